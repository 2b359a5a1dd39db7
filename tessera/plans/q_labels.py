"""Queries of human labels and of the comparison tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import labels as L
from ..operators import scoring as S
from ..operators import tables as C
from .adapters import ANNOTATION_ROWS, adapt, table
from .q_scoring import SCORED, scored
from .registry import query, rounded

A = f"r AS (SELECT *, label = truth AS ok FROM ({ANNOTATION_ROWS}))"
LAST = f"{A}, last AS (SELECT annotator, item, label FROM (SELECT *, row_number() OVER (PARTITION BY annotator, item ORDER BY shipped DESC, ord DESC, line DESC, label DESC) AS k FROM r) WHERE k = 1)"


def rows(spark, sf):
    return adapt(spark, sf, ANNOTATION_ROWS).withColumn("ok", F.col("label") == F.col("truth"))


def last(spark, sf):
    return L.last_labels(rows(spark, sf), "annotator", "item", "label", ["shipped", "ord", "line"])


@query("""SELECT 'duplicate_id' AS violation, count(*) AS n_found FROM (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) > 1)
  UNION ALL SELECT 'bad_label', count(*) FROM lineitem WHERE l_returnflag NOT IN ('A', 'R') UNION ALL SELECT 'wrong_count', count(*) FROM lineitem""")
def h1_validate_items(spark, sf):
    return L.validate_items(table(spark, sf, "lineitem"), "l_orderkey", "l_returnflag", ("A", "R"), 450)


_SUM = "count(*) AS n_rows, count(DISTINCT annotator) AS n_annotators, round(avg(CAST(ok AS INT)), 6) AS accuracy, round(avg(response_time) + 1e-7, 4) AS mean_time, round(avg(replay), 6) AS mean_replay, round(avg(CAST(label = 'A' AS INT)), 6) AS share_up, round(avg(CAST(label = 'R' AS INT)), 6) AS share_down"


@query(f"WITH {A} SELECT category, difficulty, {_SUM} FROM r GROUP BY 1, 2")
def h2_annotation_summary(spark, sf):
    s = L.annotation_summary(rows(spark, sf), ["category", "difficulty"], "annotator", "ok", "response_time", "replay", "label", "A", "R")
    return rounded(s.withColumn("mean_time", F.round(F.col("mean_time") + 1e-7, 4)))


def _pivot(col, values, v="CAST(ok AS INT)"):
    return ", ".join(f"round(avg({v}) FILTER ({col} = '{x}'), 6) AS {x}" for x in values)


CURVES = ("linear", "quad_first_flat", "quad_last_flat", "jump")
TIERS = ("low", "mid", "high")
CATS = ("volume", "echo", "pitch")


@query(f"WITH {A} SELECT category, {_pivot('trajectory', CURVES)} FROM r GROUP BY 1")
def h3_accuracy_matrix(spark, sf):
    return rounded(L.accuracy_matrix(rows(spark, sf), "category", "trajectory", CURVES, "ok"))


_AGG = "count(*) AS n_rows, round(avg(CAST(ok AS INT)), 6) AS accuracy, round(avg(response_time) + 1e-7, 4) AS mean_time, round(avg(replay), 6) AS mean_replay"


@query(f"WITH {A} SELECT annotator, 'overall' AS scope, 'all' AS key, {_AGG} FROM r GROUP BY 1 " + " ".join(f"UNION ALL SELECT annotator, 'by_{k}', {k}, {_AGG} FROM r GROUP BY annotator, {k}" for k in ("category", "difficulty", "trajectory")))
def h4_annotator_summary(spark, sf):
    s = L.annotator_summary(rows(spark, sf), "annotator", ("category", "difficulty", "trajectory"), "ok", "response_time", "replay")
    return rounded(s.withColumn("mean_time", F.round(F.col("mean_time") + 1e-7, 4)))


@query(f"""WITH {LAST}, c AS (SELECT item, label, count(*) AS c FROM last GROUP BY 1, 2) SELECT item, CAST(sum(c) AS BIGINT) AS n_labels, (list(label ORDER BY c DESC, label))[1] AS majority,
  round(CASE WHEN sum(c) <= 1 THEN 1.0 ELSE sum(c * (c - 1)) / CAST(sum(c) * (sum(c) - 1) AS DOUBLE) END, 6) AS agreement FROM c GROUP BY item""")
def h5_item_consensus(spark, sf):
    return rounded(L.item_consensus(last(spark, sf), "item", "label"))


@query(f"""WITH {LAST}, p AS (SELECT x.annotator AS a, y.annotator AS b, count(*) AS n, count(*) FILTER (x.label = y.label) AS same, count(*) FILTER (x.label = 'A') AS pa, count(*) FILTER (y.label = 'A') AS pb
  FROM last x JOIN last y ON x.item = y.item AND x.annotator < y.annotator GROUP BY 1, 2), q AS (SELECT *, (pa * pb + (n - pa) * (n - pb)) / CAST(n * n AS DOUBLE) AS e, same / CAST(n AS DOUBLE) AS o FROM p)
  SELECT a, b, n AS n_shared, round(o, 6) AS agreement, round(CASE WHEN e >= 1 THEN 1.0 ELSE (o - e) / (1 - e) END, 6) AS kappa FROM q""")
def h6_h7_pairwise_kappa(spark, sf):
    return rounded(L.pairwise(last(spark, sf), "annotator", "item", "label", "A"))


@query(f"WITH {A}, g AS (SELECT category, difficulty, annotator, avg(CAST(ok AS INT)) AS acc FROM r GROUP BY 1, 2, 3) SELECT category, difficulty, round(avg(acc), 6) AS accuracy, count(*) AS n_annotators FROM g GROUP BY 1, 2")
def h8_mean_of_annotators(spark, sf):
    return rounded(L.mean_of_annotators(rows(spark, sf), ["category", "difficulty"], "annotator", "ok"))


@query(f"""WITH {A}, i AS (SELECT p_partkey AS item, p_size % 4 AS category FROM part), t AS (SELECT category, count(DISTINCT item) AS n_items FROM i GROUP BY 1),
  d AS (SELECT annotator, category, count(DISTINCT r.item) AS n_done FROM r JOIN i ON r.item = i.item GROUP BY 1, 2)
  SELECT s_suppkey AS annotator, t.category, n_items, coalesce(n_done, 0) AS n_done, coalesce(n_done, 0) >= n_items AS complete FROM supplier CROSS JOIN t LEFT JOIN d ON d.annotator = s_suppkey AND d.category = t.category""".replace("r.*, ", "").replace("SELECT annotator, category, count(DISTINCT r.item)", "SELECT r.annotator, i.category, count(DISTINCT r.item)"))
def h9_progress(spark, sf):
    items = table(spark, sf, "part").select(F.col("p_partkey").alias("item"), (F.col("p_size") % 4).alias("category"))
    who = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("annotator"))
    return rounded(L.progress(items, rows(spark, sf), who, "annotator", "item", "category"))


@query(f"""WITH {A}, q AS (SELECT s_suppkey AS annotator, p_partkey AS item, p_size % 4 AS category FROM supplier JOIN part ON p_partkey % 20 = s_suppkey % 20)
  SELECT annotator, item AS next_item FROM (SELECT *, row_number() OVER (PARTITION BY annotator ORDER BY category, item) AS k FROM q
  WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.annotator = q.annotator AND r.item = q.item)) WHERE k = 1""")
def h10_next_item(spark, sf):
    items = table(spark, sf, "part").select(F.col("p_partkey").alias("item"), (F.col("p_size") % 4).alias("category"), (F.col("p_partkey") % 20).alias("slot"))
    who = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("annotator"), (F.col("s_suppkey") % 20).alias("slot"))
    done = adapt(spark, sf, "SELECT l_suppkey AS annotator, l_partkey AS item FROM lineitem WHERE l_returnflag IN ('A', 'R')")  # the pairs of rows()
    return L.next_item(who, items, done, "annotator", "item", "slot", ["category"])


@query(f"WITH {A} SELECT annotator, item, ord, line, label, truth, response_time, coalesce(CASE WHEN line = 1 THEN replay > 25 END, label = CASE WHEN line > 3 THEN truth ELSE 'A' END) AS is_right FROM r")
def h11_row_correctness(spark, sf):
    r = rows(spark, sf).withColumns({"stored": F.when(F.col("line") == 1, F.col("replay") > 25), "late": F.when(F.col("line") > 3, F.col("truth")), "fallback": F.lit("A")})
    return L.row_correctness(r, "stored", ["label"], ["late", "fallback"]).select("annotator", "item", "ord", "line", "label", "truth", "response_time", "is_right")


#: Accuracy by series (models, and the source clips in the place of humans), category, curve, tier and prompt variant.
ACC = f"{SCORED}, acc AS (SELECT CASE WHEN model = 0 THEN 'human' ELSE 'model' || model END AS series, model, category, curve, tier, variant, avg(coalesce(CAST(pred = gold AS INT), 0)) AS accuracy FROM s GROUP BY ALL)"
EVENTS = ("view", "click", "purchase")


def acc(spark, sf, *by):
    s = scored(spark, sf).withColumn("series", F.when(F.col("model") == 0, "human").otherwise(F.concat(F.lit("model"), F.col("model").cast("string"))))
    return s.groupBy(*by).agg(S.share(F.col("pred") == F.col("gold")).alias("accuracy"))


def _acc(*by):
    name = {"series": "CASE WHEN model = 0 THEN 'human' ELSE 'model' || model END AS series"}
    return f"{SCORED}, acc AS (SELECT {', '.join(name.get(b, b) for b in by)}, avg(coalesce(CAST(pred = gold AS INT), 0)) AS accuracy FROM s GROUP BY ALL)"


_T1 = ", ".join(f"avg(accuracy) FILTER (category = '{c}') AS {c}" for c in EVENTS)
_BEST = ", ".join(f"coalesce(series <> 'human' AND abs({c} - max({c}) FILTER (series <> 'human') OVER ()) <= 1e-12, false) AS best_{c}" for c in (*EVENTS, "avg"))


@query(f"WITH {_acc('series', 'category')}, t AS (SELECT series, {_T1} FROM acc GROUP BY 1), u AS (SELECT *, list_avg([{', '.join(EVENTS)}]) AS avg FROM t) SELECT series, {', '.join(f'round({c}, 6) AS {c}' for c in (*EVENTS, 'avg'))}, {_BEST} FROM u")
def t1_human_model_table(spark, sf):
    return rounded(C.human_model_table(acc(spark, sf, "series", "category"), EVENTS))


@query(f"WITH {_acc('series', 'category', 'curve')} SELECT series, {_pivot('curve', CURVES, 'accuracy')} FROM acc GROUP BY 1")
def t2_trajectory_table(spark, sf):
    return rounded(C.trajectory_table(acc(spark, sf, "series", "category", "curve"), CURVES))


@query(f"WITH {_acc('series', 'category', 'tier')} SELECT category, series, {_pivot('tier', TIERS, 'accuracy')} FROM acc GROUP BY 1, 2")
def t3_tier_table(spark, sf):
    return rounded(C.tier_table(acc(spark, sf, "series", "category", "tier"), TIERS))


@query(f"WITH {_acc('sample_origin', 'category')}, t AS (SELECT sample_origin AS dataset, {_T1} FROM acc GROUP BY 1) SELECT dataset, {', '.join(f'round({c}, 6) AS {c}' for c in EVENTS)}, round(list_avg([{', '.join(EVENTS)}]), 6) AS avg FROM t")
def t4_domain_table(spark, sf):
    return rounded(C.domain_table(acc(spark, sf, "sample_origin", "category").withColumnRenamed("sample_origin", "dataset"), EVENTS))


VARIANTS = ("default", "swap", "paraphrase")
_V = f"""{_acc('model', 'category', 'variant')}, w AS (SELECT *, abs(accuracy - max(accuracy) OVER (PARTITION BY model, category)) <= 1e-12 AS win FROM acc),
  g AS (SELECT model, variant, avg(accuracy) AS mean_accuracy, count(*) FILTER (win) AS wins FROM w GROUP BY 1, 2), v AS (SELECT *, mean_accuracy - max(mean_accuracy) FILTER (variant = 'default') OVER (PARTITION BY model) AS delta FROM g)"""


@query(f"WITH {_V} SELECT model, variant, round(mean_accuracy, 6) AS mean_accuracy, wins, round(delta, 6) AS delta FROM v")
def t5_variant_comparison(spark, sf):
    return rounded(C.variant_comparison(acc(spark, sf, "model", "category", "variant"), VARIANTS))


@query(f"""WITH {_V}, o AS (SELECT *, list_position(['default', 'swap', 'paraphrase'], variant) AS pos FROM v)
  SELECT model, (list(variant ORDER BY mean_accuracy DESC, pos))[1] AS best_variant, (list(variant ORDER BY mean_accuracy, pos))[1] AS worst_variant, round(max(mean_accuracy) - min(mean_accuracy), 6) AS gap FROM o GROUP BY 1""")
def t5_variant_extremes(spark, sf):
    return rounded(C.variant_extremes(C.variant_comparison(acc(spark, sf, "model", "category", "variant"), VARIANTS), VARIANTS))


@query(f"""WITH {_acc('model', 'category', 'variant')}, j AS (SELECT x.model, x.variant, x.category, x.accuracy - b.accuracy AS shift FROM acc x JOIN acc b ON x.model = b.model AND x.category = b.category AND b.variant = 'default' WHERE x.variant <> 'default')
  SELECT model, variant, category, round(shift, 6) AS shift FROM (SELECT *, row_number() OVER (PARTITION BY model, variant ORDER BY round(abs(shift), 12) DESC, category) AS k FROM j) WHERE k = 1""")
def t6_largest_shift(spark, sf):
    return rounded(C.largest_shift(acc(spark, sf, "model", "category", "variant"), "default"))


@query(f"WITH {_acc('model', 'category', 'variant')} SELECT category, variant, model, round(accuracy, 6) AS accuracy FROM (SELECT *, row_number() OVER (PARTITION BY category, variant ORDER BY round(accuracy, 12) DESC, model) AS k FROM acc) WHERE k = 1")
def t7_category_leaders(spark, sf):
    return rounded(C.category_leaders(acc(spark, sf, "model", "category", "variant")))


_NAMED = "'model-' || (5 - model)"


@query(f"WITH {_acc('model', 'category', 'variant')}, named AS (SELECT category, variant, {_NAMED} AS model, accuracy FROM acc) SELECT category, variant, model, round(accuracy, 6) AS accuracy FROM (SELECT *, row_number() OVER (PARTITION BY category, variant ORDER BY round(accuracy, 12) DESC, model) AS k FROM named) WHERE k = 1")
def t7_named_leaders(spark, sf):
    """Leaders among models with names, as models have outside these tables."""
    return rounded(C.category_leaders(acc(spark, sf, "model", "category", "variant").withColumn("model", F.expr(_NAMED))))


_X = f"{_acc('model', 'category', 'tier')}, x AS (SELECT model, category AS actual, CASE tier WHEN 'low' THEN 'view' WHEN 'mid' THEN 'click' ELSE 'purchase' END AS asked, accuracy FROM acc)"


def _cross(spark, sf):
    asked = F.when(F.col("tier") == "low", "view").when(F.col("tier") == "mid", "click").otherwise("purchase")
    return acc(spark, sf, "model", "category", "tier").select("model", F.col("category").alias("actual"), asked.alias("asked"), "accuracy")


@query(f"""WITH {_X} SELECT model, round(count(*) / 15.0, 6) AS coverage, round(avg(accuracy), 6) AS mean_all, round(avg(accuracy) FILTER (actual = asked), 6) AS mean_diagonal, round(avg(accuracy) FILTER (actual <> asked), 6) AS mean_off,
  (list(actual || '/' || asked ORDER BY round(accuracy, 12) DESC, actual || '/' || asked))[1] AS best_pair, (list(actual || '/' || asked ORDER BY round(accuracy, 12), actual || '/' || asked))[1] AS worst_pair FROM x GROUP BY 1""")
def t8_cross_attribute_summary(spark, sf):
    return rounded(C.cross_attribute_summary(_cross(spark, sf), 15))


@query(f"WITH {_X} SELECT actual, asked, round(avg(accuracy), 6) AS mean_accuracy, count(*) AS n_models FROM x GROUP BY 1, 2")
def t9_cross_attribute_matrix(spark, sf):
    return rounded(C.cross_attribute_matrix(_cross(spark, sf)))


@query(f"""WITH {_X}, m AS (SELECT actual, asked, avg(accuracy) AS mean_accuracy, count(*) AS n_models FROM x GROUP BY 1, 2),
  k AS (SELECT *, row_number() OVER (ORDER BY round(mean_accuracy, 12) DESC, actual, asked) AS hi, row_number() OVER (ORDER BY round(mean_accuracy, 12), actual, asked) AS lo FROM m)
  SELECT actual, asked, round(mean_accuracy, 6) AS mean_accuracy, n_models, 'best' AS side FROM k WHERE hi <= 4 UNION ALL SELECT actual, asked, round(mean_accuracy, 6), n_models, 'worst' FROM k WHERE lo <= 4""")
def t9_extreme_pairs(spark, sf):
    return rounded(C.extreme_pairs(C.cross_attribute_matrix(_cross(spark, sf)), 4))


_GRID = "gr AS (SELECT m.model, a.actual, q.asked FROM (SELECT DISTINCT model FROM x) m, (SELECT DISTINCT actual FROM x) a, (SELECT DISTINCT asked FROM x) q), y AS (SELECT * FROM x WHERE NOT (model = 2 AND actual = 'click') AND NOT (model = 4 AND asked = 'view'))"


def _gaps(spark, sf):
    """The accuracies with some pairs taken out, and the whole grid."""
    x = _cross(spark, sf)
    grid = x.select("model").distinct().crossJoin(F.broadcast(x.select("actual").distinct())).crossJoin(F.broadcast(x.select("asked").distinct()))
    return x.filter("not (model = 2 and actual = 'click') and not (model = 4 and asked = 'view')"), grid


@query(f"""WITH {_X}, {_GRID}, j AS (SELECT gr.*, y.accuracy FROM gr LEFT JOIN y ON gr.model = y.model AND gr.actual = y.actual AND gr.asked = y.asked)
  SELECT 'by_actual' AS scope, actual AS key, count(accuracy) AS n_found, count(*) AS n_possible FROM j GROUP BY actual UNION ALL SELECT 'by_model', CAST(model AS VARCHAR), count(accuracy), count(*) FROM j GROUP BY model""")
def t9_coverage(spark, sf):
    return C.cross_attribute_coverage(*_gaps(spark, sf))


@query(f"WITH {_X}, {_GRID} SELECT model, actual, asked FROM gr EXCEPT SELECT model, actual, asked FROM y")
def t9_missing_pairs(spark, sf):
    return C.cross_attribute_gaps(*_gaps(spark, sf))


_G = f"""{_acc('model', 'category', 'curve', 'tier')}, rec AS (SELECT tier AS scope, CASE curve WHEN 'linear' THEN 'view' WHEN 'jump' THEN 'click' ELSE 'purchase' END AS train_category, category AS test_category, accuracy FROM acc),
  base AS (SELECT category AS test_category, avg(accuracy) AS base_accuracy FROM acc WHERE category <> 'view' GROUP BY 1),
  g AS (SELECT rec.*, base_accuracy, train_category = rec.test_category AS in_domain, accuracy - base_accuracy AS delta FROM rec LEFT JOIN base ON rec.test_category = base.test_category)"""


def _gen(spark, sf):
    a = acc(spark, sf, "model", "category", "curve", "tier")
    train = F.when(F.col("curve") == "linear", "view").when(F.col("curve") == "jump", "click").otherwise("purchase")
    base = a.filter("category <> 'view'").groupBy(F.col("category").alias("test_category")).agg(F.avg("accuracy").alias("base_accuracy"))
    return C.generalization(a.select(F.col("tier").alias("scope"), train.alias("train_category"), F.col("category").alias("test_category"), "accuracy"), base)


_GM = "round(avg(accuracy), 6) AS accuracy, round(avg(delta), 6) AS delta, count(*) AS n FROM g GROUP BY ALL"


@query(f"""WITH {_G} SELECT 'scope+train_category+in_domain' AS level, scope, train_category, in_domain, {_GM} UNION ALL SELECT 'scope+in_domain', scope, NULL, in_domain, {_GM} UNION ALL SELECT 'scope+train_category', scope, train_category, NULL, {_GM}""")
def t10_generalization(spark, sf):
    return rounded(C.generalization_means(_gen(spark, sf)))


@query(f"WITH {_G} SELECT scope, train_category, {', '.join(f'round(avg(accuracy) FILTER (test_category = {c!r}), 6) AS {c}' for c in ('view', 'click', 'purchase'))} FROM g GROUP BY 1, 2")
def t10_generalization_matrix(spark, sf):
    return rounded(C.generalization_matrix(_gen(spark, sf), ("view", "click", "purchase")))


@query(f"""WITH {_acc('model', 'category', 'curve', 'tier')}, rec AS (SELECT tier AS method, model, CASE curve WHEN 'linear' THEN 'view' WHEN 'jump' THEN 'click' ELSE 'purchase' END AS train_category, category, accuracy FROM acc),
  d AS (SELECT method, model, category, avg(accuracy) AS accuracy FROM rec WHERE train_category = category GROUP BY ALL), u AS (SELECT * FROM d UNION ALL SELECT method, model, 'average', avg(accuracy) FROM d GROUP BY 1, 2)
  SELECT method, model, category, round(accuracy, 6) AS accuracy, abs(accuracy - max(accuracy) OVER (PARTITION BY method, category)) <= 1e-12 AS best FROM u""")
def t11_in_domain_table(spark, sf):
    a = acc(spark, sf, "model", "category", "curve", "tier")
    train = F.when(F.col("curve") == "linear", "view").when(F.col("curve") == "jump", "click").otherwise("purchase")
    r = a.select(F.col("tier").alias("method"), "model", train.alias("train_category"), F.col("category").alias("test_category"), "accuracy")
    r = r.groupBy("method", "model", "train_category", "test_category").agg(F.avg("accuracy").alias("accuracy"))
    return rounded(C.in_domain_table(r))


@query(f"WITH {_acc('model', 'category', 'curve')}, g AS (SELECT model, curve AS stage, avg(accuracy) AS m, count(DISTINCT category) AS n_categories FROM acc GROUP BY 1, 2) SELECT model, stage, round(m, 6) AS mean_accuracy, n_categories, rank() OVER (PARTITION BY model ORDER BY round(m, 12) DESC NULLS LAST) AS rank FROM g")
def t12_stage_comparison(spark, sf):
    return rounded(C.stage_comparison(acc(spark, sf, "model", "category", "curve").withColumnRenamed("curve", "stage")))


@query(f"WITH {SCORED} SELECT category FROM s WHERE NOT (model = 1 AND category = 'click') GROUP BY 1 HAVING count(DISTINCT model) = 5")
def t12_shared_categories(spark, sf):
    return C.shared_categories(acc(spark, sf, "model", "category").filter("not (model = 1 and category = 'click')"))


_LAYER = "list_position(['linear', 'quad_first_flat', 'quad_last_flat', 'jump'], curve)"


def _layers(spark, sf, *more):
    layer = F.array_position(F.array(*[F.lit(c) for c in CURVES]), F.col("curve"))
    return acc(spark, sf, "model", "curve", *more).withColumn("layer", layer).withColumnRenamed("accuracy", "value")


@query(f"""WITH {_acc('model', 'curve')}, p AS (SELECT model, {_LAYER} AS layer, accuracy AS value FROM acc) SELECT model, CAST((list(layer ORDER BY round(value, 12) DESC, layer))[1] AS BIGINT) AS best_layer, round((list(value ORDER BY round(value, 12) DESC, layer))[1], 6) AS best_value,
  CAST(max(layer) AS BIGINT) AS final_layer, round((list(value ORDER BY layer DESC))[1], 6) AS final_value FROM p GROUP BY 1""")
def t13_best_layer(spark, sf):
    return rounded(C.best_layer(_layers(spark, sf)))


@query(f"WITH {_acc('model', 'curve', 'tier', 'category')}, p AS (SELECT model AS stream, tier AS position, {_LAYER} AS layer, category, accuracy AS value FROM acc) SELECT stream, position, {', '.join(f'round(avg(value) FILTER (layer = {k}), 6) AS layer_{k}' for k in (1, 2, 4))} FROM p GROUP BY 1, 2")
def t14_position_layer_table(spark, sf):
    p = _layers(spark, sf, "tier", "category").select(F.col("model").alias("stream"), F.col("tier").alias("position"), "layer", "category", "value")
    return rounded(C.position_layer_table(p, (1, 2, 4)))

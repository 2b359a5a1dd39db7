"""Queries of the text functions and of scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import scoring as S
from .adapters import PREDICTIONS, adapt, table
from .registry import query, rounded

INC, DEC = (r"\b(" + "|".join(w) + r")\b" for w in (T.INCREASE, T.DECREASE))
INC_S, DEC_S = (r"\b(" + "|".join(w) + r")\b" for w in (T.INCREASE_SYNONYMS, T.DECREASE_SYNONYMS))


def _m(col, pattern):
    return f"regexp_matches(lower(coalesce({col}, '')), '{pattern}')"


def _dir(col, inc=INC, dec=DEC):
    return f"CASE WHEN {_m(col, inc)} AND NOT {_m(col, dec)} THEN 'increase' WHEN {_m(col, dec)} AND NOT {_m(col, inc)} THEN 'decrease' END"


SCORED = f"""s AS (SELECT *, gold_label AS gold, CASE WHEN error IS NOT NULL THEN NULL ELSE {_dir('raw_response')} END AS pred,
  {_m('raw_response', INC)} AND {_m('raw_response', DEC)} AS ambiguous, error IS NOT NULL AS failed FROM ({PREDICTIONS}))"""
R = "round({0}, 6)"


def _ratio(a, b):
    return f"round(CASE WHEN {b} = 0 THEN 0.0 ELSE ({a}) / CAST({b} AS DOUBLE) END, 6)"


COUNTS = """count(*) AS n_rows, count(pred) AS n_parsed, count(*) - count(pred) AS n_unparsed, count(*) FILTER (pred = gold) AS n_correct,
  count(*) FILTER (ambiguous) AS n_ambiguous, count(*) FILTER (failed) AS n_error,
  count(*) FILTER (pred = 'increase' AND gold = 'increase') AS tp, count(*) FILTER (pred = 'increase' AND gold = 'decrease') AS fp,
  count(*) FILTER (pred = 'decrease' AND gold = 'increase') AS fn, count(*) FILTER (pred = 'decrease' AND gold = 'decrease') AS tn,
  count(*) FILTER (gold = 'increase') AS n_up, count(*) FILTER (gold = 'decrease') AS n_down"""
METRICS = f"""n_rows, n_parsed, n_unparsed, n_correct, n_ambiguous, n_error, tp, fp, fn, tn,
  {_ratio('n_correct', 'n_rows')} AS accuracy, {_ratio('n_correct', 'n_parsed')} AS accuracy_parsed,
  round(tp / CAST(nullif(n_up, 0) AS DOUBLE), 6) AS accuracy_up, round(tn / CAST(nullif(n_down, 0) AS DOUBLE), 6) AS accuracy_down,
  round(coalesce(list_avg([tp / CAST(nullif(n_up, 0) AS DOUBLE), tn / CAST(nullif(n_down, 0) AS DOUBLE)]), 0), 6) AS balanced_accuracy,
  {_ratio('tp', '(tp + fp)')} AS precision_increase, {_ratio('tp', 'n_up')} AS recall_increase,
  {_ratio('2 * tp', '(n_up + tp + fp)')} AS f1_increase,
  {_ratio('tp + fp', 'n_parsed')} AS increase_ratio_parsed, {_ratio('tp + fp', 'n_rows')} AS increase_ratio_all"""


def scored(spark, sf, synonyms=None):
    return S.score_rows(adapt(spark, sf, PREDICTIONS), synonyms=synonyms)


@query(f"SELECT conv_id, turn, {_dir('text')} AS label, {_dir('text', INC_S, DEC_S)} AS wide_label, {_m('text', INC)} AND {_m('text', DEC)} AS ambiguous, NOT ({_m('text', INC)} OR {_m('text', DEC)}) AS retry FROM conversations")
def f1_f2_f3_parse_prose(spark, sf):
    c = F.col("text")
    return table(spark, sf, "conversations").select("conv_id", "turn", T.parse_direction(c).alias("label"), T.parse_direction_synonyms(c).alias("wide_label"), T.is_ambiguous(c).alias("ambiguous"), T.needs_retry(c).alias("retry"))


@query(f"SELECT clip_id, {_dir('raw_response')} AS label, {_dir('raw_response', INC_S, DEC_S)} AS wide_label, {_m('raw_response', INC)} AND {_m('raw_response', DEC)} AS ambiguous, NOT ({_m('raw_response', INC)} OR {_m('raw_response', DEC)}) AS retry FROM ({PREDICTIONS})")
def f1_f2_f3_parse_answers(spark, sf):
    c = F.col("raw_response")
    return adapt(spark, sf, PREDICTIONS).select("clip_id", T.parse_direction(c).alias("label"), T.parse_direction_synonyms(c).alias("wide_label"), T.is_ambiguous(c).alias("ambiguous"), T.needs_retry(c).alias("retry"))


_TERN = "CASE {0} WHEN 'increases' THEN 'increase' WHEN 'decreases' THEN 'decrease' WHEN '' THEN NULL ELSE {0} END"


@query(f"""SELECT clip_id, {_TERN.format(r"regexp_extract(lower(trim(raw_response)), '\b(increases|increase|decreases|decrease|constant)\b', 1)")} AS ternary,
  nullif(regexp_extract(lower(trim(raw_response)), '\\b(yes|no)\\b', 1), '') AS yes_no FROM ({PREDICTIONS})""")
def f4_parse_first_label(spark, sf):
    c = F.col("raw_response")
    return adapt(spark, sf, PREDICTIONS).select("clip_id", T.parse_first_label(c, T.TERNARY).alias("ternary"), T.parse_first_label(c, T.YES_NO).alias("yes_no"))


@query(f"SELECT clip_id, CASE direction WHEN 'up' THEN 'increase' WHEN 'down' THEN 'decrease' END AS gold, CASE WHEN lower(trim(raw_response)) IN ('increase', 'decrease') THEN lower(trim(raw_response)) END AS answer FROM ({PREDICTIONS})")
def f5_normalize_label(spark, sf):
    return adapt(spark, sf, PREDICTIONS).select("clip_id", T.normalize_label(F.col("direction")).alias("gold"), T.normalize_label(F.col("raw_response")).alias("answer"))


@query(f"SELECT clip_id, CASE WHEN error IS NOT NULL THEN NULL WHEN wide THEN {_dir('raw_response', INC_S, DEC_S)} ELSE {_dir('raw_response')} END AS pred FROM ({PREDICTIONS})")
def f6_prediction_for_row(spark, sf):
    return scored(spark, sf, "wide").select("clip_id", "pred")


@query("SELECT doc_id, md5(trim(regexp_replace(text, '[\\s\\x0B]+', ' ', 'g'))) AS digest FROM documents")
def f7_normalize_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(T.normalize_text(F.col("text"))).alias("digest"))


@query("""SELECT c_custkey, CASE WHEN lower(c_mktsegment) LIKE '%build%' THEN 'Build' WHEN lower(c_mktsegment) LIKE '%auto%' THEN 'Auto' ELSE 'Others' END AS accent,
  CASE c_nationkey % 3 WHEN 0 THEN 'male' WHEN 1 THEN 'female' ELSE 'unknown' END AS gender FROM customer""")
def f8_canonical_groups(spark, sf):
    g = F.element_at(F.array(F.lit(" M "), F.lit("Woman"), F.lit("n/a")), (F.col("c_nationkey") % 3 + 1).cast("int"))
    return table(spark, sf, "customer").select("c_custkey", T.canonical_accent(F.col("c_mktsegment"), ("Build", "Auto")).alias("accent"), T.canonical_gender(g).alias("gender"))


@query("SELECT page_id, regexp_replace(trim(url), '[^\\p{L}\\p{N}._-]', '_', 'g') || '.wav' AS file FROM pages WHERE length(trim(url)) > 0")
def f9_safe_filename(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.safe_filename(F.col("url")).alias("file")).filter("file is not null")


@query("SELECT event_id, sha256('7:' || event_id || ':' || event_type) AS ord, CAST(CAST(('0x' || substr(sha256('7:' || event_id || ':' || event_type), 1, 8)) AS BIGINT) AS DECIMAL(20,0)) AS seed_high FROM events")
def f10_stable_seed(spark, sf):
    c = [F.col("event_id"), F.col("event_type")]
    high = F.floor(T.stable_seed(F.lit(7), *c) / F.lit(4294967296).cast("decimal(20,0)")).cast("decimal(20,0)")
    return table(spark, sf, "events").select("event_id", T.hash_order(7, *c).alias("ord"), high.alias("seed_high"))


@query(f"SELECT clip_id, 'src__' || model AS source_id, CAST(clip_id AS VARCHAR) AS clip, curve, tier, direction FROM ({PREDICTIONS})")
def f11_split_clip_id(spark, sf):
    joined = F.concat_ws("__", F.lit("src"), F.col("model").cast("string"), F.col("clip_id").cast("string"), "curve", "tier", "direction")
    return adapt(spark, sf, PREDICTIONS).select("clip_id", T.split_clip_id(joined).alias("p")).select("clip_id", "p.*")


_CURVE = "CASE curve WHEN 'linear' THEN t WHEN 'quad_first_flat' THEN t * t WHEN 'quad_last_flat' THEN 1 - (1 - t) * (1 - t) ELSE CASE WHEN t < 0.5 THEN 0.0 ELSE 1.0 END END"


@query(f"SELECT clip_id, round({_CURVE}, 6) AS progress FROM (SELECT *, CASE WHEN clip_id % 20 = 0 THEN 1.0 ELSE (clip_id % 20) / 19.0 END AS t FROM ({PREDICTIONS}))".replace("WHEN clip_id % 20 = 0 THEN 1.0 ELSE (clip_id % 20) / 19.0", "WHEN model = 0 THEN 1.0 ELSE (clip_id % 20) / 19.0"))
def f12_step_progress(spark, sf):
    n = F.when(F.col("model") == 0, 1).otherwise(20)
    return rounded(adapt(spark, sf, PREDICTIONS).select("clip_id", T.step_progress(F.col("clip_id") % 20, n, F.col("curve")).alias("progress")))


@query(f"""SELECT clip_id, 'Does the ' || replace(category, '_', ' ') || ' increase or decrease over time?' || chr(10) || chr(10) || 'Answer with only one word: "increase" or "decrease".' AS prompt,
  'Does the ' || replace(category, '_', ' ') || ' of this audio clip decrease or increase over time?' || chr(10) || chr(10) || 'Answer with only one word: "decrease" or "increase".' AS swapped,
  'How does the ' || replace(category, '_', ' ') || ' vary with time?' || chr(10) || chr(10) || 'Answer with only one word: "increase", "decrease" or "constant".' AS ternary FROM ({PREDICTIONS})""")
def f13_build_prompt(spark, sf):
    c = F.col("category")
    return adapt(spark, sf, PREDICTIONS).select("clip_id", T.build_prompt(c).alias("prompt"), T.build_prompt(c, True, True).alias("swapped"), T.build_format_prompt(c, "ternary").alias("ternary"))


_ASKED = "CASE event_id % 4 WHEN 0 THEN 'volume' WHEN 1 THEN 'voice_pitch' WHEN 2 THEN 'speaking_speed' ELSE 'echo' END"
_WORDINGS = ", ".join(
    "('{}', '{}', '{}', '{}', '{}')".format(category, *variant) for category, variants in T.PARAPHRASES.items() for variant in variants
)


@query(f"""SELECT event_id, asked, variant, question || chr(10) || chr(10) || 'Answer with only one word: "' || up || '" or "' || down || '".' AS prompt
FROM (SELECT event_id, {_ASKED} AS asked FROM events) JOIN (VALUES {_WORDINGS}) v(category, variant, question, up, down) ON asked = category""")
def f13_paraphrased_prompts(spark, sf):
    asked = table(spark, sf, "events").select("event_id", F.expr(_ASKED).alias("asked"))
    return asked.select("event_id", "asked", F.explode(T.paraphrased_prompts(F.col("asked"))).alias("p")).select("event_id", "asked", "p.variant", "p.prompt")


@query("""SELECT event_id, 'What is the speaker''s ' || event_type || ' in this audio?' || chr(10) || chr(10) || 'Options:' || chr(10) || 'A. low' || chr(10) || 'B. high'
  || chr(10) || chr(10) || 'Answer with only the option letter.' AS prompt FROM events""")
def f13_option_prompts(spark, sf):
    shape = T.build_option_prompt("%s", ["low", "high"])
    return table(spark, sf, "events").select("event_id", F.format_string(shape, "event_type").alias("prompt"))


@query("""SELECT vec_id, list_position(v, list_max(v)) - 1 AS best, round(exp(v[1] - list_max(v)) / list_sum([exp(x - list_max(v)) for x in v]), 6) AS p_first
FROM (SELECT vec_id, [round(CAST(embedding[1] AS DOUBLE), 1), round(CAST(embedding[2] AS DOUBLE), 1), round(CAST(embedding[3] AS DOUBLE), 1)] AS v FROM embeddings)""")
def f14_f15_options(spark, sf):
    v = F.create_map(*[x for i, k in enumerate("ABC") for x in (F.lit(k), F.round(F.col("embedding")[i].cast("double"), 1))])
    df = table(spark, sf, "embeddings").select("vec_id", v.alias("m"))
    best = F.instr(F.lit("ABC"), T.argmax_option(F.col("m"), "ABC")) - 1
    return rounded(df.select("vec_id", best.cast("long").alias("best"), T.softmax_options(F.col("m"))["A"].alias("p_first")))


@query("SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'kimi-audio' WHEN 1 THEN lower(s_name) ELSE lower(s_name) END AS slug FROM supplier")
def f16_model_slug(spark, sf):
    ids = F.when(F.col("s_suppkey") % 3 == 0, "moonshotai/Kimi-Audio-7B-Instruct").when(F.col("s_suppkey") % 3 == 1, F.concat(F.lit("Org/"), "s_name")).otherwise(F.col("s_name"))
    return table(spark, sf, "supplier").select("s_suppkey", T.model_slug(ids).alias("slug"))


@query(f"WITH {SCORED}, c AS (SELECT model, category, {COUNTS} FROM s GROUP BY model, category) SELECT model, category, {METRICS} FROM c")
def m1_binary_metrics(spark, sf):
    return rounded(S.binary_metrics(scored(spark, sf), ["model", "category"]))


_SCOPES = " UNION ALL ".join([f"SELECT 'overall' AS scope, 'all' AS key, {COUNTS} FROM s", *[f"SELECT 'by_{k}', {k}, {COUNTS} FROM s GROUP BY {k}" for k in ("category", "tier", "curve", "direction")]])


@query(f"WITH {SCORED}, c AS ({_SCOPES}) SELECT scope, key, {METRICS} FROM c")
def m2_summarize(spark, sf):
    return rounded(S.summarize(scored(spark, sf)))


@query(f"""SELECT model, response, n, first_at, rank FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY n DESC, first_at) AS rank FROM
  (SELECT model, coalesce(raw_response, '') AS response, count(*) AS n, min(clip_id) AS first_at FROM ({PREDICTIONS}) GROUP BY 1, 2)) WHERE rank <= 5""")
def m3_top_responses(spark, sf):
    return rounded(S.top_responses(adapt(spark, sf, PREDICTIONS), "model", "raw_response", "clip_id", 5))


@query(f"""WITH p AS ({PREDICTIONS}) SELECT category, 'origin' AS attribute, min(sample_origin) AS value FROM p GROUP BY category HAVING count(DISTINCT sample_origin) = 1
  UNION ALL SELECT category, 'category', category FROM p GROUP BY category""")
def m4_constant_attributes(spark, sf):
    p = adapt(spark, sf, PREDICTIONS).withColumn("origin", F.col("sample_origin")).withColumn("group", F.col("category"))
    out = S.constant_attributes(p, "group", ["origin", "category", "error"])
    return out.select(F.col("group").alias("category"), "attribute", "value")


@query(f"""WITH p AS (SELECT *, clip_id % 997 AS cid, CASE WHEN clip_id % 89 = 0 THEN 'odd' ELSE gold_label END AS g FROM ({PREDICTIONS})),
  c AS (SELECT model, CASE WHEN cid % 83 = 0 THEN NULL ELSE cid END AS cid, count(*) AS n, count(*) FILTER (g = 'odd') AS bad FROM p GROUP BY 1, 2)
  SELECT model, 'invalid_gold' AS violation, CAST(sum(bad) AS BIGINT) AS n_found FROM c GROUP BY model HAVING sum(bad) > 0
  UNION ALL SELECT model, 'missing_id', CAST(sum(n) AS BIGINT) FROM c WHERE cid IS NULL GROUP BY model
  UNION ALL SELECT model, 'duplicate_id', count(*) FROM c WHERE cid IS NOT NULL AND n > 1 GROUP BY model
  UNION ALL SELECT model, 'wrong_count', CAST(sum(n) AS BIGINT) FROM c GROUP BY model HAVING sum(n) <> 100 + model""")
def m5_validate_predictions(spark, sf):
    p = adapt(spark, sf, PREDICTIONS)
    cid = F.when(F.col("clip_id") % 997 % 83 != 0, F.col("clip_id") % 997)
    p = p.withColumn("cid", cid).withColumn("gold_label", F.when(F.col("clip_id") % 89 == 0, "odd").otherwise(F.col("gold_label")))
    expected = p.select("model").distinct().withColumn("n_expected", 100 + F.col("model"))
    return S.validate_predictions(p, expected, "model", "cid")


_PARSER = "CASE model WHEN 0 THEN 'synonym-unique-direction-v1' WHEN 1 THEN 'first-hit' WHEN 2 THEN NULL ELSE 'main-unique-direction-v1' END"


@query(f"""WITH f AS (SELECT model, {_PARSER} AS parser, count(*) AS n, count(*) FILTER (wide) AS w FROM ({PREDICTIONS}) WHERE NOT (model = 4 AND wide) GROUP BY 1)
  SELECT model, 'parser_mismatch' AS violation, CASE model WHEN 0 THEN n - w ELSE w END AS n_found FROM f WHERE model IN (0, 3, 4) AND CASE model WHEN 0 THEN n - w ELSE w END > 0
  UNION ALL SELECT model, 'unknown_parser', n FROM f WHERE model IN (1, 2)""")
def m5_parser_mismatch(spark, sf):
    """Rows with and without words for their answers against the parser that a run manifest names; one file is as it should be."""
    p = adapt(spark, sf, PREDICTIONS).filter("not (model = 4 and wide)")
    expected = p.groupBy("model").agg(F.count("*").alias("n_expected")).withColumn("parser", F.expr(_PARSER))
    return S.validate_predictions(p.withColumn("key", F.monotonically_increasing_id()), expected, "model", "key", words="wide")


_MANIFEST = """SELECT CASE WHEN event_id % 101 = 0 THEN '/abs/' WHEN event_id % 103 = 0 THEN '../' WHEN event_id % 107 = 0 THEN 'a..b/' ELSE '' END || event_type || '/run.' || (event_id % 4000)
  || CASE event_id % 5 WHEN 0 THEN '.jsonl' WHEN 1 THEN '.json' ELSE '.x' END AS path FROM events WHERE event_id % 109 > 0 UNION ALL SELECT '' FROM events WHERE event_id % 109 = 0"""


@query(f"""WITH e AS (SELECT path, count(*) AS n, regexp_replace(path, '([^/])\\.[^./]+$', '\\1') || '.json' AS target FROM ({_MANIFEST}) GROUP BY 1), t AS (SELECT target, count(*) AS sharing FROM e GROUP BY 1)
  SELECT path, unnest(list_filter([CASE WHEN n > 1 THEN 'repeated_path' END, CASE WHEN path = '' THEN 'empty_path' END, CASE WHEN path <> '' AND (starts_with(path, '/') OR list_contains(string_split(path, '/'), '..')) THEN 'unsafe_path' END,
    CASE WHEN path <> '' AND sharing > 1 THEN 'colliding_output' END], lambda v: v IS NOT NULL)) AS violation FROM e JOIN t ON e.target = t.target""")
def m5_check_manifest(spark, sf):
    return S.check_manifest(adapt(spark, sf, _MANIFEST))


_OPTIONS = """SELECT CASE WHEN vec_id % 37 = 0 THEN 0 ELSE vec_id END AS id, round(CAST(embedding[{0}] AS DOUBLE), 1) AS a, round(CAST(embedding[{1}] AS DOUBLE), 1) AS b, CASE WHEN vec_id % 11 = 0 THEN NULL ELSE round(CAST(embedding[{2}] AS DOUBLE), 1) END AS c,
  CASE WHEN label = 9 THEN 'none' WHEN label % 3 = 0 THEN 'joy' WHEN label % 3 = 1 THEN 'fear' ELSE 'anger' END AS gold, CASE label % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' END AS option, CASE label % 5 WHEN 0 THEN 'joy' WHEN 1 THEN 'fear' WHEN 2 THEN 'anger' END AS stored FROM embeddings"""


@query(f"""WITH o AS (SELECT *, CASE WHEN c IS NOT NULL THEN CASE WHEN a >= b AND a >= c THEN 'A' WHEN b >= c THEN 'B' ELSE 'C' END END AS best FROM ({_OPTIONS.format(1, 2, 3)})), p AS (SELECT *, CASE best WHEN 'A' THEN 'joy' WHEN 'B' THEN 'fear' WHEN 'C' THEN 'anger' END AS meant FROM o)
  SELECT id, 'invalid_scores' AS violation FROM p WHERE best IS NULL UNION ALL SELECT id, 'invalid_gold' FROM p WHERE gold = 'none' UNION ALL SELECT id, 'stored_option' FROM p WHERE option <> best
  UNION ALL SELECT id, 'stored_label' FROM p WHERE stored <> meant UNION ALL SELECT id, 'duplicate_id' FROM p GROUP BY id HAVING count(*) > 1""")
def f14_check_options(spark, sf):
    """Stored options and labels against the best option of the scores."""
    o = adapt(spark, sf, _OPTIONS.format(0, 1, 2))
    o = o.withColumn("scores", F.create_map(F.lit("A"), "a", F.lit("B"), "b", F.lit("C"), "c"))
    return S.check_options(o, "id", "scores", "ABC", ("joy", "fear", "anger"), "gold", "option", "stored")


@query(f"SELECT model, count(*) AS n, sha256(string_agg(CAST(clip_id AS VARCHAR), chr(10) ORDER BY CAST(clip_id AS VARCHAR))) AS id_sha256 FROM ({PREDICTIONS}) GROUP BY model")
def m6_id_digest(spark, sf):
    return S.id_digest(adapt(spark, sf, PREDICTIONS), "model", "clip_id")


@query(f"""WITH i AS (SELECT model, category, CAST(clip_id % 5003 AS VARCHAR) AS id, count(*) AS k FROM ({PREDICTIONS}) GROUP BY ALL),
  r AS (SELECT model, category, substr(sha256(id), 1, 3) AS part, sum(k) AS n, sha256(string_agg(id || '=' || k, chr(10) ORDER BY id)) AS d FROM i GROUP BY ALL)
  SELECT model, category, CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(part || ':' || d, chr(10) ORDER BY part)) AS id_sha256 FROM r GROUP BY ALL""")
def m6_id_set_digest(spark, sf):
    return S.id_set_digest(adapt(spark, sf, PREDICTIONS), ["model", "category"], F.col("clip_id") % 5003)


@query(f"""WITH {SCORED}, a AS (SELECT model, avg(coalesce(CAST(pred = gold AS INT), 0)) AS accuracy, count(*) AS n_rows FROM s GROUP BY model)
  SELECT model, 'accuracy' AS metric, round(accuracy, 6) AS actual, round(accuracy + 0.25, 6) AS recorded FROM a WHERE model % 2 = 1
  UNION ALL SELECT model, 'n_rows', n_rows, n_rows + 1 FROM a WHERE model = 2""")
def m7_compare_to_reference(spark, sf):
    a = S.binary_metrics(scored(spark, sf), ["model"]).select("model", "accuracy", "n_rows")
    e = a.select("model", (F.col("accuracy") + F.when(F.col("model") % 2 == 1, 0.25).otherwise(0.0)).alias("accuracy"), (F.col("n_rows") + (F.col("model") == 2).cast("int")).alias("n_rows"))
    return rounded(S.compare_to_reference(a, e, ["model"], ["accuracy", "n_rows"]))


@query(f"WITH {SCORED} SELECT model, count(*) AS n_rows, count(pred) AS n_parsed, count(*) FILTER (pred = gold) AS n_correct, {_ratio('count(*) FILTER (pred = gold)', 'count(*)')} AS accuracy_all, {_ratio('count(*) FILTER (pred = gold)', 'count(pred)')} AS accuracy_parsed FROM s GROUP BY model")
def m8_run_totals(spark, sf):
    return rounded(S.run_totals(S.binary_metrics(scored(spark, sf), ["model", "category"]), ["model"]))


@query(f"WITH {SCORED} SELECT sample_origin, coalesce(pred, 'unparsed') AS pred, gold, count(*) AS n FROM s GROUP BY 1, 2, 3")
def m9_confusion(spark, sf):
    return S.confusion(scored(spark, sf), ["sample_origin"])


@query(f"WITH {SCORED} SELECT sample_origin, count(*) AS n_rows, count(pred) AS n_parsed, count(*) FILTER (pred = gold) AS n_correct, {_ratio('count(*) FILTER (pred = gold)', 'count(pred)')} AS accuracy_parsed, {_ratio('count(*) FILTER (pred = gold)', 'count(*)')} AS accuracy_strict FROM s GROUP BY 1")
def m9_multiclass_metrics(spark, sf):
    return rounded(S.multiclass_metrics(scored(spark, sf), ["sample_origin"]))


_F1 = "CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2.0 * tp / (2 * tp + fp + fn) END"
_PRF = """l AS (SELECT unnest(['increase', 'decrease', 'constant']) AS label), c AS (SELECT model, label, count(*) FILTER (pred = label AND gold = label) AS tp,
  count(*) FILTER (pred = label AND gold <> label) AS fp, count(*) FILTER (gold = label AND NOT coalesce(pred = label, false)) AS fn FROM s, l GROUP BY 1, 2)"""


@query(f"WITH {SCORED}, {_PRF} SELECT model, round(avg({_F1}), 6) AS macro_f1 FROM c GROUP BY model")
def m10_macro_f1(spark, sf):
    return rounded(S.macro_f1(scored(spark, sf), ("increase", "decrease", "constant"), ["model"]))


_ACC = "avg(coalesce(CAST(pred = gold AS INT), 0)) FILTER (gold = '{0}')"
_I, _D = _ACC.format("increase"), _ACC.format("decrease")


@query(f"WITH {SCORED} SELECT category, round({_I}, 6) AS acc_increase, round({_D}, 6) AS acc_decrease, round(avg(coalesce(CAST(pred = gold AS INT), 0)), 6) AS strict_accuracy, round(({_I} + {_D}) / 2, 6) AS macro_accuracy FROM s GROUP BY category")
def m11_class_accuracy(spark, sf):
    return rounded(S.class_accuracy(scored(spark, sf), ("increase", "decrease"), ["category"]))


@query(f"WITH {SCORED} SELECT model, tier, round({_I}, 6) AS acc_increase, round({_D}, 6) AS acc_decrease, round({_I} - {_D}, 6) AS difference FROM s GROUP BY 1, 2")
def m12_direction_difference(spark, sf):
    return rounded(S.direction_difference(scored(spark, sf), ["model", "tier"]))


@query(f"""WITH {SCORED}, l AS (SELECT unnest(['increase', 'decrease', 'unparsed']) AS label),
  c AS (SELECT category, sample_origin, label, avg(CAST(coalesce(pred, 'unparsed') = label AS INT)) AS share FROM s, l GROUP BY 1, 2, 3)
  SELECT sample_origin, label, round(avg(share), 6) AS share FROM c GROUP BY 1, 2""")
def m13_prediction_distribution(spark, sf):
    return rounded(S.prediction_distribution(scored(spark, sf), "category", "sample_origin", ("increase", "decrease")))


@query(f"WITH {SCORED}, {_PRF} SELECT model, label, tp, fp, fn, {_ratio('tp', '(tp + fp)')} AS precision, {_ratio('tp', '(tp + fn)')} AS recall, round({_F1}, 6) AS f1 FROM c")
def m14_per_class_prf(spark, sf):
    return rounded(S.per_class_prf(scored(spark, sf), ("increase", "decrease", "constant"), ["model"]))


@query(f"""WITH {SCORED}, a AS (SELECT * FROM s WHERE clip_id % 11 <> 0), b AS (SELECT clip_id, CASE WHEN clip_id % 4 = 0 THEN 'increase' ELSE pred END AS pred, gold FROM s WHERE clip_id % 13 <> 0)
  SELECT count(*) FILTER (a.pred = 'decrease' AND b.clip_id IS NOT NULL) AS n_source, count(*) FILTER (a.pred = 'decrease' AND b.pred = 'increase') AS n_moved,
  count(*) FILTER (a.clip_id IS NULL OR b.clip_id IS NULL) AS n_unmatched, CAST(0 AS BIGINT) AS n_gold_differs,
  {_ratio("count(*) FILTER (a.pred = 'decrease' AND b.pred = 'increase')", "count(*) FILTER (a.pred = 'decrease' AND b.clip_id IS NOT NULL)")} AS rate FROM a FULL JOIN b ON a.clip_id = b.clip_id""")
def m15_prediction_transition(spark, sf):
    s = scored(spark, sf)
    other = s.withColumn("pred", F.when(F.col("clip_id") % 4 == 0, "increase").otherwise(F.col("pred"))).filter("clip_id % 13 <> 0")
    return rounded(S.prediction_transition(s.filter("clip_id % 11 <> 0"), other, ["clip_id"], "decrease", "increase"))


_BIAS = f"""SELECT model, category, count(*) AS n_rows, count(pred) AS n_parsed, count(*) - count(pred) AS n_unparsed, count(*) FILTER (pred = 'increase') AS n_preferred,
  {_ratio("count(*) FILTER (pred = 'increase')", "count(*)")} AS rate_all, {_ratio("count(*) FILTER (pred = 'increase')", "count(pred)")} AS rate_parsed FROM s GROUP BY 1, 2"""


@query(f"WITH {SCORED} {_BIAS}")
def m16_response_bias(spark, sf):
    return rounded(S.response_bias(scored(spark, sf), ["model", "category"]))


@query(f"""WITH {SCORED}, b AS ({_BIAS}) SELECT model, round(avg(rate_parsed), 5) AS mean_rate, max(category) FILTER (rate_parsed = hi) AS max_category, max(hi) AS max_rate,
  min(category) FILTER (rate_parsed = lo) AS min_category, min(lo) AS min_rate
  FROM (SELECT *, max(rate_parsed) OVER (PARTITION BY model) AS hi, min(rate_parsed) OVER (PARTITION BY model) AS lo FROM b) GROUP BY model""")
def m17_bias_extremes(spark, sf):
    rates = rounded(S.response_bias(scored(spark, sf), ["model", "category"]))
    return S.bias_extremes(rates, "model", "category", "rate_parsed").withColumn("mean_rate", F.round("mean_rate", 5))


_EX = "lower(trim(coalesce(raw_response, ''))) IN ('increase', 'decrease')"
_MR = f"avg(CAST({_EX} AS INT)) AS exact_rate, avg(CAST(pred IS NOT NULL AS INT)) AS parser_rate, avg(CAST(lower(trim(raw_response)) = gold AS INT)) FILTER ({_EX}) AS exact_accuracy"


@query(f"""WITH {SCORED}, c AS (SELECT model, category, {_MR} FROM s GROUP BY 1, 2), p AS (SELECT model, 'pooled' AS pooling, {_MR} FROM s GROUP BY 1)
  SELECT model, pooling, round(exact_rate, 6) AS exact_rate, round(parser_rate, 6) AS parser_rate, round(exact_accuracy, 6) AS exact_accuracy FROM p
  UNION ALL SELECT model, 'by_category', round(avg(exact_rate), 6), round(avg(parser_rate), 6), round(avg(exact_accuracy), 6) FROM c GROUP BY model""")
def m18_match_rates(spark, sf):
    return rounded(S.match_rates(scored(spark, sf), "model", "category"))


@query()
def m19_bootstrap_ci(spark, sf):
    s = scored(spark, sf).withColumn("ok", F.coalesce(F.col("pred") == F.col("gold"), F.lit(False)))
    return S.bootstrap_ci(s, ["model", "category"], "ok")


@query(f"""SELECT clip_id, CASE WHEN retry AND clip_id % 2 = 0 THEN 'decreases' ELSE raw_response END AS raw_response FROM
  (SELECT *, NOT ({_m('raw_response', INC)} OR {_m('raw_response', DEC)}) AS retry FROM ({PREDICTIONS}))""")
def m20_merge_retries(spark, sf):
    p = adapt(spark, sf, PREDICTIONS).select("clip_id", "raw_response")
    retried = S.retry_queue(p).filter("clip_id % 2 = 0").withColumn("raw_response", F.lit("decreases"))
    return S.merge_retries(p, retried, ["clip_id"])


@query(f"WITH {SCORED}, c AS (SELECT category, variant, {COUNTS} FROM s GROUP BY 1, 2) SELECT category, variant, n_rows, {_ratio('n_correct', 'n_rows')} AS accuracy, {_ratio('tp + fp', 'n_parsed')} AS increase_ratio_parsed FROM c")
def m21_paraphrase_metrics(spark, sf):
    return rounded(S.paraphrase_metrics(scored(spark, sf)))

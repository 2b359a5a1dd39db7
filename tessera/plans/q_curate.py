"""Queries of curation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import curate as C
from .adapters import CLIPS, PREDICTIONS, SPEAKERS, adapt, table
from .q_scoring import scored  # noqa: F401
from .registry import query, rounded

NORM = "trim(regexp_replace({0}, '[\\s\\x0B]+', ' ', 'g'))"


def H(seed, *cols):
    return "sha256(" + " || ':' || ".join([f"'{seed}'", *[f"CAST({c} AS VARCHAR)" for c in cols]]) + ")"


@query("SELECT speaker, stem, substr(stem, instr(stem, '_') + 1) AS sentence_id FROM (SELECT source AS speaker, lang || '_' || doc_id AS stem FROM documents) WHERE CAST(split_part(stem, '_', 2) AS BIGINT) % 3 <> 0")
def c1_paired_clips(spark, sf):
    t = table(spark, sf, "documents").select(F.col("source").alias("speaker"), F.concat_ws("_", "lang", "doc_id").alias("stem"), "doc_id")
    return C.paired_clips(t.drop("doc_id"), t.filter("doc_id % 3 <> 0").drop("doc_id"), "speaker", "stem")


@query(f"SELECT clip_id, speaker, duration FROM ({CLIPS}) WHERE duration BETWEEN 500 AND 3000 AND clip_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def c2_eligible_clips(spark, sf):
    bad = table(spark, sf, "labels").filter("toxic = 1").select(F.col("doc_id").alias("clip_id"))
    return C.eligible_clips(adapt(spark, sf, CLIPS), "duration", 500, 3000, bad).select("clip_id", "speaker", "duration")


@query("SELECT c_mktsegment, CAST(floor(101 / 5) + CASE WHEN row_number() OVER (ORDER BY c_mktsegment) <= 101 % 5 THEN 1 ELSE 0 END AS BIGINT) AS target FROM (SELECT DISTINCT c_mktsegment FROM customer)")
def c3_even_targets(spark, sf):
    return C.even_targets(table(spark, sf, "customer"), "c_mktsegment", 101)


_SP = f"sp AS (SELECT * FROM ({SPEAKERS}))"
_BEST_GROUP = f"""WITH {_SP}, ac AS (SELECT accent AS label, CAST(floor(20 / (count(*) OVER ())) + CASE WHEN row_number() OVER (ORDER BY accent) <= 20 % (count(*) OVER ()) THEN 1 ELSE 0 END AS BIGINT) AS target FROM (SELECT DISTINCT accent FROM sp)),
  grid AS (SELECT 'a' AS kind, label, target FROM ac UNION ALL SELECT 'g', 'F', 10 UNION ALL SELECT 'g', 'M', 10), d AS (SELECT trial, sp.*, row_number() OVER (PARTITION BY trial ORDER BY {H(3, 'trial', 'speaker')}, speaker) AS at_ FROM range(60) t(trial), sp),
  p AS (SELECT * FROM d WHERE at_ <= 20), c AS (SELECT trial, 'a' AS kind, accent AS label, count(*) AS c FROM p GROUP BY ALL UNION ALL SELECT trial, 'g', gender, count(*) FROM p GROUP BY ALL),
  s AS (SELECT t.trial, sum(abs(coalesce(c, 0) - target) * CASE grid.kind WHEN 'g' THEN 10 ELSE 1 END) AS score FROM range(60) t(trial) CROSS JOIN grid LEFT JOIN c ON c.trial = t.trial AND c.kind = grid.kind AND c.label = grid.label GROUP BY 1),
  b AS (SELECT * FROM s ORDER BY score, trial LIMIT 1) SELECT speaker, gender, accent, p.trial, CAST(score AS BIGINT) AS score FROM p JOIN b ON p.trial = b.trial"""


@query(_BEST_GROUP)
def c4_balanced_group_search(spark, sf):
    return rounded(C.balanced_group_search(adapt(spark, sf, SPEAKERS), "speaker", "gender", "accent", 20, 60, 3))


@query(_BEST_GROUP)
def c4_balanced_group_search_all(spark, sf):
    """The search under its earlier name, when the other one kept to a subset."""
    return rounded(C.balanced_group_search(adapt(spark, sf, SPEAKERS), "speaker", "gender", "accent", 20, 60, 3))


@query(f"""WITH r AS (SELECT clip_id, speaker, count(*) OVER (PARTITION BY speaker) AS group_size, row_number() OVER (PARTITION BY speaker ORDER BY {H(11, 'speaker', 'clip_id')}, clip_id) AS k FROM ({CLIPS}))
  SELECT clip_id, speaker, group_size, row_number() OVER (PARTITION BY speaker ORDER BY clip_id) AS item_no FROM r WHERE k <= 8""")
def c5_sample_per_group(spark, sf):
    return rounded(C.sample_per_group(adapt(spark, sf, CLIPS).select("clip_id", "speaker"), "speaker", "clip_id", 8, 11))


@query(f"WITH c AS ({CLIPS}) SELECT clip_id FROM c WHERE clip_id % 4 <> 0 AND {NORM.format('text')} NOT IN (SELECT {NORM.format('text')} FROM c WHERE clip_id % 4 = 0)")
def c6_exclude_overlapping_text(spark, sf):
    c = adapt(spark, sf, CLIPS)
    return C.exclude_overlapping_text(c.filter("clip_id % 4 <> 0"), c.filter("clip_id % 4 = 0"), "text").select("clip_id")


@query()
def c7_unique_text_quota_sample(spark, sf):
    c = adapt(spark, sf, CLIPS)
    targets = c.groupBy("speaker").agg(F.least(F.lit(9), F.floor(F.countDistinct(C.text_key(F.col("text"))) / 2)).cast("int").alias("target"))
    return C.unique_text_quota_sample(c, "speaker", "clip_id", "text", targets, 5)


@query(f"""WITH a AS (SELECT *, row_number() OVER (PARTITION BY accent, speaker ORDER BY {H(2, 'clip_id')}, clip_id) AS s FROM ({CLIPS})), b AS (SELECT *, row_number() OVER (PARTITION BY accent ORDER BY {H(2, 'clip_id')}, clip_id) AS r FROM a WHERE s <= 3)
  SELECT clip_id, accent, speaker FROM b WHERE r <= 25""")
def c8_capped_balanced_sample(spark, sf):
    return C.capped_balanced_sample(adapt(spark, sf, CLIPS).select("clip_id", "accent", "speaker"), "accent", "speaker", "clip_id", 25, 3, 2)


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events) WHERE k = 1")
def c9_dedup_first(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return C.dedup_first(e, ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


_COIN = "CAST('0x' || substr({0}, 1, 8) AS BIGINT) / 4294967296.0 < 100 / 400.0"


@query(f"""WITH c AS ({CLIPS}), n AS (SELECT speaker, count(*) AS n FROM c GROUP BY 1), t AS (SELECT attempt, n.*, {_COIN.format(H(4, 'attempt', 'speaker'))} AS test FROM range(40) r(attempt), n),
  f AS (SELECT min(attempt) AS attempt FROM (SELECT attempt FROM t GROUP BY 1 HAVING sum(n) FILTER (test) >= 100 AND sum(n) FILTER (NOT test) >= 300)),
  s AS (SELECT c.speaker, clip_id, t.attempt, CASE WHEN test THEN 'test' ELSE 'train' END AS split FROM c JOIN t ON c.speaker = t.speaker JOIN f ON f.attempt = t.attempt)
  SELECT speaker, clip_id, attempt, split FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY {H(4, 'split', 'clip_id')}, clip_id) AS k FROM s) WHERE k <= CASE split WHEN 'test' THEN 100 ELSE 300 END""")
def c10_disjoint_partition(spark, sf):
    return C.disjoint_partition(adapt(spark, sf, CLIPS), "speaker", "clip_id", 300, 100, 40, 4)


@query(f"""WITH c AS (SELECT *, count(*) OVER (PARTITION BY accent) AS n, row_number() OVER (PARTITION BY accent ORDER BY {H(6, 'clip_id')}, clip_id) AS k FROM ({CLIPS}))
  SELECT clip_id, accent, CASE WHEN k <= least(greatest(1, CAST(round_even(n * 0.15, 0) AS INT)), n - 1) THEN 'val' ELSE 'train' END AS split FROM c""")
def c11_stratified_split(spark, sf):
    return C.stratified_split(adapt(spark, sf, CLIPS).select("clip_id", "accent"), "accent", "clip_id", 0.15, 6)


_FS = f"""t AS (SELECT category, gold_label, clip_id AS train_key, row_number() OVER (PARTITION BY category, gold_label ORDER BY {H(8, 'clip_id')}, clip_id) - 1 AS idx, count(*) OVER (PARTITION BY category, gold_label) AS size FROM p WHERE clip_id % 3 <> 0),
  z AS (SELECT category, gold_label, max(size) AS size, least(max(size), 3) AS k FROM t GROUP BY 1, 2), q AS (SELECT p.clip_id, z.*, CAST('0x' || substr({H(8, 'p.clip_id', 'z.gold_label')}, 1, 8) AS BIGINT) % size AS start FROM p JOIN z ON p.category = z.category WHERE p.clip_id % 3 = 0),
  i AS (SELECT *, unnest(range(0, k)) AS i FROM q)"""


@query(f"""WITH p AS ({PREDICTIONS}), {_FS} SELECT i.clip_id, i.category, i.gold_label, train_key, row_number() OVER (PARTITION BY i.clip_id ORDER BY {H(8, 'i.clip_id', 'train_key')}, train_key) AS place
  FROM i JOIN t ON i.category = t.category AND i.gold_label = t.gold_label AND t.idx = (i.start + i.i * greatest(1, CAST(floor(i.size / i.k) AS BIGINT))) % i.size""")
def c12_fewshot_contexts(spark, sf):
    p = adapt(spark, sf, PREDICTIONS).select("clip_id", "category", "gold_label")
    return rounded(C.fewshot_contexts(p.filter("clip_id % 3 = 0"), p.filter("clip_id % 3 <> 0"), "clip_id", "clip_id", "category", "gold_label", 3, 8))


_MAN = """SELECT event_id, user_id AS speaker, user_id * 1000 + event_id % 3 AS source, CASE event_id % 2 WHEN 0 THEN 'up' ELSE 'down' END AS direction,
  CASE event_id % 5 WHEN 0 THEN 'low' WHEN 1 THEN 'mid' ELSE 'high' END AS tier, CASE WHEN value < 50 THEN 'linear' ELSE 'jump' END AS curve FROM events"""


@query(f"""WITH m AS ({_MAN}), c AS (SELECT row_number() OVER (ORDER BY t, u) - 1 AS i, t AS tier, u AS curve FROM (VALUES ('high'), ('low'), ('mid')) a(t), (VALUES ('jump'), ('linear')) b(u)),
  f AS (SELECT speaker, min(source) AS source, row_number() OVER (ORDER BY speaker) - 1 AS i FROM m GROUP BY 1), w AS (SELECT f.speaker, f.source, tier, curve, CASE f.i % 2 WHEN 0 THEN 'up' ELSE 'down' END AS direction FROM f JOIN c ON c.i = f.i % 6)
  SELECT m.* FROM m SEMI JOIN w USING (speaker, source, tier, curve, direction)""")
def c13_annotation_subset(spark, sf):
    conditions = spark.createDataFrame([(i, t, c) for i, (t, c) in enumerate((t, c) for t in ("high", "low", "mid") for c in ("jump", "linear"))], "at long, tier string, curve string")
    return C.annotation_subset(adapt(spark, sf, _MAN), "speaker", "source", conditions)


@query(f"""WITH p AS ({PREDICTIONS}) SELECT clip_id, category, gold_label AS label, 'augmented' AS origin FROM p WHERE sample_origin = 'augmented'
  UNION ALL SELECT clip_id, category, 'constant', 'source' FROM (SELECT clip_id FROM p WHERE sample_origin = 'source'), (SELECT DISTINCT category FROM p)""")
def c14_union_origins(spark, sf):
    p = adapt(spark, sf, PREDICTIONS).withColumn("label", F.col("gold_label"))
    return C.union_origins(p.filter("sample_origin = 'augmented'"), p.filter("sample_origin = 'source'"), p, "constant")


_BND = """SELECT event_id AS item, CASE WHEN event_id % 5 = 0 THEN NULL ELSE user_id END AS clip, event_id % 4 <> 0 AS detected, CASE WHEN event_id % 4 <> 0 THEN round(value, 2) END AS onset FROM events WHERE event_id % 3 = 0"""


@query(f"""WITH b AS ({_BND}), c AS (SELECT event_id AS item, user_id AS clip FROM events), k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY item) AS r FROM b WHERE clip IS NOT NULL) WHERE r = 1)
  SELECT c.item, c.clip, coalesce(b.detected, k.detected, false) AS detected, CASE WHEN b.item IS NOT NULL THEN b.onset ELSE k.onset END AS onset FROM c LEFT JOIN b ON b.item = c.item LEFT JOIN k ON k.clip = c.clip""")
def c15_merge_bounds(spark, sf):
    clips = table(spark, sf, "events").select(F.col("event_id").alias("item"), F.col("user_id").alias("clip"))
    return C.merge_bounds(clips, adapt(spark, sf, _BND), "item", "clip", ["onset"])


@query(f"WITH b AS ({_BND}) SELECT event_id AS item, 'missing' AS reason FROM events WHERE event_id NOT IN (SELECT item FROM b) UNION ALL SELECT item, 'invalid' FROM b WHERE NOT detected")
def c16_bounds_coverage(spark, sf):
    return C.bounds_coverage(table(spark, sf, "events").select(F.col("event_id").alias("item")), adapt(spark, sf, _BND), "item")


@query(f"""WITH c AS ({CLIPS}), t AS (SELECT {NORM.format('text')} AS x, count(*) AS n FROM c GROUP BY 1) SELECT 'total' AS measure, 'rows' AS name, CAST(count(*) AS DOUBLE) AS value FROM c UNION ALL SELECT 'total', 'speakers', count(DISTINCT speaker) FROM c
  UNION ALL SELECT 'total', 'min_duration', min(duration) FROM c UNION ALL SELECT 'total', 'max_duration', max(duration) FROM c UNION ALL SELECT 'total', 'repeated_texts', count(*) FILTER (n > 1) FROM t UNION ALL SELECT 'total', 'max_frequency', max(n) FROM t
  UNION ALL SELECT 'accent', accent, count(*) FROM c GROUP BY accent UNION ALL SELECT 'speakers_with', CAST(n AS VARCHAR), count(*) FROM (SELECT count(*) AS n FROM c GROUP BY speaker) GROUP BY n""")
def c17_selection_report(spark, sf):
    return rounded(C.selection_report(adapt(spark, sf, CLIPS), "speaker", "text", "duration", "accent"))


@query(f"""WITH c AS (SELECT *, {NORM.format('text')} AS x FROM ({CLIPS})), te AS (SELECT * FROM c WHERE clip_id % 5 = 0), tr AS (SELECT * FROM c WHERE clip_id % 5 <> 0), r AS (
  SELECT 'test_rows' AS rule, count(*) AS a FROM te UNION ALL SELECT 'train_rows', count(*) FROM tr UNION ALL SELECT 'shared_speakers', count(*) FROM (SELECT speaker FROM te INTERSECT SELECT speaker FROM tr) UNION ALL SELECT 'shared_texts', count(*) FROM (SELECT x FROM te INTERSECT SELECT x FROM tr)
  UNION ALL SELECT 'repeated_texts', count(*) FROM (SELECT x FROM tr GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'missing_bounds', count(*) FROM te WHERE clip_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT 'direction_balance', sum(CASE clip_id % 2 WHEN 0 THEN 1 ELSE -1 END) FROM te)
  SELECT rule, CAST(a AS DOUBLE) AS actual, CASE rule WHEN 'test_rows' THEN 200.0 WHEN 'shared_speakers' THEN 0.0 WHEN 'direction_balance' THEN 0.0 END AS expected, CASE rule WHEN 'test_rows' THEN a = 200 WHEN 'shared_speakers' THEN a = 0 WHEN 'direction_balance' THEN a = 0 ELSE false END AS ok FROM r""")
def c18_check_dataset(spark, sf):
    c = adapt(spark, sf, CLIPS).withColumn("direction", F.when(F.col("clip_id") % 2 == 0, "up").otherwise("down"))
    bounds = table(spark, sf, "labels").select(F.col("doc_id").alias("clip_id"))
    return C.check_dataset(c.filter("clip_id % 5 = 0"), c.filter("clip_id % 5 <> 0"), bounds, {"test_rows": 200, "shared_speakers": 0, "direction_balance": 0}, "clip_id", "speaker", "text", "direction")


_REL = f"""SELECT category, clip_id % 1999 AS cid, CASE clip_id % 50 WHEN 0 THEN '../x' WHEN 1 THEN '/abs/' || clip_id ELSE 'a/' || CAST(clip_id % 5000 AS STRING) END AS path, direction,
  CASE WHEN clip_id % 31 = 0 THEN 'decrease' ELSE gold_label END AS label FROM ({PREDICTIONS})"""


@query(f"""WITH r AS ({_REL}), x AS (SELECT category, count(*) FILTER (label <> CASE direction WHEN 'up' THEN 'increase' ELSE 'decrease' END) AS bad_label, count(*) FILTER (path LIKE '/%' OR path LIKE '../%') AS unsafe_path, count(*) AS n FROM r GROUP BY 1)
  SELECT category, 'bad_label' AS rule, bad_label AS n_found FROM x UNION ALL SELECT category, 'unsafe_path', unsafe_path FROM x UNION ALL SELECT category, 'wrong_count', n FROM x WHERE n <> 2006
  UNION ALL SELECT category, 'duplicate_key', count(*) FROM (SELECT category, cid FROM r GROUP BY ALL HAVING count(*) > 1) GROUP BY 1 UNION ALL SELECT category, 'shared_path', count(*) FROM (SELECT category, path FROM r GROUP BY ALL HAVING count(*) > 1) GROUP BY 1""")
def c19_check_release(spark, sf):
    r = adapt(spark, sf, _REL)
    expected = r.select("category").distinct().withColumn("n_expected", F.lit(2006))
    return C.check_release(r, expected, "category", "cid", "path", "direction", "label")


@query(f"SELECT clip_id, 'test/' || category || '/' || clip_id || '.wav' AS target_path, 'test/' || category || '/manifest.csv' AS manifest, CASE sample_origin WHEN 'source' THEN 'source_clips/' || clip_id || '.wav' END AS selected_audio_path FROM ({PREDICTIONS})")
def c20_restructure_release(spark, sf):
    p = adapt(spark, sf, PREDICTIONS).withColumn("split", F.lit("test"))
    return C.restructure_release(p, "split", "category", "clip_id", "sample_origin").select("clip_id", "target_path", "manifest", "selected_audio_path")


@query(f"SELECT clip_id, category, direction, CASE direction WHEN 'up' THEN 'increase' ELSE 'decrease' END AS gold_label FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY clip_id) AS k FROM ({PREDICTIONS}) WHERE model IN (1, 3)) WHERE k <= 40")
def c21_samples_from_manifest(spark, sf):
    p = adapt(spark, sf, PREDICTIONS).select("clip_id", "category", "direction", "model")
    who = p.filter("model in (1, 3)").select("model").distinct()
    return C.samples_from_manifest(p, "category", "direction", ["clip_id"], 40, who, "model").drop("model")


@query(f"SELECT clip_id, category, asked, 'Does the ' || asked || ' change?' AS prompt FROM (SELECT clip_id, category FROM ({PREDICTIONS})), (SELECT DISTINCT event_type AS asked FROM events)")
def c22_prompt_grid(spark, sf):
    p = adapt(spark, sf, PREDICTIONS)
    prompts = p.select(F.col("category").alias("asked")).distinct().withColumn("prompt", F.concat(F.lit("Does the "), "asked", F.lit(" change?")))
    return C.prompt_grid(p.select("clip_id", "category"), prompts)

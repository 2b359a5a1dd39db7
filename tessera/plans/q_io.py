"""Queries of readers, writers and streams: each writes a table to a folder of its own and reads it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import io as S
from ..sources import chunks as K
from ..streaming import annotations as A
from .adapters import ANNOTATION_ROWS, FEATURES, PREDICTIONS, adapt, table
from .q_signal import WAVES, clips
from .registry import query, rounded


@query(f"SELECT model, category, clip_id, gold_label, raw_response FROM ({PREDICTIONS})")
def s1_read_predictions(spark, sf):
    path = S.work_dir(spark, "predictions")
    p = adapt(spark, sf, PREDICTIONS).select("model", "category", "clip_id", "gold_label", "raw_response")
    p.withColumnsRenamed({"model": "m", "category": "c"}).write.partitionBy("c", "m").json(path)
    back = S.read_predictions(spark, path + "/*/*", "clip_id long, gold_label string, raw_response string", category_at=2, model_at=1)
    tail = lambda c: F.element_at(F.split(c, "="), 2)
    return back.select(tail("path_model").cast("long").alias("model"), tail("path_category").alias("category"), "clip_id", "gold_label", "raw_response")


@query("SELECT doc_id, md5(text) AS digest, lang FROM documents")
def s2_read_manifest(spark, sf):
    path = S.work_dir(spark, "manifest")
    d = table(spark, sf, "documents").select("doc_id", "lang", "text")
    S.write_table(d, path, "csv")
    return S.read_manifest(spark, path, "doc_id long, lang string, text string").select("doc_id", F.md5("text").alias("digest"), "lang")


@query("SELECT 'p' || lpad(CAST(c_custkey AS VARCHAR), CAST(greatest(3, len(CAST(c_custkey AS VARCHAR))) AS INT), '0') AS speaker_id, CAST(20 + c_nationkey AS BIGINT) AS age, CASE c_nationkey % 2 WHEN 0 THEN 'F' ELSE 'M' END AS gender, 'Accent' AS accent, CASE c_custkey % 3 WHEN 0 THEN '' ELSE 'North  East' END AS region FROM customer".replace("North  East", "North East"))
def s3_read_speaker_info(spark, sf):
    path = S.work_dir(spark, "speakers")
    c = table(spark, sf, "customer")
    line = F.concat_ws("  ", F.col("c_custkey").cast("string"), (20 + F.col("c_nationkey")).cast("string"), F.when(F.col("c_nationkey") % 2 == 0, "F").otherwise("M"), F.lit("Accent"), F.when(F.col("c_custkey") % 3 != 0, "North  East"))
    extra = spark.createDataFrame([("ID  AGE  GENDER  ACCENTS  REGION",), ("",), ("12 30",)], "value string")
    c.select(line.alias("value")).union(extra).write.text(path)
    return rounded(S.read_speaker_info(spark, path))


@query(f"""WITH w AS (SELECT clip_id, [trunc(greatest(-32768.0, least(32767.0, v * 32768))) / 32768 for v in x] AS s FROM ({WAVES}))
  SELECT clip_id, CAST(2000 AS BIGINT) AS rate, CAST(1 AS BIGINT) AS channels, round(len(s) / 2000.0, 6) AS duration_sec, CAST(len(s) AS BIGINT) AS n_samples, round(list_sum([v * v for v in s]), 4) AS energy FROM w""")
def s4_s5_waveforms(spark, sf):
    """Clips as WAV files in the work folder, and read back."""
    path = S.work_dir(spark, "waves")
    S.write_waveforms(clips(spark, sf), path, 2000)
    back = S.read_waveforms(spark, path + "/*.wav")
    energy = F.aggregate("samples", F.lit(0.0), lambda a, v: a + v * v)
    clip = F.regexp_extract("path", r"(\d+)\.wav$", 1).cast("long")
    return rounded(back.select(clip.alias("clip_id"), "rate", "channels", "duration_sec", F.size("samples").alias("n_samples"), F.round(energy, 4).alias("energy")))


@query()
def s5_encode_waveform(spark, sf):
    """Clips as PCM bytes in a column."""
    pcm = clips(spark, sf).select("clip_id", S.encode_waveform("samples").alias("pcm"))
    return pcm.select("clip_id", F.length("pcm").cast("long").alias("n_bytes"), F.sha2("pcm", 256).alias("sha256"))


@query(f"SELECT model, category, count(*) AS n_rows, CAST(0 AS BIGINT) AS not_finite, CAST(0 AS BIGINT) AS duplicate_ids, string_agg(DISTINCT source, ',' ORDER BY source) AS layers FROM ({FEATURES}) GROUP BY 1, 2".replace("string_agg(DISTINCT source, ',' ORDER BY source)", "array_to_string(list_sort(list(DISTINCT CAST(source AS VARCHAR))), ',')"))
def s6_features(spark, sf):
    path = S.work_dir(spark, "features")
    S.write_features(adapt(spark, sf, FEATURES), path)
    return S.check_features(S.read_features(spark, path), ["model", "category"], "clip_id", "source")


@query("SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def s7_write_table(spark, sf):
    path = S.work_dir(spark, "orders")
    S.write_table(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), path, "json", ["o_orderstatus"])
    back = spark.read.schema("o_orderkey long, o_orderstatus string, o_totalprice double").json(path)
    return back.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query(f"SELECT clip_id, model, category, sample_origin AS root FROM (SELECT *, min(CASE sample_origin WHEN 'source' THEN 0 ELSE 1 END) OVER (PARTITION BY model, category, tier) AS best FROM ({PREDICTIONS})) WHERE CASE sample_origin WHEN 'source' THEN 0 ELSE 1 END = best")
def s8_first_root_wins(spark, sf):
    roots = spark.createDataFrame([("source", 0), ("augmented", 1)], "root string, priority int")
    p = adapt(spark, sf, PREDICTIONS).withColumnRenamed("sample_origin", "root")
    return S.first_root_wins(p, roots, "root", ["model", "category", "tier"]).select("clip_id", "model", "category", "root")


@query("""WITH c AS (SELECT doc_id, ['/a/' || doc_id, '/b/' || (doc_id % 500), '/c/' || source] AS p FROM documents), l AS (SELECT '/a/' || doc_id AS path FROM documents WHERE doc_id % 3 = 0 UNION SELECT '/b/' || doc_id FROM documents WHERE doc_id % 2 = 0 UNION SELECT '/c/src1')
  SELECT doc_id, list_filter(p, lambda x: x IN (SELECT path FROM l))[1] AS resolved FROM c""".replace("list_filter(p, lambda x: x IN (SELECT path FROM l))[1]", "(SELECT (list(path ORDER BY at))[1] FROM (SELECT unnest(p) AS path, unnest([1, 2, 3]) AS at) u WHERE path IN (SELECT path FROM l))").replace("AS at)", "AS pos)").replace("ORDER BY at)", "ORDER BY pos)"))
def s9_resolve_paths(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source")
    c = d.withColumn("candidates", F.array(F.concat(F.lit("/a/"), F.col("doc_id").cast("string")), F.concat(F.lit("/b/"), (F.col("doc_id") % 500).cast("string")), F.concat(F.lit("/c/"), "source")))
    a = d.filter("doc_id % 3 = 0").select(F.concat(F.lit("/a/"), F.col("doc_id").cast("string")).alias("path"))
    b = d.filter("doc_id % 2 = 0").select(F.concat(F.lit("/b/"), F.col("doc_id").cast("string")).alias("path"))
    listing = a.union(b).union(d.filter("source = 'src1'").select(F.lit("/c/src1").alias("path")))
    return S.resolve_paths(c, listing, "doc_id", "candidates").select("doc_id", "resolved")


@query()
def s10_file_digests(spark, sf):
    return S.file_digests(spark, [f"{sf}/{t}.parquet" for t in ("documents", "events", "lineitem")]).select(F.element_at(F.split("path", "/"), -1).alias("name"), "size", "sha256")


@query()
def s10_tree_digests(spark, sf):
    """The same files by chunks of 64 KB, which many tasks read. No SQL: tested against a plain reading."""
    found = K.tree_digests(spark, [f"{sf}/{t}.parquet" for t in ("documents", "events", "lineitem")], 65_536)
    return found.select(F.element_at(F.split("path", "/"), -1).alias("name"), "size", "n_chunks", "sha256")


def _log(spark, sf, files=None):
    """The annotation log as JSON lines in a folder, in two files where they are taken one by one; and its static tables."""
    path = S.work_dir(spark, "log")
    a = adapt(spark, sf, ANNOTATION_ROWS)
    log = a.select(F.col("annotator").cast("string"), "category", F.col("item").cast("string"), F.when(F.col("line") == 7, "X").otherwise(F.col("label")).alias("label"), F.when(F.col("line") == 6, -F.col("response_time")).otherwise(F.col("response_time")).alias("response_time"), F.col("replay").cast("long"), F.col("shipped").alias("submitted_at"))
    (log.repartition(2, "annotator") if files else log).write.json(path)
    items = a.filter("item % 9 <> 0").select(F.col("item").cast("string"), "truth").distinct()
    assigned = a.filter("annotator % 5 <> 0").select(F.col("annotator").cast("string"), "category").distinct()
    return path, items, assigned


_LOG = f"""r AS (SELECT CAST(annotator AS VARCHAR) AS annotator, category, CAST(item AS VARCHAR) AS item, CASE WHEN annotator % 5 = 0 THEN 'not_assigned' WHEN line = 7 THEN 'bad_label' WHEN line = 6 THEN 'negative' WHEN item % 9 = 0 THEN 'unknown_item' END AS reject_reason,
  CASE WHEN line = 7 THEN 'X' ELSE label END = truth AS is_correct, CASE WHEN line = 6 THEN -response_time ELSE response_time END AS response_time, replay,
  CASE WHEN line = 7 THEN 'X' ELSE label END AS label, shipped AS submitted_at FROM ({ANNOTATION_ROWS}))"""


@query(f"WITH {_LOG} SELECT category, coalesce(reject_reason, 'accepted') AS reason, count(*) AS n, CAST(count(*) FILTER (is_correct AND reject_reason IS NULL) AS BIGINT) AS n_correct FROM r GROUP BY 1, 2")
def r1_stream_submissions(spark, sf):
    out, at = S.work_dir(spark, "submissions"), S.work_dir(spark, "checkpoint")
    A.run_to(A.stream_submissions(spark, *_log(spark, sf)), out, at)
    back = spark.read.parquet(out)
    return back.groupBy("category", F.coalesce("reject_reason", F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"), F.sum((F.col("is_correct") & F.col("reject_reason").isNull()).cast("long")).alias("n_correct")).withColumn("n_correct", F.coalesce("n_correct", F.lit(0)))


def _accepted(spark, sf, files=None):
    return A.stream_submissions(spark, *_log(spark, sf, files), files=files).filter("reject_reason is null")


@query(f"""WITH {_LOG}, k AS (SELECT *, row_number() OVER (PARTITION BY annotator, category, item ORDER BY submitted_at, label, response_time, replay) AS nth
  FROM r WHERE reject_reason IS NULL)
SELECT annotator, category, item, label, round(response_time, 2) AS response_time, replay, CASE WHEN nth = 1 THEN 'kept' ELSE 'repeated' END AS outcome FROM k""")
def r2_stream_dedup(spark, sf):
    path, at = S.work_dir(spark, "first"), S.work_dir(spark, "checkpoint")
    A.stream_dedup(_accepted(spark, sf), path, at).awaitTermination()
    back = spark.read.schema(f"{A.SUBMISSION}, outcome string").parquet(path)
    return back.select("annotator", "category", "item", "label", F.round("response_time", 2).alias("response_time"), "replay", "outcome")


SUMMARY = f"WITH {_LOG} SELECT category, annotator, count(*) AS n_rows, round(avg(CAST(is_correct AS INT)), 6) AS accuracy, round(avg(response_time) + 1e-7, 4) AS mean_time, round(avg(replay), 6) AS mean_replay FROM r WHERE reject_reason IS NULL GROUP BY 1, 2"


@query(SUMMARY)
def r3_stream_summary(spark, sf):
    out, at = S.work_dir(spark, "summary"), S.work_dir(spark, "checkpoint")
    A.run_to(A.stream_summary(_accepted(spark, sf)), out, at, "complete")
    back = spark.read.schema("category string, annotator string, n_rows long, accuracy double, mean_time double, mean_replay double").parquet(out)
    return rounded(back.withColumn("mean_time", F.round(F.col("mean_time") + 1e-7, 4)))


@query(SUMMARY)
def r3_stream_summary_updates(spark, sf):
    """The same in update mode, from files taken one by one: the last row of each key counts."""
    out, at = S.work_dir(spark, "summary"), S.work_dir(spark, "checkpoint")
    A.run_to(A.stream_summary(_accepted(spark, sf, files=1)), out, at, "update")
    schema = "category string, annotator string, n_rows long, accuracy double, mean_time double, mean_replay double, batch long"
    back = A.latest(spark.read.schema(schema).parquet(out), ["category", "annotator"])
    return rounded(back.withColumn("mean_time", F.round(F.col("mean_time") + 1e-7, 4)))


_KEPT = f"""{_LOG}, k AS (SELECT annotator, item, label FROM r WHERE reject_reason IS NULL
  QUALIFY row_number() OVER (PARTITION BY annotator, category, item ORDER BY submitted_at, label, response_time, replay) = 1)"""


def _kept(spark, sf):
    """The first submissions, deduplicated by one stream and read by another."""
    path, at = S.work_dir(spark, "first"), S.work_dir(spark, "checkpoint")
    A.stream_dedup(_accepted(spark, sf), path, at).awaitTermination()
    return A.stream_kept(spark, path)


@query(f"""WITH {_KEPT}, c AS (SELECT item, label, count(*) AS c FROM k GROUP BY 1, 2), n AS (SELECT item, sum(c) AS n, sum(c * (c - 1)) AS same FROM c GROUP BY 1),
  m AS (SELECT item, label FROM c QUALIFY row_number() OVER (PARTITION BY item ORDER BY c DESC, label) = 1)
SELECT n.item, CAST(n AS BIGINT) AS n_labels, label AS majority, round(CASE WHEN n = 1 THEN 1.0 ELSE CAST(same AS DOUBLE) / (n * (n - 1)) END, 6) AS agreement FROM n JOIN m ON n.item = m.item""")
def r4_stream_agreement(spark, sf):
    """Consensus of items after every submission, in update mode: the last row of each item counts."""
    out, at = S.work_dir(spark, "agreement"), S.work_dir(spark, "checkpoint")
    A.run_to(A.stream_agreement(_kept(spark, sf)), out, at, "update")
    return rounded(A.latest(spark.read.schema("item string, n_labels long, majority string, agreement double, batch long").parquet(out), ["item"]))


@query(f"""WITH {_KEPT}, p AS (SELECT x.annotator AS a, y.annotator AS b, count(*) AS n, sum(CAST(x.label = y.label AS INT)) / count(*)::DOUBLE AS agreement,
  avg(CAST(x.label = 'A' AS INT)) AS pa, avg(CAST(y.label = 'A' AS INT)) AS pb FROM k x JOIN k y ON x.item = y.item AND x.annotator < y.annotator GROUP BY 1, 2),
  e AS (SELECT *, pa * pb + (1 - pa) * (1 - pb) AS chance FROM p)
SELECT a, b, n AS n_shared, round(agreement, 6) AS agreement, round(CASE WHEN chance >= 1 THEN 1.0 ELSE (agreement - chance) / (1 - chance) END, 6) AS kappa FROM e""")
def r4_stream_pair_agreement(spark, sf):
    """Agreement and kappa of all pairs of annotators, kept by three streams: first submissions, their pairs, sums of pairs."""
    pairs, out = S.work_dir(spark, "pairs"), S.work_dir(spark, "agreement")
    A.run_to(A.stream_pairs(_kept(spark, sf), "A", 2), pairs, S.work_dir(spark, "checkpoint"))
    told = spark.readStream.schema("item string, a string, b string, same long, pa long, pb long").parquet(pairs)
    A.run_to(A.stream_pair_agreement(told), out, S.work_dir(spark, "checkpoint"), "update")
    return rounded(A.latest(spark.read.schema("a string, b string, n_shared long, agreement double, kappa double, batch long").parquet(out), ["a", "b"]))

"""Tables in the shape of the operators' inputs, derived by SQL that Spark and DuckDB both run.

Each text reads only the given tables; `table()` and `adapt()` bind their names to files.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

PREDICTIONS = """
SELECT event_id AS clip_id, user_id % 5 AS model, event_type AS category,
  CASE event_id % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'mid' ELSE 'high' END AS tier,
  CASE CAST(floor(event_id / 3) AS BIGINT) % 4 WHEN 0 THEN 'linear' WHEN 1 THEN 'quad_first_flat' WHEN 2 THEN 'quad_last_flat' ELSE 'jump' END AS curve,
  CASE event_id % 2 WHEN 0 THEN 'up' ELSE 'down' END AS direction,
  CASE event_id % 2 WHEN 0 THEN 'increase' ELSE 'decrease' END AS gold_label,
  CASE WHEN event_id % 7 = 0 THEN 'source' ELSE 'augmented' END AS sample_origin,
  CASE event_id % 3 WHEN 0 THEN 'default' WHEN 1 THEN 'swap' ELSE 'paraphrase' END AS variant,
  CASE (event_id * 31 + user_id) % 12 WHEN 0 THEN 'increase' WHEN 1 THEN 'Increases.' WHEN 2 THEN 'decrease' WHEN 3 THEN 'It decreases'
    WHEN 4 THEN 'increase or decrease' WHEN 5 THEN 'increasing' WHEN 6 THEN '' WHEN 7 THEN NULL WHEN 8 THEN 'does not increase' WHEN 9 THEN 'preincrease'
    WHEN 10 THEN CASE WHEN event_id % 4 < 2 THEN 'yes' ELSE 'Constant, no' END ELSE '  DECREASE  ' END AS raw_response,
  CASE WHEN event_id % 97 = 0 THEN 'timeout' END AS error, event_id % 5 = 0 AS wide
FROM events"""

#: One row per (annotator, item): the last label; and every distinct row.
ANNOTATION_ROWS = """
SELECT DISTINCT l_suppkey AS annotator, l_partkey AS item, l_returnflag AS label, l_extendedprice AS response_time, l_quantity AS replay,
  l_shipdate AS shipped, l_orderkey AS ord, l_linenumber AS line,
  CASE l_partkey % 3 WHEN 0 THEN 'volume' WHEN 1 THEN 'echo' ELSE 'pitch' END AS category,
  CASE l_partkey % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'mid' ELSE 'high' END AS difficulty,
  CASE l_partkey % 4 WHEN 0 THEN 'linear' WHEN 1 THEN 'quad_first_flat' WHEN 2 THEN 'quad_last_flat' ELSE 'jump' END AS trajectory,
  CASE l_partkey % 2 WHEN 0 THEN 'A' ELSE 'R' END AS truth
FROM lineitem WHERE l_returnflag IN ('A', 'R')"""

CLIPS = """
SELECT d.doc_id AS clip_id, source AS speaker, lang AS accent, n_chars AS duration, text, coalesce(quality, 0) AS quality
FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l ON d.doc_id = l.doc_id"""

SPEAKERS = """
SELECT c_custkey AS speaker, c_mktsegment AS accent, CASE c_nationkey % 2 WHEN 0 THEN 'F' ELSE 'M' END AS gender, c_nationkey AS region, c_acctbal AS age
FROM customer"""

FEATURES = """
SELECT CAST(floor(vec_id / 2) AS BIGINT) % 3 AS model, CAST(floor(vec_id / 6) AS BIGINT) % 4 AS category, CAST(floor(vec_id / 24) AS BIGINT) % 5 AS source,
  CAST(floor(vec_id / 2) AS BIGINT) AS pair, CASE vec_id % 2 WHEN 0 THEN 'up' ELSE 'down' END AS direction, 1 - vec_id % 2 AS gold, vec_id AS clip_id, embedding AS vec
FROM embeddings"""

FRAMES = """
SELECT user_id AS clip, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame, value AS rms
FROM events"""

#: Clips of a benchmark: one per event, with its speech bounds and condition.
BOUNDED = """
SELECT event_id AS clip_id, 8000 + event_id % 2 * 8000 AS rate, 4000 + event_id % 3000 AS num_samples,
  (event_id % 10) / 40.0 AS onset_sec, 0.1 + (event_id % 13) / 20.0 AS offset_sec,
  CASE event_id % 9 WHEN 0 THEN 'volume' WHEN 1 THEN 'speaking_speed' WHEN 2 THEN 'voice_pitch' WHEN 3 THEN 'background_noise' WHEN 4 THEN 'audio_distortion'
    WHEN 5 THEN 'audio_roughness' WHEN 6 THEN 'voice_clarity' WHEN 7 THEN 'voice_vibration' ELSE 'echo' END AS category,
  CASE user_id % 2 WHEN 0 THEN 'up' ELSE 'down' END AS direction,
  CASE user_id % 4 WHEN 0 THEN 'linear' WHEN 1 THEN 'quad_first_flat' WHEN 2 THEN 'quad_last_flat' ELSE 'jump' END AS curve,
  CASE user_id % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'mid' ELSE 'high' END AS tier, 0.25 + (user_id % 3) * 0.125 AS amount, floor(value * 5) / 1000 AS clipped_ratio
FROM events"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def adapt(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The SQL with table names bound to the Parquet files of `sf_dir`."""
    bound = re.sub(rf"\b(FROM|JOIN) ({'|'.join(TABLES)})\b", lambda m: f"{m[1]} parquet.`{sf_dir}/{m[2]}.parquet`", sql)
    return spark.sql(bound)

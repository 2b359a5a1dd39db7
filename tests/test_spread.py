"""Work on long clips and large groups against plain loops, with spans and parts small enough to be crossed."""

import hashlib
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.functions.text import hash_order
from tessera.operators import curate as C
from tessera.operators import labels as L
from tessera.operators import signal as W
from tessera.operators import spread as S
from tessera.operators import tables as T
from tessera.plans import catalog


def runs(active, least):
    out, start = [], None
    for i, on in enumerate([*active, False]):
        if on and start is None:
            start = i
        if not on and start is not None:
            if i - start >= least:
                out.append((start, i))
            start = None
    return out


@pytest.mark.parametrize("span", [1, 2, 5, 64])
def test_runs_are_stitched_over_spans(spark, span):
    rng = random.Random(span)
    clips = {c: [rng.random() < p for _ in range(rng.randrange(200))] for c, p in (("a", 0.5), ("b", 0.95), (None, 0.9), ("d", 1.0), ("e", 0.0))}
    frames = spark.createDataFrame([(c, i, on) for c, x in clips.items() for i, on in enumerate(x)], "clip string, frame long, active boolean")
    for least in (1, 3):
        got = W.active_segments(frames.repartition(7), least, span=span).collect()
        assert sorted(map(repr, ((r.clip, r.start, r.stop) for r in got))) == sorted(repr((c, *r)) for c, x in clips.items() for r in runs(x, least))


def test_one_long_clip(spark):
    n = 2_000_000
    on = (F.col("frame") % 1000 < 600) | F.col("frame").between(500_300, 1_500_299)
    frames = spark.range(n).select(F.lit("c").alias("clip"), F.col("id").alias("frame")).withColumn("active", on).withColumn("rms", F.when(on, 1.0).otherwise(0.001))
    got = sorted((r.start, r.stop) for r in W.active_segments(frames, 2).collect())
    want = [(i, i + 600) for i in range(0, n, 1000) if i + 600 <= 500_000 or i >= 1_501_000]
    want += [(500_000, 1_500_600)]
    assert got == sorted(want)
    b = W.speech_bounds(frames.withColumn("rms", F.when(F.col("frame") < 10, 0.001).otherwise(F.col("rms"))), 10, 2, 0.01, 0.025).first()
    assert b.detected and b.n_segments == len(want) and abs(b.onset_sec - 0.1) < 1e-9
    pooled = W.segment_mean_pool(frames.withColumn("value", F.col("frame").cast("double")), 4).orderBy("segment").collect()
    assert [r.value for r in pooled] == [n / 8 - 0.5 + i * n / 4 for i in range(4)]


def test_frames_are_numbered_within_clips(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot"] * 9 + ["a", "b", None]), rng.randrange(50), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "clip string, ts long, id long").repartition(5)
    got = {r.id: r.frame for r in W.frames_in_order(df, "clip", ["ts", "id"]).collect()}
    for clip in {c for c, _, _ in rows}:
        own = sorted((t, i) for c, t, i in rows if c == clip)
        assert [got[i] for _, i in own] == list(range(len(own)))


@pytest.mark.parametrize("crowd", [1, 40, 10_000])
def test_selection_by_hash(spark, crowd):
    groups = {"a": 3000, "b": 3000, None: 500, "small": 5}
    rows = [(g, i + 10_000 * j) for j, (g, n) in enumerate(groups.items()) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, key long").repartition(6)
    order = lambda key: hashlib.sha256(f"7:{key}".encode()).hexdigest()
    assert df.filter("key = 3").select(hash_order(7, F.col("key")).alias("h")).first().h == order(3)
    for k, of in ((1200, {}), (F.when(F.col("g") == "a", 77).otherwise(0), {"a": 77})):
        got = {}
        for r in S.least_by_hash(df, ["g"], hash_order(7, F.col("key")), "key", k, crowd).collect():
            got.setdefault(r.g, set()).add(r.key)
        size = lambda g: of.get(g, 0) if of else 1200  # noqa: E731, B023
        want = {g: set(sorted((key for h, key in rows if h == g), key=order)[: size(g)]) for g in groups if size(g)}
        assert got == want
    assert S.least_by_hash(df.limit(0), ["g"], hash_order(7, F.col("key")), "key", 3).count() == 0


def test_a_sample_larger_than_a_window_limit(spark):
    df = spark.range(60_000).select((F.col("id") % 2).alias("g"), F.col("id").alias("key"), F.lit("x").alias("other"))
    got = C.sample_per_group(df, "g", "key", 20_000, 3)
    assert got.columns == ["g", "key", "other", "group_size", "item_no"]
    n = got.groupBy("g").agg(F.count("*").alias("n"), F.min("item_no").alias("lo"), F.max("item_no").alias("hi"), F.countDistinct("item_no").alias("u"), F.max("group_size").alias("s")).collect()
    assert {(r.g, r.n, r.lo, r.hi, r.u, r.s) for r in n} == {(g, 20_000, 1, 20_000, 20_000, 30_000) for g in (0, 1)}
    with pytest.raises(Exception, match="too few rows in group"):
        C.sample_per_group(df, "g", "key", 30_001, 3).count()


def test_leaders_by_name_and_unknown_keys(spark):
    acc = spark.createDataFrame([("echo", "x", "mimo", 0.5), ("echo", "x", "kimi", 0.5), ("echo", "x", "af3", 0.4), ("pitch", "x", "a", None), ("pitch", "x", "b", 0.0)], "category string, variant string, model string, accuracy double")
    assert {(r.category, r.model, r.accuracy) for r in T.category_leaders(acc).collect()} == {("echo", "kimi", 0.5), ("pitch", "b", 0.0)}
    m = spark.createDataFrame([("up", "linear", "low", 0.5), (None, "linear", None, 0.0)], "direction string, curve string, tier string, clipped_ratio double")
    got = sorted((r.scope, r.key, r.n_rows, r.mean_clipped_ratio) for r in W.clip_stats(m).collect())
    assert got == [("by_curve", "linear", 2, 0.25), ("by_direction", "unknown", 1, 0.0), ("by_direction", "up", 1, 0.5), ("by_tier", "low", 1, 0.5), ("by_tier", "unknown", 1, 0.0), ("overall", "all", 2, 0.25)]


def test_next_item_over_shared_lists(spark, tmp_path):
    """Lists that annotators share, against the SQL: items without a category last, repeated items, finished lists, items of other lists."""
    rng, path = random.Random(8), str(tmp_path)
    part = [(k, rng.choice([None, *range(8)])) for k in range(400)] + [(40, 0), (60, None), (None, 1)]
    lines = [(rng.randrange(90), rng.randrange(400), rng.choice("ARN"), n) for n in range(9000)] + [(7, k, "A", 1) for k in range(400)] + [(None, 7, "A", 1), (8, None, "A", 1)]
    spark.createDataFrame([(k,) for k in [*range(100), 3, None]], "s_suppkey long").write.parquet(f"{path}/supplier.parquet")
    spark.createDataFrame(part, "p_partkey long, p_size int").write.parquet(f"{path}/part.parquet")
    rows = spark.createDataFrame(lines, "l_suppkey long, l_partkey long, l_returnflag string, l_linenumber int")
    rest = {"l_extendedprice": F.lit(1.0), "l_quantity": F.lit(1.0), "l_shipdate": F.lit("2024-01-01").cast("timestamp"), "l_orderkey": F.monotonically_increasing_id()}
    rows.withColumns(rest).write.parquet(f"{path}/lineitem.parquet")
    con = duckdb.connect()
    for t in ("supplier", "part", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet/*.parquet'")
    got = sorted(map(tuple, catalog.queries()["h10_next_item"](spark, path).collect()))
    assert got == sorted(con.execute(catalog.oracle_sql()["h10_next_item"]).fetchall()) and 7 not in dict(got) and len(got) > 90


def test_next_item_pairs_nobody_with_a_whole_list(spark):
    """20,000 annotators of one list of 20,000 items: 400 million pairs, of which none but the done ones is made."""
    ids = spark.range(20_000).select(F.col("id"), F.lit("one").alias("list"))
    done = ids.filter("id % 2 = 0").select(F.col("id").alias("who"), F.lit(0).cast("long").alias("item")).union(ids.filter("id % 4 = 0").select("id", F.lit(1)))
    got = L.next_item(ids.withColumnRenamed("id", "who"), ids.withColumnRenamed("id", "item"), done, "who", "item", "list", [])
    assert "CartesianProduct" not in (plan := got._jdf.queryExecution().toString()) and "NestedLoop" not in plan
    assert {(r.n, r.next_item): r.k for r in got.groupBy((F.col("who") % 4).alias("n"), "next_item").agg(F.count("*").alias("k")).collect()} == {(0, 2): 5000, (1, 0): 5000, (2, 1): 5000, (3, 0): 5000}

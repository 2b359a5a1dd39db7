import hashlib
import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.operators import labels as L
from tessera.operators import scoring as S


def scored(spark, rows):
    return S.score_rows(spark.createDataFrame(rows, "raw_response string, gold_label string, error string"))


def test_unparsed_rows_stay_in_the_denominators(spark):
    m = S.binary_metrics(scored(spark, [("increase", "increase", None), (None, "increase", None)])).first()
    assert (m.accuracy, m.accuracy_parsed, m.recall_increase, m.n_unparsed, m.accuracy_down) == (0.5, 1.0, 0.5, 1, None)
    m = S.binary_metrics(scored(spark, [("increase", "increase", None), ("decrease", "decrease", "boom")])).first()
    assert (m.balanced_accuracy, m.accuracy_down, m.n_error, m.accuracy_parsed) == (0.5, 0.0, 1, 1.0)


def test_empty_input_and_error_rows(spark):
    m = S.binary_metrics(scored(spark, [])).first()
    assert m.n_rows == 0 and m.accuracy == 0.0
    m = S.binary_metrics(scored(spark, [("increase decrease", "up", "x"), ("increase", "down", "")])).first()
    assert (m.n_ambiguous, m.n_error, m.n_parsed, m.fp) == (1, 1, 1, 1)


def test_macro_f1(spark):
    df = spark.createDataFrame([("yes", "yes"), (None, "yes"), ("no", "no")], "pred string, gold string")
    assert math.isclose(S.macro_f1(df, ("yes", "no")).first().macro_f1, 5 / 6)


def test_validation(spark):
    rows = [("f", "1", "constant"), ("f", "1", "up"), ("f", None, "down"), ("g", "1", "up")]
    expected = spark.createDataFrame([("f", 3), ("g", 2), ("h", 1)], "file string, n_expected int")
    got = {(r.file, r.violation): r.n_found for r in S.validate_predictions(spark.createDataFrame(rows, "file string, clip string, gold_label string"), expected, "file", "clip").collect()}
    assert got == {("f", "invalid_gold"): 1, ("f", "duplicate_id"): 1, ("f", "missing_id"): 1, ("g", "wrong_count"): 1, ("h", "wrong_count"): 0}


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["increase", "decreases", "both increase decrease", "", None]), st.sampled_from(["up", "down"]), st.sampled_from([None, "e"])), min_size=1, max_size=30))
def test_metrics_recomputed(spark, rows):
    m = S.binary_metrics(scored(spark, rows).repartition(3)).first()
    parse = {"increase": "increase", "decreases": "decrease"}
    pred = [None if e else parse.get(r) for r, _, e in rows]
    gold = [{"up": "increase", "down": "decrease"}[g] for _, g, _ in rows]
    right = sum(p == g for p, g in zip(pred, gold, strict=True))
    recalls = [sum(p == g == k for p, g in zip(pred, gold, strict=True)) / gold.count(k) for k in ("increase", "decrease") if k in gold]
    assert math.isclose(m.accuracy, right / len(rows)) and math.isclose(m.balanced_accuracy, sum(recalls) / len(recalls))


def test_agreement_recomputed(spark):
    rng = random.Random(1)
    rows = [(a, i, rng.choice("AR"), k) for k, (a, i) in enumerate((rng.randrange(6), rng.randrange(12)) for _ in range(120))]
    last = {}
    for a, i, label, _ in rows:
        last[a, i] = label
    df = spark.createDataFrame(rows, "annotator int, item int, label string, k int")
    got = L.last_labels(df.repartition(4), "annotator", "item", "label", ["k"])
    assert {(r.annotator, r.item): r.label for r in got.collect()} == last
    for r in L.item_consensus(got, "item", "label").collect():
        own = [v for (_, i), v in last.items() if i == r.item]
        pairs = [(x, y) for k, x in enumerate(own) for y in own[:k]]
        assert r.majority == min(set(own), key=lambda v: (-own.count(v), v))
        assert math.isclose(r.agreement, sum(x == y for x, y in pairs) / len(pairs) if pairs else 1.0)
    for r in L.pairwise(got, "annotator", "item", "label", "A").collect():
        both = [(last[r.a, i], last[r.b, i]) for i in range(12) if (r.a, i) in last and (r.b, i) in last]
        n, same = len(both), sum(x == y for x, y in both)
        pa, pb = (sum(p[k] == "A" for p in both) / n for k in (0, 1))
        chance = pa * pb + (1 - pa) * (1 - pb)
        assert r.n_shared == n and math.isclose(r.agreement, same / n)
        assert math.isclose(r.kappa, 1.0 if chance >= 1 else (same / n - chance) / (1 - chance), abs_tol=1e-12)


@pytest.mark.parametrize("kind", ["int", "string"])
def test_pairs_by_blocks_are_pairs_by_join(spark, kind):
    """Items beyond the limit in blocks, with several labels, nulls and chunks of items; the rest by a join."""
    rng = random.Random(4)
    rows = [(a if kind == "int" else f"w{a}", i, rng.choice("AABC") if rng.random() > 0.1 else None) for a in range(40) for i in range(30) if rng.random() < (0.9 if i < 12 else 0.1)]
    rows += [(None, 1, "A"), (rows[0][0], None, "A")]
    df = spark.createDataFrame(rows, f"annotator {kind}, item int, label string")
    want = {}
    for a, i, x in rows:
        for b, j, y in rows:
            if None not in (a, b, i) and i == j and a < b:
                s = want.setdefault((a, b), [0, 0, 0, 0])
                for k, v in enumerate((1, x is not None and x == y, x == "A", y == "A")):
                    s[k] += v
    named = df.select(F.col("item").alias("i"), F.col("annotator").alias("who"), F.col("label").alias("l"), F.coalesce((F.col("label") == "A").cast("int"), F.lit(0)).alias("p"))
    named = named.filter("i is not null and who is not null")
    for sums in (L.item_pair_sums(named), L.block_pair_sums(named, 7, 100)):
        assert {(r.a, r.b): [r.n_shared, r.same, r.pa, r.pb] for r in sums.collect()} == want
    chunked = {}
    for r in L.block_pair_sums(named, 16, 8).collect():
        s = chunked.setdefault((r.a, r.b), [0, 0, 0, 0])
        s[:] = [u + v for u, v in zip(s, (r.n_shared, r.same, r.pa, r.pb), strict=True)]
    assert chunked == want
    scores = lambda hot: sorted(map(tuple, L.pairwise(df, "annotator", "item", "label", "A", hot, 7).collect()))
    assert len(scores(1000)) == len(want) and scores(1000) == scores(10) == scores(0)


def test_pairs_of_an_item_that_everybody_labelled(spark):
    n = 2500
    df = spark.range(n).select(F.col("id").alias("annotator"), F.lit(1).alias("item"), F.when(F.col("id") % 3 == 0, "A").otherwise("R").alias("label"))
    got = L.pairwise(df, "annotator", "item", "label", "A").agg(F.count("*"), F.sum("n_shared"), F.sum(F.col("agreement")), F.max("b")).first()
    yes = len(range(0, n, 3))
    assert tuple(got) == (n * (n - 1) // 2, n * (n - 1) // 2, yes * (yes - 1) // 2 + (n - yes) * (n - yes - 1) // 2, n - 1)
    assert L.pairwise(df.limit(0), "annotator", "item", "label", "A").count() == 0


def test_bootstrap_does_not_depend_on_partitions(spark):
    df = spark.createDataFrame([(i % 3, i % 7 != 0) for i in range(300)], "g int, ok boolean")
    a, b = (sorted(S.bootstrap_ci(df.repartition(n), ["g"], "ok", 2000).collect()) for n in (1, 7))
    assert a == b and all(r.ci_low <= r.accuracy <= r.ci_high for r in a)


def test_id_digests_in_order_and_by_ranges(spark):
    ids = [f"c{i % 90}" for i in range(200)]
    df = spark.createDataFrame([("x", c) for c in ids] + [(None, "a"), ("x", None), ("only null", None)], "file string, clip string")
    got = {r.file: (r.n, r.id_sha256) for r in S.id_digest(df.repartition(5), "file", "clip").collect()}
    sha = lambda lines: hashlib.sha256("\n".join(lines).encode()).hexdigest()
    assert got == {"x": (200, sha(sorted(ids))), None: (1, sha(["a"])), "only null": (0, sha([]))}
    ranges = {}
    for c in sorted(set(ids)):
        ranges.setdefault(hashlib.sha256(c.encode()).hexdigest()[:3], []).append(f"{c}={ids.count(c)}")
    by_range = {r.file: (r.n, r.id_sha256) for r in S.id_set_digest(df.repartition(5), ["file"], F.col("clip")).collect()}
    assert by_range["x"] == (200, sha([f"{k}:{sha(v)}" for k, v in sorted(ranges.items())]))
    assert S.id_digest(df.limit(0), "file", "clip").count() == 0

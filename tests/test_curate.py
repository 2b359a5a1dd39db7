import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import curate as C
from tessera.plans import catalog
from tessera.plans.adapters import SPEAKERS, adapt


def in_hash_order(seed, *keys):
    return lambda k: hashlib.sha256(":".join([str(seed), *[str(x) for x in keys], str(k)]).encode()).hexdigest()


@pytest.mark.parametrize("case", range(4))
def test_quota_sample_is_the_sequential_greedy(spark, case):
    rng = random.Random(case)
    rows = [(f"s{rng.randrange(5)}", k, f"t{rng.randrange(25)}") for k in range(120)]
    lists = {}
    for s in sorted({r[0] for r in rows}):
        own = sorted((r for r in rows if r[0] == s), key=lambda r: (in_hash_order(9, s)(r[1]), r[1]))
        seen = set()
        lists[s] = [(k, t) for _, k, t in own if not (t in seen or seen.add(t))]
    targets = dict.fromkeys(lists, 3)
    want = C.greedy_quota(lists, targets)
    df = spark.createDataFrame(rows, "speaker string, clip int, text string")
    t = spark.createDataFrame(list(targets.items()), "speaker string, target int")
    rounds = []
    got = C.unique_text_quota_sample(df.repartition(4), "speaker", "clip", "text", t, 9, log=rounds).collect()
    assert sorted((r.speaker, r.clip, r.slot) for r in got) == sorted(want)
    assert rounds[0][0] == 15 and all(moved < 15 for moved, _ in rounds[1:]) and rounds[-1][1] == 0


def test_quota_rounds_move_losers_and_those_behind_them_only(spark):
    """Two speakers who share one text of 400 each: one bid is lost, and only slots behind it bid again."""
    rows = [(s, k, "shared" if k == 0 else f"{s}{k}") for s in "ab" for k in range(400)]
    lists = {s: [(k, t) for _, k, t in sorted((r for r in rows if r[0] == s), key=lambda r: in_hash_order(2, s)(r[1]))] for s in "ab"}
    at = {s: [t for _, t in lists[s]].index("shared") + 1 for s in "ab"}
    targets = {"a": 390, "b": 390}
    df, t = spark.createDataFrame(rows, "speaker string, clip int, text string"), spark.createDataFrame(list(targets.items()), "speaker string, target int")
    rounds = []
    got = C.unique_text_quota_sample(df, "speaker", "clip", "text", t, 2, log=rounds).collect()
    assert sorted((r.speaker, r.clip, r.slot) for r in got) == sorted(C.greedy_quota(lists, targets))
    assert rounds == [(780, 1), (391 - max(at.values()), 0)]


def test_quota_of_null_texts_and_speakers(spark):
    df = spark.createDataFrame([(None, 1, "x"), (None, 2, None), ("a", 3, "x"), ("a", 4, "y")], "speaker string, clip int, text string")
    t = spark.createDataFrame([(None, 1), ("a", 1)], "speaker string, target int")
    got = C.unique_text_quota_sample(df, "speaker", "clip", "text", t, 1).collect()
    assert {(r.speaker, r.slot) for r in got} == {(None, 1), ("a", 1)} and {r.clip for r in got} == {1, 4}


def test_quota_that_cannot_be_met_raises(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("b", 2, "x")], "speaker string, clip int, text string")
    t = spark.createDataFrame([("a", 1), ("b", 1)], "speaker string, target int")
    with pytest.raises(ValueError, match="too few texts"):
        C.unique_text_quota_sample(df, "speaker", "clip", "text", t, 1).collect()


@pytest.mark.parametrize("parts", [1, 4, 17])
def test_samples_do_not_depend_on_partitions(spark, parts):
    df = spark.range(200).select(F.col("id").alias("clip_id"), (F.col("id") % 5).alias("speaker")).orderBy(F.rand(parts)).repartition(parts)
    got = sorted(r.clip_id for r in C.sample_per_group(df, "speaker", "clip_id", 3, 1).collect())
    want = []
    for s in range(5):
        want += sorted(range(s, 200, 5), key=lambda k: in_hash_order(1, s)(k))[:3]
    assert got == sorted(want)


def test_short_group_raises(spark):
    with pytest.raises(Exception, match="too few rows"):
        C.sample_per_group(spark.createDataFrame([(1, 1)], "clip_id int, speaker int"), "speaker", "clip_id", 2, 1).collect()


def test_fewshot_contexts_are_distinct_and_of_the_category(spark):
    t = spark.range(60).select(F.col("id").alias("clip"), (F.col("id") % 3).alias("cat"), (F.col("id") % 2).alias("label"))
    got = C.fewshot_contexts(t, t, "clip", "clip", "cat", "label", 4, 1).collect()
    per = {}
    for r in got:
        per.setdefault(r.clip, []).append(r)
        assert r.train_key % 3 == r.cat and r.train_key % 2 == r.label
    assert all(len(v) == 8 and len({r.train_key for r in v}) == 8 and sorted(r.place for r in v) == list(range(1, 9)) for v in per.values())


def test_stratified_split_edges(spark):
    df = spark.createDataFrame([("a", 1)] + [("b", i) for i in range(2)] + [("c", i) for i in range(10)], "label string, k int")
    n = {(r.label, r.split): r["count"] for r in C.stratified_split(df, "label", "k", 0.25, 1).groupBy("label", "split").count().collect()}
    assert n == {("a", "train"): 1, ("b", "train"): 1, ("b", "val"): 1, ("c", "val"): 2, ("c", "train"): 8}
    assert C.stratified_split(df, "label", "k", 0, 1).filter("split = 'val'").count() == 0


def balanced_by_hand(rows, n, iters, seed):
    """rows: (speaker, gender, accent)."""
    even = lambda labels: {x: n // len(labels) + (i < n % len(labels)) for i, x in enumerate(sorted(labels))}
    genders, accents = even({r[1] for r in rows} & {"F", "M"}), even({r[2] for r in rows})
    tried = []
    for trial in range(iters):
        drawn = sorted(rows, key=lambda r: (in_hash_order(seed, trial)(r[0]), r[0]))[:n]
        off = lambda targets, k: sum(abs(sum(r[k] == x for r in drawn) - t) for x, t in targets.items())  # noqa: E731, B023
        tried.append((10 * off(genders, 1) + off(accents, 2), trial, drawn))
    score, trial, drawn = min(tried, key=lambda t: t[:2])
    return sorted((*r, trial, score) for r in drawn)


def test_balanced_search_draws_from_all_speakers(spark, sf_small):
    rows = [(r.speaker, r.gender, r.accent) for r in adapt(spark, sf_small, SPEAKERS).collect()]
    got = catalog.queries()["c4_balanced_group_search_all"](spark, sf_small).collect()
    assert sorted((r.speaker, r.gender, r.accent, r.trial, r.score) for r in got) == balanced_by_hand(rows, 20, 60, 3)


def test_balanced_search_passes_on_few_rows_of_a_partition(spark):
    df = spark.range(3000).select(F.col("id").alias("s"), F.when(F.col("id") % 3 == 0, "F").otherwise("M").alias("g"), (F.col("id") % 4).cast("string").alias("a"))
    got = C.balanced_group_search(df.repartition(6), "s", "g", "a", 10, 8, 1).collect()
    assert sorted(tuple(r) for r in got) == balanced_by_hand([tuple(r) for r in df.collect()], 10, 8, 1)


def test_balanced_search_draws_again_what_came_short(spark):
    """With a share that leaves too few rows of some trials, in blocks, and on fewer speakers than are wanted."""
    rows = [(k, "FM"[k % 2], "xyz"[k % 3]) for k in range(400)]
    df = spark.createDataFrame(rows, "s long, g string, a string")
    got = C.balanced_group_search(df, "s", "g", "a", 13, 10, 5, block=3).collect()
    assert sorted(tuple(r) for r in got) == balanced_by_hand(rows, 13, 10, 5)
    drawn, _ = C.least_draws(df, "s", 13, 400 * 3, range(4, 9), 5)  # as if the table had three times its rows: the first share is too small
    for trial in range(4, 9):
        assert {r.s for r in drawn.filter(F.col("trial") == trial).collect()} == set(sorted(range(400), key=in_hash_order(5, trial))[:13])
    assert drawn.count() == 5 * 13
    assert C.balanced_group_search(df, "s", "g", "a", 500, 3, 5).count() == 400
    assert C.balanced_group_search(df.limit(0), "s", "g", "a", 5, 3, 5).count() == 0


def test_balanced_search_stops_at_a_perfect_draw(spark):
    df = spark.createDataFrame([(k, "FM"[k % 2], "x") for k in range(4)], "s long, g string, a string")
    got = C.balanced_group_search(df, "s", "g", "a", 4, 1 << 40, 5, block=16).collect()  # all four: score 0 in trial 0
    assert [(r.trial, r.score) for r in got] == [(0, 0)] * 4


def test_hash_ranks_are_the_places_within_a_group(spark):
    rows = [(None if k % 4 == 0 else "ab"[k % 2], k) for k in range(400)]
    df = spark.createDataFrame(rows, "g string, k long").repartition(7)
    got = {(r.g, r.k): (r["__at"], r["__size"]) for r in C.hash_ranks(df, ["g"], C.hash_order(5, F.col("k")), "k", 1).collect()}
    for g in (None, "a", "b"):
        own = sorted((k for x, k in rows if x == g), key=in_hash_order(5))
        assert [got[g, k] for k in own] == [(i + 1, len(own)) for i in range(len(own))]
    assert len(got) == 400


def test_ordered_places_number_all_rows(spark):
    df = spark.range(500).select((F.col("id") * 37 % 1009).alias("k")).repartition(6)
    got = sorted((r.k, r.i) for r in C.ordered_places(df, ["k"], "i").collect())
    assert [i for _, i in got] == list(range(500))
    assert C.ordered_places(df.limit(0), ["k"], "i").count() == 0

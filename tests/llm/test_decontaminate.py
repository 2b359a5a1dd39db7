import random

import numpy as np
import pytest

from tessera.llm import decontaminate as m
from tessera.llm.decontaminate import brute, contamination


def check(spark, docs, items):
    d = spark.createDataFrame([(i, t, 1) for i, t in enumerate(docs)], "doc_id long, text string, n_words int")
    b = spark.createDataFrame(items, "item_id string, text string")
    got = {r.doc_id: r for r in contamination(d, b).collect()}
    for i, e in enumerate(brute(docs, items)):
        r = got[i]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == e, docs[i]
    return got


def test_against_brute_force(spark):
    rng = random.Random(3)
    word = lambda: rng.choice(["ab", "cé", "d1", "Éa", "x"])
    items = [(str(i), " ".join(word() for _ in range(rng.randrange(0, 20)))) for i in range(30)] + [("n", None), ("dup", "q r s"), ("dup2", "Q r, S")]
    docs = [None, "", "...", "Q-R\nS!", "xq r s", "q r sx", "q r s " * 3]
    for _ in range(60):
        parts = [" ".join(word() for _ in range(rng.randrange(40)))]
        if rng.random() < 0.6:
            parts += [rng.choice(items)[1] or "", " ".join(word() for _ in range(rng.randrange(300)))]
        docs.append("; ".join(parts))
    check(spark, docs, items)


def test_long_items_and_texts_against_brute_force(spark):
    """Items of all lengths around multiples of the seed; texts that hold stretches of all lengths at all places."""
    rng = random.Random(5)
    words = lambda n: [rng.choice("abcdefgh") * rng.randrange(1, 3) for _ in range(n)]
    items = [(f"i{n}", " ".join(words(n))) for n in [*range(1, 45), 400]] + [("rep", "la " * 60), ("i44", "another text under a known id")]
    docs = []
    for _ in range(150):
        parts = []
        for _ in range(rng.randrange(1, 6)):
            w = rng.choice(items)[1].split()
            a = rng.randrange(len(w))
            parts += w[a : a + rng.choice([12, 13, 14, 20, 50])] + words(rng.randrange(0, 30))
        docs.append(" ".join(parts))
    docs += ["la " * n for n in (12, 13, 14, 700)] + [" ".join(docs)]
    check(spark, docs, items)


def test_automaton_finds_what_a_plain_search_finds():
    rng = random.Random(6)
    for _ in range(60):
        patterns = list({tuple(rng.randrange(1, 4) for _ in range(rng.randrange(1, 7))) for _ in range(rng.randrange(1, 12))})
        words = [rng.randrange(0, 5) % 4 for _ in range(rng.randrange(0, 900))]
        want = sorted((k + len(p), i) for i, p in enumerate(patterns) for k in range(len(words) - len(p) + 1) if tuple(words[k : k + len(p)]) == p)
        assert sorted(m.Automaton(patterns, 4).scan(np.array(words, np.int64))) == want
    assert m.Automaton([], 1).scan(np.array([0, 0])) == []


def test_a_large_benchmark_takes_one_scan_and_a_larger_one_is_refused(spark):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(50_000)]
    items = [(str(i), " ".join(rng.choices(vocabulary, k=3_500))) for i in range(1_000)]  # some 20 MB
    b = spark.createDataFrame(items, "item_id string, text string")
    d = spark.createDataFrame([(i, t[5_000:9_000]) for i, (_, t) in enumerate(items[:20])], "doc_id long, text string")
    got = contamination(d, b)
    assert got._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert [r.n_items for r in got.collect()] == [1] * 20
    with pytest.raises(ValueError):
        contamination(d, b, most=1_000)


def test_offsets_point_into_the_text(spark):
    item = " ".join(f"w{i}" for i in range(13))
    text = "Vorspiel é:  " + item.upper().replace(" ", " -- ") + "! ende"
    r = check(spark, [text], [("7", item)])[0]
    assert [text[x.start : x.end].lower().split(" -- ") for x in r.matches] == [item.split()]


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    assert [r.contaminated for r in contamination(d, b).collect()] == [False] * 3
    assert contamination(d.limit(0), b).count() == 0

import random

import numpy as np
from tessera.llm import near as m
from tessera.llm.common import words_of
from tessera.llm.graph import components


def shingle_set(t):
    w = words_of(t)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """doc_id -> (class members by id, n_copies, n_links), all pairs."""
    texts = {}
    for i, t in rows:
        texts.setdefault(tuple(words_of(t)) or (None, i, id(t)), []).append(i)
    keys = [k for k in texts if k[0] is not None]
    sets = {k: shingle_set(" ".join(w.decode() for w in k)) for k in keys}
    near = {k: {o for o in keys if o != k and len(sets[k] & sets[o]) >= 0.8 * len(sets[k] | sets[o])} for k in keys}
    out, seen = {}, {}
    for k in texts:
        todo, group = [k], {k}
        while todo:
            for o in near.get(todo.pop(), ()):
                if o not in group:
                    group.add(o)
                    todo.append(o)
        least = min(i for o in group for i in texts[o])
        for i in texts[k]:
            out[i] = (least, len(texts[k]), len(near.get(k, ())))
    return out


def corpus(seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefé") for _ in range(rng.randrange(1, 6)))
    rows = []
    for _ in range(40):
        base = [word() for _ in range(rng.randrange(1, 150))]
        for _ in range(rng.randrange(1, 5)):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                w[rng.randrange(len(w))] = word()
            rows.append(" ".join(w))
    rows += ["", None, "- -", None, "a b c", "A b, c!", "a b c d", "a b c d e", "a b c d e"]
    return list(enumerate(rows))


def compare(spark, rows):
    df = spark.createDataFrame([(i, t, 3) for i, t in rows], "doc_id long, text string, class_id int")
    got = m.near_copies(df).collect()
    assert len(got) == len(rows)
    return {r.doc_id: (r.class_id, r.n_copies, r.n_links) for r in got}


def test_against_all_pairs(spark):
    rows = corpus()
    assert compare(spark, rows) == brute(rows)


def test_query_documents(spark, sf_small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()]
    assert compare(spark, rows) == brute(rows)


def test_large_groups_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(m, "BLOCK_TEXTS", 60)
    monkeypatch.setattr(m, "BLOCK_SHINGLES", 9_000)
    monkeypatch.setattr(m, "BLOCK_PROFILES", 40)
    rng = random.Random(9)
    rows = []
    for edits, n in ((3, 130), (2, 110), (8, 110)):
        base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        for i in range(n):
            w = list(base)
            for k in rng.sample(range(200), min(edits, 3)):
                w[k] = f"x{rng.randrange(10**6)}"
            for k in range(0, 5 * edits, 10):  # edits that many texts have in common
                w[k + 3] = rng.choice(["same", "same", w[k + 3], f"one{k % 20}", f"few{i % 9}"])
            rows.append((edits * 1000 + i, " ".join(w)))
    rows += [(9000 + i, " ".join(f"y{rng.randrange(10**6)}" for _ in range(100))) for i in range(50)] + [(9500 + i, t) for i, t in rows[:30]]
    assert compare(spark, rows) == brute(rows)


def test_pruning_keeps_what_reaches_the_threshold():
    rng = np.random.default_rng(0)
    least = m.least_matches(0.8)
    a = rng.integers(0, 1 << 32, (4000, m.HASHES), dtype=np.uint32)
    b = np.where(rng.random(a.shape) < 0.8, a, a + 1)
    assert len(m.survivors(a, b, least)) >= 3995 and len(m.survivors(a, np.where(rng.random(a.shape) < 0.3, a, a + 1), least)) < 5


def test_components_of_chains(spark):
    edges = [(f"{i:03}", f"{i + 1:03}") for i in range(40)] + [("z1", "z2")]
    random.Random(1).shuffle(edges)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert set(got.values()) == {"000", "z1"} and len(got) == 43


def test_empty_table(spark):
    assert m.near_copies(spark.createDataFrame([], "doc_id long, text string")).count() == 0

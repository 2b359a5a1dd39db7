import random

import numpy as np
from tessera.llm import repeats as m


def covered(df):
    out = {}
    for r in m.repeated_passages(df).collect():
        assert r.n_words == r.end_word - r.start_word >= m.MIN_WORDS
        out.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
    return out


def corpus(seed=0):
    rng = random.Random(seed)
    words = lambda n: [f"w{rng.randrange(10**7)}" for _ in range(n)]
    passages = [words(n) for n in (40, 49, 50, 51, 55, 60, 64, 70, 120, 300)]
    rows = []
    for i in range(60):
        w = words(rng.randrange(0, 60))
        for p in rng.sample(passages, rng.randrange(0, 3)):
            w += p + words(rng.randrange(1, 40))
        rows.append((i, " ".join(w)))
    rows += [(100 + i, "spam " * 200 + " ".join(words(5))) for i in range(1)] + [(200, rows[3][1]), (201, None), (202, "")]
    return rows


def test_against_all_windows(spark):
    for seed in range(3):
        rows = corpus(seed)
        got = covered(spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n_words int"))
        assert got == m.brute(rows)


def test_documents(spark, sf_small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()]
    want, got = m.brute(rows), covered(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got == want


def test_many_documents_share_a_passage(spark):
    rng = random.Random(4)
    common = [f"c{i}" for i in range(53)]
    rows = [(i, " ".join([f"a{rng.randrange(10**7)}" for _ in range(30)] + common + [f"b{rng.randrange(10**7)}" for _ in range(30)])) for i in range(500)]
    assert covered(spark.createDataFrame(rows, "doc_id long, text string")) == {i: set(range(30, 83)) for i in range(500)}


def test_stretch_hashes():
    w = np.random.default_rng(1).integers(0, 1 << 63, 200, dtype=np.uint64)
    h = m.Hashes(np.concatenate([w, w]))
    assert (h.of(np.arange(150), 50) == h.of(np.arange(200, 350), 50)).all()
    assert len(set(h.of(np.arange(150), 50).tolist())) == 150


def test_empty_table(spark):
    assert m.repeated_passages(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert m.repeated_passages(spark.createDataFrame([(None, "a " * 80), (None, "a " * 80)], "doc_id long, text string")).count() == 0


def test_rows_without_id_are_told_apart_by_their_text(spark):
    rng = random.Random(2)
    words = lambda n: " ".join(f"w{rng.randrange(10**7)}" for _ in range(n))
    common = words(60)
    rows = [(None, f"{words(9)} {common} {words(i)}") for i in range(20)] + [(1, common), (2, words(80))]
    got = m.repeated_passages(spark.createDataFrame([*rows, rows[0]], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.start_word, r.end_word) for r in got) == [(0, 9, 69)] * 20 + [(1, 0, 60)]

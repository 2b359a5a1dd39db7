import zlib
from collections import Counter
from math import isclose, log10

import numpy as np
from tessera.llm import ppm as m


def counts_of(texts, share=0.0):
    """Counts after every context; none of four bytes or more reaches before the third start byte, nor of five."""
    levels = [{} for _ in range(m.DEPTH + 1)]
    total = 0
    for t in texts:
        raw = m.START + (t or "").encode() + m.END
        for i in range(3, len(raw)):
            total += 1
            for d in range(min(m.DEPTH, i) + 1):
                levels[d].setdefault(int.from_bytes(raw[i - d : i], "big") | d << 60, np.zeros(256))[raw[i]] += 1
    levels = [{c & ((1 << 60) - 1): x for c, x in level.items()} for level in levels]
    for d in range(2, m.DEPTH + 1):
        levels[d] = {c: x for c, x in levels[d].items() if x.sum() >= share * total}
    return levels


def as_levels(counts):
    return [(np.array(sorted(c), np.int64), np.array([c[k] for k in sorted(c)])) for c in counts]


def brute_score(levels, text):
    raw = m.START + (text or "").encode() + m.END
    return sum(m.brute_log10(levels, raw[max(0, i - m.DEPTH) : i], raw[i]) for i in range(3, len(raw)))


def test_trie_is_a_distribution_and_follows_the_definition():
    levels = counts_of(["abracadabra", "abra cad", "", "zé"], 0.02)
    t = m.Trie(as_levels(levels))
    assert np.allclose((10.0 ** t.logs.astype(float)).sum(axis=1), 1, atol=1e-4)
    texts = ["abracad", "", None, "xyzzy", "é", "abra\0\0z", "a"]
    assert np.allclose(t.score(texts), [brute_score(levels, x) for x in texts], rtol=1e-5)


def brute_base(train, text):
    tokens = lambda t: [*(t or "").encode().lower().split(), None]
    c = Counter(w for t in train for w in tokens(t))
    n, v = sum(c.values()), len(c)
    own = tokens(text)
    return len(own), sum(c[w] > 0 for w in own), n, sum(log10((c[w] + 1) / (n + v + 1)) for w in own)


def test_query_against_brute_force(spark, sf_small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()]
    rows += [(9001, None), (9002, ""), (9003, "É\x0bB  b\x1cq " + "w" * 500), (9001, "dup id"), (None, "no id")]
    docs = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, score int")
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    train = [t for i, t in rows if not held(i)]
    levels = counts_of(train, m.NODE_SHARE)
    got = m.score(docs, docs.filter(m.bucket("doc_id", 7) != 2), head_words=300).collect()
    assert len(got) == len(rows)
    by = {(r.doc_id, r.n_tokens): r for r in got}
    for i, t in rows[::7] + rows[-5:]:
        n, known, total, base = brute_base(train, t)
        r = by[i, n]
        assert (r.n_known, r.train_tokens) == (known, total) and isclose(r.base_score, base, rel_tol=1e-9)
        assert isclose(r.score, brute_score(levels, t), rel_tol=1e-4)


def test_rare_contexts_of_a_large_table_count(spark):
    common = [(i, "the same old line is said again and again " * 40) for i in range(400)]
    rare = [(1000 + i, f"quizzical zephyr {i % 3}") for i in range(6)]
    odd = [(2000, "quizzical zephyr"), (2001, "quizzed é zzz"), (2002, None), (2003, "q")]
    levels = counts_of([t for _, t in common + rare])
    train, docs = (spark.createDataFrame(x, "doc_id long, text string") for x in (common + rare, common[:3] + rare + odd))
    for size in (0, 90, m.HEAD_GRAMS):
        got = {r.doc_id: r.score for r in m.score(docs, train, head_grams=size).collect()}
        assert len(got) == 13
        for i, t in common[:3] + rare + odd:
            assert isclose(got[i], brute_score(levels, t), rel_tol=1e-5)


def test_learns(spark, sf_check):
    got = m.held_out_score(spark.read.parquet(f"{sf_check}/documents.parquet")).filter("held_out").collect()
    assert len(got) > 100 and sum(r.score for r in got) > 1.1 * sum(r.base_score for r in got)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "ab"), (2, None)], "doc_id long, text string")
    r = {x.doc_id: x for x in m.score(docs, docs.limit(0)).collect()}
    assert (r[1].n_tokens, r[1].n_known, r[1].train_tokens, r[1].base_score) == (2, 0, 0, 0.0)
    assert isclose(r[1].score, 3 * log10(1 / 256), rel_tol=1e-5)
    assert m.score(docs.limit(0), docs).count() == 0

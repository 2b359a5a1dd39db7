import collections
import random
import re

import pytest

from tessera.llm import collocations as m
from tessera.llm.queries import op11_collocations, oracle_sql
from tests.oracle import compare, connect

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counts(rows):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            w = re.findall(r"[^ \t]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    return f, n


def brute(rows, least, top):
    f, n = counts(rows)
    out = []
    for lang, c in f.items():
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        held = {q for p, a in cand.items() for q in (p[:2], p[1:]) if len(p) == 3 and 100 * a >= 50 * c[q]}
        best = []
        for p in cand.keys() - held:
            score, k = min((10**6 * c[p] ** 2 // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            best.append((-score, -c[p], " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i, ph.decode(), -a, left, right, n[lang], -s) for i, (s, a, ph, left, right) in enumerate(sorted(best)[:top], 1)]
    return sorted(out)


def texts(seed=1, n=300):
    rng = random.Random(seed)
    bag = ["a", "B", "of", "the", "é", "É", "ﬁ", "x" * 30, "don't", "-", "\x00", "\x7f", " ", "\U0001f600"]
    glue = [" "] * 8 + ["  ", "\t", ".", ", ", "!?", "\n", "\r\n", "\x0b", ";", ":"]
    return ["".join(rng.choice(bag) + rng.choice(glue) for _ in range(rng.randrange(40))) for _ in range(n)]


def rows_of(df):
    return sorted(tuple(r[c] for c in "lang rank phrase a l r n score".split()) for r in df.collect())


def test_against_all_phrases(spark):
    bodies = [None, "", " ", ".", "a b c", "a b c", *texts()]
    rows = [(i, t, [None, "und", "en", "de"][i % 4], "x") for i, t in enumerate(bodies)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, phrase string")
    for least, top in ((2, 2000), (10, 7)):
        assert rows_of(m.collocations(df, least, top)) == brute([(t, lang) for _, t, lang, _ in rows], least, top)
    assert m.collocations(df.limit(0)).count() == 0
    assert m.collocations(df.withColumnRenamed("phrase", "n").repartition(3), 2, 2000).count() == len(brute([r[1:3] for r in rows], 2, 2000))


@pytest.mark.parametrize("seed", range(3))
def test_tries_that_burst_spill_and_forget(monkeypatch, seed):
    rng = random.Random(seed)
    for name, value in {"BURST": rng.choice([2, 9]), "HELD": rng.choice([20, 300]), "WORDS": rng.choice([5, 60]), "CHUNK": rng.choice([7, 400])}.items():
        monkeypatch.setattr(m, name, value)
    bodies = texts(seed, 120) + [" ".join(f"w{rng.randrange(90)}" for _ in range(3000)), "y" * 5000, "é" * 3 + " " + "z" * 50]
    counter, runs = m.Counter(16), []
    for lang in ("en", "de"):
        for i in range(0, len(bodies), 40):
            runs += counter.feed(lang, bodies[i : i + 40])
    runs += counter.close()
    f, n = counts([(t, "en") for t in bodies])
    want = {" ".join(p): c for p, c in f["en"].items()} | {"": n["en"]}
    for lang in ("en", "de"):
        by = collections.defaultdict(list)
        for unit, own, run in runs:
            if own == lang:
                by[unit].append(m.unpacked(run))
        got = [(p.decode(), c) for parts in by.values() for p, c in zip(*m.merged(parts).to_pydict().values(), strict=True)]
        assert len(got) == len(want) and dict(got) == want  # no phrase in two partitions
    assert all(p == sorted(p) for p in ([w.split(b" ") for w in m.unpacked(run)["phrase"].to_pylist()] for _, _, run in runs))


def test_large_counts_are_exact(spark):
    a, left, right = 3_000_000_000_000_007, 3_000_000_000_000_011, 3_000_000_000_000_019
    got = spark.createDataFrame([(a, left, right)], "a long, f1 long, f2 long").select(m._scored("a", [("f1", "f2"), ("f2", "f1")]).alias("c")).collect()[0].c
    assert (got.score, got.k, got.l) == (10**6 * a * a // (left * right), 1, left)


def test_the_query_against_its_sql(spark, sf_check):
    assert compare(spark, connect(sf_check), "op11", op11_collocations, oracle_sql()["op11_collocations"], sf_check) == ""

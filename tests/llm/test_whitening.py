import math

import numpy as np
import pytest

from tessera.llm import whitening as m
from tessera.llm.queries import op12_whitening

NAN, INF = float("nan"), float("inf")


def plain(vectors, k):
    """Eigenvalues, deviations, the exact centred rows and the trace, from exact whole numbers."""
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for v in vectors], object)
    n = len(x)
    y = n * x - x.sum(axis=0)
    v = (y.T.dot(y) / n**3).astype(float)
    e, u = np.linalg.eigh(v)
    return n, [int(s) for s in (y * y).sum(axis=1)], (y / n).astype(float), e[::-1][:k], u[:, ::-1][:, :k], float(np.trace(v))


def check(got, ids, vectors, k, close=1e-9):
    n, deviations, c, e, u, trace = plain(vectors, k)
    assert len(got) == n * len(e) and {(r.vec_id, r.component) for r in got} == {(i, j + 1) for i in ids for j in range(len(e))}
    at = {(r.vec_id, r.component): r for r in got}
    w = np.array([[at[i, j + 1].whitened for j in range(len(e))] for i in ids])
    want = c @ u / np.sqrt(e)
    assert np.abs(w * np.sign((w * want).sum(axis=0)) - want).max() < close
    assert [at[i, 1].deviation for i in ids] == deviations
    assert np.allclose([at[ids[0], j + 1].explained for j in range(len(e))], e / trace, rtol=1e-10)
    error = np.abs(np.cov(w.T, bias=True).reshape(len(e), -1) - np.eye(len(e))).max()
    assert {r.n for r in got} == {n} and all(abs(r.identity_error - error) < 1e-9 and r.identity_error < 1e-6 for r in got)


def test_fewer_dimensions_than_the_block(spark):
    rng = np.random.default_rng(1)
    v = (rng.standard_normal((300, 7)) * [9, 5, 4, 3, 1, 0.5, 0.2]).astype(np.float32)
    odd = [(None, [1.0] * 7), (900, None), (901, []), (902, [NAN] * 7), (903, [INF] + [0.0] * 6), (904, [None] + [0.0] * 6), (905, [1.0, 2.0]), (906, [1e30] + [0.0] * 6)]
    rows = [(i, x) for i, x in enumerate(v.tolist())] + odd
    df = spark.createDataFrame([(i, x, 1, 2.0) for i, x in rows], "vec_id long, embedding array<float>, x int, whitened double")
    kept = [(i, x) for i, x in rows if i is None or i < 900]
    check(m.whiten(df.repartition(5)).collect(), [i for i, _ in kept], [x for _, x in kept], 7)
    assert m.whiten(df.limit(0)).count() == 0
    assert m.whiten(df.filter("vec_id = 3")).count() == 0 and m.whiten(df.filter("vec_id >= 900 and vec_id <= 904")).count() == 0


def test_filtered_rounds_and_equal_rows(spark):
    rng = np.random.default_rng(2)
    v = rng.standard_normal((400, 90)) @ np.diag(np.r_[np.geomspace(300, 2, 20), np.linspace(2, 1, 70)])
    v = np.r_[v, v[:50]]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "vec_id long, embedding array<double>")
    check(m.whiten(df.repartition(4), components=20).collect(), list(range(len(v))), v.tolist(), 20)


def test_rank_below_the_components(spark):
    rng = np.random.default_rng(4)
    v = np.c_[rng.integers(-9, 9, (60, 3)).astype(float), np.full((60, 80), 0.5)]
    v = np.c_[v, v[:, 0]]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "vec_id long, embedding array<double>")
    got = m.whiten(df).collect()
    assert {r.component for r in got} == {1, 2, 3} and max(r.identity_error for r in got) < 1e-9


def test_sums_beyond_64_bits():
    x = np.array([[1 << 50, 0], [-(1 << 50), 3], [5, 1]])
    centre = m.Centre(3, tuple(int(s) for s in x.astype(object).sum(axis=0)))
    y = 3 * x.astype(object) - np.array(centre.sums, object)
    want = [int(a * a + b * b) for a, b in y]
    assert centre.deviations(x) == [w if w < 1 << 63 else None for w in want] and centre.deviations(x)[0] is None


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_the_query_on_its_table(spark, sf):
    rows = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").collect()
    check(op12_whitening(spark, f"/root/testdata/{sf}").collect(), [r.vec_id for r in rows], [r.embedding for r in rows], 32)

"""Whitening of embeddings: leading eigenvectors of their covariance by Chebyshev-filtered subspace iteration.

The data are only ever multiplied: a pass over all rows gives X'(XQ) for a block Q of few columns, X centred first. A polynomial
of such passes, by the three-term recurrence of Chebyshev's, damps what lies below the block's least eigenvalue and lifts the
rest; QR and Rayleigh-Ritz follow on the driver, on matrices of d rows and as many columns as the block. It ends when the
residuals of all wanted pairs are at rounding level, so that a result is certified and not merely converged.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

COMPONENTS = 32
#: Degree of the filter: passes over the data in one round.
DEGREE = 8
#: Rounds after which the search gives up with an error rather than return what is not certified.
ROUNDS = 60
#: Residual of a certified pair, in units of the greatest eigenvalue; and the most that may stand where rounding stops its fall.
TOLERANCE, LOOSEST = 1e-14, 1e-12
#: Rows of an Arrow batch.
VECTOR_ROWS = 2000
#: Tasks that add up what tasks have added up.
GATHER = 4
#: Entries of 2**45 or more would not be whole after the scaling; such rows are dropped as those with non-finite entries are.
LARGEST = float(1 << 45)


def quantized(df: DataFrame, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(key, x): x = floor(64 c) + 1,000,000 of every entry c, without rows that are null, empty or hold null, non-finite or huge entries.

    If rows differ in length, those of the commonest length stay, the longer of equally common ones.
    """
    c = F.col(vector).cast("array<double>")
    fine = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < LARGEST)
    kept = df.select(F.col(key), c.alias("__c")).filter(F.col("__c").isNotNull() & (F.size("__c") > 0)).filter(F.forall("__c", fine))
    kept = materialize(kept.select(key, F.transform("__c", lambda v: F.floor(v * 64).cast("long") + 1_000_000).alias("x")))
    lengths = kept.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    return kept.filter(F.size("x") == lengths[0].d) if lengths else kept


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of an Arrow list column, all of one length, as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _gathered(df: DataFrame, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all rows of the matrices that `of` makes of blocks of x, added up in Spark.

    A task adds up its own rows. The rows of these sums go to a few tasks and are added again, so that the driver gets a few
    matrices and not one from each task that read vectors.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(VECTOR_ROWS))

    def told(rows: Sequence[int], values: Sequence[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array(list(values), pa.list_(pa.float64()))], names=["row", "v"])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                got = of(_matrix(batch.column(0)))
                total = got if total is None else total + got
        if total is not None:
            yield told(range(len(total)), total)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for row, v in zip(batch.column(0).to_pylist(), _matrix(batch.column(1)) if batch.num_rows else (), strict=True):
                held[row] = held[row] + v if row in held else v
        if held:
            yield told(list(held), list(held.values()))

    schema = "row int, v array<double>"
    sums = df.select("x").mapInArrow(part, schema).repartition(GATHER).mapInArrow(add, schema).toArrow()
    rows, values = sums.column("row").to_numpy(), _matrix(sums.column("v").combine_chunks())
    out = np.zeros((rows.max() + 1, values.shape[1]))
    np.add.at(out, rows, values)
    return out


def totals(df: DataFrame) -> tuple[int, list[int]]:
    """n and the exact sum of every dimension."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, None
        for batch in batches:
            if batch.num_rows:
                own = _matrix(batch.column(0)).sum(axis=0, dtype=np.int64).tolist()
                n, sums = n + batch.num_rows, own if sums is None else [a + b for a, b in zip(sums, own, strict=True)]
        for i, v in enumerate([n, *sums] if n else ()):
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([str(v)])], names=["row", "v"])

    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(VECTOR_ROWS))
    rows = df.select("x").mapInArrow(part, "row int, v string").groupBy("row").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()
    found = [int(r.v) for r in sorted(rows, key=lambda r: r.row)]
    return (found[0], found[1:]) if found else (0, [])


@dataclass(frozen=True)
class Centre:
    """Exact mean S / n of every dimension, as a whole part and a rest below 1."""

    n: int
    sums: tuple[int, ...]

    def of(self, x: np.ndarray) -> np.ndarray:
        """x - S / n, rounded once."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        return (x - whole) - np.array([s % self.n for s in self.sums], float) / self.n

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The sum over dimensions of (n x - S)^2, exact; null beyond 64 bits."""
        reach = self.n * float(np.abs(self.of(x)).max(initial=0)) + 1
        if max(reach * reach * x.shape[1], self.n * float(np.abs(x).max(initial=0))) < 2.0**62:
            y = self.n * x - np.array(self.sums, np.int64)
            return (y * y).sum(axis=1).tolist()
        y = self.n * x.astype(object) - np.array(self.sums, object)
        return [v if v < 1 << 63 else None for v in (y * y).sum(axis=1)]


def _filtered(times: Callable[[np.ndarray], np.ndarray], q: np.ndarray, vq: np.ndarray, e: np.ndarray, wanted: int) -> np.ndarray:
    """The block under a polynomial of V that is at most 1 on [0, e[-1]] and grows beyond. vq: V q, which is known already.

    The degree is lowered where the greatest eigenvalue would outgrow the last wanted one by more than twelve digits.
    """
    half = max(e[-1], 1e-14 * e[0]) / 2
    grown = lambda m, v: np.exp(m * (np.arccosh(max((v - half) / half, 1.0)) - np.arccosh((e[0] - half) / half)))
    degree = max([m for m in range(2, DEGREE + 1) if grown(m, e[wanted - 1]) > 1e-12], default=1)
    first = sigma = half / (e[0] - half)
    before, now = q, (vq - half * q) * (sigma / half)
    for _ in range(degree - 1):
        after = 1 / (2 / first - sigma)
        before, now = now, (times(now) - half * now) * (2 * after / half) - (sigma * after) * before
        sigma = after
    return now


def leading(df: DataFrame, centre: Centre, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The greatest eigenvalues of the covariance, falling, and their unit vectors as columns: `wanted`, or fewer of lower rank.

    df: rows of x. The block has half as many columns again, sixteen at least, and never more than there are dimensions.
    """
    d = len(centre.sums)
    wanted = min(wanted, d)
    block = min(d, wanted + max(16, wanted // 2))

    def times(q: np.ndarray) -> np.ndarray:
        def gram(x: np.ndarray) -> np.ndarray:
            c = centre.of(x)
            return c.T @ (c @ q)

        return _gathered(df, gram) / centre.n

    q = np.linalg.qr(np.random.default_rng(7).standard_normal((d, block)))[0]
    vq, last = times(q), np.inf
    for _ in range(ROUNDS):
        h = q.T @ vq
        e, u = np.linalg.eigh((h + h.T) / 2)
        e, u = e[::-1], u[:, ::-1]
        q, vq = q @ u, vq @ u
        rank = int((e[:wanted] > d * np.finfo(float).eps * max(e[0], 0)).sum())
        worst = float(np.linalg.norm(vq - q * e, axis=0)[:wanted].max())
        settled = worst <= TOLERANCE * e[0] or worst <= LOOSEST * e[0] and worst > last / 2
        if block == d or settled or e[0] <= 0:
            return e[:rank], q[:, :rank]
        last = worst
        q = np.linalg.qr(_filtered(times, q, vq, e, wanted))[0]
        vq = times(q)
    raise ArithmeticError(f"eigenvectors not certified after {ROUNDS} rounds: residual {worst / e[0]:.1e} of the greatest eigenvalue")


def whiten(df: DataFrame, vector: str = "embedding", key: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error): a row for every kept vector and component.

    Dropped: vectors that are null, empty, hold null, non-finite or huge entries (2**45 and more), or are not of the commonest
    length. All others are fitted and returned, repeated ones and repeated ids too, ids may be null. Components without variance
    (an eigenvalue at rounding level, as of constant dimensions or of fewer rows than components) have no row; a table that is
    empty, or of equal vectors, gives none. deviation is null beyond 64 bits. Other columns are not read.
    """
    spark = df.sparkSession
    x = quantized(df, vector, key)
    n, sums = totals(x)
    made = spark.createDataFrame([], "component int, n long, deviation long, whitened double, explained double, identity_error double").schema
    schema = type(made)([x.schema[key], *made.fields])
    if not n:
        return spark.createDataFrame([], schema)
    centre = Centre(n, tuple(sums))
    e, q = leading(x, centre, components)
    if not len(e):
        return spark.createDataFrame([], schema)
    weights = q / np.sqrt(e)

    def moments(block: np.ndarray) -> np.ndarray:
        c = centre.of(block)
        w = np.column_stack([c @ weights, np.ones(len(c)), (c * c).sum(axis=1)])
        return w.T @ w[:, :-1]

    k = len(e)
    sums_of = _gathered(x, moments) / n
    mean, trace = sums_of[k, :k], float(sums_of[k + 1, k])
    error = float(np.abs(sums_of[:k, :k] - np.outer(mean, mean) - np.eye(k)).max())
    explained = e / trace

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            m = _matrix(batch.column(1))
            at = np.repeat(np.arange(len(m)), k)
            own = pa.array(centre.deviations(m), pa.int64()).take(pa.array(at))
            tiled = lambda v, t: pa.array(np.tile(v, len(m)), t)  # noqa: E731, B023
            columns = [batch.column(0).take(pa.array(at)), tiled(np.arange(1, k + 1), pa.int32()), pa.array(np.full(len(at), n, np.int64)), own]
            columns += [pa.array((centre.of(m) @ weights).ravel()), tiled(explained, pa.float64()), pa.array(np.full(len(at), error))]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return x.select(key, "x").mapInArrow(rows, schema)

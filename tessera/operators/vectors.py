"""Feature vectors: paired differences, means, cosines and linear probes."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from .scoring import id_set_digest, share
from .spread import saved, spread_join

DOUBLES = ArrayType(DoubleType())


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def pair_directions(features: DataFrame, keys: Sequence[str], direction: str = "direction", vec: str = "vec", gold: str = "gold") -> DataFrame:
    """(keys, diff): up less down of each pair. One grouping in place of a self-join; unpaired keys and wrong labels raise."""
    up, down = F.col(direction) == "up", F.col(direction) == "down"
    g = features.groupBy(*keys).agg(
        F.sum(up.cast("int")).alias("n_up"), F.sum(down.cast("int")).alias("n_down"), F.max(F.when(up, F.col(vec))).alias("u"), F.max(F.when(down, F.col(vec))).alias("d"),
        F.min((F.col(gold) == up.cast("int")).cast("int")).alias("right"),
    )
    fine = (F.col("n_up") == 1) & (F.col("n_down") == 1) & (F.col("right") == 1)
    diff = F.zip_with("u", "d", lambda a, b: a.cast("double") - b.cast("double"))
    return g.select(*keys, F.when(fine, diff).otherwise(F.raise_error(F.lit("a pair is incomplete or mislabelled")).cast(DOUBLES)).alias("diff"))


def vector_mean(df: DataFrame, by: Sequence[str], vec: str) -> DataFrame:
    """(by, vec, n): element-wise means. Sums within Arrow batches leave a row per group and batch; only these are exploded."""
    schema = type(df.schema)([df.schema[b] for b in by]).add("s", DOUBLES).add("k", "long")

    def partial(batches):
        for pdf in batches:
            out = [(*(key if isinstance(key, tuple) else (key,)), np.sum(np.stack(g[vec].to_list()).astype(np.float64), axis=0), len(g)) for key, g in pdf.groupby(list(by), dropna=False)]
            yield pd.DataFrame(out, columns=[*by, "s", "k"])

    sums = df.select(*by, vec).mapInPandas(partial, schema)
    total = sums.select(*by, "k", F.posexplode("s").alias("i", "x")).groupBy(*by, "i").agg((F.sum("x") / F.sum("k")).alias("m"), F.sum("k").alias("n"))
    ordered = F.array_sort(F.collect_list(F.struct("i", "m")))
    return total.groupBy(*by).agg(F.transform(ordered, lambda x: x["m"]).alias("vec"), F.max("n").alias("n"))


def source_directions(pairs: DataFrame, by: Sequence[str], source: str, expected: int | None = None) -> DataFrame:
    """(by, vec): mean difference per source first, then the equal mean over sources; with `expected`, sources of fewer pairs raise."""
    per = vector_mean(pairs, [*by, source], "diff")
    if expected is not None:
        per = per.withColumn("vec", F.when(F.col("n") == expected, F.col("vec")).otherwise(F.raise_error(F.lit("a source lacks pairs")).cast(DOUBLES)))
    return vector_mean(per, by, "vec").drop("n")


def cosine_matrix(directions: DataFrame, group: Sequence[str], item: str, vec: str = "vec", base: str | None = None) -> DataFrame:
    """(group, a, b, cosine) for all items within a group; null where a norm is 1e-12 or less. With `base`, a value of the first group column, also the difference to it."""
    norm = lambda v: F.sqrt(dot(v, v))
    left = directions.select(*group, F.col(item).alias("a"), F.col(vec).alias("va"), norm(F.col(vec)).alias("na"))
    right = directions.select(*group, F.col(item).alias("b"), F.col(vec).alias("vb"), norm(F.col(vec)).alias("nb"))
    fine = (F.col("na") > 1e-12) & (F.col("nb") > 1e-12)
    out = left.join(right, list(group)).select(*group, "a", "b", F.when(fine, F.try_divide(dot(F.col("va"), F.col("vb")), F.col("na") * F.col("nb"))).alias("cosine"))
    if base is None:
        return out
    was = out.filter(F.col(group[0]) == base).select(*group[1:], "a", "b", F.col("cosine").alias("base_cosine"))
    return out.join(was, [*group[1:], "a", "b"], "left").withColumn("delta", F.col("cosine") - F.col("base_cosine")).drop("base_cosine")


def alignment_summary(cosines: DataFrame, group: Sequence[str]) -> DataFrame:
    """Mean cosine and mean absolute cosine over unordered pairs of different items."""
    return cosines.filter("a < b").groupBy(*group).agg(F.avg("cosine").alias("mean_cosine"), F.avg(F.abs("cosine")).alias("mean_abs_cosine"), F.count("cosine").alias("n_pairs"))


def check_feature_sets(features: DataFrame, model: str, category: str, clip: str, gold: str, base: object, vec: str = "vec", prompt: str | None = None, source: str | None = None) -> DataFrame:
    """(model, category, same_ids, same_labels, same_shape, finite): every model's set against the base model's.

    prompt adds same_prompts: the prompt of every id as in the base model's set. source adds same_sources: the set of sources as
    in the base model's first category, as all sets should hold the same ones. Sets are compared by digests of ranges of their
    ids (`id_set_digest`), rows without id left out.
    """
    sets = lambda c, name, df=features: id_set_digest(df, [model, category], c).select(model, category, F.col("id_sha256").alias(name))
    with_id = lambda c: F.when(F.col(clip).isNotNull(), F.concat_ws("=", F.col(clip).cast("string"), F.col(c).cast("string")))
    g = features.groupBy(model, category).agg(F.min(F.size(vec)).alias("lo"), F.max(F.size(vec)).alias("hi"), F.max(F.exists(vec, lambda x: F.isnan(x) | (F.abs(x) == float("inf"))).cast("int")).alias("bad"))
    found = {"same_ids": sets(F.col(clip), "same_ids"), "same_labels": sets(with_id(gold), "same_labels")}
    if prompt:
        found["same_prompts"] = sets(with_id(prompt), "same_prompts")
    for df in found.values():
        g = g.join(df, [model, category], "left")
    b = g.filter(F.col(model) == base).select(category, *[F.col(c).alias(f"base_{c}") for c in [*found, "lo", "hi"]])
    same = lambda c: F.col(c).eqNullSafe(F.col(f"base_{c}"))
    out = g.join(b, category, "left").select(model, category, *[same(c).alias(c) for c in found], (same("lo") & same("hi") & F.col("lo").eqNullSafe(F.col("hi"))).alias("same_shape"), (F.col("bad") == 0).alias("finite"))
    if not source:
        return out
    held = sets(F.col(source), "held", features.select(model, category, source).distinct())
    first = held.filter(F.col(model) == base).agg(F.min_by("held", category).alias("first"))
    told = held.crossJoin(F.broadcast(first)).select(model, category, F.col("held").eqNullSafe(F.col("first")).alias("same_sources"))
    return out.join(told, [model, category], "left").withColumn("same_sources", F.coalesce("same_sources", F.lit(False)))


def standardize(features: DataFrame, by: Sequence[str], vec: str = "vec") -> DataFrame:
    """(by, mean, std): per dimension, population deviation; one below 1e-6 counts as 1."""
    g = features.select(*by, F.posexplode(vec).alias("i", "x")).groupBy(*by, "i").agg(F.avg(F.col("x").cast("double")).alias("m"), F.stddev_pop(F.col("x").cast("double")).alias("s"))
    ordered = F.array_sort(F.collect_list(F.struct("i", "m", "s")))
    g = g.groupBy(*by).agg(ordered.alias("o"))
    return g.select(*by, F.transform("o", lambda x: x["m"]).alias("mean"), F.transform("o", lambda x: F.when(x["s"] < 1e-6, 1.0).otherwise(x["s"])).alias("std"))


#: Bytes of sums that the driver holds at once: fits of so many groups go on side by side, the next ones after them.
FIT_BYTES = 64 << 20
#: Tasks that add up what tasks have added up.
GATHER = 4


def _add_up(df: DataFrame, columns: Sequence[str], part: Callable[[pa.RecordBatch], dict[int, np.ndarray]]) -> dict[int, np.ndarray]:
    """For each group number the sum over all rows of what `part` makes of batches; group -> flat vector.

    A task adds up its own rows. Its sums go to a few tasks, which add them again, so the driver gets a few sums of each group and
    not one from every task.
    """
    schema = "g int, v array<double>"
    told = lambda held: pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array(list(held.values()), pa.list_(pa.float64()))], names=["g", "v"])

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for g, v in part(batch).items():
                held[g] = held[g] + v if g in held else v
        if held:
            yield told(held)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for g, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                v = v.values.to_numpy()
                held[g] = held[g] + v if g in held else v
        if held:
            yield told(held)

    out: dict[int, np.ndarray] = {}
    for r in df.select(*columns).mapInArrow(own, schema).repartition(GATHER).mapInArrow(again, schema).toLocalIterator():
        out[r.g] = out[r.g] + np.array(r.v) if r.g in out else np.array(r.v)
    return out


def _grouped(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(group, vectors, gold) of a batch of g, vec and gold."""
    if batch.num_rows:
        g = batch.column(0).to_numpy()
        x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(float)
        y = batch.column(2).to_numpy(zero_copy_only=False).astype(float)
        for one in np.unique(g):
            at = g == one
            yield int(one), x[at], y[at]


@dataclass
class Fit:
    """One group's fit: weights with the bias last, those that the next pass tries, and the penalised loss of the former."""

    n: float
    mean: np.ndarray
    std: np.ndarray
    weights: np.ndarray
    tried: np.ndarray
    loss: float = np.inf
    done: bool = False

    def step(self, sums: np.ndarray, decay: float, near: float) -> None:
        """Take the tried weights if they lower the loss and go on by Newton's rule; else try half the way."""
        d = len(self.weights)
        loss = sums[0] / self.n + decay / 2 * float(self.tried @ self.tried)
        if loss > self.loss * (1 + 1e-12):
            self.tried = (self.weights + self.tried) / 2
            self.done = float(np.abs(self.tried - self.weights).max()) <= near
            return
        self.weights, self.loss = self.tried, loss
        gradient = sums[1 : d + 1] / self.n + decay * self.weights
        move = np.linalg.solve(sums[d + 1 :].reshape(d, d) / self.n + decay * np.eye(d), gradient)
        self.tried = self.weights - move
        if float(np.abs(move).max()) <= near:
            self.weights, self.done = self.tried, True


def fit_logistic(rows: DataFrame, fits: dict[int, Fit], decay: float, near: float, rounds: int) -> None:
    """Newton steps for all fits side by side until the last one moves by `near` at most. rows: g, vec, gold.

    A pass gives each group's loss, gradient and Gram sums at its tried weights. Groups that are done are left out of the next.
    """
    for _ in range(rounds):
        if not (left := {g: f for g, f in fits.items() if not f.done}):
            return
        at = {g: (f.mean, f.std, f.tried) for g, f in left.items()}

        def part(batch: pa.RecordBatch, at=at) -> dict[int, np.ndarray]:
            out = {}
            for g, x, y in _grouped(batch):
                if g in at:
                    mean, std, w = at[g]
                    z = np.column_stack([(x - mean) / std, np.ones(len(x))])
                    logit = z @ w
                    p = 1 / (1 + np.exp(-np.clip(logit, -700, 700)))
                    loss = float((np.logaddexp(0, logit) - y * logit).sum())
                    out[g] = np.concatenate([[loss], z.T @ (p - y), ((z * (p * (1 - p))[:, None]).T @ z).ravel()])
            return out

        for g, sums in _add_up(rows, ["g", "vec", "gold"], part).items():
            left[g].step(sums, decay, near)
    if any(not f.done for f in fits.values()):
        raise ArithmeticError(f"probes not settled after {rounds} rounds")


def train_probes(features: DataFrame, by: Sequence[str], vec: str = "vec", gold: str = "gold", decay: float = 1e-4, near: float = 1e-6, rounds: int = 200) -> DataFrame:
    """(by, weights, bias, mean, std, n_train, loss): one logistic probe per group on standardised vectors.

    weights: the only minimum of the mean log loss plus decay / 2 times the squared weights and bias, by Newton steps whose sums
    are made where the rows lie; no group comes into one task, and partitions do not matter beyond rounding. The last step moves
    by `near` at most, and the error falls with its square.
    Groups are fitted side by side, as many as FIT_BYTES of sums allow, then the next ones; the driver holds one result for each
    group. Rows without vector or gold, or with non-finite entries, are left out; vectors of a group have one length.
    """
    spark = features.sparkSession
    fine = F.col(vec).isNotNull() & F.col(gold).isNotNull() & (F.size(vec) > 0) & F.forall(vec, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    kept = features.filter(fine).select(*by, F.col(vec).cast("array<double>").alias("__vec"), F.col(gold).cast("int").alias("__gold"))
    groups = kept.groupBy(*by).agg(F.max(F.size("__vec")).alias("__d")).orderBy(*by).collect()
    named = [features.schema[b] for b in by]
    made = spark.createDataFrame([], "weights array<double>, bias double, mean array<double>, std array<double>, n_train long, loss double").schema
    found, start = [], 0
    while start < len(groups):
        size, stop = 0, start
        while stop < len(groups) and (stop == start or size + 8 * (groups[stop]["__d"] + 2) ** 2 <= FIT_BYTES):
            size, stop = size + 8 * (groups[stop]["__d"] + 2) ** 2, stop + 1
        numbers = spark.createDataFrame([(*r[:-1], i) for i, r in enumerate(groups[start:stop], start)], StructType([*named, StructField("__g", IntegerType())]))
        rows = spread_join(kept, numbers, by, F.xxhash64("__vec"))
        rows = saved(rows.select(F.col("__g").alias("g"), F.col("__vec").alias("vec"), F.col("__gold").alias("gold")))
        moments = lambda batch: {g: np.concatenate([[len(x)], x.sum(axis=0)]) for g, x, _ in _grouped(batch)}
        means = {g: (v[0], v[1:] / v[0]) for g, v in _add_up(rows, ["g", "vec", "gold"], moments).items()}
        spreads = _add_up(rows, ["g", "vec", "gold"], lambda batch, means=means: {g: ((x - means[g][1]) ** 2).sum(axis=0) for g, x, _ in _grouped(batch)})
        fits = {}
        for g, (n, mean) in means.items():
            std = np.sqrt(spreads[g] / n)
            zero = np.zeros(len(mean) + 1)
            fits[g] = Fit(n, mean, np.where(std < 1e-6, 1.0, std), zero, zero)
        fit_logistic(rows, fits, decay, near, rounds)
        for g, f in fits.items():
            found.append((*groups[g][:-1], f.weights[:-1].tolist(), float(f.weights[-1]), f.mean.tolist(), f.std.tolist(), int(f.n), float(f.loss)))
        start = stop
    return spark.createDataFrame(found, StructType([*named, *made.fields]))


def score_probes(features: DataFrame, probes: DataFrame, by: Sequence[str], vec: str = "vec", gold: str = "gold") -> DataFrame:
    """Per group accuracy, per-class accuracy (null if absent), balanced accuracy and n; a logit of 0 or more is class 1."""
    scaled = F.zip_with(F.zip_with(vec, "mean", lambda x, m: x.cast("double") - m), "std", lambda x, s: x / s)
    j = features.join(probes, list(by)).withColumn("pred", (dot(scaled, F.col("weights")) + F.col("bias") >= 0).cast("int"))
    right = F.col("pred") == F.col(gold)
    g = j.groupBy(*by).agg(F.count("*").alias("n_test"), share(right).alias("accuracy"), share(right, F.col(gold) == 1).alias("accuracy_up"), share(right, F.col(gold) == 0).alias("accuracy_down"))
    known = F.array_compact(F.array("accuracy_up", "accuracy_down"))
    return g.withColumn("balanced_accuracy", F.coalesce(F.try_divide(F.aggregate(known, F.lit(0.0), lambda a, x: a + x), F.size(known).cast("double")), F.col("accuracy")))


def mean_over_categories(probes: DataFrame, by: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Equal means over categories; nulls are skipped."""
    return probes.groupBy(*by).agg(*[F.avg(v).alias(v) for v in values], F.count("*").alias("n_categories"))

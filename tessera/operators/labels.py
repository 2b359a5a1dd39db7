"""Human labels: accuracy, agreement and progress. Agreement takes the last label of an annotator for an item."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .scoring import n_if, share
from .spread import ordered_places, saved, spread_join


def row_correctness(df: DataFrame, stored: str, answers: Sequence[str], truths: Sequence[str]) -> DataFrame:
    """Adds is_right: the stored flag, else whether the first answer and the first truth present agree; null without both."""
    return df.withColumn("is_right", F.coalesce(F.col(stored), F.coalesce(*answers) == F.coalesce(*truths)))


def validate_items(df: DataFrame, item: str, label: str, labels: Sequence[str], expected: int) -> DataFrame:
    """(violation, n_found): empty ids, duplicate ids, labels outside the domain, a row count other than expected."""
    g = df.groupBy(item).agg(F.count("*").alias("n"), n_if(~F.coalesce(F.col(label).isin(*labels), F.lit(False))).alias("bad"))
    empty = F.col(item).isNull() | (F.col(item).cast("string") == "")
    s = g.agg(
        F.coalesce(F.sum(F.when(empty, F.col("n"))), F.lit(0)).alias("empty_id"), n_if(~empty & (F.col("n") > 1)).alias("duplicate_id"),
        F.coalesce(F.sum("bad"), F.lit(0)).alias("bad_label"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
    )
    s = s.withColumn("wrong_count", F.when(F.col("n") != expected, F.col("n")))
    kinds = F.array(*[F.struct(F.lit(k).alias("violation"), F.col(k).cast("long").alias("n_found")) for k in ("empty_id", "duplicate_id", "bad_label", "wrong_count")])
    return s.select(F.explode(kinds).alias("v")).select("v.*").filter("n_found > 0 or violation = 'wrong_count' and n_found is not null")


def annotation_summary(df: DataFrame, by: Sequence[str], annotator: str, right: str, time: str, replay: str, label: str, up: str, down: str) -> DataFrame:
    """Rows, annotators, accuracy, mean time and replays, and the share of either label."""
    return df.groupBy(*by).agg(
        F.count("*").alias("n_rows"), F.countDistinct(annotator).alias("n_annotators"), share(F.col(right)).alias("accuracy"), F.avg(time).alias("mean_time"),
        F.avg(replay).alias("mean_replay"), share(F.col(label) == up).alias("share_up"), share(F.col(label) == down).alias("share_down"),
    )


def accuracy_matrix(df: DataFrame, row: str, column: str, values: Sequence[str], right: str) -> DataFrame:
    """Accuracy per row and column value; an empty cell is null."""
    return df.groupBy(row).agg(*[share(F.col(right), F.col(column) == v).alias(v) for v in values])


def annotator_summary(df: DataFrame, annotator: str, keys: Sequence[str], right: str, time: str, replay: str) -> DataFrame:
    """(annotator, scope, key): totals, accuracy, mean time and replays overall and by each key, in one pass."""
    filled = df.withColumns({k: F.coalesce(F.col(k).cast("string"), F.lit("unknown")) for k in keys})
    sets = [[F.col(annotator)]] + [[F.col(annotator), F.col(k)] for k in keys]
    g = filled.groupingSets(sets, annotator, *keys).agg(F.count("*").alias("n_rows"), share(F.col(right)).alias("accuracy"), F.avg(time).alias("mean_time"), F.avg(replay).alias("mean_replay"))
    scope = F.coalesce(*[F.when(F.col(k).isNotNull(), F.lit(f"by_{k}")) for k in keys], F.lit("overall"))
    return g.select(annotator, scope.alias("scope"), F.coalesce(*keys, F.lit("all")).alias("key"), "n_rows", "accuracy", "mean_time", "mean_replay")


def last_labels(df: DataFrame, annotator: str, item: str, label: str, order: Sequence[str]) -> DataFrame:
    """One row per annotator and item: the last label in the order given. Combined before the shuffle."""
    return df.groupBy(annotator, item).agg(F.max(F.struct(*order, label)).alias("m")).select(annotator, item, F.col(f"m.{label}").alias(label))


def item_consensus(last: DataFrame, item: str, label: str) -> DataFrame:
    """Per item: labels, the commonest (ties by name) and agreement, the share of equal pairs; 1 for a single label.

    From label counts, so no pair of annotators is formed.
    """
    c = last.groupBy(item, label).agg(F.count("*").alias("c"))
    s = c.groupBy(item).agg(F.sum("c").alias("n_labels"), F.min(F.struct((-F.col("c")).alias("k"), F.col(label).alias("v"))).alias("top"), F.sum(F.col("c") * (F.col("c") - 1)).alias("same"))
    pairs = F.col("n_labels") * (F.col("n_labels") - 1)
    return s.select(item, "n_labels", F.col("top.v").alias("majority"), F.when(pairs == 0, 1.0).otherwise(F.try_divide(F.col("same").cast("double"), pairs)).alias("agreement"))


def pairwise(last: DataFrame, annotator: str, item: str, label: str, positive: str, hot: int = 256, block: int = 512) -> DataFrame:
    """Per two annotators with shared items: n_shared, agreement and kappa from the overlap's marginals.

    Annotators of an item with up to `hot` of them are paired by a join on the item. Larger items go through blocks of
    annotators: see `block_pair_sums`. Both give sums that are added per pair. Kappa is 1 where chance explains all. Labels
    without item or annotator are in no pair; a null label equals none and is not positive.
    """
    named = last.select(F.col(item).alias("i"), F.col(annotator).alias("who"), F.col(label).alias("l"), F.coalesce((F.col(label) == positive).cast("int"), F.lit(0)).alias("p"))
    named = saved(named.filter("i is not null and who is not null"))
    large = saved(named.groupBy("i").agg(F.count("*").alias("n")).filter(F.col("n") > hot).select("i", F.lit(True).alias("large")))
    if large.isEmpty():
        return pair_scores(item_pair_sums(named))
    told = spread_join(named, large, ["i"], F.col("who"), "left")
    blocks = block_pair_sums(saved(told.filter("large").drop("large")), block)
    sums = item_pair_sums(told.filter("large is null").drop("large")).unionByName(blocks)
    return pair_scores(sums.groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in ("n_shared", "same", "pa", "pb")]))


def item_pair_sums(named: DataFrame) -> DataFrame:
    """(a, b, n_shared, same, pa, pb) of any two annotators a < b by a join on the item; named: i, who, l, p."""
    a, b = (named.select("i", F.col("who").alias(x), F.col("l").alias(f"l{x}"), F.col("p").alias(f"p{x}")) for x in "ab")
    both = a.join(b, "i").filter("a < b")
    return both.groupBy("a", "b").agg(F.count("*").alias("n_shared"), n_if(F.col("la") == F.col("lb")).alias("same"), F.sum("pa").alias("pa"), F.sum("pb").alias("pb"))


def block_pair_sums(named: DataFrame, block: int = 512, items: int = 1024) -> DataFrame:
    """The sums of `item_pair_sums` as products of label matrices, so that no pair of annotators is a row for each item.

    Annotators are dealt by hash to blocks of some `block`, items to chunks of some `items`. Every two blocks meet in a task of
    their own for each chunk, as matrices of annotators by items; products of these count what the annotators share. A label
    goes to as many tasks as there are blocks, whatever its item's annotators; an item's pairs spread over all of them.
    """
    many = named.agg(F.approx_count_distinct("who").alias("who"), F.approx_count_distinct("i").alias("i")).first()
    blocks, chunks = max(1, -(-many.who // block)), max(1, -(-many.i // items))
    dealt = named.withColumn("own", F.pmod(F.xxhash64("who", F.lit(17)), F.lit(blocks)).cast("int")).withColumn("chunk", F.pmod(F.xxhash64("i", F.lit(19)), F.lit(chunks)).cast("int"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    met = met.withColumn("first", F.least("own", "other")).withColumn("second", F.greatest("own", "other")).drop("other")
    kind = named.schema["who"].dataType
    schema = StructType().add("x", kind).add("y", kind)
    for c in ("n_shared", "same", "px", "py"):
        schema = schema.add(c, "long")

    def products(pdf: pd.DataFrame) -> pd.DataFrame:
        first, second = pdf["first"].iloc[0], pdf["second"].iloc[0]
        at, _ = pd.factorize(pdf["i"])
        values, _ = pd.factorize(pdf["l"])  # -1: null
        sides = []
        for own in (first, second):
            mine = (pdf["own"] == own).to_numpy()
            rows, names = pd.factorize(pdf["who"][mine])
            sides.append((rows, names, at[mine], values[mine], pdf["p"].to_numpy()[mine]))
        width = int(at.max()) + 1

        def matrix(side, weights):
            m = np.zeros((len(side[1]), width))
            np.add.at(m, (side[0], side[2]), weights)
            return m

        x, y = sides
        if not len(x[1]) or not len(y[1]):
            return pd.DataFrame({f.name: [] for f in schema})
        all_x, all_y = matrix(x, 1.0), matrix(y, 1.0)
        shared = all_x @ all_y.T
        same = sum((matrix(x, x[3] == v) @ matrix(y, y[3] == v).T for v in np.intersect1d(x[3][x[3] >= 0], y[3][y[3] >= 0])), np.zeros(shared.shape))
        px, py = matrix(x, x[4]) @ all_y.T, all_x @ matrix(y, y[4]).T
        r, c = np.nonzero(np.triu(shared, 1) if first == second else shared)
        out = {"x": x[1].take(r), "y": y[1].take(c)} | {k: m[r, c].astype(np.int64) for k, m in (("n_shared", shared), ("same", same), ("px", px), ("py", py))}
        return pd.DataFrame(out)

    found = met.groupBy("first", "second", "chunk").applyInPandas(products, schema)
    ordered = F.col("x") < F.col("y")
    pick = lambda one, two, name: F.when(ordered, F.col(one)).otherwise(F.col(two)).alias(name)
    return found.select(pick("x", "y", "a"), pick("y", "x", "b"), "n_shared", "same", pick("px", "py", "pa"), pick("py", "px", "pb")).filter("a < b")


def pair_scores(sums: DataFrame) -> DataFrame:
    """(a, b, n_shared, agreement, kappa) from sums over shared items: n_shared, same, and the positive labels pa and pb of either."""
    n = F.col("n_shared").cast("double")
    chance = (F.col("pa") * F.col("pb") + (n - F.col("pa")) * (n - F.col("pb"))) / (n * n)
    agreement = F.col("same") / n
    kappa = F.when(chance >= 1.0, 1.0).otherwise(F.try_divide(agreement - chance, 1.0 - chance))
    return sums.select("a", "b", "n_shared", agreement.alias("agreement"), kappa.alias("kappa"))


def mean_of_annotators(df: DataFrame, by: Sequence[str], annotator: str, right: str) -> DataFrame:
    """Accuracy per annotator first, then their equal mean."""
    g = df.groupBy(*by, annotator).agg(share(F.col(right)).alias("acc"))
    return g.groupBy(*by).agg(F.avg("acc").alias("accuracy"), F.count("*").alias("n_annotators"))


def progress(items: DataFrame, done: DataFrame, annotators: DataFrame, annotator: str, item: str, category: str) -> DataFrame:
    """Completed and total items per annotator and category, and whether all are done; annotators without any count too."""
    totals = items.groupBy(category).agg(F.countDistinct(item).alias("n_items"))
    did = done.join(items.select(item, category).distinct(), [item], "left_semi").select(annotator, item).distinct().join(items.select(item, category).distinct(), item)
    counts = did.groupBy(annotator, category).agg(F.count("*").alias("n_done"))
    grid = annotators.select(annotator).distinct().crossJoin(F.broadcast(totals))
    out = grid.join(counts, [annotator, category], "left").withColumn("n_done", F.coalesce("n_done", F.lit(0)).cast("long"))
    return out.withColumn("complete", F.col("n_done") >= F.col("n_items"))


def next_item(who: DataFrame, lists: DataFrame, done: DataFrame, annotator: str, item: str, named: str, order: Sequence[str]) -> DataFrame:
    """The first item of each annotator's list that is not done, in the order given and then by item, nulls last.

    who: annotator, `named` (which list is theirs). lists: `named`, item and the columns of the order; any number of annotators
    share one. done: annotator, item. Who has done the whole list has no row. Items are numbered within their list, and the first
    one left is number 0 or follows a done one: only these are looked at, so no annotator is paired with a list's items.
    """
    own = who.select(annotator, named).filter(F.col(annotator).isNotNull()).distinct()
    by = F.struct(*[x for i, c in enumerate(order) for x in (F.col(c).isNull().alias(f"none{i}"), F.col(c).alias(f"by{i}"))], F.col(item).alias("item"))
    firsts = lists.filter(F.col(named).isNotNull() & F.col(item).isNotNull()).groupBy(named, item).agg(F.min(by).alias("__by"))
    numbered = saved(ordered_places(firsts, ["__by"], "__place", [named]).select(named, item, F.col("__place").cast("long").alias("__place")))
    did = saved(done.select(annotator, item).join(own, annotator).join(numbered, [named, item]).select(annotator, named, "__place"))
    after = own.withColumn("__place", F.lit(0).cast("long")).unionByName(did.withColumn("__place", F.col("__place") + 1))
    left = after.join(did, [annotator, named, "__place"], "left_anti").groupBy(annotator, named).agg(F.min("__place").alias("__place"))
    return left.join(numbered, [named, "__place"]).select(annotator, F.col(item).alias("next_item"))

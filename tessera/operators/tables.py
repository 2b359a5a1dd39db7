"""Comparison tables: pivots, rankings and differences over small results of scoring and labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TIE = 1e-12


def wide(df: DataFrame, row: Sequence[str], column: str, values: Sequence[str], value: str) -> DataFrame:
    """One column per value of `column`; a cell without rows is null."""
    return df.groupBy(*row).agg(*[F.avg(F.when(F.col(column) == v, F.col(value))).alias(str(v)) for v in values])


def equal_mean(cols: Sequence[str]) -> Column:
    """Mean of the columns that are not null."""
    known = F.array_compact(F.array(*[F.col(c) for c in cols]))
    return F.try_divide(F.aggregate(known, F.lit(0.0), lambda a, x: a + x), F.size(known).cast("double"))


def human_model_table(acc: DataFrame, categories: Sequence[str], human: str = "human") -> DataFrame:
    """series, a column per category, their mean, and best_<column> flags of the best models; humans never win, ties all do.

    acc: series, category, accuracy.
    """
    t = wide(acc, ["series"], "category", categories, "accuracy").withColumn("avg", equal_mean(categories))
    w = Window.partitionBy()
    for c in [*categories, "avg"]:
        best = F.max(F.when(F.col("series") != human, F.col(c))).over(w)
        t = t.withColumn(f"best_{c}", F.coalesce((F.col("series") != human) & (F.abs(F.col(c) - best) <= TIE), F.lit(False)))
    return t


def trajectory_table(acc: DataFrame, curves: Sequence[str]) -> DataFrame:
    """Accuracy per series and curve, each the equal mean over categories. acc: series, category, curve, accuracy."""
    return wide(acc.groupBy("series", "category", "curve").agg(F.avg("accuracy").alias("accuracy")), ["series"], "curve", curves, "accuracy")


def tier_table(acc: DataFrame, tiers: Sequence[str]) -> DataFrame:
    """Accuracy by category and series, a column per tier."""
    return wide(acc, ["category", "series"], "tier", tiers, "accuracy")


def domain_table(acc: DataFrame, categories: Sequence[str]) -> DataFrame:
    """Accuracy by source dataset, a column per category, and their mean. acc: dataset, category, accuracy."""
    return wide(acc, ["dataset"], "category", categories, "accuracy").withColumn("avg", equal_mean(categories))


def variant_comparison(acc: DataFrame, variants: Sequence[str]) -> DataFrame:
    """Per (model, variant): mean over categories, difference to the first variant, and wins (categories where it is best, ties all).

    acc: model, category, variant, accuracy.
    """
    best = F.max("accuracy").over(Window.partitionBy("model", "category"))
    win = (F.abs(F.col("accuracy") - best) <= TIE).cast("long")
    g = acc.withColumn("win", win).groupBy("model", "variant").agg(F.avg("accuracy").alias("mean_accuracy"), F.sum("win").alias("wins"))
    base = F.max(F.when(F.col("variant") == variants[0], F.col("mean_accuracy"))).over(Window.partitionBy("model"))
    return g.withColumn("delta", F.col("mean_accuracy") - base)


def variant_extremes(comparison: DataFrame, variants: Sequence[str]) -> DataFrame:
    """Per model the best and the worst variant and the gap; of equal ones the first in order."""
    at = -F.array_position(F.array(*[F.lit(v) for v in variants]), F.col("variant"))
    hi = F.max(F.struct("mean_accuracy", at.alias("at"), "variant"))
    lo = F.max(F.struct((-F.col("mean_accuracy")).alias("low"), at.alias("at"), "variant"))
    g = comparison.groupBy("model").agg(hi.alias("hi"), lo.alias("lo"))
    return g.select("model", F.col("hi.variant").alias("best_variant"), F.col("lo.variant").alias("worst_variant"), (F.col("hi.mean_accuracy") + F.col("lo.low")).alias("gap"))


def largest_shift(acc: DataFrame, base: str) -> DataFrame:
    """Per (model, variant) the category with the largest absolute change to the base variant; the first by name on ties."""
    b = acc.filter(F.col("variant") == base).select("model", "category", F.col("accuracy").alias("was"))
    j = acc.filter(F.col("variant") != base).join(b, ["model", "category"]).withColumn("shift", F.col("accuracy") - F.col("was"))
    w = Window.partitionBy("model", "variant").orderBy(F.desc(F.round(F.abs("shift"), 12)), "category")
    return j.withColumn("r", F.row_number().over(w)).filter("r = 1").select("model", "variant", "category", "shift")


def category_leaders(acc: DataFrame) -> DataFrame:
    """Best model per (category, variant); the least model on ties. Models may be names or numbers; a null accuracy is the worst."""
    m = acc.groupBy("category", "variant").agg(F.min(F.struct(F.col("accuracy").isNull().alias("none"), (-F.round("accuracy", 12)).alias("a"), "model", "accuracy")).alias("m"))
    return m.select("category", "variant", F.col("m.model").alias("model"), F.col("m.accuracy").alias("accuracy"))


def cross_attribute_summary(acc: DataFrame, n_pairs: int) -> DataFrame:
    """Per model: coverage of the grid, means over all, diagonal and other pairs, best and worst pair. acc: model, actual, asked, accuracy."""
    same = F.col("actual") == F.col("asked")
    pair = F.concat_ws("/", "actual", "asked")
    top = F.min(F.struct((-F.round("accuracy", 12)).alias("k"), pair.alias("p")))
    low = F.min(F.struct(F.round("accuracy", 12).alias("k"), pair.alias("p")))
    g = acc.groupBy("model").agg(
        (F.count("accuracy") / n_pairs).alias("coverage"), F.avg("accuracy").alias("mean_all"), F.avg(F.when(same, F.col("accuracy"))).alias("mean_diagonal"),
        F.avg(F.when(~same, F.col("accuracy"))).alias("mean_off"), top.alias("t"), low.alias("l"),
    )
    return g.select("model", "coverage", "mean_all", "mean_diagonal", "mean_off", F.col("t.p").alias("best_pair"), F.col("l.p").alias("worst_pair"))


def cross_attribute_matrix(acc: DataFrame) -> DataFrame:
    """Mean over models per (actual, asked), with the number of models."""
    return acc.groupBy("actual", "asked").agg(F.avg("accuracy").alias("mean_accuracy"), F.count("accuracy").alias("n_models"))


def cross_attribute_coverage(acc: DataFrame, grid: DataFrame) -> DataFrame:
    """(scope, key, n_found, n_possible): how much of a grid (model, actual, asked) has an accuracy, by actual attribute and by model."""
    j = grid.distinct().join(acc.filter("accuracy is not null").select("model", "actual", "asked", F.lit(1).alias("found")).distinct(), ["model", "actual", "asked"], "left")
    count = lambda k: j.groupBy(F.col(k).cast("string").alias("key")).agg(F.count("found").alias("n_found"), F.count("*").alias("n_possible")).select(F.lit(f"by_{k}").alias("scope"), "*")
    return count("actual").union(count("model"))


def cross_attribute_gaps(acc: DataFrame, grid: DataFrame) -> DataFrame:
    """(model, actual, asked) of a grid that have no accuracy."""
    return grid.distinct().join(acc.filter("accuracy is not null"), ["model", "actual", "asked"], "left_anti")


def extreme_pairs(matrix: DataFrame, k: int) -> DataFrame:
    """The k best and the k worst pairs, ties by name; `side` tells which."""
    key = F.round("mean_accuracy", 12)
    top = matrix.orderBy(F.desc(key), "actual", "asked").limit(k).withColumn("side", F.lit("best"))
    return top.unionByName(matrix.orderBy(key, "actual", "asked").limit(k).withColumn("side", F.lit("worst")))


def generalization(records: DataFrame, base: DataFrame) -> DataFrame:
    """Adds in_domain and delta to the base accuracy of the test category. base: test_category, base_accuracy, one row each."""
    j = records.join(base, "test_category", "left")
    return j.withColumns({"in_domain": F.col("train_category") == F.col("test_category"), "delta": F.col("accuracy") - F.col("base_accuracy")})


def generalization_matrix(rows: DataFrame, categories: Sequence[str], value: str = "accuracy") -> DataFrame:
    """Per scope and trained category the mean of a value for each tested category, a column each; an empty cell is null."""
    return rows.groupBy("scope", "train_category").agg(*[F.avg(F.when(F.col("test_category") == c, F.col(value))).alias(c) for c in categories])


def generalization_means(rows: DataFrame) -> DataFrame:
    """(level, scope, train_category, in_domain): mean accuracy and delta at three levels; nulls are skipped."""
    sets = [["scope", "train_category", "in_domain"], ["scope", "in_domain"], ["scope", "train_category"]]
    parts = []
    for keys in sets:
        g = rows.groupBy(*keys).agg(F.avg("accuracy").alias("accuracy"), F.avg("delta").alias("delta"), F.count("*").alias("n"))
        for k, kind in (("train_category", "string"), ("in_domain", "boolean")):
            if k not in keys:
                g = g.withColumn(k, F.lit(None).cast(kind))
        parts.append(g.select(F.lit("+".join(keys)).alias("level"), "scope", F.col("train_category").cast("string"), "in_domain", "accuracy", "delta", "n"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def in_domain_table(rows: DataFrame) -> DataFrame:
    """Diagonal rows with the best (method, category) flagged, and an average row per (method, model). rows: method, model, train_category, test_category, accuracy."""
    d = rows.filter("train_category = test_category").select("method", "model", F.col("test_category").cast("string").alias("category"), "accuracy")
    best = F.max("accuracy").over(Window.partitionBy("method", "category"))
    avg = d.groupBy("method", "model").agg(F.avg("accuracy").alias("accuracy")).withColumn("category", F.lit("average"))
    return d.unionByName(avg).withColumn("best", F.abs(F.col("accuracy") - best) <= TIE)


def stage_comparison(probes: DataFrame) -> DataFrame:
    """Mean per (model, stage) with its number of categories, and the stage's rank inside the model, nulls last. probes: model, category, stage, accuracy."""
    g = probes.groupBy("model", "stage").agg(F.avg("accuracy").alias("mean_accuracy"), F.countDistinct("category").alias("n_categories"))
    return g.withColumn("rank", F.rank().over(Window.partitionBy("model").orderBy(F.desc_nulls_last(F.round("mean_accuracy", 12)))))


def shared_categories(probes: DataFrame) -> DataFrame:
    """Categories that every model has."""
    n = probes.agg(F.countDistinct("model").alias("n"))
    g = probes.groupBy("category").agg(F.countDistinct("model").alias("m"))
    return g.join(F.broadcast(n), g.m == n.n).select("category")


def best_layer(probes: DataFrame) -> DataFrame:
    """Per model the layer with the highest value (the first on ties), that value, and the last layer's. probes: model, layer, value."""
    best = F.max(F.struct(F.round("value", 12).alias("v"), (-F.col("layer")).alias("k"), "layer", "value"))
    last = F.max(F.struct("layer", "value"))
    g = probes.groupBy("model").agg(best.alias("b"), last.alias("l"))
    return g.select("model", F.col("b.layer").alias("best_layer"), F.col("b.value").alias("best_value"), F.col("l.layer").alias("final_layer"), F.col("l.value").alias("final_value"))


def position_layer_table(probes: DataFrame, layers: Sequence[int]) -> DataFrame:
    """Mean over categories per (stream, position), a column per layer. probes: stream, position, layer, category, value."""
    return probes.groupBy("stream", "position").agg(*[F.avg(F.when(F.col("layer") == x, F.col("value"))).alias(f"layer_{x}") for x in layers])

"""Joins and numberings that no frequent key or long group brings into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.folders import work_dir

#: Parts that a key's rows are dealt to in a join.
SALTS = 16


def saved_at(df: DataFrame, to: str | None = None) -> tuple[DataFrame, str]:
    """Written to the shared folder and read back, and where: lineage ends here. With `to`, rows are added to that folder's.

    The files go by `discard`, or when the driver's JVM ends.
    """
    spark = df.sparkSession
    to = to or work_dir(spark, "round")
    df.write.mode("append").parquet(to)
    where = _path(spark, to)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(to), to


def saved(df: DataFrame) -> DataFrame:
    """Written to the shared folder and read back; the files go when the driver's JVM ends."""
    return saved_at(df)[0]


def discard(spark: SparkSession, path: str) -> None:
    """Deletes what `saved_at` wrote; no later plan may read it."""
    _path(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(_path(spark, path), True)


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def matches(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """A join on keys whose nulls are equal; the right side's keys are left out."""
    named = right.withColumnsRenamed({k: f"__right_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"__right_{k}")) for k in keys]
    return left.join(named, on, how).drop(*[f"__right_{k}" for k in keys])


def spread_join(many: DataFrame, few: DataFrame, keys: Sequence[str], by: Column, how: str = "inner", salts: int = SALTS) -> DataFrame:
    """A join in which a key may stand in any share of `many` and in a row or two of `few`; nulls are equal.

    Rows of `many` are dealt to `salts` parts by the column `by`; those of `few` are repeated for each.
    """
    dealt = many.withColumn("__salt", F.pmod(F.xxhash64(by, F.lit(5)), F.lit(salts)).cast("int"))
    repeated = few.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return matches(dealt, repeated, [*keys, "__salt"], how).drop("__salt")


def ordered_places(df: DataFrame, order: Sequence[str], name: str, by: Sequence[str] = ()) -> DataFrame:
    """Adds the place from 0 in an order within each group of `by`, which must not tie: places within ranges of a written table,
    and the rows of the group in the ranges before. A group of any size is cut into ranges like the rest."""
    ranged = saved(df.repartitionByRange(*by, *order).withColumn("__range", F.spark_partition_id()))
    sizes = ranged.groupBy(*by, "__range").agg(F.count("*").alias("__n"))
    earlier = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*by, "__range", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    within = ranged.withColumn("__within", F.row_number().over(Window.partitionBy(*by, "__range").orderBy(*order)) - 1)
    return matches(within, sizes, [*by, "__range"]).withColumn(name, F.col("__within") + F.col("__before")).drop("__range", "__before", "__within")


def least_by_hash(df: DataFrame, by: Sequence[str], hashed: Column, key: str, k: Column | int, crowd: int = 4096, digits: int = 2) -> DataFrame:
    """The first k rows of each group in the order of a hash in hex and then of key; all rows of a smaller group.

    Radix selection: counts by the leading digits of the hash give the digits that the k-th row of a group begins with. Longer
    digits are counted among the rows that begin so, until no group has more than `crowd` of them. Rows below the found digits
    stay, rows above go, both where they are; only those that begin with them are ordered. k: a number, or a column of `by`.
    """
    cut = df.withColumn("__hash", hashed)
    wanted = (F.lit(k) if isinstance(k, int) else k).cast("long")
    bounds, length = None, digits
    while True:
        head = F.substring("__hash", 1, length)
        rows = cut if bounds is None else spread_join(cut, bounds, by, F.col("__hash")).filter(F.substring("__hash", 1, length - digits) == F.col("__bound"))
        need = wanted if bounds is None else F.col("__need")
        n = rows.select(*by, head.alias("__head"), need.alias("__want")).groupBy(*by, "__head", "__want").agg(F.count("*").alias("__n"))
        upto = F.sum("__n").over(Window.partitionBy(*by).orderBy("__head"))
        at = n.withColumn("__upto", upto).filter((F.col("__upto") >= F.col("__want")) & (F.col("__upto") - F.col("__n") < F.col("__want")))
        found = saved(at.select(*by, F.col("__head").alias("__bound"), (F.col("__want") - F.col("__upto") + F.col("__n")).alias("__need"), F.col("__n").alias("__size")))
        crowded = found.agg(F.max("__size").alias("m")).first().m
        bounds = found.drop("__size")
        if crowded is None or crowded <= crowd or length >= 64:
            break
        length += digits
    told = spread_join(cut, bounds, by, F.col("__hash"), "left").withColumn("__head", F.substring("__hash", 1, length))
    whole = F.col("__bound").isNull() & (wanted > 0)
    below = told.filter(whole | (F.col("__head") < F.col("__bound")))
    edge = told.filter(F.col("__head") == F.col("__bound")).withColumn("__at", F.row_number().over(Window.partitionBy(*by).orderBy("__hash", key)))
    edge = edge.filter(F.col("__at") <= F.col("__need")).drop("__at")
    return below.unionByName(edge).drop("__hash", "__head", "__bound", "__need")

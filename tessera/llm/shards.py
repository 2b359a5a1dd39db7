"""Sharding by jump consistent hashing: a key's shard from its 64 bits and the number of shards alone, without a table of rings.

When shards are appended only the share of keys that the new ones take moves, and all of it into them. Slots number a shard's rows
without gaps, in an order that the rows give themselves, so neither partitions nor file order matter.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

SHARDS = 16
#: Parts that equal rows are counted in, and copies that one step unrolls.
COPY_PARTS, COPY_BLOCK = 64, 4096

# Fixed values of the jump consistent hash: its 64-bit linear congruential generator and the bits that it drops.
MULTIPLIER, DROPPED = np.uint64(2862933555777941757), np.uint64(33)


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each key, from 0. keys: uint64. A few rounds over the keys that still jump, some ln(shards) each."""
    if shards < 1:
        raise ValueError("there must be at least one shard")
    key, at = keys.astype(np.uint64), np.zeros(len(keys), np.int64)
    going = np.arange(len(keys))
    while len(going):
        with np.errstate(over="ignore"):
            state = key[going] * MULTIPLIER + np.uint64(1)
        key[going] = state
        leap = ((at[going] + 1) * (float(1 << 31) / ((state >> DROPPED).astype(np.int64) + 1))).astype(np.int64)
        inside = leap < shards
        going = going[inside]
        at[going] = leap[inside]
    return at


def jump_shard(key: Column, shards: int) -> Column:
    """The shard of a 64-bit key. Only the key passes through Arrow; the other columns stay in the JVM. Narrow: no shuffle."""

    @F.pandas_udf("int")
    def run(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(keys.to_numpy(np.int64).view(np.uint64), shards).astype(np.int32))

    return run(key)


def number(df: DataFrame, shard: str, by: Sequence[str], slot: str = "slot") -> DataFrame:
    """Adds `slot`: rows of a shard numbered from 0 without gaps, ordered by a hash of the columns `by` and then by these.

    Rows that agree in all columns are counted first, before the shuffle, in some parts, so no number of repeats makes a group.
    The rest is dealt by the leading bits of the hash to ranges, of which each shard has one to two for each task of a shuffle;
    a range is counted by itself and its first number is the sum of those before it.
    """
    spark = df.sparkSession
    bits = max(4, int(spark.conf.get("spark.sql.shuffle.partitions")).bit_length())
    counted = df.withColumn("__copies", F.spark_partition_id() % COPY_PARTS).groupBy(*df.columns, "__copies").agg(F.count("*").alias("__n"))
    counted = counted.withColumn("__h", F.xxhash64(*by)).withColumn("__part", F.shiftrightunsigned("__h", 64 - bits).cast("int"))
    counted = materialize(counted)
    sizes = counted.groupBy(shard, "__part").agg(F.sum("__n").alias("__of"))
    before = Window.partitionBy(shard).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(shard, "__part", F.coalesce(F.sum("__of").over(before), F.lit(0)).alias("__start"))
    rest = [c for c in df.columns if c not in by]
    within = Window.partitionBy(shard, "__part").orderBy("__h", *by, *rest, "__copies").rowsBetween(Window.unboundedPreceding, -1)
    ranked = counted.withColumn("__own", F.coalesce(F.sum("__n").over(within), F.lit(0))).join(starts, [shard, "__part"])
    copies = ranked.withColumn("__block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1, F.lit(COPY_BLOCK).cast("long"))))
    copies = copies.withColumn("__copy", F.explode(F.sequence(F.col("__block"), F.least(F.col("__block") + COPY_BLOCK, F.col("__n")) - 1)))
    return copies.select(*df.columns, (F.col("__start") + F.col("__own") + F.col("__copy")).alias(slot))


def assign(docs: DataFrame, shards: int = SHARDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, size, text_crc32, law, shard, slot, grown_shard) for every row: law `key`, the id and the number of shards decide.

    grown_shard: the shard with one more. size: bytes of the text plus 1. A null text counts as empty: size 1, crc32 0. Null ids
    hash alike and share a shard. Rows of one id share a shard and have slots of their own; equal rows are interchangeable. An
    empty table gives none. Other columns are not read, so their names do not matter. Texts are not shuffled.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(key), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"))
    hashed = F.xxhash64(key)
    dealt = rows.withColumns({"shard": jump_shard(hashed, shards), "grown_shard": jump_shard(hashed, shards + 1)})
    numbered = number(dealt, "shard", [key, "text_crc32", "size"])
    return numbered.select(key, "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, key: str = "doc_id") -> None:
    """All columns of all rows as Parquet under `path`/shard=N, N by the same law. Each task writes what it holds: no shuffle.

    A target that exists is refused, and so is a column named `shard`, with which the folders would clash.
    """
    if "shard" in docs.columns:
        raise ValueError("the documents have a column named shard")
    docs.withColumn("shard", jump_shard(F.xxhash64(key), shards)).write.mode("errorifexists").partitionBy("shard").parquet(path)

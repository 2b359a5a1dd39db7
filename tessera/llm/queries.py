"""The queries of this subpackage: each applies one operator with production parameters to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, collocations, decontaminate, interleave, langid, licenses, near, pii, ppm, repeats, shards, toxicity, whitening
from .common import bucket


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null texts count as empty and are scored by their end alone; repeated rows and ids stay; an empty table gives none."""
    return ppm.held_out_score(table(spark, sf_dir, "documents"))


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null texts and those without letters are `und` with score 0; repeated rows and ids stay; an empty table gives none."""
    return langid.identify(table(spark, sf_dir, "documents")).withColumn("held_out", bucket("doc_id", 3) == 1)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null, empty and blank texts have no tokens; repeated rows and ids stay; an empty table gives none."""
    return bpe.encode(table(spark, sf_dir, "documents"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null text stays null; texts without values stay as they are; repeated rows stay and agree; the key is the session's."""
    return pii.pseudonymize(table(spark, sf_dir, "documents"), pii.session_key(spark))


def op5_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null texts and those without words are alone in their class; repeated rows are copies; an empty table gives none."""
    return near.near_copies(table(spark, sf_dir, "documents"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and empty texts are clean; repeated rows stay; an empty benchmark contaminates nothing."""
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("matches")


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and empty texts have no words and no notice; repeated rows stay; an empty table gives none."""
    return licenses.scan(table(spark, sf_dir, "documents"), spans=True)


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null, empty and short texts have no passages; rows of one id are one document; an empty table gives none."""
    return repeats.repeated_passages(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and empty texts get the score of a text without a match; repeated rows stay; without labels none is toxic."""
    scored = toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.withColumn("held_out", bucket("doc_id", 3) == 1)


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null counts as empty text, one row of padding; repeated rows stay and agree; an empty table gives none."""
    return interleave.media_of_documents(table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null texts count as empty, null languages as `und`; equal rows all count; an empty table gives none."""
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null vectors and those with null or non-finite entries are dropped; repeated rows and ids stay; an empty table gives none."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null texts count as empty; rows of one id share a shard, each with a slot of its own; an empty table gives none."""
    return shards.assign(table(spark, sf_dir, "documents"))


def media_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ordered sequences of all raw web pages, by the same reader as in op10_media."""
    return interleave.page_sequences(table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0]))) | {"media_pages": media_pages}


#: DuckDB SQL for those that SQL can express over whole tables.
ORACLE_SQL: dict[str, str] = {"op6_decontaminate": decontaminate.SQL, "op11_collocations": collocations.SQL}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)

"""Curation of `documents` in stages; each works on all that the stage before it kept.

Every stage takes the columns of `documents` and any others, whatever their names, and returns them as they were: what is not
id or text rides along in one struct, apart from the columns that an operator makes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, decontaminate, near, pii, toxicity
from tessera.llm.common import discard, released, saved

ROW = "__row"


def _named(columns: list[str]) -> list[Column]:
    """Columns of any name."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in columns]


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id, text and a struct of all columns but the text, under a name that no operator uses."""
    return docs.select("doc_id", "text", F.struct(*_named([c for c in docs.columns if c != "text"])).alias(ROW))


def _unpacked(packed: DataFrame, columns: list[str], **changed) -> DataFrame:
    """The columns as they were, but for those in `changed`."""
    old = {c: F.col("text") if c == "text" else F.col(ROW).getField(c) for c in columns} | changed
    return packed.select(*[old[c].alias(c) for c in columns])


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar, learned from the labels outside the held-out third, does not predict as toxic.

    The prediction is a column beside the row itself, so no join follows. Null and empty texts stay; repeated rows, and rows
    that share an id, are judged each by its own text.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = toxicity.score(_packed(docs), labels, keep=("doc_id", "text", ROW))
    return _unpacked(scored.filter("predicted = 0"), docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the row with the least id; of several with that id the one with the least digest.

    Ids need not be unique: a row is known by its id and a digest of its columns, so of wholly equal rows one stays. Rows
    without id come after all others. Rows without words, null texts too, are classes of their own.
    """
    rest = F.to_json(F.struct(*_named([c for c in docs.columns if c != "text"])))
    own = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), F.xxhash64("text", rest).alias("digest"))
    named = docs.select(own.alias("row_id"), F.struct(*_named(docs.columns)).alias(ROW))
    classes = near.near_copies(named.select(F.col("row_id").alias("doc_id"), F.col(f"{ROW}.text").alias("text")))
    kept = classes.filter("doc_id = class_id").select(F.col("doc_id").alias("row_id")).groupBy("row_id").agg(F.count("*").alias("times"))
    met = named.join(kept, "row_id")
    once, again = met.filter("times = 1"), met.filter("times > 1").groupBy("row_id").agg(F.first(ROW).alias(ROW))
    return once.select(f"{ROW}.*").unionByName(again.select(f"{ROW}.*"))


def reject_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less than a twentieth of whose words lie in benchmark windows.

    Null and empty texts stay; repeated rows, and rows that share an id, are judged each by its own text.
    """
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    judged = decontaminate.contamination(_packed(docs), items, keep=("doc_id", "text", ROW))
    return _unpacked(judged.filter("not contaminated"), docs.columns)


def mask_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with pseudonyms in place of personal values; n_chars follows the new text.

    Null and empty texts stay as they are, n_chars of a null text too; equal texts stay equal. The key is that of the session.
    """
    masked = pii.pseudonymize(_packed(docs), pii.session_key(spark), keep=("doc_id", ROW))
    changed = {}
    if "n_chars" in docs.columns:
        old = F.col(ROW).getField("n_chars")
        changed["n_chars"] = F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), old)
    return _unpacked(masked, docs.columns, **changed)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the counts and digests of their tokens in n_tokens, ids_sha256 and decoded_sha256.

    A column of one of these names in `docs` gives way to the result. Null and empty texts have no tokens.
    """
    made = ("n_tokens", "ids_sha256", "decoded_sha256")
    encoded = bpe.encode(_packed(docs), keep=("doc_id", "text", ROW))
    old = {c: F.col("text") if c == "text" else F.col(ROW).getField(c) for c in docs.columns if c not in made}
    return encoded.select(*[v.alias(c) for c, v in old.items()], *made)


STAGES = [
    ("toxicity", reject_toxic),
    ("near_copies", drop_near_copies),
    ("decontamination", reject_contaminated),
    ("pseudonyms", mask_private),
    ("bpe", encode),
]

#: No SQL expresses the stages; tests/llm/test_pipeline.py holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what a stage returns is written and read again as the next one's input.

    The files of a stage are deleted once its successor's are written. An empty table gives an empty one.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for _, stage in STAGES:
        with released(spark) as files:
            docs, path = saved(stage(spark, docs, sf_dir))
            files.discard(path)
        discard(spark, before)
        before = [path]
    return docs

"""What several operators of this subpackage share."""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python helper takes at once.
BLOCK_BYTES = 6 << 20
#: Rows of an Arrow batch from the JVM; whole texts ride in it, so it stays small.
ARROW_ROWS = 1000

#: Tasks that the rows of one frequent key are dealt to in a join, at least.
SALTS = 16

#: A-Z to lower case; every ASCII byte that is neither digit nor letter to a space; bytes over 127 stay.
WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z lower-cased, as UTF-8; null has none."""
    return text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split() if text else []


def bucket(column: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def scratch(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir. On one machine, as in tests, it may be unset: a folder of our own.

    Elsewhere executors would write where nobody else reads, so an unset folder is an error there.
    """
    if path := spark.conf.get("spark.checkpoint.dir", None):
        return path
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if path := getattr(spark, "_tessera_scratch", None):
        return path
    spark._tessera_scratch = tempfile.mkdtemp(prefix="tessera-")
    return spark._tessera_scratch


#: The paths written within each open released(), innermost last.
_OPEN: list[set[str]] = []


def _file_system(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def saved(df: DataFrame) -> tuple[DataFrame, str]:
    """Cut lineage: write to the shared folder and read back; also where. The files go when the driver's JVM ends."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if _OPEN:
        _OPEN[-1].add(path)
    files, where = _file_system(spark, path)
    files.deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path), path


def materialize(df: DataFrame) -> DataFrame:
    return saved(df)[0]


def discard(spark: SparkSession, paths: Iterable[str]) -> None:
    """Delete what saved() wrote, once nothing reads it any more."""
    for path in paths:
        files, where = _file_system(spark, path)
        files.delete(where, True)


@contextmanager
def released(spark: SparkSession):
    """Whatever is saved within is deleted at the end, but for the paths that are taken out of the set."""
    own: set[str] = set()
    _OPEN.append(own)
    try:
        yield own
    finally:
        _OPEN.remove(own)
        discard(spark, own)


def salted_join(many: DataFrame, few: DataFrame, on: Sequence[str], by: str, how: str = "inner", salts: int = SALTS) -> DataFrame:
    """An equi-join in which a key may stand in very many rows of `many`, but in few of `few`.

    Rows of `many` are dealt into `salts` parts by the column `by`, and those of `few` repeated for each, so that a key's rows
    meet in as many tasks; skewed parts are split further by Spark's own handling of skewed joins.
    """
    dealt = many.withColumn("__salt", F.pmod(F.xxhash64(by, F.lit(99)), F.lit(salts)).cast("int"))
    repeated = few.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(repeated, [*on, "__salt"], how).drop("__salt")


def blocks(batches: Iterator[pa.RecordBatch], text: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about `limit` bytes of text, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
        start = held = 0
        for i, n in enumerate(sizes):
            if i > start and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        yield batch.slice(start)


def map_texts(
    df: DataFrame,
    make: Callable[[], Callable[[list[str | None]], dict[str, Sequence]]],
    schema: str,
    keep: Sequence[str] = ("doc_id",),
    text: str = "text",
    limit: int = BLOCK_BYTES,
) -> DataFrame:
    """Columns `keep` and those of `schema`, which the function that `make` returns derives from whole texts.

    Narrow: no shuffle, texts go through Arrow in blocks of `limit` bytes. `make` runs once a task. Other columns of the
    input are not read; a kept column that is also in `schema` is replaced by the derived one. A kept text travels once.
    """
    spark = df.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    made = spark.createDataFrame([], schema).schema
    kept = [k for k in dict.fromkeys(keep) if k not in made.names]
    same = [k for k in kept if k == text and df.schema[k].dataType.simpleString() == "string"]
    source = df.select(*[F.col(k) for k in kept if k not in same], F.col(text).cast("string").alias("__text"))
    fields = [df.select(k).schema[0] for k in kept] + list(made.fields)
    out_schema = type(made)(fields)
    names = made.names

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(out_schema)
        types = [arrow.field(n).type for n in names]
        work = make()
        for block in blocks(batches, "__text", limit):
            got = work(block.column("__text").to_pylist())
            columns = [block.column("__text" if k in same else k).cast(arrow.field(k).type) for k in kept]
            columns += [pa.array(got[n], type=t) for n, t in zip(names, types, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return source.mapInArrow(run, out_schema)


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()

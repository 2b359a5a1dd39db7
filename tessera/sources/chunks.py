"""Large files as ranges of bytes: a data source whose partitions are parts of files, and digests made from them.

A file of any size is read by as many tasks as it has ranges. Files are listed by Spark's own file systems on the driver; tasks
open them through Arrow's, which know local and mounted paths, HDFS, S3, GCS and Azure. Another scheme is an error that names it.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from .folders import arrow_files

#: Bytes of a chunk, which is one row, and of a range, which is one partition.
CHUNK, RANGE = 8 << 20, 128 << 20
#: Digests that one node of the tree joins.
FAN = 4096


def listed(spark: SparkSession, paths: str | Sequence[str]) -> list[tuple[str, int]]:
    """(path, bytes) of all files that the paths, which may hold wildcards or name folders, stand for."""
    hadoop, out = spark.sparkContext._jvm.org.apache.hadoop.fs, []
    for path in [paths] if isinstance(paths, str) else paths:
        where = hadoop.Path(path)
        files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        found = files.globStatus(where)
        if not found:
            raise FileNotFoundError(path)
        for status in found:
            each = files.listFiles(status.getPath(), True)
            while each.hasNext():
                one = each.next()
                if not one.getPath().getName().startswith(("_", ".")):
                    out.append((one.getPath().toString(), one.getLen()))
    return out


class Bytes(InputPartition):
    def __init__(self, path: str, start: int, stop: int) -> None:
        super().__init__(path)
        self.path, self.start, self.stop = path, start, stop


class ByteRangeReader(DataSourceReader):
    def __init__(self, files: list[tuple[str, int]], chunk: int, size: int, digest: bool) -> None:
        self.files, self.chunk, self.digest = files, chunk, digest
        self.step = max(1, size // chunk) * chunk

    def partitions(self) -> Sequence[InputPartition]:
        return [Bytes(path, at, min(n, at + self.step)) for path, n in self.files for at in range(0, max(n, 1), self.step)]

    def read(self, partition: Bytes) -> Iterator[tuple]:
        files, path = arrow_files(partition.path)
        with files.open_input_file(path) as f:
            for at in range(partition.start, partition.stop, self.chunk):
                data = f.read_at(min(self.chunk, partition.stop - at), at)
                if len(data) != min(self.chunk, partition.stop - at):
                    raise ValueError(f"{uri} has changed while it was read")
                told = hashlib.sha256(data).hexdigest() if self.digest else data
                yield partition.path, at // self.chunk, len(data), told


class ByteRanges(DataSource):
    """Options: files (a list of path and bytes as JSON), chunk and range (bytes), digest (SHA-256 of a chunk in place of it)."""

    @classmethod
    def name(cls) -> str:
        return "byte_ranges"

    def schema(self) -> str:
        return f"path string, chunk long, size long, {'sha256 string' if self.options.get('digest') == 'true' else 'content binary'}"

    def reader(self, schema: StructType) -> DataSourceReader:
        files = [(path, n) for path, n in json.loads(self.options["files"])]
        return ByteRangeReader(files, int(self.options["chunk"]), int(self.options["range"]), self.options.get("digest") == "true")


def read_chunks(spark: SparkSession, paths: str | Sequence[str], chunk: int = CHUNK, size: int = RANGE, digest: bool = False) -> DataFrame:
    """(path, chunk, size, content or sha256): every file in chunks, numbered from 0, `size` bytes of it to a task.

    An empty file has no chunk. With `digest` no content leaves the task that reads it.
    """
    spark.dataSource.register(ByteRanges)
    options = {"files": json.dumps(listed(spark, paths)), "chunk": str(chunk), "range": str(size), "digest": str(digest).lower()}
    return spark.read.format("byte_ranges").options(**options).load()


def tree_digests(spark: SparkSession, paths: str | Sequence[str], chunk: int = CHUNK, size: int = RANGE) -> DataFrame:
    """(path, size, n_chunks, sha256): a digest of every file that many tasks make together.

    The SHA-256 of each chunk; of each FAN of these in their order, joined by newlines; and of what these give, in the same way.
    It depends on `chunk`, not on how the chunks were dealt. An empty file has the digest of no line.
    """
    joined = lambda c: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(c, "sha256"))), lambda x: x["sha256"]), "\n"), 256).alias("sha256")
    leaves = read_chunks(spark, paths, chunk, size, digest=True)
    nodes = leaves.groupBy("path", F.floor(F.col("chunk") / FAN).alias("node")).agg(joined("chunk"), F.sum("size").alias("size"), F.count("*").alias("n_chunks"))
    tops = nodes.groupBy("path").agg(joined("node"), F.sum("size").alias("size"), F.sum("n_chunks").alias("n_chunks"))
    files = spark.createDataFrame([(p,) for p, _ in listed(spark, paths)], "path string")
    none = hashlib.sha256(b"").hexdigest()
    return files.join(tops, "path", "left").select("path", F.coalesce("size", F.lit(0)).alias("size"), F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), F.coalesce("sha256", F.lit(none)).alias("sha256"))


def compare_digests(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """(path, status): found files (path, sha256) against a manifest of the same columns.

    `same`, `changed`, `unrecorded` (the manifest names no digest), `unlisted` (not in the manifest) or `missing` (only there).
    Paths of either side are unique.
    """
    j = found.select("path", F.col("sha256").alias("now"), F.lit(True).alias("here")).join(manifest.select("path", F.col("sha256").alias("then"), F.lit(True).alias("known")), "path", "full")
    status = F.when(F.col("here").isNull(), "missing").when(F.col("known").isNull(), "unlisted").when(F.coalesce(F.col("then"), F.lit("")) == "", "unrecorded")
    return j.select("path", status.when(F.col("now") == F.lower("then"), "same").otherwise("changed").alias("status"))

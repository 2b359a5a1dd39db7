"""Readers and writers of predictions, manifests, waveforms and features. Schemas are given, never inferred."""

from __future__ import annotations

import hashlib
import io
import uuid
import wave
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

from ..functions import dsp
from ..operators.scoring import n_if
from .folders import arrow_files, work_dir  # noqa: F401


#: Bytes of a file that a task holds to add them to its digest.
PIECE = 8 << 20
#: White space and control characters at the ends of a CSV field, which Spark's writer cuts off by default.
AS_IT_IS = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
#: What the reader puts for a field without quotes and text, to tell it from an empty text; no file says it.
ABSENT = "absent-6c1e5f0b2f7d4a5e9a83d1c4b7e60f92"


def path_part(at: int, path: Column | None = None) -> Column:
    """The at-th directory name from the end of a file's path; 1 is its own folder."""
    return F.try_element_at(F.split(F.input_file_name() if path is None else path, "/"), F.lit(-1 - at))


def read_predictions(spark: SparkSession, paths: str | Sequence[str], schema: StructType | str, category_at: int | None = None, model_at: int | None = None, array: bool = False) -> DataFrame:
    """Prediction rows of JSON lines (blank ones dropped) or, with `array`, of files that hold one JSON array.

    category_at, model_at: which folder, counted from the file upward, names them; given ones are added as path_category
    and path_model.
    """
    df = spark.read.schema(schema).json(paths, multiLine=array)
    added = {"path_category": category_at, "path_model": model_at}
    return df.withColumns({k: path_part(v) for k, v in added.items() if v is not None}) if any(v is not None for v in added.values()) else df


def read_manifest(spark: SparkSession, paths: str | Sequence[str], schema: StructType | str, sep: str = ",", multi_line: bool = True) -> DataFrame:
    """Rows of CSV or TSV files with a header line, which may begin with a byte order mark; file and line serve first-wins rules.

    line: the row's number in its file, from 1, whatever the partitions. Rows are numbered where they are read: within their
    block of the file by the order of the task, after the rows of the blocks before it, which a count of all blocks gives. No
    row is shuffled or sorted for it, and the files are read twice. multi_line: fields may hold line ends, and a file is one
    block; without, large files are split among tasks. A field with nothing between its separators is null, a quoted empty one
    the empty text; white space stays.
    """
    df = spark.read.schema(schema).csv(paths, header=True, sep=sep, multiLine=multi_line, escape='"', charToEscapeQuoteEscaping='"', enforceSchema=True, nullValue=ABSENT, emptyValue="", **AS_IT_IS)
    named = df.select("*", F.input_file_name().alias("file"), F.col("_metadata.file_block_start").alias("__at"), F.monotonically_increasing_id().alias("__row"))
    blocks = named.groupBy("file", "__at").agg(F.count("*").alias("__n"), F.min("__row").alias("__first"))
    earlier = F.sum("__n").over(Window.partitionBy("file").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.withColumn("__shift", F.coalesce(earlier, F.lit(0)) - F.col("__first") + 1).select("file", "__at", "__shift")
    line = (F.col("__row") + F.col("__shift")).cast("long").alias("line")
    return named.join(blocks, ["file", "__at"]).select(*df.columns, "file", line)


def read_speaker_info(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """speaker_id, age, gender, accent, region of a white-space table; header, blank and short lines are left out."""
    parts = F.split(F.trim("value"), r"\s+")
    t = spark.read.text(paths).select(parts.alias("p")).filter((F.size("p") >= 4) & F.try_element_at("p", F.lit(1)).rlike("^[0-9]+$"))
    p = lambda i: F.element_at("p", i)
    region = F.array_join(F.slice("p", 5, F.greatest(F.size("p") - 4, F.lit(0))), " ")
    return t.select(F.format_string("p%03d", p(1).cast("int")).alias("speaker_id"), p(2).cast("int").alias("age"), p(3).alias("gender"), p(4).alias("accent"), region.alias("region"))


def read_waveforms(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """path, rate, channels, duration_sec and samples (mono, -1 to 1) of 8- and 16-bit PCM WAV files; others raise."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    schema = StructType().add("path", "string").add("rate", "integer").add("channels", "integer").add("duration_sec", "double").add("samples", ArrayType(DoubleType()))

    def decode(batches):
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                with wave.open(io.BytesIO(content)) as w:
                    rows.append((path, w.getframerate(), w.getnchannels(), w.getnframes() / w.getframerate(), dsp.from_pcm(w.readframes(w.getnframes()), w.getsampwidth(), w.getnchannels())))
            yield pd.DataFrame(rows, columns=[f.name for f in schema])

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInPandas(decode, schema)


def write_waveforms(df: DataFrame, path: str, rate: int, key: str = "clip_id", samples: str = "samples", width: int = 2) -> int:
    """One mono PCM WAV file per row, `key`.wav in a folder that driver and executors share; the number of rows.

    A file is written beside and then renamed, so a task that runs again leaves the same files. Keys must be safe names. Tasks
    write through Arrow's file systems, as `chunks` reads; a scheme that those do not know raises before any task starts.
    """
    files, folder = arrow_files(path)
    files.create_dir(folder, recursive=True)

    def write(batches):
        files, folder = arrow_files(path)
        for pdf in batches:
            for k, x in zip(pdf[key], pdf[samples], strict=True):
                content = io.BytesIO()
                with wave.open(content, "wb") as w:
                    w.setparams((1, width, rate, 0, "NONE", ""))
                    w.writeframes(dsp.to_pcm(x, width))
                to = f"{folder}/{k}.wav"
                with files.open_output_stream(part := f"{to}.{uuid.uuid4().hex}") as f:
                    f.write(content.getvalue())
                files.move(part, to)
            yield pd.DataFrame({"n": [len(pdf)]})

    return df.select(key, samples).mapInPandas(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n


def encode_waveform(samples: Column | str, width: int = 2) -> Column:
    """PCM bytes of samples of -1 to 1."""

    @F.pandas_udf("binary")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series([dsp.to_pcm(a, width) for a in x])

    return run(samples)


def write_features(df: DataFrame, path: str, partition_by: Sequence[str] = ("model", "category")) -> None:
    write_table(df, path, "parquet", partition_by)


def read_features(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema is not None else spark.read).parquet(path)


def check_features(df: DataFrame, file: Sequence[str], clip: str, layer: str, vec: str = "vec") -> DataFrame:
    """(file, n_rows, not_finite, duplicate_ids, layers): layers as a text, which must be the same for every file."""
    g = df.groupBy(*file, clip, layer).agg(F.count("*").alias("n"), F.max(F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))).cast("int")).alias("bad"))
    return g.groupBy(*file).agg(F.sum("n").alias("n_rows"), F.sum("bad").alias("not_finite"), n_if(F.col("n") > 1).alias("duplicate_ids"), F.array_join(F.array_sort(F.collect_set(F.col(layer).cast("string"))), ",").alias("layers"))


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = ()) -> None:
    """CSV (with header), JSON lines or Parquet; a target that is there raises."""
    w = df.write.mode("errorifexists").partitionBy(*partition_by)
    w.csv(path, header=True, escape='"', **AS_IT_IS) if fmt == "csv" else w.format(fmt).save(path)


def first_root_wins(df: DataFrame, roots: DataFrame, root: str, keys: Sequence[str]) -> DataFrame:
    """Rows of the first root in order for each key. roots, a small table: root, priority."""
    ranked = df.join(F.broadcast(roots), root)
    best = ranked.groupBy(*keys).agg(F.min("priority").alias("__best"))
    return ranked.join(best, list(keys)).filter(F.col("priority") == F.col("__best")).drop("__best", "priority")


def resolve_paths(df: DataFrame, listing: DataFrame, key: str, candidates: str, path: str = "path") -> DataFrame:
    """Per row the first candidate path that the listing has; null without any."""
    c = df.select(key, F.posexplode(candidates).alias("at", path)).join(listing.select(path).distinct(), path, "left_semi")
    best = c.groupBy(key).agg(F.min(F.struct("at", path)).alias("m")).select(key, F.col(f"m.{path}").alias("resolved"))
    return df.join(best, key, "left")


def file_digests(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """path, size and SHA-256 of every file, as recorded elsewhere; Spark lists them and leaves out hidden and empty ones.

    A file is read in pieces by one task, through Arrow's file systems, so it may have any size; see chunks.tree_digests for
    digests that many tasks make of one. Where Arrow does not know a path's scheme, Spark reads the file as one row, 2 GB at most.
    """
    files = spark.read.format("binaryFile").load(paths).select("path", F.col("length").alias("size"))
    if all(map(_arrow_knows, _qualified(spark, [paths] if isinstance(paths, str) else paths))):
        return files.mapInPandas(_hashed, "path string, size long, sha256 string")
    return spark.read.format("binaryFile").load(paths).select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def _qualified(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    """The paths with the scheme that Spark reads them by."""
    named, conf = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration()
    return [(p := named(path)).getFileSystem(conf).makeQualified(p).toString() for path in paths]


def _arrow_knows(path: str) -> bool:
    try:
        return bool(arrow_files(path))
    except ValueError:
        return False


def _hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for path, size in zip(pdf["path"], pdf["size"], strict=True):
            files, at = arrow_files(path)
            digest, read = hashlib.sha256(), 0
            with files.open_input_stream(at, compression=None) as f:
                while piece := f.read(PIECE):
                    digest.update(piece)
                    read += len(piece)
            if read != size:
                raise ValueError(f"{path} has changed while it was read")
            yield pd.DataFrame({"path": [path], "size": [size], "sha256": [digest.hexdigest()]})


def numbered(df: DataFrame, order: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Adds row_no from 1 in the order given, within `by`."""
    return df.withColumn("row_no", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))

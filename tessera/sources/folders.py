"""Where files between two steps go."""

from __future__ import annotations

import re
import tempfile
import uuid
from urllib.parse import quote

from pyspark.sql import SparkSession


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder name in the shared folder of spark.checkpoint.dir. On one machine, as in tests, that may be unset.

    Elsewhere executors would write where the driver does not read, so an unset folder is an error there.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_tessera_work", None)
    if root is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = spark._tessera_work = tempfile.mkdtemp(prefix="tessera-")
    return f"{root}/{name}-{uuid.uuid4().hex}"


def arrow_files(path: str):
    """The Arrow file system of a path or URI, and the path in it: local and mounted paths, HDFS, S3, GCS and Azure.

    What only Spark can open is an error that names it, rather than a folder on the machine that happens to ask.
    """
    from pyarrow import fs

    scheme, _, rest = re.sub(r"^file:/(?!/)", "file:///", path).rpartition("://")
    uri = f"{scheme or 'file'}://{quote(rest, safe='/:@')}"
    try:
        return fs.FileSystem.from_uri(uri)
    except Exception as e:
        raise ValueError(f"tasks cannot open {uri}: {e}") from e

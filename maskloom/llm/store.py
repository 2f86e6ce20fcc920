"""Written intermediates in the folder all executors share, and size-checked broadcasts."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder named by ``spark.checkpoint.dir``.

    A local session without that setting gets a folder of its own; on a cluster it must be set.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        root = sc.getCheckpointDir()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write once, read back: cuts lineage, survives lost executors, gives Spark a known size."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hinted(df: DataFrame, most_rows: int = 1_000_000) -> DataFrame:
    """``df`` (narrow, already written) with a broadcast hint if it has at most ``most_rows`` rows.

    Beyond that bound Spark joins it by shuffle.
    """
    return F.broadcast(df) if df.count() <= most_rows else df


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """Arrow file system and path of a folder, for tasks that write or read files of their own."""
    local = re.match(r"file:/+(.*)", uri)
    return (fs.LocalFileSystem(), "/" + local[1]) if local else fs.FileSystem.from_uri(uri)


def put(files: fs.FileSystem, path: str, write) -> None:
    """Call ``write(stream)`` on a new file that appears under ``path`` only when it is whole.

    A task that runs twice replaces the file by an equal one.
    """
    files.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with files.open_output_stream(part) as stream:
        write(stream)
    try:
        files.move(part, path)
    except OSError:
        if files.get_file_info(path).type != fs.FileType.File:
            raise
        files.delete_file(path)
        files.move(part, path)

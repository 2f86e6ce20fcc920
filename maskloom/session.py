"""Session helpers: lineage cuts that survive the loss of an executor."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and read it back from there.

    The folder is the one the cluster names in ``spark.checkpoint.dir``. Only a local session without
    that setting gets a fresh folder of its own; on a cluster the setting must be there.
    """
    spark = df.sparkSession
    _ensure_folder(spark)
    return df.checkpoint(eager=True)


def _ensure_folder(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.match(r"local(\[|$)", sc.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder for written intermediates, inside the shared checkpoint folder."""
    _ensure_folder(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"

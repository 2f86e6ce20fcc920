"""Tables that change by commits: folders of files, and small commit files that name them.

A folder counts only once a commit names it. Commit files appear whole, under a name that is taken at
most once, through the file system Spark itself uses; so readers see a batch entirely or not at all, and a
batch that runs again finds its name taken.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class _Files:
    """Files of one folder in Spark's own file system."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        sc = spark.sparkContext
        self._path = sc._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(sc._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._path(f"{self.path}/{name}")

    def names(self, folder: str) -> list[str]:
        if not self._fs.exists(self._at(folder)):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._at(folder)))

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._at(name))

    def read(self, name: str) -> dict:
        return json.loads(self.spark.read.text(f"{self.path}/{name}", wholetext=True).first().value)

    def write_once(self, name: str, content: dict) -> bool:
        """False if the name is taken."""
        if self.exists(name):
            return False
        folder, _, leaf = name.rpartition("/")
        part = f"{folder}/_{leaf}.{uuid.uuid4().hex}"
        self._fs.mkdirs(self._at(folder))
        stream = self._fs.create(self._at(part), False)
        stream.write(bytearray(json.dumps(content).encode()))
        stream.close()
        return bool(self._fs.rename(self._at(part), self._at(name)))

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(name), True)


class LiveTable:
    """A table kept as a snapshot and a few deltas, one commit per micro-batch.

    ``merge`` turns any number of deltas into one table of the same columns that says the same
    (an associative merge). Beyond ``most`` folders a batch merges all of them into a snapshot, so a
    reader never opens more. A commit file holds its batch number and the folders that count. The last
    ``keep`` commits stay readable; what they don't name is deleted. There is one writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, merge: Callable[[DataFrame], DataFrame],
                 most: int = 8, keep: int = 2):
        self.spark, self.schema, self.merge, self.most, self.keep = spark, schema, merge, most, keep
        self.files = _Files(spark, path)

    def _last(self) -> dict:
        commits = [n for n in self.files.names("commits") if not n.startswith("_")]
        return self.files.read(f"commits/{commits[-1]}") if commits else {"batch": -1, "folders": []}

    def _load(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.files.path}/{f}" for f in folders])

    def _write(self, df: DataFrame, kind: str, batch: int) -> str:
        name = f"data/{kind}-{batch:012d}-{uuid.uuid4().hex}"
        df.select(*self.schema.names).write.parquet(f"{self.files.path}/{name}")
        return name

    def commit(self, delta: DataFrame, batch: int) -> bool:
        """Add a batch; False, and no effect, if it was added before."""
        last = self._last()
        if batch <= last["batch"]:
            return False
        folders = [*last["folders"], self._write(delta, "delta", batch)]
        if len(folders) > self.most:
            folders = [self._write(self.merge(self._load(folders)), "snapshot", batch)]
        done = self.files.write_once(f"commits/{batch:012d}.json", {"batch": batch, "folders": folders})
        self._clean()
        return done

    def _clean(self) -> None:
        commits = [n for n in self.files.names("commits") if not n.startswith("_")]
        for name in commits[:-self.keep]:
            self.files.delete(f"commits/{name}")
        held = {f for n in commits[-self.keep:] for f in self.files.read(f"commits/{n}")["folders"]}
        for name in self.files.names("data"):
            if f"data/{name}" not in held:
                self.files.delete(f"data/{name}")

    def folders(self) -> list[str]:
        return self._last()["folders"]

    def read(self) -> DataFrame:
        return self.merge(self._load(self.folders()))

    def sink(self, shape: Callable[[DataFrame], DataFrame] = lambda df: df):
        """Function for ``foreachBatch``: each batch's ``shape`` is one delta."""
        def write(df: DataFrame, batch: int) -> None:
            self.commit(shape(df), batch)
        return write


def append_once(rows: DataFrame, path: str, batch_id: str, spread: int = 8) -> bool:
    """Append decisions under a batch id, one folder per day; a job that runs again appends nothing.

    Up to ``spread`` tasks write a day's files. Returns whether this call appended.
    """
    files, folder = _Files(rows.sparkSession, path), f"data/{uuid.uuid4().hex}"
    commit = f"commits/{batch_id}.json"
    if files.exists(commit):
        return False
    salt = F.pmod(F.xxhash64(*rows.columns), F.lit(spread))
    rows.withColumn("day", F.to_date("timestamp")).repartition("day", salt).write.partitionBy("day").parquet(f"{files.path}/{folder}")
    if files.write_once(commit, {"folder": folder}):
        return True
    files.delete(folder)
    return False


def read_appended(spark: SparkSession, path: str) -> DataFrame:
    """All committed decisions, with their ``day``; folders without a commit don't count."""
    commits = f"{path.rstrip('/')}/commits/[!_]*.json"
    folders = [r.folder for r in spark.read.schema("folder string").json(commits).collect()]  # a name per batch
    parts = [spark.read.option("basePath", f"{path.rstrip('/')}/{f}").parquet(f"{path.rstrip('/')}/{f}") for f in folders]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out

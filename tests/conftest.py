import os
import sys
import tempfile

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    s = (SparkSession.builder.master("local[4]").appName("tests")
         .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
         .config("spark.driver.memory", "4g").config("spark.sql.session.timeZone", "UTC")
         .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp")).getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def frame(spark):
    """A pixel table from 2-d lists: frame(m=[[..]], v=[[..]])."""
    def make(scene_id=0, **planes):
        first = next(iter(planes.values()))
        h, w = len(first), len(first[0])
        rows = [(scene_id, h, w, y, x, *(float(p[y][x]) if isinstance(p[y][x], float) else int(p[y][x])
                                         for p in planes.values()))
                for y in range(h) for x in range(w)]
        return spark.createDataFrame(rows, ["scene_id", "h", "w", "y", "x", *planes])
    return make


@pytest.fixture(scope="session")
def plane():
    """Column of one frame back as a 2-d list."""
    def read(df, col):
        rows = df.select("y", "x", col).collect()
        out = [[None] * (1 + max(r["x"] for r in rows)) for _ in range(1 + max(r["y"] for r in rows))]
        for r in rows:
            out[r["y"]][r["x"]] = r[col]
        return out
    return read

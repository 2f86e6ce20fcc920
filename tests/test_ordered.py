import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from maskloom.operators import ordered as O


def data(spark):
    random.seed(3)
    rows = [("hot" if i % 3 else f"k{i % 7}", random.randint(0, 400), i, random.randint(-9, 9)) for i in range(600)]
    return spark.createDataFrame(rows, ["k", "t", "i", "v"])


def test_running_equals_plain_windows(spark):
    d = data(spark)
    w = Window.partitionBy("k").orderBy("t", "i")
    want = d.select("i", F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("s"),
                    F.max("v").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("m"),
                    F.row_number().over(w).alias("r"))
    for width in (1, 37, 1000):
        b = F.floor(F.col("t") / width)
        got = O.running(d, ["k"], b, [F.col("t"), F.col("i")], {"s": F.col("v")}, {"m": F.col("v")})
        got = O.ranked(got, ["k"], b, [F.col("t"), F.col("i")], "r").select("i", "s", "m", "r")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_neighbours_equal_lag_and_lead(spark):
    d = data(spark)
    w = Window.partitionBy("k").orderBy("t", "i")
    for width in (5, 1000):
        b = F.floor(F.col("t") / width)
        for ahead, f in ((False, F.lag), (True, F.lead)):
            got = O.neighbours(d, ["k"], b, [F.col("t"), F.col("i")], {"n": F.col("v")}, ahead)
            want = d.select("i", f("v").over(w).alias("n"))
            key = lambda r: r[0]
            assert sorted(map(tuple, got.select("i", "n").collect()), key=key) == sorted(
                map(tuple, want.collect()), key=key)


def test_null_keys_and_null_order_values_stay(spark):
    d = spark.createDataFrame([("a", 1, 1), ("a", None, 2), (None, 5, 3), (None, None, 4), (None, 2, 5)], "k string, t int, i int")
    for width in (1, 100):
        r = O.ranked(d, ["k"], F.floor(F.col("t") / width), [F.col("t"), F.col("i")], "r", "n").collect()
        assert {x["i"]: (x["r"], x["n"]) for x in r} == {1: (1, 2), 2: (2, 2), 5: (1, 3), 3: (2, 3), 4: (3, 3)}
        n = O.neighbours(d, ["k"], F.floor(F.col("t") / width), [F.col("t"), F.col("i")], {"p": F.col("i")})
        assert {x["i"]: x["p"] for x in n.collect()} == {1: None, 2: 1, 5: None, 3: 5, 4: 3}

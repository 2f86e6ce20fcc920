import datetime as dt
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from maskloom.functions import scalars as X
from maskloom.operators import agreement as A
from maskloom.operators import decisions as L
from maskloom.operators import evaluation as V
from maskloom.operators import statistics as ST
from maskloom.operators.raster import decode_masks
from maskloom.schemas import LOG_FIELDS
from maskloom.sources import scenes as SC
from maskloom.sources import tables as TB

T0 = dt.datetime(2024, 5, 1)


def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def test_equal_times_go_to_the_later_row(spark):
    log = spark.createDataFrame([("s", T0, 1, "a"), ("s", T0, 2, "b"), ("s", T0 - dt.timedelta(1), 3, "c")],
                                ["scene_id", "ts", "log_pos", "route"])
    assert L.latest(log, ["scene_id"]).first()["route"] == "b"


def test_latest_is_a_partial_aggregate(spark):
    log = spark.createDataFrame([("s", T0, 1, "a")], ["scene_id", "ts", "log_pos", "route"])
    plan = L.latest(log, ["scene_id"])._jdf.queryExecution().executedPlan().toString()
    assert "partial_max_by" in plan and "Window" not in plan


def items(spark, rows):
    return spark.createDataFrame(rows, "scene_dir string, n_annotators long")


def test_session_with_one_replicate_is_validation_as_a_whole(spark):
    d = items(spark, [("/r/s1/a", 1), ("/r/s1/b", 2), ("/r/s2/a", 1)])
    m = L.scene_manifest(d, None, 0.0, 0.0, 5)
    assert {r["split"] for r in m.filter("group = 's1'").collect()} == {"val"}
    assert m.select("group", "fold").distinct().count() == 2


def test_eval_scene_drops_the_rest_of_its_session(spark):
    d = items(spark, [("/r/s1/a", 1), ("/r/s1/b", 1), ("/r/s2/a", 1)])
    ev = spark.createDataFrame([("/r/s1/a", "reward")], ["scene_dir", "set"])
    m = {r["scene_dir"]: r["split"] for r in L.scene_manifest(d, ev).collect()}
    assert m == {"/r/s1/a": "val", "/r/s2/a": "train"}
    assert [r["scene_dir"] for r in L.leaked(
        d.withColumn("group", X.parent_name("scene_dir")), ev).collect()] == ["/r/s1/b"]


def test_split_does_not_move_when_rows_are_added(spark):
    a = spark.range(50).select(F.concat(F.lit("s"), "id").alias("k"))
    b = spark.range(500).select(F.concat(F.lit("s"), "id").alias("k"))
    f = X.export_split("k", 0.3)
    want = {r["k"]: r["s"] for r in a.select("k", f.alias("s")).collect()}
    got = {r["k"]: r["s"] for r in b.select("k", f.alias("s")).collect()}
    assert all(got[k] == v for k, v in want.items())


def test_hash_buckets_equal_big_integers(spark):
    import hashlib
    keys = ["", "session 1", "Überlauf", "x" * 200]
    d = spark.createDataFrame([(k,) for k in keys], ["k"]).select(
        "k", X.md5_bucket("k", 10000).alias("m"), X.sha1_bucket("k", 100, "replicate:").alias("s"))
    for r in d.collect():
        assert r["m"] == int(hashlib.md5(r["k"].encode()).hexdigest(), 16) % 10000
        assert r["s"] == int(hashlib.sha1(("replicate:" + r["k"]).encode()).hexdigest(), 16) % 100


def test_log_header_rules(spark):
    d = folder()
    with open(f"{d}/old.csv", "w") as f:
        f.write(",".join(LOG_FIELDS[:20]) + "\n2024-05-01T10:00:00,ann,s1" + "," * 17 + "\n")
    with open(f"{d}/bad.csv", "w") as f:
        f.write("annotator,timestamp\na,b\n")
    row = TB.read_decision_log(spark, [f"{d}/old.csv"]).first()
    assert row["annotator"] == "ann" and row["route"] is None and row["eval_set"] is None
    assert row["timestamp"] == dt.datetime(2024, 5, 1, 10)
    with pytest.raises(ValueError):
        TB.read_decision_log(spark, [f"{d}/bad.csv"])


def test_log_positions_follow_files_and_lines(spark):
    d = folder()
    for part, rows in (("part-0", 1), ("part-1", 50), ("part-2", 3)):
        with open(f"{d}/{part}.csv", "w") as f:
            f.write(",".join(LOG_FIELDS[:20]) + "\n")
            f.writelines(f"2024-05-01T10:00:00,{part}-{i:02d},s1" + "," * 17 + "\n" for i in range(rows))
    got = [r["annotator"] for r in TB.read_decision_log(spark, [d]).orderBy("log_pos").collect()]
    assert got == sorted(got) and len(got) == 54


def test_log_split_into_many_ranges_is_the_same_log(spark):
    """Quoted line ends, doubled quotes and commas, split at places of any kind."""
    import csv
    import random
    random.seed(4)
    d = folder()
    want = []
    for part in ("a.csv", "b.csv"):
        with open(f"{d}/{part}", "w", newline="") as f:
            w = csv.writer(f, lineterminator="\n" if part == "a.csv" else "\r\n")
            w.writerow(LOG_FIELDS[:20])
            for i in range(300):
                note = "".join(random.choice(['\n', '"', ',', 'ab', '\n\n', ' ', 'x']) for _ in range(random.randint(0, 30)))
                w.writerow(["2024-05-01T10:00:00", f"{part}-{i:03d}", f"s{note}e", *[""] * 17])
                want.append((f"{part}-{i:03d}", f"s{note}e"))
            f.write("\n")
    scene = LOG_FIELDS[2]
    whole = TB.read_decision_log(spark, [d]).select("log_pos", "annotator", scene).orderBy("log_pos").collect()
    assert [(r["annotator"], r[scene]) for r in whole] == want
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1700")
        lines = TB._quoted_records(spark, [d])
        assert spark.read.text(d).rdd.getNumPartitions() >= 16 and lines.count() >= 602
        split = TB.read_decision_log(spark, [d]).select("log_pos", "annotator", scene).orderBy("log_pos").collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert split == whole


def test_scene_in_both_eval_sets_is_an_error(spark):
    d = folder()
    with open(f"{d}/e.csv", "w") as f:
        f.write("set,scene_dir\nreward,/a\ntest,/a\n")
    with pytest.raises(ValueError):
        TB.read_eval_sets(spark, f"{d}/e.csv")


def test_discovery_prefers_the_first_name_and_prunes(spark):
    d = folder()
    for p in ("a/x/color_preserved_5_band.tiff", "a/x/final_5_band.tiff", "a/y/final_5_band.tiff",
              "work/z/final_5_band.tiff", "1/2/3/4/5/6/7/final_5_band.tiff"):
        os.makedirs(os.path.dirname(f"{d}/{p}"), exist_ok=True)
        open(f"{d}/{p}", "w").write("x")
    got = {r["scene_dir"][len(d):]: r["tiff_kind"] for r in SC.discover(SC.inventory(spark, d), d).collect()}
    assert got == {"/a/x": "rgb_native", "/a/y": "bgr_512"}


def test_thermal_frame(spark):
    d = folder()
    vals = list(range(160 * 120))
    open(f"{d}/f.pgm", "w").write("P2\n160 120\n620\n" + " ".join(map(str, vals)))
    t = SC.read_thermal(spark, d)
    assert t.count() == 19200
    assert t.filter("y = 119 and x = 159").first()["v"] == 19199
    open(f"{d}/g.pgm", "w").write("P5\n1 1\n2\n1")
    with pytest.raises(Exception):
        SC.read_thermal(spark, f"{d}/g.pgm").count()


def test_mask_encodings(spark):
    rows = [("a", 0), ("a", 255), ("b", 0), ("b", 1), ("c", 0), ("c", 2), ("c", 255)]
    m = spark.createDataFrame([(1, s, 0, i, c) for i, (s, c) in enumerate(rows)],
                              ["scene_id", "source", "y", "x", "cls"])
    got = sorted((r["source"], r["cls"]) for r in decode_masks(m).collect())
    assert got == [("a", 0), ("a", 1), ("b", 0), ("b", 1), ("c", 0), ("c", 2), ("c", 255)]


def scores(spark, a, b):
    rows = [(0, s, 0, i, v) for s, m in (("a", a), ("b", b)) for i, v in enumerate(m)]
    m = spark.createDataFrame(rows, ["scene_id", "s", "y", "x", "m"])
    return A.with_scores(A.pair_overlap(m, "s")).first()


def test_mask_scores_on_empty_masks(spark):
    r = scores(spark, [0, 0, 0], [0, 0, 0])
    assert (r["iou"], r["dice"], r["kappa"]) == (1.0, 1.0, 1.0)
    r = scores(spark, [1, 0, 0], [0, 0, 0])
    assert (r["iou"], r["dice"]) == (0.0, 0.0)
    assert scores(spark, [1, 1, 0, 0], [0, 1, 1, 0])["iou"] == pytest.approx(1 / 3)


def test_percentile_kinds(spark):
    d = spark.range(100).select(F.lit("b").alias("band"), F.col("id").alias("v"))
    assert ST.exact_percentiles(d, ["band"], "v", {"p": 0.02}).first()["p"] == pytest.approx(1.98)
    h = ST.histogram(d, ["band"], "v")
    assert ST.discrete_percentiles(h, ["band"], {"p": 0.02}).first()["p"] == 1


META = dict(model_id=1, bands="red,green,blue,thermal,nir", classes="background,water", schema="1",
            in_channels="5", num_classes="2", normalization="embedded:meanstd",
            resize_interpolation="area", norm_mean="[1,2,3,4,5]", norm_std="[1,1,1,1,1]",
            norm_p_lo=None, norm_p_hi=None)


def registry(spark, **changes):
    row = {**META, **changes}
    types = ", ".join(f"{k} {'long' if k == 'model_id' else 'string'}" for k in row)
    return spark.createDataFrame([tuple(row.values())], types)


def test_model_metadata(spark):
    assert V.registry_problems(registry(spark)).first()["problems"] == []
    t = V.typed_registry(registry(spark)).first()
    assert t["input_range"] == "raw_0_255" and t["norm_mean"] == [1, 2, 3, 4, 5] and t["in_channels"] == 5
    bad = V.registry_problems(registry(spark, norm_mean="[1,2]", normalization="zscore")).first()["problems"]
    assert bad == ["normalization.unknown"]
    bad = V.registry_problems(registry(spark, norm_mean="[1,2]", resize_interpolation="cubic")).first()["problems"]
    assert bad == ["resize_interpolation.unknown", "norm_mean.count"]


def test_rows_of_one_position_split_by_name(spark):
    rows = [(f"s{i:02}", i // 10) for i in range(40)]
    for order in (rows, rows[::-1], rows[1::2] + rows[::2]):
        d = spark.createDataFrame(order, "scene_dir string, pos long").repartition(3)
        got = {r["scene_dir"] for r in L.positional_split(d, 0.1, block=2).filter("split = 'val'").collect()}
        assert got == {"s36", "s37", "s38", "s39"}

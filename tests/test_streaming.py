import datetime as dt
import random
import tempfile

from pyspark.sql import functions as F

from maskloom.operators.decisions import latest
from maskloom.sources import commits
from maskloom.streaming import views as V

SCHEMA = "log_pos long, ts timestamp_ntz, annotator string, scene_id long, route string, active_seconds double"
T0 = dt.datetime(2024, 1, 1)


def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def rows(n=200):
    random.seed(9)
    return [(i, T0 + dt.timedelta(minutes=random.randint(0, 60)), f"a{i % 3}", i % 11, "auto_edited", float(i)) for i in range(n)]


def feed(spark, parts):
    src, out, cp = folder(), folder(), folder()
    schema = spark.createDataFrame([], SCHEMA).schema
    return src, out, cp, schema, parts


def test_latest_is_the_same_in_any_arrival_order(spark):
    data = rows()
    want = None
    for seed in (1, 2):
        random.seed(seed)
        random.shuffle(data)
        src, out, cp = folder(), folder(), folder()
        for k in range(4):
            spark.createDataFrame(data[k::4], SCHEMA).coalesce(1).write.mode("append").parquet(src)
        s = V.log_stream(spark, src, spark.createDataFrame([], SCHEMA).schema, files_per_batch=1)
        V.run(V.latest_stream(s, ["scene_id"]), out, cp, "update").awaitTermination()
        got = sorted(map(tuple, V.read_latest(spark, out, ["scene_id"]).select("scene_id", "log_pos").collect()))
        batch = sorted(map(tuple, latest(spark.createDataFrame(data, SCHEMA), ["scene_id"]).select("scene_id", "log_pos").collect()))
        assert got == batch
        assert want is None or want == got
        want = got


def test_a_replayed_batch_changes_nothing(spark):
    out = folder()
    write = V._per_batch(out)
    d = spark.createDataFrame(rows(20), SCHEMA)
    write(d, 0)
    write(d, 0)
    assert spark.read.parquet(out).count() == 20


def test_rows_behind_the_watermark_are_counted(spark):
    src, out, cp = folder(), folder(), folder()
    on_time = [(i, T0 + dt.timedelta(days=i), "a", 1, "auto_edited", 1.0) for i in range(5)]
    late = [(99, T0, "a", 1, "auto_edited", 1.0)]
    spark.createDataFrame(on_time, SCHEMA).coalesce(1).write.mode("append").parquet(src)
    s = V.log_stream(spark, src, spark.createDataFrame([], SCHEMA).schema, files_per_batch=1)
    q = V.throughput(s, "1 hour", lateness="1 hour")
    V.run(q, out, cp, "append").awaitTermination()
    spark.createDataFrame(late, SCHEMA).coalesce(1).write.mode("append").parquet(src)
    run = V.run(q, out, cp, "append")
    run.awaitTermination()
    dropped = sum(o.numRowsDroppedByWatermark for p in run.recentProgress for o in p.stateOperators)
    assert dropped == 1
    assert spark.read.parquet(out).agg(F.sum("decisions")).first()[0] == 4


def test_idle_gaps_do_not_count(spark):
    ts = [0, 5, 9, 100, 104]
    e = spark.createDataFrame([(i, 1, "a", T0 + dt.timedelta(seconds=t), "move") for i, t in enumerate(ts)],
                              "pos long, scene_id long, annotator string, ts timestamp_ntz, kind string")
    keys = ["scene_id", "annotator"]
    assert V.active_seconds(e, keys, 12).first()["active_seconds"] == 9 + 12 + 4 + 12
    spells = V.active_sessions(e, keys, "12 seconds", "1 minute").collect()
    assert sum(r["active_seconds"] for r in spells) == 37


def test_review_ends_at_the_first_edit(spark):
    ev = [(0, "edit"), (1, "seed_shown"), (4, "move"), (7, "edit"), (9, "save")]
    assert review_rows(spark, ev, 12) == [6.0]


def test_reviews_count_active_time_and_every_seed(spark):
    ev = [(0, "seed_shown"), (100, "move"), (103, "seed_shown"), (105, "save"), (106, "edit"), (110, "seed_shown"), (130, "edit")]
    assert review_rows(spark, ev, 12) == [12.0 + 3 + 2, 12.0]


REVIEW_SCHEMA = "pos long, scene_id long, annotator string, ts timestamp_ntz, kind string"


def review_rows(spark, ev, idle):
    e = spark.createDataFrame([(i, 1, "a", T0 + dt.timedelta(seconds=t), k) for i, (t, k) in enumerate(ev)], REVIEW_SCHEMA)
    rows = V.review_times(e, ["scene_id", "annotator"], idle, block_s=50).orderBy("start").collect()
    return [r["review_seconds"] for r in rows]


def test_reviews_survive_a_restart(spark):
    """Two runs over one log, with events out of order inside the lateness, give what one pass gives."""
    random.seed(4)
    data = [(i, i % 3, "a", T0 + dt.timedelta(seconds=7 * i + random.randint(0, 40)), random.choice(["seed_shown", "move", "edit", "save"]))
            for i in range(120)]
    end = [(999, 9, "z", T0 + dt.timedelta(hours=2), "move")]
    src, out, cp = folder(), folder(), folder()
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    for part in (data[:60], data[60:] + end):
        spark.createDataFrame(part, REVIEW_SCHEMA).coalesce(1).write.mode("append").parquet(src)
        s = V.log_stream(spark, src, spark.createDataFrame([], REVIEW_SCHEMA).schema, files_per_batch=1)
        V.run(V.review_stream(s, ["scene_id", "annotator"], 30, "2 minutes"), out, cp, "append").awaitTermination()
    spark.conf.set(key, before)
    want = V.review_times(spark.createDataFrame(data, REVIEW_SCHEMA), ["scene_id", "annotator"], 30)
    cols = ["scene_id", "annotator", "start", "review_seconds"]
    got, want = (sorted((r.scene_id, r.annotator, r.start, round(r.review_seconds, 6)) for r in d.select(cols).collect())
                 for d in (spark.read.parquet(out), want))
    assert got == want and len(got) > 10


def table(spark, path, most=3):
    return V.live_latest(spark, path, spark.createDataFrame([], SCHEMA).schema, ["scene_id"], most=most)


def test_live_table_is_compacted_and_replay_safe(spark):
    path, data = folder(), rows(90)
    t = table(spark, path)
    for b in range(9):
        part = spark.createDataFrame(data[b::9], SCHEMA)
        assert t.commit(latest(part, ["scene_id"]), b)
        assert not t.commit(part, b)  # a replay
        assert len(t.folders()) <= 3
    want = latest(spark.createDataFrame(data, SCHEMA), ["scene_id"])
    assert sorted(map(tuple, t.read().select("scene_id", "log_pos").collect())) == sorted(map(tuple, want.select("scene_id", "log_pos").collect()))
    assert len(t.files.names("commits")) <= 2 and len(t.files.names("data")) <= 6
    assert table(spark, folder()).read().count() == 0


def test_a_crash_before_the_commit_leaves_the_table_as_it_was(spark, monkeypatch):
    path, data = folder(), rows(40)
    t = table(spark, path)
    t.commit(spark.createDataFrame(data[:20], SCHEMA), 0)
    before = sorted(t.read().select("log_pos").collect())
    broken = table(spark, path)
    monkeypatch.setattr(broken.files, "write_once", lambda *a: 1 / 0)
    try:
        broken.commit(spark.createDataFrame(data[20:], SCHEMA), 1)
        raise AssertionError
    except ZeroDivisionError:
        pass
    assert sorted(table(spark, path).read().select("log_pos").collect()) == before
    assert len(t.files.names("data")) == 2  # what the crash left
    again = table(spark, path)
    assert again.commit(spark.createDataFrame(data[20:], SCHEMA), 1)
    assert len(again.files.names("data")) == 2
    want = latest(spark.createDataFrame(data, SCHEMA), ["scene_id"])
    assert sorted(again.read().select("log_pos").collect()) == sorted(want.select("log_pos").collect())


def test_a_job_that_runs_twice_appends_once(spark):
    path = folder()
    d = spark.createDataFrame(rows(20), SCHEMA).withColumnRenamed("ts", "timestamp")
    assert commits.append_once(d, path, "job-1") and not commits.append_once(d, path, "job-1")
    assert commits.append_once(d.limit(5), path, "job-2")
    assert commits.read_appended(spark, path).count() == 25


def test_medians_are_exact_for_many_values(spark):
    n = 30_001
    d = spark.range(n).select((F.col("id") * 7919 % n).cast("double").alias("active_seconds"), F.lit("manual").alias("route"),
                              F.lit(T0).cast("timestamp_ntz").alias("ts"))
    assert [tuple(r) for r in V.throughput(d, "1 day").select("decisions", "median_seconds").collect()] == [(n, 15000.0)]
    none = d.limit(3).withColumn("active_seconds", F.lit(None).cast("double"))
    assert V.throughput(none, "1 day").first().median_seconds is None


def test_throughput_sums_a_window_once(spark, capsys):
    """A sum inside the walk over a window's values would be taken again for each of them."""
    rows = [(dt.datetime(2024, 1, 1), "a", v) for v in (3.0, 1.0, 2.0, 2.0, None)] + [(dt.datetime(2024, 1, 2), "a", None)]
    t = V.throughput(spark.createDataFrame(rows, "ts timestamp_ntz, route string, active_seconds double"), "1 day")
    assert [(r["decisions"], r["median_seconds"]) for r in t.orderBy("start").collect()] == [(5, 2.0), (1, None)]
    t.explain("extended")
    plan = capsys.readouterr().out.split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]
    assert plan.count("aggregate(") == 1

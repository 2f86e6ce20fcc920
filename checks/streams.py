"""Streams run to completion over files, and readers and writers run as round trips."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import functions as F

from checks import derived as D
from checks import registry
from checks.log import hashed
from checks.raster import AT
from checks.registry import check
from maskloom.functions.scalars import is_replicate
from maskloom.operators.decisions import latest
from maskloom.operators.evaluation import merge_run_status
from maskloom.operators.ordered import ranked
from maskloom.sources import commits as CM
from maskloom.sources import scenes as SC
from maskloom.sources import tables as TB
from maskloom.session import scratch
from maskloom.streaming import views as V

LOG_COLUMNS = ("log_pos", "ts", "annotator", "scene_id", "route", "active_seconds")


def log_files(spark, sf):
    """The log as six files in an order that is not the log's."""
    log = D.label_log(spark, sf).select(*LOG_COLUMNS)
    path = scratch(spark, "log")
    log.repartition(6, F.col("log_pos") * 31 % 97).write.parquet(path)
    return path, log.schema


def live_twin(name: str):
    """The same result from a live table."""
    def wrap(fn):
        key = name.replace("_stream", "_live")
        registry.QUERIES[key], registry.SQL[key] = fn, registry.SQL[name]
        return fn
    return wrap


def finished(stream, spark, mode, shape=lambda df: df):
    out = scratch(spark, "view")
    q = V.run(stream, out, scratch(spark, "state"), mode, shape)
    q.awaitTermination()
    return out


@check("st1_latest_stream", uses="label_log", sql="""
SELECT scene_id, annotator, log_pos, ts, route, active_seconds FROM label_log QUALIFY row_number() OVER (PARTITION BY scene_id, annotator ORDER BY ts DESC, log_pos DESC) = 1""")
def st1(spark, sf):
    path, schema = log_files(spark, sf)
    s = V.log_stream(spark, path, schema, files_per_batch=2)
    out = finished(V.latest_stream(s, ["scene_id", "annotator"]), spark, "update")
    return V.read_latest(spark, out, ["scene_id", "annotator"])


@live_twin("st1_latest_stream")
def st1_live(spark, sf):
    path, schema = log_files(spark, sf)
    keys = ["scene_id", "annotator"]
    table = V.live_latest(spark, scratch(spark, "live"), schema, keys, most=2)
    s = V.log_stream(spark, path, schema, files_per_batch=1)
    V.live(s, table, scratch(spark, "state"), lambda d: latest(d, keys)).awaitTermination()
    return table.read()


@check("st2_active_seconds", uses="ui_event", sql="""
, g AS (SELECT *, (epoch_us(lead(ts) OVER (PARTITION BY scene_id, annotator ORDER BY ts, pos)) - epoch_us(ts)) / 1e6 AS gap FROM ui_event)
SELECT scene_id, annotator, round(sum(least(coalesce(gap, 1800), 1800)), 4) AS active_seconds, count(*) AS events FROM g GROUP BY 1, 2""")
def st2(spark, sf):
    d = V.active_seconds(D.ui_event(spark, sf), ["scene_id", "annotator"], 1800)
    return d.withColumn("active_seconds", F.round("active_seconds", 4))


SPELLS = """g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) < 1800 * 1000000 THEN 0 ELSE 1 END AS first FROM ui_event WINDOW w AS (PARTITION BY scene_id, annotator ORDER BY ts, pos)),
sp AS (SELECT *, sum(first) OVER (PARTITION BY scene_id, annotator ORDER BY ts, pos) AS spell FROM g)"""


@check("st2_active_sessions_stream", uses="ui_event", sql=f""", {SPELLS},
a AS (SELECT scene_id, annotator, min(ts) AS start, count(*) AS events, (max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6 + 1800 AS active_seconds, max(epoch_us(ts)) + 1800000000 AS stop FROM sp GROUP BY scene_id, annotator, spell)
SELECT scene_id, annotator, sum(events)::BIGINT AS events, round(sum(active_seconds), 2) AS active_seconds FROM a WHERE stop <= (SELECT max(epoch_us(ts)) - 3600000000 FROM ui_event) GROUP BY 1, 2""")
def st2b(spark, sf):
    e = D.ui_event(spark, sf)
    path = scratch(spark, "ui")
    e.repartitionByRange(4, "ts").write.parquet(path)
    s = V.active_sessions(V.log_stream(spark, path, e.schema), ["scene_id", "annotator"], "1800 seconds", "1 hour")
    done = spark.read.parquet(finished(s, spark, "append"))
    return done.groupBy("scene_id", "annotator").agg(
        F.sum("events").alias("events"), F.round(F.sum("active_seconds"), 2).alias("active_seconds"))


REVIEWS = """g AS (SELECT *, coalesce(least((epoch_us(lead(ts) OVER w) - epoch_us(ts)) / 1e6, 1800), 1800)::DOUBLE AS a FROM ui_event WINDOW w AS (PARTITION BY scene_id, annotator ORDER BY ts, pos)),
c AS (SELECT *, sum(a) OVER (PARTITION BY scene_id, annotator ORDER BY ts, pos) - a AS u FROM g),
k AS (SELECT *, kind = 'seed_shown' AS seed, lag(kind = 'seed_shown') OVER (PARTITION BY scene_id, annotator ORDER BY ts, pos) AS before FROM c WHERE kind IN ('seed_shown', 'edit', 'save')),
f AS (SELECT *, lag(seed) OVER w AS opened, lag(u) OVER w AS shown_at FROM k WHERE NOT (seed AND coalesce(before, FALSE)) WINDOW w AS (PARTITION BY scene_id, annotator ORDER BY ts, pos))
SELECT scene_id, annotator, round(sum(u - shown_at), 4) AS review_seconds, count(*) AS reviews FROM f WHERE NOT seed AND opened"""


def reviews(d):
    return d.groupBy("scene_id", "annotator").agg(F.round(F.sum("review_seconds"), 4).alias("review_seconds"), F.count("*").alias("reviews"))


@check("st3_review_seconds", uses="ui_event", sql=f", {REVIEWS} GROUP BY 1, 2")
def st3(spark, sf):
    return reviews(V.review_times(D.ui_event(spark, sf), ["scene_id", "annotator"], 1800))


@check("st3_review_stream", uses="ui_event", sql=f", {REVIEWS} AND epoch_ms(ts) < (SELECT max(epoch_ms(ts)) - 3600000 FROM ui_event) GROUP BY 1, 2")
def st3_stream(spark, sf):
    """The log in six files, in no order; reviews that the watermark has passed."""
    e = D.ui_event(spark, sf)
    path = scratch(spark, "ui")
    e.repartition(6, F.col("pos") * 31 % 97).write.parquet(path)
    with rocksdb(spark):
        s = V.review_stream(V.log_stream(spark, path, e.schema), ["scene_id", "annotator"], 1800, "1 hour")
        return reviews(spark.read.parquet(finished(s, spark, "append")))


@contextmanager
def rocksdb(spark):
    key, name = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(key)
    spark.conf.set(key, name)
    yield
    spark.conf.set(key, before)


@check("st4_run_status_stream", uses="run_event", sql="""
, s AS (SELECT run, list(step ORDER BY pos) AS last_steps FROM (SELECT * FROM run_event WHERE event = 'step' QUALIFY row_number() OVER (PARTITION BY run ORDER BY pos DESC) <= 60) GROUP BY 1)
SELECT run, CASE WHEN count(*) FILTER (WHERE event = 'error') > 0 THEN 'error' ELSE 'stopped' END AS phase, max(miou) FILTER (WHERE event = 'eval') AS best_miou,
  arg_max(msg, pos) FILTER (WHERE event = 'error') AS error, count(*) FILTER (WHERE event = 'eval') AS evals, array_to_string(any_value(last_steps), ',') AS last_steps
FROM run_event LEFT JOIN s USING (run) GROUP BY 1""")
def st4(spark, sf):
    e = D.run_event(spark, sf)
    path = scratch(spark, "runs")
    e.repartition(5, "pos").write.json(path)
    s = V.log_stream(spark, path, e.schema, "json", files_per_batch=2)
    out = finished(s, spark, "append", V.run_partial)
    return V.read_run_status(spark, out).withColumn(
        "last_steps", F.array_join(F.col("last_steps").cast("array<string>"), ","))


@live_twin("st4_run_status_stream")
def st4_live(spark, sf):
    e = D.run_event(spark, sf)
    path = scratch(spark, "runs")
    e.repartition(5, "pos").write.json(path)
    table = V.live_runs(spark, scratch(spark, "live"), V.run_partial(e).schema, most=2)
    V.live(V.log_stream(spark, path, e.schema, "json", files_per_batch=1), table, scratch(spark, "state"), V.run_partial).awaitTermination()
    return merge_run_status(table.read()).withColumn("last_steps", F.array_join(F.col("last_steps").cast("array<string>"), ","))


@check("st5_open_queue_stream", uses="label_log manifest", sql=f"""
, done AS (SELECT scene_id, list_sort(list(DISTINCT annotator)) AS seen FROM label_log GROUP BY 1),
q AS (SELECT m.scene_id, a.annotator, coalesce(seen, []) AS seen, {hashed('sha1', "'replicate:' || m.scene_id", 100)} < 30 AS rep, review_status FROM manifest m LEFT JOIN done USING (scene_id), (SELECT unnest(['ann0', 'ann9']) AS annotator) a)
SELECT scene_id, annotator, len(seen) AS n_labels, CASE WHEN list_contains(seen, annotator) THEN FALSE WHEN rep AND len(seen) < 2 THEN TRUE WHEN len(seen) > 0 THEN FALSE ELSE review_status = 'pending' END AS needs_label,
  rep AND len(seen) > 0 AND NOT list_contains(seen, annotator) AS blind FROM q""")
def st5(spark, sf):
    path, schema = log_files(spark, sf)
    s = V.log_stream(spark, path, schema, files_per_batch=2)
    out = finished(V.labelled_by_stream(s), spark, "update")
    scenes = D.manifest(spark, sf).select("scene_id", "review_status",
                                          is_replicate(F.col("scene_id").cast("string"), 30).alias("replicate"))
    return V.read_open_queue(spark, out, scenes, ["ann0", "ann9"])


@live_twin("st5_open_queue_stream")
def st5_live(spark, sf):
    path, schema = log_files(spark, sf)
    s = V.log_stream(spark, path, schema, files_per_batch=1)
    table = V.live_labelled_by(spark, scratch(spark, "live"), V.labelled_by_stream(s).schema, most=2)
    V.live(s, table, scratch(spark, "state"), V.labelled_by_stream).awaitTermination()
    scenes = D.manifest(spark, sf).select("scene_id", "review_status",
                                          is_replicate(F.col("scene_id").cast("string"), 30).alias("replicate"))
    return V.open_queue(table.read(), scenes, ["ann0", "ann9"])


THROUGHPUT = "SELECT {w} AS start, route, count(*) AS decisions, quantile_disc(active_seconds, 0.5) AS median_seconds FROM label_log GROUP BY 1, 2"


@check("st6_throughput_daily", uses="label_log", sql=THROUGHPUT.format(w="date_trunc('day', ts)::TIMESTAMP"))
def st6(spark, sf):
    return V.throughput(D.label_log(spark, sf), "1 day")


@check("st6_throughput_sliding", uses="label_log", sql="""
, w AS (SELECT *, ts - to_days(k::INT) AS start FROM label_log, (SELECT unnest([0, 1]) AS k))
SELECT start, route, count(*) AS decisions, quantile_disc(active_seconds, 0.5) AS median_seconds FROM w GROUP BY 1, 2""")
def st6b(spark, sf):
    return V.throughput(D.label_log(spark, sf), "2 days", "1 day")


@check("st6_throughput_stream", uses="label_log", sql="""
SELECT date_trunc('day', ts)::TIMESTAMP AS start, route, count(*) AS decisions, quantile_disc(active_seconds, 0.5) AS median_seconds FROM label_log
WHERE ts + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM label_log) GROUP BY 1, 2""")
def st6c(spark, sf):
    path, schema = log_files(spark, sf)
    s = V.throughput(V.log_stream(spark, path, schema), "1 day", lateness="1 hour")
    return spark.read.parquet(finished(s, spark, "append")).drop("batch")


# -- round trips ------------------------------------------------------------------------------------


@check("s3_thermal_frames", uses="px", sql="SELECT scene_id, y, x, th * 2 AS v, 8 AS h, 8 AS w, 620 AS top FROM px")
def s3(spark, sf):
    p = D.px(spark, sf)
    rows = p.groupBy("scene_id").agg(F.sort_array(F.collect_list(F.struct("y", "x", "th"))).alias("c"))
    text = F.concat(F.lit("P2\n# raw counts\n8 8\n620\n"), F.array_join(
        F.transform("c", lambda c: F.coalesce((c["th"] * 2).cast("string"), F.lit("-"))), " "))
    path = scratch(spark, "pgm")
    rows.select("scene_id", text.alias("value")).repartition("scene_id").write.partitionBy("scene_id").text(path)
    d = SC.read_thermal(spark, f"{path}/*/*.txt")
    return d.select(F.regexp_extract("path", "scene_id=([0-9]+)", 1).cast("long").alias("scene_id"),
                    "y", "x", "v", "h", "w", "top")


@check("s4_capture_metadata", sql="""
WITH b AS (SELECT unnest([0, 1]) AS k, unnest(['Blue Channel', 'NIR Band']) AS n)
SELECT 'frame ' || event_id AS timestamp, 'final_5_band.tiff' AS raster, k::INT AS band, n || ' ' || event_type AS name FROM events, b""")
def s4(spark, sf):
    e = D.table(spark, sf, "events")
    doc = F.struct(
        F.concat(F.lit("frame "), F.col("event_id").cast("string")).alias("timestamp"),
        F.create_map(F.lit("final_5_band.tiff"), F.array(
            F.concat(F.lit("Band 1: Blue Channel "), "event_type"), F.concat(F.lit("Band 2: NIR Band "), "event_type")))
        .alias("band_descriptions"))
    path = scratch(spark, "meta")
    e.select(F.to_json(doc).alias("value")).write.text(path)
    return SC.band_descriptions(SC.read_capture_metadata(spark, path, one_per_file=False))


@check("s6_log_read", uses="label_log", sql="""
SELECT annotator, scene_id::VARCHAR AS scene_id, route, round(active_seconds, 1) AS active_seconds, review_seconds, ts AS timestamp, seed_backend,
  row_number() OVER (ORDER BY review_seconds IS NOT NULL, log_pos) AS place FROM label_log""")
def s6(spark, sf):
    """An old log with a short header and a current one, read as one log."""
    log = D.label_log(spark, sf).select(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), "annotator",
        F.col("scene_id").cast("string").alias("scene_id"), "scene_dir", "route", "seed_backend", "review_seconds",
        F.round("active_seconds", 1).alias("active_seconds"), "log_pos")
    full = log.select(*[F.col(c).cast("string") if c in log.columns else F.lit(None).cast("string").alias(c)
                        for c in TB.LOG_FIELDS], "log_pos")
    paths = []
    for cond, n in (("review_seconds is null", 20), ("review_seconds is not null", 25)):
        path = scratch(spark, "csv")
        part = full.filter(cond).repartitionByRange(7, "log_pos").sortWithinPartitions("log_pos").select(*TB.LOG_FIELDS[:n])
        part.write.option("header", True).option("quote", '"').option("escape", '"').csv(path)
        paths.append(path)
    log = TB.read_decision_log(spark, paths)
    place = ranked(log, [], F.expr("log_pos >> 33"), [F.col("log_pos")], "place")  # a file is a block
    return place.select("annotator", "scene_id", "route", "active_seconds", "review_seconds", "timestamp", "seed_backend", "place")


@check("s7_log_append", uses="label_log", sql="SELECT log_pos, ts AS timestamp, route, ts::DATE AS day FROM label_log")
def s7(spark, sf):
    log = D.label_log(spark, sf).withColumnRenamed("ts", "timestamp").select("log_pos", "timestamp", "route")
    path = scratch(spark, "append")
    for half in ("log_pos % 2 = 0", "log_pos % 2 = 1"):
        TB.append_decisions(log.filter(half), path)
    return spark.read.parquet(path)


@check("s7_append_once", uses="label_log", sql="SELECT log_pos, ts AS timestamp, route, ts::DATE AS day FROM label_log")
def s7_once(spark, sf):
    """Two batches, the first of which runs twice."""
    log = D.label_log(spark, sf).withColumnRenamed("ts", "timestamp").select("log_pos", "timestamp", "route")
    path = scratch(spark, "append")
    for batch in (0, 1, 0):
        CM.append_once(log.filter(f"log_pos % 2 = {batch}"), path, f"batch-{batch}")
    return CM.read_appended(spark, path)


@check("s11_json_lines", uses="auto_px", sql="""
SELECT 'scene-' || scene_id AS scene, 'auto' || labeller AS backend, round(avg(m), 4) AS water_frac FROM auto_px GROUP BY 1, 2""")
def s11(spark, sf):
    """Every eleventh line is broken and dropped, then written again whole."""
    r = D.auto_px(spark, sf).groupBy("scene_id", "labeller").agg(F.round(F.avg("m"), 4).alias("water_frac"))
    doc = F.to_json(F.struct(F.concat(F.lit("scene-"), F.col("scene_id").cast("string")).alias("scene"),
                             F.concat(F.lit("auto"), F.col("labeller").cast("string")).alias("backend"), "water_frac"))
    broken = F.when(F.col("scene_id") % 11 == 0, F.concat(F.lit("{"), doc)).otherwise(doc)
    path = scratch(spark, "jsonl")
    r.select(broken.alias("value")).write.text(path)
    r.filter("scene_id % 11 = 0").select(doc.alias("value")).write.mode("append").text(path)
    return TB.read_json_lines(spark, path).select("scene", "backend", "water_frac")


@check("s13_dataset_export", uses="px mask_px scene_dim", sql="""
, it AS (SELECT scene_id, CASE WHEN scene_id % 5 = 0 THEN 'val' ELSE 'train' END AS split FROM scene_dim WHERE scene_id % 3 <> 0)
SELECT split, count(*) AS pixels, sum((cls = 1)::INT)::BIGINT AS water, sum(r)::BIGINT AS red FROM it JOIN (SELECT * FROM mask_px WHERE annotator = 0 AND scene_id % 7 <> 0) m USING (scene_id)
JOIN px USING (scene_id, y, x) GROUP BY 1""")
def s13(spark, sf):
    s = F.col("scene_id")
    items = D.scene_dim(spark, sf).filter("scene_id % 3 <> 0").select(
        "scene_id", F.when(s % 5 == 0, "val").otherwise("train").alias("split"))
    m = D.mask_px(spark, sf).filter("annotator = 0 and scene_id % 7 <> 0").select(*AT, "cls")
    path = scratch(spark, "export")
    TB.export_dataset(items, D.px(spark, sf), m, path)
    img, ann = spark.read.parquet(f"{path}/img_dir"), spark.read.parquet(f"{path}/ann_dir")
    return img.join(ann.drop("split"), AT).groupBy("split").agg(
        F.count("*").alias("pixels"), F.sum("cls").cast("long").alias("water"), F.sum("r").alias("red"))

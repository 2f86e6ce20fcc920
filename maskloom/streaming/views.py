"""Live views of the decision log and of run events.

Every view reads a growing folder of files. Views whose batches merge are live tables: a snapshot and a
few deltas, each committed with its batch id, so a restart after a lost driver or executor repeats no
effect and a reader opens a bounded number of folders. Append-only views write one folder per
micro-batch, overwritten when the batch is replayed.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from maskloom.operators.decisions import is_blind, latest, needs_label
from maskloom.operators.evaluation import merge_run_parts, merge_run_status, run_status_parts
from maskloom.operators.ordered import neighbours, running
from maskloom.sources.commits import LiveTable


def log_stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet",
               files_per_batch: int | None = None) -> DataFrame:
    r = spark.readStream.format(fmt).schema(schema)
    if files_per_batch:
        r = r.option("maxFilesPerTrigger", files_per_batch)
    return r.load(path)


def _per_batch(out: str, shape=lambda df: df):
    def write(df: DataFrame, batch: int) -> None:
        shape(df).write.mode("overwrite").parquet(f"{out}/batch={batch}")
    return write


def run(stream: DataFrame, out: str, checkpoint: str, mode: str, shape=lambda df: df,
        once: bool = True) -> StreamingQuery:
    w = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(
        _per_batch(out, shape))
    return (w.trigger(availableNow=True) if once else w).start()


# -- ST1: latest decision per key -----------------------------------------------------------------


def latest_stream(decisions: DataFrame, keys: list[str], ts: str = "ts", pos: str = "log_pos") -> DataFrame:
    """Running latest decision per key. Order of arrival does not matter, so late rows need no rule."""
    rest = [c for c in decisions.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(F.col(ts), F.col(pos)))
    return decisions.groupBy(*keys).agg(best.alias("_b")).select(*keys, "_b.*")


def read_latest(spark: SparkSession, out: str, keys: list[str], ts: str = "ts", pos: str = "log_pos"
                ) -> DataFrame:
    return latest(spark.read.parquet(out).drop("batch"), keys, ts, pos)


def live(stream: DataFrame, table: LiveTable, checkpoint: str, shape=lambda df: df, once: bool = True) -> StreamingQuery:
    """Run a stateless stream into a live table; what batches say is merged there, not in stream state."""
    w = stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(table.sink(shape))
    return (w.trigger(availableNow=True) if once else w).start()


def live_latest(spark: SparkSession, path: str, schema: T.StructType, keys: list[str], ts: str = "ts", pos: str = "log_pos",
                most: int = 8) -> LiveTable:
    """Latest decision per key as a live table; deltas are the batches' own latest decisions."""
    return LiveTable(spark, path, schema, lambda d: latest(d, keys, ts, pos).select(*schema.names), most)


# -- ST2, ST3: time at work -----------------------------------------------------------------------


def _seconds(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp")) / F.lit(1e6)


def active_sessions(events: DataFrame, keys: list[str], idle: str, lateness: str) -> DataFrame:
    """Spells of activity without an idle gap, with their length; the last event of a spell counts
    ``idle``. Append output: a spell is final once the watermark has passed it."""
    s = events.withColumn("_t", F.col("ts").cast("timestamp")).withWatermark("_t", lateness)
    return s.groupBy(*keys, F.session_window("_t", idle)).agg(F.count("*").alias("events")).select(
        *keys, F.col("session_window.start").alias("start"), "events",
        (_seconds(F.col("session_window.end")) - _seconds(F.col("session_window.start")))
        .alias("active_seconds"))


def active_seconds(events: DataFrame, keys: list[str], idle_s: float, tie: str = "pos",
                   block_s: int = 3600) -> DataFrame:
    """Batch form: each event counts until the next one, at most ``idle_s``. Keys of any size are
    walked in hour blocks."""
    d = _with_activity(events, keys, idle_s, tie, block_s)
    return d.groupBy(*keys).agg(F.sum("_a").alias("active_seconds"), F.count("*").alias("events"))


def _with_activity(events: DataFrame, keys: list[str], idle_s: float, tie: str, block_s: int) -> DataFrame:
    d = events.withColumn("_s", F.unix_micros(F.col("ts").cast("timestamp")))
    d = neighbours(d, keys, F.floor(F.col("_s") / (block_s * 1_000_000)), [F.col("_s"), F.col(tie)],
                   {"_n": F.col("_s")}, ahead=True)
    gap = (F.col("_n") - F.col("_s")) / 1e6
    return d.withColumn("_a", F.least(F.coalesce(gap, F.lit(float(idle_s))), F.lit(float(idle_s))))


def review_times(events: DataFrame, keys: list[str], idle_s: float, tie: str = "pos", block_s: int = 3600) -> DataFrame:
    """Batch form of review times: one row per review, ``keys, start, review_seconds``.

    A review runs from the first seed shown after the last edit or save to the next edit or save, in
    active seconds: each event counts until the next one, at most ``idle_s``.
    """
    d = _with_activity(events, keys, idle_s, tie, block_s)
    block, order = F.floor(F.col("_s") / (block_s * 1_000_000)), [F.col("_s"), F.col(tie)]
    d = running(d, keys, block, order, {"_upto": F.col("_a")}).withColumn("_at", F.col("_upto") - F.col("_a"))
    marks = d.filter(F.col("kind").isin("seed_shown", "edit", "save"))
    seed = F.col("kind") == "seed_shown"
    # Of seeds in a row only the first one counts.
    marks = neighbours(marks, keys, block, order, {"_before": seed})
    marks = marks.filter(~(seed & F.coalesce("_before", F.lit(False))))
    ends = neighbours(marks, keys, block, order, {"_shown": F.when(seed, F.struct(F.col("_at").alias("at"), F.col("_s").alias("us")))})
    return ends.filter(~seed & F.col("_shown").isNotNull()).select(
        *keys, F.timestamp_micros("_shown.us").alias("start"), (F.col("_at") - F.col("_shown.at")).alias("review_seconds"))


def review_stream(events: DataFrame, keys: list[str], idle_s: float, lateness: str, tie: str = "pos") -> DataFrame:
    """``review_times`` while the log grows. Append output: a review is final once the watermark passed its end.

    Each key keeps the events the watermark has not passed and one clock; an event-time timer walks them
    in order. The session must use the RocksDB state store.
    """
    d = events.select(*keys, F.col("ts").cast("timestamp").alias("at"), F.col(tie).cast("long").alias("place"), "kind").withWatermark("at", lateness)
    out = T.StructType([*[d.schema[k] for k in keys], T.StructField("start", T.TimestampType()), T.StructField("review_seconds", T.DoubleType())])
    return d.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=ReviewClock(keys, idle_s), outputStructType=out, outputMode="Append", timeMode="EventTime")


class ReviewClock(StatefulProcessor):
    """Events of a key that may still be overtaken, and its clock of active seconds."""

    def __init__(self, keys: list[str], idle_s: float):
        self.keys, self.idle_s = keys, idle_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = handle.getListState("events", "us long, pos long, kind string")
        self.clock = handle.getValueState("clock", "last long, active double, shown long, shown_at double")

    def handleInputRows(self, key, rows, timerValues):
        found = [r for pdf in rows for r in zip(pdf["at"].astype("datetime64[us]").astype("int64"), pdf["place"], pdf["kind"])]
        if found:
            self.events.appendList([(int(us), int(pos), kind) for us, pos, kind in found])
            self._wake(min(us for us, *_ in found), timerValues)
        return iter([])

    def _wake(self, us: int, timerValues) -> None:
        self.handle.registerTimer(max(-(-int(us) // 1000), timerValues.getCurrentWatermarkInMs() + 1))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        held = sorted(self.events.get())
        ready, rest = [e for e in held if e[0] <= passed], [e for e in held if e[0] > passed]
        if not ready:
            if rest:
                self._wake(rest[0][0], timerValues)
            return
        last, active, shown, shown_at = self.clock.get() if self.clock.exists() else (None, 0.0, None, None)
        out = []
        for us, _, kind in ready:
            if last is not None:
                active += min((us - last) / 1e6, self.idle_s)
            last = us
            if kind == "seed_shown" and shown is None:
                shown, shown_at = us, active
            elif kind in ("edit", "save") and shown is not None:
                out.append((shown, active - shown_at))
                shown = shown_at = None
        self.clock.update((last, active, shown, shown_at))
        self.events.clear()
        if rest:
            self.events.put(rest)
            self._wake(rest[0][0], timerValues)
        if out:
            frame = {k: [v] * len(out) for k, v in zip(self.keys, key)}
            yield pd.DataFrame({**frame, "start": pd.to_datetime([s for s, _ in out], unit="us"), "review_seconds": [r for _, r in out]})

    def close(self) -> None:
        pass


# -- ST4: run status ------------------------------------------------------------------------------


def run_partial(events: DataFrame, last: int = 60) -> DataFrame:
    """What one micro-batch says about each run; partial results merge in any order."""
    return run_status_parts(events, last)


def read_run_status(spark: SparkSession, out: str, last: int = 60) -> DataFrame:
    return merge_run_status(spark.read.parquet(out).drop("batch"), last)


def live_runs(spark: SparkSession, path: str, schema: T.StructType, last: int = 60, most: int = 8) -> LiveTable:
    """Run status as a live table of mergeable summaries; ``schema`` is that of ``run_partial``."""
    return LiveTable(spark, path, schema, lambda d: merge_run_parts(d, last), most)


# -- ST5: who labelled what, open queue -----------------------------------------------------------


def labelled_by_stream(decisions: DataFrame) -> DataFrame:
    """Labellers of each scene so far: a short set per scene."""
    named = decisions.filter("annotator <> ''")
    return named.groupBy("scene_id").agg(F.collect_set("annotator").alias("labelled_by"))


def read_open_queue(spark: SparkSession, out: str, scenes: DataFrame, labellers: list[str],
                    per_scene: int = 2) -> DataFrame:
    """Which scenes each labeller still owes. ``scenes`` has ``scene_id, review_status, replicate``.

    A scene's set only grows, so its largest emitted set is its state.
    """
    done = spark.read.parquet(out).groupBy("scene_id").agg(
        F.max_by("labelled_by", F.size("labelled_by")).alias("labelled_by"))
    return open_queue(done, scenes, labellers, per_scene)


def live_labelled_by(spark: SparkSession, path: str, schema: T.StructType, most: int = 8) -> LiveTable:
    """Labellers of each scene as a live table; deltas are the batches' own sets."""
    return LiveTable(spark, path, schema, lambda d: d.groupBy("scene_id").agg(
        F.array_distinct(F.flatten(F.collect_set("labelled_by"))).alias("labelled_by")), most)


def open_queue(done: DataFrame, scenes: DataFrame, labellers: list[str], per_scene: int = 2) -> DataFrame:
    """The open queue from ``scene_id, labelled_by``."""
    none = F.array().cast("array<string>")
    d = scenes.join(done, "scene_id", "left").withColumn("labelled_by", F.coalesce("labelled_by", none))
    d = d.withColumn("annotator", F.explode(F.array(*[F.lit(a) for a in labellers])))
    by, who = F.col("labelled_by"), F.col("annotator")
    return d.select("scene_id", "annotator", F.size(by).cast("long").alias("n_labels"),
                    needs_label(by, who, F.col("replicate"), F.col("review_status"), per_scene)
                    .alias("needs_label"),
                    is_blind(by, who, F.col("replicate"), F.lit(False)).alias("blind"))


# -- ST6: throughput ------------------------------------------------------------------------------


def throughput(decisions: DataFrame, length: str, slide: str | None = None,
               lateness: str | None = None) -> DataFrame:
    """Decisions and median active seconds by route in tumbling or sliding windows.

    The median is exact, the first value at which half of them are reached: values are counted first, then
    picked from their counts, two chained aggregates. A window's row holds its distinct values. With
    ``lateness`` the input is a stream and rows behind the watermark are dropped and counted in the
    query's progress.
    """
    d = decisions.withColumn("_t", F.col("ts").cast("timestamp"))
    if lateness:
        d = d.withWatermark("_t", lateness)
    w = F.window("_t", length, slide) if slide else F.window("_t", length)
    counts = d.groupBy(w, "route", "active_seconds").agg(F.count("*").alias("n"))
    pairs = F.array_sort(F.collect_list(F.when(F.col("active_seconds").isNotNull(), F.struct(F.col("active_seconds").alias("v"), "n"))))
    known = F.coalesce(F.sum(F.when(F.col("active_seconds").isNotNull(), F.col("n"))), F.lit(0))
    s = counts.groupBy("window", "route").agg(F.sum("n").alias("decisions"), known.alias("_known"), pairs.alias("_p"))
    half = F.col("_known") / 2  # a column: a sum over the list would be taken again for each of its values
    start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("double").alias("v"))
    median = F.aggregate("_p", start, lambda a, p: F.struct(
        (a["seen"] + p["n"]).alias("seen"), F.when(a["seen"] >= half, a["v"]).otherwise(p["v"].cast("double")).alias("v")), lambda a: a["v"])
    return s.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "route", "decisions", median.alias("median_seconds"))

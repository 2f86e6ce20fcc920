"""Manifests, sidecars, the decision log and exports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskloom.functions.scalars import slug
from maskloom.operators.decisions import latest
from maskloom.schemas import (
    AUTO_MASK_RESULTS, DECISION_LOG, EVAL_SETS, EXCLUSIONS, LOG_FIELDS, MANIFEST, PROVENANCE_FIELDS)


def blank_to_null(df: DataFrame) -> DataFrame:
    """Empty text plays null in every text table."""
    return df.withColumns({f.name: F.nullif(F.trim(f.name), F.lit("")) for f in df.schema
                           if isinstance(f.dataType, T.StringType)})


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return blank_to_null(spark.read.csv(path, header=True, schema=MANIFEST, enforceSchema=False))


def upsert_manifest(old: DataFrame, new: DataFrame, key: str = "scene_dir") -> DataFrame:
    """New values win column by column, a new scene starts with an ``ok`` labelling status."""
    o, n = old.alias("o"), new.alias("n")
    j = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full")

    def pick(c: str):
        both = [F.col(f"{a}.{c}") for a, d in (("n", new), ("o", old)) if c in d.columns]
        if c == "autolabel_status":
            both.append(F.lit("ok"))
        return F.coalesce(*both).alias(c)

    return j.select(*[pick(c) for c in dict.fromkeys([*old.columns, *new.columns])])


def _quoted_records(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Records of CSV files that many tasks read: ``src`` (place in ``paths``), ``file, record, text``.

    Files are read as lines by byte ranges. A line starts a record where the quotes before it in its file
    are even in number: they are counted inside each range, and a table of ranges (a row each) carries their
    parity and the number of records on. A record's lines meet again on its number, so a record may run
    over any number of ranges. Quotes inside a field must be doubled, which leaves the parity as it is.
    """
    lines = reduce(DataFrame.unionByName, [
        spark.read.text(path, lineSep="\n").select(
            F.lit(i).alias("src"), F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("range"), F.monotonically_increasing_id().alias("n"), "value")
        for i, path in enumerate(paths)])
    at = ["src", "file", "range"]
    inside = Window.partitionBy(*at).orderBy("n")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    odd = F.pmod(F.coalesce(F.sum("_q").over(before), F.lit(0)), F.lit(2))
    d = lines.withColumn("_q", F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit(""))))
    d = d.withColumn("_odd", odd).withColumns({
        f"_starts{p}": F.sum((F.col("_odd") == p).cast("long")).over(inside) for p in (0, 1)})
    file = Window.partitionBy("src", "file").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = d.groupBy(*at).agg(F.sum("_q").alias("_t"), *[F.max(f"_starts{p}").alias(f"_m{p}") for p in (0, 1)])
    ranges = ranges.withColumn("_open", F.pmod(F.coalesce(F.sum("_t").over(file), F.lit(0)), F.lit(2)))
    ranges = ranges.withColumn("_m", F.when(F.col("_open") == 0, F.col("_m0")).otherwise(F.col("_m1")))
    ranges = ranges.withColumn("_records", F.coalesce(F.sum("_m").over(file), F.lit(0)))
    number = F.col("_records") + F.when(F.col("_open") == 0, F.col("_starts0")).otherwise(F.col("_starts1"))
    d = d.join(ranges.select(*at, "_open", "_records"), at).withColumn("record", number)
    parts = F.sort_array(F.collect_list(F.struct("range", "n", "value")))
    return d.groupBy("src", "file", "record").agg(
        F.rtrim(F.array_join(F.transform(parts, lambda x: x["value"]), "\n"), F.lit("\r")).alias("text"))


def read_decision_log(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Log files of any age: a header may be shorter than the current one, never reordered.

    ``log_pos`` follows the order of ``paths``, of file names inside a folder and of the records of a
    file, and is the same for any way of splitting files. All headers are checked by one job. A file is
    split into byte ranges even if fields hold line ends; empty lines between records are left out.
    """
    records = _quoted_records(spark, paths)
    heads = records.filter("record = 1").withColumn("_head", F.trim("text"))
    known = [",".join(LOG_FIELDS[:n]) for n in range(1, len(LOG_FIELDS) + 1)]
    bad = heads.filter(~F.col("_head").isin(known)).select("file").first()
    if bad:
        raise ValueError(f"{bad['file']}: columns are reordered or unknown")
    files = heads.select("src", "file", F.row_number().over(
        Window.partitionBy("src").orderBy("file")).alias("_rank"))  # one row per file
    at = F.shiftleft(F.col("src").cast("long"), 56) + F.shiftleft(F.col("_rank").cast("long"), 33) + F.col("record") - 2
    rows = records.filter((F.col("record") > 1) & (F.trim("text") != "")).join(files, ["src", "file"])
    log = rows.select(at.alias("log_pos"), F.from_csv(
        "text", ", ".join(f"{c} string" for c in LOG_FIELDS), {"quote": '"', "escape": '"', "multiLine": "true"}).alias("_r"))
    log = blank_to_null(log.select("log_pos", "_r.*"))
    types = {f.name: f.dataType for f in DECISION_LOG}
    return log.select("log_pos", *[F.col(c).try_cast(types[c]).alias(c) for c in LOG_FIELDS])


def append_decisions(rows: DataFrame, path: str, spread: int = 8) -> None:
    """Append decisions, one folder per day. Up to ``spread`` tasks write a day's files."""
    salt = F.pmod(F.xxhash64(*rows.columns), F.lit(spread))
    (rows.withColumn("day", F.to_date("timestamp")).repartition("day", salt)
     .write.mode("append").partitionBy("day").parquet(path))


def eval_violations(evals: DataFrame) -> DataFrame:
    """Rows that break the rules of the evaluation-set sidecar."""
    known = F.coalesce(F.col("set").isin(*EVAL_SETS), F.lit(False))
    here = F.coalesce(F.trim("scene_dir") != "", F.lit(False))
    flags = F.filter(F.array(F.when(~known, "unknown set"), F.when(~here, "no scene")),
                     lambda p: p.isNotNull())
    single = evals.select("scene_dir", F.explode(flags).alias("problem")).groupBy(
        "scene_dir", "problem").agg(F.count("*").alias("n"))
    both = evals.filter(known & here).groupBy("scene_dir").agg(
        F.count_distinct("set").alias("_k"), F.count("*").alias("n")).filter("_k > 1")
    return single.unionByName(both.select("scene_dir", F.lit("in both sets").alias("problem"), "n"))


def read_eval_sets(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation sets, one row per scene; a broken sidecar stops the job."""
    raw = spark.read.csv(path, header=True).select("set", "scene_dir")
    bad = eval_violations(raw).limit(3).collect()
    if bad:
        raise ValueError(f"{path}: {[(r['scene_dir'], r['problem']) for r in bad]}")
    return raw.distinct()


def read_exclusions(spark: SparkSession, path: str) -> DataFrame:
    return blank_to_null(spark.read.csv(path, header=True, schema=EXCLUSIONS, enforceSchema=False))


def exclusions(sidecar: DataFrame, scope: str, ts: str = "ts") -> DataFrame:
    return sidecar.filter(F.col("scope") == scope).select("scene_id", ts).distinct()


def pool_queue(sidecar: DataFrame) -> DataFrame:
    return sidecar.select(F.trim("scene_dir").alias("scene_dir")).filter("scene_dir <> ''").distinct()


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType = AUTO_MASK_RESULTS) -> DataFrame:
    """Newline JSON; lines that do not parse are dropped."""
    wide = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    raw = spark.read.json(path, schema=wide, mode="PERMISSIVE", columnNameOfCorruptRecord="_bad")
    return raw.filter("_bad is null").drop("_bad")


def mask_store(decisions: DataFrame) -> DataFrame:
    """One mask per scene and labeller, the last saved one."""
    last = latest(decisions, ["scene_id", "annotator"])
    name = F.coalesce(F.nullif(slug("annotator"), F.lit("")), F.lit("anon"))
    return last.withColumn("mask_path", F.concat(
        F.lit("masks/"), F.col("scene_id").cast("string"), F.lit("/"), name, F.lit(".png")))


def provenance(exported: DataFrame) -> DataFrame:
    """The 13 provenance columns; what the log does not know is null."""
    stem = F.element_at(F.split("scene_dir", "/"), -1)
    d = exported.withColumn("stem", stem)
    return d.select(*[F.col(c) if c in d.columns else F.lit(None).cast("double").alias(c)
                      for c in PROVENANCE_FIELDS])


def ragged_union(parts: list[DataFrame]) -> DataFrame:
    """Result tables with different columns as one: columns in first-seen order, gaps null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def export_dataset(items: DataFrame, px: DataFrame, masks: DataFrame, path: str) -> DataFrame:
    """Write image pixels and 0/1 class pixels by split; scenes without a mask or image are left out.

    ``items`` has ``scene_id, split``. Returns the scenes written.
    """
    have = masks.select("scene_id").distinct()
    ready = (items.join(have, "scene_id", "left_semi")
             .join(px.select("scene_id").distinct(), "scene_id", "left_semi")
             .select("scene_id", "split"))
    px.join(ready, "scene_id").write.mode("overwrite").partitionBy("split").parquet(f"{path}/img_dir")
    (masks.join(ready, "scene_id").withColumn("cls", (F.col("cls") == 1).cast("short"))
     .write.mode("overwrite").partitionBy("split").parquet(f"{path}/ann_dir"))
    return ready

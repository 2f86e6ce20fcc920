"""Decision-log operators: latest decision, gold selection, splits, leak rules, provenance."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskloom.functions.scalars import (
    export_split, fold_of, group_split, is_replicate, leaf_name, parent_name)
from maskloom.operators.ordered import ranked
from maskloom.schemas import EVAL_SETS, GOLD_ROUTES


def latest(log: DataFrame, keys, ts: str = "ts", pos: str = "log_pos") -> DataFrame:
    """Last decision per key: largest time, ties to the later row.

    An aggregate, not a window: every task keeps one row per key, so a key with a third of all
    decisions moves one row per task.
    """
    rest = [c for c in log.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(F.col(ts), F.col(pos)))
    return log.groupBy(*keys).agg(best.alias("_b")).select(*keys, "_b.*")


def labellers_per_scene(log: DataFrame, key: str = "scene_id", who: str = "annotator") -> DataFrame:
    """Set and number of the labellers of each scene, at least 1."""
    named = log.filter(F.col(who) != "").select(key, who).distinct()
    sets = named.groupBy(key).agg(F.sort_array(F.collect_list(who)).alias("labelled_by"))
    return log.select(key).distinct().join(sets, key, "left").select(
        key, F.coalesce("labelled_by", F.array().cast("array<string>")).alias("labelled_by"),
        F.greatest(F.lit(1), F.coalesce(F.size("labelled_by"), F.lit(1))).cast("long")
        .alias("n_annotators"))


def gold(log: DataFrame, scenes: DataFrame, routes=GOLD_ROUTES) -> DataFrame:
    """Scenes whose latest decision is human verified and whose raster and mask exist.

    ``scenes`` has ``scene_dir, has_tiff, has_mask``; a scene it does not list has neither.
    """
    named = log.filter(F.col("scene_dir") != "")
    last = latest(named, ["scene_dir"]).filter(F.col("route").isin(*routes))
    count = labellers_per_scene(named, "scene_dir").select("scene_dir", "n_annotators")
    files = scenes.filter("has_tiff and has_mask").select("scene_dir")
    return last.join(files, "scene_dir", "left_semi").join(count, "scene_dir")


def skip_reasons(log: DataFrame, scenes: DataFrame, routes=GOLD_ROUTES) -> DataFrame:
    """Why scenes are not gold: ``reason, n``."""
    last = latest(log.filter(F.col("scene_dir") != ""), ["scene_dir"])
    j = last.join(scenes.select("scene_dir", "has_tiff", "has_mask"), "scene_dir", "left")
    reason = (F.when(~F.col("route").isin(*routes), "route")
              .when(~F.coalesce("has_tiff", F.lit(False)), "no raster")
              .when(~F.coalesce("has_mask", F.lit(False)), "no mask").otherwise("gold"))
    return j.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


def approved(manifest: DataFrame) -> DataFrame:
    s = F.col("review_status")
    return manifest.filter((s == "approved") | ((s == "manual") & F.col("has_mask")))


def mask_source(manifest: DataFrame) -> DataFrame:
    """Hand mask first, then the automatic one; null when there is neither."""
    hand = F.concat("scene_dir", F.lit("/water_mask.png"))
    return manifest.select(
        "*", F.when(F.col("has_mask"), hand).otherwise(F.col("mask_path")).alias("mask_used"),
        F.when(F.col("has_mask"), "manual").when(F.col("mask_path").isNotNull(), "auto")
        .alias("mask_kind"))


def review_queue(manifest: DataFrame, statuses=("pending",)) -> DataFrame:
    return manifest.filter(F.coalesce("review_status", F.lit("pending")).isin(*statuses)
                           & (F.col("autolabel_status") == "ok"))


# One-letter review decisions; a skip changes nothing.
REVIEW_CODES = {"a": "approved", "r": "rejected", "m": "manual"}


def apply_review(manifest: DataFrame, decisions: DataFrame) -> DataFrame:
    """Bulk review: ``decisions`` has ``scene_dir, code``."""
    codes = F.create_map(*[F.lit(v) for kv in REVIEW_CODES.items() for v in kv])
    j = manifest.join(decisions.select("scene_dir", "code"), "scene_dir", "left")
    return j.withColumn("review_status", F.coalesce(
        F.try_element_at(codes, F.col("code")), "review_status")).drop("code")


def route_of(seeded: Column, strokes: Column, iou: Column, has_water: Column,
             interactive: Column) -> Column:
    """Labelling route of one saved mask."""
    return (F.when(~seeded, F.when(has_water, "manual_from_scratch").otherwise("empty"))
            .when(interactive, "interactive_clicks")
            .when((strokes == 0) & F.coalesce(iou >= 0.999, F.lit(False)), "auto_accepted")
            .otherwise("auto_edited"))


def timing_rows(log: DataFrame, exclusions: DataFrame, scope: str = "timing") -> DataFrame:
    """Rows whose times are measurements: those no sidecar row of ``scope`` names."""
    drop = exclusions.filter(F.col("scope") == scope).select("scene_id", "ts").distinct()
    return log.join(drop, ["scene_id", "ts"], "left_anti")


def export_splits(items: DataFrame, evals: DataFrame, val: float = 0.2,
                  replicates_train: bool = False) -> DataFrame:
    """Split of every gold scene: test scenes leave, reward scenes and replicates validate."""
    reward, test = EVAL_SETS
    j = items.join(evals.select("scene_dir", F.col("set").alias("_set")), "scene_dir", "left")
    j = j.filter(F.coalesce(F.col("_set") != test, F.lit(True)))
    rep = (F.col("n_annotators") > 1) & F.lit(not replicates_train)
    return j.withColumn("split", F.when(F.coalesce(F.col("_set") == reward, F.lit(False)) | rep, "val")
                        .otherwise(export_split(leaf_name("scene_dir"), val))).drop("_set")


def positional_split(manifest: DataFrame, val: float = 0.2, pos: str = "pos",
                     block: int = 1 << 16, tie: str = "scene_dir") -> DataFrame:
    """Last ``max(1, round(n * val))`` rows by position, then ``tie``, validate; one row alone trains."""
    d = ranked(manifest, [], F.floor(F.col(pos) / block), [F.col(pos), F.col(tie)], "_r", "_n")
    k = F.when(F.col("_n") > 1, F.greatest(F.lit(1), F.bround(F.col("_n") * val, 0))).otherwise(0)
    return d.withColumn("split", F.when(F.col("_r") > F.col("_n") - k, "val")
                        .otherwise("train")).drop("_r", "_n")


def gold_with_empty(log: DataFrame, scenes: DataFrame, evals: DataFrame) -> DataFrame:
    """Gold scenes, and evaluation scenes whose latest decision says there is no water.

    A scene has one latest decision, so both kinds come from one pass over the log.
    """
    both = gold(log, scenes, (*GOLD_ROUTES, "empty"))
    j = both.join(evals.select("scene_dir", F.lit(True).alias("_ev")), "scene_dir", "left")
    return j.filter((F.col("route") != "empty") | F.col("_ev")).drop("_ev")


def _with_eval_flags(items: DataFrame, evals: DataFrame, group: str) -> DataFrame:
    """Evaluation set of each item (``_set``) and whether its session has any (``_held``)."""
    d = items.join(evals.select("scene_dir", F.col("set").alias("_set")), "scene_dir", "left")
    held = d.groupBy(group).agg(F.max(F.col("_set").isNotNull()).alias("_held"))
    return d.join(held, group)


def drop_eval_sessions(items: DataFrame, evals: DataFrame, group: str = "group") -> DataFrame:
    """A session with an evaluation scene keeps only its evaluation scenes."""
    d = _with_eval_flags(items, evals, group)
    return d.filter(F.col("_set").isNotNull() | ~F.col("_held")).drop("_set", "_held")


def leaked(items: DataFrame, evals: DataFrame, group: str = "group") -> DataFrame:
    """Labelled scenes kept out because their session is used for evaluation."""
    d = _with_eval_flags(items, evals, group)
    return d.filter(F.col("_set").isNull() & F.col("_held")).drop("_set", "_held")


def scene_manifest(items: DataFrame, evals: DataFrame | None, val: float = 0.2, test: float = 0.0,
                   folds: int = 0) -> DataFrame:
    """Leak-free training manifest: a session is assigned as a whole.

    With evaluation sets the split comes from them: reward validates, test tests, the rest trains.
    """
    d = items.withColumns({"group": parent_name("scene_dir"), "stem": leaf_name("scene_dir")})
    if evals is None:
        most = d.groupBy("group").agg(F.max("n_annotators").alias("_n"))
        split = group_split("group", "_n", val, test)
        return d.join(most, "group").withColumns({"fold": fold_of("group", folds), "split": split}).drop("_n")
    reward, held = EVAL_SETS
    d = _with_eval_flags(d, evals, "group").filter(F.col("_set").isNotNull() | ~F.col("_held"))
    split = F.when(F.col("_set") == reward, "val").when(F.col("_set") == held, "test").otherwise("train")
    return d.withColumns({"fold": fold_of("group", folds), "split": split}).drop("_set", "_held")


def relocate(log: DataFrame, found: DataFrame) -> DataFrame:
    """Repair stale paths by ``(parent, name)``.

    ``found`` lists labelled folders on disk (``path``). A path on disk is ``current``; a stale one
    with exactly one namesake is ``relocated`` to it, with several ``ambiguous``, with none
    ``missing``.
    """
    here = found.select(F.col("path").alias("scene_dir")).distinct().withColumn("_here", F.lit(True))
    index = found.select("path").distinct().groupBy(
        parent_name("path").alias("_p"), leaf_name("path").alias("_l")).agg(
        F.count("*").alias("_k"), F.min("path").alias("_to"))
    j = (log.withColumns({"_p": parent_name("scene_dir"), "_l": leaf_name("scene_dir")})
         .join(here, "scene_dir", "left").join(index, ["_p", "_l"], "left"))
    status = (F.when(F.col("_here"), "current").when(F.col("_k") == 1, "relocated")
              .when(F.col("_k") > 1, "ambiguous").otherwise("missing"))
    return j.withColumn("path_status", status).withColumn(
        "resolved_dir", F.when(F.col("path_status") == "relocated", F.col("_to"))
        .otherwise(F.col("scene_dir"))).drop("_here", "_k", "_to", "_p", "_l")


def counts_by(items: DataFrame, *columns: str) -> DataFrame:
    """Counts of every column on its own, in one pass: ``dimension, value, n``."""
    sets = [[F.col(c)] for c in columns]
    g = items.groupingSets(sets, *columns).agg(F.count("*").alias("n"),
                                               F.grouping_id().alias("_g"))
    bits = {((1 << len(columns)) - 1) ^ (1 << (len(columns) - 1 - i)): c
            for i, c in enumerate(columns)}
    dim = F.create_map(*[F.lit(v) for kv in bits.items() for v in kv])[F.col("_g").cast("int")]
    value = F.coalesce(*[F.col(c).cast("string") for c in columns])
    return g.select(dim.alias("dimension"), value.alias("value"), "n")


def needs_label(done: Column, annotator: Column, replicate: Column, status: Column,
                per_scene: int = 2) -> Column:
    """Is a scene still in this labeller's queue? ``done`` is the set of labellers."""
    return (F.when(F.array_contains(done, annotator), False)
            .when(replicate & (F.size(done) < per_scene), True)
            .when(F.size(done) > 0, False)
            .otherwise(F.coalesce(status, F.lit("pending")) == "pending"))


def is_blind(done: Column, annotator: Column, replicate: Column, in_eval: Column) -> Column:
    """Must an existing mask be hidden from this labeller?"""
    return in_eval | (replicate & (F.size(done) > 0) & ~F.array_contains(done, annotator))


def queue_rank(eval_set: Column, pool: Column) -> Column:
    """Reward scenes first, then test, then queued pool frames, then the rest."""
    reward, test = EVAL_SETS
    return (F.when(eval_set == reward, 0).when(eval_set == test, 1)
            .when(pool, 2).otherwise(3))


def scene_list(scenes: DataFrame, log: DataFrame, evals: DataFrame, pool: DataFrame,
               annotator: str, replicate_pct: int = 12, per_scene: int = 2) -> DataFrame:
    """The queue as one labeller sees it.

    ``scenes`` has ``scene_id, scene_dir, pos, review_status, has_mask``.
    """
    done = labellers_per_scene(log).select("scene_id", "labelled_by")
    j = (scenes.join(done, "scene_id", "left")
         .join(evals.select("scene_dir", F.col("set").alias("eval_set")), "scene_dir", "left")
         .join(pool.select("scene_dir").distinct().withColumn("pool_queue", F.lit(True)),
               "scene_dir", "left"))
    who, by = F.lit(annotator), F.coalesce("labelled_by", F.array().cast("array<string>"))
    rep = is_replicate(F.col("scene_id").cast("string"), replicate_pct)
    j = j.withColumns({"labelled_by": by, "pool_queue": F.coalesce("pool_queue", F.lit(False)),
                       "replicate": rep})
    blind = is_blind(F.col("labelled_by"), who, F.col("replicate"), F.col("eval_set").isNotNull())
    need = needs_label(F.col("labelled_by"), who, F.col("replicate"), F.col("review_status"), per_scene)
    return j.withColumns({
        "blind": blind, "needs_label": need,
        "rank": queue_rank(F.col("eval_set"), F.col("pool_queue")),
        "n_labels": F.size("labelled_by").cast("long")}).withColumns({
            "has_manual": ~F.col("blind") & F.col("has_mask"),
            "review_status": F.when(F.col("needs_label"), "pending").otherwise(
                F.coalesce("review_status", F.lit("pending")))})


def next_scene(queue: DataFrame, block: int | None = None) -> DataFrame:
    """For each scene the next one its labeller still owes, wrapping around the end of the queue.

    ``queue`` has ``scene_id, rank, pos, needs_label``. The next owed scene is a minimum over the
    rows after the current one, read backwards as a running minimum. The queue is cut into blocks of
    ``block`` positions, by default about as many as there are blocks: inside a block a window,
    between blocks the first owed scene of any later block.
    """
    block = block or max(64, math.isqrt(queue.count()))
    place = F.struct("rank", "pos", "scene_id")
    blk = F.struct(F.col("rank").alias("r"), F.expr(f"pos div {block}").alias("b"))
    d = queue.withColumn("_blk", blk)
    owed = F.when(F.col("needs_label"), place)
    firsts = d.groupBy("_blk").agg(F.min(owed).alias("_f"))
    whole = Window.partitionBy(F.lit(0))  # one row per block, not per scene
    back = whole.orderBy(F.desc("_blk")).rowsBetween(Window.unboundedPreceding, -1)
    later = firsts.select("_blk", F.min("_f").over(back).alias("_later"), F.min("_f").over(whole).alias("_first"))
    inside = Window.partitionBy("_blk").orderBy(F.desc("rank"), F.desc("pos"), F.desc("scene_id")).rowsBetween(
        Window.unboundedPreceding, -1)
    j = d.withColumn("_in", F.min(owed).over(inside)).join(later, "_blk")
    nxt = F.coalesce("_in", "_later", F.when(F.col("_first") != place, F.col("_first")))
    return j.select("scene_id", nxt["scene_id"].alias("next_scene_id"))

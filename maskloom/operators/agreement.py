"""Comparison of masks: overlap, kappa, boundary F1, and their summaries.

Pairs are never formed per pixel. Pixels are first reduced to counts of vote patterns per scene
(which labeller said what), a handful of rows per scene, and only those patterns are expanded into
pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskloom.operators.neighbourhood import outline, square
from maskloom.operators.raster import nearest
from maskloom.operators.tiles import SCENE, TILE, filter_tiles


def pattern_counts(masks: DataFrame, source: str, values: list[str], keys=SCENE) -> DataFrame:
    """``keys, votes, n``: how many pixels carry each combination of the sources' values."""
    vote = F.struct(F.col(source).alias("s"), *[F.col(v) for v in values])
    per_pixel = masks.groupBy(*keys, "y", "x").agg(F.sort_array(F.collect_list(vote)).alias("votes"))
    return per_pixel.groupBy(*keys, "votes").agg(F.count("*").alias("n"))


def pattern_pairs(patterns: DataFrame, keys=SCENE) -> DataFrame:
    """Every pair of sources ``a < b`` in every pattern, with the pattern's pixel count."""
    pairs = F.flatten(F.transform("votes", lambda a, i: F.transform(
        F.slice(F.col("votes"), i + 2, F.size("votes")),
        lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return patterns.select(*keys, "n", F.explode(pairs).alias("_p")).select(*keys, "n", "_p.a", "_p.b")


def pair_overlap(masks: DataFrame, source: str, value: str = "m", keys=SCENE) -> DataFrame:
    """Two-by-two pixel counts of every pair of masks of a scene."""
    p = pattern_pairs(pattern_counts(masks, source, [value], keys), keys)
    a, b, n = F.col(f"a.{value}"), F.col(f"b.{value}"), F.col("n")
    return p.groupBy(*keys, F.col("a.s").alias("a"), F.col("b.s").alias("b")).agg(
        F.sum(n * a * b).alias("both"), F.sum(n * a).alias("in_a"), F.sum(n * b).alias("in_b"),
        F.sum(n).alias("pixels"))


def iou(both: Column, in_a: Column, in_b: Column) -> Column:
    """Two empty masks agree: 1."""
    union = in_a + in_b - both
    return F.when(union == 0, 1.0).otherwise(both / union)


def dice(both: Column, in_a: Column, in_b: Column) -> Column:
    return F.when(in_a + in_b == 0, 1.0).otherwise(2 * both / (in_a + in_b))


def kappa(both: Column, in_a: Column, in_b: Column, n: Column) -> Column:
    """Chance-corrected agreement; 1 when chance alone already agrees everywhere."""
    seen = (n - in_a - in_b + 2 * both) / n
    pa, pb = in_a / n, in_b / n
    chance = pa * pb + (1 - pa) * (1 - pb)
    return F.when(chance >= 1, 1.0).otherwise((seen - chance) / (1 - chance))


def edited_fraction(both: Column, in_a: Column, in_b: Column, n: Column) -> Column:
    return (in_a + in_b - 2 * both) / n


def with_scores(counts: DataFrame) -> DataFrame:
    """IoU, Dice, kappa, edited share and the two water percentages of each pair."""
    t, a, b, n = (F.col(c) for c in ("both", "in_a", "in_b", "pixels"))
    return counts.withColumns({
        "iou": iou(t, a, b), "dice": dice(t, a, b), "kappa": kappa(t, a, b, n),
        "edited": edited_fraction(t, a, b, n),
        "water_pct_a": 100 * a / n, "water_pct_b": 100 * b / n})


def on_first_grid(masks: DataFrame, source: str, keys=SCENE) -> DataFrame:
    """Resample every mask of a scene to the frame size of its first source."""
    first = masks.groupBy(*keys).agg(
        F.min_by(F.struct("h", "w"), F.col(source)).alias("_s")).select(
        *keys, F.col("_s.h").alias("_h"), F.col("_s.w").alias("_w"))
    j = masks.join(first, list(keys))
    return nearest(j, F.col("_h"), F.col("_w")).drop("_h", "_w")


def pair_boundary_f1(masks: DataFrame, source: str, value: str = "m", tolerance: int = 3, keys=SCENE,
                     tile: int = TILE) -> DataFrame:
    """F1 of two mask outlines with ``tolerance`` pixels of slack; null when neither has one."""
    sk = [*keys, source]

    def trace(planes):
        e = outline(planes[value])
        return {"e": e, "d": square(e, 2 * tolerance + 1, True)}

    d = filter_tiles(masks.select(*sk, "h", "w", "y", "x", value), trace, [value],
                     {"e": "int", "d": "int"}, 1 + tolerance, sk, tile)
    p = pattern_pairs(pattern_counts(d, source, ["e", "d"], keys), keys)
    n = F.col("n")
    s = p.groupBy(*keys, F.col("a.s").alias("a"), F.col("b.s").alias("b")).agg(
        F.sum(n * F.col("a.e")).alias("ea"), F.sum(n * F.col("b.e")).alias("eb"),
        F.sum(n * F.col("a.e") * F.col("b.d")).alias("hit_a"),
        F.sum(n * F.col("b.e") * F.col("a.d")).alias("hit_b"))
    prec = F.when(F.col("ea") > 0, F.col("hit_a") / F.col("ea")).otherwise(0.0)
    rec = F.when(F.col("eb") > 0, F.col("hit_b") / F.col("eb")).otherwise(0.0)
    f1 = F.when((F.col("ea") == 0) & (F.col("eb") == 0), F.lit(None)).when(
        prec + rec == 0, 0.0).otherwise(2 * prec * rec / (prec + rec))
    return s.select(*keys, "a", "b", f1.cast("double").alias("boundary_f1"))


def labeller_pairs(scene_sources: DataFrame, source: str, keys=SCENE) -> DataFrame:
    """All pairs ``a < b`` of labellers of a scene. The pairs are the result asked for."""
    a = scene_sources.select(*keys, F.col(source).alias("a")).distinct()
    b = a.withColumnRenamed("a", "b")
    return a.join(b, list(keys)).filter("a < b")


def agreement_summary(pairs: DataFrame, score: str) -> DataFrame:
    """Pairs, scenes, mean, median and minimum of a score.

    Scores are counted at 4 digits first, so the median is taken over at most 10,001 values.
    """
    c = pairs.groupBy(F.round(score, 4).alias("s")).agg(F.count("*").alias("n"))
    known = c.filter("s is not null")
    return known.agg(F.sum("n").alias("pairs"), (F.sum(F.col("s") * F.col("n")) / F.sum("n")).alias("mean"),
                     F.percentile("s", F.lit(0.5), F.col("n")).alias("median"), F.min("s").alias("least"))


def labeller_bias(pairs: DataFrame) -> DataFrame:
    """Mean water percentage of each labeller over the pairs they are part of."""
    long = pairs.select(F.explode(F.array(
        F.struct(F.col("a").alias("who"), F.col("water_pct_a").alias("pct")),
        F.struct(F.col("b").alias("who"), F.col("water_pct_b").alias("pct")))).alias("_e")).select("_e.*")
    return long.groupBy("who").agg(F.avg("pct").alias("mean_water_pct"), F.count("*").alias("n"))


def usability_disputes(last: DataFrame, routes, keys=SCENE) -> DataFrame:
    """Scenes some labellers gave a mask and others did not."""
    usable = F.col("route").isin(*routes).cast("int")
    return last.groupBy(*keys).agg(
        F.sum(usable).alias("with_mask"), F.count("*").alias("labellers"),
        (F.max(usable) - F.min(usable)).alias("_d")).filter("_d > 0").drop("_d")


def worst(pairs: DataFrame, k: int = 10, keys=SCENE) -> DataFrame:
    """The ``k`` pairs with the lowest IoU, ties by scene and names."""
    return pairs.orderBy("iou", *keys, "a", "b").limit(k)

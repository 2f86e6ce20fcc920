"""Votes of several automatic labellers on the same frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskloom.operators.agreement import iou, pair_overlap
from maskloom.operators.tiles import SCENE

# Overlay colours (R, G, B) and opacities of the disagreement map.
AGREE_RGB, MAJORITY_RGB, CONTESTED_RGB = (0, 190, 200), (245, 180, 0), (230, 70, 200)
AGREE_ALPHA, CONTESTED_ALPHA_MIN, CONTESTED_ALPHA_MAX = 90, 18, 215
# Percent limits of the verdict and of the water flag.
STRONG_DISPUTE, SOME_DISPUTE = 40, 15
CONSENSUS_WATER, SINGLE_WATER = 0.5, 2.0


def votes(masks: DataFrame, value: str = "m", keys=SCENE) -> DataFrame:
    """Votes per pixel and the majority; an even tie counts as water."""
    v = masks.groupBy(*keys, "y", "x").agg(F.sum(value).alias("votes"), F.count("*").alias("n"))
    return v.withColumn("consensus", (F.col("votes") >= F.ceil(F.col("n") / 2)).cast("int"))


def vote_summary(v: DataFrame, keys=SCENE) -> DataFrame:
    contested = ((F.col("votes") > 0) & (F.col("votes") < F.col("n"))).cast("int")
    return v.groupBy(*keys).agg(
        F.avg(contested).alias("disagreement_frac"),
        (100 * F.avg("consensus")).alias("consensus_pct"))


def iou_matrix(masks: DataFrame, source: str, value: str = "m", keys=SCENE) -> DataFrame:
    c = pair_overlap(masks, source, value, keys)
    return c.select(*keys, "a", "b", iou(F.col("both"), F.col("in_a"), F.col("in_b")).alias("iou"))


def mean_agreement(matrix: DataFrame, keys=SCENE) -> DataFrame:
    return matrix.groupBy(*keys).agg(F.avg("iou").alias("agreement"), F.count("*").alias("pairs"))


def disagreement_map(v: DataFrame, keys=SCENE) -> DataFrame:
    """Colour by which way the vote went, opacity by how close it was to a tie."""
    k, n = F.col("votes"), F.col("n")
    tie = 1 - F.abs(2 * k / n - 1)
    span = CONTESTED_ALPHA_MAX - CONTESTED_ALPHA_MIN
    alpha = F.floor(F.round(CONTESTED_ALPHA_MIN + span * tie * tie, 6)).cast("int")

    def pick(i: int) -> Column:
        return (F.when(k == 0, 0).when(k == n, AGREE_RGB[i])
                .when(F.col("consensus") == 1, MAJORITY_RGB[i]).otherwise(CONTESTED_RGB[i]))

    return v.select(*keys, "y", "x", pick(0).alias("red"), pick(1).alias("green"),
                    pick(2).alias("blue"),
                    F.when(k == 0, 0).when(k == n, AGREE_ALPHA).otherwise(alpha).alias("alpha"))


def verdict(disagreement_pct: Column) -> Column:
    return (F.when(disagreement_pct > STRONG_DISPUTE, "strong disagreement")
            .when(disagreement_pct > SOME_DISPUTE, "mostly agree").otherwise("closely agree"))


def water_present(consensus_pct: Column, largest_pct: Column) -> Column:
    return (consensus_pct > CONSENSUS_WATER) | (largest_pct > SINGLE_WATER)


def ensemble_report(masks: DataFrame, source: str, value: str = "m", keys=SCENE) -> DataFrame:
    """One row per scene: agreement, contested share, consensus and the plain verdict."""
    v = vote_summary(votes(masks, value, keys), keys)
    a = mean_agreement(iou_matrix(masks, source, value, keys), keys)
    top = masks.groupBy(*keys, source).agg((100 * F.avg(value)).alias("_p")).groupBy(*keys).agg(
        F.max("_p").alias("largest_pct"), F.count("*").alias("n_ran"))
    j = v.join(a, list(keys), "left").join(top, list(keys))
    return j.withColumns({
        "water_present": water_present(F.col("consensus_pct"), F.col("largest_pct")),
        "verdict": verdict(100 * F.col("disagreement_frac"))})

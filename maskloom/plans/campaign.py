"""Facts a routing campaign is built from: timings, automatic quality, observations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskloom.operators.evaluation import model_agreement, prediction_stats
from maskloom.operators.neighbourhood import edge_density
from maskloom.operators.selection import redundancy
from maskloom.operators.statistics import band_summary, grey_entropy, histogram, index_shares, index_summary, otsu
from maskloom.operators.tiles import SCENE


def scene_facts(scenes: DataFrame, measured: DataFrame, auto: DataFrame, gold: DataFrame) -> DataFrame:
    """Per scene: measured time and each automatic labeller's IoU with gold and water share."""
    j = auto.join(gold, ["scene_id", "y", "x"])
    either = F.sum(F.greatest("m", "gold"))
    q = j.groupBy("scene_id", "labeller").agg(
        F.round(F.when(either == 0, 1.0).otherwise(F.sum(F.col("m") * F.col("gold")) / either), 4)
        .alias("iou_vs_gold"), F.round(F.avg("m"), 4).alias("water_frac"))
    lists = q.groupBy("scene_id").agg(F.sort_array(F.collect_list(
        F.struct("labeller", "iou_vs_gold", "water_frac"))).alias("auto"))
    return scenes.join(measured, "scene_id", "left").join(lists, "scene_id", "left")


# Names of the descriptors on disk.
BAND_FEATURES = {"r": "r", "g": "g", "b": "b", "th": "thermal", "nir": "nir"}
STATISTICS = {"mean": "mean", "sd": "std", "p5": "p5", "p50": "p50", "p95": "p95"}


def scene_features(px: DataFrame, keys=SCENE) -> DataFrame:
    """One row of descriptors per frame: five statistics of each band and of NDWI, shares of positive NDWI
    and dark NIR, separability of thermal, edge density and grey entropy.

    Every part counts pixels per frame and value first; what is joined is one row per frame.
    """
    bands = band_summary(px, list(BAND_FEATURES), keys).groupBy(*keys).pivot("band", list(BAND_FEATURES)).agg(
        *[F.first(c).alias(n) for c, n in STATISTICS.items()])
    bands = bands.select(*keys, *[F.col(f"{b}_{n}").alias(f"{name}_{n}") for b, name in BAND_FEATURES.items() for n in STATISTICS.values()])
    index = index_summary(px, keys).select(*keys, *[F.col(c).alias(f"ndwi_{n}") for c, n in STATISTICS.items()])
    heat = px.select(*keys, F.when(F.col("th").isNotNull(), F.greatest(F.lit(0), F.least(F.lit(255), "th"))).cast("int").alias("th"))
    apart = otsu(histogram(heat, keys, "th"), keys).select(*keys, F.col("sep").alias("thermal_otsu_sep"))
    d = bands
    for part in (index, index_shares(px, keys=keys), apart, edge_density(px, keys), grey_entropy(px, keys)):
        d = d.join(part, list(keys))
    return d


def observations(candidates: DataFrame, labelled: DataFrame, features: DataFrame, pred: DataFrame,
                 auto: DataFrame, cost: DataFrame) -> DataFrame:
    """One row per candidate: scene features, what the model says, how far it is from the automatic
    mask, what a label is expected to cost, and how redundant its session is.

    ``cost`` is the one-row median table.
    """
    p = prediction_stats(pred).select("scene_id", F.col("mean_entropy").alias("entropy"),
                                      F.col("low_conf_frac").alias("low_conf"), "pred_water")
    iou = model_agreement(pred, auto.withColumn("cls", F.col("m"))).select(
        "scene_id", F.col("water_iou").alias("iou_model_auto"))
    share = auto.groupBy("scene_id").agg(F.avg("m").alias("auto_water"))
    median = cost.select("median_s").scalar()
    d = redundancy(candidates, labelled)
    for extra in (features, p, iou, share):
        d = d.join(extra, "scene_id")
    return d.withColumn("manual_min", median / 60)

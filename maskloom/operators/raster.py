"""Per-pixel raster operators: stretch, normalise, views, resampling, padding, tiles, mask codes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskloom.functions.scalars import clip, ndwi, sha1_bucket
from maskloom.operators.neighbourhood import box_sum
from maskloom.operators.statistics import band_long, exact_percentiles
from maskloom.operators.tiles import SCENE, filter_tiles, join_scene_stats, with_frame_size
from maskloom.schemas import BANDS, IGNORE, MODALITIES, REPLACED_OPTICS, WATER


def complete_bands(px: DataFrame, strict: bool = False, depth: Column | None = None) -> DataFrame:
    """Missing bands become 0, or an error when ``strict``.

    ``depth`` is the number of bands that a frame's raster has: the bands after them are missing, and null
    values of the others stay. Without it every null value is of a missing band.
    """

    def fix(i: int, b: str) -> Column:
        if b not in px.columns:
            return F.raise_error(F.lit(f"band {b} is missing")).cast("int") if strict else F.lit(0)
        bad = F.raise_error(F.concat(F.lit(f"band {b} is missing in scene "),
                                     F.col("scene_id").cast("string"))).cast("int")
        lacks = F.col(b).isNull() if depth is None else depth <= i
        return F.when(lacks, bad if strict else F.lit(0)).otherwise(F.col(b))

    return px.withColumns({b: fix(i, b) for i, b in enumerate(BANDS)})


def modality(px: DataFrame, name: str, replacement: DataFrame | None = None) -> DataFrame:
    """The bands of one named sensor subset; one subset takes its optical bands from another frame."""
    bands = MODALITIES[name]
    at = [c for c in ("scene_id", "h", "w", "y", "x") if c in px.columns]
    if name == REPLACED_OPTICS:
        if replacement is None:
            raise ValueError(f"modality {name} needs the replacement frame")
        other = replacement.select("scene_id", "y", "x", *bands)
        return px.select(*at).join(other, ["scene_id", "y", "x"])
    return px.select(*at, *bands)


def between(v: Column, lo: Column, hi: Column) -> Column:
    """Position of ``v`` between two bounds, clipped to [0, 1]; 0 when the bounds coincide."""
    return F.when(hi > lo, clip((v - lo) / (hi - lo))).otherwise(F.lit(0.0))


def _sizes(px: DataFrame, keys) -> DataFrame:
    return px.groupBy(*keys).agg(F.max("h").alias("h"), F.max("w").alias("w"))


def stretch(px: DataFrame, bands, lo: float = 0.02, hi: float = 0.98, keys=SCENE,
            scale: float = 1.0) -> DataFrame:
    """Each band between two of its own percentiles, as ``<band>_n`` in [0, scale]."""
    long = band_long(px.select(*keys, *bands), bands)
    p = exact_percentiles(long, [*keys, "band"], "v", {"lo": lo, "hi": hi})
    wide = p.groupBy(*keys).pivot("band", list(bands)).agg(
        F.first("lo").alias("lo"), F.first("hi").alias("hi"))
    stats = wide.join(_sizes(px, keys), list(keys))
    return join_scene_stats(px, stats, keys).select(*px.columns, *[
        (between(F.col(b), F.col(f"{b}_lo"), F.col(f"{b}_hi")) * scale).alias(f"{b}_n")
        for b in bands])


def minmax(px: DataFrame, bands, keys=SCENE) -> DataFrame:
    """Each band between its smallest and largest value of the frame, as ``<band>_n``."""
    s = px.groupBy(*keys).agg(*[F.min(b).alias(f"_lo_{b}") for b in bands],
                              *[F.max(b).alias(f"_hi_{b}") for b in bands],
                              F.max("h").alias("h"), F.max("w").alias("w"))
    return join_scene_stats(px, s, keys).select(*px.columns, *[
        between(F.col(b), F.col(f"_lo_{b}"), F.col(f"_hi_{b}")).alias(f"{b}_n") for b in bands])


def frozen(stats: DataFrame) -> dict[str, dict[str, float]]:
    """Band statistics as plain numbers; the table has one row per band of a frame."""
    return {r["band"]: r.asDict() for r in stats.collect()}


def normalise(px: DataFrame, stats: dict[str, dict[str, float]] | None, bands, method: str,
              keys=SCENE) -> DataFrame:
    """Frozen statistics (``mean, sd, p_lo, p_hi`` per band) applied to frames."""
    if method == "minmax":
        return minmax(px, bands, keys)

    def f(b: str) -> Column:
        s = stats[b]
        if method == "meanstd":
            return (F.col(b) - s["mean"]) / max(s["sd"], 1e-6)
        return clip((F.col(b) - s["p_lo"]) / max(s["p_hi"] - s["p_lo"], 1e-6))

    if method not in ("meanstd", "percentile"):
        raise ValueError(f"unknown normalisation {method}")
    return px.select(*px.columns, *[f(b).alias(f"{b}_n") for b in bands])


def view_layers(px: DataFrame, keys=SCENE) -> DataFrame:
    """Display columns: colour infrared (NIR, red, green), thermal and NIR grey, NDWI grey.

    A level within 1e-6 of the next whole number counts as that number.
    """
    s = stretch(px, ("nir", "r", "g", "th"), keys=keys, scale=255.0)

    def level(c: Column) -> Column:
        return F.floor(F.round(c, 6)).cast("int")

    return s.select(
        *px.columns, level(F.col("nir_n")).alias("cir_r"), level(F.col("r_n")).alias("cir_g"),
        level(F.col("g_n")).alias("cir_b"), level(F.col("th_n")).alias("thermal_grey"),
        level(clip((ndwi() + 1) / 2 * 255, 0, 255)).alias("ndwi_grey"))


# Overlay colour (R, G, B) and the share of the photo under it.
OVERLAY_RGB = {"r": 102, "g": 0, "b": 204}
PHOTO_SHARE = 0.6


def overlay(px: DataFrame, mask: DataFrame, keys=SCENE) -> DataFrame:
    """Photo blended with a magenta layer where the mask is set."""
    on = [*keys, "y", "x"]
    j = px.join(mask.select(*on, "m"), on, "left")
    return j.select(*on, *[
        F.round(PHOTO_SHARE * F.col(b) + (1 - PHOTO_SHARE)
                * F.when(F.col("m") == 1, v).otherwise(F.col(b))).cast("int").alias(f"over_{b}")
        for b, v in OVERLAY_RGB.items()])


def nearest(df: DataFrame, h: int | Column, w: int | Column) -> DataFrame:
    """Nearest-neighbour resampling to ``h`` x ``w`` (numbers or columns): for masks.

    Every source pixel emits the target pixels that read it, so no coordinate join is needed.
    """

    h, w = (v if isinstance(v, Column) else F.lit(v) for v in (h, w))

    def targets(c: Column, size: Column, n: Column) -> Column:
        first = F.ceil(c * n / size)
        stop = F.least(n, F.ceil((c + 1) * n / size)) - 1
        return F.when(first <= stop, F.sequence(first, stop))

    ys = targets(F.col("y"), F.col("h"), h)
    xs = targets(F.col("x"), F.col("w"), w)
    return (df.withColumn("_y", F.explode(ys)).withColumn("_x", F.explode(xs))
            .withColumns({"y": F.col("_y").cast("int"), "x": F.col("_x").cast("int"),
                          "h": h, "w": w}).drop("_y", "_x"))


def bilinear(df: DataFrame, value: str, classes: int, h: int | Column, w: int | Column, by) -> DataFrame:
    """Bilinear resampling of score arrays to ``h`` x ``w`` (numbers or columns).

    Every source pixel sends its weight to the target pixels it contributes to; the targets add up.
    """
    h, w = (v if isinstance(v, Column) else F.lit(v) for v in (h, w))

    def shares(c: Column, size: Column, n: Column) -> Column:
        def place(t: Column) -> Column:
            at = F.greatest(F.lit(0.0), F.least((size - 1).cast("double"),
                                                (t + 0.5) * size / n - 0.5))
            return F.greatest(F.lit(0.0), 1 - F.abs(at - c))
        first = F.greatest(F.lit(0), F.floor((c - 0.5) * n / size - 0.5))
        last = F.least(n - 1, F.ceil((c + 1.5) * n / size - 0.5))
        low = F.when(c == 0, F.lit(0)).otherwise(first)
        high = F.when(c == size - 1, n - 1).otherwise(last)
        cells = F.transform(F.sequence(low, high),
                            lambda t: F.struct(t.cast("int").alias("t"), place(t).alias("k")))
        return F.filter(cells, lambda s: s["k"] > 0)

    d = (df.withColumn("_y", F.explode(shares(F.col("y"), F.col("h"), h)))
         .withColumn("_x", F.explode(shares(F.col("x"), F.col("w"), w))))
    k = F.col("_y.k") * F.col("_x.k")
    s = d.groupBy(*by, F.col("_y.t").alias("y"), F.col("_x.t").alias("x")).agg(
        F.array(*[F.sum(k * F.col(value)[c]) for c in range(classes)]).alias(value))
    return s.withColumns({"h": h, "w": w})


def block_mean(px: DataFrame, values, factor: int, keys=SCENE) -> DataFrame:
    """Image shrunk by a whole factor: the mean of each block, a cut block of what it holds."""
    return px.groupBy(*keys, F.expr(f"int(y div {factor})").alias("y"),
                      F.expr(f"int(x div {factor})").alias("x")).agg(
        *[F.avg(v).alias(v) for v in values])


def pad(df: DataFrame, fill: dict[str, int], multiple: int = 32, keys=SCENE) -> DataFrame:
    """Add rows and columns on the right and bottom until both sides are multiples of ``multiple``.

    Only border pixels emit padding: the right edge its row, the bottom edge its column, the corner
    the rest.
    """
    def up(c: str) -> Column:
        return (F.ceil(F.col(c) / multiple) * multiple).cast("int")

    d = df.withColumns({"_h": up("h"), "_w": up("w")})

    def reach(c: str, size: str, full: str) -> Column:
        return F.when(F.col(c) == F.col(size) - 1, F.sequence(F.col(c), F.col(full) - 1)).otherwise(
            F.array(F.col(c)))

    d = (d.withColumn("_y", F.explode(reach("y", "h", "_h")))
         .withColumn("_x", F.explode(reach("x", "w", "_w"))))
    new = (F.col("_y") != F.col("y")) | (F.col("_x") != F.col("x"))
    return (d.withColumns({k: F.when(new, v).otherwise(F.col(k)) for k, v in fill.items()})
            .withColumns({"y": F.col("_y"), "x": F.col("_x"), "h": F.col("_h"), "w": F.col("_w")})
            .drop("_y", "_x", "_h", "_w"))


def crop(df: DataFrame, h: int, w: int) -> DataFrame:
    """Undo the padding."""
    return df.filter((F.col("y") < h) & (F.col("x") < w)).withColumns({"h": F.lit(h), "w": F.lit(w)})


def tile_balance(mask: DataFrame, size: int, keys=SCENE, limit: float = 0.85) -> DataFrame:
    """Grid crops with the share of their largest class; ``keep`` when it is at most ``limit``."""
    ty, tx = F.expr(f"int(y div {size})").alias("ty"), F.expr(f"int(x div {size})").alias("tx")
    n = mask.filter(F.col("cls") != IGNORE).groupBy(*keys, ty, tx, "cls").agg(
        F.count("*").alias("n"))
    t = n.groupBy(*keys, "ty", "tx").agg(F.max("n").alias("top"), F.sum("n").alias("valid"))
    share = F.col("top") / F.col("valid")
    return t.select(*keys, "ty", "tx", "valid", share.alias("top_share"),
                    (share <= limit).alias("keep"))


def drawn_tiles(mask: DataFrame, size: int, draws: int = 10, seed: int = 0, keys=SCENE,
                limit: float = 0.85) -> DataFrame:
    """One crop per frame from ``draws`` seeded offsets: the first within ``limit``, else the least
    dominated one. Offsets are a hash of frame, seed and draw, so a draw never depends on layout. A frame
    whose draws hold ignored pixels only gets its corner, as draw -1 without a share.

    A pixel is copied only to the draws that cover it.
    """
    def offset(draw: Column, axis: str, side: str) -> Column:
        key = F.concat_ws(":", *[F.col(k).cast("string") for k in keys], F.lit(str(seed)),
                          draw.cast("string"), F.lit(axis))
        return F.pmod(sha1_bucket(key, 1 << 30), F.greatest(F.lit(1), F.col(side) - size + 1))

    offsets = F.transform(F.sequence(F.lit(0), F.lit(draws - 1)), lambda i: F.struct(
        i.alias("draw"), offset(i, "y", "h").alias("top"), offset(i, "x", "w").alias("left")))
    covers = F.filter(offsets, lambda o: F.col("y").between(o["top"], o["top"] + size - 1)
                      & F.col("x").between(o["left"], o["left"] + size - 1))
    inside = mask.filter(F.col("cls") != IGNORE).select(*keys, "cls", F.explode(covers).alias("_o")).select(*keys, "cls", "_o.*")
    n = inside.groupBy(*keys, "draw", "top", "left", "cls").agg(F.count("*").alias("n"))
    s = n.groupBy(*keys, "draw", "top", "left").agg((F.max("n") / F.sum("n")).alias("share"))
    rank = F.when(F.col("share") <= limit, F.struct(F.lit(0.0).alias("s"), F.col("draw").alias("d")))
    rank = rank.otherwise(F.struct(F.col("share").alias("s"), F.col("draw").alias("d")))
    best = F.min_by(F.struct("draw", "top", "left", "share"), rank)
    chosen = s.groupBy(*keys).agg(best.alias("_b")).select(*keys, "_b.*")
    corner = mask.select(*keys).distinct().join(chosen, list(keys), "left_anti").select(
        *keys, F.lit(-1).alias("draw"), F.lit(0).alias("top"), F.lit(0).alias("left"), F.lit(None).cast("double").alias("share"))
    return chosen.unionByName(corner)


def decode_masks(mask: DataFrame, keys=("scene_id", "source")) -> DataFrame:
    """One class code for three encodings.

    A mask whose values are all 0 or 255 is a binary mask with 255 for water; any other mask already
    holds class codes and 255 for ignored pixels.
    """
    mask = with_frame_size(mask, keys)
    binary = mask.groupBy(*keys).agg(F.min(F.col("cls").isin(0, IGNORE)).alias("_b"),
                                     F.max("h").alias("h"), F.max("w").alias("w"))
    return join_scene_stats(mask, binary, keys).withColumn(
        "cls", F.when(F.col("_b"), F.when(F.col("cls") > 0, WATER).otherwise(0))
        .otherwise(F.col("cls"))).drop("_b")


def collapse_classes(cls: Column, classes: int) -> Column:
    """Fold classes a model cannot represent into background, ignored pixels stay."""
    return F.when((cls == IGNORE) | (cls < classes), cls).otherwise(0)


def binary_view(cls: Column) -> Column:
    return F.when(cls == WATER, 1).otherwise(0)


def regional_uncertainty(pred: DataFrame, classes: int, keys=SCENE, tile: int = 256) -> DataFrame:
    """Mean over valid pixels of 3x3 class impurity times 3x3 mean entropy.

    ``pred`` has ``cls`` (predicted class), ``ent`` (entropy) and ``valid`` (0 on padding).
    """
    def score(p):
        n = box_sum(np.ones(p["cls"].shape), 1)
        shares = [box_sum((p["cls"] == c).astype(float), 1) / n for c in range(classes)]
        impurity = -sum(f * np.log(f + 1e-9) for f in shares)
        return {"_u": impurity * box_sum(p["ent"], 1) / n}

    d = filter_tiles(pred, score, ["cls", "ent"], {"_u": "double"}, 1, keys, tile)
    return d.filter("valid = 1").groupBy(*keys).agg(F.avg("_u").alias("score"))


def grid_violations(px: DataFrame, masks: DataFrame, source: str, keys=SCENE) -> DataFrame:
    """Masks whose size is not their image's."""
    i = px.groupBy(*keys).agg((F.max("y") + 1).alias("ih"), (F.max("x") + 1).alias("iw"))
    m = masks.groupBy(*keys, source).agg((F.max("y") + 1).alias("mh"), (F.max("x") + 1).alias("mw"))
    return i.join(m, list(keys)).filter("ih <> mh or iw <> mw")

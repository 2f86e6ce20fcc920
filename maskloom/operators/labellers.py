"""Rule-based water labellers: ``pixels -> 0/1 mask``, registered by name.

A labeller takes a pixel table and returns ``(scene_id, h, w, y, x, m)`` plus, where it cannot
decide a scene, no rows for it. Each filter chain tiles the frames once with the halo of the whole
chain, and frame statistics meet the pixels on the tile key.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskloom.functions.scalars import clip, grey, ndwi
from maskloom.operators import backgrounds as BG
from maskloom.operators import tile_labellers as TL
from maskloom.operators.neighbourhood import box_sum, spread
from maskloom.operators.raster import between
from maskloom.operators.statistics import exact_percentiles, histogram, otsu
from maskloom.operators.tilearrays import pack, unpack
from maskloom.operators.tiles import SCENE, TILE, count_tiles, filter_tiles, join_scene_stats
from maskloom.schemas import BANDS
from maskloom.session import durable

# Digits kept of a float map before its percentiles are taken, on the 0..255 scale: far below one
# sensor count, and a frame then has few distinct values to count.
COUNTS = 2


@dataclass(frozen=True)
class FusionParams:
    """Parameters of the spectral fusion labeller. The published defaults."""

    nir_gate: float = 0.45
    nir_gate_soft: float = 0.12
    w_ndwi: float = 0.40
    w_texture: float = 0.35
    w_thermal: float = 0.25
    base: float = 0.35
    specular: bool = False
    snow_guard: bool = True
    horizon: bool = True
    min_area_frac: float = 0.003
    thresh: float = 0.5
    flat_ndwi: float = 0.55
    flat_from: float = 0.55
    flat_soft: float = 0.25
    flat_texture: float = 0.30
    flat_thermal: float = 0.15
    snow_level: float = 0.78
    snow_spread: float = 0.10
    snow_share: float = 0.12
    shiny_level: float = 0.75
    shiny_prob: float = 0.85


def packed(px: DataFrame, bands, keys=SCENE, tile: int = TILE, gaps: bool = False) -> DataFrame:
    """Tile arrays of a pixel table, written once: labellers read them more than once."""
    return durable(pack(px, bands, keys, tile, gaps))


def _bounds(counts: DataFrame, bands, keys) -> DataFrame:
    """2nd and 98th percentile of counted maps (``keys, band, v, n``): ``<band>_lo, <band>_hi``."""
    c = counts.groupBy(*keys, "band", "v").agg(F.sum("n").alias("n"))
    ends = F.array(F.lit(0.02), F.lit(0.98))
    p = c.groupBy(*keys).agg(*[
        F.percentile(F.when(F.col("band") == b, F.col("v")), ends, F.col("n")).alias(b) for b in bands])
    return p.select(*keys, *[F.col(b)[i].alias(f"{b}_{end}") for b in bands
                             for i, end in enumerate(("lo", "hi"))])


def _counted(px: DataFrame, band: str, v: Column, digits: int, keys) -> DataFrame:
    return px.groupBy(*keys, F.lit(band).alias("band"), F.round(v.cast("double"), digits).alias("v")).agg(
        F.count("*").alias("n"))


def _scaled(name: str, v: Column) -> Column:
    return between(v, F.col(f"{name}_lo"), F.col(f"{name}_hi"))


def horizon_rows(px: DataFrame, keys=SCENE) -> DataFrame:
    """First image row that no longer looks like sky, null unless the top rows do."""
    bright = F.greatest("r", "g", "b") / F.lit(255.0)
    sky = (bright > 0.55) & (F.col("b") >= F.col("r") - 5)
    rows = px.groupBy(*keys, "y").agg(F.sum(sky.cast("int")).alias("_k"), F.count("*").alias("_n"))
    share = F.col("_k") / F.col("_n")
    h = rows.groupBy(*keys).agg(
        F.avg(F.when(F.col("y") < 10, share)).alias("_top"),
        F.min(F.when(share < 0.15, F.col("y"))).alias("_row"))
    return h.select(*keys, F.when(F.col("_top") >= 0.3, F.col("_row")).alias("horizon_row"))


def frame_statistics(px: DataFrame, keys=SCENE) -> DataFrame:
    """Per-frame numbers the fusion labeller needs before any filter runs."""
    ndwi_n = clip((ndwi() + 1) / 2)
    nir = histogram(px, keys, "nir")
    nir_p = nir.groupBy(*keys).agg(
        F.percentile(F.col("v").cast("double"), F.array(F.lit(.02), F.lit(.98)), F.col("n"))
        .alias("_p"), (F.max("v") - F.min("v")).cast("double").alias("nir_range"))
    levels = px.groupBy(*keys, F.floor(ndwi_n * 255).cast("int").alias("v")).agg(
        F.count("*").alias("n"))
    cut = otsu(levels, keys).select(*keys, (F.col("cut") / 255.0).alias("ndwi_cut"))
    size = px.groupBy(*keys).agg(F.max("h").alias("h"), F.max("w").alias("w"))
    return (size.join(nir_p, list(keys)).join(cut, list(keys)).join(horizon_rows(px, keys), list(keys))
            .select(*keys, "h", "w", "nir_range", "ndwi_cut", "horizon_row",
                    F.col("_p")[0].alias("nir_lo"), F.col("_p")[1].alias("nir_hi")))


def fusion_probability(px: DataFrame, params: FusionParams = FusionParams(), keys=SCENE,
                       tile: int = TILE) -> DataFrame:
    """Water probability of every pixel: ``prob``, and the 0/1 guards ``snow`` and ``spec``.

    Frames run as tile arrays (``tile_labellers``); this is their form as pixel rows.
    """
    d = TL.fusion_probability(packed(px, BANDS, keys, tile=tile), params, keys, tile)
    return unpack(d, {"prob": "double", "snow": "int", "spec": "int"}, keys, tile)


def spectral_fusion(px: DataFrame, params: FusionParams = FusionParams(), keys=SCENE,
                    tile: int = TILE) -> DataFrame:
    """NIR gate times weighted cues, thresholded, large components kept, filled, opened once."""
    d = TL.spectral_fusion(packed(px, BANDS, keys, tile=tile), params, keys, tile)
    return unpack(d, {"prob": "double", "snow": "int", "spec": "int", "m": "int"}, keys, tile)


def fusion_report(labelled: DataFrame, stats: DataFrame, thresh: float = 0.5, keys=SCENE) -> DataFrame:
    """One row per frame: the numbers a reviewer sees next to a fused mask.

    ``stats`` are the frame statistics of the same frames.
    """
    n = F.count("*")
    d = labelled.groupBy(*keys).agg(
        F.round(F.sum("snow") / n, 4).alias("snow_guard_frac"),
        F.round(F.sum("spec") / n, 4).alias("specular_frac"),
        F.round(100 * F.sum("m") / n, 2).alias("water_pct"))
    return d.join(stats, list(keys)).select(
        *keys, F.round("ndwi_cut", 3).alias("ndwi_otsu"), F.round("nir_range", 1).alias("nir_dyn_range"),
        (F.col("nir_range") > 12).alias("nir_reliable"), "snow_guard_frac", "specular_frac",
        "horizon_row", F.lit(round(thresh, 3)).alias("prob_thresh"), "water_pct",
        F.lit("none").alias("refine"))


MASK_COLUMNS = ("h", "w", "y", "x", "m")


def nir_threshold(px: DataFrame, threshold: float = 0.25, opens: int = 2, keys=SCENE,
                  tile: int = TILE) -> DataFrame:
    """Water is NIR below a share of the frame's range. A flat frame gives no mask."""
    return unpack(TL.nir_threshold(packed(px, ("nir",), keys, tile=tile), threshold, opens, keys, tile), {"m": "int"}, keys, tile)


def flat_nir_scenes(px: DataFrame, keys=SCENE) -> DataFrame:
    return px.groupBy(*keys).agg(F.min("nir").alias("_lo"), F.max("nir").alias("_hi")).filter(
        "_hi = _lo").select(*keys, F.lit("nir").alias("labeller"),
                            F.lit("flat nir").alias("error"))


def thermal_otsu(px: DataFrame, keys=SCENE, tile: int = TILE) -> DataFrame:
    """Water is below the Otsu cut of both the thermal and the NIR band."""
    return unpack(TL.thermal_otsu(packed(px, ("th", "nir"), keys, tile=tile, gaps=True), keys, tile), {"m": "int"}, keys, tile)


def sibling_frames(scenes: DataFrame, k: int = 6, at_least: int = 3) -> DataFrame:
    """The first ``k`` other frames of the same view by name: ``scene_id, ref_id``.

    A frame's first ``k`` siblings are among the first ``k + 1`` names of its folder, so folders are
    ranked once and only those few names meet all frames of the folder. Views with fewer than
    ``at_least`` siblings give nothing.
    """
    by_name = Window.partitionBy("parent").orderBy("name", "scene_id")
    first = (scenes.withColumn("_rn", F.row_number().over(by_name)).filter(F.col("_rn") <= k + 1)
             .groupBy("parent").agg(F.sort_array(F.collect_list(
                 F.struct("_rn", F.col("scene_id").alias("id")))).alias("_first")))
    size = scenes.groupBy("parent").agg((F.count("*") - 1).alias("_n"))
    refs = F.slice(F.filter("_first", lambda s: s["id"] != F.col("scene_id")), 1, k)
    return (scenes.join(first, "parent").join(size, "parent").filter(F.col("_n") >= at_least)
            .select("scene_id", F.explode(refs).alias("_r")).select(
                "scene_id", F.col("_r.id").alias("ref_id")))


def background(px: DataFrame, scenes: DataFrame, k: int = 6, at_least: int = 3, tile: int = TILE) -> DataFrame:
    """Per-pixel median of each frame's sibling frames; ``scenes`` has ``scene_id, parent, name``."""
    d = BG.with_background(packed(px, BG.BACKED, tile=tile), scenes, k, at_least, tile)
    return unpack(d, {f"bg_{b}": "double" for b in BG.BACKED}, tile=tile).drop("h", "w")


def change_labeller(px: DataFrame, scenes: DataFrame, cut: float = 0.55, k: int = 6, at_least: int = 3, tile: int = TILE) -> DataFrame:
    """Pixels that turned dark in NIR and wet in NDWI since the dry background of their view."""
    d = BG.change_labeller(packed(px, ("r", "g", "b", "nir"), tile=tile), scenes, cut, k, at_least, tile)
    return unpack(d, {"m": "int"}, tile=tile)


def labeller_errors(px: DataFrame, scenes: DataFrame, at_least: int = 3) -> DataFrame:
    """``scene_id, labeller, error`` of frames that a labeller cannot decide."""
    return flat_nir_scenes(px).unionByName(BG.few_siblings(scenes, at_least))


def snap_to_edges(px: DataFrame, coarse: DataFrame, radius: int = 8, eps: float = 1e-4,
                  keys=SCENE, tile: int = TILE) -> DataFrame:
    """Guided filter of the fused probability with the photo's grey, then a percentile cut.

    ``coarse`` has ``m`` and ``prob``. A frame whose refined mask would be empty keeps the coarse
    one. The guide is in [0, 1].
    """
    on = [*keys, "y", "x"]
    d = px.select(*on, "h", "w", (F.round(grey()) / 255.0).alias("_i")).join(
        coarse.select(*on, "m", clip(F.greatest("prob", F.col("m").cast("double"))).alias("_p")), on)

    def guided(planes):
        i, p, n = planes["_i"], planes["_p"], (2 * radius + 1) ** 2
        mi, mp = box_sum(i, radius) / n, box_sum(p, radius) / n
        a = (box_sum(i * p, radius) / n - mi * mp) / (box_sum(i * i, radius) / n - mi * mi + eps)
        b = mp - a * mi
        return {"_f": (box_sum(a, radius) * i + box_sum(b, radius)) / n}

    d = filter_tiles(d, guided, ["_i", "_p"], {"_f": "double"}, 2 * radius, keys, tile, mirror=True)
    d = d.select(*on, "h", "w", "m", F.round("_f", 6).alias("filtered"))
    cut = exact_percentiles(d.filter("m = 1"), keys, "filtered", {"_q": 0.30})
    scene = d.groupBy(*keys).agg(F.max("filtered").alias("_top"), F.max("h").alias("h"),
                                 F.max("w").alias("w")).join(cut, list(keys), "left")
    level = F.greatest(F.lit(0.4), F.coalesce("_q", F.lit(0.5)))
    fine = (F.col("filtered") >= level).cast("int")
    return join_scene_stats(d, scene, keys, tile).select(
        *keys, "h", "w", "y", "x",
        F.when(F.col("_top") >= level, fine).otherwise(F.col("m")).alias("m"),
        F.when(F.col("_top") >= level, "guided").otherwise("none").alias("refine"))


def spread_points(cand: DataFrame, weight: str, n: int = 8, grid: int = 6, keys=SCENE) -> DataFrame:
    """The best candidate of each cell of a ``grid`` over the candidates' extent, then the top n.

    Ties go to the first pixel in reading order within a cell. The cell winner is an aggregate, so
    a frame of any size is combined on the map side; at most ``grid^2`` rows per frame are ranked.
    """
    ext = cand.groupBy(*keys).agg((F.max("y") + 1).alias("_h"), (F.max("x") + 1).alias("_w"),
                                  F.max("h").alias("h"), F.max("w").alias("w"))
    c = join_scene_stats(cand, ext, keys).withColumn("_cell", F.expr(
        f"(y * {grid} div _h) * {grid} + (x * {grid} div _w)"))
    best = c.groupBy(*keys, "_cell").agg(F.max_by(
        F.struct("y", "x", F.col(weight).alias("weight")),
        F.struct(F.col(weight), -F.col("y"), -F.col("x"))).alias("_b"))
    w = Window.partitionBy(*keys).orderBy(F.desc("weight"), F.desc("_cell"))
    return (best.select(*keys, "_cell", "_b.*").withColumn("rank", F.row_number().over(w))
            .filter(F.col("rank") <= n).select(*keys, "rank", "y", "x", "weight"))


def prompt_candidates(px: DataFrame, prob: DataFrame, keys=SCENE, tile: int = TILE) -> DataFrame:
    """Probability, stretched NIR and texture of each pixel: the material of prompt points."""
    on = [*keys, "y", "x"]
    d = px.select(*on, "h", "w", "nir", grey().alias("grey")).join(prob.select(*on, "prob"), on)

    def texture(planes):
        return {"tex": spread(planes["grey"], 7)}

    counts = (count_tiles(d, texture, ["grey"], {"tex": COUNTS}, 3, keys, tile, mirror=True)
              .unionByName(_counted(d, "nir", F.col("nir"), COUNTS, keys)))
    d = filter_tiles(d, texture, ["grey"], {"tex": "double"}, 3, keys, tile, mirror=True, drop=("grey",))
    size = px.groupBy(*keys).agg(F.max("h").alias("h"), F.max("w").alias("w"))
    stats = _bounds(counts, ("nir", "tex"), keys).join(size, list(keys))
    d = join_scene_stats(d, stats, keys, tile)
    score = 0.5 + 0.25 * _scaled("nir", F.col("nir")) + 0.25 * _scaled("tex", F.col("tex"))
    return d.select(*on, "h", "w", "prob", F.round(score, 9).alias("neg"))


def prompt_points(cand: DataFrame, n_pos: int = 8, n_neg: int = 8, keys=SCENE) -> DataFrame:
    """Positive (label 1) and negative (label 0) click points."""
    pos = spread_points(cand.filter("prob >= 0.8"), "prob", n_pos, keys=keys)
    neg = spread_points(cand.filter("prob <= 0.15"), "neg", n_neg, keys=keys)
    return pos.withColumn("label", F.lit(1)).unionByName(neg.withColumn("label", F.lit(0)))


def prompt_box(cand: DataFrame, keys=SCENE) -> DataFrame:
    """Extent of the 15x15 dilation of confident pixels; no row when there are none.

    Dilating by a square moves each side of the extent out by 7, cut at the frame.
    """
    e = cand.filter("prob >= 0.6").groupBy(*keys).agg(
        F.min("x").alias("a"), F.min("y").alias("b"), F.max("x").alias("c"), F.max("y").alias("d"),
        F.max("h").alias("h"), F.max("w").alias("w"))
    return e.select(*keys, F.greatest(F.lit(0), F.col("a") - 7).alias("x0"),
                    F.greatest(F.lit(0), F.col("b") - 7).alias("y0"),
                    F.least(F.col("w") - 1, F.col("c") + 7).alias("x1"),
                    F.least(F.col("h") - 1, F.col("d") + 7).alias("y1"))


# Fallback points and box as shares of width and height.
FALLBACK_POINTS = ((0.5, 0.75), (0.3, 0.85), (0.7, 0.85), (0.5, 0.93))
FALLBACK_BOX = (0.10, 0.42, 0.90, 0.98)


def with_fallback(frames: DataFrame, points: DataFrame, box: DataFrame, keys=SCENE
                  ) -> tuple[DataFrame, DataFrame]:
    """Add lower-centre points and swap the box where the prior is too weak to prompt with.

    Weak: fewer than 3 positive points, no box, or a box share below .04 or above .92.
    """
    n = points.groupBy(*keys).agg(F.sum("label").alias("_pos"))
    f = frames.select(*keys, "h", "w").join(n, list(keys), "left").join(box, list(keys), "left")
    share = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) / (F.col("h") * F.col("w"))
    weak = ((F.coalesce("_pos", F.lit(0)) < 3) | F.col("x0").isNull() | (share < 0.04)
            | (share > 0.92))
    f = f.withColumn("used_fallback", weak)

    def at(size: str, s: float) -> Column:
        return F.floor(F.col(size) * s).cast("int")

    extra = F.array(*[F.struct((F.lit(100 + i)).alias("rank"), at("h", sy).alias("y"),
                               at("w", sx).alias("x"), F.lit(None).cast("double").alias("weight"),
                               F.lit(1).alias("label")) for i, (sx, sy) in enumerate(FALLBACK_POINTS)])
    more = f.filter("used_fallback").select(*keys, F.explode(extra).alias("_e")).select(*keys, "_e.*")
    bx = f.select(*keys, "used_fallback", *[
        F.when(F.col("used_fallback"), at(side, s)).otherwise(F.col(c)).alias(c)
        for c, side, s in zip(("x0", "y0", "x1", "y1"), ("w", "h", "w", "h"), FALLBACK_BOX)])
    return points.unionByName(more), bx


LABELLERS: dict[str, Callable[..., DataFrame]] = {
    "spectral": spectral_fusion,
    "nir": nir_threshold,
    "thermal": thermal_otsu,
    "change": change_labeller,
}


def run_labeller(name: str, px: DataFrame, **params) -> DataFrame:
    """Run one registered labeller; ``source`` names it in the result."""
    if name not in LABELLERS:
        raise KeyError(f"no labeller {name}; there are {', '.join(LABELLERS)}")
    m = LABELLERS[name](px, **params)
    return m.select(*SCENE, F.lit(name).alias("source"), *MASK_COLUMNS)

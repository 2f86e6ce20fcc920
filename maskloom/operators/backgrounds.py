"""Backgrounds of views from the frames taken of them at other times, kept per folder.

A frame's background is the median of the first ``k`` other frames of its folder by name. Those are the
folder's first ``k + 1`` names without the frame itself, so a folder has at most ``k + 1`` different
backgrounds: one per name left out. They are formed once, from the sorted values of each pixel, and
frames look theirs up. Work and rows follow the folders and the sizes of their frames, not frames times k.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from maskloom.operators import tilearrays as A
from maskloom.operators.neighbourhood import gauss, gauss_radius, sobel_length
from maskloom.operators.raster import bilinear
from maskloom.operators.tile_labellers import COUNTS, _by_frame, _histograms, _meet, _unit, counted, grey_of, percentile, tidy
from maskloom.operators.tiles import SCENE, TILE
from maskloom.session import durable

BACKED = ("nir", "g")
COPY_FRAMES = 2048      # frames that share one copy of a folder's background in a join


def left_out(scenes: DataFrame, k: int = 6, at_least: int = 3) -> tuple[DataFrame, DataFrame]:
    """Frames with their folder and the rank that their background leaves out, and each folder's first frames.

    Folders with fewer than ``at_least`` other frames are in neither. A folder is ranked by name with a
    limit, so a hot one sends only its first names to the ranking.
    """
    by_name = Window.partitionBy("parent").orderBy("name", "scene_id")
    first = durable(scenes.withColumn("rank", F.row_number().over(by_name)).filter(F.col("rank") <= k + 1)
                    .select("parent", "scene_id", "rank"))
    size = durable(scenes.groupBy("parent").agg(F.count("*").alias("_n")).filter(F.col("_n") > at_least))
    first = first.join(size, "parent")
    # A frame behind the first k + 1 leaves the last of them out.
    late = F.coalesce("rank", F.lit(k + 1))
    frames = scenes.join(size, "parent").join(first.select("scene_id", "rank"), "scene_id", "left")
    return (frames.select("scene_id", "parent", late.alias("rank"), (F.floor(F.col("_n") / COPY_FRAMES) + 1).alias("_copies")),
            first.select("parent", "scene_id", "rank"))


def few_siblings(scenes: DataFrame, at_least: int = 3) -> DataFrame:
    """Error rows of frames whose view has too few other frames."""
    size = scenes.groupBy("parent").agg((F.count("*") - 1).alias("siblings")).filter(F.col("siblings") < at_least)
    return scenes.join(size, "parent").select("scene_id", F.lit("change").alias("labeller"), F.lit("few siblings").alias("error"))


def _size() -> F.Column:
    return F.concat_ws("x", "h", "w").alias("size")


def folder_backgrounds(tiles: DataFrame, frames: DataFrame, first: DataFrame, k: int = 6, tile: int = TILE) -> DataFrame:
    """``parent, size, rank, ty, tx`` and ``bg_nir, bg_g``: a folder's median without its frame ``rank``,
    for every size of its frames. First frames of another size are resampled bilinearly; those without
    pixels are left out of all."""
    key = ["parent", "size"]
    sized = tiles.filter("ty = 0 and tx = 0").select("scene_id", "h", "w")
    targets = durable(frames.join(sized, "scene_id").select("parent", "h", "w").distinct())
    wanted = durable(first.join(sized, "scene_id").select("parent", "scene_id", "rank", F.col("h").alias("_h"), F.col("w").alias("_w"))
                     .join(targets, "parent").select("parent", "scene_id", "rank", F.col("h").alias("to_h"), F.col("w").alias("to_w"),
                                                     ((F.col("h") == F.col("_h")) & (F.col("w") == F.col("_w"))).alias("same")))
    found = tiles.select("scene_id", "h", "w", "ty", "tx", *BACKED).join(wanted, "scene_id")
    planes = ["h", "w", "ty", "tx", *BACKED]
    stacked = found.filter("same").select("parent", _size(), "rank", *planes)
    if not wanted.filter("not same").isEmpty():
        by = ["parent", "rank", "to_h", "to_w"]
        rows = A.unpack(found.filter("not same"), dict.fromkeys(BACKED, "double"), by, tile)
        rows = rows.select(*by, "h", "w", "y", "x", F.array(*BACKED).alias("v"))
        rows = bilinear(rows, "v", len(BACKED), F.col("to_h"), F.col("to_w"), by)
        rows = rows.select("parent", _size(), "rank", "h", "w", "y", "x", *[F.col("v")[i].alias(b) for i, b in enumerate(BACKED)])
        stacked = stacked.unionByName(A.pack(rows, BACKED, (*key, "rank"), tile))
    names = [*key, "rank", "h", "w", "ty", "tx", *[f"bg_{b}" for b in BACKED]]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stacked.select(*key).schema) + (
        ", rank int, h int, w int, ty int, tx int, " + ", ".join(f"bg_{b} binary" for b in BACKED))
    schema = A._arrow(ddl)

    def medians(rows: pa.Table) -> pa.Table:
        one = {c: rows[c][0].as_py() for c in (*key, "h", "w", "ty", "tx")}
        p = A.place_of(one["h"], one["w"], one["ty"], one["tx"], tile)
        ranks = rows["rank"].to_numpy()
        out = [{**one, "rank": r} for r in ranks.tolist()]
        if k + 1 not in ranks:  # later frames leave nothing out that has pixels
            out.append({**one, "rank": k + 1})
        for b in BACKED:
            stack = np.stack([A.unpack_plane(x, p.y1 - p.y0, p.x1 - p.x0).astype(np.float64) for x in rows[b].to_pylist()])
            order = np.argsort(stack, axis=0, kind="stable")
            values, n = np.take_along_axis(stack, order, 0), len(ranks) - 1
            at = np.empty_like(order)
            np.put_along_axis(at, order, np.arange(len(ranks)).reshape(-1, 1, 1), 0)  # each frame's place among the sorted
            for i in range(len(ranks)):
                # Without one value, those behind it move up by one.
                middle = [np.where(m < at[i], values[m], values[m + 1]) for m in ((n - 1) // 2, n // 2)]
                out[i][f"bg_{b}"] = A.pack_plane((middle[0] + middle[1]) / 2)
            if len(out) > len(ranks):
                out[-1][f"bg_{b}"] = A.pack_plane((values[n // 2] + values[(n + 1) // 2]) / 2)
        return pa.Table.from_pylist(out, schema)

    return stacked.groupBy(*key, "ty", "tx").applyInArrow(medians, ddl).select(*names)


def with_background(tiles: DataFrame, scenes: DataFrame, k: int = 6, at_least: int = 3, tile: int = TILE) -> DataFrame:
    """Tiles of frames with enough siblings, with ``bg_nir`` and ``bg_g``.

    Backgrounds are copied so that at most ``COPY_FRAMES`` frames share a join key.
    """
    frames, first = left_out(scenes, k, at_least)
    frames = durable(frames)
    made = durable(folder_backgrounds(tiles, frames, first, k, tile))
    # A folder with at most k + 1 frames leaves out ranks it has; a larger one has all k + 1.
    copies = durable(frames.select("parent", "_copies").distinct())
    spread = made.drop("h", "w").join(copies, "parent").withColumn("_copy", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1))).drop("_copies")
    numbers = frames.withColumn("_copy", F.pmod(F.xxhash64("scene_id"), "_copies")).drop("_copies")
    d = _meet(tiles, numbers, SCENE, tile).withColumn("size", F.concat_ws("x", "h", "w"))
    at = ["parent", "size", "rank", "_copy", "ty", "tx"]
    return d.join(spread, at).drop("parent", "size", "rank", "_copy")


def _change_numbers(bands) -> dict:
    return {f"{b}_{end}": percentile(*bands[b], q) for b in ("fall", "rise", "tex") for end, q in (("lo", 0.02), ("hi", 0.98))}


def change_score(tiles: DataFrame, scenes: DataFrame, k: int = 6, at_least: int = 3, tile: int = TILE) -> DataFrame:
    """NIR fall, NDWI rise and smoothness against the background: ``score`` of every tile."""
    halo = 1 + gauss_radius(2)

    def differ(p, at, row):
        nir, g, bg_nir, bg_g = (p[c].astype(np.float64) for c in ("nir", "g", "bg_nir", "bg_g"))
        rise = (g - nir) / (g + nir + 1e-6) - (bg_g - bg_nir) / (bg_g + bg_nir + 1e-6)
        return {"grey": grey_of(p), "fall": np.maximum(bg_nir - nir, 0.0), "rise": np.maximum(rise, 0.0)}

    def smooth(p, at, row):
        grey, wide = at.mirrored(p["grey"], halo)
        tex = wide.cut(gauss(sobel_length(grey), 2))
        own = {c: A.unpack_plane(row[c], *tex.shape) for c in ("fall", "rise")}
        return {"tex": tex, "counts": counted(fall=np.round(own["fall"], 2), rise=np.round(own["rise"], 4), tex=np.round(tex, 2))}

    def score(p, at, row):
        part = {c: _unit(p[c], row[f"{c}_lo"], row[f"{c}_hi"]) for c in ("fall", "rise", "tex")}
        return {"score": np.round(0.5 * part["fall"] + 0.35 * part["rise"] + 0.15 * (1 - part["tex"]), 9)}

    reads = ["r", "g", "b", "nir", "bg_nir", "bg_g"]
    d = A.map_tiles(with_background(tiles, scenes, k, at_least, tile), differ, reads, dict.fromkeys(("grey", "fall", "rise"), "binary"), tile=tile)
    found = durable(A.with_margin(d, smooth, ["grey"], {"tex": "binary", "counts": COUNTS}, halo, tile=tile, carry=("fall", "rise")))
    ddl = ", ".join(f"{b}_{end} double" for b in ("fall", "rise", "tex") for end in ("lo", "hi"))
    numbers = durable(_by_frame(_histograms(found, SCENE), _change_numbers, ddl, SCENE))
    return A.map_tiles(_meet(found.drop("counts"), numbers, SCENE, tile), score, ["fall", "rise", "tex"], {"score": "binary"}, tile=tile)


def change_labeller(tiles: DataFrame, scenes: DataFrame, cut: float = 0.55, k: int = 6, at_least: int = 3, tile: int = TILE) -> DataFrame:
    """Pixels that turned dark in NIR and wet in NDWI since the dry background; ``few_siblings`` names frames without one."""
    d = A.map_tiles(change_score(tiles, scenes, k, at_least, tile), lambda p, at, row: {"m": p["score"] > cut}, ["score"], {"m": "binary"}, tile=tile)
    return A.fill_holes(tidy(d, 1, 1, tile=tile), "m", "m", tile=tile)

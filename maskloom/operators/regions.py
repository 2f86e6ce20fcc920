"""Regions around many seeds: grown by value or by class.

The region of a seed is a component of the band of values within a tolerance of the seed's own. Bands
reach to both sides, so they don't nest like thresholds do; but seeds of a frame with the same value have
the same band. A frame is therefore labelled once per distinct value under its seeds (at most as many as
it has grey levels), however many seeds there are; each seed then looks its label up in its tile.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskloom.operators import tilearrays as A
from maskloom.operators.tile_labellers import _meet
from maskloom.operators.tiles import SCENE, TILE
from maskloom.session import durable


def _per_tile(seeds: DataFrame, keys) -> DataFrame:
    return seeds.groupBy(*keys, "ty", "tx").agg(F.collect_list(F.struct("seed", "y", "x")).alias("seeds"))  # seeds of a tile


def seed_regions(tiles: DataFrame, seeds: DataFrame, value: str, tolerance: float, keys=SCENE, tile: int = TILE
                 ) -> tuple[DataFrame, DataFrame]:
    """``keys, seed, level, comp, area`` of each seed, and ``keys, level, comp, y, x`` of the regions' pixels.

    ``seeds`` has ``keys, seed, y, x``. ``level`` is the value under the seed and ``comp`` the region's
    first pixel, ``y * w + x``. Seeds outside of the frames are left out; one on a missing value has the
    level NaN and a region of its own pixel alone.
    """
    def values(p, at, row):
        return {"found": [{**s, "level": float(p[value][s["y"] - at.y0, s["x"] - at.x0])} for s in row["seeds"]
                          if at.y0 <= s["y"] < at.y1 and at.x0 <= s["x"] < at.x1]}

    seed_type = seeds.schema["seed"].dataType.simpleString()
    placed = seeds.select(*keys, "seed", F.col("y").cast("int"), F.col("x").cast("int"), F.expr(f"int(y div {tile})").alias("ty"),
                          F.expr(f"int(x div {tile})").alias("tx"))
    under = A.map_tiles(tiles.join(_per_tile(placed, keys), [*keys, "ty", "tx"]), values, [value],
                        {"found": f"array<struct<seed:{seed_type},y:int,x:int,level:double>>"}, keys, tile)
    under = durable(under.select(*keys, "w", "ty", "tx", F.explode("found").alias("s")).select(*keys, "w", "ty", "tx", "s.*"))
    alone = under.filter(F.isnan("level")).withColumn("comp", F.col("y").cast("long") * F.col("w") + F.col("x"))
    under = under.filter(~F.isnan("level")).drop("w")
    levels = durable(under.groupBy(*keys).agg(F.collect_set("level").alias("levels")))  # values of a frame

    at_level = [*keys, "level"]
    met = _meet(tiles.select(*keys, "h", "w", "ty", "tx", value), levels, keys, tile).withColumn("level", F.explode("levels")).drop("levels")
    lab = A.components(met, lambda p, row: np.where(np.abs(p[value] - row["level"]) <= tolerance, 1, -1), [value], 4, at_level, tile)
    lab = durable(lab.drop(value))

    def look_up(p, at, row):
        regions = [row["regions"][p["labels"][s["y"] - at.y0, s["x"] - at.x0]] for s in row["seeds"]]
        return {"found": [{"seed": s["seed"], "comp": r["comp"], "area": r["area"]} for s, r in zip(row["seeds"], regions)]}

    here = [*at_level, "ty", "tx"]
    found = A.map_tiles(lab.join(_per_tile(under, at_level), here), look_up, ["labels"],
                        {"found": f"array<struct<seed:{seed_type},comp:bigint,area:bigint>>"}, at_level, tile)
    found = durable(found.select(*at_level, F.explode("found").alias("s")).select(*at_level, "s.*"))

    def of_seeds(p, at, row):
        names = np.array([r["comp"] for r in row["regions"]] + [-1], np.int64)
        return {"comp": np.where(np.isin(names, row["wanted"]), names, -1)[p["labels"]]}

    parts = lab.select(*here, F.explode("regions.comp").alias("comp"))
    wanted = parts.join(found.select(*at_level, "comp").distinct(), [*at_level, "comp"]).groupBy(*here).agg(
        F.collect_list("comp").alias("wanted"))  # regions of a tile
    planes = A.map_tiles(lab.join(wanted, here), of_seeds, ["labels"], {"comp": "binary"}, at_level, tile)
    pixels = A.unpack(planes, {"comp": "bigint"}, at_level, tile).filter("comp >= 0").select(*at_level, "comp", "y", "x")
    return (found.unionByName(alone.select(*at_level, "seed", "comp", F.lit(1).cast("long").alias("area"))),
            pixels.unionByName(alone.select(*at_level, "comp", "y", "x").distinct()))


def _pixels_of_seeds(df: DataFrame, seeds: DataFrame, value: str, tolerance: float, keys, tile: int) -> DataFrame:
    tiles = durable(A.pack(df, [value], keys, tile, gaps=True))
    found, pixels = seed_regions(tiles, seeds, value, tolerance, keys, tile)
    return found.join(pixels, [*keys, "level", "comp"]).select(*keys, "seed", "y", "x")


def grow_from_seeds(df: DataFrame, seeds: DataFrame, value: str, tolerance: float, keys=SCENE, tile: int = TILE) -> DataFrame:
    """4-connected region around each seed whose value is within ``tolerance`` of the seed's: ``keys, seed, y, x``."""
    return _pixels_of_seeds(df, seeds, value, tolerance, keys, tile)


def same_class_region(df: DataFrame, seeds: DataFrame, value: str = "cls", keys=SCENE, tile: int = TILE) -> DataFrame:
    """4-connected region of the class under each seed."""
    return _pixels_of_seeds(df, seeds, value, 0, keys, tile)

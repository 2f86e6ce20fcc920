"""Pixels per second of the raster operators: ``python bench_raster.py [frames] [side]``.

Frames are generated by hash, as in any load test; correctness is checked elsewhere.
"""

from __future__ import annotations

import json
import sys
import time

from pyspark.sql import functions as F

from bench import session
from maskloom.operators import components as C
from maskloom.operators import labellers as B
from maskloom.operators import neighbourhood as N
from maskloom.operators import statistics as ST
from maskloom.operators import tile_labellers as TL
from maskloom.operators import tilearrays as A
from maskloom.schemas import BANDS
from maskloom.session import scratch


def frames(spark, n: int, side: int):
    d = spark.range(n * side * side).select(
        F.expr(f"id div {side * side}").alias("scene_id"), F.lit(side).alias("h"), F.lit(side).alias("w"),
        F.expr(f"int(id % {side * side} div {side})").alias("y"), F.expr(f"int(id % {side})").alias("x"))
    wave = F.sin(F.col("x") / 17.0 + F.col("scene_id")) + F.cos(F.col("y") / 23.0)

    def band(k: int):
        return F.least(F.lit(255), F.greatest(F.lit(0), (
            128 + 50 * wave * (1 if k % 2 else -1) + F.pmod(F.xxhash64("scene_id", "y", "x", F.lit(k)), F.lit(40))
        ).cast("int"))).alias(("r", "g", "b", "th", "nir")[k])

    return d.select("*", *[band(k) for k in range(5)])


def main(argv):
    n, side = (int(argv[0]) if argv else 200), (int(argv[1]) if len(argv) > 1 else 256)
    spark = session()
    path = scratch(spark, "frames")
    frames(spark, n, side).repartition(32, "scene_id").sortWithinPartitions("scene_id", "y", "x").write.parquet(path)
    px = spark.read.parquet(path)
    stored = scratch(spark, "tiles")
    A.write_tiles(A.pack(px, BANDS), stored)
    tiles = A.read_tiles(spark, stored)
    mask = px.withColumn("m", (F.col("nir") < 120).cast("int")).drop("r", "g", "b", "th", "nir")
    jobs = {
        "histogram": lambda: ST.histogram(ST.band_long(px, ("th", "nir")), ["scene_id", "band"], "v"),
        "band_summary": lambda: ST.band_summary(px, ("r", "g", "b", "th", "nir")),
        "local_sd": lambda: N.local_sd(px.select("scene_id", "h", "w", "y", "x", "th"), "th", "s"),
        "ellipse_open": lambda: N.ellipse_open(mask, "m", "m"),
        "components": lambda: C.drop_small(mask, "m", "m", 0.003),
        "fill_holes": lambda: C.fill_holes(mask, "m", "m"),
        "nir_threshold": lambda: B.nir_threshold(px),
        "spectral_fusion": lambda: B.spectral_fusion(px),
        "tiles_nir_threshold": lambda: TL.nir_threshold(tiles),
        "tiles_thermal_otsu": lambda: TL.thermal_otsu(tiles),
        "tiles_spectral_fusion": lambda: TL.spectral_fusion(tiles, B.FusionParams()),
    }
    out = {}
    for name, job in jobs.items():
        t = time.perf_counter()
        job().write.format("noop").mode("overwrite").save()
        out[name] = round(n * side * side / (time.perf_counter() - t))
    print(json.dumps({"metric": "pixel_rows_per_second", "frames": n, "side": side, "jobs": out}))


if __name__ == "__main__":
    main(sys.argv[1:])

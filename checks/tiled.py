"""Queries of components and labellers once more with tiles of 4 pixels, against the same SQL.

Frames of 8x8 pixels are then four tiles each, so halos, tile borders and stitching have rows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import derived as D
from checks import registry
from checks.raster import AT, masks, seeds, waters
from maskloom.operators import components as C
from maskloom.operators import regions as RG
from maskloom.operators import labellers as B

TILE = 4


def tiled(name: str):
    def wrap(fn):
        registry.QUERIES[f"{name}_tiled"] = fn
        registry.SQL[f"{name}_tiled"] = registry.SQL[name]
        return fn
    return wrap


@tiled("n8_components")
def n8(spark, sf):
    d = waters(spark, sf).withColumn("on", F.when(F.col("m") == 1, 1))
    return C.components(d, "on", 8, tile=TILE).filter("comp is not null").select(*AT, "comp", "area")


@tiled("n8_area_filter")
def n8b(spark, sf):
    return C.drop_small(waters(spark, sf), "m", "m", 0.1, tile=TILE).select(*AT, "m")


@tiled("n9_fill_holes")
def n9(spark, sf):
    return C.fill_holes(waters(spark, sf), "m", "m", tile=TILE).select(*AT, "m")


@tiled("n10_relabel_region")
def n10(spark, sf):
    m = masks(spark, sf)
    return RG.same_class_region(m, seeds(m), tile=TILE)


@tiled("n11_class_cleanup")
def n11(spark, sf):
    return C.clean_class(masks(spark, sf), 1, tile=TILE).select(*AT, "cls")


@tiled("n12_spectral_fusion")
def n12(spark, sf):
    return B.spectral_fusion(D.px(spark, sf), tile=TILE).select(*AT, "m")


@tiled("n13_nir_threshold")
def n13(spark, sf):
    return B.nir_threshold(D.px(spark, sf), 0.6, 1, tile=TILE).select(*AT, "m")


@tiled("n14_thermal_otsu")
def n14(spark, sf):
    return B.thermal_otsu(D.px(spark, sf), tile=TILE).select(*AT, "m")

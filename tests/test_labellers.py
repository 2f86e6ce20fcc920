import random

import numpy as np
from pyspark.sql import functions as F

from maskloom.operators import labellers as B
from maskloom.operators import raster as R

random.seed(6)
H, W = 12, 14


def bands(seed):
    rng = np.random.default_rng(seed)
    wet = np.zeros((H, W), bool)
    wet[4:, 1:13] = True
    base = {"r": 110, "g": 120, "b": 100, "th": 140, "nir": 170}
    out = {k: rng.integers(v - 15, v + 15, (H, W)) for k, v in base.items()}
    out["nir"][wet] -= 130
    out["th"][wet] = rng.integers(60, 95, wet.sum())
    return {k: np.clip(v, 0, 255).tolist() for k, v in out.items()}


def test_any_tile_size_gives_the_same_mask(frame, plane):
    px = frame(**bands(1))
    for f in (B.spectral_fusion, B.nir_threshold):
        whole = plane(f(px, tile=64), "m")
        assert plane(f(px, tile=5), "m") == whole
        assert 0 < sum(map(sum, whole)) < H * W


def test_guided_snap_follows_an_edge(frame, plane):
    b = bands(2)
    for k in "rgb":
        b[k] = [[60 if y >= 5 and 3 <= x < 11 else 200 for x in range(W)] for y in range(H)]
    px = frame(**b)
    coarse = [[int(y >= 6 and 4 <= x < 10) for x in range(W)] for y in range(H)]
    prob = [[0.9 if c else 0.1 for c in row] for row in coarse]
    d = B.snap_to_edges(px, frame(m=coarse, prob=prob), radius=3)
    assert {r["refine"] for r in d.select("refine").distinct().collect()} == {"guided"}
    m = plane(d, "m")
    assert sum(map(sum, m)) > 0
    assert all(m[y][x] == 0 for y in range(3) for x in range(W))
    other = plane(B.snap_to_edges(px, frame(m=coarse, prob=prob), radius=3, tile=5), "m")
    assert other == m


def test_prompt_box_is_the_extent_of_the_dilation(spark, frame):
    prob = [[0.9 if (y, x) in ((8, 9), (10, 12)) else 0.0 for x in range(W)] for y in range(H)]
    box = B.prompt_box(frame(prob=prob)).first()
    assert (box["x0"], box["y0"], box["x1"], box["y1"]) == (2, 1, W - 1, H - 1)


def test_registry_names_its_labellers(frame):
    px = frame(**bands(3))
    assert B.run_labeller("nir", px).select("source").distinct().first()["source"] == "nir"
    try:
        B.run_labeller("none", px)
        raise AssertionError
    except KeyError:
        pass


def test_drawn_tiles_do_not_depend_on_layout(frame):
    m = frame(cls=[[int(x > 6) for x in range(W)] for y in range(H)])
    a = R.drawn_tiles(m, 6).collect()
    assert a == R.drawn_tiles(m.repartition(7, "x"), 6).collect()
    assert a[0]["share"] <= 0.85 or a[0]["draw"] >= 0
    assert R.drawn_tiles(m, 6).filter(F.col("top") > H - 6).count() == 0

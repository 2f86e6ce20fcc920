import random

import pytest

from maskloom.operators import neighbourhood as N
from maskloom.operators.agreement import pair_boundary_f1
from maskloom.operators.raster import bilinear, nearest, pad
from maskloom.operators.tiles import filter_tiles

random.seed(5)
H, W = 11, 13
IMAGE = [[float(random.randint(0, 255)) for _ in range(W)] for _ in range(H)]
MASK = [[int(random.random() < 0.6) for _ in range(W)] for _ in range(H)]


def fold(i, n):
    """Mirror index without repeating the border."""
    while not 0 <= i < n:
        i = -i if i < 0 else 2 * (n - 1) - i
    return i


def at(y, x):
    return IMAGE[fold(y, H)][fold(x, W)]


@pytest.mark.parametrize("tile", [3, 5, 64])
def test_linear_filters_match_brute_force_for_any_tile(frame, plane, tile):
    df = frame(v=IMAGE)
    g = plane(N.gradient(df, "v", "o", tile=tile), "o")
    s = plane(N.local_sd(df, "v", "o", 7, tile=tile), "o")
    b = plane(N.blur(df, "v", "o", 2, tile=tile), "o")
    k = N.gauss_weights(2)
    r = len(k) // 2
    for y in range(H):
        for x in range(W):
            gx = sum(w * (at(y + d, x + 1) - at(y + d, x - 1)) for d, w in ((-1, 1), (0, 2), (1, 1)))
            gy = sum(w * (at(y + 1, x + d) - at(y - 1, x + d)) for d, w in ((-1, 1), (0, 2), (1, 1)))
            assert g[y][x] == pytest.approx((gx * gx + gy * gy) ** .5, abs=1e-6)
            box = [at(y + i, x + j) for i in range(-3, 4) for j in range(-3, 4)]
            m = sum(box) / 49
            assert s[y][x] == pytest.approx((sum((v - m) ** 2 for v in box) / 49) ** .5, abs=1e-6)
            want = sum(k[i + r] * k[j + r] * at(y + i, x + j) for i in range(-r, r + 1) for j in range(-r, r + 1))
            assert b[y][x] == pytest.approx(want, abs=1e-6)


def ellipse_brute(m, grow):
    cells = [(i, j) for i in (-1, 0, 1) for j in range(-2, 3)] + [(-2, 0), (2, 0)]
    f = max if grow else min
    return [[f(m[y + i][x + j] for i, j in cells if 0 <= y + i < H and 0 <= x + j < W)
             for x in range(W)] for y in range(H)]


@pytest.mark.parametrize("tile", [4, 64])
def test_ellipse_open_and_close(frame, plane, tile):
    df = frame(m=MASK)
    o = MASK
    for g in (False, False, True, True):
        o = ellipse_brute(o, g)
    assert plane(N.ellipse_open(df, "m", "o", 2, tile=tile), "o") == o
    c = ellipse_brute(ellipse_brute(MASK, True), False)
    assert plane(N.ellipse_close(df, "m", "o", 1, tile=tile), "o") == c


def test_dilating_one_pixel_gives_nine(frame):
    m = [[int((y, x) == (2, 2)) for x in range(5)] for y in range(5)]
    assert N.square_filter(frame(m=m), "m", "o", 3, True).filter("o = 1").count() == 9


def test_chain_uses_one_exchange(frame):
    d = filter_tiles(frame(v=IMAGE), lambda p: {"o": N.gauss(N.sobel_length(p["v"]), 2)}, ["v"],
                     {"o": "double"}, 9, mirror=True)
    assert d._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_boundary_f1_hand_cases(spark, frame):
    empty = [[0] * 6 for _ in range(6)]
    blob = [[int(1 < y < 4 and 1 < x < 4) for x in range(6)] for y in range(6)]

    def score(a, b):
        from pyspark.sql import functions as F
        m = frame(m=a).withColumn("s", F.lit("a")).unionByName(frame(m=b).withColumn("s", F.lit("b")))
        return pair_boundary_f1(m, "s").first()["boundary_f1"]

    assert score(empty, empty) is None
    assert score(blob, empty) == 0.0
    assert score(blob, blob) == 1.0


def test_resampling(frame, plane):
    m = [[10 * y + x for x in range(4)] for y in range(4)]
    up = plane(nearest(frame(v=m), 8, 8), "v")
    assert up == [[10 * (y // 2) + x // 2 for x in range(8)] for y in range(8)]
    p = pad(frame(cls=m), {"cls": 255}, 5)
    assert p.count() == 25 and p.filter("cls = 255").count() == 9


def test_bilinear_matches_formula(spark, frame):
    from pyspark.sql import functions as F
    src = [[float(3 * y + x * x) for x in range(4)] for y in range(3)]
    d = frame(v=src).withColumn("p", F.array("v"))
    got = {(r["y"], r["x"]): r["p"][0] for r in bilinear(d, "p", 1, 5, 7, ["scene_id"]).collect()}
    assert len(got) == 35
    for (y, x), v in got.items():
        fy = min(max((y + .5) * 3 / 5 - .5, 0), 2)
        fx = min(max((x + .5) * 4 / 7 - .5, 0), 3)
        y0, x0 = min(int(fy), 1), min(int(fx), 2)
        a, b = fy - y0, fx - x0
        want = ((1 - a) * ((1 - b) * src[y0][x0] + b * src[y0][x0 + 1])
                + a * ((1 - b) * src[y0 + 1][x0] + b * src[y0 + 1][x0 + 1]))
        assert v == pytest.approx(want, abs=1e-9)

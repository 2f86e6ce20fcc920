"""Square tiles with a halo: the unit of work of every neighbourhood operator.

A frame is cut into tiles of fixed size and each tile also receives the pixels around it that its
filters read, so one hash exchange on ``(keys, tile)`` serves a whole filter chain, a task holds a
bounded number of rows, and one huge frame is spread like many small ones. Results do not depend on
the tile size. Inside a tile the filters are array arithmetic, which measured several times faster
than row and column windows over the same tiles.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TILE = 256
SCENE = ("scene_id",)
Planes = dict[str, np.ndarray]


def with_frame_size(df: DataFrame, keys=SCENE) -> DataFrame:
    """Add ``h`` and ``w`` where a pixel table does not carry them."""
    if "h" in df.columns and "w" in df.columns:
        return df
    size = df.groupBy(*keys).agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
    return df.join(size, list(keys))


def _span(c: str, halo: int, tile: int, size: str) -> Column:
    """Indices of the tiles that read coordinate ``c``."""
    return F.expr(f"sequence(greatest(0, {c} - {halo}) div {tile}, "
                  f"least({size} - 1, {c} + {halo}) div {tile})")


def _with_halo(df: DataFrame, halo: int, tile: int) -> DataFrame:
    return (df.withColumn("_ty", F.explode(_span("y", halo, tile, "h")))
            .withColumn("_tx", F.explode(_span("x", halo, tile, "w"))))


def _dense(rows: pa.Table, reads: list[str], halo: int, tile: int, mirror: bool):
    """Planes of one tile, which rows are its own, and where those rows are in a plane."""
    y, x = rows["y"].to_numpy(), rows["x"].to_numpy()
    y0, x0, y1, x1 = y.min(), x.min(), y.max(), x.max()
    h, w = rows["h"][0].as_py(), rows["w"][0].as_py()
    border = [(halo * (y0 == 0), halo * (y1 == h - 1)), (halo * (x0 == 0), halo * (x1 == w - 1))]
    planes = {}
    for c in reads:
        plane = np.zeros((y1 - y0 + 1, x1 - x0 + 1))
        plane[y - y0, x - x0] = rows[c].to_numpy()
        planes[c] = np.pad(plane, border, mode="reflect") if mirror and halo else plane
    if mirror and halo:
        y0, x0 = y0 - border[0][0], x0 - border[1][0]
    own = (y // tile == rows["_ty"][0].as_py()) & (x // tile == rows["_tx"][0].as_py())
    return planes, own, (y[own] - y0, x[own] - x0)


def _fields(df: DataFrame, names) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*names).schema)


def filter_tiles(df: DataFrame, chain: Callable[[Planes], Planes], reads: list[str],
                 writes: dict[str, str], halo: int, keys=SCENE, tile: int = TILE,
                 mirror: bool = False, drop=()) -> DataFrame:
    """Run ``chain`` over every tile: dense planes of ``reads`` in, planes of ``writes`` out.

    ``halo`` is the summed radius of the chain. ``mirror`` extends frames by reflection at their
    border, for linear filters; without it planes end at the border and minimum and maximum filters
    simply see nothing beyond. Other columns of ``df`` pass through, except those in ``drop``.
    """
    d = with_frame_size(df, keys)
    keep = [c for c in d.columns if c not in writes and c not in drop]
    schema = _fields(d, keep) + "".join(f", `{k}` {t}" for k, t in writes.items())

    def run(rows: pa.Table) -> pa.Table:
        planes, own, at = _dense(rows, reads, halo, tile, mirror)
        planes = chain(planes)
        out = rows.select(keep).filter(pa.array(own))
        for k, t in writes.items():
            v = planes[k][at]
            none = np.isnan(v) if v.dtype.kind == "f" else np.zeros(len(v), bool)  # a missing value was met
            out = out.append_column(k, pa.array(v if t == "double" else np.where(none, 0, v).astype(np.int32), mask=none))
        return out

    return _with_halo(d, halo, tile).groupBy(*keys, "_ty", "_tx").applyInArrow(run, schema)


def count_tiles(df: DataFrame, chain: Callable[[Planes], Planes], reads: list[str],
                digits: dict[str, int], halo: int, keys=SCENE, tile: int = TILE,
                mirror: bool = False) -> DataFrame:
    """Value counts of filtered planes: ``keys, band, v, n``, one row per tile and distinct value.

    Values are rounded to ``digits``. Counting happens in the tile, so a frame's pixels never leave
    it: what is shuffled next is a few thousand rows per tile.
    """
    d = with_frame_size(df, keys)

    def run(rows: pa.Table) -> pa.Table:
        planes, _, at = _dense(rows, reads, halo, tile, mirror)
        planes = chain(planes)
        parts = []
        for band, k in digits.items():
            v, n = np.unique(np.round(planes[band][at], k), return_counts=True)
            one = {c: pa.repeat(rows[c][0], len(v)) for c in keys}
            parts.append(pa.table({**one, "band": pa.repeat(pa.scalar(band), len(v)), "v": pa.array(v),
                                   "n": pa.array(n.astype(np.int64))}))
        return pa.concat_tables(parts)

    schema = _fields(d, keys) + ", band string, v double, n long"
    need = d.select(*keys, "h", "w", "y", "x", *reads)
    return _with_halo(need, halo, tile).groupBy(*keys, "_ty", "_tx").applyInArrow(run, schema)


def tile_key(df: DataFrame, tile: int = TILE) -> DataFrame:
    return df.withColumns({"_ty": F.expr(f"y div {tile}"), "_tx": F.expr(f"x div {tile}")})


def join_scene_stats(df: DataFrame, stats: DataFrame, keys=SCENE, tile: int = TILE) -> DataFrame:
    """Give every pixel its frame's statistics; ``stats`` carries ``h`` and ``w``.

    Statistics are first copied to each tile of their frame and meet the pixels on the tile, so one
    frame with a third of all pixels is spread over its tiles instead of one join key.
    """
    def tiles(size: str) -> Column:
        return F.explode(F.expr(f"sequence(0L, ({size} - 1) div {tile})"))

    per_tile = stats.withColumn("_ty", tiles("h")).withColumn("_tx", tiles("w")).drop("h", "w")
    return tile_key(df, tile).join(per_tile, [*keys, "_ty", "_tx"]).drop("_ty", "_tx")

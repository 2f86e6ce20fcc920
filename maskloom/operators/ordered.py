"""Ordered operators over groups of any size.

A plain window puts a whole group into one task. Here a group is cut into blocks by a monotone
expression of its order column; windows run inside blocks, and a small table of block totals
carries the running value from block to block. The caller picks a block width that keeps a block
well inside one task's memory; any width gives the same result. Null keys form a group like any
other, and rows without an order value come last in theirs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _at_block(d: DataFrame, side: DataFrame, on: list[str]) -> DataFrame:
    """``d`` with the columns of ``side`` (one row per block), null keys equal to each other."""
    s = side.withColumnsRenamed({c: f"_s_{c}" for c in on})
    same = F.lit(True)
    for c in on:
        same = same & F.col(c).eqNullSafe(F.col(f"_s_{c}"))
    return d.join(s, same, "left").drop(*[f"_s_{c}" for c in on])


def running(df: DataFrame, keys, block: Column, order, sums: dict[str, Column] | None = None,
            maxima: dict[str, Column] | None = None, whole: dict[str, str] | None = None
            ) -> DataFrame:
    """Inclusive running sums, and maxima over the rows before the current one.

    ``order`` must be total inside a group, and ``block`` must never decrease along it. ``whole``
    names columns for the group totals of some sums.
    """
    keys, sums, maxima, whole = list(keys), sums or {}, maxima or {}, whole or {}
    d = df.withColumns({"_blk": block, **{f"_in_{k}": v for k, v in {**sums, **maxima}.items()}})
    totals = d.groupBy(*keys, "_blk").agg(
        *[F.sum(f"_in_{k}").alias(f"_t_{k}") for k in sums],
        *[F.max(f"_in_{k}").alias(f"_t_{k}") for k in maxima])
    group = Window.partitionBy(*(keys or [F.lit(0)]))
    before = group.orderBy(F.col("_blk").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, "_blk",
        *[F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_o_{k}") for k in sums],
        *[F.max(f"_t_{k}").over(before).alias(f"_o_{k}") for k in maxima],
        *[F.sum(f"_t_{k}").over(group).alias(name) for k, name in whole.items()])
    w = Window.partitionBy(*keys, "_blk").orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    prior = w.rowsBetween(Window.unboundedPreceding, -1)
    j = _at_block(d, offsets, [*keys, "_blk"]).withColumns({
        **{k: F.col(f"_o_{k}") + F.sum(f"_in_{k}").over(upto) for k in sums},
        **{k: F.greatest(f"_o_{k}", F.max(f"_in_{k}").over(prior)) for k in maxima}})
    return j.drop("_blk", *[f"_in_{k}" for k in (*sums, *maxima)], *[f"_o_{k}" for k in (*sums, *maxima)])


def ranked(df: DataFrame, keys, block: Column, order, out: str = "rank",
           size: str | None = None) -> DataFrame:
    """Position in the group from 1, and optionally the group's size."""
    return running(df, keys, block, order, {out: F.lit(1)}, whole={out: size} if size else None)


def neighbours(df: DataFrame, keys, block: Column, order, carry: dict[str, Column],
               ahead: bool = False) -> DataFrame:
    """Values of the previous (or next) row of the group, across block borders."""
    keys = list(keys)
    d = df.withColumns({"_blk": block, **{f"_in_{k}": v for k, v in carry.items()}})
    w = Window.partitionBy(*keys, "_blk").orderBy(*order)
    pick = F.lead if ahead else F.lag
    edge = F.min_by if ahead else F.max_by
    last = d.groupBy(*keys, "_blk").agg(edge(
        F.struct(*[F.col(f"_in_{k}") for k in carry]),
        F.struct(*[o for o in order])).alias("_e"))
    wb = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(F.col("_blk").asc_nulls_last())
    near = last.select(*keys, "_blk", pick("_e").over(wb).alias("_e"))
    has = pick(F.lit(1)).over(w).isNotNull()
    j = _at_block(d, near, [*keys, "_blk"]).withColumns({
        k: F.when(has, pick(f"_in_{k}").over(w)).otherwise(F.col(f"_e._in_{k}")) for k in carry})
    return j.drop("_blk", "_e", *[f"_in_{k}" for k in carry])

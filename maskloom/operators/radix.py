"""Exact ranks, quantiles and top shares over values of any distribution.

Values are dealt to blocks by the leading bits (or characters) they sort by. A block with too many rows
and more than one value is narrowed by its next bits; each level counts only the blocks narrowed before
it. The blocks of a group follow each other as their values do, so block totals carry ranks, and only
the block that holds a wanted rank is looked into. A block beyond the row limit holds one value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskloom.operators.ordered import _at_block, ranked
from maskloom.session import durable

BLOCK_ROWS = 100_000        # rows beyond which a block is narrowed
MOST_NARROWED = 100_000     # blocks narrowed per level: the limit grows with the rows to keep to this
FIRST_SHIFT, DIGIT = 48, 12  # bits left out by the first prefix, bits a level adds
CHARACTERS = 3              # characters a level adds


def sortable_bits(value: Column) -> Column:
    """A double as a long that sorts as the double does: its bits, negated for negative values.

    Exponent and fraction are found by exact divisions by powers of two. NaN and infinity share the
    place of the largest finite value, both zeros share one.
    """
    a = F.least(F.abs(value), F.lit(float.fromhex("0x1.fffffffffffffp+1023")))
    guess = F.greatest(F.lit(-1022.0), F.least(F.lit(1023.0), F.floor(F.log2(a))))
    share = a / F.pow(F.lit(2.0), guess)
    e = F.greatest(F.lit(-1022.0), guess + F.when(share >= 2, 1).when(share < 1, -1).otherwise(0))
    fraction = (a / F.pow(F.lit(2.0), e) * F.lit(float(1 << 52))).cast("long")
    bits = F.when(a == 0, F.lit(0).cast("long")).otherwise((e + 1022).cast("long") * F.lit(1 << 52) + fraction)
    return F.when(value < 0, -bits).when(value.isNotNull(), bits)


def _prefixes(df: DataFrame, value: str):
    """Function from a level to the block of ``value`` there, and the last level (None: no last one)."""
    kind = df.schema[value].dataType
    if isinstance(kind, T.StringType):
        return (lambda level: F.substring(value, 1, CHARACTERS * (level + 1))), None
    whole = isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    bits = F.col(value).cast("long") if whole else sortable_bits(F.col(value).cast("double"))

    def prefix(level: int) -> Column:
        shift = max(0, FIRST_SHIFT - DIGIT * level)
        return F.shiftleft(F.shiftright(bits, shift), shift)

    return prefix, FIRST_SHIFT // DIGIT


def blocks(df: DataFrame, keys, value: str, rows: int = BLOCK_ROWS, out: str = "_block") -> DataFrame:
    """Add ``out``, which never decreases along ``value`` (a number or a string) inside a group.

    Blocks hold at most ``rows`` rows or ``1 / MOST_NARROWED`` of all, or else one value; null values are
    a block of their own. ``df`` is read once per level, so it should be cheap to read.

    Narrowed blocks are told apart by a 64-bit hash: two that share one are both narrowed, which moves no
    value out of order. Their table holds at most ``MOST_NARROWED`` longs, so it is broadcast.
    """
    keys = list(keys)
    prefix, last = _prefixes(df, value)
    d, level, limit = df.withColumn(out, prefix(0)), 0, None
    met = d
    while level != last:
        sizes = durable(met.groupBy(*keys, out).agg(
            F.count("*").alias("_n"), F.min(value).alias("_lo"), F.max(value).alias("_hi")))
        if limit is None:
            limit = max(rows, -(-(sizes.agg(F.sum("_n")).first()[0] or 0) // MOST_NARROWED))
        mark = F.xxhash64(*keys, out, F.lit(level))
        wide = durable(sizes.filter((F.col("_n") > limit) & (F.col("_lo") < F.col("_hi"))).select(mark.alias("_mark")).distinct())
        if wide.isEmpty():
            break
        level += 1
        found = d.join(F.broadcast(wide), mark == F.col("_mark"), "left")
        met = found.filter("_mark is not null").withColumn(out, prefix(level)).drop("_mark")
        d = found.withColumn(out, F.when(F.col("_mark").isNotNull(), prefix(level)).otherwise(F.col(out))).drop("_mark")
    return d


def _group(keys) -> list:
    return list(keys) or [F.lit(0)]


def quantile(df: DataFrame, keys, value: str, at: float, out: str, rows: int = BLOCK_ROWS) -> DataFrame:
    """``keys, out, n``: the quantile of each group, interpolated between the two ranks around it.

    Values are counted first. Null values are left out; a group without others has no row.
    """
    keys = list(keys)
    c = durable(df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_k")))
    b = blocks(c, keys, value, rows)
    totals = b.groupBy(*keys, "_block").agg(F.sum("_k").alias("_t"))
    group = Window.partitionBy(*_group(keys))
    place = (F.col("n") - 1) * F.lit(float(at))
    near = totals.withColumns({
        "_before": F.sum("_t").over(group.orderBy("_block")) - F.col("_t"), "n": F.sum("_t").over(group)}).filter(
        (F.col("_before") <= F.ceil(place)) & (F.col("_before") + F.col("_t") > F.floor(place))).drop("_t")
    inside = _at_block(b, near, [*keys, "_block"]).filter("n is not null")
    upto = F.col("_before") + F.sum("_k").over(Window.partitionBy(*keys, "_block").orderBy(value))
    picked = inside.withColumn("_upto", upto).groupBy(*keys, "n").agg(
        F.min(F.when(F.col("_upto") > F.floor(place), F.col(value))).alias("_a"),
        F.min(F.when(F.col("_upto") > F.ceil(place), F.col(value))).alias("_b"))
    low = F.floor(place)
    mean = F.when(F.col("_a") == F.col("_b"), F.col("_a").cast("double")).otherwise(
        (low + 1 - place) * F.col("_a") + (place - low) * F.col("_b"))
    return picked.select(*keys, mean.alias(out), "n")


def highest_share(df: DataFrame, keys, value: str, tie: str, share: float, out: str, rows: int = BLOCK_ROWS) -> DataFrame:
    """Add boolean ``out``: among the highest ``share`` of the group's rows (rounded half-even).

    Equal values are taken by ascending ``tie``, nulls come last. Whole blocks are in or out; a group has
    one block at most that the border runs through, and only its rows are ordered. If that block is one
    value, its rows are dealt to blocks of ``tie``, so copies of one value may be any share of the rows.
    """
    keys = list(keys)
    b = blocks(df, keys, value, rows)
    sizes = b.groupBy(*keys, "_block").agg(
        F.count("*").alias("_n"), F.coalesce(F.min(value) == F.max(value), F.lit(True)).alias("_same"))
    group = Window.partitionBy(*_group(keys))
    before = F.sum("_n").over(group.orderBy(F.col("_block").desc_nulls_last())) - F.col("_n")
    room = F.bround(F.sum("_n").over(group) * F.lit(float(share)), 0).cast("long") - before
    d = _at_block(b, sizes.withColumn("_room", room), [*keys, "_block"])
    border = (F.col("_room") > 0) & (F.col("_room") < F.col("_n"))
    plain = d.filter(~border).withColumn(out, F.col("_room") > 0)
    # Read again by each level of tie blocks.
    edge = blocks(durable(d.filter(border)), keys, tie, rows, "_tie").withColumn("_tie", F.when(F.col("_same"), F.col("_tie")))
    edge = ranked(edge, keys, F.col("_tie"), [F.col(value).desc_nulls_last(), F.col(tie)], "_rank")
    edge = edge.withColumn(out, F.col("_rank") <= F.col("_room"))
    return plain.select(*df.columns, out).unionByName(edge.select(*df.columns, out))

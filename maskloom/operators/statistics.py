"""Histograms, percentiles, Otsu cuts and per-scene band descriptors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskloom.functions.scalars import grey, ndwi
from maskloom.operators.tiles import SCENE


def band_long(px: DataFrame, bands) -> DataFrame:
    """One row per pixel and band: ``band, v``."""
    pairs = ", ".join(f"'{b}', {b}" for b in bands)
    keep = [c for c in px.columns if c not in bands]
    return px.selectExpr(*keep, f"stack({len(bands)}, {pairs}) AS (band, v)")


def histogram(df: DataFrame, keys, value: str) -> DataFrame:
    """Counts per key and value: at most 256 rows per key for band values."""
    return df.groupBy(*keys, F.col(value).alias("v")).agg(F.count("*").alias("n"))


def exact_percentiles(df: DataFrame, keys, value, qs: dict[str, float],
                      decimals: int | None = None) -> DataFrame:
    """Interpolated percentiles of a column, counted before they are collected.

    Values are first counted per key, so a hot key is combined on the map side and the final
    buffer holds distinct values only. Float maps are put on a grid of ``decimals`` digits, which
    bounds that number too.
    """
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    if decimals is not None:
        v = F.round(v, decimals)
    counted = df.groupBy(*keys, v.alias("_v")).agg(F.count("*").alias("_n"))
    names = list(qs)
    p = counted.groupBy(*keys).agg(
        F.percentile("_v", F.array(*[F.lit(qs[k]) for k in names]), F.col("_n")).alias("_p"))
    return p.select(*keys, *[F.col("_p")[i].alias(k) for i, k in enumerate(names)])


def moments(hist: DataFrame, keys) -> DataFrame:
    """Exact mean and population sd from a histogram; nulls are no values."""
    v = F.col("v").cast("long")
    s = hist.groupBy(*keys).agg(F.sum(F.when(v.isNotNull(), F.col("n"))).alias("n"), F.sum(v * F.col("n")).alias("_s"),
                                F.sum(v * v * F.col("n")).alias("_q"))
    mean = F.col("_s") / F.col("n")
    var = F.greatest(F.col("_q") / F.col("n") - mean * mean, F.lit(0.0))
    return s.select(*keys, "n", mean.alias("mean"), F.when(mean.isNotNull(), F.sqrt(var)).alias("sd"))


def discrete_percentiles(hist: DataFrame, keys, qs: dict[str, float]) -> DataFrame:
    """First value whose cumulative count reaches ``q`` of all. Windows hold 256 rows per key."""
    w = Window.partitionBy(*keys)
    n = F.sum(F.when(F.col("v").isNotNull(), F.col("n")))
    run = hist.withColumn("_c", n.over(w.orderBy("v"))).withColumn("_t", n.over(w))
    return run.groupBy(*keys).agg(
        *[F.min(F.when(F.col("_c") >= F.col("_t") * q, F.col("v"))).alias(k)
          for k, q in qs.items()])


def otsu(hist: DataFrame, keys) -> DataFrame:
    """Cut ``t`` with the largest between-class variance, lowest on ties, and its separability.

    Class 0 is ``v <= t``. The score ``N^2 * w0 * w1 * (m0 - m1)^2`` is formed as
    ``(N*s0 - n0*S)^2 / (n0*n1)`` from integer sums, so equal scores are equal numbers.
    """
    w = Window.partitionBy(*keys)
    v = F.col("v").cast("long")
    c = hist.select(
        *keys, "v",
        F.sum("n").over(w.orderBy("v")).alias("_n0"),
        F.sum(v * F.col("n")).over(w.orderBy("v")).alias("_s0"),
        F.sum("n").over(w).alias("_n"), F.sum(v * F.col("n")).over(w).alias("_s"),
        F.sum(v * v * F.col("n")).over(w).alias("_q"))
    n1 = F.col("_n") - F.col("_n0")

    def whole(name: str) -> Column:
        return F.col(name).cast("decimal(19,0)")

    dif = (whole("_n") * whole("_s0") - whole("_n0") * whole("_s")).cast("double")
    score = F.when(n1 > 0, dif * dif / (F.col("_n0").cast("double") * n1)).otherwise(0.0)
    best = c.groupBy(*keys).agg(
        F.max_by("v", F.struct(score.alias("a"), (-F.col("v")).alias("b"))).alias("cut"),
        F.max(score).alias("_b"), F.max("_n").alias("_n"), F.max("_s").alias("_s"),
        F.max("_q").alias("_q"))
    n = F.col("_n").cast("double")
    variance = F.col("_q") / n - (F.col("_s") / n) * (F.col("_s") / n)
    return best.select(*keys, F.col("cut").cast("int").alias("cut"),
                       (F.col("_b") / (n * n) / (variance + 1e-6)).alias("sep"))


def band_summary(px: DataFrame, bands, keys=SCENE) -> DataFrame:
    """Mean, population sd and the 5th, 50th and 95th percentile of each band."""
    long = band_long(px.select(*keys, *bands), bands)
    h = histogram(long, [*keys, "band"], "v")
    pct = h.groupBy(*keys, "band").agg(
        F.percentile(F.col("v").cast("double"), F.array(F.lit(.05), F.lit(.5), F.lit(.95)),
                     F.col("n")).alias("_p"))
    return (moments(h, [*keys, "band"]).join(pct, [*keys, "band"])
            .select(*keys, "band", "mean", "sd", *[F.col("_p")[i].alias(k)
                                                   for i, k in enumerate(("p5", "p50", "p95"))]))


def index_summary(px: DataFrame, keys=SCENE) -> DataFrame:
    """Mean, population sd and the 5th, 50th and 95th percentile of NDWI, from counts of its values."""
    h = px.groupBy(*keys, ndwi().alias("v")).agg(F.count("*").alias("n"))
    total = F.sum(F.when(F.col("v").isNotNull(), F.col("n")))
    mean = F.sum(F.col("v") * F.col("n")) / total
    square = F.sum(F.col("v") * F.col("v") * F.col("n")) / total
    d = h.groupBy(*keys).agg(mean.alias("mean"), F.when(mean.isNotNull(), F.sqrt(F.greatest(square - mean * mean, F.lit(0.0)))).alias("sd"),
                             F.percentile("v", F.array(F.lit(.05), F.lit(.5), F.lit(.95)), F.col("n")).alias("_p"))
    return d.select(*keys, "mean", "sd", *[F.col("_p")[i].alias(k) for i, k in enumerate(("p5", "p50", "p95"))])


def index_shares(px: DataFrame, cuts=(15, 25, 35), keys=SCENE) -> DataFrame:
    """Share of positive NDWI, and of pixels in the lowest 15, 25, 35 % of the NIR range.

    Counted per NIR value first, so the range and the shares come from one pass over pixels.
    """
    h = px.groupBy(*keys, F.col("nir").alias("v")).agg(
        F.count("*").alias("n"), F.sum((ndwi() > 0).cast("int")).alias("pos"), F.count(ndwi()).alias("known"))
    w = Window.partitionBy(*keys)
    lo, hi = F.min("v").over(w), F.max("v").over(w)
    scaled = h.withColumn("_u", (F.col("v") - lo) / (hi - lo + F.lit(1e-6)))
    there = F.when(F.col("_u").isNotNull(), F.col("n"))  # pixels without NIR count nowhere
    return scaled.groupBy(*keys).agg(
        F.try_divide(F.sum("pos"), F.sum("known")).alias("ndwi_pos_frac"),
        *[(F.sum(F.when(F.col("_u") < c / 100, there).otherwise(there * 0)) / F.sum(there))
          .alias(f"nir_dark_frac_{c}") for c in cuts])


def grey_entropy(px: DataFrame, keys=SCENE) -> DataFrame:
    """Entropy in bits of a 32-bin grey histogram on [0, 255]."""
    b = F.least(F.floor(grey() * 32 / 255), F.lit(31))
    h = px.groupBy(*keys, b.alias("bin")).agg(F.count("*").alias("n"))
    t = h.groupBy(*keys).agg(F.sum("n").alias("t"),
                             F.collect_list("n").alias("ns"))  # at most 32 counts
    p = F.transform("ns", lambda n: n / (F.col("t") + F.lit(1e-6)))
    e = -F.aggregate(p, F.lit(0.0), lambda a, q: a + q * F.log2(q))
    return t.select(*keys, e.alias("gray_entropy"))


def class_fractions(mask: DataFrame, keys=(), ignore: int = 255) -> DataFrame:
    """Share of each class among valid pixels."""
    h = mask.filter(F.col("cls") != ignore).groupBy(*keys, "cls").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(*(keys or [F.lit(0)])))  # one row per class
    return h.withColumn("total", total).withColumn("frac", F.col("n") / F.col("total"))


def class_weights(fracs: Column, classes: int, cap: float = 5.0) -> Column:
    """Inverse-frequency weights of an array of class shares, floored and capped.

    Fewer classes than shares folds the surplus into background first.
    """
    n = F.size(fracs)
    folded = F.when(n > classes, F.transform(
        F.slice(fracs, 1, classes),
        lambda f, i: F.when(i == 0, f + F.aggregate(
            F.slice(fracs, classes + 1, 99), F.lit(0.0), lambda a, v: a + v)).otherwise(f))
    ).otherwise(fracs)
    return F.transform(folded, lambda f: F.least(
        F.lit(cap), F.lit(1.0) / F.size(folded) / F.greatest(f, F.lit(1e-3))))


def binary_weights(water: Column, cap: float = 5.0) -> Column:
    """The two-class weights used when no class shares are known."""
    w = F.greatest(F.lit(1e-3), F.least(F.lit(0.999), water))
    return F.array(F.least(F.lit(cap), F.lit(0.5) / (1 - w)), F.least(F.lit(cap), F.lit(0.5) / w))


def band_error(a: DataFrame, b: DataFrame, bands, keys=SCENE) -> DataFrame:
    """Mean absolute difference of two sources of the same bands, over shared pixels."""
    on = [*keys, "y", "x"]
    j = a.select(*on, *[F.col(c).alias(f"_a_{c}") for c in bands]).join(
        b.select(*on, *[F.col(c).alias(f"_b_{c}") for c in bands]), on)
    return j.groupBy(*keys).agg(
        *[(F.sum(F.abs(F.col(f"_a_{c}").cast("long") - F.col(f"_b_{c}"))) / F.count("*"))
          .alias(f"mae_{c}") for c in bands])

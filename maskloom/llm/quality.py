"""Quality rules: base rules on a text's own counts, then robust multivariate outliers.

Each language and source gets a minimum-covariance-determinant estimate of location and scatter of
transformed statistics; a text far from it by Mahalanobis distance is rejected. Only DataFrame and
SQL functions are used.

The estimate covers all rows. A concentration step needs the three quarters of a cell's rows that
lie nearest to the current estimate. Rows are summed into bins of the logarithm of their squared
distance (count, sums, sums of products), a table of bounded size per cell that Spark aggregates
before it shuffles; the nearest bins are then added up to the new estimate. Steps start from the
classical and from a median-based estimate; the smaller determinant wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskloom.llm.store import hinted, keep

MIN_WORDS = 50
COVERAGE = 0.75       # share of a cell's rows that an estimate rests on
MIN_CELL = 50         # smaller cells of a language share one estimate, then all languages do
STEPS = 4             # concentration steps
BINS = 16             # bins per doubling of the squared distance
# Chi-square with 5 degrees of freedom at 0.5, and the cutoff, far out in its tail
# since statistics of sound prose have longer tails than a normal distribution.
CHI2_MEDIAN, CUTOFF = 4.3515, 120.0
# Smallest spread assumed of each transformed statistic.
FLOORS = (0.25, 0.08, 0.03, 0.05, 0.05)
STATS = ("x0", "x1", "x2", "x3", "x4")
N = len(STATS)
BLANKS = r"[\\x20\\x09-\\x0D]+"  # as written inside a SQL string


def word_counts(text: str = "_t") -> dict[str, str]:
    """SQL text of the base counts over column ``text`` (never null) and ``_w``, its words.

    Windows of three words are compared by a 64-bit hash; two different windows of one text
    collide with a chance of about n squared / 2**64.
    """
    windows = "transform(sequence(0, size(_w) - 3), i -> xxhash64(_w[i], _w[i + 1], _w[i + 2]))"
    return {
        "n_words": "cast(size(_w) as bigint)",
        "word_chars": f"cast(length(regexp_replace({text}, '{BLANKS}', '')) as bigint)",
        "n_symbols": f"cast(length({text}) - length(translate({text}, '#*$%&|<>', '')) as bigint)",
        "_lines": f"filter(split({text}, '\\\\n', -1), l -> translate(l, ' \\t\\n\\f\\r' || char(11), '') <> '')",
        "_h": f"case when size(_w) >= 3 then {windows} else cast(array() as array<bigint>) end",
    }


# Sorted (hash, position) pairs give the positions of repeated windows; a word counts once however
# many of them cover it.
_REPEATED = """case when size(_h) = size(array_distinct(_h)) then 0L else
  aggregate(
    sort_array(flatten(transform(array(sort_array(transform(_h, (h, i) -> struct(h, i)))), s ->
      transform(filter(s, (p, j) -> (j > 0 and s[j - 1].h = p.h) or (j < size(s) - 1 and s[j + 1].h = p.h)), p -> p.i)))),
    named_struct('n', 0L, 'end', -1),
    (a, i) -> named_struct('n', a.n + (i + 3 - greatest(i, a.end)), 'end', i + 3),
    a -> a.n) end"""


def base_counts(docs: DataFrame, carry: list[Column]) -> DataFrame:
    """``carry`` plus the base counts of every whole text; a null text has no words."""
    d = docs.select(*carry, F.coalesce("text", F.lit("")).alias("_t"))
    d = d.withColumn("_w", F.expr(f"filter(split(_t, '{BLANKS}'), w -> w <> '')"))
    names = [c for c in d.columns if c not in ("_t", "_w")]
    d = d.select(*names, *[F.expr(e).alias(n) for n, e in word_counts().items()])
    return d.select(*names, "n_words", "word_chars", "n_symbols",
                    F.expr("cast(size(_lines) - size(array_distinct(_lines)) as bigint)").alias("n_dup_lines"),
                    F.expr(_REPEATED).alias("n_repeat_words"), F.expr("size(_lines)").alias("_n_lines"))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (F.expr("100 * n_repeat_words > 50 * n_words"))


def _transformed() -> list[Column]:
    share = lambda a, b: F.sqrt(F.col(a) / F.greatest(F.col(b), F.lit(1)))
    return [c.alias(n) for n, c in zip(STATS, (
        F.log1p("n_words"), F.log1p(F.col("word_chars") / F.greatest("n_words", F.lit(1))),
        share("n_symbols", "word_chars"), share("n_dup_lines", "_n_lines"),
        share("n_repeat_words", "n_words")))]


def _pairs():
    return [(i, j) for i in range(N) for j in range(i + 1)]


def _moments(cond: Column | None = None) -> list[Column]:
    """Count, sums and sums of products, of all rows or of those that meet ``cond``."""
    x = [F.col(s) if cond is None else F.when(cond, F.col(s)) for s in STATS]
    n = F.count("*") if cond is None else F.count(F.when(cond, 1))
    return [n.alias("n"), *[F.sum(x[i]).alias(f"s{i}") for i in range(N)],
            *[F.sum(x[i] * x[j]).alias(f"p{i}{j}") for i, j in _pairs()]]


def _factor(d: DataFrame) -> DataFrame:
    """Moments to centre ``m*``, Cholesky factor ``l**`` and log determinant ``ld``.

    The squared smallest spreads are added to the diagonal, so the factor exists for any rows.
    """
    d = d.withColumns({f"m{i}": F.col(f"s{i}") / F.col("n") for i in range(N)})
    d = d.withColumns({f"c{i}{j}": F.col(f"p{i}{j}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}")
                       for i, j in _pairs()})
    for j in range(N):
        rest = sum((F.col(f"l{j}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))
        floor = F.lit(FLOORS[j] ** 2)
        d = d.withColumn(f"l{j}{j}", F.sqrt(F.greatest(F.col(f"c{j}{j}") + floor - rest, floor)))
        d = d.withColumns({f"l{i}{j}": (F.col(f"c{i}{j}") - sum(
            (F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))) / F.col(f"l{j}{j}")
            for i in range(j + 1, N)})
    return d.withColumn("ld", sum((F.log(f"l{j}{j}") for j in range(N)), F.lit(0.0)))


ESTIMATE = [f"m{i}" for i in range(N)] + [f"l{i}{j}" for i, j in _pairs()]


def squared_distance() -> Column:
    """Squared Mahalanobis distance by forward substitution with the Cholesky factor."""
    z: list[Column] = []
    for i in range(N):
        z.append((F.col(f"x{i}") - F.col(f"m{i}") - sum(
            (F.col(f"l{i}{k}") * z[k] for k in range(i)), F.lit(0.0))) / F.col(f"l{i}{i}"))
    return sum((v * v for v in z), F.lit(0.0))


def _binned(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    """Moments per cell, start and distance bin, with the count up to and with the bin."""
    d = rows.join(hinted(estimates, 100_000), "cell").withColumn(
        "bin", F.floor(F.log2(F.greatest(squared_distance(), F.lit(1e-6))) * BINS).cast("int"))
    binned = d.groupBy("cell", "start", "bin").agg(*_moments())
    w = Window.partitionBy("cell", "start")  # a few hundred bins
    return (binned.withColumn("upto", F.sum("n").over(w.orderBy("bin")))
            .withColumn("all", F.sum("n").over(w)))


def fit(rows: DataFrame) -> DataFrame:
    """``cell``, centre, factor and ``scale`` of each cell, from ``cell, x0..x4`` rows.

    ``scale`` makes the median squared distance that of a normal distribution.
    """
    classic = rows.groupBy("cell").agg(*_moments()).withColumn("start", F.lit(0))
    middle = rows.groupBy("cell").agg(*[F.percentile_approx(s, [0.25, 0.5, 0.75], 1000).alias(f"q{i}")
                                        for i, s in enumerate(STATS)])
    robust = middle.select("cell", F.lit(1).alias("start"), F.lit(1).alias("n"),
                           *[F.col(f"q{i}")[1].alias(f"s{i}") for i in range(N)],
                           *[(F.col(f"q{i}")[1] * F.col(f"q{j}")[1] + (
                               F.pow((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349, F.lit(2)) if i == j else 0))
                             .alias(f"p{i}{j}") for i, j in _pairs()])
    est = keep(_factor(classic.unionByName(robust)).select("cell", "start", *ESTIMATE), "mcd")
    for _ in range(STEPS):
        inner = F.col("upto") - F.col("n") < F.ceil(F.col("all") * COVERAGE)
        best = _binned(rows, est).filter(inner).groupBy("cell", "start").agg(
            F.sum("n").alias("n"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(N)],
            *[F.sum(f"p{i}{j}").alias(f"p{i}{j}") for i, j in _pairs()])
        est = keep(_factor(best).select("cell", "start", "ld", *ESTIMATE), "mcd")
    won = est.groupBy("cell").agg(F.min_by("start", F.struct("ld", "start")).alias("start"))
    est = est.join(won, ["cell", "start"])
    median = _binned(rows, est).filter(F.col("upto") * 2 >= F.col("all")).groupBy("cell").agg(
        (F.pow(F.lit(2.0), (F.min("bin") + 0.5) / BINS) / CHI2_MEDIAN).alias("scale"))
    return keep(est.join(median, "cell").select("cell", "scale", *ESTIMATE), "mcd")


def with_verdicts(docs: DataFrame, carry: list[Column]) -> DataFrame:
    """``carry``, the base counts, ``base_failed``, ``distance`` and ``kept``, one row per row."""
    counted = base_counts(docs, [*carry, F.col("lang").alias("_lang"), F.col("source").alias("_source")])
    rows = keep(counted.withColumn("base_failed", base_failed()).select("*", *_transformed()), "counts")
    cells = rows.filter(~F.col("base_failed")).groupBy("_lang", "_source").agg(F.count("*").alias("n"))
    lang = Window.partitionBy("_lang")  # one row per source
    poor = F.when(F.col("n") < MIN_CELL, F.col("n"))
    cells = cells.withColumn("pool", F.sum(poor).over(lang))
    name = F.when(F.col("n") >= MIN_CELL, F.to_json(F.struct("_lang", "_source"))).when(
        F.col("pool") >= MIN_CELL, F.to_json(F.struct("_lang"))).otherwise("{}")
    cells = keep(cells.select(F.col("_lang").alias("cl"), F.col("_source").alias("cs"), name.alias("cell")), "cells")
    placed = rows.join(cells, F.expr("_lang <=> cl and _source <=> cs"), "left").drop("cl", "cs")
    sound = placed.filter(~F.col("base_failed")).select("cell", *STATS)
    estimates = fit(sound)
    far = placed.join(estimates, "cell", "left").withColumn(
        "distance", F.when(~F.col("base_failed"), squared_distance() / F.greatest("scale", F.lit(1.0))))
    names = [c for c in rows.columns if c not in ("_lang", "_source", "_n_lines", *STATS)]
    return far.select(*names, F.sqrt("distance").alias("distance"),
                      (~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= CUTOFF)).alias("kept"))


def judge(docs: DataFrame) -> DataFrame:
    """Verdicts of ``documents`` rows: ``doc_id``, counts, ``base_failed``, ``distance``, ``kept``.

    Null text: no words, so it fails the base rules. Null language or source: a cell of its own.
    Repeated rows each get the same verdict. An empty table gives no rows. Only the columns
    ``doc_id, text, lang, source`` are read, whatever else the table holds.
    """
    return with_verdicts(docs, [F.col("doc_id")])


def passing(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    key = lambda: F.xxhash64("doc_id", "text", "lang", "source")
    verdicts = with_verdicts(docs, [key().alias("_key")])
    bad = keep(verdicts.filter(~F.col("kept")).select("_key").distinct(), "rejected")
    names = docs.columns
    return docs.select(F.struct("*").alias("_row"), key().alias("_key")).join(
        hinted(bad), "_key", "left_anti").select(*[F.col("_row")[n].alias(n) for n in names])

"""Spending a labelling budget: roll-outs, optimum, batch rules, cost and gain models, reports.

A queue is a short ordered list (a dozen images), so it travels as one array per queue and the
budget is a fold over it: one shuffle by queue, any number of policies.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskloom.functions.scalars import sha1_bucket
from maskloom.operators.ordered import neighbours, running
from maskloom.operators.radix import highest_share, quantile


def budget(n: Column | int, median_s: float, rho: float = 0.25, review_s: float = 0.0,
           reviews_included: bool = True) -> Column:
    """Seconds a queue of ``n`` images may use."""
    n = n if isinstance(n, Column) else F.lit(n)
    b = rho * n * median_s
    return b + (1 - rho) * n * review_s if reviews_included else b


def median_seconds(rows: DataFrame, seconds: str, keys=()) -> DataFrame:
    """Median of measured times, found by radix blocks of the distinct times."""
    return quantile(rows, keys, seconds, 0.5, "median_s")


def charged_seconds(scenes: DataFrame, measured: DataFrame, median_s: float) -> DataFrame:
    """A scene's own time where it was measured, else the median."""
    return scenes.join(measured, "scene_id", "left").withColumn(
        "charged_s", F.coalesce("manual_s", F.lit(median_s)))


def queues(steps: DataFrame, median_s: float, seed: int = 1) -> DataFrame:
    """One row per queue with its steps in order. Missing times are charged the median.

    ``u`` is a uniform draw in [0, 1) from a hash of seed, queue and step, the same for everyone.
    """
    cost = F.coalesce("manual_s", F.lit(median_s))
    key = F.concat_ws(":", F.lit(str(seed)), F.col("queue_id").cast("string"), F.col("t").cast("string"))
    draw = sha1_bucket(key, 1 << 20) / F.lit(1 << 20)
    size = F.count("*")
    score = F.col("ripu") if "ripu" in steps.columns else F.lit(None).cast("double")
    step = F.struct("t", "q", cost.alias("c"), score.alias("ripu"), draw.alias("u"), *(
        ["session"] if "session" in steps.columns else []))
    return steps.groupBy("queue_id").agg(F.sort_array(F.collect_list(step)).alias("steps"), size.alias("n"))


# A policy says MANUAL or not from (step, index, budget left); the budget must also be positive.
Policy = Callable[[Column, Column, Column], Column]


def all_auto() -> Policy:
    return lambda s, i, b: F.lit(False)


def first_come() -> Policy:
    return lambda s, i, b: F.lit(True)


def random_share(rho: float) -> Policy:
    return lambda s, i, b: s["u"] < rho


def score_threshold(tau) -> Policy:
    return lambda s, i, b: s["ripu"] >= tau


def score_rank(median_s: float, review_s: float) -> Policy:
    """MANUAL for an image among the best ``m`` still to come, ``m`` = labels the budget buys."""
    per = max(1e-9, median_s - review_s)

    def f(s, i, b):
        left = F.col("n") - i
        spare = F.greatest(F.lit(0.0), b - left * review_s)
        m = F.greatest(F.lit(1), F.ceil(spare / per))
        return s["ahead"] < m
    return f


def images_ahead(q: DataFrame) -> DataFrame:
    """Steps with ``i`` (place in the queue) and ``ahead`` (later images with a higher score)."""
    extra = ["session"] if "session" in _step_fields(q) else []
    return q.withColumn("steps", F.transform("steps", lambda s, i: F.struct(
        *[s[c].alias(c) for c in ("t", "q", "c", "ripu", "u", *extra)],
        F.size(F.filter(F.slice(F.col("steps"), i + 2, F.size("steps")),
                        lambda o: o["ripu"] > s["ripu"])).alias("ahead"), i.alias("i"))))


def roll_out(q: DataFrame, policies: dict[str, Policy], total: Column, median_s: float,
             review_s: float = 0.0, alpha: float = 100.0) -> DataFrame:
    """Follow every policy through every queue: return, seconds left, and the steps taken.

    Queues are assembled once; each policy walks the same array.
    """
    d = images_ahead(q).withColumns({
        "_b0": total.cast("double"), "policy": F.explode(F.array(*[F.lit(n) for n in policies]))})
    has_session = "session" in _step_fields(q)
    fields = "t int, manual boolean, q_used double, q_auto double, ratio double" + (
        ", session string" if has_session else "")
    start = F.struct(F.col("_b0").alias("b"), F.array().cast(f"array<struct<{_types(fields)}>>").alias("log"))

    def chosen(s, b) -> Column:
        pick = F.lit(False)
        for name, policy in policies.items():
            pick = F.when(F.col("policy") == name, policy(s, s["i"], b)).otherwise(pick)
        return pick

    def step(acc, s):
        manual = (acc["b"] > 0) & chosen(s, acc["b"])
        row = F.struct(
            s["t"].alias("t"), manual.alias("manual"),
            F.when(manual, F.lit(1.0)).otherwise(s["q"]).alias("q_used"), s["q"].alias("q_auto"),
            (acc["b"] / (F.lit(median_s) * (F.col("n") - s["i"]))).alias("ratio"),
            *([s["session"].alias("session")] if has_session else []))
        left = acc["b"] - F.when(manual, s["c"]).otherwise(F.lit(float(review_s)))
        return F.struct(left.alias("b"), F.concat(acc["log"], F.array(row)).alias("log"))

    d = d.withColumn("_r", F.aggregate("steps", start, step))
    ret = alpha * F.aggregate("_r.log", F.lit(0.0), lambda a, s: a + s["q_used"])
    return d.select("queue_id", "policy", ret.alias("ret"), F.col("_r.b").alias("left_s"),
                    F.col("_r.log").alias("log"))


def _step_fields(q: DataFrame) -> list[str]:
    return q.schema["steps"].dataType.elementType.names


def _types(fields: str) -> str:
    return ", ".join(":".join(f.split()) for f in fields.split(", "))


def tune_threshold(steps: DataFrame, grid: list[float], total: Column, median_s: float,
                   review_s: float = 0.0, alpha: float = 100.0) -> DataFrame:
    """Mean return of every threshold: ``tau, mean_return``; infinity is never. Queues of any length
    walk under each threshold; ``total`` may use the queue's length ``n``."""
    d = queues(steps, median_s).withColumns({"_b": total.cast("double"), "tau": F.explode(F.array(*[F.lit(t) for t in grid]))})

    def step(acc, s):
        manual = (acc["b"] > 0) & (s["ripu"] >= F.col("tau"))
        return F.struct((acc["b"] - F.when(manual, s["c"]).otherwise(F.lit(float(review_s)))).alias("b"),
                        (acc["g"] + F.when(manual, F.lit(1.0)).otherwise(s["q"])).alias("g"))

    start = F.struct(F.col("_b").alias("b"), F.lit(0.0).alias("g"))
    return d.groupBy("tau").agg((alpha * F.avg(F.aggregate("steps", start, step)["g"])).alias("mean_return"))


def best_threshold(tuned: DataFrame) -> DataFrame:
    """Largest mean return, the lower threshold on ties."""
    return tuned.agg(F.max_by("tau", F.struct(F.round("mean_return", 6), -F.col("tau"))).alias("tau"),
                     F.max("mean_return").alias("mean_return"))


def score_grid(steps: DataFrame, n: int = 21) -> list[float]:
    """Distinct quantiles of the score (fixed number of values), and infinity."""
    c = steps.groupBy("ripu").agg(F.count("*").alias("k"))
    qs = F.array(*[F.lit(i / (n - 1)) for i in range(n)])
    row = c.agg(F.percentile("ripu", qs, F.col("k")).alias("p")).first()
    return sorted(set(row["p"])) + [float("inf")]


def hindsight_optimum(steps: DataFrame, total: Column, median_s: float,
                      review_s: float = 0.0, alpha: float = 100.0) -> DataFrame:
    """Best return of each queue with everything known, for queues of any length.

    A fold over the queue keeps the states (seconds left, gain) that no other state beats in both;
    spent budgets are all alike. ``total`` may use the queue's length ``n``.
    """
    none = F.array().cast("array<struct<b:double,g:double>>")

    def undominated(states):
        best = F.struct(F.lit(float("-inf")).alias("top"), none.alias("kept"))
        return F.aggregate(F.sort_array(states, asc=False), best, lambda a, x: F.when(
            x["g"] > a["top"], F.struct(x["g"].alias("top"), F.concat(a["kept"], F.array(x)).alias("kept"))).otherwise(a),
            lambda a: a["kept"])

    def after(x, cost, gain):
        return F.struct(F.greatest(F.lit(0.0), x["b"] - cost).alias("b"), (x["g"] + gain).alias("g"))

    def step(states, s):
        by_hand = F.transform(F.filter(states, lambda x: x["b"] > 0), lambda x: after(x, s["c"], F.lit(1.0)))
        left = F.transform(states, lambda x: after(x, F.lit(float(review_s)), s["q"]))
        return undominated(F.concat(by_hand, left))

    d = queues(steps, median_s)
    start = F.array(F.struct(F.greatest(F.lit(0.0), total.cast("double")).alias("b"), F.lit(0.0).alias("g")))
    end = F.aggregate("steps", start, step)
    return d.select("queue_id", (alpha * F.array_max(F.transform(end, lambda x: x["g"]))).alias("optimum"))


# -- batch rules --------------------------------------------------------------------------------

# Action codes.
AUTO, MANUAL, SKIP = 0, 1, 2


def disagreement_rule(tau: float, iou: str = "iou_model_auto") -> Column:
    """A person where model and automatic mask disagree, the automatic mask elsewhere."""
    return F.when(F.col(iou) < tau, MANUAL).otherwise(AUTO)


def random_rule(key: Column, seed: int = 0) -> Column:
    return sha1_bucket(F.concat(F.lit(f"{seed}:"), key), 3).cast("int")


def uncertainty_rule(cand: DataFrame, batch: str, frac: float, skip_confident: bool = False,
                     tie: str = "scene_id") -> DataFrame:
    """The most uncertain share of each batch goes to a person. Batches may be of any size and their
    entropies of any distribution; ``cand`` is read once per level of blocks."""
    d = highest_share(cand, [batch], "entropy", tie, frac, "_top")
    rest = SKIP if skip_confident else AUTO
    return d.withColumn("action", F.when(F.col("_top"), MANUAL).otherwise(rest)).drop("_top")


def linear_actions(cand: DataFrame, features: list[str], auto_w: list[float], manual_w: list[float],
                   lam: float) -> DataFrame:
    """Score both labelling actions linearly, subtract the price of time, skip when neither pays."""
    x = F.array(*[F.col(f).cast("double") for f in features], F.lit(1.0))

    def value(w: list[float], minutes: str) -> Column:
        ws = F.array(*[F.lit(float(v)) for v in w])
        dot = F.aggregate(F.zip_with(x, ws, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
        return dot - lam * F.col(minutes)

    d = cand.withColumns({"value_auto": value(auto_w, "auto_min"),
                          "value_manual": value(manual_w, "manual_min")})
    top = F.greatest("value_auto", "value_manual", F.lit(0.0))
    return d.withColumn("action", F.when(top == 0.0, SKIP).when(F.col("value_auto") == top, AUTO)
                        .otherwise(MANUAL))


def step_rewards(steps: DataFrame, keys, alpha: float = 100.0, lam: float = 1.0, block: int = 1024
                 ) -> DataFrame:
    """Reward of each campaign step and the return so far: gain in score minus the price of time.

    ``steps`` has ``t, score, minutes``; step 0 is the start and earns nothing.
    """
    blk = F.floor(F.col("t") / block)
    d = neighbours(steps, keys, blk, [F.col("t")], {"_p": F.col("score")})
    r = F.when(F.col("_p").isNull(), 0.0).otherwise(
        alpha * (F.col("score") - F.col("_p")) - lam * F.col("minutes"))
    d = d.withColumn("reward", r).drop("_p")
    return running(d, keys, blk, [F.col("t")], {"return": F.col("reward")})


# -- models -------------------------------------------------------------------------------------


def gram(rows: DataFrame, features: list[str], target: str) -> DataFrame:
    """``X'X`` and ``X'y`` of a least-squares fit with intercept, in one aggregate: ``i, j, value``;
    ``j = -1`` holds the target."""
    cols = [F.lit(1.0)] + [F.col(f).cast("double") for f in features]
    y = F.col(target).cast("double")
    pairs = [(i, j, cols[i] * cols[j]) for i in range(len(cols)) for j in range(i, len(cols))]
    pairs += [(i, -1, c * y) for i, c in enumerate(cols)]
    wide = rows.filter(F.col(target).isNotNull()).agg(
        *[F.sum(v).alias(f"s{k}") for k, (_, _, v) in enumerate(pairs)])
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"s{k}").alias("value"))
                      for k, (i, j, _) in enumerate(pairs)])
    return wide.select(F.explode(cells).alias("_c")).select("_c.*")


def solve(cells: DataFrame) -> list[float]:
    """Coefficients from the few Gram cells."""
    got = {(r["i"], r["j"]): r["value"] for r in cells.collect()}
    d = 1 + max(i for i, _ in got)
    a = np.array([[got[min(i, j), max(i, j)] for j in range(d)] for i in range(d)])
    b = np.array([got[i, -1] for i in range(d)])
    return np.linalg.lstsq(a, b, rcond=None)[0].tolist()


def predicted_seconds(features: list[str], coef: list[float]) -> Column:
    """Linear time estimate; no label takes under a second."""
    v = F.lit(float(coef[0]))
    for f, c in zip(features, coef[1:]):
        v = v + float(c) * F.col(f)
    return F.greatest(F.lit(1.0), v)


def gain_statistics(batches: DataFrame, features: list[str], noise_sd: float = 3.3) -> DataFrame:
    """Sufficient statistics of the gain model: ``i, j, value`` with ``j = -1`` for ``x y``.

    ``batches`` holds one row per candidate with ``batch, action, gain``. A batch's design vector is
    the sum of its candidates' features (and 1) per labelling action. The table of products has a
    fixed number of rows, and partial sums form where batches are.
    """
    x = [F.col(f).cast("double") for f in features] + [F.lit(1.0)]
    sums = [F.sum(F.when(F.col("action") == a, v).otherwise(0.0)) for a in (AUTO, MANUAL) for v in x]
    d = batches.groupBy("batch").agg(F.array(*sums).alias("x"), F.max("gain").alias("y"))
    left = d.select("x", "y", F.posexplode("x").alias("i", "_v")).filter("_v <> 0")
    right = F.concat(F.transform("x", lambda v, j: F.struct(j.alias("j"), v.alias("v"))),
                     F.array(F.struct(F.lit(-1).alias("j"), F.col("y").cast("double").alias("v"))))
    cells = left.select("i", "_v", F.explode(right).alias("_r")).filter("_r.j = -1 or _r.j >= i")
    return cells.groupBy("i", F.col("_r.j").alias("j")).agg(
        (F.sum(F.col("_v") * F.col("_r.v")) / noise_sd ** 2).alias("value"))


# -- reports ------------------------------------------------------------------------------------


def step_log(rolled: DataFrame) -> DataFrame:
    return rolled.select("queue_id", "policy", F.explode("log").alias("_s")).select(
        "queue_id", "policy", "_s.*")


def policy_report(rolled: DataFrame, total: float) -> DataFrame:
    """MANUAL per queue, seconds used, overrun, recall of failed automatic masks, and the automatic
    quality of images sent either way."""
    s = step_log(rolled)
    m = F.col("manual").cast("int")
    per_step = s.groupBy("policy").agg(
        (F.sum(m) / F.count_distinct("queue_id")).alias("manual_per_queue"),
        F.avg(F.when(F.col("q_auto") < 0.5, m)).alias("failure_recall"),
        F.avg(F.when(F.col("manual"), F.col("q_auto"))).alias("q_manual"),
        F.avg(F.when(~F.col("manual"), F.col("q_auto"))).alias("q_auto"))
    per_queue = rolled.groupBy("policy").agg(
        F.avg("ret").alias("mean_return"), (total - F.avg("left_s")).alias("used_s"),
        F.avg(F.greatest(F.lit(0.0), -F.col("left_s"))).alias("overrun_s"))
    return per_queue.join(per_step, "policy")


# Lower ends of the budget bins, in median labels per remaining image.
BUDGET_BINS = (0.0, 0.25, 0.5, 0.75, 1.0, 1.5)


def manual_by_budget(rolled: DataFrame) -> DataFrame:
    """Share of MANUAL steps by budget left per remaining image, while any is left."""
    r = F.col("ratio")
    b = F.when(r < BUDGET_BINS[1], BUDGET_BINS[0])
    for lo, hi in zip(BUDGET_BINS[1:], BUDGET_BINS[2:]):
        b = b.when(r < hi, lo)
    return step_log(rolled).filter("ratio > 0").groupBy("policy", b.otherwise(BUDGET_BINS[-1]).alias("bin")).agg(
        F.avg(F.col("manual").cast("int")).alias("p_manual"), F.count("*").alias("n"))


def gain_by_session(rolled: DataFrame) -> DataFrame:
    """Mean quality gain over the automatic mask per image, times 100, by session."""
    return step_log(rolled).groupBy("policy", "session").agg(
        (100 * F.avg(F.col("q_used") - F.col("q_auto"))).alias("gain"))

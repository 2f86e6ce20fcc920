"""Labelling budgets, frame selection, cost and gain models."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import derived as D
from checks.experiments import rounded
from checks.labellers import PRED, predicted, water
from checks.log import hashed
from checks.raster import AT
from checks.registry import check
from maskloom.operators import decisions as L
from maskloom.operators import evaluation as V
from maskloom.operators import routing as R
from maskloom.operators import selection as C
from maskloom.operators import statistics as ST

MEDIAN, REVIEW, RHO, N = 24.0, 2.0, 0.25, 12
TOTAL = RHO * N * MEDIAN + (1 - RHO) * N * REVIEW
TAU = 0.25


def queue(spark, sf):
    return R.queues(D.queue_step(spark, sf), MEDIAN)


@check("r1_budgets", uses="queue_step", sql=f"""
SELECT queue_id, 0.25 * count(*) * {MEDIAN} + 0.75 * count(*) * {REVIEW} AS inclusive, 0.25 * count(*) * {MEDIAN} AS labels_only FROM queue_step GROUP BY 1""".replace(str(MEDIAN), f"{MEDIAN}::DOUBLE"))
def r1(spark, sf):
    q = queue(spark, sf)
    return q.select("queue_id", R.budget(F.col("n"), MEDIAN, RHO, REVIEW).alias("inclusive"),
                    R.budget(F.col("n"), MEDIAN, RHO, REVIEW, False).alias("labels_only"))


STEPS = f"""st AS MATERIALIZED (SELECT a.queue_id, a.t, a.q, coalesce(a.manual_s, {MEDIAN}::DOUBLE) AS c, a.ripu, a.session,
  (SELECT count(*) FROM queue_step b WHERE b.queue_id = a.queue_id AND b.t > a.t AND b.ripu > a.ripu) AS ahead,
  {hashed('sha1', "'1:' || a.queue_id || ':' || a.t", 1 << 20)} AS u, max(a.t) OVER (PARTITION BY a.queue_id) + 1 AS n FROM queue_step a),
bud AS (SELECT queue_id, n, {RHO}::DOUBLE * n * {MEDIAN} + {1 - RHO}::DOUBLE * n * {REVIEW} AS b FROM st WHERE t = 0),
pol AS (SELECT unnest(['all_auto', 'first_come', 'random', 'threshold', 'ranked']) AS policy),
walk AS (SELECT queue_id, policy, 0 AS t, b, 0.0::DOUBLE AS r, FALSE AS manual, 0.0::DOUBLE AS b_before FROM bud, pol
  UNION ALL SELECT w.queue_id, w.policy, w.t + 1, w.b - CASE WHEN d.manual THEN s.c ELSE {REVIEW}::DOUBLE END, w.r + CASE WHEN d.manual THEN 1.0 ELSE s.q END, d.manual, w.b
  FROM walk w JOIN st s ON s.queue_id = w.queue_id AND s.t = w.t,
  LATERAL (SELECT w.b > 0 AND CASE w.policy WHEN 'all_auto' THEN FALSE WHEN 'first_come' THEN TRUE WHEN 'random' THEN s.u < {RHO} * {1 << 20}
    WHEN 'threshold' THEN s.ripu >= {TAU} ELSE s.ahead < greatest(1, ceil(greatest(0.0, w.b - (s.n - s.t) * {REVIEW}::DOUBLE) / {MEDIAN - REVIEW}::DOUBLE)) END AS manual) d)"""
ROLLED = f"""{STEPS}, fin AS MATERIALIZED (SELECT w.queue_id, policy, 100 * r AS ret, w.b AS left_s FROM walk w JOIN bud USING (queue_id) WHERE w.t = n),
log AS MATERIALIZED (SELECT w.queue_id, policy, w.t - 1 AS t, manual, CASE WHEN manual THEN 1.0 ELSE q END AS q_used, q AS q_auto, b_before / ({MEDIAN}::DOUBLE * (n - (w.t - 1))) AS ratio, session
  FROM walk w JOIN st s ON s.queue_id = w.queue_id AND s.t = w.t - 1 WHERE w.t > 0)"""


def rolled(spark, sf):
    return R.roll_out(queue(spark, sf), {
        "all_auto": R.all_auto(), "first_come": R.first_come(), "random": R.random_share(RHO),
        "threshold": R.score_threshold(TAU), "ranked": R.score_rank(MEDIAN, REVIEW)},
        R.budget(F.col("n"), MEDIAN, RHO, REVIEW), MEDIAN, REVIEW)


@check("r2_roll_outs", uses="queue_step", recursive=True, sql=f", {ROLLED} SELECT queue_id, policy, round(ret, 4) AS ret, round(left_s, 4) AS left_s FROM fin")
def r2(spark, sf):
    return rolled(spark, sf).select("queue_id", "policy", F.round("ret", 4).alias("ret"),
                                    F.round("left_s", 4).alias("left_s"))


@check("w8_images_ahead", uses="queue_step", sql="""
SELECT queue_id, t, (SELECT count(*) FROM queue_step b WHERE b.queue_id = a.queue_id AND b.t > a.t AND b.ripu > a.ripu)::INT AS ahead FROM queue_step a""")
def w8(spark, sf):
    return R.images_ahead(queue(spark, sf)).select("queue_id", F.explode("steps").alias("s")).select(
        "queue_id", "s.t", "s.ahead")


TUNED = f"""g AS MATERIALIZED (SELECT DISTINCT unnest(quantile_cont(ripu, [i / 20.0 for i in range(21)])) AS tau FROM queue_step UNION ALL SELECT 'infinity'::DOUBLE),
st AS MATERIALIZED (SELECT queue_id, t, q, coalesce(manual_s, {MEDIAN}::DOUBLE) AS c, ripu, max(t) OVER (PARTITION BY queue_id) + 1 AS n FROM queue_step),
walk AS (SELECT queue_id, tau, n, 0 AS t, {RHO}::DOUBLE * n * {MEDIAN} + {1 - RHO}::DOUBLE * n * {REVIEW} AS b, 0.0::DOUBLE AS r FROM st, g WHERE t = 0
  UNION ALL SELECT w.queue_id, w.tau, w.n, w.t + 1, w.b - CASE WHEN w.b > 0 AND s.ripu >= w.tau THEN s.c ELSE {REVIEW}::DOUBLE END, w.r + CASE WHEN w.b > 0 AND s.ripu >= w.tau THEN 1.0 ELSE s.q END
  FROM walk w JOIN st s ON s.queue_id = w.queue_id AND s.t = w.t)"""


def tuned(spark, sf):
    steps = D.queue_step(spark, sf)
    return R.tune_threshold(steps, R.score_grid(steps), R.budget(F.col("n"), MEDIAN, RHO, REVIEW),
                            MEDIAN, REVIEW)


@check("r3_threshold_grid", uses="queue_step", recursive=True, sql=f", {TUNED} SELECT round(tau, 6) AS tau, round(100 * avg(r), 4) AS mean_return FROM walk WHERE t = n GROUP BY 1".replace("i / 20.0", "i / 20.0::DOUBLE"))
def r3(spark, sf):
    return rounded(tuned(spark, sf).withColumn("mean_return", F.round("mean_return", 4)))


@check("r3_best_threshold", uses="queue_step", recursive=True, sql=f""", {TUNED}, m AS (SELECT tau, 100 * avg(r) AS m FROM walk WHERE t = n GROUP BY 1)
SELECT round(tau, 6) AS tau, round(m, 4) AS mean_return FROM m ORDER BY round(m, 6) DESC, m.tau LIMIT 1""".replace("i / 20.0", "i / 20.0::DOUBLE"))
def r3b(spark, sf):
    return rounded(R.best_threshold(tuned(spark, sf)).withColumn("mean_return", F.round("mean_return", 4)))


def eight(spark, sf):
    o = D.table(spark, sf, "orders")
    return o.select(F.expr("o_orderkey div 8").alias("queue_id"), (F.col("o_orderkey") % 8).cast("int").alias("t"),
                    ((F.col("o_custkey") * 37 % 1001) / 1000).alias("q"),
                    F.when(F.col("o_orderkey") % 17 != 0, (5 + F.col("o_custkey") % 40).cast("double")).alias("manual_s"))


def optimum_sql(steps: str, total: str) -> str:
    """Every choice of images done by hand, by recursion, over queues of any length."""
    return f"""s AS MATERIALIZED (SELECT queue_id, q, c, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY queue_id) AS n FROM ({steps}) WINDOW w AS (PARTITION BY queue_id ORDER BY t)),
w AS (SELECT queue_id, 0 AS i, n, {total} AS b, 0.0::DOUBLE AS g FROM s WHERE i = 0
  UNION ALL SELECT w.queue_id, w.i + 1, w.n, w.b - CASE WHEN m.m = 1 THEN s.c ELSE {REVIEW}::DOUBLE END, w.g + CASE WHEN m.m = 1 THEN 1.0 ELSE s.q END
  FROM w JOIN s ON s.queue_id = w.queue_id AND s.i = w.i, (SELECT unnest([0, 1]) AS m) m WHERE m.m = 0 OR w.b > 0)
SELECT queue_id, round(100 * max(g), 4) AS optimum FROM w WHERE i = n GROUP BY 1"""


EIGHT = f"""SELECT o_orderkey // 8 AS queue_id, o_orderkey % 8 AS t, (o_custkey * 37 % 1001) / 1000.0::DOUBLE AS q,
  CASE WHEN o_orderkey % 17 <> 0 THEN (5 + o_custkey % 40)::DOUBLE ELSE {MEDIAN}::DOUBLE END AS c FROM orders"""


@check("r4_hindsight_optimum", sql=f"WITH RECURSIVE {optimum_sql(EIGHT, f'{RHO}::DOUBLE * n * {MEDIAN} + {1 - RHO}::DOUBLE * n * {REVIEW}')}")
def r4(spark, sf):
    o = R.hindsight_optimum(eight(spark, sf), R.budget(F.col("n"), MEDIAN, RHO, REVIEW), MEDIAN, REVIEW)
    return o.withColumn("optimum", F.round("optimum", 4))


@check("r4_hindsight_optimum_12", uses="queue_step", recursive=True, sql=f", {optimum_sql(f'SELECT queue_id, t, q, coalesce(manual_s, {MEDIAN})::DOUBLE AS c FROM queue_step', f'{TOTAL}::DOUBLE')}")
def r4b(spark, sf):
    o = R.hindsight_optimum(D.queue_step(spark, sf), F.lit(TOTAL), MEDIAN, REVIEW)
    return o.withColumn("optimum", F.round("optimum", 4))


@check("a25_share_of_optimum", uses="queue_step", recursive=True, sql=f""", {ROLLED.replace("'ranked'])", "'ranked'])")}, best AS (SELECT queue_id, max(ret) AS c, max(ret) FILTER (WHERE policy = 'all_auto') AS f FROM fin GROUP BY 1),
allp AS (SELECT queue_id, policy, ret FROM fin UNION ALL SELECT queue_id, 'optimum', c FROM best)
SELECT policy, round(avg(ret), 4) AS mean_return, round(avg(ret - f) / avg(c - f), 5) AS share FROM allp JOIN best USING (queue_id) GROUP BY 1""")
def a25s(spark, sf):
    r = rolled(spark, sf).select("queue_id", "policy", "ret")
    top = r.groupBy("queue_id").agg(F.max("ret").alias("ret")).withColumn("policy", F.lit("optimum"))
    s = V.share_of_optimum(r.unionByName(top))
    return s.select("policy", F.round("mean_return", 4).alias("mean_return"), F.round("share", 5).alias("share"))


@check("a26_policy_report", uses="queue_step", recursive=True, sql=f""", {ROLLED}
SELECT f.policy, round(mean_return, 4) AS mean_return, round(used_s, 4) AS used_s, round(overrun_s, 4) AS overrun_s, round(manual_per_queue, 5) AS manual_per_queue, round(failure_recall, 6) AS failure_recall, round(q_manual, 6) AS q_manual, round(q_auto, 6) AS q_auto
FROM (SELECT policy, avg(ret) AS mean_return, {TOTAL} - avg(left_s) AS used_s, avg(greatest(0, -left_s)) AS overrun_s FROM fin GROUP BY 1) f JOIN
 (SELECT policy, sum(manual::INT) / count(DISTINCT queue_id) AS manual_per_queue, avg(manual::INT) FILTER (WHERE q_auto < 0.5) AS failure_recall, avg(q_auto) FILTER (WHERE manual) AS q_manual, avg(q_auto) FILTER (WHERE NOT manual) AS q_auto FROM log GROUP BY 1) s USING (policy)""")
def a26(spark, sf):
    d = R.policy_report(rolled(spark, sf), TOTAL)
    digits = {"mean_return": 4, "used_s": 4, "overrun_s": 4, "manual_per_queue": 5}
    return d.select("policy", *[F.round(c, digits.get(c, 6)).alias(c) for c in d.columns if c != "policy"])


@check("a26_manual_by_budget", uses="queue_step", recursive=True, sql=f""", {ROLLED}
SELECT policy, CASE WHEN ratio < 0.25 THEN 0.0 WHEN ratio < 0.5 THEN 0.25 WHEN ratio < 0.75 THEN 0.5 WHEN ratio < 1 THEN 0.75 WHEN ratio < 1.5 THEN 1.0 ELSE 1.5 END::DOUBLE AS bin,
  round(avg(manual::INT), 6) AS p_manual, count(*) AS n FROM log WHERE ratio > 0 GROUP BY 1, 2""")
def a26b(spark, sf):
    return rounded(R.manual_by_budget(rolled(spark, sf)))


@check("a26_gain_by_session", uses="queue_step", recursive=True, sql=f", {ROLLED} SELECT policy, session, round(100 * avg(q_used - q_auto), 5) AS gain FROM log GROUP BY 1, 2")
def a26c(spark, sf):
    return rounded(R.gain_by_session(rolled(spark, sf)), 5)


@check("a32_route_medians", uses="label_log log_exclusions", sql="""
, t AS (SELECT * FROM label_log l WHERE NOT EXISTS (SELECT 1 FROM log_exclusions e WHERE e.scope = 'timing' AND e.scene_id = l.scene_id AND e.ts = l.ts))
SELECT route, round(quantile_cont(active_seconds, 0.5), 6) AS median_s, count(*) AS n FROM t GROUP BY 1""")
def a32(spark, sf):
    t = L.timing_rows(D.label_log(spark, sf), D.log_exclusions(spark, sf))
    return rounded(R.median_seconds(t, "active_seconds", ["route"]))


MEASURED = """t AS (SELECT * FROM label_log l WHERE NOT EXISTS (SELECT 1 FROM log_exclusions e WHERE e.scope = 'timing' AND e.scene_id = l.scene_id AND e.ts = l.ts)),
lastt AS MATERIALIZED (SELECT scene_id, active_seconds AS manual_s FROM t WHERE route = 'interactive_clicks' QUALIFY row_number() OVER (PARTITION BY scene_id ORDER BY log_pos DESC) = 1)"""


def measured(spark, sf):
    t = L.timing_rows(D.label_log(spark, sf), D.log_exclusions(spark, sf))
    t = t.filter("route = 'interactive_clicks'")
    return L.latest(t.withColumn("_o", F.lit(0)), ["scene_id"], "_o", "log_pos").select(
        "scene_id", F.col("active_seconds").alias("manual_s"))


@check("a32_charged_seconds", uses="label_log log_exclusions scene_dim", sql=f", {MEASURED} SELECT scene_id, coalesce(manual_s, 24.0) AS charged_s FROM scene_dim LEFT JOIN lastt USING (scene_id)")
def a32b(spark, sf):
    return R.charged_seconds(D.scene_dim(spark, sf), measured(spark, sf), 24.0).select("scene_id", "charged_s")


@check("j11_scene_timing_and_quality", uses="label_log log_exclusions scene_dim auto_px mask_px", sql=f""", {MEASURED},
q AS (SELECT a.scene_id, a.labeller, CASE WHEN sum(greatest(a.m, (g.cls = 1)::INT)) = 0 THEN 1.0 ELSE sum(a.m * (g.cls = 1)::INT) / sum(greatest(a.m, (g.cls = 1)::INT)) END AS iou, avg(a.m) AS wf
  FROM auto_px a JOIN (SELECT * FROM mask_px WHERE annotator = 0) g USING (scene_id, y, x) GROUP BY 1, 2)
SELECT scene_id, manual_s, labeller, round(iou, 4) AS iou_vs_gold, round(wf, 4) AS water_frac FROM scene_dim LEFT JOIN lastt USING (scene_id) LEFT JOIN q USING (scene_id)""")
def j11(spark, sf):
    from maskloom.plans.campaign import scene_facts
    g = D.mask_px(spark, sf).filter("annotator = 0").select(*AT, (F.col("cls") == 1).cast("int").alias("gold"))
    f = scene_facts(D.scene_dim(spark, sf).select("scene_id"), measured(spark, sf), D.auto_px(spark, sf), g)
    return f.select("scene_id", "manual_s", F.explode("auto").alias("a")).select("scene_id", "manual_s", "a.*")


# -- batch rules and observation ------------------------------------------------------------------

BATCH = """cnd AS MATERIALIZED (SELECT o_orderkey AS scene_id, o_orderkey // 10 AS batch, 'S' || (o_custkey % 6) AS session, (o_custkey * 37 % 1001) / 1000.0::DOUBLE AS iou_model_auto,
  (round(o_totalprice * 100)::BIGINT % 500) / 400.0::DOUBLE AS entropy, 0.1::DOUBLE AS auto_min, (5 + o_custkey % 40) / 60.0::DOUBLE AS manual_min,
  CASE o_custkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS action, ((o_orderkey // 10) * 13 % 101 - 50) / 100.0::DOUBLE AS gain FROM orders)"""


def cand(spark, sf):
    o = D.table(spark, sf, "orders")
    b = F.expr("o_orderkey div 10")
    return o.select(
        F.col("o_orderkey").alias("scene_id"), b.alias("batch"),
        F.concat(F.lit("S"), (F.col("o_custkey") % 6).cast("string")).alias("session"),
        ((F.col("o_custkey") * 37 % 1001) / 1000).alias("iou_model_auto"),
        (F.round(F.col("o_totalprice") * 100).cast("long") % 500 / 400).alias("entropy"),
        F.lit(0.1).alias("auto_min"), ((5 + F.col("o_custkey") % 40) / 60).alias("manual_min"),
        (F.col("o_custkey") % 3).cast("int").alias("action"), ((b * 13 % 101 - 50) / 100).alias("gain"))


@check("r5_batch_rules", sql=f"""WITH {BATCH}
SELECT scene_id, 0 AS all_auto, CASE WHEN iou_model_auto < 0.5 THEN 1 ELSE 0 END AS disagree, {hashed('sha1', "'0:' || scene_id", 3)}::INT AS random,
  CASE WHEN row_number() OVER (PARTITION BY batch ORDER BY entropy DESC, scene_id) <= round_even(count(*) OVER (PARTITION BY batch) * 0.5, 0) THEN 1 ELSE 2 END AS uncertain FROM cnd""")
def r5(spark, sf):
    d = R.uncertainty_rule(cand(spark, sf).drop("action"), "batch", 0.5, skip_confident=True)
    return d.select("scene_id", F.lit(R.AUTO).alias("all_auto"), R.disagreement_rule(0.5).alias("disagree"),
                    R.random_rule(F.col("scene_id").cast("string")).alias("random"),
                    F.col("action").alias("uncertain"))


@check("w7_most_uncertain", sql=f"""WITH {BATCH}
SELECT session, count(*) AS n FROM (SELECT * FROM cnd QUALIFY row_number() OVER (PARTITION BY session ORDER BY entropy DESC, scene_id) <= round_even(count(*) OVER (PARTITION BY session) * 0.3, 0)) GROUP BY 1""")
def w7(spark, sf):
    d = R.uncertainty_rule(cand(spark, sf).drop("action"), "session", 0.3)
    return d.filter(F.col("action") == R.MANUAL).groupBy("session").agg(F.count("*").alias("n"))


WA, WM = [1.5, -0.5, 0.2], [-1.0, 2.0, 0.4]


@check("r6_linear_actions", sql=f"""WITH {BATCH}, v AS (SELECT scene_id, {WA[0]}::DOUBLE * iou_model_auto + {WA[1]}::DOUBLE * entropy + {WA[2]}::DOUBLE - 1.0 * auto_min AS va,
  {WM[0]}::DOUBLE * iou_model_auto + {WM[1]}::DOUBLE * entropy + {WM[2]}::DOUBLE - 1.0 * manual_min AS vm FROM cnd)
SELECT scene_id, round(va, 6) AS value_auto, round(vm, 6) AS value_manual, CASE WHEN greatest(va, vm) <= 0 THEN 2 WHEN va >= vm THEN 0 ELSE 1 END AS action FROM v""")
def r6(spark, sf):
    d = R.linear_actions(cand(spark, sf), ["iou_model_auto", "entropy"], WA, WM, 1.0)
    return d.select("scene_id", F.round("value_auto", 6).alias("value_auto"),
                    F.round("value_manual", 6).alias("value_manual"), "action")


@check("w4_step_rewards", uses="train_hist", sql="""
, r AS (SELECT modality, fold, epoch, CASE WHEN lag(miou) OVER w IS NULL THEN 0.0 ELSE 100 * (miou - lag(miou) OVER w) - 1.0 * n_val / 10 END AS reward FROM train_hist WINDOW w AS (PARTITION BY modality, fold ORDER BY epoch))
SELECT modality, fold, epoch, round(reward, 5) AS reward, round(sum(reward) OVER (PARTITION BY modality, fold ORDER BY epoch), 5) AS "return" FROM r""")
def w4(spark, sf):
    s = D.train_hist(spark, sf).select("modality", "fold", F.col("epoch").alias("t"), F.col("miou").alias("score"),
                                       (F.col("n_val") / 10).alias("minutes"))
    d = R.step_rewards(s, ["modality", "fold"], block=16)
    return d.select("modality", "fold", F.col("t").alias("epoch"), F.round("reward", 5).alias("reward"),
                    F.round("return", 5).alias("return"))


@check("j14_redundancy", sql=f"""WITH {BATCH}, lab AS (SELECT * FROM cnd WHERE action = 1), per AS (SELECT session, count(*) AS k FROM lab WHERE session <> 'S4' GROUP BY 1)
SELECT scene_id, coalesce(k, 0) AS same_count, round(coalesce(k, 0) / (SELECT greatest(1, count(*)) FROM lab WHERE session <> 'S4'), 6) AS same_share, count(*) OVER (PARTITION BY batch, session) - 1 AS same_batch
FROM cnd LEFT JOIN per USING (session)""")
def j14(spark, sf):
    c = cand(spark, sf)
    lab = c.filter((F.col("action") == 1) & (F.col("session") != "S4"))
    return C.redundancy(c, lab).select("scene_id", "same_count", F.round("same_share", 6).alias("same_share"), "same_batch")


@check("a31_gram", sql=f"""WITH {BATCH}, x AS (SELECT [1.0::DOUBLE, entropy, iou_model_auto] AS x, manual_min * 60 AS y FROM cnd)
SELECT i, j, round(sum(x[i + 1] * CASE WHEN j = -1 THEN y ELSE x[j + 1] END), 4) AS value FROM x, (SELECT unnest([0, 1, 2]) AS i), (SELECT unnest([-1, 0, 1, 2]) AS j) WHERE j = -1 OR j >= i GROUP BY 1, 2""")
def a31(spark, sf):
    g = R.gram(cand(spark, sf).withColumn("y", F.col("manual_min") * 60), ["entropy", "iou_model_auto"], "y")
    return g.withColumn("value", F.round("value", 4))


@check("a31_time_model_error")
def a31b(spark, sf):
    c = cand(spark, sf).withColumn("y", F.col("manual_min") * 60)
    feats = ["entropy", "iou_model_auto"]
    coef = R.solve(R.gram(c.filter("session <> 'S1'"), feats, "y"))
    return c.filter("session = 'S1'").agg(
        F.avg(F.abs(R.predicted_seconds(feats, coef) - F.col("y"))).alias("mae"), F.count("*").alias("n"))


@check("a34_gain_statistics", sql=f"""WITH {BATCH}, b AS (SELECT batch, max(gain) AS y, [sum(CASE WHEN action = 0 THEN iou_model_auto ELSE 0 END), sum(CASE WHEN action = 0 THEN entropy ELSE 0 END), sum((action = 0)::INT)::DOUBLE,
  sum(CASE WHEN action = 1 THEN iou_model_auto ELSE 0 END), sum(CASE WHEN action = 1 THEN entropy ELSE 0 END), sum((action = 1)::INT)::DOUBLE] AS x FROM cnd GROUP BY 1)
SELECT i::INT AS i, j::INT AS j, round(sum(x[i + 1] * CASE WHEN j = -1 THEN y ELSE x[j + 1] END) / 10.89, 4) AS value FROM b, (SELECT unnest(range(6)) AS i), (SELECT unnest(range(-1, 6)) AS j) WHERE j = -1 OR j >= i GROUP BY 1, 2""")
def a34(spark, sf):
    return R.gain_statistics(cand(spark, sf), ["iou_model_auto", "entropy"]).withColumn(
        "value", F.round("value", 4))


@check("r9_candidate_batches", uses="scene_dim", sql=f"""
, big AS (SELECT session, row_number() OVER (ORDER BY count(*) DESC, session) - 1 AS k, count(*) OVER () AS m FROM scene_dim GROUP BY 1 HAVING count(*) >= 5),
b AS (SELECT unnest(range(8)) AS batch), bb AS (SELECT batch, CASE WHEN batch % 2 = 0 THEN (SELECT session FROM (SELECT session, k FROM big ORDER BY k LIMIT 8) WHERE k = (batch // 2) % (SELECT least(8, count(*)) FROM big)) END AS solo FROM b),
d AS (SELECT batch, scene_id, session, row_number() OVER (PARTITION BY batch ORDER BY {hashed('sha1', "'0:' || batch || ':' || scene_id", 1 << 30)}, scene_id) AS r FROM bb JOIN scene_dim ON solo IS NULL OR session = solo)
SELECT batch::INT AS batch, scene_id, session FROM d WHERE r <= 5""")
def r9(spark, sf):
    return C.candidate_batches(D.scene_dim(spark, sf).select("scene_id", "session"), 5, 8)


@check("r10_campaign_draw", uses="scene_dim", sql=f"""
, d AS (SELECT s.seed, scene_id, row_number() OVER (PARTITION BY s.seed ORDER BY {hashed('sha1', "s.seed || ':' || scene_id", 1 << 30)}, scene_id) - 1 AS r FROM scene_dim, (SELECT unnest([3, 4, 5]) AS seed) s)
SELECT seed, scene_id, CASE WHEN r < 10 THEN -1 ELSE ((r - 10) // 6)::INT END AS batch FROM d WHERE r < 34""")
def r10(spark, sf):
    return C.campaign_draw(D.scene_dim(spark, sf).select("scene_id"), [3, 4, 5], 10, 6, 4)


@check("r11_session_folds", uses="scene_dim", sql="""
SELECT scene_id, f.fold, CASE WHEN (f.fold = 'A') = (session IN ('session 1', 'session 4')) THEN 'eval' ELSE 'fit' END AS side FROM scene_dim, (SELECT unnest(['A', 'B']) AS fold) f""")
def r11(spark, sf):
    s = D.scene_dim(spark, sf).select("scene_id", "session")
    one = ["session 1", "session 4"]
    other = [f"session {i}" for i in range(7) if f"session {i}" not in one]
    return C.session_folds(s, {"A": one, "B": other}).select("scene_id", "fold", "side")


@check("r12_observation", uses="px prob_px auto_px scene_dim label_log log_exclusions", sql=f""", {PRED}, {MEASURED},
pr AS (SELECT scene_id, avg(ent) AS entropy, avg((top < 0.6)::INT) AS low_conf, avg((cls = 1)::INT) AS pred_water FROM pred GROUP BY 1),
au AS (SELECT scene_id, avg(m) AS auto_water, CASE WHEN sum(greatest(m, (cls = 1)::INT)) = 0 THEN 1.0 ELSE sum(m * (cls = 1)::INT) / sum(greatest(m, (cls = 1)::INT)) END AS iou FROM pred JOIN (SELECT * FROM auto_px WHERE labeller = 1) USING (scene_id, y, x) GROUP BY 1),
ix AS (SELECT scene_id, avg((g > nir)::INT) AS pos FROM px GROUP BY 1),
lab AS (SELECT scene_id, session FROM scene_dim WHERE scene_id % 5 = 0), cd AS (SELECT scene_id, scene_id // 10 AS batch, session FROM scene_dim WHERE scene_id % 5 <> 0), per AS (SELECT session, count(*) AS k FROM lab GROUP BY 1)
SELECT scene_id, batch, round(pos, 6) AS ndwi_pos_frac, round(entropy, 5) AS entropy, low_conf, pred_water, round(iou, 6) AS iou_model_auto, auto_water, round((SELECT quantile_cont(manual_s, 0.5) FROM lastt) / 60, 6) AS manual_min,
  coalesce(k, 0) AS same_count, round(coalesce(k, 0) / (SELECT count(*) FROM lab), 6) AS same_share, count(*) OVER (PARTITION BY batch, cd.session) - 1 AS same_batch
FROM cd LEFT JOIN per USING (session) JOIN pr USING (scene_id) JOIN au USING (scene_id) JOIN ix USING (scene_id)""")
def r12(spark, sf):
    from maskloom.plans.campaign import observations
    s = D.scene_dim(spark, sf).select("scene_id", "session")
    c = s.filter("scene_id % 5 <> 0").withColumn("batch", F.expr("scene_id div 10"))
    o = observations(c, s.filter("scene_id % 5 = 0"), ST.index_shares(D.px(spark, sf)).select("scene_id", "ndwi_pos_frac"),
                     predicted(spark, sf), water(spark, sf), R.median_seconds(measured(spark, sf), "manual_s"))
    digits = {"ndwi_pos_frac": 6, "entropy": 5, "iou_model_auto": 6, "manual_min": 6, "same_share": 6}
    names = ("scene_id", "batch", "ndwi_pos_frac", "entropy", "low_conf", "pred_water", "iou_model_auto", "auto_water",
             "manual_min", "same_count", "same_share", "same_batch")
    return o.select(*[F.round(c, digits[c]).alias(c) if c in digits else F.col(c) for c in names])


# -- selection ------------------------------------------------------------------------------------


@check("p8_usable_frames", uses="capture", sql="SELECT pos FROM capture WHERE has_tiff AND brightness >= 30 AND session IS NOT NULL")
def p8(spark, sf):
    return C.usable_frames(D.capture(spark, sf)).select("pos")


@check("u5_collapsed_copies", uses="capture", sql="SELECT session, stem, max(pos) AS pos FROM capture GROUP BY 1, 2")
def u5(spark, sf):
    return C.collapse_copies(D.capture(spark, sf)).select("session", "stem", "pos")


@check("j8_shared_label_flag", uses="capture", sql="SELECT pos, bool_or(labelled) OVER (PARTITION BY session, stem) AS labelled FROM capture")
def j8(spark, sf):
    return C.share_label_flag(D.capture(spark, sf)).select("pos", "labelled")


@check("j7_deployment", uses="capture deploy_window", sql="""
, h AS (SELECT c.pos, c.session, w.name, row_number() OVER (PARTITION BY c.pos ORDER BY ord) AS r FROM capture c JOIN deploy_window w ON w.session = c.session AND c.ts::DATE BETWEEN from_date AND to_date)
SELECT pos, name AS placement FROM h WHERE r = 1 UNION ALL SELECT pos, '' FROM capture ANTI JOIN deploy_window USING (session)""")
def j7(spark, sf):
    return C.deployment(D.capture(spark, sf), D.deploy_window(spark, sf)).select("pos", "placement")


@check("j9_far_in_time", uses="capture", sql="""
SELECT pos FROM capture c WHERE NOT labelled AND NOT EXISTS (SELECT 1 FROM capture b WHERE b.labelled AND b.session = c.session AND abs(epoch(c.ts) - epoch(b.ts)) < 5400)""")
def j9(spark, sf):
    c = D.capture(spark, sf)
    return C.far_in_time(c.filter("not labelled"), c.filter("labelled"), 5400).select("pos")


@check("w5_time_spread", uses="capture", sql="""
, r AS (SELECT pos, session, row_number() OVER (PARTITION BY session ORDER BY ts, pos) - 1 AS r, count(*) OVER (PARTITION BY session) AS n FROM capture),
p AS (SELECT DISTINCT session, round_even(i * (n - 1) / 59.0::DOUBLE, 0) AS r FROM (SELECT DISTINCT session, n FROM r WHERE n > 60), (SELECT unnest(range(60)) AS i))
SELECT pos FROM r JOIN p USING (session, r) UNION ALL SELECT pos FROM r WHERE n <= 60""")
def w5(spark, sf):
    return C.time_spread(D.capture(spark, sf), ["session"], 60).select("pos")


@check("f12_quotas", uses="capture", sql="""
, s AS (SELECT DISTINCT session, 'm' || (dayofmonth(ts) % 4) AS stratum FROM capture), w AS (SELECT session, (length(session) * 7 + ascii(right(session, 1))) % 13 AS want FROM (SELECT DISTINCT session FROM s))
SELECT session, stratum, want // m + (i < want % m)::INT AS quota FROM (SELECT session, stratum, want, row_number() OVER (PARTITION BY session ORDER BY stratum) - 1 AS i, count(*) OVER (PARTITION BY session) AS m FROM s JOIN w USING (session))""")
def f12(spark, sf):
    c = D.capture(spark, sf)
    s = c.select("session", F.concat(F.lit("m"), (F.dayofmonth("ts") % 4).cast("string")).alias("stratum")).distinct()
    s = s.withColumn("want", (F.length("session") * 7 + F.ascii(F.right("session", F.lit(1)))) % 13)
    return C.quotas(s, ["session"], "want").select("session", "stratum", "quota")


FEATURES = ("f1", "f2", "f3", "f4")


def standardised(name: str, source: str, keys: str) -> str:
    """CTE: ``source`` with features standardised per group, and distances' building blocks."""
    m = ", ".join(f"avg({f}) AS m_{f}, stddev_pop({f}) AS s_{f}" for f in FEATURES)
    z = ", ".join(f"round(({f} - m_{f}) / (s_{f} + 1e-9::DOUBLE), 6) AS z_{f}" for f in FEATURES)
    return (f"{name}_m AS (SELECT {keys}, {m} FROM {source} GROUP BY {keys}), "
            f"{name}_0 AS MATERIALIZED (SELECT {keys}, pos, epoch(ts)::BIGINT AS s, want, gap, forced, {z} FROM {source} JOIN {name}_m USING ({keys}))")


def distance(a: str, b: str) -> str:
    return "round(" + " + ".join(f"({a}.z_{f} - {b}.z_{f}) * ({a}.z_{f} - {b}.z_{f})" for f in FEATURES) + ", 6)"


def picked(name: str, source: str, keys: str, rounds: int) -> str:
    """CTEs: farthest points of ``source`` (keys, pos, ts, features, want, gap, forced), one CTE per round."""
    on = " AND ".join(f"a.{k} = b.{k}" for k in keys.split(", "))
    ctes = [standardised(name, source, keys),
            f"{name}_p0 AS MATERIALIZED (SELECT {keys}, pos, s, row_number() OVER (PARTITION BY {keys} ORDER BY s, pos) AS rank, "
            + ", ".join(f"z_{f}" for f in FEATURES) + f" FROM {name}_0 WHERE forced = 1)"]
    for i in range(1, rounds + 1):
        norm = "round(" + " + ".join(f"z_{f} * z_{f}" for f in FEATURES) + ", 6)"
        ctes.append(f"""{name}_p{i} AS MATERIALIZED (WITH d AS (SELECT a.*, min({distance('a', 'b')}) AS far, bool_and(b.pos IS NULL OR abs(a.s - b.s) >= a.gap) AS free, count(b.pos) AS have, bool_or(a.pos = b.pos) AS used
    FROM {name}_0 a LEFT JOIN {name}_p{i - 1} b ON {on} WHERE a.forced = 0 GROUP BY ALL)
  SELECT * FROM {name}_p{i - 1} UNION ALL SELECT {keys}, pos, s, have + 1 AS rank, {', '.join(f'z_{f}' for f in FEATURES)} FROM d
  WHERE have < want AND free AND NOT coalesce(used, FALSE) AND (far IS NULL OR far > 0)
  QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY coalesce(far, -{norm}) DESC, s, pos) = 1)""")
    return ",\n".join(ctes)


def picked_of_all(name: str, source: str, keys: str, rounds: int) -> str:
    """CTEs like those of ``picked``, for groups of any size: distances are carried from round to round."""
    on = " AND ".join(f"a.{k} = b.{k}" for k in keys.split(", "))
    z = ", ".join(f"z_{f}" for f in FEATURES)
    norm = "round(" + " + ".join(f"z_{f} * z_{f}" for f in FEATURES) + ", 6)"
    ctes = [standardised(name, source, keys),
            f"{name}_p0 AS MATERIALIZED (SELECT {keys}, pos, s, row_number() OVER (PARTITION BY {keys} ORDER BY s, pos) AS rank, {z} FROM {name}_0 WHERE forced = 1)",
            f"""{name}_s0 AS MATERIALIZED (WITH h AS (SELECT {keys}, count(*) AS have FROM {name}_p0 GROUP BY {keys}),
    o AS (SELECT c.*, coalesce(have, 0) AS have FROM {name}_0 c LEFT JOIN h USING ({keys}) WHERE forced = 0 AND coalesce(have, 0) < want)
  SELECT a.*, min({distance('a', 'b')}) AS far, bool_and(b.pos IS NULL OR abs(a.s - b.s) >= a.gap) AS free FROM o a LEFT JOIN {name}_p0 b ON {on} GROUP BY ALL)"""]
    for i in range(1, rounds + 1):
        ctes.append(f"""{name}_w{i} AS MATERIALIZED (SELECT * FROM {name}_s{i - 1} WHERE have + {i - 1} < want AND free AND (far IS NULL OR far > 0)
  QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY coalesce(far, -{norm}) DESC, s, pos) = 1)""")
        ctes.append(f"""{name}_s{i} AS MATERIALIZED (SELECT a.* REPLACE (least(a.far, {distance('a', 'b')}) AS far, a.free AND coalesce(abs(a.s - b.s) >= a.gap, TRUE) AS free)
  FROM {name}_s{i - 1} a LEFT JOIN {name}_w{i} b ON {on})""")
    each = "".join(f" UNION ALL SELECT {keys}, pos, s, have + {i} AS rank, {z} FROM {name}_w{i}" for i in range(1, rounds + 1))
    return ",\n".join([*ctes, f"{name}_p{rounds} AS MATERIALIZED (SELECT * FROM {name}_p0{each})"])


SPREAD60 = """sr AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY ts, pos) - 1 AS r, count(*) OVER (PARTITION BY session) AS n FROM capture),
sp AS (SELECT DISTINCT session, round_even(i * (n - 1) / 59.0::DOUBLE, 0) AS r FROM (SELECT DISTINCT session, n FROM sr WHERE n > 60), (SELECT unnest(range(60)) AS i)),
thin AS MATERIALIZED (SELECT sr.*, 8 AS want, 1800 AS gap, 0 AS forced FROM sr LEFT JOIN sp USING (session, r) WHERE n <= 60 OR sp.session IS NOT NULL)"""


@check("r7_farthest_points", uses="capture", sql=f""", {SPREAD60}, {picked('fp', 'thin', 'session', 8)}
SELECT session, pos, rank FROM fp_p8""")
def r7(spark, sf):
    t = C.time_spread(D.capture(spark, sf), ["session"], 60).withColumns({"forced": F.lit(0), "quota": F.lit(8)})
    return C.farthest_points(t, ["session"], list(FEATURES), gap_s=1800)


def plan(spark, sf):
    """A set for each session, and a second one for those that end in an even character."""
    c = D.capture(spark, sf).select("session").distinct().withColumn("k", F.ascii(F.right("session", F.lit(1))))
    one = c.select(F.lit(0).alias("ord"), F.when(F.col("k") % 3 == 0, "reward").when(F.col("k") % 3 == 1, "test").otherwise("pool").alias("set"),
                   "session", F.lit(6).alias("want"))
    return one.unionByName(c.filter("k % 2 = 0").select(F.lit(1).alias("ord"), F.lit("extra").alias("set"), "session", F.lit(4).alias("want")))


SERIES = ["S1", "S2", "S3", "S4"]


def proposals(spark, sf, cap=None):
    f = C.deployment(C.usable_frames(C.collapse_copies(C.share_label_flag(D.capture(spark, sf)))), D.deploy_window(spark, sf))
    return C.propose(plan(spark, sf), f, f.filter("pos < 0").select("session", "ts"), list(FEATURES), SERIES, cap=cap)


def proposed_sql(thinned: bool = True) -> str:
    """The proposals of both turns as CTEs ending in ``proposed``; ``thinned`` strata or all frames are candidates."""
    pick = picked if thinned else picked_of_all
    series = ", ".join(f"'{s}'" for s in SERIES)
    frame_ctes = """lab AS (SELECT *, bool_or(labelled) OVER (PARTITION BY session, stem) AS lab_any FROM capture),
col AS (SELECT * REPLACE (lab_any AS labelled) FROM lab QUALIFY row_number() OVER (PARTITION BY session, stem ORDER BY pos DESC) = 1),
usable AS (SELECT * FROM col WHERE has_tiff AND session IS NOT NULL AND brightness >= 30),
hit AS (SELECT c.pos, w.name, row_number() OVER (PARTITION BY c.pos ORDER BY ord) AS r FROM usable c JOIN deploy_window w ON w.session = c.session AND c.ts::DATE BETWEEN from_date AND to_date),
frames AS MATERIALIZED (SELECT u.*, h.name AS placement FROM usable u JOIN hit h ON h.pos = u.pos AND h.r = 1 UNION ALL SELECT u.*, '' FROM usable u ANTI JOIN deploy_window USING (session)),
sess AS (SELECT DISTINCT session, ascii(right(session, 1)) AS k FROM capture),
plan AS (SELECT 0 AS ord, CASE k % 3 WHEN 0 THEN 'reward' WHEN 1 THEN 'test' ELSE 'pool' END AS "set", session, 6 AS want FROM sess
  UNION ALL SELECT 1, 'extra', session, 4 FROM sess WHERE k % 2 = 0)"""
    candidates = """m{t} AS (SELECT "set", session, count(DISTINCT stratum) AS m FROM st{t} GROUP BY 1, 2),
rk{t} AS MATERIALIZED (SELECT s.*, CASE WHEN ser THEN greatest(3, 60 // m) ELSE 60 END AS k, row_number() OVER w - 1 AS r, count(*) OVER (PARTITION BY "set", session, stratum) AS sz
  FROM st{t} s JOIN m{t} USING ("set", session) WINDOW w AS (PARTITION BY "set", session, stratum ORDER BY ts, pos)),
ix{t} AS (SELECT DISTINCT "set", session, stratum, round_even(i * (sz - 1) / (k - 1)::DOUBLE, 0) AS r FROM (SELECT DISTINCT "set", session, stratum, sz, k FROM rk{t} WHERE sz > k), (SELECT unnest(range(60)) AS i) WHERE i < k),
th{t} AS MATERIALIZED (SELECT r.* FROM rk{t} r LEFT JOIN ix{t} i USING ("set", session, stratum, r) WHERE (sz <= k OR i.session IS NOT NULL) AND NOT ("set" = 'reward' AND labelled)),
fo{t} AS MATERIALIZED (SELECT * FROM rk{t} WHERE "set" = 'reward' AND labelled)""" if thinned else """th{t} AS MATERIALIZED (SELECT *, 0 AS r FROM st{t} WHERE NOT ("set" = 'reward' AND labelled)),
fo{t} AS MATERIALIZED (SELECT *, 0 AS r FROM st{t} WHERE "set" = 'reward' AND labelled)"""
    ctes = [frame_ctes]
    for t, n in ((0, 9), (1, 6)):
        taken = "" if t == 0 else f" UNION ALL SELECT session, epoch(ts)::BIGINT AS s FROM turn{t - 1} WHERE session IN ({series})"
        ctes.append(f"""f{t} AS MATERIALIZED (SELECT f.*, p."set", p.want AS n, ceil(p.want * 1.4)::BIGINT AS need, session IN ({series}) AS ser FROM frames f JOIN plan p USING (session) WHERE p.ord = {t} AND f.ts IS NOT NULL),
busy{t} AS MATERIALIZED (SELECT session, epoch(ts)::BIGINT AS s FROM f{t} WHERE labelled AND "set" <> 'reward' AND ser{taken}),
c{t} AS MATERIALIZED (SELECT f.* FROM f{t} f WHERE ("set" = 'reward' OR NOT labelled) AND NOT EXISTS (SELECT 1 FROM busy{t} b WHERE b.session = f.session AND abs(epoch(f.ts)::BIGINT - b.s) < 1800)),
np{t} AS (SELECT session, count(DISTINCT placement) AS k FROM c{t} WHERE placement <> '' GROUP BY 1),
st{t} AS MATERIALIZED (SELECT c.*, CASE WHEN NOT ser THEN 'all' WHEN coalesce(k, 0) > 1 THEN placement ELSE strftime(ts, '%Y-%m') END AS stratum FROM c{t} c LEFT JOIN np{t} USING (session)),
{candidates.format(t=t)},
nf{t} AS (SELECT "set", session, count(*) AS nf FROM fo{t} GROUP BY 1, 2),
qs{t} AS (SELECT "set", session, stratum, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY "set", session) AS m, greatest(0, need - coalesce(nf, 0)) AS lft
  FROM (SELECT DISTINCT "set", session, stratum, need FROM th{t} WHERE ser) LEFT JOIN nf{t} USING ("set", session) WINDOW w AS (PARTITION BY "set", session ORDER BY stratum)),
sa{t} AS MATERIALIZED (SELECT th.* EXCLUDE (r), greatest(1, lft // m + (i < lft % m)::INT) AS want, 1800 AS gap, 0 AS forced FROM th{t} th JOIN qs{t} USING ("set", session, stratum)),
sb{t} AS MATERIALIZED (SELECT a.* EXCLUDE (r), greatest(1, need, coalesce(nf, 0)) AS want, 0 AS gap, (a."set" = 'reward' AND labelled)::INT AS forced FROM (SELECT * FROM th{t} UNION ALL SELECT * FROM fo{t}) a LEFT JOIN nf{t} USING ("set", session) WHERE NOT ser),
{pick(f'sa{t}f', f'sa{t}', '"set", session, stratum', n)},
{pick(f'sb{t}f', f'sb{t}', '"set", session', n)},
pk{t} AS (SELECT p."set", p.session, pos, row_number() OVER (PARTITION BY p."set", p.session ORDER BY stratum, rank) + coalesce(nf, 0) AS rank FROM sa{t}f_p{n} p LEFT JOIN nf{t} n ON n."set" = p."set" AND n.session = p.session
  UNION ALL SELECT "set", session, pos, row_number() OVER (PARTITION BY "set", session ORDER BY ts, pos) FROM fo{t} WHERE ser
  UNION ALL SELECT "set", session, pos, rank FROM sb{t}f_p{n}),
turn{t} AS MATERIALIZED (SELECT pk."set", pk.session, pk.rank, c.stem, c.placement, c.ts, CASE WHEN c.labelled THEN 'yes' ELSE '' END AS relabel FROM pk{t} pk JOIN c{t} c ON c."set" = pk."set" AND c.session = pk.session AND c.pos = pk.pos)""")
    ctes.append("proposed AS MATERIALIZED (SELECT * FROM turn0 UNION ALL SELECT * FROM turn1)")
    return ",\n".join(ctes)


PROPOSED = proposed_sql()


@check("r8_proposals", uses="capture deploy_window", sql=f', {PROPOSED} SELECT "set", session, stem, placement, ts, rank, relabel FROM proposed')
def r8(spark, sf):
    return proposals(spark, sf, cap=60).select("set", "session", "stem", "placement", "ts", "rank", "relabel")


@check("r8_shortfall", uses="capture deploy_window", sql=f""", {PROPOSED}
SELECT p."set", p.session, want, count(o.session) AS proposed, count(o.session) < want AS short FROM plan p LEFT JOIN proposed o ON o."set" = p."set" AND o.session = p.session GROUP BY 1, 2, 3""")
def r8b(spark, sf):
    return C.shortfall(plan(spark, sf), proposals(spark, sf, cap=60))


@check("u4_proposal_queues", uses="capture deploy_window", sql=f""", {proposed_sql(thinned=False)}
SELECT CASE WHEN "set" IN ('reward', 'test') THEN 'eval' ELSE 'pool' END AS queue, "set", session, stem, rank FROM proposed""")
def u4(spark, sf):
    return C.by_queue(proposals(spark, sf)).select("queue", "set", "session", "stem", "rank")


@check("t4_click_candidates", uses="auto_px", sql="""
, s AS (SELECT scene_id, labeller, 100 * avg(m) AS water_pct, sum(m * (y * 3 + x)) % 17 AS score FROM auto_px GROUP BY 1, 2)
SELECT scene_id, labeller, water_pct, row_number() OVER (PARTITION BY scene_id ORDER BY score DESC, labeller) AS rank FROM s QUALIFY rank <= 3""")
def t4(spark, sf):
    s = D.auto_px(spark, sf).groupBy("scene_id", "labeller").agg(
        (100 * F.avg("m")).alias("water_pct"), (F.sum(F.col("m") * (F.col("y") * 3 + F.col("x"))) % 17).alias("score"))
    return C.top_ranked(s, ["scene_id"], [F.desc("score"), F.col("labeller")], 3).select(
        "scene_id", "labeller", "water_pct", F.col("rank").cast("long").alias("rank"))


@check("t5_first_rows", uses="manifest", sql="SELECT scene_dir, pos FROM manifest ORDER BY pos, scene_dir LIMIT 16")
def t5(spark, sf):
    return D.manifest(spark, sf).orderBy("pos", "scene_dir").limit(16).select("scene_dir", "pos")

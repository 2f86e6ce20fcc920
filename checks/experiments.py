"""Training histories, experiment tables, scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import derived as D
from checks.log import hashed
from checks.registry import check
from maskloom.functions import scalars as X
from maskloom.operators import evaluation as V

RUN = ["modality", "fold"]


def rounded(df, digits=6, skip=()):
    kinds = dict(df.dtypes)
    return df.select(*[F.round(c, digits).alias(c) if kinds[c] == "double" and c not in skip else F.col(c)
                       for c in df.columns])


@check("w2_training_progress", uses="train_hist", sql="""
, a AS (SELECT *, row_number() OVER w AS k, max(miou) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM train_hist WINDOW w AS (PARTITION BY modality, fold ORDER BY epoch)),
b AS (SELECT *, miou > coalesce(prior, -1) AS is_best FROM a)
SELECT modality, fold, epoch, is_best, k - max(CASE WHEN is_best THEN k END) OVER (PARTITION BY modality, fold ORDER BY epoch) AS stale FROM b""")
def w2(spark, sf):
    return V.training_progress(D.train_hist(spark, sf), RUN, 5, block=16).select(
        *RUN, "epoch", "is_best", "stale")


@check("w2_early_stop", uses="train_hist", sql="""
, a AS (SELECT *, row_number() OVER w AS k, max(miou) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM train_hist WINDOW w AS (PARTITION BY modality, fold ORDER BY epoch)),
b AS (SELECT *, k - max(CASE WHEN miou > coalesce(prior, -1) THEN k END) OVER (PARTITION BY modality, fold ORDER BY epoch) AS stale FROM a)
SELECT modality, fold, min(epoch) FILTER (WHERE stale >= 8) AS stop_epoch FROM b GROUP BY 1, 2""")
def w2b(spark, sf):
    return V.early_stop(V.training_progress(D.train_hist(spark, sf), RUN, 8, block=16), RUN)


@check("w3_best_epoch", uses="train_hist", sql="""
SELECT modality, fold, epoch, miou, water_iou, boundary_f1, n_val FROM train_hist QUALIFY row_number() OVER (PARTITION BY modality, fold ORDER BY miou DESC, epoch) = 1""")
def w3(spark, sf):
    return V.best_epoch(D.train_hist(spark, sf), RUN)


BEST = "best AS MATERIALIZED (SELECT * FROM train_hist QUALIFY row_number() OVER (PARTITION BY modality, fold ORDER BY miou DESC, epoch) = 1)"


def best(spark, sf):
    b = V.best_epoch(D.train_hist(spark, sf), RUN)
    return b.withColumn("miou", F.when((F.col("modality") != 3) | (F.col("fold") != 2), F.col("miou")))


FAILED = f"{BEST}, folds AS MATERIALIZED (SELECT * REPLACE (CASE WHEN modality = 3 AND fold = 2 THEN NULL ELSE miou END AS miou) FROM best)"


@check("a22_fold_summary", uses="train_hist", sql=f""", {FAILED}, f AS (SELECT modality, miou, coalesce(water_iou, 0) AS water_iou, coalesce(boundary_f1, 0) AS boundary_f1, n_val FROM folds WHERE miou IS NOT NULL)
SELECT modality, count(*) AS n_folds, sum(n_val)::BIGINT AS n_scenes, min(miou) AS min_miou, max(miou) AS max_miou,
  round(avg(miou), 6) AS mean_miou, round(stddev_pop(miou), 6) AS sd_miou, round(sum(miou * n_val) / sum(n_val), 6) AS weighted_miou,
  round(avg(water_iou), 6) AS mean_water_iou, round(stddev_pop(water_iou), 6) AS sd_water_iou, round(sum(water_iou * n_val) / sum(n_val), 6) AS weighted_water_iou,
  round(avg(boundary_f1), 6) AS mean_boundary_f1, round(stddev_pop(boundary_f1), 6) AS sd_boundary_f1, round(sum(boundary_f1 * n_val) / sum(n_val), 6) AS weighted_boundary_f1
FROM f GROUP BY 1""")
def a22(spark, sf):
    return rounded(V.fold_summary(best(spark, sf), ["modality"]))


@check("t3_ordered_cells", uses="train_hist", sql=f""", {BEST} SELECT modality, round(avg(miou), 6) AS mean_miou FROM best GROUP BY 1 ORDER BY avg(miou) DESC, modality""")
def t3(spark, sf):
    b = V.best_epoch(D.train_hist(spark, sf), RUN)
    m = b.groupBy("modality").agg(F.round(F.avg("miou"), 6).alias("mean_miou"))
    return m.orderBy(F.desc("mean_miou"), "modality")


@check("j12_paired_folds", uses="train_hist", sql=f""", {FAILED}
SELECT f.modality, f.fold, round(b.miou - f.miou, 6) AS diff FROM folds f JOIN folds b ON b.fold = f.fold AND b.modality = 0
WHERE f.modality <> 0 AND f.miou IS NOT NULL AND b.miou IS NOT NULL""")
def j12(spark, sf):
    return V.paired_with(best(spark, sf), "modality", 0, ["fold"], "miou").select(
        "modality", "fold", F.round("diff", 6).alias("diff"))


@check("j12_paired_gain", uses="train_hist", sql=f""", {FAILED}, d AS (SELECT f.modality, b.miou - f.miou AS diff FROM folds f JOIN folds b ON b.fold = f.fold AND b.modality = 0
  WHERE f.modality <> 0 AND f.miou IS NOT NULL AND b.miou IS NOT NULL)
SELECT modality, round(avg(diff), 6) AS mean_diff, count(*) AS pairs, sum((diff > 0)::INT)::BIGINT AS wins FROM d GROUP BY 1""")
def j12b(spark, sf):
    return rounded(V.paired_gain(V.paired_with(best(spark, sf), "modality", 0, ["fold"], "miou"), "modality"))


@check("j13_experiment_grid", uses="train_hist", sql="SELECT m.modality, f.fold, a.a AS arch FROM (SELECT DISTINCT modality FROM train_hist) m, (SELECT DISTINCT fold FROM train_hist) f, (SELECT unnest(['b0', 'b2']) AS a) a")
def j13(spark, sf):
    return V.experiment_grid(D.train_hist(spark, sf), ["modality", "fold"], {"arch": ["b0", "b2"]})


@check("u1_unfinished_cells", uses="train_hist", sql="""
, g AS (SELECT m.modality, f.fold FROM (SELECT DISTINCT modality FROM train_hist) m, (SELECT DISTINCT fold FROM train_hist) f)
SELECT modality, fold FROM g ANTI JOIN (SELECT DISTINCT modality, fold FROM train_hist WHERE miou > 0.85) d USING (modality, fold)""")
def u1(spark, sf):
    h = D.train_hist(spark, sf)
    return V.unfinished(V.experiment_grid(h, ["modality", "fold"], {}), h.filter("miou > 0.85"), RUN)


@check("u2_key_mismatch", uses="manifest scene_dim", sql="""
, a AS (SELECT scene_dir FROM manifest WHERE scene_id % 7 <> 0), b AS (SELECT scene_dir FROM scene_dim WHERE scene_id % 6 <> 0)
SELECT scene_dir, 'left' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT scene_dir, 'right' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def u2(spark, sf):
    return V.key_mismatch(D.manifest(spark, sf).filter("scene_id % 7 <> 0").select("scene_dir"),
                          D.scene_dim(spark, sf).filter("scene_id % 6 <> 0").select("scene_dir"))


@check("u3_shared_keys", uses="scene_dim", sql="SELECT scene_dir FROM scene_dim WHERE scene_id % 3 = 0 INTERSECT SELECT scene_dir FROM scene_dim WHERE scene_id % 5 = 0")
def u3(spark, sf):
    s = D.scene_dim(spark, sf)
    return s.filter("scene_id % 3 = 0").select("scene_dir").intersect(
        s.filter("scene_id % 5 = 0").select("scene_dir"))


PRICED = "ep AS MATERIALIZED (SELECT *, 100 * (miou_final - miou0) - 1.0 * minutes AS ret, 100 * (miou_final - miou0) AS gain FROM episode)"


def priced(spark, sf):
    return V.reprice(D.episode(spark, sf), [1.0])


@check("a23_policy_summary", uses="episode", sql=f""", {PRICED}, j AS (SELECT e.*, CASE WHEN e.policy <> 2 THEN e.ret - b.ret END AS d, CASE WHEN e.policy <> 2 THEN 100 * (e.test_gain - b.test_gain) END AS dt
  FROM ep e LEFT JOIN ep b ON b.policy = 2 AND b.seed = e.seed)
SELECT policy, count(*) AS n, round(avg(ret), 6) AS mean_return, round(coalesce(stddev_samp(ret), 0), 6) AS sd_return, round(avg(miou_final), 6) AS mean_final, round(avg(gain), 6) AS mean_gain,
  round(coalesce(stddev_samp(gain), 0), 6) AS sd_gain, round(avg(minutes), 6) AS mean_minutes, round(avg(d), 6) AS mean_diff, CASE WHEN count(d) > 0 THEN round(coalesce(stddev_samp(d), 0), 6) END AS sd_diff,
  sum((d > 0)::INT)::BIGINT AS wins, round(avg(100 * test_gain), 6) AS mean_test_gain, round(avg(dt), 6) AS mean_test_diff FROM j GROUP BY 1""")
def a23(spark, sf):
    return rounded(V.policy_summary(priced(spark, sf), 2))


@check("a24_repriced_returns", uses="episode", sql="""
SELECT policy, lam, round(avg(100 * (miou_final - miou0) - lam * minutes), 6) AS mean_return FROM episode, (SELECT unnest([0.0, 1.0, 5.0])::DOUBLE AS lam) GROUP BY 1, 2""")
def a24(spark, sf):
    return V.reprice(D.episode(spark, sf), [0, 1, 5]).groupBy("policy", "lam").agg(
        F.round(F.avg("return"), 6).alias("mean_return"))


@check("a25_paired_interval", uses="episode", sql=f""", {PRICED}, d AS (SELECT e.policy, b.ret - e.ret AS d FROM ep e JOIN ep b ON b.policy = 2 AND b.seed = e.seed WHERE e.policy <> 2)
SELECT policy, round(avg(d), 5) AS mean_diff, round(avg(d) - 1.96 * stddev_samp(d) / sqrt(count(d)), 5) AS low, round(avg(d) + 1.96 * stddev_samp(d) / sqrt(count(d)), 5) AS high,
  sum((d > 1e-9)::INT)::BIGINT AS better, sum((d < -1e-9)::INT)::BIGINT AS worse FROM d GROUP BY 1""")
def a25(spark, sf):
    p = V.paired_with(priced(spark, sf), "policy", 2, ["seed"], "return")
    return rounded(V.paired_interval(p, ["policy"]), 5)


@check("a27_spearman", uses="episode", sql="""
, p AS (SELECT e.policy, e.seed, b.miou_final AS x, e.miou_final AS y FROM episode e JOIN episode b ON b.policy = 1 AND b.seed = e.seed WHERE e.policy <> 1),
r AS (SELECT policy, rank() OVER (PARTITION BY policy ORDER BY x) + (count(*) OVER (PARTITION BY policy, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY policy ORDER BY y) + (count(*) OVER (PARTITION BY policy, y) - 1) / 2 AS ry FROM p)
SELECT policy, round(corr(rx, ry), 6) AS rho, count(*) AS n FROM r GROUP BY 1""")
def a27(spark, sf):
    e = D.episode(spark, sf)
    b = e.filter("policy = 1").select("seed", F.col("miou_final").alias("x"))
    return rounded(V.spearman(e.filter("policy <> 1").join(b, "seed").withColumn("y", F.col("miou_final")),
                              ["policy"], "x", "y"))


@check("a27_seed_pair_spearman", uses="episode", sql="""
, p AS (SELECT a.seed AS sa, b.seed AS sb, a.miou_final AS x, b.miou_final AS y FROM episode a JOIN episode b ON a.policy = b.policy AND a.seed < b.seed),
r AS (SELECT sa, sb, rank() OVER (PARTITION BY sa, sb ORDER BY x) + (count(*) OVER (PARTITION BY sa, sb, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY sa, sb ORDER BY y) + (count(*) OVER (PARTITION BY sa, sb, y) - 1) / 2 AS ry FROM p)
SELECT sa, sb, round(corr(rx, ry), 6) AS rho, count(*) AS n FROM r GROUP BY 1, 2""")
def a27b(spark, sf):
    e = D.episode(spark, sf)
    a = e.select("policy", F.col("seed").alias("sa"), F.col("miou_final").alias("x"))
    b = e.select("policy", F.col("seed").alias("sb"), F.col("miou_final").alias("y"))
    return rounded(V.spearman(a.join(b, "policy").filter("sa < sb"), ["sa", "sb"], "x", "y"))


@check("w9_run_status", uses="run_event", sql="""
, s AS (SELECT run, list(step ORDER BY pos) AS last_steps FROM (SELECT * FROM run_event WHERE event = 'step' QUALIFY row_number() OVER (PARTITION BY run ORDER BY pos DESC) <= 60) GROUP BY 1)
SELECT run, CASE WHEN count(*) FILTER (WHERE event = 'error') > 0 THEN 'error' ELSE 'stopped' END AS phase, max(miou) FILTER (WHERE event = 'eval') AS best_miou,
  arg_max(msg, pos) FILTER (WHERE event = 'error') AS error, count(*) FILTER (WHERE event = 'eval') AS evals, array_to_string(any_value(last_steps), ',') AS last_steps
FROM run_event LEFT JOIN s USING (run) GROUP BY 1""")
def w9(spark, sf):
    return V.run_status(D.run_event(spark, sf), 60).withColumn(
        "last_steps", F.array_join(F.col("last_steps").cast("array<string>"), ","))


# -- scalar functions -------------------------------------------------------------------------------


@check("f1_hash_buckets", uses="capture", sql=f"""
SELECT pos, {hashed('md5', 'dir', 10000)} AS split_bucket, {hashed('md5', "'fold:' || dir", 7)} AS fold, {hashed('sha1', "'replicate:' || dir", 100)} AS replicate_bucket FROM capture""")
def f1(spark, sf):
    return D.capture(spark, sf).select("pos", X.md5_bucket("dir", 10000).alias("split_bucket"),
                                       X.fold_of("dir", 7).alias("fold"),
                                       X.sha1_bucket("dir", 100, "replicate:").alias("replicate_bucket"))


@check("f3_scene_ids", sql="""
SELECT page_id, trim(regexp_replace(split_part(url, '/', -2) || '__' || split_part(url, '/', -1), '[^A-Za-z0-9_-]+', '-', 'g'), '-') || '-' || substr(sha1(url), 1, 6) AS scene_id FROM pages""")
def f3(spark, sf):
    return D.table(spark, sf, "pages").select("page_id", X.stable_scene_id("url").alias("scene_id"))


@check("f4_labeller_names", sql=r"""
SELECT doc_id, coalesce(nullif(substr(trim(regexp_replace(regexp_replace(text, '[\x00-\x1f\x7f]', '', 'g'), '\s+', ' ', 'g')), 1, 40), ''), 'anon') AS name FROM documents""")
def f4(spark, sf):
    return D.table(spark, sf, "documents").select("doc_id", X.clean_labeller("text", "anon").alias("name"))


@check("f5_path_parts", uses="capture scene_dim", sql="""
SELECT pos::VARCHAR AS key, CASE WHEN pos % 5 = 0 THEN CASE WHEN pos % 10 = 0 THEN 'NODE7' END ELSE split_part(dir, '/', 1) || '/' || split_part(dir, '/', 2) END AS session FROM capture
UNION ALL SELECT replace(session || '/' || stem, ' ', '_'), split_part(scene_dir, '/', -2) FROM scene_dim""")
def f5(spark, sf):
    d = F.when(F.col("pos") % 5 == 0, F.concat(
        F.lit("NODE7/"), F.when(F.col("pos") % 10 == 0, "0").otherwise(""),
        F.element_at(F.split("dir", "/"), 3))).otherwise(F.col("dir"))
    a = D.capture(spark, sf).select(F.col("pos").cast("string").alias("key"),
                                    X.session_of(d, ["NODE7"], ["archive-a", "archive-b"]).alias("session"))
    b = D.scene_dim(spark, sf).select(X.scene_key("session", "stem").alias("key"),
                                      X.parent_name("scene_dir").alias("session"))
    return a.unionByName(b)


@check("f6_loose_times", sql="""
, x AS (SELECT 1) SELECT event_id, try_strptime('202401' || lpad((event_id % 31 + 1)::VARCHAR, 2, '0') || c, '%Y%m%d%H%M%S') AS t FROM (
  SELECT event_id, rpad(CASE WHEN length(r) < 4 THEN lpad(r, 4, '0') ELSE r END, 6, '0') AS c FROM (SELECT event_id, (event_id * 7919 % 250000)::VARCHAR AS r FROM events))""".replace(", x AS (SELECT 1) ", ""))
def f6(spark, sf):
    day = F.concat(F.lit("202401"), F.lpad((F.col("event_id") % 31 + 1).cast("string"), 2, "0"))
    return D.table(spark, sf, "events").select(
        "event_id", X.loose_time(day, (F.col("event_id") * 7919 % 250000).cast("string")).alias("t"))


@check("f7_time_formats", sql="SELECT event_id, strftime(ts, '%Y%m%d-%H%M%S') AS manifest, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS log FROM events")
def f7(spark, sf):
    return D.table(spark, sf, "events").select("event_id", X.manifest_time("ts").alias("manifest"),
                                               X.log_time("ts").alias("log"))


@check("f8_score_functions", uses="prob_px px", sql="""
SELECT scene_id, y, x, round(p[1], 6) AS p0, round(p[4], 6) AS p3, round(-list_sum(list_transform(p, lambda v: v * ln(v + 1e-9))), 5) AS ent,
  list_position(p, list_max(p)) - 1 AS cls, round(1 / (1 + exp(-(r - 120) / 30.0)), 6) AS sig, round(sqrt(r * r + g * g), 6) AS hyp, greatest(0.1, least(0.9, r / 255.0::DOUBLE)) AS clipped FROM prob_px JOIN px USING (scene_id, y, x)""")
def f8(spark, sf):
    z = D.logit_px(spark, sf).select("scene_id", "y", "x", X.softmax("z").alias("p"))
    j = z.join(D.px(spark, sf).select("scene_id", "y", "x", "r", "g"), ["scene_id", "y", "x"])
    return j.select("scene_id", "y", "x", F.round(F.col("p")[0], 6).alias("p0"), F.round(F.col("p")[3], 6).alias("p3"),
                    F.round(X.entropy("p"), 5).alias("ent"), X.argmax("p").alias("cls"),
                    F.round(X.sigmoid((F.col("r") - 120) / 30.0), 6).alias("sig"),
                    F.round(F.hypot("r", "g"), 6).alias("hyp"), X.clip(F.col("r") / 255.0, 0.1, 0.9).alias("clipped"))


@check("f9_json_maps", sql="""SELECT event_id, (props->>'k')::DOUBLE AS k, CASE WHEN props IS NULL THEN NULL ELSE '{"k":' || (props->>'k') || '.0}' END AS text FROM events""")
def f9(spark, sf):
    m = X.number_map("props")
    return D.table(spark, sf, "events").select("event_id", m["k"].alias("k"), X.map_json(m).alias("text"))


@check("f10_grey", uses="px", sql="SELECT scene_id, y, x, round(0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b, 4) AS grey FROM px")
def f10(spark, sf):
    return D.px(spark, sf).select("scene_id", "y", "x", F.round(X.grey(), 4).alias("grey"))


@check("f11_seed_lists", sql="""
SELECT n_nationkey, unnest(CASE WHEN n_nationkey % 2 = 0 THEN range(n_nationkey::BIGINT, n_nationkey + n_regionkey + 1) ELSE [n_nationkey::BIGINT, 7] END) AS seed FROM nation""")
def f11(spark, sf):
    k = F.col("n_nationkey")
    spec = F.when(k % 2 == 0, F.concat(k.cast("string"), F.lit("-"), (k + F.col("n_regionkey")).cast("string"))
                  ).otherwise(F.concat(k.cast("string"), F.lit(",7")))
    return D.table(spark, sf, "nation").select("n_nationkey", F.explode(X.seed_list(spec)).alias("seed"))

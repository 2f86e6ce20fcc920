"""Decision-log operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import derived as D
from checks.registry import check
from maskloom.functions.scalars import is_replicate
from maskloom.operators import decisions as L
from maskloom.operators import evaluation as V
from maskloom.schemas import GOLD_ROUTES
from maskloom.sources import tables as T


def hashed(algo: str, key: str, modulus: int) -> str:
    """Remainder of a hex digest, 32 bits at a time."""
    e = "0"
    for i in range(0, 32 if algo == "md5" else 40, 8):
        e = f"((({e}) * 4294967296 + ('0x' || substr({algo}({key}), {i + 1}, 8))::BIGINT) % {modulus})"
    return e


LAST = """last AS MATERIALIZED (SELECT * FROM label_log WHERE scene_dir <> ''
  QUALIFY row_number() OVER (PARTITION BY scene_dir ORDER BY ts DESC, log_pos DESC) = 1),
who AS MATERIALIZED (SELECT scene_dir, greatest(1, count(DISTINCT annotator)) AS n_annotators FROM label_log GROUP BY 1)"""
GOLD = f"""{LAST}, gold AS MATERIALIZED (SELECT last.*, n_annotators FROM last JOIN scene_dim USING (scene_dir) JOIN who USING (scene_dir)
  WHERE has_tiff AND has_mask AND route IN ('auto_accepted', 'auto_edited', 'interactive_clicks', 'manual_from_scratch'))"""
EMPTY = """items AS MATERIALIZED (SELECT * FROM gold UNION ALL SELECT last.*, n_annotators FROM last JOIN scene_dim USING (scene_dir)
  JOIN who USING (scene_dir) SEMI JOIN eval_sets USING (scene_dir) WHERE has_tiff AND has_mask AND route = 'empty')"""


def gold(spark, sf):
    return L.gold(D.label_log(spark, sf), D.scene_dim(spark, sf))


def items(spark, sf):
    return L.gold_with_empty(D.label_log(spark, sf), D.scene_dim(spark, sf), D.eval_sets(spark, sf))


@check("w1_latest_decision", uses="label_log", sql="""
SELECT scene_id, annotator, log_pos, ts, route, active_seconds FROM label_log
QUALIFY row_number() OVER (PARTITION BY scene_id, annotator ORDER BY ts DESC, log_pos DESC) = 1""")
def w1(spark, sf):
    return L.latest(D.label_log(spark, sf), ["scene_id", "annotator"]).select(
        "scene_id", "annotator", "log_pos", "ts", "route", "active_seconds")


@check("w1_latest_per_scene", uses="label_log", sql="""
SELECT scene_dir, log_pos, route FROM label_log QUALIFY row_number() OVER (PARTITION BY scene_dir ORDER BY ts DESC, log_pos DESC) = 1""")
def w1b(spark, sf):
    return L.latest(D.label_log(spark, sf), ["scene_dir"]).select("scene_dir", "log_pos", "route")


@check("s16_mask_store", uses="label_log", sql="""
SELECT scene_id, annotator, 'masks/' || scene_id || '/' || annotator || '.png' AS mask_path, log_pos FROM label_log WHERE route NOT IN ('rejected')
QUALIFY row_number() OVER (PARTITION BY scene_id, annotator ORDER BY ts DESC, log_pos DESC) = 1""")
def s16(spark, sf):
    return T.mask_store(D.label_log(spark, sf).filter("route <> 'rejected'")).select(
        "scene_id", "annotator", "mask_path", "log_pos")


@check("p1_gold", uses="label_log scene_dim", sql=f", {GOLD} SELECT scene_dir, scene_id, log_pos, route, n_annotators FROM gold")
def p1(spark, sf):
    return gold(spark, sf).select("scene_dir", "scene_id", "log_pos", "route", "n_annotators")


@check("p1_skip_reasons", uses="label_log scene_dim", sql=f""", {LAST}
SELECT CASE WHEN route NOT IN ('auto_accepted', 'auto_edited', 'interactive_clicks', 'manual_from_scratch') THEN 'route'
  WHEN NOT coalesce(has_tiff, FALSE) THEN 'no raster' WHEN NOT coalesce(has_mask, FALSE) THEN 'no mask' ELSE 'gold' END AS reason, count(*) AS n
FROM last LEFT JOIN scene_dim USING (scene_dir) GROUP BY 1""")
def p1b(spark, sf):
    return L.skip_reasons(D.label_log(spark, sf), D.scene_dim(spark, sf))


@check("p2_approved", uses="manifest", sql="SELECT scene_dir, review_status FROM manifest WHERE review_status = 'approved' OR (review_status = 'manual' AND has_mask)")
def p2(spark, sf):
    return L.approved(D.manifest(spark, sf)).select("scene_dir", "review_status")


@check("p3_review_queue", uses="manifest", sql="SELECT scene_dir, pos FROM manifest WHERE review_status IN ('pending', 'manual') AND autolabel_status = 'ok'")
def p3(spark, sf):
    return L.review_queue(D.manifest(spark, sf), ("pending", "manual")).select("scene_dir", "pos")


@check("p4_apply_review", uses="manifest", sql="""
SELECT scene_dir, coalesce(CASE WHEN scene_id % 3 = 1 THEN CASE ['a', 'r', 'm', 's'][scene_id % 4 + 1] WHEN 'a' THEN 'approved' WHEN 'r' THEN 'rejected' WHEN 'm' THEN 'manual' END END, review_status) AS review_status FROM manifest""")
def p4(spark, sf):
    m = D.manifest(spark, sf)
    codes = F.array(*[F.lit(c) for c in "arms"])
    d = m.filter("scene_id % 3 = 1").select("scene_dir", codes[(F.col("scene_id") % 4).cast("int")].alias("code"))
    return L.apply_review(m, d).select("scene_dir", "review_status")


@check("p5_route", uses="label_log", sql="""
SELECT log_pos, CASE WHEN seed_backend IS NULL THEN CASE WHEN log_pos % 4 <> 0 THEN 'manual_from_scratch' ELSE 'empty' END
  WHEN log_pos % 5 = 0 THEN 'interactive_clicks' WHEN log_pos % 3 = 0 AND active_seconds / 50 >= 0.999 THEN 'auto_accepted' ELSE 'auto_edited' END AS route FROM label_log""")
def p5(spark, sf):
    n = F.col("log_pos")
    return D.label_log(spark, sf).select("log_pos", L.route_of(
        F.col("seed_backend").isNotNull(), n % 3, F.col("active_seconds") / 50, n % 4 != 0, n % 5 == 0)
        .alias("route"))


@check("p6_mask_source", uses="manifest", sql="""
SELECT scene_dir, CASE WHEN has_mask THEN scene_dir || '/water_mask.png' ELSE mask_path END AS mask_used,
  CASE WHEN has_mask THEN 'manual' WHEN mask_path IS NOT NULL THEN 'auto' END AS mask_kind FROM manifest""")
def p6(spark, sf):
    return L.mask_source(D.manifest(spark, sf)).select("scene_dir", "mask_used", "mask_kind")


@check("p10_registry_problems", uses="model_registry", sql="""
, m AS (SELECT *, len(string_split(bands, ',')) AS n, split_part(normalization, ':', -1) AS method FROM model_registry)
SELECT model_id, array_to_string(list_filter([
  CASE WHEN in_channels <> n::VARCHAR THEN 'in_channels.count' END,
  CASE WHEN num_classes <> '2' THEN 'num_classes.count' END,
  CASE WHEN method NOT IN ('minmax', 'meanstd', 'percentile') THEN 'normalization.unknown' END,
  CASE WHEN resize_interpolation NOT IN ('area', 'bilinear') THEN 'resize_interpolation.unknown' END,
  CASE WHEN method = 'meanstd' AND norm_mean IS NULL THEN 'norm_mean.missing' END,
  CASE WHEN method = 'meanstd' AND norm_std IS NULL THEN 'norm_std.missing' END,
  CASE WHEN method = 'percentile' AND norm_p_lo IS NULL THEN 'norm_p_lo.missing' END], lambda v: v IS NOT NULL), '; ') AS problems FROM m""")
def p10(spark, sf):
    return V.registry_problems(D.model_registry(spark, sf)).select(
        "model_id", F.array_join("problems", "; ").alias("problems"))


@check("p11_typed_registry", uses="model_registry", sql="""
SELECT model_id, array_to_string(list_sort(string_split(bands, ',')), '|') AS bands, len(string_split(classes, ','))::INT AS classes, "schema"::BIGINT AS "schema",
  in_channels::BIGINT AS in_channels, num_classes::BIGINT AS num_classes, normalization,
  CASE WHEN starts_with(normalization, 'embedded:') THEN 'raw_0_255' ELSE 'normalised' END AS input_range,
  list_sum(from_json(norm_mean, '["DOUBLE"]')) AS norm_mean, list_sum(from_json(norm_std, '["DOUBLE"]')) AS norm_std,
  list_sum(from_json(norm_p_lo, '["DOUBLE"]')) AS norm_p_lo, list_sum(from_json(norm_p_hi, '["DOUBLE"]')) AS norm_p_hi FROM model_registry""")
def p11(spark, sf):
    t = V.typed_registry(D.model_registry(spark, sf))
    sums = {c: F.aggregate(c, F.lit(0.0), lambda a, v: a + v)
            for c in ("norm_mean", "norm_std", "norm_p_lo", "norm_p_hi")}
    return t.withColumns({"bands": F.array_join(F.sort_array("bands"), "|"), "classes": F.size("classes"), **sums})


@check("p12_mask_sanity", uses="mask_px", sql="""
, s AS (SELECT CASE WHEN scene_id = 4 THEN 99 ELSE scene_id % 25 END AS grp, annotator, count(DISTINCT scene_id) AS scenes, avg((cls = 1 AND scene_id % 25 <> 3)::INT) AS w FROM mask_px
  WHERE cls <> 255 GROUP BY 1, 2)
SELECT grp, annotator, u.p AS problem FROM s, (SELECT unnest([1, 2]) AS k, unnest(['masks.empty', 'scenes.one']) AS p) u
WHERE (k = 1 AND w <= 0) OR (k = 2 AND scenes = 1)""")
def p12(spark, sf):
    m = D.mask_px(spark, sf).filter("cls <> 255")
    g = F.when(F.col("scene_id") == 4, 99).otherwise(F.col("scene_id") % 25).alias("grp")
    s = m.groupBy(g, "annotator").agg(
        F.count_distinct("scene_id").alias("scenes"),
        F.avg(((F.col("cls") == 1) & (F.col("scene_id") % 25 != 3)).cast("int")).alias("water_frac"))
    return V.mask_sanity(s).select("grp", "annotator", "problem")


DONE = """done AS MATERIALIZED (SELECT scene_id, list_sort(list(DISTINCT annotator)) AS seen FROM label_log GROUP BY 1),
pool AS (SELECT scene_dir FROM scene_dim WHERE scene_id %% 8 = 1),
lst AS MATERIALIZED (SELECT m.scene_id, m.pos, m.review_status, m.has_mask, coalesce(seen, []) AS seen, e."set" AS eval_set, p.scene_dir IS NOT NULL AS pool_queue,
  %s < 12 AS rep FROM manifest m LEFT JOIN done ON done.scene_id = m.scene_id LEFT JOIN eval_sets e ON e.scene_dir = m.scene_dir LEFT JOIN pool p ON p.scene_dir = m.scene_dir),
q AS MATERIALIZED (SELECT *, CASE WHEN list_contains(seen, 'ann9') THEN FALSE WHEN rep AND len(seen) < 2 THEN TRUE WHEN len(seen) > 0 THEN FALSE
    ELSE coalesce(review_status, 'pending') = 'pending' END AS needs_label,
  eval_set IS NOT NULL OR (rep AND len(seen) > 0 AND NOT list_contains(seen, 'ann9')) AS blind,
  CASE WHEN eval_set = 'reward' THEN 0 WHEN eval_set = 'test' THEN 1 WHEN pool_queue THEN 2 ELSE 3 END AS rank FROM lst)""" % (
    hashed("sha1", "'replicate:' || m.scene_id", 100))


def scene_list(spark, sf):
    log = D.label_log(spark, sf)
    pool = D.scene_dim(spark, sf).filter("scene_id % 8 = 1")
    return L.scene_list(D.manifest(spark, sf), log, D.eval_sets(spark, sf), pool, "ann9")


@check("p13_blind_scenes", uses="label_log scene_dim manifest eval_sets", sql=f", {DONE} SELECT scene_id, blind, NOT blind AND has_mask AS has_manual FROM q")
def p13(spark, sf):
    return scene_list(spark, sf).select("scene_id", "blind", "has_manual")


@check("p14_needs_label", uses="label_log scene_dim manifest eval_sets", sql=f", {DONE} SELECT scene_id, needs_label FROM q")
def p14(spark, sf):
    return scene_list(spark, sf).select("scene_id", "needs_label")


@check("j16_scene_list", uses="label_log scene_dim manifest eval_sets", sql=f""", {DONE}
SELECT scene_id, rank, pool_queue, eval_set, len(seen)::BIGINT AS n_labels, CASE WHEN needs_label THEN 'pending' ELSE coalesce(review_status, 'pending') END AS review_status FROM q""")
def j16(spark, sf):
    return scene_list(spark, sf).select("scene_id", "rank", "pool_queue", "eval_set", "n_labels", "review_status")


@check("w6_next_scene", uses="label_log scene_dim manifest eval_sets", sql=f""", {DONE},
o AS (SELECT scene_id, needs_label, row_number() OVER (ORDER BY rank, pos, scene_id) AS r FROM q)
SELECT a.scene_id, (SELECT arg_min(b.scene_id, CASE WHEN b.r > a.r THEN b.r ELSE b.r + 1000000 END) FROM o b WHERE b.needs_label AND b.scene_id <> a.scene_id) AS next_scene_id FROM o a""")
def w6(spark, sf):
    return L.next_scene(scene_list(spark, sf), 64)


@check("j3_timing_rows", uses="label_log log_exclusions", sql="""
SELECT log_pos, active_seconds FROM label_log l WHERE NOT EXISTS (SELECT 1 FROM log_exclusions e WHERE e.scope = 'timing' AND e.scene_id = l.scene_id AND e.ts = l.ts)""")
def j3(spark, sf):
    return L.timing_rows(D.label_log(spark, sf), D.log_exclusions(spark, sf)).select("log_pos", "active_seconds")


@check("j4_export_splits", uses="label_log scene_dim eval_sets", sql=f""", {GOLD}
SELECT scene_dir, CASE WHEN e."set" = 'reward' OR n_annotators > 3 THEN 'val' WHEN {hashed('md5', "split_part(scene_dir, '/', -1)", 10000)} < 2000 THEN 'val' ELSE 'train' END AS split
FROM gold LEFT JOIN eval_sets e USING (scene_dir) WHERE coalesce(e."set" <> 'test', TRUE)""")
def j4(spark, sf):
    g = gold(spark, sf).withColumn("n_annotators", F.when(F.col("n_annotators") > 3, 2).otherwise(1))
    return L.export_splits(g, D.eval_sets(spark, sf)).select("scene_dir", "split")


@check("w1_positional_split", uses="manifest", sql="""
SELECT scene_dir, CASE WHEN row_number() OVER (ORDER BY pos) > count(*) OVER () - greatest(1, round_even(count(*) OVER () * 0.2, 0)) THEN 'val' ELSE 'train' END AS split
FROM manifest WHERE review_status = 'approved' OR (review_status = 'manual' AND has_mask)""")
def positional(spark, sf):
    return L.positional_split(L.approved(D.manifest(spark, sf)), 0.2, block=64).select("scene_dir", "split")


MANIFEST = f"""{GOLD}, {EMPTY}, it AS MATERIALIZED (SELECT items.*, split_part(scene_dir, '/', -2) AS grp, split_part(scene_dir, '/', -1) AS stem FROM items),
bad AS (SELECT DISTINCT grp FROM it SEMI JOIN eval_sets USING (scene_dir))"""


@check("u6_gold_with_empty", uses="label_log scene_dim eval_sets", sql=f", {GOLD}, {EMPTY} SELECT scene_dir, route, n_annotators FROM items")
def u6(spark, sf):
    return items(spark, sf).select("scene_dir", "route", "n_annotators")


@check("j5_leaked_scenes", uses="label_log scene_dim eval_sets", sql=f""", {MANIFEST}
SELECT scene_dir, grp AS "group" FROM it ANTI JOIN eval_sets USING (scene_dir) WHERE grp IN (SELECT grp FROM bad)""")
def j5(spark, sf):
    d = items(spark, sf).withColumn("group", F.element_at(F.split("scene_dir", "/"), -2))
    return L.leaked(d, D.eval_sets(spark, sf)).select("scene_dir", "group")


@check("j5_scene_manifest", uses="label_log scene_dim eval_sets", sql=f""", {MANIFEST}
SELECT scene_dir, it.grp AS "group", stem, route, n_annotators, {hashed('md5', "'fold:' || it.grp", 5)} AS fold,
  CASE e."set" WHEN 'reward' THEN 'val' WHEN 'test' THEN 'test' ELSE 'train' END AS split
FROM it LEFT JOIN eval_sets e USING (scene_dir) WHERE e."set" IS NOT NULL OR it.grp NOT IN (SELECT grp FROM bad)""")
def j5b(spark, sf):
    return L.scene_manifest(items(spark, sf), D.eval_sets(spark, sf), 0.2, 0.1, 5).select(
        "scene_dir", "group", "stem", "route", "n_annotators", "fold", "split")


@check("f2_session_split", uses="label_log scene_dim", sql=f""", {GOLD}, it AS (SELECT gold.*, split_part(scene_dir, '/', -2) AS grp FROM gold),
g AS (SELECT grp, max(CASE WHEN grp = 'session 2' THEN 2 ELSE 1 END) AS n FROM it GROUP BY 1)
SELECT scene_dir, {hashed('md5', "'fold:' || it.grp", 5)} AS fold, CASE WHEN n > 1 THEN 'val' WHEN {hashed('md5', 'it.grp', 10000)} < 1500 THEN 'test'
  WHEN {hashed('md5', 'it.grp', 10000)} < 4500 THEN 'val' ELSE 'train' END AS split FROM it JOIN g USING (grp)""")
def f2(spark, sf):
    g = gold(spark, sf).withColumn("n_annotators", F.when(
        F.element_at(F.split("scene_dir", "/"), -2) == "session 2", 2).otherwise(1))
    return L.scene_manifest(g, None, 0.3, 0.15, 5).select("scene_dir", "fold", "split")


@check("j6_relocate", uses="label_log scene_dim", sql="""
, found AS (SELECT DISTINCT CASE WHEN scene_id % 4 = 0 THEN scene_dir ELSE replace(scene_dir, '/data/', '/mnt/') END AS path FROM scene_dim WHERE scene_id % 5 <> 0
  UNION SELECT replace(scene_dir, '/data/', '/old/') FROM scene_dim WHERE scene_id % 7 = 1),
ix AS (SELECT split_part(path, '/', -2) AS p, split_part(path, '/', -1) AS l, count(*) AS k, min(path) AS t FROM found GROUP BY 1, 2)
SELECT log_pos, CASE WHEN f.path IS NOT NULL THEN 'current' WHEN k = 1 THEN 'relocated' WHEN k > 1 THEN 'ambiguous' ELSE 'missing' END AS path_status,
  CASE WHEN f.path IS NULL AND k = 1 THEN t ELSE scene_dir END AS resolved_dir
FROM label_log LEFT JOIN found f ON f.path = scene_dir LEFT JOIN ix ON p = split_part(scene_dir, '/', -2) AND l = split_part(scene_dir, '/', -1)""")
def j6(spark, sf):
    s = D.scene_dim(spark, sf)
    moved = F.when(F.col("scene_id") % 4 == 0, F.col("scene_dir")).otherwise(
        F.replace("scene_dir", F.lit("/data/"), F.lit("/mnt/")))
    found = s.filter("scene_id % 5 <> 0").select(moved.alias("path")).unionByName(
        s.filter("scene_id % 7 = 1").select(F.replace("scene_dir", F.lit("/data/"), F.lit("/old/")).alias("path")))
    return L.relocate(D.label_log(spark, sf), found).select("log_pos", "path_status", "resolved_dir")


@check("a17_labellers_per_scene", uses="label_log", sql="SELECT scene_id, array_to_string(list_sort(list(DISTINCT annotator)), ',') AS labelled_by, count(DISTINCT annotator) AS n_annotators FROM label_log GROUP BY 1")
def a17(spark, sf):
    return L.labellers_per_scene(D.label_log(spark, sf)).withColumn(
        "labelled_by", F.array_join("labelled_by", ","))


@check("a18_counts", uses="label_log", sql="""
SELECT 'route' AS dimension, route AS value, count(*) AS n FROM label_log GROUP BY 2 UNION ALL
SELECT 'annotator', annotator, count(*) FROM label_log GROUP BY 2 UNION ALL
SELECT 'scene_id', scene_id::VARCHAR, count(*) FROM label_log GROUP BY 2""")
def a18(spark, sf):
    return L.counts_by(D.label_log(spark, sf), "route", "annotator", "scene_id")


@check("a37_scenes_per_root", uses="scene_dim", sql="SELECT root, count(*) AS scenes FROM scene_dim GROUP BY 1")
def a37(spark, sf):
    return D.scene_dim(spark, sf).groupBy("root").agg(F.count("*").alias("scenes"))


@check("a37_groups_per_fold", uses="scene_dim", sql=f"""
SELECT {hashed('md5', "'fold:' || session", 5)} AS fold, count(DISTINCT session) AS groups, array_to_string(list_sort(list(DISTINCT session)), ',') AS held_out FROM scene_dim GROUP BY 1""")
def a37b(spark, sf):
    from maskloom.functions.scalars import fold_of
    return V.groups_per_fold(D.scene_dim(spark, sf).select(
        F.col("session").alias("group"), fold_of("session", 5).alias("fold"))).withColumn(
        "held_out", F.array_join("held_out", ","))


@check("s1_discover_scenes", uses="inventory", sql="""
, p AS (SELECT regexp_replace(path, '/[^/]*$', '') AS scene_dir, regexp_extract(path, '[^/]*$') AS name, path, length FROM inventory),
k AS (SELECT *, list_position(['color_preserved_5_band.tiff', 'final_5_band.tiff'], name) AS pri, string_split(scene_dir, '/')[3:] AS parts FROM p)
SELECT scene_dir, name AS tiff_name, length, CASE WHEN name = 'final_5_band.tiff' THEN 'bgr_512' ELSE 'rgb_native' END AS tiff_kind FROM k
WHERE pri > 0 AND NOT list_has_any(parts, ['work', '.git']) AND len(parts) <= 3
QUALIFY row_number() OVER (PARTITION BY scene_dir ORDER BY pri, length, path) = 1""")
def s1(spark, sf):
    from maskloom.sources.scenes import discover
    return discover(D.inventory(spark, sf), "/archive", excluded=("work", ".git"), max_depth=3).select(
        "scene_dir", "tiff_name", "length", "tiff_kind")


@check("s5_manifest_upsert", uses="manifest", sql="""
, old AS (SELECT * FROM manifest WHERE scene_id % 3 <> 0), new AS (SELECT scene_dir, 'approved' AS review_status, 12.5::DOUBLE AS water_pct FROM manifest WHERE scene_id % 2 = 0)
SELECT scene_dir, coalesce(new.review_status, old.review_status) AS review_status, coalesce(new.water_pct, old.water_pct) AS water_pct,
  coalesce(old.autolabel_status, 'ok') AS autolabel_status, old.mask_path FROM old FULL JOIN new USING (scene_dir)""")
def s5(spark, sf):
    m = D.manifest(spark, sf)
    new = m.filter("scene_id % 2 = 0").select("scene_dir", F.lit("approved").alias("review_status"),
                                              F.lit(12.5).alias("water_pct"))
    old = m.filter("scene_id % 3 <> 0").select("scene_dir", "review_status", "water_pct", "autolabel_status", "mask_path")
    return T.upsert_manifest(old, new)


@check("s8_eval_violations", uses="eval_sets", sql="""
, e AS (SELECT scene_dir, "set" FROM eval_sets UNION ALL SELECT CASE WHEN scene_id % 3 = 0 THEN '' ELSE scene_dir END, CASE WHEN scene_id % 4 = 1 THEN 'pool' ELSE 'test' END FROM eval_sets)
SELECT scene_dir, 'unknown set' AS problem, count(*) AS n FROM e WHERE "set" NOT IN ('reward', 'test') GROUP BY 1
UNION ALL SELECT scene_dir, 'no scene', count(*) FROM e WHERE scene_dir = '' GROUP BY 1
UNION ALL SELECT scene_dir, 'in both sets', count(*) FROM e WHERE scene_dir <> '' AND "set" IN ('reward', 'test') GROUP BY 1 HAVING count(DISTINCT "set") > 1""")
def s8(spark, sf):
    e = D.eval_sets(spark, sf)
    s = F.col("scene_id")
    extra = e.select(F.when(s % 3 == 0, "").otherwise(F.col("scene_dir")).alias("scene_dir"),
                     F.when(s % 4 == 1, "pool").otherwise("test").alias("set"))
    return T.eval_violations(e.select("scene_dir", "set").unionByName(extra))


@check("s9_exclusions", uses="log_exclusions", sql="SELECT DISTINCT scene_id, ts FROM log_exclusions WHERE scope = 'timing'")
def s9(spark, sf):
    return T.exclusions(D.log_exclusions(spark, sf), "timing")


@check("s10_pool_queue", uses="scene_dim", sql="SELECT DISTINCT CASE WHEN scene_id % 6 = 0 THEN '/data/root0/x' ELSE scene_dir END AS scene_dir FROM scene_dim WHERE scene_id % 8 <> 1")
def s10(spark, sf):
    s = F.col("scene_id")
    raw = D.scene_dim(spark, sf).select(F.when(s % 8 == 1, "  ").when(s % 6 == 0, " /data/root0/x")
                                        .otherwise(F.col("scene_dir")).alias("scene_dir"))
    return T.pool_queue(raw)


@check("s12_paired_tree", uses="inventory", sql="""
, i AS (SELECT DISTINCT ['train', 'val', 'test'][length % 3 + 1] AS split, 's' || length % 40 AS stem FROM inventory WHERE length % 2 = 0),
a AS (SELECT DISTINCT ['train', 'val', 'test'][length % 3 + 1] AS split, 's' || length % 40 AS stem FROM inventory WHERE length % 5 <> 0)
SELECT split, stem FROM i JOIN a USING (split, stem)""")
def s12(spark, sf):
    from maskloom.sources.scenes import paired_tree
    inv = D.inventory(spark, sf)
    split = F.array(F.lit("train"), F.lit("val"), F.lit("test"))[(F.col("length") % 3).cast("int")]
    stem = F.concat(F.lit("s"), (F.col("length") % 40).cast("string"))
    img = inv.filter("length % 2 = 0").select(F.concat(F.lit("/d/img_dir/"), split, F.lit("/"), stem, F.lit(".tiff")).alias("path"))
    ann = inv.filter("length % 5 <> 0").select(F.concat(F.lit("/d/ann_dir/"), split, F.lit("/"), stem, F.lit(".png")).alias("path"))
    return paired_tree(img.unionByName(ann)).select("split", "stem")


@check("s14_provenance", uses="label_log scene_dim eval_sets", sql=f""", {GOLD}
SELECT CASE WHEN e."set" = 'reward' OR n_annotators > 1 THEN 'val' WHEN {hashed('md5', "split_part(scene_dir, '/', -1)", 10000)} < 2000 THEN 'val' ELSE 'train' END AS split,
  split_part(scene_dir, '/', -1) AS stem, scene_dir, route, seed_backend, n_annotators, NULL::DOUBLE AS auto_vs_final_iou, NULL::DOUBLE AS edited_pixel_frac, active_seconds,
  NULL::DOUBLE AS ensemble_agreement, NULL::DOUBLE AS ensemble_disagreement_frac, annotator, ts AS timestamp
FROM gold LEFT JOIN eval_sets e USING (scene_dir) WHERE coalesce(e."set" <> 'test', TRUE)""")
def s14(spark, sf):
    e = L.export_splits(gold(spark, sf), D.eval_sets(spark, sf))
    return T.provenance(e.withColumnRenamed("ts", "timestamp"))


@check("s15_ragged_union", uses="episode train_hist", sql="""
SELECT policy, seed, miou_final, NULL::BIGINT AS modality, NULL::BIGINT AS fold, NULL::DOUBLE AS miou FROM episode
UNION ALL SELECT NULL, NULL, NULL, modality, fold, miou FROM train_hist WHERE epoch = 0""")
def s15(spark, sf):
    a = D.episode(spark, sf).select("policy", "seed", "miou_final")
    b = D.train_hist(spark, sf).filter("epoch = 0").select("modality", "fold", "miou")
    return T.ragged_union([a, b])

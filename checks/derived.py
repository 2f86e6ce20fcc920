"""Inputs of the registered queries, derived from the given tables.

Each table exists twice: as a Spark function and as SQL text for the twin. Only integer maths and
one ``floor`` on a double are used, so both engines see the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIDE = 8  # one embedding of 64 floats is one 8x8 band


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def px(spark, sf):
    """Frames: five consecutive embeddings are the five bands of one scene; a band that is not there is null."""
    e = table(spark, sf, "embeddings")
    bands = e.groupBy(F.floor(F.col("vec_id") / 5).alias("scene_id")).agg(
        *[F.first(F.when(F.col("vec_id") % 5 == i, F.struct("embedding")), True).alias(b)
          for i, b in enumerate(("r", "g", "b", "th", "nir"))])
    cells = bands.withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit(SIDE * SIDE - 1))))

    def count(b):
        raw = F.floor((F.get(F.col(f"{b}.embedding"), F.col("pos")).cast("double") + 0.6) * 212.5)
        return F.when(F.col(b).isNotNull(), F.greatest(F.lit(0), F.least(F.lit(255), raw)).cast("int")).alias(b)

    return cells.select(
        "scene_id", F.lit(SIDE).alias("h"), F.lit(SIDE).alias("w"),
        F.expr("int(pos div 8)").alias("y"), (F.col("pos") % 8).cast("int").alias("x"),
        *[count(b) for b in ("r", "g", "b", "th", "nir")])


def mask_px(spark, sf):
    """Three labellers' class masks of every scene."""
    p = px(spark, sf).withColumn("annotator", F.explode(F.array(*[F.lit(i) for i in range(3)])))
    cls = (F.when((F.col("y") == 7) & (F.col("x") == 7), 255)
           .when(F.col("nir") < 110 + 10 * F.col("annotator"), 1)
           .when(F.least("r", "g", "b") > 130, 2).when(F.col("th") < 100, 3).otherwise(0))
    return p.select("scene_id", "annotator", "h", "w", "y", "x", cls.alias("cls"))


def auto_px(spark, sf):
    """Four automatic labellers' water masks."""
    p = px(spark, sf).withColumn("labeller", F.explode(F.array(*[F.lit(i) for i in range(4)])))
    return p.select("scene_id", "labeller", "h", "w", "y", "x",
                    (F.col("th") < 95 + 10 * F.col("labeller")).cast("int").alias("m"))


def logit_px(spark, sf):
    p = px(spark, sf)
    return p.select("scene_id", "h", "w", "y", "x", F.array(
        *[F.col(b).cast("double") / 64 for b in ("r", "g", "b", "nir")]).alias("z"))


def label_log(spark, sf):
    e = table(spark, sf, "events")
    et, scene = F.col("event_type"), (F.col("event_id") * 7) % 100
    route = (F.when(et == "click", "interactive_clicks").when(et == "view", "auto_accepted")
             .when(et == "purchase", "auto_edited")
             .when(et == "signup", F.when(F.col("event_id") % 11 == 0, "empty")
                   .otherwise("manual_from_scratch"))
             .when(scene % 10 == 3, "empty").otherwise("rejected"))
    seed = F.when(F.col("event_id") % 3 == 0, "spectral").when(F.col("event_id") % 3 == 1, "nir")
    return e.select(
        F.col("event_id").alias("log_pos"), F.date_trunc("day", "ts").cast("timestamp_ntz").alias("ts"),
        F.concat(F.lit("ann"), (F.col("user_id") % 4).cast("string")).alias("annotator"),
        scene.alias("scene_id"),
        F.concat(F.lit("/data/root"), (scene % 3).cast("string"), F.lit("/session "),
                 (scene % 7).cast("string"), F.lit("/scene-"), scene.cast("string"))
        .alias("scene_dir"),
        route.alias("route"), seed.alias("seed_backend"),
        F.col("value").alias("active_seconds"),
        F.when(et.isin("view", "purchase"), F.floor(F.col("value") * 25) / 100).alias("review_seconds"))


def log_exclusions(spark, sf):
    return (label_log(spark, sf).filter("log_pos % 29 = 0")
            .select("scene_id", "ts", F.when(F.col("log_pos") % 58 == 0, "mask")
                    .otherwise("timing").alias("scope")))


def scene_dim(spark, sf):
    e = table(spark, sf, "embeddings")
    s = e.select(F.floor(F.col("vec_id") / 5).alias("scene_id")).distinct()
    sid = F.col("scene_id")
    text = sid.cast("string")
    root = F.concat(F.lit("/data/root"), (sid % 3).cast("string"))
    sess = F.concat(F.lit("session "), (sid % 7).cast("string"))
    return s.select(
        "scene_id", sess.alias("session"), F.concat(F.lit("scene-"), text).alias("stem"),
        root.alias("root"),
        F.concat(root, F.lit("/"), sess, F.lit("/scene-"), text).alias("scene_dir"),
        (sid % 9 != 0).alias("has_mask"), (sid % 13 != 0).alias("has_tiff"))


def eval_sets(spark, sf):
    s = scene_dim(spark, sf)
    return s.filter("scene_id % 10 = 3").select(
        "scene_id", "scene_dir",
        F.when(F.col("scene_id") % 20 == 3, "reward").otherwise("test").alias("set"))


def manifest(spark, sf):
    s = scene_dim(spark, sf)
    k = F.col("scene_id") % 4
    return s.select(
        "scene_id", (F.col("scene_id") * 37 % 1000).alias("pos"), "scene_dir",
        F.when(F.col("scene_id") % 5 == 0, "failed").otherwise("ok").alias("autolabel_status"),
        F.when(F.col("scene_id") % 6 != 0, F.concat("scene_dir", F.lit("/auto.png")))
        .alias("mask_path"),
        (F.col("scene_id") % 50 * 2.0).alias("water_pct"),
        F.when(k == 0, "pending").when(k == 1, "approved").when(k == 2, "manual")
        .otherwise("rejected").alias("review_status"), "has_mask")


def ui_event(spark, sf):
    """Activity events of the labelling page, at full time resolution."""
    e = table(spark, sf, "events")
    et = F.col("event_type")
    return e.select(
        F.col("event_id").alias("pos"), (F.col("user_id") % 20).alias("scene_id"),
        F.concat(F.lit("ann"), (F.col("user_id") % 3).cast("string")).alias("annotator"),
        F.col("ts").cast("timestamp_ntz").alias("ts"),
        F.when(et == "view", "seed_shown").when(et == "click", "edit").when(et == "purchase", "save")
        .otherwise("move").alias("kind"))


def inventory(spark, sf):
    """File listing: web page paths stand in for a capture archive."""
    p = table(spark, sf, "pages")
    tail = F.regexp_extract("url", "^https?://([^?#]*?)/*(?:[?#].*)?$", 1)
    name = (F.when(F.col("page_id") % 3 == 0, "color_preserved_5_band.tiff")
            .when(F.col("page_id") % 3 == 1, "final_5_band.tiff").otherwise("water_mask.png"))
    folder = F.when(F.col("page_id") % 17 == 0, "work/").otherwise("")
    return p.select(F.concat(F.lit("/archive/"), folder, tail, F.lit("/"), name).alias("path"),
                    F.length("html").cast("long").alias("length"))


def queue_step(spark, sf):
    o = table(spark, sf, "orders")
    return o.select(
        F.expr("o_orderkey div 12").alias("queue_id"),
        (F.col("o_orderkey") % 12).cast("int").alias("t"),
        ((F.col("o_custkey") * 37 % 1001) / 1000).alias("q"),
        F.when(F.col("o_orderkey") % 17 != 0, (5 + F.col("o_custkey") % 40).cast("double"))
        .alias("manual_s"),
        (F.round(F.col("o_totalprice") * 100).cast("long") % 1000 / 2000).alias("ripu"),
        F.concat(F.lit("S"), (F.col("o_custkey") % 5).cast("string")).alias("session"))


def train_hist(spark, sf):
    o = table(spark, sf, "orders")
    return (o.groupBy((F.col("o_custkey") % 7).alias("modality"),
                      (F.col("o_orderkey") % 5).alias("fold"),
                      F.expr("(o_orderkey div 5) % 40").alias("epoch"))
            .agg(F.round(F.sum(F.round(F.col("o_totalprice") * 100).cast("long"))
                         / F.count("*") / 50000000, 4).alias("miou"),
                 F.round(F.max(F.round(F.col("o_totalprice") * 100).cast("long")) / 50000000, 4)
                 .alias("water_iou"),
                 F.round(F.min(F.when(F.col("o_custkey") % 3 == 0,
                                      F.round(F.col("o_totalprice") * 100).cast("long")))
                         / 50000000, 4).alias("boundary_f1"),
                 F.count("*").alias("n_val")))


def episode(spark, sf):
    li = table(spark, sf, "lineitem")
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    return (li.groupBy(F.col("l_linenumber").cast("long").alias("policy"),
                       (F.col("l_orderkey") % 50).alias("seed"))
            .agg(F.round(F.sum(cents) / F.count("*") / 10000000, 4).alias("miou_final"),
                 F.round(F.min(cents) / 10000000, 4).alias("miou0"),
                 F.round(F.sum(F.col("l_quantity").cast("long")) / F.count("*") / 10, 3)
                 .alias("minutes"),
                 F.round(F.max(F.when(F.col("l_orderkey") % 4 != 0, cents)) / 100000000, 4)
                 .alias("test_gain"))
            .withColumn("test_gain", F.when(F.col("seed") % 5 != 0, F.col("test_gain"))))


def capture(spark, sf):
    """Archive frames: two archives hold copies of the same session."""
    e = table(spark, sf, "events")
    copy = F.col("event_id") % 10 == 0
    return e.select(
        F.col("event_id").alias("pos"),
        F.concat(F.when(F.col("event_id") % 4 == 0, "archive-b/").otherwise("archive-a/"),
                 F.lit("S"), (F.col("user_id") % 20).cast("string"), F.lit("/f"),
                 F.expr("event_id div 2").cast("string")).alias("dir"),
        F.concat(F.lit("S"), (F.col("user_id") % 20).cast("string")).alias("session"),
        F.concat(F.lit("f"), F.expr("event_id div 2").cast("string")).alias("stem"),
        F.date_trunc("second", "ts").cast("timestamp_ntz").alias("ts"),
        F.col("value").alias("brightness"),
        copy.alias("labelled"), (F.col("event_id") % 7 != 0).alias("has_tiff"),
        *[(F.col("event_id") * k % 101 / 10).alias(f"f{i}")
          for i, k in enumerate((17, 29, 43, 71), start=1)])


def deploy_window(spark, sf):
    """Placements of node cameras: one to two windows for some sessions, one pair overlapping."""
    n = table(spark, sf, "nation").filter("n_nationkey < 20 and n_nationkey % 4 <> 3")
    k = F.col("n_nationkey")
    base = n.select(F.concat(F.lit("S"), k.cast("string")).alias("session"), k.alias("k"),
                    F.explode(F.array(F.lit(0), F.lit(1))).alias("ord"))
    return base.filter("ord = 0 or k % 2 = 0").select(
        "session", F.concat(F.lit("placement-"), F.col("ord").cast("string")).alias("name"),
        F.date_add(F.lit("2024-01-01").cast("date"), F.col("ord") * (5 + F.col("k"))).alias("from_date"),
        F.date_add(F.lit("2024-01-01").cast("date"), F.col("ord") * (5 + F.col("k")) + 10 + F.col("k"))
        .alias("to_date"), "ord")


def rating(spark, sf):
    return table(spark, sf, "labels").select(
        "doc_id", F.col("quality").alias("a"), F.col("toxic").alias("b"))


def model_registry(spark, sf):
    p = table(spark, sf, "part")
    n = F.col("p_size") % 5 + 1
    norm = F.get(F.array(*[F.lit(v) for v in (
        "minmax", "meanstd", "percentile", "embedded:meanstd", "zscore")]),
        (F.col("p_partkey") % 5).cast("int"))
    floats = F.concat(F.lit("["), F.array_join(F.array_repeat(F.lit("1.5"), n.cast("int")), ", "),
                      F.lit("]"))
    names = ("red", "green", "blue", "thermal", "nir")
    return p.select(
        F.col("p_partkey").alias("model_id"),
        F.array_join(F.slice(F.array(*[F.lit(b) for b in names]), 1, n.cast("int")), ",").alias("bands"),
        F.lit("background,water").alias("classes"), F.lit("1").alias("schema"),
        F.when(F.col("p_partkey") % 11 == 0, "9").otherwise(n.cast("string")).alias("in_channels"),
        F.when(F.col("p_partkey") % 13 == 0, "3").otherwise("2").alias("num_classes"),
        norm.alias("normalization"),
        F.when(F.col("p_partkey") % 7 == 0, "nearest").otherwise("area").alias("resize_interpolation"),
        F.when(F.col("p_partkey") % 3 != 0, floats).alias("norm_mean"),
        F.when(F.col("p_partkey") % 6 != 0, floats).alias("norm_std"),
        F.when(F.col("p_partkey") % 4 != 0, floats).alias("norm_p_lo"), floats.alias("norm_p_hi"))


def run_event(spark, sf):
    """Event lines of training runs."""
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    return o.select(
        F.concat(F.lit("run"), (F.col("o_custkey") % 9).cast("string")).alias("run"),
        k.alias("pos"),
        F.when(k % 97 == 0, "error").when(k % 10 == 0, "eval").when(k % 501 == 1, "start")
        .otherwise("step").alias("event"),
        k.alias("step"), F.expr("o_orderkey div 10").alias("epoch"),
        F.round(F.col("o_totalprice") / 500000, 4).alias("loss"),
        F.round(F.col("o_custkey") * 37 % 1001 / 1000, 4).alias("miou"),
        F.concat(F.lit("failed at "), k.cast("string")).alias("msg"))


# name -> (tables it reads, SQL)
SQL: dict[str, tuple[str, str]] = {
    "px": ("", """
SELECT scene_id, 8 AS h, 8 AS w, (i // 8)::INT AS y, (i % 8)::INT AS x,
  max(v) FILTER (WHERE band = 0) AS r, max(v) FILTER (WHERE band = 1) AS g,
  max(v) FILTER (WHERE band = 2) AS b, max(v) FILTER (WHERE band = 3) AS th,
  max(v) FILTER (WHERE band = 4) AS nir
FROM (SELECT vec_id // 5 AS scene_id, vec_id % 5 AS band, i,
        greatest(0, least(255, floor((embedding[i + 1]::DOUBLE + 0.6) * 212.5)))::INT AS v
      FROM (SELECT vec_id, embedding, unnest(range(64)) AS i FROM embeddings))
GROUP BY scene_id, i"""),
    "mask_px": ("px", """
SELECT scene_id, a AS annotator, h, w, y, x,
  CASE WHEN y = 7 AND x = 7 THEN 255 WHEN nir < 110 + 10 * a THEN 1
       WHEN least(r, g, b) > 130 THEN 2 WHEN th < 100 THEN 3 ELSE 0 END AS cls
FROM px, (SELECT unnest([0, 1, 2]) AS a)"""),
    "auto_px": ("px", """
SELECT scene_id, k AS labeller, h, w, y, x, (th < 95 + 10 * k)::INT AS m
FROM px, (SELECT unnest([0, 1, 2, 3]) AS k)"""),
    "prob_px": ("px", """
SELECT scene_id, h, w, y, x, [e0 / s, e1 / s, e2 / s, e3 / s] AS p FROM (
  SELECT *, e0 + e1 + e2 + e3 AS s FROM (
    SELECT scene_id, h, w, y, x, exp(r / 64.0 - m) AS e0, exp(g / 64.0 - m) AS e1,
      exp(b / 64.0 - m) AS e2, exp(nir / 64.0 - m) AS e3
    FROM (SELECT *, greatest(r, g, b, nir) / 64.0 AS m FROM px)))"""),
    "label_log": ("", """
SELECT event_id AS log_pos, date_trunc('day', ts)::TIMESTAMP AS ts,
  'ann' || (user_id % 4) AS annotator, (event_id * 7) % 100 AS scene_id,
  '/data/root' || ((event_id * 7) % 100 % 3) || '/session ' || ((event_id * 7) % 100 % 7)
    || '/scene-' || ((event_id * 7) % 100) AS scene_dir,
  CASE event_type WHEN 'click' THEN 'interactive_clicks' WHEN 'view' THEN 'auto_accepted'
    WHEN 'purchase' THEN 'auto_edited'
    WHEN 'signup' THEN CASE WHEN event_id % 11 = 0 THEN 'empty' ELSE 'manual_from_scratch' END
    ELSE CASE WHEN (event_id * 7) % 100 % 10 = 3 THEN 'empty' ELSE 'rejected' END END AS route,
  CASE event_id % 3 WHEN 0 THEN 'spectral' WHEN 1 THEN 'nir' END AS seed_backend,
  value AS active_seconds,
  CASE WHEN event_type IN ('view', 'purchase') THEN floor(value * 25) / 100 END AS review_seconds
FROM events"""),
    "log_exclusions": ("label_log", """
SELECT scene_id, ts, CASE WHEN log_pos % 58 = 0 THEN 'mask' ELSE 'timing' END AS scope
FROM label_log WHERE log_pos % 29 = 0"""),
    "scene_dim": ("", """
SELECT scene_id, 'session ' || (scene_id % 7) AS session, 'scene-' || scene_id AS stem,
  '/data/root' || (scene_id % 3) AS root,
  '/data/root' || (scene_id % 3) || '/session ' || (scene_id % 7) || '/scene-' || scene_id
    AS scene_dir, scene_id % 9 <> 0 AS has_mask, scene_id % 13 <> 0 AS has_tiff
FROM (SELECT DISTINCT vec_id // 5 AS scene_id FROM embeddings)"""),
    "eval_sets": ("scene_dim", """
SELECT scene_id, scene_dir, CASE WHEN scene_id % 20 = 3 THEN 'reward' ELSE 'test' END AS "set"
FROM scene_dim WHERE scene_id % 10 = 3"""),
    "manifest": ("scene_dim", """
SELECT scene_id, scene_id * 37 % 1000 AS pos, scene_dir,
  CASE WHEN scene_id % 5 = 0 THEN 'failed' ELSE 'ok' END AS autolabel_status,
  CASE WHEN scene_id % 6 <> 0 THEN scene_dir || '/auto.png' END AS mask_path,
  (scene_id % 50 * 2)::DOUBLE AS water_pct,
  CASE scene_id % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'approved' WHEN 2 THEN 'manual'
    ELSE 'rejected' END AS review_status, has_mask
FROM scene_dim"""),
    "ui_event": ("", """
SELECT event_id AS pos, user_id % 20 AS scene_id, 'ann' || (user_id % 3) AS annotator, ts,
  CASE event_type WHEN 'view' THEN 'seed_shown' WHEN 'click' THEN 'edit'
    WHEN 'purchase' THEN 'save' ELSE 'move' END AS kind
FROM events"""),
    "inventory": ("", """
SELECT '/archive/' || CASE WHEN page_id % 17 = 0 THEN 'work/' ELSE '' END
  || regexp_extract(url, '^https?://([^?#]*?)/*(?:[?#].*)?$', 1) || '/'
  || CASE page_id % 3 WHEN 0 THEN 'color_preserved_5_band.tiff' WHEN 1 THEN 'final_5_band.tiff'
     ELSE 'water_mask.png' END AS path, length(html)::BIGINT AS length
FROM pages"""),
    "queue_step": ("", """
SELECT o_orderkey // 12 AS queue_id, (o_orderkey % 12)::INT AS t,
  (o_custkey * 37 % 1001) / 1000.0::DOUBLE AS q,
  CASE WHEN o_orderkey % 17 <> 0 THEN (5 + o_custkey % 40)::DOUBLE END AS manual_s,
  (round(o_totalprice * 100)::BIGINT % 1000) / 2000.0::DOUBLE AS ripu,
  'S' || (o_custkey % 5) AS session
FROM orders"""),
    "train_hist": ("", """
SELECT o_custkey % 7 AS modality, o_orderkey % 5 AS fold, (o_orderkey // 5) % 40 AS epoch,
  round(sum(c)::BIGINT / count(*) / 50000000.0::DOUBLE, 4) AS miou,
  round(max(c) / 50000000.0::DOUBLE, 4) AS water_iou,
  round(min(c) FILTER (WHERE o_custkey % 3 = 0) / 50000000.0::DOUBLE, 4) AS boundary_f1,
  count(*) AS n_val
FROM (SELECT *, round(o_totalprice * 100)::BIGINT AS c FROM orders) GROUP BY 1, 2, 3"""),
    "episode": ("", """
SELECT l_linenumber::BIGINT AS policy, l_orderkey % 50 AS seed,
  round(sum(c)::BIGINT / count(*) / 10000000.0::DOUBLE, 4) AS miou_final,
  round(min(c) / 10000000.0::DOUBLE, 4) AS miou0,
  round(sum(l_quantity::BIGINT)::BIGINT / count(*) / 10.0::DOUBLE, 3) AS minutes,
  CASE WHEN l_orderkey % 50 % 5 <> 0 THEN
    round(max(c) FILTER (WHERE l_orderkey % 4 <> 0) / 100000000.0::DOUBLE, 4) END AS test_gain
FROM (SELECT *, round(l_extendedprice * 100)::BIGINT AS c FROM lineitem) GROUP BY 1, 2"""),
    "capture": ("", """
SELECT event_id AS pos,
  CASE WHEN event_id % 4 = 0 THEN 'archive-b/' ELSE 'archive-a/' END || 'S' || (user_id % 20)
    || '/f' || (event_id // 2) AS dir,
  'S' || (user_id % 20) AS session, 'f' || (event_id // 2) AS stem,
  date_trunc('second', ts)::TIMESTAMP AS ts, value AS brightness,
  event_id % 10 = 0 AS labelled, event_id % 7 <> 0 AS has_tiff,
  event_id * 17 % 101 / 10.0::DOUBLE AS f1, event_id * 29 % 101 / 10.0::DOUBLE AS f2,
  event_id * 43 % 101 / 10.0::DOUBLE AS f3, event_id * 71 % 101 / 10.0::DOUBLE AS f4
FROM events"""),
    "deploy_window": ("", """
SELECT 'S' || n_nationkey AS session, 'placement-' || o AS name,
  (DATE '2024-01-01' + o * (5 + n_nationkey))::DATE AS from_date,
  (DATE '2024-01-01' + o * (5 + n_nationkey) + 10 + n_nationkey)::DATE AS to_date, o AS ord
FROM nation, (SELECT unnest([0, 1]) AS o)
WHERE n_nationkey < 20 AND n_nationkey % 4 <> 3 AND (o = 0 OR n_nationkey % 2 = 0)"""),
    "rating": ("", "SELECT doc_id, quality AS a, toxic AS b FROM labels"),
    "model_registry": ("", """
SELECT p_partkey AS model_id,
  array_to_string(['red', 'green', 'blue', 'thermal', 'nir'][1:n], ',') AS bands,
  'background,water' AS classes, '1' AS "schema",
  CASE WHEN p_partkey % 11 = 0 THEN '9' ELSE n::VARCHAR END AS in_channels,
  CASE WHEN p_partkey % 13 = 0 THEN '3' ELSE '2' END AS num_classes,
  ['minmax', 'meanstd', 'percentile', 'embedded:meanstd', 'zscore'][p_partkey % 5 + 1]
    AS normalization,
  CASE WHEN p_partkey % 7 = 0 THEN 'nearest' ELSE 'area' END AS resize_interpolation,
  CASE WHEN p_partkey % 3 <> 0 THEN fl END AS norm_mean,
  CASE WHEN p_partkey % 6 <> 0 THEN fl END AS norm_std,
  CASE WHEN p_partkey % 4 <> 0 THEN fl END AS norm_p_lo, fl AS norm_p_hi
FROM (SELECT p_partkey, n, '[' || array_to_string(list_transform(range(n), lambda z: '1.5'), ', ')
        || ']' AS fl FROM (SELECT p_partkey, p_size % 5 + 1 AS n FROM part))"""),
    "run_event": ("", """
SELECT 'run' || (o_custkey % 9) AS run, o_orderkey AS pos,
  CASE WHEN o_orderkey % 97 = 0 THEN 'error' WHEN o_orderkey % 10 = 0 THEN 'eval'
    WHEN o_orderkey % 501 = 1 THEN 'start' ELSE 'step' END AS event,
  o_orderkey AS step, o_orderkey // 10 AS epoch, round(o_totalprice / 500000, 4) AS loss,
  round(o_custkey * 37 % 1001 / 1000.0::DOUBLE, 4) AS miou, 'failed at ' || o_orderkey AS msg
FROM orders"""),
}


def with_clause(names: list[str], body: str, recursive: bool = False) -> str:
    """Prefix ``body`` with the derived tables it needs, in dependency order.

    A body that starts with further CTEs starts with ``,``.
    """
    order: list[str] = []

    def need(n: str) -> None:
        for d in SQL[n][0].split():
            need(d)
        if n not in order:
            order.append(n)

    for n in names:
        need(n)
    if not order:
        return body.strip()
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ", ".join(f"{n} AS ({SQL[n][1].strip()})" for n in order) + "\n" + body.strip()

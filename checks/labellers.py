"""Rule-based labellers, prompts, agreement and ensembles."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import derived as D
from checks import sqltext as S
from checks.raster import AT, GREY, MASKS, PRED, masks, predicted, water
from checks.registry import check
from maskloom.functions.scalars import softmax
from maskloom.operators import agreement as A
from maskloom.operators import decisions as L
from maskloom.operators import ensemble as E
from maskloom.operators import evaluation as V
from maskloom.operators import labellers as B
from maskloom.operators import raster as R
from maskloom.schemas import AGREEMENT_ROUTES
from maskloom.session import durable

U = S.unit


def pct(name: str, src: str, value: str, digits: int) -> str:
    return f"""{name} AS MATERIALIZED (SELECT scene_id, quantile_cont(round({value}::DOUBLE, {digits}), 0.02) AS lo,
  quantile_cont(round({value}::DOUBLE, {digits}), 0.98) AS hi FROM {src} GROUP BY 1)"""


FUSED = f""", {GREY}, {S.gradient('tg', 'px', 'th')}, {S.separable('tb', 'tg', 'v', S.gauss(2), S.gauss(2))},
{S.local_sd('sd', 'gr', 'u')}, {S.separable('sb', 'sd', 'v', S.gauss(2), S.gauss(2))},
{pct('tp', 'tb', 'v', 2)}, {pct('sp', 'sb', 'v', 2)}, {pct('np', 'px', 'nir', 2)},
cool AS MATERIALIZED (SELECT scene_id, y, x, 1 - {U('v', 'lo', 'hi')} AS v FROM tb JOIN tp USING (scene_id)),
{S.separable('th3', 'cool', 'v', S.gauss(3), S.gauss(3))},
nd AS MATERIALIZED (SELECT scene_id, y, x, greatest(0.0, least(1.0, ((g - nir) / (g + nir + 1e-6::DOUBLE) + 1) / 2)) AS u FROM px),
lev AS (SELECT scene_id, floor(u * 255)::BIGINT AS v, count(*) AS n FROM nd GROUP BY 1, 2),
{S.otsu('ot', 'lev', 'scene_id')},
hr AS (SELECT scene_id, CASE WHEN avg(f) FILTER (WHERE y < 10) >= 0.3 THEN min(y) FILTER (WHERE f < 0.15) END AS horizon_row
  FROM (SELECT scene_id, y, avg((greatest(r, g, b) / 255.0::DOUBLE > 0.55 AND b >= r - 5)::INT) AS f FROM px GROUP BY 1, 2) GROUP BY 1),
st AS (SELECT px.scene_id, (max(nir) - min(nir))::DOUBLE AS nir_range, any_value(cut) / 255.0::DOUBLE AS ndwi_cut,
  any_value(horizon_row) AS horizon_row FROM px JOIN ot USING (scene_id) JOIN hr USING (scene_id) GROUP BY 1),
cue AS MATERIALIZED (SELECT px.scene_id, px.y, px.x, r, g, b, st.nir_range, st.ndwi_cut, st.horizon_row,
  {U('px.nir', 'np.lo', 'np.hi')} AS nir_n,
  greatest(0.0, least(1.0, (nd.u - st.ndwi_cut) / 0.15::DOUBLE + 0.5)) AS s_ndwi,
  1 - {U('sb.v', 'sp.lo', 'sp.hi')} AS s_tex, th3.v AS s_th,
  (greatest(r, g, b) / 255.0::DOUBLE > 0.78 AND (greatest(r, g, b) - least(r, g, b)) / (greatest(r, g, b) + 1e-6::DOUBLE) < 0.10) AS snow
  FROM px JOIN nd USING (scene_id, y, x) JOIN sb USING (scene_id, y, x) JOIN th3 USING (scene_id, y, x)
  JOIN st ON st.scene_id = px.scene_id JOIN np ON np.scene_id = px.scene_id JOIN sp ON sp.scene_id = px.scene_id),
fused AS MATERIALIZED (SELECT *, round(CASE WHEN horizon_row > 5 AND y < horizon_row THEN 0.0 ELSE
    CASE WHEN snow THEN 0.12::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN nir_range > 12 THEN
      1 / (1 + exp(-((0.45::DOUBLE - nir_n) / 0.12::DOUBLE))) * (0.35::DOUBLE + 0.65::DOUBLE *
        (0.4::DOUBLE * s_ndwi + 0.35::DOUBLE * s_tex + 0.25::DOUBLE * s_th) / 1.000001::DOUBLE)
      ELSE 0.55::DOUBLE * greatest(0.0, least(1.0, (s_ndwi - 0.55::DOUBLE) / 0.25::DOUBLE)) + 0.3::DOUBLE * s_tex + 0.15::DOUBLE * s_th END
    END, 9) AS prob FROM cue)"""


@check("n12_fusion_probability", uses="px", sql=FUSED + "\nSELECT scene_id, y, x, round(prob, 5) AS prob FROM fused")
def n12p(spark, sf):
    return B.fusion_probability(D.px(spark, sf)).select(*AT, F.round("prob", 5).alias("prob"))


FUSED_MASK = f"""{FUSED}, f0 AS MATERIALIZED (SELECT scene_id, y, x, (prob >= 0.5)::INT AS m FROM fused),
{S.comps('cc', 'f0')}, big AS (SELECT scene_id, comp FROM cc GROUP BY 1, 2 HAVING count(*) >= 0.003 * 64),
f1 AS MATERIALIZED (SELECT f0.scene_id, f0.y, f0.x, (big.comp IS NOT NULL)::INT AS m FROM f0 LEFT JOIN cc USING (scene_id, y, x)
  LEFT JOIN big ON big.scene_id = cc.scene_id AND big.comp = cc.comp),
{S.fill('f2', 'f1')}, {S.chain('f3', 'f2', [False, True])}"""


@check("n12_spectral_fusion", uses="px", recursive=True, sql=FUSED_MASK + "\nSELECT scene_id, y, x, m FROM f3")
def n12(spark, sf):
    return B.spectral_fusion(D.px(spark, sf)).select(*AT, "m")


@check("n12_fusion_report", uses="px", recursive=True, sql=FUSED_MASK + """
SELECT scene_id, round(max(ndwi_cut), 3) AS ndwi_otsu, round(max(nir_range), 1) AS nir_dyn_range,
  max(nir_range) > 12 AS nir_reliable, round(avg(snow::INT), 4) AS snow_guard_frac, 0.0::DOUBLE AS specular_frac,
  max(horizon_row) AS horizon_row, 0.5::DOUBLE AS prob_thresh, round(100 * avg(m), 2) AS water_pct, 'none' AS refine
FROM fused JOIN f3 USING (scene_id, y, x) GROUP BY 1""")
def n12r(spark, sf):
    p = D.px(spark, sf)
    return B.fusion_report(B.spectral_fusion(p), B.frame_statistics(p))


@check("n12_specular", uses="px", sql=f"""{FUSED},
near AS (SELECT a.scene_id, a.y, a.x, max((b.raw > 0.5)::INT) AS near FROM raw a JOIN raw b ON a.scene_id = b.scene_id AND {S.box(12)} GROUP BY 1, 2, 3)
SELECT scene_id, y, x, (greatest(r, g, b) / 255.0::DOUBLE > 0.75 AND b >= r AND nir_n < 0.5 AND near = 1 AND nir_range > 12)::INT AS spec
FROM cue JOIN near USING (scene_id, y, x)""".replace("near AS (SELECT a.scene_id", """raw AS MATERIALIZED (SELECT scene_id, y, x,
  CASE WHEN snow THEN 0.12::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN nir_range > 12 THEN
      1 / (1 + exp(-((0.45::DOUBLE - nir_n) / 0.12::DOUBLE))) * (0.35::DOUBLE + 0.65::DOUBLE *
        (0.4::DOUBLE * s_ndwi + 0.35::DOUBLE * s_tex + 0.25::DOUBLE * s_th) / 1.000001::DOUBLE)
      ELSE 0.55::DOUBLE * greatest(0.0, least(1.0, (s_ndwi - 0.55::DOUBLE) / 0.25::DOUBLE)) + 0.3::DOUBLE * s_tex + 0.15::DOUBLE * s_th END AS raw FROM cue),
near AS (SELECT a.scene_id"""))
def n12s(spark, sf):
    p = B.FusionParams(specular=True)
    return B.fusion_probability(D.px(spark, sf), p).select(*AT, "spec")


@check("w10_horizon_row", uses="px", sql="""
SELECT scene_id, CASE WHEN avg(f) FILTER (WHERE y < 10) >= 0.3 THEN min(y) FILTER (WHERE f < 0.15) END AS horizon_row
FROM (SELECT scene_id, y, avg((greatest(r, g, b) / 255.0::DOUBLE > 0.55 AND b >= r - 5)::INT) AS f FROM px GROUP BY 1, 2) GROUP BY 1""")
def w10(spark, sf):
    return B.horizon_rows(D.px(spark, sf))


def cleaned(src: str, opens: int, closes: int, out: str) -> str:
    return f"""{S.chain('z1', src, [False] * opens + [True] * opens)}, {S.fill('z2', 'z1')},
{S.chain(out, 'z2', [True] * closes + [False] * closes)}"""


@check("n13_nir_threshold", uses="px", recursive=True, sql=f"""
, lim AS (SELECT scene_id, min(nir) AS lo, max(nir) AS hi FROM px GROUP BY 1),
z0 AS MATERIALIZED (SELECT scene_id, y, x, ((nir - lo) / (hi - lo) < 0.6)::INT AS m FROM px JOIN lim USING (scene_id) WHERE hi > lo),
{cleaned('z0', 1, 1, 'z3')} SELECT scene_id, y, x, m FROM z3""")
def n13(spark, sf):
    return B.nir_threshold(D.px(spark, sf), 0.6, 1).select(*AT, "m")


@check("n13_flat_scenes", uses="px", sql="""
SELECT scene_id, 'nir' AS labeller, 'flat nir' AS error FROM px GROUP BY 1
HAVING min(CASE WHEN scene_id % 4 = 0 THEN 7 ELSE nir END) = max(CASE WHEN scene_id % 4 = 0 THEN 7 ELSE nir END)""")
def n13b(spark, sf):
    p = D.px(spark, sf).withColumn("nir", F.when(F.col("scene_id") % 4 == 0, 7).otherwise(F.col("nir")))
    return B.flat_nir_scenes(p)


@check("n14_thermal_otsu", uses="px", recursive=True, sql=f"""
, ht AS (SELECT scene_id, th::BIGINT AS v, count(*) AS n FROM px GROUP BY 1, 2),
hn AS (SELECT scene_id, nir::BIGINT AS v, count(*) AS n FROM px GROUP BY 1, 2),
{S.otsu('ot', 'ht', 'scene_id')}, {S.otsu('onn', 'hn', 'scene_id')},
z0 AS MATERIALIZED (SELECT scene_id, y, x, (th < ot.cut AND nir < onn.cut)::INT AS m FROM px JOIN ot USING (scene_id) JOIN onn USING (scene_id)),
{cleaned('z0', 2, 2, 'z3')} SELECT scene_id, y, x, m FROM z3""")
def n14(spark, sf):
    return B.thermal_otsu(D.px(spark, sf)).select(*AT, "m")


def views(spark, sf):
    return D.scene_dim(spark, sf).select("scene_id", F.col("session").alias("parent"),
                                         F.col("stem").alias("name"))


SIBLINGS = """sib AS MATERIALIZED (SELECT scene_id, ref_id FROM (
  SELECT a.scene_id, b.scene_id AS ref_id, row_number() OVER (PARTITION BY a.scene_id ORDER BY b.stem, b.scene_id) AS k,
    count(*) OVER (PARTITION BY a.scene_id) AS n
  FROM scene_dim a JOIN scene_dim b ON a.session = b.session AND a.scene_id <> b.scene_id) WHERE n >= 3 AND k <= 6)"""


@check("j10_sibling_frames", uses="scene_dim", sql=f", {SIBLINGS} SELECT * FROM sib")
def j10(spark, sf):
    return B.sibling_frames(views(spark, sf))


BG = f"""{SIBLINGS}, bg AS MATERIALIZED (SELECT sib.scene_id, y, x, quantile_cont(nir::DOUBLE, 0.5) AS bg_nir,
  quantile_cont(g::DOUBLE, 0.5) AS bg_g FROM sib JOIN px ON px.scene_id = ref_id GROUP BY 1, 2, 3)"""


@check("a33_median_background", uses="px scene_dim", sql=f", {BG} SELECT * FROM bg")
def a33(spark, sf):
    return B.background(D.px(spark, sf), views(spark, sf))


@check("n15_change", uses="px scene_dim", recursive=True, sql=f""", {BG}, {GREY},
d AS MATERIALIZED (SELECT scene_id, y, x, greatest(bg_nir - nir, 0.0) AS dr,
  greatest((g - nir) / (g + nir + 1e-6::DOUBLE) - (bg_g - bg_nir) / (bg_g + bg_nir + 1e-6::DOUBLE), 0.0) AS ri FROM px JOIN bg USING (scene_id, y, x)),
{S.gradient('gm', 'gr', 'u')}, {S.separable('tx', 'gm', 'v', S.gauss(2), S.gauss(2))},
{pct('dp', 'd', 'dr', 2)}, {pct('rp', 'd', 'ri', 4)}, {pct('xp', 'tx', 'v', 2)},
z0 AS MATERIALIZED (SELECT scene_id, y, x, (round(0.5::DOUBLE * {U('dr', 'dp.lo', 'dp.hi')} + 0.35::DOUBLE * {U('ri', 'rp.lo', 'rp.hi')}
  + 0.15::DOUBLE * (1 - {U('tx.v', 'xp.lo', 'xp.hi')}), 9) > 0.3)::INT AS m
  FROM d JOIN tx USING (scene_id, y, x) JOIN dp USING (scene_id) JOIN rp USING (scene_id) JOIN xp USING (scene_id)),
{cleaned('z0', 1, 1, 'z3')}, {S.fill('z4', 'z3')} SELECT scene_id, y, x, m FROM z4""")
def n15(spark, sf):
    return B.change_labeller(D.px(spark, sf), views(spark, sf), 0.3).select(*AT, "m")


TWO_SIZES = f"""{SIBLINGS}, fr AS (SELECT DISTINCT scene_id, CASE WHEN scene_id % 5 = 0 THEN 6 ELSE 8 END AS h, 8 - scene_id % 3 AS w FROM px),
cutpx AS MATERIALIZED (SELECT px.scene_id, y, x, nir::DOUBLE AS nir, g::DOUBLE AS g FROM px JOIN fr USING (scene_id) WHERE y < fr.h AND x < fr.w),
ends AS (SELECT s.scene_id, ref_id, c.y, c.x, r.h AS rh, r.w AS rw,
    greatest(0.0, least(r.h - 1.0, (c.y + 0.5::DOUBLE) * r.h / t.h - 0.5)) AS py, greatest(0.0, least(r.w - 1.0, (c.x + 0.5::DOUBLE) * r.w / t.w - 0.5)) AS px
  FROM sib s JOIN fr t ON t.scene_id = s.scene_id JOIN fr r ON r.scene_id = ref_id JOIN cutpx c ON c.scene_id = s.scene_id),
four AS (SELECT scene_id, ref_id, y, x, floor(py)::INT AS y0, least(floor(py)::INT + 1, rh - 1) AS y1, floor(px)::INT AS x0,
    least(floor(px)::INT + 1, rw - 1) AS x1, py - floor(py) AS fy, px - floor(px) AS fx FROM ends),
one AS (SELECT f.scene_id, f.ref_id, f.y, f.x,
    (1 - fy) * ((1 - fx) * a.nir + fx * b.nir) + fy * ((1 - fx) * c.nir + fx * d.nir) AS nir,
    (1 - fy) * ((1 - fx) * a.g + fx * b.g) + fy * ((1 - fx) * c.g + fx * d.g) AS g
  FROM four f JOIN cutpx a ON a.scene_id = ref_id AND a.y = y0 AND a.x = x0 JOIN cutpx b ON b.scene_id = ref_id AND b.y = y0 AND b.x = x1
  JOIN cutpx c ON c.scene_id = ref_id AND c.y = y1 AND c.x = x0 JOIN cutpx d ON d.scene_id = ref_id AND d.y = y1 AND d.x = x1)
SELECT scene_id, y, x, round(quantile_cont(nir, 0.5), 6) AS bg_nir, round(quantile_cont(g, 0.5), 6) AS bg_g FROM one GROUP BY 1, 2, 3"""


@check("a33_two_sizes", uses="px scene_dim", sql=f", {TWO_SIZES}")
def a33_sizes(spark, sf):
    """Frames of several sizes in a folder: siblings are resampled to each frame's size."""
    p = D.px(spark, sf).withColumns({"h": F.when(F.col("scene_id") % 5 == 0, 6).otherwise(8),
                                     "w": (8 - F.col("scene_id") % 3).cast("int")}).filter("y < h and x < w")
    return B.background(p, views(spark, sf), tile=4).select(*AT, F.round("bg_nir", 6).alias("bg_nir"), F.round("bg_g", 6).alias("bg_g"))


@check("j10_labeller_errors", uses="px scene_dim", sql="""
SELECT scene_id, 'nir' AS labeller, 'flat nir' AS error FROM px GROUP BY 1
HAVING min(CASE WHEN scene_id % 4 = 0 THEN 7 ELSE nir END) = max(CASE WHEN scene_id % 4 = 0 THEN 7 ELSE nir END)
UNION ALL SELECT scene_id, 'change', 'few siblings' FROM scene_dim JOIN
  (SELECT CASE WHEN scene_id % 11 < 9 THEN session ELSE stem END AS parent FROM scene_dim GROUP BY 1 HAVING count(*) < 4) p
  ON p.parent = CASE WHEN scene_id % 11 < 9 THEN session ELSE stem END""")
def j10_errors(spark, sf):
    p = D.px(spark, sf).withColumn("nir", F.when(F.col("scene_id") % 4 == 0, 7).otherwise(F.col("nir")))
    alone = F.when(F.col("scene_id") % 11 < 9, F.col("parent")).otherwise(F.col("name"))
    return B.labeller_errors(p, views(spark, sf).withColumn("parent", alone))


@check("n16_edge_snap")
def n16(spark, sf):
    p = D.px(spark, sf)
    return B.snap_to_edges(p, durable(B.spectral_fusion(p)))


CAND = f"""{FUSED}, {S.local_sd('sd2', 'gr', 'u')}, {pct('s2', 'sd2', 'v', 2)},
cand AS MATERIALIZED (SELECT px.scene_id, px.y, px.x, fused.prob,
  round(0.5 + 0.25 * {U('px.nir', 'np.lo', 'np.hi')} + 0.25 * {U('sd2.v', 's2.lo', 's2.hi')}, 9) AS neg
  FROM px JOIN fused USING (scene_id, y, x) JOIN sd2 USING (scene_id, y, x) JOIN np ON np.scene_id = px.scene_id JOIN s2 ON s2.scene_id = px.scene_id),
side AS (SELECT scene_id, y, x, prob AS wt, 1 AS label FROM cand WHERE prob >= 0.8
  UNION ALL SELECT scene_id, y, x, neg, 0 FROM cand WHERE prob <= 0.15),
ext AS (SELECT *, max(y) OVER (PARTITION BY scene_id, label) + 1 AS hh, max(x) OVER (PARTITION BY scene_id, label) + 1 AS ww FROM side),
cell AS (SELECT *, (y * 6 // hh) * 6 + x * 6 // ww AS cell FROM ext),
best AS (SELECT * FROM cell QUALIFY row_number() OVER (PARTITION BY scene_id, label, cell ORDER BY wt DESC, y, x) = 1),
pts AS MATERIALIZED (SELECT scene_id, y, x, label, row_number() OVER (PARTITION BY scene_id, label ORDER BY wt DESC, cell DESC) AS rank, wt
  FROM best QUALIFY rank <= 8),
bx AS MATERIALIZED (SELECT scene_id, greatest(0, min(x) - 7) AS x0, greatest(0, min(y) - 7) AS y0, least(7, max(x) + 7) AS x1, least(7, max(y) + 7) AS y1
  FROM cand WHERE prob >= 0.6 GROUP BY 1)"""


def candidates(spark, sf):
    p = D.px(spark, sf)
    return durable(B.prompt_candidates(p, B.fusion_probability(p)))


@check("t2_grid_points", uses="px", sql=f"{CAND} SELECT scene_id, label, rank::INT AS rank, y, x, round(wt, 5) AS weight FROM pts")
def t2(spark, sf):
    return B.prompt_points(candidates(spark, sf)).select(
        "scene_id", "label", "rank", "y", "x", F.round("weight", 5).alias("weight"))


@check("n17_prompt_box", uses="px", sql=f"{CAND} SELECT * FROM bx")
def n17(spark, sf):
    return B.prompt_box(candidates(spark, sf))


WEAK = """weak AS (SELECT ids.scene_id, coalesce(p.n, 0) < 3 OR x0 IS NULL OR (x1 - x0) * (y1 - y0) / 64.0 < 0.04
    OR (x1 - x0) * (y1 - y0) / 64.0 > 0.92 AS weak, x0, y0, x1, y1
  FROM (SELECT DISTINCT scene_id FROM px) ids LEFT JOIN (SELECT scene_id, count(*) AS n FROM pts WHERE label = 1 GROUP BY 1) p USING (scene_id)
  LEFT JOIN bx USING (scene_id))"""


@check("n18_prompt_fallback", uses="px", sql=f"""{CAND}, {WEAK}
SELECT scene_id, y, x, label FROM pts UNION ALL
SELECT scene_id, u.y, u.x, 1 FROM weak, (VALUES (6, 4), (6, 2), (6, 5), (7, 4)) u(y, x) WHERE weak""")
def n18(spark, sf):
    c = candidates(spark, sf)
    frames = D.px(spark, sf).filter("y = 0 and x = 0")
    pts, _ = B.with_fallback(frames, B.prompt_points(c), B.prompt_box(c))
    return pts.select("scene_id", "y", "x", "label")


@check("n18_fallback_box", uses="px", sql=f"""{CAND}, {WEAK}
SELECT scene_id, weak AS used_fallback, CASE WHEN weak THEN 0 ELSE x0 END AS x0, CASE WHEN weak THEN 3 ELSE y0 END AS y0,
  CASE WHEN weak THEN 7 ELSE x1 END AS x1, CASE WHEN weak THEN 7 ELSE y1 END AS y1 FROM weak""")
def n18b(spark, sf):
    c = candidates(spark, sf)
    frames = D.px(spark, sf).filter("y = 0 and x = 0")
    return B.with_fallback(frames, B.prompt_points(c), B.prompt_box(c))[1]


# -- agreement ------------------------------------------------------------------------------------


def binary(spark, sf):
    return D.mask_px(spark, sf).withColumn("m", (F.col("cls") == 1).cast("int")).withColumn(
        "annotator", F.concat(F.lit("ann"), F.col("annotator").cast("string")))


BIN = "bm AS MATERIALIZED (SELECT scene_id, 'ann' || annotator AS who, y, x, (cls = 1)::INT AS m FROM mask_px)"
PAIRS = """pc AS MATERIALIZED (SELECT a.scene_id, a.who AS a, b.who AS b, sum(a.m * b.m)::BIGINT AS t, sum(a.m)::BIGINT AS na,
  sum(b.m)::BIGINT AS nb, count(*) AS n FROM bm a JOIN bm b USING (scene_id, y, x) WHERE a.who < b.who GROUP BY 1, 2, 3),
ps AS MATERIALIZED (SELECT *, CASE WHEN na + nb - t = 0 THEN 1.0 ELSE t / (na + nb - t)::DOUBLE END AS iou,
  CASE WHEN na + nb = 0 THEN 1.0 ELSE 2 * t / (na + nb)::DOUBLE END AS dice,
  CASE WHEN na / n * (nb / n) + (1 - na / n) * (1 - nb / n) >= 1 THEN 1.0 ELSE
    ((n - na - nb + 2 * t) / n - (na / n * (nb / n) + (1 - na / n) * (1 - nb / n))) / (1 - (na / n * (nb / n) + (1 - na / n) * (1 - nb / n))) END AS kappa,
  (na + nb - 2 * t) / n::DOUBLE AS edited, 100 * na / n AS pa, 100 * nb / n AS pb FROM pc)"""
USABLE = """usable AS (SELECT scene_id, annotator AS who FROM label_log
  QUALIFY row_number() OVER (PARTITION BY scene_id, annotator ORDER BY ts DESC, log_pos DESC) = 1
  AND route IN ('auto_accepted', 'auto_edited', 'manual_from_scratch'))"""


def usable_masks(spark, sf):
    last = L.latest(D.label_log(spark, sf), ["scene_id", "annotator"])
    ok = last.filter(F.col("route").isin(*AGREEMENT_ROUTES)).select("scene_id", "annotator")
    return binary(spark, sf).join(ok, ["scene_id", "annotator"], "left_semi")


@check("labeller_disagreement", uses="mask_px label_log", sql=f"""
, {USABLE}, bm AS MATERIALIZED (SELECT scene_id, 'ann' || annotator AS who, y, x, (cls = 1)::INT AS m FROM mask_px
  SEMI JOIN usable ON usable.scene_id = mask_px.scene_id AND usable.who = 'ann' || mask_px.annotator), {PAIRS}
SELECT scene_id, a, b, round(iou, 4) AS iou, round(dice, 4) AS dice, round(kappa, 4) AS kappa,
  round(pa, 3) AS water_pct_a, round(pb, 3) AS water_pct_b FROM ps ORDER BY round(iou, 4), scene_id, a, b LIMIT 10""")
def labeller_disagreement(spark, sf):
    s = A.with_scores(A.pair_overlap(usable_masks(spark, sf), "annotator"))
    r = s.select("scene_id", "a", "b", *[F.round(c, 4).alias(c) for c in ("iou", "dice", "kappa")],
                 *[F.round(c, 3).alias(c) for c in ("water_pct_a", "water_pct_b")])
    return A.worst(r, 10)


@check("j1_labeller_pairs", uses="label_log", sql="""
SELECT DISTINCT l.scene_id, l.annotator AS a, r.annotator AS b FROM label_log l JOIN label_log r
ON l.scene_id = r.scene_id AND l.annotator < r.annotator""")
def j1(spark, sf):
    return A.labeller_pairs(D.label_log(spark, sf), "annotator")


@check("j2_mixed_grids", uses="mask_px", sql=f"""
, bm AS MATERIALIZED (SELECT a.scene_id, 'ann' || a.annotator AS who, a.y, a.x, CASE WHEN a.annotator = 2 THEN (c.cls = 1)::INT ELSE (a.cls = 1)::INT END AS m
  FROM mask_px a JOIN mask_px c ON c.scene_id = a.scene_id AND c.annotator = a.annotator AND c.y = a.y // 2 * 2 AND c.x = a.x // 2 * 2), {PAIRS}
SELECT scene_id, a, b, t AS both, na AS in_a, nb AS in_b, n AS pixels FROM pc""")
def j2(spark, sf):
    m = binary(spark, sf).drop("cls")
    small = m.filter("annotator = 'ann2' and y % 2 = 0 and x % 2 = 0").withColumns({
        "y": F.expr("int(y div 2)"), "x": F.expr("int(x div 2)"), "h": F.lit(4), "w": F.lit(4)})
    both = m.filter("annotator <> 'ann2'").unionByName(small)
    return A.pair_overlap(A.on_first_grid(both, "annotator"), "annotator")


@check("a1_mask_overlap", uses="mask_px", sql=f", {BIN}, {PAIRS} SELECT scene_id, a, b, round(iou, 6) AS iou, round(dice, 6) AS dice FROM ps")
def a1(spark, sf):
    s = A.with_scores(A.pair_overlap(binary(spark, sf), "annotator"))
    return s.select("scene_id", "a", "b", F.round("iou", 6).alias("iou"), F.round("dice", 6).alias("dice"))


@check("a2_kappa", uses="mask_px", sql=f", {BIN}, {PAIRS} SELECT scene_id, a, b, round(kappa, 6) AS kappa FROM ps")
def a2(spark, sf):
    s = A.with_scores(A.pair_overlap(binary(spark, sf), "annotator"))
    return s.select("scene_id", "a", "b", F.round("kappa", 6).alias("kappa"))


@check("a2_rating_kappa", uses="rating", sql="""
, c AS (SELECT sum(a * b)::DOUBLE AS t, sum(a)::DOUBLE AS na, sum(b)::DOUBLE AS nb, count(*)::DOUBLE AS n FROM rating)
SELECT round(((n - na - nb + 2 * t) / n - (na / n * nb / n + (1 - na / n) * (1 - nb / n))) / (1 - (na / n * nb / n + (1 - na / n) * (1 - nb / n))), 6) AS kappa FROM c""")
def a2b(spark, sf):
    c = D.rating(spark, sf).agg(F.sum(F.col("a") * F.col("b")).alias("t"), F.sum("a").alias("na"),
                                F.sum("b").alias("nb"), F.count("*").alias("n"))
    return c.select(F.round(A.kappa(*(F.col(k) for k in ("t", "na", "nb", "n"))), 6).alias("kappa"))


@check("a3_edited_fraction", uses="mask_px", sql=f", {BIN}, {PAIRS} SELECT scene_id, a, b, edited FROM ps")
def a3(spark, sf):
    return A.with_scores(A.pair_overlap(binary(spark, sf), "annotator")).select(
        "scene_id", "a", "b", "edited")


@check("a16_iou_matrix", uses="auto_px", sql="""
, c AS (SELECT a.scene_id, a.labeller AS a, b.labeller AS b, sum(a.m * b.m) AS t, sum(greatest(a.m, b.m)) AS u
  FROM auto_px a JOIN auto_px b USING (scene_id, y, x) WHERE a.labeller < b.labeller GROUP BY 1, 2, 3)
SELECT scene_id, round(avg(CASE WHEN u = 0 THEN 1.0 ELSE t / u::DOUBLE END), 6) AS agreement, count(*) AS pairs FROM c GROUP BY 1""")
def a16(spark, sf):
    m = E.mean_agreement(E.iou_matrix(D.auto_px(spark, sf), "labeller"))
    return m.withColumn("agreement", F.round("agreement", 6))


@check("a19_labeller_bias", uses="mask_px", sql=f""", {BIN}, {PAIRS}
SELECT who, round(avg(p), 4) AS mean_water_pct, count(*) AS n FROM (SELECT a AS who, pa AS p FROM ps UNION ALL SELECT b, pb FROM ps) GROUP BY 1""")
def a19(spark, sf):
    s = A.with_scores(A.pair_overlap(binary(spark, sf), "annotator"))
    return A.labeller_bias(s).withColumn("mean_water_pct", F.round("mean_water_pct", 4))


@check("a20_agreement_summary", uses="mask_px", sql=f""", {BIN}, {PAIRS}
SELECT count(*) AS pairs, round(avg(round(iou, 4)), 6) AS mean, round(quantile_cont(round(iou, 4), 0.5), 6) AS median, min(round(iou, 4)) AS least FROM ps""")
def a20(spark, sf):
    s = A.with_scores(A.pair_overlap(binary(spark, sf), "annotator"))
    return A.agreement_summary(s, "iou").select(
        "pairs", F.round("mean", 6).alias("mean"), F.round("median", 6).alias("median"), "least")


@check("a21_usability_disputes", uses="label_log", sql="""
, l AS (SELECT scene_id, (route IN ('auto_accepted', 'auto_edited', 'manual_from_scratch'))::INT AS u FROM label_log
  QUALIFY row_number() OVER (PARTITION BY scene_id, annotator ORDER BY ts DESC, log_pos DESC) = 1)
SELECT scene_id, sum(u)::BIGINT AS with_mask, count(*) AS labellers FROM l GROUP BY 1 HAVING max(u) > min(u)""")
def a21(spark, sf):
    return A.usability_disputes(L.latest(D.label_log(spark, sf), ["scene_id", "annotator"]), AGREEMENT_ROUTES)


@check("t1_worst_pairs", uses="mask_px", sql=f""", {BIN}, {PAIRS}
SELECT scene_id, a, b, round(iou, 6) AS iou FROM ps ORDER BY round(iou, 6), scene_id, a, b LIMIT 10""")
def t1(spark, sf):
    s = A.with_scores(A.pair_overlap(binary(spark, sf), "annotator"))
    return A.worst(s.select("scene_id", "a", "b", F.round("iou", 6).alias("iou")), 10)


@check("n7_boundary_f1", uses="mask_px", sql=f"""
, {BIN}, hi AS MATERIALIZED (SELECT a.scene_id, a.who, a.y, a.x, max(b.m) - min(b.m) AS m FROM bm a JOIN bm b ON a.scene_id = b.scene_id AND a.who = b.who AND {S.box(1)} GROUP BY 1, 2, 3, 4),
{S.morph('di', 'hi', True, S.box(2), key='scene_id, who')},
ed AS MATERIALIZED (SELECT scene_id, who, y, x, hi.m AS e, di.m AS d FROM hi JOIN di USING (scene_id, who, y, x)),
s AS (SELECT scene_id, a.who AS a, b.who AS b, sum(a.e) AS ea, sum(b.e) AS eb, sum(a.e * b.d) AS ha, sum(b.e * a.d) AS hb
  FROM ed a JOIN ed b USING (scene_id, y, x) WHERE a.who < b.who GROUP BY 1, 2, 3),
f AS (SELECT *, CASE WHEN ea > 0 THEN ha / ea ELSE 0 END AS p, CASE WHEN eb > 0 THEN hb / eb ELSE 0 END AS r FROM s)
SELECT scene_id, a, b, round(CASE WHEN ea = 0 AND eb = 0 THEN NULL WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 6) AS boundary_f1 FROM f""")
def n7(spark, sf):
    m = binary(spark, sf).drop("cls")
    return A.pair_boundary_f1(m, "annotator", tolerance=2).withColumn(
        "boundary_f1", F.round("boundary_f1", 6))


# -- ensembles ------------------------------------------------------------------------------------

VOTES = "vt AS (SELECT scene_id, y, x, sum(m)::BIGINT AS votes, count(*) AS n, (sum(m) >= ceil(count(*) / 2))::INT AS consensus FROM auto_px GROUP BY 1, 2, 3)"


@check("a15_votes", uses="auto_px", sql=f""", {VOTES}
SELECT scene_id, round(avg((votes > 0 AND votes < n)::INT), 6) AS disagreement_frac, round(100 * avg(consensus), 6) AS consensus_pct FROM vt GROUP BY 1""")
def a15(spark, sf):
    return E.vote_summary(E.votes(D.auto_px(spark, sf))).select(
        "scene_id", *[F.round(c, 6).alias(c) for c in ("disagreement_frac", "consensus_pct")])


@check("n23_disagreement_map", uses="auto_px", sql=f""", {VOTES}
SELECT scene_id, y, x, CASE WHEN votes = 0 THEN 0 WHEN votes = n THEN 0 WHEN consensus = 1 THEN 245 ELSE 230 END AS red,
  CASE WHEN votes = 0 THEN 0 WHEN votes = n THEN 190 WHEN consensus = 1 THEN 180 ELSE 70 END AS green,
  CASE WHEN votes = 0 THEN 0 WHEN votes = n THEN 200 WHEN consensus = 1 THEN 0 ELSE 200 END AS blue,
  CASE WHEN votes = 0 THEN 0 WHEN votes = n THEN 90 ELSE floor(18 + 197 * pow(1 - abs(2 * votes / n - 1), 2))::INT END AS alpha FROM vt""")
def n23(spark, sf):
    return E.disagreement_map(E.votes(D.auto_px(spark, sf)))


@check("p9_water_verdict", uses="auto_px", sql=f""", {VOTES},
s AS (SELECT scene_id, 100 * avg((votes > 0 AND votes < n)::INT) AS dis, 100 * avg(consensus) AS cons FROM vt GROUP BY 1),
t AS (SELECT scene_id, max(p) AS top FROM (SELECT scene_id, labeller, 100 * avg(m) AS p FROM auto_px GROUP BY 1, 2) GROUP BY 1)
SELECT scene_id, cons > 0.5 OR top > 2 AS water_present,
  CASE WHEN dis > 40 THEN 'strong disagreement' WHEN dis > 15 THEN 'mostly agree' ELSE 'closely agree' END AS verdict FROM s JOIN t USING (scene_id)""")
def p9(spark, sf):
    return E.ensemble_report(D.auto_px(spark, sf), "labeller").select("scene_id", "water_present", "verdict")


# -- model scores ---------------------------------------------------------------------------------


def scored(spark, sf):
    t = D.mask_px(spark, sf).filter("annotator = 0").select(*AT, F.col("cls").alias("truth"))
    return predicted(spark, sf).withColumnRenamed("cls", "pred").join(t, AT)


SCORED = f"""{PRED}, sc AS MATERIALIZED (SELECT pred.*, m.cls AS truth FROM pred JOIN (SELECT * FROM mask_px WHERE annotator = 0) m USING (scene_id, y, x))"""


@check("a4_confusion", uses="prob_px mask_px", sql=f""", {SCORED}, k AS (SELECT unnest([0, 1, 2, 3]) AS c)
SELECT t.c AS truth, p.c AS pred, count(sc.y) AS n FROM k t CROSS JOIN k p LEFT JOIN sc ON sc.truth = t.c AND sc.cls = p.c GROUP BY 1, 2""")
def a4(spark, sf):
    return V.confusion_cells(V.confusion(scored(spark, sf), 4))


@check("a5_class_scores", uses="prob_px mask_px", sql=f""", {SCORED}, v AS (SELECT * FROM sc WHERE truth <> 255),
k AS (SELECT scene_id, c, count(*) FILTER (WHERE truth = c AND cls = c) AS tp, count(*) FILTER (WHERE truth = c OR cls = c) AS u,
  count(*) FILTER (WHERE cls = c) AS np, count(*) FILTER (WHERE truth = c) AS nt, count(*) AS n FROM v, (SELECT unnest([0, 1, 2, 3]) AS c) GROUP BY 1, 2),
w AS (SELECT scene_id, max(tp / u) FILTER (WHERE c = 0 AND u > 0) AS iou_0, max(tp / u) FILTER (WHERE c = 1 AND u > 0) AS iou_1,
  max(tp / u) FILTER (WHERE c = 2 AND u > 0) AS iou_2, max(tp / u) FILTER (WHERE c = 3 AND u > 0) AS iou_3, avg(tp / u) FILTER (WHERE u > 0) AS miou,
  coalesce(max(tp / np) FILTER (WHERE c = 1 AND np > 0), 0) AS p, coalesce(max(tp / nt) FILTER (WHERE c = 1 AND nt > 0), 0) AS r, sum(tp) / max(n) AS acc, max(n) AS n FROM k GROUP BY 1)
SELECT scene_id, round(iou_0, 6) AS iou_0, round(iou_1, 6) AS iou_1, round(iou_2, 6) AS iou_2, round(iou_3, 6) AS iou_3, round(miou, 6) AS miou,
  round(p, 6) AS precision_water, round(r, 6) AS recall_water, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1_water, round(acc, 6) AS accuracy, n AS n_pixels FROM w""")
def a5(spark, sf):
    d = V.class_scores(V.confusion(scored(spark, sf), 4, ["scene_id"]), 4, ["scene_id"])
    return d.select("scene_id", *[F.round(c, 6).alias(c) for c in d.columns
                                  if c not in ("scene_id", "n_pixels")], "n_pixels")


@check("a30_prediction_stats", uses="prob_px", sql=f""", {PRED}
SELECT scene_id, round(avg(ent), 5) AS mean_entropy, avg((top < 0.6)::INT) AS low_conf_frac, avg((cls = 1)::INT) AS pred_water FROM pred GROUP BY 1""")
def a30(spark, sf):
    return V.prediction_stats(predicted(spark, sf)).withColumn("mean_entropy", F.round("mean_entropy", 5))


@check("a29_model_agreement", uses="prob_px manifest", sql=f""", {PRED}, f AS (SELECT scene_id FROM manifest ORDER BY pos, scene_id LIMIT 8),
o AS (SELECT scene_id, y, x, list_position([p[2], p[1], p[3], p[4]], list_max(p)) - 1 AS cls FROM pred)
SELECT scene_id, avg((a.cls = o.cls)::INT) AS pixel_agreement, CASE WHEN sum((a.cls = 1 OR o.cls = 1)::INT) = 0 THEN 1.0 ELSE
  sum((a.cls = 1 AND o.cls = 1)::INT) / sum((a.cls = 1 OR o.cls = 1)::INT) END AS water_iou FROM pred a JOIN o USING (scene_id, y, x) SEMI JOIN f ON f.scene_id = a.scene_id GROUP BY 1""")
def a29(spark, sf):
    p = predicted(spark, sf)
    swap = F.array(F.col("p")[1], F.col("p")[0], F.col("p")[2], F.col("p")[3])
    other = p.withColumn("cls", (F.array_position(swap, F.array_max("p")) - 1).cast("int"))
    first = D.manifest(spark, sf).orderBy("pos", "scene_id").limit(8)
    return V.model_agreement(p, other, first)


@check("j17_model_against_auto", uses="prob_px auto_px", sql=f""", {PRED}
SELECT scene_id, CASE WHEN sum(greatest(m, (cls = 1)::INT)) = 0 THEN 1.0 ELSE sum(m * (cls = 1)::INT) / sum(greatest(m, (cls = 1)::INT)) END AS iou_model_auto
FROM pred JOIN (SELECT * FROM auto_px WHERE labeller = 1) a USING (scene_id, y, x) GROUP BY 1""")
def j17(spark, sf):
    a = water(spark, sf).select(*AT, F.col("m").alias("cls"))
    return V.model_agreement(predicted(spark, sf), a).select(
        "scene_id", F.col("water_iou").alias("iou_model_auto"))


@check("a35_losses", uses="prob_px mask_px", sql=f""", {SCORED}, v AS MATERIALIZED (SELECT * FROM sc WHERE truth <> 255),
ce AS (SELECT sum(-w * ln(p[truth + 1])) / sum(w) AS ce FROM (SELECT *, [1.0, 0.5, 2.0, 1.5][truth + 1]::DOUBLE AS w FROM v)),
di AS (SELECT 1 - (2 * sum(p[2] * (truth = 1)::INT) + 1) / (sum(p[2]) + sum((truth = 1)::INT) + 1) AS dice FROM v),
e AS (SELECT c, (truth = c)::INT AS fg, round(abs((truth = c)::INT - p[c + 1]), 9) AS e, v.scene_id, y, x FROM v, (SELECT unnest([0, 1, 2, 3]) AS c)),
o AS (SELECT c, e, fg, sum(fg) OVER w AS cg, count(*) OVER w AS ck, sum(fg) OVER (PARTITION BY c) AS g FROM e WINDOW w AS (PARTITION BY c ORDER BY e DESC, fg, scene_id, y, x ROWS UNBOUNDED PRECEDING)),
j AS (SELECT c, e, 1 - (g - cg) / (g + ck - cg)::DOUBLE AS j, CASE WHEN ck = 1 THEN 0 ELSE 1 - (g - (cg - fg)) / (g + ck - 1 - (cg - fg))::DOUBLE END AS jp FROM o WHERE g > 0),
lo AS (SELECT avg(l) AS lovasz FROM (SELECT c, sum(e * (j - jp)) AS l FROM j GROUP BY 1))
SELECT round(ce, 5) AS ce, round(dice, 5) AS dice, round(lovasz, 5) AS lovasz, round(0.5 * ce + 0.25 * dice + 0.25 * lovasz, 5) AS mixed FROM ce, di, lo""")
def a35(spark, sf):
    s = scored(spark, sf).select("truth", "p")
    ce = V.cross_entropy(s, [1.0, 0.5, 2.0, 1.5])
    row = ce.select("ce", V.soft_dice(s).scalar().alias("dice"), V.lovasz(s, 4).scalar().alias("lovasz"))
    row = row.withColumn("mixed", V.mixed_loss("ce+dice+lovasz", *(F.col(c) for c in ("ce", "dice", "lovasz"))))
    return row.select(*[F.round(c, 5).alias(c) for c in row.columns])


@check("a36_fused_views", uses="prob_px px", sql="""
, q AS (SELECT a.scene_id, a.y, a.x, list_transform(range(1, 5), lambda i: (a.p[i] + b.p[5 - i]) / 2) AS p
  FROM prob_px a JOIN prob_px b ON a.scene_id = b.scene_id AND a.y = b.y AND b.x = a.x)
SELECT scene_id, y, x, floor(round(p[1], 9) * 1e5)::BIGINT AS p0, floor(round(p[2], 9) * 1e5)::BIGINT AS p1, list_position(list_transform(p, lambda v: round(v, 9)), list_max(list_transform(p, lambda v: round(v, 9)))) - 1 AS cls FROM q""")
def a36(spark, sf):
    p = D.logit_px(spark, sf).withColumn("p", softmax("z")).drop("z")
    mirrored = p.withColumns({"x": F.col("w") - 1 - F.col("x"), "p": F.reverse("p")})
    v = p.withColumn("flipped", F.lit(False)).unionByName(mirrored.withColumn("flipped", F.lit(True)))
    f = V.fuse_views(v, 4).withColumn("p", F.transform("p", lambda q: F.round(q, 9)))
    return f.select(*AT, *[F.floor(F.col("p")[i] * 1e5).alias(f"p{i}") for i in (0, 1)],
                    (F.array_position("p", F.array_max("p")) - 1).cast("int").alias("cls"))


@check("a38_class_percent", uses="mask_px", sql=f"""
SELECT scene_id, c AS cls, round(100 * sum((cls = c)::INT) / count(*), 6) AS pct FROM {MASKS}, (SELECT unnest([0, 1, 2, 3]) AS c) GROUP BY 1, 2""")
def a38(spark, sf):
    m = masks(spark, sf)
    return V.class_percentages(m, 4).withColumn("pct", F.round("pct", 6))


@check("j15_grid_check", uses="mask_px px", sql="""
, i AS (SELECT scene_id, max(y) + 1 AS ih, max(x) + 1 AS iw FROM px GROUP BY 1),
m AS (SELECT scene_id, annotator, max(y) + 1 AS mh, max(x) + 1 AS mw FROM mask_px WHERE NOT (scene_id % 11 = 0 AND annotator = 1 AND x >= 6) GROUP BY 1, 2)
SELECT scene_id, annotator, ih, iw, mh, mw FROM i JOIN m USING (scene_id) WHERE ih <> mh OR iw <> mw""")
def j15(spark, sf):
    m = D.mask_px(spark, sf).filter(~((F.col("scene_id") % 11 == 0) & (F.col("annotator") == 1) & (F.col("x") >= 6)))
    return R.grid_violations(D.px(spark, sf), m, "annotator")

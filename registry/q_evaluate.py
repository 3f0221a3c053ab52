"""Evaluation tables."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from posteria.operators import cleaning, density, evaluation as ev, labels, quantiles
from registry import views as V
from registry.util import rnd, rounded

Q, SQL = {}, {}
PRED = V.pred_sql()
SCORES = {"p1": "pred_p1", "p2": "pred_p2", "p3": "pred_p3"}
BEST = "case when pred_p1 >= pred_p2 and pred_p1 >= pred_p3 then 'p1' when pred_p2 >= pred_p3 then 'p2' else 'p3' end"
LABELLED = f"SELECT *, {BEST} AS CLASS FROM ({PRED})"


def R(expr, digits=6):
    return f"round({expr}, {digits}) + 0.0::double"


def BIN(c, low=17, high=25):
    return f"(case when {c} > {low} and {c} <= {high} then ceil({c}) - 1 end)::int"


def labelled(s, d):
    return labels.predicted_class(V.v_pred(s, d), list(SCORES.values()), list(SCORES))


Q["e01_class_counts"] = lambda s, d: ev.class_counts(V.v_obj(s, d, ["cls"]), "cls")
SQL["e01_class_counts"] = f"SELECT cls, count(*) AS n FROM ({V.obj_sql(['cls'])}) GROUP BY cls"


def e07(s, d, **how):
    return quantiles.quantiles(V.v_pred(s, d), ["z_obs", "z_sigma", "mag_g"], [0.001, 0.01, 0.1, 0.99, 0.999], **how).select(
        "name", "q", rnd("value").alias("value"))


Q["e07_quantiles"] = e07
SQL["e07_quantiles"] = " UNION ALL ".join(
    f"SELECT '{c}' AS name, {q}::double AS q, {R(f'quantile_cont({c}, {q})')} AS value FROM ({PRED})"
    for c in ("z_obs", "z_sigma", "mag_g") for q in (0.001, 0.01, 0.1, 0.99, 0.999))
Q["e07_quantiles_narrowed"] = lambda s, d: e07(s, d, left_values=5000)
SQL["e07_quantiles_narrowed"] = SQL["e07_quantiles"]

Q["e08_class_pairs"] = lambda s, d: labels.class_pairs(V.v_obj(s, d, ["cls"]), "cls")
SQL["e08_class_pairs"] = (
    "SELECT a.event_type AS one_class, b.event_type AS other_class FROM (SELECT DISTINCT event_type FROM events) a, "
    "(SELECT DISTINCT event_type FROM events) b WHERE a.event_type <> b.event_type")

OVO = " UNION ALL ".join(
    f"SELECT '{a}' AS one_class, '{b}' AS other_class, (true_class = '{a}')::int AS label, pred_{a} AS score, mag_g "
    f"FROM ({PRED}) WHERE true_class IN ('{a}','{b}')" for a in SCORES for b in SCORES if a != b)


def ovo(s, d):
    return ev.one_vs_one(V.v_pred(s, d), "true_class", SCORES, ["mag_g"])


Q["e09_roc_points"] = lambda s, d: rounded(
    ev.roc_points(ovo(s, d), "label", "score", ["one_class", "other_class"]), 9)
SQL["e09_roc_points"] = f"""
WITH o AS ({OVO}), t AS (SELECT one_class, other_class, score, sum(label) AS p, count(*) - sum(label) AS n FROM o GROUP BY ALL),
c AS (SELECT one_class, other_class, score, sum(p) OVER w AS cp, sum(n) OVER w AS cn,
  sum(p) OVER (PARTITION BY one_class, other_class) AS tp, sum(n) OVER (PARTITION BY one_class, other_class) AS tn
  FROM t WINDOW w AS (PARTITION BY one_class, other_class ORDER BY score DESC))
SELECT one_class, other_class, {R('score', 9)} AS threshold, {R('cp::double / tp', 9)} AS tpr, {R('cn::double / tn', 9)} AS fpr FROM c
UNION ALL SELECT DISTINCT one_class, other_class, NULL::double, 0.0::double, 0.0::double FROM o"""


def auc_sql(by, source, having=""):
    g = ", ".join(by)
    return f"""
WITH o AS ({source}), r AS (SELECT *, rank() OVER (PARTITION BY {g} ORDER BY score)
   + (count(*) OVER (PARTITION BY {g}, score) - 1) / 2.0::double AS mid FROM o)
SELECT {g}, sum(label)::bigint AS n_pos, (count(*) - sum(label))::bigint AS n_neg,
  case when sum(label) > 0 and sum(label) < count(*) then
  {R('(sum(case when label = 1 then mid else 0.0::double end) - sum(label) * (sum(label) + 1) / 2.0::double) / (sum(label)::double * (count(*) - sum(label))::double)')} end AS auc
FROM r GROUP BY {g} {having}"""


Q["e10_auc"] = lambda s, d: rounded(ev.auc(ovo(s, d), "label", "score", ["one_class", "other_class"]))
SQL["e10_auc"] = auc_sql(["one_class", "other_class"], OVO)
Q["e10_auc_by_magnitude"] = lambda s, d: rounded(ev.auc(
    ev.mag_bin(ovo(s, d), "mag_g").filter("mag_bin is not null"), "label", "score",
    ["one_class", "other_class", "mag_bin"], min_rows=50))
SQL["e10_auc_by_magnitude"] = auc_sql(
    ["one_class", "other_class", "mag_bin"], f"SELECT *, {BIN('mag_g')} AS mag_bin FROM ({OVO}) WHERE {BIN('mag_g')} IS NOT NULL",
    "HAVING count(*) > 50")

Q["e11_score_histogram"] = lambda s, d: rounded(
    ev.score_histogram(ovo(s, d), "label", "score", ["one_class", "other_class"]))
SQL["e11_score_histogram"] = f"""
SELECT one_class, other_class, label, bin, n, {R('n / sum(n) OVER (PARTITION BY one_class, other_class)')} AS share FROM
(SELECT one_class, other_class, label, least(floor(score * 20), 19)::int AS bin, count(*) AS n FROM ({OVO}) GROUP BY ALL)"""

Q["e12_mag_bin"] = lambda s, d: ev.mag_bin(V.v_pred(s, d).select("number", "mag_r"), "mag_r")
SQL["e12_mag_bin"] = f"SELECT number, mag_r, {BIN('mag_r')} AS mag_bin FROM ({PRED})"

Q["e13_failure_rates"] = lambda s, d: rounded(ev.failure_rates(labelled(s, d), "true_class", "CLASS", "mag_g", 17, 30))
SQL["e13_failure_rates"] = f"""
WITH c AS (SELECT {BIN('mag_g', 17, 30)} AS mag_bin, sum((true_class <> CLASS)::int)::bigint AS fails, count(*) AS n FROM ({LABELLED}) GROUP BY 1),
f AS (SELECT b::int AS mag_bin, coalesce(fails, 0)::bigint AS fails, coalesce(n, 0)::bigint AS n FROM range(17, 30) t(b) LEFT JOIN c ON c.mag_bin = b),
g AS (SELECT *, case when n > 0 then 100.0::double * fails / n end AS p FROM f)
SELECT mag_bin, fails, n, {R('p')} AS failure_pct, {R('p / sum(p) OVER ()')} AS share,
 {R('100.0::double * sum(fails) OVER (ORDER BY mag_bin) / sum(n) OVER ()')} AS cumulative_pct FROM g"""

Q["e14_confusion"] = lambda s, d: rounded(ev.confusion(labelled(s, d), "true_class", "CLASS", list(SCORES)))
GRID3 = "(SELECT * FROM (VALUES ('p1'),('p2'),('p3')) a(t), (VALUES ('p1'),('p2'),('p3')) b(p))"
SQL["e14_confusion"] = f"""
WITH c AS (SELECT true_class, CLASS, count(*) AS k FROM ({LABELLED}) GROUP BY ALL),
f AS (SELECT t, p, coalesce(k, 0)::bigint AS n FROM {GRID3} g LEFT JOIN c ON true_class = t AND CLASS = p)
SELECT t AS "true", p AS pred, n, {R('coalesce(n / nullif(sum(n) OVER (PARTITION BY t), 0), 0)')} AS share FROM f"""
Q["e14_confusion_by_magnitude"] = lambda s, d: rounded(ev.confusion(
    ev.mag_bin(labelled(s, d), "mag_g").filter("mag_bin is not null"), "true_class", "CLASS", list(SCORES), ["mag_bin"]))
SQL["e14_confusion_by_magnitude"] = f"""
WITH l AS (SELECT *, {BIN('mag_g')} AS mag_bin FROM ({LABELLED})),
c AS (SELECT mag_bin, true_class, CLASS, count(*) AS k FROM l WHERE mag_bin IS NOT NULL GROUP BY ALL),
f AS (SELECT m.mag_bin, t, p, coalesce(k, 0)::bigint AS n FROM (SELECT DISTINCT mag_bin FROM c) m CROSS JOIN {GRID3} g
  LEFT JOIN c ON c.mag_bin = m.mag_bin AND true_class = t AND CLASS = p)
SELECT mag_bin, t AS "true", p AS pred, n, {R('coalesce(n / nullif(sum(n) OVER (PARTITION BY mag_bin, t), 0), 0)')} AS share FROM f"""

REL = "abs(z_pred - z_obs) / (1 + z_obs)"


def e15(s, d, **how):
    df = V.v_pred(s, d).withColumn("rel", F.expr(REL))
    return rounded(ev.binned_residuals(df, "rel", ["mag_r", "mag_g"], **how))


Q["e15_binned_residuals"] = e15
_m = " UNION ALL ".join(f"SELECT '{m}' AS mag, {BIN(m)} AS mag_bin, {REL} AS r FROM ({PRED})" for m in ("mag_r", "mag_g"))
SQL["e15_binned_residuals"] = f"""
SELECT mag, mag_bin, {R('md')} AS median, {R('mean')} AS mean, {R('std')} AS std,
 {R('sum(md) OVER (PARTITION BY mag ORDER BY mag_bin) / sum(md) OVER (PARTITION BY mag)')} AS cumulative_share FROM
 (SELECT mag, mag_bin, median(r) AS md, avg(r) AS mean, stddev_samp(r) AS std FROM ({_m}) WHERE mag_bin IS NOT NULL GROUP BY mag, mag_bin)"""
# the way for groups of stated bound
Q["e15_binned_residuals_narrowed"] = lambda s, d: e15(s, d, bounded=True)
SQL["e15_binned_residuals_narrowed"] = SQL["e15_binned_residuals"]


def clip_sql(source, value, by=None, rounds=4):
    """Rows (g, v) left after unrolled plain-std clipping."""
    step = f"SELECT {by or '0'} AS g, {value} AS v FROM ({source})"
    for _ in range(rounds):
        step = (f"SELECT g, v FROM (SELECT *, median(v) OVER (PARTITION BY g) AS m, stddev_pop(v) OVER (PARTITION BY g) AS s "
                f"FROM ({step})) WHERE abs(v - m) <= 6 * s")
    return step


PULL = "(z_obs - z_pred) / z_sigma"
MAD = "1.482602218505602::double * median(abs(v - m))"
Q["e16_pull_distribution"] = lambda s, d: rounded(ev.pull_distribution(V.v_pred(s, d), "z_obs", "z_pred", "z_sigma"))
SQL["e16_pull_distribution"] = f"""
WITH p AS (SELECT {PULL} AS v FROM ({PRED})),
k AS (SELECT avg(v) AS cm, median(v) AS cmd, stddev_pop(v) AS cs FROM ({clip_sql('SELECT * FROM p', 'v')})),
s AS (SELECT {MAD} AS sd FROM (SELECT v, median(v) OVER () AS m FROM p)),
h AS (SELECT least(floor((v + 6) / 12 * 50), 49)::int AS bin, count(*) AS n FROM p WHERE v BETWEEN -6 AND 6 GROUP BY 1)
SELECT bin, n, {R('n / (sum(n) OVER () * 0.24::double)')} AS density,
 {R('exp(-0.5::double * pow((-6 + (bin + 0.5::double) * 0.24::double - cmd) / sd, 2)) / (sd * sqrt(2 * pi()))')} AS normal,
 {R('cm')} AS clipped_mean, {R('cmd')} AS clipped_median, {R('cs')} AS clipped_std, {R('sd')} AS mad_std FROM h, k, s"""

RES = f"SELECT true_class, z_pred - z_obs AS r FROM ({PRED})"


def with_residual(s, d):
    return V.v_pred(s, d).select("true_class", (F.col("z_pred") - F.col("z_obs")).alias("r"))


Q["e17_mad_std"] = lambda s, d: rounded(ev.mad_std(with_residual(s, d), "r", ["true_class"]))
SQL["e17_mad_std"] = (
    f"SELECT true_class, {R('any_value(m)')} AS median, {R('1.482602218505602::double * median(abs(r - m))')} AS mad_std FROM "
    f"(SELECT true_class, r, median(r) OVER (PARTITION BY true_class) AS m FROM ({RES})) GROUP BY true_class")
Q["e18_sigma_clip_stats"] = lambda s, d: rounded(ev.sigma_clip_stats(with_residual(s, d), "r", ["true_class"]))
SQL["e18_sigma_clip_stats"] = (
    f"SELECT g AS true_class, count(*) AS n_left, {R('avg(v)')} AS mean, {R('median(v)')} AS median, {R('stddev_pop(v)')} AS std "
    f"FROM ({clip_sql(RES, 'r', 'true_class')}) GROUP BY g")
Q["e18_sigma_clip_mad_overall"] = lambda s, d: rounded(ev.sigma_clip_stats(with_residual(s, d), "r", spread="mad"))
_step = f"SELECT r AS v FROM ({RES})"
for _ in range(3):
    _step = (f"SELECT v FROM (SELECT *, 1.482602218505602::double * median(abs(v - m)) OVER () AS s FROM "
             f"(SELECT *, median(v) OVER () AS m FROM ({_step}))) WHERE abs(v - m) <= 6 * s")
SQL["e18_sigma_clip_mad_overall"] = (
    f"SELECT count(*) AS n_left, {R('avg(v)')} AS mean, {R('median(v)')} AS median, {R('stddev_pop(v)')} AS std FROM ({_step})")

# --- residual projections -----------------------------------------------------------------
Q["b22_residuals"] = lambda s, d: rounded(ev.residuals(
    V.v_pred(s, d).select("number", "z_obs", "z_pred"), [("z_obs", "z_pred")], ["z_obs"]))
SQL["b22_residuals"] = (
    f"SELECT number, {R('z_obs')} AS z_obs, {R('z_pred')} AS z_pred, {R('z_pred - z_obs')} AS z_pred_residual, "
    f"{R('abs(z_pred - z_obs)')} AS z_pred_residual_abs, {R(REL)} AS z_pred_residual_rel FROM ({PRED})")
Q["b25_rotated_residuals"] = lambda s, d: rounded(ev.rotated_residuals(
    V.v_pred(s, d).select("number", "z_obs", "z_pred"), "z_obs", "z_pred").drop("z_obs", "z_pred"))
SQL["b25_rotated_residuals"] = (
    f"SELECT number, {R('(z_obs + z_pred)/sqrt(2)')} AS res_x, {R('(z_pred - z_obs)/sqrt(2)')} AS res_y FROM ({PRED})")
Q["b25_relative_residuals"] = lambda s, d: rounded(ev.rotated_residuals(
    V.v_pred(s, d).select("number", "z_obs", "z_pred"), "z_obs", "z_pred", relative=True).drop("z_obs", "z_pred"))
SQL["b25_relative_residuals"] = (
    f"SELECT number, {R('z_obs')} AS res_x, {R('(z_pred - z_obs)/(1 + z_obs)')} AS res_y FROM ({PRED})")
DEFL = (
    "SELECT number, case when z_pred > z_obs then 'above' else 'below' end AS side, "
    "case when (z_pred - z_obs)/sqrt(2) > 0 then (z_pred - z_obs)/sqrt(2) - sqrt(z_err*z_err + z_sigma*z_sigma) "
    f"else (z_pred - z_obs)/sqrt(2) + sqrt(z_err*z_err + z_sigma*z_sigma) end AS deflated FROM ({PRED})")
Q["b26_error_deflated_residuals"] = lambda s, d: rounded(ev.error_deflated_residuals(
    V.v_pred(s, d), "z_obs", "z_pred", "z_err", "z_sigma").select("number", "side", "deflated"))
SQL["b26_error_deflated_residuals"] = f"SELECT number, side, {R('deflated')} AS deflated FROM ({DEFL})"
Q["e24_above_below_stats"] = lambda s, d: rounded(ev.above_below_stats(
    V.v_pred(s, d), "z_obs", "z_pred", "z_err", "z_sigma"))
SQL["e24_above_below_stats"] = (
    f"SELECT g AS side, count(*) AS n_left, {R('avg(v)')} AS mean, {R('median(v)')} AS median, {R('stddev_pop(v)')} AS std "
    f"FROM ({clip_sql(DEFL, 'deflated', 'side')}) GROUP BY g")
Q["e25_residual_histogram"] = lambda s, d: ev.residual_histogram(with_residual(s, d), "r", -0.03, 0.03, 50, ["true_class"])
SQL["e25_residual_histogram"] = (
    f"SELECT true_class, least(floor((r - -0.03::double) / (0.03::double - -0.03::double) * 50), 49)::int AS bin, count(*) AS n FROM ({RES}) "
    "WHERE r BETWEEN -0.03::double AND 0.03::double GROUP BY ALL")

# --- densities on a grid ----------------------------------------------------------------------
B = 25
XY = f"SELECT number, z_obs AS x, z_pred AS y, z_sigma AS z FROM ({PRED})"


def xy(s, d):
    return V.v_pred(s, d).selectExpr("number", "z_obs AS x", "z_pred AS y", "z_sigma AS z")


BOX = density.Grid(0.0, 1.0, 0.0, 1.0, B, B)
CELL = f"least(floor({{0}} * {B}), {B - 1})::int"
INBOX = "x BETWEEN 0 AND 1 AND y BETWEEN 0 AND 1"
COUNTS = f"SELECT {CELL.format('x')} AS ix, {CELL.format('y')} AS iy, count(*) AS n FROM ({XY}) WHERE {INBOX} GROUP BY ALL"
Q["e19_density_2d"] = lambda s, d: density.density_2d(xy(s, d), "x", "y", BOX)
SQL["e19_density_2d"] = COUNTS
Q["e20_binned_median_2d"] = lambda s, d: rounded(density.binned_median_2d(xy(s, d), "x", "y", "z", BOX, thresh=20))
MED = (f"SELECT {CELL.format('x')} AS ix, {CELL.format('y')} AS iy, count(*) AS n, "
       f"case when count(*) >= 20 then median(z) end AS median FROM ({XY}) WHERE {INBOX} GROUP BY ALL")
SQL["e20_binned_median_2d"] = f"SELECT ix, iy, n, {R('median')} AS median FROM ({MED})"
_w = "exp(-((d.i*d.i + e.i*e.i) / 8.0::double))"
_norm = "(SELECT sum(exp(-((a.i*a.i + b.i*b.i) / 8.0::double))) FROM range(-8, 9) a(i), range(-8, 9) b(i))"
Q["e21_smooth_grid"] = lambda s, d: rounded(density.smooth_grid(
    density.density_2d(xy(s, d), "x", "y", BOX), "n", BOX, missing="zero"))
SQL["e21_smooth_grid"] = f"""
SELECT (ix + d.i)::int AS ix, (iy + e.i)::int AS iy, {R(f'sum({_w} * n) / any_value({_norm})')} AS smooth
FROM ({COUNTS}), range(-8, 9) d(i), range(-8, 9) e(i)
WHERE ix + d.i BETWEEN 0 AND {B - 1} AND iy + e.i BETWEEN 0 AND {B - 1} GROUP BY ALL"""
Q["e21_smooth_median_grid"] = lambda s, d: rounded(density.smooth_grid(
    density.binned_median_2d(xy(s, d), "x", "y", "z", BOX, thresh=20), "median", BOX, missing="interpolate"))
SQL["e21_smooth_median_grid"] = f"""
WITH m AS ({MED}), g AS (SELECT a.i AS ix, b.i AS iy, median FROM range(-8, {B + 8}) a(i) CROSS JOIN range(-8, {B + 8}) b(i)
  LEFT JOIN m ON m.ix = a.i AND m.iy = b.i),
f AS (SELECT ix, iy, case when ix BETWEEN 0 AND {B - 1} AND iy BETWEEN 0 AND {B - 1} then median else 0.0::double end AS v FROM g),
r AS (SELECT (ix + d.i)::int AS ix, (iy + e.i)::int AS iy, sum({_w} * v) AS a, sum(case when v IS NOT NULL then {_w} end) AS w,
  count(*) FILTER (v IS NOT NULL AND f.ix BETWEEN 0 AND {B - 1} AND f.iy BETWEEN 0 AND {B - 1}) AS touched
  FROM f, range(-8, 9) d(i), range(-8, 9) e(i) WHERE ix + d.i BETWEEN 0 AND {B - 1} AND iy + e.i BETWEEN 0 AND {B - 1} GROUP BY 1, 2)
SELECT ix, iy, {R('a / w')} AS smooth FROM r WHERE touched > 0"""
Q["e22_sparse_points"] = lambda s, d: rounded(density.sparse_points(xy(s, d), "x", "y", BOX, thresh=20).select("number", "x", "y"))
SQL["e22_sparse_points"] = f"""
WITH c AS ({COUNTS}), r AS (SELECT number, x, y, floor(x * {B})::int AS ix, floor(y * {B})::int AS iy FROM ({XY}) WHERE x >= 0 AND x < 1 AND y >= 0 AND y < 1)
SELECT number, {R('x')} AS x, {R('y')} AS y FROM r JOIN c USING (ix, iy) WHERE n < 20"""
HEX = density.Grid(0.0, 1.0, 0.0, 1.0, 50, 28)
Q["e23_hexbin"] = lambda s, d: rounded(density.hexbin(xy(s, d), "x", "y", 0.0, 1.0, 0.0, 1.0, 50))
SQL["e23_hexbin"] = f"""
WITH p AS (SELECT x * 50 AS a, y * 28 AS b FROM ({XY}) WHERE {INBOX}),
q AS (SELECT round_even(a, 0) AS a1, round_even(b, 0) AS b1, floor(a) AS a2, floor(b) AS b2,
 pow(a - round_even(a, 0), 2) + 3 * pow(b - round_even(b, 0), 2) < pow(a - floor(a) - 0.5, 2) + 3 * pow(b - floor(b) - 0.5, 2) AS first FROM p),
h AS (SELECT (case when first then 0 else 1 end)::int AS lattice, (case when first then a1 else a2 end)::int AS ix, (case when first then b1 else b2 end)::int AS iy FROM q)
SELECT lattice, ix, iy, count(*) AS n, {R('log10(count(*))')} AS log_n FROM h GROUP BY ALL"""
Q["e26_density_levels"] = lambda s, d: rounded(density.density_levels(density.density_2d(xy(s, d), "x", "y", BOX), "n"))
SQL["e26_density_levels"] = f"""
WITH e AS (SELECT log10(min(n)) AS lo, log10(max(n)) * 0.9::double AS hi FROM ({COUNTS}))
SELECT i::int AS level, {R('lo + (hi - lo) * i / 4.0::double')} AS value FROM e, range(0, 5) t(i)"""
Q["e26_density_levels_above"] = lambda s, d: rounded(density.density_levels(
    density.density_2d(xy(s, d), "x", "y", BOX), "n", thresh=5))
SQL["e26_density_levels_above"] = f"""
WITH e AS (SELECT log10(greatest(min(n), 5)) AS lo, greatest(0.99::double * log10(max(n)), 6.0::double) AS hi FROM ({COUNTS}))
SELECT i::int AS level, {R('lo + (hi - lo) * i / 9.0::double')} AS value FROM e, range(0, 10) t(i)"""

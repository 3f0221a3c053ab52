"""Scalar features, cleaning, scaling, labels, joins, sampling."""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import functions as F

from posteria.operators import cleaning, features, joins, labels, ranks, sampling, scaling, sets
from registry import views as V
from registry.util import rnd, rounded

Q, SQL = {}, {}
OBJ = V.obj_sql()
FLUX = ["flux_aper_1", "flux_aper_2", "flux_aper_3"]
REL = ["flux_relerr_aper_1", "flux_relerr_aper_2", "flux_relerr_aper_3"]
MAGS = ["mag_r", "mag_g", "mag_i"]


def R(expr, digits=6):
    return f"round({expr}, {digits}) + 0.0::double"


def clean_sql(c):
    return f"case when {c} > -999 then {c} end"


# --- B: filters and missing values ------------------------------------------------
Q["b01_filter_class"] = lambda s, d: cleaning.filter_class(
    V.v_obj(s, d, ["tile_id", "number", "cls"]), "cls", ["click", "view"])
SQL["b01_filter_class"] = f"SELECT tile_id, number, cls FROM ({OBJ}) WHERE cls IN ('click','view')"

Q["b02_sentinel_to_null"] = lambda s, d: cleaning.sentinel_to_null(
    V.v_obj(s, d, ["number", "flux_aper_1", "flux_aper_2"]), ["flux_aper_1", "flux_aper_2"])
SQL["b02_sentinel_to_null"] = (
    f"SELECT number, {clean_sql('flux_aper_1')} AS flux_aper_1, {clean_sql('flux_aper_2')} AS flux_aper_2 FROM ({OBJ})")

Q["b02_sentinel_strict"] = lambda s, d: cleaning.sentinel_to_null(
    V.v_obj(s, d, ["number", "flux_aper_1"]), ["flux_aper_1"], rule="<")
SQL["b02_sentinel_strict"] = (
    f"SELECT number, case when flux_aper_1 >= -999 then flux_aper_1 end AS flux_aper_1 FROM ({OBJ})")

Q["b03_missing_mag_to_null"] = lambda s, d: cleaning.missing_mag_to_null(V.v_obj(s, d, ["number", *MAGS]), MAGS)
SQL["b03_missing_mag_to_null"] = f"SELECT number, {', '.join(f'nullif({m}, 99.0) AS {m}' for m in MAGS)} FROM ({OBJ})"


def _with_target(s, d):
    df = V.v_obj(s, d, ["number", "flux_aper_1", "mag_r"])
    return cleaning.sentinel_to_null(df, ["flux_aper_1"])


Q["b04_drop_null_targets"] = lambda s, d: cleaning.drop_null_targets(_with_target(s, d), ["flux_aper_1"], ["mag_r"])
SQL["b04_drop_null_targets"] = f"SELECT number, flux_aper_1, mag_r FROM ({OBJ}) WHERE flux_aper_1 > -999"
Q["b04_label_null_targets"] = lambda s, d: cleaning.label_null_targets(_with_target(s, d), ["flux_aper_1"])
SQL["b04_label_null_targets"] = (
    f"SELECT number, coalesce({clean_sql('flux_aper_1')}, -999.0::double) AS flux_aper_1, mag_r FROM ({OBJ})")


def b05(s, d):
    df = V.v_obj(s, d)
    flux, err = features.photometry_columns(df.columns)
    return df.select("number", *flux, *err)


Q["b05_photometry_columns"] = b05
SQL["b05_photometry_columns"] = f"SELECT number, {', '.join(FLUX + REL)} FROM ({OBJ})"


def b06(s, d):
    df = V.v_obj(s, d, ["number", "mag_r", "mag_g", "pmra_g", "mag_err_r", "e_pmra_g"])
    return features.attach_errors(df, ["mag_r", "mag_g", "pmra_g"]).select(
        "number", "mag_r", "mag_r__err", "mag_g__err", "pmra_g__err")


Q["b06_attach_errors"] = b06
SQL["b06_attach_errors"] = (
    "SELECT number, mag_r, mag_err_r AS mag_r__err, NULL::double AS mag_g__err, e_pmra_g AS pmra_g__err "
    f"FROM ({OBJ})")

Q["b07_relative_to_absolute"] = lambda s, d: rounded(
    features.relative_to_absolute(V.v_obj(s, d, ["number", *FLUX, *REL]), list(zip(FLUX, REL))).select(
        "number", *[f"{f}_error" for f in FLUX]))
SQL["b07_relative_to_absolute"] = (
    "SELECT number, " + ", ".join(f"{R(f'{f}*{r}')} AS {f}_error" for f, r in zip(FLUX, REL)) + f" FROM ({OBJ})")


def b08(s, d):
    df = V.v_obj(s, d, ["number", "pmra_g", "pmde_g", "e_pmra_g", "e_pmde_g", "pmra_cw", "pmde_cw", "e_pmra_cw", "e_pmde_cw"])
    df = features.proper_motion(df, "pmra_g", "pmde_g", "e_pmra_g", "e_pmde_g")
    return rounded(features.proper_motion(
        df, "pmra_cw", "pmde_cw", "e_pmra_cw", "e_pmde_cw", "pm_cw", "e_pm_cw", scale=1000.0, absolute_errors=True))


Q["b08_proper_motion"] = b08


def _pm(a, b, sa, sb):
    n = f"sqrt(({a})*({a})+({b})*({b}))"
    return R(n), f"case when {n} > 0 then {R(f'sqrt(({a})*({a})*({sa})*({sa})+({b})*({b})*({sb})*({sb}))/{n}')} end"


_g = _pm("pmra_g", "pmde_g", "e_pmra_g", "e_pmde_g")
_c = _pm("pmra_cw*1000", "pmde_cw*1000", "abs(e_pmra_cw)*1000", "abs(e_pmde_cw)*1000")
SQL["b08_proper_motion"] = (
    f"SELECT number, {_g[1]} AS pm_g_error, {_g[0]} AS pm_g, {_c[1]} AS e_pm_cw, {_c[0]} AS pm_cw FROM ({OBJ})")

Q["b09_galactic"] = lambda s, d: rounded(
    features.galactic(V.v_obj(s, d, ["number", "alpha_j2000", "delta_j2000"]), "alpha_j2000", "delta_j2000")
    .select("number", "l", "b"), 5)
SQL["b09_galactic"] = f"""
WITH o AS ({OBJ}), c AS (SELECT number, radians(delta_j2000) AS d, radians(alpha_j2000 - 192.8594812065348) AS t,
 radians(27.12825118085622) AS p FROM o),
v AS (SELECT number, cos(d)*sin(t) AS e, sin(d)*cos(p)-cos(d)*sin(p)*cos(t) AS n, sin(d)*sin(p)+cos(d)*cos(p)*cos(t) AS z FROM c),
w AS (SELECT number, 122.9319185680026 - degrees(atan2(e, n)) AS l, degrees(asin(z)) AS b FROM v)
SELECT number, {R('case when l < 0 then l + 360 when l >= 360 then l - 360 else l end', 5)} AS l, {R('b', 5)} AS b FROM w"""


def _clean_flux(s, d):
    return cleaning.sentinel_to_null(V.v_obj(s, d, ["number", *FLUX, *REL]), FLUX)


CLEAN_FLUX = f"SELECT number, {', '.join(f'{clean_sql(f)} AS {f}' for f in FLUX)}, {', '.join(REL)} FROM ({OBJ})"
ZPT = f"SELECT median(m) AS zeropoint FROM (SELECT unnest([{', '.join(f'min({f})' for f in FLUX)}]) AS m FROM ({CLEAN_FLUX}))"
Q["b10_fit_flux_zeropoint"] = lambda s, d: rounded(features.fit_flux_zeropoint(_clean_flux(s, d), FLUX), 9)
SQL["b10_fit_flux_zeropoint"] = f"SELECT {R('zeropoint', 9)} AS zeropoint FROM ({ZPT})"


def b11(s, d, relative=False):
    df = _clean_flux(s, d)
    zero = features.fit_flux_zeropoint(df, FLUX).first()["zeropoint"]
    return rounded(features.log_flux(df, list(zip(FLUX, REL)), zero, errors_are_relative=relative))


def _log_sql(relative):
    div = (lambda f: f"{math.log(10.0)!r}::double") if relative else (lambda f: f"({f}*{math.log(10.0)!r}::double)")
    return (
        f"WITH f AS ({CLEAN_FLUX}), z AS ({ZPT}) SELECT number, "
        + ", ".join(f"case when {f} - zeropoint > 0 then {R(f'log10({f} - zeropoint)')} end AS {f}" for f in FLUX) + ", "
        + ", ".join(f"case when {div(f)} <> 0 then {R(f'{r}/{div(f)}')} end AS {r}" for f, r in zip(FLUX, REL))
        + " FROM f, z")


Q["b11_log_flux"] = b11
SQL["b11_log_flux"] = _log_sql(False)
Q["b11_log_flux_relative"] = lambda s, d: b11(s, d, True)
SQL["b11_log_flux_relative"] = _log_sql(True)


def b12(s, d):
    df = features.pairwise_colors(cleaning.missing_mag_to_null(V.v_obj(s, d, ["number", *MAGS]), MAGS), MAGS)
    return df.select("number", *[rnd(F.col(f"`{a}-{b}`")).alias(f"{a}_{b}") for a, b in combinations(MAGS, 2)])


Q["b12_pairwise_colors"] = b12
SQL["b12_pairwise_colors"] = (
    "SELECT number, " + ", ".join(f"{R(f'nullif({a},99.0)-nullif({b},99.0)')} AS {a}_{b}" for a, b in combinations(MAGS, 2))
    + f" FROM ({OBJ})")

SCALED = ["flux_aper_1", "flux_aper_2", "mag_r", "const_q"]


def _scalable(s, d):
    df = V.v_obj(s, d, ["number", *SCALED, "flux_relerr_aper_1", "mag_err_r"])
    df = cleaning.missing_mag_to_null(cleaning.sentinel_to_null(df, ["flux_aper_1", "flux_aper_2"]), ["mag_r"])
    return df.withColumnsRenamed({"flux_relerr_aper_1": "flux_aper_1__err", "mag_err_r": "mag_r__err"})


SCALABLE = (
    f"SELECT number, {clean_sql('flux_aper_1')} AS flux_aper_1, {clean_sql('flux_aper_2')} AS flux_aper_2, "
    f"nullif(mag_r, 99.0) AS mag_r, const_q, flux_relerr_aper_1 AS flux_aper_1__err, mag_err_r AS mag_r__err FROM ({OBJ})")


def _ends(c):
    return f"quantile_cont({c}, 0.005) AS {c}_lo, quantile_cont({c}, 0.995) - quantile_cont({c}, 0.005) AS {c}_w"


ENDS = f"SELECT {', '.join(_ends(c) for c in SCALED)} FROM ({SCALABLE})"
Q["b13_fit_scaler"] = lambda s, d: rounded(scaling.fit_scaler(_scalable(s, d), SCALED))
SQL["b13_fit_scaler"] = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {R(f'{c}_lo')} AS minimum, {R(f'{c}_w')} AS dynamic_range, {c}_w > 0 AS scaled FROM ({ENDS})"
    for c in SCALED)


def b13_large(s, d):
    return rounded(scaling.fit_scaler(_scalable(s, d), SCALED, left_values=5000))


Q["b13_fit_scaler_narrowed"] = b13_large
SQL["b13_fit_scaler_narrowed"] = SQL["b13_fit_scaler"]
Q["b13_fit_scaler_approx"] = lambda s, d: scaling.fit_scaler_approx(_scalable(s, d), SCALED)


def _applied(s, d):
    df = _scalable(s, d)
    return scaling.apply_scaler(df, scaling.fit_scaler(df, SCALED))


S_COLS = [*SCALED, "flux_aper_1__err", "mag_r__err"]


def _applied_sql(c):
    base = c.removesuffix("__err")
    shift = "" if c.endswith("__err") else f" - {base}_lo"
    return f"case when {base}_w > 0 then ({c}{shift})/{base}_w else {c} end"


def _clip_sql(e):
    return f"case when {e} < 0 then 0.0::double when {e} > 1 then 1.0::double else {e} end"


APPLIED = f"SELECT number, {', '.join(f'{_applied_sql(c)} AS {c}' for c in S_COLS)} FROM ({SCALABLE}), ({ENDS})"
CLIPPED = f"SELECT number, {', '.join(f'{_clip_sql(c)} AS {c}' for c in S_COLS)} FROM ({APPLIED})"
Q["b14_apply_scaler"] = lambda s, d: rounded(_applied(s, d))
SQL["b14_apply_scaler"] = f"SELECT number, {', '.join(f'{R(c)} AS {c}' for c in S_COLS)} FROM ({APPLIED})"
Q["b15_clip_unit"] = lambda s, d: rounded(cleaning.clip_unit(_applied(s, d), S_COLS))
SQL["b15_clip_unit"] = f"SELECT number, {', '.join(f'{R(c)} AS {c}' for c in S_COLS)} FROM ({CLIPPED})"
Q["b16_impute"] = lambda s, d: rounded(cleaning.impute(
    cleaning.clip_unit(_applied(s, d), S_COLS), SCALED, ["flux_aper_1__err", "mag_r__err"]))
SQL["b16_impute"] = (
    "SELECT number, " + ", ".join(f"{R(f'coalesce({c}, -0.1::double)')} AS {c}" for c in SCALED) + ", "
    + ", ".join(f"{R(f'greatest(coalesce({c}, 0.0::double), 0.0::double)')} AS {c}" for c in S_COLS[-2:]) + f" FROM ({CLIPPED})")

Q["b17_encode_labels"] = lambda s, d: labels.encode_labels(V.v_obj(s, d, ["number", "cls"]), "cls")
SQL["b17_encode_labels"] = (
    "SELECT number, cls, " + ", ".join(f"(cls = '{c}')::int AS cls_{c}" for c in V.CLASSES)
    + f", (dense_rank() OVER (ORDER BY cls) - 1)::int AS cls_num FROM ({OBJ})")

PRED = V.pred_sql()
Q["b18_predicted_class"] = lambda s, d: labels.predicted_class(
    V.v_pred(s, d), ["pred_p1", "pred_p2", "pred_p3"], ["p1", "p2", "p3"]).select("number", "CLASS")
BEST = "case when pred_p1 >= pred_p2 and pred_p1 >= pred_p3 then 'p1' when pred_p2 >= pred_p3 then 'p2' else 'p3' end"
SQL["b18_predicted_class"] = f"SELECT number, {BEST} AS CLASS FROM ({PRED})"

Q["b19_strip_prefix"] = lambda s, d: rounded(features.strip_prefix(
    V.v_pred(s, d).selectExpr("number", "pred_p1 AS pred_nom_p1_mean", "z_sigma AS pred_var_z_std")))
SQL["b19_strip_prefix"] = f"SELECT number, {R('pred_p1')} AS p1_mean, {R('z_sigma')} AS z_std FROM ({PRED})"

Q["b20_floor_sigma"] = lambda s, d: rounded(cleaning.floor_sigma(
    V.v_pred(s, d).select("number", (F.col("z_sigma") - 0.01).alias("z_sigma")), ["z_sigma"]))
SQL["b20_floor_sigma"] = f"SELECT number, {R('greatest(z_sigma - 0.01, 0.0001)')} AS z_sigma FROM ({PRED})"

Q["b21_evaluation_ready"] = lambda s, d: rounded(cleaning.evaluation_ready(
    cleaning.missing_mag_to_null(V.v_pred(s, d).select("number", "mag_r", "mag_err_r", "z_obs"), ["mag_r"])
    .withColumn("z_obs", F.expr("if(number % 7 = 0, null, z_obs)")), ["mag_r"], ["mag_err_r"]))
SQL["b21_evaluation_ready"] = (
    f"SELECT number, {R('least(mag_r, 25.0::double)')} AS mag_r, {R('least(mag_err_r, 0.75::double)')} AS mag_err_r, "
    f"case when number % 7 = 0 then 99.0::double else {R('z_obs')} end AS z_obs FROM ({PRED})")

Q["b23_zero_errors"] = lambda s, d: cleaning.zero_errors(V.v_obj(s, d, ["number", "mag_r", "mag_g"]), ["mag_r", "mag_g"])
SQL["b23_zero_errors"] = f"SELECT number, mag_r, mag_g, 0.0::double AS mag_r__err, 0.0::double AS mag_g__err FROM ({OBJ})"
Q["b24_magnitude_cut"] = lambda s, d: cleaning.magnitude_cut(V.v_obj(s, d, ["number", "mag_r"]), "mag_r")
SQL["b24_magnitude_cut"] = f"SELECT number, mag_r FROM ({OBJ}) WHERE mag_r < 21.5"

# --- C: joins -----------------------------------------------------------------------
KEYS = ["tile_id", "number"]
EXT = V.ext_sql()
Q["c01_enrich"] = lambda s, d: joins.enrich(V.v_obj(s, d, [*KEYS, "mag_r", "mag_g"]), V.v_ext(s, d), KEYS)
SQL["c01_enrich"] = (
    f"SELECT o.tile_id, o.number, o.mag_r, o.mag_g, e.ebv, e.mag_r AS mag_r_ext FROM ({OBJ}) o "
    f"LEFT JOIN ({EXT}) e ON o.tile_id = e.tile_id AND o.number = e.number")


def _pred_part(s, d, *cols):
    return V.v_pred(s, d).select("number", *cols)


Q["c02_attach_predictions"] = lambda s, d: rounded(joins.attach_predictions(
    V.v_obj(s, d, ["number", "mag_g"]), _pred_part(s, d, "pred_p1"), _pred_part(s, d, "z_sigma"), ["number"]))
SQL["c02_attach_predictions"] = (
    f"SELECT o.number, {R('o.mag_g')} AS mag_g, {R('p.pred_p1')} AS pred_p1, {R('p.z_sigma')} AS z_sigma "
    f"FROM ({OBJ}) o JOIN ({PRED}) p ON o.number = p.number")
Q["c03_attach_truth"] = lambda s, d: rounded(joins.attach_truth(
    _pred_part(s, d, "z_pred"), _pred_part(s, d, "z_obs"), _pred_part(s, d, "z_err"), ["number"]))
SQL["c03_attach_truth"] = (
    f"SELECT number, {R('z_pred')} AS z_pred, {R('z_obs')} AS z_obs, {R('z_err')} AS z_err FROM ({PRED})")
Q["c04_join_new_columns"] = lambda s, d: rounded(joins.join_new_columns(
    V.v_obj(s, d, ["number", "mag_g", "mag_r"]), V.v_pred(s, d).select("number", "mag_r", "pred_p2"), ["number"]))
SQL["c04_join_new_columns"] = (
    f"SELECT o.number, {R('o.mag_g')} AS mag_g, {R('o.mag_r')} AS mag_r, {R('p.pred_p2')} AS pred_p2 "
    f"FROM ({OBJ}) o JOIN ({PRED}) p ON o.number = p.number")

# --- sampling, splits, folds ------------------------------------------------------------
Q["a03_take_first"] = lambda s, d: sampling.take_first(V.v_obj(s, d, [*KEYS, "cls"]), KEYS, 250)
SQL["a03_take_first"] = f"SELECT tile_id, number, cls FROM ({OBJ}) ORDER BY tile_id, number LIMIT 250"
RANKED = f"SELECT *, row_number() OVER (ORDER BY tile_id, number) - 1 AS rn FROM ({V.obj_sql([*KEYS, 'cls'])})"
Q["a04_systematic_sample"] = lambda s, d: sampling.systematic_sample(V.v_obj(s, d, [*KEYS, "cls"]), KEYS, 7, 3)
SQL["a04_systematic_sample"] = f"SELECT tile_id, number, cls FROM ({RANKED}) WHERE (rn + 3) % 7 = 0"
Q["a13_select_positions"] = lambda s, d: sampling.select_positions(
    V.v_obj(s, d, [*KEYS, "cls"]), KEYS, [0, 5, 17, *range(100, 140)]).drop("request")
SQL["a13_select_positions"] = (
    f"SELECT tile_id, number, cls, rn AS position FROM ({RANKED}) WHERE rn IN (0, 5, 17) OR rn BETWEEN 100 AND 139")
Q["d07_evenly_spaced"] = lambda s, d: sampling.evenly_spaced(V.v_obj(s, d, [*KEYS, "cls"]), KEYS, 15).drop("request")
SQL["d07_evenly_spaced"] = (
    f"SELECT tile_id, number, cls, rn AS position FROM ({RANKED}) WHERE rn IN "
    f"(SELECT floor(i * ((SELECT count(*) FROM events) - 1) / 14.0::double)::bigint FROM range(0, 15) t(i))")


def a12(s, d):
    df = V.v_obj(s, d, [*KEYS, "cls"])
    first = df.orderBy("number").limit(40).collect()  # the request list: forty names
    ids = [f"{r['tile_id']}-{r['number']}" for r in reversed(first)]
    return sampling.select_objects(df, ids + ids[:3])


Q["a12_select_objects"] = a12
SQL["a12_select_objects"] = f"""
WITH f AS (SELECT tile_id, number, cls, row_number() OVER (ORDER BY number DESC) - 1 AS request
  FROM (SELECT tile_id, number, cls FROM ({OBJ}) ORDER BY number LIMIT 40))
SELECT tile_id, number, cls, request::int AS request FROM f
UNION ALL SELECT tile_id, number, cls, (request + 40)::int FROM f WHERE request < 3"""

HASH = "md5(number::varchar || '|42')"
ORDERED = f"SELECT number, cls, {HASH} AS h FROM ({OBJ})"
Q["d01_seeded_order"] = lambda s, d: sampling.seeded_order(V.v_obj(s, d, ["number", "cls"]), ["number"], 42)
SQL["d01_seeded_order"] = f"SELECT number, cls, h AS shuffle_key FROM ({ORDERED})"
Q["d01_shuffled_positions"] = lambda s, d: ranks.key_ranks(
    sampling.seeded_order(V.v_obj(s, d, ["number"]), ["number"], 42), ["shuffle_key"], ["number"])
SQL["d01_shuffled_positions"] = f"SELECT number, row_number() OVER (ORDER BY h) - 1 AS position FROM ({ORDERED})"
Q["d02_train_valid_split"] = lambda s, d: sampling.train_valid_split(V.v_obj(s, d, ["number", "cls"]), ["number"])
SQL["d02_train_valid_split"] = (
    "SELECT number, cls, case when row_number() OVER (ORDER BY h) <= ceil(0.1::double * count(*) OVER ()) "
    f"then 'valid' else 'train' end AS split FROM ({ORDERED})")
Q["d02_threshold_split"] = lambda s, d: sampling.threshold_split(V.v_obj(s, d, ["number", "cls"]), ["number"], 0.25)
SQL["d02_threshold_split"] = f"SELECT number, cls, case when h < '40000000' then 'valid' else 'train' end AS split FROM ({ORDERED})"
Q["d03_stratified_split"] = lambda s, d: sampling.stratified_split(V.v_obj(s, d, ["number", "cls"]), ["number"], "cls")
SQL["d03_stratified_split"] = (
    "SELECT number, cls, case when row_number() OVER (PARTITION BY cls ORDER BY h) <= ceil(0.1::double * count(*) OVER (PARTITION BY cls)) "
    f"then 'valid' else 'train' end AS split FROM ({ORDERED}) QUALIFY count(*) OVER (PARTITION BY cls) >= 2")
Q["d04_kfold"] = lambda s, d: sampling.kfold(V.v_obj(s, d, ["number", "cls"]), ["number"], 8, 2)
SQL["d04_kfold"] = " UNION ALL ".join(
    f"SELECT number, cls, {r}::int AS repeat, (ntile(8) OVER (ORDER BY md5(number::varchar || '|{42 + r}')) - 1)::int AS fold FROM ({OBJ})"
    for r in (0, 1))
Q["d04_kfold_stratified"] = lambda s, d: sampling.kfold(V.v_obj(s, d, ["number", "cls"]), ["number"], 8, 1, "cls")
SQL["d04_kfold_stratified"] = (
    f"SELECT number, cls, 0::int AS repeat, (ntile(8) OVER (PARTITION BY cls ORDER BY h) - 1)::int AS fold FROM ({ORDERED})")
Q["d05_undersample"] = lambda s, d: sampling.undersample(V.v_obj(s, d, ["number", "cls"]), ["number"], "cls")
SQL["d05_undersample"] = (
    f"WITH o AS ({ORDERED}) SELECT number, cls FROM o QUALIFY row_number() OVER (PARTITION BY cls ORDER BY h) "
    "<= (SELECT min(c) FROM (SELECT count(*) AS c FROM o GROUP BY cls))")


Q["d05_undersample_replacement"] = lambda s, d: sampling.undersample(
    V.v_obj(s, d, ["number", "cls"]), ["number"], "cls", replacement=True).withColumn("pick", F.col("pick").cast("int"))
SQL["d05_undersample_replacement"] = f"""
WITH o AS (SELECT number, cls, row_number() OVER (PARTITION BY cls ORDER BY h) AS r, count(*) OVER (PARTITION BY cls) AS n FROM ({ORDERED})),
p AS (SELECT cls, n, unnest(range(1, 1 + (SELECT min(n) FROM o))) AS pick FROM (SELECT DISTINCT cls, n FROM o)),
q AS (SELECT cls, pick, floor({V._slice("md5(cls || '|' || pick::varchar || '|42')", 1, 'duckdb')} * n) + 1 AS r FROM p)
SELECT o.number, o.cls, pick::int AS pick FROM q JOIN o USING (cls, r)"""


def d08(s, d):
    df = V.v_obj(s, d, ["number", "pmra_g", "pmde_g", "e_pmra_g", "e_pmde_g"]).withColumnsRenamed(
        {"e_pmra_g": "pmra_g__err", "e_pmde_g": "pmde_g__err"})
    return rounded(sampling.perturb(df, ["number"], ["pmra_g", "pmde_g"], draw=2).select("number", "pmra_g", "pmde_g"))


def _normal_sql(stream):
    digest = f"md5(number::varchar || '|{stream}')"
    return (f"sqrt(-2.0::double*ln({V._slice(digest, 1, 'duckdb')}+{2.0**-33!r}::double))"
            f"*cos(2.0::double*pi()*{V._slice(digest, 2, 'duckdb')})")


Q["d08_perturb"] = d08
SQL["d08_perturb"] = (
    f"SELECT number, {R(f'pmra_g + e_pmra_g*{_normal_sql(4)}')} AS pmra_g, "
    f"{R(f'pmde_g + e_pmde_g*{_normal_sql(5)}')} AS pmde_g FROM ({OBJ})")

# --- H: running sums, top-k, set operations ------------------------------------------------
Q["h01_running_total"] = lambda s, d: ranks.running_total(
    V.v_obj(s, d, ["number", "cls"]).groupBy("cls").agg(F.count(F.lit(1)).alias("n")), ["cls"], "n")
SQL["h01_running_total"] = (
    f"SELECT cls, n, sum(n) OVER (ORDER BY cls)::bigint AS n_cum FROM (SELECT cls, count(*) AS n FROM ({OBJ}) GROUP BY cls)")


def h01_large(s, d):
    df = V.v_obj(s, d, ["number", "cls"]).withColumn("one", F.lit(1))
    return ranks.running_total(df, ["number"], "one", by=["cls"], large=True).select("number", "cls", "one_cum")


Q["h01_running_total_large"] = h01_large
SQL["h01_running_total_large"] = (
    f"SELECT number, cls, row_number() OVER (PARTITION BY cls ORDER BY number) AS one_cum FROM ({OBJ})")
Q["h02_top_k"] = lambda s, d: sets.top_k(
    V.v_obj(s, d, ["number", "cls", "mag_g"]), [F.col("mag_g").desc(), F.col("number")], 5, ["cls"])
SQL["h02_top_k"] = (
    f"SELECT number, cls, mag_g FROM ({OBJ}) QUALIFY row_number() OVER (PARTITION BY cls ORDER BY mag_g DESC, number) <= 5")


def _cls(s, d, *c):
    return cleaning.filter_class(V.v_obj(s, d, ["number", "cls"]), "cls", c)


Q["h03_concat"] = lambda s, d: sets.concat([_cls(s, d, "click"), _cls(s, d, "view"), _cls(s, d, "click")])
SQL["h03_concat"] = (
    f"SELECT number, cls FROM ({OBJ}) WHERE cls IN ('click','view') UNION ALL SELECT number, cls FROM ({OBJ}) WHERE cls = 'click'")
Q["h04_union_distinct"] = lambda s, d: sets.union_distinct(
    _cls(s, d, "click", "view").select("cls"), _cls(s, d, "view", "error").select("cls"))
SQL["h04_union_distinct"] = f"SELECT DISTINCT cls FROM ({OBJ}) WHERE cls IN ('click','view','error')"
Q["h04_difference"] = lambda s, d: sets.difference(
    V.v_obj(s, d, KEYS), V.v_ext(s, d).select(*KEYS))
SQL["h04_difference"] = f"SELECT DISTINCT tile_id, number FROM ({OBJ}) WHERE number % 3 = 0"

"""Mixtures, neighbours, balancing and feature selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from posteria.operators import balance, mixture, neighbors, posterior, selection
from posteria.session import staged_path
from registry import views as V
from registry.util import rounded

Q, SQL = {}, {}
T3 = ["p1", "p2", "p3"]
KEYS = ["tile_id", "number"]
DRAW = V.draw_sql()


def R(expr, digits=6):
    return f"round({expr}, {digits}) + 0.0::double"


# Fixed values of the rotation, written out for the SQL side.
A, B, C = "((sqrt(3)+3)/6)", "(-sqrt((2-sqrt(3))/6))", "(-1/sqrt(3))"
ROWS = ((A, B, C), (B, A, C))


def plane(p):
    return [f"({r[0]}*{p[0]} + {r[1]}*{p[1]} + {r[2]}*{p[2]})" for r in ROWS]


def back(x, y):
    return [f"({ROWS[0][i]}*{x} + {ROWS[1][i]}*{y} + 1/3.0::double)" for i in range(3)]


PRED = V.pred_sql()
Q["f08_rotate_simplex"] = lambda s, d: rounded(mixture.rotate_simplex(
    V.v_pred(s, d).select("number", "pred_p1", "pred_p2", "pred_p3"), ["pred_p1", "pred_p2", "pred_p3"]).select("number", "r1", "r2"))
_p = plane(["pred_p1", "pred_p2", "pred_p3"])
SQL["f08_rotate_simplex"] = f"SELECT number, {R(_p[0])} AS r1, {R(_p[1])} AS r2 FROM ({PRED})"
_d = plane(T3)
ROT = f"SELECT number, draw, {_d[0]} AS r1, {_d[1]} AS r2 FROM ({DRAW})"


def rotated(s, d):
    return mixture.rotate_draws(V.v_draws(s, d, T3), T3)


Q["f08_rotate_draws"] = lambda s, d: rounded(posterior.explode_draws(rotated(s, d), ["number"], ["r1", "r2"]))
SQL["f08_rotate_draws"] = f"SELECT number, draw::int AS draw, {R('r1')} AS r1, {R('r2')} AS r2 FROM ({ROT})"


def mstep(resp):
    eps = "2.220446049250313e-15::double"
    return f"""SELECT number, comp, s11/m - (s1/m)*(s1/m) + 1e-6::double AS a, s12/m - (s1/m)*(s2/m) AS b, s22/m - (s2/m)*(s2/m) + 1e-6::double AS c,
 s1/m AS m1, s2/m AS m2, m / sum(m) OVER (PARTITION BY number) AS w FROM
 (SELECT number, comp, sum(r) + {eps} AS m, sum(r*r1) AS s1, sum(r*r2) AS s2, sum(r*r1*r1) AS s11, sum(r*r1*r2) AS s12, sum(r*r2*r2) AS s22
  FROM {resp} GROUP BY number, comp)"""


def estep(params):
    return f"""SELECT number, draw, comp, r1, r2, exp(lp - max(lp) OVER v) / sum(exp(lp - mx)) OVER v AS r FROM
 (SELECT *, max(lp) OVER (PARTITION BY number, draw) AS mx FROM (SELECT number, draw, comp, r1, r2,
  ln(w) - 0.5::double * ((c*(r1-m1)*(r1-m1) - 2*b*(r1-m1)*(r2-m2) + a*(r2-m2)*(r2-m2))/(a*c-b*b) + ln(a*c-b*b)) - ln(2*pi()) AS lp
  FROM rot JOIN {params} USING (number))) WINDOW v AS (PARTITION BY number, draw)"""


def gmm_sql(steps):
    third = [f"ceil({V.DRAWS}/3.0::double)::int", f"ceil({V.DRAWS}*2/3.0::double)::int"]
    ctes = [
        f"rot AS MATERIALIZED ({ROT})",
        f"cut AS (SELECT number, list_sort(list(r1))[{third[0]}] AS c1, list_sort(list(r1))[{third[1]}] AS c2 FROM rot GROUP BY number)",
        "q0 AS (SELECT number, draw, r1, r2, (r1 > c1)::int + (r1 > c2)::int AS comp, 1.0::double AS r FROM rot JOIN cut USING (number))",
        f"g0 AS MATERIALIZED ({mstep('q0')})",
    ]
    for i in range(steps):
        ctes += [f"q{i + 1} AS ({estep(f'g{i}')})", f"g{i + 1} AS MATERIALIZED ({mstep(f'q{i + 1}')})"]
    ctes.append(f"o AS (SELECT *, row_number() OVER (PARTITION BY number ORDER BY w DESC) AS k FROM g{steps})")
    part = {"cov_11": "a", "cov_12": "b", "cov_22": "c", "mean_1": "m1", "mean_2": "m2", "weight": "w"}
    cols = ", ".join(
        f"{R('max(case when k = ' + n[4] + ' then ' + part[n.split('_', 1)[1]] + ' end)')} AS {n}" for n in mixture.gmm_columns())
    return f"WITH {', '.join(ctes)} SELECT number, {cols} FROM o GROUP BY number"


Q["f09_fit_gmm_two_rounds"] = lambda s, d: rounded(mixture.fit_gmm(rotated(s, d), ["number"], max_iter=2, tol=0.0))
SQL["f09_fit_gmm_two_rounds"] = gmm_sql(2)
Q["f09_fit_gmm"] = lambda s, d: mixture.fit_gmm(rotated(s, d), ["number"])


def f09_long(s, d):
    draws = mixture.rotate_simplex(V.v_draws_long(s, d, T3), T3)
    return rounded(mixture.fit_gmm_long(draws, ["number"], 2, 0.0))


Q["f09_fit_gmm_long"] = f09_long
Q["f09_fit_gmm_seeded"] = lambda s, d: mixture.fit_gmm(rotated(s, d), ["number"], seed_by=["number"])
SQL["f09_fit_gmm_long"] = gmm_sql(2)

GMM = V.gmm_sql()
Q["f10_pack_gmm"] = lambda s, d: rounded(mixture.pack_gmm(mixture._component_rows(V.v_gmm(s, d), KEYS), KEYS), 9)
_long = " UNION ALL ".join(
    f"SELECT tile_id, number, {k} AS comp, " + ", ".join(f"comp{k}_{c} AS {c}" for c in mixture.PARTS) + f" FROM ({GMM})" for k in (1, 2, 3))
SQL["f10_pack_gmm"] = (
    f"WITH o AS (SELECT *, row_number() OVER (PARTITION BY tile_id, number ORDER BY weight DESC) AS k FROM ({_long})) SELECT tile_id, number, "
    + ", ".join(f"{R('max(case when k = ' + n[4] + ' then ' + n.split('_', 1)[1] + ' end)', 9)} AS {n}" for n in mixture.gmm_columns())
    + " FROM o GROUP BY tile_id, number")

_m = back("mean_1", "mean_2")
_cov = {
    f"{i + 1}{j + 1}": f"({ROWS[0][i]}*{ROWS[0][j]}*cov_11 + ({ROWS[0][i]}*{ROWS[1][j]} + {ROWS[1][i]}*{ROWS[0][j]})*cov_12 + {ROWS[1][i]}*{ROWS[1][j]}*cov_22)"
    for i in range(3) for j in range(i, 3)}
Q["f11_unpack_gmm"] = lambda s, d: rounded(mixture.unpack_gmm(V.v_gmm(s, d), KEYS))
SQL["f11_unpack_gmm"] = (
    f"SELECT tile_id, number, comp::int AS comp, {R('weight')} AS weight, " + ", ".join(f"{R(e)} AS m{i + 1}" for i, e in enumerate(_m)) + ", "
    + ", ".join(f"{R(e)} AS c{ij}" for ij, e in _cov.items()) + f" FROM ({_long})")

_low = "((cov_11 + cov_22)/2 - sqrt((cov_11-cov_22)/2*(cov_11-cov_22)/2 + cov_12*cov_12))"
REPAIRED = (
    f"SELECT tile_id, number, comp, weight, mean_1, mean_2, cov_12, cov_11 - 10*least({_low}, 0) AS cov_11, "
    f"cov_22 - 10*least({_low}, 0) AS cov_22 FROM ({_long})")
Q["f12_repair_psd"] = lambda s, d: rounded(
    mixture._component_rows(mixture.repair_psd(V.v_gmm(s, d)), KEYS).select(*KEYS, "comp", "cov_11", "cov_12", "cov_22"))
SQL["f12_repair_psd"] = (
    f"SELECT tile_id, number, comp::int AS comp, {R('cov_11')} AS cov_11, {R('cov_12')} AS cov_12, {R('cov_22')} AS cov_22 FROM ({REPAIRED})")

POINTS = 12


def _gauss(pair):
    part = lambda j: V._slice("h", 2 * pair + j, "duckdb")
    return f"sqrt(-2.0::double*ln({part(1)} + {2.0**-33!r}::double))*cos(2.0::double*pi()*{part(2)})"


_b = back("x", "y")
SAMPLED = f"""SELECT tile_id, number, comp::int AS comp, i::int AS sample, {_b[0]} AS p1, {_b[1]} AS p2, {_b[2]} AS p3 FROM
 (SELECT tile_id, number, comp, i, mean_1 + sqrt(cov_11)*z1 AS x,
   mean_2 + cov_12/sqrt(cov_11)*z1 + sqrt(greatest(cov_22 - cov_12/sqrt(cov_11)*cov_12/sqrt(cov_11), 0))*z2 AS y FROM
  (SELECT *, {_gauss(0)} AS z1, {_gauss(1)} AS z2 FROM (SELECT *, md5(concat_ws('|', tile_id::varchar, number::varchar, comp::varchar, i::varchar, 'xy')) AS h
   FROM (SELECT *, unnest(range(1, 1 + floor({POINTS}.0::double*weight)::bigint)) AS i FROM ({REPAIRED})))))"""
Q["f13_sample_gmm"] = lambda s, d: rounded(mixture.sample_gmm(mixture.repair_psd(V.v_gmm(s, d)), KEYS, POINTS))
SQL["f13_sample_gmm"] = f"SELECT tile_id, number, comp, sample, {R('p1')} AS \"P_Galaxy\", {R('p2')} AS \"P_QSO\", {R('p3')} AS \"P_Star\" FROM ({SAMPLED})"


NAMES = ["P_Galaxy", "P_QSO", "P_Star"]


def f13_full(s, d):
    """5,000 points of every object: their number, and whether mean and variance are those of the mixture, within six standard errors."""
    repaired = mixture.repair_psd(V.v_gmm(s, d))
    found = mixture.array_moments(mixture.sample_gmm_arrays(repaired, KEYS, 5000), KEYS, NAMES)
    parts = mixture.unpack_gmm(repaired, KEYS).withColumn("k", F.floor(5000 * F.col("weight")))
    share = lambda e: F.sum(F.col("k") * e) / F.sum("k")
    means = parts.groupBy(*KEYS).agg(F.sum("k").alias("points"), *[share(F.col(f"m{i}")).alias(f"e{i}") for i in (1, 2, 3)],
                                     *[share(F.col(f"c{i}{i}") + F.col(f"m{i}") * F.col(f"m{i}")).alias(f"s{i}") for i in (1, 2, 3)])
    var = lambda i: F.col(f"s{i}") - F.col(f"e{i}") * F.col(f"e{i}")
    near = [F.abs(F.col(f"{n}_mean") - F.col(f"e{i}")) <= 6 * F.sqrt(var(i) / F.col("points")) for i, n in enumerate(NAMES, 1)]
    near += [F.abs(F.col(f"{n}_{n}_cov") / var(i) - 1) <= 0.2 for i, n in enumerate(NAMES, 1)]
    agree = near[0] & near[1] & near[2] & near[3] & near[4] & near[5]
    return found.join(means, KEYS).select(*KEYS, F.col("n").cast("long").alias("n"), agree.alias("agree"))


Q["f13_sample_gmm_full"] = f13_full
SQL["f13_sample_gmm_full"] = (
    "SELECT tile_id, number, (" + " + ".join(f"floor(5000 * comp{k}_weight)" for k in (1, 2, 3)) + f")::BIGINT AS n, true AS agree FROM ({GMM})")


def f14(s, d):
    table = mixture.reconstruct_posteriors(V.v_gmm(s, d), n=POINTS, path=staged_path(s, "pdf"))
    return table.groupBy(*KEYS, "comp").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(
        F.col("P_Galaxy") + F.col("P_QSO") + F.col("P_Star")), 2).alias("total"))


Q["f14_reconstruct_posteriors"] = f14
SQL["f14_reconstruct_posteriors"] = f"SELECT tile_id, number, comp, count(*) AS n, 1.0::double AS total FROM ({SAMPLED}) GROUP BY ALL"


def f14_ids(s, d):
    table = V.v_gmm(s, d)
    few = table.orderBy("number").limit(20).select(*KEYS).collect()  # the request list: twenty names
    ids = [f"{r['tile_id']}-{r['number']}" for r in few]
    return mixture.reconstruct_posteriors(table, ids + ids[:2], n=POINTS).groupBy(*KEYS, "request").agg(F.count(F.lit(1)).alias("n"))


Q["f14_reconstruct_named"] = f14_ids
SQL["f14_reconstruct_named"] = f"""
WITH c AS (SELECT tile_id, number, count(*) AS n FROM ({SAMPLED}) GROUP BY ALL), f AS
 (SELECT c.*, row_number() OVER (ORDER BY number) - 1 AS request FROM c WHERE number IN (SELECT event_id FROM events ORDER BY event_id LIMIT 20))
SELECT tile_id, number, request::int AS request, n FROM f UNION ALL SELECT tile_id, number, (request + 20)::int, n FROM f WHERE request < 2"""

# --- neighbours --------------------------------------------------------------------------
FEATS = [f"f{i}" for i in range(62)]
EMB = V.emb_sql()
ED = "sqrt(" + " + ".join(f"(a.{f}-b.{f})*(a.{f}-b.{f})" for f in FEATS) + ")"
MD = " + ".join(f"abs(a.{f}-b.{f})" for f in FEATS)


def near_sql(dist, k, where="a.number <> b.number"):
    return (f"SELECT a.number AS query, b.number AS neighbour, {dist} AS distance, b.f62, b.f63 FROM e a JOIN e b ON {where} "
            f"QUALIFY row_number() OVER (PARTITION BY a.number ORDER BY {dist}, b.number) <= {k}")


Q["g05_knn"] = lambda s, d: rounded(neighbors.knn(
    V.v_emb(s, d), V.v_emb(s, d), "number", "number", FEATS, 5, skip_self=True))
# the way for training tables too large to broadcast, with small blocks
Q["g05_knn_partitioned"] = lambda s, d: rounded(neighbors.knn(
    V.v_emb(s, d), V.v_emb(s, d), "number", "number", FEATS, 5, skip_self=True, block=64, fan=16, probes=4))
SQL["g05_knn"] = (
    f"WITH e AS MATERIALIZED ({EMB}) SELECT query, row_number() OVER (PARTITION BY query ORDER BY distance, neighbour)::int AS rank, "
    f"neighbour, {R('distance')} AS distance FROM ({near_sql(ED, 5)})")
SQL["g05_knn_partitioned"] = SQL["g05_knn"]
Q["g05_knn_predict"] = lambda s, d: rounded(neighbors.knn_predict(
    V.v_emb(s, d), V.v_emb(s, d), "number", "number", FEATS, ["f62", "f63"], 7, skip_self=True))
SQL["g05_knn_predict"] = (
    f"WITH e AS MATERIALIZED ({EMB}) SELECT query AS number, {R('avg(f62)')} AS pred_f62, {R('avg(f63)')} AS pred_f63 "
    f"FROM ({near_sql(ED, 7)}) GROUP BY query")
Q["g05_knn_predict_manhattan"] = lambda s, d: rounded(neighbors.knn_predict(
    V.v_emb(s, d), V.v_emb(s, d), "number", "number", FEATS, ["f62", "f63"], 4, p=1, weights="distance"))
SQL["g05_knn_predict_manhattan"] = (
    f"WITH e AS MATERIALIZED ({EMB}), n AS ({near_sql(MD, 4, 'true')}), w AS (SELECT *, case when min(distance) OVER (PARTITION BY query) = 0 "
    "then (distance = 0)::int::double else 1 / nullif(distance, 0) end AS w FROM n) "
    f"SELECT query AS number, {R('sum(w*f62)/sum(w)')} AS pred_f62, {R('sum(w*f63)/sum(w)')} AS pred_f63 FROM w GROUP BY query")

# --- balancing ---------------------------------------------------------------------------
UNEVEN = "case when cls in ('C0','C1','C2','C3','C4') then 'A' when cls in ('C5','C6','C7') then 'B' else 'D' end"
Q["d06_smote"] = lambda s, d: rounded(balance.smote(
    V.v_emb(s, d).withColumn("cls", F.expr(UNEVEN)), "number", "cls", FEATS, ["f62", "f63"]).select(
    "number", "cls", "synthetic", "f0", "f1", "f61", "f63"))
_row = ("SELECT number, cls, 0 AS synthetic, f0, f1, f61, f63 FROM e")
_u1 = V.u("number", "'n'||i", "duckdb")
_u2 = V.u("number", "'u'||i", "duckdb")
SQL["d06_smote"] = f"""
WITH e AS MATERIALIZED (SELECT * EXCLUDE (cls), {UNEVEN} AS cls FROM ({EMB})),
z AS (SELECT cls, count(*) AS n, max(count(*)) OVER () - count(*) AS need FROM e GROUP BY cls),
base AS (SELECT e.*, need // n + (row_number() OVER (PARTITION BY e.cls ORDER BY md5(number::varchar || '|42')) <= need % n)::int AS copies
  FROM e JOIN z USING (cls) WHERE need > 0),
near AS (SELECT a.number, b.number AS nb, row_number() OVER (PARTITION BY a.number ORDER BY {ED}, b.number) AS rk
  FROM base a JOIN e b ON a.cls = b.cls AND a.number <> b.number QUALIFY rk <= 5),
made AS (SELECT *, floor({_u1} * 5)::int + 1 AS pick, {_u2} AS u FROM (SELECT base.*, unnest(range(1, copies + 1)) AS i FROM base)),
syn AS (SELECT m.number, m.cls, i AS synthetic, """ + ", ".join(f"m.{c} + u*(t.{c} - m.{c}) AS {c}" for c in ("f0", "f1", "f61", "f63")) + f"""
  FROM made m JOIN near ON near.number = m.number AND near.rk = m.pick JOIN e t ON t.number = near.nb)
SELECT number, cls, synthetic::int AS synthetic, {', '.join(f'{R(c)} AS {c}' for c in ('f0', 'f1', 'f61', 'f63'))} FROM ({_row} UNION ALL SELECT * FROM syn)"""

# --- feature selection ------------------------------------------------------------------------
ALL64 = [f"f{i}" for i in range(64)]


def with_targets(s, d):
    return V.v_emb(s, d).withColumns({f"y{i}": (F.col("cls") == f"C{i}").cast("double") for i in range(3)})


EMBY = f"SELECT *, {', '.join(f'(cls = {chr(39)}C{i}{chr(39)})::int::double AS y{i}' for i in range(3))} FROM ({EMB})"
Q["e02_variance_filter"] = lambda s, d: rounded(selection.variance_filter(
    V.v_obj(s, d, ["flux_aper_1", "mag_r", "const_q"]), ["flux_aper_1", "mag_r", "const_q"]), 4)
SQL["e02_variance_filter"] = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {R(f'var_pop({c})', 4)} AS variance, var_pop({c}) > 0 AS kept FROM ({V.obj_sql([c])})"
    for c in ("flux_aper_1", "mag_r", "const_q"))


def fscore_sql(y):
    return " UNION ALL ".join(
        f"SELECT '{c}' AS feature, corr({c}, {y})*corr({c}, {y})/(1 - corr({c}, {y})*corr({c}, {y}))*(count(*) - 2) AS score FROM e" for c in ALL64)


def mi_sql(y):
    cuts = ", ".join(f"min({c}) AS l_{c}, max({c}) AS h_{c}" for c in [*ALL64, y])
    cell = lambda c: f"least(floor(({c} - l_{c}) / (h_{c} - l_{c}) * 10.0::double), 9)"
    long = " UNION ALL ".join(f"SELECT '{c}' AS feature, {cell(c)} AS x, {cell(y)} AS y FROM e, (SELECT {cuts} FROM e)" for c in ALL64)
    return f"""SELECT feature, sum(c / n * ln(c * n / (cx * cy))) AS score FROM (SELECT feature, c::double AS c, sum(c) OVER (PARTITION BY feature)::double AS n,
 sum(c) OVER (PARTITION BY feature, x)::double AS cx, sum(c) OVER (PARTITION BY feature, y)::double AS cy
 FROM (SELECT feature, x, y, count(*) AS c FROM ({long}) GROUP BY ALL)) GROUP BY feature"""


Q["e03_f_score"] = lambda s, d: rounded(selection.f_score(with_targets(s, d), ALL64, "y0"))
SQL["e03_f_score"] = f"WITH e AS MATERIALIZED ({EMBY}) SELECT feature, {R('score')} AS score FROM ({fscore_sql('y0')})"
Q["e03_select_k"] = lambda s, d: selection.select_k(selection.f_score(with_targets(s, d), ALL64, "y0"), 64)
SQL["e03_select_k"] = f"WITH e AS MATERIALIZED ({EMBY}) SELECT feature FROM ({fscore_sql('y0')}) ORDER BY score DESC LIMIT 42"
Q["e04_mutual_information"] = lambda s, d: rounded(selection.mutual_information(with_targets(s, d), ALL64, "y1"))
SQL["e04_mutual_information"] = f"WITH e AS MATERIALIZED ({EMBY}) SELECT feature, {R('score')} AS score FROM ({mi_sql('y1')})"
Q["e05_union_selected"] = lambda s, d: selection.union_selected(with_targets(s, d), ALL64, ["y0", "y1", "y2"])
SQL["e05_union_selected"] = f"WITH e AS MATERIALIZED ({EMBY}) " + " UNION ".join(
    f"SELECT feature FROM (SELECT feature FROM ({sql(y)}) ORDER BY score DESC, feature LIMIT 42)" for y in ("y0", "y1") for sql in (fscore_sql, mi_sql))


def e06(s, d):
    df = V.v_tab(s, d).withColumn("label", (F.col("cls") == "1-URGENT").cast("double"))
    return selection.rfe_cv(df, "number", ["x1", "x2", "x3"], "label", folds=3, trees=8, depth=4)


Q["e06_rfe_cv"] = e06

"""Null classes, repeated positions, tied orders and composite keys, each against SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from posteria.operators import balance, neighbors, sampling, sets
from posteria.operators import evaluation as ev
from registry import views as V
from registry.q_evaluate import RES, clip_sql, with_residual
from registry.q_prepare import HASH, KEYS, OBJ, RANKED
from registry.util import rnd, rounded

Q, SQL = {}, {}

# objects of one class have none
GAPS = f"SELECT number, case when cls = 'error' then null else cls end AS cls, {HASH} AS h FROM ({OBJ})"


def with_gaps(s, d):
    return V.v_obj(s, d, ["number", "cls"]).withColumn("cls", F.expr("nullif(cls, 'error')"))


Q["d03_null_class"] = lambda s, d: sampling.stratified_split(with_gaps(s, d), ["number"], "cls")
SQL["d03_null_class"] = (
    "SELECT number, cls, case when row_number() OVER (PARTITION BY cls ORDER BY h) <= ceil(0.1::double * count(*) OVER (PARTITION BY cls)) "
    f"then 'valid' else 'train' end AS split FROM ({GAPS})")
Q["d04_null_class"] = lambda s, d: sampling.kfold(with_gaps(s, d), ["number"], 8, 1, "cls")
SQL["d04_null_class"] = (
    f"SELECT number, cls, 0::int AS repeat, (ntile(8) OVER (PARTITION BY cls ORDER BY h) - 1)::int AS fold FROM ({GAPS})")
Q["d05_null_class"] = lambda s, d: sampling.undersample(with_gaps(s, d), ["number"], "cls")
SQL["d05_null_class"] = (
    f"WITH o AS ({GAPS}) SELECT number, cls FROM o QUALIFY row_number() OVER (PARTITION BY cls ORDER BY h) "
    "<= (SELECT min(c) FROM (SELECT count(*) AS c FROM o GROUP BY cls))")
Q["d05_null_class_replacement"] = lambda s, d: sampling.undersample(
    with_gaps(s, d), ["number"], "cls", replacement=True).withColumn("pick", F.col("pick").cast("int"))
SQL["d05_null_class_replacement"] = f"""
WITH o AS (SELECT number, cls, row_number() OVER (PARTITION BY cls ORDER BY h) AS r, count(*) OVER (PARTITION BY cls) AS n FROM ({GAPS})),
p AS (SELECT cls, n, unnest(range(1, 1 + (SELECT min(n) FROM o))) AS pick FROM (SELECT DISTINCT cls, n FROM o)),
q AS (SELECT cls, pick, floor({V._slice("md5(coalesce(cls || '|', '') || pick::varchar || '|42')", 1, 'duckdb')} * n) + 1 AS r FROM p)
SELECT o.number, o.cls, pick::int AS pick FROM q JOIN o ON o.cls IS NOT DISTINCT FROM q.cls AND o.r = q.r"""

# one true class has no name
NORES = f"SELECT nullif(true_class, 'p2') AS true_class, r FROM ({RES})"


def residual_gaps(s, d):
    return with_residual(s, d).withColumn("true_class", F.expr("nullif(true_class, 'p2')"))


R = lambda e: f"round({e}, 6) + 0.0::double"
Q["e17_null_group"] = lambda s, d: rounded(ev.mad_std(residual_gaps(s, d), "r", ["true_class"]))
SQL["e17_null_group"] = (
    f"SELECT true_class, {R('any_value(m)')} AS median, {R('1.482602218505602::double * median(abs(r - m))')} AS mad_std FROM "
    f"(SELECT true_class, r, median(r) OVER (PARTITION BY true_class) AS m FROM ({NORES})) GROUP BY true_class")
Q["e18_null_group"] = lambda s, d: rounded(ev.sigma_clip_stats(residual_gaps(s, d), "r", ["true_class"]))
SQL["e18_null_group"] = (
    f"SELECT g AS true_class, count(*) AS n_left, {R('avg(v)')} AS mean, {R('median(v)')} AS median, {R('stddev_pop(v)')} AS std "
    f"FROM ({clip_sql(NORES, 'r', 'true_class')}) GROUP BY g")

# --- positions -------------------------------------------------------------------------------
PLACES = [7, 3, 3, 0, 7, 7, 11]
Q["a13_repeated_positions"] = lambda s, d: sampling.select_positions(V.v_obj(s, d, [*KEYS, "cls"]), KEYS, PLACES)
SQL["a13_repeated_positions"] = (
    f"SELECT tile_id, number, cls, rn AS position, request FROM ({RANKED}) JOIN (VALUES "
    + ", ".join(f"({p}, {i})" for i, p in enumerate(PLACES)) + ") v(place, request) ON rn = place")
# more positions than rows: every row of a short table comes up several times
Q["d07_more_than_rows"] = lambda s, d: sampling.evenly_spaced(
    V.v_obj(s, d, ["cls"]).distinct(), ["cls"], 12)
SQL["d07_more_than_rows"] = (
    f"WITH c AS (SELECT cls, row_number() OVER (ORDER BY cls) - 1 AS position FROM (SELECT DISTINCT cls FROM ({OBJ}))) "
    "SELECT cls, position, i AS request FROM c JOIN range(0, 12) t(i) ON position = "
    "floor(i * ((SELECT count(*) FROM c) - 1) / 11.0::double)::bigint")
# an order with ties: how many rows of each class are taken is fixed, which ones is not
Q["a04_tied_order"] = lambda s, d: sampling.systematic_sample(
    V.v_obj(s, d, ["number", "cls"]), ["cls"], 7, 3).groupBy("cls").agg(F.count(F.lit(1)).alias("n"))
SQL["a04_tied_order"] = (
    f"SELECT cls, count(*) AS n FROM (SELECT cls, row_number() OVER (ORDER BY cls) - 1 AS rn FROM ({OBJ})) "
    "WHERE (rn + 3) % 7 = 0 GROUP BY cls")
Q["h04_difference_nulls"] = lambda s, d: sets.difference(
    with_gaps(s, d).select("cls"), with_gaps(s, d).filter("cls is null or cls = 'view'").select("cls"))
SQL["h04_difference_nulls"] = f"SELECT DISTINCT cls FROM ({GAPS}) WHERE cls IS NOT NULL AND cls <> 'view'"

# --- composite keys: numbers repeat between tiles ------------------------------------------------
TILES = "number % 7 AS tile, number // 7 AS num"
FEATS = [f"f{i}" for i in range(64)]


def tiled(s, d):
    return V.v_emb(s, d).withColumns({"tile": F.expr("number % 7"), "num": F.expr("number div 7")})


ED = "sqrt(" + " + ".join(f"(a.{f}-b.{f})*(a.{f}-b.{f})" for f in FEATS) + ")"
Q["g05_knn_composite"] = lambda s, d: neighbors.knn(
    tiled(s, d), tiled(s, d), ["tile", "num"], ["tile", "num"], FEATS, 5, skip_self=True).select(
    F.col("query.tile").alias("tile"), F.col("query.num").alias("num"), "rank",
    F.col("neighbour.tile").alias("near_tile"), F.col("neighbour.num").alias("near_num"), rnd("distance").alias("distance"))
SQL["g05_knn_composite"] = f"""
WITH e AS MATERIALIZED (SELECT *, {TILES} FROM ({V.emb_sql()})),
n AS (SELECT a.tile, a.num, b.tile AS near_tile, b.num AS near_num, {ED} AS distance FROM e a JOIN e b ON a.number <> b.number)
SELECT tile, num, row_number() OVER (PARTITION BY tile, num ORDER BY distance, near_tile, near_num)::int AS rank, near_tile, near_num,
 {R('distance')} AS distance FROM n QUALIFY rank <= 5"""
UNEVEN = "case when cls in ('C0','C1','C2','C3','C4') then 'A' when cls in ('C5','C6','C7') then 'B' else 'D' end"
SHOWN = ["f0", "f1", "f61", "f63"]
Q["d06_smote_composite"] = lambda s, d: rounded(balance.smote(
    tiled(s, d).withColumn("cls", F.expr(UNEVEN)), ["tile", "num"], "cls", FEATS).select("tile", "num", "cls", "synthetic", *SHOWN))
_key = "tile::varchar || '|' || num::varchar"
_u1 = V._slice(f"md5({_key} || '|' || 'n' || i::varchar)", 1, "duckdb")
_u2 = V._slice(f"md5({_key} || '|' || 'u' || i::varchar)", 1, "duckdb")
SQL["d06_smote_composite"] = f"""
WITH e AS MATERIALIZED (SELECT * EXCLUDE (cls), {UNEVEN} AS cls, {TILES} FROM ({V.emb_sql()})),
z AS (SELECT cls, count(*) AS n, max(count(*)) OVER () - count(*) AS need FROM e GROUP BY cls),
base AS (SELECT e.*, need // n + (row_number() OVER (PARTITION BY e.cls ORDER BY md5({_key} || '|42')) <= need % n)::int AS copies
  FROM e JOIN z USING (cls) WHERE need > 0),
near AS (SELECT a.number, b.number AS nb, row_number() OVER (PARTITION BY a.number ORDER BY {ED}, b.tile, b.num) AS rk
  FROM base a JOIN e b ON a.cls = b.cls AND a.number <> b.number QUALIFY rk <= 5),
made AS (SELECT *, floor({_u1} * 5)::int + 1 AS pick, {_u2} AS u FROM (SELECT base.*, unnest(range(1, copies + 1)) AS i FROM base)),
syn AS (SELECT m.tile, m.num, m.cls, i AS synthetic, {', '.join(f'm.{c} + u*(t.{c} - m.{c}) AS {c}' for c in SHOWN)}
  FROM made m JOIN near ON near.number = m.number AND near.rk = m.pick JOIN e t ON t.number = near.nb)
SELECT tile, num, cls, synthetic::int AS synthetic, {', '.join(f'{R(c)} AS {c}' for c in SHOWN)}
FROM (SELECT tile, num, cls, 0 AS synthetic, {', '.join(SHOWN)} FROM e UNION ALL SELECT * FROM syn)"""

# --- keys that repeat: two of three objects share their key with another -----------------------
PAIRED = "SELECT event_id // 3 AS pair, event_id AS number, event_type AS cls FROM events"


def paired(s, d):
    return V.v_obj(s, d, ["number", "cls"]).selectExpr("number div 3 AS pair", "number", "cls")


Q["d02_repeated_key"] = lambda s, d: sampling.train_valid_split(paired(s, d), ["pair"]).groupBy("split").agg(F.count(F.lit(1)).alias("n"))
SQL["d02_repeated_key"] = (
    "SELECT unnest(['valid', 'train']) AS split, unnest([ceil(count(*) * 0.1::double)::bigint, count(*) - ceil(count(*) * 0.1::double)::bigint]) AS n FROM events")
Q["d05_repeated_key"] = lambda s, d: sampling.undersample(paired(s, d), ["pair"], "cls").groupBy("cls").agg(F.count(F.lit(1)).alias("n"))
SQL["d05_repeated_key"] = f"SELECT cls, min(count(*)) OVER () AS n FROM ({PAIRED}) GROUP BY cls"

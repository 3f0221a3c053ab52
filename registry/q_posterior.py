"""Posterior summaries over every object's draws."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from posteria.operators import evaluation, posterior, quantiles
from registry import views as V
from registry.util import rounded, sql_rounded

Q, SQL = {}, {}
T3 = ["p1", "p2", "p3"]
DRAW = V.draw_sql()
SIGMA = "1.482602218505602::double"


def clip_sql(source: str, target: str, rounds: int) -> str:
    """Unrolled clip of one target: long rows (number, draw, v) that survive."""
    step = f"SELECT number, draw, {target} AS v FROM ({source})"
    for _ in range(rounds):
        step = (
            f"SELECT number, draw, v FROM (SELECT *, {SIGMA} * median(abs(v - m)) OVER (PARTITION BY number) AS s "
            f"FROM (SELECT *, median(v) OVER (PARTITION BY number) AS m FROM ({step}))) WHERE abs(v - m) <= 6 * s"
        )
    return step


ROUNDS = 10
CLIP_O1 = clip_sql(DRAW, "o1", ROUNDS)

Q["f02_clip_draws"] = lambda s, d: posterior.clip_draws(V.v_draws(s, d, ["o1"]), ["o1"]).select(
    "number", F.size("o1_clipped").cast("long").alias("n_left"),
    (F.round(F.array_max("o1_clipped"), 6) + F.lit(0.0)).alias("largest"))
SQL["f02_clip_draws"] = (
    f"SELECT number, count(*) AS n_left, round(max(v), 6) + 0.0::double AS largest FROM ({CLIP_O1}) GROUP BY number")


def _clipped(s, d):
    return posterior.clip_draws(V.v_draws(s, d, ["o1"]), ["o1"])


Q["f03_draw_percentiles"] = lambda s, d: rounded(
    posterior.draw_percentiles(_clipped(s, d), ["o1"]).drop("o1_draws", "o1_clipped"))
SQL["f03_draw_percentiles"] = (
    "SELECT number, " + ", ".join(
        f"round(quantile_cont(v, {q}), 6) + 0.0::double AS o1_{p}" for p, q in posterior.PERCENTILES.items())
    + f" FROM ({CLIP_O1}) GROUP BY number")

MAD = (
    f"SELECT number, round({SIGMA} * median(abs(v - m)), 6) + 0.0::double AS {{t}}_std FROM "
    "(SELECT *, median(v) OVER (PARTITION BY number) AS m FROM ({src})) GROUP BY number")
Q["f04_draw_mad_std"] = lambda s, d: rounded(
    posterior.draw_mad_std(_clipped(s, d), ["o1"]).drop("o1_draws", "o1_clipped"))
SQL["f04_draw_mad_std"] = MAD.format(t="o1", src=CLIP_O1)
Q["f05_draw_mean"] = lambda s, d: rounded(
    posterior.draw_mean(_clipped(s, d), ["o1"]).drop("o1_draws", "o1_clipped"))
SQL["f05_draw_mean"] = f"SELECT number, round(avg(v), 6) + 0.0::double AS o1_mean FROM ({CLIP_O1}) GROUP BY number"

CORR = ", ".join(f"round(corr({a}, {b}), 6) + 0.0::double AS {a}_{b}_corr" for a, b in combinations(T3, 2))
Q["f06_draw_correlation"] = lambda s, d: rounded(
    posterior.draw_correlation(V.v_draws(s, d, T3), T3).drop(*[f"{t}_draws" for t in T3]))
SQL["f06_draw_correlation"] = f"SELECT number, {CORR} FROM ({DRAW}) GROUP BY number"


def summary_sql(targets) -> str:
    parts, joins = [f"SELECT number, {CORR} FROM d GROUP BY number"], []
    for t in targets:
        clip = clip_sql("d", t, ROUNDS)
        pcs = ", ".join(
            f"round(quantile_cont(v, {q}), 6) + 0.0::double AS {t}_{p}" for p, q in posterior.PERCENTILES.items())
        parts.append(
            f"SELECT number, round(avg(v), 6) + 0.0::double AS {t}_mean, {pcs}, "
            f"round({SIGMA} * median(abs(v - m)), 6) + 0.0::double AS {t}_std FROM "
            f"(SELECT *, median(v) OVER (PARTITION BY number) AS m FROM ({clip})) GROUP BY number")
    joined = " JOIN ".join(f"({p}) s{i}" + (" USING (number)" if i else "") for i, p in enumerate(parts))
    return f"WITH d AS MATERIALIZED ({DRAW}) SELECT * FROM {joined}"


Q["f07_posterior_summary"] = lambda s, d: rounded(
    posterior.posterior_summary(V.v_draws(s, d, T3), ["number"], T3))
SQL["f07_posterior_summary"] = summary_sql(T3)

Q["f07_percentiles_of_long_draws"] = lambda s, d: quantiles.group_quantiles(
    V.v_draws_long(s, d, ["p1"]), ["number"], ["p1"], [0.15865, 0.5, 0.84135], bounded=True).select(
    "number", "q", (F.round("value", 6) + F.lit(0.0)).alias("value"))
SQL["f07_percentiles_of_long_draws"] = " UNION ALL ".join(
    f"SELECT number, {q}::double AS q, round(quantile_cont(p1, {q}), 6) + 0.0::double AS value FROM ({DRAW}) GROUP BY number"
    for q in (0.15865, 0.5, 0.84135))

Q["f15_observed_spread"] = lambda s, d: rounded(posterior.observed_spread(
    V.v_pred(s, d).select("number", "z_obs", "z_pred"), {"var_z": ("z_pred", "z_obs")}).select("number", "var_z"))
SQL["f15_observed_spread"] = (
    f"SELECT number, round(abs(z_pred - z_obs), 6) + 0.0::double AS var_z FROM ({V.pred_sql()})")

"""Catalog-like views over the given tables, one SQL text for both engines.

Only the uniform generator differs by dialect; it is bit-identical.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DRAWS = 40
CLASSES = ["click", "error", "purchase", "signup", "view"]


def u(key: str, stream: str | int, dialect: str) -> str:
    if dialect == "spark":
        digest = f"md5(concat(cast({key} as string),'|',cast({stream} as string)))"
        return f"(cast(conv(substr({digest},1,8),16,10) as bigint)/4294967296D)"
    digest = f"md5(({key})::varchar||'|'||({stream})::varchar)"
    return f"(('0x'||substr({digest},1,8))::bigint/4294967296.0::double)"


def _e(x: float, dialect: str) -> str:
    return f"cast({x} as double)"


def obj_columns(dialect: str) -> dict[str, str]:
    def r(k):
        return u("event_id", k, dialect)

    d = lambda x: _e(x, dialect)
    return {
        "tile_id": "user_id",
        "number": "event_id",
        "cls": "event_type",
        "flux_aper_1": f"case when event_id % 17 = 0 then {d(-999.0)} else value end",
        "flux_aper_2": f"case when event_id % 19 = 0 then {d(-999.0)} else value*({d(0.5)}+{r(5)}) end",
        "flux_aper_3": f"value*({d(0.2)}+{r(6)})",
        "flux_relerr_aper_1": f"{d(0.01)}+{d(0.1)}*{r(1)}",
        "flux_relerr_aper_2": f"{d(0.01)}+{d(0.1)}*{r(7)}",
        "flux_relerr_aper_3": f"{d(0.01)}+{d(0.1)}*{r(8)}",
        "mag_r": f"case when event_id % 13 = 0 then {d(99.0)} else {d(16)}+{d(10)}*{r(2)} end",
        "mag_g": f"case when event_id % 11 = 0 then {d(99.0)} else {d(16)}+{d(10)}*{r(3)} end",
        "mag_i": f"case when event_id % 23 = 0 then {d(99.0)} else {d(16)}+{d(10)}*{r(4)} end",
        "mag_err_r": f"{d(1.2)}*{r(21)}",
        "pmra_g": f"case when event_id % 29 = 0 then {d(0)} else {d(20)}*({r(9)}-{d(0.5)}) end",
        "pmde_g": f"case when event_id % 29 = 0 then {d(0)} else {d(20)}*({r(10)}-{d(0.5)}) end",
        "e_pmra_g": r(11),
        "e_pmde_g": r(12),
        "pmra_cw": f"{d(0.02)}*({r(13)}-{d(0.5)})",
        "pmde_cw": f"{d(0.02)}*({r(14)}-{d(0.5)})",
        "e_pmra_cw": f"{r(15)}-{d(0.5)}",
        "e_pmde_cw": f"{r(16)}-{d(0.5)}",
        "alpha_j2000": f"{d(360)}*{r(17)}",
        "delta_j2000": f"{d(180)}*{r(18)}-{d(90)}",
        "const_q": d(3.5),
    }


def obj_sql(cols=None, dialect="duckdb", table="events") -> str:
    every = obj_columns(dialect)
    names = cols or list(every)
    return f"SELECT {', '.join(f'{every[c]} AS {c}' for c in names)} FROM {table}"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def dealt(spark: SparkSession, df: DataFrame, key: str) -> DataFrame:
    """The given table is one small file: its rows are dealt out to all cores, by number, as the planner would join small parts again."""
    return df.repartition(spark.sparkContext.defaultParallelism, key)


def v_obj(spark: SparkSession, sf: str, cols=None) -> DataFrame:
    every = obj_columns("spark")
    names = cols or list(every)
    return table(spark, sf, "events").selectExpr(*[f"{every[c]} AS {c}" for c in names])


# --- external table: two of three objects have a row --------------------------

def ext_sql(dialect="duckdb") -> str:
    return (
        f"SELECT user_id AS tile_id, event_id AS number, {_e(0.3, dialect)}*{u('event_id', 20, dialect)} AS ebv, "
        f"{u('event_id', 22, dialect)} AS mag_r FROM events WHERE event_id % 3 <> 0"
    )


def v_ext(spark, sf) -> DataFrame:
    table(spark, sf, "events").createOrReplaceTempView("events")
    return spark.sql(ext_sql("spark"))


# --- posterior draws ------------------------------------------------------------

def _slice(digest: str, j: int, dialect: str) -> str:
    """The j-th uniform of a digest (eight hex digits each)."""
    part = f"substr({digest},{8 * j - 7},8)"
    if dialect == "spark":
        return f"(cast(conv({part},16,10) as bigint)/4294967296D)"
    return f"(('0x'||{part})::bigint/4294967296.0::double)"


_PRIME = 2147483647


def _mixed(n: str) -> str:
    """Integer hash by modular squares, the same text in both dialects."""
    x = f"(({n}) * 48271 + 11) % {_PRIME}"
    x = f"({x}) * ({x}) % {_PRIME} + {n}"
    return f"(({x}) % {_PRIME}) * 16807 % {_PRIME}"


def draw_sql() -> str:
    """Long table (number, draw, o1, p1, p2, p3) in DuckDB; every object."""
    w = [
        f"-ln(u{j} / {_PRIME}.0::double + {2.0**-33!r}::double)"
        f"*(case when number % 3 + 1 = {j} then 3.0::double else 1.0::double end) AS w{j}"
        for j in (1, 2, 3)
    ]
    us = ", ".join(f"{_mixed(f'(event_id * {3 * DRAWS} + draw * 3 + {j})')} AS u{j}" for j in (1, 2, 3))
    return (
        "SELECT number, draw, case when (number + draw) % 97 = 0 then 25.0::double else w1/(w1+w2+w3) end AS o1, "
        "w1/(w1+w2+w3) AS p1, w2/(w1+w2+w3) AS p2, w3/(w1+w2+w3) AS p3 FROM "
        f"(SELECT number, draw, {', '.join(w)} FROM (SELECT event_id AS number, draw, {us} FROM events, range(0,{DRAWS}) t(draw)))"
    )


def v_draws(spark, sf, targets=("o1", "p1", "p2", "p3")) -> DataFrame:
    """One row per object, one array of draws per target (``<t>_draws``)."""
    base = dealt(spark, table(spark, sf, "events").select("event_id"), "event_id")
    spots = [(d, j) for d in range(DRAWS) for j in (1, 2, 3)]
    mixed = base.selectExpr(
        "event_id AS number", *[f"{_mixed(f'(event_id * {3 * DRAWS} + {3 * d + j})')} AS u{d}_{j}" for d, j in spots]
    )
    weighed = mixed.selectExpr(
        "number",
        *[
            f"-ln(u{d}_{j} / {_PRIME}D + {2.0**-33!r}D)*(case when number % 3 + 1 = {j} then 3D else 1D end) AS w{d}_{j}"
            for d, j in spots
        ],
    )

    def value(t: str, d: int) -> str:
        share = f"w{d}_{1 if t == 'o1' else t[1]}/(w{d}_1+w{d}_2+w{d}_3)"
        return f"case when (number + {d}) % 97 = 0 then 25D else {share} end" if t == "o1" else share

    arrays = [f"array({', '.join(value(t, d) for d in range(DRAWS))}) AS {t}_draws" for t in targets]
    return weighed.selectExpr("number", *arrays)


def v_draws_long(spark, sf, targets=("o1", "p1", "p2", "p3")) -> DataFrame:
    zipped = ", ".join(f"{t}_draws" for t in targets)
    arrays = v_draws(spark, sf, targets)
    return arrays.selectExpr("number", f"posexplode(arrays_zip({zipped})) AS (draw, z)").selectExpr(
        "number", "draw", *[f"z.{t}_draws AS {t}" for t in targets]
    )


# --- evaluated predictions: draw 0 of every object --------------------------------

def pred_sql(dialect="duckdb") -> str:
    d = lambda x: _e(x, dialect)
    r = lambda k: u("event_id", k, dialect)
    w = [
        f"-ln({r(100 + j)} + {d(2.0**-33)})*(case when event_id % 3 + 1 = {j} then {d(3)} else {d(1)} end) AS w{j}"
        for j in (1, 2, 3)
    ]
    return (
        "SELECT number, true_class, w1/(w1+w2+w3) AS pred_p1, w2/(w1+w2+w3) AS pred_p2, w3/(w1+w2+w3) AS pred_p3, "
        f"mag_r, mag_g, mag_err_r, z_obs, z_obs + {d(0.05)}*(zu-{d(0.5)}) + (case when number % 101 = 0 then {d(3)} else {d(0)} end) AS z_pred, "
        "z_err, z_sigma FROM (SELECT event_id AS number, concat('p', cast(event_id % 3 + 1 as "
        f"{'string' if dialect == 'spark' else 'varchar'})) AS true_class, {', '.join(w)}, "
        f"case when event_id % 13 = 0 then {d(99.0)} else {d(16)}+{d(10)}*{r(2)} end AS mag_r, "
        f"{d(16)}+{d(10)}*{r(3)} AS mag_g, {d(1.2)}*{r(21)} AS mag_err_r, "
        f"{r(30)} AS z_obs, {r(31)} AS zu, {d(0.01)}*{r(32)} AS z_err, {d(0.005)}+{d(0.02)}*{r(33)} AS z_sigma FROM events) q"
    )


def v_pred(spark, sf) -> DataFrame:
    table(spark, sf, "events").createOrReplaceTempView("events")
    return spark.sql(pred_sql("spark"))


# --- compressed posteriors; one in ten has an indefinite covariance ----------------

GMM_COLUMNS = [
    *[f"comp{k}_cov_{ij}" for k in (1, 2, 3) for ij in ("11", "12", "22")],
    *[f"comp{k}_mean_{i}" for k in (1, 2, 3) for i in (1, 2)],
    *[f"comp{k}_weight" for k in (1, 2, 3)],
]


def gmm_sql(dialect="duckdb") -> str:
    d = lambda x: _e(x, dialect)
    r = lambda k: u("event_id", k, dialect)
    parts = []
    for k in (1, 2, 3):
        base = 40 + 10 * k
        parts += [
            f"{d(0.002)}+{d(0.02)}*{r(base)} AS comp{k}_cov_11",
            f"case when event_id % 10 = 0 then {d(0.05)} else {d(0.001)}*({r(base + 1)}-{d(0.5)}) end AS comp{k}_cov_12",
            f"{d(0.002)}+{d(0.02)}*{r(base + 2)} AS comp{k}_cov_22",
            f"{d(0.4)}*({r(base + 3)}-{d(0.5)}) AS comp{k}_mean_1",
            f"{d(0.4)}*({r(base + 4)}-{d(0.5)}) AS comp{k}_mean_2",
            f"{d(0.1)}+{r(base + 5)} AS q{k}",
        ]
    cov_mean = ", ".join(c for c in GMM_COLUMNS if "weight" not in c)
    weights = ", ".join(f"q{k}/(q1+q2+q3) AS comp{k}_weight" for k in (1, 2, 3))
    return f"SELECT tile_id, number, {cov_mean}, {weights} FROM (SELECT user_id AS tile_id, event_id AS number, {', '.join(parts)} FROM events) q"


def v_gmm(spark, sf) -> DataFrame:
    dealt(spark, table(spark, sf, "events").select("user_id", "event_id"), "event_id").createOrReplaceTempView("events")
    return spark.sql(gmm_sql("spark"))


# --- embeddings as 64 named features; orders as a small tabular problem -------------

def v_emb(spark, sf, dims=64) -> DataFrame:
    return table(spark, sf, "embeddings").selectExpr(
        "vec_id AS number",
        *[f"cast(embedding[{i}] as double) AS f{i}" for i in range(dims)],
        "concat('C', cast(label as string)) AS cls",
    )


def emb_sql(dims=64) -> str:
    feats = ", ".join(f"embedding[{i + 1}]::double AS f{i}" for i in range(dims))
    return f"SELECT vec_id AS number, {feats}, 'C'||label::varchar AS cls FROM embeddings"


def v_tab(spark, sf) -> DataFrame:
    return table(spark, sf, "orders").selectExpr(
        "o_orderkey AS number", "o_totalprice AS x1", "cast(o_custkey as double) AS x2",
        f"{u('o_orderkey', 60, 'spark')} AS x3", "o_orderpriority AS cls",
    )


def tab_sql() -> str:
    return (
        "SELECT o_orderkey AS number, o_totalprice AS x1, o_custkey::double AS x2, "
        f"{u('o_orderkey', 60, 'duckdb')} AS x3, o_orderpriority AS cls FROM orders"
    )

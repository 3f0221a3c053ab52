"""Training checked step by step: full-batch rounds of a small network, repeated in SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from posteria.models import network, scoring, training
from posteria.models.network import NetConfig
from posteria.operators import cleaning, labels, posterior
from posteria.plans import predict
from registry import views as V
from registry.q_flow import NET_F, NETX, NETY, R, plain_state
from registry.util import rounded

Q, SQL = {}, {}
EPOCHS, RATE = 4, 0.05
PLAIN = dict(hidden=(2,), dropout=(), input_dropout=0.0, epochs=EPOCHS, learning_rate=RATE, replicas=4, local_steps=False, patience=100)
SQUARED = NetConfig(kind="deterministic", loss="mse", **PLAIN)
LIKELIHOOD = NetConfig(kind="gaussian", loss="nll", **PLAIN)
TARGETS = {"mse": ["cls_click", "cls_error"], "nll": ["cls_click"]}


def rows(s, d):
    df = V.v_obj(s, d, ["number", "cls", *NET_F])
    return labels.encode_labels(predict.prepare_features(df, plain_state(s, d)), "cls", V.CLASSES)


def fitted(s, d, cfg):
    df = rows(s, d)
    return df, training.fit_net(df, ["number"], NET_F, TARGETS[cfg.loss], cfg)


def points(cfg):
    def run(s, d):
        df, model = fitted(s, d, cfg)
        return rounded(scoring.predict_points(df, model, ["number"]), 5)

    return run


FOLD = "ntile(3) OVER (ORDER BY md5(number::varchar || '|42')) - 1"


TRUTHS = ("(event_type = 'click')::int::double", "(event_type = 'error')::int::double")


def chain(cfg, tag="", fold=None, truths=TRUTHS):
    """CTEs p0..pE (one row of parameters and Adam moments each); with ``fold``
    trained on the other folds only."""
    others = "" if fold is None else f"AND fold <> {fold}"
    n_out = 2
    names = [f"w{i}{j}" for i in (0, 1) for j in (0, 1)] + ["b0", "b1"]
    names += [f"u{j}{k}" for j in (0, 1) for k in (0, 1)] + ["c0", "c1"]
    start = np.concatenate([p.ravel() for p in network.init_params(2, len(TARGETS[cfg.loss]), cfg)])
    ctes = [
        f"d{tag} AS MATERIALIZED (SELECT x.*, {FOLD} AS fold, {truths[0]} AS t0, {truths[1]} AS t1, "
        f"substr(md5(number::varchar || '|42'), 1, 8) < '4ccccccc' AS held FROM ({NETX}) x JOIN events ON event_id = number)",
        f"p{tag}0 AS (SELECT " + ", ".join(f"{float(v)!r}::double AS {n}, 0.0::double AS m_{n}, 0.0::double AS v_{n}" for n, v in zip(names, start)) + ")",
    ]

    def forward(e):
        z = ", ".join(f"w0{j}*x0 + w1{j}*x1 + b{j} AS z{j}" for j in (0, 1))
        h = ", ".join(f"greatest(z{j}, 0) AS h{j}" for j in (0, 1))
        o = ", ".join(f"h0*u0{k} + h1*u1{k} + c{k} AS o{k}" for k in range(n_out))
        base = f"SELECT *, {o} FROM (SELECT *, {h} FROM (SELECT *, {z} FROM d{tag}, p{tag}{e}))"
        if cfg.loss == "mse":
            return (f"SELECT *, ((o0-t0)*(o0-t0) + (o1-t1)*(o1-t1))/2 AS loss, o0 - t0 AS g0, o1 - t1 AS g1 FROM ({base})")
        return (
            "SELECT *, 0.5::double*((t0-o0)/sg)*((t0-o0)/sg) + ln(sg) + 0.5::double*ln(2*pi()) AS loss, -(t0-o0)/(sg*sg) AS g0, "
            "(1/sg - (t0-o0)*(t0-o0)/(sg*sg*sg))*0.05::double/(1 + exp(-0.05::double*o1)) AS g1 FROM "
            f"(SELECT *, 1e-4::double + ln(1 + exp(0.05::double*o1)) AS sg FROM ({base}))")

    for e in range(EPOCHS):
        back = ", ".join(f"case when z{j} > 0 then g0*u{j}0 + g1*u{j}1 else 0.0::double end AS k{j}" for j in (0, 1))
        grad = {f"w{i}{j}": f"x{i}*k{j}" for i in (0, 1) for j in (0, 1)} | {f"b{j}": f"k{j}" for j in (0, 1)}
        grad |= {f"u{j}{k}": f"h{j}*g{k}" for j in (0, 1) for k in (0, 1)} | {f"c{k}": f"g{k}" for k in (0, 1)}
        means = ", ".join(f"avg({x}) AS d_{n}" for n, x in grad.items())
        ctes.append(f"g{tag}{e} AS MATERIALIZED (SELECT {means} FROM (SELECT *, {back} FROM ({forward(e)})) WHERE NOT held {others})")
        t = e + 1
        moved = ", ".join(
            f"{n} - {RATE}::double*((0.9::double*m_{n} + 0.1::double*d_{n})/{1 - 0.9**t!r}::double)/(sqrt((0.999::double*v_{n} + 0.001::double*d_{n}*d_{n})/{1 - 0.999**t!r}::double) + 1e-7) AS {n}, "
            f"0.9::double*m_{n} + 0.1::double*d_{n} AS m_{n}, 0.999::double*v_{n} + 0.001::double*d_{n}*d_{n} AS v_{n}" for n in names)
        ctes.append(f"p{tag}{e + 1} AS MATERIALIZED (SELECT {moved} FROM p{tag}{e}, g{tag}{e})")
    return ", ".join(ctes), forward


def points_sql(cfg):
    ctes, forward = chain(cfg)
    shown = ", ".join(f"{R(f'o{i}', 5)} AS pred_{t}" for i, t in enumerate(TARGETS[cfg.loss]))
    return f"WITH {ctes} SELECT number, {shown} FROM ({forward(EPOCHS)})"


def history_sql(cfg):
    ctes, forward = chain(cfg)
    return f"WITH {ctes} " + " UNION ALL ".join(
        f"SELECT {e}::int AS epoch, (SELECT {R('avg(loss)', 5)} FROM ({forward(e)}) WHERE NOT held) AS loss, "
        f"(SELECT {R('avg(loss)', 5)} FROM ({forward(e + 1)}) WHERE held) AS val_loss, {RATE}::double AS learning_rate" for e in range(EPOCHS))


Q["g02_full_batch_rounds"] = points(SQUARED)
SQL["g02_full_batch_rounds"] = points_sql(SQUARED)
Q["g03_full_batch_rounds"] = points(LIKELIHOOD)
SQL["g03_full_batch_rounds"] = points_sql(LIKELIHOOD)
Q["g07_history_full_batch"] = lambda s, d: rounded(fitted(s, d, SQUARED)[1].history_table(s), 5)
SQL["g07_history_full_batch"] = history_sql(SQUARED)
Q["g07_history_likelihood"] = lambda s, d: rounded(fitted(s, d, LIKELIHOOD)[1].history_table(s), 5)
SQL["g07_history_likelihood"] = history_sql(LIKELIHOOD)


# dropout with rates of zero leaves every draw of a mask at one
UNDROPPED = NetConfig(kind="dropout", loss="nll", **PLAIN | dict(dropout=(0.0,)))


def g01(s, d):
    df = rows(s, d)
    model = training.fit_dropout_net(df, ["number"], NET_F, TARGETS["nll"], UNDROPPED)
    return rounded(scoring.predict_points(df, model, ["number"]), 5)


Q["g01_full_batch_rounds"] = g01
SQL["g01_full_batch_rounds"] = points_sql(LIKELIHOOD)


def g10(s, d):
    """A spread model trained on the distance of two columns from the truth."""
    df = posterior.observed_spread(rows(s, d), {"var_a": (NET_F[0], "cls_click"), "var_b": (NET_F[1], "cls_error")})
    model = training.fit_spread_model(df, ["number"], NET_F, ["var_a", "var_b"], SQUARED)
    return rounded(cleaning.floor_sigma(scoring.predict_points(df, model, ["number"]), ["pred_var_a", "pred_var_b"]), 5)


def g10_sql():
    ctes, forward = chain(SQUARED, truths=tuple(f"abs(x{i} - {t})" for i, t in enumerate(TRUTHS)))
    shown = ", ".join(f"greatest({R(f'o{i}', 5)}, 0.0001::double) AS pred_var_{c}" for i, c in enumerate("ab"))
    return f"WITH {ctes} SELECT number, {shown} FROM ({forward(EPOCHS)})"


Q["g10_spread_full_batch"] = g10
SQL["g10_spread_full_batch"] = g10_sql()


def g04(s, d):
    """One tree over a feature of five values: its leaves are the means of the groups."""
    df = V.v_tab(s, d).withColumn("code", F.substring("cls", 1, 1).cast("double"))
    models = training.fit_forest(df, ["code"], ["x1"], n_trees=1, depth=5, bootstrap=False)
    return rounded(training.predict_forest(df, models, ["code"]).select("number", "pred_x1"), 4)


Q["g04_single_tree"] = g04
SQL["g04_single_tree"] = f"SELECT number, {R('avg(x1) OVER (PARTITION BY cls)', 4)} AS pred_x1 FROM ({V.tab_sql()})"


def oof(s, d):
    out, _ = scoring.cross_validated_predictions(rows(s, d), ["number"], NET_F, TARGETS["mse"], SQUARED, k=3, n_iter=2)
    return rounded(out.select("number", "fold", *[f"{t}_pc50" for t in TARGETS["mse"]]), 5)


def oof_sql():
    parts = [chain(SQUARED, f"{c}_", f) for f, c in enumerate("abc")]
    shown = ", ".join(f"{R(f'o{i}', 5)} AS {t}_pc50" for i, t in enumerate(TARGETS["mse"]))
    return f"WITH {', '.join(p[0] for p in parts)} " + " UNION ALL ".join(
        f"SELECT number, fold::int AS fold, {shown} FROM ({p[1](EPOCHS)}) WHERE fold = {f}" for f, p in enumerate(parts))


Q["g09_out_of_fold_full_batch"] = oof
SQL["g09_out_of_fold_full_batch"] = oof_sql()

# --- scoring with weights that SQL can repeat ----------------------------------------------


def f01(s, d):
    state = plain_state(s, d)
    ready = predict.prepare_features(V.v_obj(s, d, ["number", *NET_F]), state)
    return rounded(posterior.explode_draws(scoring.draws(ready, state.model, ["number"], 3), ["number"], ["y1", "y2"]))


Q["f01_draws_fixed_weights"] = f01
SQL["f01_draws_fixed_weights"] = f"SELECT number, draw::int AS draw, {R('y1')} AS y1, {R('y2')} AS y2 FROM ({NETY}), range(0, 3) t(draw)"
Q["g12_external_fixed_weights"] = lambda s, d: rounded(predict.predict_external(
    V.v_obj(s, d, ["number", *NET_F]), plain_state(s, d), ["number"], n_iter=4, external=V.v_ext(s, d).select("number", "ebv"), keep=["ebv"]).select(
    "number", "ebv", "y1_pc02", "y2_mean", "CLASS"))
SQL["g12_external_fixed_weights"] = (
    f"SELECT n.number, {R('ebv')} AS ebv, {R('y1')} AS y1_pc02, {R('y2')} AS y2_mean, case when y1 >= y2 then 'a' else 'b' end AS CLASS "
    f"FROM ({NETY}) n LEFT JOIN ({V.ext_sql()}) e USING (number)")

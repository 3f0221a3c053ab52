"""Sources, sinks, models, scoring and streaming."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from posteria.models import network, scoring, training
from posteria.models.network import NetConfig
from posteria.models.training import FittedNet
from posteria.operators import cleaning, labels, posterior, scaling
from posteria.plans import bulk, predict, train
from posteria.session import staged_path
from posteria.sources import catalog, sinks
from posteria.streaming.scoring import scoring_throughput, stream_score, stream_score_logged
from registry import views as V
from registry.util import rounded

Q, SQL = {}, {}
KEYS = ["tile_id", "number"]
OBJ = V.obj_sql()
DRAW = V.draw_sql()
PRED = V.pred_sql()
SMALL = ["tile_id", "number", "cls", "flux_aper_3", "mag_g"]
SMALL_SCHEMA = "tile_id long, number long, cls string, flux_aper_3 double, mag_g double"


def R(expr, digits=6):
    return f"round({expr}, {digits}) + 0.0::double"


def as_csv(s, d, parts=None):
    """The view as CSV files in the shared folder."""
    path = staged_path(s, "csv")
    df = V.v_obj(s, d, SMALL)
    writer = df.write.option("header", True)
    if parts:
        writer = df.withColumn("part", F.expr(f"cls")).write.partitionBy("part").option("header", True)
    writer.csv(path)
    return path


Q["a01_scan_catalog"] = lambda s, d: rounded(catalog.scan_catalog(s, as_csv(s, d), SMALL_SCHEMA))
SQL["a01_scan_catalog"] = f"SELECT tile_id, number, cls, {R('flux_aper_3')} AS flux_aper_3, {R('mag_g')} AS mag_g FROM ({OBJ})"


def a02(s, d):
    path = as_csv(s, d)
    return rounded(catalog.scan_catalog(s, path, catalog.schema_from_sample(s, path))).select(
        F.col("tile_id").cast("long").alias("tile_id"), F.col("number").cast("long").alias("number"), "cls", "flux_aper_3", "mag_g")


Q["a02_schema_from_sample"] = a02
SQL["a02_schema_from_sample"] = SQL["a01_scan_catalog"]


def csv_files(s, d):
    path = as_csv(s, d, parts=True)
    return sorted({r[0] for r in s.read.text(path).select("_metadata.file_path").distinct().collect()})


def a05(s, d):
    files = csv_files(s, d)
    missing = files[0] + ".gone"
    df = catalog.scan_manifest(s, [*files, missing], SMALL_SCHEMA)
    # one folder for each class, and file names that repeat between them: only the path tells the class
    folder = F.regexp_extract("file", "part=([^/]*)/", 1).alias("folder")
    names = F.count_distinct(F.regexp_extract("file", "[^/]*$", 0)) <= F.count_distinct("file")
    return df.groupBy(folder).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("number").alias("objects"), F.min("cls").alias("cls"), names.alias("told_apart"))


Q["a05_scan_manifest"] = a05
SQL["a05_scan_manifest"] = (
    f"SELECT cls AS folder, count(*)::bigint AS n, count(DISTINCT number)::bigint AS objects, cls, true AS told_apart FROM ({OBJ}) GROUP BY cls")


def a06(s, d):
    files = csv_files(s, d)
    kept = catalog.existing_only(s, [files[0] + ".gone", *files])
    return catalog.scan_catalog(s, kept, SMALL_SCHEMA, "csv").select("number", "cls")


Q["a06_existing_only"] = a06
SQL["a06_existing_only"] = f"SELECT number, cls FROM ({OBJ})"
Q["a07_pending_only"] = lambda s, d: catalog.pending_only(
    V.v_obj(s, d, [*KEYS, "cls"]), V.v_ext(s, d).select(*KEYS), KEYS)
SQL["a07_pending_only"] = f"SELECT tile_id, number, cls FROM ({OBJ}) WHERE number % 3 = 0"


def a08(s, d, mode, digits):
    path = staged_path(s, "pred")
    df = V.v_pred(s, d).select("number", "mag_g", "pred_p1", "pred_p2", "true_class")
    sinks.write_predictions(df, path, ["number"], ["mag_g"], mode, digits, partition_by=["true_class"])
    return s.read.parquet(path)


Q["a08_write_reduced"] = lambda s, d: a08(s, d, "reduced", 4)
SQL["a08_write_reduced"] = f"SELECT number, round(pred_p1, 4) AS pred_p1, round(pred_p2, 4) AS pred_p2, true_class FROM ({PRED})"
Q["a08_write_full"] = lambda s, d: a08(s, d, "full", 6)
SQL["a08_write_full"] = (
    f"SELECT number, round(mag_g, 6) AS mag_g, round(pred_p1, 6) AS pred_p1, round(pred_p2, 6) AS pred_p2, true_class FROM ({PRED})")


def a09(s, d):
    from posteria.operators.sampling import stratified_split

    path = staged_path(s, "split")
    sinks.save_split(stratified_split(V.v_obj(s, d, ["number", "cls", "mag_g"]), ["number"], "cls"), path)
    return sinks.load_split(s, path, "valid")


Q["a09_save_load_split"] = a09
SQL["a09_save_load_split"] = (
    f"SELECT number, cls, mag_g FROM ({OBJ}) QUALIFY row_number() OVER (PARTITION BY cls ORDER BY md5(number::varchar || '|42')) "
    "<= ceil(0.1::double * count(*) OVER (PARTITION BY cls))")


def a10(s, d):
    path = staged_path(s, "draws")
    wanted = V.v_pred(s, d).filter("mag_r = 99").select("number")
    sinks.export_draws(V.v_draws_long(s, d, ["p1"]), wanted, ["number"], path)
    return rounded(s.read.parquet(path))


Q["a10_export_draws"] = a10
SQL["a10_export_draws"] = (
    f"SELECT number, draw::int AS draw, {R('p1')} AS p1 FROM ({DRAW}) WHERE number IN (SELECT number FROM ({PRED}) WHERE mag_r = 99)")

# --- a network with weights that follow from the data: SQL can repeat it ---------------------
NET_F = ["mag_g", "flux_aper_3"]
NET_W = [np.array([[0.5, -1.0, 0.25], [1.0, 0.75, -0.5]]), np.array([0.1, 0.0, 0.2]), np.array([[1.0, -0.5], [0.5, 0.25], [-1.0, 1.0]]), np.array([0.05, -0.05])]


def plain_state(s, d, kind="deterministic"):
    df = cleaning.missing_mag_to_null(V.v_obj(s, d, NET_F), ["mag_g"])
    scaler = scaling.scaler_constants(scaling.fit_scaler(df, NET_F))
    cfg = NetConfig(kind=kind, hidden=(3,), dropout=(0.0,), input_dropout=0.0)
    return sinks.CatalogState(FittedNet(NET_W, cfg, NET_F, ["y1", "y2"], []), scaler, None, ["a", "b"], ["mag_g"])


SCALED = ", ".join(
    f"coalesce(case when ({{0}} - lo_{i})/w_{i} < 0 then 0.0::double when ({{0}} - lo_{i})/w_{i} > 1 then 1.0::double else ({{0}} - lo_{i})/w_{i} end, -0.1::double) AS x{i}".format(c)
    for i, c in enumerate(["m", "f"]))
NETX = f"""SELECT number, {SCALED} FROM (SELECT number, nullif(mag_g, 99.0) AS m, flux_aper_3 AS f FROM ({OBJ})),
 (SELECT quantile_cont(m, 0.005) AS lo_0, quantile_cont(m, 0.995) - quantile_cont(m, 0.005) AS w_0, quantile_cont(f, 0.005) AS lo_1,
  quantile_cont(f, 0.995) - quantile_cont(f, 0.005) AS w_1 FROM (SELECT nullif(mag_g, 99.0) AS m, flux_aper_3 AS f FROM ({OBJ})))"""
_h = [f"greatest({NET_W[0][0, j]}::double*x0 + {NET_W[0][1, j]}::double*x1 + {NET_W[1][j]}::double, 0)" for j in range(3)]
_y = [" + ".join(f"{NET_W[2][j, t]}::double*h{j}" for j in range(3)) + f" + {NET_W[3][t]}::double" for t in range(2)]
NETY = f"SELECT number, {_y[0]} AS y1, {_y[1]} AS y2 FROM (SELECT number, {', '.join(f'{e} AS h{j}' for j, e in enumerate(_h))} FROM ({NETX}))"


def net_points(s, d):
    state = plain_state(s, d)
    path = staged_path(s, "state")
    sinks.save_state(s, state, path)
    state = sinks.load_state(s, path)
    ready = predict.prepare_features(V.v_obj(s, d, ["number", *NET_F]), state)
    return rounded(scoring.predict_points(ready, state.model, ["number"]))


Q["a11_save_load_state"] = net_points
SQL["a11_save_load_state"] = f"SELECT number, {R('y1')} AS pred_y1, {R('y2')} AS pred_y2 FROM ({NETY})"
Q["g11_score_fixed_weights"] = lambda s, d: rounded(predict.score(
    V.dealt(s, V.v_obj(s, d, ["number", *NET_F]), "number"), plain_state(s, d), ["number"], n_iter=5).select(
    "number", "y1_mean", "y1_pc50", "y2_pc98", "y2_std", "CLASS"))
SQL["g11_score_fixed_weights"] = (
    f"SELECT number, {R('y1')} AS y1_mean, {R('y1')} AS y1_pc50, {R('y2')} AS y2_pc98, 0.0::double AS y2_std, "
    f"case when y1 >= y2 then 'a' else 'b' end AS CLASS FROM ({NETY})")

# --- trained models --------------------------------------------------------------------------
FEATS = [f"f{i}" for i in range(64)]
TARGETS = ["cls_C0", "cls_C1", "cls_C2"]
TINY = NetConfig(hidden=(24, 12), dropout=(0.1, 0.1), input_dropout=0.05, epochs=4, batch_size=64, learning_rate=5e-3, replicas=4, patience=10)


def three_class(s, d):
    df = V.v_emb(s, d).withColumn("cls", F.expr("concat('C', cast(cast(substr(cls, 2) as int) % 3 as string))"))
    return labels.encode_labels(df, "cls", ["C0", "C1", "C2"])


def summarised(s, d, model, n_iter=20):
    drawn = scoring.draws(three_class(s, d), model, ["number"], n_iter)
    return labels.predicted_class(
        posterior.posterior_summary(drawn, ["number"], TARGETS), [f"{t}_pc50" for t in TARGETS], ["C0", "C1", "C2"])


def fitted(fit, **change):
    from dataclasses import replace

    return lambda s, d: summarised(s, d, fit(three_class(s, d), ["number"], FEATS, TARGETS, replace(TINY, **change)))


Q["f01_draws"] = lambda s, d: posterior.explode_draws(scoring.draws(
    three_class(s, d), training.fit_dropout_net(three_class(s, d), ["number"], FEATS, TARGETS, TINY), ["number"], 10), ["number"], TARGETS)
Q["g01_fit_dropout_net"] = fitted(training.fit_dropout_net)
Q["g01_fit_dropout_net_sync"] = fitted(training.fit_dropout_net, local_steps=False, learning_rate=2e-2)
Q["g02_fit_deterministic_net"] = fitted(training.fit_deterministic_net)
Q["g03_fit_gaussian_net"] = fitted(training.fit_gaussian_net, loss="nll")
Q["g06_fit_variational_net"] = fitted(training.fit_variational_net, loss="nll")
Q["g07_history"] = lambda s, d: training.fit_dropout_net(
    three_class(s, d), ["number"], FEATS, TARGETS, TINY).history_table(s)


def g04(s, d):
    df = three_class(s, d).withColumn("cls_C0", F.col("cls_C0").cast("double"))
    others = FEATS[1:]  # f0 is a target
    models = training.fit_forest(df, others, ["cls_C0", "f0"], n_trees=10, depth=5)
    return training.predict_forest(df, models, others).select("number", "pred_cls_C0", "pred_f0")


Q["g04_fit_forest"] = g04
Q["g08_loss_metrics"] = lambda s, d: rounded(scoring.loss_metrics(V.v_pred(s, d), "z_obs", "z_pred"))
_dd = "(z_pred - z_obs)"
_lg = "(ln(1 + greatest(z_pred, 1e-7)) - ln(1 + greatest(z_obs, 1e-7)))"
SQL["g08_loss_metrics"] = f"""SELECT {R(f'avg({_dd}*{_dd})')} AS mse, {R(f'avg(abs{_dd})')} AS mae,
 {R(f'avg(abs{_dd}/greatest(abs(z_obs), 1e-7)*100)')} AS mape, {R(f'avg({_lg}*{_lg})')} AS msle,
 {R(f'avg(case when abs{_dd} <= 1 then {_dd}*{_dd}*0.5::double else abs{_dd} - 0.5::double end)')} AS huber,
 {R(f'avg(abs{_dd} + ln(1 + exp(-2*abs{_dd})) - ln(2))')} AS log_cosh FROM ({PRED})"""


def g11_default(s, d):
    """300 draws of the default network, with mixtures, for every object; the weights are those it starts from."""
    cfg = NetConfig()
    model = training.FittedNet(network.init_params(64, 3, cfg), cfg, FEATS, TARGETS, [])
    objects = V.dealt(s, V.v_emb(s, d), "number")
    return scoring.summarised_draws(objects, model, ["number"], 300, mixtures=True)


Q["g11_score_default_net"] = g11_default


def oof(s, d):
    from dataclasses import replace

    return scoring.cross_validated_predictions(
        three_class(s, d), ["number"], FEATS, TARGETS, replace(TINY, epochs=2), k=3, n_iter=10)


Q["g09_cross_validated_predictions"] = lambda s, d: oof(s, d)[0].drop(*FEATS)


def g10(s, d):
    from dataclasses import replace

    table = posterior.observed_spread(oof(s, d)[0], {f"var_{t}": (f"{t}_pc50", t) for t in TARGETS})
    names = [f"var_{t}" for t in TARGETS]
    model = training.fit_spread_model(
        table, ["number"], FEATS, names, replace(training.SPREAD_CONFIG, hidden=(16,), epochs=2, replicas=4))
    return cleaning.floor_sigma(scoring.predict_points(table, model, ["number"], prefix="sigma_"), [f"sigma_{n}" for n in names])


Q["g10_fit_spread_model"] = g10


def whole_training(s, d):
    from dataclasses import replace

    df = V.v_obj(s, d).withColumn("cls", F.expr("case when cls in ('click', 'view') then 'C0' when cls = 'error' then 'C1' else 'C2' end"))
    plan = train.TrainPlan(
        keys=("tile_id", "number"), label="cls", features=("mag_g", "mag_r", "pmra_g"), photometry="flux_aper",
        mags=("mag_g", "mag_r"), stratify=True, balancing="undersample", net=replace(TINY, epochs=2))
    return train.train(df, plan)


def g11(s, d):
    state, prepared = whole_training(s, d)
    drawn = scoring.draws(prepared, state.model, KEYS, 20, ["cls", "split"])
    summary = posterior.posterior_summary(drawn, [*KEYS, "cls", "split"], state.model.targets)
    return labels.predicted_class(summary, [f"{t}_pc50" for t in state.model.targets], state.classes)


Q["g11_train_and_score"] = g11


def g12(s, d):
    df = three_class(s, d)
    model = training.fit_dropout_net(df, ["number"], FEATS, TARGETS, TINY)
    scaler = scaling.scaler_constants(scaling.fit_scaler(df, FEATS))
    state = sinks.CatalogState(model, scaler, None, ["C0", "C1", "C2"], [])
    return predict.predict_external(df.select("number", *FEATS), state, ["number"], n_iter=20, mixtures=True)


Q["g12_predict_external"] = g12

# --- streaming --------------------------------------------------------------------------------


def s01(s, d):
    state = plain_state(s, d)
    out, log = staged_path(s, "scored"), staged_path(s, "log")
    every = V.obj_columns("spark")
    rows = lambda df: predict.score(
        df.selectExpr(*[f"{every[c]} AS {c}" for c in ("number", *NET_F)]), state, ["number"], n_iter=5).select(
        "number", "y1_mean", "y2_pc50", "CLASS")
    schema = V.table(s, d, "events").schema
    return rounded(stream_score(s, d, out, schema, rows, log, name_glob="events.parquet"))


Q["s01_stream_score"] = s01
SQL["s01_stream_score"] = (
    f"SELECT number, {R('y1')} AS y1_mean, {R('y2')} AS y2_pc50, case when y1 >= y2 then 'a' else 'b' end AS CLASS FROM ({NETY})")


def s01_logged(s, d):
    state = plain_state(s, d)
    out, log = staged_path(s, "scored"), staged_path(s, "log")
    every = V.obj_columns("spark")
    rows = lambda df: predict.score(
        df.selectExpr(*[f"{every[c]} AS {c}" for c in ("number", *NET_F)]), state, ["number"], n_iter=5).select(
        "number", "y1_mean", "y2_pc50", "CLASS")
    return rounded(stream_score_logged(s, d, out, V.table(s, d, "events").schema, rows, log, name_glob="events.parquet"))


Q["s01_stream_score_logged"] = s01_logged
SQL["s01_stream_score_logged"] = SQL["s01_stream_score"]


def a08_bulk(s, d):
    """Two files of one catalog and one that is missing, scored in one call and called again."""
    state = plain_state(s, d)
    place = staged_path(s, "catalog")
    V.v_obj(s, d, ["number", *NET_F]).write.parquet(place)
    files = [r[0] for r in s.read.parquet(place).select("_metadata.file_path").distinct().collect()]
    schema, out = s.read.parquet(place).schema, staged_path(s, "bulk")
    call = lambda: bulk.predict_files(s, [*files, f"{place}/missing.parquet"], schema, state, ["number"], out, n_iter=5, files_per_batch=8, fmt="parquet")
    call()
    return call().select("number", "y1_mean", "y2_pc50", "CLASS")


Q["a08_predict_files"] = a08_bulk
SQL["a08_predict_files"] = (
    f"SELECT number, round(y1, 4) + 0.0::double AS y1_mean, round(y2, 4) + 0.0::double AS y2_pc50, case when y1 >= y2 then 'a' else 'b' end AS CLASS FROM ({NETY})")
Q["s02_scoring_throughput"] = lambda s, d: rounded(scoring_throughput(
    V.v_obj(s, d, ["tile_id", "cls", "mag_err_r"]).selectExpr("cls AS run", "tile_id AS file", "1 AS n_sources", "mag_err_r AS seconds")), 9)
SQL["s02_scoring_throughput"] = f"""
WITH f AS (SELECT cls AS run, tile_id AS file, count(*) AS n_sources, sum(mag_err_r) AS seconds FROM ({OBJ}) GROUP BY ALL)
SELECT run, file, n_sources, {R('seconds', 9)} AS seconds, {R('seconds / n_sources', 9)} AS file_secs_per_source,
 {R('sum(seconds) OVER w / sum(n_sources) OVER w', 9)} AS secs_per_source FROM f WINDOW w AS (PARTITION BY run ORDER BY file)"""

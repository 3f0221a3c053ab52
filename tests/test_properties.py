"""Agreement with brute force, independence of partitions, statistics."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from posteria.functions import addressed, arrays
from posteria.functions.seeded import normal, uniform
from posteria.models import network, scoring, training
from posteria.models.network import NetConfig
from posteria.operators import balance, evaluation, mixture, neighbors, ordered, posterior, quantiles, sampling, selection
from posteria.plans import predict, train
from posteria.sources import catalog, sinks
from posteria.streaming.scoring import stream_score


def test_narrowed_quantiles_with_ties_and_a_hot_group(spark):
    rng = np.random.default_rng(3)
    frame = pd.DataFrame({"g": ["hot"] * 6000 + [None] * 40 + ["one"], "v": np.r_[np.round(rng.normal(size=6000), 1), rng.normal(size=40), 5.0]})
    frame.loc[:2000, "v"] = 0.3
    df = spark.createDataFrame(frame)
    qs = [0.0, 0.005, 0.31, 0.5, 0.995, 1.0]
    got = quantiles.group_quantiles(df, ["g"], ["v"], qs, left_values=100).collect()
    assert len(got) == 3 * len(qs)
    for r in got:
        part = frame[frame.g.isna()] if r["g"] is None else frame[frame.g == r["g"]]
        assert r["value"] == pytest.approx(np.quantile(part.v, r["q"]), abs=1e-12)


@pytest.mark.parametrize("p,fan,block", [(2, 9, 64), (1, 5, 50), (3, None, 4096), (2, 30, 4096), (2, 2, 64)])
def test_knn_equals_brute_force(spark, p, fan, block):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 3))
    x[:150] = [0.25, 0.25, 0.25]  # a third of all rows are copies
    q = np.vstack([rng.normal(size=(60, 3)), x[:5]])
    t = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "k long, a double, b double, c double")
    u = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(q)], "k long, a double, b double, c double")
    got = neighbors.knn(t, u, "k", "k", ["a", "b", "c"], 4, p=p, fan=fan, block=block, probes=2).collect()
    d = (np.abs(q[:, None] - x[None]) ** p).sum(2) ** (1 / p)
    want = {(i, r + 1): int(j) for i in range(len(q)) for r, j in enumerate(np.lexsort((np.arange(400), np.round(d[i], 12)))[:4])}
    assert {(r["query"], r["rank"]): r["neighbour"] for r in got} == want


def test_knn_within_groups_skips_the_row_itself(spark):
    df = spark.range(60).select(F.col("id").alias("k"), (F.col("id") % 2).cast("string").alias("g"), F.col("id").cast("double").alias("x"))
    out = neighbors.knn(df, df, "k", "k", ["x"], 2, by="g", skip_self=True, fan=4, block=8).collect()
    assert len(out) == 120
    assert all(r["query"] != r["neighbour"] and (r["query"] - r["neighbour"]) % 2 == 0 for r in out)
    assert {r["neighbour"] for r in out if r["query"] == 10} == {8, 12}


def test_smote_points_lie_between_class_members(spark):
    rng = np.random.default_rng(1)
    data = [(i, "big" if i < 90 else "small", *map(float, rng.normal(size=2))) for i in range(120)]
    df = spark.createDataFrame(data, "k long, c string, x double, y double")
    out = balance.smote(df, "k", "c", ["x", "y"]).toPandas()
    assert dict(out.c.value_counts()) == {"big": 90, "small": 90}
    real = np.array([r[2:] for r in data if r[1] == "small"])
    for _, r in out[out.synthetic > 0].iterrows():
        base = np.array([d[2:] for d in data if d[0] == r.k][0])
        step = np.array([r.x, r.y]) - base
        away = real - base
        cross = np.abs(away[:, 0] * step[1] - away[:, 1] * step[0])
        along = (away * step).sum(1)
        assert ((cross < 1e-9) & (along >= (step**2).sum() - 1e-9)).any()
    again = balance.smote(df.repartition(7), "k", "c", ["x", "y"]).toPandas()
    key = ["k", "synthetic"]
    pd.testing.assert_frame_equal(out.sort_values(key).reset_index(drop=True), again.sort_values(key).reset_index(drop=True))


def test_smote_refuses_single_members(spark):
    df = spark.createDataFrame([(1, "a", 0.0), (2, "a", 1.0), (3, "b", 0.0)], "k long, c string, x double")
    with pytest.raises(ValueError):
        balance.smote(df, "k", "c", ["x"])


def test_auc_is_antisymmetric_and_roc_ends_at_one(spark):
    df = spark.range(500).select((F.col("id") % 3 == 0).cast("int").alias("y"), F.round(uniform("id", 1), 2).alias("s"))
    one = evaluation.auc(df, "y", "s").first()["auc"]
    two = evaluation.auc(df.withColumn("s", -F.col("s")), "y", "s").first()["auc"]
    assert one + two == pytest.approx(1)
    points = evaluation.roc_points(df, "y", "s").toPandas().sort_values(["tpr", "fpr"])
    assert (points.tpr.iloc[0], points.fpr.iloc[0], points.tpr.iloc[-1], points.fpr.iloc[-1]) == (0, 0, 1, 1)
    assert np.trapezoid(points.tpr, points.fpr) == pytest.approx(one)


def test_single_class_auc_is_null(spark):
    df = spark.range(10).select(F.lit(1).alias("y"), F.col("id").cast("double").alias("s"))
    assert evaluation.auc(df, "y", "s").first()["auc"] is None


def test_grouped_clip_equals_overall_clip_and_many_blocks(spark, monkeypatch):
    df = spark.range(4000).select(F.lit("g").alias("g"), F.when(F.col("id") % 50 == 0, 100.0 + F.col("id")).otherwise(normal("id", 1)).alias("v"))
    plain = evaluation.sigma_clip_stats(df, "v").first()
    grouped = evaluation.sigma_clip_stats(df, "v", ["g"]).first()
    monkeypatch.setattr(ordered, "LEAST_BLOCK", 20)
    large = evaluation.sigma_clip_stats(df, "v", ["g"]).first()
    for c in ("n_left", "mean", "median", "std"):
        assert plain[c] == pytest.approx(grouped[c]) == pytest.approx(large[c])
    assert plain["n_left"] == 4000 - 80


def test_right_gaussian_pulls_have_unit_spread(spark):
    df = spark.range(4000).select(normal("id", 1).alias("obs"), F.lit(0.0).alias("pred"), F.lit(1.0).alias("sig"))
    out = evaluation.pull_distribution(df, "obs", "pred", "sig")
    r = out.first()
    assert r["mad_std"] == pytest.approx(1, abs=0.05) and r["clipped_mean"] == pytest.approx(0, abs=0.06)
    assert out.agg((F.sum("density") * 0.24).alias("d")).first()["d"] == pytest.approx(1)


def test_array_statistics_against_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(20, 31))
    x[:, 3] = 50
    df = spark.createDataFrame([(i, list(map(float, r)), list(map(float, r[::-1]))) for i, r in enumerate(x)], "id int, a_draws array<double>, b_draws array<double>")
    out = posterior.posterior_summary(df, ["id"], ["a", "b"]).toPandas().set_index("id")
    for i in range(20):
        v = np.delete(x[i], 3)
        assert out.a_mean[i] == pytest.approx(v.mean())
        assert out.a_std[i] == pytest.approx(arrays.MAD_TO_SIGMA * np.median(np.abs(v - np.median(v))))
        assert out.a_pc16[i] == pytest.approx(np.percentile(v, 15.865))
        assert out.a_b_corr[i] == pytest.approx(np.corrcoef(x[i], x[i][::-1])[0, 1])


def test_identical_draws_have_no_spread_and_no_correlation(spark):
    df = spark.createDataFrame([([0.5] * 9, [0.1 * i for i in range(9)])], "a_draws array<double>, b_draws array<double>")
    r = posterior.posterior_summary(df.withColumn("id", F.lit(1)), ["id"], ["a", "b"]).first()
    assert r["a_std"] == 0 and r["a_pc50"] == 0.5 and r["a_b_corr"] is None


def test_summary_in_blocks_equals_the_single_operators(spark):
    rng = np.random.default_rng(8)
    rows = [(i, np.r_[rng.normal(size=20 + i % 3), [60.0] * (i % 2)].tolist()) for i in range(40)]
    rows = [(i, a, a[::-1]) for i, a in rows] + [(40, None, None), (41, [], []), (42, [0.1] * 9, [0.1] * 9)]
    df = spark.createDataFrame(rows, "id int, a_draws array<double>, b_draws array<double>")
    fast = posterior.posterior_summary(df, ["id"], ["a", "b"], block=7).orderBy("id").toPandas()
    slow = posterior.clip_draws(df, ["a", "b"])
    slow = posterior.draw_percentiles(posterior.draw_mean(posterior.draw_mad_std(slow, ["a", "b"]), ["a", "b"]), ["a", "b"])
    slow = posterior.draw_correlation(slow, ["a", "b"]).orderBy("id").toPandas()[list(fast.columns)]
    assert len(fast) == 43
    pd.testing.assert_frame_equal(fast, slow, check_dtype=False, atol=1e-12)
    assert np.isnan(fast.a_b_corr[42]) and np.isnan(fast.a_mean[41])


def test_gmm_recovers_planted_mixture(spark):
    rng = np.random.default_rng(0)
    centres, weights = np.array([[-0.4, 0.0], [0.0, 0.1], [0.4, -0.1]]), [0.5, 0.3, 0.2]
    draws = []
    for i in range(6):
        pts = np.vstack([rng.normal(c, 0.03, (int(600 * w), 2)) for c, w in zip(centres, weights)])
        draws.append((i, pts[:, 0].tolist(), pts[:, 1].tolist()))
    df = spark.createDataFrame(draws, "id int, r1_draws array<double>, r2_draws array<double>")
    out = mixture.fit_gmm(df, ["id"]).toPandas()
    for k, (c, w) in enumerate(zip(centres, weights), 1):
        assert np.allclose(out[f"comp{k}_weight"], w, atol=0.01)
        assert np.allclose(out[[f"comp{k}_mean_1", f"comp{k}_mean_2"]], c, atol=0.01)
        assert np.allclose(out[f"comp{k}_cov_11"], 0.0009, rtol=0.3)


@pytest.mark.parametrize("loss", sorted(network.LOSSES) + ["nll"])
@pytest.mark.parametrize("kind", ["deterministic", "gaussian"])
def test_gradients_match_finite_differences(kind, loss):
    if kind == "deterministic" and loss == "nll":
        with pytest.raises(ValueError):
            NetConfig(kind=kind, loss=loss)
        return
    cfg = NetConfig(kind=kind, loss=loss, hidden=(5, 4), dropout=())
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(7, 3)), rng.random((7, 2)) + 0.2
    params = network.init_params(3, 2, cfg)
    value = lambda: network.gradients(params, x, y, cfg, np.random.default_rng(9), 7)[0]
    grads = network.gradients(params, x, y, cfg, np.random.default_rng(9), 7)[1]
    for p, g in zip(params, grads):
        at = tuple(0 for _ in p.shape)
        old = p[at]
        p[at] = old + 1e-6
        up = value()
        p[at] = old - 1e-6
        down = value()
        p[at] = old
        assert g[at] == pytest.approx((up - down) / 2e-6, rel=1e-3, abs=1e-6)


def test_learning_rate_schedule():
    cfg = NetConfig(step_decay=30)
    assert network.decayed(1e-4, 28, cfg) == 1e-4
    assert network.decayed(1e-4, 29, cfg) == 5e-5
    assert network.decayed(2.5e-5, 59, cfg) in (1.2e-5, 1.3e-5)
    assert network.decayed(1e-7, 29, cfg) == 1e-7


PLANTED = NetConfig(hidden=(16,), dropout=(0.1,), input_dropout=0.0, epochs=12, batch_size=32, learning_rate=1e-2, replicas=3)


def planted(spark, n=900):
    df = spark.range(n).select("id", (uniform("id", 1) * 2 - 1).alias("x"), (uniform("id", 2) * 2 - 1).alias("z"))
    a = (F.col("x") + F.col("z") > 0).cast("double")
    return df.select("*", a.alias("a"), (1 - a).alias("b"))


@pytest.mark.parametrize("fit", ["dropout", "deterministic", "gaussian", "variational"])
def test_networks_learn_a_planted_rule(spark, fit):
    from dataclasses import replace

    df = planted(spark)
    cfg = replace(PLANTED, epochs=25 if fit == "variational" else 12, learning_rate=2e-2 if fit == "variational" else 1e-2)
    model = getattr(training, f"fit_{fit}_net")(df, ["id"], ["x", "z"], ["a", "b"], cfg)
    losses = [h[2] for h in model.history]
    assert losses[-1] < losses[0]
    out = scoring.predict_points(df, model, ["id"], ["a"])
    assert out.filter((F.col("pred_a") > F.col("pred_b")) == (F.col("a") == 1)).count() > 0.9 * 900


def test_draws_do_not_depend_on_partitions(spark):
    df = planted(spark, 60)
    model = training.FittedNet(network.init_params(2, 2, PLANTED), PLANTED, ["x", "z"], ["a", "b"], [])
    one = scoring.draws(df.repartition(1), model, ["id"], 7).orderBy("id").collect()
    many = scoring.draws(df.repartition(9), model, ["id"], 7).orderBy("id").collect()
    assert [r["id"] for r in one] == [r["id"] for r in many]
    # a different batch shape may change the last bit of a matrix product
    assert np.allclose([r["a_draws"] for r in one], [r["a_draws"] for r in many], atol=1e-12)


def test_input_noise_widens_the_draws(spark):
    df = planted(spark, 20).withColumns({"x__err": F.lit(0.5), "z__err": F.lit(0.5)})
    cfg = NetConfig(kind="deterministic", hidden=(8,), dropout=())
    model = training.FittedNet(network.init_params(2, 1, cfg), cfg, ["x", "z"], ["a"], [])
    still = scoring.draws(df, model, ["id"], 30).first()["a_draws"]
    noisy = scoring.draws(df, model, ["id"], 30, input_noise=True).first()["a_draws"]
    assert np.std(still) < 1e-12 and np.std(noisy) > 0.01


def test_early_stopping_keeps_the_best_epoch(spark):
    from dataclasses import replace

    cfg = replace(PLANTED, learning_rate=5.0, epochs=30, patience=2, kind="deterministic")
    model = training.fit_net(planted(spark, 200), ["id"], ["x", "z"], ["a", "b"], cfg)
    assert len(model.history) < 30


def test_cross_validation_covers_every_row_once(spark):
    from dataclasses import replace

    df = planted(spark, 120)
    out, losses = scoring.cross_validated_predictions(df, ["id"], ["x", "z"], ["a", "b"], replace(PLANTED, epochs=2), k=3, n_iter=5)
    assert sorted(r["id"] for r in out.select("id").collect()) == list(range(120))
    assert losses.count() == 6


def test_state_round_trip(spark, tmp_path):
    model = training.FittedNet(network.init_params(2, 2, PLANTED), PLANTED, ["x", "z"], ["a", "b"], [(0, 1.0, 2.0, 0.1)])
    state = sinks.CatalogState(model, {"x": (0.0, 2.0)}, 0.5, ["a", "b"], ["m"])
    sinks.save_state(spark, state, str(tmp_path / "s"))
    back = sinks.load_state(spark, str(tmp_path / "s"))
    assert back.model.cfg == PLANTED and back.scaler == state.scaler and back.model.history == model.history
    assert all(np.array_equal(a, b) for a, b in zip(back.model.params, model.params))


def test_stream_restart_equals_batch(spark, tmp_path):
    source, out, log = (str(tmp_path / n) for n in ("in", "out", "log"))
    df = planted(spark, 100)
    model = training.FittedNet(network.init_params(2, 2, PLANTED), PLANTED, ["x", "z"], ["a", "b"], [])
    state = sinks.CatalogState(model, {}, None, ["a", "b"], [])
    rows = lambda d: predict.score(d, state, ["id"], n_iter=4)
    run = lambda: stream_score(spark, source, out, df.schema, rows, log)
    df.filter("id < 60").write.parquet(source)
    assert run().count() == 60
    assert run().count() == 60
    df.filter("id >= 60").write.mode("append").parquet(source)
    streamed = run().orderBy("id").toPandas()
    batch = rows(df).orderBy("id").toPandas()
    pd.testing.assert_frame_equal(streamed, batch, atol=1e-9)


def test_training_plan_smote_and_anova(spark):
    n = 240
    df = spark.range(n).select(
        F.lit(1).alias("tile_id"), F.col("id").alias("number"),
        F.when(F.col("id") % 6 == 0, "QSO").when(F.col("id") % 6 == 1, "STAR").otherwise("GAL").alias("CLASS"),
        *[(uniform("id", i) + (F.col("id") % 6 == i).cast("double")).alias(f"f{i}") for i in range(6)])
    plan = train.TrainPlan(("tile_id", "number"), "CLASS", tuple(f"f{i}" for i in range(6)), stratify=True, select="anova",
                           net=NetConfig(hidden=(8,), dropout=(0.1,), epochs=2, batch_size=32, learning_rate=1e-2, replicas=2))
    state, prepared = train.train(df, plan)
    assert state.classes == ["GAL", "QSO", "STAR"] and 4 <= len(state.model.features) <= 6
    out = predict.score(df, state, ["tile_id", "number"], n_iter=6, mixtures=True)
    assert out.count() == n and "comp3_weight" in out.columns and out.filter("CLASS is null").count() == 0


def test_scoring_prepares_rows_as_training_did(spark, tmp_path):
    from registry import views

    df = views.v_obj(spark, "/root/testdata/sf0.001").withColumn("z", F.when(F.col("number") % 5 == 0, -1000.0).otherwise(F.col("mag_err_r")))
    plan = train.TrainPlan(
        ("tile_id", "number"), "cls", ("mag_g", "pmra_g", "pmde_g", "e_pmra_g", "e_pmde_g", "pmra_cw", "pmde_cw"), targets=("z",),
        photometry="flux_aper", fold_motion=True, galactic_latitude=True, mags=("mag_g",), balancing="undersample",
        net=NetConfig(hidden=(6,), dropout=(0.1,), epochs=2, learning_rate=1e-2, replicas=2))
    state, prepared = train.train(df, plan)
    assert {"pm_g", "pm_g_error", "pm_cw", "e_pm_cw", "b", "flux_aper_1", "mag_g"} == set(state.model.features) - {"flux_aper_2", "flux_aper_3"}
    assert state.model.targets[0] == "z" and len(state.class_targets) == 5
    assert prepared.filter("z < -999").count() == 0 and prepared.count() == 800
    sinks.save_state(spark, state, str(tmp_path / "state"))
    state = sinks.load_state(spark, str(tmp_path / "state"))
    again = predict.prepare_features(df, state)
    cols = [*state.model.features, *[f"{f}__err" for f in state.model.features]]
    left = prepared.select("number", *cols).orderBy("number").toPandas()
    right = again.filter("number % 5 <> 0").select("number", *cols).orderBy("number").toPandas()
    pd.testing.assert_frame_equal(left, right, atol=1e-12)
    out = predict.score(df, state, ["tile_id", "number"], n_iter=5)
    assert out.count() == 1000 and out.filter("CLASS is null or z_mean is null").count() == 0


def test_regression_only_plan(spark):
    df = planted(spark, 200).withColumn("z", F.col("x") * 0.5)
    plan = train.TrainPlan(("id",), None, ("x",), targets=("z",), net=NetConfig(hidden=(6,), dropout=(0.0,), input_dropout=0.0, epochs=2, learning_rate=1e-2, replicas=2))
    state, _ = train.train(df, plan)
    out = predict.score(df, state, ["id"], n_iter=5)
    assert out.count() == 200 and "CLASS" not in out.columns
    with pytest.raises(ValueError):
        train.TrainPlan(("id",), None, ("x",))


def test_manifest_and_pending(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"t{i}.csv").write_text("tile_id,number,x\n" + f"{i},1,0.5\n{i},2,1.5\n")
    names = [str(tmp_path / f"t{i}.csv") for i in (0, 1, 2, 9)]
    (tmp_path / "list.txt").write_text("\n".join(names) + "\n")
    schema = catalog.schema_from_sample(spark, names[0])
    df = catalog.scan_manifest(spark, str(tmp_path / "list.txt"), schema)
    found = sorted(r["file"] for r in df.select("file").distinct().collect())
    assert df.count() == 6 and [f.removeprefix("file:") for f in found] == names[:3]
    done = spark.createDataFrame([(found[1],)], "file string")
    assert catalog.pending_only(df, done, ["file"]).count() == 4
    # a file of the same name in another folder is another file
    (tmp_path / "more").mkdir()
    (tmp_path / "more" / "t1.csv").write_text("tile_id,number,x\n9,1,0.5\n")
    df = catalog.scan_manifest(spark, [names[1], str(tmp_path / "more" / "t1.csv")], schema)
    assert [r["tile_id"] for r in catalog.pending_only(df, done, ["file"]).collect()] == [9]
    with pytest.raises(ValueError):
        catalog.scan_catalog(spark, names[0])


def test_rfe_finds_the_informative_feature(spark):
    df = planted(spark, 400).withColumn("noise", uniform("id", 9)).withColumn("label", F.col("a"))
    out = selection.rfe_cv(df, "id", ["x", "z", "noise"], "label", folds=2, trees=8).collect()
    assert [r["n_features"] for r in out] == [3, 2, 1]
    assert out[0]["dropped"] == ["noise"] and sum(r["best"] for r in out) == 1


def test_positions_repeat_and_keep_their_order(spark):
    df = spark.range(4).withColumnRenamed("id", "k").repartition(3)
    rows = sampling.select_positions(df, ["k"], [2, 0, 2]).orderBy("request").collect()
    assert [r["k"] for r in rows] == [2, 0, 2]
    assert [r["k"] for r in sampling.evenly_spaced(df, ["k"], 10).orderBy("request").collect()] == [0, 0, 0, 1, 1, 1, 2, 2, 2, 3]
    tied = spark.createDataFrame([(1, i) for i in range(6)], "k long, v long")
    assert sampling.systematic_sample(tied, ["k"], 3).count() == 2
    assert sampling.select_positions(tied, ["k"], [1]).count() == 1


def test_smote_tells_tiles_apart(spark):
    # the same numbers in two distant tiles: made points stay inside the cloud of their tile
    rows = [(t, n, "rare", 100.0 * t + 0.01 * n) for t in (0, 1) for n in range(8)]
    rows += [(5, n, "many", 50.0 + 0.01 * n) for n in range(40)]
    df = spark.createDataFrame(rows, "tile long, num long, c string, x double")
    out = balance.smote(df, ["tile", "num"], "c", ["x"], k=3).collect()
    made = [r for r in out if r["synthetic"]]
    assert len(made) == 24 and len({(r["tile"], r["num"], r["synthetic"]) for r in made}) == 24
    assert all(0 <= r["x"] - 100 * r["tile"] <= 0.08 for r in made)
    assert len([r for r in out if r["c"] == "rare"]) == 40


def test_neighbours_of_a_null_group(spark):
    df = spark.createDataFrame([(1, None, 0.0), (2, None, 1.0), (3, "", 0.1), (4, "", 5.0)], "k long, g string, x double")
    out = neighbors.knn(df, df, "k", "k", ["x"], 1, by="g", skip_self=True).collect()
    assert {(r["query"], r["g"], r["neighbour"]) for r in out} == {(1, None, 2), (2, None, 1), (3, "", 4), (4, "", 3)}


def test_summary_rejects_unequal_draw_counts(spark):
    df = spark.createDataFrame([(1, [1.0] * 4, [5.0, 5.0]), (2, [1.0] * 4, [6.0] * 6)], "k long, a_draws array<double>, b_draws array<double>")
    with pytest.raises(Exception, match="draws"):
        posterior.posterior_summary(df, ["k"], ["a", "b"]).collect()


def test_staged_tables_can_be_released(spark):
    import os

    from posteria import session

    with session.scratch(spark):
        held = session.stage(spark.range(3), "gone")
        assert held.count() == 3
        name = "/" + held.inputFiles()[0].removeprefix("file:").lstrip("/")
        assert os.path.exists(name)
    assert not os.path.exists(name)


def test_plan_with_several_tiles(spark):
    rows = planted(spark, 300).withColumn("tile", F.col("id") % 3).withColumn("num", F.floor(F.col("id") / 3))
    left = sampling.stratified_split(rows, ["tile", "num"], "a")
    assert left.count() == 300
    folds = selection.rfe_cv(rows.withColumn("label", F.col("a")), ["tile", "num"], ["x", "z"], "label", folds=2, trees=4)
    assert folds.count() == 2


def test_queries_go_to_a_bounded_number_of_cells(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(30, 64)) * 2
    x = centres[rng.integers(0, 30, 3000)] + rng.normal(size=(3000, 64)) * 0.6
    feats = [f"f{i}" for i in range(64)]
    t = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], ["k", *feats])
    q = t.filter("k % 10 = 0")
    d = np.sqrt(((x[::10][:, None] - x[None]) ** 2).sum(2))
    d[np.arange(300), np.arange(300) * 10] = np.inf
    want = {(i * 10, int(j)) for i in range(300) for j in np.argsort(d[i], kind="stable")[:5]}

    train = t.select(F.lit("").alias("_group"), F.col("k").alias("_key"), F.array(*feats).alias("_x"), F.lit(True).alias("_one"))
    rows, levels = neighbors._split(train, 128, 8, 2.0, False)
    sizes = [r["count"] for r in rows.groupBy("_cell").count().collect()]
    assert sum(sizes) == 3000 and max(sizes) <= 128 and len(levels) > 1
    routed = neighbors._down(q.select(F.lit("").alias("_group"), F.col("k").alias("_qkey"), F.array(*feats).alias("_x")), levels, 4096, 2.0, 10)
    copies = [r["count"] for r in routed.groupBy("_qkey").count().collect()]
    assert len(copies) == 300 and max(copies) <= 10

    near = neighbors.knn(t, q, "k", "k", feats, 5, skip_self=True, fan=8, block=128, probes=10, exact=False, certify=True).collect()
    found = {(r["query"], r["neighbour"]) for r in near}
    assert len(near) == 1500 and len(found & want) >= 0.9 * len(want)
    proven = {r["query"] for r in near if r["certain"]}
    assert {p for p in found if p[0] in proven} == {p for p in want if p[0] in proven}
    exact = neighbors.knn(t, q, "k", "k", feats, 5, skip_self=True, fan=8, block=128, probes=10).collect()
    assert {(r["query"], r["neighbour"]) for r in exact} == want


def test_nearest_rows_with_many_ties():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 3, size=(300, 2)).astype(float)
    x[100:] += 1e6  # far from the origin: products round
    y = x[rng.integers(0, 300, 80)]
    keys = rng.permutation(300)
    q, t, d = neighbors.nearest_rows(x, keys, y, np.zeros(80, np.int64), np.zeros(80, bool), 7, 2.0)
    full = np.sqrt(((y[:, None] - x[None]) ** 2).sum(2))
    for i in range(80):
        want = np.lexsort((keys, full[i]))[:7]
        assert list(t[q == i]) == list(want) and np.allclose(d[q == i], full[i][want], atol=0)


def plain_clip(v, sigma, max_rounds, spread):
    low, high, left, rounds = -np.inf, np.inf, None, 0
    while True:
        kept = v[(v >= low) & (v <= high)]
        m = np.median(kept)
        s = kept.std() if spread == "std" else np.median(np.abs(kept - m)) * 1.482602218505602
        settled = len(kept) == left or rounds == max_rounds
        low, high = max(low, m - sigma * s), min(high, m + sigma * s)
        if settled:
            return len(kept), kept.mean(), m, kept.std(), low, high
        left, rounds = len(kept), rounds + 1


@pytest.mark.parametrize("least", [3, 64, 4096])
def test_order_statistics_of_any_group(spark, monkeypatch, least):
    rng = np.random.default_rng(least)
    parts = {"wide": rng.standard_cauchy(3000), "ties": np.round(rng.normal(size=2500), 1), None: rng.normal(1e5, 1e-2, 500), "one": np.array([2.5]),
             "two": np.array([1.0, 4.0]), "same": np.full(900, 7.0), "out": np.r_[rng.normal(size=800), [50.0] * 40, -1e6]}
    rows = [(g, float(x)) for g, v in parts.items() for x in v] + [("wide", None), ("one", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    monkeypatch.setattr(ordered, "LEAST_BLOCK", least)
    for spread, rounds, sigma in (("std", None, 3.0), ("mad", None, 4.0), ("mad", 1, 2.0)):
        found = {r["g"]: r for r in evaluation.sigma_clip_limits(df, "v", ["g"], sigma, rounds, spread).collect()}
        assert set(found) == set(parts)
        for g, v in parts.items():
            want = plain_clip(v, sigma, rounds, spread)
            r = found[g]
            assert (r["n"], r["median"]) == (want[0], want[2])
            assert [r["mean"], r["std"], r["lo"], r["hi"]] == pytest.approx([want[1], want[3], want[4], want[5]], rel=1e-9, abs=1e-9)
    for r in evaluation.mad_std(df, "v", ["g"]).collect():
        v = parts[r["g"]]
        assert r["median"] == np.median(v) and r["mad_std"] == pytest.approx(np.median(np.abs(v - np.median(v))) * 1.482602218505602, rel=1e-12)


def test_rounds_of_a_clip_cost_no_jobs(spark, monkeypatch):
    """Each round sheds a little of a long tail; staged tables do not grow with the rounds."""
    v = np.exp(np.random.default_rng(1).normal(size=6000) * 2)
    df = spark.createDataFrame([(float(x),) for x in v], "v double")
    monkeypatch.setattr(ordered, "LEAST_BLOCK", 50)
    real, written = ordered.stage, []
    monkeypatch.setattr(ordered, "stage", lambda d, label="stage": written.append(label) or real(d, label))
    counts = []
    for rounds in (1, 40):
        written.clear()
        n = evaluation.sigma_clip_limits(df, "v", [], 2.5, rounds).first()["n"]
        assert n == plain_clip(v, 2.5, rounds, "std")[0]
        counts.append(len(written))
    assert counts[1] <= counts[0] + 6


def scored_parts(spark, n=60):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i, *map(float, rng.normal(size=4))) for i in range(n)], ["id", "a", "b", "c", "d"])
    df = df.withColumns({f"{c}__err": F.lit(0.1) for c in "abcd"})
    cfg = network.NetConfig(hidden=(20, 10), dropout=(0.2, 0.1))
    model = training.FittedNet(network.init_params(4, 3, cfg), cfg, list("abcd"), ["p", "q", "r"], [])
    point = network.NetConfig(kind="deterministic", hidden=(6,))
    spread = training.FittedNet(network.init_params(2, 2, point), point, ["a", "c"], ["s1", "s2"], [])
    return df, model, spread


def test_one_pass_equals_the_operators_one_after_another(spark):
    df, model, spread = scored_parts(spark)
    t = model.targets
    drawn = mixture.rotate_draws(scoring.draws(df, model, ["id"], 50, ["a", "c"], input_noise=True), t)
    slow = mixture.fit_gmm(posterior.posterior_summary(drawn, ["id", "a", "c", "r1_draws", "r2_draws"], t),
                           ["id", "a", "c", *posterior.summary_columns(t)])
    slow = scoring.predict_points(slow, spread, ["id"], slow.columns, prefix="").orderBy("id").toPandas()
    fused = scoring.summarised_draws(df.repartition(7), model, ["id"], 50, ["a", "c"], True, mixtures=True, spread=spread)
    fast = fused.orderBy("id").toPandas()
    assert set(slow.columns) == set(fast.columns)
    for c in slow.columns:
        assert np.allclose(slow[c], fast[c], rtol=1e-8, atol=1e-10, equal_nan=True), c
    plan = fused._jdf.queryExecution().executedPlan().toString()
    whole = scoring.summarised_draws(df, model, ["id"], 50, mixtures=True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and whole.count("MapInArrow") == 1 and "Exchange" not in whole


def test_random_numbers_belong_to_their_address():
    seeds = np.array([5, -7, 2**62, 5], np.int64)
    whole = addressed.bits(seeds, 40, 3, 9)
    assert (addressed.bits(seeds[1:3], 40, 3, 9) == whole[1:3]).all() and (addressed.bits(seeds, 12, 3, 4) == whole[:, :12, :4]).all()
    assert (whole[0] == whole[3]).all() and len(np.unique(whole[:3])) == whole[:3].size
    assert not (addressed.bits(seeds, 40, 2, 9) == whole).any()
    seeds = np.arange(200)
    z = addressed.normals(seeds, 100, 1, 5)
    assert abs(z.mean()) < 0.02 and abs(z.std() - 1) < 0.02 and abs(np.corrcoef(z[:-1].ravel(), z[1:].ravel())[0, 1]) < 0.02
    m = addressed.masks(seeds, 100, 1, 7, 0.2)
    assert abs((m == 0).mean() - 0.2) < 0.01 and abs(m.mean() - 1) < 0.01
    params = network.init_params(3, 2, network.NetConfig(hidden=(8,), dropout=(0.3,)))
    x, cfg = np.random.default_rng(0).normal(size=(200, 3)), network.NetConfig(hidden=(8,), dropout=(0.3,))
    block = network.block_draws(params, x, cfg, 20, seeds)
    ones = np.concatenate([network.block_draws(params, x[i : i + 1], cfg, 20, seeds[i : i + 1]) for i in range(200)])
    assert np.allclose(block, ones, rtol=1e-12, atol=1e-12)


def test_long_draws_converge_to_the_fit_of_arrays(spark):
    rng = np.random.default_rng(6)
    rows = []
    for i in range(12):
        c = rng.normal(size=(3, 2)) * 0.5
        v = np.concatenate([c[j] + rng.normal(size=(20 + 10 * j, 2)) * 0.05 for j in range(3)])
        rows.append((i, v[:, 0].tolist(), v[:, 1].tolist()))
    df = spark.createDataFrame(rows, "k long, r1_draws array<double>, r2_draws array<double>")
    long = df.select("k", F.explode(F.arrays_zip("r1_draws", "r2_draws")).alias("z")).select("k", F.col("z.r1_draws").alias("r1"), F.col("z.r2_draws").alias("r2"))
    a = mixture.fit_gmm(df, ["k"]).orderBy("k").toPandas()
    b = mixture.fit_gmm_long(long.repartition(7), ["k"]).orderBy("k").toPandas()
    assert np.allclose(a, b, rtol=1e-6, atol=1e-9)
    # the seeded start is the same in any partitioning and finds planted centres
    one, many = (mixture.fit_gmm(x, ["k"], seed_by=["k"]).orderBy("k").toPandas() for x in (df.repartition(1), df.repartition(6)))
    assert np.allclose(one, many)


def test_seeded_start_finds_far_groups():
    rng = np.random.default_rng(3)
    centres = np.array([[0, 0], [5, 0], [0, 5]])
    v = np.stack([np.concatenate([c + rng.normal(size=(30, 2)) * 0.1 for c in centres]) for _ in range(50)])
    start = mixture._seeded_start(v[:, :, 0], v[:, :, 1], np.arange(50))
    pure = [len({tuple(np.unique(s[i : i + 30])) for i in (0, 30, 60)}) == 3 and all(len(np.unique(s[i : i + 30])) == 1 for i in (0, 30, 60)) for s in start]
    assert np.mean(pure) > 0.95
    same = mixture._seeded_start(np.ones((2, 9)), np.ones((2, 9)), np.arange(2))
    assert (same == same[:, :1]).all()


def test_sampled_arrays_belong_to_their_key(spark):
    from registry import views

    df = mixture.repair_psd(views.v_gmm(spark, "/root/testdata/sf0.001")).limit(200)
    one = mixture.sample_gmm_arrays(df.repartition(1), ["tile_id", "number"], 101).orderBy("number").collect()
    many = mixture.sample_gmm_arrays(df.repartition(9), ["tile_id", "number"], 101, block=7).orderBy("number").collect()
    assert one == many
    for r in one:
        assert 98 <= len(r["P_QSO"]) <= 101
        assert np.allclose(np.add(np.add(r["P_Galaxy"], r["P_QSO"]), r["P_Star"]), 1)


@pytest.mark.parametrize("fraction", [0.1, 0.34, 0.9])
def test_splits_are_exact_where_keys_repeat(spark, fraction):
    rows = [(i % 5, i) for i in range(40)] + [(7, 99)] * 30 + [(8, None)]
    df = spark.createDataFrame(rows, "k long, v long").repartition(3)
    out = sampling.train_valid_split(df, ["k"], fraction).collect()
    assert sorted((r["k"], r["v"] or -1) for r in out) == sorted((k, v or -1) for k, v in rows)
    assert sum(r["split"] == "valid" for r in out) == int(np.ceil(len(rows) * fraction))
    classed = spark.createDataFrame([("a", 1, i) for i in range(17)] + [("b", 2, 0)] * 9 + [(None, 3, i % 2) for i in range(4)], "c string, k long, v long")
    kept = sampling.undersample(classed, ["k"], "c").collect()
    assert sorted(str(r["c"]) for r in kept) == ["None"] * 4 + ["a"] * 4 + ["b"] * 4
    held = sampling.stratified_split(classed, ["k"], "c", 0.5).filter("split = 'valid'").collect()
    assert sorted(str(r["c"]) for r in held) == ["None"] * 2 + ["a"] * 9 + ["b"] * 5


def test_places_are_found_by_the_order_alone(spark, monkeypatch):
    from posteria.operators import ranks

    rows = [(i // 4, f"text {i}" * 20, i % 3) for i in range(400)] + [(7, "twin", 0)] * 5
    df = spark.createDataFrame(rows, "o long, wide string, x int").repartition(6)
    real, written = ranks.stage, []
    monkeypatch.setattr(ranks, "stage", lambda d, label="stage": written.append(d.columns) or real(d, label))
    found = sampling.systematic_sample(df, ["o"], 9, 2).collect()
    ordered = sorted(r[0] for r in rows)
    assert sorted(r["o"] for r in found) == [o for i, o in enumerate(ordered) if (i + 2) % 9 == 0]
    assert all("wide" not in columns for columns in written)
    some = sampling.select_positions(df, ["o"], [0, 404, 30, 30]).orderBy("request").collect()
    assert [r["o"] for r in some] == [ordered[i] for i in (0, 404, 30, 30)] and some[2][:3] == some[3][:3]
    twins = sampling.systematic_sample(df, ["o"], 1).collect()
    assert sorted((r["o"], r["wide"]) for r in twins) == sorted((a, b) for a, b, _ in rows)


def small_state():
    model = training.FittedNet(network.init_params(2, 2, PLANTED), PLANTED, ["x", "z"], ["a", "b"], [])
    return sinks.CatalogState(model, {}, None, ["a", "b"], [])


def test_a_batch_cut_short_is_neither_doubled_nor_missing(spark, tmp_path, monkeypatch):
    from posteria.sources import runlog
    from posteria.streaming import scoring as stream

    source, out, log = (str(tmp_path / n) for n in ("in", "out", "log"))
    df = planted(spark, 90).repartition(3)
    df.write.parquet(source)
    rows = lambda d: predict.score(d, small_state(), ["id"], n_iter=3)
    run = lambda: stream.stream_score_logged(spark, source, out, df.schema, rows, log, files_per_batch=1)
    real, calls = runlog.commit_batch, []

    def cut(batch, number, *how):
        calls.append(number)
        if len(calls) == 2:  # the rows are there, the log is not
            how[1](batch).write.mode("overwrite").parquet(f"{how[0]}/predictions/batch={number}")
            raise RuntimeError("lost")
        real(batch, number, *how)

    monkeypatch.setattr(stream, "commit_batch", cut)
    with pytest.raises(Exception, match="lost"):
        run()
    assert runlog.read_committed(spark, out).count() < 90
    found = run()
    assert sorted(r["id"] for r in found.select("id").collect()) == list(range(90))
    history = runlog.read_log(spark, out).withColumn("run", F.lit("one"))
    assert history.count() == 3 and history.agg(F.sum("n_sources")).first()[0] == 90
    through = stream.scoring_throughput(history, ("batch", "place")).orderBy("batch", "place").collect()
    assert [r["batch"] for r in through] == [0, 1, 2] and all(r["secs_per_source"] > 0 for r in through)


def test_bulk_prediction_goes_on_where_it_stopped(spark, tmp_path):
    from posteria.plans import bulk
    from posteria.sources import runlog

    df = planted(spark, 60)
    for i in range(3):
        df.filter(F.col("id") % 3 == i).coalesce(1).write.csv(str(tmp_path / f"c{i}"), header=True)
    files = sorted(str(p) for i in range(3) for p in (tmp_path / f"c{i}").glob("part-*.csv"))
    listed = tmp_path / "manifest.txt"
    listed.write_text("\n".join([*files[:2], str(tmp_path / "none.csv")]) + "\n")
    call = lambda **how: bulk.predict_files(spark, str(listed), df.schema, small_state(), ["id"], str(tmp_path / "out"), n_iter=3, files_per_batch=1, **how)
    first = call()
    assert first.count() == 40 and "x" not in first.columns
    listed.write_text("\n".join(files) + "\n")
    (tmp_path / "out" / "predictions" / "batch=2").mkdir(parents=True)  # a lost attempt
    again = call().collect()
    assert sorted(r["id"] for r in again) == list(range(60))
    assert call().count() == 60 and runlog.read_log(spark, str(tmp_path / "out")).count() == 3
    full = bulk.predict_files(spark, files, df.schema, small_state(), ["id"], str(tmp_path / "full"), mode="full", n_iter=3)
    assert {"x", "z", "a_mean"} <= set(full.columns) and full.count() == 60


def test_slices_of_many_replicas_meet_in_small_groups(spark, monkeypatch):
    rng = np.random.default_rng(2)
    numbers, weights = rng.normal(size=(300, 4)), rng.integers(1, 50, 300)
    rows = [(s, p, numbers[p].tolist(), float(weights[p]), 1, 1.0, int(weights[p]), 0.0, 0) for s in (0, 1) for p in range(300)]
    df = spark.createDataFrame(rows, training._OUT).repartition(40)
    real, met = training._merged, []
    monkeypatch.setattr(training, "_merged", lambda d, *by: met.append(max(r["count"] for r in d.groupBy(*by).count().collect())) or real(d, *by))
    out = training.average(df, 300, most=7).orderBy("slice").collect()
    assert len(met) == 3 and max(met) <= 7
    for r in out:
        assert np.allclose(r["mean"].toArray(), np.average(numbers, axis=0, weights=weights)) and r["n"] == weights.sum() and r["loss"] == 300


def test_spread_model_is_trained_saved_and_used(spark, tmp_path):
    df = spark.range(90).select(
        F.lit(1).alias("tile_id"), F.col("id").alias("number"), F.when(F.col("id") % 2 == 0, "A").otherwise("B").alias("CLASS"),
        *[(uniform("id", i) + (F.col("id") % 2 == i).cast("double")).alias(f"f{i}") for i in range(2)])
    tiny = NetConfig(hidden=(6,), dropout=(0.1,), epochs=2, batch_size=32, learning_rate=1e-2, replicas=2)
    plan = train.TrainPlan(("tile_id", "number"), "CLASS", ("f0", "f1"), balancing=None, net=tiny, spread_folds=2, spread_draws=4,
                           spread_net=NetConfig(kind="deterministic", hidden=(4,), dropout=(), input_dropout=0.0, epochs=2, replicas=2))
    state, _ = train.train(df, plan)
    sinks.save_state(spark, state, str(tmp_path / "s"))
    back = sinks.load_state(spark, str(tmp_path / "s"))
    assert back.spread.targets == ["sigma_CLASS_A", "sigma_CLASS_B"] and back.spread.features == state.spread.features
    a, b = (predict.score(df, x, ["tile_id", "number"], n_iter=3).orderBy("number").toPandas() for x in (state, back))
    pd.testing.assert_frame_equal(a, b)
    assert {"sigma_CLASS_A", "sigma_CLASS_B"} <= set(a.columns) and (a.sigma_CLASS_A >= 1e-4).all()


def test_evaluation_plan_equals_its_operators(spark, tmp_path):
    from posteria.plans import evaluate
    from registry import views

    df = views.v_pred(spark, "/root/testdata/sf0.001")
    scores = {"p1": "pred_p1", "p2": "pred_p2", "p3": "pred_p3"}
    tables = evaluate.evaluate_classes(df, "true_class", scores, "mag_g", limit=24.0)
    evaluate.write_evaluation(tables, str(tmp_path))
    assert set(tables) == {"class_counts", "roc", "auc", "auc_by_mag", "score_histogram", "failure_rates", "confusion", "confusion_by_mag"}
    back = evaluate.read_evaluation(spark, str(tmp_path), "auc").collect()
    pairs = evaluation.one_vs_one(df.filter("mag_g < 24"), "true_class", scores)
    want = {(r["one_class"], r["other_class"]): r["auc"] for r in evaluation.auc(pairs, "label", "score", ["one_class", "other_class"]).collect()}
    assert {(r["one_class"], r["other_class"]): r["auc"] for r in back} == pytest.approx(want) and len(want) == 6
    assert sum(r["n"] for r in tables["confusion"].collect()) == df.count()
    found = evaluate.evaluate_target(df, "z_obs", "z_pred", "z_err", "z_sigma", ["mag_g", "mag_r"])
    assert found["mad"].first()["mad_std"] > 0 and {r["side"] for r in found["above_below"].collect()} == {"above", "below"}
    assert found["binned_residuals"].count() > 8 and found["pulls"].count() > 10


@pytest.mark.parametrize("p", [1, 2, 3])
def test_quick_distances_rule_out_no_neighbour(p):
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(size=(2500, 7)), np.round(rng.normal(size=(300, 7))), np.full((40, 7), 1e6), np.full((3, 7), 0.5)])
    y = np.vstack([x[:50], rng.normal(size=(90, 7)), x[-4:], np.full((2, 7), -1e6)])
    keys = rng.permutation(len(x))
    own, has = np.r_[keys[:50], np.zeros(len(y) - 50, int)], np.arange(len(y)) < 50
    gap = np.abs(y[:, None] - x[None])
    d = gap.sum(2) if p == 1 else np.sqrt(np.einsum("qtd,qtd->qt", gap, gap)) if p == 2 else (gap**p).sum(2) ** (1 / p)
    d[(own[:, None] == keys[None]) & has[:, None]] = np.inf
    want = np.lexsort((np.broadcast_to(keys, d.shape), d), axis=1)[:, :6]
    far = np.take_along_axis(d, want, 1)
    for bound in (None, far[:, -1].copy()):  # a bound that the last neighbour just meets
        rows, found, dist = neighbors.nearest_rows(x, keys, y, own, has, 6, p, bound)
        assert (rows.reshape(-1, 6) == np.arange(len(y))[:, None]).all()
        assert (found.reshape(-1, 6) == want).all() and np.array_equal(dist.reshape(-1, 6), far)


@pytest.mark.parametrize("far,kind", [(1, np.float32), (1e-30, np.float32), (1e6, np.float64)])
def test_single_precision_rules_out_no_neighbour(far, kind):
    """Few pairs are measured one by one, whatever the size of the rows, and rows far apart fall back on double precision."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(6000, 16)) * min(far, 1)
    if far > 1:
        x[::2, 0] += far  # two heaps, rows of one much nearer than their size
    x[5] = 1e4 * far  # one row far out spoils nothing
    x[1000:1400] = x[2000:2400] * (1 + 1e-9)
    y, keys = x[:300], np.arange(6000)
    tiles = neighbors._Tiles(x, y, 2)
    assert tiles.table.dtype == kind
    measured, pairs = [], neighbors._pairs
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(neighbors, "_pairs", lambda y, x, near, far, p: (measured.append(len(near)), pairs(y, x, near, far, p))[1])
        rows, found, dist = neighbors.nearest_rows(x, keys, y, keys[:300], np.ones(300, bool), 4, 2)
    gap = np.abs(y[:, None] - x[None])
    d = np.sqrt(np.einsum("qtd,qtd->qt", gap, gap))
    d[keys[:300], keys[:300]] = np.inf
    want = np.lexsort((np.broadcast_to(keys, d.shape), d), axis=1)[:, :4]
    assert (found.reshape(-1, 4) == want).all() and np.array_equal(dist.reshape(-1, 4), np.take_along_axis(d, want, 1))
    assert sum(measured) < 0.02 * d.size


def test_queries_that_no_bound_settles_do_not_go_to_every_cell(spark, monkeypatch):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(1500, 40))
    feats = [f"f{i}" for i in range(40)]
    t = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], ["k", *feats])
    moved, meet = [], neighbors._meet
    monkeypatch.setattr(neighbors, "_meet", lambda a, b, *rest: (moved.append(a.count() + b.count()), meet(a, b, *rest))[1])
    got = neighbors.knn(t, t, "k", "k", feats, 3, skip_self=True, fan=32, block=32, probes=2).collect()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    assert {(r["query"], r["rank"]): r["neighbour"] for r in got} == {
        (i, r + 1): int(j) for i in range(len(x)) for r, j in enumerate(np.argsort(d[i], kind="stable")[:3])}
    assert max(moved) < 8 * len(x)


def test_moments_are_taken_where_the_points_are_drawn(spark):
    from posteria.functions import addressed
    from registry import views

    df = mixture.repair_psd(views.v_gmm(spark, "/root/testdata/sf0.001")).limit(90)
    keys, names = ["tile_id", "number"], ["P_Galaxy", "P_QSO", "P_Star"]
    arrays = mixture.sample_gmm_arrays(df, keys, 301)
    fused = mixture.array_moments(arrays, keys, names)
    assert fused._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    apart = mixture.array_moments(arrays.select("*"), keys, names)
    assert sorted(fused.collect()) == sorted(apart.collect())
    seeds, counts, layers = np.array([7, -3, 7]), np.array([5, 0, 9]), np.array([241, 242, 243])
    ragged = addressed.ragged_normals(seeds, counts, layers, 2)
    want = np.concatenate([addressed.normals(seeds[i : i + 1], int(c), int(layers[i]), 2)[0] for i, c in enumerate(counts)])
    assert np.array_equal(np.stack(ragged, axis=1), want)


def test_long_draws_move_as_one_row_an_object(spark):
    rng = np.random.default_rng(4)
    frame = pd.DataFrame({"k": np.repeat(["a", None, "b", "c"], 30), "n": np.repeat([1, 1, 2, 2], 30), "r1": rng.normal(size=120), "r2": rng.normal(size=120)})
    long = spark.createDataFrame(frame.astype(object).where(frame.notna(), None), "k string, n long, r1 double, r2 double").coalesce(1)
    fit = lambda df: mixture.fit_gmm_long(df, ["k", "n"], 3, 0.0).orderBy("k", "n")
    one, many = fit(long), fit(long.orderBy("r2").repartition(6))
    a, b = one.toPandas(), many.toPandas()
    assert len(a) == 4 and a.k.isna().sum() == 1
    pd.testing.assert_frame_equal(a, b)
    both = F.sort_array(F.collect_list(F.struct("r1", "r2")))
    packed = long.groupBy("k", "n").agg(both.alias("d")).select("k", "n", F.col("d.r1").alias("r1_draws"), F.col("d.r2").alias("r2_draws"))
    pd.testing.assert_frame_equal(a, mixture.fit_gmm(packed, ["k", "n"], 3, 0.0).orderBy("k", "n").toPandas())
    assert "Aggregate" not in one._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("kind", ["dropout", "gaussian", "deterministic"])
def test_draws_of_many_objects_take_little_room(kind):
    """Beside the draws, what a block needs depends on the few objects that go through the layers together."""
    import tracemalloc

    from posteria.models import network

    cfg = network.NetConfig(kind=kind, hidden=(24, 12), dropout=(0.1, 0.1), input_dropout=0.05)
    rng = np.random.default_rng(5)
    params, x, seeds = network.init_params(7, 3, cfg), rng.normal(size=(8000, 7)), rng.integers(-(2**62), 2**62, 8000)
    tracemalloc.start()
    found = network.block_draws(params, x, cfg, 20, seeds, np.abs(x) / 10)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < found.nbytes + 30e6
    alone = np.concatenate([network.block_draws(params, x[i : i + 1], cfg, 20, seeds[i : i + 1], np.abs(x[i : i + 1]) / 10) for i in (0, 624, 625, 7999)])
    np.testing.assert_allclose(found[[0, 624, 625, 7999]], alone, rtol=1e-12, atol=1e-12)


@pytest.mark.parametrize("single", [True, False])
def test_all_rows_are_compared_without_copies_in_a_shuffle(spark, monkeypatch, single):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(90, 6)).astype(np.float32).astype(float) + (0.0 if single else 1e-12)
    groups = ["a"] * 60 + ["b"] * 26 + ["c"] * 4
    rows = spark.createDataFrame([(g, i, row.tolist(), [float(-i)]) for i, (g, row) in enumerate(zip(groups, x))], "_group string, _key long, _x array<double>, _y array<double>")
    rows = neighbors._widened(neighbors._narrowed(rows)) if not single else neighbors._narrowed(rows).drop("_wide")
    asks = rows.select("_group", F.col("_key").alias("_qkey"), F.col("_key").alias("_skip"), "_x")
    monkeypatch.setattr(neighbors, "BLOCK", 8)
    found = neighbors._best(neighbors._scan(rows, asks, 3, 2.0, True, block=80), 3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan
    got = {(r["_qkey"], r["rank"]): (r["_key"], r["_y"]) for r in found.collect()}
    want = {}
    for i in range(90):
        near = sorted((float(np.sqrt(((x[i] - x[j]) ** 2).sum())), j) for j in range(90) if j != i and groups[j] == groups[i])[:3]
        want |= {(i, r): (j, [float(-j)]) for r, (_, j) in enumerate(near, 1)}
    assert got == want


def test_vectors_are_narrowed_only_where_nothing_is_lost(spark):
    rows = spark.createDataFrame([(0, [0.5, -2.0]), (1, [0.1, 1.0]), (2, [1e300, 0.0]), (3, [None, 0.5]), (4, None)], "k long, _x array<double>")
    held = {r["k"]: (r["_x"], r["_wide"]) for r in neighbors._narrowed(rows).collect()}
    assert held == {0: ([0.5, -2.0], None), 1: (None, [0.1, 1.0]), 2: (None, [1e300, 0.0]), 3: ([None, 0.5], None), 4: (None, None)}
    assert {r["k"]: r["_x"] for r in neighbors._widened(neighbors._narrowed(rows)).collect()} == {r["k"]: r["_x"] for r in rows.collect()}


def test_smote_carries_places_not_rows(spark, monkeypatch):
    from posteria.operators import balance

    seen = []
    monkeypatch.setattr(balance, "knn", lambda *a, **how: seen.append(how["payload"]) or neighbors.knn(*a, **how))
    df = spark.createDataFrame([(i, "a" if i < 12 else "b", float(i % 5), float(i), None if i == 13 else 2.0 * i) for i in range(18)], "k long, g string, x double, z double, w double")
    made = balance.smote(df, "k", "g", ["x", "z"], ["w"], k=2).filter("synthetic > 0").collect()
    assert len(made) == 6 and seen == [["_place"]]
    for r in made:
        assert 12 <= r["z"] <= 17 and (r["w"] is None or abs(r["w"] - 2 * r["z"]) < 1e-9)


def test_many_folders_are_those_that_partition_by_writes(spark, tmp_path):
    from posteria.sources import folders

    rows = [(v, i, float(i)) for i, v in enumerate(["a", "b/c", None, "", "é %=", "a", "x y"] * 40)]
    df = spark.createDataFrame(rows, "t string, n long, v double")
    df.write.partitionBy("t").parquet(str(tmp_path / "want"))
    folders.write_folders(df.limit(3), str(tmp_path / "got"), "t")
    folders.write_folders(df.hint("rebalance", "t"), str(tmp_path / "got"), "t")  # replaces what is there
    named = lambda p: sorted(f.name for f in p.iterdir() if f.is_dir())
    assert named(tmp_path / "got") == named(tmp_path / "want")
    got, want = (spark.read.parquet(str(tmp_path / p)).select("t", "n", "v").collect() for p in ("got", "want"))
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(got) == 280
    left = [f.name for f in (tmp_path / "got").rglob("*") if f.is_file()]
    assert "_SUCCESS" in left and not [f for f in left if f.startswith(".")]  # no file of an attempt, none for which Hadoop starts a process


def test_folders_hold_no_rows_for_an_empty_table(spark, tmp_path):
    from posteria.sources import folders

    df = spark.createDataFrame([], "t long, n long")
    folders.write_folders(df, str(tmp_path / "none"), "t")
    assert spark.read.schema(df.schema).parquet(str(tmp_path / "none")).count() == 0

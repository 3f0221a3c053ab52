"""Hand-worked edge cases."""

import math

import pytest
from pyspark.sql import functions as F

from posteria.functions import scalar, simplex
from posteria.operators import cleaning, density, evaluation, features, labels, mixture, ranks, sampling, scaling, sets


def rows(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def test_sentinel_rules_differ_at_the_sentinel(spark):
    df = spark.createDataFrame([(1, -999.0), (2, -999.5), (3, 0.0), (4, float("nan")), (5, None)], "id int, x double")
    loose = dict(rows(cleaning.sentinel_to_null(df, ["x"]), "id", "x"))
    strict = dict(rows(cleaning.sentinel_to_null(df, ["x"], "<"), "id", "x"))
    assert loose == {1: None, 2: None, 3: 0.0, 4: None, 5: None}
    assert strict == {1: -999.0, 2: None, 3: 0.0, 4: None, 5: None}
    with pytest.raises(ValueError):
        cleaning.sentinel_to_null(df, ["x"], ">")


def test_impute_and_clip_keep_null_apart(spark):
    df = spark.createDataFrame([(-1.0, -2.0), (None, None), (0.5, 0.1), (7.0, 3.0)], "x double, e double")
    clipped = cleaning.clip_unit(df, ["x", "e"])
    assert rows(clipped, "x") == [(0.0,), (None,), (0.5,), (1.0,)]
    assert rows(cleaning.impute(clipped, ["x"], ["e"]), "x", "e") == [(0.0, 0.0), (-0.1, 0.0), (0.5, 0.1), (1.0, 1.0)]
    assert rows(cleaning.impute(df, ["x"], ["e"]), "e")[0] == (0.0,)


def test_proper_motion_of_a_star_at_rest(spark):
    df = spark.createDataFrame([(3.0, 4.0, 1.0, 1.0), (0.0, 0.0, 1.0, 1.0)], "a double, d double, ea double, ed double")
    out = rows(features.proper_motion(df, "a", "d", "ea", "ed"), "pm_g", "pm_g_error")
    assert out == [(5.0, 1.0), (0.0, None)]
    assert features.proper_motion(df, "a", "d", "ea", "ed").columns == ["pm_g_error", "pm_g"]


def test_galactic_reference_points(spark):
    df = spark.createDataFrame(
        [(scalar.POLE_RA, scalar.POLE_DEC), (0.0, 90.0), (266.40499, -28.93617)], "ra double, dec double")
    pole, ncp, centre = rows(features.galactic(df, "ra", "dec"), "l", "b")
    assert pole[1] == pytest.approx(90, abs=1e-5)
    assert ncp[0] == pytest.approx(122.9319, abs=1e-4) and ncp[1] == pytest.approx(27.1283, abs=1e-4)
    assert min(centre[0], 360 - centre[0]) < 1e-3 and abs(centre[1]) < 1e-3


def test_log_flux_at_and_below_zeropoint(spark):
    df = spark.createDataFrame([(1.0, 0.1), (11.0, 0.1), (0.5, 0.1), (0.0, 0.1), (None, 0.1)], "f double, e double")
    out = rows(features.log_flux(df, [("f", "e")], 1.0), "f", "e")
    assert [r[0] for r in out] == [None, 1.0, None, None, None]
    assert out[1][1] == pytest.approx(0.1 / (11 * math.log(10)))
    assert out[3][1] is None
    relative = rows(features.log_flux(df, [("f", "e")], 1.0, errors_are_relative=True), "e")
    assert relative[1][0] == pytest.approx(0.1 / math.log(10))


def test_error_column_priorities():
    cols = ["x", "x_err", "x_error", "a_mag_auto_r", "mag_err_auto_r", "a_mag_err_auto_r", "plx", "e_plx", "r_ZPT", "r_ERRZPT", "n", "n_RMS"]
    pick = lambda f, **k: features.error_column(cols, f, **k)
    assert pick("x") == "x_error"
    assert pick("a_mag_auto_r") == "mag_err_auto_r"
    assert pick("a_mag_auto_r", prefix_aware=True) == "a_mag_err_auto_r"
    assert pick("plx") == "e_plx" and pick("r_ZPT") == "r_ERRZPT" and pick("n") == "n_RMS"
    assert pick("zzz") is None


def test_attach_errors_needs_features(spark):
    with pytest.raises(ValueError):
        features.attach_errors(spark.range(1), [])


def test_feature_presets_have_the_known_sizes():
    assert len(features.base_features(True)) == 257
    assert len(set(features.base_features(True))) == 257
    assert len(features.base_features(False)) == 134


def test_photometry_presets():
    cols = ["flux_aper_1_r", "fnu_flux_aper_1_r", "flux_relerr_aper_1_r", "fnu_flux_relerr_aper_1_r", "mag_aper_3_0_r", "corr_mag_aper_3_0_r"]
    assert features.photometry_columns(cols) == (["flux_aper_1_r"], ["flux_relerr_aper_1_r"])
    assert features.photometry_columns(cols, "fnu_flux_aper") == (["fnu_flux_aper_1_r"], ["fnu_flux_relerr_aper_1_r"])
    assert features.photometry_columns(cols, "photo_3")[0] == ["mag_aper_3_0_r"]
    with pytest.raises(ValueError):
        features.photometry_columns(cols, "nope")


def test_strip_prefix(spark):
    df = spark.createDataFrame([(1, 2)], ["pred_nom_a_mean", "pred_var_a_std"])
    assert features.strip_prefix(df).columns == ["a_mean", "a_std"]


def test_constant_feature_is_not_scaled(spark):
    df = spark.range(100).select(F.lit(3.0).alias("c"), F.col("id").cast("double").alias("x"))
    state = scaling.fit_scaler(df, ["c", "x"], 0.0, 1.0)
    assert rows(scaling.apply_scaler(df, state).agg(F.max("c"), F.max("x")), "*") == [(3.0, 1.0)]


def test_labels(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("c",)], "k string")
    out = labels.encode_labels(df, "k")
    assert out.columns == ["k", "k_a", "k_b", "k_c", "k_num"]
    assert sorted(rows(out, "k_num", "k_b"), key=str) == sorted([(1, 1), (0, 0), (None, 0), (2, 0)], key=str)


def test_predicted_class_takes_the_first_of_a_tie(spark):
    df = spark.createDataFrame([(0.4, 0.4, 0.2), (0.1, 0.1, 0.8), (None, None, None)], "CLASS_a_pc50 double, CLASS_b_pc50 double, CLASS_c_pc50 double")
    assert rows(labels.predicted_class(df, df.columns), "CLASS") == [("a",), ("c",), (None,)]


def test_magnitude_bins_are_right_closed(spark):
    df = spark.createDataFrame([(17.0,), (17.1,), (18.0,), (25.0,), (25.01,), (None,)], "m double")
    assert rows(evaluation.mag_bin(df, "m"), "mag_bin") == [(None,), (17,), (17,), (24,), (None,), (None,)]


def test_failure_rates_keep_empty_bins(spark):
    df = spark.createDataFrame([("a", "a", 17.5), ("a", "b", 17.5), ("b", "b", 24.5)], "t string, p string, m double")
    out = {r["mag_bin"]: r for r in evaluation.failure_rates(df, "t", "p", "m").collect()}
    assert sorted(out) == list(range(17, 25))
    assert out[17]["failure_pct"] == 50.0 and out[20]["n"] == 0 and out[20]["failure_pct"] is None
    assert out[24]["cumulative_pct"] == pytest.approx(100 / 3)


def test_confusion_has_the_full_grid(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b")], "t string, p string")
    out = {(r["true"], r["pred"]): r["share"] for r in evaluation.confusion(df, "t", "p", ["a", "b", "c"]).collect()}
    assert len(out) == 9 and out[("a", "b")] == 0.5 and out[("c", "c")] == 0.0


def test_grid_edges(spark):
    df = spark.createDataFrame([(0.0, 0.0), (1.0, 1.0), (0.5, 1.0), (1.1, 0.5)], "x double, y double")
    grid = density.Grid(0.0, 1.0, 0.0, 1.0, 2, 2)
    assert sorted(rows(density.density_2d(df, "x", "y", grid), "ix", "iy", "n")) == [(0, 0, 1), (1, 1, 2)]
    # the closed last edge counts in the grid but its points are not listed
    assert rows(density.sparse_points(df, "x", "y", grid, 5), "x", "y") == [(0.0, 0.0)]


def test_smoothing_preserves_mass_inside(spark):
    cells = spark.createDataFrame([(50, 50, 10)], "ix int, iy int, n int")
    out = density.smooth_grid(cells, "n", density.Grid(0, 1, 0, 1, 100, 100))
    total, peak = out.agg(F.sum("smooth"), F.max("smooth")).first()
    assert total == pytest.approx(10) and peak == pytest.approx(10 / (2 * math.pi * 4), rel=0.01)


def test_rotation_is_orthogonal_and_round_trips(spark):
    m = simplex.ROTATION
    for i in range(3):
        for j in range(3):
            assert sum(m[i][k] * m[j][k] for k in range(3)) == pytest.approx(float(i == j), abs=1e-12)
    df = spark.createDataFrame([(0.2, 0.3, 0.5)], "a double, b double, c double")
    r = mixture.rotate_simplex(df, ["a", "b", "c"])
    back = r.select(*[c.alias(n) for n, c in zip("abc", simplex.from_plane(F.col("r1"), F.col("r2")))])
    assert rows(back, "a", "b", "c")[0] == pytest.approx((0.2, 0.3, 0.5))
    with pytest.raises(ValueError):
        mixture.rotate_simplex(df, ["a", "b"])


def test_repair_makes_covariances_positive(spark):
    parts = {"cov_11": 1.0, "cov_12": 2.0, "cov_22": 1.0, "mean_1": 0.0, "mean_2": 0.0, "weight": 1 / 3}
    df = spark.createDataFrame([(1, 1)], "tile_id long, number long").select(
        "*", *[F.lit(v).alias(f"comp{k}_{n}") for k in (1, 2, 3) for n, v in parts.items()])
    fixed = mixture.repair_psd(df).first()
    # lowest eigenvalue -1, so ten is added
    assert fixed["comp1_cov_11"] == pytest.approx(11.0) and fixed["comp1_cov_12"] == 2.0


def test_samples_sum_to_one_and_stay_under_n(spark):
    parts = {"cov_11": 0.01, "cov_12": 0.002, "cov_22": 0.02, "mean_1": 0.1, "mean_2": -0.1}
    df = spark.range(5).select(F.lit(1).alias("tile_id"), F.col("id").alias("number"), *[
        F.lit(v).alias(f"comp{k}_{n}") for k in (1, 2, 3) for n, v in parts.items()],
        *[F.lit(w).alias(f"comp{k}_weight") for k, w in ((1, 0.5), (2, 0.3), (3, 0.2))])
    out = mixture.sample_gmm(df, ["tile_id", "number"], 1001)
    assert out.groupBy("number").count().filter("count <> 500 + 300 + 200").count() == 0
    stats = out.select((F.col("P_Galaxy") + F.col("P_QSO") + F.col("P_Star")).alias("s"), *[
        c.alias(n) for n, c in zip("xy", simplex.to_plane((F.col("P_Galaxy"), F.col("P_QSO"), F.col("P_Star"))))]).agg(
        F.min("s"), F.max("s"), F.avg("x"), F.var_pop("x"), F.covar_pop("x", "y")).first()
    assert stats[0] == pytest.approx(1) and stats[1] == pytest.approx(1)
    assert stats[2] == pytest.approx(0.1, abs=0.01) and stats[3] == pytest.approx(0.01, rel=0.1) and stats[4] == pytest.approx(0.002, abs=0.001)


def test_complementary_systematic_samples(spark):
    df = spark.range(103)
    parts = [{r["id"] for r in sampling.systematic_sample(df, ["id"], 4, s).collect()} for s in range(4)]
    assert set().union(*parts) == set(range(103)) and sum(map(len, parts)) == 103
    assert parts[0] == set(range(0, 103, 4))


def test_evenly_spaced_ends(spark):
    got = sorted(r["id"] for r in sampling.evenly_spaced(spark.range(100), ["id"], 4).collect())
    assert got == [0, 33, 66, 99]


def test_split_sizes_and_single_member_classes(spark):
    df = spark.range(101).select("id", F.when(F.col("id") == 7, "solo").otherwise(F.concat(F.lit("k"), F.col("id") % 2)).alias("c"))
    out = sampling.stratified_split(df, ["id"], "c", 0.1)
    assert out.filter("c = 'solo'").count() == 0
    assert dict(rows(out.filter("split = 'valid'").groupBy("c").count(), "c", "count")) == {"k0": 6, "k1": 5}
    assert sampling.train_valid_split(df, ["id"]).filter("split = 'valid'").count() == 11


@pytest.mark.parametrize("n", [3, 8, 29])
def test_folds_are_disjoint_and_complete(spark, n):
    out = sampling.kfold(spark.range(n), ["id"], 8, 2)
    assert out.count() == 2 * n
    sizes = [r["count"] for r in out.groupBy("repeat", "fold").count().collect()]
    assert max(sizes) - min(sizes) <= 1


def test_positions_do_not_depend_on_partitions(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("id"))
    for parts in (1, 7):
        out = ranks.key_ranks(df.repartition(parts), ["id"], ["id"])
        assert out.filter("id <> position").count() == 0


def test_prefix_sums_with_a_hot_group(spark):
    df = spark.range(3000).select(F.when(F.col("id") < 2500, "hot").otherwise("cold").alias("g"), "id", F.lit(1).alias("one"))
    out = ranks.prefix_sums(df.repartition(5), ["g"], ["id"], ["one"])
    want = F.when(F.col("g") == "hot", F.col("id") + 1).otherwise(F.col("id") - 2499)
    assert out.filter(F.col("one_cum") != want).count() == 0
    assert dict(rows(out.select("g", "one_total").distinct(), "g", "one_total")) == {"hot": 2500, "cold": 500}


def test_top_k_and_sets(spark):
    a, b = spark.createDataFrame([(1,), (2,), (2,)], "x int"), spark.createDataFrame([(2,), (3,)], "x int")
    assert sorted(rows(sets.union_distinct(a, b), "x")) == [(1,), (2,), (3,)]
    assert rows(sets.difference(a, b), "x") == [(1,)]
    assert sets.concat([a, b]).count() == 5
    assert rows(sets.top_k(a, [F.col("x").desc()], 1), "x") == [(2,)]

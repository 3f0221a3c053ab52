"""Evaluation of predictions: ROC, confusion, failure rates, residuals, pulls."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from posteria.functions.scalar import grid_cell, right_closed_bin
from posteria.operators import ordered
from posteria.operators.quantiles import group_medians
from posteria.operators.ranks import prefix_sums
from posteria.session import stage


def class_counts(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))


# --- one against one --------------------------------------------------------------


def one_vs_one(df: DataFrame, true_col: str, scores: Mapping[str, str], keep: Sequence[str] = ()) -> DataFrame:
    """Rows (one_class, other_class, label, score) for every ordered pair that
    contains the row's true class. ``scores`` maps class -> probability column.

    2(K-1) output rows per object for K classes, made inside the row.
    """
    cases = []
    for one, column in scores.items():
        for other in scores:
            if one != other:
                case = F.struct(
                    F.lit(one).alias("one_class"),
                    F.lit(other).alias("other_class"),
                    (F.col(true_col) == one).cast("int").alias("label"),
                    F.col(column).alias("score"),
                )
                cases.append(F.when(F.col(true_col).isin(one, other), case))
    return df.select(*keep, F.inline(F.array_compact(F.array(*cases))))


def _tied(df: DataFrame, label: str, score: str, by: Sequence[str]) -> DataFrame:
    """Positives and negatives per distinct score: ties meet before any order."""
    return (
        df.filter(F.col(score).isNotNull())
        .groupBy(*by, F.col(score).alias("threshold"))
        .agg(
            F.sum((F.col(label) == 1).cast("long")).alias("pos"),
            F.sum((F.col(label) == 0).cast("long")).alias("neg"),
        )
    )


def roc_points(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """(threshold, tpr, fpr) with every distinct score as ``>=`` threshold,
    plus the start (null, 0, 0) of each curve."""
    by = list(by) or ["_all"]
    if by == ["_all"]:
        df = df.withColumn("_all", F.lit(0))
    running = prefix_sums(_tied(df, label, score, by), by, [F.col("threshold") * -1], ["pos", "neg"])
    rate = lambda c: F.try_divide(F.col(f"{c}_cum").cast("double"), F.col(f"{c}_total").cast("double"))
    points = F.array(F.struct("threshold", rate("pos").alias("tpr"), rate("neg").alias("fpr")))
    # the row with the highest score also brings the start of its curve
    first = (F.col("pos_cum") == F.col("pos")) & (F.col("neg_cum") == F.col("neg"))
    start = F.array(
        F.struct(F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("tpr"), F.lit(0.0).alias("fpr"))
    )
    return running.select(*by, F.inline(F.when(first, F.concat(start, points)).otherwise(points))).drop("_all")


def auc(df: DataFrame, label: str, score: str, by: Sequence[str] = (), min_rows: int = 0) -> DataFrame:
    """Area under the ROC curve per group by mid-ranks; groups with at most
    ``min_rows`` rows are left out, one-class groups give null."""
    by = list(by) or ["_all"]
    if by == ["_all"]:
        df = df.withColumn("_all", F.lit(0))
    running = prefix_sums(_tied(df, label, score, by), by, ["threshold"], ["neg"])
    # pairs won by each positive: negatives strictly below, half of the ties
    won = F.col("pos") * (F.col("neg_cum") - F.col("neg") * F.lit(0.5))
    return (
        running.groupBy(*by)
        .agg(F.sum(won).alias("_won"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
        .filter(F.col("n_pos") + F.col("n_neg") > min_rows)
        .select(
            *by, "n_pos", "n_neg",
            F.try_divide(F.col("_won"), F.col("n_pos").cast("double") * F.col("n_neg").cast("double")).alias("auc"),
        )
        .drop("_all")
    )


def score_histogram(df: DataFrame, label: str, score: str, by: Sequence[str] = (), bins: int = 20) -> DataFrame:
    """Share of each (label, bin) among all rows of the group, bins on [0, 1]."""
    counts = (
        df.withColumn("bin", grid_cell(F.col(score), 0.0, 1.0, bins))
        .filter(F.col("bin").isNotNull())
        .groupBy(*by, F.col(label).alias("label"), "bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    total = F.sum("n").over(Window.partitionBy(*by))  # bins x labels rows per group
    return counts.select(*by, "label", "bin", "n", (F.col("n") / total).alias("share"))


# --- by magnitude --------------------------------------------------------------------


def mag_bin(df: DataFrame, mag: str, low: int = 17, high: int = 25, out: str = "mag_bin") -> DataFrame:
    """Left edge of the right-closed unit bin; null outside (low, high]."""
    return df.withColumn(out, right_closed_bin(F.col(mag), low, high))


def _bin_table(df: DataFrame, low: int, high: int) -> DataFrame:
    return df.sparkSession.range(low, high).select(F.col("id").cast("int").alias("mag_bin"))


def failure_rates(df: DataFrame, true_col: str, pred_col: str, mag: str, low: int = 17, high: int = 25) -> DataFrame:
    """Per magnitude bin: fails, n, failure percentage, share of the summed
    percentages and cumulative percentage; empty bins are present. A missing
    prediction is a failure."""
    counts = (
        mag_bin(df, mag, low, high)
        .filter(F.col("mag_bin").isNotNull())
        .groupBy("mag_bin")
        .agg(
            F.sum((~F.col(true_col).eqNullSafe(F.col(pred_col))).cast("long")).alias("fails"),
            F.count(F.lit(1)).alias("n"),
        )
    )
    filled = _bin_table(df, low, high).join(counts, "mag_bin", "left").na.fill(0, ["fails", "n"])
    ratio = F.try_divide(F.col("fails") * 100.0, F.col("n").cast("double"))
    every = Window.partitionBy(F.lit(0))  # (high - low) rows
    upto = Window.orderBy("mag_bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return filled.withColumn("failure_pct", ratio).select(
        "mag_bin", "fails", "n", "failure_pct",
        F.try_divide(F.col("failure_pct"), F.sum("failure_pct").over(every)).alias("share"),
        F.try_divide(F.sum("fails").over(upto) * 100.0, F.sum("n").over(every).cast("double")).alias("cumulative_pct"),
    )


def confusion(df: DataFrame, true_col: str, pred_col: str, classes: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Row-normalised confusion matrix on the full class grid, zeros included."""
    by = list(by)
    counts = df.groupBy(*by, F.col(true_col).alias("true"), F.col(pred_col).alias("pred")).agg(
        F.count(F.lit(1)).alias("n")
    )
    # from here on one row per group, one column per cell of the K x K grid
    pairs = [(t, p) for t in classes for p in classes]
    hit = lambda t, p: F.sum(F.when((F.col("true") == t) & (F.col("pred") == p), F.col("n")).otherwise(0))
    wide = counts.groupBy(*by).agg(*[hit(t, p).alias(f"_{i}") for i, (t, p) in enumerate(pairs)])
    number = lambda i: F.coalesce(F.col(f"_{i}"), F.lit(0))
    cells = []
    for i, (t, p) in enumerate(pairs):
        row = sum((number(j) for j, (u, _) in enumerate(pairs) if u == t), F.lit(0))
        share = F.coalesce(F.try_divide(number(i).cast("double"), row.cast("double")), F.lit(0.0))
        cells.append(F.struct(F.lit(t).alias("true"), F.lit(p).alias("pred"), number(i).alias("n"), share.alias("share")))
    return wide.select(*by, F.inline(F.array(*cells)))


def binned_residuals(df: DataFrame, residual: str, mags: Sequence[str], low: int = 17, high: int = 25, **how) -> DataFrame:
    """Per magnitude column and bin: median, mean and sample std of the residual,
    and the running share of the summed medians."""
    pairs = F.array(
        *[F.struct(F.lit(m).alias("mag"), right_closed_bin(F.col(m), low, high).alias("mag_bin")) for m in mags]
    )
    rows = df.select(F.col(residual).alias("r"), F.inline(pairs)).filter(F.col("mag_bin").isNotNull())
    moments = rows.groupBy("mag", "mag_bin").agg(F.avg("r").alias("mean"), F.stddev_samp("r").alias("std"))
    medians = group_medians(rows, ["mag", "mag_bin"], {"r": "median"}, **how)
    upto = Window.partitionBy("mag").orderBy("mag_bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.sum("median").over(Window.partitionBy("mag"))
    return moments.join(medians, ["mag", "mag_bin"]).select(
        "mag", "mag_bin", "median", "mean", "std",
        F.try_divide(F.sum("median").over(upto), total).alias("cumulative_share"),
    )


# --- residuals -------------------------------------------------------------------------


def residuals(df: DataFrame, pairs: Sequence[tuple[str, str]], regression: Sequence[str] = ()) -> DataFrame:
    """Add residual, absolute residual and, for regression targets, |d|/(1+obs)."""
    cols = []
    for obs, pred in pairs:
        d = F.col(pred) - F.col(obs)
        cols += [d.alias(f"{pred}_residual"), F.abs(d).alias(f"{pred}_residual_abs")]
        if obs in regression:
            cols.append(F.try_divide(F.abs(d), F.lit(1.0) + F.col(obs)).alias(f"{pred}_residual_rel"))
    return df.select("*", *cols)


def rotated_residuals(df: DataFrame, obs: str, pred: str, relative: bool = False) -> DataFrame:
    """Add ``res_x``, ``res_y``: the pair rotated by 45 degrees, or for
    redshift-like targets (obs, (pred - obs)/(1 + obs))."""
    o, p, root = F.col(obs), F.col(pred), F.lit(math.sqrt(2.0))
    if relative:
        return df.select("*", o.alias("res_x"), F.try_divide(p - o, F.lit(1.0) + o).alias("res_y"))
    return df.select("*", ((o + p) / root).alias("res_x"), ((p - o) / root).alias("res_y"))


def error_deflated_residuals(df: DataFrame, obs: str, pred: str, obs_err: str, pred_err: str) -> DataFrame:
    """Rotated residual moved towards zero by the total error; ``side`` tells
    which side of zero the residual was on."""
    rotated = rotated_residuals(df, obs, pred)
    total = F.sqrt(F.col(obs_err) * F.col(obs_err) + F.col(pred_err) * F.col(pred_err))
    above = F.col("res_y") > 0
    return rotated.select(
        "*",
        F.when(above, F.col("res_y") - total).otherwise(F.col("res_y") + total).alias("deflated"),
        F.when(above, "above").otherwise("below").alias("side"),
    )


def residual_histogram(df: DataFrame, col: str, low: float, high: float, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """Counts per bin on [low, high], last edge closed, outside ignored."""
    return (
        df.withColumn("bin", grid_cell(F.col(col), low, high, bins))
        .filter(F.col("bin").isNotNull())
        .groupBy(*by, "bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )


# --- robust statistics ---------------------------------------------------------------------


def mad_std(df: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    """MAD sigma per group: columns (by..., median, mad_std)."""
    return ordered.search(df, by, col, ordered.median_and_mad, "median double, mad_std double")


CLIPPED = "n long, mean double, median double, std double, lo double, hi double"


def sigma_clip_limits(
    df: DataFrame, col: str, by: Sequence[str] = (), sigma: float = 6.0, max_rounds: int | None = None, spread: str = "std"
) -> DataFrame:
    """Per group the closed range that survives clipping, with the mean, median
    and std of what is inside.

    The values are sorted once; all rounds are searches in the blocks of a
    group, whatever its size.
    """
    return ordered.search(df, by, col, lambda values: ordered.clip(values, sigma, max_rounds, spread), CLIPPED)


def sigma_clip_stats(df: DataFrame, col: str, by: Sequence[str] = (), sigma: float = 6.0, max_rounds: int | None = None, **how) -> DataFrame:
    """Mean, median and std per group after clipping until nothing changes."""
    return sigma_clip_limits(df, col, by, sigma, max_rounds, **how).select(
        *by, F.col("n").alias("n_left"), "mean", "median", "std"
    )


def above_below_stats(df: DataFrame, obs: str, pred: str, obs_err: str, pred_err: str) -> DataFrame:
    """Clipped statistics of the error-deflated residuals on each side of zero."""
    return sigma_clip_stats(error_deflated_residuals(df, obs, pred, obs_err, pred_err), "deflated", ["side"])


def pull_distribution(df: DataFrame, obs: str, pred: str, sigma_col: str, bins: int = 50, limit: float = 6.0) -> DataFrame:
    """Density of (obs - pred)/sigma on [-limit, limit] with the normal curve of
    the clipped median and the unclipped MAD sigma at the bin centres."""
    pulls = stage(  # one column, read by every pass below
        df.select(F.try_divide(F.col(obs) - F.col(pred), F.col(sigma_col)).alias("pull")).filter(
            F.col("pull").isNotNull()
        ),
        "pulls",
    )
    def robust(values: ordered.Ordered) -> dict:
        return ordered.clip(values, 6.0, None, "std") | {"spread": values.mad_std(values.median())}

    clipped = ordered.search(pulls, [], "pull", robust, CLIPPED + ", spread double").first()
    if clipped is None:  # no pulls
        clipped = dict.fromkeys(("mean", "median", "std", "spread"), math.nan)
    spread = clipped["spread"]
    width = 2 * limit / bins
    counts = residual_histogram(pulls, "pull", -limit, limit, bins)
    total = F.sum("n").over(Window.partitionBy(F.lit(0))).cast("double")  # at most `bins` rows
    centre = F.lit(-limit) + (F.col("bin") + 0.5) * F.lit(width)
    z = (centre - F.lit(clipped["median"])) / F.lit(spread)
    curve = F.exp(z * z * -0.5) / F.lit(spread * math.sqrt(2 * math.pi))
    return counts.select(
        "bin", "n", (F.col("n") / (total * F.lit(width))).alias("density"), curve.alias("normal"),
        F.lit(clipped["mean"]).alias("clipped_mean"), F.lit(clipped["median"]).alias("clipped_median"),
        F.lit(clipped["std"]).alias("clipped_std"), F.lit(spread).alias("mad_std"),
    )

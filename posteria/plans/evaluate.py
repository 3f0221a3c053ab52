"""Evaluation of a scored table as one plan: every table that a report needs, by name."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from posteria.operators import cleaning, evaluation, labels
from posteria.session import stage


def evaluate_classes(
    df: DataFrame, truth: str, scores: Mapping[str, str], mag: str, limit: float = 21.5, low: int = 17, high: int = 25, least_rows: int = 51
) -> dict[str, DataFrame]:
    """Tables for class probabilities; ``scores`` maps a class to its column.

    roc, auc, auc_by_mag (bins of ``least_rows`` or more) and score_histogram of
    each ordered pair of classes, from objects brighter than ``limit``;
    failure_rates, confusion and confusion_by_mag of the most probable class,
    from all. Objects without a truth take no part. The narrow columns needed
    are written once and read by all tables.
    """
    classes = list(scores)
    rows = df.filter(F.col(truth).isNotNull()).select(F.col(truth).alias("truth"), F.col(mag).alias("mag"), *[F.col(c).alias(f"s{i}") for i, c in enumerate(scores.values())])
    own = [f"s{i}" for i in range(len(classes))]
    rows = stage(evaluation.mag_bin(labels.predicted_class(rows, own, classes), "mag", low, high), "scored")
    bright = cleaning.magnitude_cut(rows, "mag", limit)
    pairs = stage(evaluation.one_vs_one(bright, "truth", dict(zip(classes, own)), ["mag_bin"]), "pairs")
    by = [c for c in pairs.columns if c not in ("label", "score", "mag_bin")]
    known = pairs.filter(F.col("mag_bin").isNotNull())
    return {
        "class_counts": evaluation.class_counts(rows, "truth"),
        "roc": evaluation.roc_points(pairs, "label", "score", by),
        "auc": evaluation.auc(pairs, "label", "score", by),
        "auc_by_mag": evaluation.auc(known, "label", "score", [*by, "mag_bin"], least_rows),
        "score_histogram": evaluation.score_histogram(pairs, "label", "score", by),
        "failure_rates": evaluation.failure_rates(rows, "truth", "CLASS", "mag", low, high),
        "confusion": evaluation.confusion(rows, "truth", "CLASS", classes),
        "confusion_by_mag": evaluation.confusion(rows.filter(F.col("mag_bin").isNotNull()), "truth", "CLASS", classes, ["mag_bin"]),
    }


def evaluate_target(
    df: DataFrame, obs: str, pred: str, obs_error: str, pred_error: str, mags: Sequence[str], relative: bool = True
) -> dict[str, DataFrame]:
    """Tables for one numeric target: residuals by magnitude, clipped statistics overall and beyond the errors, pulls."""
    d = F.col(pred) - F.col(obs)
    residual = F.try_divide(d, F.lit(1.0) + F.col(obs)) if relative else d
    rows = df.select(*[F.col(c).alias(n) for c, n in ((obs, "obs"), (pred, "pred"), (obs_error, "obs_error"), (pred_error, "pred_error"))], *mags, residual.alias("residual"))
    rows = stage(rows.filter(F.col("obs").isNotNull() & F.col("pred").isNotNull()), "targets")
    return {
        "binned_residuals": evaluation.binned_residuals(rows, "residual", mags),
        "clipped_residuals": evaluation.sigma_clip_stats(rows, "residual"),
        "mad": evaluation.mad_std(rows, "residual"),
        "above_below": evaluation.above_below_stats(rows, "obs", "pred", "obs_error", "pred_error"),
        "pulls": evaluation.pull_distribution(rows, "obs", "pred", "pred_error"),
    }


def write_evaluation(tables: Mapping[str, DataFrame], path: str) -> None:
    """Each table in a folder of its name."""
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{path}/{name}")


def read_evaluation(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}")

"""Robust quantile scaling; the fitted state is a small table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posteria.operators.cleaning import _replace
from posteria.operators.quantiles import group_quantiles


def fit_scaler(df: DataFrame, cols: Sequence[str], lo: float = 0.005, hi: float = 0.995, **how) -> DataFrame:
    """Rows (feature, minimum, dynamic_range, scaled) from exact quantiles."""
    ends = group_quantiles(df.select(*cols), [], cols, [lo, hi], **how)
    low = F.max(F.when(F.col("q") == lo, F.col("value")))
    high = F.max(F.when(F.col("q") == hi, F.col("value")))
    return (
        ends.groupBy(F.col("name").alias("feature"))
        .agg(low.alias("minimum"), (high - low).alias("dynamic_range"))
        .withColumn("scaled", F.col("dynamic_range") > 0)
    )


def fit_scaler_approx(df: DataFrame, cols: Sequence[str], lo: float = 0.005, hi: float = 0.995, accuracy: int = 10_000) -> DataFrame:
    """Single-pass variant on a mergeable sketch (rank error <= n/accuracy)."""
    sketch = df.agg(*[F.percentile_approx(c, [lo, hi], accuracy).alias(c) for c in cols])
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("e")) for c in cols])
    return sketch.select(F.inline(rows)).select(
        "feature",
        F.col("e")[0].cast("double").alias("minimum"),
        (F.col("e")[1] - F.col("e")[0]).cast("double").alias("dynamic_range"),
        (F.col("e")[1] > F.col("e")[0]).alias("scaled"),
    )


def scaler_constants(state: DataFrame) -> dict[str, tuple[float, float]]:
    """feature -> (minimum, range) for scaled features. One row per feature."""
    return {
        r["feature"]: (r["minimum"], r["dynamic_range"])
        for r in state.filter("scaled").select("feature", "minimum", "dynamic_range").collect()
    }


def apply_scaler(df: DataFrame, state: DataFrame | dict, error_suffix: str = "__err") -> DataFrame:
    """Scale values and, by name, their errors. Constants fold into one projection."""
    constants = state if isinstance(state, dict) else scaler_constants(state)
    have = set(df.columns)
    new = {}
    for c, (low, width) in constants.items():
        if c in have:
            new[c] = (F.col(c) - F.lit(low)) / F.lit(width)
        if c + error_suffix in have:
            new[c + error_suffix] = F.col(c + error_suffix) / F.lit(width)
    return _replace(df, new)

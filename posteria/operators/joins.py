"""Key joins. No side is forced to broadcast: Spark broadcasts a side only
when its measured size is under ``spark.sql.autoBroadcastJoinThreshold`` and
splits skewed keys at run time otherwise."""

from __future__ import annotations

from collections.abc import Sequence

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_groups(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join by group labels, null being a label like any other; ``on`` columns come from ``left``."""
    if not on:
        raise ValueError("groups to join by are missing")
    own = {c: f"_on{i}" for i, c in enumerate(on)}
    right = right.select(*[F.col(c).alias(n) for c, n in own.items()], *[c for c in right.columns if c not in own])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(n)) for c, n in own.items()])
    joined = left.join(right, same, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*own.values())


def enrich(df: DataFrame, external: DataFrame, key_cols: Sequence[str], suffix: str = "_ext") -> DataFrame:
    """Left join of an external table; its colliding columns get ``suffix``."""
    clash = {c: c + suffix for c in external.columns if c in df.columns and c not in key_cols}
    return df.join(external.withColumnsRenamed(clash), list(key_cols), "left")


def attach_predictions(out: DataFrame, preds: DataFrame, sigma: DataFrame | None, key_cols: Sequence[str]) -> DataFrame:
    """Pass-through columns with predictions and, if given, predicted sigmas."""
    joined = out.join(preds, list(key_cols))
    return joined.join(sigma, list(key_cols)) if sigma is not None else joined


def attach_truth(preds: DataFrame, truth: DataFrame, truth_error: DataFrame | None, key_cols: Sequence[str]) -> DataFrame:
    joined = preds.join(truth, list(key_cols))
    return joined.join(truth_error, list(key_cols)) if truth_error is not None else joined


def join_new_columns(a: DataFrame, b: DataFrame, key_cols: Sequence[str]) -> DataFrame:
    """Add to ``a`` only the columns it does not have yet."""
    new = [c for c in b.columns if c not in a.columns]
    return a.join(b.select(*key_cols, *new), list(key_cols))

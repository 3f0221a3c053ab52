"""Row filters, sentinels and missing values."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posteria.functions.scalar import clip, nan_to_null

# In-band markers for missing numbers.
SENTINEL = -999.0
MISSING_MAG = 99.0
# Fixed value: scaled features are in [0, 1]; missing ones go just outside.
FILL_VALUE = -0.1
SIGMA_FLOOR = 1e-4


def _replace(df: DataFrame, new: dict) -> DataFrame:
    """One projection that keeps the column order."""
    return df.select(*[new[c].alias(c) if c in new else F.col(c) for c in df.columns])


def filter_class(df: DataFrame, col: str, one_or_many: str | Iterable[str]) -> DataFrame:
    wanted = [one_or_many] if isinstance(one_or_many, str) else list(one_or_many)
    return df.filter(F.col(col).isin(wanted))


def sentinel_to_null(df: DataFrame, cols: Sequence[str], rule: str = "<=") -> DataFrame:
    """Values at or below (``<=``, features) or below (``<``, targets) -999 are missing."""
    if rule not in ("<", "<="):
        raise ValueError("rule must be '<' or '<='")
    missing = (lambda c: c < SENTINEL) if rule == "<" else (lambda c: c <= SENTINEL)
    return _replace(df, {c: F.when(~missing(F.col(c)), nan_to_null(F.col(c))) for c in cols})


def missing_mag_to_null(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return _replace(df, {c: F.nullif(F.col(c), F.lit(MISSING_MAG)) for c in cols})


def drop_null_targets(df: DataFrame, targets: Sequence[str], errors: Sequence[str] = ()) -> DataFrame:
    return df.na.drop(subset=[*targets, *errors])


def label_null_targets(df: DataFrame, targets: Sequence[str], errors: Sequence[str] = ()) -> DataFrame:
    return df.na.fill(SENTINEL, subset=[*targets, *errors])


def clip_unit(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return _replace(df, {c: clip(F.col(c), 0.0, 1.0) for c in cols})


def impute(df: DataFrame, features: Sequence[str], errors: Sequence[str] = (), fill: float = FILL_VALUE) -> DataFrame:
    """Missing feature -> ``fill``; missing or negative error -> 0."""
    new = {c: F.coalesce(nan_to_null(F.col(c)), F.lit(fill)) for c in features}
    new |= {c: F.greatest(F.coalesce(nan_to_null(F.col(c)), F.lit(0.0)), F.lit(0.0)) for c in errors}
    return _replace(df, new)


def zero_errors(df: DataFrame, features: Sequence[str], suffix: str = "__err") -> DataFrame:
    have = set(df.columns)
    return df.select("*", *[F.lit(0.0).alias(c + suffix) for c in features if c + suffix not in have])


def floor_sigma(df: DataFrame, cols: Sequence[str], floor: float = SIGMA_FLOOR) -> DataFrame:
    return _replace(
        df, {c: F.when(F.col(c).isNotNull(), F.greatest(F.col(c), F.lit(floor))) for c in cols}
    )


def evaluation_ready(df: DataFrame, mags: Sequence[str], mag_errs: Sequence[str]) -> DataFrame:
    """Missing numbers become 99, magnitudes lie in [0, 25], their errors in [0, 0.75]."""
    numeric = [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")]
    filled = {c: F.coalesce(nan_to_null(F.col(c)), F.lit(MISSING_MAG)) for c in numeric}
    filled |= {c: clip(filled[c], 0.0, 25.0) for c in mags}
    filled |= {c: clip(filled[c], 0.0, 0.75) for c in mag_errs}
    return _replace(df, filled)


def magnitude_cut(df: DataFrame, mag: str, limit: float = 21.5) -> DataFrame:
    return df.filter(F.col(mag) < limit)


def all_present(cols: Sequence[str]):
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols])

"""Wide to long without one expression per column and row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def names_array(names: Sequence[str]) -> Column:
    return F.array(*[F.lit(n) for n in names])


def melt(df: DataFrame, keep: Sequence[str | Column], cols: Sequence[str]) -> DataFrame:
    """Rows (keep..., place, v): one per column, ``place`` is its number in ``cols``."""
    packed = F.array(*[F.col(c).cast("double") for c in cols])
    return df.select(*keep, F.posexplode(packed).alias("place", "v"))


def named(place: str, names: Sequence[str]) -> Column:
    return F.get(names_array(names), F.col(place))

"""Top-k, stacking and set operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, order: Sequence[str | Column], k: int, by: Sequence[str] = ()) -> DataFrame:
    """First k rows of an order, per group when ``by`` is given.

    Spark keeps only k rows per group and task before the shuffle, so a hot
    group never travels whole.
    """
    if not by:
        return df.orderBy(*order).limit(k)
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("_r", place).filter(F.col("_r") <= k).drop("_r")


def concat(dfs: Sequence[DataFrame]) -> DataFrame:
    out = dfs[0]
    for df in dfs[1:]:
        out = out.unionByName(df)
    return out


def union_distinct(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of ``a`` that are not in ``b``; nulls are equal to nulls."""
    return a.subtract(b.select(*a.columns))

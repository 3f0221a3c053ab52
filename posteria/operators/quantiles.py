"""Exact interpolated quantiles for groups of any size."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from posteria.functions.shape import melt, named
from posteria.operators.ordered import search
from posteria.session import stage

LEFT_VALUES = 2_000_000  # around a wanted place; of more, the range is sketched and cut again
SKETCH_ACCURACY = 10_000
GRID = [i / 64 for i in range(65)]


def _melt(df: DataFrame, by: Sequence[str], cols: Sequence[str]) -> DataFrame:
    return melt(df, by, cols).select(*by, named("place", cols).alias("name"), "v").filter(F.col("v").isNotNull())


def _same(left: DataFrame, right: DataFrame, on: Sequence[str]) -> Column:
    # group labels may be null, and null is a group of its own
    return reduce(lambda a, b: a & b, [left[c].eqNullSafe(right[c]) for c in on])


def _narrow(
    df: DataFrame, long: DataFrame, by: list[str], cols: Sequence[str], qs: Sequence[float], most: int
) -> DataFrame:
    """Per (by, name, q): size, the closed value range that is known to hold
    both order statistics, and how many values lie below it."""
    edge = 2.0 / SKETCH_ACCURACY
    marks = [m for q in qs for m in (max(q - edge, 0.0), min(q + edge, 1.0))]
    def sketched(c: str) -> Column:
        v = F.col(c).cast("double")
        return F.struct(
            F.lit(c).alias("name"), F.count(v).alias("n"), F.min(v).alias("mn"), F.max(v).alias("mx"),
            F.percentile_approx(v, marks, SKETCH_ACCURACY).alias("b"),
        )

    # one sketch per column side by side: keys are the groups only
    wide = df.groupBy(*by).agg(F.array(*[sketched(c) for c in cols]).alias("s"))
    sketch = wide.select(*by, F.inline("s")).filter(F.col("n") > 0)
    ranges = F.array(
        *[
            F.struct(F.lit(float(q)).alias("q"), F.col("b")[2 * i].alias("lo"), F.col("b")[2 * i + 1].alias("hi"))
            for i, q in enumerate(qs)
        ]
    )
    bounds = sketch.select(*by, "name", "n", "mn", "mx", F.inline(ranges))
    on = [*by, "name"]
    while True:
        bounds = stage(bounds, "bounds")
        counted = stage(
            long.join(bounds, _same(long, bounds, on))
            .groupBy(*[bounds[c] for c in on], "q", "n", "mn", "mx", "lo", "hi")
            .agg(
                F.sum((F.col("v") < F.col("lo")).cast("long")).alias("below"),
                F.sum(F.col("v").between(F.col("lo"), F.col("hi")).cast("long")).alias("inside"),
            )
            .withColumn("h", (F.col("n") - 1) * F.col("q"))
            .withColumn("k0", F.floor("h"))
            .withColumn("k1", F.ceil("h")),
            "counts",
        )
        missed = (F.col("k0") < F.col("below")) | (F.col("k1") >= F.col("below") + F.col("inside"))
        wide = (F.col("inside") > most) & (F.col("lo") < F.col("hi"))
        state = counted.agg(
            F.max(missed.cast("int")).alias("missed"), F.max((wide & ~missed).cast("int")).alias("wide")
        ).first()
        if state["missed"]:
            # the sketch was off for some group: open that group's range fully
            bounds = counted.select(
                *on, "n", "mn", "mx", "q",
                F.when(missed, F.col("mn")).otherwise(F.col("lo")).alias("lo"),
                F.when(missed, F.col("mx")).otherwise(F.col("hi")).alias("hi"),
            )
            continue
        if not state["wide"]:
            return counted
        # too many values left in a range: sketch that range alone and cut again
        wide_rows = counted.filter(wide)
        inner = (
            long.join(wide_rows, _same(long, wide_rows, on))
            .filter(F.col("v").between(F.col("lo"), F.col("hi")))
            .groupBy(*[wide_rows[c] for c in on], "q")
            .agg(F.percentile_approx("v", GRID, SKETCH_ACCURACY).alias("g"))
        )
        share = lambda k: (F.col(k) - F.col("below")) * F.lit(64.0) / F.col("inside")
        low = F.greatest(F.floor(share("k0")) - 1, F.lit(0)).cast("int")
        high = F.least(F.ceil(share("k1")) + 1, F.lit(64)).cast("int")
        new = counted.join(inner.select(*[F.col(c).alias(f"_g_{c}") for c in [*on, "q"]], "g"),
                           reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in [*on, "q"]]),
                           "left")
        cut = new.select(
            *on, "n", "mn", "mx", "q", "lo", "hi", "inside",
            F.coalesce(F.get("g", low), F.col("lo")).alias("lo2"),
            F.coalesce(F.get("g", high), F.col("hi")).alias("hi2"),
        )
        cut = stage(cut, "cut")
        if not cut.filter((F.col("lo2") > F.col("lo")) | (F.col("hi2") < F.col("hi"))).head(1):
            return counted  # what is left is ties; they collapse by value below
        bounds = cut.select(
            *on, "n", "mn", "mx", "q", F.col("lo2").alias("lo"), F.col("hi2").alias("hi")
        )


def group_quantiles(
    df: DataFrame,
    by: Sequence[str],
    cols: Sequence[str],
    qs: Sequence[float],
    left_values: int = LEFT_VALUES,
    bounded: bool = False,
) -> DataFrame:
    """Exact quantiles (linear interpolation) as rows (by..., name, q, value).

    A mergeable sketch narrows each wanted place to the few values around it,
    counts prove the range right, and only those values are sorted.
    ``bounded=True`` states that group sizes have a known bound (draws of one
    object), which one built-in aggregate serves.
    """
    by = list(by)
    if bounded:
        marks = F.array(*[F.lit(float(q)) for q in qs])
        wide = df.groupBy(*by).agg(
            *[F.percentile(F.col(c).cast("double"), marks).alias(f"_q{i}") for i, c in enumerate(cols)]
        )
        rows = F.array(
            *[
                F.struct(F.lit(c).alias("name"), F.lit(float(q)).alias("q"), F.get(f"_q{i}", F.lit(j)).alias("value"))
                for i, c in enumerate(cols)
                for j, q in enumerate(qs)
            ]
        )
        return wide.select(*by, F.inline(rows)).filter(F.col("value").isNotNull())

    long = _melt(df, by, cols)
    on = [*by, "name"]
    marks = _narrow(df, long, by, cols, qs, left_values)
    kept = (
        long.join(marks, _same(long, marks, on))
        .filter(F.col("v").between(F.col("lo"), F.col("hi")))
        .groupBy(*[marks[c] for c in on], "q", "h", "k0", "k1", "below", "v")
        .agg(F.count(F.lit(1)).alias("c"))
    )
    order = Window.partitionBy(*on, "q").orderBy("v").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    placed = kept.withColumn("cum", F.col("below") + F.sum("c").over(order))
    ends = placed.groupBy(*on, "q", "h", "k0").agg(
        F.min(F.when(F.col("cum") > F.col("k0"), F.col("v"))).alias("v0"),
        F.min(F.when(F.col("cum") > F.col("k1"), F.col("v"))).alias("v1"),
    )
    return ends.select(
        *on, "q",
        (F.col("v0") + (F.col("v1") - F.col("v0")) * (F.col("h") - F.col("k0"))).alias("value"),
    )


def quantiles(df: DataFrame, cols: Sequence[str], qs: Sequence[float], **how) -> DataFrame:
    """Axis limits: exact quantiles of whole columns, rows (name, q, value)."""
    return group_quantiles(df, [], cols, qs, **how)


def group_medians(df: DataFrame, by: Sequence[str], cols: dict[str, str], bounded: bool = False) -> DataFrame:
    """One row per group with the median of each column, ``cols`` maps
    column -> output name. Null where a column has no value in the group."""
    if bounded:
        long = group_quantiles(df, by, list(cols), [0.5], bounded=True)
        return long.groupBy(*by).agg(
            *[F.max(F.when(F.col("name") == c, F.col("value"))).alias(a) for c, a in cols.items()]
        )
    out = None
    for c, a in cols.items():
        one = search(df, by, c, lambda values: {"median": values.median()}, "median double").withColumnRenamed("median", a)
        out = one if out is None else _both(out, one, list(by))
    return out


def _both(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """Full join of one row per group; a null label is a group of its own."""
    if not by:
        return left.join(right, F.lit(True), "full")  # one row each
    names = {c: f"_r{i}" for i, c in enumerate(by)}
    right = right.withColumnsRenamed(names)
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()])
    there = F.lit(True)
    joined = left.withColumn("_left", there).join(right, same, "full")
    labels = [F.when(F.col("_left"), F.col(c)).otherwise(F.col(n)).alias(c) for c, n in names.items()]
    return joined.select(*labels, *[c for c in joined.columns if c not in {*by, *names.values(), "_left"}])

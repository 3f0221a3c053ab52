"""Two-dimensional densities. Grids are bounded by their bin counts, which are
parameters, so only the first aggregation of each operator sees the rows."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posteria.functions.scalar import grid_cell
from posteria.operators.quantiles import group_medians


BROADCAST_CELLS = 1_000_000


@dataclass(frozen=True)
class Grid:
    x_low: float
    x_high: float
    y_low: float
    y_high: float
    x_bins: int = 100
    y_bins: int = 100


def _cells(df: DataFrame, x: str, y: str, grid: Grid, closed: bool = True) -> DataFrame:
    return df.withColumns(
        {
            "ix": grid_cell(F.col(x), grid.x_low, grid.x_high, grid.x_bins, closed),
            "iy": grid_cell(F.col(y), grid.y_low, grid.y_high, grid.y_bins, closed),
        }
    ).filter(F.col("ix").isNotNull() & F.col("iy").isNotNull())


def density_2d(df: DataFrame, x: str, y: str, grid: Grid) -> DataFrame:
    """Counts of the non-empty cells (ix, iy, n); the last edges are closed."""
    return _cells(df.select(x, y), x, y, grid).groupBy("ix", "iy").agg(F.count(F.lit(1)).alias("n"))


def binned_median_2d(df: DataFrame, x: str, y: str, z: str, grid: Grid, thresh: int = 10, **how) -> DataFrame:
    """Median of z per cell, null where a cell has fewer than ``thresh`` rows."""
    rows = _cells(df.select(x, y, z), x, y, grid)
    counts = rows.groupBy("ix", "iy").agg(F.count(F.lit(1)).alias("n"))
    medians = group_medians(rows, ["ix", "iy"], {z: "median"}, **how)
    return counts.join(medians, ["ix", "iy"], "left").select(
        "ix", "iy", "n", F.when(F.col("n") >= thresh, F.col("median")).alias("median")
    )


def _kernel(sigma: float) -> list[tuple[int, float]]:
    half = math.ceil(8 * sigma) // 2  # eight sigmas wide, odd
    raw = [(i, math.exp(-i * i / (2 * sigma * sigma))) for i in range(-half, half + 1)]
    total = sum(w for _, w in raw)
    return [(i, w / total) for i, w in raw]


def smooth_grid(cells: DataFrame, value: str, grid: Grid, sigma: float = 2.0, missing: str = "zero") -> DataFrame:
    """Gaussian convolution of a grid, zero outside it.

    ``missing="zero"`` reads absent cells as zero (counts);
    ``"interpolate"`` gives absent or null cells no weight. The kernel is
    separable, so two one-dimensional passes replace the square stencil.
    """
    kernel = _kernel(sigma)
    taps = F.array(*[F.struct(F.lit(i).alias("step"), F.lit(w).alias("w")) for i, w in kernel])
    start = cells.filter(F.col(value).isNotNull()).select(
        "ix", "iy", F.col(value).cast("double").alias("a"), F.lit(1.0).alias("m")
    )

    def blur(df: DataFrame, axis: str, bins: int) -> DataFrame:
        other = "iy" if axis == "ix" else "ix"
        spread = df.select(other, axis, "a", "m", F.inline(taps)).withColumn(axis, F.col(axis) + F.col("step"))
        return (
            spread.filter(F.col(axis).between(0, bins - 1))
            .groupBy("ix", "iy")
            .agg(F.sum(F.col("a") * F.col("w")).alias("a"), F.sum(F.col("m") * F.col("w")).alias("m"))
        )

    out = blur(blur(start, "ix", grid.x_bins), "iy", grid.y_bins)
    if missing == "zero":
        return out.select("ix", "iy", F.col("a").alias("smooth"))

    def covered(bins: int):
        return F.array(*[F.lit(sum(w for i, w in kernel if 0 <= c + i < bins)) for c in range(bins)])

    # cells outside the grid are zeros with full weight
    outside = 1.0 - F.get(covered(grid.x_bins), F.col("ix")) * F.get(covered(grid.y_bins), F.col("iy"))
    return out.select("ix", "iy", F.try_divide(F.col("a"), F.col("m") + outside).alias("smooth"))


def sparse_points(df: DataFrame, x: str, y: str, grid: Grid, thresh: int = 10) -> DataFrame:
    """Rows in cells with fewer than ``thresh`` rows; right and top edge excluded."""
    counts = density_2d(df, x, y, grid).filter(F.col("n") < thresh)
    if grid.x_bins * grid.y_bins <= BROADCAST_CELLS:
        counts = F.broadcast(counts)  # never more rows than the grid has cells
    return _cells(df, x, y, grid, closed=False).join(counts, ["ix", "iy"])


def hexbin(
    df: DataFrame, x: str, y: str, x_low: float, x_high: float, y_low: float, y_high: float, gridsize: int = 50
) -> DataFrame:
    """Counts on a hexagonal lattice: the nearer centre of two shifted grids."""
    nx, ny = gridsize, int(gridsize / math.sqrt(3))
    inside = F.col(x).between(x_low, x_high) & F.col(y).between(y_low, y_high)
    a = (F.col(x) - x_low) / F.lit(x_high - x_low) * F.lit(float(nx))
    b = (F.col(y) - y_low) / F.lit(y_high - y_low) * F.lit(float(ny))
    sq = lambda c: c * c
    placed = df.filter(inside).select(a.alias("a"), b.alias("b"))
    corner = sq(F.col("a") - F.rint("a")) + 3.0 * sq(F.col("b") - F.rint("b"))
    middle = sq(F.col("a") - F.floor("a") - 0.5) + 3.0 * sq(F.col("b") - F.floor("b") - 0.5)
    first = corner < middle
    return (
        placed.select(
            F.when(first, 0).otherwise(1).alias("lattice"),
            F.when(first, F.rint("a")).otherwise(F.floor("a").cast("double")).cast("int").alias("ix"),
            F.when(first, F.rint("b")).otherwise(F.floor("b").cast("double")).cast("int").alias("iy"),
        )
        .groupBy("lattice", "ix", "iy")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("log_n", F.log10("n"))
    )


def density_levels(cells: DataFrame, value: str, thresh: float | None = None) -> DataFrame:
    """Contour levels of log10(value): 5 from the minimum to 0.9 of the maximum;
    with ``thresh`` 10 from log10(max(min, thresh)) to
    max(0.99 log10(max), thresh + 1)."""
    low, high = F.min(value).cast("double"), F.max(value).cast("double")
    if thresh is None:
        count, first, last = 5, F.log10(low), F.log10(high) * 0.9
    else:
        count = 10
        first = F.log10(F.greatest(low, F.lit(float(thresh))))
        last = F.greatest(F.log10(high) * 0.99, F.lit(float(thresh + 1)))
    ends = cells.filter(F.col(value) > 0).agg(first.alias("a"), last.alias("b"))
    return ends.select("a", "b", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("level")).select(
        "level", (F.col("a") + (F.col("b") - F.col("a")) * F.col("level") / F.lit(float(count - 1))).alias("value")
    )

"""Posterior summaries. A row is an object and ``<t>_draws`` holds its draws of
target ``t``; every operator here is a projection, so objects never shuffle."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from posteria.functions import blocks

# The percentiles reported for every target.
PERCENTILES = {"pc02": 0.02275, "pc16": 0.15865, "pc50": 0.50, "pc84": 0.84135, "pc98": 0.97725}


def _draws(t: str) -> str:
    return f"{t}_draws"


def clip_draws(df: DataFrame, targets: Sequence[str], sigma: float = 6.0, max_rounds: int = 10) -> DataFrame:
    """Add ``<t>_clipped``: draws within ``sigma`` MAD sigmas of the median,
    repeated until nothing changes or ``max_rounds``; ascending."""
    made = [T.StructField(f"{t}_clipped", T.ArrayType(T.DoubleType())) for t in targets]
    schema = T.StructType([*df.schema.fields, *made])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = [blocks.clipped_lists(batch.column(_draws(t)), sigma, max_rounds) for t in targets]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=schema.names)

    return df.mapInArrow(run, schema)


def _with_statistics(df: DataFrame, made: dict[tuple[str, ...], tuple[Sequence[str], Callable[..., np.ndarray]]]) -> DataFrame:
    """Add, for each tuple of array columns, the named numbers that a step finds in their rows."""
    names = [n for found, _ in made.values() for n in found]
    schema = T.StructType([*df.schema.fields, *[T.StructField(n, T.DoubleType()) for n in names]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = []
            for columns, (found, step) in made.items():
                table = blocks.per_length([batch.column(c) for c in columns], len(found), step)
                new += [pa.array(v, pa.float64(), from_pandas=True) for v in table.T]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=schema.names)

    return df.mapInArrow(run, schema)


def draw_percentiles(clipped: DataFrame, targets: Sequence[str]) -> DataFrame:
    qs = list(PERCENTILES.values())
    return _with_statistics(
        clipped, {(f"{t}_clipped",): ([f"{t}_{p}" for p in PERCENTILES], lambda v: blocks.quantiles(v, qs)) for t in targets}
    )


def draw_mad_std(clipped: DataFrame, targets: Sequence[str]) -> DataFrame:
    return _with_statistics(clipped, {(f"{t}_clipped",): ([f"{t}_std"], blocks.mad_std) for t in targets})


def draw_mean(clipped: DataFrame, targets: Sequence[str]) -> DataFrame:
    return _with_statistics(clipped, {(f"{t}_clipped",): ([f"{t}_mean"], lambda v: v.mean(1, keepdims=True)) for t in targets})


def draw_correlation(df: DataFrame, targets: Sequence[str]) -> DataFrame:
    """Pearson correlation of every target pair over the unclipped draws."""
    pairs = {(_draws(a), _draws(b)): ([f"{a}_{b}_corr"], blocks.correlation) for a, b in combinations(targets, 2)}
    return _with_statistics(df, pairs)


def summary_columns(targets: Sequence[str]) -> list[str]:
    return [
        *[f"{t}_mean" for t in targets],
        *[f"{t}_std" for t in targets],
        *[f"{a}_{b}_corr" for a, b in combinations(targets, 2)],
        *[f"{t}_{p}" for p in PERCENTILES for t in targets],
    ]


def summary_of(raw: dict[str, np.ndarray], sigma: float = 6.0, max_rounds: int = 10) -> dict[str, np.ndarray]:
    """The columns of ``summary_columns`` for a block, from (objects, draws) of every target."""
    out = {}
    for t, x in raw.items():
        v = np.sort(x, axis=1)
        first, size, out[f"{t}_std"] = blocks.clipped_range(v, sigma, max_rounds)
        out[f"{t}_mean"] = blocks.range_mean(v, first, size)
        for p, q in PERCENTILES.items():
            out[f"{t}_{p}"] = blocks.range_quantile(v, first, size, q)
    for a, b in combinations(raw, 2):
        out[f"{a}_{b}_corr"] = blocks.correlation(raw[a], raw[b])[:, 0]
    return {n: out[n] for n in summary_columns(list(raw))}


def posterior_summary(
    df: DataFrame, keep: Sequence[str], targets: Sequence[str], sigma: float = 6.0, max_rounds: int = 10,
    block: int = 4096,
) -> DataFrame:
    """``keep`` columns plus mean, MAD sigma, correlations and percentiles.

    The same numbers as the operators above in one pass over Arrow batches: a
    draw is sorted once and every statistic reads the sorted rows. The targets
    of an object must have equally many draws.
    """
    keep, targets = list(keep), list(targets)
    names = summary_columns(targets)
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(n, T.DoubleType()) for n in names])

    def summarise(part: pa.RecordBatch) -> dict[str, np.ndarray]:
        raw = {t: blocks.matrix(part, _draws(t)) for t in targets}
        if len({x.shape for x in raw.values()}) > 1:
            raise ValueError(f"targets differ in their numbers of draws: { {t: x.shape[1] for t, x in raw.items()} }")
        return summary_of(raw, sigma, max_rounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for length, part in blocks.equal_length_parts(batch, _draws(targets[0]), block):
                nothing = {n: np.full(part.num_rows, np.nan) for n in names}
                yield blocks.with_columns(part, keep, summarise(part) if length else nothing)

    return df.select(*keep, *[_draws(t) for t in targets]).mapInArrow(run, schema)


def observed_spread(df: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """Add |median - truth|; ``pairs`` maps output -> (median column, truth column)."""
    return df.select("*", *[F.abs(F.col(m) - F.col(y)).alias(o) for o, (m, y) in pairs.items()])


def explode_draws(df: DataFrame, keep: Sequence[str], targets: Sequence[str]) -> DataFrame:
    """Long form: one row (key, draw, value per target)."""
    zipped = F.arrays_zip(*[F.col(_draws(t)) for t in targets])
    return df.select(*keep, F.posexplode(zipped).alias("draw", "z")).select(
        *keep, "draw", *[F.col("z")[_draws(t)].alias(t) for t in targets]
    )

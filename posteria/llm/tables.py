"""Narrow views of corpus tables and arrow batch helpers shared by the operators.

An operator takes only the columns it names and gives them private names, so
extra columns of its input, whatever they are called, never clash.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from contextlib import suppress

import pyarrow as pa
import pyarrow.compute  # noqa: F401  (loads pa.compute)
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str) -> Column:
    """Column by its literal name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """``df`` reduced to the given columns under the given names."""
    return df.select(*[quoted(source).alias(name) for name, source in columns.items()])


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most_bytes`` of ``column`` (one row at least).

    A batch that Spark hands over is limited by rows; texts differ so much in
    length that memory must be bounded by bytes instead.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.schema.get_field_index(column)
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)
        start = held = 0
        for row, size in enumerate(sizes):
            if held and held + size > most_bytes:
                yield batch.slice(start, row - start)
                start, held = row, 0
            held += int(size)
        yield batch.slice(start)


def give_back() -> None:
    """Return freed memory to the machine: a Python worker outlives its task, beside the work of later ones."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # only some C libraries have it
        ctypes.CDLL(None).malloc_trim(0)


def lean(step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``step`` over the batches of a task, its memory given back when the task is over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from step(batches)
        finally:
            give_back()

    return run


def sealed(df: DataFrame, prefix: str = "_c") -> DataFrame:
    """``df`` with private column names, so that nothing an operator adds clashes with them."""
    return df.select(*[quoted(c).alias(f"{prefix}{i}") for i, c in enumerate(df.columns)])


def unsealed(df: DataFrame, names: list[str], prefix: str = "_c", **made: Column) -> DataFrame:
    """The columns of a sealed table under their own names again, those in ``made`` (by private name) replaced."""
    return df.select(*[made.get(f"{prefix}{i}", F.col(f"{prefix}{i}")).alias(c) for i, c in enumerate(names)])

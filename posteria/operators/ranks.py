"""Global positions and running sums without a single-task window."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from posteria.operators.joins import join_groups
from posteria.session import stage


def bucket_digits(rows: int) -> int:
    """Hex digits of a hash that cut ``rows`` into about as many buckets as a bucket has rows."""
    return max(1, -(-(max(rows, 1) - 1).bit_length() // 8))


def key_ranks(df: DataFrame, order: Sequence[str | Column], keep: Sequence[str]) -> DataFrame:
    """``keep`` columns plus ``position`` (0-based) in the order of ``order``.

    Rows are range partitioned and sorted, every row learns its place inside
    its partition, and the per-partition counts give the offsets. Pass only
    key columns in ``keep`` and join back: the staged table stays narrow.
    """
    # partition id in the upper 31 bits, place in the partition in the lower 33
    place = F.monotonically_increasing_id()
    names = [f"_o{i}" for i in range(len(order))]
    narrow = df.select(
        *keep, *[(F.col(o) if isinstance(o, str) else o).alias(n) for n, o in zip(names, order)]
    )
    placed = stage(
        narrow.repartitionByRange(*names)
        .sortWithinPartitions(*names)
        .withColumn("_place", place)
        .select(
            *keep,
            F.shiftrightunsigned("_place", 33).alias("_part"),
            F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)).alias("_index"),
        ),
        "ranks",
    )
    # one row per partition: the ordered window below sees a few thousand rows
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return placed.join(F.broadcast(offsets), "_part").select(
        *keep, (F.col("_off") + F.col("_index")).alias("position")
    )


def prefix_sums(
    df: DataFrame, by: Sequence[str], order: Sequence[str | Column], sums: Sequence[str]
) -> DataFrame:
    """Add ``<c>_cum``, the inclusive running sum of each column in ``sums``,
    and ``<c>_total``, its sum over the group.

    ``df`` must be unique in (by, order) - aggregate ties first - so no group
    is too hot to be cut into ranges.
    """
    columns = df.columns
    names = [f"_o{i}" for i in range(len(order))]
    keyed = df.select(
        *columns, *[(F.col(o) if isinstance(o, str) else o).alias(n) for n, o in zip(names, order)]
    )
    ranged = keyed.repartitionByRange(*by, *names).sortWithinPartitions(*by, *names).select(*columns)
    # running sums are taken on the way out of the one shuffle
    placed = stage(_running(ranged, by, sums), "prefix")
    totals = placed.groupBy("_part", *by).agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # a group lies in neighbouring ranges, so this has at most
    # (partitions + groups) rows
    offsets = totals.select(
        "_part",
        *by,
        *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_off_{c}") for c in sums],
        *[F.sum(f"_t_{c}").over(Window.partitionBy(*by)).alias(f"{c}_total") for c in sums],
    )
    return join_groups(placed, stage(offsets, "offsets"), ["_part", *by]).select(
        *columns,
        *[(F.col(f"_off_{c}") + F.col(f"_loc_{c}")).alias(f"{c}_cum") for c in sums],
        *[f"{c}_total" for c in sums],
    )


def _running(ordered: DataFrame, by: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """``ordered`` with its partition ``_part`` and ``_loc_<c>``, the running sum of
    each group's rows in that partition. Groups stand together."""
    schema = T.StructType(ordered.schema.fields + [T.StructField("_part", T.LongType())])
    for c in sums:
        whole = isinstance(ordered.schema[c].dataType, T.IntegralType)
        schema = schema.add(f"_loc_{c}", T.LongType() if whole else T.DoubleType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last, carried = None, dict.fromkeys(sums, 0)
        for batch in batches:
            if not batch.num_rows:
                continue
            # the number of the group a row is in, counted within the batch; nulls are equal
            new = np.zeros(batch.num_rows, bool)
            for c in by:
                codes = batch.column(c).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                new[1:] |= codes[1:] != codes[:-1]
            first = tuple(batch.column(c)[0].as_py() for c in by)
            starts = np.concatenate(([0], np.flatnonzero(new)))
            group = np.cumsum(new)
            columns = list(batch.columns) + [pa.array(np.full(batch.num_rows, part), pa.int64())]
            for c in sums:
                values = batch.column(c).fill_null(0).to_numpy(zero_copy_only=False)
                running = np.cumsum(values)
                before = np.concatenate((running[:1] * 0, running))[starts]
                local = running - before[group]
                if first == last:
                    local[group == 0] += carried[c]
                carried[c] = local[-1]
                columns.append(pa.array(local))
            last = tuple(batch.column(c)[-1].as_py() for c in by)
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return ordered.mapInArrow(run, schema)


def hash_cuts(
    df: DataFrame, by: Sequence[str], hash_col: str, positions: Column, total: str = "_n"
) -> DataFrame:
    """Hashes standing at given 1-based places of each group's hash order.

    ``positions`` is an array expression over ``by`` and the group size
    ``total``. Returns ``by``, ``total`` and arrays in the order of the places:
    ``cuts`` (hashes), ``among`` (which of the rows of that hash stands there)
    and ``same`` (how many have it). Hashes fill their buckets evenly, so only the few buckets that
    hold a wanted place are ever sorted; the table itself is not shuffled.
    """
    # both the table of buckets and a bucket grow with the root of the table
    bucket = F.substring(hash_col, 1, bucket_digits(df.count()))
    rows = df.select(*by, F.col(hash_col).alias("_h"), bucket.alias("_bucket"))
    counts = rows.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    filled = counts.select(
        *by,
        "_bucket",
        "_c",
        F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_below"),
        F.sum("_c").over(whole).alias(total),
    )
    wanted = (
        filled.select("*", F.posexplode(positions).alias("_i", "_p"))
        .filter((F.col("_p") > F.col("_below")) & (F.col("_p") <= F.col("_below") + F.col("_c")))
        .drop("_c")
    )
    # a place p <= 0 means "nothing": it yields no cut at all
    # staged, so that the planner knows how small it is and broadcasts it
    wanted = stage(wanted, "places")
    held = wanted.select(*by, "_bucket").distinct()
    local = Window.partitionBy(*by, "_bucket").orderBy("_h")
    ranked = join_groups(rows, held, [*by, "_bucket"], "left_semi").select(
        *by, "_bucket", "_h", F.row_number().over(local).alias("_r"), F.rank().over(local).alias("_first"),
        F.count(F.lit(1)).over(Window.partitionBy(*by, "_bucket", "_h")).alias("_same"),
    )
    hits = join_groups(ranked, wanted, [*by, "_bucket"]).filter(
        F.col("_p") == F.col("_below") + F.col("_r")
    )
    cut = F.struct("_i", "_h", (F.col("_r") - F.col("_first") + 1).cast("long").alias("_a"), "_same")
    found = hits.groupBy(*by, total).agg(F.array_sort(F.collect_list(cut)).alias("_cuts"))
    return found.select(*by, total, F.col("_cuts._h").alias("cuts"), F.col("_cuts._a").alias("among"), F.col("_cuts._same").alias("same"))


def running_total(
    df: DataFrame, order: Sequence[str], col: str, by: Sequence[str] = (), large: bool = False
) -> DataFrame:
    """Add ``<col>_cum``: running sum in the order of ``order``.

    Bin tables use a plain window. ``large=True`` takes the range-partitioned
    way, which needs rows unique in (by, order).
    """
    if large:
        return prefix_sums(df, list(by), list(order), [col]).drop(f"{col}_total")
    frame = Window.partitionBy(*by).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return df.withColumn(f"{col}_cum", F.sum(col).over(frame))

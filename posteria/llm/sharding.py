"""Reproducible global shuffle: a Feistel permutation of global row numbers.

Row numbers come from the key order of the rows, not from files or tasks, so
the same rows get the same shard and slot in any layout. Row ``r`` of ``n``
goes to place ``p = permute(r)``, shard ``p % shards``, slot ``p // shards``:
shards differ by one row at most, slots are gapless, and both can be computed
for any row number without looking at the others.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from posteria.llm.tables import quoted
from posteria.session import stage

PRIME = 2147483647  # 2^31 - 1: products of residues fit a long
ROUNDS = ((1181783497, 1664525), (276601519, 22695477), (812433253, 69069),
          (597334677, 134775813), (747796405, 48271), (1103515245, 16807))
SHORT_WALK = 8


def _long(value: int) -> Column:
    return F.lit(value).cast("long")


def rounds(seed: int) -> list[tuple[int, int]]:
    """Key and factor of each round."""
    return [((key + 7919 * (i + 1) * seed) % PRIME, factor) for i, (key, factor) in enumerate(ROUNDS)]


def sides(rows: int) -> tuple[int, int]:
    """Sides of a near-square grid that holds ``rows`` places and few more."""
    left = max(1, math.isqrt(max(rows, 1) - 1) + 1)
    return left, max(1, -(-max(rows, 1) // left))


def _mixed(t: Column, factor) -> Column:
    return (((t * t) % _long(PRIME) + t) * factor) % _long(PRIME)


def _pass(place: Column, left: int, right: int, seed: int) -> Column:
    """One pass of the permutation inside one expression, for the few rows that walk."""
    steps = F.array(*[
        F.struct(_long(key).alias("k"), _long(factor).alias("f"), _long(right if i % 2 else left).alias("m"))
        for i, (key, factor) in enumerate(rounds(seed))
    ])
    start = F.struct(F.floor(place / _long(right)).cast("long").alias("p"), (place % _long(right)).alias("q"))
    return F.aggregate(
        steps,
        start,
        lambda s, r: F.struct(
            s["q"].alias("p"), ((s["p"] + _mixed((s["q"] + r["k"]) % _long(PRIME), r["f"])) % r["m"]).alias("q")
        ),
        lambda s: s["p"] * _long(right) + s["q"],
    )


def permute(df: DataFrame, column: str, rows: int, seed: int) -> DataFrame:
    """Replace ``column`` (0 .. rows-1) by its place under a seeded permutation.

    Halves are residues of the grid's sides. Cycle walking: a place beyond
    ``rows`` is permuted again until it falls inside. Less than one place in
    ``sqrt(rows)`` is outside, and a walk cannot be longer than the number of
    places outside, so the last expression always ends inside.
    """
    left, right = sides(rows)
    spare = left * right - rows
    names = [c for c in df.columns if c != column]
    kept = [quoted(c) for c in names]
    v = quoted(column)
    df = df.select(*kept, ((v - v % _long(right)) / _long(right)).cast("long").alias("_x"), (v % _long(right)).alias("_y"))
    for i, (key, factor) in enumerate(rounds(seed)):
        # one projection for the shared term, one for the round: terms are not repeated
        source, target, side = ("_x", "_y", right) if i % 2 else ("_y", "_x", left)
        df = df.select(*kept, "_x", "_y", ((F.col(source) + _long(key)) % _long(PRIME)).alias("_t"))
        moved = ((F.col(target) + _mixed(F.col("_t"), _long(factor))) % _long(side)).alias(target)
        df = df.select(*kept, source, moved)
    df = df.select(*kept, (F.col("_x") * _long(right) + F.col("_y")).alias("_v"))
    for most in sorted({min(SHORT_WALK, spare), spare} - {0}):
        walked = F.aggregate(
            F.sequence(F.lit(1), F.lit(most)),
            F.col("_v"),
            lambda held, _: F.when(held < _long(rows), held).otherwise(_pass(held, left, right, seed)),
        )
        df = df.select(*kept, F.when(F.col("_v") < _long(rows), F.col("_v")).otherwise(walked).alias("_v"))
    return df.select(*kept, F.col("_v").alias(column))


def shard_rows(df: DataFrame, order: Sequence[str], shards: int, seed: int = 0) -> DataFrame:
    """All rows and columns of ``df`` plus ``shard`` (int) and ``slot`` (long).

    ``order``: columns that number the rows. Nulls come first; rows that are
    equal in ``order`` are numbered in the order they are read, so ``order``
    should tell different rows apart. Input columns called ``shard`` or
    ``slot`` are replaced. No rows give no rows. Pass the narrow columns that
    shards are cut by; a hot key is split, its rows differ in the last sort
    column.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    names = [c for c in df.columns if c not in ("shard", "slot")]
    # private names: the input may hold any others
    held = {c: f"_c{i}" for i, c in enumerate(names)}
    rows = df.select(*[quoted(c).alias(held[c]) for c in names]).withColumn("_tie", F.monotonically_increasing_id())
    keys = [held[c] for c in order] + ["_tie"]
    place = F.monotonically_increasing_id()
    numbered = stage(
        rows.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .drop("_tie")
        .withColumn("_place", place)
        .withColumn("_part", F.shiftrightunsigned("_place", 33))
        .withColumn("_index", F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_place"),
        "numbered",
    )
    sizes = numbered.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    # one row per range partition
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), _long(0)).alias("_off"))
    total = numbered.count()
    placed = numbered.join(offsets, "_part").select(
        *held.values(), (F.col("_off") + F.col("_index")).alias("_p")
    )
    placed = permute(placed, "_p", total, seed)
    return placed.select(
        *[quoted(v).alias(c) for c, v in held.items()],
        (F.col("_p") % _long(shards)).cast("int").alias("shard"),
        ((F.col("_p") - F.col("_p") % _long(shards)) / _long(shards)).cast("long").alias("slot"),
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard, each sorted by slot; every row moves once."""
    (
        sharded.repartitionByRange("shard", "slot")
        .sortWithinPartitions("shard", "slot")
        .write.mode("overwrite")
        .partitionBy("shard")
        .parquet(path)
    )

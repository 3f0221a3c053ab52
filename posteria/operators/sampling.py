"""Subsets, splits, folds and seeded orders."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from posteria.functions.seeded import normal, seeded_hash, uniform
from posteria.operators.joins import join_groups
from posteria.operators.ranks import hash_cuts, key_ranks, prefix_sums
from posteria.session import stage


def take_first(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """First n rows of an order (each task keeps only its own best n)."""
    return df.orderBy(*order).limit(n)


def _at_places(df: DataFrame, order: Sequence[str], wanted: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows at the places that ``wanted`` leaves of a table with ``position``, with what it adds.

    Only the order and a hash of each row are sorted and written, however wide
    the table; the rows themselves are fetched by these. Ties go by the hash,
    and rows that are equal in all columns stand for each other.
    """
    names = {f"_at{i}": c for i, c in enumerate(order)}
    keyed = df.select("*", *[F.col(c).alias(n) for n, c in names.items()], F.xxhash64(*df.columns).alias("_row"))
    key = [*names, "_row"]
    places = stage(wanted(key_ranks(keyed.select(*key), key, key)), "places")
    rows = join_groups(keyed, places.select(*key).distinct(), key, "left_semi").dropDuplicates(key)
    return join_groups(places, rows, key).drop(*key)


def systematic_sample(df: DataFrame, order: Sequence[str], each: int, skip: int = 0) -> DataFrame:
    """Rows i of the order with ``(i + skip) % each == 0``; ties take the places they get, each one row."""
    every = lambda ranked: ranked.filter(F.pmod(F.col("position") + skip, F.lit(each)) == 0)
    return _at_places(df, order, every).select(*df.columns)


def select_positions(df: DataFrame, order: Sequence[str], positions: Sequence[int]) -> DataFrame:
    """Rows at the given 0-based positions of the order, one for each request.

    Adds ``position`` and ``request``, the place of the position in the list:
    a repeated position gives its row again, and sorting by ``request`` gives
    the rows as they were asked for.
    """
    asked = [(int(p), i) for i, p in enumerate(positions)]
    wanted = df.sparkSession.createDataFrame(asked, "position long, request long")
    found = _at_places(df, order, lambda ranked: ranked.join(wanted, "position"))
    return found.select(*df.columns, "position", "request")


def evenly_spaced(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """n positions from the first to the last row, evenly spaced, truncated."""
    total = df.count()
    if total == 0 or n < 1:
        nothing = F.lit(None).cast("long")
        return df.select("*", nothing.alias("position"), nothing.alias("request")).limit(0)
    step = (total - 1) / (n - 1) if n > 1 else 0.0
    spots = [int(i * step) for i in range(n - 1)] + [total - 1] if n > 1 else [0]
    return select_positions(df, order, spots)


def select_objects(df: DataFrame, ids: Sequence[str], tile: str = "tile_id", number: str = "number") -> DataFrame:
    """Objects named ``'tile-number'``, one row per request, with ``request``."""
    spark: SparkSession = df.sparkSession
    asked = spark.createDataFrame([(i, s) for i, s in enumerate(ids)], "request int, id string")
    parts = F.split("id", "-")
    asked = asked.select(
        "request", parts[0].cast("long").alias(tile), parts[1].cast("long").alias(number)
    )
    return df.join(F.broadcast(asked), [tile, number])


def seeded_order(df: DataFrame, keys: Sequence[str], seed: int = 42, out: str = "shuffle_key") -> DataFrame:
    """Add the key that orders rows as one reproducible shuffle."""
    return df.withColumn(out, seeded_hash(list(keys), seed))


def _with_cuts(df: DataFrame, by: Sequence[str], keys: Sequence[str], seed: int, positions) -> DataFrame:
    hashed = seeded_order(df, keys, seed, "_hash")
    cuts = hash_cuts(hashed, by, "_hash", positions)
    if by:
        # one row per class, staged: broadcast by its known size, else a plain join
        return join_groups(hashed, stage(cuts, "cuts"), list(by), "left")
    found = cuts.first()  # one row: the cuts become literals of a plain projection
    if found is None:
        return hashed.withColumn("_n", F.lit(0)).withColumn("cuts", F.lit(None).cast("array<string>"))
    return hashed.withColumn("_n", F.lit(found["_n"])).withColumn(
        "cuts", F.array(*[F.lit(c) for c in found["cuts"]]).cast("array<string>")
    )


def _first_places(df: DataFrame, by: list[str], keys: Sequence[str], seed: int, place) -> DataFrame:
    """Add ``_n`` and ``_first``: whether the row is among the first ``place`` of its group in seeded order.

    Rows that repeat a key share its hash. Where a cut falls among them, they go
    by a hash of the row, and equal rows are counted before they are placed, so
    that the number is exact and no key is too hot.
    """
    hashed = seeded_order(df, keys, seed, "_hash")
    cuts = stage(hash_cuts(hashed, by, "_hash", F.array(place)), "cuts")  # one row per group
    cuts = cuts.select(*by, "_n", F.col("cuts")[0].alias("_cut"), F.col("among")[0].alias("_among"), F.col("same")[0].alias("_same"))
    torn = F.col("_among") < F.col("_same")
    marked = join_groups(hashed, cuts, by, "left") if by else hashed.join(cuts, F.lit(True), "left")  # one row
    marked = marked.withColumn("_n", F.coalesce("_n", F.lit(0).cast("long")))
    below = F.col("_hash") < F.col("_cut")
    at = F.coalesce(F.col("_hash") == F.col("_cut"), F.lit(False))
    if not cuts.filter(torn).head(1):
        return marked.select(*df.columns, "_n", F.coalesce(below | at, F.lit(False)).alias("_first"))
    edge = at & torn
    rest = marked.filter(~F.coalesce(edge, F.lit(False))).select(*df.columns, "_n", F.coalesce(below | at, F.lit(False)).alias("_first"))
    groups = [f"_b{i}" for i in range(len(by))]
    copies = marked.filter(edge).groupBy(*df.columns, "_n", "_among").agg(F.count(F.lit(1)).alias("_c"))
    copies = copies.select("*", *[F.col(c).alias(g) for g, c in zip(groups, by)], F.xxhash64(*df.columns).alias("_row"))
    placed = prefix_sums(copies, groups, ["_row"], ["_c"])
    mine = F.col("_among") - (F.col("_c_cum") - F.col("_c"))  # how many of these copies are still first
    split = placed.select(*df.columns, "_n", mine.alias("_mine"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("_c"))).alias("_i"))
    return rest.unionByName(split.select(*df.columns, "_n", (F.col("_i") <= F.col("_mine")).alias("_first")))


def train_valid_split(df: DataFrame, keys: Sequence[str], fraction: float = 0.10, seed: int = 42) -> DataFrame:
    """Add ``split``; exactly ceil(fraction * n) rows are 'valid', also where keys repeat."""
    return stratified_split(df, keys, [], fraction, seed)


def stratified_split(
    df: DataFrame, keys: Sequence[str], by: str | Sequence[str], fraction: float = 0.10, seed: int = 42
) -> DataFrame:
    """Per-class holdout of exactly ceil(fraction * n) rows; classes with fewer than two members are dropped. Null is a class."""
    by = [by] if isinstance(by, str) else list(by)
    marked = _first_places(df, by, keys, seed, F.ceil(F.col("_n") * F.lit(fraction)))
    if by:
        marked = marked.filter(F.col("_n") >= 2)
    return marked.select(*df.columns, F.when(F.col("_first"), "valid").otherwise("train").alias("split"))


def threshold_split(df: DataFrame, keys: Sequence[str], fraction: float = 0.10, seed: int = 42) -> DataFrame:
    """Single-pass split by hash value: about ``fraction`` of the rows are 'valid'."""
    cut = format(int(fraction * 16**8), "08x")
    valid = F.substring(seeded_hash(list(keys), seed), 1, 8) < cut
    return df.withColumn("split", F.when(valid, "valid").otherwise("train"))


def kfold(
    df: DataFrame, keys: Sequence[str], k: int = 8, repeats: int = 1,
    stratify: str | None = None, seed: int = 42,
) -> DataFrame:
    """Add ``repeat`` and ``fold`` (0-based); rows are repeated once per repeat. Rows that repeat a key share its fold."""
    by = [stratify] if stratify else []
    size = F.floor(F.col("_n") / k)
    spare = F.col("_n") % k
    # last place of every fold but the final one; the first folds take the spare rows
    ends = F.transform(F.sequence(F.lit(1), F.lit(k - 1)), lambda i: i * size + F.least(i, spare))
    parts = []
    for r in range(repeats):
        marked = _with_cuts(df, by, keys, seed + r, ends)
        fold = F.when(
            F.col("cuts").isNotNull(), F.size(F.filter("cuts", lambda c: c < F.col("_hash")))
        ).otherwise(0)
        parts.append(marked.select(*df.columns, F.lit(r).alias("repeat"), fold.cast("int").alias("fold")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def undersample(
    df: DataFrame, keys: Sequence[str], by: str, seed: int = 42, replacement: bool = False
) -> DataFrame:
    """Every class down to the size of the smallest, whole rows.

    With ``replacement`` each class is drawn that many times at random places
    of its seeded order, so rows may repeat; ``pick`` numbers the draws.
    """
    smallest = df.groupBy(by).agg(F.count(F.lit(1)).alias("_size")).agg(F.min("_size")).first()[0]
    if replacement:
        ordered = seeded_order(df, keys, seed, "_hash").select(by, *keys, "_hash", F.lit(1).alias("_one"))
        ranked = prefix_sums(ordered, [by], ["_hash"], ["_one"]).withColumnRenamed("_one_cum", "_rank")
        sizes = df.groupBy(by).agg(F.count(F.lit(1)).alias("_n"))
        # draws are numbered by a distributed range; classes, a short list, are added to each number
        numbers = df.sparkSession.range(1, int(smallest or 0) + 1).withColumnRenamed("id", "pick")
        classes = [F.struct(F.lit(r[0]).cast(df.schema[by].dataType).alias(by), F.lit(r[1]).alias("_n")) for r in sizes.collect()]
        if not classes:
            return df.withColumn("pick", F.lit(None).cast("long")).limit(0)
        picks = numbers.select("pick", F.inline(F.array(*classes)))
        spot = F.floor(uniform([by, "pick"], seed) * F.col("_n")) + 1
        drawn = join_groups(picks.select(by, "pick", spot.alias("_rank")), ranked.select(by, *keys, "_rank"), [by, "_rank"])
        return join_groups(df, drawn.select(by, *keys, "pick"), [by, *keys])
    if smallest is None:
        return df
    return _first_places(df, [by], keys, seed, F.lit(int(smallest))).filter("_first").select(*df.columns)


def perturb(df: DataFrame, keys: Sequence[str], features: Sequence[str], draw: int, error_suffix: str = "__err") -> DataFrame:
    """One input-noise draw: each feature gets Normal(0, error) noise, seeded by key and draw."""
    streams = {f: draw * len(features) + i for i, f in enumerate(features)}
    new = {f: F.col(f) + F.col(f + error_suffix) * normal(list(keys), streams[f]) for f in features}
    return df.select(*[new[c].alias(c) if c in new else F.col(c) for c in df.columns])

"""Synthetic minority rows on the segments between in-class neighbours."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posteria.functions.seeded import uniform
from posteria.operators.joins import join_groups
from posteria.operators.neighbors import knn
from posteria.operators.ranks import hash_cuts
from posteria.operators.sampling import seeded_order
from posteria.session import stage


def smote(
    df: DataFrame, key: str | Sequence[str], by: str, feats: Sequence[str], carried: Sequence[str] = (),
    k: int = 5, seed: int = 42, **how,
) -> DataFrame:
    """Bring every class to the size of the largest.

    Returns the input rows with ``synthetic`` 0 and the made ones with 1..n
    (their ``key`` columns are the base row's). A made row is
    ``x + u (neighbour - x)`` with one ``u`` for the whole row, so features and
    ``carried`` numbers (errors, targets) stay consistent. Base rows take turns
    in a seeded order. Rows without a class are returned and not balanced.
    """
    keys = [key] if isinstance(key, str) else list(key)
    counts = df.filter(F.col(by).isNotNull()).groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    sizes = {r[by]: r["n"] for r in counts.collect()}  # classes
    most = max(sizes.values(), default=0)
    short = {c: most - n for c, n in sizes.items() if n < most}
    single = [c for c in short if sizes[c] < 2]
    if single:
        raise ValueError(f"classes with one member have no neighbours: {single}")
    names = [*feats, *carried]
    real = df.select(*keys, by, *names, F.lit(0).alias("synthetic"))
    if not short:
        return real

    # neighbours are found as places of rows; only the chosen one's numbers are fetched
    minority = stage(df.filter(F.col(by).isin(list(short))).select(*keys, by, *names).withColumn("_place", F.monotonically_increasing_id()), "minority")
    per_class = lambda values: F.element_at(
        F.create_map(*[x for c, v in values.items() for x in (F.lit(c), F.lit(v))]), F.col(by)
    )
    hashed = seeded_order(minority, keys, seed, "_hash")
    spare = {c: short[c] % sizes[c] for c in short}
    cuts = stage(hash_cuts(hashed, [by], "_hash", F.array(per_class(spare))), "cuts")  # one row per class
    turns = F.when(F.col("_hash") <= F.get("cuts", F.lit(0)), 1).otherwise(0)
    base = (
        hashed.join(cuts.select(by, "cuts"), [by], "left")
        .withColumn("_copies", (per_class({c: short[c] // sizes[c] for c in short}) + turns).cast("int"))
        .filter(F.col("_copies") > 0)
    )
    own = keys[0] if len(keys) == 1 else keys
    near = knn(minority, base, own, own, feats, k, by=by, payload=["_place"], skip_self=True, **how)
    parts = [F.col("query").alias(own)] if len(keys) == 1 else [F.col("query")[c].alias(c) for c in keys]
    lists = near.groupBy(F.col(by), *parts).agg(
        F.sort_array(F.collect_list(F.struct("rank", "payload"))).alias("near")  # k entries
    )
    made = join_groups(base.drop("_place"), lists, [by, *keys]).select(
        "*", F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("synthetic")
    )
    pick = F.floor(uniform(keys, F.concat(F.lit("n"), F.col("synthetic"))) * F.size("near")).cast("int")
    made = made.withColumn("_to", F.get("near", pick)["payload"][0].cast("long")).withColumn(
        "_u", uniform(keys, F.concat(F.lit("u"), F.col("synthetic")))
    ).drop("near")
    ends = minority.select(F.col("_place").alias("_to"), *[F.col(c).cast("double").alias(f"_to_{i}") for i, c in enumerate(names)])
    made = made.join(ends, "_to", "left")
    moved = [(F.col(c) + F.col("_u") * (F.col(f"_to_{i}") - F.col(c))).alias(c) for i, c in enumerate(names)]
    return real.unionByName(made.select(*keys, by, *moved, "synthetic"))

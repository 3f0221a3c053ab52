"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posteria.session import stage


def _stars(both: DataFrame, larger: bool) -> DataFrame:
    """Tie neighbours of each node u to the least node m among u and them: the larger ones, or the smaller ones and u.

    ``both``: links (u, v); minima combine before the shuffle. They are staged,
    so that the join back is a plain one and a node of many links can be split.
    """
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    least = stage(least, "least")
    tied = both.join(least, "u")
    if larger:
        return tied.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) of every node that has a link; the component is its least node.

    Links between a node and itself and links with a null end are ignored.
    Every round is a table in the shared folder; rounds go on until the links
    are stars around the least nodes.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), F.col(a).alias("_a"), F.col(b).alias("_b"))
    edges = edges.filter("_a is not null and _b is not null and u <> v").select("u", "v").distinct()
    edges = stage(edges, "links")
    before = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).collect()[0]
        if before == now:
            break
        before = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = stage(_stars(both, larger=True).filter("u <> v").distinct(), "links")
        edges = stage(_stars(large, larger=False).filter("u <> v").distinct(), "links")
    member = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return member.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())

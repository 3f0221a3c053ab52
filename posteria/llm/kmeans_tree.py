"""Nearest neighbours through a hierarchical k-means tree, searched best bin first.

The tree is fitted on a bounded sample; every vector is put into a leaf. A
query visits leaves in the order of a priority queue of distances to centres,
as many as a calibration on sample queries needs for the wanted recall. Leaves
are cut into blocks, so a task compares a bounded number of queries with a
bounded number of vectors, whatever a leaf holds.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from posteria.llm.tables import quoted
from posteria.session import stage

SAMPLE = 20_000  # vectors the tree is fitted on (expected; picked by a hash of the id)
BRANCHES = 8
LEAF = 100  # a node of fewer sample vectors is not split
ROUNDS = 12
RECALL = 0.98  # wanted on the calibration queries
CALIBRATION = 256  # queries
BLOCK = 4096  # vectors of a leaf that one task holds
CHUNK = 2048  # queries of a leaf that one task holds


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances by a matrix product: for choosing, not for reporting."""
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T), 0.0)


class Tree:
    """Nodes are numbered; inner nodes have centres and children, leaves a leaf number."""

    def __init__(self, sample: np.ndarray, branches: int = BRANCHES, leaf: int = LEAF):
        self.centres: list[np.ndarray | None] = []
        self.children: list[list[int]] = []
        self.leaf_of: list[int] = []
        self.leaves = 0
        self._grow(np.unique(sample, axis=0), branches, leaf)

    def _grow(self, points: np.ndarray, branches: int, leaf: int) -> int:
        node = len(self.centres)
        self.centres.append(None)
        self.children.append([])
        self.leaf_of.append(-1)
        groups = self._split(points, branches) if len(points) > leaf else []
        if len(groups) < 2:
            self.leaf_of[node] = self.leaves
            self.leaves += 1
            return node
        self.centres[node] = np.array([points[g].mean(0) for g in groups])
        self.children[node] = [self._grow(points[g], branches, leaf) for g in groups]
        return node

    @staticmethod
    def _split(points: np.ndarray, branches: int) -> list[np.ndarray]:
        """k-means from spread-out starts: each next start is the point farthest from those before."""
        starts = [0]
        nearest = distances(points, points[:1])[:, 0]
        while len(starts) < min(branches, len(points)):
            far = int(nearest.argmax())
            if nearest[far] <= 0:
                break
            starts.append(far)
            nearest = np.minimum(nearest, distances(points, points[far : far + 1])[:, 0])
        centres = points[starts]
        for _ in range(ROUNDS):
            owner = distances(points, centres).argmin(1)
            centres = np.array([points[owner == i].mean(0) if (owner == i).any() else c for i, c in enumerate(centres)])
        owner = distances(points, centres).argmin(1)
        return [g for i in range(len(centres)) if len(g := np.flatnonzero(owner == i))]

    def assign(self, points: np.ndarray) -> np.ndarray:
        """Leaf of each point, always to the nearest centre."""
        out = np.zeros(len(points), np.int64)
        todo = [(0, np.arange(len(points)))]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            if self.leaf_of[node] >= 0:
                out[rows] = self.leaf_of[node]
                continue
            # differences, not a product: equal vectors must take equal ways
            owner = np.stack([((points[rows] - c) ** 2).sum(1) for c in self.centres[node]], 1).argmin(1)
            todo += [(child, rows[owner == i]) for i, child in enumerate(self.children[node])]
        return out

    def order(self, query: np.ndarray) -> Iterator[int]:
        """Leaves best bin first: nodes wait in a queue by the distance to their centre."""
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            if self.leaf_of[node] >= 0:
                yield self.leaf_of[node]
                continue
            gaps = ((self.centres[node] - query) ** 2).sum(1)
            for gap, child in zip(gaps.tolist(), self.children[node]):
                heapq.heappush(queue, (gap, child))

    def calibrate(self, queries: np.ndarray, sample: np.ndarray, k: int, recall: float) -> int:
        """Leaf visits, widened until the ``k`` true neighbours within the sample are found often enough."""
        if not len(queries) or len(sample) < 2:
            return 1
        leaf = self.assign(sample)
        ranks = []
        for query in queries:
            gaps = ((sample - query) ** 2).sum(1)
            gaps[gaps == 0] = np.inf  # the query itself and its copies lie in its own leaf
            near = np.argsort(gaps, kind="stable")[:k]
            place = {x: i for i, x in enumerate(self.order(query))}
            ranks += [place[leaf[i]] for i in near if np.isfinite(gaps[i])]
        visits, ranks = 1, np.array(ranks)
        while visits < self.leaves and len(ranks) and (ranks < visits).mean() < recall:
            visits += max(1, visits // 8)
        return min(visits, self.leaves)


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of the rows that take part: an id, and a vector without null or non-finite components that is not zero."""
    v = F.col("v")
    rows = df.select(quoted(id_col).cast("long").alias("id"), quoted(vector_col).cast("array<double>").alias("v"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(F.col("id").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0.0))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 10,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    sample: int = SAMPLE,
    recall: float = RECALL,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest vectors found for every query, nearest first.

    Score: Euclidean distance in double precision; ties go to the smaller id.
    ``queries`` has the columns of ``vectors``; a query never finds a row of its
    own id. Vectors that are null, zero, or hold null or non-finite components
    take no part, nor do rows of a null id, nor vectors of another length than
    most have. A query gets ``k`` rows, or all candidates if there are fewer.
    Empty tables give no rows.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    rows = usable(vectors, id_col, vector_col)
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], schema)
    dim, total = lengths[0]["d"], lengths[0]["count"]
    rows = rows.filter(F.size("v") == dim)
    asked = usable(queries, id_col, vector_col).filter(F.size("v") == dim)
    part = lambda df, n, of: df.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < F.lit(int(min(1.0, n / max(of, 1)) * (1 << 30))))
    held = np.array([r["v"] for r in part(rows, sample, total).collect()], float).reshape(-1, dim)
    if not len(held):
        held = np.array([r["v"] for r in rows.limit(1).collect()], float).reshape(-1, dim)
    tree = Tree(held)
    trial = np.array([r["v"] for r in part(asked, CALIBRATION, asked.count()).collect()], float).reshape(-1, dim)
    visits = tree.calibrate(trial, np.unique(held, axis=0), k, recall)
    shared = spark.sparkContext.broadcast(tree)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                points = _matrix(batch.column(1), dim)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(shared.value.assign(points)), pa.array([p.tobytes() for p in points], pa.binary())],
                    names=["id", "leaf", "v"],
                )

    leafed = stage(rows.mapInArrow(place, "id long, leaf long, v binary"), "leaves")
    counts = np.zeros(tree.leaves, np.int64)  # a number for each leaf of the tree
    for r in leafed.groupBy("leaf").count().collect():
        counts[r["leaf"]] = r["count"]

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, leaves, points = [], [], []
            for query, point in zip(batch.column(0).to_pylist(), _matrix(batch.column(1), dim) if batch.num_rows else ()):
                seen = found = 0
                for leaf in shared.value.order(point):
                    if seen >= visits and found > k:
                        break
                    seen += 1
                    found += counts[leaf]
                    if counts[leaf]:
                        ids.append(query)
                        leaves.append(leaf)
                        points.append(point.tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(leaves, pa.int64()), pa.array(points, pa.binary())], names=["id", "leaf", "v"]
            )

    visited = stage(asked.mapInArrow(visit, "id long, leaf long, v binary"), "visits")
    # cells of bounded size: blocks of a leaf's vectors, chunks of its queries
    blocks = leafed.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("long").alias("blocks"))
    chunks = visited.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / F.lit(CHUNK)).cast("long").alias("chunks"))
    cells = F.broadcast(blocks.join(chunks, "leaf"))  # a row for each leaf of the tree
    some = F.xxhash64("id")
    left = visited.join(cells, "leaf").select(
        "leaf", F.pmod(some, "chunks").alias("chunk"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "id", "v"
    )
    right = leafed.join(cells, "leaf").select(
        "leaf", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), F.pmod(some, "blocks").alias("block"), "id", "v"
    )

    def compare(asked_here: pa.Table, there: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if asked_here.num_rows and there.num_rows:
            matrix = lambda t: np.frombuffer(b"".join(t.column("v").to_pylist())).reshape(-1, dim)
            ids = lambda t: t.column("id").to_numpy()
            q, v, qid, vid = matrix(asked_here), matrix(there), ids(asked_here), ids(there)
            for start in range(0, len(q), 256):
                gaps = distances(q[start : start + 256], v)
                for i, row in enumerate(gaps, start):
                    other = np.flatnonzero(vid != qid[i])
                    if len(other) > k:
                        edge = np.partition(row[other], k - 1)[k - 1]
                        # whatever rounding of the product could have put behind the border
                        other = other[row[other] <= edge + 1e-9 * (1.0 + (q[i] @ q[i]) + edge)]
                    exact = np.sqrt(((v[other] - q[i]) ** 2).sum(1))
                    best = np.lexsort((vid[other], exact))[:k]
                    out[0] += [int(qid[i])] * len(best)
                    out[1] += vid[other[best]].tolist()
                    out[2] += exact[best].tolist()
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

    cell = ["leaf", "chunk", "block"]
    found = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(compare, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

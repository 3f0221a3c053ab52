import numpy as np
import pytest
from pyspark.sql import functions as F

from posteria.llm import kmeans_tree
from tests.conftest import SF_DIR

SCHEMA = "vec_id long, embedding array<float>, label int, leaf int"


def brute(ids, points, queries, k):
    out = {}
    for q in queries:
        gaps = np.sqrt(((points - points[q]) ** 2).sum(1))
        order = [i for i in np.lexsort((ids, gaps)) if ids[i] != ids[q]][:k]
        out[int(ids[q])] = [(int(ids[i]), gaps[i]) for i in order]
    return out


def found(df, queries, **more):
    got = {}
    for r in kmeans_tree.nearest(df, queries, **more).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(got[r["query_id"]])
    return got


def test_recall_on_the_table(spark):
    df = spark.read.parquet(SF_DIR.replace("0.001", "0.1") + "/embeddings.parquet")
    rows = df.orderBy("vec_id").collect()
    ids, points = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    want = brute(ids, points, np.flatnonzero(ids % 20 == 0), 10)
    got = found(df, df.filter(F.col("vec_id") % 20 == 0))
    assert set(got) == set(want) and all(len(g) == 10 for g in got.values())
    hits = [len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 10 for q in want]
    assert np.mean(hits) >= 0.9
    gaps = {q: dict(zip(ids.tolist(), np.sqrt(((points - points[ids == q]) ** 2).sum(1)))) for q in want}
    assert all(s == pytest.approx(gaps[q][i], abs=1e-12) for q, g in got.items() for i, s in g)


def test_copies_ties_and_bounded_cells(spark, monkeypatch):
    monkeypatch.setattr(kmeans_tree, "BLOCK", 16)
    monkeypatch.setattr(kmeans_tree, "CHUNK", 8)
    rnd = np.random.default_rng(5)
    points = np.round(rnd.normal(size=(120, 3)), 1).astype(np.float32).astype(float)
    points[40:100] = points[40]  # half of all rows are one vector
    points[(points == 0).all(1)] = 1.0
    ids = rnd.permutation(1000)[:120]
    rows = [(int(i), [float(x) for x in p], 1, 2) for i, p in zip(ids, points)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(df, df, k=10, recall=1.0) == {q: [(i, pytest.approx(s)) for i, s in w] for q, w in brute(ids, points, range(120), 10).items()}


def test_rows_that_take_no_part_and_few_candidates(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [2.0, 0.0]), (3, [2.5, 0.0]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [nan, 1.0]),
            (8, [inf, 1.0]), (9, [None, 1.0]), (10, [1.0, 2.0, 3.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame([(i, v, None, None) for i, v in rows], SCHEMA)
    got = found(df, df)
    assert set(got) == {1, 2, 3}
    assert [i for i, _ in got[1]] == [3, 2, 3] and got[1][0][1] == 1.0
    assert found(df.limit(0), df.limit(0)) == {} and found(df, df.limit(0)) == {}
    assert found(df.filter("vec_id = 1"), df) in ({2: [(1, pytest.approx(2**0.5))], 3: [(1, 1.0), (1, 1.5)]}, {2: [(1, pytest.approx(2**0.5))], 3: [(1, pytest.approx(1.0))]})


def test_best_bin_first_visits_every_leaf_once():
    rnd = np.random.default_rng(1)
    points = rnd.normal(size=(2000, 4))
    tree = kmeans_tree.Tree(points, leaf=20)
    for q in points[:20]:
        order = list(tree.order(q))
        assert sorted(order) == list(range(tree.leaves))
    assert set(tree.assign(points).tolist()) <= set(range(tree.leaves))
    assert tree.calibrate(points[:50], points, 10, 1.0) >= tree.calibrate(points[:50], points, 10, 0.5) >= 1
    assert kmeans_tree.Tree(np.ones((500, 3))).leaves == 1

import itertools
import random
import re

import numpy as np
import pytest

from posteria.llm import minhash
from posteria.llm.components import components


def brute_sets(texts, n):
    out = []
    for text in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        out.append(set(zip(*[words[i:] for i in range(n)])) if len(words) >= n else ({tuple(words)} if words else set()))
    return out


def brute_components(ids, sets, percent):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (i, a), (j, b) in itertools.combinations(zip(ids, sets), 2):
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            x, y = find(i), find(j)
            parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("words", [1, 2, 5])
def test_sets_equal_plain_ones(words):
    texts = ["", "  ", "One", "one two", "a b a b a b", "ÄÖ x ÄÖ\tb\x0bc\x1cd", "a B C d e f g a b c d e", "\n\n", "x " * 5000]
    got = minhash.shingle_sets([t.encode() for t in texts], words)
    want = brute_sets(texts, words)
    assert [len(g) for g in got] == [len(w) for w in want]
    seen = {}
    for g, w in zip(got, want):
        assert seen.setdefault(frozenset(w), g.tobytes()) == g.tobytes()


def test_texts_longer_than_a_piece(monkeypatch):
    text = ("word " * 60 + "x" * 700 + " ") * 3 + "end of it"
    whole = minhash.shingle_sets([text.encode()], 2)[0]
    monkeypatch.setattr(minhash, "PIECE", 256)
    cut = minhash.shingle_sets([text.encode(), b"a b"], 2)
    assert len(cut[0]) == len(whole) == len(brute_sets([text], 2)[0])


def test_densified_signatures_estimate_similarity():
    rnd = np.random.default_rng(2)
    for size in (3, 40, 2000):
        agree = []
        for _ in range(60):
            shared = rnd.integers(0, 2**64, 4 * size, dtype=np.uint64)
            own = rnd.integers(0, 2**64, (2, size // 2 or 1), dtype=np.uint64)
            sign = minhash.signatures([np.unique(np.concatenate((shared, o))) for o in own], minhash.BINS)
            assert (sign != minhash.EMPTY).all()
            agree.append((sign[0] == sign[1]).mean())
        similarity = 4 * size / (4 * size + 2 * (size // 2 or 1))
        assert abs(np.mean(agree) - similarity) < 0.04
    assert (minhash.signatures([np.zeros(0, np.uint64)], 10) == minhash.EMPTY).all()


def family(rnd, base, edits):
    words = list(base)
    for _ in range(edits):
        words[rnd.randrange(len(words))] = f"n{rnd.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("block", [minhash.BLOCK, 3])  # a centre in one cell, and in many
def test_components_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    rnd = random.Random(7)
    texts = []
    for _ in range(6):
        base = [f"w{rnd.randrange(4000)}" for _ in range(rnd.choice([12, 60, 120]))]
        texts += [family(rnd, base, rnd.randint(0, len(base) // 8)) for _ in range(12)]
    for _ in range(2):  # drifting copies: each like the one before, the ends unlike
        words = [f"w{rnd.randrange(4000)}" for _ in range(100)]
        for step in range(25):
            words[(7 * step) % 100] = f"d{rnd.randrange(10**6)}"
            texts.append(" ".join(words))
    texts += [texts[3]] * 30 + ["one", "one", "One two", "", None, " "]
    rnd.shuffle(texts)
    ids = rnd.sample(range(1000), len(texts))
    sets = brute_sets(texts, 2)
    want = brute_components(ids, sets, 80)
    df = spark.createDataFrame([(i, t, 5) for i, t in zip(ids, texts)], "doc_id long, text string, component_id int")
    out = minhash.near_duplicates(df, words=2, percent=80).collect()
    assert len(out) == len(texts)
    sizes = {i: len(s) for i, s in zip(ids, sets)}
    for r in out:
        i = r["doc_id"]
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (sizes[i], want[i], want[i] == i)


def test_counts_never_rule_out_a_link():
    import pyarrow as pa

    rnd = np.random.default_rng(4)
    hub = np.unique(rnd.integers(0, 2**64, 150, dtype=np.uint64))
    fresh = lambda n: rnd.integers(0, 2**64, n, dtype=np.uint64)
    pool = [np.unique(np.concatenate((rnd.choice(hub, rnd.integers(90, 151), replace=False), fresh(rnd.integers(0, 40))))) for _ in range(60)]
    pool += [np.unique(np.concatenate((x[rnd.random(len(x)) < 0.95], fresh(3)))) for x in pool[:30]]
    batch = pa.RecordBatch.from_arrays(
        [pa.array([0] * 90), pa.array(range(1, 91)), pa.array([hub.tobytes()] * 90, pa.binary()), pa.array([x.tobytes() for x in pool], pa.binary())],
        names=["a", "b", "left", "right"],
    )
    counts = [c for out in minhash._compared([batch], 80) for c in out.column("counts").to_pylist()]
    rows = pa.table({"id": pa.array(range(90)), "counts": pa.array(counts, pa.binary()), "component": pa.array(range(90))})
    got = minhash._possible(rows, rows, 80).to_pylist()
    made = {(r["a"], r["b"]) for r in got}
    want = set()
    for i, j in itertools.combinations(range(90), 2):
        shared = len(np.intersect1d(pool[i], pool[j]))
        if 100 * shared >= 80 * (len(pool[i]) + len(pool[j]) - shared):
            want.add((i, j))
    assert want <= made and len(want) >= 25 and len(made) < 800  # of 4005 pairs


def test_null_and_repeated_ids_and_no_rows(spark):
    rows = [(None, "a b c d e f"), (None, None), (4, "a b c d e f"), (4, "q r s t u v"), (9, "q r s t u v"), (11, "zz")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = minhash.near_duplicates(df, words=2).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in out) == [
        (0, 0, True), (0, 0, True), (4, 4, True), (4, 4, True), (9, 4, False), (11, 11, True)]
    assert minhash.near_duplicates(df.limit(0)).collect() == []


def test_an_id_ties_all_its_texts(spark):
    rows = [(2, "q r s"), (4, "a b c"), (4, "q r s"), (4, ""), (7, "a b c"), (8, "x y z"), (8, "k l m"), (9, "x y z"), (10, "k l m"), (11, None), (11, " ")]
    out = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=2).collect()
    want = {2: 2, 4: 2, 7: 2, 8: 8, 9: 8, 10: 8, 11: 11}
    assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in out) == sorted((i, want[i], i == want[i]) for i, _ in rows)


def test_components_of_chains_stars_and_rings(spark):
    rnd = random.Random(1)
    links = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(200, 260)] + [(300, 301), (301, 302), (302, 300), (5, 5), (None, 3)]
    rnd.shuffle(links)
    links = [(b, a) if rnd.random() < 0.5 else (a, b) for a, b in links]
    out = components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()
    got = {r["node"]: r["component"] for r in out}
    assert len(out) == len(got)
    want = {i: 100 for i in range(100, 141)} | {i: 7 for i in [7, *range(200, 260)]} | {300: 300, 301: 300, 302: 300}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").collect() == []

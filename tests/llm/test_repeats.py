import random
from collections import Counter

import numpy as np
import pytest

from posteria.llm import repeats


def brute(texts, width):
    data = [(t or "").encode() for t in texts]
    counts = Counter(b[i : i + width] for b in data for i in range(len(b) - width + 1))
    out = []
    for b in data:
        hit = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if counts[b[i : i + width]] > 1:
                hit[i : i + width] = b"\1" * width
        spans, i = [], 0
        while i < len(b):
            if hit[i]:
                j = i
                while j < len(b) and hit[j]:
                    j += 1
                spans.append((i, j))
                i = j
            else:
                i += 1
        out.append((len(b), spans, bytes(x for x, h in zip(b, hit) if not h)))
    return out


def made(seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abé ") for _ in range(rnd.randint(1, 9)))
    passages = ["".join(word() for _ in range(rnd.randint(4, 40))) for _ in range(6)]
    texts = []
    for _ in range(60):
        parts = ["".join(word() for _ in range(rnd.randint(0, 30)))]
        for _ in range(rnd.randint(0, 3)):
            passage = rnd.choice(passages)
            low = rnd.randrange(len(passage) // 2)
            parts += [passage[low : rnd.randint(low + 1, len(passage))], word()]
        texts.append("".join(parts))
    return texts + [texts[0], texts[1], texts[1], "", None, "x" * 31, "x" * 32, "y" * 33, "ab" * 200, None]


@pytest.mark.parametrize("runs", [repeats.RUNS, 1])  # sorted in tasks, and dealt out by window
def test_equals_brute_force(spark, runs):
    texts = made(4)
    rows = [(i if i % 9 else None, t, 1, i) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept int, n int").repartition(5)
    out = repeats.remove_repeats(df, width=32, runs=runs).collect()
    want = brute(texts, 32)
    assert len(out) == len(texts) and any(s for _, s, _ in want) and set(out[0].asDict()) == {"doc_id", "text", "n", "n_bytes", "removed", "kept"}
    for r in out:
        size, spans, kept = want[r["n"]]
        assert (r["n_bytes"], [tuple(x) for x in r["removed"]], bytes(r["kept"])) == (size, spans, kept)


def test_radix_sort_keeps_exactly_the_repeated():
    rnd = np.random.default_rng(1)
    for width in (16, 21, 32):
        data = rnd.integers(0, 2, 3000).astype(np.uint8)
        at = rnd.permutation(np.arange(len(data) - width))
        group = at % 3
        seen = Counter((int(g), data[a : a + width].tobytes()) for a, g in zip(at, group))
        want = [seen[int(g), data[a : a + width].tobytes()] > 1 for a, g in zip(at, group)]
        assert repeats.radix_repeated(data, at, group, width).tolist() == want


def test_sliding_minimum():
    values = np.random.default_rng(3).integers(0, 100, 500)
    for width in (1, 2, 5, 64, 137):
        assert repeats.least(values, width).tolist() == [int(values[i : i + width].min()) for i in range(501 - width)]


def test_very_long_text_and_text_output(spark):
    rnd = random.Random(2)
    long = "".join(rnd.choice("abcdefgh ") for _ in range(2_300_000))
    part = long[1_048_300:1_048_800]  # over the border of two pieces
    df = spark.createDataFrame([(1, long), (2, "é" * 20 + part + "ü"), (3, None)], "doc_id long, text string")
    out = {r["doc_id"]: r for r in repeats.remove_repeats(df, width=200, as_text=True).collect()}
    assert [tuple(x) for x in out[1]["removed"]] == [(1_048_300, 1_048_800)]
    assert out[2]["kept"] == "é" * 20 + "ü" and out[3]["kept"] == ""
    assert repeats.remove_repeats(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        repeats.remove_repeats(df, width=8)


def test_more_crowded_runs_than_a_piece_holds(spark):
    rnd = random.Random(6)
    noise = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    line, whole = noise(190), noise(260)  # part of every window near it, and repeated itself
    texts = [noise(60) + line + noise(60) + (whole + noise(40) if i % 50 == 0 else "") for i in range(1500)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    out = repeats.remove_repeats(df, width=200, runs=1).collect()
    want = brute(texts, 200)
    assert sum(len(s) for _, s, _ in want) == 30
    for r in out:
        size, spans, kept = want[r["doc_id"]]
        assert (r["n_bytes"], [tuple(x) for x in r["removed"]], bytes(r["kept"])) == (size, spans, kept)

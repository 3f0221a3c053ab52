import random

import pytest

from posteria.llm import sharding


@pytest.mark.parametrize("rows", [1, 2, 3, 5, 16, 17, 1000])
def test_permutation_is_one_to_one(spark, rows):
    df = spark.range(rows).withColumnRenamed("id", "p")
    out = [r["p"] for r in sharding.permute(df, "p", rows, seed=3).collect()]
    assert sorted(out) == list(range(rows))
    if rows == 1000:
        assert out != list(range(rows))


def brute_place(row, rows, seed):
    left, right = sharding.sides(rows)
    v = row
    while True:
        x, y = divmod(v, right)
        for i, (key, factor) in enumerate(sharding.rounds(seed)):
            t = ((x if i % 2 else y) + key) % sharding.PRIME
            f = ((t * t % sharding.PRIME + t) * factor) % sharding.PRIME
            if i % 2:
                y = (y + f) % right
            else:
                x = (x + f) % left
        v = x * right + y
        if v < rows:
            return v


def test_matches_brute_force_and_layout_does_not_matter(spark):
    ids = list(range(333))
    random.Random(1).shuffle(ids)
    df = spark.createDataFrame([(i, f"t{i % 7}") for i in ids], "doc_id long, text string")
    want = {i: divmod(brute_place(i, 333, 5), 4) for i in ids}
    for parts in (1, 9):
        out = sharding.shard_rows(df.repartition(parts), ["doc_id"], 4, seed=5).collect()
        assert {r["doc_id"]: (r["slot"], r["shard"]) for r in out} == want
        assert {r["doc_id"]: r["text"] for r in out} == {i: f"t{i % 7}" for i in ids}


def test_slots_are_gapless_with_nulls_repeats_and_clashing_columns(spark):
    rows = [(None, "a", 1, 1)] * 5 + [(7, None, 2, 2)] * 6 + [(i, "b", 3, 3) for i in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int, `_p` int")
    out = sharding.shard_rows(df, ["doc_id"], 3).collect()
    assert len(out) == 20 and out[0].asDict().keys() == {"doc_id", "text", "shard", "slot", "_p"}
    slots = {}
    for r in out:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(s) for s in slots.values()]
    assert max(sizes) - min(sizes) <= 1


def test_more_shards_than_rows_and_no_rows(spark, tmp_path):
    df = spark.createDataFrame([(1,), (2,)], "doc_id long")
    out = sharding.shard_rows(df, ["doc_id"], 5)
    assert sorted((r["shard"], r["slot"]) for r in out.collect()) in ([(0, 0), (1, 0)],)
    assert sharding.shard_rows(df.limit(0), ["doc_id"], 5).collect() == []
    sharding.write_shards(out, str(tmp_path / "shards"))
    assert spark.read.parquet(str(tmp_path / "shards")).count() == 2
    with pytest.raises(ValueError):
        sharding.shard_rows(df, ["doc_id"], 0)

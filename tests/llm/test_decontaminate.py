import random

import pytest

from posteria.llm import decontaminate as d


def dynamic(pattern, text):
    best, row = (len(pattern), 0), list(range(len(pattern) + 1))
    for at, symbol in enumerate(text, 1):
        left, row = row, [0]
        for i, wanted in enumerate(pattern, 1):
            row.append(min(left[i] + 1, row[i - 1] + 1, left[i - 1] + (symbol != wanted)))
        if row[-1] < best[0]:
            best = (row[-1], at)
    return best


def test_bit_vectors_equal_the_dynamic_programme():
    rnd = random.Random(3)
    for _ in range(1500):
        p = [rnd.randint(1, 4) for _ in range(rnd.randint(1, 9))]
        t = [rnd.randint(0, 4) for _ in range(rnd.randint(0, 20))]
        assert d.nearest_end(p, t) == dynamic(p, t)
    p = [rnd.randint(1, 50) for _ in range(200)]
    t = [rnd.randint(1, 50) for _ in range(50)] + p[:90] + [0] + p[95:] + [7] * 30
    assert d.nearest_end(p, t) == dynamic(p, t)


def test_pieces_cover_an_item():
    for words in range(1, 80):
        budget = d.budget_of(words, d.SHARE)
        pieces = d.pieces_of(words, budget)
        assert len(pieces) == budget + 1 and pieces[0][0] == 0 and pieces[-1][1] == words
        assert all(a < b for a, b in pieces) and all(x[1] == y[0] for x, y in zip(pieces, pieces[1:]))


def edited(rnd, words, edits):
    words = list(words)
    for _ in range(edits):
        at = rnd.randrange(len(words))
        kind = rnd.randrange(3)
        if kind == 0:
            words[at] = "zz"
        elif kind == 1:
            del words[at]
        else:
            words.insert(at, "yy")
    return words


@pytest.mark.parametrize("most_words", [10**6, 40])  # one block, many blocks
def test_equals_brute_force_over_all_places(spark, most_words):
    rnd = random.Random(8)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, [rnd.choice(vocabulary) for _ in range(rnd.randint(8, 30))]) for i in range(12)]
    docs = []
    for i in range(90):
        text = [rnd.choice(vocabulary) for _ in range(rnd.randint(0, 60))]
        if i % 2:
            _, words = rnd.choice(items)
            text[len(text) // 2 : len(text) // 2] = edited(rnd, words, rnd.randint(0, 5))
        docs.append((i, " ".join(text).replace("w1 ", "W1,\n")))
    want = set()
    for doc, text in docs:
        for item, words in items:
            distance, _ = dynamic(words, d.words_of(text))
            if distance <= d.budget_of(len(words), d.SHARE):
                want.add((doc, item, distance))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(i, "  ".join(w)) for i, w in items], "item_id long, text string")
    out = d.contaminated(df, bench, most_words=most_words).collect()
    assert {(r["doc_id"], r["item_id"], r["distance"]) for r in out} == want and len(out) == len(want)
    assert len(want) > 15
    texts = dict(docs)
    for r in out:  # the place is right: its own distance is the one told
        place = d.words_of(texts[r["doc_id"]])[r["first_word"] : r["end_word"]]
        pattern = dict(items)[r["item_id"]]
        assert d.nearest_end_anchored(pattern, place)[0] == r["distance"]
    left = d.without_contaminated(df, bench, most_words=most_words).collect()
    assert {r["doc_id"] for r in left} == set(texts) - {doc for doc, _, _ in want}


def test_odd_rows(spark):
    item = "one two three four five six seven eight nine ten"
    rows = [(None, f"x {item} y", 1), (None, None, 1), (1, "", 1), (2, f"{item} " * 3000, 1), (2, f"{item} " * 3000, 1), (3, item.upper(), 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([("a", item), ("a", item), ("b", None), ("c", "one two"), (None, item)], "item_id string, text string")
    out = d.contaminated(df, bench).collect()
    assert sorted((r["doc_id"] or 0, r["item_id"] or "", r["distance"]) for r in out) == sorted(
        (k, i, 0) for k in (0, 2, 2, 3) for i in ("a", "")
    )
    left = d.without_contaminated(df, bench)
    assert left.columns == df.columns and sorted((r["doc_id"] or 0) for r in left.collect()) == [0, 1]
    assert d.contaminated(df, bench.limit(0)).collect() == [] and d.contaminated(df.limit(0), bench).collect() == []
    assert d.without_contaminated(df, bench.limit(0)).count() == 6


def test_short_items_and_scripts_without_blanks(spark, tmp_path):
    from posteria.llm import queries

    chinese, thai = "中华人民共和国的首都是北京市，对吗", "ประเทศไทยมีกรุงเทพเป็นเมืองหลวง"
    items = [("s", "Who wrote Hamlet?"), ("c", chinese), ("t", thai), ("n", "?!"), ("o", "東京")]
    docs = [(1, "so who wrote hamlet then"), (2, "who really wrote hamlet"), (3, "前文" + chinese + "后文"), (4, "ก" + thai + "ข"), (5, "?!")]
    docs += [(6, chinese.replace("首", "省")), (7, "go to 東京tower now"), (8, "東 京")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    hits = {(r["doc_id"], r["item_id"]) for r in queries.op3_decontaminate(spark, str(tmp_path)).collect()}
    assert hits == {(1, "s"), (3, "c"), (4, "t"), (6, "c"), (7, "o"), (8, "o")}
    df, bench = (spark.read.parquet(str(tmp_path / f"{t}.parquet")) for t in ("documents", "benchmark"))
    assert {r["doc_id"] for r in d.without_contaminated(df, bench, short=True).collect()} == {2, 5}


def test_one_block_is_alive_at_a_time(spark, monkeypatch):
    from pyspark import Broadcast, SparkContext

    alive, most, made = [0], [0], SparkContext.broadcast
    gone = Broadcast.destroy

    def broadcast(self, value):
        alive[0] += 1
        most[0] = max(most[0], alive[0])
        return made(self, value)

    def destroy(self, *args):
        alive[0] -= 1
        gone(self, *args)

    monkeypatch.setattr(SparkContext, "broadcast", broadcast)
    monkeypatch.setattr(Broadcast, "destroy", destroy)
    items = [(i, "\n".join(f"w{i}x{j}" for j in range(10))) for i in range(4)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert [len(b) for b in d.blocks(bench, "item_id", "text", 20)] == [2, 2]
    assert len(list(d.blocks(spark.createDataFrame([(i, f"{i}" * 4000) for i in range(4)], "item_id long, text string"), "item_id", "text", 300))) == 4
    df = spark.createDataFrame([(i, items[i % 5][1] if i % 5 < 4 else None) for i in range(10)], "doc_id long, text string")
    assert sorted((r["doc_id"], r["item_id"]) for r in d.contaminated(df, bench, most_words=10).collect()) == [(i, i % 5) for i in range(10) if i % 5 < 4]
    assert sorted(r["doc_id"] for r in d.without_contaminated(df, bench, most_words=10).collect()) == [4, 9]
    assert most == [1]

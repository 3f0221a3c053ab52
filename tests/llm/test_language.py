from collections import Counter

import numpy as np
import pytest

from posteria.llm import language
from tests.conftest import SF_DIR


def brute_rank(text):
    """n-grams of one to three, most frequent first, by plain counting."""
    letters = "".join(c.lower() if c.isalpha() else " " for c in text)
    counts = Counter()
    for word in letters.split():
        padded = "\x01" + word + "\x01"
        counts.update(word)
        counts.update(padded[i : i + 2] for i in range(len(padded) - 1))
        counts.update(padded[i : i + 3] for i in range(len(padded) - 2))
    code = lambda g: sum(ord(c) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))
    return sorted(((code(g), n) for g, n in counts.items()), key=lambda x: (-x[1], x[0]))


@pytest.mark.parametrize("text", ["Das ist ein Haus, das.", "a", "été à la  plage!", "x1y2", "Ñandú ñ ñ"])
def test_ranks_equal_plain_counting(text):
    found, counts = language.ranked(language.grams(language.spelled(text), 21), 50)
    assert list(zip(found.tolist(), counts.tolist())) == brute_rank(text)[:50]


def test_ties_at_the_border_go_to_small_codes():
    found, _ = language.ranked(np.array([5, 5, 4, 3, 2, 1]), 3)
    assert found.tolist() == [5, 1, 2]


@pytest.fixture(scope="module")
def profiles(spark):
    docs = spark.read.parquet(SF_DIR.replace("0.001", "0.01") + "/documents.parquet")
    from pyspark.sql import functions as F

    return docs, language.learn(docs.filter(~language.held_out(F.col("doc_id"))))


def test_held_out_accuracy(profiles):
    from pyspark.sql import functions as F

    docs, known = profiles
    judged = language.identify(docs, known).filter(language.held_out(F.col("doc_id"))).collect()
    right = sum(r["lang"] == r["lang_pred"] for r in judged)
    assert len(judged) > 200 and right / len(judged) > 0.97
    assert all(0 <= r["score"] <= 1 for r in judged)


def test_odd_texts_and_columns(spark, profiles):
    _, known = profiles
    rows = [(1, None, "en", 0.5), (2, "", "en", 0.5), (3, "12 !? 34", "en", 0.5), (None, "漢字", None, 0.5), (5, "the of and " * 40000, "en", 0.5), (5, "a", "en", 0.5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    out = language.identify(df, known).collect()
    assert len(out) == 6 and set(out[0].asDict()) == {"doc_id", "text", "lang", "lang_pred", "score", "margin"}
    by = {(r["doc_id"], (r["text"] or "")[:3]): r for r in out}
    assert [by[k]["lang_pred"] for k in ((1, ""), (2, ""), (3, "12 "))] == ["und"] * 3
    assert by[1, ""]["score"] == 0 and by[5, "the"]["lang_pred"] == "en"
    assert by[None, "漢字"]["lang_pred"] in known.langs
    assert language.identify(df.limit(0), known).collect() == []


def test_nothing_learned(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    known = language.learn(empty)
    df = spark.createDataFrame([(1, "some text", "en")], "doc_id long, text string, lang string")
    assert language.identify(df, known, keep=["doc_id"]).collect()[0]["lang_pred"] == "und"
    # one language only, and labels without letters
    known = language.learn(spark.createDataFrame([(1, "abc", "xx"), (2, "12", "yy"), (3, None, "zz"), (4, "d", None)], empty.schema))
    assert known.langs == ["xx"]
    assert language.identify(df, known).collect()[0]["lang_pred"] == "xx"


def test_an_id_of_many_rows_is_one_of_the_sample(spark):
    rows = [(1, f"unu du tri kvar {i} zzz", "eo") for i in range(300)] + [(i, "the of and that this", "en") for i in range(2, 40)] + [(1, "unu du", "eo")] * 50
    learned = language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample=4)
    once = language.learn(spark.createDataFrame([r for r in rows if r[2] == "en"] + [rows[0]], "doc_id long, text string, lang string"), sample=4)
    assert learned.langs == once.langs == ["en", "eo"]
    # one text of three or four words has few n-grams, three hundred numbered ones have many
    assert (learned.ranks[:, learned.langs.index("eo")] >= 0).sum() < 60

import math
import random

import pytest

from posteria.llm import lexical, queries
from registry import compare
from tests.conftest import SF_DIR


def brute(docs, items, k):
    """(item_id, rank, doc_id, score) by the formula, one document after another."""
    held = [(i, lexical.terms_of(t)) for i, t in docs]
    held = [(i, terms) for i, terms in held if terms]
    n, total = len(held), sum(len(terms) for _, terms in held)
    out = []
    for item, text in items:
        found = []
        for doc, terms in held:
            m, score = 25 + (75 * len(terms) * n) // total, 0
            for term in lexical.terms_of(text):
                tf, df = terms.count(term), sum(term in other for _, other in held)
                if tf:
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1))) * ((10**9 * tf) // (1000 * tf + 8 * m))
            if score > 0:
                found.append((-score, doc is not None, doc or 0, doc))
        out += [(item, rank, doc, -s) for rank, (s, _, _, doc) in enumerate(sorted(found, key=lambda f: f[:3])[:k], 1)]
    return out


def test_terms():
    assert lexical.terms_of("Ab-C3_dÉ　x \x80y漢!") == ["ab", "c3", "dÉ　x", "\x80y漢"]
    assert lexical.terms_of(None) == lexical.terms_of(" .,") == []


def test_query_equals_sql(spark):
    con = compare.connect("/root/testdata/sf0.01")
    assert compare.difference(queries.op13_search(spark, "/root/testdata/sf0.01"), con, queries.SQL["op13_search"]) is None


@pytest.mark.parametrize("owners,docs_in_block,in_bundle", [(1, 4096, 64), (3, 7, 3), (4, 5, 1)])
def test_equals_brute_force(spark, monkeypatch, owners, docs_in_block, in_bundle):
    rnd = random.Random(owners)
    words = ["the", "of", "And", *(f"w{int(rnd.paretovariate(0.7))}" for _ in range(60))]
    make = lambda most: " ".join(rnd.choice(words) for _ in range(rnd.randint(0, most)))
    docs = [(i, make(30)) for i in rnd.sample(range(1000), 120)]
    docs += [(5000, docs[0][1]), (5000, docs[0][1]), (None, docs[1][1]), (5001, None), (5002, ""), (5003, "the " * 3000)]
    items = [(i, make(12)) for i in range(9)] + [(3, docs[0][1]), (None, "the w1 w1"), (70, None), (71, "nowhere else"), (72, "w1 " * 400)]
    monkeypatch.setattr(lexical, "BLOCK_DOCS", docs_in_block)
    monkeypatch.setattr(lexical, "BUNDLE_ITEMS", in_bundle)
    d = spark.createDataFrame([(a, b, 1, 2) for a, b in docs], "doc_id long, text string, item_id int, score int").repartition(3)
    i = spark.createDataFrame([(a, b, 1) for a, b in items], "item_id long, text string, rank int").repartition(2)
    found = lexical.search(d, i, k=4, owners=owners)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(brute(docs, items, 4), key=str)


def test_few_and_empty(spark):
    docs = spark.createDataFrame([("b", "x y"), ("a", "x y"), ("c", "z")], "doc_id string, text string")
    items = spark.createDataFrame([(1, "x")], "item_id long, text string")
    found = lexical.search(docs, items).orderBy("rank").collect()
    assert [(r["rank"], r["doc_id"]) for r in found] == [(1, "a"), (2, "b")]
    for d, i in ((docs.limit(0), items), (docs, items.limit(0)), (docs, items.filter("item_id = 2"))):
        assert lexical.search(d, i).collect() == []
    with pytest.raises(ValueError):
        lexical.search(docs, items, owners=0)


def test_nothing_that_can_still_win_is_let_go(spark, monkeypatch):
    """Many documents share the rare terms, few of them win by common ones alone."""
    docs = [(i, "rare1 rare2 filler " + "pad " * (i % 9)) for i in range(60)] + [(100 + i, "common1 common2 common3 " * (1 + i % 3)) for i in range(300)]
    items = [(1, "rare1 common1 common2"), (2, "common1 common2 common3"), (3, "rare1 rare2")]
    monkeypatch.setattr(lexical, "BLOCK_DOCS", 50)
    found = lexical.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, found.collect())) == sorted(brute(docs, items, 10))

import random
import struct

import corpus_pipeline
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from posteria.llm import decontaminate, queries, repeats
from posteria.session import stage
from tests.conftest import SF_DIR
from tests.llm.test_minhash import brute_components, brute_sets
from tests.llm.test_repeats import brute

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder, docs = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{SF_DIR}/documents.parquet")
    extra = [(9001, None, "en", "s", 0), (9002, "12 34 !!", "en", "s", 8), (None, "the of and that this of the and then there", None, None, None)]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    out = {"input": docs.collect()}
    for name, step in corpus_pipeline.STAGES:
        step(spark, docs, SF_DIR).write.parquet(str(folder / name))
        docs = spark.read.parquet(str(folder / name))
        out[name] = docs.collect()
        assert name == "packing" or docs.columns == COLUMNS
    return out


def test_language_drops_only_what_has_none(stages):
    gone = set(stages["input"]) - set(stages["language"])
    assert {r["doc_id"] for r in gone} == {9001, 9002}


def test_one_of_each_group_stays(stages):
    rows = [r for r in stages["language"] if r["doc_id"] is not None]
    want = brute_components([r["doc_id"] for r in rows], brute_sets([r["text"] for r in rows], 5), 80)
    kept = {r["doc_id"] for r in stages["near_duplicates"] if r["doc_id"] is not None}
    assert kept == {i for i, c in want.items() if i == c}
    assert any(r["doc_id"] is None for r in stages["near_duplicates"])


def test_repeats_are_cut(stages):
    before = stages["near_duplicates"]
    want = {r["doc_id"]: w for r, w in zip(before, brute([r["text"] for r in before], 200))}
    after = {r["doc_id"]: r for r in stages["repeats"]}
    for r in before:
        _, spans, kept = want[r["doc_id"]]
        text = kept.decode("utf-8", "ignore") if spans else r["text"]
        if spans and not text.strip():
            assert r["doc_id"] not in after
        else:
            assert after[r["doc_id"]]["text"] == text
            assert not spans or after[r["doc_id"]]["n_chars"] == len(text)


def test_repeats_beside_a_crowded_gram(spark):
    rnd = random.Random(7)
    noise = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    line, whole = noise(190), noise(260)  # part of every window near it, in more contexts than a task sorts; repeated itself
    texts = [noise(60) + line + noise(60) + (whole if i % 500 == 0 else "") for i in range(repeats.RUNS + 300)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    out = {r["doc_id"]: r for r in corpus_pipeline.no_repeats(spark, docs.coalesce(1), SF_DIR).collect()}
    want = [kept.decode() for _, _, kept in brute(texts, 200)]
    assert sum(a != b for a, b in zip(texts, want)) == 5
    assert [(out[i]["text"], out[i]["n_chars"]) for i in range(len(texts))] == [(t, len(t)) for t in want]


def test_benchmark_items_are_gone(spark, stages):
    items = [r["text"] for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    items = [(w, decontaminate.budget_of(len(w), decontaminate.SHARE)) for w in map(decontaminate.words_of, items)]
    for r in stages["repeats"]:
        words = decontaminate.words_of(r["text"])
        held = any(decontaminate.nearest_end(w, words)[0] <= budget for w, budget in items)
        assert (r in stages["benchmark"]) != held


def test_sequences_hold_the_documents(stages):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = {}
    for r in sorted(stages["packing"], key=lambda r: r["start"]):
        pieces.setdefault(r["doc_id"], []).extend(struct.unpack(f"<{r['length']}I", r["ids"]))
    assert pieces == {r["doc_id"]: library.encode(r["text"], add_special_tokens=False).ids + [0] for r in stages["benchmark"]}


def test_run_is_all_stages(spark):
    assert corpus_pipeline.run(spark, SF_DIR).count() > 0
    assert set(corpus_pipeline.Q) == {"pipeline"} and len(corpus_pipeline.STAGES) == 5
    assert sorted(int(n[2:].split("_")[0]) for n in queries.Q) == list(range(1, 14))


def test_copies_stay_once(spark):
    long = [" ".join(f"{name}{i}" for i in range(60)) for name in ("ant", "bee", "cat", "dog")]
    near = long[3].replace("dog30", "other")
    rows = [(5, long[0]), (5, long[0]), (6, long[1]), (None, long[1]), (None, long[2]), (None, long[2])]
    rows += [(7, long[3]), (8, near), (8, "a text of its own that shares only its id"), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], ", ".join(f"{c} {k}" for c, k in zip(COLUMNS, ["long", "string", "string", "string", "long"])))
    want = [rows[i] for i in (0, 2, 4, 6, 8, 9)]
    once = corpus_pipeline.one_of_each(spark, docs, SF_DIR)
    assert once.columns == COLUMNS
    assert sorted(((r["doc_id"], r["text"]) for r in once.collect()), key=str) == sorted(want, key=str)
    after = corpus_pipeline.no_repeats(spark, once, SF_DIR).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in after), key=str) == sorted(want, key=str)


STAGES_THAT_KEEP = corpus_pipeline.STAGES[:-1]


def test_columns_of_others_are_left_alone(spark):
    names = [*COLUMNS, "score", "kept", "removed", "margin", "lang_pred", "n_bytes", "component_id", "row", "a.b", "best"]
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    extra = [F.concat(F.lit(f"{c} "), F.col("doc_id").cast("string")).alias(c) for c in names[len(COLUMNS) :]]
    docs = docs.select(*COLUMNS, *extra).union(docs.limit(1).select(F.lit(777), F.lit(None), "lang", "source", "n_chars", *[F.lit(f"{c} 777") for c in names[len(COLUMNS) :]]))
    for _, step in STAGES_THAT_KEEP:
        docs = stage(step(spark, docs, SF_DIR), "kept")
        assert docs.columns == names
        for r in docs.collect():
            assert all(r[c] == f"{c} {r['doc_id']}" for c in names[len(COLUMNS) :])
    assert docs.count() > 100
    assert corpus_pipeline.packed(spark, docs, SF_DIR).count() > 100


def test_stages_on_no_rows(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(0)
    for name, step in corpus_pipeline.STAGES:
        out = step(spark, docs, SF_DIR)
        assert out.collect() == [], name
        assert name == "packing" or out.columns == COLUMNS


def test_a_very_long_text_passes(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    words = docs.filter("lang = 'en'").agg(F.concat_ws(" ", F.collect_list("text"))).first()[0].split()
    text = " ".join(f"{w} {i}" for i, w in enumerate(words * 3))  # no run of 200 bytes twice
    long = spark.createDataFrame([(5000, text, "en", "s", len(text))], docs.schema)
    assert len(text) > 300_000
    rows = docs.unionByName(long)
    for _, step in STAGES_THAT_KEEP:
        rows = stage(step(spark, rows, SF_DIR), "long")
    assert rows.filter("doc_id = 5000").first()["text"] == text

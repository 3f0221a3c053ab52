import json
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from posteria.llm import bpe, packing, words
from tests.conftest import SF_DIR

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a", "b", " ", "  ", "\n", "\t", "é", "1", "²", "½", "'s", "'ll", ".", "!!", "_", "\x1c", "\x85", "\u0301", "漢", "😀", "<|endoftext|>",
         "\r\n", "\u200b", "the", "ı", "Ⅷ", " '", "\u00a0"]


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(1)
    made = ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 12))) for _ in range(4000)]
    return made + ["", "a" * 5000, "ab" * 3000, " " * 3000, "x " * 2000, "\n" * 50, " " * 400_000 + "x", "\n" * 300_000]


@pytest.fixture(scope="module")
def wanted(texts):
    library = Tokenizer.from_file(PATH)
    return [e.ids for e in library.encode_batch_fast(texts, add_special_tokens=False)]


def test_counts_equal_the_library(texts, wanted):
    counter = bpe.Counter(bpe.read_file(PATH))
    assert [counter.count(t) for t in texts] == [len(w) for w in wanted]


def test_counts_do_not_depend_on_what_is_remembered(texts, wanted, monkeypatch):
    monkeypatch.setattr(words, "MEMO", 5)
    counter = bpe.Counter(bpe.read_file(PATH))
    assert [counter.count(t) for t in texts] == [len(w) for w in wanted]


def test_ids_equal_the_library_both_ways(texts, wanted, monkeypatch):
    want = [np.asarray(w, "<u4").tobytes() for w in wanted]
    assert [packing.Encoder(bpe.read_file(PATH)).encode(t) for t in texts[:50]] == want[:50]
    encoder = packing.Encoder(bpe.read_file(PATH))
    assert [encoder.encode(t) for t in texts] == want
    monkeypatch.setattr(packing, "ranks_of", lambda model: None)
    slow = packing.Encoder(bpe.read_file(PATH))
    assert [slow.encode(t) for t in texts[:500]] == want[:500]


def test_query_over_rows(spark, texts, wanted):
    rows = [(i, t, 1) for i, t in enumerate(texts[:300])] + [(None, None, 2), (5, texts[5], 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    out = bpe.count_tokens(df, PATH, limit=4).collect()
    assert len(out) == 302
    for r in out:
        text = texts[r["doc_id"]] if r["doc_id"] is not None else ""
        n = len(wanted[r["doc_id"]]) if r["doc_id"] is not None else 0
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), n, n > 4)
    assert bpe.count_tokens(df.limit(0), PATH, limit=4).collect() == []


@pytest.mark.parametrize("n", [1, 2, 3, 1023, 1024, 1025, 5000])
def test_binary_lengths(n):
    found = packing.binary_lengths(n, 1024)
    assert sum(found) == n and all(x & (x - 1) == 0 and x <= 1024 for x in found)
    assert len([x for x in found if x < 1024]) == len({x for x in found if x < 1024})


def test_pieces_rebuild_the_documents(spark, texts, wanted):
    rows = [(i, t, 9) for i, t in enumerate(texts)] + [(None, None, 9), (3, texts[3], 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, bucket int").repartition(5)
    out = packing.pack(df, PATH, most=64).withColumn("crc", F.crc32("ids")).collect()
    assert sorted(r["sequence_id"] for r in out) == list(range(len(out)))
    by_sequence = sorted(out, key=lambda r: r["sequence_id"])
    assert [r["length"] for r in by_sequence] == sorted((r["length"] for r in out), reverse=True)
    whole = {}
    for r in out:
        assert r["offset"] == 0 and r["length"] & (r["length"] - 1) == 0 and r["length"] * 4 == len(r["ids"])
        assert r["crc"] == zlib.crc32(bytes(r["ids"]))
        whole.setdefault(r["doc_id"], []).append(r)
    assert len(whole) == len(texts) + 1
    for key, pieces in whole.items():
        want = np.asarray((wanted[key] if key is not None else []) + [0], "<u4").tobytes()
        copies = 2 if key == 3 else 1
        assert {r["doc_tokens"] for r in pieces} == {len(want) // 4}
        starts = {}
        for r in pieces:
            starts.setdefault(r["start"], []).append(bytes(r["ids"]))
        assert all(len(x) == copies and len(set(x)) == 1 for x in starts.values())
        assert b"".join(starts[s][0] for s in sorted(starts)) == want
    assert packing.pack(df.limit(0), PATH).collect() == []
    with pytest.raises(ValueError):
        packing.pack(df, PATH, most=100)


def test_plain_join_of_offsets_gives_the_same(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").repartition(3)
    want = sorted(map(tuple, packing.pack(docs, PATH).collect()))
    monkeypatch.setattr(packing, "MOST_BROADCAST", 0)
    assert sorted(map(tuple, packing.pack(docs, PATH).collect())) == want


def test_ids_are_not_written_where_only_checksums_are_wanted(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    full = packing.pack(docs, PATH)
    lean = packing.pack(docs, PATH, with_ids=False)
    assert "ids" not in lean.columns
    assert sorted(map(tuple, full.drop("ids").collect())) == sorted(map(tuple, lean.collect()))
    assert full.filter(F.crc32("ids") != F.col("ids_crc32")).count() == 0


@pytest.mark.parametrize("change", [{"normalizer": {"type": "NFC"}}, {"pre_tokenizer": None}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True}},
                                    {"added_tokens": [{"id": 1, "content": "x", "lstrip": True, "rstrip": False, "single_word": False}]}])
def test_other_vocabulary_files_are_refused(change):
    content = json.dumps(json.loads(bpe.read_file(PATH)) | change).encode()
    for kind in (bpe.Counter, packing.Encoder):
        with pytest.raises(ValueError):
            kind(content)

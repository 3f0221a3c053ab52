import glob
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from posteria.llm import idfiles, queries
from tests.conftest import SF_DIR
from tests.llm.test_tokens import PARTS

PATH = public_tokenizers.path("byte_bpe_50k.json")


def brute(rows):
    """(id, start, n, ids) of (id, text) rows with unique ids, one after another."""
    library, start, out = Tokenizer.from_file(PATH), 0, []
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        out.append((key, start, len(ids), np.asarray(ids, "<u4").tobytes()))
        start += len(ids)
    return out


def test_query_equals_the_library(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    want = [(i, s, n, zlib.crc32(ids)) for i, s, n, ids in brute([(r["doc_id"], r["text"]) for r in docs.collect()])]
    out = queries.op12_token_files(spark, SF_DIR).select("doc_id", "start", "n_tokens", "ids_crc32")
    assert sorted(map(tuple, out.collect())) == sorted(want)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    rnd = random.Random(3)
    rows = [(i, "".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 30)))) for i in rnd.sample(range(-500, 5000), 400)]
    rows += [(9000, None), (9001, ""), (None, "no id"), (9002, "a b " * 60_000)]
    df = spark.createDataFrame([(a, b, 7, "x") for a, b in rows], "doc_id long, text string, start int, ids string").repartition(5)
    folder = idfiles.write_ids(df, PATH, folder=str(tmp_path_factory.mktemp("ids") / "out"), file_bytes=1500)
    return rows, folder


def test_round_trip_over_many_files(spark, odd):
    rows, folder = odd
    assert len(glob.glob(f"{folder}/ids-*.bin")) > 3
    found = [(r["doc_id"], r["start"], r["n_tokens"], bytes(r["ids"])) for r in idfiles.read_ids(spark, folder).collect()]
    key = lambda r: r[1]
    assert sorted(found, key=key) == brute(rows)
    crc = idfiles.read_ids(spark, folder).filter(F.crc32("ids") != F.col("ids_crc32"))
    assert crc.count() == 0


def test_single_documents_are_read_alone(spark, odd):
    rows, folder = odd
    some = [rows[0][0], rows[7][0], 9001, 123456]
    want = [r for r in brute(rows) if r[0] in some]
    found = [(r["doc_id"], r["start"], r["n_tokens"], bytes(r["ids"])) for r in idfiles.read_ids(spark, folder, only=some).collect()]
    assert sorted(found, key=lambda r: r[1]) == want
    assert idfiles.read_ids(spark, folder, only=[]).collect() == []


def test_damaged_files_raise(odd):
    _, folder = odd
    system, root = idfiles._open(folder)
    name = sorted(glob.glob(f"{folder}/ids-*.bin"))[0]
    dictionary = open(glob.glob(f"{folder}/*.dictionary")[0], "rb").read()
    assert len(idfiles.IdFile(system, name, dictionary).index)
    with pytest.raises(ValueError, match="another dictionary"):
        idfiles.IdFile(system, name, dictionary + b"x")
    whole = open(name, "rb").read()
    short = name + ".short"
    with open(short, "wb") as out:
        out.write(whole[:-3])
    with pytest.raises(ValueError, match="whole"):
        idfiles.IdFile(system, short, dictionary)


def test_repeated_ids_and_empty_tables(spark):
    rows = [(1, "same text"), (1, "same text"), (1, "other"), (None, None), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = idfiles.read_ids(spark, idfiles.write_ids(df, PATH, end_id=50256)).orderBy("start").collect()
    assert [r["doc_id"] for r in found] == [None, None, 1, 1, 1]
    ends = np.cumsum([r["n_tokens"] for r in found])
    assert [r["start"] for r in found] == [0, *ends[:-1]]
    assert all(struct.unpack("<I", r["ids"][-4:]) == (50256,) for r in found)
    assert idfiles.read_ids(spark, idfiles.write_ids(df.limit(0), PATH)).collect() == []
    named = spark.createDataFrame([("b", "x"), ("a", "y z")], "doc_id string, text string")
    assert [r["doc_id"] for r in idfiles.read_ids(spark, idfiles.write_ids(named, PATH)).orderBy("start").collect()] == ["a", "b"]


def test_the_dictionary_pays_for_short_documents(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").unionByName(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    content = open(PATH, "rb").read()
    trained = idfiles.train_dictionary(docs, content, 2)
    assert trained == idfiles.train_dictionary(docs.repartition(3), content, 2)
    short = [r["text"] for r in docs.collect() if r["text"] and len(r["text"]) < 1500]
    encoder = idfiles.Encoder(content)
    arrays = [idfiles._narrow(encoder.encode(t), 2) for t in short]
    press = idfiles.zstandard.ZstdCompressor(level=3, dict_data=idfiles._dictionary(trained))
    alone = idfiles.zstandard.ZstdCompressor(level=3)
    assert sum(len(press.compress(a)) for a in arrays) < 0.9 * sum(len(alone.compress(a)) for a in arrays)

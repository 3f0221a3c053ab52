"""Token ids in binary files: one zstandard frame for each document, one dictionary for all.

Frames of short documents are small only if they share what they have in
common, so a dictionary is trained on id arrays of a sample and every document
is compressed by itself against it. Any document can then be read alone: by
its place in the index at the end of its file.

A folder holds
  ``<sha256>.dictionary``  the dictionary, named by its hash
  ``ids-<part>-<attempt>.bin``  files in ascending order of ids and parts
  ``manifest``  a table of the files that count, one row each

and a file holds
  8 bytes ``IDFILE01``, 32 bytes hash of the dictionary, 1 byte width of an id
  the frames, one after another: little-endian unsigned ids of that width
  the index, an Arrow stream: id, at (offset), size (of the frame), start, n_tokens
  8 bytes length of the index, 8 bytes ``IDFILE01``

A task writes a file of its own and returns its manifest row; Spark commits
the rows of one attempt of each task, so what a lost attempt has written is
never read.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (loads pa.compute)
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from posteria.llm.bpe import read_file
from posteria.llm.packing import Encoder
from posteria.llm.tables import give_back, pick, slices
from posteria.session import claimed_path, stage

MAGIC = b"IDFILE01"
HEADER = "<8s32sB"
FOOTER = "<Q8s"
SAMPLE_DOCS = 800  # texts the dictionary is trained on
SAMPLE_BYTES = 8192  # longer texts are not sampled: the dictionary serves short ones
DICTIONARY_BYTES = 64 << 10
FILE_BYTES = 32 << 20  # of frames, about
LEVEL = 3
BATCH_IDS = 1 << 21  # ids handed to Spark at a time, but one document at least


def _open(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system and path of a folder that tasks can reach without Spark (local paths, file, hdfs, s3, gs)."""
    return pa.fs.FileSystem.from_uri("file://" + uri[5:] if uri.startswith("file:/") and not uri.startswith("file://") else uri)


def id_width(content: bytes, end_id: int) -> int:
    """Bytes that hold every id of the vocabulary file: 2 or 4."""
    file = json.loads(content)
    most = max([end_id, *file["model"]["vocab"].values(), *(t["id"] for t in file["added_tokens"])])
    return 2 if most < 1 << 16 else 4


def _narrow(ids: bytes, width: int) -> bytes:
    return ids if width == 4 else np.frombuffer(ids, "<u4").astype("<u2").tobytes()


def _wide(ids: bytes, width: int) -> bytes:
    return ids if width == 4 else np.frombuffer(ids, "<u2").astype("<u4").tobytes()


def _dictionary(trained: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(trained) if trained else None


def train_dictionary(docs: DataFrame, content: bytes, width: int, id_col: str = "doc_id", text_col: str = "text") -> bytes:
    """Dictionary from the id arrays of at most ``SAMPLE_DOCS`` different texts of at most ``SAMPLE_BYTES`` bytes.

    The texts are those of least hash, so the same rows give the same
    dictionary. It is empty where zstandard finds too little to learn from.
    """
    spark = docs.sparkSession
    hashed = pick(docs, text=text_col).filter(F.octet_length("text").between(1, SAMPLE_BYTES)).withColumn("h", F.xxhash64("text"))
    last = hashed.select("h").distinct().orderBy("h").limit(SAMPLE_DOCS).agg(F.max("h")).first()[0]
    if last is None:
        return b""
    shared = spark.sparkContext.broadcast(content)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            found = [_narrow(encoder.encode(t), width) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], names=["ids"])

    chosen = hashed.filter(F.col("h") <= last).groupBy("h").agg(F.min("text").alias("text")).select("text")
    samples = sorted(bytes(r["ids"]) for r in chosen.mapInArrow(encoded, "ids binary").collect())
    shared.destroy()
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too few or too small
        return b""


def write_ids(
    docs: DataFrame,
    tokenizer_path: str,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    folder: str | None = None,
    file_bytes: int = FILE_BYTES,
) -> str:
    """Write the ids of every whole text, ``end_id`` after each, in ascending order of ids; returns the folder.

    Rows with a null id come first; rows that share an id follow each other by
    length, checksum and place of their row; null and empty texts hold only
    the end id; no rows give a folder without files. A text is one frame,
    however long. Extra columns are left out. The folder (by default a new one
    in the shared folder) must be one that tasks can write to by themselves.

    Texts are encoded where they lie; only frames are shuffled, by ranges of
    (id, length, checksum, row), so that many rows of one id are split.
    """
    spark = docs.sparkSession
    folder = folder or claimed_path(spark, "ids")
    content = read_file(tokenizer_path)
    width = id_width(content, end_id)
    trained = train_dictionary(docs, content, width, id_col, text_col)
    digest = hashlib.sha256(trained).digest()
    system, root = _open(folder)
    system.create_dir(root, recursive=True)
    with system.open_output_stream(f"{root}/{digest.hex()}.dictionary") as out:
        out.write(trained)
    end = struct.pack("<I", end_id)
    shared = spark.sparkContext.broadcast((content, trained))
    rows = pick(docs, id=id_col, text=text_col)
    id_type = rows.schema["id"].dataType

    def framed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, known = shared.value
        encoder, part, place = Encoder(vocabulary), TaskContext.get().partitionId(), 0
        press = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(known))
        for batch in slices(batches, "text", 4 << 20):
            n, crc, frames = [], [], []
            for text in batch.column(1).to_pylist():
                ids = encoder.encode(text or "") + end
                n.append(len(ids) // 4)
                crc.append(zlib.crc32(ids))
                frames.append(press.compress(_narrow(ids, width)))
            places = pa.array((part << 33) + np.arange(place, place + batch.num_rows), pa.int64())
            place += batch.num_rows
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), places, pa.array(frames, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "crc", "place", "frame"])
        del encoder, press
        give_back()

    kind = f"id {id_type.simpleString()}, n long, crc long, place long, frame binary"
    frames = stage(rows.mapInArrow(framed, kind), "frames")
    shared.destroy()
    total = frames.agg(F.sum(F.octet_length("frame"))).first()[0] or 0
    order = ["id", "n", "crc", "place"]
    ranged = frames.repartitionByRange(max(1, -(-total // file_bytes)), *order).sortWithinPartitions(*order)

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, out, at, start, index = TaskContext.get().partitionId(), None, struct.calcsize(HEADER), 0, []
        system, root = _open(folder)
        name = f"ids-{part:06d}-{uuid.uuid4().hex}.bin"
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                out = system.open_output_stream(f"{root}/{name}")
                out.write(struct.pack(HEADER, MAGIC, digest, width))
            n, frames = batch.column(1).to_numpy(), batch.column(4)
            sizes = pa.compute.binary_length(frames).to_numpy().astype(np.int64)
            for frame in frames:
                out.write(frame.as_buffer())
            places, starts = at + np.cumsum(sizes) - sizes, start + np.cumsum(n) - n
            at, start = at + int(sizes.sum()), start + int(n.sum())
            columns = [batch.column(0), *(pa.array(x, pa.int64()) for x in (places, sizes, starts, n))]
            index.append(pa.RecordBatch.from_arrays(columns, names=["id", "at", "size", "start", "n_tokens"]))
        if out is None:
            return
        table = pa.Table.from_batches(index)
        body = pa.BufferOutputStream()
        with pa.ipc.new_stream(body, table.schema) as stream:
            stream.write_table(table)
        body = body.getvalue()
        out.write(body)
        out.write(struct.pack(FOOTER, body.size, MAGIC))
        out.close()
        ids = table["id"].drop_null()
        edges = [ids[0].as_py(), ids[-1].as_py()] if len(ids) else [None, None]
        row = {"part": part, "file": name, "n_docs": len(table), "n_tokens": start, "least_id": edges[0], "most_id": edges[1]}
        yield pa.RecordBatch.from_pylist([row], schema=manifest_arrow)

    manifest_type = T.StructType.fromDDL("part long, file string, n_docs long, n_tokens long").add("least_id", id_type).add("most_id", id_type)
    manifest_arrow = _arrow_schema(manifest_type)
    ranged.mapInArrow(written, manifest_type).write.parquet(f"{folder}/manifest")
    return folder


def _arrow_schema(kind: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(kind)


class IdFile:
    """One file: its header checked against the dictionary, its index, its frames."""

    def __init__(self, system: pa.fs.FileSystem, path: str, dictionary: bytes):
        self.handle = system.open_input_file(path)
        magic, digest, self.width = struct.unpack(HEADER, self.handle.read(struct.calcsize(HEADER)))
        size = self.handle.size()
        self.handle.seek(size - struct.calcsize(FOOTER))
        length, closing = struct.unpack(FOOTER, self.handle.read(struct.calcsize(FOOTER)))
        if magic != MAGIC or closing != MAGIC:
            raise ValueError(f"{path} is no file of ids, or not a whole one")
        if digest != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{path} was written with another dictionary")
        self.handle.seek(size - struct.calcsize(FOOTER) - length)
        self.index = pa.ipc.open_stream(self.handle.read(length)).read_all()
        self.open = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary)).decompress

    def ids(self, row: int) -> bytes:
        """Ids of the document in that row of the index, as little-endian unsigned 32-bit integers."""
        self.handle.seek(self.index["at"][row].as_py())
        return _wide(self.open(self.handle.read(self.index["size"][row].as_py())), self.width)


def read_ids(spark: SparkSession, folder: str, with_ids: bool = True, only: Sequence | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and ``ids`` of every document, or of those whose id is in ``only``.

    ``start``: ids of all documents before it, over all files. ``ids``:
    little-endian unsigned 32-bit integers (left out without ``with_ids``).
    A file is read by one task, frame by frame; with ``only``, files that
    cannot hold one of the ids are not opened, and of the others only the
    index and the frames asked for are read. A file that is cut short, or
    written with another dictionary, raises.
    """
    manifest = spark.read.parquet(f"{folder}/manifest")
    id_type = manifest.schema["least_id"].dataType
    kind = T.StructType().add("doc_id", id_type)
    for name, c in (("start", T.LongType()), ("n_tokens", T.LongType()), ("ids_crc32", T.LongType()), ("ids", T.BinaryType())):
        kind = kind.add(name, c) if with_ids or name != "ids" else kind
    # one row for each file of many megabytes: small enough for one task
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    if only is not None:
        wanted = sorted(set(only))
        if not wanted:
            return spark.createDataFrame([], kind)
        files = files.filter((F.col("least_id") <= wanted[-1]) & (F.col("most_id") >= wanted[0]))
    files = files.select("part", "file", "base")
    schema = _arrow_schema(kind)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _open(folder)
        dictionaries = [f.path for f in system.get_file_info(pa.fs.FileSelector(root)) if f.path.endswith(".dictionary")]
        dictionary = None
        for batch in batches:
            for row in batch.to_pylist():
                if dictionary is None:
                    with system.open_input_stream(dictionaries[0]) as stream:
                        dictionary = stream.read()
                file = IdFile(system, f"{root}/{row['file']}", dictionary)
                if only is None:
                    rows = np.arange(len(file.index))
                else:
                    rows = np.flatnonzero(pa.compute.is_in(file.index["id"], pa.array(wanted, file.index["id"].type)).to_numpy())
                yield from _documents(file, rows, row["base"], with_ids, schema)
                file.handle.close()
        give_back()

    tasks = max(1, files.count())
    return files.repartitionByRange(tasks, "part").mapInArrow(read, kind)


def _documents(file: IdFile, rows: np.ndarray, base: int, with_ids: bool, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The documents in those rows of the index, in batches of bounded size."""
    n = file.index["n_tokens"].to_numpy()
    held, crc, ids = 0, [], []
    first = 0
    for i, row in enumerate(rows):
        found = file.ids(int(row))
        crc.append(zlib.crc32(found))
        ids.append(found if with_ids else None)
        held += int(n[row])
        if held >= BATCH_IDS or i + 1 == len(rows):
            some = file.index.take(pa.array(rows[first : i + 1]))
            start = pa.compute.add(some["start"], base)
            columns = [some["id"], start, some["n_tokens"], pa.array(crc, pa.int64()), *([pa.array(ids, pa.binary())] if with_ids else [])]
            yield pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns], schema=schema)
            held, crc, ids, first = 0, [], [], i + 1

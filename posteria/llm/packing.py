"""Packing token sequences: every document is cut into pieces of binary length.

A document of ``n`` tokens becomes ``n // most`` pieces of ``most`` tokens and
one piece for every set bit of the rest. Each piece is a sequence of its own in
the bucket of its length: no sequence crosses documents and none is padded,
because every length is a power of two.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from posteria.llm.bpe import byte_level, printable_bytes, read_file
from posteria.llm.tables import lean, pick, slices
from posteria.llm.words import WORDS
from posteria.session import stage

MOST_BROADCAST = 1 << 20  # rows of three numbers


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit integers.

    The ids are those of the tokenizers library for a byte-level BPE file.
    Where the ids follow the order of the merges (checked), whole texts go
    through tiktoken with the same ranks, which gives the same ids sooner; a
    text that its pattern engine gives up on (very long runs of white space)
    goes through the library itself.
    """

    def __init__(self, content: bytes):
        self.content, self.library = content, None
        file = byte_level(json.loads(content))
        self.special = {t["content"]: self._packed([t["id"]]) for t in file["added_tokens"]}
        found = sorted(self.special, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, found)) + ")") if found else None
        ranks, self.fast = ranks_of(file["model"]), None
        if ranks:
            import tiktoken

            self.fast = tiktoken.Encoding("ranks", pat_str=WORDS.pattern, mergeable_ranks=ranks, special_tokens={})

    @staticmethod
    def _packed(ids: list[int]) -> bytes:
        return np.asarray(ids, "<u4").tobytes()

    def _slow(self, text: str) -> bytes:
        if self.library is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_str(self.content.decode())
        return self._packed(self.library.encode(text, add_special_tokens=False).ids)

    def plain(self, text: str) -> bytes:
        if self.fast is not None:
            try:
                return self.fast.encode_to_numpy(text).astype("<u4", copy=False).tobytes()
            except ValueError:
                pass
        return self._slow(text)

    def encode(self, text: str) -> bytes:
        """The vocabulary's special strings become their own ids, as the library does by default."""
        if self.cut is None or not self.cut.search(text):
            return self.plain(text)
        return b"".join(self.special.get(part) or self.plain(part) for part in self.cut.split(text))


def ranks_of(model: dict) -> dict[bytes, int] | None:
    """Ids by bytes, if ids rise with the merges that make them; else None."""
    as_byte = printable_bytes()
    ids = {bytes(as_byte[c] for c in piece): i for piece, i in model["vocab"].items()}
    last = 255
    for merge in model["merges"]:
        left, right = merge.split(" ") if isinstance(merge, str) else merge
        made = ids[bytes(as_byte[c] for c in left + right)]
        if made <= last:
            return None
        last = made
    return ids


def binary_lengths(tokens: int, most: int) -> list[int]:
    """``tokens`` as full lengths and then falling powers of two."""
    rest = tokens % most
    return [most] * (tokens // most) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    most: int = 1024,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = True,
) -> DataFrame:
    """Pieces of all documents: id, start, length, ids, ids_crc32, doc_tokens, sequence_id, offset.

    ``ids``: the tokens as little-endian unsigned 32-bit integers (left out,
    and never written, without ``with_ids``); ``ids_crc32`` is their checksum.
    The closing ``end_id`` belongs to the document. Whole texts are encoded,
    however long. Null and empty texts hold only that id.
    ``sequence_id`` is gapless, and sequences of equal length follow each
    other; ``offset`` is 0, as a sequence is one piece. Repeated ids are packed
    once for each row; extra columns are left out; no rows give no pieces.

    Pieces are written once to the shared folder, numbered within task and
    length; a small table of counts then gives the global numbers, so nothing
    is sorted or shuffled.
    """
    if most < 1 or most & (most - 1):
        raise ValueError("most must be a power of two")
    spark = docs.sparkSession
    content = read_file(tokenizer_path)
    shared = spark.sparkContext.broadcast(content)
    end = struct.pack("<I", end_id)
    rows = pick(docs, id=id_col, text=text_col)
    id_type = rows.schema["id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task, used = Encoder(shared.value), TaskContext.get().partitionId(), [0] * most.bit_length()
        for batch in slices(batches, "text", 4 << 20):
            encoded = [encoder.encode(t or "") for t in batch.column(1).to_pylist()]
            of, start, length, ids, crc, total, bucket, local = [], [], [], [], [], [], [], []
            for row, found in enumerate(encoded):
                found += end
                n = len(found) // 4
                at = 0
                for size in binary_lengths(n, most):
                    b = size.bit_length() - 1
                    of.append(row)
                    start.append(at)
                    length.append(size)
                    piece = found[4 * at : 4 * (at + size)]
                    ids.append(piece if with_ids else None)
                    crc.append(zlib.crc32(piece))
                    total.append(n)
                    bucket.append(b)
                    local.append(used[b])
                    used[b] += 1
                    at += size
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(of, pa.int64())),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()),
                    pa.array(ids, pa.binary()),
                    pa.array(crc, pa.int64()),
                    pa.array(total, pa.int64()),
                    pa.array(bucket, pa.int32()),
                    pa.array([task] * len(of), pa.int64()),
                    pa.array(local, pa.int64()),
                ],
                names=["id", "start", "length", "ids", "ids_crc32", "doc_tokens", "bucket", "task", "local"],
            )

    kind = f"id {id_type}, start long, length long, ids binary, ids_crc32 long, doc_tokens long, bucket int, task long, local long"
    made = rows.mapInArrow(lean(cut), kind)
    pieces = stage(made if with_ids else made.drop("ids"), "pieces")
    shared.destroy()  # the pieces are written
    counts = pieces.groupBy("bucket", "task").agg((F.max("local") + 1).alias("n"))
    inside = Window.partitionBy("bucket").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    # one row per length: at most 11 for sequences of 1024
    whole = counts.groupBy("bucket").agg(F.sum("n").alias("n"))
    longer = Window.orderBy(F.col("bucket").desc()).rowsBetween(Window.unboundedPreceding, -1)
    starts = whole.select("bucket", F.coalesce(F.sum("n").over(longer), F.lit(0)).alias("bucket_from"))
    offsets = counts.select("bucket", "task", F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("task_from"))
    offsets = offsets.join(F.broadcast(starts), "bucket").select(
        "bucket", "task", (F.col("task_from") + F.col("bucket_from")).alias("first")
    )
    # a row for each task and length: checked before it is broadcast, so that pieces stay where they are
    offsets = stage(offsets, "offsets")
    if offsets.count() <= MOST_BROADCAST:
        offsets = F.broadcast(offsets)
    return pieces.join(offsets, ["bucket", "task"]).select(
        F.col("id").alias(id_col),
        "start",
        "length",
        *(["ids"] if with_ids else []),
        "ids_crc32",
        "doc_tokens",
        (F.col("first") + F.col("local")).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )

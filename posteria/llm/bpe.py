"""Token counts by byte-pair merging with a heap over a linked list.

A word starts as its bytes. The adjacent pair of lowest rank is merged again
and again; pairs wait in a heap, symbols hang in a doubly linked list. The
count is the number of bytes minus the number of merges: no token is ever
written out. Words repeat, so a task remembers the counts it has worked out.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame

from posteria.llm.tables import pick, slices
from posteria.llm.words import ByWord


def printable_bytes() -> dict[str, int]:
    """The printable character that stands for each byte in a vocabulary file."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def byte_level(file: dict) -> dict:
    """The vocabulary file, if it is one whose rules are known here; another would be read wrongly."""
    before, model = file["pre_tokenizer"] or {}, file["model"]
    if model["type"] != "BPE" or file["normalizer"] is not None:
        raise ValueError("only byte-level BPE without normalizer is understood")
    if before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
        raise ValueError("words must be cut by the byte-level pattern, without a prefix space")
    if any(model.get(flag) for flag in ("dropout", "byte_fallback", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix")):
        raise ValueError("dropout, byte fallback, whole words before merges and word marks are not understood")
    if any(token[flag] for token in file["added_tokens"] for flag in ("lstrip", "rstrip", "single_word")):
        raise ValueError("added tokens that take blanks along or stand alone are not understood")
    return file


class Counter:
    """Counts the tokens of a text for one vocabulary file (JSON of a byte-level BPE)."""

    def __init__(self, content: bytes):
        file = byte_level(json.loads(content))
        model = file["model"]
        as_byte = printable_bytes()
        name = lambda piece: bytes(as_byte[c] for c in piece)
        ids = {name(piece): i for piece, i in model["vocab"].items()}
        self.first = [ids[bytes([b])] for b in range(256)]
        self.pairs: dict[int, tuple[int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = (name(p) for p in (merge.split(" ") if isinstance(merge, str) else merge))
            self.pairs[ids[left] << 20 | ids[right]] = (rank, ids[left + right])
        special = sorted((t["content"] for t in file["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.plain = ByWord(lambda word: self.merged(word.encode("utf-8", "replace")), sum)

    def merged(self, word: bytes) -> int:
        """Tokens of one word: its bytes less the merges."""
        n = len(word)
        if n < 2:
            return n
        pairs, symbol = self.pairs, [self.first[b] for b in word]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = [-1] * n  # of the pair that starts at a live symbol
        heap = []
        for i in range(n - 1):
            found = pairs.get(symbol[i] << 20 | symbol[i + 1])
            if found:
                rank[i] = found[0]
                heap.append(found[0] << 32 | i)
        heapq.heapify(heap)
        merges = 0
        while heap:
            entry = heapq.heappop(heap)
            i = entry & 0xFFFFFFFF
            if rank[i] != entry >> 32:
                continue  # one of the two symbols has changed since
            j = after[i]
            symbol[i] = pairs[symbol[i] << 20 | symbol[j]][1]
            rank[j] = -1
            k = after[i] = after[j]
            merges += 1
            rank[i] = -1
            if k < n:
                before[k] = i
                found = pairs.get(symbol[i] << 20 | symbol[k])
                if found:
                    rank[i] = found[0]
                    heapq.heappush(heap, found[0] << 32 | i)
            h = before[i]
            if h >= 0:
                found = pairs.get(symbol[h] << 20 | symbol[i])
                if found:
                    rank[h] = found[0]
                    heapq.heappush(heap, found[0] << 32 | h)
                else:
                    rank[h] = -1
        return n - merges

    def count(self, text: str) -> int:
        """Tokens of the whole text; the vocabulary's special strings count as one each."""
        if self.special is None or not self.special.search(text):
            return self.plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self.plain, parts))


_COUNTERS: dict[str, Counter] = {}


def _counter(digest: str, shared: Broadcast) -> Counter:
    """One vocabulary for each worker process, kept from task to task."""
    if digest not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[digest] = Counter(shared.value)
    return _COUNTERS[digest]


def read_file(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def count_tokens(
    docs: DataFrame, tokenizer_path: str, limit: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """id, n_bytes, n_tokens, over_limit of every row; null texts count as empty.

    The vocabulary file (about a megabyte) is read on the driver and broadcast.
    Rows stay where they are; repeated ids give repeated rows; extra columns
    are left out.
    """
    spark = docs.sparkSession
    content = read_file(tokenizer_path)
    shared: Broadcast = spark.sparkContext.broadcast(content)
    digest = hashlib.sha256(content).hexdigest()
    rows = pick(docs, id=id_col, text=text_col)
    id_type = rows.schema["id"].dataType.simpleString()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(digest, shared)
        for batch in slices(batches, "text"):
            sizes, counts = [], []
            for text in batch.column(1).to_pylist():
                text = text or ""
                sizes.append(len(text.encode("utf-8", "replace")))
                counts.append(counter.count(text))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([c > limit for c in counts], pa.bool_())],
                names=["id", "n_bytes", "n_tokens", "over_limit"],
            )
        counter.plain.forget()

    out = rows.mapInArrow(counted, f"id {id_type}, n_bytes long, n_tokens long, over_limit boolean")
    return out.withColumnRenamed("id", id_col)

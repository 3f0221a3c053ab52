"""Benchmark items inside documents, edits allowed: pigeonhole pieces, then Myers' bit-parallel distance.

Texts are compared as lower-case words. An item may differ from its place in a
document by ``budget`` edits of words. Cut into budget + 1 pieces, at least one
piece must be there unchanged; every exact hit of a piece names a window, and
the window is verified with the bit-parallel edit distance.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posteria.llm.repeats import mixed
from posteria.llm.tables import lean, pick, quoted, slices
from posteria.session import stage

WORD = re.compile(r"\w+")
#: Letters and marks of scripts without blanks between words (Chinese, Japanese, Thai, Lao, Burmese, Khmer, Tai, Javanese).
UNSPACED_RANGES = (
    "\u0e01-\u0e2e\u0e30-\u0e3a\u0e40-\u0e4e\u0e81-\u0ece\u0edc-\u0edf\u1000-\u103f\u1050-\u108f\u1780-\u17d3\u1950-\u1974\u1980-\u19c9"
    "\u1a20-\u1a7c\u3005-\u3007\u3041-\u3096\u309d-\u309f\u30a1-\u30fa\u30fc-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\ua980-\ua9c0"
    "\uf900-\ufaff\uff66-\uff9f\U00020000-\U000323af"
)
UNSPACED = re.compile(f"[{UNSPACED_RANGES}]")
MIXED = re.compile(rf"[{UNSPACED_RANGES}]|[^\W{UNSPACED_RANGES}]+")
SHARE = 0.15  # of an item's words that may be edited
LEAST_WORDS = 8  # shorter items are common: they are looked for only on demand, and without edits
BLOCK_WORDS = 500_000  # of the benchmark that one pass over the documents looks for
WORD_BYTES = 16  # a word counts once for so many bytes, so that long ones fill a block too
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    """Lower-case words; a character is a word in scripts without blanks."""
    text = text.lower()
    return (MIXED if not text.isascii() and UNSPACED.search(text) else WORD).findall(text)


def budget_of(words: int, share: float) -> int:
    return int(words * share)


def pieces_of(words: int, budget: int) -> list[tuple[int, int]]:
    """Bounds of budget + 1 pieces of nearly equal length."""
    parts = budget + 1
    return [(i * words // parts, (i + 1) * words // parts) for i in range(parts)]


def nearest_end(pattern: list[int], text: list[int]) -> tuple[int, int]:
    """(distance, end) of the place in ``text`` that ends the best match of ``pattern``; the first among equals.

    Myers' bit vectors: one integer holds a whole column of the dynamic
    programme, differences up and down in two bit masks.
    """
    m = len(pattern)
    masks: dict[int, int] = {}
    for i, symbol in enumerate(pattern):
        masks[symbol] = masks.get(symbol, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    best, end = m, 0
    for at, symbol in enumerate(text):
        equal = masks.get(symbol, 0)
        x = equal | down
        across = ((x & up) + up ^ up) | x
        rise = down | ~(across | up) & full
        fall = up & across
        if rise & top:
            score += 1
        elif fall & top:
            score -= 1
        rise = rise << 1 & full  # a match may begin anywhere: no cost along the text
        fall = fall << 1 & full
        up = fall | ~(x | rise) & full
        down = rise & x
        if score < best:
            best, end = score, at + 1
    return best, end


class Index:
    """Pieces of a block of benchmark items by length and fingerprint."""

    def __init__(self, items: list[tuple[object, str]], share: float, least: int, short: bool = False):
        self.ids: dict[str, int] = {}
        self.items: list[tuple[object, list[int], int]] = []
        pieces: dict[int, list[tuple[int, int, int]]] = {}
        for item, text in items:
            words = words_of(text)
            if not words or len(words) < least and not short:
                continue
            coded = [self.ids.setdefault(w, len(self.ids) + 1) for w in words]
            budget = budget_of(len(coded), share) if len(words) >= least else 0
            for start, end in pieces_of(len(coded), budget):
                print_ = int(self._prints(np.array(coded[start:end], np.uint64), end - start)[0])
                pieces.setdefault(end - start, []).append((print_, len(self.items), start))
            self.items.append((item, coded, budget))
        self.pieces = {}
        for length, found in pieces.items():
            by_print: dict[int, list[tuple[int, int]]] = {}
            for print_, item, start in found:
                by_print.setdefault(print_, []).append((item, start))
            self.pieces[length] = (np.array(sorted(by_print), np.uint64), by_print)

    @staticmethod
    def _prints(coded: np.ndarray, length: int) -> np.ndarray:
        """Fingerprint of each run of ``length`` words."""
        n = len(coded) - length + 1
        total = np.zeros(max(n, 0), np.uint64)
        for i in range(length):
            total = total * FACTOR + coded[i : i + n]
        return mixed(total)

    def hits(self, text: str) -> list[tuple[object, int, int, int]]:
        """(item, first word, end word, distance) of the best place of every item that is near enough."""
        coded = [self.ids.get(w, 0) for w in words_of(text)]
        array = np.array(coded, np.uint64)
        windows: dict[int, list[tuple[int, int]]] = {}
        for length, (sorted_prints, by_print) in self.pieces.items():
            if len(array) < length:
                continue
            prints = self._prints(array, length)
            at = np.searchsorted(sorted_prints, prints)
            at[at == len(sorted_prints)] = 0
            for place in np.flatnonzero(sorted_prints[at] == prints).tolist():
                for item, start in by_print[int(prints[place])]:
                    _, pattern, budget = self.items[item]
                    low = place - start - budget
                    windows.setdefault(item, []).append((low, low + len(pattern) + 2 * budget))
        out = []
        for item, spans in sorted(windows.items()):
            name, pattern, budget = self.items[item]
            best = None
            joined: list[list[int]] = []
            for low, high in sorted(spans):
                if joined and low <= joined[-1][1]:
                    joined[-1][1] = max(high, joined[-1][1])
                else:
                    joined.append([max(low, 0), high])
            for low, high in joined:
                distance, end = nearest_end(pattern, coded[low:high])
                if distance <= budget and (best is None or distance < best[2]):
                    back = coded[max(low, low + end - len(pattern) - budget) : low + end][::-1]
                    _, length = nearest_end_anchored(pattern[::-1], back)
                    best = (low + end - length, low + end, distance)
            if best:
                out.append((name, *best))
        return out


def nearest_end_anchored(pattern: list[int], text: list[int]) -> tuple[int, int]:
    """(distance, length) of the prefix of ``text`` that is nearest to ``pattern``; the shortest among equals."""
    row = list(range(len(pattern) + 1))
    best = (row[-1], 0)
    for at, symbol in enumerate(text, 1):
        left = row
        row = [at]
        for i, wanted in enumerate(pattern, 1):
            row.append(min(left[i] + 1, row[i - 1] + 1, left[i - 1] + (symbol != wanted)))
        best = min(best, (row[-1], at))
    return best


def blocks(benchmark: DataFrame, item_col: str, text_col: str, most_words: int) -> Iterator[list[tuple[object, str]]]:
    """The benchmark in blocks of bounded size; null texts are left out."""
    rows = pick(benchmark, item=item_col, text=text_col).filter("text is not null").distinct()
    held, size = [], 0
    for row in rows.toLocalIterator():
        words = max(len(words_of(row["text"])), len(row["text"].encode()) // WORD_BYTES)
        if held and size + words > most_words:
            yield held
            held, size = [], 0
        held.append((row["item"], row["text"]))
        size += words
    if held:
        yield held


def passes(rows: DataFrame, held: Iterator[Index], look: Callable, schema: str) -> Iterator[DataFrame]:
    """``look`` over ``rows`` for one index after another; each result is written and its broadcast destroyed before the next."""
    for index in held:
        shared = rows.sparkSession.sparkContext.broadcast(index)
        part = stage(rows.mapInArrow(lean(look(shared)), schema), "hits")
        shared.destroy()
        del index, shared  # before the next is made
        yield part


def without_contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    share: float = SHARE,
    least_words: int = LEAST_WORDS,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    most_words: int = BLOCK_WORDS,
    short: bool = False,
) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no benchmark item; judged as in ``contaminated``.

    Rows are filtered where they are, whatever their ids; null texts stay, repeated rows
    are judged alike, whole texts are read however long, and no rows, or no
    benchmark, leave what there is. A benchmark of one block is looked for on
    the way; one of several blocks has a staged copy of the rows, with a row
    key, read once for each block. Both ways keep the same rows.
    """
    names = docs.columns
    out = docs.select(*[quoted(c).alias(f"_c{i}") for i, c in enumerate(names)])
    text, gone = names.index(text_col), None

    def clean(index):
        def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = index.value
            for batch in slices(batches, f"_c{text}"):
                yield batch.filter(pa.array([not t or not known.hits(t) for t in batch.column(text).to_pylist()], pa.bool_()))

        return kept

    def found(index):
        def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = index.value
            for batch in slices(batches, "text"):
                yield batch.select([0]).filter(pa.array([bool(t and known.hits(t)) for t in batch.column(1).to_pylist()], pa.bool_()))

        return rows_of

    index_of = lambda block: Index(block, share, least_words, short)
    held = blocks(benchmark, item_col, item_text_col, most_words)
    first = list(islice(held, 2))
    if len(first) == 1:  # one pass, where the rows are
        out = out.mapInArrow(lean(clean(docs.sparkSession.sparkContext.broadcast(index_of(first[0])))), out.schema)
    elif first:
        out = stage(out.withColumn("_row", F.monotonically_increasing_id()), "rows")
        for part in passes(pick(out, row="_row", text=f"_c{text}"), map(index_of, chain(first, held)), found, "row long"):
            gone = part if gone is None else gone.unionByName(part)
        out = out.join(stage(gone.distinct(), "gone").withColumnRenamed("row", "_row"), "_row", "left_anti")
    return out.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(names)])


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    share: float = SHARE,
    least_words: int = LEAST_WORDS,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    most_words: int = BLOCK_WORDS,
    short: bool = False,
) -> DataFrame:
    """(id, item, first_word, end_word, distance): an item's best place in each document that holds it.

    An item of ``w`` words may be off by ``share * w`` edited words. Items of
    fewer than ``least_words`` words are found only with ``short``, and only
    unchanged; items without a word and null texts never. The whole
    benchmark is looked for, block by block of bounded size, each broadcast for
    one pass over the whole documents, which do not move; of several blocks the
    hits are written and the broadcast destroyed before the next. Rows that repeat an
    id give rows each; extra columns are left out; empty tables give no rows.
    """
    rows = pick(docs, id=id_col, text=text_col)
    spark = docs.sparkSession
    id_type = rows.schema["id"].dataType.simpleString()
    item_type = benchmark.schema[item_col].dataType
    schema = f"id {id_type}, item {item_type.simpleString()}, first_word long, end_word long, distance int"

    def look(index):
        def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = index.value
            for batch in slices(batches, "text"):
                of, hits = [], []
                for row, text in enumerate(batch.column(1).to_pylist()):
                    for hit in known.hits(text) if text else ():
                        of.append(row)
                        hits.append(hit)
                columns = [batch.column(0).take(pa.array(of, pa.int64()))]
                columns.append(pa.array([h[0] for h in hits], arrow_type))
                columns += [pa.array([h[i] for h in hits], k) for i, k in ((1, pa.int64()), (2, pa.int64()), (3, pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "item", "first_word", "end_word", "distance"])

        return found

    from pyspark.sql.pandas.types import to_arrow_type

    arrow_type = to_arrow_type(item_type)
    out = None
    index_of = lambda block: Index(block, share, least_words, short)
    held = blocks(benchmark, item_col, item_text_col, most_words)
    first = list(islice(held, 2))
    if len(first) == 1:
        out = rows.mapInArrow(lean(look(spark.sparkContext.broadcast(index_of(first[0])))), schema)
    elif first:
        for part in passes(rows, map(index_of, chain(first, held)), look, schema):
            out = part if out is None else out.unionByName(part)
    if out is None:
        out = rows.select("id", F.lit(None).cast(item_type).alias("item"), F.lit(0).cast("long").alias("first_word"), F.lit(0).cast("long").alias("end_word"), F.lit(0).alias("distance")).limit(0)
    return out.select(quoted("id").alias(id_col), quoted("item").alias(item_col), "first_word", "end_word", "distance")

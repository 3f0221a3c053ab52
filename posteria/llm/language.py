"""Language identification by rank-order profiles of character n-grams.

A language's profile lists its most frequent n-grams (one to three letters, a
word's edges count as a blank) by rank. A document is ranked the same way over
its whole text; its distance to a profile is the sum of how far each of its
n-grams is out of place, and the nearest profile names the language.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from posteria.llm.tables import lean, pick, quoted, slices
from posteria.session import stage

UNKNOWN = "und"
TOP = 300  # n-grams of a profile and of a document
SAMPLE = 512  # labelled documents of a language that the profiles are fitted on, at most
BLANK = 1
_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point its lower-cased letter, or the blank. Built once in a worker."""
    if not _LETTERS:
        table = np.full(0x110000, BLANK, np.uint32)
        for code in range(0x110000):
            if unicodedata.category(chr(code))[0] == "L":
                low = chr(code).lower()
                table[code] = ord(low) if len(low) == 1 else code
        _LETTERS.append(table)
    return _LETTERS[0]


def spelled(text: str) -> np.ndarray:
    """Lower-case letters of the text, words between single blanks."""
    codes = letters()[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
    codes = np.concatenate(([BLANK], codes, [BLANK])).astype(np.int64)
    return codes[(codes != BLANK) | np.concatenate(([True], codes[:-1] != BLANK))]


def grams(codes: np.ndarray, bits: int) -> np.ndarray:
    """All n-grams of one to three symbols, packed into integers; none spans two words."""
    if len(codes) < 3:
        return codes[:0]
    a, b, c = codes[:-2], codes[1:-1], codes[2:]
    blank = codes == BLANK
    pairs = codes[:-1] << bits | codes[1:]
    triples = (a << 2 * bits | b << bits | c)[~blank[1:-1]]
    return np.concatenate((codes[~blank], pairs, triples))


def ranked(found: np.ndarray, top: int = TOP) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent n-grams, most frequent first and small codes first among equals, with counts."""
    found = np.sort(found)
    ends = np.flatnonzero(np.concatenate((found[1:] != found[:-1], [True])))
    counts = np.diff(ends, prepend=-1)
    distinct = found[ends]
    if len(counts) > top:
        least = np.partition(counts, len(counts) - top)[len(counts) - top]
        held = counts >= least  # ties at the border stay in and are cut below
        distinct, counts = distinct[held], counts[held]
    order = np.lexsort((distinct, -counts))[:top]
    return distinct[order], counts[order]


class Profiles:
    """Profiles of all languages, over the alphabet that they use.

    Symbols outside it count as one foreign symbol, so n-grams of a document
    fit 24 bits and sort fast.
    """

    def __init__(self, rows: list[tuple[str, int, int]]):
        """``rows``: (language, rank from 0, n-gram over code points)."""
        self.langs = sorted({lang for lang, _, _ in rows})
        wide = [(lang, rank, [g >> 42, g >> 21 & 0x1FFFFF, g & 0x1FFFFF]) for lang, rank, g in rows]
        used = sorted({s for _, _, symbols in wide for s in symbols} - {0, BLANK})
        self.foreign = len(used) + 2
        self.bits = max(2, self.foreign.bit_length())
        self.table = np.full(0x110000, self.foreign, np.int32)
        self.table[BLANK] = BLANK
        for i, symbol in enumerate(used):
            self.table[symbol] = i + 2
        self.table[0] = 0
        packed = [(self.langs.index(lang), rank, self._pack(symbols)) for lang, rank, symbols in wide]
        self.grams = np.array(sorted({g for _, _, g in packed}), np.int64)
        #: rank of each known n-gram in each language; TOP where it has none
        self.ranks = np.full((len(self.grams) + 1, len(self.langs)), -1, np.int64)
        for lang, rank, gram in packed:
            self.ranks[np.searchsorted(self.grams, gram), lang] = rank

    def _pack(self, symbols: list[int]) -> int:
        gram = 0
        for symbol in symbols:
            gram = gram << self.bits | int(self.table[symbol])
        return gram

    def judge(self, text: str | None) -> tuple[str, float, float]:
        """(language, score, margin to the second); ``und`` and zeros without a letter."""
        codes = spelled(text) if text else None
        if codes is None or len(codes) < 3 or not self.langs:
            return UNKNOWN, 0.0, 0.0
        found, _ = ranked(grams(self.table[codes].astype(np.int64), self.bits))
        place = np.minimum(np.searchsorted(self.grams, found), max(len(self.grams) - 1, 0))
        known = self.grams[place] == found
        ranks = self.ranks[np.where(known, place, len(self.grams))]
        out = np.abs(ranks - np.arange(len(found))[:, None])
        distance = np.where(ranks < 0, TOP, np.minimum(out, TOP)).sum(0) / (TOP * len(found))
        best = int(np.argmin(distance))  # the first name among equals
        rest = np.delete(distance, best)
        margin = float(rest.min() - distance[best]) if len(rest) else 1.0
        return self.langs[best], float(1.0 - distance[best]), margin


def learn(
    labelled: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> Profiles:
    """Profiles from at most ``sample`` labelled documents of each language.

    The sample is picked by hashes of id and text, one text for each of
    ``sample`` hash buckets of a language, so that picking is a small combining
    aggregate and rows that repeat an id, or all of a row, add nothing. Rows
    with null id or language take no part; without rows nothing is learned.
    Texts of the sample are read whole. What comes to the driver is ``TOP``
    n-grams for each language.
    """
    rows = pick(labelled, id=id_col, text=text_col, lang=lang_col).filter("id is not null and lang is not null")
    hashed = F.xxhash64("id")
    both = F.struct(hashed.alias("h"), F.xxhash64("text").alias("t"))
    picked = (
        rows.select("lang", F.pmod(hashed, F.lit(sample)).alias("bucket"), both.alias("both"))
        .groupBy("lang", "bucket")
        .agg(F.min("both").alias("both"))
        .select("lang", "both.h", "both.t")
    )
    # ``sample`` rows for each language; staged, so that the planner knows their size and texts need not move
    picked = stage(picked, "sample")
    found = rows.select("lang", "text", hashed.alias("h"), F.xxhash64("text").alias("t")).join(picked, ["lang", "h", "t"], "left_semi")
    chosen = found.groupBy("lang", "h", "t").agg(F.min("text").alias("text")).select("lang", "text")  # copies of a row once

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            by_lang: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text:
                    by_lang.setdefault(lang, []).append(grams(spelled(text), 21))
            for lang, found in by_lang.items():
                distinct, counts = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(distinct), pa.string()), pa.array(distinct, pa.int64()), pa.array(counts, pa.int64())],
                    names=["lang", "gram", "n"],
                )

    counted = chosen.mapInArrow(lean(count), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram")  # distinct n-grams of the sample only
    top = counted.withColumn("rank", F.row_number().over(order) - 1).filter(F.col("rank") < TOP)
    return Profiles([(r["lang"], r["rank"], r["gram"]) for r in top.select("lang", "rank", "gram").collect()])


def identify(
    docs: DataFrame,
    profiles: Profiles,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all by default) plus ``lang_pred``, ``score`` and ``margin``.

    Whole texts are ranked; rows stay where they are. ``lang_pred`` is ``und``
    and ``score`` 0 for a text that is null or has no letter, and for all
    texts if nothing was learned. Score: 1 less the mean out-of-place distance
    as a share of the largest possible. Input columns of the three names are
    replaced. Equal distances go to the first language by name; repeated rows
    are judged alike; no rows give no rows.
    """
    made = ("lang_pred", "score", "margin")
    names = [c for c in (docs.columns if keep is None else keep) if c not in made]
    held = {c: f"_c{i}" for i, c in enumerate(names)}
    text = held.get(text_col, "_text")
    rows = docs.select(*[quoted(c).alias(v) for c, v in (held | {text_col: text}).items()])
    shared = docs.sparkSession.sparkContext.broadcast(profiles)
    kinds = [(f.name, f.dataType.simpleString()) for f in rows.schema.fields if f.name in held.values()]
    out_names = [*[name for name, _ in kinds], *made]

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in slices(batches, text):
            found = [known.judge(t) for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            langs, scores, margins = zip(*found)
            columns = [batch.column(batch.schema.get_field_index(name)) for name, _ in kinds]
            columns += [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(margins, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=out_names)

    schema = ", ".join([f"`{n}` {k}" for n, k in kinds] + ["lang_pred string", "score double", "margin double"])
    return rows.mapInArrow(lean(judged), schema).select(*[quoted(v).alias(c) for c, v in held.items()], *made)


def held_out(id_col: Column) -> Column:
    """Is the document kept from learning? CRC-32 of the id as text leaves 2 on division by 4."""
    return F.coalesce(F.pmod(F.crc32(F.encode(id_col.cast("string"), "UTF-8")), F.lit(4)) == 2, F.lit(False))

"""Repeated byte windows across and inside documents: a depth-limited radix sort of suffixes.

Suffixes are ordered through the first ``width`` bytes only, most significant
digit first; a suffix that is alone after a digit is dropped, and the groups
left after the last digit are exactly the repeated windows.

1. First digit: the least 64-byte gram of the window (by fingerprint). Equal
   windows agree on it and on its place, so a run of neighbouring windows with
   the same gram travels as one row, about one for 60 bytes of text.
2. Second digit: the fingerprint of the whole run. Where all runs of a gram are
   equal, every window of them is repeated (or, if there is one, none).
3. Runs that share a gram and differ are read as bytes and sorted by eight
   bytes at a time in tasks that hold many grams each. A gram with too many
   different runs for one task has its windows dealt out over all tasks by
   fingerprint and counted instead.

The first two digits are counts that combine before they are shuffled, so a
passage that a third of all documents share gathers in no task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posteria.llm.tables import lean, quoted, slices
from posteria.session import stage

GRAM = 64  # bytes of the first digit
PIECE = 1 << 18  # bytes worked on at once
OPENED = 4 << 20  # bytes of texts that a batch of frames opens to, or one text
RUNS = 2048  # different runs of a gram that one task sorts
WINDOWS = 400_000  # windows sorted together
BASE = np.uint64(0x9E3779B97F4A7C15)
BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: list[np.ndarray] = []


def powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, for one piece."""
    if not _POWERS:
        for base in (BASE, BACK):
            steps = np.full(PIECE + 4096, base, np.uint64)
            steps[0] = 1
            _POWERS.append(np.cumprod(steps))
    return _POWERS[0], _POWERS[1]


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


class Piece:
    """Fingerprints of any range of up to ``PIECE`` bytes, by prefix sums."""

    def __init__(self, data: np.ndarray):
        up, self.down = powers()
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.down[start])

    def grams(self, width: int) -> np.ndarray:
        """Fingerprint of the ``width`` bytes from each start."""
        n = len(self.sums) - width
        return mixed((self.sums[width:] - self.sums[:n]) * self.down[:n])


def least(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each ``width`` neighbours, by doubling."""
    size = 1
    while 2 * size <= width:
        values = np.minimum(values[: len(values) - size], values[size:])
        size *= 2
    rest = width - size
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def segments(data: np.ndarray, valid: np.ndarray, owner: np.ndarray, width: int, gram: int):
    """Runs of window starts that share the same least gram.

    ``valid``: starts of whole windows inside one document; ``owner``: the
    document of each byte. Returns (first start, last start, gram start, digit,
    fingerprint of all bytes of the run).
    """
    piece = Piece(data)
    found = piece.grams(gram)
    place = np.arange(len(found), dtype=np.uint64)
    order = (found & ~np.uint64(PIECE * 2 - 1)) | place
    at = (least(order, width - gram + 1) & np.uint64(PIECE * 2 - 1)).astype(np.int64)[valid]
    cut = np.flatnonzero((at[1:] != at[:-1]) | (np.diff(valid) != 1) | (owner[valid[1:]] != owner[valid[:-1]])) + 1
    first = valid[np.concatenate(([0], cut))]
    last = valid[np.concatenate((cut - 1, [len(valid) - 1]))]
    anchor = at[np.concatenate(([0], cut))]
    digit = found[anchor]
    whole = piece.of(first, last + width) ^ mixed(((last - first) << 8 | (anchor - first)).astype(np.uint64))
    return first, last, anchor, digit, whole


def squeezed(df: DataFrame, column: str) -> DataFrame:
    """``df`` with a text column as zstd frames of its UTF-8 bytes (null: empty), for the way through a shuffle.

    Texts shuffle at about half the size that the shuffle's own compression gives.
    """
    names = df.columns
    at = names.index(column)
    kinds = ", ".join(f"`{f.name}` {'binary' if f.name == column else f.dataType.simpleString()}" for f in df.schema.fields)

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in slices(batches, column):
            frames = [press.compress(t or b"") for t in batch.column(at).cast(pa.binary()).to_pylist()]
            columns = [*batch.columns[:at], pa.array(frames, pa.binary()), *batch.columns[at + 1 :]]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return df.mapInArrow(lean(squeeze), kinds)


def unsqueezed(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Batches of bounded size with the texts of their squeezed column."""
    loosen = zstandard.ZstdDecompressor()
    for batch in slices(batches, column, 2 << 20):
        frames = batch.column(batch.schema.get_field_index(column)).to_pylist()
        # repetitive texts are small as frames: what they open to is bounded, not the frames
        start, texts, held = 0, [], 0
        for row, frame in enumerate(frames):
            size = zstandard.frame_content_size(frame)
            if texts and held + size > OPENED:
                yield batch.slice(start, row - start), texts
                start, texts, held = row, [], 0
            texts.append(loosen.decompress(frame))
            held += size
        if texts:
            yield batch.slice(start), texts


def _pieces(texts: list[bytes], keys: np.ndarray, width: int):
    """(bytes, owner of each byte, offset of each owner's first byte, key of each owner), of bounded size."""
    held: list[bytes] = []
    offsets: list[int] = []
    of: list[int] = []
    size = 0

    def done():
        lengths = np.array([len(b) for b in held])
        return np.frombuffer(b"".join(held), np.uint8), lengths, np.array(offsets), keys[of]

    step = PIECE - width
    for i, text in enumerate(texts):
        for start in range(0, len(text) - width + 1, step):
            part = text[start : start + step + width - 1]
            if held and size + len(part) > PIECE:
                yield done()
                held, offsets, of, size = [], [], [], 0
            held.append(part)
            offsets.append(start)
            of.append(i)
            size += len(part)
    if held:
        yield done()


def _runs_of(batches: Iterator[pa.RecordBatch], width: int, gram: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", 2 << 20):
        texts = batch.column(1).cast(pa.binary()).to_pylist()
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        for data, lengths, offsets, of in _pieces([t or b"" for t in texts], keys, width):
            owner = np.repeat(np.arange(len(lengths)), lengths)
            ends = np.cumsum(lengths)
            places = np.arange(len(data))
            valid = places[places + width <= ends[owner]]
            first, last, anchor, digit, whole = segments(data, valid, owner, width, gram)
            who = owner[first]
            start = offsets[who] + first - (ends - lengths)[who]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(of[who], pa.int64()),
                    pa.array(start, pa.int64()),
                    pa.array(last - first + 1, pa.int32()),
                    pa.array(anchor - first, pa.int32()),
                    pa.array(digit.view(np.int64)),
                    pa.array(whole.view(np.int64)),
                ],
                names=["k", "start", "windows", "anchor", "digit", "run"],
            )


RUN = "k long, start long, windows int, anchor int, digit long, run long"
MARK = "k long, start long, end long"


def radix_repeated(data: np.ndarray, at: np.ndarray, group: np.ndarray, width: int) -> np.ndarray:
    """Which of the windows that begin at ``at`` equal another one of their group; eight bytes a pass."""
    words = np.zeros(len(data), np.uint64)
    padded = np.concatenate((data, np.zeros(8, np.uint8))).astype(np.uint64)
    for j in range(8):
        words |= padded[j : j + len(data)] << np.uint64(56 - 8 * j)
    alive = np.arange(len(at))
    for depth in [*range(0, width - 7, 8), *([width - 8] if width % 8 else [])]:
        digit = words[at[alive] + depth]
        order = np.lexsort((digit, group))
        alive, group, digit = alive[order], group[order], digit[order]
        new = np.concatenate(([True], (group[1:] != group[:-1]) | (digit[1:] != digit[:-1])))
        ids = np.cumsum(new) - 1
        many = np.bincount(ids)[ids] > 1
        alive, group = alive[many], ids[many]
        if not len(alive):
            break
    found = np.zeros(len(at), bool)
    found[alive] = True
    return found


def _marks(repeated: np.ndarray, run: np.ndarray, offset: np.ndarray, keys: np.ndarray, starts: np.ndarray, wanted: np.ndarray, width: int):
    """Ranges of bytes that the repeated windows of the wanted runs cover."""
    take = np.flatnonzero(repeated & wanted[run])
    if not len(take):
        return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 3, names=["k", "start", "end"])
    r, o = run[take], offset[take]
    cut = np.flatnonzero((r[1:] != r[:-1]) | (o[1:] != o[:-1] + 1)) + 1
    first, last = np.concatenate(([0], cut)), np.concatenate((cut - 1, [len(take) - 1]))
    who = r[first]
    return pa.RecordBatch.from_arrays(
        [pa.array(keys[who]), pa.array(starts[who] + o[first]), pa.array(starts[who] + o[last] + width)],
        names=["k", "start", "end"],
    )


def _sort_groups(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Radix sort of the runs of whole grams; rows come grouped by digit."""
    held: list[pa.RecordBatch] = []
    windows = 0

    def solve(table: pa.Table):
        column = lambda name: table.column(name).to_numpy()
        counts, keys, starts = column("windows").astype(np.int64), column("k"), column("start")
        data = np.frombuffer(b"".join(table.column("bytes").to_pylist()), np.uint8)
        base = np.concatenate(([0], np.cumsum(counts + width - 1)[:-1]))
        run = np.repeat(np.arange(len(counts)), counts)
        offset = np.arange(len(run)) - np.repeat(np.cumsum(counts) - counts, counts)
        _, gram = np.unique(column("digit"), return_inverse=True)
        place = column("anchor").astype(np.int64)[run] - offset  # how far into the window the gram begins
        repeated = radix_repeated(data, base[run] + offset, gram[run] * width + place, width)
        return _marks(repeated, run, offset, keys, starts, column("n") == 1, width)

    for batch in batches:
        held.append(batch)
        windows += int(pa.compute.sum(batch.column("windows")).as_py() or 0)
        if windows < WINDOWS:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        digits = table.column("digit").to_numpy()
        # the last gram may go on in the next batch
        cut = int(np.argmax(digits == digits[-1]))
        if cut:
            yield solve(table.slice(0, cut).combine_chunks())
            rest = table.slice(cut).combine_chunks()
            held, windows = rest.to_batches(), int(pa.compute.sum(rest.column("windows")).as_py())
    if held and windows:
        yield solve(pa.Table.from_batches(held).combine_chunks())


def _windows_of(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """One row for each window of a run, under its 128-bit fingerprint with the gram's."""
    for batch in slices(batches, "bytes", PIECE):  # a fingerprint reaches no further; a run is shorter
        counts = batch.column("windows").to_numpy().astype(np.int64)
        data = np.frombuffer(b"".join(batch.column("bytes").to_pylist()), np.uint8)
        base = np.concatenate(([0], np.cumsum(counts + width - 1)[:-1]))
        run = np.repeat(np.arange(len(counts)), counts)
        offset = np.arange(len(run)) - np.repeat(np.cumsum(counts) - counts, counts)
        piece, at = Piece(data), base[run] + offset
        place = batch.column("anchor").to_numpy().astype(np.int64)[run] - offset
        seen = piece.of(at, at + width) ^ mixed(place.astype(np.uint64))
        pick = lambda name: pa.array(batch.column(name).to_numpy()[run])
        yield pa.RecordBatch.from_arrays(
            [pick("digit"), pa.array(seen.view(np.int64)), pick("k"), pa.array(batch.column("start").to_numpy()[run] + offset), pick("n")],
            names=["digit", "seen", "k", "start", "n"],
        )


def repeated_ranges(texts: DataFrame, width: int, gram: int = GRAM, runs: int = RUNS) -> DataFrame:
    """(k, start, end) of bytes covered by repeated windows, for ``texts`` of columns k (a 64-bit hash of the text) and text.

    Ranges may overlap. Several rows of the same k stand for copies.
    """
    if width < 16:
        raise ValueError("windows of less than 16 bytes are not supported")
    gram = min(gram, width // 2)
    found = texts.select("k", "text").mapInArrow(lean(lambda batches: _runs_of(batches, width, gram)), RUN)
    found = stage(found, "runs")
    shared = (
        found.groupBy("digit")
        .agg(F.count(F.lit(1)).alias("m"), F.min("run").alias("low"), F.max("run").alias("high"))
        .filter("m > 1")
        .select("digit", (F.col("low") == F.col("high")).alias("equal"))
    )
    shared = stage(shared, "digits")  # so that a gram of many rows can be split in the join
    hot = stage(found.join(shared, "digit"), "shared")
    whole = (F.col("start") + F.col("windows") + F.lit(width - 1)).alias("end")
    settled = hot.filter("equal").select("k", "start", whole)
    # different runs of a gram, each once; a run seen twice is repeated as a whole
    one = F.min(F.struct("k", "start", "windows", "anchor")).alias("one")
    differ = hot.filter("not equal").groupBy("digit", "run").agg(F.count(F.lit(1)).alias("n"), one)
    differ = stage(differ.select("digit", "run", "n", "one.*"), "different")
    # staged, so that a run of many rows can be split in the join, or the list sent to the rows
    often = stage(differ.filter("n > 1").select("digit", "run"), "twice")
    twice = hot.filter("not equal").join(often, ["digit", "run"])
    settled = settled.unionByName(twice.select("k", "start", whole))
    crowded = differ.groupBy("digit").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > runs)
    differ = differ.join(crowded.select("digit", F.lit(True).alias("crowd")), "digit", "left")
    # the bytes of these runs; a run belongs to one text, so a list is no longer than its text
    wanted = F.struct("digit", "run", "n", "start", "windows", "anchor", F.coalesce("crowd", F.lit(False)).alias("crowd"))
    asked = differ.groupBy("k").agg(F.collect_list(wanted).alias("asked"))
    kind = "digit long, run long, n long, k long, start long, windows int, anchor int, crowd boolean, bytes binary"
    pieces = squeezed(texts.select("k", "text"), "text").join(asked, "k").mapInArrow(lean(lambda batches: _bytes_of(batches, width)), kind)
    pieces = stage(pieces.dropDuplicates(["digit", "run"]), "bytes")  # copies of a text gave the same
    sorted_here = (
        pieces.filter("not crowd")
        .repartition("digit")
        .sortWithinPartitions("digit")
        .select("digit", "n", "k", "start", "windows", "anchor", "bytes")
        .mapInArrow(lean(lambda batches: _sort_groups(batches, width)), MARK)
    )
    dealt = pieces.filter("crowd").select("digit", "n", "k", "start", "windows", "anchor", "bytes")
    dealt = dealt.mapInArrow(lean(lambda batches: _windows_of(batches, width)), "digit long, seen long, k long, start long, n long")
    equal = dealt.groupBy("digit", "seen").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("digit", "seen")
    dealt = dealt.filter("n = 1").join(equal, ["digit", "seen"], "left_semi")
    dealt = dealt.select("k", "start", (F.col("start") + F.lit(width)).alias("end"))
    return settled.unionByName(sorted_here).unionByName(dealt).distinct()


def _bytes_of(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    names = ["digit", "run", "n", "k", "start", "windows", "anchor", "crowd", "bytes"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()]
    for batch, texts in unsqueezed(batches, "text"):
        out: list[list] = [[] for _ in names]
        for key, text, asked in zip(batch.column(0).to_pylist(), texts, batch.column(2).to_pylist()):
            for a in asked:
                start, end = a["start"], a["start"] + a["windows"] + width - 1
                if end <= len(text):
                    row = [a["digit"], a["run"], a["n"], key, start, a["windows"], a["anchor"], a["crowd"], text[start:end]]
                    for column, value in zip(out, row):
                        column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=names)


def merged_ranges(ranges: list[tuple[int, int]], size: int) -> list[tuple[int, int]]:
    """Sorted, maximal, within 0 .. size."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(ranges):
        end = min(end, size)
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        elif start < end:
            out.append((start, end))
    return out


def remove_repeats(
    docs: DataFrame,
    width: int = 200,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: Sequence[str] | None = None,
    runs: int = RUNS,
    as_text: bool = False,
) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all by default), n_bytes, removed and kept.

    ``removed``: the maximal byte ranges (start, end) covered by ``width``-byte
    strings that also start anywhere else, in this or another row; overlaps
    count. ``kept``: the other bytes, in order. Texts are UTF-8 bytes; a null
    text is empty; a text shorter than ``width`` keeps all. Two rows with the
    same text are two documents, even if their ids are equal. Input columns of
    the three names are replaced. ``as_text``: ``kept`` is a string, without
    the characters that a cut has split. No rows give no rows; whole texts are
    read, however long. Texts are told apart by a 64-bit hash when
    ranges go back to them.
    """
    made = ("n_bytes", "removed", "kept")
    names = [c for c in (docs.columns if keep is None else keep) if c not in made]
    held = {c: f"_c{i}" for i, c in enumerate(names)}
    text = quoted(text_col).cast("string")
    rows = docs.select(*[quoted(c).alias(v) for c, v in held.items()], text.alias("text"), text.isNull().alias("null"), F.xxhash64(text).alias("k"))
    long = rows.filter(F.octet_length("text") >= width)
    ranges = repeated_ranges(long.select("k", "text"), width, runs=runs)
    # a text has no more ranges than bytes
    by_text = ranges.groupBy("k").agg(F.collect_list(F.struct("start", "end")).alias("ranges"))
    # the text goes once, squeezed, even where it is also one of the columns kept
    own = held.pop(text_col, None)
    joined = squeezed(rows.select(*held.values(), "text", "null", "k"), "text").join(by_text, "k", "left")
    joined = joined.select(*held.values(), "text", "null", "ranges")
    kinds = [(f.name, f.dataType.simpleString()) for f in joined.schema.fields if f.name in held.values()]

    def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in unsqueezed(batches, "text"):
            at = batch.schema.get_field_index("text")
            sizes, removed, kept = [], [], []
            for value, found in zip(texts, batch.column(at + 2).to_pylist()):
                spans = merged_ranges([(r["start"], r["end"]) for r in found or ()], len(value))
                edges = [0, *[e for span in spans for e in span], len(value)]
                sizes.append(len(value))
                removed.append([{"start": a, "end": b} for a, b in spans])
                rest = b"".join(value[a:b] for a, b in zip(edges[::2], edges[1::2]))
                kept.append(rest.decode("utf-8", "ignore") if as_text else rest)
            span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
            columns = [batch.column(batch.schema.get_field_index(n)) for n, _ in kinds]
            if own:
                empty = batch.column(at + 1).to_pylist()
                columns.append(pa.array([None if n else t.decode() for t, n in zip(texts, empty)], pa.string()))
            columns += [pa.array(sizes, pa.int64()), pa.array(removed, pa.list_(span)), pa.array(kept, pa.string() if as_text else pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=[*[n for n, _ in kinds], *([own] if own else []), *made])

    schema = [f"`{n}` {k}" for n, k in kinds] + ([f"{own} string"] if own else []) + ["n_bytes long", "removed array<struct<start:long,end:long>>", "kept string" if as_text else "kept binary"]
    named = {c: held.get(c, own) for c in names}
    return joined.mapInArrow(lean(apart), ", ".join(schema)).select(*[quoted(v).alias(c) for c, v in named.items()], *made)

"""Near-duplicate documents: one-permutation MinHash, bands, star-shaped candidate links.

1. One pass over the texts gives each document its set size, a 128-bit print of
   the set and its band keys. Equal sets are one class, their least id stands
   for them.
2. Classes that share a band key share a bucket. A bucket's first star ties all
   members to one centre, the member with the most bucket mates; only these
   pairs are checked, on full sets.
3. A star can miss a link between two members that its centre does not link.
   The check against the centre also counts, in 32 parts of the hash range, how
   much of a member's set lies inside and outside the centre's. For two members
   these counts bound their overlap from above. Members left outside their
   centre's component are compared with the others around the centre by that
   bound alone, in blocks of bounded size; only pairs that it cannot rule out
   are made, and checked on full sets like the rest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posteria.llm.components import components
from posteria.llm.repeats import PIECE, Piece, mixed
from posteria.llm.tables import lean, pick, slices
from posteria.session import stage

ROWS = 5
BANDS = 40  # a pair at 0.8 shares no band with a chance of 1.3e-7
BINS = ROWS * BANDS
PARTS = 32  # of the hash range, for bounds on overlaps
BLOCK = 2048  # members around a centre that one task holds
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def shingle_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit fingerprints of the runs of ``words`` words of each text.

    Words are runs of bytes other than blank and 9 to 13, A-Z lower-cased. A
    text of fewer words is one run; without a word the set is empty. Short
    texts are worked on together.
    """
    out: list[np.ndarray] = []
    held: list[bytes] = []
    size = 0
    for text in texts:
        if held and size + len(text) + 1 > PIECE:
            out += _sets(held, words)
            held, size = [], 0
        held.append(text)
        size += len(text) + 1
    return out + (_sets(held, words) if held else [])


def _word_prints(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and fingerprint of each word; a text longer than a piece is cut between words."""
    gap = SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], gap, [True])).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    prints = np.zeros(len(start), np.uint64)
    at = 0
    while at < len(start):
        upto = int(np.searchsorted(end, start[at] + PIECE, "right"))
        if upto == at:  # one word longer than a piece: fold its pieces
            value = np.uint64(0)
            for cut in range(int(start[at]), int(end[at]), PIECE):
                part = data[cut : min(cut + PIECE, int(end[at]))]
                value = mixed(Piece(part).of(np.array([0]), np.array([len(part)])) + value)[0]
            prints[at] = value
            at += 1
            continue
        low = int(start[at])
        piece = Piece(data[low : int(end[upto - 1])])
        prints[at:upto] = piece.of(start[at:upto] - low, end[at:upto] - low)
        at = upto
    return start, prints


def _sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    joined = np.frombuffer(b" ".join(texts).lower(), np.uint8)
    lengths = np.array([len(t) + 1 for t in texts])
    ends = np.cumsum(lengths)
    start, prints = _word_prints(joined)
    owner = np.searchsorted(ends, start, "right")
    count = np.bincount(owner, minlength=len(texts))
    shingle = np.zeros(len(prints), np.uint64)
    for i in range(words):  # words beyond the end leave their marks on places that are not used
        shingle = mixed(shingle * np.uint64(0x9E3779B97F4A7C15) + np.roll(prints, -i) + np.uint64(i + 1))
    first = np.cumsum(count) - count
    rank = np.arange(len(prints)) - first[owner]
    use = rank <= count[owner] - words
    short = np.flatnonzero((count > 0) & (count < words))
    for i in short:
        value = np.array([count[i]], np.uint64)
        for p in prints[first[i] : first[i] + count[i]]:
            value = mixed(value * np.uint64(0x9E3779B97F4A7C15) + p)
        shingle[first[i]] = value[0]
        use[first[i]] = True
    values, owner = shingle[use], owner[use]
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    new = np.concatenate(([True], (values[1:] != values[:-1]) | (owner[1:] != owner[:-1]))) if len(values) else np.zeros(0, bool)
    values, owner = values[new], owner[new]
    return np.split(values, np.cumsum(np.bincount(owner, minlength=len(texts)))[:-1])


def probes(bins: int) -> np.ndarray:
    """For each bin its own order of looking through all bins (row: attempt)."""
    place = np.arange(bins * bins, dtype=np.uint64)
    keys = mixed(place + np.uint64(12345)).reshape(bins, bins)
    return np.argsort(keys, axis=0, kind="stable")


_PROBES: dict[int, np.ndarray] = {}


def signatures(sets: list[np.ndarray], bins: int) -> np.ndarray:
    """One-permutation signatures, empty bins filled by optimal densification.

    Fingerprints are already mixed, so their high bits are the bin and the
    first of a bin is its least. An empty bin copies the first full bin in its
    own order of looking; the order is the same for all documents.
    """
    sign = np.full((len(sets), bins), EMPTY, np.uint64)
    lengths = np.array([len(s) for s in sets])
    if not lengths.sum():
        return sign
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), lengths)
    bin_of = ((values >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    cell = owner * bins + bin_of
    first = np.concatenate(([True], cell[1:] != cell[:-1]))
    sign.reshape(-1)[cell[first]] = values[first]
    if bins not in _PROBES:
        _PROBES[bins] = probes(bins)
    full = sign != EMPTY
    row, col = np.nonzero(~full & (lengths > 0)[:, None])
    for attempt in range(bins):
        if not len(row):
            break
        source = _PROBES[bins][attempt, col]
        hit = full[row, source]
        sign[row[hit], col[hit]] = sign[row[hit], source[hit]]
        row, col = row[~hit], col[~hit]
    return sign


def band_keys(sign: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each document and band."""
    keys = np.tile(mixed(np.arange(1, bands + 1, dtype=np.uint64)), (len(sign), 1))
    cells = sign.reshape(len(sign), bands, rows)
    for r in range(rows):
        keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + cells[:, :, r])
    return keys


def _bytes(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def _sketched(batches: Iterator[pa.RecordBatch], words: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", 4 << 20):
        sets = shingle_sets(_bytes(batch.column(1)), words)
        keys = band_keys(signatures(sets, bands * rows), bands, rows).view(np.int64)
        sums = [[int(mixed(s ^ salt).sum(dtype=np.uint64).view(np.int64)) for s in sets] for salt in (np.uint64(1), np.uint64(2))]
        lists = pa.ListArray.from_arrays(np.arange(len(sets) + 1, dtype=np.int32) * bands, pa.array(keys.reshape(-1)))
        columns = [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(sums[0], pa.int64()), pa.array(sums[1], pa.int64()), lists]
        yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "s1", "s2", "keys"])


def _whole_sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", 4 << 20):
        sets = [s.tobytes() for s in shingle_sets(_bytes(batch.column(1)), words)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["id", "held"])


def _counts(values: np.ndarray) -> np.ndarray:
    return np.bincount((values & np.uint64(PARTS - 1)).astype(np.int64), minlength=PARTS).astype(np.uint32)


def _compared(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """(a, b, is it a link, counts of b's set inside and outside a's by part of the hash range)."""
    for batch in slices(slices(batches, "left"), "right"):
        linked, counts = [], []
        for left, right in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            a, b = np.frombuffer(left, np.uint64), np.frombuffer(right, np.uint64)
            both = np.sort(np.concatenate((a, b)), kind="stable")
            shared = both[1:][both[1:] == both[:-1]]
            linked.append(100 * len(shared) >= percent * (len(both) - len(shared)))
            inside = _counts(shared)
            counts.append(np.concatenate((inside, _counts(b) - inside)).tobytes())
        columns = [*batch.columns[:2], pa.array(linked, pa.bool_()), pa.array(counts, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "linked", "counts"])


def _checked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a: centre, b: member) compared on their full sets."""
    members = pairs.join(sets.select(F.col("id").alias("b"), F.col("held").alias("right")), "b")
    whole = members.join(sets.select(F.col("id").alias("a"), F.col("held").alias("left")), "a")
    id_type = dict(pairs.dtypes)["a"]
    kind = f"a {id_type}, b {id_type}, linked boolean, counts binary"
    return whole.select("a", "b", "left", "right").mapInArrow(lean(lambda x: _compared(x, percent)), kind)


def _possible(outside: pa.Table, around: pa.Table, percent: int) -> pa.Table:
    """Pairs of different components around one centre that the counts do not rule out."""
    column = lambda t, name: t.column(name).to_pylist()
    counts = lambda t: np.frombuffer(b"".join(column(t, "counts")), np.uint32).reshape(-1, 2 * PARTS)
    ids: tuple[list, list] = ([], [])
    if outside.num_rows and around.num_rows:
        mine, theirs = counts(outside), counts(around)
        size = theirs.sum(1, dtype=np.int64)
        # components as numbers, for quick comparison
        number = {c: i for i, c in enumerate({*column(outside, "component"), *column(around, "component")})}
        group = np.array([number[c] for c in column(around, "component")])
        other = column(around, "id")
        for row, own, component in zip(mine, column(outside, "id"), column(outside, "component")):
            most = np.minimum(theirs, row).sum(1, dtype=np.int64)
            fits = 100 * most >= percent * (size + int(row.sum(dtype=np.int64)) - most)
            for i in np.flatnonzero(fits & (group != number[component])).tolist():
                ids[0].append(min(own, other[i]))
                ids[1].append(max(own, other[i]))
    kind = outside.schema.field("id").type
    return pa.table({"a": pa.array(ids[0], kind), "b": pa.array(ids[1], kind)})


def _missed(checked: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """Pairs around the centres that may be links between components."""
    label = found.select(F.col("node").alias("id"), "component")
    around = checked.select(F.col("a").alias("centre"), F.col("b").alias("id"), "counts").join(label, "id", "left")
    around = around.withColumn("component", F.coalesce("component", "id"))
    middle = label.select(F.col("id").alias("centre"), F.col("component").alias("home"))
    around = around.join(middle, "centre", "left")
    around = stage(around.withColumn("outside", F.col("component") != F.coalesce("home", "centre")), "around")
    blocks = lambda n: F.ceil(n / F.lit(BLOCK)).cast("long")
    sizes = around.groupBy("centre").agg(
        blocks(F.count(F.lit(1))).alias("blocks"), blocks(F.sum(F.col("outside").cast("long"))).alias("chunks")
    )
    # centres with someone outside; staged, so that a hot centre can be split in the joins below
    sizes = stage(sizes.filter("chunks > 0"), "sizes")
    placed = around.join(sizes, "centre")
    upto = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    some = lambda c: F.pmod(F.xxhash64("id"), F.col(c))
    rows = ["centre", "id", "counts", "component"]
    left = placed.filter("outside").select(*rows, some("chunks").alias("chunk"), upto("blocks").alias("block"))
    right = placed.select(*rows, some("blocks").alias("block"), upto("chunks").alias("chunk"))
    right = right.select(*[F.col(c).alias(f"_{c}") for c in right.columns])  # both sides come from one table
    cell = ["centre", "chunk", "block"]
    id_type = dict(checked.dtypes)["a"]
    pairs = left.groupBy(*cell).cogroup(right.groupBy(*[f"_{c}" for c in cell])).applyInArrow(
        lambda x, y: _possible(x, y.rename_columns([c.removeprefix("_") for c in y.column_names]), percent), f"a {id_type}, b {id_type}"
    )
    return pairs.distinct()


def near_duplicates(
    docs: DataFrame,
    words: int = 5,
    percent: int = 80,
    id_col: str = "doc_id",
    text_col: str = "text",
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """id, n_shingles, component_id and kept of every row.

    Documents are linked if 100 * shared >= ``percent`` * united distinct runs
    of ``words`` words; ``component_id`` is the least id reachable over links
    and ``kept`` tells whether it is the row's own. A text without words, or
    null, has no set and no link. Rows of a null id take no part: their
    component is null and they are kept. Rows that repeat an id are one node:
    they tie the components of all their texts.
    Whole texts are read, however long; no rows give no rows. Extra columns
    are left out.
    """
    texts = pick(docs, id=id_col, text=text_col)
    texts = texts.select("id", F.col("text").cast("string").alias("text"))
    id_type = texts.schema["id"].dataType.simpleString()
    kind = f"id {id_type}, n long, s1 long, s2 long, keys array<long>"
    sketch = stage(texts.mapInArrow(lean(lambda x: _sketched(x, words, bands, rows)), kind), "sketch")
    named = sketch.filter("id is not null and n > 0")
    same = ["n", "s1", "s2"]
    classes = stage(named.groupBy(*same).agg(F.min("id").alias("rep")), "classes")
    stands = named.join(classes, same).filter("id = rep")
    keyed = stands.select("id", "n", F.explode("keys").alias("bucket"))
    sizes = keyed.groupBy("bucket").agg(F.count_distinct("id").alias("size")).filter("size > 1")
    # staged, so that a hot bucket can be split in the join
    members = keyed.join(stage(sizes, "sizes"), "bucket").select("id", "bucket", "size").distinct()
    members = stage(members, "buckets")
    mates = members.groupBy("id").agg(F.sum("size").alias("mates"))
    wanted = mates.select("id")
    sets = texts.join(wanted.hint("shuffle_hash"), "id").select("id", "text").mapInArrow(
        lean(lambda x: _whole_sets(x, words)), f"id {id_type}, held binary"
    )
    sets = stage(sets, "sets")
    # the centre of a bucket is the member with the most mates, the least id among equals
    centre = members.join(mates, "id").groupBy("bucket").agg(F.min(F.struct(-F.col("mates"), "id")).alias("c"))
    centre = stage(centre.select("bucket", F.col("c.id").alias("a")), "centres")
    star = members.join(centre, "bucket").filter(F.col("id") != F.col("a"))
    star = stage(star.select("a", F.col("id").alias("b")).distinct(), "pairs")
    checked = stage(_checked(star, sets, percent), "checked")
    # an id with several texts ties their classes: a star around the least of them
    repeated = sketch.filter("id is not null").groupBy("id").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    repeated = stage(repeated.select("id"), "repeated")
    homes = named.join(repeated, "id").join(classes, same).select("id", "rep").distinct()
    homes = stage(homes, "homes")
    least = stage(homes.groupBy("id").agg(F.min("rep").alias("a")), "least")
    ties = homes.join(least, "id").filter("rep <> a").select("a", F.col("rep").alias("b"))
    links = checked.filter("linked").select("a", "b").unionByName(ties)
    found = stage(components(links, "a", "b"), "components")
    missed = stage(_missed(checked, found, percent), "pairs")
    more = stage(_checked(missed, sets, percent).filter("linked").select("a", "b"), "checked")
    found = stage(components(links.unionByName(more), "a", "b"), "components")
    # from classes back to rows
    label = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left")
    label = label.select(*same, F.coalesce("component", "rep").alias("component"))
    # rows without words go with the other rows of their id
    home = least.join(found.withColumnRenamed("node", "a"), "a", "left").select("id", F.coalesce("component", "a").alias("home"))
    out = sketch.select("id", *same).join(label, same, "left").join(stage(home, "home"), "id", "left")
    by_id = F.when(F.col("id").isNull(), F.lit(None)).otherwise(F.coalesce("component", "home", "id"))
    out = out.select("id", "n", by_id.cast(id_type).alias("component"))
    return out.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.col("component").alias("component_id"),
        F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"),
    )

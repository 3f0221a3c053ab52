"""Ranked lexical search by pipelined term partitioning.

The index is dealt out by term to a few owners, rare terms to the first, and
by blocks of documents, so that no list is longer than a block. A bundle of
items travels with its sparse accumulators, one bundle for each block, through
the owners: at each it meets that owner's lists of the block in a cogroup,
adds what they contribute and goes on. Contributions are whole numbers, so the
order in which they are added does not matter. After the last owner the ten
best of a block are known, and the best of all blocks are the answer.

Between owners an accumulator goes only if it cannot reach the answer any
more: if even the most that the later owners may add to it leaves it below the
k-th best score its item already has in the block. Scores never fall, so this
loses nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (loads pa.compute)
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from posteria.llm.tables import lean, pick, slices
from posteria.operators.ranks import key_ranks
from posteria.session import stage

#: Fixed: what a term is, once A-Z are in lower case.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
#: The same for UTF-8: bytes of terms in lower case, all others blank. No byte of another character is below 0x80.
SOLID = bytes((c | 32 if chr(c).isalpha() else c) if c > 127 or chr(c).isalnum() else 32 for c in range(128)) + bytes(range(128, 256))
BLOCK_DOCS = 4096  # documents of a block, fewer if their texts are long
BLOCK_BYTES = 8 << 20
BUNDLE_ITEMS = 64
OWNERS = 3  # an owner holds terms of up to APART times the documents of the one before
APART = 8
MOST = 10**6  # no term adds more than its weight times this


def terms_of(text: str | None) -> list[str]:
    return regex.findall(TERM, (text or "").translate(LOWER))


class _Codes(dict):
    """Numbers of terms, in the order in which they are first met."""

    def __missing__(self, term: bytes) -> int:
        self[term] = code = len(self)
        return code


def _sliced(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """The bytes of the values between neighbouring cuts, as one binary value each."""
    offsets = (cuts * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(values.tobytes())])


def _index(docs: DataFrame) -> DataFrame:
    """block, term, local, tf, n, total: lists of the documents of a block that hold a term, and how often.

    The list of the empty term (no text has it) names every document that has
    terms: its place in the block, its length and, in ``ids``, its id.
    """
    id_type = docs.schema["id"].dataType.simpleString()

    def inverted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        codes, found, lengths, ids, held = _Codes(), [], [], [], 0

        def block() -> pa.RecordBatch:
            n, sizes = len(codes) + 1, np.array(lengths, np.int64)
            places = np.repeat(np.arange(sizes.size), sizes)
            # one number for each term of each document, in the order of terms and then documents
            pairs, tf = np.unique(np.concatenate(found) * BLOCK_DOCS + places, return_counts=True)
            term, local = np.divmod(pairs, BLOCK_DOCS)
            ends = np.cumsum(np.bincount(term, minlength=n - 1))
            local = np.concatenate((np.arange(sizes.size), local)).astype("<u2")
            tf = np.concatenate((sizes, tf)).astype("<u4")
            cuts = np.concatenate(([0, sizes.size], sizes.size + ends))
            named = pa.concat_arrays(ids)
            offsets = pa.array(np.concatenate(([0], np.full(n, len(named)))), pa.int32())
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(n, number), pa.int64()),
                    pa.array([b"", *codes], pa.binary()).cast(pa.string()),
                    _sliced(local, cuts),
                    _sliced(tf, cuts),
                    pa.array(np.diff(cuts), pa.int64()),
                    pa.array(np.add.reduceat(tf, cuts[:-1], dtype=np.int64), pa.int64()),
                    pa.ListArray.from_arrays(offsets, named),
                ],
                names=["block", "term", "local", "tf", "n", "total", "ids"],
            )

        for batch in slices(batches, "text", 1 << 20):
            for row, text in enumerate(batch.column(1).cast(pa.binary()).to_pylist()):
                terms = text.translate(SOLID).split() if text else ()
                if not terms:
                    continue
                found.append(np.fromiter(map(codes.__getitem__, terms), np.int64, len(terms)))
                lengths.append(len(terms))
                ids.append(batch.column(0).slice(row, 1))
                held += len(text)
                if len(ids) >= BLOCK_DOCS or held >= BLOCK_BYTES:
                    yield block()
                    codes, found, lengths, ids, held = _Codes(), [], [], [], 0
                    number += 1
        if ids:
            yield block()
        del codes, found

    kind = f"block long, term string, local binary, tf binary, n long, total long, ids array<{id_type}>"
    return docs.mapInArrow(lean(inverted), kind)


def _bundles(items: DataFrame) -> DataFrame:
    """bundle, slot, item, id, term, times: the terms of every item, ``BUNDLE_ITEMS`` items to a bundle."""
    lower = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = stage(items.withColumn("item", F.monotonically_increasing_id()), "items")
    found = rows.withColumn("lowered", lower).select("item", "id", F.explode(F.expr(f"regexp_extract_all(lowered, r'{TERM}', 0)")).alias("term"))
    terms = found.groupBy("item", "id", "term").agg(F.count(F.lit(1)).alias("times"))
    placed = key_ranks(rows, ["item"], ["item"])
    bundle, slot = F.floor(F.col("position") / BUNDLE_ITEMS), F.pmod("position", F.lit(BUNDLE_ITEMS))
    return stage(terms.join(placed.select("item", bundle.alias("bundle"), slot.alias("slot")), "item"), "bundled")


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _unpacked(packed: bytes, items: int, docs: int) -> np.ndarray:
    """Accumulators of a bundle as a table of items by documents of the block."""
    table = np.zeros((items, docs), np.int64)
    if packed:
        n = int(np.frombuffer(packed, "<u4", 1)[0])
        where = np.frombuffer(packed, "<u4", n, 4)
        table.reshape(-1)[where] = np.frombuffer(packed, "<i8", n, 4 + 4 * n)
    return table


def _packed(table: np.ndarray) -> bytes:
    """The accumulators that are not zero: their number, places and scores."""
    where = np.flatnonzero(table)
    return np.uint32(where.size).tobytes() + where.astype("<u4").tobytes() + table.reshape(-1)[where].astype("<i8").tobytes()


def search(
    docs: DataFrame,
    items: DataFrame,
    k: int = 10,
    owners: int = OWNERS,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` documents of highest score above 0 for every item.

    A term weighs floor(1000 ln((2N + 2) / (2 df + 1))) and adds, for each
    time the item holds it, weight * (10^9 tf div (1000 tf + 8 m)), where m is
    25 + (75 n N div L): N documents with terms, L terms in all, n in this one.
    Equal scores go by ascending id, nulls first. Whole texts are read,
    however long. Null and empty texts have no terms: such documents are never
    found and such items get no rows. Rows that repeat an id are documents, or
    items, of their own, so a repeated item is answered once for each row.
    Empty tables give no rows; extra columns are left out.
    """
    if owners < 1:
        raise ValueError("there must be one owner at least")
    bundled = _bundles(pick(items, id=item_col, text=item_text_col))
    spark = docs.sparkSession
    # the texts are read once; of each block the lists that some item needs are written
    wanted = bundled.select("term").distinct().unionByName(spark.createDataFrame([("",)], "term string"))
    index = stage(_index(pick(docs, id=id_col, text=text_col)).join(stage(wanted, "terms"), "term"), "index")
    blocks, lists = index.filter("term = ''"), index.filter("term != ''").drop("ids", "total")
    n_docs, n_terms = blocks.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    uses = _owned(bundled, lists, n_docs, owners)
    found = _carried(blocks, lists, uses, bundled, n_docs, n_terms, k, owners)
    best = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("id").asc_nulls_first())
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    names = bundled.select("item", F.col("id").alias("name")).distinct()
    return ranked.join(names, "item").select(F.col("name").alias(item_col), "rank", F.col("id").alias(id_col), "score")


def _owned(bundled: DataFrame, lists: DataFrame, n_docs: int, owners: int) -> DataFrame:
    """bundle, term, df, owner, uses, most: how the items of a bundle use a term, and what it can add for one use."""
    df = lists.groupBy("term").agg(F.sum("n").alias("df"))
    owner = sum(((F.col("df") * APART**later > n_docs).cast("int") for later in range(1, owners)), F.lit(0))
    # one above the weight: an upper bound however the logarithm is rounded
    most = (F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1))) + 1) * MOST
    use = F.struct(F.col("slot").cast("int").alias("slot"), "times")
    used = bundled.groupBy("bundle", "term").agg(F.collect_list(use).alias("uses"))  # one for each item of the bundle at most
    return stage(used.join(df, "term").select("bundle", "term", "df", "uses", owner.alias("owner"), most.alias("most")), "uses")


def _rests(uses: DataFrame, owners: int) -> DataFrame:
    """bundle, slot, rest_<p>: the most that owners from p on can add to an item's score."""
    use = uses.select("bundle", "owner", "most", F.explode("uses").alias("use"))
    rest = lambda p: F.coalesce(F.sum(F.when(F.col("owner") >= p, F.col("most") * F.col("use.times"))), F.lit(0))
    return use.groupBy("bundle", F.col("use.slot").alias("slot")).agg(*[rest(p).alias(f"rest_{p}") for p in range(owners)])


def _carried(
    blocks: DataFrame, lists: DataFrame, uses: DataFrame, bundled: DataFrame, n_docs: int, n_terms: int, k: int, owners: int
) -> DataFrame:
    """item, id, score: the k best documents of every block for each item."""
    spark = blocks.sparkSession
    rests = stage(_rests(uses, owners), "rests")
    last_bundle = uses.agg(F.max("bundle")).first()[0]
    if last_bundle is None:  # no document holds a term of an item
        return spark.createDataFrame([], f"item long, id {_element(blocks)}, score long")
    # every bundle goes to every block: a stated set of queries against all rows, in blocks
    sent = blocks.select("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(last_bundle))).alias("bundle"))
    sent = sent.join(rests.select("bundle").distinct(), "bundle", "left_semi")  # those with a term that is found
    travelling, floors = sent.withColumn("scores", F.lit(None).cast("binary")), None
    for p in range(owners):
        last = p + 1 == owners
        known = rests.join(floors, ["bundle", "slot"], "left") if floors is not None else rests.withColumn("floor", F.lit(None).cast("long"))
        told = F.struct("slot", F.col(f"rest_{p}").alias("before"), (F.lit(0).cast("long") if last else F.col(f"rest_{p + 1}")).alias("after"), F.coalesce("floor", F.lit(0).cast("long")).alias("floor"))
        known = stage(known.groupBy("bundle").agg(F.collect_list(told).alias("items")), "known")  # one for each item of the bundle
        left = travelling.join(known, "bundle")
        own = lists.join(uses.filter(F.col("owner") == p).drop("owner", "most"), "term").select("bundle", "block", "term", "local", "tf", "df", "uses", F.lit(None).cast(blocks.schema["ids"].dataType).alias("ids"))
        lengths = sent.join(blocks, "block").select(
            "bundle", "block", "term", "local", "tf", F.lit(0).cast("long").alias("df"),
            F.lit(None).cast(uses.schema["uses"].dataType).alias("uses"), (F.col("ids") if last else F.lit(None).cast(blocks.schema["ids"].dataType)).alias("ids"),
        )
        right = own.unionByName(lengths).withColumnsRenamed({"bundle": "_bundle", "block": "_block"})
        met = left.groupBy("bundle", "block").cogroup(right.groupBy("_bundle", "_block"))
        if last:
            best = met.applyInArrow(_step(n_docs, n_terms, k, True), f"bundle long, slot long, id {_element(blocks)}, score long")
            items = stage(bundled.select("bundle", "slot", "item").distinct(), "slots")
            return stage(best.join(items, ["bundle", "slot"]).select("item", "id", "score"), "best")
        travelling = stage(met.applyInArrow(_step(n_docs, n_terms, k, False), "bundle long, block long, scores binary, best array<struct<slot:long,score:long>>"), "bundles")
        # the k-th best score that an item has so far, over all blocks: its final one is not lower
        high = travelling.select("bundle", F.explode("best").alias("b")).select("bundle", "b.slot", "b.score")
        order = Window.partitionBy("bundle", "slot").orderBy(F.col("score").desc())
        floors = stage(high.withColumn("r", F.row_number().over(order)).filter(F.col("r") == k).select("bundle", "slot", F.col("score").alias("floor")), "floors")
        travelling = travelling.drop("best")


def _element(blocks: DataFrame) -> str:
    return blocks.schema["ids"].dataType.elementType.simpleString()


def _step(n_docs: int, n_terms: int, k: int, last: bool):
    """What happens where a bundle meets the lists of one owner in one block."""

    def met(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        bundle, block = (x.as_py() for x in key)
        told = left["items"][0].as_py()
        slots = np.array([t["slot"] for t in told])
        row_of = {slot: row for row, slot in enumerate(slots.tolist())}
        before, after, floor = (np.array([t[name] for t in told], np.int64) for name in ("before", "after", "floor"))
        terms = right["term"].to_pylist()
        own = terms.index("")
        lengths = np.frombuffer(right["tf"][own].as_py(), "<u4").astype(np.int64)
        m8 = 8 * (25 + (75 * lengths * n_docs) // n_terms)
        scores = _unpacked(left["scores"][0].as_py(), len(told), lengths.size)
        # what cannot reach the answer any more is let go, and not begun
        scores[scores + before[:, None] < floor[:, None]] = 0
        closed = np.flatnonzero(before < floor)
        shut = scores[closed] == 0
        for i, term in enumerate(terms):
            if i == own:
                continue
            places = np.frombuffer(right["local"][i].as_py(), "<u2")
            tf = np.frombuffer(right["tf"][i].as_py(), "<u4").astype(np.int64)
            add = weight(n_docs, right["df"][i].as_py()) * ((10**9 * tf) // (1000 * tf + m8[places]))
            for use in right["uses"][i].as_py():
                scores[row_of[use["slot"]], places] += use["times"] * add
        if closed.size:
            held = scores[closed]
            held[shut] = 0
            scores[closed] = held
        scores[scores + after[:, None] < floor[:, None]] = 0
        if last:
            return _answers(bundle, slots, scores, right["ids"][own].values, k)
        best = []
        for row, slot in enumerate(slots.tolist()):
            line = scores[row]
            high = line if line.size <= k else np.partition(line, line.size - k)[-k:]
            best += [{"slot": slot, "score": int(x)} for x in high if x > 0]
        kind = pa.list_(pa.struct([("slot", pa.int64()), ("score", pa.int64())]))
        columns = [pa.array([bundle], pa.int64()), pa.array([block], pa.int64()), pa.array([_packed(scores)], pa.binary()), pa.array([best], kind)]
        return pa.Table.from_arrays(columns, names=["bundle", "block", "scores", "best"])

    return met


def _answers(bundle: int, slots: np.ndarray, scores: np.ndarray, ids: pa.Array, k: int) -> pa.Table:
    """The k best documents of the block for each item, ties by id, nulls first."""
    order = pa.compute.sort_indices(ids, null_placement="at_start").to_numpy()
    rank = np.empty(order.size, np.int64)
    rank[order] = np.arange(order.size)
    of, places, values = [], [], []
    for row, slot in enumerate(slots.tolist()):
        line = scores[row]
        found = np.flatnonzero(line)
        if found.size > k:
            found = found[line[found] >= np.partition(line[found], found.size - k)[-k]]
        found = found[np.lexsort((rank[found], -line[found]))][:k]
        of += [slot] * found.size
        places += found.tolist()
        values += line[found].tolist()
    columns = [pa.array([bundle] * len(of), pa.int64()), pa.array(of, pa.int64()), ids.take(pa.array(places, pa.int64())), pa.array(values, pa.int64())]
    return pa.Table.from_arrays(columns, names=["bundle", "slot", "id", "score"])

"""k nearest neighbours through a tree of cells.

Training rows are split again and again into cells around pivots, rows of the
cell itself, until a cell fits one task; a cell of any size is split in blocks
and no level holds more than a fixed number of pivots for a cell. A query goes
down to at most ``probes`` cells, so its copies are bounded whatever the number
of dimensions, and tasks return k candidates per query, never pairs.

The distances to pivots and the radii of the cells give, by the triangle
inequality, a lower bound for everything a query has not seen. Where its k-th
neighbour is nearer than that, the answer is certain; with ``exact`` the other
queries, and only these, are compared with all rows, block by block, so that
what moves is bounded also where the bounds rule out next to nothing, as with
many features: both sides are written once in blocks and a product of the two
reads them. A trial with some queries, first among a sample of the rows, shows
whether the tree pays at all. Vectors move in single precision where that holds
all of them exactly.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (loads pa.compute)
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from posteria.functions.seeded import seeded_hash
from posteria.operators.joins import join_groups
from posteria.operators.ranks import key_ranks
from posteria.session import stage

FAN = 64  # cells that one cell is split into
PROBES = 16  # cells that a query is sent to at first
BLOCK = 4096  # rows of a side in one task
BROADCAST_NUMBERS = 4_000_000  # a training table of up to so many numbers (32 MB) is sent to the queries instead
SCAN_NUMBERS = 8_000_000  # numbers (64 MB) of a side in one task where all rows are compared
PACKED_NUMBERS = 262_144  # numbers of a block that is one row of the product
PRODUCT_GROUPS = 16  # groups with at least this part of all pairs are compared by a product
TRIAL = 2048  # queries that show whether the tree pays
SAMPLE = 16_384  # rows among which the first trial is made
_CHUNK = 4_000_000  # numbers in one distance block


def _distances(a: np.ndarray, b: np.ndarray, p: float) -> np.ndarray:
    """Exact to the last digits, by differences; ``a`` and ``b`` broadcast over all but the last axis."""
    gap = np.abs(a - b)
    if p == 2:
        return np.sqrt(np.einsum("...d,...d->...", gap, gap))
    if p == 1:
        return gap.sum(-1)
    return (gap**p).sum(-1) ** (1 / p)


def _table(a: np.ndarray, b: np.ndarray, p: float) -> tuple[np.ndarray, np.ndarray | float]:
    """Distances of all rows of ``a`` to all of ``b`` and how far off they can be.

    Euclidean ones come from one matrix product, after moving the origin to the
    middle of ``b``; others from differences.
    """
    if p != 2:
        return _distances(a[:, None, :], b[None], p), 0.0
    middle = b.mean(0)
    a, b = a - middle, b - middle
    squares = np.einsum("qd,qd->q", a, a)[:, None] + np.einsum("td,td->t", b, b)[None]
    # rounding of the sum of products, relative to the squares, turned into a distance
    off = np.sqrt(squares * (1e-15 * (a.shape[1] + 8)))
    return np.sqrt(np.maximum(squares - 2 * (a @ b.T), 0.0)), off


def _pairs(y: np.ndarray, x: np.ndarray, near: np.ndarray, far: np.ndarray, p: float) -> np.ndarray:
    """Exact distances of the rows ``near`` of ``y`` to the rows ``far`` of ``x``, one by one."""
    out = np.empty(len(near))
    for s in _chunks(len(near), x.shape[1]):
        out[s] = _distances(y[near[s]], x[far[s]], p)
    return out


class _Tiles:
    """Quick lower bounds of the distances of tiles of ``y`` to tiles of ``x``, to some power.

    Euclidean ones are squares from one matrix product, less what rounding can
    have added, in single precision where that tells some rows apart; the square
    of the row of ``y`` is left to the bound, that of ``x``, less its share of the
    rounding, is one more feature. Manhattan ones are sums over
    features in steps of whole numbers: clipping and rounding down to steps
    bring two rows nearer by less than a step a feature or leave them, and
    |a - b| is 2 max(a, b) - a - b. Others are the distances.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray, p: float):
        self.p, self.power, self.x, self.y = p, 1, x, y
        self.rows, self.columns = 64, max(1, 65536 // x.shape[1])
        if p == 2:
            middle = x.mean(0)
            a, b = x - middle, y - middle
            top = max(np.abs(a).max(), np.abs(b).max())
            if not (top == 0 or 1e-140 < top < 1e140):
                return
            # a power of two brings all into the range of single precision
            self.size = 2.0 ** -np.frexp(top)[1]
            a *= self.size
            b *= self.size
            sx, self.sy = np.einsum("td,td->t", a, a), np.einsum("qd,qd->q", b, b)
            # rounding of the numbers and of the sum of products, relative to the squares
            self.slack, self.least, kind = 6e-8 * (x.shape[1] + 8), 1e-35, np.float32  # and what is too small for it
            few, some = (slice(None, None, max(1, len(v) // n)) for v, n in ((b, 32), (a, 2048)))
            d = self.sy[few][:, None] + sx[some] - 2 * (b[few] @ a[some].T)
            room = np.partition(d, min(8, d.shape[1] - 1), axis=1)[:, [min(8, d.shape[1] - 1)]] + self.slack * (self.sy[few][:, None] + 2 * sx[some]) + self.least
            if (d <= room).mean() > 0.02 + 9 / d.shape[1]:  # rows too near for it, compared with their size
                self.slack, self.least, kind = 1e-15 * (x.shape[1] + 8), 1e-300, np.float64
            self.x = np.column_stack([-2 * a, sx * (1 - 2 * self.slack)]).astype(kind)
            self.y = np.column_stack([b, np.ones(len(b))]).astype(kind)
            self.power, self.rows, self.columns = 2, 512, 2048
            self.table = np.empty(self.rows * self.columns, kind)
        elif p == 1 and x.shape[1] < 32768:
            some = x[:: max(1, len(x) // 2048)]  # only the size of a step depends on these
            low, high = np.quantile(some, [0.001, 0.999], axis=0)
            self.step = (high - low).sum() / (65535 - x.shape[1])
            if not 1e-290 < self.step < 1e290:
                return
            self.rows, self.columns = 128, 1024
            wide = np.floor((high - low) / self.step)
            steps = lambda v: np.ascontiguousarray(np.clip((v - low) / self.step, 0, wide).T.astype(np.uint16))
            self.x, self.y = steps(x), steps(y)
            self.sx, self.sy = (v.sum(0, dtype=np.int64).astype(np.int32) for v in (self.x, self.y))
            self.most, self.sum = (np.empty(self.rows * self.columns, np.uint16) for _ in range(2))

    def quick(self, q: slice, t: slice) -> tuple[np.ndarray, float, np.ndarray | float]:
        """(table, a, b): what the table shows times a, less b, is no more than the distance to the power."""
        if self.power == 2:
            y, x, sy = self.y[q], self.x[t], self.sy[q]
            table = np.matmul(y, x.T, out=self.table[: len(y) * len(x)].reshape(len(y), len(x)))
            less = sy * self.slack + self.least
            return table, self.size**-2, ((less - sy) / self.size**2)[:, None]
        if self.rows != 128:
            return _distances(self.y[q][:, None, :], self.x[t][None], self.p), 1.0, 0.0
        shape = (len(self.sy[q]), len(self.sx[t]))
        most, total = (v[: shape[0] * shape[1]].reshape(shape) for v in (self.most, self.sum))
        total[:] = 0
        for a, b in zip(self.y, self.x):
            np.maximum(a[q, None], b[None, t], out=most)
            total += most
        table = total.astype(np.int32)
        table *= 2
        table -= self.sx[t]
        table -= self.sy[q][:, None]
        return table, self.step, self.step * (len(self.x) + 1)


def _chunks(n: int, width: int) -> Iterator[slice]:
    step = max(1, _CHUNK // max(width, 1))
    return (slice(i, i + step) for i in range(0, n, step))


def _matrix(column) -> np.ndarray:
    """A column of equally long lists as rows of numbers in double precision."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(len(column), -1)


def nearest_rows(
    x: np.ndarray, keys: np.ndarray, y: np.ndarray, skip: np.ndarray, has: np.ndarray, k: int, p: float, bound: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of y, row of x, distance) of the k nearest rows of ``x`` for each of ``y``; ties to the smaller key.

    ``skip``: for each row of ``y`` the key that is not its neighbour, where it
    ``has`` one. Rows beyond ``bound`` may be left out. Only pairs that a quick
    distance does not rule out are measured exactly.
    """
    found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
    if not k or not len(x) or not len(y):
        return found[0]
    tiles = _Tiles(x, y, p)
    for start in range(0, len(y), tiles.rows):
        q = slice(start, min(start + tiles.rows, len(y)))
        reach = np.full(q.stop - q.start, np.inf) if bound is None else bound[q].copy()
        rows, places, far = found[0]
        for at in range(0, len(x), tiles.columns):
            t = slice(at, min(at + tiles.columns, len(x)))
            table, scale, less = tiles.quick(q, t)
            limit = reach
            new = np.flatnonzero(np.isinf(reach))
            if len(new) and t.stop - t.start > k:
                # so many rows, one of them may be the query's own, say how far its neighbours can be
                few = np.argpartition(table[new], k, axis=1)[:, : k + 1]
                limit = reach.copy()
                limit[new] = _pairs(y[q], x[t], np.repeat(new, k + 1), few.ravel(), p).reshape(few.shape).max(1)
            limit = (((limit * (1 + 1e-9)) ** tiles.power)[:, None] + less) / scale
            if table.dtype == np.float32:
                limit = np.nextafter(limit.astype(np.float32), np.float32(np.inf))
            hit = np.flatnonzero(table.min(1) <= limit[:, 0])  # after the first tiles few rows have something new
            i, j = np.divmod(np.flatnonzero(table[hit] <= limit[hit]), t.stop - t.start)
            i = hit[i]
            other = ~(has[q][i] & (keys[t][j] == skip[q][i]))
            i, j = i[other], j[other]
            if not len(i):
                continue
            d = _pairs(y[q], x[t], i, j, p)
            rows, places, far = np.concatenate([rows, i]), np.concatenate([places, j + at]), np.concatenate([far, d])
            order = np.lexsort((keys[places], far, rows))
            rows, places, far = rows[order], places[order], far[order]
            rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
            reach[rows[rank == k - 1]] = np.minimum(reach[rows[rank == k - 1]], far[rank == k - 1])
            rows, places, far = rows[rank < k], places[rank < k], far[rank < k]
        found.append((rows + start, places, far))
    rows, places, far = (np.concatenate(c) for c in zip(*found))
    seen = np.isfinite(far)
    return rows[seen], places[seen], far[seen]


def _found(left: pa.Table, right: pa.Table, k: int, p: float, payload: bool) -> pa.Table:
    """The k nearest rows of ``left`` (one group) for each row of ``right``."""
    keys = left["_key"].to_numpy()
    skip = right["_skip"]
    own, has = skip.fill_null(0).to_numpy(), skip.is_valid().to_numpy()
    bound = right["_bound"].to_numpy() if "_bound" in right.column_names else None
    q, t, d = nearest_rows(_matrix(left["_x"]), keys, _matrix(right["_x"]), own, has, k, p, bound)
    columns = [right["_group"].take(q), right["_qkey"].take(q), pa.array(keys[t]), pa.array(d)]
    names = ["_group", "_qkey", "_key", "_d"]
    if payload:
        columns.append(left["_y"].take(t))
        names.append("_y")
    return pa.table(columns, names=names)


def _fields(payload: bool) -> str:
    return "_group string, _qkey long, _key long, _d double" + (", _y array<double>" if payload else "")


def _scan_small(train: DataFrame, query: DataFrame, k: int, p: float, payload: bool) -> DataFrame:
    """Training table of measured size on every executor; queries do not move and
    each one's neighbours are found in its own task."""
    held = train.toArrow().combine_chunks().sort_by([("_group", "ascending"), ("_key", "ascending")])
    groups = held["_group"].to_numpy()
    first = {g: (np.searchsorted(groups, g), np.searchsorted(groups, g, "right")) for g in dict.fromkeys(groups.tolist())}
    handle = query.sparkSession.sparkContext.broadcast((held, first))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, first = handle.value
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for group in table["_group"].unique().to_pylist():
                if group in first:
                    start, end = first[group]
                    part = table.filter(pa.compute.equal(table["_group"], group))
                    yield from _found(held.slice(start, end - start), part, k, p, payload).combine_chunks().to_batches()

    return query.mapInArrow(scan, _fields(payload))


# --- the tree ---------------------------------------------------------------------------


def _salted(rows: DataFrame, sizes: DataFrame, key: str, block: int) -> DataFrame:
    """Rows of the cells in ``sizes`` (group, cell, n), each with its ``_salt`` of n / block."""
    salts = F.ceil(F.col("n") / block)
    return rows.join(sizes, ["_group", "_cell"]).withColumn("_salt", F.pmod(F.xxhash64(key), salts)).drop("n")


def _for_salts(rows: DataFrame, sizes: DataFrame, block: int) -> DataFrame:
    """Rows of the cells in ``sizes``, one for each salt, under names of their own."""
    salts = F.explode(F.sequence(F.lit(0).cast("long"), (F.ceil(F.col("n") / block) - 1).cast("long")))
    out = rows.join(sizes, ["_group", "_cell"]).withColumn("_salt", salts).drop("n")
    return out.withColumnsRenamed({c: f"_p{c}" for c in out.columns})


def _meet(rows: DataFrame, others: DataFrame, step, fields: str) -> DataFrame:
    """``step`` over the rows of a cell's salt and the others of it."""
    on = ["_group", "_cell", "_salt"]

    def met(left: pa.Table, right: pa.Table) -> pa.Table:
        return step(left, right.rename_columns([c[2:] for c in right.column_names]))

    return rows.groupBy(*on).cogroup(others.groupBy(*[f"_p{c}" for c in on])).applyInArrow(met, fields)


def _split(train: DataFrame, block: int, fan: int, p: float, payload: bool) -> tuple[DataFrame, list[DataFrame]]:
    """Rows with the cell of at most ``block`` rows that they end in, and for each level the pivots:
    (_group, _cell, _child, _x, _radius)."""
    rows, levels = stage(train.withColumn("_cell", F.lit("")), "cells"), []
    fields = f"_group string, _key long, _x {dict(train.dtypes)['_x']}, _one boolean" + (", _y array<double>" if payload else "") + ", _cell string, _r double"

    def assign(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], left[c].type) for c in own] + [pa.array([], pa.string()), pa.array([], pa.float64())], names=[*own, "_cell", "_r"])
        x, pivots, children = _matrix(left["_x"]), _matrix(right["_x"]), right["_child"].to_numpy()
        cells, radius = np.empty(len(x), np.int64), np.empty(len(x))
        for s in _chunks(len(x), len(pivots) if p == 2 else pivots.size):
            cells[s] = _table(x[s], pivots, p)[0].argmin(1)
            # any cell may take a row, but what radii are made of is exact
            radius[s] = _pairs(x, pivots, np.arange(len(x))[s], cells[s], p)
        parent = left["_cell"][0].as_py()
        names = np.array([f"{parent}/{c}" for c in children.tolist()], object)[cells]
        return pa.table([*[left[c] for c in own], pa.array(names, pa.string()), pa.array(radius)], names=[*own, "_cell", "_r"])

    own = [c for c in rows.columns if c != "_cell"]
    while True:
        big = stage(rows.groupBy("_group", "_cell").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > block), "big")
        if not big.head(1):
            return rows, levels
        order = Window.partitionBy("_group", "_cell").orderBy(seeded_hash(["_group", "_key"], 7 + len(levels)), "_key")
        different = rows.filter("_one").join(big.drop("n"), ["_group", "_cell"])  # copies of a row are no pivots of their own
        pivots = different.withColumn("_child", F.row_number().over(order) - 1).filter(F.col("_child") < fan)
        pivots = stage(pivots.select("_group", "_cell", "_child", "_x"), "pivots")
        dealt = stage(_meet(_salted(rows, big, "_key", block), _for_salts(pivots, big, block), assign, fields), "split")
        size = dealt.groupBy("_group", F.col("_cell").alias("_below")).agg(F.max("_r").alias("_radius"))
        named = pivots.withColumn("_below", F.concat("_cell", F.lit("/"), F.col("_child").cast("string")))
        levels.append(stage(named.join(size, ["_group", "_below"]).select("_group", "_cell", "_below", "_x", "_radius"), "level"))
        rows = stage(rows.join(big, ["_group", "_cell"], "left_anti").unionByName(dealt.drop("_r")), "cells")


def _down(query: DataFrame, levels: list[DataFrame], block: int, p: float, probes: int) -> DataFrame:
    """Queries with the cells at the bottom that they go to, at most ``probes`` of the nearest for each;
    ``_cut`` is the least distance that anything in the others can have."""
    kept = [c for c in query.columns]
    block = max(block, BLOCK)  # cells can be smaller than what a task takes of the queries
    # what is carried from level to level is the place of a query, its vector is fetched by it
    query = stage(query.withColumn("_place", F.monotonically_increasing_id()), "placed")
    vectors = query.select("_place", "_x")
    at = query.select("_place", "_group", "_qkey").withColumns({"_cell": F.lit(""), "_far": F.lit(0.0), "_least": F.lit(0.0), "_cut": F.lit(float("inf"))})
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in at.schema.fields)
    names = at.columns

    def expand(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return left.slice(0, 0).select(names)
        y, pivots, radius = _matrix(left["_x"]), _matrix(right["_x"]), right["_radius"].to_numpy()
        cut = left["_cut"].to_numpy().copy()
        rows, cells, far, bound = [], [], [], []
        for s in _chunks(len(y), len(pivots) if p == 2 else pivots.size):
            d, off = _table(y[s], pivots, p)
            # what floating distances may be off by is taken from the bound
            low = np.maximum((d - off) * (1 - 1e-9) - radius[None] * (1 + 1e-9), 0.0)
            wanted = np.ones_like(low, bool)
            if probes < d.shape[1]:
                wanted[:] = False
                np.put_along_axis(wanted, np.argpartition(d, probes - 1, axis=1)[:, :probes], True, 1)
                cut[s] = np.minimum(cut[s], np.where(wanted, np.inf, low).min(1))
            q, c = np.nonzero(wanted)
            rows.append(q + s.start)
            cells.append(c)
            far.append(d[q, c])
            bound.append(low[q, c])
        rows, cells = np.concatenate(rows), np.concatenate(cells)
        made = {"_cell": right["_below"].take(pa.array(cells)), "_far": pa.array(np.concatenate(far)), "_least": pa.array(np.concatenate(bound)), "_cut": pa.array(cut[rows])}
        return pa.table([made[c] if c in made else left[c].take(pa.array(rows)) for c in names], names=names)

    for level in levels:
        inner = level.select("_group", "_cell").distinct()
        sizes = at.join(inner, ["_group", "_cell"]).groupBy("_group", "_cell").agg(F.count(F.lit(1)).alias("n"))
        sizes = stage(sizes, "sizes")
        going = at.join(vectors, "_place")
        more = _meet(_salted(going, sizes, "_place", block), _for_salts(level, sizes, block), expand, fields)
        ended = at.join(sizes, ["_group", "_cell"], "left_anti")
        at = ended.unionByName(more)
        mine = Window.partitionBy("_group", "_qkey")  # at most probes * probes rows, without the vectors
        place = F.row_number().over(mine.orderBy("_far", "_cell", "_place"))
        at = at.withColumn("_r", place)
        left_out = F.min(F.when(F.col("_r") > probes, F.col("_least"))).over(mine)
        at = at.withColumn("_cut", F.least(F.min("_cut").over(mine), left_out)).filter(F.col("_r") <= probes).drop("_r")
        at = stage(at, "routed")
    return at.drop("_group", "_qkey").join(query, "_place").select(*kept, "_cell", "_cut")


def _nearest_of(k: int, p: float, payload: bool):
    """Step for ``_meet``: the k nearest rows of the other side for each query."""
    names = ["_group", "_qkey", "_key", "_d"] + (["_y"] if payload else [])
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.float64()] + ([pa.list_(pa.float64())] if payload else [])

    def near(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], t) for t in kinds], names=names)
        return _found(right, left, k, p, payload)

    return near


def _search(train: DataFrame, routed: DataFrame, k: int, p: float, payload: bool, block: int) -> DataFrame:
    """The k nearest of each query in each cell that it was sent to."""
    block = max(block, BLOCK)
    sizes = stage(routed.groupBy("_group", "_cell").agg(F.count(F.lit(1)).alias("n")), "sizes")
    near = _nearest_of(k, p, payload)
    return _meet(_salted(routed, sizes, "_qkey", block), _for_salts(train, sizes, block), near, _fields(payload))


def _scan(train: DataFrame, query: DataFrame, k: int, p: float, payload: bool, block: int = SCAN_NUMBERS) -> DataFrame:
    """The k nearest of each query in each block of its group's training rows, each query compared with every row.

    The few groups that have most of the pairs are compared by a product of
    blocks, the others in a grid: both sides are cut into blocks of at most
    ``block`` numbers and each block meets each of the other side in a task.
    """
    width = F.max(F.size("_x") + (F.size("_y") if payload else F.lit(0)))
    blocks_of = lambda n, w: F.ceil(F.col(n) * F.col(w) / block)
    cores = train.sparkSession.sparkContext.defaultParallelism
    sizes = train.groupBy("_group").agg(F.count(F.lit(1)).alias("_n"), width.alias("_w")).join(
        query.groupBy("_group").agg(F.count(F.lit(1)).alias("_m"), F.max(F.size("_x")).alias("_v")), "_group")
    pairs = F.col("_n").cast("double") * F.col("_m")
    sizes = stage(sizes.crossJoin(sizes.agg(F.sum(pairs).alias("_all"))).withColumn("_share", pairs / F.col("_all")), "sizes")
    large = sizes.filter((F.col("_share") >= 1 / PRODUCT_GROUPS) & (F.greatest("_n", "_m") > BLOCK)).collect()  # at most so many rows
    names = [r["_group"] for r in large]
    grid = sizes.filter(~F.col("_group").isin(names)).select("_group", "_m", "_share", blocks_of("_n", "_w").alias("_rows"), blocks_of("_m", "_v").alias("_least"))
    # queries are cut finer where their blocks would leave cores without work
    tasks = F.ceil(8 * cores * F.col("_share") / F.col("_rows"))
    more = F.greatest("_least", F.least(tasks, F.ceil(F.col("_m") / BLOCK)))
    grid = stage(grid.select("_group", F.col("_rows").cast("int").alias("_rows"), more.cast("int").alias("_asks")), "grid")
    dealt = lambda key, n: F.pmod(F.xxhash64(key, "_x"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rows = train.join(grid, "_group").withColumn("_cell", dealt("_key", "_rows")).withColumn("_salt", every("_asks"))
    asks = query.join(grid, "_group").withColumn("_salt", dealt("_qkey", "_asks")).withColumn("_cell", every("_rows"))
    rows = rows.drop("_rows", "_asks").withColumnsRenamed({c: f"_p{c}" for c in rows.columns})
    found = _meet(asks.drop("_rows", "_asks"), rows, _nearest_of(k, p, payload), _fields(payload))
    if not large:
        return found
    total = lambda n, w: sum(r[n] * r[w] for r in large)
    parts = max(1, -(-total("_n", "_w") // block))
    cuts = max(-(-total("_m", "_v") // block), -(-4 * cores // parts))
    by_product = _product(train.filter(F.col("_group").isin(names)), query.filter(F.col("_group").isin(names)), parts, cuts, k, p, payload)
    return by_product if grid.isEmpty() else found.unionByName(by_product)


def _packed(rows: DataFrame, parts: int, label: str) -> DataFrame:
    """Rows of a group as blocks of ``PACKED_NUMBERS``, one row each: the vectors as bytes, the other columns as lists; in ``parts`` files."""
    single = dict(rows.dtypes)["_x"] == "array<float>"
    lists = [(f.name, f.dataType.simpleString()) for f in rows.schema.fields if f.name not in ("_group", "_x")]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for group in table["_group"].unique().to_pylist():
                part = table.filter(pa.compute.equal(table["_group"], group)).combine_chunks()
                x = _matrix(part["_x"]).astype(np.float32 if single else np.float64, copy=False)
                step = -(-len(x) // -(-x.size // PACKED_NUMBERS))
                for at in range(0, len(x), step):
                    s = slice(at, at + step)
                    columns = [pa.array([group]), pa.array([x[s].tobytes()], pa.binary())]
                    for name, _ in lists:
                        held = part[name].slice(at, step).combine_chunks()
                        held = held.chunk(0) if isinstance(held, pa.ChunkedArray) else held
                        columns.append(pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), held))
                    yield pa.RecordBatch.from_arrays(columns, names=["_group", "_x", *[n for n, _ in lists]])

    fields = ", ".join(["_group string, _x binary", *[f"{n} array<{t}>" for n, t in lists]])
    return stage(rows.mapInArrow(pack, fields).repartition(parts), label)


def _product(train: DataFrame, query: DataFrame, parts: int, cuts: int, k: int, p: float, payload: bool) -> DataFrame:
    """The k nearest of each query in each part of the rows. Each side is written once, in ``parts`` and
    ``cuts`` files of blocks; what a task reads again are files, nothing is copied through a shuffle."""
    kind = np.float32 if dict(train.dtypes)["_x"] == "array<float>" else np.float64
    rows = _packed(train.select("_group", "_x", "_key", *(["_y"] if payload else [])), parts, "rows")
    own = [c for c in query.columns if c in ("_qkey", "_skip", "_bound")]
    asks = _packed(query.select("_group", "_x", *own), cuts, "asks")
    rows, asks = (side.withColumn("_block", F.monotonically_increasing_id()) for side in (rows, asks))
    both = asks.join(rows.withColumnsRenamed({c: f"_p{c}" for c in rows.columns}).hint("shuffle_replicate_nl"), F.col("_group") == F.col("_p_group"))
    sides = {"": own, "_p": ["_key", *(["_y"] if payload else [])]}

    def table(group: str, blocks: list[pa.RecordBatch], sign: str) -> pa.Table:
        made = {n: pa.concat_arrays([b.column(sign + n).flatten() for b in blocks]) for n in sides[sign]}
        x = np.concatenate([np.frombuffer(b.column(sign + "_x")[0].as_buffer(), kind) for b in blocks])
        size = len(made[sides[sign][0]])
        lists = pa.ListArray.from_arrays(pa.array(np.arange(size + 1) * (len(x) // size), pa.int32()), pa.array(x))
        return pa.table({"_group": pa.array([group] * size), "_x": lists, **made})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = {"": {}, "_p": {}}  # blocks of each side by group and number: they come once for each of the other side
        for batch in batches:
            for sign, names in sides.items():
                columns = batch.select([f"{sign}_group", f"{sign}_x", *[sign + n for n in names]])
                for i, (group, number) in enumerate(zip(batch.column(f"{sign}_group").to_pylist(), batch.column(f"{sign}_block").to_pylist())):
                    if number not in (held := seen[sign].setdefault(group, {})):
                        held[number] = columns.take(pa.array([i]))  # a copy, so that the batch can go
        for group, asked in seen[""].items():
            left, right = table(group, list(seen["_p"][group].values()), "_p"), table(group, list(asked.values()), "")
            yield from _found(left, right, k, p, payload).combine_chunks().to_batches()

    return both.mapInArrow(run, _fields(payload))


def _best(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("_group", "_qkey").orderBy("_d", "_key"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k)


def _probed(
    rows: DataFrame, levels: list[DataFrame], query: DataFrame, k: int, p: float, payload: bool, block: int, probes: int
) -> tuple[DataFrame, DataFrame]:
    """(the k nearest in the cells that queries are sent to, for each query its ``_reach`` and
    ``certain``: whether the bounds prove that it has no nearer ones)."""
    routed = stage(_down(query, levels, block, p, probes), "routed")
    near = stage(_best(_search(rows, routed, k, p, payload, block), k), "near")
    reach = near.groupBy("_group", "_qkey").agg(
        # fewer than k found means nothing is ruled out
        F.when(F.count(F.lit(1)) >= k, F.max("_d")).otherwise(F.lit(float("inf"))).alias("_reach")
    )
    cut = routed.groupBy("_group", "_qkey").agg(F.min("_cut").alias("_cut"))
    known = join_groups(cut, reach, ["_group", "_qkey"], "left").na.fill(float("inf"), ["_reach"])
    # equal distances go to the smaller key, which may be in a cell not seen: certain needs less
    known = known.withColumn("certain", (F.col("_reach") < F.col("_cut")) | (F.col("_cut") == float("inf")))
    return near, stage(known, "known")


def _settled(rows: DataFrame, levels: list[DataFrame], query: DataFrame, k: int, p: float, block: int, probes: int) -> float:
    """The share of some of the queries that the tree settles."""
    step = max(1, query.count() // TRIAL)
    some = query.filter(F.pmod(F.xxhash64("_qkey"), F.lit(step)) == 0)
    _, known = _probed(rows.select("_group", "_key", "_x", "_cell"), levels, some, k, p, False, block, probes)
    settled, asked = known.agg(F.count_if("certain"), F.count(F.lit(1))).first()
    return settled / asked if asked else 1.0


def _sample_settled(train: DataFrame, query: DataFrame, n: int, k: int, p: float, block: int, fan: int, probes: int) -> float:
    """The same among a sample of the ``n`` rows, in cells as wide as those of all of them: the nearest of few rows
    stands for the k-th of all. Where a sample of so many rows would be too thin for that, 1."""
    step = n // SAMPLE
    if step < 2 or step > 64:
        return 1.0
    few = train.select("_group", "_key", "_x", "_one").filter(F.pmod(F.xxhash64("_key", F.lit("sample")), F.lit(step)) == 0)
    block = max(2 * (k + 1), block // step)
    rows, levels = _split(few, block, fan, p, False)
    return _settled(rows, levels, query, 1, p, block, probes)


def _through_tree(
    train: DataFrame, query: DataFrame, k: int, p: float, payload: bool, block: int, fan: int, probes: int, exact: bool, n: int | None
) -> DataFrame:
    """Neighbours with ``certain``. Queries that the tree leaves open are compared with all rows if ``exact``;
    with the number of rows ``n`` trials are made, and all are, where the tree settles less than half of some
    first queries, or less than a quarter of them among a sample of the rows."""
    trial = exact and n is not None
    all_compared = lambda rows: _best(_scan(rows, query, k, p, payload), k).withColumn("certain", F.lit(True))
    if trial and _sample_settled(train, query, n, k, p, block, fan, probes) < 0.25:
        return all_compared(train)
    rows, levels = _split(train, block, fan, p, payload)
    if trial and _settled(rows, levels, query, k, p, block, probes) < 0.5:
        return all_compared(rows)
    near, known = _probed(rows, levels, query, k, p, payload, block, probes)
    near = join_groups(near, known.select("_group", "_qkey", "certain"), ["_group", "_qkey"])
    if exact:
        open_ones = known.filter(~F.col("certain")).select("_group", "_qkey", (F.col("_reach") * (1 + 1e-9) + 1e-12).alias("_bound"))
        again = stage(join_groups(query, open_ones, ["_group", "_qkey"]), "again")
        rest = _best(_scan(rows, again, k, p, payload), k)
        return near.filter("certain").unionByName(rest.withColumn("certain", F.lit(True)))
    return near


def _group_of(by: str | None):
    """The group as text that is never null, so that a null group stays a group."""
    return F.coalesce(F.concat(F.lit("="), F.col(by).cast("string")), F.lit("")) if by else F.lit("")


def _named(near: DataFrame, by: str | None, payload: Sequence[str], certify: bool) -> DataFrame:
    label = F.when(F.col("_group") != "", F.substring("_group", 2, 1 << 30)).alias("_group")
    named = near.select(
        label, F.col("_qkey").alias("query"), "rank", F.col("_key").alias("neighbour"),
        F.col("_d").alias("distance"), *([F.col("_y").alias("payload")] if payload else []), *(["certain"] if certify else []),
    )
    return named.withColumnRenamed("_group", by) if by else named.drop("_group")


def _narrowed(rows: DataFrame) -> DataFrame:
    """``_x`` in single precision where that is exactly the vector, else in ``_wide``."""
    same = F.forall("_x", lambda v: v.isNull() | (v.cast("float").cast("double") == v))
    return rows.withColumns({"_x": F.when(same, F.col("_x").cast("array<float>")), "_wide": F.when(~same, F.col("_x"))})


def _widened(rows: DataFrame) -> DataFrame:
    return rows.withColumn("_x", F.coalesce("_wide", F.col("_x").cast("array<double>"))).drop("_wide")


def _key_list(key: str | Sequence[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def _knn_composite(
    train: DataFrame, query: DataFrame, train_key: list[str], query_key: list[str], **how
) -> DataFrame:
    """Numbers the keys of both sides in their order, searches by number, puts the keys back as structs."""
    both = train.select(*train_key).union(query.select(*query_key)).distinct()
    numbers = stage(key_ranks(both, train_key, train_key).withColumnRenamed("position", "_kn"), "keys")
    own = numbers.withColumnsRenamed(dict(zip(train_key, query_key)))
    near = knn(join_groups(train, numbers, train_key), join_groups(query, own, query_key), "_kn", "_kn", **how)
    columns = near.columns
    key = F.struct(*train_key)
    near = near.join(numbers.select(F.col("_kn").alias("query"), key.alias("_q")), "query")
    near = near.join(numbers.select(F.col("_kn").alias("neighbour"), key.alias("_n")), "neighbour")
    back = {"query": F.col("_q").alias("query"), "neighbour": F.col("_n").alias("neighbour")}
    return near.select(*[back.get(c, F.col(c)) for c in columns])


def knn(
    train: DataFrame, query: DataFrame, train_key: str | Sequence[str], query_key: str | Sequence[str], feats: Sequence[str], k: int = 5,
    p: float = 2.0, by: str | None = None, payload: Sequence[str] = (), skip_self: bool = False,
    fan: int | None = None, block: int = BLOCK, probes: int = PROBES, exact: bool = True, certify: bool = False,
) -> DataFrame:
    """Rows (group, query, rank, neighbour, distance[, payload array][, certain]).

    Minkowski distance with p >= 1; ties go to the smaller training key. Keys
    are one whole number or a list of columns; with a list ``query`` and
    ``neighbour`` are structs of the training key's columns. A row with a null,
    NaN or infinite feature is no neighbour and has none.

    With ``exact`` the answer is that of comparing all rows. Without it a query
    is compared with the rows of at most ``probes`` cells of at most ``block``
    rows; ``certify`` then adds whether the triangle inequality proves its
    answer. A training table of measured small size is sent to the queries,
    where all answers are exact; giving ``fan``, the cells that a cell is split
    into, asks for the tree at any size.
    """
    how = dict(feats=feats, k=k, p=p, by=by, payload=payload, skip_self=skip_self, fan=fan, block=block, probes=probes, exact=exact, certify=certify)
    if not (isinstance(train_key, str) and isinstance(query_key, str)):
        return _knn_composite(train, query, _key_list(train_key), _key_list(query_key), **how)
    if p < 1:
        raise ValueError("p must be at least 1, the search relies on the triangle inequality")
    if probes < 1 or (fan is not None and fan < 2):
        raise ValueError("a query needs a cell to go to, and a cell two or more to be split into")
    vector = F.array(*[F.col(c).cast("double") for c in feats]).alias("_x")
    group = _group_of(by).alias("_group")
    extra = [F.array(*[F.col(c).cast("double") for c in payload]).alias("_y")] if payload else []
    finite = F.forall("_x", lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False)))
    t = train.select(group, F.col(train_key).cast("long").alias("_key"), vector, *extra)
    own = F.col(query_key).cast("long")
    skip = own if skip_self else F.lit(None).cast("long")
    q = query.select(group, own.alias("_qkey"), skip.alias("_skip"), vector)

    # of identical vectors only the k+1 smallest keys can ever be neighbours, so
    # a heap of copies shrinks before it is searched
    copy = F.row_number().over(Window.partitionBy("_group", "_x", "_wide").orderBy("_key"))
    t = _narrowed(t).withColumn("_copy", copy).filter(F.col("_copy") <= k + 1).withColumn("_one", F.col("_copy") == 1).drop("_copy")
    # looked at once written: before, the planner would carry the test of every feature through the caller's plan
    t = stage(t, "rows")
    pay = bool(payload)
    n = _widened(t).filter(finite).count() if fan is None else None
    if fan is None and n * (len(feats) + len(payload) + 1) <= BROADCAST_NUMBERS:
        near = _scan_small(_widened(t).filter(finite).drop("_one"), q, k, p, pay)
        near = _best(near, k).withColumn("certain", F.lit(True))
    else:
        q = stage(_narrowed(q), "queries")
        single = all(side.filter(F.col("_wide").isNotNull()).isEmpty() for side in (t, q))
        t, q = ((side.drop("_wide") if single else _widened(side)).filter(finite) for side in (t, q))
        near = _through_tree(t, q, k, p, pay, max(block, 2 * (k + 1)), fan or FAN, probes, exact, n)
    return _named(near, by, payload, certify)


def knn_predict(
    train: DataFrame, query: DataFrame, train_key: str | Sequence[str], query_key: str | Sequence[str], feats: Sequence[str],
    targets: Sequence[str], k: int = 5, p: float = 2.0, weights: str = "uniform", **how,
) -> DataFrame:
    """Mean of the neighbours' targets, plain or weighted by 1/distance (a
    neighbour at distance zero then decides alone)."""
    if weights not in ("uniform", "distance"):
        raise ValueError("weights must be 'uniform' or 'distance'")
    found = knn(train, query, train_key, query_key, feats, k, p, payload=targets, **how)
    if weights == "distance":
        zero = F.max((F.col("distance") == 0).cast("int")).over(Window.partitionBy("query"))  # k rows
        found = found.withColumn("zero", zero)
        w = F.when(F.col("zero") == 1, (F.col("distance") == 0).cast("double")).otherwise(
            F.try_divide(F.lit(1.0), F.col("distance"))
        )
    else:
        w = F.lit(1.0)
    found = found.withColumn("w", w)
    if isinstance(train_key, str) and isinstance(query_key, str):
        own = [F.col("query").alias(query_key)]
    else:
        own = [F.col("query")[t].alias(q) for t, q in zip(_key_list(train_key), _key_list(query_key))]
    return found.groupBy(*own).agg(
        *[
            F.try_divide(F.sum(F.col("w") * F.col("payload")[i]), F.sum("w")).alias(f"pred_{t}")
            for i, t in enumerate(targets)
        ]
    )

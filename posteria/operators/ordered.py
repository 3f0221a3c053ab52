"""Order statistics of one column from one sorted pass.

Values are counted, sorted by ranges and cut into blocks; a block keeps its
values and says how many there are, between which bounds, and their mean and
sum of squares about it. Medians, median deviations and every round of a clip
are then searches over the blocks of a group: whole blocks count by what they
say, and only the few that a bound or a wanted place falls into are opened.

A search runs first without any block open and names those it had to guess
about; it runs again with these open until it had to guess about none, so the
number of jobs does not depend on the rounds of a clip.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from posteria.functions.arrays import MAD_TO_SIGMA
from posteria.operators.joins import join_groups
from posteria.session import stage

LEAST_BLOCK = 4096  # different values of a block,
MOST_BLOCKS = 1 << 16  # more where the whole table would have more blocks than this


class Ordered:
    """The blocks of one group in order, some of them open."""

    def __init__(self, n, low, high, mean, m2, opened: dict[int, tuple[np.ndarray, np.ndarray]]):
        self.n, self.low, self.high, self.mean, self.m2, self.opened = n, low, high, mean, m2, opened
        self.ends = np.cumsum(n)
        self.size = int(self.ends[-1]) if len(n) else 0
        self.guessed: set[int] = set()

    def _values(self, block: int) -> tuple[np.ndarray, np.ndarray]:
        """Values and counts of a block; made up evenly, and noted, if it is not open."""
        if self.low[block] == self.high[block]:
            return self.low[block : block + 1], self.n[block : block + 1]
        if block not in self.opened:
            self.guessed.add(block)
            steps = min(int(self.n[block]), 64)
            counts = np.diff(np.linspace(0, int(self.n[block]), steps + 1).astype(np.int64))
            return np.linspace(self.low[block], self.high[block], steps), counts
        return self.opened[block]

    def at(self, place: int) -> float:
        """The value at a place, from 0."""
        block = int(np.searchsorted(self.ends, place, "right"))
        values, counts = self._values(block)
        inside = place - (int(self.ends[block]) - int(self.n[block]))
        return float(values[np.searchsorted(np.cumsum(counts), inside, "right")])

    def quantile(self, q: float, first: int = 0, size: int | None = None) -> float:
        """Interpolated quantile of ``size`` values from the place ``first``."""
        h = ((self.size if size is None else size) - 1) * q
        low = self.at(first + math.floor(h))
        return low if h == math.floor(h) else low + (self.at(first + math.ceil(h)) - low) * (h - math.floor(h))

    def median(self, first: int = 0, size: int | None = None) -> float:
        size = self.size if size is None else size
        return (self.at(first + (size - 1) // 2) + self.at(first + size // 2)) / 2

    def inside(self, low: float, high: float) -> tuple[int, int, float, float]:
        """First place, number, mean and population deviation of the values from ``low`` to ``high``."""
        whole = (self.low >= low) & (self.high <= high)
        parts = [(self.n[whole], self.mean[whole], self.m2[whole])]
        first = int(self.n[self.high < low].sum())
        for block in np.flatnonzero(~whole & (self.high >= low) & (self.low <= high)).tolist():
            values, counts = self._values(block)
            first += int(counts[values < low].sum())
            kept = (values >= low) & (values <= high)
            if kept.any():
                v, c = values[kept], counts[kept]
                mean = float((v * c).sum() / c.sum())
                parts.append((np.array([c.sum()]), np.array([mean]), np.array([(c * (v - mean) ** 2).sum()])))
        n, mean, m2 = (np.concatenate(p) for p in zip(*parts))
        total = int(n.sum())
        if not total:
            return first, 0, math.nan, math.nan
        middle = float((mean * n).sum() / total)
        return first, total, middle, math.sqrt(max(float((m2 + n * (mean - middle) ** 2).sum()) / total, 0.0))

    def _near(self, centre: float, away: float, low: float, high: float) -> tuple[int, int, list[int]]:
        """Least and greatest number of values in ``low`` to ``high`` within ``away`` of the centre, and the blocks that decide."""
        # rounded differences rise with the distance, so whole blocks are judged by their bounds
        far = np.maximum(np.abs(self.low - centre), np.abs(self.high - centre))
        near = np.where((self.low <= centre) & (centre <= self.high), 0.0, np.minimum(np.abs(self.low - centre), np.abs(self.high - centre)))
        full = (far <= away) & (self.low >= low) & (self.high <= high)
        sure = int(self.n[full].sum())
        open_ones, most = [], sure
        for block in np.flatnonzero(~full & (near <= away) & (self.high >= low) & (self.low <= high)).tolist():
            if block in self.opened or self.low[block] == self.high[block]:
                values, counts = self._values(block)
                kept = int(counts[(np.abs(values - centre) <= away) & (values >= low) & (values <= high)].sum())
                sure, most = sure + kept, most + kept
            else:
                open_ones.append(block)
                most += int(self.n[block])
        return sure, most, open_ones

    def _deviation(self, centre: float, place: int, low: float, high: float) -> float:
        """The distance to the centre at a place in the order of distances: bisection over all doubles from 0 on."""
        least, most = 0, int(np.float64(np.inf).view(np.int64))
        while least < most:
            middle = (least + most) // 2
            sure, possible, open_ones = self._near(centre, float(np.int64(middle).view(np.float64)), low, high)
            if sure > place:
                most = middle
            elif possible <= place:
                least = middle + 1
            else:  # only the open values can tell
                self.guessed.update(open_ones)
                if (sure + possible) // 2 > place:
                    most = middle
                else:
                    least = middle + 1
        return float(np.int64(least).view(np.float64))

    def mad_std(self, centre: float, low: float = -math.inf, high: float = math.inf, size: int | None = None) -> float:
        size = self.size if size is None else size
        places = sorted({(size - 1) // 2, size // 2})
        found = [self._deviation(centre, p, low, high) for p in places]
        return (found[0] + found[-1]) / 2 * MAD_TO_SIGMA


def clip(values: Ordered, sigma: float, max_rounds: int | None, spread: str) -> dict:
    """What clipping to ``sigma`` deviations about the median, again and again, leaves."""
    low, high, left, rounds = -math.inf, math.inf, None, 0
    while True:
        first, n, mean, std = values.inside(low, high)
        median = values.median(first, n)
        settled = n == left or rounds == max_rounds
        s = std if spread != "mad" else values.mad_std(median, low, high, n)
        low, high = max(low, median - sigma * s), min(high, median + sigma * s)
        if settled:
            return {"n": n, "mean": mean, "median": median, "std": std, "lo": low, "hi": high}
        left, rounds = n, rounds + 1


def median_and_mad(values: Ordered) -> dict:
    centre = values.median()
    return {"median": centre, "mad_std": values.mad_std(centre)}


def _blocks(df: DataFrame, by: list[str], col: str) -> DataFrame:
    """Blocks of the sorted values of each group, by part and place in it."""
    rows = df.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(by)], F.col(col).cast("double").alias("v"))
    rows = rows.filter(F.col("v").isNotNull() & ~F.isnan("v"))
    groups = [f"_g{i}" for i in range(len(by))]
    # equal values are one row, so no range is hot
    counted = stage(rows.groupBy(*groups, "v").agg(F.count(F.lit(1)).alias("c")), "counted")
    size = max(LEAST_BLOCK, -(-counted.count() // MOST_BLOCKS))
    ordered = counted.repartitionByRange(*groups, "v").sortWithinPartitions(*groups, "v")
    fields = "part long, place long, n long, low double, high double, mean double, m2 double, values array<double>, counts array<long>"
    schema = T.StructType([ordered.schema[g] for g in groups] + T.StructType.fromDDL(fields).fields)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place, held, rest = TaskContext.get().partitionId(), 0, [], 0

        def block(table: pa.Table) -> Iterator[pa.RecordBatch]:
            """The values of one group, in blocks."""
            nonlocal place
            v, c = table["v"].to_numpy(), table["c"].to_numpy()
            for at in range(0, len(v), size):
                x, w = v[at : at + size], c[at : at + size]
                n = int(w.sum())
                mean = float(x[0] + ((x - x[0]) * w).sum() / n)
                columns = [table[g].slice(at, 1).combine_chunks() for g in groups]
                columns += [pa.array([y]) for y in (part, place, n, float(x[0]), float(x[-1]), mean, float((w * (x - mean) ** 2).sum()))]
                columns += [pa.array([x], pa.list_(pa.float64())), pa.array([w], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in columns], names=schema.names)
                place += 1

        def runs(table: pa.Table) -> list[int]:
            new = np.zeros(table.num_rows, bool)
            for g in groups:
                codes = table[g].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                new[1:] |= codes[1:] != codes[:-1]
            return [0, *np.flatnonzero(new).tolist(), table.num_rows]

        def solved(last: bool) -> Iterator[pa.RecordBatch]:
            """Blocks of what is held, but for the last group, which may go on."""
            nonlocal held, rest
            table = pa.Table.from_batches(held).combine_chunks()
            edges = runs(table)
            for start, end in zip(edges[:-2], edges[1:-1]):
                yield from block(table.slice(start, end - start))
            start = edges[-2]
            if last:
                yield from block(table.slice(start))
                return
            whole = (table.num_rows - start) // size * size  # full blocks of it can go
            if whole:
                yield from block(table.slice(start, whole))
            left = table.slice(start + whole)
            held, rest = left.combine_chunks().to_batches(), left.num_rows

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                rest += batch.num_rows
                if rest >= 4 * size:
                    yield from solved(False)
        if held and sum(b.num_rows for b in held):
            yield from solved(True)

    return stage(ordered.mapInArrow(cut, schema), "blocks")


def search(df: DataFrame, by: Sequence[str], col: str, step: Callable[[Ordered], dict], fields: str) -> DataFrame:
    """``by`` and the ``fields`` that ``step`` finds in the ordered values of each group; null and NaN values are none.

    A group of any size is one row for each block in the task that searches it.
    """
    by = list(by)
    groups = [f"_g{i}" for i in range(len(by))]
    blocks = _blocks(df, by, col)
    summary = blocks.drop("values", "counts")
    made = T.StructType.fromDDL(fields)
    schema = T.StructType([summary.schema[g] for g in groups] + made.fields).add("_guessed", T.ArrayType(T.StructType.fromDDL("part long, place long")))

    def solve(table: pa.Table) -> pa.Table:
        order = np.lexsort((table["place"].to_numpy(), table["part"].to_numpy()))
        table = table.take(pa.array(order))
        opened = {}
        if "values" in table.column_names:
            there = np.flatnonzero(table["values"].is_valid().to_numpy())
            opened = {int(i): (table["values"][int(i)].values.to_numpy(), table["counts"][int(i)].values.to_numpy()) for i in there}
        values = Ordered(*[table[c].to_numpy() for c in ("n", "low", "high", "mean", "m2")], opened)
        found = step(values)
        guessed = [{"part": table["part"][i].as_py(), "place": table["place"][i].as_py()} for i in sorted(values.guessed)]
        columns = [table[g].slice(0, 1) for g in groups] + [pa.array([found[f.name]]) for f in made.fields]
        columns.append(pa.array([guessed], pa.list_(pa.struct([("part", pa.int64()), ("place", pa.int64())]))))
        return pa.table(columns, names=schema.names)

    known, rows, done = None, summary, None
    while True:
        found = stage(rows.groupBy(*groups).applyInArrow(solve, schema), "found")
        settled = found.filter(F.size("_guessed") == 0).drop("_guessed")
        done = settled if done is None else done.unionByName(settled)
        open_ones = found.filter(F.size("_guessed") > 0)
        if not open_ones.head(1):
            names = dict(zip(groups, by))
            return done.select(*[F.col(c).alias(names.get(c, c)) for c in done.columns])
        asked = open_ones.select(F.inline("_guessed")).distinct()
        known = stage(asked if known is None else known.unionByName(asked), "asked")
        values = blocks.select("part", "place", "values", "counts").join(known, ["part", "place"], "left_semi")
        still = join_groups(summary, open_ones.select(*groups), groups, "left_semi") if groups else summary
        rows = still.join(stage(values, "open"), ["part", "place"], "left")

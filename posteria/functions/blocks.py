"""Arrow batches of equally long draws as matrices, and their statistics."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from posteria.functions.arrays import MAD_TO_SIGMA


def equal_length_parts(batch: pa.RecordBatch, name: str, rows: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Pieces of at most ``rows`` rows whose arrays in ``name`` have one length.
    Normally that is the whole batch; null arrays count as length zero."""
    lengths = pc.fill_null(pc.list_value_length(batch.column(name)), 0).to_numpy(zero_copy_only=False)
    for length in np.unique(lengths):
        part = batch if (lengths == length).all() else batch.filter(pa.array(lengths == length))
        for at in range(0, part.num_rows, rows):
            yield int(length), part.slice(at, rows)


def matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """(rows, draws); the arrays of a part must be equally long, null counting as empty."""
    lengths = pc.fill_null(pc.list_value_length(batch.column(name)), 0)
    if len(set(lengths.unique().to_pylist())) > 1:
        raise ValueError(f"objects of one draw count elsewhere have different numbers of draws in {name}")
    values = batch.column(name).flatten().to_numpy(zero_copy_only=False)
    return values.reshape(batch.num_rows, -1).astype(float, copy=False)


def with_columns(batch: pa.RecordBatch, keep: Sequence[str], new: dict[str, np.ndarray]) -> pa.RecordBatch:
    columns = [batch.column(c) for c in keep] + [pa.array(v, pa.float64(), from_pandas=True) for v in new.values()]
    return pa.RecordBatch.from_arrays(columns, names=[*keep, *new])


def _middle(v: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    rows = np.arange(len(v))
    return (v[rows, first + (size - 1) // 2] + v[rows, first + size // 2]) / 2


def clipped_range(v: np.ndarray, sigma: float, max_rounds: int):
    """First place, size and MAD sigma of what clipping leaves of each ascending
    row: values near the median are neighbours in order, so a range says it all."""
    n, t = v.shape
    first, size, spread = np.zeros(n, int), np.full(n, t), np.zeros(n)
    live = np.arange(n)
    place = np.arange(t)
    for turn in range(max_rounds + 1):
        block, a, c = v[live], first[live], size[live]
        away = np.abs(block - _middle(block, a, c)[:, None])
        away[(place < a[:, None]) | (place >= (a + c)[:, None])] = np.inf
        s = _middle(np.sort(away, axis=1), np.zeros(len(live), int), c) * MAD_TO_SIGMA
        spread[live] = s
        if turn == max_rounds:
            break
        inside = away <= sigma * s[:, None]
        first[live], size[live] = inside.argmax(1), inside.sum(1)
        live = live[size[live] < c]
        if not len(live):
            break
    return first, size, spread


def clipped_lists(column: pa.Array, sigma: float, max_rounds: int) -> pa.ListArray:
    """Each array's ascending values that clipping leaves; null stays null, empty empty."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False)
    starts = np.cumsum(lengths) - lengths
    sizes, found = np.zeros(len(lengths), np.int64), {}
    for length in np.unique(lengths[lengths > 0]):
        rows = np.flatnonzero(lengths == length)
        v = np.sort(values[starts[rows][:, None] + np.arange(length)], axis=1)
        first, size, _ = clipped_range(v, sigma, max_rounds)
        sizes[rows], found[int(length)] = size, (rows, v, first, size)
    ends = np.cumsum(sizes)
    out = np.empty(int(sizes.sum()))
    for length, (rows, v, first, size) in found.items():
        place = np.arange(length)
        inside = (place >= first[:, None]) & (place < (first + size)[:, None])
        target = (ends - sizes)[rows][:, None] + place - first[:, None]
        out[target[inside]] = v[inside]
    offsets = pa.array(np.concatenate(([0], ends)).astype(np.int32))
    nulls = pc.is_null(column)
    return pa.ListArray.from_arrays(offsets, pa.array(out), mask=nulls if pc.any(nulls).as_py() else None)


def range_quantile(v: np.ndarray, first: np.ndarray, size: np.ndarray, q: float) -> np.ndarray:
    h = (size - 1) * q
    low = np.floor(h).astype(int)
    rows = np.arange(len(v))
    a, b = v[rows, first + low], v[rows, first + np.minimum(low + 1, size - 1)]
    return a + (b - a) * (h - low)


def range_mean(v: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    place = np.arange(v.shape[1])
    inside = (place >= first[:, None]) & (place < (first + size)[:, None])
    return np.where(inside, v, 0.0).sum(1) / size


def per_length(columns: Sequence[pa.Array], width: int, step: Callable[..., np.ndarray]) -> np.ndarray:
    """(rows, width): ``step`` over the arrays of the columns as matrices, rows of one length at a time.

    The arrays of a row must be equally long; an empty or null one gives NaN.
    """
    lengths = [pc.fill_null(pc.list_value_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns]
    if any((n != lengths[0]).any() for n in lengths):
        raise ValueError("arrays of one row differ in length")
    values = [c.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False) for c in columns]
    starts = np.cumsum(lengths[0]) - lengths[0]
    out = np.full((len(lengths[0]), width), np.nan)
    for length in np.unique(lengths[0][lengths[0] > 0]):
        rows = np.flatnonzero(lengths[0] == length)
        out[rows] = step(*[v[starts[rows][:, None] + np.arange(length)] for v in values])
    return out


def quantiles(v: np.ndarray, qs: Sequence[float]) -> np.ndarray:
    """Interpolated quantiles of each row."""
    v = np.sort(v, axis=1)
    none, all_of = np.zeros(len(v), int), np.full(len(v), v.shape[1])
    return np.stack([range_quantile(v, none, all_of, q) for q in qs], axis=1)


def mad_std(v: np.ndarray) -> np.ndarray:
    return quantiles(np.abs(v - quantiles(v, [0.5])), [0.5]) * MAD_TO_SIGMA


def correlation(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Pearson's, of each row; rounding must not give constant draws a length."""
    varied = (a.max(1) > a.min(1)) & (b.max(1) > b.min(1))
    a, b = a - a.mean(1, keepdims=True), b - b.mean(1, keepdims=True)
    dot = lambda x, y: np.einsum("nt,nt->n", x, y)
    scale = np.sqrt(dot(a, a)) * np.sqrt(dot(b, b))
    return np.divide(dot(a, b), scale, out=np.full(len(scale), np.nan), where=varied & (scale > 0))[:, None]

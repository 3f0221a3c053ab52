"""Posteriors of three classes as 2-D Gaussian mixtures: fit, pack, rebuild, resample."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from posteria.functions import addressed, blocks, simplex
from posteria.functions.seeded import digest, normal_of
from posteria.operators.sampling import select_objects
from posteria.sources.folders import write_folders

COMPONENTS = 3
REGULARISER = 1e-6  # added to every variance
MIXTURE, SAMPLE = 240, 241  # layers of the addresses of random numbers
PARTS = ["cov_11", "cov_12", "cov_22", "mean_1", "mean_2", "weight"]


def require_three(targets: Sequence[str]) -> None:
    if len(targets) != COMPONENTS:
        raise ValueError("mixtures of class probabilities need exactly three targets")


def gmm_columns() -> list[str]:
    """The eighteen flat column names of a compressed posterior."""
    comps = range(1, COMPONENTS + 1)
    return [
        *[f"comp{k}_{c}" for k in comps for c in PARTS[:3]],
        *[f"comp{k}_{c}" for k in comps for c in PARTS[3:5]],
        *[f"comp{k}_weight" for k in comps],
    ]


# --- rotation -----------------------------------------------------------------------


def rotate_simplex(df: DataFrame, targets: Sequence[str]) -> DataFrame:
    """Add ``r1``, ``r2`` from three probability columns."""
    require_three(targets)
    x, y = simplex.to_plane(tuple(F.col(t) for t in targets))
    return df.select("*", x.alias("r1"), y.alias("r2"))


def rotate_draws(df: DataFrame, targets: Sequence[str]) -> DataFrame:
    """Add ``r1_draws``, ``r2_draws`` from three arrays of draws."""
    require_three(targets)
    p, q, r = (F.col(f"{t}_draws") for t in targets)

    def axis(row):
        both = F.zip_with(p, q, lambda x, y: row[0] * x + row[1] * y)
        return F.zip_with(both, r, lambda s, z: s + row[2] * z)

    return df.select("*", *[axis(row).alias(f"r{i}_draws") for i, row in enumerate(simplex.PLANE, 1)])


# --- fit -----------------------------------------------------------------------------


def _maximise(phi: np.ndarray, resp: np.ndarray):
    """Weights, means and covariances of a block from its weighted moments.
    ``phi`` (n, T, 6) holds 1, x, y, xx, xy, yy of centred draws, ``resp``
    (n, K, T) the responsibilities."""
    s = resp @ phi
    mass = s[..., 0] + 10 * np.finfo(float).eps
    m1, m2 = s[..., 1] / mass, s[..., 2] / mass
    a = s[..., 3] / mass - m1 * m1 + REGULARISER
    b = s[..., 4] / mass - m1 * m2
    c = s[..., 5] / mass - m2 * m2 + REGULARISER
    return mass / mass.sum(1, keepdims=True), m1, m2, a, b, c


def _expect(phi: np.ndarray, w, m1, m2, a, b, c):
    """Responsibilities and the mean log-likelihood per object. A log density is
    a quadratic form, hence one product of ``phi`` with six coefficients."""
    det = a * c - b * b
    p, q, r = c / det, -b / det, a / det
    base = np.log(w) - 0.5 * (p * m1 * m1 + 2 * q * m1 * m2 + r * m2 * m2 + np.log(det)) - np.log(2 * np.pi)
    coef = np.stack([base, p * m1 + q * m2, q * m1 + r * m2, -0.5 * p, -q, -0.5 * r], axis=2)
    logp = coef @ phi.transpose(0, 2, 1)
    top = logp.max(1, keepdims=True)
    np.exp(logp - top, out=logp)
    total = logp.sum(1, keepdims=True)
    logp /= total
    return logp, (top + np.log(total)).mean((1, 2))


def _ranked_start(x: np.ndarray) -> np.ndarray:
    """The component of each draw by its rank along the first axis."""
    t = x.shape[1]
    cuts = np.sort(x, axis=1)[:, [-(-t * k // COMPONENTS) - 1 for k in range(1, COMPONENTS)]]
    return (x[:, None] > cuts[:, :, None]).sum(1)


def _seeded_start(x: np.ndarray, y: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """The component of each draw by the nearest of centres that are draws themselves: the first any of them, the
    next ones with chances by the squared distance to the centres so far. Draws without distance share one centre."""
    rows, u = np.arange(len(x)), addressed.uniforms(seeds, 1, MIXTURE, COMPONENTS)[:, 0]
    pick = np.minimum((u[:, 0] * x.shape[1]).astype(int), x.shape[1] - 1)
    far, start = np.full(x.shape, np.inf), np.zeros(x.shape, int)
    for k in range(COMPONENTS):
        if k:
            mass = np.cumsum(far, axis=1)
            pick = (mass <= (u[:, k] * mass[:, -1])[:, None]).sum(1).clip(max=x.shape[1] - 1)
        away = (x - x[rows, pick][:, None]) ** 2 + (y - y[rows, pick][:, None]) ** 2
        start[away < far] = k
        far = np.minimum(far, away)
    return start


def _fit_block(x: np.ndarray, y: np.ndarray, max_iter: int, tol: float, seeds: np.ndarray | None = None) -> np.ndarray:
    """Mixtures of a block of objects, columns in the order of gmm_columns(); seeds ask for the seeded start."""
    n, t = x.shape
    start = _ranked_start(x) if seeds is None else _seeded_start(x, y, seeds)
    middle = x.mean(1, keepdims=True), y.mean(1, keepdims=True)
    u, v = x - middle[0], y - middle[1]
    phi = np.stack([np.ones_like(u), u, v, u * u, u * v, v * v], axis=2)
    params = np.stack(_maximise(phi, (start[:, None] == np.arange(COMPONENTS)[:, None]).astype(float)))
    live, last = np.arange(n), np.full(n, -np.inf)
    for _ in range(max_iter):
        resp, score = _expect(phi, *params[:, live])
        params[:, live] = np.stack(_maximise(phi, resp))
        moving = np.abs(score - last) >= tol
        if not moving.any():
            break
        live, last, phi = live[moving], score[moving], phi if moving.all() else phi[moving]
    w, m1, m2, a, b, c = params
    order = np.argsort(-w, axis=1, kind="stable")
    pick = lambda m: np.take_along_axis(m, order, 1)
    covs = np.stack([pick(a), pick(b), pick(c)], 2).reshape(n, -1)
    centres = np.stack([pick(m1) + middle[0], pick(m2) + middle[1]], 2).reshape(n, -1)
    return np.hstack([covs, centres, pick(w)])


def fit_block(raw: dict[str, np.ndarray], targets: Sequence[str], max_iter: int = 100, tol: float = 1e-3) -> dict[str, np.ndarray]:
    """The columns of ``gmm_columns`` for (objects, draws) of the three targets."""
    p, q, r = (raw[t] for t in targets)
    x, y = (row[0] * p + row[1] * q + row[2] * r for row in simplex.PLANE)
    return dict(zip(gmm_columns(), _fit_block(x, y, max_iter, tol).T))


def fit_gmm(
    df: DataFrame, keep: Sequence[str], max_iter: int = 100, tol: float = 1e-3, block: int = 256, seed_by: Sequence[str] | None = None
) -> DataFrame:
    """Fit every object's mixture to ``r1_draws``, ``r2_draws`` (equally long
    in an object). Objects are independent rows: no shuffle, a block at a time.

    The start splits the draws by rank along the first axis or, with the key
    columns ``seed_by``, by centres sampled by squared distance, the same for a
    key wherever it is. Components come out by falling weight.
    """
    names = gmm_columns()
    schema = T.StructType(
        [df.schema[c] for c in keep] + [T.StructField(n, T.DoubleType()) for n in names]
    )
    seed, seeded = [F.xxhash64(*seed_by).alias("_seed")] if seed_by else [], bool(seed_by)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for length, part in blocks.equal_length_parts(batch, "r1_draws", block):
                if length:
                    x, y = blocks.matrix(part, "r1_draws"), blocks.matrix(part, "r2_draws")
                    seeds = part.column(part.schema.get_field_index("_seed")).to_numpy() if seeded else None
                    fitted = _fit_block(x, y, max_iter, tol, seeds)
                else:
                    fitted = np.full((part.num_rows, len(names)), np.nan)
                yield blocks.with_columns(part, list(keep), dict(zip(names, fitted.T)))

    return df.select(*keep, "r1_draws", "r2_draws", *seed).mapInArrow(fit, schema)


def _flat(df: DataFrame, keys: Sequence[str], comps) -> DataFrame:
    """Flat columns from an array of component structs, by falling weight."""
    ordered = df.select(*keys, F.sort_array(comps, asc=False).alias("c"))
    part = lambda n: F.get("c", F.lit(int(n[4]) - 1))[n.split("_", 1)[1]]
    return ordered.select(*keys, *[part(n).alias(n) for n in gmm_columns()])


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str], whole: bool) -> Iterator[pa.RecordBatch]:
    """keys, r1_draws, r2_draws: the draws of rows that stand together and have one key; if ``whole``, also across
    batches, each object's draws in an order of their own."""
    names, held = [*keys, "r1_draws", "r2_draws"], None

    def joined(rows: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
        offsets = rows.column(len(keys)).offsets.to_numpy()
        values = [rows.column(len(keys) + i).flatten().to_numpy(zero_copy_only=False) for i in (0, 1)]
        ends = np.append(offsets[starts], offsets[-1]) - offsets[0]
        if whole:
            order = np.lexsort((values[1], values[0], np.repeat(np.arange(len(starts)), np.diff(ends))))
            values = [v[order] for v in values]
        first = rows.take(pa.array(starts)).columns[: len(keys)]
        lists = [pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(v)) for v in values]
        return pa.RecordBatch.from_arrays([*first, *lists], names=names)

    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            batch = pa.concat_batches([held, pa.RecordBatch.from_arrays(batch.columns, schema=held.schema)])
        new = np.zeros(batch.num_rows, bool)
        new[0] = True
        for i in range(len(keys)):
            codes = batch.column(i).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            new[1:] |= codes[1:] != codes[:-1]
        starts = np.flatnonzero(new)
        if whole:  # the last key may go on in the next batch
            held, batch, starts = batch.slice(starts[-1]), batch.slice(0, starts[-1]), starts[:-1]
        if len(starts):
            yield joined(batch, starts)
    if held is not None:
        yield joined(held, np.array([0]))


def fit_gmm_long(draws: DataFrame, keys: Sequence[str], max_iter: int = 100, tol: float = 1e-3, **how) -> DataFrame:
    """The same fit, to convergence, for long draws (keys..., r1, r2).

    The draws of an object, as many as the run parameter says, are gathered
    once; rounds then cost no shuffle and objects that have converged take no
    part in later ones. Draws that stand together are moved as one row, and no
    draw is moved or sorted by Spark on its own.
    """
    keys = list(keys)
    both = [T.StructField(f"r{i}_draws", T.ArrayType(T.DoubleType())) for i in (1, 2)]
    schema = T.StructType([draws.schema[k] for k in keys] + both)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32))
            lists = [pa.ListArray.from_arrays(each, batch.column(len(keys) + i)) for i in (0, 1)]
            rows = pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], *lists], names=schema.names)
            yield from _runs(iter([rows]), keys, False)

    packed = draws.select(*keys, *[F.col(f"r{i}").cast("double") for i in (1, 2)]).mapInArrow(pack, schema)
    met = packed.repartition(*keys).sortWithinPartitions(*keys) if keys else packed.coalesce(1)
    return fit_gmm(met.mapInArrow(lambda batches: _runs(batches, keys, True), schema), keys, max_iter, tol, **how)


def pack_gmm(params: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Long parameters (keys..., comp, PARTS) -> one flat row per object, the
    components by falling weight."""
    packed = params.groupBy(*keys).agg(F.collect_list(F.struct("weight", *PARTS[:5])).alias("c"))  # three entries
    return _flat(packed, keys, F.col("c"))


# --- rebuild -------------------------------------------------------------------------


def _component_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    comps = F.array(
        *[
            F.struct(F.lit(k).alias("comp"), *[F.col(f"comp{k}_{c}").alias(c) for c in PARTS])
            for k in range(1, COMPONENTS + 1)
        ]
    )
    return df.select(*keys, F.inline(comps))


def _lowest_eigenvalue(a, b, c):
    half = (a - c) / 2.0
    return (a + c) / 2.0 - F.sqrt(half * half + b * b)


def repair_psd(df: DataFrame) -> DataFrame:
    """Add -10 x the lowest eigenvalue to the variances of every component whose
    covariance is indefinite. Done in the plane: the rotation keeps eigenvalues,
    and the rebuilt probabilities still sum to one."""
    new = {}
    for k in range(1, COMPONENTS + 1):
        a, b, c = (F.col(f"comp{k}_{n}") for n in PARTS[:3])
        low = _lowest_eigenvalue(a, b, c)
        lift = F.when(low < 0, low * -10.0).otherwise(F.lit(0.0))
        new[f"comp{k}_cov_11"], new[f"comp{k}_cov_22"] = a + lift, c + lift
    return df.select(*[new[c].alias(c) if c in new else F.col(c) for c in df.columns])


def unpack_gmm(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per component with its 3-D mean and covariance (upper triangle)."""
    rows = _component_rows(df, keys)
    means = simplex.from_plane(F.col("mean_1"), F.col("mean_2"))
    covs = simplex.covariance_from_plane(F.col("cov_11"), F.col("cov_12"), F.col("cov_22"))
    return rows.select(
        *keys, "comp", "weight",
        *[m.alias(f"m{i + 1}") for i, m in enumerate(means)],
        *[c.alias(f"c{ij}") for ij, c in covs.items()],
    )


def sample_gmm(df: DataFrame, keys: Sequence[str], n: int = 5000, names: Sequence[str] = ("P_Galaxy", "P_QSO", "P_Star")) -> DataFrame:
    """int(n x weight) points per component, seeded by (key, component, point)."""
    keys = list(keys)
    points = F.floor(F.lit(float(n)) * F.col("weight")).cast("int")
    rows = _component_rows(df, keys).withColumn("points", points).filter(F.col("points") > 0)
    rows = rows.select("*", F.explode(F.sequence(F.lit(1), F.col("points"))).alias("sample"))
    seed = [*keys, "comp", "sample"]
    l11 = F.sqrt("cov_11")
    l21 = F.try_divide(F.col("cov_12"), l11)
    l22 = F.sqrt(F.greatest(F.col("cov_22") - l21 * l21, F.lit(0.0)))
    drawn = rows.withColumn("_h", digest(seed, "xy")).withColumns(
        {"z1": normal_of(F.col("_h"), 0), "z2": normal_of(F.col("_h"), 1)}
    ).withColumns(
        {"x": F.col("mean_1") + l11 * F.col("z1"), "y": F.col("mean_2") + l21 * F.col("z1") + l22 * F.col("z2")}
    )
    p = simplex.from_plane(F.col("x"), F.col("y"))
    return drawn.select(*keys, "comp", "sample", *[c.alias(m) for c, m in zip(p, names)])


def sample_gmm_arrays(
    df: DataFrame, keys: Sequence[str], n: int = 5000, names: Sequence[str] = ("P_Galaxy", "P_QSO", "P_Star"), block: int = 64
) -> DataFrame:
    """keys and, for each name, the array of an object's points: int(n x weight) of each component, one after another.

    The points of a key are the same in any batch. No row is made for a point:
    some objects at a time are drawn by one array operation. ``array_moments``
    of the result takes them in the task that draws them.
    """
    keys = list(keys)
    columns = [f"comp{k}_{c}" for k in range(1, COMPONENTS + 1) for c in PARTS]
    schema = T.StructType([df.schema[k] for k in keys] + [T.StructField(m, T.ArrayType(T.DoubleType(), False)) for m in names])
    back = np.array(simplex.PLANE, float)
    layers = SAMPLE + np.arange(1, COMPONENTS + 1)
    few = max(1, 16384 // max(n, 1))  # objects whose points stay in the cache

    def points(seeds: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Points an object, and the flat coordinates; ``parts`` (objects, components, PARTS)."""
        c11, c12, c22, m1, m2, w = (np.ascontiguousarray(parts[:, :, i]).ravel() for i in range(6))
        counts = np.maximum(np.floor(n * np.nan_to_num(w)), 0).astype(np.int64)
        z1, z2 = addressed.ragged_normals(np.repeat(seeds, COMPONENTS), counts, np.tile(layers, len(seeds)), 2)
        l11 = np.sqrt(c11)
        l21 = np.divide(c12, l11, out=np.zeros_like(c12), where=l11 > 0)
        l22 = np.sqrt(np.maximum(c22 - l21 * l21, 0.0))
        x, y, end = np.empty_like(z1), np.empty_like(z1), 0
        for c, a, b, d, e, g in zip(counts.tolist(), m1, m2, l11, l21, l22):
            s = slice(end, end := end + c)
            np.multiply(z1[s], d, out=x[s])
            x[s] += a
            np.multiply(z1[s], e, out=y[s])
            y[s] += b
            y[s] += z2[s] * g
        return counts.reshape(-1, COMPONENTS).sum(1), [back[0, i] * x + back[1, i] * y + 1 / 3 for i in range(3)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                seeds = part.column(len(keys)).to_numpy()
                parts = np.stack([part.column(len(keys) + 1 + i).to_numpy(zero_copy_only=False) for i in range(len(columns))], axis=1)
                parts = parts.astype(float).reshape(-1, COMPONENTS, len(PARTS))
                made = [points(seeds[i : i + few], parts[i : i + few]) for i in range(0, len(seeds), few)]
                offsets = pa.array(np.concatenate(([0], np.cumsum(np.concatenate([c for c, _ in made])))).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([p[i] for _, p in made]))) for i in range(3)]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keys)], *lists], names=schema.names)

    source = df.select(*keys, F.xxhash64(*keys).alias("_seed"), *[F.col(c).cast("double") for c in columns])
    out = source.mapInArrow(run, schema)
    out._drawn = source, run  # what makes its rows, for a step that takes them in the same task
    return out


def array_moments(df: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """keys, n and, for each array, its mean and the population covariances of each pair, ``<a>_<b>_cov``.

    Arrays that ``sample_gmm_arrays`` draws do not leave the task, only their moments do.
    """
    places = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    made = ["n", *[f"{a}_mean" for a in names], *[f"{names[i]}_{names[j]}_cov" for i, j in places]]
    schema = T.StructType([df.schema[k] for k in keys] + [T.StructField(m, T.DoubleType()) for m in made])
    source, draw = vars(df).get("_drawn") or (df.select(*keys, *names), iter)

    def moments(*arrays: np.ndarray) -> np.ndarray:
        rows, size = np.stack(arrays, axis=1), arrays[0].shape[1]
        mean = rows.mean(2)
        rows -= mean[:, :, None]
        products = rows @ rows.transpose(0, 2, 1) / size
        return np.column_stack([np.full(len(rows), float(size)), mean, *[products[:, i, j] for i, j in places]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in draw(batches):
            at_of = batch.schema.get_field_index
            for at in range(0, batch.num_rows, 4):
                part = batch.slice(at, 4)
                table = blocks.per_length([part.column(at_of(a)) for a in names], len(made), moments)
                yield blocks.with_columns(part.select(list(keys)), list(keys), dict(zip(made, table.T)))

    return source.mapInArrow(run, schema)


def reconstruct_posteriors(
    df: DataFrame, ids: Sequence[str] | None = None, n: int = 5000,
    keys: Sequence[str] = ("tile_id", "number"), names: Sequence[str] = ("P_Galaxy", "P_QSO", "P_Star"),
    path: str | None = None,
) -> DataFrame:
    """Resampled posteriors of a whole table or of named objects as one long
    table; with ``path`` also written, one folder per tile."""
    chosen = select_objects(df, ids, *keys) if ids is not None else df
    extra = ["request"] if ids is not None else []
    repaired = repair_psd(chosen)
    points = sample_gmm(repaired, [*keys, *extra], n, names)
    if path is None:
        return points
    rounded = points.select(*keys, *extra, "comp", "sample", *[F.round(c, 4).alias(c) for c in names])
    # one folder per tile without a file per task and tile; hot tiles are split
    write_folders(rounded.hint("rebalance", keys[0]), path, keys[0])
    return df.sparkSession.read.schema(rounded.schema).parquet(path)

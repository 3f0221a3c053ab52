"""Scoring with fitted networks, and losses as aggregates."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from posteria.functions import blocks
from posteria.models import network
from posteria.models.training import FittedNet, fit_net
from posteria.operators import mixture, posterior
from posteria.operators.sampling import kfold


def _inputs(df: DataFrame, model: FittedNet, keys: list[str], kept: list[str], input_noise: bool, error_suffix: str) -> list:
    """Columns that a task needs of a row: those kept, the seed of its key, features and, for noise, their errors."""
    pack = lambda cols: F.array(*[F.col(c).cast("double") for c in cols])
    columns = [*kept, F.xxhash64(*keys, F.lit(model.cfg.seed)).alias("_seed"), pack(model.features).alias("_x")]
    return [*columns, pack([f + error_suffix for f in model.features]).alias("_e")] if input_noise else columns


def _cubes(batches: Iterator[pa.RecordBatch], params, cfg, n_iter: int, input_noise: bool) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows and their draws (objects, draws, targets), a block of bounded size at a time."""
    rows = network.block_rows(params, n_iter)
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            errors = blocks.matrix(part, "_e") if input_noise else None
            seeds = part.column(part.schema.get_field_index("_seed")).to_numpy()
            yield part, network.block_draws(params, blocks.matrix(part, "_x"), cfg, n_iter, seeds, errors)


def draws(
    df: DataFrame, model: FittedNet, keys: Sequence[str], n_iter: int = 300, keep: Sequence[str] = (),
    input_noise: bool = False, error_suffix: str = "__err",
) -> DataFrame:
    """``n_iter`` stochastic predictions per object as arrays ``<t>_draws``.

    The randomness of an object is addressed by a hash of its key, the draw,
    the layer and the unit, so any partitioning gives the same draws.
    ``input_noise`` adds Normal(0, error) noise to the inputs of every draw. A
    task holds a block of bounded size at a time, one matrix product a layer.
    """
    keys = list(keys)
    kept = [*keys, *[c for c in keep if c not in keys]]
    names = [f"{t}_draws" for t in model.targets]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(n, T.ArrayType(T.DoubleType(), False)) for n in names])
    handle, cfg = df.sparkSession.sparkContext.broadcast(model.params), model.cfg

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, cube in _cubes(batches, handle.value, cfg, n_iter, input_noise):
            offsets = pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * n_iter)
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(cube[:, :, j]).reshape(-1))) for j in range(len(names))]
            yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], *lists], names=schema.names)

    return df.select(*_inputs(df, model, keys, kept, input_noise, error_suffix)).mapInArrow(run, schema)


def summarised_draws(
    df: DataFrame, model: FittedNet, keys: Sequence[str], n_iter: int = 300, keep: Sequence[str] = (), input_noise: bool = False,
    error_suffix: str = "__err", mixtures: bool = False, spread: FittedNet | None = None,
) -> DataFrame:
    """Draws, their summary and, if wanted, mixtures and predicted sigmas of every object, in one pass.

    The same numbers as ``draws``, ``posterior_summary``, ``rotate_draws``,
    ``fit_gmm`` and ``predict_points`` one after another, but no draw leaves
    the task: a row goes in with its features and comes out with its summary.
    """
    keys, targets = list(keys), list(model.targets)
    kept = [*keys, *[c for c in keep if c not in keys]]
    names = posterior.summary_columns(targets)
    if mixtures:
        mixture.require_three(targets)
        names = [*names, *mixture.gmm_columns()]
    sigmas = list(spread.targets) if spread else []
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(n, T.DoubleType()) for n in [*names, *sigmas]])
    handle = df.sparkSession.sparkContext.broadcast((model.params, spread.params if spread else None))
    cfg, spread_cfg = model.cfg, spread.cfg if spread else None
    columns = _inputs(df, model, keys, kept, input_noise, error_suffix)
    if spread:
        columns.append(F.array(*[F.col(c).cast("double") for c in spread.features]).alias("_s"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        params, spread_params = handle.value
        for part, cube in _cubes(batches, params, cfg, n_iter, input_noise):
            raw = {t: np.ascontiguousarray(cube[:, :, j]) for j, t in enumerate(targets)}
            out = posterior.summary_of(raw) if n_iter else dict.fromkeys(posterior.summary_columns(targets), np.full(part.num_rows, np.nan))
            if mixtures:
                out |= mixture.fit_block(raw, targets)
            if spread_params is not None:
                point = network.point_prediction(spread_params, blocks.matrix(part, "_s"), spread_cfg)
                out |= dict(zip(sigmas, point.T))
            yield blocks.with_columns(part, kept, out)

    return df.select(*columns).mapInArrow(run, schema)


def predict_points(df: DataFrame, model: FittedNet, keys: Sequence[str], keep: Sequence[str] = (), prefix: str = "pred_") -> DataFrame:
    """One noise-free prediction per target, ``<prefix><t>``."""
    kept = [*keys, *[c for c in keep if c not in keys]]
    names = [f"{prefix}{t}" for t in model.targets]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(n, T.DoubleType()) for n in names])
    handle = df.sparkSession.sparkContext.broadcast(model.params)
    cfg = model.cfg
    packed = F.array(*[F.col(f).cast("double") for f in model.features]).alias("_x")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            out = network.point_prediction(handle.value, np.stack(batch["_x"]), cfg)
            yield pd.concat([batch[kept], pd.DataFrame(out, columns=names, index=batch.index)], axis=1)

    return df.select(*kept, packed).mapInPandas(run, schema)


def cross_validated_predictions(
    df: DataFrame, keys: Sequence[str], features: Sequence[str], targets: Sequence[str], cfg, k: int = 8,
    repeats: int = 1, stratify: str | None = None, n_iter: int = 300, seed: int = 42,
) -> tuple[DataFrame, DataFrame]:
    """(out-of-fold posterior summaries with the truth, loss history per fold).

    Every row is summarised by a model that never saw it.
    """
    folded = kfold(df, keys, k, repeats, stratify, seed).persist()
    parts, history = [], []
    for r in range(repeats):
        for f in range(k):
            rows = folded.filter(F.col("repeat") == r)
            model = fit_net(rows.filter(F.col("fold") != f), keys, features, targets, cfg)
            history += [(r, f, *h) for h in model.history]
            keep = [*targets, *([] if not stratify else [stratify]), *features, "repeat", "fold"]
            parts.append(summarised_draws(rows.filter(F.col("fold") == f), model, keys, n_iter, list(dict.fromkeys(keep))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    losses = df.sparkSession.createDataFrame(
        history, "repeat int, fold int, epoch int, loss double, val_loss double, learning_rate double"
    )
    return out, losses


def loss_metrics(df: DataFrame, obs: str, pred: str) -> DataFrame:
    """All losses as one aggregate: mse, mae, mape, msle, huber, log_cosh."""
    y, p = F.col(obs), F.col(pred)
    d = p - y
    size = F.abs(d)
    tiny = F.lit(1e-7)
    log_gap = F.log1p(F.greatest(p, tiny)) - F.log1p(F.greatest(y, tiny))
    return df.agg(
        F.avg(d * d).alias("mse"),
        F.avg(size).alias("mae"),
        F.avg(size / F.greatest(F.abs(y), tiny) * 100.0).alias("mape"),
        F.avg(log_gap * log_gap).alias("msle"),
        F.avg(F.when(size <= 1, d * d * 0.5).otherwise(size - 0.5)).alias("huber"),
        F.avg(size + F.log1p(F.exp(size * -2.0)) - F.log(F.lit(2.0))).alias("log_cosh"),
    )

"""Data-parallel training: one Spark job per epoch.

Each replica (partition) walks its rows in small batches from the broadcast
weights; the weights come back in slices, are averaged by an aggregation over
the slices, and only the averaged model reaches the driver. Its size is that
of the model, whatever the size of the data.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from posteria.functions.seeded import seeded_hash
from posteria.models import network
from posteria.models.network import NetConfig

MEET = 64  # replicas whose slices meet in one row
SLICE = 65_536  # numbers per slice of the flattened model


@dataclass
class FittedNet:
    """Weights with everything needed to score; ``history`` rows are
    (epoch, loss, val_loss, learning_rate)."""

    params: list[np.ndarray]
    cfg: NetConfig
    features: list[str]
    targets: list[str]
    history: list[tuple[int, float, float, float]]

    def history_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.history, "epoch int, loss double, val_loss double, learning_rate double")


def _flatten(groups) -> np.ndarray:
    return np.concatenate([a.ravel() for g in groups for a in g])


def _restore(flat: np.ndarray, shapes) -> list[np.ndarray]:
    out, at = [], 0
    for s in shapes:
        n = int(np.prod(s))
        out.append(flat[at : at + n].reshape(s).copy())
        at += n
    return out


def _epoch_job(handle, cfg: NetConfig, epoch: int, rate: float, n_instances: int):
    """Partition function: measure the broadcast weights on the validation rows,
    then train on the others; emits model slices and loss sums."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        params, m, v, step = handle.value
        params, m, v = ([a.copy() for a in g] for g in (params, m, v))
        start = [a.copy() for a in params]
        total = [np.zeros_like(a) for a in params]
        part = TaskContext.get().partitionId()
        rng = np.random.Generator(np.random.Philox(key=cfg.seed, counter=[0, 0, epoch, part]))
        loss_sum = val_sum = 0.0
        n_train = n_val = 0
        for batch in batches:
            x, y = np.stack(batch["x"]), np.stack(batch["y"])
            held = batch["held"].to_numpy()
            if held.any():
                # start weights: the average that ended the epoch before
                value, _ = network.gradients(start, x[held], y[held], cfg, rng, n_instances)
                val_sum += value * held.sum()
                n_val += int(held.sum())
            x, y = x[~held], y[~held]
            for rows in np.array_split(rng.permutation(len(x)), max(1, -(-len(x) // cfg.batch_size))):
                if not len(rows):
                    continue
                loss, grads = network.gradients(params, x[rows], y[rows], cfg, rng, n_instances)
                loss_sum += loss * len(rows)
                n_train += len(rows)
                if cfg.local_steps:
                    step = network.adam_step(params, grads, m, v, step, rate)
                else:
                    for t, g in zip(total, grads):
                        t += g * len(rows)
        if not n_train + n_val:
            return
        if cfg.local_steps:
            flat = _flatten([params, m, v])
        else:
            flat = _flatten([[t / max(n_train, 1) for t in total]])
        pieces = [flat[i : i + SLICE] for i in range(0, len(flat), SLICE)]
        first = lambda value: [value] + [0] * (len(pieces) - 1)
        yield pd.DataFrame(
            {
                "slice": range(len(pieces)),
                "part": part,
                "numbers": pieces,
                "weight": float(n_train),
                "step": step,
                "loss": first(loss_sum),
                "n": first(n_train),
                "val": first(val_sum),
                "n_val": first(n_val),
            }
        )

    return run


_OUT = "slice int, part int, numbers array<double>, weight double, step long, loss double, n long, val double, n_val long"


def _merged(rows: DataFrame, *by) -> DataFrame:
    """One row for each group: the weighted mean of the numbers, and the sums."""
    return rows.groupBy(*by).agg(
        Summarizer.mean(array_to_vector("numbers"), F.col("weight")).alias("mean"), F.sum("weight").alias("weight"),
        F.max("step").alias("step"), F.sum("loss").alias("loss"), F.sum("n").alias("n"),
        F.sum("val").alias("val"), F.sum("n_val").alias("n_val"),
    )


def average(rows: DataFrame, replicas: int, most: int = MEET) -> DataFrame:
    """Every slice of the model averaged over all replicas; no more than ``most`` rows of a slice ever meet."""
    while replicas > most:
        replicas = -(-replicas // most)
        some = F.pmod("part", F.lit(replicas)).cast("int").alias("part")
        rows = _merged(rows, "slice", some).withColumn("numbers", vector_to_array("mean"))
    return _merged(rows, "slice")


def fit_net(df: DataFrame, keys: Sequence[str], features: Sequence[str], targets: Sequence[str], cfg: NetConfig) -> FittedNet:
    """Train on whole rows without nulls; 30% by hash watch for overfitting."""
    keys, features, targets = list(keys), list(features), list(targets)
    spark = df.sparkSession
    replicas = cfg.replicas or spark.sparkContext.defaultParallelism
    digest = seeded_hash(keys, cfg.seed)
    cut = format(int(cfg.valid_fraction * 16**8), "08x")
    pack = lambda cols: F.array(*[F.col(c).cast("double") for c in cols])
    # hash partitioning on the key: a retry rebuilds the same replicas
    data = (
        df.select(pack(features).alias("x"), pack(targets).alias("y"), digest.alias("h"))
        .withColumn("held", F.substring("h", 1, 8) < cut)
        .repartition(replicas, "h")
        .sortWithinPartitions("h")
        .select("x", "y", "held")
        .persist()
    )
    n_instances = max(data.count(), 1)

    params = network.init_params(len(features), len(targets), cfg)
    shapes = [p.shape for p in params]
    m, v, step = [np.zeros(s) for s in shapes], [np.zeros(s) for s in shapes], 0
    rate, history, losses = cfg.learning_rate, [], []
    best, best_value, best_epoch = params, float("inf"), -1

    for epoch in range(cfg.epochs + 1):  # the last job only measures
        handle = spark.sparkContext.broadcast((params, m, v, step))
        rate = network.decayed(rate, epoch, cfg)
        rows = data.mapInPandas(_epoch_job(handle, cfg, epoch, rate, n_instances), _OUT)
        merged = average(rows, replicas)
        slices = sorted(merged.collect(), key=lambda r: r["slice"])  # as large as the model
        handle.unpersist()
        loss, n, val, n_val = (sum(r[c] for r in slices) for c in ("loss", "n", "val", "n_val"))
        if epoch:
            # this job measured the weights that the epoch before produced
            value = val / n_val if n_val else losses[-1][0]
            history.append((epoch - 1, losses[-1][0], value, losses[-1][1]))
            if value < best_value - cfg.min_delta:
                best, best_value, best_epoch = params, value, epoch
            if epoch - best_epoch >= cfg.patience or epoch == cfg.epochs:
                break
        losses.append((loss / max(n, 1), rate))
        flat = np.concatenate([r["mean"].toArray() for r in slices])
        if cfg.local_steps:
            together = _restore(flat, shapes * 3)
            k = len(shapes)
            params, m, v = together[:k], together[k : 2 * k], together[2 * k :]
            step = max(r["step"] for r in slices)
        else:
            params = [p.copy() for p in params]
            step = network.adam_step(params, _restore(flat, shapes), m, v, step, rate)
    data.unpersist()
    return FittedNet(best, cfg, features, targets, history)


def fit_dropout_net(df, keys, features, targets, cfg: NetConfig | None = None) -> FittedNet:
    return fit_net(df, keys, features, targets, replace(cfg or NetConfig(), kind="dropout"))


def fit_deterministic_net(df, keys, features, targets, cfg: NetConfig | None = None) -> FittedNet:
    return fit_net(df, keys, features, targets, replace(cfg or NetConfig(), kind="deterministic"))


def fit_gaussian_net(df, keys, features, targets, cfg: NetConfig | None = None) -> FittedNet:
    return fit_net(df, keys, features, targets, replace(cfg or NetConfig(loss="nll"), kind="gaussian"))


def fit_variational_net(df, keys, features, targets, cfg: NetConfig | None = None) -> FittedNet:
    return fit_net(df, keys, features, targets, replace(cfg or NetConfig(loss="nll"), kind="variational"))


# The second model, which learns the spread of the first one.
SPREAD_CONFIG = NetConfig(
    kind="deterministic", hidden=(128, 128), dropout=(), input_dropout=0.0, epochs=2000, batch_size=64,
    step_decay=25, patience=200,
)


def fit_spread_model(oof: DataFrame, keys, features, spreads: Sequence[str], cfg: NetConfig = SPREAD_CONFIG) -> FittedNet:
    """Predict |median - truth| (columns ``spreads``) from the features."""
    return fit_deterministic_net(oof, keys, features, spreads, cfg)


def fit_forest(
    df: DataFrame, features: Sequence[str], targets: Sequence[str], n_trees: int = 100, depth: int = 10, seed: int = 42, bootstrap: bool = True
) -> dict[str, RandomForestRegressionModel]:
    """One random forest regressor per target; without ``bootstrap`` a tree sees every row once."""
    data = VectorAssembler(inputCols=list(features), outputCol="_x").transform(df)
    return {
        t: RandomForestRegressor(
            featuresCol="_x", labelCol=t, predictionCol=f"pred_{t}", numTrees=n_trees, maxDepth=depth, seed=seed, bootstrap=bootstrap
        ).fit(data)
        for t in targets
    }


def predict_forest(df: DataFrame, models: dict[str, RandomForestRegressionModel], features: Sequence[str]) -> DataFrame:
    out = VectorAssembler(inputCols=list(features), outputCol="_x").transform(df)
    for model in models.values():
        out = model.transform(out)
    return out.drop("_x")

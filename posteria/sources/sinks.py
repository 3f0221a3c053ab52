"""Writing predictions, splits, draws and fitted state."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from posteria.models.network import NetConfig
from posteria.models.training import FittedNet


def prediction_columns(
    df: DataFrame, keys: Sequence[str], pass_through: Sequence[str] = (), mode: str = "reduced", digits: int = 4
) -> DataFrame:
    """Reduced (keys + predictions) or full (with pass-through columns) output,
    numbers rounded; use six digits when mixtures are included."""
    if mode not in ("reduced", "full"):
        raise ValueError("mode must be 'reduced' or 'full'")
    dropped = set() if mode == "full" else set(pass_through) - set(keys)
    rounded = lambda f: (
        F.round(f.name, digits).alias(f.name) if f.dataType.typeName() in ("double", "float") else F.col(f.name)
    )
    return df.select(*[rounded(f) for f in df.schema.fields if f.name not in dropped])


def write_predictions(
    df: DataFrame, path: str, keys: Sequence[str], pass_through: Sequence[str] = (), mode: str = "reduced",
    digits: int = 4, partition_by: Sequence[str] = (), fmt: str = "parquet", save_mode: str = "append",
) -> None:
    out = prediction_columns(df, keys, pass_through, mode, digits)
    writer = out.write.mode(save_mode).partitionBy(*partition_by)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


def save_split(df: DataFrame, path: str, split_col: str = "split") -> None:
    """Train and validation rows with all their columns as one dataset."""
    df.write.mode("overwrite").partitionBy(split_col).parquet(path)


def load_split(spark: SparkSession, path: str, split: str | None = None, split_col: str = "split") -> DataFrame:
    df = spark.read.parquet(path)
    return df if split is None else df.filter(F.col(split_col) == split).drop(split_col)


def export_draws(draws: DataFrame, wanted: DataFrame, keys: Sequence[str], path: str, partition_by: Sequence[str] = ()) -> None:
    """Write the full draws of the objects whose keys are in ``wanted``."""
    chosen = draws.join(wanted.select(*keys).distinct(), list(keys), "left_semi")
    chosen.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


@dataclass
class CatalogState:
    """Everything that scoring needs besides the catalog. ``class_targets`` are
    the targets that stand for ``classes``, all of them if empty; ``spread`` is
    the second model, which predicts how far the medians are off."""

    model: FittedNet | None
    scaler: dict[str, tuple[float, float]]
    zeropoint: float | None = None
    classes: list[str] = field(default_factory=list)
    mags: list[str] = field(default_factory=list)
    photometry: str | None = None
    fold_motion: bool = False
    galactic_latitude: bool = False
    class_targets: list[str] = field(default_factory=list)
    spread: FittedNet | None = None


# fields that go into the settings row as they are
_PLAIN = ["scaler", "zeropoint", "classes", "mags", "photometry", "fold_motion", "galactic_latitude", "class_targets"]


def _described(model: FittedNet) -> dict:
    return {"cfg": model.cfg.as_dict(), "features": model.features, "targets": model.targets, "history": model.history}


def _write_weights(spark: SparkSession, model: FittedNet, path: str) -> None:
    rows = [(i, list(p.shape), p.ravel().tolist()) for i, p in enumerate(model.params)]
    spark.createDataFrame(rows, "place int, shape array<int>, numbers array<double>").write.mode("overwrite").parquet(path)


def _read_model(spark: SparkSession, found: dict, path: str) -> FittedNet:
    cfg = NetConfig(**{k: tuple(v) if isinstance(v, list) else v for k, v in found["cfg"].items()})
    weights = spark.read.parquet(path).orderBy("place").collect()  # as large as the model
    params = [np.array(r["numbers"], dtype=float).reshape(r["shape"]) for r in weights]
    return FittedNet(params, cfg, found["features"], found["targets"], [tuple(h) for h in found["history"]])


def save_state(spark: SparkSession, state: CatalogState, path: str) -> None:
    """Small tables: one row of settings, one row per weight array of each model."""
    settings = {**_described(state.model), **{name: getattr(state, name) for name in _PLAIN}}
    _write_weights(spark, state.model, f"{path}/weights")
    if state.spread is not None:
        settings["spread"] = _described(state.spread)
        _write_weights(spark, state.spread, f"{path}/spread_weights")
    one = spark.createDataFrame([(json.dumps(settings),)], "settings string")
    one.coalesce(1).write.mode("overwrite").text(f"{path}/settings")


def load_state(spark: SparkSession, path: str) -> CatalogState:
    found = json.loads(spark.read.text(f"{path}/settings").first()[0])
    model = _read_model(spark, found, f"{path}/weights")
    spread = _read_model(spark, found["spread"], f"{path}/spread_weights") if found.get("spread") else None
    found["scaler"] = {k: tuple(v) for k, v in found["scaler"].items()}
    return CatalogState(model, **{name: found[name] for name in _PLAIN}, spread=spread)

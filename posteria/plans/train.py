"""Training as a sequence of Spark jobs from a raw catalog to a fitted state."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posteria.models.network import NetConfig
from posteria.models.scoring import cross_validated_predictions
from posteria.models.training import SPREAD_CONFIG, fit_net, fit_spread_model
from posteria.operators import balance, cleaning, features, labels, sampling, scaling, selection
from posteria.operators.posterior import observed_spread
from posteria.plans.prepare import before_photometry, derive, fluxes_of, folded_names
from posteria.session import stage
from posteria.sources.sinks import CatalogState


@dataclass(frozen=True)
class TrainPlan:
    """What to train on: a class ``label``, numeric ``targets``, or both.

    ``select`` is None, 'anova' or 'rfe'; ``balancing`` is None, 'smote' or
    'undersample'. Rows without a target are dropped. The last of ``keys``
    must identify an object. With ``spread_folds`` out-of-fold predictions of
    that many folds train a second model, of how far the medians are off.
    """

    keys: tuple[str, ...]
    label: str | None
    features: tuple[str, ...]
    targets: tuple[str, ...] = ()
    target_errors: tuple[str, ...] = ()
    photometry: str | None = None
    fold_motion: bool = False
    galactic_latitude: bool = False
    mags: tuple[str, ...] = ()
    classes: tuple[str, ...] = ()
    valid_fraction: float = 0.10
    stratify: bool = False
    select: str | None = None
    balancing: str | None = "smote"
    seed: int = 42
    net: NetConfig = field(default_factory=NetConfig)
    spread_folds: int = 0
    spread_net: NetConfig = SPREAD_CONFIG
    spread_draws: int = 300

    def __post_init__(self):
        if not self.label and not self.targets:
            raise ValueError("a plan needs a label or targets")


def prepare_training(df: DataFrame, plan: TrainPlan) -> tuple[DataFrame, CatalogState]:
    """Clean, derive, scale, encode and split. The returned state has no model yet."""
    if plan.classes:
        df = cleaning.filter_class(df, plan.label, plan.classes)
    numeric = [*plan.targets, *plan.target_errors]
    if numeric:
        df = cleaning.sentinel_to_null(df, numeric, rule="<")
    df = cleaning.drop_null_targets(df, [*([plan.label] if plan.label else []), *numeric])

    state = CatalogState(
        None, {}, mags=list(plan.mags), photometry=plan.photometry, fold_motion=plan.fold_motion,
        galactic_latitude=plan.galactic_latitude,
    )
    raw = before_photometry(df, state)
    fluxes, _ = fluxes_of(raw, state)
    if fluxes:
        state.zeropoint = features.fit_flux_zeropoint(raw, fluxes).first()["zeropoint"]
    names = folded_names(plan.features, df.columns) if plan.fold_motion else list(plan.features)
    photo = fluxes or (features.photometry_columns(raw.columns, plan.photometry)[0] if plan.photometry else [])
    names = list(dict.fromkeys([*names, *(["b"] if plan.galactic_latitude else []), *photo]))

    df = features.attach_errors(cleaning.sentinel_to_null(derive(df, state), names), names)
    state.scaler = scaling.scaler_constants(scaling.fit_scaler(df, names))
    errors = [f"{n}__err" for n in names]
    df = cleaning.clip_unit(scaling.apply_scaler(df, state.scaler), [*names, *errors])
    df = cleaning.impute(df, names, errors)
    coded = []
    if plan.label:
        state.classes = labels.label_dictionary(df, plan.label)
        state.class_targets = [f"{plan.label}_{c}" for c in state.classes]
        df = labels.encode_labels(df, plan.label, state.classes)
        coded = [plan.label, f"{plan.label}_num", *state.class_targets]
    varied = {r["feature"] for r in selection.variance_filter(df, names).filter("kept").collect()}
    names = [n for n in names if n in varied]
    by = [plan.label] if plan.stratify and plan.label else []
    df = sampling.stratified_split(df, plan.keys, by, plan.valid_fraction, plan.seed)
    keep = [*plan.keys, *coded, *numeric, *names, *[f"{n}__err" for n in names], "split"]
    return stage(df.select(*keep), "training"), state


def best_features(train: DataFrame, plan: TrainPlan, names: Sequence[str], targets: Sequence[str]) -> list[str]:
    if plan.select is None:
        return list(names)
    if plan.select == "anova":
        chosen = {r["feature"] for r in selection.union_selected(train, names, targets).collect()}
    else:
        table = selection.rfe_cv(
            train, plan.keys, names, targets[-1], step=max(len(names) // 50, 1), least=max(len(names) // 20, 1)
        )
        chosen = set(table.filter("best").first()["features"])
    return [n for n in names if n in chosen]


def balanced(train: DataFrame, plan: TrainPlan, names: Sequence[str], targets: Sequence[str]) -> DataFrame:
    if not plan.label:
        return train.withColumn("synthetic", F.lit(0))
    if plan.balancing == "undersample":
        return sampling.undersample(train, plan.keys, plan.label, plan.seed).withColumn("synthetic", F.lit(0))
    if plan.balancing == "smote":
        carried = [*targets, *[f"{n}__err" for n in names]]
        return balance.smote(train, plan.keys, plan.label, names, carried, seed=plan.seed)
    return train.withColumn("synthetic", F.lit(0))


def train(df: DataFrame, plan: TrainPlan) -> tuple[CatalogState, DataFrame]:
    """(fitted state, prepared rows with their split). Validation rows never
    take part in selection, balancing or fitting."""
    prepared, state = prepare_training(df, plan)
    targets = [*plan.targets, *state.class_targets]
    names = [c.removesuffix("__err") for c in prepared.columns if c.endswith("__err")]
    rows = prepared.filter(F.col("split") == "train")
    names = best_features(rows, plan, names, targets)
    fitted = balanced(rows, plan, names, targets)
    state.model = fit_net(fitted, [*plan.keys, "synthetic"], names, targets, plan.net)
    if plan.spread_folds:
        unseen, _ = cross_validated_predictions(rows, plan.keys, names, targets, plan.net, plan.spread_folds, n_iter=plan.spread_draws)
        off = observed_spread(unseen, {f"sigma_{t}": (f"{t}_pc50", t) for t in targets})
        state.spread = fit_spread_model(stage(off, "spread"), plan.keys, names, [f"sigma_{t}" for t in targets], plan.spread_net)
    return state, prepared

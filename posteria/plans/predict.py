"""Bulk scoring as one plan: clean, scale, draw, summarise, name the class."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posteria.models.scoring import summarised_draws
from posteria.operators import cleaning, labels, scaling
from posteria.operators.features import attach_errors
from posteria.operators.joins import enrich
from posteria.plans.prepare import derive
from posteria.models.training import FittedNet
from posteria.sources.sinks import CatalogState


def prepare_features(df: DataFrame, state: CatalogState, error_suffix: str = "__err") -> DataFrame:
    """Derive, clean and scale as fitted; missing numbers get the fill value."""
    names = state.model.features
    out = cleaning.sentinel_to_null(derive(df, state), names)
    bare = [f for f in names if f + error_suffix not in out.columns]
    if bare:
        out = attach_errors(out, bare)
    errors = [f + error_suffix for f in names]
    out = scaling.apply_scaler(out, {f: c for f, c in state.scaler.items() if f in names}, error_suffix)
    out = cleaning.clip_unit(out, [*names, *errors])
    return cleaning.impute(out, names, errors)


def score(
    df: DataFrame, state: CatalogState, keys: Sequence[str], n_iter: int = 300, keep: Sequence[str] = (),
    mixtures: bool = False, input_noise: bool = False, spread: FittedNet | None = None,
    external: DataFrame | None = None,
) -> DataFrame:
    """Posterior summary and most probable class of every row, any table size.

    After the optional join everything is row-local: one pass makes the draws,
    summarises them and fits the mixtures, and no object moves between tasks.
    Sigmas come from ``spread``, or the spread model of the state.
    """
    spread = spread or state.spread
    if external is not None:
        df = enrich(df, external, keys)
    kept = [*keys, *[c for c in keep if c not in keys]]
    # pass-through columns keep their values, whatever the scaled features are called
    held = {c: f"_keep_{i}" for i, c in enumerate(kept) if c in df.columns}
    ready = prepare_features(df.withColumns({n: F.col(c) for c, n in held.items()}), state)
    out = summarised_draws(ready, state.model, [held[k] for k in keys], n_iter, [held.get(c, c) for c in kept], input_noise, mixtures=mixtures, spread=spread)
    out = out.withColumnsRenamed({n: c for c, n in held.items()})
    if state.classes:
        named = state.class_targets or state.model.targets
        out = labels.predicted_class(out, [f"{t}_pc50" for t in named], state.classes)
    return cleaning.floor_sigma(out, spread.targets) if spread is not None else out


def predict_external(test_catalog: DataFrame, state: CatalogState, keys: Sequence[str], **how) -> DataFrame:
    """Score an extra table at training time with the state just fitted."""
    return score(test_catalog, state, keys, **how)

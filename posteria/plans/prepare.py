"""Derived features, the same for training and scoring."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from posteria.operators import cleaning, features
from posteria.sources.sinks import CatalogState

# Fixed values: (ra, dec, error of ra, error of dec, length, its error, scale,
# errors taken absolute) of the two proper-motion catalogs.
MOTIONS = [
    ("pmra_g", "pmde_g", "e_pmra_g", "e_pmde_g", "pm_g", "pm_g_error", 1.0, False),
    ("pmra_cw", "pmde_cw", "e_pmra_cw", "e_pmde_cw", "pm_cw", "e_pm_cw", 1000.0, True),
]
SKY = ("alpha_j2000", "delta_j2000")


def fold_motions(df: DataFrame) -> DataFrame:
    """Replace the components of each proper motion that is present by its length."""
    for ra, dec, era, edec, out, error, scale, absolute in MOTIONS:
        if {ra, dec, era, edec} <= set(df.columns):
            df = cleaning.sentinel_to_null(df, [ra, dec, era, edec])
            df = features.proper_motion(df, ra, dec, era, edec, out, error, scale, absolute)
    return df


def folded_names(names: Sequence[str], columns: Sequence[str]) -> list[str]:
    """Feature names after ``fold_motions`` of a table with ``columns``."""
    out = list(names)
    for *parts, length, error, _, _ in MOTIONS:
        if set(parts) <= set(columns) and set(parts) & set(out):
            out = [n for n in out if n not in parts] + [error, length]
    return out


def fluxes_of(df: DataFrame, state: CatalogState) -> tuple[list[str], list[str]]:
    if not state.photometry or "flux" not in state.photometry:
        return [], []
    return features.photometry_columns(df.columns, state.photometry)


def before_photometry(df: DataFrame, state: CatalogState) -> DataFrame:
    if state.fold_motion:
        df = fold_motions(df)
    if state.galactic_latitude:
        df = features.galactic(df, *SKY)
    df = cleaning.missing_mag_to_null(df, [m for m in state.mags if m in df.columns])
    return cleaning.sentinel_to_null(df, fluxes_of(df, state)[0])


def derive(df: DataFrame, state: CatalogState) -> DataFrame:
    """Motions folded, coordinates turned, magnitudes cleaned, fluxes as
    logarithms above the fitted zero point with errors ``<flux>_error``."""
    df = before_photometry(df, state)
    fluxes, relative = fluxes_of(df, state)
    if not fluxes:
        return df
    df = features.log_flux(df, list(zip(fluxes, relative)), state.zeropoint, errors_are_relative=True)
    return df.withColumnsRenamed({r: f"{f}_error" for f, r in zip(fluxes, relative)})

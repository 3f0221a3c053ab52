"""Derived features with propagated errors."""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posteria.functions import scalar
from posteria.operators.cleaning import _replace

# Fixed values: (value pattern, value exclusion, error pattern, error exclusion)
# by preset. Columns are chosen by substring.
PHOTOMETRY = {
    "flux_psfcor": ("flux_psfcor", None, "flux_relerr_psfcor", None),
    "corr_photo_3": ("corr_mag_aper_3_0", None, "flux_relerr_aper_3", None),
    "photo_3": ("mag_aper_3_0", "corr_", "flux_relerr_aper_3", None),
    "flux_3_worstpsf": ("flux_aper3_worstpsf_", None, "flux_relerr_aper3_worstpsf", None),
    "mag_3_worstpsf": ("mag_aper3_worstpsf_", None, "flux_relerr_aper3_worstpsf", None),
    "flux_aper_3_0": ("flux_aper_3_0_", None, "flux_relerr_aper_3_0_", None),
    "fnu_flux_aper": ("fnu_flux_aper_", None, "fnu_flux_relerr_aper_", None),
    "flux_aper": ("flux_aper_", "_flux_aper_", "flux_relerr_aper_", "_flux_relerr_aper_"),
    "mag_aper": ("mag_aper_", None, "mag_err_aper_", None),
}

# The survey's bands and column families.
BANDS = ["uJAVA", "J0378", "J0395", "J0410", "J0430", "gSDSS", "J0515", "rSDSS", "J0660", "iSDSS", "J0861", "zSDSS"]
TILE_QUALITY = ["NOISE", "ELLIPTICITY_MEAN", "FWHM_MEAN", "FWHMG", "MOFFATBETA_MEAN"]
TILE_QUALITY_WITH_ERRORS = ["ZPT", "NOISE_RMS", "FWHMG_RMS", "DEPTH2FWHM5S", "DEPTH3ARC5S", "M50S", "KS", "M50G", "KG"]
SOURCE_QUALITY = ["flags", "norm_wmap_val", "mask_flags"]
ASTROMETRY = ["pmra_g", "pmde_g", "plx", "ruwe", "fg", "fbp", "frp"]
ASTROMETRY_ERRORS = ["e_pmra_g", "e_pmde_g", "e_plx", "e_fg", "e_fbp", "e_frp", "angdist_gaia"]
INFRARED = ["pmra_cw", "pmde_cw", "w1mpropm_cw", "w2mpropm_cw", "angdist_cw", "jmag", "hmag", "kmag"]
INFRARED_ERRORS = ["e_pmra_cw", "e_pmde_cw", "e_w1mpropm_cw", "e_w2mpropm_cw", "e_jmag", "e_hmag", "e_kmag", "angdist_aw"]
STRUCTURE = ["x_image", "y_image", "r_eff", "fwhm_world", "a_world", "b_world", "theta_j2000", "isoarea_world", "petro_radius", "kron_radius"]
REDDENING = ["ebv"]


def base_features(with_errors: bool = True) -> list[str]:
    """Names of the base feature preset, with or without error-like columns."""
    tile = TILE_QUALITY + (TILE_QUALITY_WITH_ERRORS if with_errors else [])
    quality = [f"{band}_{q}" for q in tile for band in BANDS]
    quality += [f"{q}_{band}B" for q in SOURCE_QUALITY for band in BANDS]
    brightness = [f"mu_max_{band}B" for band in BANDS]
    astrometry = ASTROMETRY + (ASTROMETRY_ERRORS if with_errors else [])
    infrared = INFRARED + (INFRARED_ERRORS if with_errors else [])
    return quality + brightness + astrometry + STRUCTURE + infrared + REDDENING


def photometry_columns(columns: Iterable[str], preset: str = "flux_aper") -> tuple[list[str], list[str]]:
    """(value columns, error columns) present in ``columns`` for a named preset."""
    if preset not in PHOTOMETRY:
        raise ValueError(f"unknown photometry preset {preset!r}; choose from {sorted(PHOTOMETRY)}")
    value, not_value, error, not_error = PHOTOMETRY[preset]
    columns = list(columns)
    pick = lambda has, lacks: [c for c in columns if has in c and not (lacks and lacks in c)]
    return pick(value, not_value), pick(error, not_error)


def error_column(columns: Iterable[str], feature: str, prefix_aware: bool = False) -> str | None:
    """Name of the column holding the error of ``feature``, or None.

    A feature named ``..mag_x`` looks for ``mag_err_x`` only; with
    ``prefix_aware`` it also looks for ``<prefix>mag_err_x``.
    """
    have = set(columns)
    if f"{feature}_error" in have:
        return f"{feature}_error"
    head, mag, tail = feature.partition("mag_")
    if mag:
        tail = tail.split("mag_")[0]
        names = ([f"{head}mag_err_{tail}"] if prefix_aware else []) + [f"mag_err_{tail}"]
    else:
        names = [f"{feature}{end}" for end in ("_err", "_ERR", "_RMS")]
        names += [feature.replace("_ZPT", "") + "_ERRZPT", f"e_{feature}"]
    return next((n for n in names if n in have), None)


def attach_errors(df: DataFrame, features: Sequence[str], prefix_aware: bool = False) -> DataFrame:
    """Add ``<feature>__err`` for every feature; null where no error exists."""
    if not features:
        raise ValueError("attach_errors needs at least one feature")
    found = {f: error_column(df.columns, f, prefix_aware) for f in features}
    return df.select(
        "*",
        *[(F.col(e) if e else F.lit(None)).cast("double").alias(f"{f}__err") for f, e in found.items()],
    )


def absolute_error_name(relative: str) -> str:
    """``flux_relerr_aper_1`` -> ``flux_aper_1_error``."""
    for part in ("relerr_", "_relerr", "relerr"):
        relative = relative.replace(part, "")
    return relative + "_error"


def relative_to_absolute(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Add absolute errors for (value, relative error) column pairs."""
    return df.select(
        "*", *[(F.col(rel) * F.col(val)).alias(absolute_error_name(rel)) for val, rel in pairs]
    )


def proper_motion(
    df: DataFrame, ra: str, dec: str, era: str, edec: str, out: str = "pm_g",
    out_error: str = "pm_g_error", scale: float = 1.0, absolute_errors: bool = False,
) -> DataFrame:
    """Fold the two components into a length and its error, drop the inputs."""
    k = F.lit(float(scale))
    sa, sd = F.col(era), F.col(edec)
    if absolute_errors:
        sa, sd = F.abs(sa), F.abs(sd)
    length, spread = scalar.hypot_sigma(F.col(ra) * k, F.col(dec) * k, sa * k, sd * k)
    return df.select("*", spread.alias(out_error), length.alias(out)).drop(ra, dec, era, edec)


def galactic(df: DataFrame, ra: str, dec: str) -> DataFrame:
    r, d = F.col(ra), F.col(dec)
    return df.select(
        "*", scalar.galactic_longitude(r, d).alias("l"), scalar.galactic_latitude(r, d).alias("b")
    )


def fit_flux_zeropoint(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row ``zeropoint``: the median over columns of the column minimum."""
    lows = df.agg(F.array(*[F.min(c) for c in cols]).alias("lows"))
    # only as many rows as there are columns
    return lows.select(F.explode("lows").alias("low")).agg(F.median("low").alias("zeropoint"))


def log_flux(
    df: DataFrame, pairs: Sequence[tuple[str, str]], zeropoint: float, errors_are_relative: bool = False
) -> DataFrame:
    """``flux -> log10(flux - zeropoint)`` with the error divided by flux first.

    ``errors_are_relative=True`` skips that division, for error columns that
    are relative already. Non-positive arguments give null.
    """
    new = {}
    for flux, err in pairs:
        value = F.col(flux)
        base = F.lit(math.log(10.0)) if errors_are_relative else value * F.lit(math.log(10.0))
        new[err] = F.try_divide(F.col(err), base)
        shifted = value - F.lit(zeropoint)
        new[flux] = F.when(shifted > 0, F.log10(shifted))
    return _replace(df, new)


def pairwise_colors(df: DataFrame, mags: Sequence[str]) -> DataFrame:
    return df.select(
        "*", *[(F.col(a) - F.col(b)).alias(f"{a}-{b}") for a, b in combinations(mags, 2)]
    )


def strip_prefix(df: DataFrame, prefixes: Sequence[str] = ("pred_nom_", "pred_var_")) -> DataFrame:
    names = df.columns
    for p in prefixes:
        names = [n.replace(p, "") for n in names]
    return df.toDF(*names)

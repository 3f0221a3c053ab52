"""Column expressions shared by the operators."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# J2000 direction of the north galactic pole and the galactic
# longitude of the north celestial pole, in degrees.
POLE_RA = 192.8594812065348
POLE_DEC = 27.12825118085622
NORTH_CELESTIAL_L = 122.9319185680026


def clip(c: Column, low: float, high: float) -> Column:
    """Clip that leaves null as null (``greatest``/``least`` skip nulls)."""
    return F.when(c < low, F.lit(float(low))).when(c > high, F.lit(float(high))).otherwise(c)


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def galactic_latitude(ra: Column, dec: Column) -> Column:
    d, pole = F.radians(dec), math.radians(POLE_DEC)
    turn = F.radians(ra - F.lit(POLE_RA))
    sine = F.sin(d) * math.sin(pole) + F.cos(d) * math.cos(pole) * F.cos(turn)
    return F.degrees(F.asin(F.greatest(F.least(sine, F.lit(1.0)), F.lit(-1.0))))


def galactic_longitude(ra: Column, dec: Column) -> Column:
    d, pole = F.radians(dec), math.radians(POLE_DEC)
    turn = F.radians(ra - F.lit(POLE_RA))
    east = F.cos(d) * F.sin(turn)
    north = F.sin(d) * math.cos(pole) - F.cos(d) * math.sin(pole) * F.cos(turn)
    return F.pmod(F.lit(NORTH_CELESTIAL_L) - F.degrees(F.atan2(east, north)), F.lit(360.0))


def hypot_sigma(a: Column, b: Column, sa: Column, sb: Column) -> tuple[Column, Column]:
    """Length of (a, b) and its first-order uncertainty (null at zero length)."""
    length = F.sqrt(a * a + b * b)
    spread = F.sqrt((a * sa) * (a * sa) + (b * sb) * (b * sb))
    return length, F.try_divide(spread, length)


def softplus(c: Column) -> Column:
    return F.greatest(c, F.lit(0.0)) + F.log1p(F.exp(-F.abs(c)))


def right_closed_bin(c: Column, low: int, high: int) -> Column:
    """Left edge of the unit bin (a, a+1] that holds ``c``; null outside."""
    return F.when((c > low) & (c <= high), (F.ceil(c) - 1).cast("int"))


def grid_cell(c: Column, low: float, high: float, bins: int, closed: bool = True) -> Column:
    """0-based cell of an equal grid, null outside. ``closed`` puts values on
    the last edge into the last cell."""
    cell = F.floor((c - F.lit(low)) / F.lit(high - low) * F.lit(float(bins))).cast("int")
    inside = (c >= low) & ((c <= high) if closed else (c < high))
    return F.when(inside, F.least(cell, F.lit(bins - 1)))

"""Rotation of three class probabilities into the plane they live in."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# An orthogonal matrix whose third row is the simplex normal, so
# the third rotated coordinate of probabilities that sum to one is constant.
_A = (math.sqrt(3) + 3) / 6
_B = -math.sqrt((2 - math.sqrt(3)) / 6)
_C = 1 / math.sqrt(3)
ROTATION = ((_A, _B, -_C), (_B, _A, -_C), (_C, _C, _C))
PLANE = ROTATION[:2]


def to_plane(p: tuple[Column, Column, Column]) -> tuple[Column, Column]:
    x, y = (row[0] * p[0] + row[1] * p[1] + row[2] * p[2] for row in PLANE)
    return x, y


def from_plane(x: Column, y: Column) -> tuple[Column, Column, Column]:
    """Back to three coordinates that sum to one."""
    a, b, c = (PLANE[0][i] * x + PLANE[1][i] * y + F.lit(1 / 3) for i in range(3))
    return a, b, c


def covariance_from_plane(c11: Column, c12: Column, c22: Column) -> dict[str, Column]:
    """Upper triangle of the 3x3 covariance that the plane covariance stands for."""
    out = {}
    for i in range(3):
        for j in range(i, 3):
            u, v = PLANE[0], PLANE[1]
            out[f"{i + 1}{j + 1}"] = (
                u[i] * u[j] * c11 + (u[i] * v[j] + v[i] * u[j]) * c12 + v[i] * v[j] * c22
            )
    return out

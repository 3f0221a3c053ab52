"""Key-derived randomness: the same key gives the same number in any
partitioning and after any retry, so nothing here uses ``rand()``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_POW_32 = 4294967296.0
HALF_STEP = 2.0**-33


def _text(keys: Column | str | Sequence[Column | str]) -> list[Column]:
    if isinstance(keys, (str, Column)):
        keys = [keys]
    return [(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]


def digest(keys, stream) -> Column:
    """32 hex digits per key and stream: four independent uniforms."""
    stream = stream if isinstance(stream, Column) else F.lit(stream)
    return F.md5(F.concat_ws("|", *_text(keys), stream.cast("string")))


def uniform_of(hexed: Column, part: int = 0) -> Column:
    """Uniform in [0, 1) from the ``part``-th eight digits of a digest."""
    return F.conv(F.substring(hexed, 8 * part + 1, 8), 16, 10).cast("bigint") / F.lit(TWO_POW_32)


def normal_of(hexed: Column, pair: int = 0) -> Column:
    """Standard normal by Box-Muller from one half of a digest."""
    radius = F.sqrt(F.lit(-2.0) * F.log(uniform_of(hexed, 2 * pair) + F.lit(HALF_STEP)))
    return radius * F.cos(F.lit(2.0) * F.pi() * uniform_of(hexed, 2 * pair + 1))


def uniform(keys, stream) -> Column:
    """Uniform in [0, 1) from the key and a stream number."""
    return uniform_of(digest(keys, stream))


def normal(keys, stream) -> Column:
    """Standard normal from the key and a stream number."""
    return normal_of(digest(keys, stream))


def seeded_hash(keys, seed: int) -> Column:
    """32 hex digits that order rows reproducibly for one seed."""
    return digest(keys, seed)

"""Random numbers of an address: numpy arrays that no batch size or partitioning changes."""

from __future__ import annotations

import numpy as np


def _mixed(z: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of ``z``."""
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def bits(seeds: np.ndarray, n_iter: int, layer: int, width: int) -> np.ndarray:
    """64 random bits for every (object, draw, layer, unit): they are a function of that address alone,
    so no batch or partition changes them. Objects are named by 64-bit seeds."""
    place = np.arange(n_iter, dtype=np.uint64)[:, None] << np.uint64(32) | np.uint64(layer << 24) | np.arange(width, dtype=np.uint64)
    return _mixed(_mixed(seeds.astype(np.int64).view(np.uint64))[:, None, None] + (place + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))


def masks(seeds: np.ndarray, n_iter: int, layer: int, width: int, rate: float) -> np.ndarray:
    """Dropout factors, 0 or 1 / (1 - rate); four units share the bits of an address."""
    return MaskMaker(n_iter, layer, width, rate)(seeds)


class MaskMaker:
    """``masks`` of one layer for some objects after others, in arrays that are used again."""

    def __init__(self, n_iter: int, layer: int, width: int, rate: float):
        place = np.arange(n_iter, dtype=np.uint64)[:, None] << np.uint64(32) | np.uint64(layer << 24) | np.arange(-(-width // 4), dtype=np.uint64)
        self.steps, self.width, self.cut = (place + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15), width, round(rate * 65536)
        self.made = None

    def __call__(self, seeds: np.ndarray) -> np.ndarray:
        """Factors (objects, draws, units), good until the next call."""
        shape = (len(seeds), *self.steps.shape)
        if self.made is None or self.made[0].shape != shape:
            wide = (*shape[:2], self.width)
            self.made = np.empty(shape, np.uint64), np.empty(shape, np.uint64), np.empty(wide, bool), np.empty(wide)
        z, spare, kept, factors = self.made
        np.add(_mixed(seeds.astype(np.int64).view(np.uint64))[:, None, None], self.steps, out=z)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
            np.right_shift(z, np.uint64(shift), out=spare)
            z ^= spare
            if factor != 1:
                z *= np.uint64(factor)
        np.greater_equal(z.view(np.uint16)[:, :, : self.width], self.cut, out=kept)
        return np.multiply(kept, 65536 / (65536 - self.cut), out=factors)


def normals(seeds: np.ndarray, n_iter: int, layer: int, width: int) -> np.ndarray:
    found = bits(seeds, n_iter, layer, width)
    u = ((found >> np.uint64(32)).astype(float) + 0.5) / 2**32
    angle = (found & np.uint64(0xFFFFFFFF)).astype(float) * (2 * np.pi / 2**32)
    return np.sqrt(-2 * np.log(u)) * np.cos(angle)


def uniforms(seeds: np.ndarray, n_iter: int, layer: int, width: int) -> np.ndarray:
    """In [0, 1)."""
    return (bits(seeds, n_iter, layer, width) >> np.uint64(11)).astype(float) / 2**53


def ragged_normals(seeds: np.ndarray, counts: np.ndarray, layers: np.ndarray, width: int) -> list[np.ndarray]:
    """For each unit the normals of all segments, one after another: of segment i the first ``counts[i]`` draws
    of ``normals(seeds[i:i + 1], ..., layers[i], width)``. Nothing is drawn beyond them."""
    place = np.arange(int(counts.max(initial=0)), dtype=np.uint64) * np.uint64((0x9E3779B97F4A7C15 << 32) % 2**64)
    start, ends, found = _mixed(seeds.astype(np.int64).view(np.uint64)), np.cumsum(counts), []
    spare = np.empty(int(counts.sum()), np.uint64)
    for unit in range(width):
        first = start + ((layers.astype(np.uint64) << np.uint64(24)) + np.uint64(unit + 1)) * np.uint64(0x9E3779B97F4A7C15)
        z = np.empty_like(spare)
        for c, end, at in zip(counts.tolist(), ends.tolist(), first):
            np.add(place[:c], at, out=z[end - c : end])
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
            np.right_shift(z, np.uint64(shift), out=spare)
            z ^= spare
            if factor != 1:
                z *= np.uint64(factor)
        np.right_shift(z, np.uint64(32), out=spare)
        u = spare.astype(float)
        u += 0.5
        u /= 2**32
        np.log(u, out=u)
        u *= -2
        np.sqrt(u, out=u)
        z &= np.uint64(0xFFFFFFFF)
        angle = z.astype(float)
        angle *= 2 * np.pi / 2**32
        u *= np.cos(angle, out=angle)
        found.append(u)
    return found

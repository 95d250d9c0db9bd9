"""Reversible 5/3 wavelet and 8x8 cosine transform.

The wavelet is a lifting over array columns (higher-order functions), and the same on numpy tiles for the codec.
Integer divisions truncate towards zero.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .color import quotient
from .grid import reflect


def _let(value: Column, body) -> Column:
    """body of the value, which is computed once: within a lambda an expression would be computed for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def forward(a: Column) -> Column:
    """Low half, then high half, of an array of integers; arrays of fewer than two stay."""

    def lifted(a: Column) -> Column:
        n = F.size(a)
        at = lambda i: F.get(a, reflect(i, n))
        high = F.transform(F.sequence(F.lit(0), quotient(n, 2) - 1), lambda k: F.get(a, 2 * k + 1) - quotient(at(2 * k) + at(2 * k + 2), 2))

        def with_high(high: Column) -> Column:
            detail = lambda i: F.get(high, quotient(reflect(i, n), 2))
            low = F.transform(F.sequence(F.lit(0), n - quotient(n, 2) - 1), lambda k: F.get(a, 2 * k) + quotient(detail(2 * k - 1) + detail(2 * k + 1) + 2, 4))
            return F.concat(low, high)

        return F.when(n < 2, a).otherwise(_let(high, with_high))

    return _let(a, lifted)


def inverse(d: Column) -> Column:
    def unlifted(d: Column) -> Column:
        n = F.size(d)
        half = n - quotient(n, 2)
        detail = lambda i: F.get(d, half + quotient(reflect(i, n), 2))
        even = F.transform(F.sequence(F.lit(0), half - 1), lambda k: F.get(d, k) - quotient(detail(2 * k - 1) + detail(2 * k + 1) + 2, 4))

        def with_even(even: Column) -> Column:
            near = lambda i: F.get(even, quotient(reflect(i, n), 2))
            odd = lambda i: F.get(d, half + quotient(i, 2)) + quotient(near(i - 1) + near(i + 1), 2)
            return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(i % 2 == 0, F.get(even, quotient(i, 2))).otherwise(odd(i)))

        return F.when(n < 2, d).otherwise(_let(even, with_even))

    return _let(d, unlifted)


def _div(a: np.ndarray, b: int) -> np.ndarray:
    return np.sign(a) * (np.abs(a) // b)


def lift(x: np.ndarray, axis: int) -> np.ndarray:
    """Forward along an axis of any array of integers."""
    x = np.moveaxis(x, axis, -1).astype(np.int64)
    n = x.shape[-1]
    if n < 2:
        return np.moveaxis(x, -1, axis)
    index = np.arange(n + 1)
    index[n] = n - 2
    follow = x[..., index[2 : n + 1 : 2]]
    high = x[..., 1::2] - _div(x[..., : n - 1 : 2][..., : n // 2] + follow[..., : n // 2], 2)
    m = n - n // 2
    before = np.concatenate([high[..., :1], high], axis=-1)[..., :m]
    after = np.concatenate([high, high[..., -1:]], axis=-1)[..., :m]
    return np.moveaxis(np.concatenate([x[..., ::2] + _div(before + after + 2, 4), high], axis=-1), -1, axis)


def unlift(d: np.ndarray, axis: int) -> np.ndarray:
    d = np.moveaxis(d, axis, -1).astype(np.int64)
    n = d.shape[-1]
    if n < 2:
        return np.moveaxis(d, -1, axis)
    m = n - n // 2
    low, high = d[..., :m], d[..., m:]
    before = np.concatenate([high[..., :1], high], axis=-1)[..., :m]
    after = np.concatenate([high, high[..., -1:]], axis=-1)[..., :m]
    out = np.empty_like(d)
    even = out[..., ::2] = low - _div(before + after + 2, 4)
    follow = np.concatenate([even[..., 1:], even[..., -1:]], axis=-1)[..., : n // 2]
    out[..., 1::2] = high + _div(even[..., : n // 2] + follow, 2)
    return np.moveaxis(out, -1, axis)


def forward_tiles(tiles: np.ndarray, levels: int | None = None) -> np.ndarray:
    """(count, T, T): columns then rows, on the top-left corner that halves at each level."""
    out, dim = tiles.astype(np.int64), tiles.shape[-1]
    while dim > 1 and levels != 0:
        out[:, :dim, :dim] = lift(lift(out[:, :dim, :dim], 1), 2)
        dim, levels = dim // 2, None if levels is None else levels - 1
    return out


def inverse_tiles(tiles: np.ndarray) -> np.ndarray:
    out, dim = tiles.astype(np.int64), 2
    while dim <= tiles.shape[-1]:
        out[:, :dim, :dim] = unlift(unlift(out[:, :dim, :dim], 2), 1)
        dim *= 2
    return out


#: Rows of the 8-point cosine transform.
DCT = np.array([[np.sqrt((1 if k == 0 else 2) / 8) * np.cos((2 * i + 1) * k * np.pi / 16) for i in range(8)] for k in range(8)])

# The luminance and chrominance tables of the JPEG standard's annex K.
LUMA = (
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
)
CHROMA = (
    17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99,
)


def dct_row(a: Column) -> Column:
    """The 8-point transform of an array of 8."""
    rows = [F.array(*(F.lit(float(c)) for c in r)) for r in DCT]
    return F.array(*(F.aggregate(F.zip_with(a, r, lambda x, c: x.cast("double") * c), F.lit(0.0), lambda s, x: s + x) for r in rows))


def dct_tiles(tiles: np.ndarray) -> np.ndarray:
    return np.einsum("ki,nij,lj->nkl", DCT, tiles, DCT)


def idct_tiles(tiles: np.ndarray) -> np.ndarray:
    return np.einsum("ki,nkl,lj->nij", DCT, tiles, DCT)


def byte_tiles(tiles: np.ndarray) -> np.ndarray:
    """The inverse transform as bytes: rounded and held within 0..255."""
    return np.clip(np.floor(idct_tiles(tiles) + 0.5), 0, 255).astype(np.uint8)

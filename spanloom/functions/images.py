"""Hashes of small grids of cells, as arrays of bits or as 64-bit words, and their distance."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def mean_bits(cells: Column) -> Column:
    """1 where a cell is above the mean of all."""
    total = F.aggregate(cells, F.lit(0.0), lambda s, x: s + x)
    mean = total / F.size(cells)
    return F.transform(cells, lambda x: (x > mean).cast("int"))


def difference_bits(cells: Column, width: int, step: int) -> Column:
    """1 where a cell is above the one ``step`` further: 1 for along rows, ``width`` for down columns."""
    inside = lambda i: (i % width < width - 1) if step == 1 else (i + step < F.size(cells))
    places = F.filter(F.sequence(F.lit(0), F.size(cells) - 1), inside)
    return F.transform(places, lambda i: (F.get(cells, i) > F.get(cells, i + step)).cast("int"))


def words(bits: Column) -> Column:
    """64-bit words of bits, the first bit the highest."""
    count = F.ceil(F.size(bits) / 64).cast("int")
    return F.transform(F.sequence(F.lit(0), count - 1), lambda w: F.aggregate(F.slice(bits, w * 64 + 1, 64), F.lit(0).cast("long"), lambda s, b: F.shiftleft(s, 1).bitwiseOR(b.cast("long"))))


def hamming(a: Column, b: Column) -> Column:
    """Bits in which two arrays of words differ."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def differing_share(a: Column, b: Column, threshold: float) -> Column:
    """Share of cells that differ by ``threshold`` or more; signatures of other lengths differ wholly."""
    apart = F.size(F.filter(F.zip_with(a, b, lambda x, y: F.abs(x - y)), lambda d: d >= threshold))
    return F.when(F.size(a) != F.size(b), 1.0).otherwise(apart / F.size(a))


def is_flat(cells: Column, least_deviation: float = 20.0, low: float = 12.0, high: float = 243.0) -> Column:
    """Whether a grey image is of one colour in effect."""
    mean = F.aggregate(cells, F.lit(0.0), lambda s, x: s + x) / F.size(cells)
    spread = F.sqrt(F.aggregate(cells, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / F.size(cells))
    return (spread < least_deviation) | (mean < low) | (mean > high)


def edge_density(cells: Column, width: int, threshold: float = 48.0) -> Column:
    """Share of the cells of a grey picture (rows of ``width``) that lie on a strong edge.

    A cell's edge is eight times itself less its neighbours, within 0 and 255; cells of the border are taken as they are.
    """
    rows = F.size(cells) / width
    at = lambda i: F.element_at(cells, i.cast("int") + 1)

    def strong(i: Column) -> Column:
        x, y = F.pmod(i, F.lit(width)), F.floor(i / width)
        inner = (x > 0) & (x < width - 1) & (y > 0) & (y < rows - 1)
        around = sum((at(F.when(inner, i + dy * width + dx).otherwise(i)) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dx or dy), F.lit(0.0))
        edge = F.least(F.greatest(8 * at(i) - around, F.lit(0.0)), F.lit(255.0))
        return F.when(inner, edge).otherwise(at(i)) >= threshold

    places = F.sequence(F.lit(0), F.size(cells) - 1)
    return F.when((F.lit(width) < 2) | (rows < 2), 0.0).otherwise(F.size(F.filter(places, strong)) / F.size(cells))


def shrunk(picture: np.ndarray, width: int, height: int) -> np.ndarray:
    """A grey picture at another size, each new cell the mean of the old ones weighed by a triangle around it."""
    for axis, size in ((1, width), (0, height)):
        old = picture.shape[axis]
        scale = max(old / size, 1.0)
        centre = (np.arange(size) + 0.5) * old / size
        weight = np.maximum(0, 1 - np.abs(np.arange(old)[None, :] + 0.5 - centre[:, None]) / scale)
        weight /= weight.sum(1, keepdims=True)
        picture = np.clip(np.floor(np.tensordot(weight, picture, (1, axis)) + 0.5), 0, 255)
        picture = picture if axis == 0 else picture.T
    return picture


def fingerprint(picture: np.ndarray, box: tuple[float, float, float, float]) -> str:
    """256 bits in hexadecimal: whether each of 8 rows of a crop (pixels) grows brighter from cell to cell; empty for no crop."""
    left, top, right, bottom = (int(round(x)) for x in box)
    if right <= left or bottom <= top:
        return ""
    cells = shrunk(picture[top:bottom, left:right].astype(float), 33, 8)
    bits = (cells[:, 1:] > cells[:, :-1]).ravel()
    return f"{int(''.join('1' if b else '0' for b in bits), 2):064x}"


def montage_cell(width: int, height: int, n: int) -> tuple[int, int]:
    """Width and height of a cell of an n x n montage, which must come out whole."""
    if n < 1:
        raise ValueError("a montage has one cell a side or more")
    if width % n or height % n:
        raise ValueError(f"{width} x {height} can't be cut into {n} x {n} cells")
    return width // n, height // n

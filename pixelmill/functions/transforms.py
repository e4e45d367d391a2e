"""Small block transforms as expressions over array elements: they stay inside generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def at(block: Column, width: int, y0: int, x0: int) -> list[list[Column]]:
    """The 4x4 samples from (y0, x0) of a block stored row by row."""
    return [[F.get(block, F.lit((y0 + y) * width + x0 + x)).cast("long") for x in range(4)] for y in range(4)]


def transposed(m: list[list[Column]]) -> list[list[Column]]:
    return [list(row) for row in zip(*m, strict=True)]


def hadamard4(v: list[Column]) -> list[Column]:
    s, d, t, u = v[0] + v[2], v[0] - v[2], v[1] + v[3], v[1] - v[3]
    return [s + t, d + u, d - u, s - t]


def satd4(e: list[list[Column]]) -> Column:
    """Sum of the absolute two-dimensional Hadamard coefficients."""
    flat = [c for row in transposed([hadamard4(r) for r in transposed([hadamard4(r) for r in e])]) for c in row]
    return sum((F.abs(c) for c in flat[1:]), F.abs(flat[0]))


def walsh4(v: list[Column]) -> list[Column]:
    """The lossless 4-point Walsh-Hadamard step, in its output order."""
    a, d = v[0] + v[1], v[3] - v[2]
    e = F.shiftright(a - d, 1)
    b, c = e - v[1], e - v[2]
    return [a - c, c, d + b, b]


def dct_basis(n: int) -> list[list[float]]:
    """Rows of the orthonormal DCT."""
    return [[math.sqrt((1 if k == 0 else 2) / n) * math.cos(math.pi * (2 * i + 1) * k / (2 * n)) for i in range(n)] for k in range(n)]


#: Rows of the 8-point forward ADST, 12 fractional bits.
ADST8 = (
    (567, 1682, 2730, 3675, 4477, 5109, 5544, 5766), (1682, 4480, 5766, 5109, 2732, -569, -3675, -5545), (2732, 5766, 3675, -1682, -5544, -4479, 569, 5109), (3675, 5108, -1681, -5764, -569, 5542, 2732, -4479),
    (4479, 2732, -5542, -569, 5764, -1681, -5108, 3675), (5109, -569, -4479, 5544, -1682, -3675, 5766, -2732), (5545, -3675, 569, 2732, -5109, 5766, -4480, 1682), (5766, -5544, 5109, -4477, 3675, -2730, 1682, -567),
)


def adst8(v: Column) -> Column:
    """The 8-point ADST of an array, rounded."""
    return F.array(*[F.shiftright(sum((F.get(v, F.lit(j)).cast("long") * w for j, w in enumerate(row)), F.lit(2048).cast("long")), 12) for row in ADST8])

"""Chroma predicted from luma by three terms, fitted to the samples around a block in fixed point.

The terms of a sample are luma beside it (its own, the one above, or the one to the left, by direction), its own luma
squared, and a constant. Parameters solve the regularised normal equations by elimination in whole numbers of 16
fractional bits: pivots are inverted by a piecewise quadratic, products are cut so that they stay within 29 bits, so
every engine finds the same ones. Blocks are worked on in Arrow batches, all of a batch at once; sums are by block, in
the row that holds its plane, so nothing is shuffled.

A block is fitted to the row above and the column left of it, from the corner to the last but one sample of each, the
outermost ring of two rows and columns being read for neighbours only.

Defined results: planes with nulls or of a wrong size give no rows. A block with nothing around it has the parameters
(0, 0, 1). Flat surroundings make the equations singular; the regularisation solves them all the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fractional bits, bits of a product, precision of a reciprocal and of its square, and the bits of its segments.
DECIMALS, PRODUCT, PRECISION, SQUARE, SEGMENT = 16, 29, 14, 8, 11
#: The reciprocal's weight, origin and height by segment.
WEIGHTS = np.array([214, 153, 113, 86, 67, 53, 43, 35])
ORIGINS = np.array([4822, 5952, 6624, 6792, 6408, 5424, 3792, 1466])
HEIGHTS = np.array([12784, 12054, 11670, 11583, 11764, 12195, 12870, 13782])
#: Directions: (rows, columns) from a sample to the luma of its first term.
TAPS = ((0, 0), (-1, 0), (0, -1))
TERMS, DEPTH, RING, PLANES = 3, 8, 2, 32


def bit_length(x: np.ndarray) -> np.ndarray:
    """Of the magnitude; 1 for zero."""
    return np.frexp(np.maximum(np.abs(x), 1).astype(float))[1].astype(np.int64)


def multiplied(a: np.ndarray, b: np.ndarray, shift: np.ndarray | int) -> np.ndarray:
    """a * b >> shift, rounded away from zero; what a product has beyond 29 bits is cut off its factors first, and off the shift."""
    a, b = np.broadcast_arrays(a, b)
    excess = np.maximum(bit_length(a) + bit_length(b) - PRODUCT, 0)
    product = (a >> (excess // 2)) * (b >> (excess - excess // 2))
    left = shift - excess
    by = np.clip(left, 1, PRODUCT)
    rounded = np.sign(product) * ((np.abs(product) + (np.int64(1) << (by - 1))) >> by)
    return np.where(left <= 0, product, np.where(left > PRODUCT, 0, rounded))


def reciprocal(d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(scale, shift) for positive d: multiplied(x, scale, shift) is x / d with 16 fractional bits."""
    shift = bit_length(d) - 1
    over = np.maximum(shift - PRECISION, 0)
    scaled = np.where(over > 0, (d + ((np.int64(1) << over) >> 1)) >> over, d << np.maximum(PRECISION - shift, 0))
    part = np.minimum(scaled, (2 << PRECISION) - 1) & ((1 << PRECISION) - 1)
    segment = part >> SEGMENT
    off = part - ORIGINS[segment]
    curve = (WEIGHTS[segment] * ((off * off) >> PRECISION)) >> SQUARE
    return (curve - (off >> 1) + HEIGHTS[segment]) << (DECIMALS - PRECISION), shift


def solved(matrix: np.ndarray, right: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """(n, terms) of symmetric matrices (n, terms, terms) and right sides (n, terms), the diagonals raised by two steps of the depth."""
    terms = right.shape[1]
    c = np.concatenate([matrix + (2 << (depth - 8)) * np.eye(terms, dtype=np.int64), right[:, :, None]], axis=2)
    for i in range(terms):
        scale, shift = reciprocal(np.maximum(np.abs(c[:, i, i]), 1))
        c[:, i, i + 1 :] = multiplied(c[:, i, i + 1 :], scale[:, None], shift[:, None])
        c[:, i + 1 :, i + 1 :] -= multiplied(c[:, i + 1 :, i, None], c[:, i, None, i + 1 :], DECIMALS)
    out = np.zeros_like(right)
    for i in reversed(range(terms)):
        out[:, i] = c[:, i, terms] - multiplied(c[:, i, i + 1 : terms], out[:, i + 1 :], DECIMALS).sum(1)
    return out


def terms_of(luma: np.ndarray, y: np.ndarray, x: np.ndarray, tap: tuple[int, int], depth: int = DEPTH) -> np.ndarray:
    """(planes, samples, terms) at the places; a neighbour outside the plane is the sample itself."""
    own, middle = luma[:, y, x], 1 << (depth - 1)
    ny, nx = y + tap[0], x + tap[1]
    inside = (ny >= 0) & (nx >= 0)
    beside = luma[:, np.where(inside, ny, y), np.where(inside, nx, x)]
    return np.stack([beside, (own * own + middle) >> depth, np.full_like(own, middle)], axis=2)


def around(y0: int, x0: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places that a block is fitted to."""
    top, left = (RING if y0 >= RING else 0), (RING if x0 >= RING else 0)
    ys, xs = np.mgrid[1 : top + size - 1, 1 : left + size - 1]
    edge = (ys < top) | (xs < left)
    return ys[edge] + y0 - top, xs[edge] + x0 - left


def fitted(luma: np.ndarray, chroma: np.ndarray, y0: int, x0: int, size: int, tap: tuple[int, int], depth: int = DEPTH) -> np.ndarray:
    """(planes, terms): the parameters of one block of each plane."""
    y, x = around(y0, x0, size)
    if not len(y):
        return np.tile([0, 0, 1 << DECIMALS], (len(luma), 1)).astype(np.int64)
    a = terms_of(luma, y, x, tap, depth)
    matrix, right = np.einsum("nsi,nsj->nij", a, a), np.einsum("nsi,ns->ni", a, chroma[:, y, x])
    shift = DECIMALS + 6 - 2 * depth - (len(y) - 1).bit_length()
    scaled = (lambda m: m << shift) if shift >= 0 else (lambda m: m >> -shift)
    return solved(scaled(matrix), scaled(right), depth)


def predicted(luma: np.ndarray, parameters: np.ndarray, y0: int, x0: int, size: int, tap: tuple[int, int], depth: int = DEPTH) -> np.ndarray:
    """(planes, samples of the block row by row)."""
    y, x = (k.ravel() for k in np.mgrid[y0 : y0 + size, x0 : x0 + size])
    total = multiplied(terms_of(luma, y, x, tap, depth), parameters[:, None, :], DECIMALS).sum(2)
    return np.clip(total, 0, (1 << depth) - 1)


def fits(planes: DataFrame, width: int, size: int = 8, key: str = "image") -> DataFrame:
    """(key, block, direction, parameters, sad, samples): each block of (key, luma, chroma) by each direction.

    luma and chroma: 8-bit samples row by row, of one size, luma already brought to chroma's resolution. Blocks count
    row by row; what is left over at the right and lower edge has none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths = np.array(b["size"])
            for length in np.unique(lengths):
                part = b.filter(pa.array(lengths == length))
                for at in range(0, part.num_rows, PLANES):
                    some = part.slice(at, PLANES)
                    luma, chroma = (some[c].flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(some.num_rows, -1, width) for c in ("luma", "chroma"))
                    across = width // size
                    for block in range(luma.shape[1] // size * across):
                        y0, x0 = block // across * size, block % across * size
                        own = chroma[:, y0 : y0 + size, x0 : x0 + size].reshape(some.num_rows, -1)
                        for direction, tap in enumerate(TAPS):
                            parameters = fitted(luma, chroma, y0, x0, size, tap)
                            found = predicted(luma, parameters, y0, x0, size, tap)
                            same = lambda v: pa.array(np.full(some.num_rows, v, np.int32))  # noqa: B023, E731
                            columns = [some[key], same(block), same(direction), pa.array(list(parameters), pa.list_(pa.int64())), pa.array(np.abs(own - found).sum(1)), pa.array(list(found.astype(np.int32)), pa.list_(pa.int32()))]
                            yield pa.RecordBatch.from_arrays(columns, [key, "block", "direction", "parameters", "sad", "samples"])

    whole = (F.size("luma") == F.size("chroma")) & (F.size("luma") > 0) & (F.size("luma") % width == 0) & ~F.exists("luma", F.isnull) & ~F.exists("chroma", F.isnull)
    rows = planes.where(whole).select(F.col(key).cast("long").alias(key), F.col("luma").cast("array<int>").alias("luma"), F.col("chroma").cast("array<int>").alias("chroma"), F.size("luma").alias("size"))
    return rows.mapInArrow(run, f"{key} long, block int, direction int, parameters array<long>, sad long, samples array<int>")


def best(found: DataFrame, key: str = "image") -> DataFrame:
    """The direction of least error of each block, ties to the first."""
    least = F.min_by(F.struct("direction", "parameters", "sad", "samples"), F.struct("sad", "direction")).alias("b")
    return found.groupBy(key, "block").agg(least).select(key, "block", "b.*")

"""Whole-number cosine transforms of blocks of 4, 8, 16 or 32 samples a side, forward and inverse.

The forward transform halves a vector into sums and weighted differences of mirrored samples, again and again; every
product is rounded, so results are the same on any machine. Coefficients are eight times the orthonormal ones. The
inverse transform is that of the public AV1 bitstream specification: rotations by 12-bit cosines and clamped
butterflies, rows before columns. It takes coefficients of over 256 samples at half scale, which `inverse` sees to.

Both work on lanes: sequences of anything that adds, subtracts and has `times`; arrays of all blocks of a batch here.
Blocks in rows are cut from square planes, so one pass serves every shape.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIDES = (4, 8, 16, 32)
#: Bits of headroom that samples get where a side is 32, and bits of the inverse's row and column sums.
HEADROOM, INNER_BITS = 6, 16
Times = Callable[[object, int], object]


def times16(x: np.ndarray, factor: int) -> np.ndarray:
    """Product with a factor of 16 fractional bits, rounded."""
    return (x * factor + (1 << 15)) >> 16


def weight(n: int, i: int) -> int:
    return round(65536 / (2 * math.cos(math.pi * (2 * i + 1) / (2 * n))))


ROOT2 = round(65536 * math.sqrt(2))


def forward_lanes(v: Sequence, times: Times = times16) -> list:
    """The transform of a sequence of 2, 4, 8, 16 or 32 values, times the root of their number."""
    n = len(v)
    if n == 2:
        return [v[0] + v[1], v[0] - v[1]]
    mirrored = list(zip(v[: n // 2], reversed(v[n // 2 :]), strict=True))
    even = forward_lanes([a + b for a, b in mirrored], times)
    odd = forward_lanes([times(a - b, weight(n, i)) for i, (a, b) in enumerate(mirrored)], times)
    odd = [times(odd[0], ROOT2) + odd[1]] + [a + b for a, b in zip(odd[1:], odd[2:], strict=False)] + odd[-1:]
    return [x for both in zip(even, odd, strict=True) for x in both]


def scale(height: int, width: int) -> int:
    return round(65536 * 8 / math.sqrt(height * width))


def along(planes: np.ndarray, axis: int, lanes: Callable[[list[np.ndarray]], list[np.ndarray]]) -> np.ndarray:
    return np.stack(lanes([planes.take(i, axis) for i in range(planes.shape[axis])]), axis)


def forward(blocks: np.ndarray) -> np.ndarray:
    """Coefficients (n, height, width) of blocks (n, height, width): columns, then rows."""
    height, width = blocks.shape[1:]
    spare = HEADROOM if max(height, width) == 32 else 0
    both = along(along(blocks.astype(np.int64) << spare, 1, forward_lanes), 2, forward_lanes)
    return (both * scale(height, width) + (1 << (15 + spare))) >> (16 + spare)


def cosine(angle: int) -> int:
    """In 128ths of a half turn, of 12 fractional bits."""
    return round(4096 * math.cos(math.pi * angle / 128))


def mirrored_bits(bits: int, x: int) -> int:
    return int(format(x, f"0{bits}b")[::-1], 2) if bits else 0


def inverse_lanes(v: Sequence[np.ndarray], bits: int = INNER_BITS) -> list[np.ndarray]:
    """The inverse of a sequence of 4, 8, 16 or 32 coefficients, times the root of half their number."""
    n = len(v).bit_length() - 1
    t = [v[mirrored_bits(n, i)] for i in range(len(v))]
    low, high = -(1 << (bits - 1)), (1 << (bits - 1)) - 1

    def turn(a: int, b: int, angle: int, swap: bool = False) -> None:
        c, s = cosine(angle), cosine(angle - 64)
        x, y = (t[a] * c - t[b] * s + 2048) >> 12, (t[a] * s + t[b] * c + 2048) >> 12
        t[a], t[b] = (y, x) if swap else (x, y)

    def cross(a: int, b: int, other: bool = False) -> None:
        a, b = (b, a) if other else (a, b)
        t[a], t[b] = np.clip(t[a] + t[b], low, high), np.clip(t[a] - t[b], low, high)

    # the odd half of each size is turned in, then mixed in stages that run beside those of the smaller sizes
    if n >= 5:
        for i in range(8):
            turn(16 + i, 31 - i, 6 + (mirrored_bits(3, 7 - i) << 3))
    if n >= 4:
        for i in range(4):
            turn(8 + i, 15 - i, 12 + (mirrored_bits(2, 3 - i) << 4))
    if n >= 5:
        for i in range(8):
            cross(16 + 2 * i, 17 + 2 * i, i % 2 == 1)
    if n >= 3:
        for i in range(2):
            turn(4 + i, 7 - i, 56 - 32 * i)
    if n >= 4:
        for i in range(4):
            cross(8 + 2 * i, 9 + 2 * i, i % 2 == 1)
    if n >= 5:
        for i in range(2):
            for j in range(2):
                turn(30 - 4 * i - j, 17 + 4 * i + j, 24 + 64 * j + 32 * (1 - i), True)
    for i in range(2):
        turn(2 * i, 2 * i + 1, 32 + 16 * i, i == 0)
    if n >= 3:
        for i in range(2):
            cross(4 + 2 * i, 5 + 2 * i, i == 1)
    if n >= 4:
        for i in range(2):
            turn(14 - i, 9 + i, 48 + 64 * i, True)
    if n >= 5:
        for i in range(4):
            for j in range(2):
                cross(16 + 4 * i + j, 19 + 4 * i - j, i % 2 == 1)
    for i in range(2):
        cross(i, 3 - i)
    if n >= 3:
        turn(6, 5, 32, True)
    if n >= 4:
        for i in range(2):
            for j in range(2):
                cross(8 + 4 * i + j, 11 + 4 * i - j, i == 1)
    if n >= 5:
        for i in range(4):
            turn(29 - i, 18 + i, 48 + 64 * (i // 2), True)
    if n >= 3:
        for i in range(4):
            cross(i, 7 - i)
    if n >= 4:
        for i in range(2):
            turn(13 - i, 10 + i, 32, True)
    if n >= 5:
        for i in range(2):
            for j in range(4):
                cross(16 + 8 * i + j, 23 + 8 * i - j, i == 1)
    if n >= 4:
        for i in range(8):
            cross(i, 15 - i)
    if n >= 5:
        for i in range(4):
            turn(27 - i, 20 + i, 32, True)
        for i in range(16):
            cross(i, 31 - i)
    return t


def inverse(coefficients: np.ndarray) -> np.ndarray:
    """Blocks (n, height, width) of what forward() returns."""
    height, width = coefficients.shape[1:]
    x = coefficients.astype(np.int64)
    # scales, as powers of two: of the coefficients, of both passes, and of the root of two that unequal sides leave
    area = (height * width).bit_length() - 1
    if area > 8:
        x = np.sign(x) * (np.abs(x) >> 1)
    if area % 2:
        x = (x * cosine(32) + 2048) >> 12
    x = along(np.clip(x, -(1 << 15), (1 << 15) - 1), 2, inverse_lanes)
    down = area // 2 - 2 - (area > 8)
    x = (x + ((1 << down) >> 1)) >> down
    return (along(np.clip(x, -(1 << 15), (1 << 15) - 1), 1, inverse_lanes) + 8) >> 4


def cut(planes: np.ndarray, height: int, width: int) -> np.ndarray:
    """All blocks of that shape of planes (n, side, side), in reading order: (n, blocks, height, width)."""
    n, side = planes.shape[:2]
    return planes.reshape(n, side // height, height, side // width, width).transpose(0, 1, 3, 2, 4).reshape(n, -1, height, width)


def by_shape(planes: DataFrame, side: int, shapes: Sequence[tuple[int, int]], work: Callable[[np.ndarray], np.ndarray], value: str, key: str = "image") -> DataFrame:
    """(key, height, width, block, values) of (key, samples): `work` on every block of every shape; height, width of SIDES.

    Rows with a null or another number of samples than side x side have none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                some = b.slice(at, 64)
                whole = some["samples"].flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, side, side)
                for height, width in shapes:
                    blocks = cut(whole, height, width)
                    n, each = blocks.shape[:2]
                    found = work(blocks.reshape(-1, height, width)).reshape(n * each, -1).astype(np.int32)
                    rows = len(found)
                    yield pa.RecordBatch.from_arrays(
                        [some[key].take(pa.array(np.repeat(np.arange(n), each))), pa.array(np.full(rows, height, np.int32)), pa.array(np.full(rows, width, np.int32)), pa.array(np.tile(np.arange(each, dtype=np.int32), n)), pa.array(list(found), pa.list_(pa.int32()))],
                        [key, "height", "width", "block", value],
                    )

    fit = (F.size("samples") == side * side) & ~F.exists("samples", F.isnull)
    return planes.where(fit).select(key, "samples").mapInArrow(run, f"{key} long, height int, width int, block int, {value} array<int>")


def coefficients(planes: DataFrame, side: int, shapes: Sequence[tuple[int, int]], key: str = "image") -> DataFrame:
    """(key, height, width, block, coefficients), each block's in reading order of frequencies (down, across)."""
    return by_shape(planes, side, shapes, forward, "coefficients", key)


def round_trip(planes: DataFrame, side: int, shapes: Sequence[tuple[int, int]], key: str = "image") -> DataFrame:
    """(key, height, width, block, samples): the blocks after forward and inverse."""
    return by_shape(planes, side, shapes, lambda x: inverse(forward(x)), "samples", key)

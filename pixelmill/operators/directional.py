"""Prediction of blocks from the samples around them: along a direction, or by filters that feed on what they predict.

Edges are those of the public AV1 bitstream specification: 2n samples above and to the left of an n x n block and the
corner, the nearest sample where one is missing. Steep edges are smoothed, those of small blocks at small angles are
doubled, and a prediction lies between two samples of an edge, in 32nds. Blocks are cut from whole planes, so all
edges are the plane's own samples (open loop), and no block waits for another. Everything is on arrays of all blocks of
a batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The directions, in degrees, and what is added to them.
NOMINAL, DELTAS = (45, 67, 90, 113, 135, 157, 180, 203), (-9, -6, -3, 0, 3, 6, 9)
ANGLES = tuple(sorted(a + d for a in NOMINAL for d in DELTAS))
#: Steps in 64ths of a sample a row, by degrees.
STEPS = {3: 1023, 6: 547, 9: 372, 14: 273, 17: 215, 20: 178, 23: 151, 26: 132, 29: 116, 32: 102, 36: 90, 39: 80, 42: 71, 45: 64, 48: 57, 51: 51, 54: 45, 58: 40, 61: 35, 64: 31, 67: 27, 70: 23, 73: 19, 76: 15, 81: 11, 84: 7, 87: 3}
#: Edge filters by strength, in sixteenths.
SMOOTHERS = ((0, 4, 8, 4, 0), (0, 5, 6, 5, 0), (2, 4, 4, 4, 2))
#: By the sum of both sides at most, (degrees at least, strength), for plain neighbours and for smooth ones.
STRENGTHS = {False: {8: ((56, 1),), 16: ((40, 1),), 24: ((8, 1), (16, 2), (32, 3)), 32: ((1, 1), (4, 2), (32, 3)), 256: ((1, 3),)}, True: {8: ((40, 1), (64, 2)), 16: ((20, 1), (48, 2)), 24: ((4, 3),), 32: ((1, 3),), 256: ((1, 3),)}}
#: Sixteenths of the corner, of the sample above, and of the one to the left, for each recursive filter.
FILTERS = ((-6, 10, 12), (-10, 16, 10), (-8, 8, 16), (-2, 8, 10), (-12, 14, 14))


def edges(planes: np.ndarray, size: int, bits: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Of all blocks of planes (n, side, side), in reading order: above and left, each (blocks, 1 + 2 * size) from the corner on."""
    n, side = planes.shape[:2]
    y, x = (v.ravel() for v in np.meshgrid(np.arange(0, side, size), np.arange(0, side, size), indexing="ij"))
    top, left, reach, half = (y > 0)[:, None], (x > 0)[:, None], np.arange(2 * size), 1 << (bits - 1)
    at = lambda yy, xx: planes[:, np.clip(yy, 0, side - 1), np.clip(xx, 0, side - 1)]
    y, x = y[:, None], x[:, None]
    above = np.where(top, at(y - 1, x + reach), np.where(left, at(y, x - 1), half - 1))
    beside = np.where(left, at(y + reach, x - 1), np.where(top, at(y - 1, x), half + 1))
    corner = np.where(top & left, at(y - 1, x - 1), np.where(left, at(y, x - 1), np.where(top, at(y - 1, x), half)))
    return tuple(np.concatenate([corner, e], 2).reshape(-1, 1 + 2 * size) for e in (above, beside))


def strength(sides: int, degrees: int, smooth: bool) -> int:
    rule = next(rule for most, rule in STRENGTHS[smooth].items() if sides <= most)
    return max((s for least, s in rule if abs(degrees) >= least), default=0)


def smoothed(edge: np.ndarray, count: int, power: int) -> np.ndarray:
    """An edge whose first `count` samples after the corner are filtered, those at its ends repeated."""
    if not power:
        return edge
    out = edge.copy()
    places = np.arange(1, count + 1)
    out[:, 1 : count + 1] = (sum(w * edge[:, np.clip(places + k - 2, 0, count)] for k, w in enumerate(SMOOTHERS[power - 1])) + 8) >> 4
    return out


def doubled(edge: np.ndarray, count: int, bits: int) -> np.ndarray:
    """The edge at every half sample, from one before the corner's half to that before the last; its first is the corner."""
    v = np.concatenate([edge[:, :1], edge[:, : count + 1], edge[:, count : count + 1]], 1)
    between = np.clip((9 * (v[:, 1:-2] + v[:, 2:-1]) - v[:, :-3] - v[:, 3:] + 8) >> 4, 0, (1 << bits) - 1)
    return np.concatenate([edge[:, :1], np.stack([between, v[:, 2:-1]], 2).reshape(len(edge), -1)], 1)


def predicted(above: np.ndarray, left: np.ndarray, angle: int, smooth: bool = False, bits: int = 8) -> np.ndarray:
    """(blocks, size, size) along an angle of ANGLES; smooth: whether neighbours are predicted smoothly."""
    size = (above.shape[1] - 1) // 2
    y, x = np.mgrid[:size, :size]
    if angle in (90, 180):
        return above[:, 1 + x] if angle == 90 else left[:, 1 + y]
    if 90 < angle < 180 and 2 * size >= 24:
        corner = (5 * left[:, 1] + 6 * above[:, 0] + 5 * above[:, 1] + 8) >> 4
        above, left = above.copy(), left.copy()
        above[:, 0] = left[:, 0] = corner
    double = []
    ready = []
    for edge, from_, far in ((above, 90, angle < 90), (left, 180, angle > 180)):
        count, d = size * (1 + far), abs(angle - from_)
        edge = smoothed(edge, count, strength(2 * size, d, smooth))
        double.append(int(0 < d < 40 and 2 * size <= (8 if smooth else 16)))
        ready.append((doubled(edge, count, bits), 2) if double[-1] else (edge, 1))

    def between(which: int, base: np.ndarray, along: np.ndarray) -> np.ndarray:
        """Between the samples at base and after it; `along` is the place in 64ths of a sample."""
        (edge, first), share = ready[which], ((along << double[which]) >> 1) & 31
        low, high = (edge[:, np.clip(base + first + k, 0, edge.shape[1] - 1)] for k in (0, 1))
        return (low * (32 - share) + high * share + 16) >> 5

    if angle < 90:
        along = (y + 1) * STEPS[angle]
        base, last = (along >> (6 - double[0])) + (x << double[0]), (2 * size - 1) << double[0]
        return np.where(base < last, between(0, base, along), ready[0][0][:, last + ready[0][1]][:, None, None])
    if angle > 180:
        along = (x + 1) * STEPS[270 - angle]
        return between(1, (along >> (6 - double[1])) + (y << double[1]), along)
    over, beside = (x << 6) - (y + 1) * STEPS[180 - angle], (y << 6) - (x + 1) * STEPS[angle - 90]
    base = over >> (6 - double[0])
    return np.where(base >= -(1 << double[0]), between(0, base, over), between(1, beside >> (6 - double[1]), beside))


def filter_taps(corner: int, above: int, left: int) -> np.ndarray:
    """(8, 7) sixteenths by which the corner, four samples above and two to the left make a patch of 2 x 4 samples.

    Each sample is filtered from its three neighbours in turn. Rows are rounded so that they still sum to 16: those with
    the largest remainders are rounded up, of equals the earlier, and the corner last.
    """
    shares = {(-1, -1): np.eye(7)[0] * 16, **{(-1, k): np.eye(7)[1 + k] * 16 for k in range(4)}, **{(k, -1): np.eye(7)[5 + k] * 16 for k in range(2)}}
    out = []
    for y in range(2):
        for x in range(4):
            row = shares[y, x] = (corner * shares[y - 1, x - 1] + above * shares[y - 1, x] + left * shares[y, x - 1]) / 16
            whole = np.floor(row).astype(int)
            order = sorted(range(7), key=lambda k: (whole[k] - row[k], k == 0, k))  # noqa: B023
            whole[order[: 16 - whole.sum()]] += 1
            out.append(whole)
    return np.array(out)


TAPS = tuple(filter_taps(*f) for f in FILTERS)


def filtered(above: np.ndarray, left: np.ndarray, mode: int, bits: int = 8) -> np.ndarray:
    """(blocks, size, size) by one of FILTERS: patches of 2 x 4, each from the edges or from the patches before it."""
    size = (above.shape[1] - 1) // 2
    grid = np.zeros((len(above), size + 1, size + 1), np.int64)
    grid[:, 0], grid[:, :, 0] = above[:, : size + 1], left[:, : size + 1]
    for y in range(1, size + 1, 2):
        for x in range(1, size + 1, 4):
            near = np.concatenate([grid[:, y - 1, x - 1 : x + 4], grid[:, y : y + 2, x - 1]], 1)
            patch = np.clip((near @ TAPS[mode].T + 8) >> 4, 0, (1 << bits) - 1)
            grid[:, y : y + 2, x : x + 4] = patch.reshape(-1, 2, 4)
    return grid[:, 1:, 1:]


def by_mode(planes: DataFrame, side: int, size: int, modes: Sequence[int], predict: Callable[[np.ndarray, np.ndarray, int], np.ndarray], mode: str, key: str = "image") -> DataFrame:
    """(key, block, mode, samples, sad): each mode's prediction of each block of (key, samples), and how far it is off.

    Rows with a null or another number of samples than side x side have none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 16):
                some = b.slice(at, 16)
                whole = some["samples"].flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, side, side)
                above, left = edges(whole, size)
                n, each = len(whole), (side // size) ** 2
                own = whole.reshape(n, side // size, size, side // size, size).transpose(0, 1, 3, 2, 4).reshape(-1, size, size)
                of, block = pa.array(np.repeat(np.arange(n), each)), pa.array(np.tile(np.arange(each, dtype=np.int32), n))
                for k in modes:
                    found = predict(above, left, k)
                    sads = np.abs(own - found).sum((1, 2))
                    yield pa.RecordBatch.from_arrays([some[key].take(of), block, pa.array(np.full(n * each, k, np.int32)), pa.array(list(found.reshape(n * each, -1).astype(np.int32)), pa.list_(pa.int32())), pa.array(sads)], [key, "block", mode, "samples", "sad"])

    fit = (F.size("samples") == side * side) & ~F.exists("samples", F.isnull)
    return planes.where(fit).select(key, "samples").mapInArrow(run, f"{key} long, block int, {mode} int, samples array<int>, sad long")


def by_angle(planes: DataFrame, side: int, size: int, angles: Sequence[int] = ANGLES, key: str = "image") -> DataFrame:
    return by_mode(planes, side, size, angles, predicted, "angle", key)


def by_filter(planes: DataFrame, side: int, size: int, key: str = "image") -> DataFrame:
    return by_mode(planes, side, size, range(len(FILTERS)), filtered, "mode", key)

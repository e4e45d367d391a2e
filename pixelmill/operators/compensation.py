"""Motion between successive frames: subpixel prediction, block search, and global motion by a pyramid of resolutions.

A row holds a frame and the one before it (pairs), so a stream is shuffled once, a row a frame; everything else happens
in Arrow batches, for all blocks of all frames of a batch at once. Frames are in parallel. Samples outside a frame are
those of its nearest edge. Vectors are (row, col) in eighths of a sample, from a block to where it was before.

Defined results: frames without one before, or with a null or a wrong number of samples in either, give no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The eight taps, of 128, at each sixteenth of a sample, from three samples before to four after.
TAPS = np.array([
    [0, 0, 0, 128, 0, 0, 0, 0], [0, 2, -6, 126, 8, -2, 0, 0], [0, 2, -10, 122, 18, -4, 0, 0], [0, 2, -12, 116, 28, -8, 2, 0], [0, 2, -14, 110, 38, -10, 2, 0], [0, 2, -14, 102, 48, -12, 2, 0], [0, 2, -16, 94, 58, -12, 2, 0], [0, 2, -14, 84, 66, -12, 2, 0],
    [0, 2, -14, 76, 76, -14, 2, 0], [0, 2, -12, 66, 84, -14, 2, 0], [0, 2, -12, 58, 94, -16, 2, 0], [0, 2, -12, 48, 102, -14, 2, 0], [0, 2, -10, 38, 110, -14, 2, 0], [0, 2, -8, 28, 116, -12, 2, 0], [0, 0, -4, 18, 122, -10, 2, 0], [0, 0, -2, 8, 126, -6, 2, 0],
])
#: Frames of a batch that are worked on at once.
FRAMES = 32
#: The steps around a vector, in the order in which equals are preferred.
CROSS = [(-1, 0), (1, 0), (0, -1), (0, 1)]
AROUND = CROSS + [(-1, -1), (-1, 1), (1, -1), (1, 1)]
FAR = np.int64(1) << 60


def pairs(frames: DataFrame, stream: str = "stream") -> DataFrame:
    """(stream, frame, samples, before) of (stream, frame, samples): an equi-join on shifted frame numbers."""
    before = frames.select(stream, (F.col("frame") + 1).alias("frame"), F.col("samples").alias("before"))
    return frames.select(stream, "frame", "samples").join(before, [stream, "frame"])


def batched(rows: DataFrame, height: int, width: int, work: Callable[..., dict[str, np.ndarray]], schema: str, keys: tuple[str, ...] = ("stream", "frame")) -> DataFrame:
    """Rows of `work`, which gets planes (samples and before) and returns columns, `of` being each row's place among the planes."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64()}
    whole = (F.size("samples") == height * width) & (F.size("before") == height * width)
    none = ~F.exists("samples", F.isnull) & ~F.exists("before", F.isnull)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, FRAMES):
                part = b.slice(at, FRAMES)
                plane = [part[c].flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, height, width) for c in ("samples", "before")]
                found = work(*plane)
                of = pa.array(found.pop("of"))
                names = [x.split() for x in schema.split(", ")]
                yield pa.RecordBatch.from_arrays([part[n].take(of) if n in keys else pa.array(found[n], kinds[kind]) for n, kind in names], [n for n, _ in names])

    return rows.where(whole & none).select(*keys, "samples", "before").mapInArrow(run, schema)


def predicted(planes: np.ndarray, of: np.ndarray, y: np.ndarray, x: np.ndarray, vectors: np.ndarray, size: int) -> np.ndarray:
    """The blocks (of planes[of], their corner at y, x) that the vectors point to, interpolated both ways."""
    height, width = planes.shape[1:]
    reach = np.arange(-3, size + 4)
    rows = np.clip((y + (vectors[:, 0] >> 3))[:, None] + reach, 0, height - 1)
    cols = np.clip((x + (vectors[:, 1] >> 3))[:, None] + reach, 0, width - 1)
    patch = planes[of[:, None, None], rows[:, :, None], cols[:, None, :]]
    down, across = (TAPS[(vectors[:, k] & 7) * 2] for k in (0, 1))
    half = (sum(across[:, t, None, None] * patch[:, :, t : t + size] for t in range(8)) + 4) >> 3
    return np.clip((sum(down[:, t, None, None] * half[:, t : t + size] for t in range(8)) + 1024) >> 11, 0, 255)


def whole_blocks(planes: np.ndarray, of: np.ndarray, y: np.ndarray, x: np.ndarray, size: int) -> np.ndarray:
    height, width = planes.shape[1:]
    reach = np.arange(size)
    return planes[of[:, None, None], np.clip(y[:, None] + reach, 0, height - 1)[:, :, None], np.clip(x[:, None] + reach, 0, width - 1)[:, None, :]]


def vector_cost(vectors: np.ndarray, weight: int) -> np.ndarray:
    """As laws.motion_cost."""
    bits = 2 * (np.frexp((np.abs(vectors) + 1).astype(float))[1]) + (vectors != 0)
    return (2 + bits.sum(1)) * weight


def satd(d: np.ndarray) -> np.ndarray:
    """Sums of absolute two-dimensional Hadamard coefficients of the 4x4 parts of differences (n, size, size)."""
    h = np.array([[1, 1, 1, 1], [1, 1, -1, -1], [1, -1, -1, 1], [1, -1, 1, -1]])
    n, size = d.shape[:2]
    parts = d.reshape(n, size // 4, 4, size // 4, 4).transpose(0, 1, 3, 2, 4)
    return np.abs(h @ parts @ h.T).sum((1, 2, 3, 4))


def grid(n: int, height: int, width: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(of, y, x) of all whole blocks of n planes."""
    of, y, x = np.meshgrid(np.arange(n), np.arange(0, height - size + 1, size), np.arange(0, width - size + 1, size), indexing="ij")
    return of.ravel(), y.ravel(), x.ravel()


def searched(samples: np.ndarray, before: np.ndarray, starts: np.ndarray, size: int, reach: int, dense: int, weight: int) -> dict[str, np.ndarray]:
    """Vector and cost of each block.

    From the better of no motion and its plane's start: steps of halving length to the best of eight neighbours while
    they improve, then every whole vector within `dense` samples (both by SAD), then half and quarter samples (by
    SATD). Costs include the vector's; of equals the first tried is kept.
    """
    of, y, x = grid(len(samples), *samples.shape[1:], size)
    own = whole_blocks(samples, of, y, x, size)

    def by_sad(v: np.ndarray, k: np.ndarray) -> np.ndarray:
        d = own[k] - whole_blocks(before, of[k], y[k] + (v[:, 0] >> 3), x[k] + (v[:, 1] >> 3), size)
        return np.where((np.abs(v) <= 8 * reach).all(1), np.abs(d).sum((1, 2)) + vector_cost(v, weight), FAR)

    def by_satd(v: np.ndarray, k: np.ndarray) -> np.ndarray:
        return satd(own[k] - predicted(before, of[k], y[k], x[k], v, size)) + vector_cost(v, weight)

    every = np.arange(len(of))
    best = np.zeros((len(of), 2), np.int64)
    cost = by_sad(best, every)

    def tried(v: np.ndarray, price: np.ndarray, k: np.ndarray) -> None:
        less = price < cost[k]
        best[k[less]], cost[k[less]] = v[less], price[less]

    tried(starts[of], by_sad(starts[of], every), every)
    step = np.full(len(of), 8 << max(0, reach.bit_length() - 1))
    while len(k := np.flatnonzero(step >= 8)):
        around = best[k][:, None] + np.array(AROUND) * step[k][:, None, None]
        prices = by_sad(around.reshape(-1, 2), np.repeat(k, 8)).reshape(-1, 8)
        first = prices.argmin(1)
        better = prices[np.arange(len(k)), first] < cost[k]
        step[k[~better]] >>= 1
        tried(around[np.arange(len(k)), first], prices[np.arange(len(k)), first], k)
    seed = best.copy()
    for dy in range(-dense, dense + 1):
        for dx in range(-dense, dense + 1):
            tried(v := seed + (8 * dy, 8 * dx), by_sad(v, every), every)
    cost = by_satd(best, every)
    for step_ in (4, 2):
        seed = best.copy()
        for turn in CROSS:
            tried(v := seed + np.array(turn) * step_, by_satd(v, every), every)
    return {"of": of, "y": y, "x": x, "mv_row": best[:, 0], "mv_col": best[:, 1], "cost": cost}


def search(rows: DataFrame, height: int, width: int, size: int = 8, reach: int = 8, dense: int = 2, weight: int = 4, levels: int = 3, stream: str = "stream") -> DataFrame:
    """(stream, frame, y, x, mv_row, mv_col, cost) for each whole block of each frame of pairs(), from its global motion on."""

    def work(samples: np.ndarray, before: np.ndarray) -> dict[str, np.ndarray]:
        return searched(samples, before, 8 * translation(samples, before, levels, reach), size, reach, dense, weight)

    return batched(rows, height, width, work, f"{stream} long, frame long, y int, x int, mv_row int, mv_col int, cost long", (stream, "frame"))


def compensated(rows: DataFrame, height: int, width: int, vectors: Callable[..., np.ndarray], size: int = 8, stream: str = "stream") -> DataFrame:
    """(stream, frame, y, x, predicted) for each sample of pairs(): what the frame before says of it.

    vectors: from the blocks' (y, x) to their (row, col).
    """

    def work(samples: np.ndarray, before: np.ndarray) -> dict[str, np.ndarray]:
        of, y, x = grid(len(before), height, width, size)
        found = predicted(before, of, y, x, vectors(y, x), size)
        inside = np.arange(size)
        full = lambda v: np.broadcast_to(v, found.shape).ravel()
        return {"of": full(of[:, None, None]), "y": full(y[:, None, None] + inside[:, None]), "x": full(x[:, None, None] + inside), "predicted": found.ravel()}

    return batched(rows, height, width, work, f"{stream} long, frame long, y int, x int, predicted int", (stream, "frame"))


# global motion


def halved(planes: np.ndarray) -> np.ndarray:
    """Means of 2x2 samples; at an odd edge, of those that there are."""
    n, height, width = planes.shape
    even = np.pad(planes, ((0, 0), (0, height % 2), (0, width % 2)))
    count = np.pad(np.ones((height, width)), ((0, height % 2), (0, width % 2)))
    sums = lambda a: a.reshape(*a.shape[:-2], (height + 1) // 2, 2, (width + 1) // 2, 2).sum((-3, -1))
    return sums(even) / sums(count)


def pyramid(planes: np.ndarray, levels: int) -> list[np.ndarray]:
    """The planes and their halvings, the finest first, no further than to one row or column."""
    out = [planes.astype(np.float64)]
    while len(out) < levels and min(out[-1].shape[1:]) > 1:
        out.append(halved(out[-1]))
    return out


def level_cost(samples: np.ndarray, before: np.ndarray, shift: np.ndarray, most: int = 64) -> np.ndarray:
    """Mean absolute difference under each plane's shift (rows, cols), in millionths, where half of either side overlaps.

    Of larger planes about `most` rows and columns are looked at: this only seeds the block search, which sees all.
    """
    _, height, width = samples.shape
    step = -(-max(height, width) // most)
    ys, xs = np.arange(0, height), np.arange(0, width)
    dy, dx = shift[:, 0, None], shift[:, 1, None]
    low_y, low_x = np.maximum(-dy, 0), np.maximum(-dx, 0)
    in_y = (ys >= low_y) & (ys < np.minimum(height - dy, height)) & ((ys - low_y) % step == 0)
    in_x = (xs >= low_x) & (xs < np.minimum(width - dx, width)) & ((xs - low_x) % step == 0)
    there = before[np.arange(len(before))[:, None, None], np.clip(ys + dy, 0, height - 1)[:, :, None], np.clip(xs + dx, 0, width - 1)[:, None, :]]
    both = in_y[:, :, None] & in_x[:, None, :]
    total, count = (np.abs(samples - there) * both).sum((1, 2)), both.sum((1, 2))
    enough = (np.minimum(height - dy, height) - low_y >= height // 2) & (np.minimum(width - dx, width) - low_x >= width // 2)
    return np.where(enough[:, 0] & (count > 0), np.floor(total * 1e6 / np.maximum(count, 1)), FAR).astype(np.int64)


def translation(samples: np.ndarray, before: np.ndarray, levels: int, reach: int, dense: int = 8) -> np.ndarray:
    """(n, 2) whole shifts (rows, cols) of planes: each level starts from twice the shift of the coarser one.

    At each level steps of halving length go on while they improve; the finest level also tries every shift within
    `dense` of the result and of no motion. Of equals the first tried is kept.
    """
    ours, theirs = pyramid(samples, levels), pyramid(before, levels)
    best = np.zeros((len(samples), 2), np.int64)
    for level in range(len(ours) - 1, -1, -1):
        most = max(1, reach >> level)
        last = level == len(ours) - 1
        best = np.clip(best if last else 2 * best, -most, most)
        cost = level_cost(ours[level], theirs[level], best)

        def tried(v: np.ndarray, k: np.ndarray) -> np.ndarray:
            v = np.clip(v, -most, most)  # noqa: B023
            price = level_cost(ours[level][k], theirs[level][k], v)  # noqa: B023
            less = price < cost[k]  # noqa: B023
            best[k[less]], cost[k[less]] = v[less], price[less]  # noqa: B023
            return less

        step = np.full(len(best), 1 << (most.bit_length() - 1) if last else min(2, most))
        while len(k := np.flatnonzero(step >= 1)):
            better = np.zeros(len(k), bool)
            for turn in [(0, -1), (0, 1), (-1, 0), (1, 0), (-1, -1), (-1, 1), (1, -1), (1, 1)]:  # columns first
                better |= tried(best[k] + np.array(turn) * step[k][:, None], k)
            step[k[~better]] //= 2
        if level == 0:
            every = np.arange(len(best))
            for seed in (best.copy(), np.zeros_like(best)):
                for dy in range(-dense, dense + 1):
                    for dx in range(-dense, dense + 1):
                        tried(seed + (dy, dx), every)
    return best


def global_motion(rows: DataFrame, height: int, width: int, reach: int = 8, levels: int = 3, stream: str = "stream") -> DataFrame:
    """(stream, frame, dy, dx): the whole shift of each frame of pairs() against the one before."""

    def work(samples: np.ndarray, before: np.ndarray) -> dict[str, np.ndarray]:
        best = translation(samples, before, levels, reach)
        return {"of": np.arange(len(best)), "dy": best[:, 0], "dx": best[:, 1]}

    return batched(rows, height, width, work, f"{stream} long, frame long, dy int, dx int", (stream, "frame"))


def best_shift(rows: DataFrame, height: int, width: int, reach: int, stream: str = "stream") -> DataFrame:
    """(stream, frame, dy, dx, cost): the shift of least mean absolute difference (in millionths) of all within reach."""

    def work(samples: np.ndarray, before: np.ndarray) -> dict[str, np.ndarray]:
        shifts = [(dy, dx) for dy in range(-reach, reach + 1) for dx in range(-reach, reach + 1)]
        costs = np.stack([level_cost(samples, before, np.tile(s, (len(samples), 1))) for s in shifts], 1)
        best = np.array(shifts)[costs.argmin(1)]
        return {"of": np.arange(len(best)), "dy": best[:, 0], "dx": best[:, 1], "cost": costs.min(1)}

    return batched(rows, height, width, work, f"{stream} long, frame long, dy int, dx int, cost long", (stream, "frame"))

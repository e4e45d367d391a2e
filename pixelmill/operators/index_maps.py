"""Palette index maps smoothed by what they cost to code: a Viterbi search along each row of a block.

An index costs by how its neighbours (left, above, and between them) rank it. With the rows above settled, a row is a
chain whose state is the index to the left, so the best row is found exactly: squared error of the samples plus weighted
price of the indices, all in whole numbers, ties to the lower index. Blocks are worked on in Arrow batches, all of a
batch at once; the first index of a block costs nothing beside its error.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Colours at most, and what an error counts against a price of a sixteenth of a bit at weight 1.
MOST, ERROR = 8, 16
#: Prices in sixteenths of a bit of the place that an index has among its neighbours' (rows: how sure those are).
PRICES = ((16, 32, 48, 56, 64, 64, 64, 64), (20, 26, 34, 60, 68, 76, 76, 76), (12, 28, 52, 60, 68, 76, 76, 76), (8, 36, 56, 64, 72, 80, 80, 80), (3, 44, 60, 68, 76, 84, 84, 84))
#: Which row of prices serves which scores of the neighbours' colours, the highest first.
CONTEXTS = {(2,): 0, (2, 2, 1): 1, (3, 2): 2, (4, 1): 3, (5,): 4}


def place(index: int, neighbours: list[tuple[int, int]]) -> tuple[int, int]:
    """(context, rank) of an index by neighbours (colour, score): colours rank by score, then number, all others behind."""
    scores: dict[int, int] = {}
    for colour, score in neighbours:
        scores[colour] = scores.get(colour, 0) + score
    ranked = sorted(scores, key=lambda c: (-scores[c], c))
    rest = [c for c in range(MOST) if c not in scores]
    return CONTEXTS[tuple(scores[c] for c in ranked)], (ranked + rest).index(index)


def price_tables(prices: tuple, weight: int) -> tuple[np.ndarray, np.ndarray]:
    """Prices by (above, between, left, index) inside a block, and by (neighbour, index) at its first row or column."""
    inside, edge = np.zeros((MOST,) * 4, np.int64), np.zeros((MOST, MOST), np.int64)
    for above, between, left, index in product(range(MOST), repeat=4):
        context, rank = place(index, [(left, 2), (above, 2), (between, 1)])
        inside[above, between, left, index] = weight * prices[context][rank]
    for beside, index in product(range(MOST), repeat=2):
        context, rank = place(index, [(beside, 2)])
        edge[beside, index] = weight * prices[context][rank]
    return inside, edge


def smoothed(errors: np.ndarray, inside: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """Maps (n, height, width) of the errors (n, height, width, MOST) of every index at every sample."""
    n, height, width, _ = errors.shape
    out, every = np.zeros((n, height, width), np.int64), np.arange(n)
    for y in range(height):
        came = np.zeros((width, n, MOST), np.int64)
        cost = errors[:, y, 0] + (edge[out[:, y - 1, 0]] if y else 0)
        for x in range(1, width):
            step = inside[out[:, y - 1, x], out[:, y - 1, x - 1]] if y else edge[None]
            total = cost[:, :, None] + step
            came[x] = total.argmin(1)
            cost = total.min(1) + errors[:, y, x]
        now = cost.argmin(1)
        for x in range(width - 1, -1, -1):
            out[:, y, x] = now
            now = came[x, every, now]
    return out


def smooth_maps(blocks: DataFrame, width: int, weight: int = 4, prices: tuple = PRICES, key: str = "vec_id") -> DataFrame:
    """(key, indices) of (key, block, centres): the smoothed map of each block, row by row.

    block: samples row by row; centres: 1 to MOST numbers. Rows with a null, no or too many centres, or a last row of
    samples that isn't whole, have none.
    """
    inside, edge = price_tables(prices, weight)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = np.array(b["size"])
            for size in np.unique(sizes):  # blocks of one size at a time
                part = b.filter(pa.array(sizes == size))
                for at in range(0, part.num_rows, 256):
                    some = part.slice(at, 256)
                    samples = some["block"].flatten().to_numpy(zero_copy_only=False).reshape(some.num_rows, -1, width).astype(np.int64)
                    centres = np.array([c + [0] * (MOST - len(c)) for c in some["centres"].to_pylist()], np.int64)
                    count = np.array([len(c) for c in some["centres"].to_pylist()])
                    errors = ERROR * (samples[..., None] - centres[:, None, None, :]) ** 2
                    errors = np.where(np.arange(MOST) < count[:, None, None, None], errors, np.int64(1) << 50)
                    maps = smoothed(errors, inside, edge).reshape(some.num_rows, -1)
                    yield pa.RecordBatch.from_arrays([some[key], pa.array(list(maps.astype(np.int32)), pa.list_(pa.int32()))], [key, "indices"])

    whole = (F.size("block") > 0) & (F.size("block") % width == 0) & F.size("centres").between(1, MOST) & ~F.exists("block", F.isnull) & ~F.exists("centres", F.isnull)
    rows = blocks.where(whole).select(key, F.col("block").cast("array<int>").alias("block"), F.col("centres").cast("array<long>").alias("centres"), F.size("block").alias("size"))
    return rows.mapInArrow(run, f"{key} long, indices array<int>")

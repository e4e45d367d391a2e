"""Whether an image is screen content: few colours, and copies that save more than the lost smoothing of its photo-like parts costs.

Two levels. First, over all images, narrow: shares of 16x16 blocks of few colours and of repeated 8x8 blocks. Only
images that pass a threshold in one of them get the second: exact copies of 8x8 blocks (operators.causal_copies, by
order and without pairs) propose displacements of whole 16x16 blocks; a block gains the energy of its gradients less
what the copy leaves and less the price of the displacement. Gains have to outweigh a loss that grows with the
quantizer's step for each photo-like 8x8 block (neither copied, nor of few colours, nor a fragment of text).

A block's displacements are those of the latest legal copies of its four quarters. Whole blocks only; images below
16x16, with nulls, or of a wrong number of samples have no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelmill.operators import causal_copies

#: Colours of a block of few, of one that may be screen content, and of a text fragment; the span that all need, at 8 bits.
FEW, LENIENT, TEXT, SPAN = 8, 16, 12, 64
#: Shares that pass, the loss of a photo-like block by step, the price of a displacement by step squared, and copies at least.
PRESCREEN, FEW_SHARE, LOSS, PRICE, COPIES = 0.02, 0.10, 32.0, 1.0, 4


def cut(plane: np.ndarray, size: int) -> np.ndarray:
    """(rows, columns, size * size) of whole blocks."""
    rows, cols = plane.shape[0] // size, plane.shape[1] // size
    return plane.reshape(rows, size, cols, size).swapaxes(1, 2).reshape(rows, cols, -1)


def colours(blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of values, and their spans."""
    ordered = np.sort(blocks, axis=-1)
    return 1 + (np.diff(ordered, axis=-1) > 0).sum(-1), ordered[..., -1] - ordered[..., 0]


def energy(eighths: np.ndarray) -> np.ndarray:
    """Squared differences of neighbours inside 8x8 blocks."""
    v = eighths.reshape(*eighths.shape[:2], 8, 8)
    return (np.diff(v, axis=3) ** 2).sum((2, 3)) + (np.diff(v, axis=2) ** 2).sum((2, 3))


def shares(plane: np.ndarray) -> tuple[int, int, int, int]:
    """16x16 blocks, those of few colours, those that may be screen content, and repeats among the 8x8 blocks that aren't flat."""
    n, span = colours(cut(plane, 16))
    eighths = cut(plane, 8)
    uneven = eighths[energy(eighths) > 0]
    return n.size, int(((n <= FEW) & (span >= SPAN)).sum()), int(((n <= LENIENT) & (span >= SPAN)).sum()), len(uneven) - len(np.unique(uneven, axis=0))


def balance(plane: np.ndarray, copies: np.ndarray, price: int) -> tuple[int, int, int]:
    """(gain, photo-like 8x8 blocks, copied 16x16 blocks); copies: rows (y, x, ref_y, ref_x) of 8x8 blocks."""
    eighths, (n, span) = cut(plane, 8), colours(cut(plane, 16))
    each = energy(eighths)
    mass = cut(each, 2).sum(-1)
    left = np.full(mass.shape, np.iinfo(np.int64).max)
    height, width = (16 * k for k in mass.shape)
    for y, x, ref_y, ref_x in copies[(copies[:, 0] < height) & (copies[:, 1] < width)]:
        py, px = y // 16 * 16, x // 16 * 16
        ry, rx = py + ref_y - y, px + ref_x - x
        apart = abs(ry - py) >= 16 or abs(rx - px) >= 16
        if apart and 0 <= ry <= height - 16 and 0 <= rx <= width - 16:
            d = plane[py : py + 16, px : px + 16] - plane[ry : ry + 16, rx : rx + 16]
            left[py // 16, px // 16] = min(left[py // 16, px // 16], int((d * d).sum()))
    gain = np.where(left == np.iinfo(np.int64).max, 0, np.maximum(mass - np.minimum(left, mass) - price, 0))
    n8, span8 = colours(eighths)
    photo = (each > 0) & ~((n8 <= TEXT) & (span8 >= SPAN))
    plain = (gain == 0) & ~((n <= FEW) & (span >= SPAN))
    return int(gain.sum()), int((photo & plain.repeat(2, 0).repeat(2, 1)).sum()), int((gain > 0).sum())


def _planes(b: pa.RecordBatch) -> Iterator[np.ndarray]:
    for k in range(b.num_rows):
        height, width = b["height"][k].as_py(), b["width"][k].as_py()
        plane = b["samples"].slice(k, 1).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(height, width)
        yield plane[: height // 16 * 16, : width // 16 * 16]


def gate(images: DataFrame, step: int, filtered: bool = True, superblock: int = 64, key: str = "image") -> DataFrame:
    """(key, few_colours, copies_pay, few_share, gain, loss) of 8-bit (key, height, width, samples), keys being unique.

    step: the quantizer's; filtered: whether blocks are smoothed at all. gain and loss are null where the first level fails.
    """
    price = int(PRICE * step * step)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = list(zip(*map(shares, _planes(b)), strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([b[key], b["height"], b["width"], b["samples"], *[pa.array(x, pa.int64()) for x in found]], [key, "height", "width", "samples", "blocks", "few", "lenient", "repeats"])

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [balance(plane, np.array([list(c.values()) for c in copies or []], np.int64).reshape(-1, 4), price) for plane, copies in zip(_planes(b), b["copies"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b[key], *[pa.array([f[i] for f in found], pa.int64()) for i in range(3)]], [key, "gain", "photo", "copied"])

    whole = (F.least("height", "width") >= 16) & (F.size("samples") == F.col("height") * F.col("width")) & ~F.exists("samples", F.isnull) & F.col(key).isNotNull()
    rows = images.where(whole).select(F.col(key).cast("long").alias(key), F.col("height").cast("int").alias("height"), F.col("width").cast("int").alias("width"), F.col("samples").cast("array<int>").alias("samples"))
    known = rows.mapInArrow(first, f"{key} long, height int, width int, samples array<int>, blocks long, few long, lenient long, repeats long")
    passed = known.where((F.col("lenient") / F.col("blocks") >= PRESCREEN) | (F.col("repeats") / (F.col("blocks") * 4) >= PRESCREEN)).select(key, "height", "width", "samples")
    copies = causal_copies.latest(passed, 8, superblock, key=key).groupBy(key).agg(F.collect_list(F.struct("y", "x", "ref_y", "ref_x")).alias("copies"))
    weighed = passed.join(copies, key, "left").mapInArrow(second, f"{key} long, gain long, photo long, copied long")
    loss = F.when(F.lit(filtered), F.col("photo") * LOSS * step).otherwise(0.0)
    weighed = weighed.select(key, "gain", F.when(F.col("gain").isNotNull(), loss).alias("loss"), "copied")
    share = F.col("few") / F.col("blocks")
    pays = F.coalesce((F.col("copied") >= COPIES) & (F.col("gain") > F.col("loss")), F.lit(False))
    return known.select(key, "few", "blocks").join(weighed, key, "left").select(key, (share >= FEW_SHARE).alias("few_colours"), pays.alias("copies_pay"), share.alias("few_share"), "gain", "loss")

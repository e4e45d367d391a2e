"""Exact copies of blocks in the part of an image that is coded before them.

Images are coded in superblocks, row by row, each row running ahead of the next: a copy is legal if it ends in an
earlier row of superblocks and no more than `lead` superblocks further right for each row in between, or in the same
row in a superblock further left. Copies may start at any sample. Of the legal ones the latest is taken: in the lowest
row of superblocks, then the rightmost superblock, then by its y and x.

Windows whose hash no block of the image has are dropped where the image lies; those that are left are grouped by their
samples, so a hash never decides. Inside a group a copy is looked up by order (an as-of search: a running maximum over
places and limits), so a group of any size is sorted, and no pairs are made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Multipliers of the rolling sums across and down; any odd numbers serve.
ACROSS, DOWN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def window_hashes(plane: np.ndarray, size: int) -> np.ndarray:
    """A hash for every window of a plane, by its top left sample (sums of products, which wrap)."""
    height, width = plane.shape
    lines = np.zeros((height, width - size + 1), np.uint64)
    for k in range(size):
        lines = lines * ACROSS + plane[:, k : width - size + 1 + k].astype(np.uint64) + np.uint64(1)
    out = np.zeros((height - size + 1, lines.shape[1]), np.uint64)
    for k in range(size):
        out = out * DOWN + lines[k : height - size + 1 + k]
    return out


def windows(images: DataFrame, size: int, key: str = "image") -> DataFrame:
    """(key, y, x, samples, block) of (key, height, width, samples): windows that may equal a block, and the blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                height, width = b["height"][k].as_py(), b["width"][k].as_py()
                if min(height, width) < size:
                    continue
                plane = b["samples"].slice(k, 1).flatten().to_numpy(zero_copy_only=False).astype("<u2").reshape(height, width)
                hashes = window_hashes(plane, size)
                y, x = np.nonzero(np.isin(hashes, np.unique(hashes[::size, ::size])))
                every = np.lib.stride_tricks.sliding_window_view(plane, (size, size))
                for at in range(0, len(y), 4096):
                    ys, xs = y[at : at + 4096], x[at : at + 4096]
                    held = np.ascontiguousarray(every[ys, xs])
                    yield pa.RecordBatch.from_arrays(
                        [b[key].slice(k, 1).take(pa.array(np.zeros(len(ys), np.int64))), pa.array(ys, pa.int32()), pa.array(xs, pa.int32()), pa.array([w.tobytes() for w in held], pa.binary()), pa.array((ys % size == 0) & (xs % size == 0))],
                        [key, "y", "x", "samples", "block"],
                    )

    whole = (F.size("samples") == F.col("height") * F.col("width")) & ~F.exists("samples", F.isnull)
    return images.where(whole).select(key, "height", "width", "samples").mapInArrow(run, f"{key} long, y int, x int, samples binary, block boolean")


def latest(images: DataFrame, size: int = 8, superblock: int = 64, lead: int = 2, key: str = "image") -> DataFrame:
    """(key, y, x, ref_y, ref_x) for each whole block that has a legal copy; superblock is a multiple of size.

    images: (key, height, width, samples), samples row by row, of 16 bits at most. Images with a null or a wrong number
    of samples have no rows, nor have blocks that no earlier window equals.
    """
    found = windows(images, size, key)
    row, col = F.expr(f"(y + {size - 1}) div {superblock}").cast("int"), F.expr(f"(x + {size - 1}) div {superblock}").cast("int")
    places = found.groupBy(key, "samples", row.alias("row"), col.alias("at")).agg(F.max(F.struct("y", "x")).alias("last"))
    places = places.select(key, "samples", "row", "at", F.struct(F.col("at"), F.col("last.y").alias("y"), F.col("last.x").alias("x")).alias("place"), F.lit(None).cast("struct<y:int,x:int>").alias("asks"))
    own = found.where("block").withColumn("own_row", row).withColumn("row", F.explode(F.sequence(F.lit(0), F.col("own_row"))))
    limit = F.when(F.col("row") == F.col("own_row"), col - 1).otherwise(col + lead * (F.col("own_row") - F.col("row")))
    asks = own.select(key, "samples", "row", limit.alias("at"), F.lit(None).cast("struct<at:int,y:int,x:int>").alias("place"), F.struct("y", "x").alias("asks"))
    upto = W.partitionBy(key, "samples", "row").orderBy("at", F.col("asks").isNotNull()).rowsBetween(W.unboundedPreceding, 0)
    told = places.unionByName(asks).withColumn("best", F.max("place").over(upto)).where("asks is not null and best is not null")
    best = told.groupBy(key, "asks").agg(F.max(F.struct("row", "best")).alias("found"))
    return best.select(key, "asks.y", "asks.x", F.col("found.best.y").alias("ref_y"), F.col("found.best.x").alias("ref_x"))

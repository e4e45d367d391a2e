"""Sampling and geometry: chroma subsampling, orientation, padding, tiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelmill.functions import color


def subsampled(samples: DataFrame, width: int, height: int, vertical: bool) -> DataFrame:
    """(image_id, r, c, cb, cr) of (image_id, y, x, r, g, b): averages of 2 (or 2x2) neighbours, edges replicated.

    Each sample is sent to the one block it lies in; at an odd edge it counts twice, as its replica would.
    """
    cb, cr = color.chroma_sums(F.col("r"), F.col("g"), F.col("b"))
    times = F.when((F.col("x") == width - 1) & F.lit(width % 2 == 1), 2).otherwise(1)
    if vertical:
        times = times * F.when((F.col("y") == height - 1) & F.lit(height % 2 == 1), 2).otherwise(1)
    row = F.expr("y div 2") if vertical else F.col("y")
    sums = samples.select("image_id", row.cast("int").alias("r_"), F.expr("cast(x div 2 as int)").alias("c"), (cb * times).alias("cb"), (cr * times).alias("cr")).groupBy("image_id", "r_", "c").agg(F.sum("cb").alias("cb"), F.sum("cr").alias("cr"))
    bits = color.BITS + (2 if vertical else 1)
    done = lambda c: color.clamp(F.shiftright(F.col(c) + (1 << (bits - 1)), bits), 0, 255).cast("int")
    return sums.select("image_id", F.col("r_").alias("r"), "c", done("cb").alias("cb"), done("cr").alias("cr"))


#: By EXIF orientation: whether the axes swap, then whether the shown x and y run backward.
ORIENTATIONS = {1: (0, 0, 0), 2: (0, 1, 0), 3: (0, 1, 1), 4: (0, 0, 1), 5: (1, 0, 0), 6: (1, 1, 0), 7: (1, 1, 1), 8: (1, 0, 1)}


def oriented(samples: DataFrame, width: int, height: int) -> DataFrame:
    """Samples (y, x, orientation, ...) of width x height images where they are shown; swapped images are height wide."""
    x, y = F.lit(None).cast("int"), F.lit(None).cast("int")
    for k, (swap, back_x, back_y) in ORIENTATIONS.items():
        across, down, w, h = (F.col("y"), F.col("x"), height, width) if swap else (F.col("x"), F.col("y"), width, height)
        x = F.when(F.col("orientation") == k, F.lit(w - 1) - across if back_x else across).otherwise(x)
        y = F.when(F.col("orientation") == k, F.lit(h - 1) - down if back_y else down).otherwise(y)
    return samples.withColumn("shown_y", y).withColumn("shown_x", x)


def tiles(sizes: DataFrame, log2: int = 2) -> DataFrame:
    """(image_id, tile, start): starts, in superblocks, of up to 2^log2 tiles of sizes (image_id, superblocks)."""
    step = F.ceil(F.col("superblocks") / (1 << log2))
    starts = F.sequence(F.lit(0).cast("long"), F.col("superblocks") - 1, step)
    return sizes.select("image_id", F.posexplode(starts).alias("tile", "start"))


def padded(samples: DataFrame, width: int, height: int, multiple: int = 8) -> DataFrame:
    """(image_id, y, x, v) of images grown to multiples by their last column and row; each sample is sent where it shows."""
    wide, high = (-(-n // multiple) * multiple for n in (width, height))
    reach = lambda at, last, end: F.sequence(at, F.when(at == last, end - 1).otherwise(at))
    rows = samples.select("image_id", F.explode(reach(F.col("y"), height - 1, high)).alias("y"), "x", "v")
    return rows.select("image_id", "y", F.explode(reach(F.col("x"), width - 1, wide)).alias("x"), "v")

"""Quantizers of superblocks: targets by contrast and dark structure, and the signalled steps that follow them in raster order.

Statistics of an image's superblocks come from an Arrow batch, narrow: images are rows and nothing is shuffled. Targets
and the running quantizer are column expressions; the fold runs over one image's superblocks, so images go side by side.

Only superblocks that lie wholly inside the image signal a step, unless the plane is padded (`padded`); the others take
over the running quantizer. A step is the rounded distance to the target in units of four (halves away from zero), of at
most six units. The anchor above which contrast is coarsened is 0.95 of the mean of log(1 + variance) over all
superblocks of the image.

Defined results: images with nulls, without a size, or with a number of samples other than height * width have no row.
Sub-blocks outside the image count as the mean of those inside it. Repeated rows come back repeated.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelmill.functions import laws
from pixelmill.operators import statistics

#: The side of a superblock and of its sub-blocks, the unit of a signalled step and the most units of one.
SIDE, SUB, UNIT, MOST = 64, 8, 4, 6
#: The share of the mean activity that anchors the coarser side, and the quantizer from which dark structure is protected.
ANCHOR, DARK_FROM = 0.95, 150

CELLS = "array<struct<row:int,col:int,whole:boolean,picked:double,activity:double,mean:double,energy:double>>"
CELL_TYPE = pa.list_(pa.struct([("row", pa.int32()), ("col", pa.int32()), ("whole", pa.bool_()), ("picked", pa.float64()), ("activity", pa.float64()), ("mean", pa.float64()), ("energy", pa.float64())]))


def variance(part: np.ndarray) -> float:
    n, s, ss = part.size, float(part.sum()), float((part * part).sum())
    return max(0.0, ss / n - (s / n) * (s / n))


def laplacian(part: np.ndarray) -> float:
    """Mean absolute four-neighbour Laplacian over the inside; 0 without one."""
    if min(part.shape) < 3:
        return 0.0
    inner = 4 * part[1:-1, 1:-1] - part[:-2, 1:-1] - part[2:, 1:-1] - part[1:-1, :-2] - part[1:-1, 2:]
    return float(np.abs(inner).mean())


def cell(plane: np.ndarray, row: int, col: int, octile: int) -> dict:
    part = plane[row * SIDE : (row + 1) * SIDE, col * SIDE : (col + 1) * SIDE]
    h, w = part.shape
    inside = [variance(part[y : y + SUB, x : x + SUB]) for y in range(0, h, SUB) for x in range(0, w, SUB)]
    every = sorted(inside + [sum(inside) / len(inside)] * ((SIDE // SUB) ** 2 - len(inside)))
    half = part[: h // 2 * 2, : w // 2 * 2].reshape(h // 2, 2, w // 2, 2).mean((1, 3))
    energy = float(np.sqrt(laplacian(part) * laplacian(half)))
    return {"row": row, "col": col, "whole": part.shape == (SIDE, SIDE), "picked": every[SUB * octile - 1], "activity": float(np.log1p(variance(part))), "mean": float(part.mean()), "energy": energy}


def measured(images: DataFrame, octile: int = 6) -> DataFrame:
    """(image, cells) of images (image, height, width, samples): the superblocks' statistics in raster order; octile from 1 to 8."""
    if not 1 <= octile <= 8:
        raise ValueError("octile has to lie between 1 and 8")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            planes = b["samples"]
            found = []
            for i, (h, w) in enumerate(zip(b["height"].to_pylist(), b["width"].to_pylist(), strict=True)):
                plane = planes[i].values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(h, w)
                found.append([cell(plane, r, c, octile) for r in range(-(-h // SIDE)) for c in range(-(-w // SIDE))])
            yield pa.RecordBatch.from_arrays([b["image"], pa.array(found, CELL_TYPE)], ["image", "cells"])

    fit = (F.col("height") > 0) & (F.col("width") > 0) & (F.size("samples") == F.col("height") * F.col("width")) & ~F.exists("samples", F.isnull)
    rows = images.where(fit).select("image", "height", "width", "samples")
    return rows.mapInArrow(measure, f"image {rows.schema['image'].dataType.simpleString()}, cells {CELLS}")


def target(c: Column, anchor: Column, base: int, strength: float, boost_only: bool, dark: bool) -> Column:
    """A superblock's quantizer: the larger protection, of flat or of dark parts, else coarser where contrast is high."""
    delta = statistics.boost_offset(c["picked"], anchor, strength)
    if boost_only:
        delta = F.least(delta, F.lit(0))
    protection = F.greatest(-delta, F.lit(0))
    if dark and base >= DARK_FROM:
        protection = F.greatest(protection, statistics.dark_offset(c["mean"], c["energy"]))
    delta = F.when(protection > 0, -protection).otherwise(delta)
    return F.greatest(F.lit(1), F.least(F.lit(255), delta + base))


def grid(images: DataFrame, base: int, uv: int = 0, octile: int = 6, strength: float = 1.0, boost_only: bool = False, dark: bool = False, padded: bool = False) -> DataFrame:
    """(image, row, col, target, signal, q, step, scale, chroma_step, chroma_scale) for each superblock of images (image, height, width, samples).

    signal counts units against the quantizer before; q is what the superblock is coded at, step its quantizer step,
    scale the base's step over it. Chroma's quantizer lies uv away from q, inside 1 to 255.
    """
    cells = measured(images, octile)
    mean = F.aggregate("cells", F.lit(0.0), lambda a, c: a + c["activity"]) / F.size("cells")
    rows = cells.withColumn("anchor", mean * ANCHOR)
    want = lambda c: F.struct(c["row"].alias("row"), c["col"].alias("col"), (c["whole"] | F.lit(padded)).alias("signals"), target(c, F.col("anchor"), base, strength, boost_only, dark).alias("target"))
    rows = rows.select("image", F.transform("cells", want).alias("cells"))

    def follow(done: Column, c: Column) -> Column:
        before = F.coalesce(F.get(done, F.size(done) - 1)["q"], F.lit(base))
        away = c["target"] - before
        units = F.least(F.lit(MOST), F.floor((F.abs(away) + UNIT // 2) / UNIT).cast("int"))
        signal = F.when(c["signals"], F.signum(away).cast("int") * units).otherwise(0)
        q = F.greatest(F.lit(1), F.least(F.lit(255), before + signal * UNIT))
        return F.concat(done, F.array(F.struct(c["row"].alias("row"), c["col"].alias("col"), c["target"].alias("target"), signal.alias("signal"), q.alias("q"))))

    none = F.array().cast("array<struct<row:int,col:int,target:int,signal:int,q:int>>")
    each = rows.select("image", F.explode(F.aggregate("cells", none, follow)).alias("c")).select("image", "c.*")
    step, chroma = laws.wide_step(F.col("q")), laws.wide_step(F.greatest(F.lit(1), F.least(F.lit(255), F.col("q") + uv)))
    out = each.withColumn("step", step).withColumn("chroma_step", chroma)
    at_base = laws.wide_step(F.lit(base))
    return out.withColumn("scale", at_base / F.col("step")).withColumn("chroma_scale", at_base / F.col("chroma_step"))

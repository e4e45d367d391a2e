"""Images as arrays of samples: interleaved channels to planes and back, plain planes, and checks of what comes in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Planes are kept in this order whatever the interleaving; alpha is the fourth.
PLANES = ("g", "b", "r", "a")
#: Largest and smallest width and height that are taken (fixed values).
LEAST_SIDE, MOST_SIDE = 1, 16383
#: Chroma samples by format: whether width and height are halved, rounded up; None: no chroma.
SUBSAMPLING = {"444": (False, False), "422": (True, False), "420": (True, True), "400": None}


def plane(samples: Column, channels: int, channel: int) -> Column:
    """Every channels-th sample from a channel on."""
    return F.transform(F.sequence(F.lit(0), F.floor(F.size(samples) / channels).cast("int") - 1), lambda i: F.get(samples, i * channels + channel))


def deinterleaved(images: DataFrame, samples: str, order: str) -> DataFrame:
    """The rows with a column for each plane; order names the channels as they are interleaved, as in "rgba" or "ga"."""
    return images.select("*", *[plane(F.col(samples), len(order), order.index(p)).alias(p) for p in PLANES if p in order])


def interleaved(images: DataFrame, name: str = "rgb") -> DataFrame:
    """The rows with `rgb`, r, g and b of each pixel in turn; alpha is dropped."""
    return images.withColumn(name, F.flatten(F.transform(F.arrays_zip("r", "g", "b"), lambda p: F.array(p["r"], p["g"], p["b"]))))


def chroma_size(width: Column, height: Column, chroma: str) -> Column:
    """Samples of each chroma plane."""
    if SUBSAMPLING[chroma] is None:
        return F.lit(0)
    w, h = (F.ceil(x / 2) if half else x for x, half in zip((width, height), SUBSAMPLING[chroma], strict=True))
    return w * h


def yuv_planes(images: DataFrame, samples: str, width: int, height: int, chroma: str) -> DataFrame:
    """The rows with y, u and v, which stand one after another in samples."""
    wide, high = SUBSAMPLING[chroma] or (False, False)
    n, m = width * height, 0 if SUBSAMPLING[chroma] is None else (-(-width // 2) if wide else width) * (-(-height // 2) if high else height)
    return images.select("*", F.slice(samples, 1, n).alias("y"), F.slice(samples, n + 1, m).alias("u"), F.slice(samples, n + m + 1, m).alias("v"))


def checked(images: DataFrame, chroma: str) -> DataFrame:
    """The rows of (width, height, quality, luma_samples, chroma_samples) with `error`, null for what can be taken.

    Quality is checked first, then sides, then the length of each plane; bad rows stay, for a quarantine.
    """
    w, h = F.col("width"), F.col("height")
    side = lambda x: x.between(LEAST_SIDE, MOST_SIDE)
    error = F.when(~F.col("quality").between(1, 100), "quality").when(~(side(w) & side(h)), "dimensions").when(F.col("luma_samples") != w.cast("long") * h, "luma").when(F.col("chroma_samples") != chroma_size(w, h, chroma), "chroma")
    return images.withColumn("error", error)

"""Frame streams: motion against the frame before, lookahead, quantizers, key frames, references."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pixelmill.functions import laws


def mean_sad(frames: DataFrame, back: int = 1) -> DataFrame:
    """(frame, sad): mean absolute difference from the frame `back` before, cut off to a whole number; 0 if there is none."""
    before = frames.select((F.col("frame") + back).alias("frame"), F.col("samples").alias("p"))
    d = F.aggregate(F.zip_with("samples", "p", lambda x, y: F.abs(x - y).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    return frames.join(before, "frame", "left").select("frame", F.coalesce(F.floor(d / F.size("samples")), F.lit(0)).alias("sad"))


def activity(frames: DataFrame, width: int = 8) -> DataFrame:
    """(frame, activity): mean absolute difference of neighbours inside a frame of rows of that width."""
    n = F.size("samples")
    right = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(i % width < width - 1, F.abs(F.get("samples", i + 1) - F.get("samples", i)).cast("long")).otherwise(0))
    below = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(i + width < n, F.abs(F.get("samples", i + width) - F.get("samples", i)).cast("long")).otherwise(0))
    total = F.aggregate(F.concat(right, below), F.lit(0).cast("long"), lambda a, x: a + x)
    rows = n / width
    return frames.select("frame", (total / (rows * (width - 1) + (rows - 1) * width)).alias("activity"))


def lookahead(stats: DataFrame, value: str, cap: int, span: int = 4096) -> DataFrame:
    """stats (frame, value) with the mean of up to `cap` frames before, this one excluded; 0 if there is none.

    Frames are cut into spans that each also get the last `cap` frames of the span before, so that a stream is spread
    over tasks; a window over the whole stream would be one task.
    """
    own = stats.withColumn("span", F.floor(F.col("frame") / span)).withColumn("own", F.lit(True))
    lent = stats.where(F.pmod("frame", F.lit(span)) >= span - cap).withColumn("span", F.floor(F.col("frame") / span) + 1).withColumn("own", F.lit(False))
    mean = F.avg(value).over(W.partitionBy("span").orderBy("frame").rowsBetween(-cap, -1))
    return own.unionByName(lent).withColumn("mean", F.coalesce(mean, F.lit(0.0))).where("own").drop("span", "own")


def quantizers(stats: DataFrame, cap: int = 8, nominal: int = 100, most: int = 12) -> DataFrame:
    """(frame, quantizer) of (frame, sad, activity)."""
    t = lookahead(stats.select("frame", "sad"), "sad", cap).withColumnRenamed("mean", "t_mean")
    s = lookahead(stats.select("frame", "activity"), "activity", cap).withColumnRenamed("mean", "s_mean")
    both = t.join(s, "frame")
    return both.select("frame", laws.frame_quantizer(F.col("sad"), F.col("t_mean"), F.col("activity"), F.col("s_mean"), nominal, most).alias("quantizer"))


def key_frames(stats: DataFrame, interval: int, threshold: int, min_gap: int, stream: str = "stream") -> DataFrame:
    """(stream, frame, key) of (stream, frame, sad): decisions depend on earlier ones, so streams are read in order.

    Key: at multiples of the interval (always for 0), or a scene cut of at least the threshold at least min_gap
    frames after the last key. A fixed key also resets the gap, so every interval decides on its own: intervals are
    the groups, and one long stream is many of them.
    """
    span = max(1, interval)

    def decide(pdf: pd.DataFrame) -> pd.DataFrame:
        keys, since = [], 0
        pdf = pdf.sort_values("frame")
        for frame, sad in zip(pdf["frame"], pdf["sad"], strict=True):
            key = frame % span == 0 or (0 < threshold <= sad and since >= min_gap)
            since = 0 if key else since + 1
            keys.append(key)
        return pdf.assign(key=keys)[[stream, "frame", "key"]]

    return stats.withColumn("group", F.floor(F.col("frame") / span)).groupBy(stream, "group").applyInPandas(decide, f"{stream} long, frame long, key boolean")


def references(frames: DataFrame, reach: int = 4, keep: int = 2) -> DataFrame:
    """(frame, place, ref): the `keep` best of the `reach` frames before, by four times the mean SAD, ties to the latest."""
    scores = None
    for back in range(1, reach + 1):
        one = mean_sad(frames, back).where(F.col("frame") >= back).select("frame", (F.col("frame") - back).alias("ref"), (F.col("sad") * 4).alias("score"))
        scores = one if scores is None else scores.unionByName(one)
    place = F.row_number().over(W.partitionBy("frame").orderBy("score", F.desc("ref")))
    return scores.withColumn("place", place).where(F.col("place") <= keep).select("frame", "place", "ref")


def second_preferred(frames: DataFrame, block: int = 16) -> DataFrame:
    """(frame, share): share of blocks of samples that the frame two before predicts clearly better than the last, where that matters."""
    last = frames.select((F.col("frame") + 1).alias("frame"), F.col("samples").alias("p0"))
    older = frames.select((F.col("frame") + 2).alias("frame"), F.col("samples").alias("p1"))
    each = frames.join(last, "frame").join(older, "frame").select("frame", F.posexplode(F.arrays_zip("samples", "p0", "p1")).alias("i", "s"))
    blocks = each.groupBy("frame", F.expr(f"i div {block}").alias("b")).agg(F.sum(F.abs(F.col("s.samples") - F.col("s.p0"))).alias("s0"), F.sum(F.abs(F.col("s.samples") - F.col("s.p1"))).alias("s1"), F.count(F.lit(1)).alias("n"))
    better = (F.col("s1") * 12 < F.col("s0") * 10) & (F.col("s0") > F.col("n") * 2)
    return blocks.groupBy("frame").agg((F.count_if(better) / F.count(F.lit(1))).alias("share"))

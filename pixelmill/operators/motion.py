"""Motion: exhaustive block search in the frame before, and the ring of frames kept for reference."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pixelmill.operators import compensation


def exhaustive(frames: DataFrame, width: int, at: int, size: int, reach: int, weight: int) -> DataFrame:
    """(frame, dy, dx, cost): the displacement of least SAD and motion cost of a block (size high and wide, from (at, at)).

    A frame meets the one before once, a row each, and all displacements that stay inside it are tried in Arrow
    batches. Ties go to the smaller dy, then dx.
    """
    steps = [(dy, dx) for dy in range(-reach, reach + 1) for dx in range(-reach, reach + 1) if min(dy, dx) >= -at and max(dy, dx) + at + size <= width]

    def work(samples: np.ndarray, before: np.ndarray) -> dict[str, np.ndarray]:
        part = lambda planes, dy, dx: planes[:, at + dy : at + dy + size, at + dx : at + dx + size]
        sads = np.stack([np.abs(part(samples, 0, 0) - part(before, *s)).sum((1, 2)) for s in steps], 1)
        costs = sads + compensation.vector_cost(np.array(steps), weight)
        best = np.array(steps)[costs.argmin(1)]
        return {"of": np.arange(len(best)), "dy": best[:, 0], "dx": best[:, 1], "cost": costs.min(1)}

    pairs = compensation.pairs(frames.withColumn("stream", F.lit(0)))
    return compensation.batched(pairs, width, width, work, "frame long, dy int, dx int, cost long", ("frame",))


def slots(frames: DataFrame, ring: int = 3) -> DataFrame:
    """(frame, slot, place, ref, ref_slot) of (frame, gop): what each frame finds in the ring, the latest first.

    A key frame begins a group and takes slot 0, each later one the next slot round the ring, so the frames there are
    the `ring` before it in its group. Groups are independent.
    """
    order = W.partitionBy("gop").orderBy("frame")
    numbered = frames.withColumn("at", F.row_number().over(order) - 1)
    refs = F.explode(F.sequence(F.lit(1), F.lit(ring)))
    each = numbered.withColumn("place", refs).withColumn("was", F.col("at") - F.col("place")).where("was >= 0")
    kept = numbered.select("gop", F.col("at").alias("was"), F.col("frame").alias("ref"))
    return each.join(kept, ["gop", "was"]).select("frame", (F.col("at") % ring).cast("int").alias("slot"), "place", "ref", (F.col("was") % ring).cast("int").alias("ref_slot"))

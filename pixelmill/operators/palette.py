"""Palettes of blocks: histograms, gates, clustering, nearest centres."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def histogram(samples: DataFrame, by: str, value: str) -> DataFrame:
    return samples.groupBy(by, F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def gate(hist: DataFrame, by: str, least: int = 2, most: int = 64) -> DataFrame:
    """(by, colours) of the groups with so many distinct values."""
    return hist.groupBy(by).agg(F.count(F.lit(1)).alias("colours")).where(F.col("colours").between(least, most))


def top_colours(hist: DataFrame, by: str, k: int) -> DataFrame:
    """(by, place, value): the k commonest values, ties to the smaller, in ascending order; none for groups of no more than k values."""
    common = W.partitionBy(by).orderBy(F.desc("n"), "value")
    ranked = hist.withColumn("rank", F.row_number().over(common)).withColumn("colours", F.count(F.lit(1)).over(W.partitionBy(by)))
    kept = ranked.where((F.col("rank") <= k) & (F.col("colours") > k))
    return kept.select(by, (F.row_number().over(W.partitionBy(by).orderBy("value")) - 1).alias("place"), "value")


def nearest(samples: DataFrame, centres: list[int]) -> DataFrame:
    """The samples with the number of the nearest centre, the first of equals. The centres are a short list."""
    distance = lambda i, c: F.struct(((F.col("v") - c) * (F.col("v") - c)).alias("d"), F.lit(i).alias("i"))
    return samples.withColumn("centre", F.least(*[distance(i, c) for i, c in enumerate(centres)])["i"])


def few_colour_share(samples: DataFrame, by: str, size: int = 16, least: int = 2, most: int = 8, flag_at: float = 0.05) -> DataFrame:
    """(by, blocks, share, screen): share of full blocks of samples (by, image_id, y, x, v) with few values."""
    blocks = samples.groupBy(by, "image_id", F.expr(f"y div {size}").alias("by_"), F.expr(f"x div {size}").alias("bx_")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("v").alias("colours")).where(F.col("n") == size * size)
    few = F.count_if(F.col("colours").between(least, most))
    return blocks.groupBy(by).agg(F.count(F.lit(1)).alias("blocks"), (few / F.count(F.lit(1))).alias("share")).withColumn("screen", F.col("share") >= flag_at)


def best_centres(values: np.ndarray, counts: np.ndarray, k: int) -> list[int] | None:
    """Whole-number centres of the split of sorted values into k runs that has the least squared error; ties: shorter first runs.

    None where there are fewer values than centres.
    """
    n = len(values)
    if n <= k:
        return values.tolist() if n == k else None
    w, s, q = (np.concatenate([[0], np.cumsum(counts * values**p)]) for p in (0, 1, 2))

    def run(i: np.ndarray | int, j: int) -> tuple[np.ndarray, np.ndarray]:
        """Centre and error of the values from i up to j."""
        dw, ds, dq = w[j] - w[i], s[j] - s[i], q[j] - q[i]
        c = (ds + dw // 2) // dw
        return c, dq - 2 * c * ds + c * c * dw

    cost = np.array([0] + [int(run(0, j)[1]) for j in range(1, n + 1)], np.int64)
    cuts = []
    for m in range(2, k + 1):
        new, cut = np.full(n + 1, np.iinfo(np.int64).max), np.zeros(n + 1, int)
        for j in range(m, n + 1):
            i = np.arange(m - 1, j)
            all_ = cost[i] + run(i, j)[1]
            cut[j] = i[int(all_.argmin())]
            new[j] = all_.min()
        cuts.append(cut)
        cost = new
    ends = [n]
    for cut in reversed(cuts):
        ends.append(int(cut[ends[-1]]))
    ends = [0, *sorted(ends)]
    return [int(run(a, b)[0]) for a, b in zip(ends, ends[1:], strict=False)]


def lloyd(values: np.ndarray, counts: np.ndarray, k: int, rounds: int = 8) -> list[int] | None:
    """Whole-number k-means from weighted quantiles; None where centres coincide."""
    n, total = len(values), int(counts.sum())
    if n <= k:
        return values.tolist() if n == k else None
    upto = np.cumsum(counts)
    centres = np.unique([values[np.argmax(upto > (2 * i + 1) * total // (2 * k))] for i in range(k)])
    for _ in range(rounds):
        if len(centres) < k:
            return None
        of = np.abs(values[:, None] - centres[None, :]).argmin(1)
        weight, sums = np.bincount(of, counts, k).astype(int), np.bincount(of, counts * values, k).astype(int)
        new = np.unique(np.where(weight > 0, (sums + weight // 2) // np.maximum(1, weight), centres))
        if np.array_equal(new, centres):
            break
        centres = new
    return centres.tolist() if len(centres) == k else None


def clustered(hist: DataFrame, by: str, k: int, method: str = "best", most: int = 64) -> DataFrame:
    """(by, centres) of groups with 2 to `most` values; groups too plain for k centres have a null."""
    packed = hist.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("value", "n"))).alias("h")).where(F.size("h").between(2, most))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = best_centres if method == "best" else lloyd
        for b in batches:
            yield pd.DataFrame({by: b[by], "centres": [f(np.array(v, np.int64), np.array(n, np.int64), k) for v, n in zip(b["v"], b["n"], strict=True)]})

    return packed.select(by, F.col("h.value").alias("v"), F.col("h.n").alias("n")).mapInPandas(run, f"{by} long, centres array<long>")


def prefix_sums(hist: DataFrame, by: str) -> DataFrame:
    """(by, value, w, s, ss): running sums of the counts, and of the values and their squares, counted."""
    upto = W.partitionBy(by).orderBy("value").rowsBetween(W.unboundedPreceding, 0)
    of = lambda x: F.sum(F.col("n") * x).over(upto)
    value = F.col("value").cast("long")
    return hist.select(by, "value", of(F.lit(1)).alias("w"), of(value).alias("s"), of(value * value).alias("ss"))


def quantiles(hist: DataFrame, by: str, k: int) -> DataFrame:
    """(by, k, centre): the first values whose running counts pass the middle of each k-th of all."""
    upto = prefix_sums(hist, by).select(by, "value", "w")
    totals = upto.withColumn("all", F.max("w").over(W.partitionBy(by))).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    return totals.where(F.expr(f"w > (2 * k + 1) * all div {2 * k}")).groupBy(by, "k").agg(F.min("value").alias("centre"))

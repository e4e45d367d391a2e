"""Block metrics and searches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pixelmill.functions import transforms


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def differences(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: (x - y).cast("long"))


def successive(blocks: DataFrame) -> DataFrame:
    """(vec_id, a, b): each block with that of the next number: an equi-join on shifted keys, not an unpartitioned window."""
    following = blocks.select((F.col("vec_id") - 1).alias("vec_id"), F.col("block").alias("b"))
    return blocks.withColumnRenamed("block", "a").join(following, "vec_id")


def metrics(pairs: DataFrame) -> DataFrame:
    """SAD, SSE, SATD (of 4x4 parts), SAD with SATD proxy, and moments of the difference, in one pass."""
    d = pairs.withColumn("d", differences(F.col("a"), F.col("b")))
    parts = [transforms.satd4(transforms.at(F.col("d"), 8, y, x)) for y in (0, 4) for x in (0, 4)]
    out = d.select("vec_id", total(F.transform("d", F.abs)).alias("sad"), total(F.transform("d", lambda x: x * x)).alias("sse"), reduce(lambda a, b: a + b, parts).alias("satd"), total(F.col("d")).alias("sum_d"))
    return out.withColumn("proxy", F.col("sad") + F.shiftright("satd", 2))


def walsh(blocks: DataFrame) -> DataFrame:
    """(vec_id, by, bx, coefficients): the lossless transform of each 4x4 part, columns first, transposed at the end."""
    part = lambda y, x: F.struct(F.lit(y // 4).alias("by"), F.lit(x // 4).alias("bx"), F.array(*[F.get("block", F.lit(8 * (y + i) + x + j)).cast("long") for i in range(4) for j in range(4)]).alias("v"))
    rows = blocks.select("vec_id", F.explode(F.array(*[part(y, x) for y in (0, 4) for x in (0, 4)])).alias("p")).select("vec_id", "p.by", "p.bx", F.col("p.v").alias("v"))

    def one_way(df: DataFrame) -> DataFrame:
        """Transforms the columns of v and transposes it; twice is both ways with the transpose undone."""
        columns = [transforms.walsh4([F.get("v", F.lit(4 * i + j)) for i in range(4)]) for j in range(4)]
        return df.select("vec_id", "by", "bx", F.array(*[c for column in columns for c in column]).alias("v"))

    both = one_way(one_way(rows))
    turned = F.array(*[F.get("v", F.lit(4 * j + i)) for i in range(4) for j in range(4)])
    return both.select("vec_id", "by", "bx", F.posexplode(turned).alias("k", "coefficient"))


def duplicates(blocks: DataFrame) -> DataFrame:
    """(vec_id, first_id): the earliest block that is an exact copy, for each that has one. Hash, then verify."""
    hashed = blocks.withColumn("h", F.xxhash64("block"))
    first = hashed.groupBy("h", "block").agg(F.min("vec_id").alias("first_id"))
    return hashed.join(first, ["h", "block"]).where("vec_id > first_id").select("vec_id", "first_id")


def edge_directions(blocks: DataFrame) -> DataFrame:
    """(vec_id, direction, variance): the line direction along which an 8x8 block varies least; the first of equals."""
    lines = {0: lambda i, j: i + j, 1: lambda i, j: i + j // 2, 2: lambda i, j: i, 3: lambda i, j: 3 + i - j // 2, 4: lambda i, j: 7 + i - j, 5: lambda i, j: 3 - i // 2 + j, 6: lambda i, j: j, 7: lambda i, j: i // 2 + j}
    costs = []
    for line in lines.values():
        groups: dict[int, list[int]] = {}
        for i in range(8):
            for j in range(8):
                groups.setdefault(line(i, j), []).append(8 * i + j)
        # a line's squared sum counts by its length: 840 is divisible by all lengths
        costs.append(reduce(lambda a, b: a + b, [_square(reduce(lambda a, b: a + b, [F.get("block", F.lit(k)) for k in g]) - 128 * len(g)) * (840 // len(g)) for g in groups.values()]))
    costed = blocks.select("vec_id", F.array(*costs).alias("cost"))
    best = costed.withColumn("direction", (F.array_position("cost", F.array_max("cost")) - 1).cast("int"))
    return best.select("vec_id", "direction", F.shiftright(F.array_max("cost") - F.get("cost", (F.col("direction") + 4) % 8), 10).alias("variance"))


def _square(x: Column) -> Column:
    return x.cast("long") * x.cast("long")


def sub_block_variances(samples: DataFrame, value: str) -> DataFrame:
    """(image_id, by, bx, variance) of 8x8 sub-blocks of samples (image_id, y, x, value)."""
    v = F.col(value).cast("long")
    sums = samples.groupBy("image_id", F.expr("y div 8").alias("by"), F.expr("x div 8").alias("bx")).agg(F.sum(v).alias("s"), F.sum(v * v).alias("ss"), F.count(F.lit(1)).alias("n"))
    return sums.select("image_id", "by", "bx", F.greatest(F.lit(0.0), F.col("ss") / F.col("n") - (F.col("s") / F.col("n")) * (F.col("s") / F.col("n"))).alias("variance"))


def octile(variances: DataFrame, k: int) -> DataFrame:
    """(image_id, picked): the k-th octile of a superblock's 64 sub-block variances."""
    ordered = F.array_sort(F.collect_list("variance"))
    return variances.groupBy("image_id").agg(F.get(ordered, F.lit(min(8 * k - 1, 63))).alias("picked"))


def spatial_activity(samples: DataFrame, value: str) -> DataFrame:
    """(image_id, activity): mean absolute difference to the right and lower neighbours, over pairs."""
    right = F.lead(value).over(W.partitionBy("image_id", "y").orderBy("x"))
    below = F.lead(value).over(W.partitionBy("image_id", "x").orderBy("y"))
    steps = samples.select("image_id", F.abs(right - F.col(value)).alias("r"), F.abs(below - F.col(value)).alias("b"))
    total_ = F.coalesce(F.sum("r"), F.lit(0)) + F.coalesce(F.sum("b"), F.lit(0))
    pairs = F.count("r") + F.count("b")
    return steps.groupBy("image_id").agg(F.when((F.count("r") == 0) | (F.count("b") == 0), 0.0).otherwise(total_ / pairs).alias("activity"))


def transform_8x8(blocks: DataFrame) -> DataFrame:
    """(vec_id, coefficients): orthonormal 8x8 DCT of each block, batch by batch as matrix products."""
    from collections.abc import Iterator

    import numpy as np
    import pandas as pd

    basis = np.array(transforms.dct_basis(8))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = np.array(b["block"].tolist(), float).reshape(-1, 8, 8) - 128
            yield pd.DataFrame({"vec_id": b["vec_id"], "coefficients": list((basis @ x @ basis.T).round(6).reshape(-1, 64))})

    return blocks.mapInPandas(run, "vec_id long, coefficients array<double>")


def luma_ac(block: Column) -> Column:
    """What an 8x8 luma block says about 4x4 chroma: sums of 2x2 samples, doubled, less their rounded mean."""
    at = lambda r, c: sum((F.get(block, F.lit(8 * (2 * r + i) + 2 * c + j)).cast("long") for i in (0, 1) for j in (0, 1)), F.lit(0).cast("long"))
    sums = F.array(*[F.shiftleft(at(r, c), 1) for r in range(4) for c in range(4)])
    return F.transform(sums, lambda x: x - F.shiftright(total(sums) + 8, 4))


def chroma_alpha(rows: DataFrame, reach: int = 3, most: int = 16) -> DataFrame:
    """(vec_id, alpha) of (vec_id, ac, v), 16 samples each: the factor, of 64, by which luma predicts chroma best.

    The quotient of the normal equation, rounded, and its neighbours are tried; the first of equals is taken.
    """
    rows = rows.withColumn("dc", F.shiftright(total(F.transform("v", lambda x: x.cast("long"))) + 8, 4))
    rows = rows.withColumn("num", total(F.zip_with("v", "ac", lambda v, a: (v - F.col("dc")) * a))).withColumn("den", total(F.transform("ac", lambda a: a * a)))
    rows = rows.withColumn("a0", F.when(F.col("den") == 0, F.lit(0)).otherwise(F.greatest(F.lit(-most), F.least(F.lit(most), F.expr("(64 * num + (den div 2) * cast(sign(num) as int)) div if(den = 0, 1, den)")))).cast("int"))

    def error(a: Column) -> Column:
        scaled = lambda x: F.when(x < 0, -F.shiftright(-x + 32, 6)).otherwise(F.shiftright(x + 32, 6))
        return total(F.transform(F.zip_with("v", "ac", lambda v, y: v - F.greatest(F.lit(0), F.least(F.lit(255), F.col("dc") + scaled(y * a)))), lambda d: d * d))

    tried = [F.when(F.abs(F.col("a0") + o) <= most, F.struct(error(F.col("a0") + o).alias("e"), (F.col("a0") + o).alias("a"))) for o in range(-reach, reach + 1)]
    return rows.select("vec_id", F.when(F.col("den") == 0, 0).otherwise(F.least(*tried)["a"]).alias("alpha"))

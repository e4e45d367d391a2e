"""Block and plane statistics: weighted and reconstruction errors, dark structure, adaptive offsets, roll-ups, fits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pixelmill.functions import transforms
from pixelmill.operators.blocks import total

#: Rows of the 4-point DCT, and weights of its coefficients, whose mean is 1 after the division.
DCT4 = ((0.5, 0.5, 0.5, 0.5), (0.6532815, 0.27059805, -0.27059805, -0.6532815), (0.5, -0.5, -0.5, 0.5), (0.27059805, -0.6532815, 0.6532815, -0.27059805))
WEIGHTS = ((1.8, 1.0, 0.4, 0.2), (1.0, 0.8, 0.2, 0.2), (0.4, 0.2, 0.2, 0.2), (0.2, 0.2, 0.2, 0.2))
MEAN_WEIGHT = 0.4625
#: Fixed values of the variance boost: threshold, slopes and bounds of both sides.
BOOST_BELOW, BOOST_SLOPE, BOOST_MOST, CUT_SLOPE, CUT_MOST = 5.549076, 5.0, 18.0, 6.0, 16.0
#: Fixed values of the protection of dark structure.
MEAN_FLOOR, DARK_REF, DARK_GAMMA, DARK_MOST_WEIGHT, DARK_SCALE, DARK_MOST = 16.0, 56.0, 1.2, 4.5, 4.0, 16


def weighted_sse(pairs: DataFrame) -> DataFrame:
    """(vec_id, wsse) of 8x8 differences d: squared 4x4 DCT coefficients, weighted."""

    def tile(y0: int, x0: int) -> Column:
        e = transforms.at(F.col("d"), 8, y0, x0)
        out = []
        for k in range(4):
            t = [reduce(lambda a, b: a + b, [e[i][j] * DCT4[k][i] for i in range(4)]) for j in range(4)]
            for m in range(4):
                c = reduce(lambda a, b: a + b, [t[j] * DCT4[m][j] for j in range(4)])
                out.append(c * c * (WEIGHTS[k][m] / MEAN_WEIGHT))
        return reduce(lambda a, b: a + b, out)

    return pairs.select("vec_id", reduce(lambda a, b: a + b, [tile(y, x) for y in (0, 4) for x in (0, 4)]).alias("wsse"))


def laplacian(samples: DataFrame, value: str) -> DataFrame:
    """(image_id, lap): mean absolute four-neighbour Laplacian over the inside of (image_id, y, x, value)."""
    row, column = W.partitionBy("image_id", "y").orderBy("x"), W.partitionBy("image_id", "x").orderBy("y")
    near = [F.lag(value).over(row), F.lead(value).over(row), F.lag(value).over(column), F.lead(value).over(column)]
    each = samples.select("image_id", F.abs(F.col(value) * 4 - reduce(lambda a, b: a + b, near)).alias("lap"))  # null at the border
    return each.groupBy("image_id").agg(F.avg("lap").alias("lap"))


def dark_structure(samples: DataFrame, value: str) -> DataFrame:
    """(image_id, mean, energy) of superblocks: energy is the root of the Laplacians at full and at half size."""
    half = samples.groupBy("image_id", F.expr("y div 2").alias("y"), F.expr("x div 2").alias("x")).agg(F.avg(value).alias("h"), F.count(F.lit(1)).alias("n")).where("n = 4")
    mean = samples.groupBy("image_id").agg(F.avg(value).alias("mean"))
    both = mean.join(laplacian(samples, value), "image_id").join(laplacian(half, "h").withColumnRenamed("lap", "half"), "image_id", "left")
    return both.select("image_id", "mean", F.coalesce(F.sqrt(F.col("lap") * F.col("half")), F.lit(0.0)).alias("energy"))


def dark_offset(mean: Column, energy: Column) -> Column:
    """How much the quantizer of a dark, structured superblock is lowered."""
    weight = F.greatest(F.lit(1.0), F.least(F.lit(DARK_MOST_WEIGHT), F.pow(F.lit(MEAN_FLOOR + DARK_REF) / (mean + MEAN_FLOOR), F.lit(DARK_GAMMA))))
    return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(float(DARK_MOST)), F.log1p(energy * (weight - 1)) * DARK_SCALE)) + 0.5).cast("int")


def boost_anchor(samples: DataFrame, value: str) -> DataFrame:
    """(image_id, anchor): 0.95 of log(1 + variance) of superblocks (image_id, y, x, value) that are frames of their own."""
    v = F.col(value).cast("long")
    sums = samples.groupBy("image_id").agg(F.sum(v).alias("s"), F.sum(v * v).alias("ss"), F.count(F.lit(1)).alias("n"))
    spread = F.greatest(F.lit(0.0), F.col("ss") / F.col("n") - (F.col("s") / F.col("n")) * (F.col("s") / F.col("n")))
    return sums.select("image_id", (F.log1p(spread) * 0.95).alias("anchor"))


def boost_offset(variance: Column, anchor: Column, strength: float = 1.0) -> Column:
    """Quantizer offset of a superblock by its variance: negative for low contrast, positive above the anchor."""
    v = F.log1p(variance)
    low = F.least((F.lit(BOOST_BELOW) - v) * (BOOST_SLOPE * strength), F.lit(BOOST_MOST))
    high = F.least(F.greatest(v - F.greatest(anchor, F.lit(BOOST_BELOW)), F.lit(0.0)) * (CUT_SLOPE * strength), F.lit(CUT_MOST))
    return F.when(v < BOOST_BELOW, -F.floor(low + 0.5)).otherwise(F.floor(high + 0.5)).cast("int")


def structure_distance(pairs: DataFrame, depth: int = 8) -> DataFrame:
    """(vec_id, distance) of 8x8 blocks a and b: squared error, weighed by how much both vary."""
    s = depth - 8
    sums = lambda c: (total(F.transform(c, lambda x: x.cast("long"))), total(F.transform(c, lambda x: x.cast("long") * x)))
    (sa, saa), (sb, sbb) = sums("a"), sums("b")
    d = pairs.select("vec_id", (saa - F.shiftright(sa * sa + 32, 6)).alias("va"), (sbb - F.shiftright(sb * sb + 32, 6)).alias("vb"), total(F.transform("d", lambda x: x * x)).alias("sse"))
    weight = (F.col("va") + F.col("vb") + (400 << (2 * s))) * 0.5 / F.sqrt(F.col("va").cast("double") * F.col("vb") + (20000 << (4 * s)))
    return d.select("vec_id", F.floor(F.col("sse") * weight + 0.5).alias("distance"))


def band_sums(samples: DataFrame) -> DataFrame:
    """(fine, c0, c1, n, e, ee) of (v, c0, c1, err): errors by eighth of the range and the classes of two neighbours."""
    return samples.groupBy(F.expr("v div 32").alias("fine"), "c0", "c1").agg(F.count(F.lit(1)).alias("n"), F.sum("err").alias("e"), F.sum(F.col("err") * F.col("err")).alias("ee"))


def rolled_up(fine: DataFrame) -> DataFrame:
    """(log2, band, c0, c1, n, e, ee): the sums at 1, 2, 4 and 8 bands, from those at 8; the samples aren't read again."""
    each = fine.withColumn("log2", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn("band", F.expr("cast(shiftright(fine, 3 - log2) as long)"))
    return each.groupBy("log2", "band", "c0", "c1").agg(F.sum("n").alias("n"), F.sum("e").alias("e"), F.sum("ee").alias("ee"))


def normal_equations(points: DataFrame, by: str) -> DataFrame:
    """(by, xx, xz, x1, zz, z1, n, xy, zy, y1) of (by, x, z, y): the sums of a fit of y by x, z and a constant."""
    p = lambda a, b: F.sum(F.col(a).cast("long") * F.col(b))
    return points.groupBy(by).agg(p("x", "x").alias("xx"), p("x", "z").alias("xz"), F.sum("x").alias("x1"), p("z", "z").alias("zz"), F.sum("z").alias("z1"), F.count(F.lit(1)).alias("n"), p("x", "y").alias("xy"), p("z", "y").alias("zy"), F.sum("y").alias("y1"))


def solved(sums: DataFrame, by: str) -> DataFrame:
    """(by, det, kx, kz, k1): the fit by Cramer's rule; nulls where it isn't unique."""
    det = lambda m: m[0] * (m[4] * m[8] - m[5] * m[7]) - m[1] * (m[3] * m[8] - m[5] * m[6]) + m[2] * (m[3] * m[7] - m[4] * m[6])
    rows, right = [["xx", "xz", "x1"], ["xz", "zz", "z1"], ["x1", "z1", "n"]], ["xy", "zy", "y1"]
    whole = lambda k: det([F.col(x).cast("double") for row, y in zip(rows, right, strict=True) for x in [y if i == k else v for i, v in enumerate(row)]])
    base = whole(None)
    put = sums.select(by, base.alias("det"), *[whole(k).alias(f"d{k}") for k in range(3)])
    return put.select(by, "det", *[F.when(F.col("det") != 0, F.col(f"d{k}") / F.col("det")).alias(n) for k, n in enumerate(("kx", "kz", "k1"))])

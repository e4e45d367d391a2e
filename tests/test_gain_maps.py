import math
import random
import struct
from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

from pixelmill.functions import gain_maps


def plain_fraction(x):
    """Convergents of the number in exact arithmetic on doubles, as the record's readers take them."""
    v = abs(float(np.float32(x)))
    if math.isnan(v) or v > gain_maps.MOST_NUMERATOR:
        return None
    bound = gain_maps.MOST_DENOMINATOR if v <= 1 else int(gain_maps.MOST_NUMERATOR / math.floor(v))
    d, before, rest = 1, 0, v - math.floor(v)
    for _ in range(gain_maps.STEPS):
        if rest == 0 or float(d) * v == math.floor(float(d) * v):
            break
        rest = 1 / rest
        if before + math.floor(rest) * d > bound:
            break
        d, before, rest = before + math.floor(rest) * d, d, rest - math.floor(rest)
    n = math.floor(d * v + 0.5)
    return (n if x >= 0 else -n, d) if n <= gain_maps.MOST_NUMERATOR else None


def test_fractions(spark):
    rng = random.Random(5)
    values = [0.0, 1.0, -1.0, 0.5, 1 / 3, -2.2, 1e-9, 1e-30, 2147483647.0, 2147483520.0, 3e9, float("inf"), float("nan"), 0.1, 16777217.0, 1.0000001, 0.9999999, -0.0, 1e-45]
    values += [rng.uniform(-10, 10) for _ in range(200)] + [rng.uniform(0, 1) ** 8 for _ in range(100)] + [rng.uniform(1, 2e9) for _ in range(50)]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)] + [(-1, None)], "i long, v double")
    found = {r["i"]: r["f"] and tuple(r["f"]) for r in rows.select("i", gain_maps.fraction(F.col("v")).alias("f")).collect()}
    assert found.pop(-1) is None
    assert found == {i: plain_fraction(v) for i, v in enumerate(values)}
    for i, v in enumerate(values):
        if found[i] and 1e-6 < abs(v) < 1e6:  # near, and exact wherever single precision allows
            assert abs(Fraction(*found[i]) - Fraction(float(np.float32(v)))) < Fraction(1, 10**6) * abs(Fraction(v))


CHANNEL = [-5, 3, 7, 2, 22, 10, -1, 64, 1, 64]


def packed(headrooms, channels, base=True):
    many = len({tuple(c) for c in channels}) > 1
    numbers = headrooms + [n for c in (channels if many else channels[:1]) for n in c]
    return struct.pack(">HHB", 0, 0, 128 * many + 64 * base) + b"".join(struct.pack(">I", n & 0xFFFFFFFF) for n in numbers)


def read(spark, rows):
    given = spark.createDataFrame(list(enumerate(rows)), "i long, b binary")
    return [r["r"] for r in given.select("i", gain_maps.parsed(F.col("b")).alias("r")).orderBy("i").collect()]


def test_records_round_trip(spark):
    other = [4, 3, 4, 2, 1, 10, -(2**31) + 1, 64, 2**31 - 1, 2**32 - 1]
    cases = [([0, 1, 3, 2], [CHANNEL] * 3, True), ([2**32 - 1, 1, 3, 2**32 - 1], [CHANNEL, other, CHANNEL], False), ([0, 1, 0, 1], [other], False)]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i long, h array<long>, c array<array<long>>, b boolean")
    made = [bytes(r["m"]) for r in rows.select("i", gain_maps.record(F.col("h"), F.col("c"), F.col("b")).alias("m")).orderBy("i").collect()]
    assert made == [packed(*c) for c in cases] and [len(m) for m in made] == [61, 141, 61]
    for got, (h, c, b) in zip(read(spark, made), cases, strict=True):
        assert (got["error"], got["headrooms"], got["channels"], got["base_space"]) == (None, h, c if len(c) == 3 else c * 3, b)


def test_broken_records_are_error_rows(spark):
    good, three = packed([0, 1, 3, 2], [CHANNEL] * 3), packed([0, 1, 3, 2], [CHANNEL, CHANNEL, [1] * 10])
    change = lambda k, v: [v if i == k else n for i, n in enumerate(CHANNEL)]
    cases = {
        None: "truncated", b"": "truncated", good[:4]: "truncated", good[:-1]: "truncated", three[:61]: "truncated", good + b"x": "trailing bytes", b"\0\1" + good[2:]: "unsupported version",
        good[:2] + b"\0\1" + good[4:] + b"more": None, packed([0, 0, 3, 2], [CHANNEL] * 3): "zero denominator of a headroom", packed([0, 1, 3, 2], [change(1, 0)] * 3): "zero denominator in a channel",
        packed([0, 1, 3, 2], [change(2, -9)] * 3): "max below min", packed([0, 1, 3, 2], [change(4, 0)] * 3): "gamma is zero", good[:4] + bytes([good[4] | 63]) + good[5:]: None,
    }
    assert [r["error"] for r in read(spark, list(cases))] == list(cases.values())
    assert read(spark, [b""])[0]["channels"] is None


def test_faulty_parameters_make_no_record(spark):
    rows = spark.createDataFrame([(0, [1, 0, 1, 1], [CHANNEL]), (1, None, [CHANNEL]), (2, [1] * 4, None), (3, [1] * 4, [CHANNEL, CHANNEL]), (4, [1] * 4, [[1] * 9]), (5, [1] * 4, [CHANNEL])], "i long, h array<long>, c array<array<long>>")
    found = {r["i"]: r["m"] is not None for r in rows.select("i", gain_maps.record(F.col("h"), F.col("c"), F.lit(False)).alias("m")).collect()}
    assert found == {0: False, 1: False, 2: False, 3: False, 4: False, 5: True}

"""Gain map parameters as fractions, and their binary record: column expressions both ways.

A record is big-endian: two versions (16 bits, 0), a byte of flags, four 32-bit numbers of the two headrooms, and ten
of a channel, for one channel where all three are equal, else for three.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The flags of a record, the steps of a continued fraction, and the bounds of its parts.
THREE_CHANNELS, BASE_SPACE = 128, 64
STEPS, MOST_NUMERATOR, MOST_DENOMINATOR = 39, (1 << 31) - 1, (1 << 32) - 1
#: Numbers of a channel in order, each with its denominator behind it; those of SIGNED may be negative.
CHANNEL = ("min", "max", "gamma", "base_offset", "other_offset")
SIGNED = (0, 2, 6, 8)
HEADER, NUMBER, PER_CHANNEL = 5, 4, 2 * len(CHANNEL)


def fraction(value: Column) -> Column:
    """(n, d) of a number, taken in single precision, by continued fractions: the first that is exact, or the last before d outgrows its bound.

    The bound of d lets n stay within MOST_NUMERATOR. Null: NaN, null, infinite and larger numbers.
    """
    single = value.cast("float").cast("double")
    size = F.abs(single)
    bound = F.when(size <= 1, F.lit(float(MOST_DENOMINATOR))).otherwise(F.floor(F.lit(float(MOST_NUMERATOR)) / F.greatest(F.lit(1.0), F.floor(size).cast("double"))).cast("double"))
    start = F.struct(F.lit(1.0).alias("d"), F.lit(0.0).alias("before"), (size - F.floor(size)).alias("rest"), size.alias("v"), bound.alias("bound"), F.lit(False).alias("done"))

    def step(s: Column, _: Column) -> Column:
        exact = (s["d"] * s["v"] == F.round(s["d"] * s["v"])) | (s["rest"] <= 0)
        turned = F.lit(1.0) / F.when(s["rest"] > 0, s["rest"]).otherwise(1.0)
        grown = s["before"] + F.floor(turned).cast("double") * s["d"]
        stop = exact | (grown > s["bound"])
        moved = F.struct(grown.alias("d"), s["d"].alias("before"), (turned - F.floor(turned)).alias("rest"), s["v"].alias("v"), s["bound"].alias("bound"), F.lit(False).alias("done"))
        return F.when(s["done"], s).when(stop, s.withField("done", F.lit(True))).otherwise(moved)

    def end(s: Column) -> Column:
        n = F.round(s["d"] * s["v"]).cast("long")
        return F.struct((n * F.when(single < 0, -1).otherwise(1)).alias("n"), s["d"].cast("long").alias("d"))

    whole = value.isNotNull() & ~F.isnan(single) & (size <= MOST_NUMERATOR)
    safe = F.when(whole, start)
    found = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), safe, step, end)
    return F.when(whole & (found["n"].between(-MOST_NUMERATOR, MOST_NUMERATOR)), found)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is reckoned once however often it is used."""
    return F.transform(F.array(value), use)[0]


def fault(headrooms: Column, channels: Column) -> Column:
    """What is wrong with parameters: null if nothing. headrooms: four numbers; channels: one or three arrays of ten."""
    d_zero = F.exists(channels, lambda c: F.exists(F.array(*[c[k] for k in range(1, PER_CHANNEL, 2)]), lambda d: d == 0))
    return (
        F.when(headrooms.isNull() | channels.isNull() | (F.size(headrooms) != 4) | ~F.size(channels).isin(1, 3) | F.exists(channels, lambda c: F.size(c) != PER_CHANNEL), "numbers missing")
        .when(d_zero, "zero denominator in a channel")
        .when(F.exists(channels, lambda c: c[2].cast("decimal(20,0)") * c[1] < c[0].cast("decimal(20,0)") * c[3]), "max below min")
        .when(F.exists(channels, lambda c: c[4] == 0), "gamma is zero")
        .when((headrooms[1] == 0) | (headrooms[3] == 0), "zero denominator of a headroom")
    )


def record(headrooms: Column, channels: Column, base_space: Column) -> Column:
    """The binary record of parameters; null where they have a fault."""
    equal = F.size(F.array_distinct(channels)) == 1
    kept = F.when(equal, F.slice(channels, 1, 1)).otherwise(channels)
    flags = F.when(equal, 0).otherwise(THREE_CHANNELS) + F.when(base_space, BASE_SPACE).otherwise(0)
    word = lambda n: F.lpad(F.hex(n.bitwiseAND(MOST_DENOMINATOR)), 2 * NUMBER, "0")
    numbers = F.array_join(F.transform(F.concat(headrooms, F.flatten(kept)), word), "")
    return F.when(fault(headrooms, channels).isNull(), F.unhex(F.concat(F.lit("00" * 4), F.lpad(F.hex(flags.cast("long")), 2, "0"), numbers)))


def parsed(data: Column) -> Column:
    """(headrooms, channels, base_space, error) of a record; with an error the others are null. Channels are always three."""
    byte = lambda at: F.conv(F.hex(F.substring(data, at, 1)), 16, 10).cast("int")
    count = F.when(byte(5).bitwiseAND(THREE_CHANNELS) > 0, 3).otherwise(1)
    need = count * (PER_CHANNEL * NUMBER) + HEADER + 4 * NUMBER
    number = lambda i: F.conv(F.hex(F.substring(data, i * NUMBER + HEADER + 1, F.lit(NUMBER))), 16, 10).cast("long")
    signed = lambda k, n: F.when(k.isin(*SIGNED) & (n > MOST_NUMERATOR), n - (1 << 32)).otherwise(n)
    span = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
    channel = lambda c: F.transform(span(PER_CHANNEL), lambda k: signed(k, number(F.least(c, count - 1) * PER_CHANNEL + k + 4)))
    minimum, writer = (F.hex(F.substring(data, at, 2)) for at in (1, 3))
    early = F.when(data.isNull() | (F.octet_length(data) < HEADER), "truncated").when(minimum != "0000", "unsupported version").when(F.octet_length(data) < need, "truncated").when((writer == "0000") & (F.octet_length(data) > need), "trailing bytes")
    read = F.struct(F.transform(span(4), number).alias("headrooms"), F.transform(span(3), channel).alias("channels"), (byte(5).bitwiseAND(BASE_SPACE) > 0).alias("base_space"))
    checked = once(read, lambda r: once(fault(r["headrooms"], r["channels"]), lambda e: F.struct(*[F.when(e.isNull(), r[n]).alias(n) for n in ("headrooms", "channels", "base_space")], e.alias("error"))))
    none = F.struct(F.lit(None).cast("array<bigint>").alias("headrooms"), F.lit(None).cast("array<array<bigint>>").alias("channels"), F.lit(None).cast("boolean").alias("base_space"), early.alias("error"))
    return F.when(early.isNull(), checked).otherwise(none)

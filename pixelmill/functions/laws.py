"""Coding laws: quality to quantizer, matrix levels, chroma offsets, filter levels, motion cost, key decisions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values: (quality, quantizer) anchors.
ANCHORS = ((1, 215), (30, 140), (40, 116), (50, 91), (60, 70), (70, 53), (80, 35), (85, 28), (90, 17), (93, 12), (96, 7), (98, 5), (99, 3), (100, 1))


def quality_to_q(quality: Column) -> Column:
    """Between two anchors along a line; quotients are cut off toward zero."""
    q, out = F.greatest(F.lit(1), F.least(F.lit(100), quality)), F.lit(ANCHORS[-1][1])
    for (l0, q0), (l1, q1) in reversed(list(zip(ANCHORS, ANCHORS[1:], strict=False))):
        step = (q - l0) * (q1 - q0) / F.lit(l1 - l0)  # never above 0
        out = F.when(q <= l1, F.ceil(step).cast("int") + q0).otherwise(out)
    return out


def half_away(x: Column) -> Column:
    return F.floor(x + 0.5).cast("int")


def matrix_level(q: Column, subsampled: bool) -> Column:
    """Quantization matrix level by base quantizer."""
    top = 8 if subsampled else 15
    return F.when(q <= 20, top).when(q <= 48, half_away((q - 20) * (8.0 - top) / 28 + top)).when(q >= 128, 0).otherwise(half_away((F.lit(128) - q) * 8.0 / 80))


def chroma_dc_delta(q: Column) -> Column:
    """Offset of the chroma DC quantizer for full-resolution chroma."""
    return F.when(q <= 160, 0).otherwise(-F.least(F.floor((q - 160) / 3), F.lit(32))).cast("int")


def chroma_ac_delta(q: Column, at_top: int = 0) -> Column:
    """Offset of the chroma AC quantizer for full-resolution chroma."""
    return F.when(q <= 20, at_top).when(q >= 96, 24).otherwise(F.floor((q - 20) * 24 / 76)).cast("int")


def filter_levels(q: Column) -> tuple[Column, Column]:
    """Luma and chroma loop filter levels, chroma not off before luma."""
    luma = F.least(F.floor(q / 8), F.lit(40)).cast("int")
    return luma, F.when(luma > 0, F.greatest(F.lit(1), F.least(F.floor(q / 10), F.lit(32)))).otherwise(0).cast("int")


def motion_cost(row: Column, col: Column, weight: int) -> Column:
    """Bits of a motion vector, as of an Exp-Golomb code, times a weight."""
    bits = lambda v: F.length(F.bin((F.abs(v) + 1).cast("long"))) * 2 + F.when(v != 0, 1).otherwise(0)
    return (bits(row) + bits(col) + 2) * weight


def frame_quantizer(temporal: Column, temporal_mean: Column, spatial: Column, spatial_mean: Column, nominal: int, most: int) -> Column:
    """A frame's quantizer by how much it moves and how busy it is, against the frames before."""
    d = F.log2((temporal + 1) / (temporal_mean + 1)) * 3 - F.log2((spatial + 1) / (spatial_mean + 1)) * 2
    d = F.greatest(F.lit(-most), F.least(F.lit(most), F.round(d).cast("int")))
    return F.when((temporal_mean <= 0) & (spatial_mean <= 0), nominal).otherwise(F.greatest(F.lit(1), F.least(F.lit(254), d + nominal)))


#: How chroma of full resolution eases to finer matrices, and the offsets of subsampled chroma.
MATRIX_CHROMA_TOP, MATRIX_KNEE, MATRIX_WIDTH = 2, 12, 5
CHROMA_MID, CHROMA_420_TAIL, CHROMA_422_SCALE = 28, 28, 0.5
#: SATD's price of a squared error, at three quantizers, for subsampled and full chroma.
PRICE_AT, PRICE_SUBSAMPLED, PRICE_FULL = (28.0, 81.0, 140.0), (24.5, 21.3, 18.2), (35.0, 21.2, 18.1)


def linear_quality_to_q(quality: Column) -> Column:
    """The straight law: quality 1 to 100 onto quantizers 254 to 1."""
    return F.greatest(F.lit(1), F.least(F.lit(254), F.floor((F.lit(100) - quality) * 254 / 99))).cast("int")


def profile(depth: Column, chroma: Column) -> Column:
    """Sequence profile by depth and chroma format."""
    return F.when((depth == 12) | (chroma == "422"), 2).when(chroma == "444", 1).otherwise(0)


def chroma_matrix_level(q: Column) -> Column:
    """Matrix level of chroma at full resolution: held down, but for the finest quantizers."""
    pinned = F.least(F.lit(MATRIX_CHROMA_TOP), matrix_level(q, False))
    ease = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.lit(MATRIX_KNEE) - q) / MATRIX_WIDTH))
    return F.when(ease > 0, half_away(pinned + (F.lit(15.0) - pinned) * ease)).otherwise(pinned)


def chroma_mid_delta(q: Column, tail: int) -> Column:
    """A dip of the offset over the middle quantizers, down to the tail beyond; quotients are cut off."""
    d = CHROMA_MID
    return F.when(q <= 20, 0).when(q < 64, -F.floor((q - 20) * d / 44)).when(q <= 96, -d).when(q < 136, -tail - F.floor((F.lit(136) - q) * (d - tail) / 40)).otherwise(-tail).cast("int")


def subsampled_chroma_delta(q: Column, chroma: str) -> Column:
    """Offset of the chroma quantizers (DC and AC alike) for 4:2:0 and 4:2:2."""
    return chroma_mid_delta(q, CHROMA_420_TAIL) if chroma == "420" else F.ceil(chroma_mid_delta(q, 0) * CHROMA_422_SCALE).cast("int")


def satd_price(q: Column, subsampled: bool) -> Column:
    """Along lines between three quantizers, constant outside."""
    k, (a, b, c) = PRICE_SUBSAMPLED if subsampled else PRICE_FULL, PRICE_AT
    return F.when(q <= a, k[0]).when(q >= c, k[2]).when(q <= b, (q - a) * (k[1] - k[0]) / (b - a) + k[0]).otherwise((q - b) * (k[2] - k[1]) / (c - b) + k[1])


def matrix_step(step: Column, weight: Column) -> Column:
    """A dequantizer step under a matrix weight (32 leaves it)."""
    return F.shiftright(step * weight + 16, 5)


def rd_cost(distortion: Column, rate: Column, price: float) -> Column:
    return distortion + rate * price


#: Steps of quantizer 0, then of quantizers 1 to 24; every further 24 quantizers double the step.
WIDE_STEPS = (64, 40, 41, 43, 44, 45, 47, 48, 49, 51, 52, 54, 55, 57, 59, 60, 62, 64, 66, 68, 70, 72, 74, 76, 78)


def wide_step(q: Column) -> Column:
    """Quantizer step of a quantizer from 0 to 255; others are clamped."""
    at = F.greatest(F.lit(1), F.least(F.lit(255), q)) - 1
    doubled = F.call_function("shiftleft", F.get(F.array(*map(F.lit, WIDE_STEPS)), at % 24 + 1), F.floor(at / 24).cast("int"))
    return F.when(q <= 0, WIDE_STEPS[0]).otherwise(doubled)

"""Colour conversion in fixed point, and HDR transfer curves."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: BT.601 full range, 13 fractional bits.
Y_OF, CB_OF, CR_OF = (2449, 4809, 934), (-1382, -2714, 4096), (4096, -3430, -666)
BITS = 13
#: Hybrid log-gamma.
HLG_A, HLG_B, HLG_C = 0.17883277, 0.28466892, 0.55991073


def weighted(rgb: tuple[Column, Column, Column], weights: tuple[int, int, int]) -> Column:
    return sum((c.cast("long") * w for c, w in zip(rgb, weights, strict=True)), F.lit(0).cast("long"))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def ycbcr(r: Column, g: Column, b: Column, depth: int = 8) -> tuple[Column, Column, Column]:
    """Rounded and clamped to the depth."""
    half, top, rgb = 1 << (BITS - 1), (1 << depth) - 1, (r, g, b)
    centre = (1 << (depth - 1)) << BITS
    shifted = lambda x: clamp(F.shiftright(x + half, BITS), 0, top).cast("int")
    return shifted(weighted(rgb, Y_OF)), shifted(weighted(rgb, CB_OF) + centre), shifted(weighted(rgb, CR_OF) + centre)


def chroma_sums(r: Column, g: Column, b: Column, depth: int = 8) -> tuple[Column, Column]:
    """Cb and Cr before rounding, as averages of neighbours take them."""
    centre = (1 << (depth - 1)) << BITS
    return weighted((r, g, b), CB_OF) + centre, weighted((r, g, b), CR_OF) + centre


def hlg_to_scene(signal: Column) -> Column:
    return F.when(signal <= 0.5, signal * signal / 3).otherwise((F.exp((signal - HLG_C) / HLG_A) + HLG_B) / 12)


def hlg_from_scene(scene: Column) -> Column:
    return F.when(scene <= 1 / 12, F.sqrt(scene * 3)).otherwise(F.ln(F.greatest(scene * 12 - HLG_B, F.lit(1e-12))) * HLG_A + HLG_C)


def pq_encode(linear: Column) -> Column:
    """Perceptual quantizer of light relative to 10,000 cd/m2."""
    m1, m2, c1, c2, c3 = 2610 / 16384, 2523 / 32, 3424 / 4096, 2413 / 128, 2392 / 128
    p = F.pow(F.greatest(linear, F.lit(0.0)), F.lit(m1))
    return F.pow((p * c2 + c1) / (p * c3 + 1), F.lit(m2))


def gain_map_apply(value: Column, sample: Column, low: float, high: float, gamma: float, base_offset: float, other_offset: float) -> Column:
    """A linear channel raised by its gain map sample (16 bit)."""
    g = F.pow(sample / 65535, F.lit(1 / gamma))
    return (value + base_offset) * F.pow(F.lit(2.0), g * high + (1 - g) * low) - other_offset


def tone_mapped(light: Column, peak: Column, knee: float = 0.75) -> Column:
    """HDR light above the knee drawn into what SDR can show, so that the peak becomes 1."""
    compression = F.when(peak > 1, F.lit(1 / (1 - knee)) - 1 / (peak - knee)).otherwise(0.0)
    above = light - knee
    return F.when(light > knee, above / (above * compression + 1) + knee).otherwise(light)


#: BT.2020 luminance, HLG's system gamma and its peak relative to SDR white.
LUMINANCE_2020, SYSTEM_GAMMA, HLG_PEAK = (0.2627, 0.6780, 0.0593), 1.2, 1000 / 203
#: PQ's peak relative to SDR white.
PQ_PEAK = 10000 / 203


def pq_decode(signal: Column) -> Column:
    """The inverse of pq_encode."""
    m1, m2, c1, c2, c3 = 2610 / 16384, 2523 / 32, 3424 / 4096, 2413 / 128, 2392 / 128
    p = F.pow(signal, F.lit(1 / m2))
    return F.pow(F.greatest(p - c1, F.lit(0.0)) / (F.lit(c2) - p * c3), F.lit(1 / m1))


def hlg_signal(rgb: tuple[Column, Column, Column]) -> list[Column]:
    """HLG signals of display light relative to SDR white: the inverse system gamma, highlights drawn to the peak."""
    display = [F.greatest(c, F.lit(0.0)) / HLG_PEAK for c in rgb]
    light = sum((c * w for c, w in zip(display, LUMINANCE_2020, strict=True)), F.lit(0.0))
    scene = [c * F.pow(light, F.lit(1 / SYSTEM_GAMMA - 1)) for c in display]
    most = F.greatest(F.lit(1.0), *scene)
    return [F.when(light > 0, hlg_from_scene(c / most)).otherwise(0.0) for c in scene]


def deepened(v: Column, depth: int) -> tuple[Column, Column]:
    """A 16-bit sample cut to a depth, and brought back by repeating its upper bits."""
    low = F.shiftright(v, 16 - depth)
    return low, F.shiftleft(low, 16 - depth).bitwiseOR(F.shiftright(low, 2 * depth - 16))


def nclx(primaries: Column, transfer: Column, matrix: Column, full_range: Column) -> Column:
    """The colour box's payload: its type, three big-endian 16-bit numbers, and a byte whose top bit is the range."""
    wide = lambda x: F.lpad(F.hex(x.cast("long")), 4, "0")
    return F.unhex(F.concat(F.lit("6E636C78"), wide(primaries), wide(transfer), wide(matrix), F.when(full_range, "80").otherwise("00")))


def leb128(x: Column, most: int = 5) -> Column:
    """Seven bits a byte, lowest first, the top bit saying that more follow."""
    out = F.lit("")
    for k in range(most):
        byte = F.shiftright(x.cast("long"), 7 * k).bitwiseAND(127)
        more = F.shiftright(x.cast("long"), 7 * (k + 1)) > 0
        here = F.lit(True) if k == 0 else F.shiftright(x.cast("long"), 7 * k) > 0
        out = F.concat(out, F.when(here, F.lpad(F.hex(byte + F.when(more, 128).otherwise(0)), 2, "0")).otherwise(""))
    return F.unhex(out)

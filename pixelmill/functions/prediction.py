"""Open-loop predictors: columns of a sample's prediction from its neighbours."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights, of 256, of the near edge by distance from it, for blocks of that side.
SMOOTH = {4: (255, 149, 85, 64), 8: (255, 197, 146, 105, 73, 50, 37, 32)}
#: Taps, of 16, of the strongest filter of an edge.
EDGE_TAPS = (2, 4, 4, 4, 2)


def paeth(left: Column, top: Column, corner: Column) -> Column:
    """Of left, top and corner the one nearest to left plus top less corner, in this order of equals."""
    far = lambda x: F.abs(left + top - corner - x)
    return F.when((far(left) <= far(top)) & (far(left) <= far(corner)), left).when(far(top) <= far(corner), top).otherwise(corner)


def smooth_weight(side: int, at: Column) -> Column:
    return F.get(F.array(*map(F.lit, SMOOTH[side])), at)


def smooth(near: Column, far: Column, weight: Column) -> Column:
    """Between an edge sample and the end of the other edge, by the weight of the former."""
    return F.shiftright(weight * near + (F.lit(256) - weight) * far + 128, 8)


def smooth_both(top: Column, bottom: Column, down: Column, left: Column, right: Column, across: Column) -> Column:
    """The mean of both ways, rounded once."""
    return F.shiftright(down * top + (F.lit(256) - down) * bottom + across * left + (F.lit(256) - across) * right + 256, 9)


def mean_of_edges(top: Column, left: Column, side: int) -> Column:
    """Rounded mean of the two edges (arrays) of a square block."""
    total = F.aggregate(F.concat(top, left), F.lit(0).cast("long"), lambda a, x: a + x)
    return F.shiftright(total + side, side.bit_length())


def filtered_edge(edge: Column) -> Column:
    """An edge (array) under the five taps, its ends replicated."""
    last = F.size(edge) - 1
    at = lambda i, k: F.get(edge, F.greatest(F.lit(0), F.least(last, i + k)))
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.shiftright(sum((at(i, k - 2) * w for k, w in enumerate(EDGE_TAPS)), F.lit(8)), 4))

"""Static cost of symbols under cumulative frequency tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bit_cost(symbols: DataFrame, by: str, table: list[int]) -> DataFrame:
    """(by, bits): sum of -log2 of the symbols' probabilities. table: 32768 less the cumulative frequencies, from symbol 0.

    Distinct symbols are counted first, so the cost is worked out once for each.
    """
    cdf = F.array(F.lit(32768), *[F.lit(x) for x in table])
    p = F.greatest(F.get(cdf, F.col("symbol")) - F.get(cdf, F.col("symbol") + 1), F.lit(1))
    counted = symbols.groupBy(by, "symbol").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy(by).agg(F.sum(F.round(-F.log2(p / 32768), 6) * F.col("n")).alias("bits"))

"""Deltas, prefix sums and running numbers within streams, by window functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BIAS = 128


def _order(stream: list[str], order: list[str]):
    return Window.partitionBy(*stream).orderBy(*order)


def delta(df: DataFrame, value: str, stream: list[str], order: list[str], bias: int = BIAS) -> Column:
    """Difference from the one before (the first from 0), plus the bias."""
    return F.col(value) - F.lag(value, 1, 0).over(_order(stream, order)) + bias


def undelta(value: str, stream: list[str], order: list[str], bias: int = BIAS) -> Column:
    return F.sum(F.col(value) - bias).over(_order(stream, order).rowsBetween(Window.unboundedPreceding, 0))


def occurrence(stream: list[str], symbol: str, order: list[str]) -> Column:
    """0-based number of the row among those of its symbol."""
    return F.row_number().over(_order([*stream, symbol], order)) - 1


def rolling_mean(value: str, stream: list[str], order: list[str], n: int = 8) -> Column:
    return F.avg(value).over(_order(stream, order).rowsBetween(1 - n, 0))


def lifted(df: DataFrame, value: str, stream: list[str], place: str) -> DataFrame:
    """Forward 5/3 lifting in long form: `band` (0 low, 1 high), `at` within the band, `coef`.

    Streams of any length: neighbours come from lag and lead, mirrored at both ends.
    """
    w = Window.partitionBy(*stream).orderBy(place)
    prev, follow = F.lag(value).over(w), F.lead(value).over(w)
    cut = lambda x, d: F.call_function("div", x, F.lit(d).cast("long"))
    v = F.col(value).cast("long")
    odd = F.col(place) % 2 == 1
    rows = df.withColumn("high", F.when(odd, v - cut((prev + F.coalesce(follow, prev)).cast("long"), 2)))
    before, after = F.lag("high").over(w), F.lead("high").over(w)
    low = v + cut(F.coalesce(before, after, F.lit(-1)) + F.coalesce(after, before, F.lit(-1)) + 2, 4)
    coef = F.when(odd, F.col("high")).otherwise(low)
    return rows.select(*stream, F.when(odd, 1).otherwise(0).alias("band"), F.call_function("div", F.col(place).cast("long"), F.lit(2).cast("long")).alias("at"), coef.alias("coef"))

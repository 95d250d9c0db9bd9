"""Distances, norms and products of array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def differences(a: Column, b: Column) -> Column:
    """Component by component; the shorter vector counts as filled with zeros."""
    return F.zip_with(a, b, lambda x, y: F.coalesce(x, F.lit(0.0)).cast("double") - F.coalesce(y, F.lit(0.0)).cast("double"))


def norm(a: Column, p: float = 2) -> Column:
    a = F.transform(a, lambda x: F.abs(x.cast("double")))
    if p == 1:
        return _sum(a)
    if p == 2:
        return F.sqrt(_sum(F.transform(a, lambda x: x * x)))
    if p == float("inf"):
        return F.array_max(a)
    return F.pow(_sum(F.transform(a, lambda x: F.pow(x, F.lit(float(p))))), F.lit(1.0 / p))


def distance(a: Column, b: Column, p: float = 2) -> Column:
    return norm(differences(a, b), p)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def unit(a: Column, p: float = 2) -> Column:
    """Null for the zero vector."""
    n = norm(a, p)
    return F.transform(a, lambda x: F.try_divide(x.cast("double"), n))


def to_text(a: Column, digits: int = 6) -> Column:
    return F.concat(F.lit("["), F.concat_ws(", ", F.transform(a, lambda x: F.format_number(x.cast("double"), digits))), F.lit("]"))

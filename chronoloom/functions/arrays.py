"""Expressions on array columns that hold one series per row; NULL marks a missing value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trim_trailing_nulls(a: Column) -> Column:
    """The array up to its last value; empty if it has none."""
    last = F.aggregate(F.transform(a, lambda x, i: F.when(x.isNotNull(), i + 1).otherwise(0)), F.lit(0), lambda m, i: F.greatest(m, i))
    return F.slice(a, 1, last)


def pad_right(a: Column, length: int) -> Column:
    """NULLs up to ``length`` values."""
    return F.concat(a, F.array_repeat(F.lit(None), F.greatest(F.lit(0), F.lit(length) - F.size(a))))


def edge_pad(a: Column, length: int) -> Column:
    """Cut to ``length``, or the last value repeated up to it."""
    return F.when(F.size(a) >= length, F.slice(a, 1, length)).otherwise(F.concat(a, F.array_repeat(F.element_at(a, -1), F.greatest(F.lit(0), F.lit(length) - F.size(a)))))


def blocks(a: Column, length: int, count: Column) -> Column:
    """The first ``count`` consecutive pieces of ``length`` values, without overlap."""
    return F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda k: F.slice(a, k * length + 1, F.lit(length)))


def as_multivariate(a: Column) -> Column:
    return F.array(a)


def first_variate(a: Column) -> Column:
    return F.get(a, 0)


def differences(a: Column, lag: int) -> Column:
    """a[i] - a[i - lag], for i from lag on."""
    n = F.greatest(F.lit(0), F.size(a) - lag)
    return F.zip_with(F.slice(a, lag + 1, n), F.slice(a, 1, n), lambda x, y: x - y)


def three_tap(a: Column, weights: tuple[float, float, float]) -> Column:
    """Weighted sum of each value and its two neighbours; outside the array values are 0."""
    zero, n = F.array(F.lit(0.0)), F.size(a)
    left, right = F.concat(zero, F.slice(a, 1, n - 1)), F.concat(F.slice(a, 2, n - 1), zero)
    w = [F.lit(x) for x in weights]
    return F.zip_with(F.zip_with(left, a, lambda l, m: w[0] * l + w[1] * m), right, lambda s, r: s + w[2] * r)

"""Scalar and aggregate expressions on numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def geometric_mean(c: Column) -> Column:
    """Geometric mean of the positive values, NULL without any."""
    return F.exp(F.avg(F.when(c > 0, F.ln(c))))


def clip(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def signed_log1p(c: Column) -> Column:
    return F.signum(c) * F.log1p(F.abs(c))


def zero_for_missing(c: Column) -> Column:
    """0 for NULL, NaN and infinities."""
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), F.lit(0.0)).otherwise(c)


def is_close(a: Column, b: Column, rtol: float = 1e-12, atol: float = 1e-12) -> Column:
    return F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b)


def round_half_even(c: Column, digits: int) -> Column:
    return F.bround(c, digits)


def stable_hash(*parts: Column) -> Column:
    """A whole number from 0 to 2**60 - 1 that depends on the values alone, on any engine that has md5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 15), 16, 10).cast("long")


def stable_uniform(*parts: Column) -> Column:
    """A number from [0, 1) that depends on the values alone."""
    return stable_hash(*parts) / F.lit(float(1 << 60))

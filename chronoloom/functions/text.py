"""Expressions that make table cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(c: Column, digits: int = 2) -> Column:
    """Fixed digits; ``--`` for NULL."""
    return F.when(c.isNull(), F.lit("--")).otherwise(F.format_string(f"%.{digits}f", c))


def mean_and_spread(mean: Column, spread: Column, digits: int = 2, best: Column | None = None) -> Column:
    """``0.84 ± 0.01``; a star before the best; ``--`` without a mean."""
    cell = F.concat(number(mean, digits), F.lit(" ± "), number(F.coalesce(spread, F.lit(0.0)), digits))
    if best is not None:
        cell = F.concat(F.when(best, F.lit("★ ")).otherwise(F.lit("")), cell)
    return F.when(mean.isNull(), F.lit("--")).otherwise(cell)


def percent(c: Column, digits: int = 1) -> Column:
    return F.when(c.isNull(), F.lit("--")).otherwise(F.concat(F.format_string(f"%.{digits}f", c * 100), F.lit("%")))


def interval(low: Column, high: Column, digits: int = 3) -> Column:
    return F.concat(F.lit("["), number(low, digits), F.lit(", "), number(high, digits), F.lit("]"))

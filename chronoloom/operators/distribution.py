"""Two-sample Kolmogorov-Smirnov tests and control of false discoveries, as window sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoloom.operators.relational import prefix_sums
from chronoloom.schema import finite

_TERMS = 100


def kolmogorov_tail(lam: Column, terms: int = _TERMS) -> Column:
    """P(K > lam) of the Kolmogorov distribution by its alternating series; 1 near 0, where the series is useless."""
    series = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0), lambda s, k: s + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * lam * lam))
    return F.when(lam < 0.04, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), series)))


def ks_tests(rows: DataFrame, value: str, sample: str, by: Sequence[str] = ("feature",)) -> DataFrame:
    """Per group: D and p of the samples False and True of ``sample`` over finite values; D NULL and p 1 if one is empty.

    Values are counted before they are ranked, so what is ranked are distinct values, range by range
    of each group (``prefix_sum``); ties share a step of both distributions.
    """
    own = rows.select(*by, F.col(sample).alias("_s"), finite(F.col(value).cast("double")).alias("_v"))
    counts = own.groupBy(*by, "_v").agg(F.sum(F.when(F.col("_v").isNotNull() & ~F.col("_s"), 1).otherwise(0)).alias("_a"), F.sum(F.when(F.col("_v").isNotNull() & F.col("_s"), 1).otherwise(0)).alias("_b"))
    totals = counts.groupBy(*by).agg(F.sum("_a").alias("na"), F.sum("_b").alias("nb")).withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(by)})
    up = prefix_sums(counts.where("_v IS NOT NULL"), "_v", {"_ua": F.col("_a"), "_ub": F.col("_b")}, by)
    steps = totals.join(up.select(*by, (F.col("_ua") + F.col("_a")).alias("ca"), (F.col("_ub") + F.col("_b")).alias("cb")), [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(by)], "left")
    steps = steps.drop(*by).withColumnsRenamed({f"_k{i}": k for i, k in enumerate(by)})
    gap = F.abs(F.try_divide("ca", "na") - F.try_divide("cb", "nb"))
    out = steps.groupBy(*by).agg(F.max("na").alias("n_a"), F.max("nb").alias("n_b"), F.max(gap).alias("d"))
    n = F.sqrt(F.col("n_a") * F.col("n_b") / (F.col("n_a") + F.col("n_b")))
    return out.withColumn("p", F.when(F.col("d").isNull(), F.lit(1.0)).otherwise(kolmogorov_tail(n * F.col("d"))))


def adjusted(df: DataFrame, p: str = "p", alpha: float = 0.05, by: Sequence[str] = (), name: str = "p_adjusted") -> DataFrame:
    """Benjamini-Hochberg adjusted p-values and whether they reject; for tables of tests."""
    ranked = df.withColumn("_r", F.row_number().over(W.partitionBy(*by).orderBy(p))).withColumn("_m", F.count(F.lit(1)).over(W.partitionBy(*by)))
    down = W.partitionBy(*by).orderBy(F.col("_r").desc()).rowsBetween(W.unboundedPreceding, 0)
    out = ranked.withColumn(name, F.least(F.lit(1.0), F.min(F.col(p) * F.col("_m") / F.col("_r")).over(down)))
    return out.withColumn("rejected", F.col(name) <= alpha).drop("_r", "_m")

"""Operators on tables of series: variates, gaps, windows, splits and sums along time."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoloom.functions import arrays
from chronoloom.functions.numeric import stable_hash

#: Fixed values of the reference corpus: window length, most windows of one series, fewest valid values.
WINDOW, MOST_WINDOWS, LEAST_VALID = 1024, 8, 128


def univariate(df: DataFrame, target: str = "target", item: str = "item_id") -> DataFrame:
    """A row for each variate, named ``{item}_dim{k}``."""
    out = df.select("*", F.posexplode(target).alias("_k", "_v")).withColumn(item, F.concat(F.col(item), F.lit("_dim"), F.col("_k").cast("string")))
    return out.drop(target, "_k").withColumnRenamed("_v", target)


def resampled(df: DataFrame, ts: str, every: str, by: Sequence[str], **aggs: Column) -> DataFrame:
    """Aggregates over windows of time; also runs on streams."""
    w = F.window(ts, every)
    return df.groupBy(*by, w.alias("_w")).agg(*[c.alias(n) for n, c in aggs.items()]).withColumn("ts", F.col("_w.start")).drop("_w")


def regular_grid(df: DataFrame, ts: str, step: str, by: Sequence[str]) -> DataFrame:
    """All steps of each group from its first to its last; values of absent steps are NULL."""
    ends = df.groupBy(*by).agg(F.min(ts).alias("_a"), F.max(ts).alias("_b"))
    grid = ends.select(*by, F.explode(F.expr(f"sequence(_a, _b, interval {step})")).alias(ts))
    return grid.join(df, [*by, ts], "left")


def filled(df: DataFrame, value: str, order: str, by: Sequence[str]) -> DataFrame:
    """Missing values take the last value before, leading ones the first value after."""
    w = W.partitionBy(*by).orderBy(order)
    back = F.last(value, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    ahead = F.first(value, ignorenulls=True).over(w.rowsBetween(0, W.unboundedFollowing))
    return df.withColumn(value, F.coalesce(back, ahead))


def without_trailing_gaps(df: DataFrame, value: str, order: str, by: Sequence[str]) -> DataFrame:
    """Rows up to each group's last value; groups without values go."""
    last = F.max(F.when(F.col(value).isNotNull(), F.col(order))).over(W.partitionBy(*by))
    return df.withColumn("_last", last).where(F.col(order) <= F.col("_last")).drop("_last")


def filled_arrays(df: DataFrame, target: str = "target") -> DataFrame:
    """The same on arrays: trailing gaps cut, then filled forwards and backwards; series without values go.

    Arrow batches in numpy: a running maximum of valid positions fills all series of a batch at once.
    """
    names = df.columns

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(target)
            kind = lists.type.value_type
            keep, out, ends = [], [], [0]
            for x in lists:
                v = x.values.cast(pa.float64()).to_numpy(zero_copy_only=False) if x.is_valid else np.zeros(0)
                ok = np.isfinite(v)
                keep.append(bool(ok.any()))
                if not keep[-1]:
                    continue
                n = len(v) - int(ok[::-1].argmax())
                at = np.maximum.accumulate(np.where(ok[:n], np.arange(n), -1))
                out.append(v[np.where(at < 0, int(ok.argmax()), at)])
                ends.append(ends[-1] + n)
            flat = pa.array(np.concatenate(out) if out else np.zeros(0)).cast(kind)
            rest = batch.filter(pa.array(keep))
            new = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([new if c == target else rest.column(c) for c in names], names=names)

    return df.mapInArrow(fill, df.schema)


def clean_windows(df: DataFrame, target: str = "target", least: int = LEAST_VALID) -> DataFrame:
    """Windows filled, with ``valid_length``; those with fewer than ``least`` values are rejected."""
    trimmed = df.withColumn("valid_length", F.size(arrays.trim_trailing_nulls(F.col(target)))).where(F.col("valid_length") >= least)
    return filled_arrays(trimmed, target)


def windows(df: DataFrame, length: int = WINDOW, most: int = MOST_WINDOWS, target: str = "target", whole: bool = True) -> DataFrame:
    """Consecutive windows of each series, ``window_index`` from 0; series shorter than a window go, or stay whole."""
    if whole:
        df = df.where(F.size(target) >= length)
    count = F.greatest(F.lit(1), F.least(F.lit(most), F.floor(F.size(target) / length))).cast("int")
    cut = F.posexplode(arrays.blocks(F.col(target), length, count)).alias("window_index", "_w")
    return df.select("*", cut).drop(target).withColumnRenamed("_w", target)


def random_window(df: DataFrame, length: int, seed: int, item: str = "item_id", target: str = "target") -> DataFrame:
    """One window of each long enough series, its start a hash of the item and the seed."""
    start = stable_hash(F.col(item), F.lit(seed)) % (F.size(target) - length + 1)
    out = df.where(F.size(target) >= length).withColumn("start_index", start)
    return out.withColumn(target, F.slice(target, (F.col("start_index") + 1).cast("int"), length))


def training_part(df: DataFrame, length: Column, n_windows: Column, target: str = "target") -> DataFrame:
    """Series without their last length * (n_windows + 1) values."""
    return df.withColumn(target, F.slice(target, F.lit(1), F.greatest(F.lit(0), F.size(target) - length * (n_windows + 1))))


def validation_part(df: DataFrame, length: Column, n_windows: Column, target: str = "target") -> DataFrame:
    return df.withColumn(target, F.slice(target, F.lit(1), F.greatest(F.lit(0), F.size(target) - length * n_windows)))


def test_windows(df: DataFrame, length: Column, n_windows: Column, target: str = "target") -> DataFrame:
    """Rolling origins: for each window what came before (``past``) and the next ``length`` values (``label``)."""
    out = df.withColumn("window_idx", F.explode(F.sequence(F.lit(0), n_windows - 1)))
    seen = F.size(target) - length * (n_windows - F.col("window_idx"))
    return out.withColumn("_seen", seen).where("_seen >= 0").withColumn("past", F.slice(target, F.lit(1), F.col("_seen"))).withColumn("label", F.slice(target, F.col("_seen") + 1, length)).drop(target, "_seen")


def cumulative(value: str, order: str, by: Sequence[str]) -> Column:
    return F.sum(value).over(W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, 0))


def seasonal_difference(value: str, order: str, by: Sequence[str], m: int) -> Column:
    return F.col(value) - F.lag(value, m).over(W.partitionBy(*by).orderBy(order))


def smoothed(value: str, order: str, by: Sequence[str], weights: tuple[float, float, float] = (1 / 3, 1 / 3, 1 / 3)) -> Column:
    """Three-tap convolution with zeros beyond the ends."""
    w = W.partitionBy(*by).orderBy(order)
    left, right = F.coalesce(F.lag(value).over(w), F.lit(0.0)), F.coalesce(F.lead(value).over(w), F.lit(0.0))
    return F.lit(weights[0]) * left + F.lit(weights[1]) * F.col(value) + F.lit(weights[2]) * right


def interpolated(df: DataFrame, value: str, at: str, by: Sequence[str]) -> DataFrame:
    """Missing values on the straight line between their neighbours; beyond the ends the nearest value."""
    w = W.partitionBy(*by).orderBy(at)
    time = df.schema[at].dataType.typeName().startswith("timestamp")
    x = (F.unix_micros(F.col(at).cast("timestamp")) if time else F.col(at)).cast("double")
    known = F.when(F.col(value).isNotNull(), F.struct(x.alias("x"), F.col(value).cast("double").alias("y")))
    before = F.last(known, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    after = F.first(known, ignorenulls=True).over(w.rowsBetween(0, W.unboundedFollowing))
    out = df.withColumns({"_b": before, "_a": after})
    line = F.col("_b.y") + (F.col("_a.y") - F.col("_b.y")) * F.try_divide(x - F.col("_b.x"), F.col("_a.x") - F.col("_b.x"))
    return out.withColumn(value, F.coalesce(F.col(value).cast("double"), line, F.col("_b.y"), F.col("_a.y"))).drop("_a", "_b")


def duplicates(df: DataFrame, item: str, target: str = "target") -> DataFrame:
    """Series whose values occur more than once: their number and smallest item."""
    return df.groupBy(target).agg(F.xxhash64(F.first(target)).alias("hash"), F.size(F.first(target)).alias("length"), F.count(F.lit(1)).alias("n"), F.min(item).alias("first_item")).where("n > 1").drop(target)


def length_summary(df: DataFrame, by: Sequence[str], target: str = "target") -> DataFrame:
    """Per dataset: series, and the least, greatest and summed length."""
    n = F.size(target).cast("long")
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_series"), F.min(n).alias("min_length"), F.max(n).alias("max_length"), F.sum(n).alias("total_length"))

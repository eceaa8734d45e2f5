"""Forecasters as a pluggable operator, and error metrics of forecasts.

A forecast is a row for each quantile level and step. Metrics are sums and means
in one aggregation; steps without a label are left out of all of them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoloom.functions.calendar import HORIZONS
from chronoloom.functions.numeric import ratio

#: Levels of the quantile loss and of the interval score's 95 % interval (fixed values).
LEVELS = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)
ALPHA = 0.05

Forecaster = Callable[[np.ndarray, int, int, Sequence[float]], np.ndarray]


def seasonal_naive(past: np.ndarray, length: int, season: int, levels: Sequence[float]) -> np.ndarray:
    """(levels, steps): the last season repeated; quantiles add those of the past seasonal differences."""
    past = np.asarray(past, float)
    if not len(past):
        return np.full((len(levels), length), np.nan)
    m = min(season, len(past))
    point = np.resize(past[-m:], length)
    errors = past[season:] - past[:-season] if len(past) > season else np.zeros(1)
    errors = errors[np.isfinite(errors)]
    spread = np.quantile(errors, levels) - np.median(errors) if len(errors) else np.zeros(len(levels))
    return point[None] + spread[:, None]


def exponential_smoothing(past: np.ndarray, length: int, season: int, levels: Sequence[float], alpha: float = 0.3) -> np.ndarray:
    """A level smoothed over the past, repeated; quantiles from one-step errors."""
    past = np.asarray(past, float)
    past = past[np.isfinite(past)]
    if not len(past):
        return np.full((len(levels), length), np.nan)
    level, errors = past[0], [0.0]
    for x in past[1:]:
        errors.append(x - level)
        level += alpha * (x - level)
    return level + np.quantile(errors, levels)[:, None] * np.sqrt(1 + alpha**2 * np.arange(length))[None]


def predicted(windows: DataFrame, keys: Sequence[str], length: int, season: int, forecaster: Forecaster = seasonal_naive, levels: Sequence[float] = LEVELS) -> DataFrame:
    """Forecasts of rows with a ``past``: (keys, step, level, value). Any function of one series fits in."""
    kinds = "".join(f"`{k}` {windows.schema[k].dataType.simpleString()}, " for k in keys)

    def run(batches):
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                q = forecaster(np.array(row[-1], float), length, season, levels)
                head = dict(zip(keys, row[:-1], strict=True))
                out.append(pd.DataFrame({**head, "step": np.tile(np.arange(1, length + 1), len(levels)), "level": np.repeat(levels, length), "value": q.ravel()}))
            yield pd.concat(out) if out else pd.DataFrame(columns=[*keys, "step", "level", "value"])

    return windows.select(*keys, "past").mapInPandas(run, f"{kinds}step int, level double, value double")


def from_samples(samples: DataFrame, keys: Sequence[str], value: str = "value", levels: Sequence[float] = LEVELS) -> DataFrame:
    """Quantile forecasts from sample paths (keys, step, value)."""
    q = samples.groupBy(*keys, "step").agg(F.percentile(value, list(levels)).alias("_q"))
    return q.select(*keys, "step", F.explode(F.arrays_zip(F.array(*[F.lit(x) for x in levels]).alias("level"), F.col("_q").alias("value"))).alias("_x")).select(*keys, "step", "_x.level", "_x.value")


def enumerated(datasets: DataFrame, key: str, long_keys: DataFrame) -> DataFrame:
    """A task for each dataset and horizon; beyond the short one only for datasets in ``long_keys``."""
    terms = datasets.withColumn("term", F.explode(F.array(*[F.lit(h) for h in HORIZONS])))
    return terms.where("term = 'short'").unionByName(terms.where("term <> 'short'").join(long_keys.select(key), key, "left_semi").select(terms.columns))


def with_properties(rows: DataFrame, properties: DataFrame, key: str = "key") -> DataFrame:
    """``rows`` with domain and number of variates of their dataset, the first part of the task's name."""
    keyed = rows.withColumn(key, F.element_at(F.split("dataset", "/"), 1))
    return keyed.join(properties.select(key, "domain", "num_variates"), key, "left").drop(key)


def at_level(wide: dict[float, str], level: float):
    """The value at any level from columns at some: linear between neighbours, along the outermost pair beyond."""
    known = sorted(wide)
    if level in wide:
        return F.col(wide[level])
    upper = next((i for i, x in enumerate(known) if x > level), len(known) - 1)
    i = max(1, upper)
    a, b = known[i - 1], known[i]
    return F.col(wide[a]) + (F.col(wide[b]) - F.col(wide[a])) * ((level - a) / (b - a))


def point_metrics(rows: DataFrame, by: Sequence[str] = (), y: str = "y", f: str = "f", scale: str | None = "scale", mean: str | None = None) -> DataFrame:
    """Errors of point forecasts f of y; ``scale`` is the past's seasonal error, ``mean`` the mean forecast if not f."""
    m = F.col(mean or f)
    e, size = F.abs(F.col(y) - F.col(f)), F.abs(F.col(y))
    known = rows.where(F.col(y).isNotNull())
    aggs = {
        "mse_mean": F.avg((F.col(y) - m) ** 2),
        "mse": F.avg((F.col(y) - F.col(f)) ** 2),
        "mae": F.avg(e),
        "mape": F.avg(ratio(e, size)),
        "smape": F.avg(ratio(2 * e, size + F.abs(F.col(f)))),
        "nd": ratio(F.sum(e), F.sum(size)),
        "rmse": F.sqrt(F.avg((F.col(y) - m) ** 2)),
        "nrmse": ratio(F.sqrt(F.avg((F.col(y) - m) ** 2)), F.avg(size)),
    }
    if scale:
        aggs["mase"] = F.avg(ratio(e, F.col(scale)))
    return known.groupBy(*by).agg(*[c.alias(n) for n, c in aggs.items()])


def interval_score(rows: DataFrame, by: Sequence[str] = (), y: str = "y", low: str = "q_low", high: str = "q_high", scale: str = "scale", alpha: float = ALPHA) -> DataFrame:
    """Mean scaled interval score: width, and 2 / alpha times what lies outside, over the seasonal error."""
    out = F.greatest(F.lit(0.0), F.col(low) - F.col(y)) + F.greatest(F.lit(0.0), F.col(y) - F.col(high))
    return rows.where(F.col(y).isNotNull()).groupBy(*by).agg(F.avg(ratio(F.col(high) - F.col(low) + out * (2 / alpha), F.col(scale))).alias("msis"))


def quantile_loss(rows: DataFrame, by: Sequence[str] = (), y: str = "y", level: str = "level", value: str = "value") -> DataFrame:
    """Mean over levels of the summed quantile losses over the sum of absolute labels."""
    loss = 2 * F.abs((F.col(y) - F.col(value)) * ((F.col(y) <= F.col(value)).cast("double") - F.col(level)))
    per_level = rows.where(F.col(y).isNotNull()).groupBy(*by, level).agg(ratio(F.sum(loss), F.sum(F.abs(y))).alias("_l"))
    return per_level.groupBy(*by).agg(F.avg("_l").alias("mean_weighted_sum_quantile_loss"))


def seasonal_error(rows: DataFrame, by: Sequence[str], order: str, value: str, season: int) -> DataFrame:
    """Mean absolute seasonal difference of the past, the scale of MASE and MSIS."""
    w = W.partitionBy(*by).orderBy(order)
    return rows.withColumn("_d", F.abs(F.col(value) - F.lag(value, season).over(w))).groupBy(*by).agg(F.avg("_d").alias("scale"))


def evaluated(windows: DataFrame, forecasts: DataFrame, keys: Sequence[str], by: Sequence[str], season: int) -> DataFrame:
    """All eleven metrics of quantile forecasts against windows with ``past`` and ``label``."""
    m = F.size("past") - season
    past = F.zip_with(F.slice("past", season + 1, F.greatest(F.lit(0), m)), F.slice("past", 1, F.greatest(F.lit(0), m)), lambda a, b: F.abs(a - b))
    scale = F.aggregate(F.filter(past, lambda x: x.isNotNull()), F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n")), lambda a, x: F.struct((a["s"] + x).alias("s"), (a["n"] + 1).alias("n")), lambda a: F.try_divide(a["s"], a["n"]))
    labels = windows.withColumn("scale", scale).select(*dict.fromkeys([*keys, *by]), "scale", F.posexplode("label").alias("_i", "y")).withColumn("step", F.col("_i") + 1).drop("_i")
    joined = labels.join(forecasts, [*keys, "step"]).withColumn("level", F.round("level", 6))
    levels = [round(x, 6) for x in LEVELS]
    wide = joined.groupBy(*dict.fromkeys([*keys, *by]), "scale", "step", "y").pivot("level", levels).agg(F.first("value"))
    names = {x: f"q{i}" for i, x in enumerate(levels)}
    wide = wide.toDF(*[c if c not in map(str, levels) else names[float(c)] for c in wide.columns])
    mean = sum((F.col(c) for c in names.values()), F.lit(0.0)) / len(names)
    wide = wide.withColumns({"f": F.col(names[0.5]), "mean": mean, "q_low": at_level(names, ALPHA / 2), "q_high": at_level(names, 1 - ALPHA / 2)})
    out = point_metrics(wide, by, mean="mean").join(interval_score(wide, by), list(by)) if by else point_metrics(wide, mean="mean").crossJoin(interval_score(wide))
    loss = quantile_loss(joined, by)
    return out.join(loss, list(by)) if by else out.crossJoin(loss)

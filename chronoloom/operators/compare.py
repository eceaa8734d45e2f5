"""Comparison of conditions: normalised errors, geometric means, ranks, paired tests."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoloom.functions.numeric import geometric_mean, is_close, ratio
from chronoloom.operators.relational import best_of_group, long_form, rank_when_known, top_k, wide_form

#: Error columns that results are compared by, and their names in tables.
ERRORS = {"mean_weighted_sum_quantile_loss": "crps", "MASE[0.5]": "mase"}


def normalised(results: DataFrame, baseline: DataFrame, keys: Sequence[str] = ("dataset",), errors: Mapping[str, str] = ERRORS) -> DataFrame:
    """``results`` with each error divided by the baseline's of the same task; tasks without a baseline go."""
    base = baseline.select(*keys, *[F.col(f"`{e}`").alias(f"_{n}") for e, n in errors.items()])
    out = results.join(base, list(keys))
    return out.withColumns({n: ratio(F.col(f"`{e}`"), F.col(f"_{n}")) for e, n in errors.items()}).drop(*[f"_{n}" for n in errors.values()])


def scores(df: DataFrame, by: Sequence[str], errors: Sequence[str] = ("crps", "mase"), task: str = "dataset") -> DataFrame:
    """Number of tasks and the geometric mean of each error over them."""
    return df.groupBy(*by).agg(F.count_distinct(task).alias("n_tasks"), *[geometric_mean(F.col(e)).alias(e) for e in errors])


def ranked(df: DataFrame, within: Sequence[str] = (), errors: Sequence[str] = ("crps", "mase")) -> DataFrame:
    """Ranks by each error within groups, and their mean."""
    out = df.withColumns({f"{e}_rank": rank_when_known(within, e) for e in errors})
    total = sum((F.col(f"{e}_rank") for e in errors), F.lit(0))
    return out.withColumn("mean_rank", total / len(errors))


def over_seeds(df: DataFrame, by: Sequence[str], errors: Sequence[str] = ("crps", "mase"), seed: str = "seed") -> DataFrame:
    """Mean and sample deviation over seeds of what ``scores`` gives for each seed (0 for one seed).

    Two stages on purpose: a mean of geometric means is not the geometric mean of all.
    """
    aggs: list[Column] = [F.count_distinct(seed).alias("n_seeds")]
    for e in errors:
        aggs += [F.avg(e).alias(f"{e}_mean"), F.coalesce(F.stddev_samp(e), F.lit(0.0)).alias(f"{e}_std")]
    return df.groupBy(*by).agg(*aggs)


def marked_best(df: DataFrame, within: Sequence[str], value: str, name: str = "best") -> DataFrame:
    """Whether a row has its group's smallest value, but for rounding."""
    return df.withColumn(name, F.coalesce(is_close(F.col(value), F.min(value).over(W.partitionBy(*within))), F.lit(False)))


def pairs(df: DataFrame, label: str, a: str, b: str, keys: Sequence[str], error: str) -> DataFrame:
    """Log ratios d = ln(error of a) - ln(error of b) of the tasks that both have, both positive."""
    left = df.where(F.col(label) == a).select(*keys, F.col(error).alias("_a"))
    right = df.where(F.col(label) == b).select(*keys, F.col(error).alias("_b"))
    return left.join(right, list(keys)).where("_a > 0 AND _b > 0").select(*keys, (F.ln("_a") - F.ln("_b")).alias("d"))


def paired_summary(d: DataFrame) -> DataFrame:
    """(n_pairs, rel_delta, win_rate) of log ratios; below 0 the first is better."""
    return d.agg(F.count("d").alias("n_pairs"), (F.exp(F.avg("d")) - 1).alias("rel_delta"), F.avg((F.col("d") < 0).cast("double")).alias("win_rate"))


#: Weights made at a time.
PART = 1_000_000


def bootstrap(d: DataFrame, order: Sequence[str], resamples: int = 10_000, seed: int = 42, by: Sequence[str] = (), level: float = 0.95) -> DataFrame:
    """Percentile interval of the mean log ratio by resampling, as relative change, for each group.

    Rows are taken in ``order`` and drawn by numpy's generator, so results repeat exactly. A
    group is one comparison, a row for each task, and takes resamples * rows * 16 bytes in one task
    (47 MB for 291 rows); for log ratios without
    such a bound there is ``poisson_bootstrap``.
    """
    low, high = 50 * (1 - level), 50 * (1 + level)

    def draw(rows: pd.DataFrame) -> pd.DataFrame:
        x = rows.sort_values(list(order))["d"].to_numpy(float)
        rng = np.random.default_rng(seed)
        means = x[rng.integers(0, len(x), size=(resamples, len(x)))].mean(axis=1)
        ends = np.exp(np.percentile(means, [low, high])) - 1
        head = {c: rows[c].iloc[0] for c in by}
        return pd.DataFrame([head | {"n_pairs": len(x), "rel_delta": float(np.exp(x.mean()) - 1), "ci_low": ends[0], "ci_high": ends[1], "p_a_better": float((means < 0).mean()), "win_rate": float((x < 0).mean())}])

    kinds = "".join(f"{c} {d.schema[c].dataType.simpleString()}, " for c in by)
    grouped = d.groupBy(*by) if by else d.groupBy(F.lit(0).alias("_all"))
    return grouped.applyInPandas(draw, f"{kinds}n_pairs long, rel_delta double, ci_low double, ci_high double, p_a_better double, win_rate double")


def poisson_bootstrap(d: DataFrame, key: Sequence[str], resamples: int = 1000, seed: int = 42, level: float = 0.95) -> DataFrame:
    """The same interval without gathering rows: each row draws a Poisson(1) weight for every resample.

    Weights are made of the key's hash and the resample's number, all of a batch at once, so they
    depend on no partitioning. Partitions send one sum and one count for each resample, whatever
    their size; a batch takes ``PART`` weights of eight bytes at a time.
    """
    bounds = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(20)])
    odd = np.uint64(0x9E3779B97F4A7C15)

    def mixed(h: np.ndarray) -> np.ndarray:
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
        return h ^ (h >> np.uint64(31))

    def weigh(batches):
        total, count = np.zeros(resamples), np.zeros(resamples)
        of = mixed(np.arange(1, resamples + 1, dtype=np.uint64) * odd + np.uint64(seed))
        for batch in batches:
            h, x = batch["h"].to_numpy().view(np.uint64), batch["d"].to_numpy(float)
            for a in range(0, len(h), max(1, PART // resamples)):
                b = a + max(1, PART // resamples)
                w = np.searchsorted(bounds, mixed(h[a:b, None] ^ of[None]) / 2.0**64, "right").astype(float)
                total += x[a:b] @ w
                count += w.sum(0)
        yield pd.DataFrame({"r": np.arange(resamples), "s": total, "n": count})

    sums = d.where("d IS NOT NULL").select(F.xxhash64(*key).alias("h"), "d").mapInPandas(weigh, "r long, s double, n double").groupBy("r").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    means = sums.select(F.try_divide("s", "n").alias("m"))
    return means.agg((F.exp(F.percentile("m", (1 - level) / 2)) - 1).alias("ci_low"), (F.exp(F.percentile("m", (1 + level) / 2)) - 1).alias("ci_high"), F.avg((F.col("m") < 0).cast("double")).alias("p_a_better"))


def against_second_and_anchors(ranking: DataFrame, label: str, anchors: Sequence[str], rank: str = "crps_rank") -> DataFrame:
    """(a, b): the best label against the second and against each anchor."""
    row = ranking.groupBy().agg(F.min_by(label, F.struct(rank, label)).alias("a"), F.array_sort(F.collect_list(F.struct(rank, label)))[1][label].alias("b"))
    rest = F.explode(F.array_distinct(F.array(F.col("b"), *[F.lit(x) for x in anchors])))
    return row.select("a", rest.alias("b")).where("a <> b")


def winners(df: DataFrame, cells: Sequence[str], family: str, condition: str, errors: Sequence[str] = ("crps", "mase")) -> DataFrame:
    """Cells each condition wins (smallest mean error) for each family and error, with their share."""
    long = long_form(df, [*cells, family, condition], errors, "metric", "score")
    means = long.groupBy(*cells, family, "metric", condition).agg(F.avg("score").alias("score"))
    first = best_of_group(means, [*cells, family, "metric"], "score", [condition])
    out = first.groupBy(family, "metric", condition).agg(F.count(F.lit(1)).alias("wins"))
    return out.withColumn("share", F.col("wins") / F.sum("wins").over(W.partitionBy(family, "metric")))


def domain_table(df: DataFrame, domain: str, condition: str, horizon: str, horizons: Sequence[str], k: int, anchors: Sequence[str], errors: Sequence[str] = ("crps", "mase"), task: str = "dataset") -> DataFrame:
    """Each domain's k best conditions and the anchors, with their errors for each horizon."""
    overall = ranked(scores(df, [domain, condition], errors, task), [domain], errors)
    rest = overall.where(~F.col(condition).isin(*anchors))
    picked = top_k(rest, [domain], [F.col("mean_rank").asc_nulls_last(), F.col(condition)], k).unionByName(overall.where(F.col(condition).isin(*anchors)))
    wide = wide_form(scores(df, [domain, condition, horizon], errors, task), [domain, condition], horizon, horizons, {e: e.upper() for e in errors})
    return picked.join(wide, [domain, condition], "left")


def composition_table(df: DataFrame, domain: str, condition: str, horizon: str, error: str = "crps", task: str = "dataset", seed: str = "seed") -> DataFrame:
    """Mean and deviation over seeds of the geometric mean in each domain and horizon, best ones marked."""
    per_seed = scores(df, [domain, condition, horizon, seed], [error], task)
    return marked_best(over_seeds(per_seed, [domain, condition, horizon], [error], seed), [domain, horizon], f"{error}_mean")

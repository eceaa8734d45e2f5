"""Deterministic sampling, stratified allocation and mixing of corpora.

Draws are hashes of keys and a seed: they depend on no partitioning, and any
engine with md5 repeats them.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoloom.functions.numeric import stable_hash, stable_uniform
from chronoloom.operators.relational import prefix_sum

# Fixed values of the reference corpus.
LENGTH, MOST_WINDOWS = 1024, 8
FLOOR, SHARE_CAP, ROUNDS = 10_000, 0.5, 10
OVERSAMPLE, LEAST_PAST, MOST_MISSING = 3, 60, 0.9
TOKENS, TOKEN_LIMIT = 4096, 15.0
#: Bins whose room is packed in one go.
SHARE_BINS = 64


def fixed_size_sample(df: DataFrame, n: int, key: Sequence[str], seed: int = 0) -> DataFrame:
    """n rows, the same in every run: those with the smallest hashes. Tasks keep n rows each, no full sort."""
    return df.withColumn("_h", stable_hash(*[F.col(k) for k in key], F.lit(seed))).orderBy("_h", *key).limit(n).drop("_h")


def random_halves(df: DataFrame, key: Sequence[str], seed: int = 0, name: str = "half") -> DataFrame:
    """Each row's half (1 or 2), by the rank of its hash; the halves differ by one row at most."""
    hashed = df.withColumn("_h", stable_hash(*[F.col(k) for k in key], F.lit(seed)))
    n = hashed.count()
    ranked = prefix_sum(hashed, "_h", F.lit(1), "_rank")
    return ranked.withColumn(name, F.when(F.col("_rank") < (n + 1) // 2, F.lit(1)).otherwise(F.lit(2)).cast("long")).drop("_h", "_rank")


def evenly_spaced(df: DataFrame, order: str, n: int) -> DataFrame:
    """Up to n rows at even distances in the order of a numeric column, first and last included."""
    total, step = df.count(), max(1, n - 1)
    numbered = prefix_sum(df, order, F.lit(1), "_i")
    # row i is the k-th pick if i = floor(k * (rows - 1) / (n - 1)) for some k
    k = F.ceil(F.col("_i") * step / max(1, total - 1))
    hit = (F.floor(k * (total - 1) / step) == F.col("_i")) & (k <= step) if total > n else F.lit(True)
    return numbered.where(hit).drop("_i")


def drawn_rows(df: DataFrame, index: str, n_draws: int, total: int, seed: int = 0) -> DataFrame:
    """The distinct rows that n_draws uniform draws with replacement hit."""
    spark = df.sparkSession
    draws = spark.range(n_draws).select((stable_hash(F.col("id"), F.lit(seed)) % total).alias(index)).distinct()
    return df.join(draws, index, "left_semi")


def supply(index: DataFrame, length: int = LENGTH, most: int = MOST_WINDOWS) -> DataFrame:
    """Datasets with series long enough on average, and the windows they can give."""
    per_series = F.when(F.col("mean_series_len") > length, F.least(F.greatest(F.lit(1), F.floor(F.col("mean_series_len") / length)), F.lit(most))).otherwise(F.lit(1))
    return index.where(F.col("mean_series_len") >= length).withColumn("windows_per_series", per_series.cast("long")).withColumn("supply", F.col("n_series") * F.col("windows_per_series"))


def strata(supplied: DataFrame) -> DataFrame:
    """Observations, share of all and supply of each (freq, domain)."""
    out = supplied.groupBy("freq", "domain").agg(F.sum("total_obs").alias("obs"), F.sum("supply").alias("supply"))
    return out.withColumn("share", F.col("obs") / F.sum("obs").over(W.partitionBy()))


def _largest_remainders(exact: np.ndarray, total: int, room: np.ndarray) -> np.ndarray:
    """Whole numbers below ``room`` that add up to ``total`` as far as the room goes, nearest to ``exact``."""
    base = np.minimum(np.floor(exact + 1e-9), room).astype(np.int64)
    for i in np.argsort(-(exact - base), kind="stable"):
        if base.sum() >= total:
            break
        base[i] += base[i] < room[i]
    left = total - base.sum()
    # what rounding could not place goes to the largest headroom
    for i in np.argsort(-(room - base), kind="stable"):
        step = int(min(left, room[i] - base[i]))
        if step <= 0:
            break
        base[i] += step
        left -= step
    return base


def _capped_shares(weights: np.ndarray, total: float, cap: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """``total`` split by ``weights`` with a cap on each part; what is over goes to the uncapped in proportion."""
    out = np.zeros(len(weights))
    free = np.ones(len(weights), bool)
    for _ in range(rounds):
        rest = total - out[~free].sum()
        if not free.any() or weights[free].sum() <= 0:
            break
        out[free] = rest * weights[free] / weights[free].sum()
        over = free & (out > cap)
        if not over.any():
            break
        out[over] = cap[over]
        free &= ~over
    return np.minimum(out, cap)


def allocate(index: pd.DataFrame, total: int, floor: int = FLOOR, share_cap: float = SHARE_CAP) -> pd.DataFrame:
    """How many windows each dataset gives: (name, freq, domain, supply, count, weight).

    Strata get their share of observations but ``floor`` at least, as far as supply goes, in
    whole numbers by largest remainders; within a stratum a dataset gets its share, at most
    ``share_cap`` of the stratum where others can fill it. What is still missing goes where most
    is left. ``weight`` is the share of observations over the share of windows. The table has a
    row for each dataset of an index, so it is handled on the driver.
    """
    index = index.sort_values("name").reset_index(drop=True)
    groups = list(index.groupby(["freq", "domain"], sort=True).groups.items())
    obs = np.array([index.loc[rows, "total_obs"].sum() for _, rows in groups], float)
    room = np.array([index.loc[rows, "supply"].sum() for _, rows in groups], np.int64)
    total = int(min(total, room.sum()))
    wanted = np.maximum(obs / obs.sum() * total, floor)
    wanted *= total / wanted.sum()
    per_stratum = _largest_remainders(_capped_shares(wanted, total, room.astype(float)), total, room)
    count = np.zeros(len(index), np.int64)
    for (_, rows), n in zip(groups, per_stratum, strict=True):
        weights, own = index.loc[rows, "total_obs"].to_numpy(float), index.loc[rows, "supply"].to_numpy(np.int64)
        cap = np.minimum(own, np.ceil(share_cap * n)) if len(rows) > 1 else own
        if cap.sum() < n:
            cap = own
        count[rows] = _largest_remainders(_capped_shares(weights, float(n), cap.astype(float)), int(n), cap.astype(np.int64))
    out = index.assign(count=count)
    short = total - count.sum()
    for i in (out["supply"] - out["count"]).sort_values(ascending=False, kind="stable").index:
        step = int(min(short, out.loc[i, "supply"] - out.loc[i, "count"]))
        out.loc[i, "count"] += step
        short -= step
    share = out["total_obs"] / out["total_obs"].sum()
    out["weight"] = (share / (out["count"] / max(1, out["count"].sum()))).where(out["count"] > 0, 0.0)
    return out[["name", "freq", "domain", "supply", "count", "weight"]]


def accepted(windows: DataFrame, allocation: DataFrame, dataset: str = "dataset", key: Sequence[str] = ("item_id", "window_index"), seed: int = 0, oversample: int = OVERSAMPLE) -> DataFrame:
    """Of each dataset's clean windows as many as allocated, those with the smallest hashes.

    A bound on the hash, ``oversample`` times the share that is needed, goes before the ranking, so
    a very large dataset sorts little more than it gives; backfill takes what the bound left short.
    """
    hashed = windows.join(allocation.select(F.col("name").alias(dataset), "count", "supply"), dataset).withColumn("_u", stable_uniform(*[F.col(k) for k in (dataset, *key)], F.lit(seed)))
    near = hashed.where(F.col("_u") <= oversample * F.col("count") / F.col("supply"))
    ranked = near.withColumn("_rn", F.row_number().over(W.partitionBy(dataset).orderBy("_u", *key)))
    return ranked.where(F.col("_rn") <= F.col("count")).drop("_rn", "_u", "count", "supply")


def backfilled(taken: DataFrame, windows: DataFrame, allocation: DataFrame, total: int, dataset: str = "dataset", key: Sequence[str] = ("item_id", "window_index"), seed: int = 1) -> DataFrame:
    """``taken`` with more windows: first of datasets that are short, then of any, up to ``total``; ``pass`` tells which."""
    keys = [dataset, *key]
    have = taken.groupBy(dataset).agg(F.count(F.lit(1)).alias("have"))
    need = allocation.select(F.col("name").alias(dataset), "count").join(have, dataset, "left").withColumn("need", F.col("count") - F.coalesce("have", F.lit(0)))
    rest = windows.join(taken.select(*keys), keys, "left_anti").withColumn("_h", stable_hash(*[F.col(k) for k in keys], F.lit(seed)))
    first = rest.join(need.where("need > 0").select(dataset, "need"), dataset).withColumn("_rn", F.row_number().over(W.partitionBy(dataset).orderBy("_h", *key)))
    first = first.where(F.col("_rn") <= F.col("need")).drop("_rn", "need")
    out = taken.withColumn("pass", F.lit(0)).unionByName(first.drop("_h").withColumn("pass", F.lit(1)))
    missing = total - out.count()
    if missing > 0:
        second = rest.join(first.select(*keys), keys, "left_anti").orderBy("_h", *keys).limit(missing)
        out = out.unionByName(second.drop("_h").withColumn("pass", F.lit(2)))
    return out


def accounting(taken: DataFrame, allocation: DataFrame, dataset: str = "dataset") -> DataFrame:
    """Allocated, collected and missing windows of each dataset, and the totals in a row without a name."""
    have = taken.groupBy(dataset).agg(F.count(F.lit(1)).alias("collected"), F.sum((F.col("pass") > 0).cast("long")).alias("backfilled"))
    rows = allocation.select(F.col("name").alias(dataset), F.col("count").alias("allocated")).join(have, dataset, "left").na.fill(0, ["collected", "backfilled"])
    rows = rows.withColumn("shortfall", F.greatest(F.lit(0), F.col("allocated") - F.col("collected")))
    return rows.rollup(dataset).agg(*[F.sum(c).alias(c) for c in ("allocated", "collected", "backfilled", "shortfall")])


def replicated(df: DataFrame, corpus: str, repeats: Mapping[str, int]) -> DataFrame:
    """Each corpus' rows as often as its number says, ``copy`` from 1."""
    times = F.create_map(*[F.lit(x) for kv in repeats.items() for x in kv])[F.col(corpus)]
    return df.withColumn("_n", times).where("_n > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_n")))).drop("_n")


def choose(weights: Mapping[str, float], u: Column) -> Column:
    """The label whose share of the unit interval holds ``u``; the first share begins at 0."""
    total, below, cases = sum(weights.values()), 0.0, None
    for label, w in weights.items():
        below += w / total
        cases = F.when(u < below, label) if cases is None else cases.when(u < below, label)
    return cases.otherwise(list(weights)[-1])


def mixture(n: int, df: DataFrame, corpus: str, key: str, weights: Mapping[str, float], seed: int = 0) -> DataFrame:
    """n draws: a corpus by weight, then a row of it, both by hash; ``draw`` from 0.

    Corpora are numbered once; draws join on (corpus, number), so none is gathered.
    """
    numbered = prefix_sum(df, key, F.lit(1), "_i", [corpus]).withColumn("_i", F.col("_i").cast("long"))
    sizes = df.groupBy(corpus).agg(F.count(F.lit(1)).alias("_n"))
    draws = df.sparkSession.range(n).select(F.col("id").alias("draw"), choose(weights, stable_uniform(F.col("id"), F.lit(seed))).alias(corpus))
    draws = draws.join(sizes, corpus).withColumn("_i", stable_hash(F.col("draw"), F.lit(seed), F.lit("row")) % F.col("_n")).drop("_n")
    return draws.join(numbered, [corpus, "_i"]).drop("_i")


def shuffled(df: DataFrame, key: Sequence[str], seed: int = 0) -> DataFrame:
    """The rows in an order that depends on keys and seed alone."""
    return df.orderBy(stable_hash(*[F.col(k) for k in key], F.lit(seed)), *key)


def long_enough(df: DataFrame, target: str = "target", least: int = LEAST_PAST, most_missing: float = MOST_MISSING) -> DataFrame:
    """Series with ``least`` values and no larger share missing than ``most_missing``."""
    missing = F.size(F.filter(target, lambda x: x.isNull()))
    return df.where((F.size(target) >= least) & (missing <= most_missing * F.size(target)))


def tokens(df: DataFrame, target: str = "target", n: int = TOKENS, limit: float = TOKEN_LIMIT) -> DataFrame:
    """Values over the mean absolute value, in n even bins between -limit and limit; NULL stays."""
    mean = F.aggregate(target, F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n")), lambda a, x: F.when(x.isNull(), a).otherwise(F.struct((a["s"] + F.abs(x)).alias("s"), (a["n"] + 1).alias("n"))), lambda a: F.try_divide(a["s"], a["n"]))
    scaled = df.withColumn("scale", F.when(mean > 0, mean).otherwise(F.lit(1.0)))
    bin_ = lambda x: F.least(F.lit(n - 1), F.greatest(F.lit(0), F.floor((x / F.col("scale") + limit) / (2 * limit) * n))).cast("int")
    return scaled.withColumn("tokens", F.transform(target, bin_))


def packed(df: DataFrame, length: str, order: str, room: int, share: int = SHARE_BINS) -> DataFrame:
    """``bin`` and ``position`` of sequences packed in order into bins of ``room``; none is overfull.

    Sequences are dealt into shares of ``share`` bins' room by the sums of the lengths before, and each
    share is packed on its own: a sequence goes into the last bin if it fits there, else into a new one.
    A sequence longer than a bin has one of its own, the only kind that is overfull. Bins of a share
    follow each other, ``bin`` is 4 * share * (number of the share) + the bin's number in it.
    """
    laid = prefix_sum(df, order, F.col(length), "_laid").withColumn("_share", F.floor(F.col("_laid") / (room * share)).cast("long")).drop("_laid")
    names = [c for c in laid.columns if c != "_share"]
    schema = T.StructType([laid.schema[c] for c in names] + [T.StructField("bin", T.LongType()), T.StructField("position", T.LongType())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, at, used = None, 0, 0
        for batch in batches:
            bins, places = [], []
            for k, n in zip(batch.column("_share").to_pylist(), batch.column(length).to_pylist(), strict=True):
                if k != own:
                    own, at, used = k, 0, 0
                elif used + n > room:
                    at, used = at + 1, 0
                bins.append(4 * share * k + at)
                places.append(used)
                used += n
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(bins, pa.int64()), pa.array(places, pa.int64())], names=[*names, "bin", "position"])

    return laid.repartition("_share").sortWithinPartitions("_share", order).mapInArrow(pack, schema)

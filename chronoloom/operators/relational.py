"""Joins, set operations, ranking and reshaping that the tables of results need."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def tagged(df: DataFrame, **values: object) -> DataFrame:
    """``df`` with constant columns."""
    return df.withColumns({name: v if isinstance(v, Column) else F.lit(v) for name, v in values.items()})


def union_all(*frames: DataFrame) -> DataFrame:
    """All rows; columns are matched by name, missing ones are NULL."""
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def union_distinct(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def without(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    """Rows of ``a`` whose keys ``b`` lacks: a set difference, or what a resumed run has left to do."""
    return a.join(b.select(*keys), list(keys), "left_anti")


def only_in(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    """Rows of ``a`` whose keys ``b`` has."""
    return a.join(b.select(*keys), list(keys), "left_semi")


def looked_up(a: DataFrame, b: DataFrame, keys: Sequence[str], defaults: Mapping[str, object]) -> DataFrame:
    """``a`` with ``b``'s columns in ``defaults``, and the defaults where ``b`` has no row."""
    out = a.join(b.select(*keys, *defaults), list(keys), "left")
    return out.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in defaults.items()})


def grouped_lookup(a: DataFrame, a_keys: Sequence[str], b: DataFrame, b_keys: Sequence[str], name: str, amount: str, many: str | None = None) -> DataFrame:
    """``a`` with what of ``b`` matches it: names joined by "; ", their number and the sum of ``amount``.

    ``many`` is a key of ``a`` that holds an array, each element of which may match. ``b`` is
    summed before the join, so a row of ``a`` meets one row for each key.
    """
    per_key = b.groupBy(*b_keys).agg(F.collect_list(F.struct(F.col(name).alias("name"), F.col(amount).alias("amount"))).alias("_found"))
    wide = a.withColumn("_row", F.monotonically_increasing_id())
    keyed = wide.select("_row", *[F.explode(k).alias(f"_{k}") if k == many else F.col(k).alias(f"_{k}") for k in a_keys])
    on = [F.col(f"_{x}") == F.col(y) for x, y in zip(a_keys, b_keys, strict=True)]
    hits = keyed.join(per_key, on, "left").groupBy("_row").agg(F.array_sort(F.flatten(F.collect_list("_found"))).alias("_found"))
    out = wide.join(hits, "_row", "left").withColumn("_found", F.coalesce("_found", F.array()))
    total = F.aggregate("_found", F.lit(0).cast("long"), lambda s, x: s + x["amount"])
    return out.select(*[f"`{c}`" for c in a.columns], F.array_join("_found.name", "; ").alias("matches"), F.size("_found").cast("long").alias("n_matches"), total.alias("amount"))


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, rank: str | None = None) -> DataFrame:
    """The first k rows of each group; ``order`` should be total."""
    out = df.withColumn("_rn", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("_rn") <= k)
    return out.withColumnRenamed("_rn", rank) if rank else out.drop("_rn")


def best_of_group(df: DataFrame, by: Sequence[str], value: str, ties: Sequence[str]) -> DataFrame:
    """The row with the smallest value of each group, by one aggregation without a sort."""
    rest = [c for c in df.columns if c not in by]
    picked = df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.min_by(F.struct(*rest), F.struct(value, *ties)).alias("_x"))
    return picked.select(*by, "_x.*").select(*df.columns)


def running_offset(df: DataFrame, order: Sequence[str], count: str, name: str = "offset") -> DataFrame:
    """Sum of ``count`` over the rows before, for tables of groups: few rows, ordered as a whole."""
    w = W.orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn(name, (F.sum(count).over(w) - F.col(count)).cast("long"))


def prefix_sum(df: DataFrame, order: str, value: Column, name: str, by: Sequence[str] = (), buckets: int = 256) -> DataFrame:
    """Sum of ``value`` over the rows before in the order of a numeric column, for tables of any size."""
    return prefix_sums(df, order, {name: value}, by, buckets)


def prefix_sums(df: DataFrame, order: str, values: Mapping[str, Column], by: Sequence[str] = (), buckets: int = 256) -> DataFrame:
    """The same for several values at once.

    Rows are cut into ranges of the column by approximate quantiles, of each group where there
    are groups. A task sums along one range of one group, the ranges' totals are summed in a
    table of one row for each, and no task sees a group or the table as a whole. Equal values of
    the column are not split.
    """
    edges = F.percentile_approx(order, [i / buckets for i in range(1, buckets)], 10 * buckets)
    at = F.size(F.filter(F.array_distinct(F.coalesce("_edges", F.array())), lambda c: c < F.col(order)))
    if by:
        # a row for each group
        cuts = df.groupBy(*by).agg(edges.alias("_edges")).withColumnsRenamed({k: f"_g{i}" for i, k in enumerate(by)})
        rows = df.join(cuts, [F.col(k).eqNullSafe(F.col(f"_g{i}")) for i, k in enumerate(by)]).drop(*[f"_g{i}" for i in range(len(by))])
    else:
        rows = df.crossJoin(F.broadcast(df.agg(edges.alias("_edges"))))  # one row
    names = list(values)
    rows = rows.withColumn("_bucket", at).drop("_edges").withColumns({f"_value{i}": values[n] for i, n in enumerate(names)})
    keys = [*by, "_bucket"]
    totals = rows.groupBy(*keys).agg(*[F.sum(f"_value{i}").alias(f"_total{i}") for i in range(len(names))])
    before = W.partitionBy(*by).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[F.coalesce(F.sum(f"_total{i}").over(before), F.lit(0)).alias(f"_before{i}") for i in range(len(names))])
    inside = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumns({f"_inside{i}": F.coalesce(F.sum(f"_value{i}").over(inside), F.lit(0)) for i in range(len(names))})
    out = rows.join(totals, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    out = out.withColumns({n: F.col(f"_before{i}") + F.col(f"_inside{i}") for i, n in enumerate(names)})
    return out.drop("_bucket", *[f"_k{i}" for i in range(len(keys))], *[f"{c}{i}" for c in ("_value", "_before", "_inside") for i in range(len(names))])


def rank_when_known(by: Sequence[str], value: str) -> Column:
    """Rank within the group, smallest first, ties alike; NULL stays unranked."""
    w = W.partitionBy(*by).orderBy(F.col(value).asc_nulls_last())
    return F.when(F.col(value).isNotNull(), F.rank().over(w).cast("long"))


def position_in(order: Sequence[str], c: Column, otherwise: int = 99) -> Column:
    """Sort key for a fixed order of labels; others come last."""
    at = F.array_position(F.array(*[F.lit(x) for x in order]), c)
    return F.when(at > 0, at).otherwise(F.lit(otherwise)).cast("long")


def long_form(df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str, value: str) -> DataFrame:
    return df.unpivot(list(ids), list(values), name, value)


def wide_form(df: DataFrame, by: Sequence[str], column: str, labels: Sequence[str], values: Mapping[str, str]) -> DataFrame:
    """``label_NAME`` for each label and value column; the labels are given, so no job looks for them."""
    return df.groupBy(*by).pivot(column, list(labels)).agg(*[F.first(c, ignorenulls=True).alias(n) for c, n in values.items()])


def with_columns_or(df: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """``df`` with columns it lacks, and their defaults for missing values."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) if c in df.columns else F.lit(v) for c, v in defaults.items()})

"""Registered queries on comparison, joins, set operations, reshaping and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoloom.functions import text
from chronoloom.functions.numeric import clip, is_close, ratio, round_half_even, signed_log1p, zero_for_missing
from chronoloom.operators import compare, relational
from chronoloom.operators.coverage import coverage_method
from chronoloom.sources.readers import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results shaped like evaluations: dataset = nation, domain = region, condition = brand, two errors."""
    line, part, supp = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    rows = line.join(part, F.col("l_partkey") == F.col("p_partkey")).join(supp, F.col("l_suppkey") == F.col("s_suppkey")).join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupBy(F.col("n_name").alias("dataset"), F.col("r_name").alias("domain"), F.col("p_brand").alias("condition")).agg(F.avg(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("e1"), F.avg("l_quantity").alias("e2"))


TASKS = """
raw AS (SELECT n_name AS dataset, r_name AS domain, p_brand AS condition, avg(l_extendedprice * (1 - l_discount)) AS e1, avg(l_quantity) AS e2
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  GROUP BY n_name, r_name, p_brand),
base AS (SELECT dataset, avg(e1) AS b1, avg(e2) AS b2 FROM raw GROUP BY dataset),
tasks AS (SELECT dataset, domain, condition, e1 / nullif(b1, 0) AS crps, e2 / nullif(b2, 0) AS mase FROM raw JOIN base USING (dataset))"""

GM = "round(exp(avg(CASE WHEN {0} > 0 THEN ln({0}) END)), 6) AS {0}"


def normalised_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = tasks(spark, sf_dir)
    base = raw.groupBy("dataset").agg(F.avg("e1").alias("e1"), F.avg("e2").alias("e2"))
    return compare.normalised(raw, base, ["dataset"], {"e1": "crps", "e2": "mase"})


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query(f"""WITH {TASKS},
s AS (SELECT condition, count(DISTINCT dataset) AS n_tasks, {GM.format('crps')}, {GM.format('mase')} FROM tasks GROUP BY condition),
r AS (SELECT *, rank() OVER (ORDER BY crps) AS crps_rank, rank() OVER (ORDER BY mase) AS mase_rank FROM s)
SELECT *, ((crps_rank + mase_rank) / 2.0)::DOUBLE AS mean_rank FROM r""")
def condition_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.ranked(rounded(compare.scores(normalised_tasks(spark, sf_dir), ["condition"]), "crps", "mase"))


@query(f"""WITH {TASKS},
s AS (SELECT domain, condition, count(DISTINCT dataset) AS n_tasks, {GM.format('crps')}, {GM.format('mase')} FROM tasks GROUP BY domain, condition)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY crps, condition) AS rank FROM s) WHERE rank <= 3""")
def topk_per_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = rounded(compare.scores(normalised_tasks(spark, sf_dir), ["domain", "condition"]), "crps", "mase")
    return relational.top_k(s, ["domain"], [F.col("crps"), F.col("condition")], 3, "rank").withColumn("rank", F.col("rank").cast("long"))


@query(f"""WITH {TASKS}, d AS (SELECT ln(a.crps) - ln(b.crps) AS d FROM tasks a JOIN tasks b USING (dataset) WHERE a.condition = 'Brand#11' AND b.condition = 'Brand#12' AND a.crps > 0 AND b.crps > 0)
SELECT count(d) AS n_pairs, round(exp(avg(d)) - 1, 6) AS rel_delta, round(avg((d < 0)::INT::DOUBLE), 6) AS win_rate FROM d""")
def paired_log_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = compare.pairs(normalised_tasks(spark, sf_dir), "condition", "Brand#11", "Brand#12", ["dataset"], "crps")
    return rounded(compare.paired_summary(d), "rel_delta", "win_rate")


@query()
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = normalised_tasks(spark, sf_dir)
    return compare.bootstrap(compare.pairs(rows, "condition", "Brand#11", "Brand#12", ["dataset"], "crps"), ["dataset"])


@query()
def poisson_bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = normalised_tasks(spark, sf_dir)
    return compare.poisson_bootstrap(compare.pairs(rows, "condition", "Brand#11", "Brand#12", ["dataset"], "crps"), ["dataset"])


@query(f"""WITH {TASKS}, l AS (UNPIVOT (SELECT domain, condition, crps, mase FROM tasks) ON crps, mase INTO NAME metric VALUE score),
m AS (SELECT domain, metric, condition, round(avg(score), 9) AS score FROM l GROUP BY ALL),
w AS (SELECT domain, metric, arg_min(condition, (score, condition)) AS condition FROM m GROUP BY domain, metric)
SELECT 'all' AS family, metric, condition, count(*) AS wins, round(count(*) / sum(count(*)) OVER (PARTITION BY metric), 6)::DOUBLE AS share FROM w GROUP BY metric, condition""")
def unpivot_winners(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = relational.tagged(normalised_tasks(spark, sf_dir), family="all")
    return rounded(compare.winners(rows, ["domain"], "family", "condition"), "share")


@query("""SELECT o_orderpriority,
  round(first(CASE WHEN o_orderstatus = 'F' THEN t END) FILTER (o_orderstatus = 'F'), 2) AS "F_TOTAL", round(first(t) FILTER (o_orderstatus = 'O'), 2) AS "O_TOTAL", coalesce(round(first(t) FILTER (o_orderstatus = 'P'), 2), -1) AS "P_TOTAL",
  first(n) FILTER (o_orderstatus = 'F') AS "F_N", first(n) FILTER (o_orderstatus = 'O') AS "O_N", first(n) FILTER (o_orderstatus = 'P') AS "P_N", '--' AS note
FROM (SELECT o_orderpriority, o_orderstatus, avg(o_totalprice) AS t, count(*) AS n FROM orders GROUP BY ALL) GROUP BY o_orderpriority""")
def horizon_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.avg("o_totalprice").alias("t"), F.count(F.lit(1)).alias("n"))
    wide = relational.wide_form(rounded(cells, "t", digits=2), ["o_orderpriority"], "o_orderstatus", ["F", "O", "P"], {"t": "TOTAL", "n": "N"})
    return relational.with_columns_or(wide, {"P_TOTAL": -1.0, "note": "--"})


_SEEDED = """e AS (SELECT event_type AS condition, CASE WHEN hour(ts) < 8 THEN 'short' WHEN hour(ts) < 16 THEN 'medium' ELSE 'long' END AS horizon, user_id % 3 AS seed, event_id AS dataset, abs(value) + 1 AS crps FROM events),
s AS (SELECT condition, horizon, seed, count(DISTINCT dataset) AS n_tasks, exp(avg(CASE WHEN crps > 0 THEN ln(crps) END)) AS crps FROM e GROUP BY ALL),
m AS (SELECT condition, horizon, count(DISTINCT seed) AS n_seeds, avg(crps) AS crps_mean, coalesce(stddev_samp(crps), 0) AS crps_std FROM s GROUP BY ALL)"""


@query(f"""WITH {_SEEDED}, b AS (SELECT *, abs(crps_mean - min(crps_mean) OVER (PARTITION BY horizon)) <= 1e-12 + 1e-12 * abs(min(crps_mean) OVER (PARTITION BY horizon)) AS best FROM m)
SELECT condition, horizon, n_seeds, round(crps_mean, 6) AS crps_mean, round(crps_std, 6) AS crps_std, best, CASE horizon WHEN 'short' THEN 1 WHEN 'medium' THEN 2 WHEN 'long' THEN 3 ELSE 99 END::BIGINT AS place FROM b""")
def composition_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    hour = F.hour("ts")
    rows = e.select(F.col("event_type").alias("condition"), F.when(hour < 8, "short").when(hour < 16, "medium").otherwise("long").alias("horizon"), (F.col("user_id") % 3).alias("seed"), F.col("event_id").alias("dataset"), (F.abs("value") + 1).alias("crps"))
    per_seed = compare.scores(rows, ["condition", "horizon", "seed"], ["crps"])
    out = compare.marked_best(compare.over_seeds(per_seed, ["condition", "horizon"], ["crps"]), ["horizon"], "crps_mean")
    return rounded(out, "crps_mean", "crps_std").withColumn("place", relational.position_in(["short", "medium", "long"], F.col("horizon")))


@query(f"""WITH {_SEEDED} SELECT condition, horizon, CASE WHEN crps_mean IS NULL THEN '--' ELSE (CASE WHEN crps_mean <= 1.5 THEN '★ ' ELSE '' END) || printf('%.2f', crps_mean) || ' ± ' || printf('%.2f', crps_std) END AS cell,
  printf('%.1f', n_seeds / 4.0 * 100) || '%' AS pct, '[' || printf('%.3f', crps_mean - crps_std) || ', --]' AS ci FROM m""")
def formatted_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = compare.over_seeds(compare.scores(_seeded(spark, sf_dir), ["condition", "horizon", "seed"], ["crps"]), ["condition", "horizon"], ["crps"])
    mean, std = F.col("crps_mean"), F.col("crps_std")
    return m.select("condition", "horizon", text.mean_and_spread(mean, std, best=mean <= 1.5).alias("cell"), text.percent(F.col("n_seeds") / 4).alias("pct"), text.interval(mean - std, F.lit(None).cast("double")).alias("ci"))


def _seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    hour = F.hour("ts")
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("condition"), F.when(hour < 8, "short").when(hour < 16, "medium").otherwise("long").alias("horizon"), (F.col("user_id") % 3).alias("seed"), F.col("event_id").alias("dataset"), (F.abs("value") + 1).alias("crps"))


@query(f"""WITH {TASKS}, x AS (SELECT * REPLACE (CASE WHEN hash_half = 0 THEN 'short' ELSE 'long' END AS horizon) FROM (SELECT *, length(dataset) % 2 AS hash_half, '' AS horizon FROM tasks)),
s AS (SELECT domain, condition, count(DISTINCT dataset) AS n_tasks, exp(avg(CASE WHEN crps > 0 THEN ln(crps) END)) AS crps, exp(avg(CASE WHEN mase > 0 THEN ln(mase) END)) AS mase FROM x GROUP BY ALL),
r AS (SELECT *, rank() OVER (PARTITION BY domain ORDER BY crps) AS cr, rank() OVER (PARTITION BY domain ORDER BY mase) AS mr FROM s),
t AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY (cr + mr) / 2.0, condition) AS rn FROM r WHERE condition <> 'Brand#11'),
p AS (SELECT domain, condition, n_tasks, crps, mase, cr, mr FROM t WHERE rn <= 2 UNION ALL SELECT domain, condition, n_tasks, crps, mase, cr, mr FROM r WHERE condition = 'Brand#11'),
h AS (SELECT domain, condition, exp(avg(ln(crps)) FILTER (horizon = 'short')) AS s1, exp(avg(ln(mase)) FILTER (horizon = 'short')) AS s2, exp(avg(ln(crps)) FILTER (horizon = 'long')) AS l1, exp(avg(ln(mase)) FILTER (horizon = 'long')) AS l2 FROM x GROUP BY ALL)
SELECT domain, condition, n_tasks, round(crps, 6) AS crps, round(mase, 6) AS mase, cr AS crps_rank, mr AS mase_rank, ((cr + mr) / 2.0)::DOUBLE AS mean_rank, round(s1, 6) AS "short_CRPS", round(s2, 6) AS "short_MASE", round(l1, 6) AS "long_CRPS", round(l2, 6) AS "long_MASE" FROM p LEFT JOIN h USING (domain, condition)""")
def domain_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = normalised_tasks(spark, sf_dir).withColumn("horizon", F.when(F.length("dataset") % 2 == 0, "short").otherwise("long"))
    out = compare.domain_table(rows, "domain", "condition", "horizon", ["short", "long"], 2, ["Brand#11"])
    return rounded(out, "crps", "mase", *[f"{h}_{e}" for h in ("short", "long") for e in ("CRPS", "MASE")])


@query("""WITH d AS (SELECT r_regionkey, r_name, unnest(CASE r_regionkey WHEN 0 THEN [0, 1] WHEN 4 THEN []::INT[] ELSE [r_regionkey] END) AS k FROM region),
m AS (SELECT r_regionkey, n_name, n FROM d JOIN (SELECT n_name, n_regionkey, count(c_custkey) AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL) ON k = n_regionkey)
SELECT r_name, coalesce(string_agg(n_name, '; ' ORDER BY n_name), '') AS matches, count(n_name)::BIGINT AS n_matches, coalesce(sum(n), 0)::BIGINT AS amount, CASE WHEN coalesce(sum(n), 0) >= 500 THEN 'PRDC' ELSE 'centroid' END AS method FROM region LEFT JOIN m USING (r_regionkey) GROUP BY r_regionkey, r_name""")
def coverage_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    sizes = nation.join(table(spark, sf_dir, "customer"), F.col("c_nationkey") == F.col("n_nationkey"), "left").groupBy("n_name", "n_regionkey").agg(F.count("c_custkey").alias("n"))
    k = F.col("r_regionkey")
    regions = table(spark, sf_dir, "region").withColumn("keys", F.when(k == 0, F.array(F.lit(0), F.lit(1))).when(k == 4, F.array().cast("array<int>")).otherwise(F.array(k)))
    out = relational.grouped_lookup(regions, ["keys"], sizes, ["n_regionkey"], "n_name", "n", "keys")
    return out.select("r_name", "matches", "n_matches", "amount", coverage_method(F.col("amount")).alias("method"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").withColumnRenamed("o_custkey", "c_custkey")
    return relational.without(table(spark, sf_dir, "customer"), done, "c_custkey").select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def semi_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").withColumnRenamed("o_custkey", "c_custkey")
    return relational.only_in(table(spark, sf_dir, "customer"), keys, "c_custkey").select("c_custkey", "c_name")


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.union_distinct(table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")), table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k")))


@query("SELECT c_custkey AS k, c_acctbal AS bal, c_mktsegment AS seg, 'c' AS kind FROM customer UNION ALL SELECT s_suppkey, s_acctbal, NULL, 's' FROM supplier")
def union_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = relational.tagged(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("bal"), F.col("c_mktsegment").alias("seg")), kind="c")
    s = relational.tagged(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("bal")), kind="s")
    return relational.union_all(c, s)


@query("SELECT p_partkey, coalesce(max(l_shipdate), TIMESTAMP '1970-01-01') AS last_ship, coalesce(count(l_orderkey), 0) AS n FROM part LEFT JOIN lineitem ON l_partkey = p_partkey AND l_quantity > 49 GROUP BY p_partkey")
def lookup_with_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = table(spark, sf_dir, "lineitem").where("l_quantity > 49").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.max("l_shipdate").alias("last_ship"), F.count(F.lit(1)).alias("n"))
    out = relational.looked_up(table(spark, sf_dir, "part").select("p_partkey"), big, ["p_partkey"], {"last_ship": None, "n": 0})
    return out.withColumn("last_ship", F.coalesce("last_ship", F.to_timestamp_ntz(F.lit("1970-01-01")) if dict(out.dtypes)["last_ship"] == "timestamp_ntz" else F.to_timestamp(F.lit("1970-01-01"))))


@query("SELECT o_orderstatus, arg_min(o_orderkey, (o_totalprice, o_orderkey)) AS o_orderkey, min(o_totalprice) AS o_totalprice FROM orders GROUP BY o_orderstatus")
def arg_min_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.best_of_group(table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderkey", "o_totalprice"), ["o_orderstatus"], "o_totalprice", ["o_orderkey"])


@query("WITH r AS (SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name) SELECT n_name, n, (sum(n) OVER (ORDER BY n_name ROWS UNBOUNDED PRECEDING) - n)::BIGINT AS offset_ FROM r")
def running_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count(F.lit(1)).alias("n"))
    return relational.running_offset(r, ["n_name"], "n", "offset_")


@query("""SELECT event_type, round(quantile_cont(value, 0.025), 6) AS p025, round(median(value), 6) AS p50, round(quantile_cont(value, 0.975), 6) AS p975, count(DISTINCT user_id) AS n_users, round(avg(value), 6) AS mean,
  round(stddev_samp(value), 6) AS std1, round(stddev_pop(value), 6) AS std0, min(value) AS lo, max(value) AS hi, round(sum(value) / sum(sum(value)) OVER (), 6) AS share FROM events GROUP BY event_type""")
def group_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = lambda q: F.round(F.percentile("value", q), 6)
    g = table(spark, sf_dir, "events").groupBy("event_type").agg(p(0.025).alias("p025"), p(0.5).alias("p50"), p(0.975).alias("p975"), F.count_distinct("user_id").alias("n_users"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_samp("value"), 6).alias("std1"), F.round(F.stddev_pop("value"), 6).alias("std0"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.sum("value").alias("_s"))
    return g.withColumn("share", F.round(F.col("_s") / F.sum("_s").over(W.partitionBy()), 6)).drop("_s")


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def run_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""SELECT p_partkey, least(10, greatest(-10, p_retailprice / 100 - 10)) AS clipped, round(sign(p_size - 25) * ln(1 + abs(p_size - 25)), 9) AS bent, coalesce(CASE WHEN p_size > 40 THEN NULL ELSE p_size::DOUBLE END, 0) AS filled,
  CASE WHEN p_size % 10 = 0 THEN NULL ELSE p_retailprice / (p_size % 10) END AS ratio_, round_even(p_retailprice, 1) AS even1, abs(p_size - 25.0) <= 1e-12 + 1e-12 * 25 AS close_ FROM part""")
def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, size = table(spark, sf_dir, "part"), F.col("p_size")
    return p.select("p_partkey", clip(F.col("p_retailprice") / 100 - 10, -10, 10).alias("clipped"), F.round(signed_log1p((size - 25).cast("double")), 9).alias("bent"), zero_for_missing(F.when(size <= 40, size.cast("double"))).alias("filled"), ratio(F.col("p_retailprice"), size % 10).alias("ratio_"), round_half_even(F.col("p_retailprice"), 1).alias("even1"), is_close(size.cast("double"), F.lit(25.0)).alias("close_"))

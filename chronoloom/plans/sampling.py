"""Registered queries on sampling, allocation and mixtures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.operators import sampling
from chronoloom.plans.series import as_arrays, daily
from chronoloom.sources.readers import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def hashed(*parts: str) -> str:
    return f"('0x' || substr(md5({' || chr(124) || '.join(p + '::VARCHAR' for p in parts)}), 1, 15))::BIGINT"


def index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of datasets: parts by brand and type, their orders as series."""
    p, line = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    rows = line.join(p, F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand", "p_type").agg(F.count_distinct("p_partkey").alias("n_series"), F.count(F.lit(1)).alias("total_obs"))
    return rows.select(F.concat("p_brand", F.lit("/"), "p_type").alias("name"), F.substring("p_brand", 7, 1).alias("freq"), F.substring_index("p_type", " ", 1).alias("domain"), "n_series", (F.col("total_obs") * 40).alias("total_obs"), (F.col("total_obs") * 40 / F.col("n_series")).alias("mean_series_len"))


INDEX = """i AS (SELECT p_brand || '/' || p_type AS name, substr(p_brand, 7, 1) AS freq, split_part(p_type, ' ', 1) AS domain, count(DISTINCT p_partkey) AS n_series, count(*) * 40 AS total_obs, count(*) * 40 / count(DISTINCT p_partkey) AS mean_series_len
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand, p_type),
s AS (SELECT *, CASE WHEN mean_series_len > 1024 THEN least(greatest(1, floor(mean_series_len / 1024)), 8) ELSE 1 END::BIGINT AS windows_per_series FROM i WHERE mean_series_len >= 1024),
t AS (SELECT *, n_series * windows_per_series AS supply FROM s)"""


@query(f"WITH {INDEX} SELECT name, freq, domain, n_series, total_obs, round(mean_series_len, 4) AS mean_series_len, windows_per_series, supply FROM t")
def dataset_supply(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.supply(index(spark, sf_dir)).withColumn("mean_series_len", F.round("mean_series_len", 4))


@query(f"WITH {INDEX} SELECT freq, domain, sum(total_obs)::BIGINT AS obs, sum(supply)::BIGINT AS supply, round(sum(total_obs) / sum(sum(total_obs)) OVER (), 9) AS share FROM t GROUP BY freq, domain")
def strata_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.strata(sampling.supply(index(spark, sf_dir))).withColumn("share", F.round("share", 9))


@query()
def stratified_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    # an index has a row for each dataset (here brand and type), far fewer than series
    supplied = sampling.supply(index(spark, sf_dir)).toPandas()
    return spark.createDataFrame(sampling.allocate(supplied, int(supplied["supply"].sum() * 0.6), floor=3))


@query(f"SELECT doc_id, lang FROM documents ORDER BY {hashed('doc_id', '11')}, doc_id LIMIT 300")
def deterministic_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.fixed_size_sample(table(spark, sf_dir, "documents").select("doc_id", "lang"), 300, ["doc_id"], 11)


@query(f"SELECT c_custkey, ntile(2) OVER (ORDER BY {hashed('c_custkey', '5')}, c_custkey) AS half FROM customer")
def random_halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.random_halves(table(spark, sf_dir, "customer").select("c_custkey"), ["c_custkey"], 5)


@query("""WITH n AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS i, count(*) OVER () AS n FROM part), k AS (SELECT unnest(range(0, 20)) AS k)
SELECT p_partkey FROM n JOIN k ON i = (k * (n - 1)) // 19""")
def probe_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.evenly_spaced(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey", 20)


@query(f"SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT {hashed('id', '3')} % (SELECT count(*) FROM customer) FROM (SELECT unnest(range(0, 200)) AS id))")
def random_row_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey")
    return sampling.drawn_rows(c, "c_custkey", 200, c.count(), 3)


@query("SELECT doc_id, lang, unnest(range(1, CASE lang WHEN 'en' THEN 1 WHEN 'de' THEN 3 WHEN 'fr' THEN 2 ELSE 0 END + 1)) AS copy FROM documents")
def replication_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.replicated(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", {"en": 1, "de": 3, "fr": 2, "es": 0}).withColumn("copy", F.col("copy").cast("long"))


@query(f"""WITH u AS (SELECT unnest(range(0, 2000)) AS draw), c AS (SELECT draw, CASE WHEN v < 0.5 THEN 'en' WHEN v < 0.8 THEN 'de' ELSE 'fr' END AS lang FROM (SELECT draw, {hashed('draw', '9')} / 1152921504606846976.0::DOUBLE AS v FROM u)),
n AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents)
SELECT draw, c.lang, doc_id FROM c JOIN n ON c.lang = n.lang AND n.i = {hashed('draw', '9', "'row'")} % n.n""")
def weighted_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return sampling.mixture(2000, docs, "lang", "doc_id", {"en": 5.0, "de": 3.0, "fr": 2.0}, 9).select("draw", "lang", "doc_id")


@query(f"""WITH w AS (SELECT p_brand AS dataset, p_partkey AS item_id, 0 AS window_index FROM part), a AS (SELECT p_brand AS name, 5 + length(p_brand) % 2 AS c, count(*) AS supply FROM part GROUP BY p_brand),
h AS (SELECT w.*, c, supply, {hashed('dataset', 'item_id', 'window_index', '0')} / 1152921504606846976.0::DOUBLE AS u FROM w JOIN a ON dataset = name), r AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY u, item_id) AS rn FROM h WHERE u <= 3 * c / supply)
SELECT dataset, item_id, window_index FROM r WHERE rn <= c""")
def accepted_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    a = p.groupBy(F.col("p_brand").alias("name")).agg((5 + F.length("p_brand") % 2).alias("count"), F.count(F.lit(1)).alias("supply"))
    return sampling.accepted(p.select(F.col("p_brand").alias("dataset"), F.col("p_partkey").alias("item_id"), F.lit(0).alias("window_index")), a)


@query(f"""WITH w AS (SELECT p_brand AS dataset, p_partkey AS item_id FROM part), a AS (SELECT p_brand AS name, 9 AS c, count(*) AS supply FROM part GROUP BY p_brand),
h AS (SELECT w.*, c, supply, {hashed('dataset', 'item_id', '0', '0')} / 1152921504606846976.0::DOUBLE AS u, {hashed('dataset', 'item_id', '0', '1')} AS h FROM w JOIN a ON dataset = name),
r AS (SELECT *, u <= 1 * c / supply AS near, row_number() OVER (PARTITION BY dataset, u <= 1 * c / supply ORDER BY u, item_id) AS rn FROM h), t AS (SELECT *, near AND rn <= c AS taken FROM r),
n AS (SELECT *, c - count(*) FILTER (taken) OVER (PARTITION BY dataset) AS need, row_number() OVER (PARTITION BY dataset, taken ORDER BY h, item_id) AS rest FROM t),
f AS (SELECT *, CASE WHEN taken THEN 0 WHEN rest <= need THEN 1 END AS pass FROM n),
s AS (SELECT *, row_number() OVER (PARTITION BY pass IS NULL ORDER BY h, dataset, item_id) AS second, (SELECT 9 * count(*) FROM a) - count(*) FILTER (pass IS NOT NULL) OVER () AS missing FROM f),
g AS (SELECT dataset, coalesce(pass, CASE WHEN second <= missing THEN 2 END) AS pass FROM s),
d AS (SELECT name AS dataset, 9 AS allocated, (SELECT count(*) FROM g WHERE g.dataset = name AND pass IS NOT NULL) AS collected, (SELECT count(*) FROM g WHERE g.dataset = name AND pass > 0) AS backfilled FROM a)
SELECT dataset, sum(allocated)::BIGINT AS allocated, sum(collected)::BIGINT AS collected, sum(backfilled)::BIGINT AS backfilled, sum(greatest(0, allocated - collected))::BIGINT AS shortfall FROM d GROUP BY ROLLUP (dataset)""")
def backfill_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    a = p.groupBy(F.col("p_brand").alias("name")).agg(F.lit(9).alias("count"), F.count(F.lit(1)).alias("supply"))
    w = p.select(F.col("p_brand").alias("dataset"), F.col("p_partkey").alias("item_id"), F.lit(0).alias("window_index"))
    taken = sampling.backfilled(sampling.accepted(w, a, oversample=1), w, a, a.count() * 9)
    return sampling.accounting(taken, a)


@query("""SELECT item, round(scale, 6) AS scale, array_to_string(list_transform(target, lambda x: least(4095, greatest(0, floor((x / scale + 15) / 30 * 4096)))::INT), ' ') AS tokens FROM (SELECT item, target, list_avg(list_transform(target, lambda x: abs(x))) AS scale FROM
  (SELECT item, list(y ORDER BY day) AS target FROM (SELECT o_orderpriority AS item, o_orderdate::DATE AS day, round(sum(o_totalprice), 2) AS y FROM orders GROUP BY ALL) GROUP BY item)) WHERE len(target) >= 60""")
def token_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sampling.tokens(sampling.long_enough(as_arrays(daily(spark, sf_dir))))
    return rows.select("item", F.round("scale", 6).alias("scale"), F.array_join(F.col("tokens").cast("array<string>"), " ").alias("tokens"))


@query("""WITH RECURSIVE d AS (SELECT doc_id, n_chars, (sum(n_chars) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) - n_chars) // (5000 * 64) AS share FROM documents),
n AS (SELECT *, row_number() OVER (PARTITION BY share ORDER BY doc_id) AS rn FROM d),
p AS (SELECT share, rn, doc_id, 0 AS b, 0 AS pos, n_chars AS used FROM n WHERE rn = 1
  UNION ALL SELECT n.share, n.rn, n.doc_id, p.b + (p.used + n.n_chars > 5000)::INT, CASE WHEN p.used + n.n_chars > 5000 THEN 0 ELSE p.used END, CASE WHEN p.used + n.n_chars > 5000 THEN 0 ELSE p.used END + n.n_chars FROM p JOIN n ON n.share = p.share AND n.rn = p.rn + 1)
SELECT doc_id, (256 * share + b)::BIGINT AS bin, pos::BIGINT AS position FROM p""")
def packed_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.packed(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "n_chars", "doc_id", 5000).select("doc_id", "bin", "position")

"""Registered queries on readers and writers: what is written comes back as the table says."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.sources import readers
from chronoloom.sources.readers import shared_folder, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("SELECT p_partkey, p_name, p_brand, p_size, p_retailprice FROM part")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/part.csv"
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size", "p_retailprice")
    readers.write_csv(rows, path, one_file=False)
    return readers.csv(spark, path, rows.schema, rows.columns)


@query("SELECT s_suppkey, s_name, round(s_acctbal, 6) AS s_acctbal FROM supplier")
def json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/supplier.json"
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    readers.write_json(rows, path)
    return spark.read.schema(rows.schema).json(path).withColumn("s_acctbal", F.round("s_acctbal", 6))


@query("SELECT n_name AS key, r_name AS domain, 'D' AS frequency, (n_nationkey % 3 + 1)::INT AS num_variates FROM nation JOIN region ON n_regionkey = r_regionkey")
def dataset_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON object keyed by dataset, as a table."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    entry = F.struct(F.col("r_name").alias("domain"), F.lit("D").alias("frequency"), (F.col("n_nationkey") % 3 + 1).alias("num_variates"))
    whole = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("n_name", entry)))).alias("value"))
    path = f"{shared_folder(spark)}/properties"
    whole.write.text(path)
    return readers.properties(spark, path)


@query("SELECT o_orderstatus AS status, o_orderkey AS k, o_totalprice AS price FROM orders UNION ALL SELECT 'new', -1, 0.5")
def append_to_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A partitioned table that is written, added to, and asked to add rows that it has."""
    path = f"{shared_folder(spark)}/orders"
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("price"))
    rows.write.partitionBy("status").parquet(path)
    more = spark.createDataFrame([("new", -1, 0.5)], rows.schema)
    readers.write_new(more.unionByName(rows.where("k % 7 = 0")), path, ["k"], ["status"])
    return spark.read.schema(rows.schema).parquet(path).select("status", "k", "price")


@query("SELECT o_orderpriority AS condition, o_orderstatus AS model_family, (o_orderkey % 3)::INT AS seed, count(*) AS n, round(avg(o_totalprice), 4) AS crps FROM orders GROUP BY ALL")
def results_by_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result tables found under their paths, tagged from them."""
    root = shared_folder(spark)
    names = [c for c in readers.RESULTS.names if c not in ("dataset", "model")]
    o = table(spark, sf_dir, "orders")
    rows = o.select(F.col("o_orderkey").cast("string").alias("dataset"), F.lit("m").alias("model"), *[(F.col("o_totalprice") if c == "mean_weighted_sum_quantile_loss" else F.lit(1)).cast(readers.RESULTS[c].dataType).alias(c) for c in names], "o_orderstatus", "o_orderpriority", (F.col("o_orderkey") % 3).alias("seed"))
    for status, priority, seed in sorted(rows.select("o_orderstatus", "o_orderpriority", "seed").distinct().collect()):
        own = rows.where((F.col("o_orderstatus") == status) & (F.col("o_orderpriority") == priority) & (F.col("seed") == seed)).select("dataset", "model", *[f"`{c}`" for c in names])
        readers.write_csv(own, f"{root}/{status}/seed_{seed}/{priority}/all_results.csv")
    found = readers.results(spark, root)
    return found.groupBy("condition", "model_family", "seed").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("mean_weighted_sum_quantile_loss"), 4).alias("crps"))

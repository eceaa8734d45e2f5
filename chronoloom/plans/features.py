"""Registered queries on features, distributions and coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.operators import coverage, distribution, features, preprocess
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


def clouds(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Embeddings with label below 4 as real points, the others as synthetic ones."""
    e = table(spark, sf_dir, "embeddings")
    return coverage.points(e.where("label < 4"), "vec_id", "embedding"), coverage.points(e.where("label >= 4"), "vec_id", "embedding")


CLOUDS = """r AS (SELECT vec_id AS id, embedding::DOUBLE[] AS x FROM embeddings WHERE label < 4), s AS (SELECT vec_id AS id, embedding::DOUBLE[] AS x FROM embeddings WHERE label >= 4)"""
BALLS = f"""{CLOUDS},
rr AS (SELECT a.id AS i, b.id AS j, list_distance(a.x, b.x) AS d FROM r a, r b), ss AS (SELECT a.id AS i, b.id AS j, list_distance(a.x, b.x) AS d FROM s a, s b), rs AS (SELECT a.id AS i, b.id AS j, list_distance(a.x, b.x) AS d FROM r a, s b),
kr AS (SELECT i, d AS radius FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d) AS k FROM rr) WHERE k = 5), ks AS (SELECT i, d AS radius FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d) AS k FROM ss) WHERE k = 5)"""


@query("""WITH e AS (SELECT event_type, event_id, value, value - avg(value) OVER (PARTITION BY event_type) AS d, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS i FROM events),
l AS (SELECT *, lag(d) OVER (PARTITION BY event_type ORDER BY event_id) AS p FROM e), b AS (SELECT event_type, i // 10 AS b, var_samp(value) AS v FROM e GROUP BY ALL HAVING count(*) = 10)
SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, round(sum(d * p) / sum(d * d), 6) AS acf1, round(avg((value = 0)::INT), 6) AS zero_rate, round(avg((value IS NULL)::INT), 6) AS gap_rate,
  round((SELECT var_samp(v) FROM b WHERE b.event_type = l.event_type), 2) AS lumpiness FROM l GROUP BY event_type""")
def feature_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = features.native_features(table(spark, sf_dir, "events"), ["event_type"], "event_id", "value")
    return out.withColumns({c: F.round(c, 2 if c == "lumpiness" else 6) for c in out.columns if c not in ("event_type", "n")})


@query()
def extracted_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.extracted(as_arrays(daily(spark, sf_dir)), ["item"])


def dimensions(spark: SparkSession, sf_dir: str, n: int = 64) -> DataFrame:
    """Embeddings with a column for each dimension."""
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", "label", *[F.get("embedding", F.lit(i)).cast("double").alias(f"f{i:02d}") for i in range(n)])


DIMS = [f"f{i:02d}" for i in range(64)]
LONG = "l AS (SELECT vec_id, label, 'f' || lpad((j - 1)::VARCHAR, 2, '0') AS feature, embedding[j]::DOUBLE AS value FROM embeddings, (SELECT unnest(range(1, 65)) AS j))"


@query(f"WITH {LONG} SELECT feature, count(*) AS n, round(avg((value IS NULL OR isnan(value))::INT), 6) AS nan_rate, round(avg((isinf(value))::INT), 6) AS inf_rate, round(avg((value = 0)::INT), 6) AS zero_rate, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM l GROUP BY feature")
def feature_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = features.diagnostics(dimensions(spark, sf_dir), DIMS)
    return out.withColumns({c: F.round(c, 6) for c in out.columns if c not in ("feature", "n")})


@query(f"""WITH {LONG}, p AS (SELECT vec_id, label, feature, CASE WHEN feature IN ('f00', 'f01') THEN sign(value) * ln(1 + abs(value)) ELSE value END AS v FROM l), m AS (SELECT feature, avg(v) AS a, stddev_pop(v) AS s FROM p WHERE label = 0 GROUP BY feature)
SELECT vec_id, feature, round(greatest(-10, least(10, (v - a) / s)), 5) AS value FROM p JOIN m USING (feature)""")
def standardise_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dimensions(spark, sf_dir)
    scaler = preprocess.fit(d.where("label = 0"), DIMS, ("f00", "f01"))
    return scaler.transform(d).unpivot(["vec_id"], DIMS, "feature", "value").withColumn("value", F.round("value", 5))


_KS = """u AS (UNPIVOT (SELECT l_returnflag = 'R' AS s, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem) ON l_quantity, l_extendedprice, l_discount, l_tax INTO NAME feature VALUE value),
c AS (SELECT feature, value, count(*) FILTER (NOT s) AS a, count(*) FILTER (s) AS b FROM u GROUP BY ALL),
w AS (SELECT feature, sum(a) OVER o AS ca, sum(b) OVER o AS cb, sum(a) OVER p AS na, sum(b) OVER p AS nb FROM c WINDOW o AS (PARTITION BY feature ORDER BY value ROWS UNBOUNDED PRECEDING), p AS (PARTITION BY feature)),
k AS (SELECT feature, max(na)::BIGINT AS n_a, max(nb)::BIGINT AS n_b, max(abs(ca / na - cb / nb)) AS d FROM w GROUP BY feature),
t AS (SELECT *, greatest(0, least(1, (SELECT sum(CASE WHEN j % 2 = 1 THEN 2 ELSE -2 END * exp(-2 * j * j * d * d * n_a * n_b / (n_a + n_b))) FROM (SELECT unnest(range(1, 101)) AS j)))) AS p0 FROM k),
q AS (SELECT feature, n_a, n_b, d, CASE WHEN sqrt(n_a * n_b / (n_a + n_b)) * d < 0.04 THEN 1 ELSE p0 END AS p FROM t)"""


def _ks(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    long = table(spark, sf_dir, "lineitem").withColumn("s", F.col("l_returnflag") == "R").unpivot(["s"], names, "feature", "value")
    return distribution.ks_tests(long, "value", "s")


@query(f"WITH {_KS} SELECT feature, n_a, n_b, round(d, 9) AS d, round(p, 6) AS p FROM q")
def ks_per_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ks(spark, sf_dir).withColumn("d", F.round("d", 9)).withColumn("p", F.round("p", 6))


@query(f"WITH {_KS}, r AS (SELECT feature, p, row_number() OVER (ORDER BY p) AS r, count(*) OVER () AS m FROM q), a AS (SELECT feature, p, least(1, min(p * m / r) OVER (ORDER BY r DESC ROWS UNBOUNDED PRECEDING)) AS p_adjusted FROM r) SELECT feature, round(p, 6) AS p, round(p_adjusted, 6) AS p_adjusted, p_adjusted <= 0.05 AS rejected FROM a")
def bh_adjust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distribution.adjusted(_ks(spark, sf_dir).select("feature", "p")).withColumn("p", F.round("p", 6)).withColumn("p_adjusted", F.round("p_adjusted", 6))


@query(f"""WITH {BALLS}, hit AS (SELECT j, count(*) FILTER (d < radius) AS n FROM rs JOIN kr USING (i) GROUP BY j), rec AS (SELECT rs.i, count(*) FILTER (d < ks.radius) AS n FROM rs JOIN ks ON rs.j = ks.i GROUP BY rs.i), cov AS (SELECT rs.i, min(d) < any_value(radius) AS c FROM rs JOIN kr USING (i) GROUP BY rs.i)
SELECT round((SELECT avg((n > 0)::INT) FROM hit), 9) AS precision, round((SELECT avg((n > 0)::INT) FROM rec), 9) AS recall, round((SELECT avg(n) / 5 FROM hit), 9) AS density, round((SELECT avg(c::INT) FROM cov), 9) AS coverage""")
def knn_prdc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = coverage.prdc(*clouds(spark, sf_dir))
    return out.withColumns({c: F.round(c, 9) for c in out.columns})


@query(f"""WITH {BALLS} SELECT i AS id, k AS rank, j AS neighbour, round(d, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j) AS k FROM rr) WHERE k <= 5""")
def nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    real, _ = clouds(spark, sf_dir)
    return coverage.neighbours(real, real).withColumn("distance", F.round("distance", 6)).withColumn("rank", F.col("rank").cast("long"))


@query(f"""WITH {BALLS}, own AS (SELECT i, min(d) AS o FROM rr WHERE i <> j GROUP BY i), near AS (SELECT j, i, d FROM (SELECT *, row_number() OVER (PARTITION BY j ORDER BY d, i) AS k FROM rs) WHERE k = 1) SELECT round(avg((d > o)::INT), 9) AS authenticity FROM near JOIN own USING (i)""")
def authenticity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.authenticity(*clouds(spark, sf_dir)).withColumn("authenticity", F.round("authenticity", 9))


_GRID = "[" + ", ".join(f"{i + 1} / 30.0::DOUBLE" for i in range(30)) + "]"


@query(f"""WITH {CLOUDS}, c AS (SELECT (SELECT list(m ORDER BY j) FROM (SELECT j, avg(x[j]) AS m FROM r, (SELECT unnest(range(1, 65)) AS j) GROUP BY j)) AS cr, (SELECT list(m ORDER BY j) FROM (SELECT j, avg(x[j]) AS m FROM s, (SELECT unnest(range(1, 65)) AS j) GROUP BY j)) AS cs),
q AS (SELECT (SELECT quantile_cont(list_distance(x, cr), {_GRID}) FROM r, c) AS qr, (SELECT quantile_cont(list_distance(x, cs), {_GRID}) FROM s, c) AS qs),
g AS (SELECT k, abs(k / 30.0 - (SELECT avg((list_distance(x, cr) <= qr[k])::INT) FROM s, c, q)) AS a, abs(k / 30.0 - (SELECT avg((list_distance(x, cs) <= qs[k])::INT) FROM r, c, q)) AS b FROM (SELECT unnest(range(1, 31)) AS k)),
z AS (SELECT k, (a + lag(a) OVER (ORDER BY k)) / 60 AS a, (b + lag(b) OVER (ORDER BY k)) / 60 AS b FROM g)
SELECT round(1 - 2 * sum(a), 6) AS alpha_precision, round(1 - 2 * sum(b), 6) AS beta_recall, round((SELECT list_distance(cr, cs) FROM c), 6) AS delta_centroid FROM z""")
def alpha_beta(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = coverage.alpha_beta(*clouds(spark, sf_dir))
    return out.withColumns({c: F.round(c, 6) for c in out.columns})


@query()
def frechet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(coverage.frechet(*clouds(spark, sf_dir)),)], "fd double")


@query()
def coverage_null_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.null_baseline(clouds(spark, sf_dir)[0])


@query("SELECT a.j AS i, b.j, round(covar_samp(e.embedding[a.j + 1], e.embedding[b.j + 1]), 7) AS cov FROM embeddings e, (SELECT unnest(range(0, 64)) AS j) a, (SELECT unnest(range(0, 64)) AS j) b WHERE a.j <= b.j AND label < 4 GROUP BY a.j, b.j")
def covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, c = coverage.moments(clouds(spark, sf_dir)[0])
    rows = [(i, j, float(c[i, j])) for i in range(len(c)) for j in range(i, len(c))]
    return spark.createDataFrame(rows, "i long, j long, cov double").withColumn("cov", F.round("cov", 7))

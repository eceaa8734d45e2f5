"""Registered queries on series: resampling, gaps, windows, splits, forecasts, tasks, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.functions import arrays, calendar
from chronoloom.operators import forecast, series
from chronoloom.sources.readers import table
from chronoloom.streaming import windows as streams

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.resampled(table(spark, sf_dir, "events"), "ts", "1 hour", ["event_type"], n=F.count(F.lit(1)), total=F.sum("value"))


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily order totals by priority: (item, day, y)."""
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("item"), F.to_date("o_orderdate").alias("day")).agg(F.round(F.sum("o_totalprice"), 2).alias("y"))


def as_arrays(rows: DataFrame) -> DataFrame:
    """One array for each item, in the order of the days; a row holds one series."""
    return rows.groupBy("item").agg(F.transform(F.array_sort(F.collect_list(F.struct("day", "y"))), lambda x: x["y"]).alias("target"))


DAILY = "daily AS (SELECT o_orderpriority AS item, o_orderdate::DATE AS day, round(sum(o_totalprice), 2) AS y FROM orders GROUP BY ALL)"
ARRAYS = f"{DAILY}, a AS (SELECT item, list(y ORDER BY day) AS target FROM daily GROUP BY item)"
HOURLY = "hourly AS (SELECT event_type, time_bucket(INTERVAL 1 hour, ts) AS ts, count(*) AS n, sum(value) AS total FROM events GROUP BY ALL)"
GRID = f"""{HOURLY}, g AS (SELECT event_type, unnest(range(a, b + INTERVAL 1 hour, INTERVAL 1 hour)) AS ts FROM (SELECT event_type, min(ts) AS a, max(ts) AS b FROM hourly GROUP BY event_type)),
grid AS (SELECT event_type, ts, CASE WHEN n > 1 THEN total END AS total FROM g LEFT JOIN hourly USING (event_type, ts))"""


def gappy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An hourly grid in which hours with fewer than two events have no value."""
    grid = series.regular_grid(hourly(spark, sf_dir), "ts", "1 hour", ["event_type"])
    return grid.select("event_type", "ts", F.when(F.col("n") > 1, F.col("total")).alias("total"))


@query(f"WITH {HOURLY} SELECT event_type, ts, n, round(total, 6) AS total FROM hourly")
def series_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hourly(spark, sf_dir).withColumn("total", F.round("total", 6))


@query(f"""WITH {GRID}, t AS (SELECT *, max(CASE WHEN total IS NOT NULL THEN ts END) OVER (PARTITION BY event_type) AS last_ FROM grid)
SELECT event_type, ts, round(coalesce(last_value(total IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY ts ROWS UNBOUNDED PRECEDING), first_value(total IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS total
FROM t WHERE ts <= last_""")
def fill_forward_backward(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = series.without_trailing_gaps(gappy(spark, sf_dir), "total", "ts", ["event_type"])
    return series.filled(rows, "total", "ts", ["event_type"]).withColumn("total", F.round("total", 6))


@query(f"""WITH {GRID}, k AS (SELECT *, epoch(ts) AS x,
  last_value(CASE WHEN total IS NOT NULL THEN epoch(ts) END IGNORE NULLS) OVER b AS x0, last_value(total IGNORE NULLS) OVER b AS y0, first_value(CASE WHEN total IS NOT NULL THEN epoch(ts) END IGNORE NULLS) OVER f AS x1, first_value(total IGNORE NULLS) OVER f AS y1
  FROM grid WINDOW b AS (PARTITION BY event_type ORDER BY ts ROWS UNBOUNDED PRECEDING), f AS (PARTITION BY event_type ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT event_type, ts, round(coalesce(total, CASE WHEN x1 > x0 THEN y0 + (y1 - y0) * ((x - x0) / (x1 - x0)) END, y0, y1), 9) AS total FROM k""")
def linear_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.interpolated(gappy(spark, sf_dir), "total", "ts", ["event_type"]).withColumn("total", F.round("total", 9))


@query(f"""WITH {ARRAYS} SELECT item, i - 1 AS window_index, 64 AS valid_length, target[(i - 1) * 64 + 1] AS first_, target[i * 64] AS last_ FROM (SELECT item, target, unnest(range(1, least(8, greatest(1, len(target) // 64)) + 1)) AS i FROM a WHERE len(target) >= 64)""")
def series_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = series.windows(as_arrays(daily(spark, sf_dir)), 64, 8)
    return w.select("item", F.col("window_index").cast("long"), F.size("target").alias("valid_length"), F.get("target", F.lit(0)).alias("first_"), F.element_at("target", -1).alias("last_"))


@query(f"""WITH {ARRAYS}, s AS (SELECT item, target, (('0x' || substr(md5(item || '|' || '7'), 1, 15))::BIGINT % (len(target) - 100 + 1))::BIGINT AS start_index FROM a WHERE len(target) >= 100)
SELECT item, start_index, round(list_sum(target[start_index + 1 : start_index + 100]), 2) AS total FROM s""")
def random_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = series.random_window(as_arrays(daily(spark, sf_dir)), 100, 7, "item")
    return w.select("item", "start_index", F.round(F.aggregate("target", F.lit(0.0), lambda s, x: s + x), 2).alias("total"))


@query(f"""WITH {ARRAYS} SELECT item, len(target)::BIGINT AS n, greatest(0, len(target) - 30 * 4)::BIGINT AS n_train, greatest(0, len(target) - 30 * 3)::BIGINT AS n_valid, w AS window_idx,
  (len(target) - 30 * (3 - w))::BIGINT AS n_past, target[len(target) - 30 * (3 - w)] AS last_past, target[len(target) - 30 * (3 - w) + 1] AS first_label, 30::BIGINT AS n_label FROM a, (SELECT unnest([0, 1, 2]) AS w)""")
def rolling_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, p, w = as_arrays(daily(spark, sf_dir)), F.lit(30), F.lit(3)
    parts = a.select("item", F.size("target").alias("n")).join(series.training_part(a, p, w).select("item", F.size("target").alias("n_train")), "item").join(series.validation_part(a, p, w).select("item", F.size("target").alias("n_valid")), "item")
    t = series.test_windows(a, p, w).select("item", F.col("window_idx").cast("int"), F.size("past").alias("n_past"), F.element_at("past", -1).alias("last_past"), F.get("label", F.lit(0)).alias("first_label"), F.size("label").alias("n_label"))
    return parts.join(t, "item").withColumns({c: F.col(c).cast("long") for c in ("n", "n_train", "n_valid", "n_past", "n_label")})


@query(f"""WITH {DAILY} SELECT item, day::VARCHAR AS day, round(sum(y) OVER (PARTITION BY item ORDER BY day ROWS UNBOUNDED PRECEDING), 2) AS total, round(y - lag(y, 7) OVER (PARTITION BY item ORDER BY day), 2) AS diff7,
  round((coalesce(lag(y) OVER (PARTITION BY item ORDER BY day), 0) + y + coalesce(lead(y) OVER (PARTITION BY item ORDER BY day), 0)) / 3, 4) AS smooth FROM daily""")
def cumulative_difference_smoothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = ("y", "day", ["item"])
    return daily(spark, sf_dir).select("item", F.col("day").cast("string").alias("day"), F.round(series.cumulative(*by), 2).alias("total"), F.round(series.seasonal_difference(*by, 7), 2).alias("diff7"), F.round(series.smoothed(*by), 4).alias("smooth"))


@query(f"""WITH {ARRAYS}, v AS (SELECT [target, list_transform(target, lambda x: -x)] AS target, item FROM a)
SELECT item || '_dim' || (k - 1) AS item_id, len(target[k])::BIGINT AS n, target[k][1] AS first_, target[1][1] AS first_variate FROM (SELECT item, target, unnest([1, 2]) AS k FROM v)""")
def multivariate_to_univariate(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = as_arrays(daily(spark, sf_dir)).select(F.col("item").alias("item_id"), F.array("target", F.transform("target", lambda x: -x)).alias("target"))
    rows = a.withColumn("first_variate", F.get(arrays.first_variate(F.col("target")), F.lit(0)))
    return series.univariate(rows).select("item_id", F.size("target").cast("long").alias("n"), F.get("target", F.lit(0)).alias("first_"), "first_variate")


@query(f"""WITH {ARRAYS}, g AS (SELECT item, list_transform(target, lambda x: CASE WHEN x > 150000 THEN x END) AS t FROM a),
k AS (SELECT item, t, coalesce(list_max(list_transform(range(1, len(t) + 1), lambda i: CASE WHEN t[i] IS NOT NULL THEN i ELSE 0 END)), 0) AS last_ FROM g)
SELECT item, last_::BIGINT AS valid_length, 2600::BIGINT AS padded, t[last_] AS last_value, round(list_sum(list_transform(range(8, len(t) + 1), lambda i: t[i] - t[i - 7])), 2) AS seven FROM k""")
def trim_and_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = as_arrays(daily(spark, sf_dir)).withColumn("t", F.transform("target", lambda x: F.when(x > 150000, x)))
    trimmed = arrays.trim_trailing_nulls(F.col("t"))
    # a sum of differences: DuckDB's list_sum skips NULL and is NULL without any value
    seven = F.filter(arrays.differences(F.col("t"), 7), lambda x: x.isNotNull())
    total = F.when(F.size(seven) > 0, F.aggregate(seven, F.lit(0.0), lambda s, x: s + x))
    return a.select("item", F.size(trimmed).cast("long").alias("valid_length"), F.size(arrays.pad_right(trimmed, 2600)).cast("long").alias("padded"), F.try_element_at(trimmed, F.lit(-1)).alias("last_value"), F.round(total, 2).alias("seven"))


@query(f"""WITH {DAILY}, u AS (SELECT item, day, y FROM daily UNION ALL SELECT item || '_copy', day, y FROM daily WHERE item < '3'), a AS (SELECT item, list(y ORDER BY day) AS target FROM u GROUP BY item)
SELECT len(target)::BIGINT AS length, count(*) AS n, min(item) AS first_item FROM a GROUP BY target HAVING count(*) > 1""")
def duplicate_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = daily(spark, sf_dir)
    both = d.unionByName(d.where("item < '3'").withColumn("item", F.concat("item", F.lit("_copy"))))
    return series.duplicates(as_arrays(both), "item").select(F.col("length").cast("long"), "n", "first_item")


_NAIVE = f"""{DAILY}, x AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY day) AS i, count(*) OVER (PARTITION BY item) AS n, y - lag(y, 7) OVER (PARTITION BY item ORDER BY day) AS e FROM daily),
hist AS (SELECT * FROM x WHERE i <= n - 28),
sc AS (SELECT item, avg(abs(e)) AS scale, [{', '.join(f'quantile_cont(e, {q}) - median(e)' for q in forecast.LEVELS)}] AS s FROM hist GROUP BY item),
lastw AS (SELECT item, i - (n - 28 - 7) - 1 AS phase, y AS f FROM hist WHERE i > n - 28 - 7),
lab AS (SELECT item, i - (n - 28) AS step, y FROM x WHERE i > n - 28),
j AS (SELECT lab.item, step, y, f, scale, s FROM lab JOIN lastw ON lab.item = lastw.item AND (step - 1) % 7 = phase JOIN sc ON sc.item = lab.item),
q AS (SELECT *, f + s[5] AS f5, f + list_avg(s) AS m, f + s[1] + (s[2] - s[1]) * ((0.025 - 0.1) / 0.1) AS lo, f + s[8] + (s[9] - s[8]) * ((0.975 - 0.8) / 0.1) AS hi FROM j),
l AS (SELECT item, lv, sum(2 * abs((y - (f + s[k])) * ((y <= f + s[k])::INT - lv))) / sum(abs(y)) AS loss FROM j, (SELECT unnest(range(1, 10)) AS k), (SELECT unnest([{', '.join(map(str, forecast.LEVELS))}]) AS lv) WHERE round(lv * 10) = k GROUP BY item, lv)"""


@query(f"""WITH {_NAIVE} SELECT item, round(avg((y - m) ** 2), 0) AS mse_mean, round(avg((y - f5) ** 2), 0) AS mse, round(avg(abs(y - f5)), 3) AS mae, round(avg(abs(y - f5) / abs(y)), 6) AS mape, round(avg(2 * abs(y - f5) / (abs(y) + abs(f5))), 6) AS smape,
  round(sum(abs(y - f5)) / sum(abs(y)), 6) AS nd, round(sqrt(avg((y - m) ** 2)), 3) AS rmse, round(sqrt(avg((y - m) ** 2)) / avg(abs(y)), 6) AS nrmse, round(avg(abs(y - f5) / scale), 6) AS mase,
  round(avg((hi - lo + 40 * greatest(0, lo - y) + 40 * greatest(0, y - hi)) / scale), 5) AS msis, round(min(wql), 6) AS mean_weighted_sum_quantile_loss FROM q JOIN (SELECT item, avg(loss) AS wql FROM l GROUP BY item) USING (item) GROUP BY item""")
def seasonal_naive_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = series.test_windows(as_arrays(daily(spark, sf_dir)), F.lit(28), F.lit(1))
    f = forecast.predicted(w, ["item"], 28, 7)
    out = forecast.evaluated(w, f, ["item"], ["item"], 7)
    digits = {"mse_mean": 0, "mse": 0, "mae": 3, "rmse": 3, "msis": 5}
    return out.withColumns({c: F.round(c, digits.get(c, 6)) for c in out.columns if c != "item"})


@query("""WITH s AS (SELECT event_type AS item, (user_id % 4) AS step, value FROM events) SELECT item, step, level, round(quantile_cont(value, 0.1) * (level = 0.1)::INT + quantile_cont(value, 0.5) * (level = 0.5)::INT + quantile_cont(value, 0.9) * (level = 0.9)::INT, 6) AS value
FROM s, (SELECT unnest([0.1, 0.5, 0.9]::DOUBLE[]) AS level) GROUP BY item, step, level""")
def quantiles_from_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "events").select(F.col("event_type").alias("item"), (F.col("user_id") % 4).alias("step"), "value")
    return forecast.from_samples(s, ["item"], levels=(0.1, 0.5, 0.9)).withColumn("value", F.round("value", 6))


_FREQS = "(VALUES ('saugeenday', 'D', 100), ('m4_hourly', 'H', 700), ('Bitbrains', '5T', 9000), ('electricity', '15T', 140000), ('solar', '10S', 5000), ('hospital', 'ME', 72), ('m4_quarterly', 'QE-DEC', 130), ('nn5', 'W-SUN', 790), ('m4_yearly', 'A-DEC', 13))"


@query(f"""WITH t(name, freq, shortest) AS {_FREQS}, u AS (SELECT *, regexp_extract(freq, '^\\d*([A-Z]+)', 1) AS l, coalesce(nullif(regexp_extract(freq, '^(\\d+)', 1), ''), '1')::INT AS m FROM t),
v AS (SELECT *, CASE l WHEN 'ME' THEN 'M' WHEN 'QE' THEN 'Q' ELSE l END AS unit FROM u),
s AS (SELECT *, CASE unit WHEN 'S' THEN 3600 WHEN 'T' THEN 1440 WHEN 'H' THEN 24 WHEN 'M' THEN 12 WHEN 'Q' THEN 4 ELSE 1 END AS base FROM v),
p AS (SELECT *, term, CASE WHEN contains(name, 'm4') THEN CASE unit WHEN 'A' THEN 6 WHEN 'Q' THEN 8 WHEN 'M' THEN 18 WHEN 'W' THEN 13 WHEN 'D' THEN 14 WHEN 'H' THEN 48 END ELSE CASE unit WHEN 'M' THEN 12 WHEN 'W' THEN 8 WHEN 'D' THEN 30 WHEN 'H' THEN 48 WHEN 'T' THEN 48 WHEN 'S' THEN 60 END END * mult AS length FROM s, (VALUES ('short', 1), ('medium', 10), ('long', 15)) AS h(term, mult))
SELECT CASE WHEN name = 'saugeenday' THEN 'saugeen' ELSE lower(name) END || '/' || freq || '/' || term AS task, unit, CASE freq WHEN 'W-SUN' THEN 'W' WHEN 'A-DEC' THEN 'A' ELSE freq END AS normal, CASE WHEN base % m = 0 THEN base // m ELSE 1 END::INT AS season, length::INT AS length,
  CASE WHEN contains(name, 'm4') THEN 1 ELSE least(greatest(ceil(0.1 * shortest / length), 1), 20) END::INT AS windows, term AS horizon, replace(CASE WHEN name = 'saugeenday' THEN 'saugeen' ELSE lower(name) END || '/' || freq || '/' || term, '/', '-') AS stem FROM p""")
def forecast_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.sql(f"SELECT col1 AS name, col2 AS freq, col3 AS shortest FROM VALUES {_FREQS[8:-1]}")
    t = t.withColumn("term", F.explode(F.array(*[F.lit(h) for h in calendar.HORIZONS])))
    name, freq = F.col("name"), F.col("freq")
    length = calendar.prediction_length(name, freq, F.col("term"))
    t = t.select(calendar.task_name(name, freq, F.col("term")).alias("task"), calendar.unit(freq).alias("unit"), calendar.normal_frequency(freq).alias("normal"), calendar.season(freq).alias("season"), length.alias("length"), calendar.window_count(name, F.col("shortest"), length).alias("windows"))
    return t.withColumn("horizon", calendar.horizon_of(F.col("task"))).withColumn("stem", calendar.file_stem(F.col("task")))


@query("""WITH t AS (SELECT n_name AS key, term FROM nation, (SELECT unnest(['short', 'medium', 'long']) AS term)), p AS (SELECT n_name AS key, r_name AS domain, n_nationkey % 3 AS num_variates FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey < 20)
SELECT lower(key) || '/D/' || term AS task, key || '/D/' || term AS dataset, coalesce(domain, '?') AS domain, coalesce(num_variates, 0)::INT AS num_variates FROM t LEFT JOIN p USING (key) WHERE term = 'short' OR key IN (SELECT n_name FROM nation WHERE n_regionkey = 2)""")
def task_enumeration(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    long_keys = nation.where("n_regionkey = 2").select(F.col("n_name").alias("key"))
    t = forecast.enumerated(nation.select(F.col("n_name").alias("key")), "key", long_keys)
    p = nation.where("n_nationkey < 20").join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("key"), F.col("r_name").alias("domain"), (F.col("n_nationkey") % 3).alias("num_variates"))
    named = t.select(calendar.task_name(F.col("key"), F.lit("D"), F.col("term")).alias("task"), F.concat_ws("/", "key", F.lit("D"), "term").alias("dataset"))
    return forecast.with_properties(named, p).na.fill({"domain": "?", "num_variates": 0})


@query("SELECT item_id, start + INTERVAL 90 minute AS next_ FROM (SELECT o_orderkey AS item_id, o_orderdate AS start FROM orders)")
def forecast_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item_id"), F.col("o_orderdate").alias("start"))
    return o.select("item_id", calendar.later(F.col("start"), F.lit("15T"), F.lit(6)).cast(o.schema["start"].dataType).alias("next_"))


@query("""WITH e AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 12 hour THEN 0 ELSE 1 END AS new_ FROM events), s AS (SELECT *, sum(new_) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, min(ts) AS started, max(ts) + INTERVAL 12 hour AS ended, count(*) AS n, round(sum(value), 6) AS total FROM s GROUP BY user_id, k""")
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.sessions(table(spark, sf_dir, "events"), "ts", "12 hours", ["user_id"], total=F.round(F.sum("value"), 6))


@query("SELECT o_orderstatus, o_orderkey, sum(o_totalprice) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) > 1e7 AS beyond FROM orders")
def prefix_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderkey", (series.cumulative("o_totalprice", "o_orderkey", ["o_orderstatus"]) > 1e7).alias("beyond"))


@query(f"WITH {HOURLY} SELECT event_type, ts, n, round(total, 6) AS total FROM hourly")
def stream_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hourly resampling as a stream that reads what is there and stops; equal to the batch."""
    import uuid

    root = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/_streams"
    root = f"{root.rstrip('/')}/stream-{uuid.uuid4().hex}"
    events = streams.parquet_stream(spark, sf_dir, "events.parquet")
    # the whole table counts, so lateness is not bounded here and the counts come out at the end
    rows = series.resampled(events, "ts", "1 hour", ["event_type"], n=F.count(F.lit(1)), total=F.sum("value"))

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out")

    q = rows.writeStream.outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{root}/state").foreachBatch(write).start()
    q.awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{root}/out").withColumn("total", F.round("total", 6))




@query("""WITH s AS (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY ALL) SELECT event_type, count(*) AS n_series, min(n)::BIGINT AS min_length, max(n)::BIGINT AS max_length, sum(n)::BIGINT AS total_length FROM s GROUP BY event_type""")
def length_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "value"))), lambda x: x["value"]).alias("target"))
    return series.length_summary(e, ["event_type"])


@query(f"""WITH {ARRAYS}, g AS (SELECT item, list_transform(target, lambda x: CASE WHEN x > 150000 THEN x END) AS t FROM a), k AS (SELECT item, t, list_max(list_transform(range(1, len(t) + 1), lambda i: CASE WHEN t[i] IS NOT NULL THEN i ELSE 0 END)) AS n FROM g),
u AS (SELECT item, n, i, t[i] AS y FROM k, (SELECT unnest(range(1, 4000)) AS i) WHERE i <= n AND n >= 128),
f AS (SELECT item, n, i, coalesce(last_value(y IGNORE NULLS) OVER (PARTITION BY item ORDER BY i ROWS UNBOUNDED PRECEDING), first_value(y IGNORE NULLS) OVER (PARTITION BY item ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS y FROM u)
SELECT item, n::BIGINT AS valid_length, (i - 1)::BIGINT AS pos, y FROM f""")
def clean_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = as_arrays(daily(spark, sf_dir)).withColumn("target", F.transform("target", lambda x: F.when(x > 150000, x)))
    return series.clean_windows(a).select("item", F.col("valid_length").cast("long").alias("valid_length"), F.posexplode("target").alias("pos", "y")).withColumn("pos", F.col("pos").cast("long"))


@query("""WITH e AS (SELECT event_type AS g, event_id, CASE WHEN event_id % 3 > 0 THEN value END AS y, value + event_id % 5 - 2 AS f FROM events)
SELECT g, round(avg(abs(y - f)), 6) AS mae, round(sum(abs(y - f)) / sum(abs(y)), 6) AS nd, round(avg((y - f) ** 2), 6) AS mse FROM e WHERE y IS NOT NULL GROUP BY g""")
def missing_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels that are missing count in no metric."""
    e = table(spark, sf_dir, "events")
    rows = e.select(F.col("event_type").alias("g"), F.when(F.col("event_id") % 3 > 0, F.col("value")).alias("y"), (F.col("value") + F.col("event_id") % 5 - 2).alias("f"))
    out = forecast.point_metrics(rows, ["g"], scale=None)
    return out.select("g", *[F.round(c, 6).alias(c) for c in ("mae", "nd", "mse")])

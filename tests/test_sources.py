from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoloom.sources import generators, readers
from chronoloom.streaming import windows


@pytest.mark.parametrize("name", sorted(generators.FAMILIES))
def test_series_depend_on_their_number_alone(name):
    length = 64
    for seed in generators.SEEDS:
        together = generators.simulate(name, seed, list(range(6)), length)
        assert together.shape == (6, length) and together.dtype == np.float32 and np.isfinite(together).all()
        assert np.allclose(generators.simulate(name, seed, [4], length)[0], together[4], rtol=1e-3, atol=1e-3)
    assert not np.allclose(generators.simulate(name, 42, [0], length), generators.simulate(name, 43, [0], length))


def test_corpus_does_not_depend_on_partitions(spark):
    a, b = ({r["series_id"]: r["target"] for r in generators.corpus(spark, "sde", 30, 42, 50, n).collect()} for n in (1, 4))
    assert a == b and len(a) == 30
    with pytest.raises(ValueError, match="no family"):
        generators.corpus(spark, "nothing", 1)


def test_distributions():
    noise = generators.fractional_noise(np.random.default_rng(0).standard_normal((400, 2, 512)), np.full(400, 0.8), 256)
    assert abs(noise.var() - 1) < 0.1
    grown = (np.cumsum(noise, 1)[:, 255] ** 2).mean()
    assert 0.6 < grown / 256**1.6 < 1.4  # variance of fractional motion grows as t^2H
    assert generators.stationary(np.array([0.5])) and not generators.stationary(np.array([1.0])) and generators.stationary(np.array([]))
    rng = np.random.default_rng(1)
    assert all(np.abs(generators.arma_coefficients(rng, 3, "observed")).max() <= 0.3 for _ in range(20))
    assert generators.stationary(generators.arma_coefficients(rng, 2, "intended"))
    k = generators.kernel_matrix("matern32", 1.0, 20)
    assert np.allclose(k, k.T) and np.allclose(np.diag(k), 1) and len(generators.KERNELS) == 41


def test_csv_json_and_appending(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5, ""), ("b", float("nan"), "x")], "k string, v double, note string")
    readers.write_csv(df, str(tmp_path / "t.csv"))
    got = readers.csv(spark, str(tmp_path / "t.csv"), "k string, v double, note string", ["k"]).orderBy("k").collect()
    assert [tuple(r) for r in got] == [("a", 1.5, ""), ("b", None, "x")]
    readers.write_json(df.select("k"), str(tmp_path / "t.json"))
    assert spark.read.json(str(tmp_path / "t.json")).count() == 2
    path = str(tmp_path / "p")
    assert readers.write_new(df, path, ["k"]) == 2 and readers.write_new(df.unionByName(df.limit(1).withColumn("k", F.lit("c"))), path, ["k"]) == 1
    readers.append(df.limit(1), path)
    assert spark.read.parquet(path).count() == 4


def test_stage(spark, tmp_path):
    stage = readers.Stage(spark, str(tmp_path / "stage"))
    assert stage.keys() == []
    for key in ("a", "b"):
        stage.write(key, spark.range(3))
    assert stage.keys() == ["a", "b"] and stage.read("a").count() == 3
    stage.drop("a")
    assert stage.keys() == ["b"]


def test_intended_arima_is_stationary_before_integration(spark):
    y = generators.simulate("arima", 42, list(range(5)), 50, mode="intended")
    assert np.isfinite(y).all() and not np.allclose(y, generators.simulate("arima", 42, list(range(5)), 50))
    assert generators.corpus(spark, "arima", 4, length=30, mode="intended").count() == 4


def test_properties_and_results(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"a": {"domain": "Energy", "frequency": "H", "num_variates": 1},\n "b": {"domain": "Web", "frequency": "D", "num_variates": 2}}')
    assert [tuple(r) for r in readers.properties(spark, str(tmp_path / "p.json")).orderBy("key").collect()] == [("a", "Energy", "H", 1), ("b", "Web", "D", 2)]
    head = "dataset,model," + ",".join(readers.RESULTS.names[2:-2]) + ",domain,num_variates\n"
    for cond in ("center_waveform", "ets"):
        d = tmp_path / "tstr/fam/seed_42" / cond
        d.mkdir(parents=True)
        (d / "all_results.csv").write_text(head + f"x/H/short,{cond}," + ",".join(["1.5"] * 10 + ["inf"]) + ",Energy,1\n")
    got = readers.results(spark, str(tmp_path / "tstr")).orderBy("condition").collect()
    assert [(r["condition"], r["model_family"], r["seed"], r["MASE[0.5]"], r["mean_weighted_sum_quantile_loss"]) for r in got] == [("ets", "fam", 42, 1.5, None), ("waveform", "fam", 42, 1.5, None)]


def test_partitioned_corpus(spark, tmp_path):
    path = str(tmp_path / "c")
    generators.corpora(spark, ["fbm", "sde"], (42, 43), 3, 20).write.partitionBy("generator", "seed").parquet(path)
    found = readers.discovered(spark, path).collect()
    assert [(r["generator"], r["seed"]) for r in found] == [("fbm", 42), ("fbm", 43), ("sde", 42), ("sde", 43)]
    assert readers.corpora(spark, path).where("generator = 'sde' AND seed = 43").count() == 3


def test_arrow_files(spark, tmp_path):
    t = pa.table({"item_id": ["a", "b"], "target": pa.array([[1.0, float("nan")], [2.0]], pa.list_(pa.float32())), "extra": [1, 2]})
    for i, make in enumerate((pa.ipc.new_file, pa.ipc.new_stream)):
        with pa.OSFile(str(tmp_path / f"{i}.arrow"), "wb") as f, make(f, t.schema) as w:
            w.write_table(t)
    schema = T.StructType([T.StructField("item_id", T.StringType()), T.StructField("target", T.ArrayType(T.FloatType()))])
    got = readers.arrow_files(spark, [str(tmp_path / "0.arrow"), str(tmp_path / "1.arrow")], schema).orderBy("item_id").collect()
    assert [tuple(r) for r in got] == [("a", [1.0, None])] * 2 + [("b", [2.0])] * 2


def test_options():
    assert readers.Options({"CHRONOLOOM_DATA_DIR": "/x"}).data_dir == "/x" and readers.Options().results_dir == "results"


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    events = windows.parquet_stream(spark, sf_dir, "events.parquet")
    aggs = {"n": F.count(F.lit(1))}
    out = windows.resampled_stream(events, "ts", "1 hour", "1 day", ["event_type"], **aggs)
    windows.run_available(out, str(tmp_path / "out"), str(tmp_path / "state"))
    batch = windows.resampled(windows.on_event_time(spark.read.parquet(f"{sf_dir}/events.parquet"), "ts"), "ts", "1 hour", ["event_type"], **aggs)
    got, want = ({(r["event_type"], r["ts"]): r["n"] for r in df.collect()} for df in (spark.read.parquet(str(tmp_path / "out")), batch))
    # append mode keeps back what the watermark has not passed
    assert got and got.items() <= want.items() and len(want) - len(got) <= 5 * 26
    windows.run_available(out, str(tmp_path / "out"), str(tmp_path / "state"))
    assert spark.read.parquet(str(tmp_path / "out")).count() >= len(got)


def test_stream_dedup(spark, sf_dir, tmp_path):
    events = windows.parquet_stream(spark, sf_dir, "events.parquet")
    windows.run_available(windows.deduplicated(events, ["user_id"], "ts", "40 days"), str(tmp_path / "o"), str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "o")).count() == spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id").distinct().count()

def test_given_draws_make_the_published_recursions():
    """Batches against plain loops over one series, from the same draws."""
    n = 40
    rngs = [np.random.default_rng([7, i]) for i in range(30)]
    draws = [generators._draw_arima(r, n) for r in rngs]
    got = generators.arima({k: np.array([d[k] for d in draws]) for k in draws[0]}, n)
    seen = set()
    for x, y in zip(draws, got):
        z, total = [], len(x["noise"])
        for t in range(total):
            e = x["noise"][t] + sum(c * x["noise"][t - j - 1] for j, c in enumerate(x["ma"]) if t > j)
            z.append(e + sum(c * z[t - j - 1] for j, c in enumerate(x["ar"]) if t > j))
        m = x["m"]
        if m:
            seen |= {("sar", bool(x["sar"][0])), ("sma", bool(x["sma"][0])), ("sd", x["sd"])}
            for t in range(m, total):
                z[t] += x["sar"][0] * z[t - m]
            z = [v + (x["sma"][0] * x["seasonal_noise"][t - m] if t >= m else 0) for t, v in enumerate(z)]
            z = [v - z[t - m] if t >= m else 0.0 for t, v in enumerate(z)] if x["sd"] else z
        for _ in range(x["d"]):
            z = list(itertools.accumulate(z))
        assert np.allclose(z[-n:], y)
    assert seen == {(k, v) for k in ("sar", "sma", "sd") for v in (False, True)}


def test_steps_pass_into_each_other():
    r = np.random.default_rng(3)
    for kind in range(60):
        n = int(r.integers(3, 9))
        bounds = np.sort(r.choice(np.arange(1, 99), n - 1, replace=False))
        bounds, levels = np.concatenate([[0], bounds]), r.normal(size=n)
        widths, steep = (None if kind % 3 == 0 else r.integers(3, 12, n - 1)), (r.uniform(5, 15, n - 1) if kind % 3 == 2 else None)
        want = [levels[max(i for i in range(n) if bounds[i] <= t)] for t in range(100)]
        for i in range(n - 1) if widths is not None else ():
            lo, hi = max(0, bounds[i + 1] - widths[i] // 2), min(100, bounds[i + 1] + widths[i] // 2)
            for t in range(lo, hi if hi - lo > 1 else lo):
                u = (t - lo) / (hi - 1 - lo)
                want[t] = levels[i] + (levels[i + 1] - levels[i]) * (u if steep is None else 1 / (1 + math.exp(-steep[i] * (u - 0.5))))
        assert np.allclose(generators.stepped(bounds, levels, 100, widths, steep), want)


def test_mean_functions_and_waves_are_what_they_say():
    r = np.random.default_rng(4)
    t = np.linspace(0, 1, 11)
    z = r.normal(size=11)
    made = {k: f((0.5, 2.0, 0.25)[: len(ranges)], t, z) for k, (ranges, f) in generators.MEANS.items()}
    assert np.allclose(made["linear"], 0.5 * t + 2) and np.allclose(made["quadratic"], 0.5 * t**2 + 2 * t + 0.25)
    assert np.allclose(made["sinusoidal"], 0.5 * np.cos(2 * np.pi * 2 * t)) and np.allclose(made["log_linear"], 0.5 * np.log(1 + 2 * t) + 0.25)
    assert np.allclose(made["random_walk"], 0.5 * np.cumsum(z))
    zero = [not generators.mean_function(np.random.default_rng(i), 9).any() for i in range(400)]
    assert 0.4 < np.mean(zero) < 0.6
    x = {k: np.array([v]) for k, v in {"kind": [0, 1, 2], "freq": [1.0, 1.0, 1.0], "amp": [1.0, 2.0, 3.0], "phase": [0.0, 0.0, 0.0], "duty": [0.5, 0.25, 0.5], "falls": [0.0, 0.0, 0.0]}.items()}
    x |= {"beat": np.zeros(1), "noise": np.zeros((1, 8)), "slope": np.ones(1)}
    saw, square, triangle = [2 * k / 8 - 1 for k in range(8)], [2 if k < 2 else -2 for k in range(8)], [3 - 12 * abs(k / 8 - 0.5) for k in range(8)]
    assert np.allclose(generators.waveform(x, 8)[0], [a + b + c + k / 8 for k, (a, b, c) in enumerate(zip(saw, square, triangle))])


def test_kernels_against_their_formulas_and_sums_of_compositions():
    n = 12
    t = [i / (n - 1) for i in range(n)]
    want = {
        "rbf": lambda a, b, v: math.exp(-0.5 * ((a - b) / v) ** 2), "dot": lambda a, b, v: v * v + a * b, "rational": lambda a, b, v: (1 + (a - b) ** 2 / (2 * v)) ** -v,
        "periodic": lambda a, b, v: math.exp(-2 * math.sin(math.pi * abs(a - b) * n / v) ** 2), "white": lambda a, b, v: v * (a == b), "matern12": lambda a, b, v: math.exp(-abs(a - b) / v),
    }
    for kind, f in want.items():
        assert np.allclose(generators.kernel_matrix(kind, 0.7, n), [[f(a, b, 0.7) for b in t] for a in t]), kind
    z = np.random.default_rng(1).normal(size=(4000, n))
    k = next(i for i, (kind, _) in enumerate(generators.KERNELS) if kind == "rbf")
    x = {"kernels": np.tile([k, k, -1, -1, -1], (4000, 1)), "added": np.tile([True, False, True, True, True], (4000, 1)), "z": z, "mean": np.zeros((4000, n))}
    cov = generators.kernel_matrix(*generators.KERNELS[k], n) ** 2
    assert np.abs(np.cov(generators.kernelsynth(x, n).T) - cov).max() < 0.15


def test_composition_models():
    a, b, c = (np.array([[v, 2 * v]]) for v in (1.0, 3.0, 5.0))
    models = [a + b + c, (a + b) * (1 + 0.1 * c), (a + c) * (1 + 0.1 * b), (b + c) * (1 + 0.1 * a), a * (1 + 0.1 * b) + c, a * (1 + 0.1 * c) + b, b * (1 + 0.1 * c) + a, a * (1 + 0.1 * b) * (1 + 0.1 * c)]
    for k, m in enumerate(models):
        assert np.allclose(generators.tsi({"trend": a, "season": b, "noise": c, "model": np.array([k])}, 2), m)

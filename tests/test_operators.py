"""Operators on small literals with expectations worked out by hand, and properties."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chronoloom import schema
from chronoloom.functions import arrays, calendar, numeric, text
from chronoloom.operators import compare, coverage, distribution, features, forecast, preprocess, relational, sampling, series

NAN, INF = float("nan"), float("inf")


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_missing_values_become_null(spark):
    df = spark.createDataFrame([(1, NAN, [1.0, INF]), (2, 2.0, [None, 3.0])], "i int, x double, a array<double>")
    assert rows(schema.nulls_for_nan(df), "i") == [(1, None, [1.0, None]), (2, 2.0, [None, 3.0])]
    with pytest.raises(ValueError, match="z"):
        schema.require(df, "x", "z")


def test_geometric_mean_skips_what_is_not_positive(spark):
    df = spark.createDataFrame([("a", 2.0), ("a", 8.0), ("a", 0.0), ("a", None), ("b", -1.0)], "k string, x double")
    assert rows(df.groupBy("k").agg(numeric.geometric_mean(F.col("x"))), "k") == [("a", pytest.approx(4.0)), ("b", None)]


def test_scalar_functions(spark):
    df = spark.createDataFrame([(-20.0, 0.0)], "x double, y double")
    r = df.select(numeric.clip(F.col("x"), -10, 10), numeric.signed_log1p(F.col("x")), numeric.ratio(F.col("x"), F.col("y")), numeric.zero_for_missing(F.lit(NAN)), numeric.is_close(F.lit(1.0), F.lit(1.0 + 1e-13)), numeric.round_half_even(F.lit(2.5), 0)).first()
    assert tuple(r) == (-10.0, pytest.approx(-math.log(21)), None, 0.0, True, 2.0)


def test_ranks_leave_null_out_and_share_ties(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 2.0), ("d", None)], "k string, crps double").withColumn("mase", F.col("crps"))
    assert [(r["k"], r["crps_rank"]) for r in compare.ranked(df).orderBy("k").collect()] == [("a", 1), ("b", 1), ("c", 3), ("d", None)]


def test_one_seed_has_no_spread(spark):
    df = spark.createDataFrame([("a", 1, 2.0), ("b", 1, 1.0), ("b", 2, 3.0)], "c string, seed int, crps double")
    assert rows(compare.over_seeds(df, ["c"], ["crps"]), "c") == [("a", 1, 2.0, 0.0), ("b", 2, 2.0, pytest.approx(math.sqrt(2)))]


def test_best_mark_tolerates_rounding(spark):
    df = spark.createDataFrame([("a", 0.1 + 0.2), ("b", 0.3), ("c", 1.0), ("d", None)], "k string, v double").withColumn("g", F.lit(1))
    assert [r["best"] for r in compare.marked_best(df, ["g"], "v").orderBy("k").collect()] == [True, True, False, False]


def test_bootstrap_repeats_numpy(spark):
    d = [0.1, -0.2, 0.05, -0.4, 0.3]
    df = spark.createDataFrame(list(enumerate(d)), "i int, d double")
    r = compare.bootstrap(df, ["i"], 2000, 42).first()
    x = np.array(d)
    means = x[np.random.default_rng(42).integers(0, 5, size=(2000, 5))].mean(axis=1)
    assert r["ci_low"] == pytest.approx(math.exp(np.percentile(means, 2.5)) - 1)
    assert r["p_a_better"] == pytest.approx((means < 0).mean()) and r["win_rate"] == 0.4
    p = compare.poisson_bootstrap(df, ["i"], 2000).first()
    assert abs(p["ci_low"] - r["ci_low"]) < 0.1 and abs(p["ci_high"] - r["ci_high"]) < 0.1


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.floats(0.01, 100), st.floats(0.01, 100)), min_size=1, max_size=8))
def test_ratio_of_geometric_means_is_mean_log_ratio(spark, values):
    df = spark.createDataFrame([(i, c, v) for i, ab in enumerate(values) for c, v in zip("ab", ab)], "dataset int, c string, e double")
    a, b = (df.where(F.col("c") == c).agg(numeric.geometric_mean(F.col("e"))).first()[0] for c in "ab")
    assert compare.paired_summary(compare.pairs(df, "c", "a", "b", ["dataset"], "e")).first()["rel_delta"] == pytest.approx(a / b - 1, abs=1e-9)


def test_comparison_driver(spark):
    r = spark.createDataFrame([("x", 1), ("y", 2), ("real", 3)], "label string, crps_rank long")
    assert rows(compare.against_second_and_anchors(r, "label", ["real", "mixed", "x"]), "b") == [("x", "mixed"), ("x", "real"), ("x", "y")]


def test_relational_defaults(spark):
    a = spark.createDataFrame([("p", "A"), ("q", "Z")], "k string, f string")
    b = spark.createDataFrame([("A", 1)], "f string, n int")
    assert rows(relational.looked_up(a, b, ["f"], {"n": -1}).select("k", "n"), "k") == [("p", 1), ("q", -1)]
    assert rows(relational.with_columns_or(a, {"z": "--", "f": "?"}), "k") == [("p", "A", "--"), ("q", "Z", "--")]


def test_prefix_sums_across_ranges(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"), (F.col("id") % 2).cast("string").alias("g"), F.lit(2).alias("v")).repartition(6)
    got = {r["k"]: r["s"] for r in relational.prefix_sum(df, "k", F.col("v"), "s", buckets=16).collect()}
    assert got == {k: 2 * k for k in range(1000)}
    per = relational.prefix_sum(df, "k", F.lit(1), "s", ["g"], buckets=16)
    assert per.columns == ["k", "g", "v", "s"] and per.groupBy("g").agg(F.max("s"), F.count_distinct("s")).orderBy("g").collect() == [("0", 499, 500), ("1", 499, 500)]
    assert relational.prefix_sum(df.limit(0), "k", F.lit(1), "s").count() == 0


def test_calendar(spark):
    f = ["15T", "5min", "H", "W-SUN", "ME", "10S", "7H"]
    df = spark.createDataFrame([(x,) for x in f], "f string")
    got = {r[0]: (r[1], r[2]) for r in df.select("f", calendar.unit(F.col("f")), calendar.season(F.col("f"))).collect()}
    assert got == {"15T": ("T", 96), "5min": ("T", 288), "H": ("H", 24), "W-SUN": ("W", 1), "ME": ("M", 12), "10S": ("S", 360), "7H": ("H", 1)}
    r = spark.range(1).select(calendar.horizon_of(F.lit("a/b/long")), calendar.horizon_of(F.lit("a")), calendar.file_stem(F.lit("a/b")), calendar.later(F.lit(dt.datetime(2020, 1, 31)), F.lit("M"), F.lit(1))).first()
    assert tuple(r) == ("long", "unknown", "a-b", dt.datetime(2020, 2, 29))


def test_cells(spark):
    r = spark.range(1).select(text.number(F.lit(None).cast("double")), text.mean_and_spread(F.lit(0.844), F.lit(0.006), best=F.lit(True)), text.percent(F.lit(0.5)), text.interval(F.lit(-0.1), F.lit(0.2))).first()
    assert tuple(r) == ("--", "★ 0.84 ± 0.01", "50.0%", "[-0.100, 0.200]")


SERIES = [[1.0, None, 3.0, None], [None, 2.0, None, 4.0], [None, None], [5.0], []]


def test_gaps_in_arrays(spark):
    df = spark.createDataFrame(list(enumerate(SERIES)), "i int, target array<float>")
    assert rows(df.select("i", arrays.trim_trailing_nulls(F.col("target"))), "i") == [(0, [1.0, None, 3.0]), (1, [None, 2.0, None, 4.0]), (2, []), (3, [5.0]), (4, [])]
    assert rows(series.filled_arrays(df), "i") == [(0, [1.0, 1.0, 3.0]), (1, [2.0, 2.0, 2.0, 4.0]), (3, [5.0])]
    assert [r["valid_length"] for r in series.clean_windows(df, least=3).orderBy("i").collect()] == [3, 4]
    assert df.where("i = 0").select(arrays.pad_right(F.col("target"), 6)).first()[0] == [1.0, None, 3.0, None, None, None]
    assert df.where("i = 3").select(arrays.edge_pad(F.col("target"), 3)).first()[0] == [5.0] * 3


def test_windows_do_not_overlap_and_stay_inside(spark):
    df = spark.createDataFrame([(n, [float(x) for x in range(n)]) for n in (3, 4, 5, 9, 40)], "item_id int, target array<float>")
    got = [(r["item_id"], r["window_index"], r["target"]) for r in series.windows(df, 4, 3).orderBy("item_id", "window_index").collect()]
    assert got == [(n, k, [4.0 * k + j for j in range(4)]) for n, most in ((4, 1), (5, 1), (9, 2), (40, 3)) for k in range(most)]
    r = series.random_window(df, 4, 1).collect()
    assert {x["item_id"] for x in r} == {4, 5, 9, 40} and all(x["target"] == [x["start_index"] + j for j in range(4)] for x in r)


def test_rolling_origins(spark):
    df = spark.createDataFrame([([float(x) for x in range(10)],)], "target array<float>")
    w = series.test_windows(df, F.lit(2), F.lit(3)).orderBy("window_idx").collect()
    assert [(len(r["past"]), r["label"]) for r in w] == [(4, [4, 5]), (6, [6, 7]), (8, [8, 9])]
    assert len(series.training_part(df, F.lit(2), F.lit(3)).first()["target"]) == 2 and len(series.validation_part(df, F.lit(2), F.lit(3)).first()["target"]) == 4


def test_rows_along_time(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate([None, 2.0, None, None, 8.0, None])], "k string, t int, v double")
    assert [r["v"] for r in series.filled(df, "v", "t", ["k"]).orderBy("t").collect()] == [2, 2, 2, 2, 8, 8]
    assert [r["v"] for r in series.interpolated(df, "v", "t", ["k"]).orderBy("t").collect()] == [2, 2, 4, 6, 8, 8]
    assert series.without_trailing_gaps(df, "v", "t", ["k"]).count() == 5


def test_perfect_and_constant_forecasts(spark):
    w = spark.createDataFrame([("a", [1.0, 2.0, 3.0, 4.0] * 3, [1.0, 2.0, None, 4.0])], "item string, past array<double>, label array<double>")
    f = forecast.predicted(w, ["item"], 4, 4)
    m = forecast.evaluated(w, f, ["item"], ["item"], 4).first()
    assert m["mae"] == 0 and m["mse"] == 0 and m["nd"] == 0 and m["mean_weighted_sum_quantile_loss"] == 0 and m["mase"] is None


def test_metrics_by_hand(spark):
    r = spark.createDataFrame([(2.0, 1.0, 2.0), (4.0, 6.0, 2.0), (None, 1.0, 2.0)], "y double, f double, scale double")
    m = forecast.point_metrics(r).first()
    assert (m["mae"], m["mse"], m["nd"], m["mase"]) == (1.5, 2.5, 0.5, 0.75)
    assert m["mape"] == pytest.approx(0.5) and m["smape"] == pytest.approx((2 / 3 + 0.4) / 2) and m["nrmse"] == pytest.approx(math.sqrt(2.5) / 3)
    q = r.withColumns({"q_low": F.lit(3.0), "q_high": F.lit(5.0)})
    assert forecast.interval_score(q).first()[0] == pytest.approx(((2 + 40) / 2 + 2 / 2) / 2)
    levels = spark.createDataFrame([(10.0, 0.1, 8.0), (10.0, 0.9, 11.0)], "y double, level double, value double")
    assert forecast.quantile_loss(levels).first()[0] == pytest.approx((2 * 2 * 0.1 + 2 * 1 * 0.1) / 10 / 2)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("AB"), st.sampled_from("xy"), st.integers(1, 10**6), st.integers(0, 500)), min_size=1, max_size=12), st.integers(1, 2000))
def test_allocation_adds_up_within_supply(parts, total):
    index = pd.DataFrame([(f"d{i}", f, d, o, s) for i, (f, d, o, s) in enumerate(parts)], columns=["name", "freq", "domain", "total_obs", "supply"])
    a = sampling.allocate(index, total, floor=5)
    assert a["count"].sum() == min(total, index["supply"].sum()) and (a["count"] <= a["supply"]).all() and (a["count"] >= 0).all()


def test_draws_do_not_depend_on_partitions(spark):
    df = spark.range(500).select(F.col("id").alias("k"), (F.col("id") % 3).cast("string").alias("c"))
    a, b = (sampling.fixed_size_sample(df.repartition(n), 50, ["k"], 1) for n in (1, 7))
    assert rows(a, "k") == rows(b, "k")
    halves = sampling.random_halves(df, ["k"])
    assert halves.groupBy("half").count().agg(F.max("count") - F.min("count")).first()[0] == 0
    m = sampling.mixture(3000, df, "c", "k", {"0": 0.7, "1": 0.3}, 2)
    share = m.where("c = '0'").count() / m.count()
    assert m.count() == 3000 and abs(share - 0.7) < 0.05
    assert [r["k"] for r in sampling.evenly_spaced(df, "k", 3).orderBy("k").collect()] == [0, 249, 499]


def test_backfill_reaches_the_total(spark):
    w = spark.createDataFrame([("a" if i < 20 else "b", i, 0) for i in range(40)], "dataset string, item_id int, window_index int")
    a = spark.createDataFrame([("a", 15, 20), ("b", 5, 20), ("gone", 4, 9)], "name string, count int, supply int")
    first = sampling.accepted(w, a, oversample=1)
    full = sampling.backfilled(first, w, a, 24)
    assert full.count() == 24 and full.select("item_id").distinct().count() == 24
    total = sampling.accounting(full, a).where("dataset IS NULL").first()
    assert total["allocated"] == 24 and total["shortfall"] == 4


def test_ks(spark):
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=80).round(1), rng.normal(0.8, 1, 60).round(1)
    data = [("f", False, float(x)) for x in a] + [("f", True, float(x)) for x in b] + [("f", True, NAN), ("empty", False, 1.0)]
    got = {r["feature"]: r for r in distribution.ks_tests(spark.createDataFrame(data, "feature string, s boolean, v double"), "v", "s").collect()}
    grid = np.unique(np.r_[a, b])
    want = max(abs((a <= x).mean() - (b <= x).mean()) for x in grid)
    assert got["f"]["d"] == pytest.approx(want) and 0 < got["f"]["p"] < 0.01
    assert got["empty"]["d"] is None and got["empty"]["p"] == 1.0
    p = spark.createDataFrame([(i, x) for i, x in enumerate([0.01, 0.04, 0.03, 0.5])], "i int, p double")
    assert [r["p_adjusted"] for r in distribution.adjusted(p).orderBy("i").collect()] == pytest.approx([0.04, 0.16 / 3, 0.16 / 3, 0.5])


def cloud(spark, x, start=0):
    return spark.createDataFrame([(start + i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, x array<double>")


def test_coverage_of_identical_and_distant_clouds(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 3))
    same, far = cloud(spark, x), cloud(spark, x + 100, 1000)
    r = coverage.prdc(same, cloud(spark, x, 1000)).first()
    assert (r["precision"], r["recall"], r["coverage"]) == (1, 1, 1)
    assert coverage.frechet(same, same) == pytest.approx(0, abs=1e-6)
    r = coverage.prdc(same, far).first()
    assert tuple(r) == (0, 0, 0, 0)
    assert coverage.authenticity(same, same).first()[0] == 0 and coverage.authenticity(same, far).first()[0] == 1
    m, c = coverage.moments(same)
    assert np.allclose(m, x.mean(0)) and np.allclose(c, np.cov(x, rowvar=False))
    assert coverage.alpha_beta(same, same).first()["alpha_precision"] > 0.9


def test_neighbours_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(coverage, "BLOCK_BYTES", 200)  # several blocks
    x = np.random.default_rng(2).integers(0, 4, (40, 2)).astype(float)
    got = {(r["id"], r["rank"]): (r["neighbour"], r["distance"]) for r in coverage.neighbours(cloud(spark, x), cloud(spark, x), 3).collect()}
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    for i in range(40):
        order = sorted(range(40), key=lambda j: (d[i, j], j))[:3]
        assert [got[i, k + 1] for k in range(3)] == [(j, pytest.approx(d[i, j])) for j in order]


def test_features_are_finite_and_tell_series_apart(spark):
    t = np.arange(400)
    rng = np.random.default_rng(3)
    wave, noise = np.sin(2 * np.pi * t / 20) + 0.05 * rng.normal(size=400), rng.normal(size=400)
    a, b = features.features(wave), features.features(noise)
    assert set(a) == set(features.FEATURES) and all(map(math.isfinite, [*a.values(), *b.values()]))
    assert a["seasonal_strength"] > 0.9 > b["seasonal_strength"] and a["spectral_entropy"] < b["spectral_entropy"] and a["PD_PeriodicityWang_th0_01"] == 20
    assert features.features(np.cumsum(noise))["kpss"] > b["kpss"]
    assert math.isnan(features.features(np.ones(50))["kpss"])
    df = spark.createDataFrame([("w", wave.tolist()), ("short", [1.0]), ("none", None)], "k string, target array<double>")
    out = {r["k"]: r for r in features.extracted(df, ["k"]).collect()}
    assert out["w"]["kpss"] == pytest.approx(a["kpss"]) and out["short"]["kpss"] is None and out["none"]["kpss"] is None


def test_scaler_and_triage(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=200)
    df = spark.createDataFrame([(float(a), float(a * 2 + 0.01 * b), float(b)) for a, b in zip(x, rng.normal(size=200))], "p double, q double, r double")
    s = preprocess.fit(df, ["p", "q", "r"], ("r",))
    got = s.transform(df).agg(F.avg("p"), F.stddev_pop("q")).first()
    assert got[0] == pytest.approx(0, abs=1e-9) and got[1] == pytest.approx(1)
    assert s.transform(spark.createDataFrame([(1e9, NAN, None)], "p double, q double, r double")).first()["p"] == 10.0
    assert preprocess.triage(df, {"p": 0.1, "q": 0.5, "r": 0.2}, ["p", "q", "r"]) == ["q", "r"]


def test_range_sums_per_group_and_of_several_values(spark):
    data = [(k % 3 if k % 3 else None, float(v), k) for k, v in enumerate([5, 1, 1, 9, 2, 7, 2, 2, 8, 0, 3, 3] * 20)]
    df = spark.createDataFrame(data, "g int, v double, k int").repartition(5)
    counts = df.groupBy("g", "v").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("t"))
    got = {(r["g"], r["v"]): (r["a"], r["b"]) for r in relational.prefix_sums(counts, "v", {"a": F.col("n"), "b": F.col("t")}, ["g"], buckets=4).collect()}
    assert got == {(g, v): (sum(h == g and w < v for h, w, _ in data), sum(k for h, w, k in data if h == g and w < v)) for g, v, _ in data}


def test_packing_keeps_to_the_room(spark):
    r = np.random.default_rng(3)
    sizes = [int(x) for x in r.integers(0, 90, 900)]
    sizes[17] = 250  # longer than a bin
    df = spark.createDataFrame([(i, n, "x") for i, n in enumerate(sizes)], "i long, n long, bin_ string").repartition(6)
    got = sorted((x["bin"], x["position"], x["i"], x["n"]) for x in sampling.packed(df, "n", "i", 100, share=8).collect())
    assert len(got) == 900 and [x[2] for x in got] == sorted(x[2] for x in got)
    bins: dict = {}
    for b, at, _, n in got:
        assert at == bins.get(b, 0)
        bins[b] = at + n
    assert [b for b, used in bins.items() if used > 100] == [b for b, _, i, _ in got if i == 17]
    # no more than twice the bins that are needed, and one for each share
    assert len(bins) <= 2 * sum(sizes) / 100 + sum(sizes) / 800 + 2
    assert sampling.packed(df.limit(0), "n", "i", 100).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.floats(0, 50), st.integers(0, 60)), min_size=1, max_size=7), st.integers(0, 150))
def test_whole_numbers_by_largest_remainders(parts, total):
    exact, room = np.array([x for x, _ in parts]), np.array([r for _, r in parts])
    total = int(min(total, room.sum()))
    got = sampling._largest_remainders(exact, total, room)
    # one unit at a time: floors, then the largest remainders once, then the largest headroom
    want = [min(math.floor(x + 1e-9), r) for x, r in parts]
    for i in sorted(range(len(parts)), key=lambda i: -(exact[i] - want[i])):
        if sum(want) < total and want[i] < room[i]:
            want[i] += 1
    floors = [min(math.floor(x + 1e-9), r) for x, r in parts]
    if sum(floors) <= total:
        assert got.sum() == total and all(g >= f for g, f in zip(got, floors)) and (got <= room).all()
        if sum(want) == total:
            assert got.tolist() == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.floats(0.1, 50), st.floats(0, 60)), min_size=1, max_size=6), st.floats(0, 200))
def test_capped_shares_fill_in_proportion(parts, total):
    weights, cap = np.array([w for w, _ in parts]), np.array([c for _, c in parts])
    got = sampling._capped_shares(weights, total, cap, rounds=20)
    assert (got <= cap + 1e-9).all() and got.sum() == pytest.approx(min(total, cap.sum()), abs=1e-6)
    # water level: those below their cap have equal shares of their weights, those at it no larger ones
    level = (got / weights)[got < cap - 1e-9]
    if len(level):
        assert np.allclose(level, level[0]) and ((got / weights) <= level[0] + 1e-9).all()


def test_allocation_by_hand():
    index = pd.DataFrame([("a", "H", "x", 900, 100), ("b", "H", "x", 100, 100), ("c", "D", "x", 1000, 30), ("d", "D", "y", 10, 50)], columns=["name", "freq", "domain", "total_obs", "supply"])
    got = sampling.allocate(index, 100, floor=10).set_index("name")
    # strata by observations want 49.75, 49.75 and 10 (the floor), that is 45.4, 45.4 and 9.1 of 100; c gives 30 at most
    assert got["count"].sum() == 100 and got.loc["c", "count"] == 30
    rest = got["count"].drop("c")
    assert rest["a"] + rest["b"] == round(70 * 49.75 / 59.75) and rest["a"] == math.ceil(0.5 * (rest["a"] + rest["b"]))
    share = index.set_index("name")["total_obs"] / 2010
    assert got["weight"].to_numpy() == pytest.approx((share / (got["count"] / 100)).to_numpy())


def test_frechet_distance_by_eigenvalues(spark):
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=(70, 4)) @ rng.normal(size=(4, 4)), rng.normal(1, 2, size=(50, 4))
    c1, c2 = np.cov(a, rowvar=False), np.cov(b, rowvar=False)
    # the trace of the root of a product is the sum of the roots of its eigenvalues
    root = np.sqrt(np.maximum(np.linalg.eigvals(c1 @ c2).real, 0)).sum()
    want = ((a.mean(0) - b.mean(0)) ** 2).sum() + np.trace(c1) + np.trace(c2) - 2 * root
    assert coverage.frechet(cloud(spark, a), cloud(spark, b, 1000)) == pytest.approx(want)


def test_null_baseline_is_the_metrics_of_halves(spark):
    x = cloud(spark, np.random.default_rng(6).normal(size=(40, 2)))
    got = {r["metric"]: (r["mean"], r["std"]) for r in coverage.null_baseline(x, splits=2, k=3).collect()}
    each = []
    for i in range(2):
        halves = sampling.random_halves(x, ["id"], i)
        each.append(coverage.all_metrics(halves.where("half = 1").drop("half"), halves.where("half = 2").drop("half"), 3).first().asDict())
    assert len(got) == 9 and all(got[m] == (pytest.approx(np.mean([e[m] for e in each])), pytest.approx(np.std([e[m] for e in each]), abs=1e-12)) for m in each[0])
    assert coverage.capped(x, 7).count() == 7 and coverage.capped(x).count() == 40
    assert rows(coverage.capped(x, 7), "id") == rows(coverage.capped(x.repartition(3), 7), "id")


def test_null_baseline_takes_as_many_jobs_for_any_number_of_splits(spark):
    x = cloud(spark, np.random.default_rng(8).normal(size=(60, 3)))
    n = []
    for splits in (1, 4):
        spark.sparkContext.setJobGroup(f"null{splits}", "")
        assert coverage.null_baseline(x, splits, 3).count() == 9
        n.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"null{splits}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert n[1] <= n[0] + 3 and n[1] < 60


def test_points_found_by_bounds_are_those_of_all_distances(monkeypatch):
    """Ties, equal points, clouds far from 0, very small, large and infinite values: to the same bit."""
    monkeypatch.setattr(coverage, "TILE", 32)
    r = np.random.default_rng(9)
    for t in range(160):
        n, m, d = r.integers(1, 40), r.integers(1, 200), r.integers(1, 70)
        x, y = r.normal(size=(n, d)), r.normal(size=(m, d))
        if t % 8 == 1:
            x, y = np.round(x), np.round(y)
        elif t % 8 == 2:
            x, y = x + 1e6, y + 1e6
        elif t % 8 == 3:
            y[:] = x[0]
        elif t % 8 in (4, 5):
            x, y = (v * (1e-200 if t % 8 == 4 else 1e170) for v in (x, y))
        elif t % 8 == 6:
            y[0, 0] = r.choice([np.nan, np.inf])
        elif t % 8 == 7:
            x[: min(n, m)] = y[: min(n, m)]
            x[0] *= 1e9
        at, k, block = np.flatnonzero(r.random(m) < 0.7), int(r.integers(1, 8)), coverage.Block(np.arange(m), y)
        with np.errstate(all="ignore"):
            every = coverage.distances(x, y[at])
            order = np.argsort(every, 1, kind="stable")[:, :k]
            got, place = block.nearest(x, at, k)
            assert np.array_equal(got, np.take_along_axis(every, order, 1), equal_nan=True) and np.array_equal(place, at[order])
            radius = r.choice([0.0, 1.0, *every.ravel()], len(at))
            assert np.array_equal(block.holding(x, at, radius), (every < radius).sum(1))


def test_composition_table(spark):
    data = [("e", c, h, s, f"t{k}", 1.0 + k + s + (c == "b")) for c in "ab" for h in ("short", "long") for s in (1, 2) for k in range(3)]
    df = spark.createDataFrame(data, "domain string, condition string, horizon string, seed int, dataset string, crps double")
    got = {(r["condition"], r["horizon"]): r for r in compare.composition_table(df, "domain", "condition", "horizon").collect()}
    for (c, _), r in got.items():
        per = [np.exp(np.mean([np.log(1.0 + k + s + (c == "b")) for k in range(3)])) for s in (1, 2)]
        assert r["crps_mean"] == pytest.approx(np.mean(per)) and r["crps_std"] == pytest.approx(np.std(per, ddof=1)) and r["best"] == (c == "a")


def test_poisson_interval_is_the_weighted_means(spark):
    r = np.random.default_rng(7)
    d = [float(x) for x in r.normal(-0.05, 0.4, 300)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate([*d, None])], "i int, d double")
    one, many = (compare.poisson_bootstrap(df.repartition(n), ["i"], 3000).first() for n in (1, 6))
    assert one["ci_low"] == pytest.approx(many["ci_low"]) and one["p_a_better"] == pytest.approx(many["p_a_better"])
    # near the normal approximation of the mean
    m, s = np.mean(d), np.std(d) / math.sqrt(300)
    assert math.log1p(one["ci_low"]) == pytest.approx(m - 1.96 * s, abs=0.012) and math.log1p(one["ci_high"]) == pytest.approx(m + 1.96 * s, abs=0.012)
    assert one["p_a_better"] == pytest.approx(0.5 * (1 + math.erf(-m / s / math.sqrt(2))), abs=0.03)


def test_padding_and_shapes_of_arrays(spark):
    from chronoloom.functions import arrays

    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0])], "i int, a array<double>")
    a = F.col("a")
    got = df.select(arrays.edge_pad(a, 5), arrays.edge_pad(a, 2), arrays.as_multivariate(a), arrays.three_tap(a, (1.0, 2.0, 3.0)), arrays.differences(a, 2)).first()
    assert [list(x) for x in got] == [[1, 2, 3, 3, 3], [1, 2], [[1, 2, 3]], [8, 14, 8], [2]]


def test_equal_series_are_found_by_value(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [1.0, 2.0]), ("c", [2.0, 1.0]), ("d", [1.0])], "item string, target array<double>")
    assert [(r["length"], r["n"], r["first_item"]) for r in series.duplicates(df, "item").collect()] == [(2, 2, "a")]

"""Every feature against its definition in plain Python loops."""

from __future__ import annotations

import cmath
import math
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoloom.operators import features


def mean(x):
    return math.fsum(x) / len(x)


def var(x):
    m = mean(x)
    return math.fsum((v - m) ** 2 for v in x) / len(x)


def z_scores(x):
    m, s = mean(x), math.sqrt(var(x))
    return [(v - m) / s for v in x]


def acf(x, lags=None):
    n, m = len(x), mean(x)
    d = [v - m for v in x]
    c = [math.fsum(d[t] * d[t + k] for t in range(n - k)) for k in range(n if lags is None else min(n, lags + 1))]
    return [v / c[0] for v in c]


def quantile(x, q):
    s = sorted(x)
    at = q * (len(s) - 1)
    k = int(at)
    return s[k] + (at - k) * (s[min(k + 1, len(s) - 1)] - s[k])


def bins(x, n):
    low, high = min(x), max(x)
    count = [0] * n
    for v in x:
        count[min(n - 1, int((v - low) / (high - low) * n))] += 1
    return count, low, (high - low) / n


def mode(x, n):
    count, low, width = bins(x, n)
    return mean([low + (k + 0.5) * width for k in range(n) if count[k] == max(count)])


def below(ac, level):
    return next((k for k, v in enumerate(ac) if v < level), len(ac))


def thirds(x):
    a, b = quantile(x, 1 / 3), quantile(x, 2 / 3)
    return [(v > a) + (v > b) for v in x]


def line(u, v):
    """Intercept, slope and squared error of the best line."""
    mu, mv = mean(u), mean(v)
    slope = sum((a - mu) * (b - mv) for a, b in zip(u, v)) / sum((a - mu) ** 2 for a in u)
    return mv - slope * mu, slope, sum((b - mv - slope * (a - mu)) ** 2 for a, b in zip(u, v))


def wang(x):
    n = len(x)
    sizes = [n // 3 + (k < n % 3) for k in range(3)]
    starts = [0, sizes[0], sizes[0] + sizes[1]]
    centre = [s + (k - 1) / 2 for s, k in zip(starts, sizes)]
    level = [mean(x[s : s + k]) for s, k in zip(starts, sizes)]

    def smooth(t):
        if t <= centre[0]:
            return level[0]
        if t >= centre[2]:
            return level[2]
        i = 0 if t < centre[1] else 1
        return level[i] + (level[i + 1] - level[i]) * (t - centre[i]) / (centre[i + 1] - centre[i])

    ac = acf([v - smooth(t) for t, v in enumerate(x)], n // 3)
    trough = None
    for k in range(1, len(ac) - 1):
        if ac[k] < ac[k - 1] and ac[k] <= ac[k + 1]:
            trough = ac[k]
        if trough is not None and ac[k] > ac[k - 1] and ac[k] >= ac[k + 1] and ac[k] > 0 and ac[k] > trough + 0.01:
            return k
    return 0


def embedding(x, tau):
    tau = max(1, min(tau, len(x) // 10))
    p = [(x[t], x[t + tau]) for t in range(len(x) - tau)]
    d = [math.dist(a, b) for a, b in zip(p, p[1:])]
    count, low, width = bins(d, max(3, math.ceil(math.sqrt(len(d)))))
    m = mean(d)
    return mean([abs(c / (len(d) * width) - math.exp(-(low + (k + 0.5) * width) / m) / m) for k, c in enumerate(count)])


def outliers(x, sign):
    n, y = len(x), [sign * v for v in x]
    medians = []
    for k in range(10**6):
        level = k * 0.01
        if level >= max(y) + 0.005:
            break
        at = [t for t in range(n) if y[t] >= level]
        if len(at) > max(2, 0.02 * n):
            medians.append(statistics.median(at) / (n / 2) - 1)
    return statistics.median(medians) if medians else 0.0


def fluctuation(x, rescaled):
    n, m = len(x), mean(x)
    y, total = [], 0.0
    for v in x:
        total += v - m
        y.append(total)
    scales = sorted({round(math.exp(math.log(5) + k * (math.log(max(6, n // 2)) - math.log(5)) / 49)) for k in range(50)})
    f = []
    for s in scales:
        rests = []
        for b in range(n // s):
            a, slope, _ = line(list(range(s)), y[b * s : b * s + s])
            rests.append([v - a - slope * t for t, v in enumerate(y[b * s : b * s + s])])
        f.append(math.sqrt(mean([(max(r) - min(r)) ** 2 for r in rests])) if rescaled else math.sqrt(mean([v * v for r in rests for v in r])))
    u, v = [math.log(s) for s in scales], [math.log(w) for w in f]
    errors = [line(u[: i + 1], v[: i + 1])[2] + line(u[i:], v[i:])[2] for i in range(3, len(u) - 3)]
    return (errors.index(min(errors)) + 4) / len(u)


def spectrum(x):
    n, m = len(x), mean(x)
    return [abs(sum((v - m) * cmath.exp(-2j * math.pi * k * t / n) for t, v in enumerate(x))) ** 2 / n for k in range(n // 2 + 1)]


def parts(x, m):
    n, w = len(x), max(3, m + 1 - m % 2)
    trend = [mean([x[min(n - 1, max(0, t + k))] for k in range(-(w // 2), w // 2 + 1)]) for t in range(n)]
    rest = [a - b for a, b in zip(x, trend)]
    season = [mean([rest[s] for s in range(t % m, n, m)]) if m > 1 else 0.0 for t in range(n)]
    shift = mean(season)
    season = [s - shift for s in season]
    return trend, season, [a - b for a, b in zip(rest, season)]


def share(part, rest):
    return max(0.0, 1 - var(rest) / var([a + b for a, b in zip(part, rest)]))


def arch(x, lags=12):
    e = [v * v for v in (w - mean(x) for w in x)]
    rows = [[1.0, *(e[t - k] for k in range(1, lags + 1))] for t in range(lags, len(e))]
    y = e[lags:]
    a = np.array(rows)
    beta = np.linalg.solve(a.T @ a, a.T @ np.array(y))  # the normal equations
    rest = [v - sum(b * c for b, c in zip(beta, r)) for v, r in zip(y, rows)]
    return len(y) * (1 - var(rest) / var(y))


def stationarity(x):
    n, m = len(x), mean(x)
    e = [v - m for v in x]
    lags = math.ceil(12 * (n / 100) ** 0.25)
    v = sum(w * w for w in e) / n + 2 * sum((1 - k / (lags + 1)) * sum(e[t] * e[t - k] for t in range(k, n)) / n for k in range(1, lags + 1))
    total, sums = 0.0, 0.0
    for w in e:
        total += w
        sums += total**2
    return sums / (n * n * v)


def plain_features(x):
    z = z_scores(x)
    ac, d, s = acf(z), [b - a for a, b in zip(z, z[1:])], thirds(z)
    tau = max(1, below(ac, 0))
    every = thirds(z[::tau])
    moves = [[sum(a == i and b == j for a, b in zip(every, every[1:])) / max(1, len(every) - 1) for j in range(3)] for i in range(3)]
    pairs = [sum(a == i and b == j for a, b in zip(s, s[1:])) / (len(s) - 1) for i in range(3) for j in range(3)]
    crossing = below(ac, 1 / math.e)
    run = longest = 0
    for v in d:
        run = run + 1 if v < 0 else 0
        longest = max(longest, run)
    p = spectrum(z)
    half = next(k for k in range(len(p)) if sum(p[: k + 1]) >= sum(p) / 2 - 1e-12)
    q = [v / sum(p[1:]) for v in p[1:]]
    period = wang(z)
    trend, season, rest = parts(z, period or 1)
    blocks = [statistics.variance(x[k : k + 10]) for k in range(0, len(x) - 9, 10)]
    return {
        "DN_HistogramMode_5": mode(z, 5), "DN_HistogramMode_10": mode(z, 10),
        "CO_f1ecac": crossing - 1 + (ac[crossing - 1] - 1 / math.e) / (ac[crossing - 1] - ac[crossing]),
        "CO_FirstMin_ac": next((k for k in range(1, len(ac) - 1) if ac[k] < ac[k - 1] and ac[k] < ac[k + 1]), len(ac)),
        "CO_trev_1_num": mean([v**3 for v in d]), "MD_hrv_classic_pnn40": mean([abs(v) > 0.04 for v in d]),
        "SB_TransitionMatrix_3ac_sumdiagcov": sum(statistics.variance([moves[i][j] for i in range(3)]) for j in range(3)),
        "PD_PeriodicityWang_th0_01": period, "CO_Embed2_Dist_tau_d_expfit_meandiff": embedding(z, tau),
        "FC_LocalSimple_mean1_tauresrat": below(acf(d), 0) / below(ac, 0), "DN_OutlierInclude_p_001_mdrmd": outliers(z, 1), "DN_OutlierInclude_n_001_mdrmd": outliers(z, -1),
        "SB_BinaryStats_diff_longstretch0": longest, "SB_MotifThree_quantile_hh": -sum(v * math.log(v) for v in pairs if v),
        "SC_FluctAnal_2_rsrangefit_50_1_logi_prop_r1": fluctuation(z, True), "SC_FluctAnal_2_dfa_50_1_2_logi_prop_r1": fluctuation(z, False),
        "SP_Summaries_welch_rect_centroid": 2 * math.pi * half / len(z), "lumpiness": statistics.variance(blocks),
        "spectral_entropy": -sum(v * math.log(v) for v in q if v > 0) / math.log(len(q)), "trend_strength": share(trend, rest), "seasonal_strength": share(season, rest),
        "arch_lm": arch(z), "e_acf1": acf(rest)[1], "kpss": stationarity(z),
    }


def cases():
    r = np.random.default_rng(8)
    t = np.arange(240)
    return {
        "season": 3 * np.sin(2 * np.pi * t / 12) + 0.02 * t + r.normal(0, 0.5, 240), "walk": np.cumsum(r.normal(size=150)), "noise": r.gamma(2.0, 1.0, 97),
        "bursts": r.normal(size=200) * np.repeat(r.uniform(0.2, 3, 10), 20), "waves": np.cos(2 * np.pi * t / 31) + 0.4 * np.sin(2 * np.pi * t / 7) + r.normal(0, 0.1, 240),
    }


@pytest.mark.parametrize("name", sorted(cases()))
def test_features_are_their_definitions(name):
    x = cases()[name]
    got, want = features.features(x), plain_features(x.tolist())
    assert set(got) == set(want) == set(features.FEATURES)
    for k in features.FEATURES:
        assert got[k] == pytest.approx(want[k], rel=1e-6, abs=1e-7), k


def test_extracted_rows_are_the_features(spark):
    rows = [(k, [None if i % 17 == 3 else float(v) for i, v in enumerate(x)]) for k, x in cases().items()] + [("short", [1.0] * 5), ("none", None)]
    df = spark.createDataFrame(rows, "k string, target array<double>").repartition(3)
    got = {r["k"]: r for r in features.extracted(df, ["k"]).collect()}
    for k, x in rows:
        if k in ("short", "none"):
            assert all(got[k][f] is None for f in features.FEATURES)
        else:
            want = plain_features([v for v in x if v is not None])
            assert [got[k][f] for f in features.FEATURES] == [pytest.approx(want[f], rel=1e-6, abs=1e-7) for f in features.FEATURES]
    assert features.extracted(df.where(F.lit(False)), ["k"]).count() == 0

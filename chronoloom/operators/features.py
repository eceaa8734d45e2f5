"""Features of series: one function of a numeric array, run over Arrow batches.

Names follow the published catch22 set and the usual forecasting texts; their
definitions here come from those publications, and parity with any one
implementation is not claimed. Features that are sums over a series also exist
as column expressions (``native_features``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# The retained features in order, and those with heavy tails.
CATCH = (
    "DN_HistogramMode_5", "DN_HistogramMode_10", "CO_f1ecac", "CO_FirstMin_ac", "CO_trev_1_num", "MD_hrv_classic_pnn40", "SB_TransitionMatrix_3ac_sumdiagcov", "PD_PeriodicityWang_th0_01",
    "CO_Embed2_Dist_tau_d_expfit_meandiff", "FC_LocalSimple_mean1_tauresrat", "DN_OutlierInclude_p_001_mdrmd", "DN_OutlierInclude_n_001_mdrmd", "SB_BinaryStats_diff_longstretch0", "SB_MotifThree_quantile_hh",
    "SC_FluctAnal_2_rsrangefit_50_1_logi_prop_r1", "SC_FluctAnal_2_dfa_50_1_2_logi_prop_r1", "SP_Summaries_welch_rect_centroid",
)
TARGETED = ("lumpiness", "spectral_entropy", "trend_strength", "seasonal_strength", "arch_lm", "e_acf1", "kpss")
FEATURES = CATCH + TARGETED
HEAVY_TAILS = ("lumpiness", "arch_lm", "PD_PeriodicityWang_th0_01", "CO_FirstMin_ac", "SB_BinaryStats_diff_longstretch0", "CO_Embed2_Dist_tau_d_expfit_meandiff")
BLOCK = 10  # observations in a block of lumpiness


def autocorrelation(x: np.ndarray, lags: int | None = None) -> np.ndarray:
    """Autocorrelations from lag 0, by FFT; NaN for a constant."""
    n = len(x)
    d = x - x.mean()
    f = np.fft.rfft(d, 1 << (2 * n - 1).bit_length())
    ac = np.fft.irfft(f * f.conj())[: n if lags is None else min(n, lags + 1)]
    return ac / ac[0] if ac[0] > 1e-12 else np.full(len(ac), np.nan)


def histogram_mode(x: np.ndarray, bins: int) -> float:
    """Centre of the fullest of even bins over the range of z-scores; the mean of ties."""
    count, edges = np.histogram(x, bins)
    return float(((edges[:-1] + edges[1:]) / 2)[count == count.max()].mean())


def first_below(ac: np.ndarray, level: float) -> int:
    hit = np.flatnonzero(ac < level)
    return int(hit[0]) if len(hit) else len(ac)


def crossing_1e(ac: np.ndarray) -> float:
    """Lag at which the autocorrelation crosses 1/e, interpolated."""
    k, level = first_below(ac, 1 / np.e), 1 / np.e
    return float(k) if k in (0, len(ac)) else k - 1 + (ac[k - 1] - level) / (ac[k - 1] - ac[k])


def first_minimum(ac: np.ndarray) -> int:
    d = np.diff(ac)
    hit = np.flatnonzero((d[:-1] < 0) & (d[1:] > 0))
    return int(hit[0]) + 1 if len(hit) else len(ac)


def terciles(x: np.ndarray) -> np.ndarray:
    """0, 1 or 2 by the third of the distribution a value lies in."""
    return np.searchsorted(np.quantile(x, [1 / 3, 2 / 3]), x, "left")


def transition_spread(x: np.ndarray, tau: int) -> float:
    """Trace of the covariance between columns of the tercile transition matrix, sampled every tau."""
    s = terciles(x[:: max(1, tau)])
    m = np.zeros((3, 3))
    np.add.at(m, (s[:-1], s[1:]), 1)
    m /= max(1, len(s) - 1)
    return float(np.trace(np.cov(m, rowvar=False)))


def detrended(x: np.ndarray, degree: int = 1) -> np.ndarray:
    t = np.arange(len(x))
    return x - np.polyval(np.polyfit(t, x, degree), t)


def wang_period(x: np.ndarray, threshold: float = 0.01) -> int:
    """First peak of the autocorrelation of the spline-detrended series that stands out from the trough before."""
    n = len(x)
    knots = np.array_split(np.arange(n), 3)
    smooth = np.interp(np.arange(n), [k.mean() for k in knots], [x[k].mean() for k in knots])
    ac = autocorrelation(x - smooth, n // 3)
    trough = None
    for k in range(1, len(ac) - 1):
        if ac[k] < ac[k - 1] and ac[k] <= ac[k + 1]:
            trough = ac[k]
        if trough is not None and ac[k] > ac[k - 1] and ac[k] >= ac[k + 1] and ac[k] > 0 and ac[k] - trough > threshold:
            return k
    return 0


def embedding_fit(x: np.ndarray, tau: int) -> float:
    """Mean absolute difference between the histogram of steps in a two-dimensional embedding and an exponential."""
    tau = max(1, min(tau, len(x) // 10))
    p = np.stack([x[:-tau], x[tau:]], 1)
    d = np.linalg.norm(np.diff(p, axis=0), axis=1)
    if len(d) < 3 or d.std() < 1e-3:
        return 0.0
    count, edges = np.histogram(d, max(3, int(np.ceil(np.sqrt(len(d))))))
    density = count / (len(d) * np.diff(edges))
    mid = (edges[:-1] + edges[1:]) / 2
    return float(np.abs(density - np.exp(-mid / d.mean()) / d.mean()).mean())


def residual_ratio(x: np.ndarray) -> float:
    """First zero crossing of the autocorrelation of differences over that of the series."""
    a, b = first_below(autocorrelation(np.diff(x)), 0), first_below(autocorrelation(x), 0)
    return a / b if b else np.nan


def outlier_median(x: np.ndarray, sign: int, step: float = 0.01) -> float:
    """Median over thresholds of where, relative to the middle, values beyond the threshold lie."""
    y, n = sign * x, len(x)
    top = y.max()
    if top < step:
        return 0.0
    order = np.argsort(-y, kind="stable")
    levels = np.arange(0, top + step / 2, step)
    count = np.searchsorted(-y[order], -levels, "right")
    used = (count > max(2, 0.02 * n))
    medians = [np.median(order[:c]) / (n / 2) - 1 for c in np.unique(count[used])]
    weights = np.bincount(np.searchsorted(np.unique(count[used]), count[used])) if used.any() else []
    return float(np.median(np.repeat(medians, weights))) if len(medians) else 0.0


def longest_run(flags: np.ndarray) -> int:
    edges = np.flatnonzero(np.diff(np.r_[0, flags.astype(int), 0]))
    return int((edges[1::2] - edges[::2]).max()) if len(edges) else 0


def word_entropy(x: np.ndarray) -> float:
    """Entropy of pairs of successive terciles."""
    s = terciles(x)
    p = np.bincount(3 * s[:-1] + s[1:], minlength=9) / max(1, len(s) - 1)
    return float(-(p[p > 0] * np.log(p[p > 0])).sum())


def fluctuation_split(x: np.ndarray, rescaled: bool) -> float:
    """Share of scales before the break in the best two-line fit of log fluctuation against log scale."""
    n = len(x)
    y = np.cumsum(x - x.mean())
    scales = np.unique(np.round(np.exp(np.linspace(np.log(5), np.log(max(6, n // 2)), 50))).astype(int))
    f = []
    for s in scales:
        k = n // s
        seg = y[: k * s].reshape(k, s)
        t = np.arange(s) - (s - 1) / 2
        slope = seg @ t / (t @ t)
        rest = seg - seg.mean(1, keepdims=True) - slope[:, None] * t
        f.append(np.sqrt(((rest.max(1) - rest.min(1)) ** 2).mean()) if rescaled else np.sqrt((rest**2).mean()))
    u, v = np.log(scales), np.log(np.maximum(f, 1e-12))
    if len(u) < 8:
        return 0.0
    error = [sum(np.polyfit(u[a], v[a], 1, full=True)[1].sum() if len(u[a]) > 2 else 0.0 for a in (slice(None, i + 1), slice(i, None))) for i in range(3, len(u) - 3)]
    return (int(np.argmin(error)) + 4) / len(u)


def spectrum(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = np.abs(np.fft.rfft(x - x.mean())) ** 2 / len(x)
    return 2 * np.pi * np.arange(len(p)) / len(x), p


def welch_centroid(x: np.ndarray) -> float:
    """Frequency that halves the spectrum's mass."""
    w, p = spectrum(x)
    c = np.cumsum(p)
    return float(w[np.searchsorted(c, c[-1] / 2)]) if c[-1] > 0 else 0.0


def spectral_entropy(x: np.ndarray) -> float:
    p = spectrum(x)[1][1:]
    p = p / p.sum() if p.sum() > 0 else p
    return float(-(p[p > 0] * np.log(p[p > 0])).sum() / np.log(len(p))) if len(p) > 1 else 0.0


def lumpiness(x: np.ndarray, block: int = BLOCK) -> float:
    """Variance of the variances of blocks."""
    k = len(x) // block
    return float(x[: k * block].reshape(k, block).var(1, ddof=1).var(ddof=1)) if k > 1 else 0.0


def decomposition(x: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trend by a centred moving mean, season by means of phases, and what is left."""
    w = max(3, m + 1 - m % 2)
    pad = np.pad(x, w // 2, "edge")
    trend = np.convolve(pad, np.full(w, 1 / w), "valid")
    rest, phase = x - trend, np.arange(len(x)) % max(1, m)
    season = (np.bincount(phase, rest) / np.bincount(phase))[phase] if m > 1 else np.zeros(len(x))
    season = season - season.mean()
    return trend, season, rest - season


def strength(part: np.ndarray, rest: np.ndarray) -> float:
    total = (part + rest).var()
    return float(max(0.0, 1 - rest.var() / total)) if total > 1e-12 else 0.0


def arch_lm(x: np.ndarray, lags: int = 12) -> float:
    """n R^2 of squared deviations regressed on their own lags."""
    e = (x - x.mean()) ** 2
    n = len(e) - lags
    if n <= lags + 1 or e.var() < 1e-12:
        return 0.0
    a = np.stack([np.ones(n), *(e[lags - k - 1 : lags - k - 1 + n] for k in range(lags))], 1)
    y = e[lags:]
    r = y - a @ np.linalg.lstsq(a, y, rcond=None)[0]
    return float(n * (1 - r.var() / y.var())) if y.var() > 1e-12 else 0.0


def kpss(x: np.ndarray) -> float:
    """Level stationarity statistic with a Bartlett long-run variance."""
    n = len(x)
    e = x - x.mean()
    lags = int(np.ceil(12 * (n / 100) ** 0.25))
    v = e @ e / n + 2 * sum((1 - k / (lags + 1)) * (e[k:] @ e[:-k]) / n for k in range(1, min(lags, n - 1) + 1))
    return float((np.cumsum(e) ** 2).sum() / (n * n * v)) if v > 1e-12 else 0.0


def features(x: np.ndarray, season: int = 0) -> dict[str, float]:
    """All features of one series; NaN where a series is too short or constant."""
    x = np.asarray(x, float)
    x = x[np.isfinite(x)]
    if len(x) < 20 or x.std() < 1e-9:
        return dict.fromkeys(FEATURES, float("nan"))
    z = (x - x.mean()) / x.std()
    ac, diff = autocorrelation(z), np.diff(z)
    m = season or wang_period(z) or 1
    trend, seasonal, rest = decomposition(z, m)
    tau = max(1, first_below(ac, 0))
    return {
        "DN_HistogramMode_5": histogram_mode(z, 5), "DN_HistogramMode_10": histogram_mode(z, 10), "CO_f1ecac": crossing_1e(ac), "CO_FirstMin_ac": float(first_minimum(ac)), "CO_trev_1_num": float((diff**3).mean()),
        "MD_hrv_classic_pnn40": float((np.abs(diff) > 0.04).mean()), "SB_TransitionMatrix_3ac_sumdiagcov": transition_spread(z, tau), "PD_PeriodicityWang_th0_01": float(wang_period(z)), "CO_Embed2_Dist_tau_d_expfit_meandiff": embedding_fit(z, tau),
        "FC_LocalSimple_mean1_tauresrat": residual_ratio(z), "DN_OutlierInclude_p_001_mdrmd": outlier_median(z, 1), "DN_OutlierInclude_n_001_mdrmd": outlier_median(z, -1), "SB_BinaryStats_diff_longstretch0": float(longest_run(diff < 0)),
        "SB_MotifThree_quantile_hh": word_entropy(z), "SC_FluctAnal_2_rsrangefit_50_1_logi_prop_r1": fluctuation_split(z, True), "SC_FluctAnal_2_dfa_50_1_2_logi_prop_r1": fluctuation_split(z, False), "SP_Summaries_welch_rect_centroid": welch_centroid(z),
        "lumpiness": lumpiness(x), "spectral_entropy": spectral_entropy(z), "trend_strength": strength(trend, rest), "seasonal_strength": strength(seasonal, rest), "arch_lm": arch_lm(z), "e_acf1": float(autocorrelation(rest)[1]) if rest.std() > 1e-9 else 0.0, "kpss": kpss(z),
    }


def extracted(df: DataFrame, keys: Sequence[str], target: str = "target", fn: Callable[[np.ndarray], dict[str, float]] = features, names: Sequence[str] = FEATURES) -> DataFrame:
    """A row of features for each series; NULL where undefined."""
    kinds = "".join(f"`{k}` {df.schema[k].dataType.simpleString()}, " for k in keys) + ", ".join(f"`{n}` double" for n in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [fn(np.array([] if x is None else [np.nan if v is None else v for v in x], float)) for x in batch.column(len(keys)).to_pylist()]
            cols = [pa.array([r[n] for r in rows], pa.float64(), from_pandas=True) for n in names]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keys))), *cols], names=[*keys, *names])

    return df.select(*keys, target).mapInArrow(run, kinds)


def native_features(df: DataFrame, by: Sequence[str], order: str, value: str, block: int = BLOCK) -> DataFrame:
    """Features that are sums over a series in rows: mean, spread, lag-1 autocorrelation, rates of zeros and gaps, lumpiness."""
    w = W.partitionBy(*by).orderBy(order)
    mean = F.avg(value).over(W.partitionBy(*by))
    rows = df.withColumns({"_d": F.col(value) - mean, "_i": F.row_number().over(w) - 1}).withColumn("_p", F.lag("_d").over(w))
    base = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.try_divide(F.sum(F.col("_d") * F.col("_p")), F.sum(F.col("_d") ** 2)).alias("acf1"),
        F.avg((F.col(value) == 0).cast("double")).alias("zero_rate"), F.avg(F.col(value).isNull().cast("double")).alias("gap_rate"),
    )
    blocks = rows.withColumn("_b", F.floor(F.col("_i") / block)).groupBy(*by, "_b").agg(F.var_samp(value).alias("_v"), F.count(F.lit(1)).alias("_c")).where(F.col("_c") == block)
    return base.join(blocks.groupBy(*by).agg(F.var_samp("_v").alias("lumpiness")), list(by), "left")


def diagnostics(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Per feature: rows, rates of missing, infinite and zero values, mean and population deviation of finite ones."""
    long = df.unpivot([], [F.col(f"`{n}`").alias(n) for n in names], "feature", "value")
    missing, infinite = F.col("value").isNull() | F.isnan("value"), F.abs("value") == float("inf")
    fine = F.when(~missing & ~infinite, F.col("value"))
    rate = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    return long.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), rate(missing).alias("nan_rate"), rate(infinite & ~missing).alias("inf_rate"), rate(fine == 0).alias("zero_rate"), F.avg(fine).alias("mean"), F.stddev_pop(fine).alias("std"))

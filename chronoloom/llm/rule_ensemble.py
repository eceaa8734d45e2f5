"""Text quality by a sparse ensemble of rules.

Small trees are boosted on labelled statistics of texts; every path from a root
to a node is a conjunction of bounds, a rule. A lasso logistic regression gives
most rules the weight zero, and what is left is compiled into a Spark column
expression, so scoring is plain arithmetic on the statistics' columns.

The trees are fitted on at most ``FIT_ROWS`` labelled documents, those with the
smallest hashes of their ids; statistics and scores cover all documents.

Defined results: a null or empty text has zeros as statistics and is scored like
any other; a document labelled several times has its highest label; labels that
are null or belong to no document are ignored; where fewer than two labels
occur, or no rule splits them, every score is the smoothed share of label 1; rows without a doc_id are
scored and not held out; repeated rows are scored alike; texts of any length are
read whole; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.llm.common import read_table, small_batches, store
from chronoloom.llm.statistics import NAMES, statistics

#: Labelled documents that a model is fitted on.
FIT_ROWS = 10_000
TREES, DEPTH, BINS, RATE = 20, 3, 32, 0.3

Bound = tuple[int, bool, float]  # feature, whether at most (else above), threshold


@dataclass(frozen=True)
class RuleEnsemble:
    names: tuple[str, ...]
    rules: tuple[tuple[Bound, ...], ...]
    weights: tuple[float, ...]
    intercept: float

    def column(self) -> Column:
        """The probability of label 1 as an expression over the statistics' columns."""
        total = F.lit(self.intercept)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            holds = F.lit(True)
            for feature, at_most, threshold in rule:
                c = F.col(self.names[feature])
                holds = holds & ((c <= threshold) if at_most else (c > threshold))
            total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.intercept + _holds(self.rules, x) @ np.array(self.weights))))


def _holds(rules: tuple[tuple[Bound, ...], ...], x: np.ndarray) -> np.ndarray:
    out = np.ones((len(x), len(rules)))
    for r, rule in enumerate(rules):
        for feature, at_most, threshold in rule:
            out[:, r] *= (x[:, feature] <= threshold) == at_most
    return out


def _grow(binned: np.ndarray, cuts: list[np.ndarray], grad: np.ndarray, hess: np.ndarray, rows: np.ndarray, features: np.ndarray, depth: int, path: tuple, rules: list, out: np.ndarray) -> None:
    """Best split by the second-order gain on binned features; puts paths into ``rules`` and leaf steps into ``out``."""
    g, h = grad[rows].sum(), hess[rows].sum()
    best = (1e-6, None, None)
    if depth and len(rows) >= 20:
        for f in features:
            n = len(cuts[f]) + 1
            gs, hs = (np.cumsum(np.bincount(binned[rows, f], v[rows], n))[:-1] for v in (grad, hess))
            gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
            gain[(hs < 0.5) | (h - hs < 0.5)] = 0
            if len(gain) and gain.max() > best[0]:
                best = (gain.max(), f, int(gain.argmax()))
    if best[1] is None:
        out[rows] = -g / (h + 1)
        return
    _, f, k = best
    left = binned[rows, f] <= k
    for at_most, part in ((True, rows[left]), (False, rows[~left])):
        step = (*path, (int(f), at_most, float(cuts[f][k])))
        rules.append(step)
        _grow(binned, cuts, grad, hess, part, features, depth - 1, step, rules, out)


def _simplified(rule: tuple[Bound, ...]) -> tuple[Bound, ...]:
    """At most one upper and one lower bound for each feature, in a fixed order."""
    upper, lower = {}, {}
    for f, at_most, t in rule:
        if at_most:
            upper[f] = min(t, upper.get(f, t))
        else:
            lower[f] = max(t, lower.get(f, t))
    return tuple(sorted([(f, True, t) for f, t in upper.items()] + [(f, False, t) for f, t in lower.items()]))


def tree_rules(x: np.ndarray, y: np.ndarray, seed: int = 1) -> tuple[tuple[Bound, ...], ...]:
    """The distinct rules of boosted trees, each tree on half of the rows and of the features."""
    rng = np.random.default_rng(seed)
    cuts = []
    for f in range(x.shape[1]):
        q = np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1]))
        cuts.append(q[q < x[:, f].max()] if len(q) else q)
    binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], 1)
    margin = np.full(len(y), np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    rules: list = []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        rows = rng.permutation(len(y))[: max(1, len(y) // 2)]
        features = np.sort(rng.permutation(x.shape[1])[: -(-x.shape[1] // 2)])
        own: list = []
        _grow(binned, cuts, p - y, p * (1 - p), rows, features, DEPTH, (), own, np.zeros(len(y)))
        rules += own
        # the margin moves for all rows: the leaves' steps are found again from the leaves' rules
        leaves = [r for r in own if not any(len(o) == len(r) + 1 and o[: len(r)] == r for o in own)]
        for leaf in leaves:
            inside = _holds((leaf,), x)[:, 0] > 0
            margin[inside] -= RATE * (p - y)[inside].sum() / ((p * (1 - p))[inside].sum() + 1)
    return tuple(dict.fromkeys(map(_simplified, rules)))


def _lasso(z: np.ndarray, y: np.ndarray, strength: float, w: np.ndarray, b: float, steps: int = 80) -> tuple[np.ndarray, float]:
    """Logistic regression with an l1 penalty by accelerated proximal gradient; the intercept is free."""
    v = np.ones(z.shape[1])
    for _ in range(15):  # the largest eigenvalue of z'z, by powers
        v = z.T @ (z @ (v / np.linalg.norm(v)))
    step = 4 * len(y) / (1.1 * np.linalg.norm(v) + len(y))
    u, c, t = w, b, 1.0
    for _ in range(steps):
        r = 1 / (1 + np.exp(-(z @ u + c))) - y
        w2 = u - step * (z.T @ r) / len(y)
        w2 = np.sign(w2) * np.maximum(np.abs(w2) - step * strength, 0)
        b2 = c - step * r.mean()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        u, c = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2, b2, t2
    return w, b


def fit(x: np.ndarray, y: np.ndarray, names: tuple[str, ...] = NAMES) -> RuleEnsemble:
    """A rule ensemble; the lasso's strength is the best of a path on every fifth row, refitted on all."""
    prior = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    if len(np.unique(y)) < 2:
        return RuleEnsemble(names, (), (), prior)
    rules = tree_rules(x, y)
    held = np.arange(len(y)) % 5 == 4
    z = _holds(rules, x)
    support = z.mean(0)
    keep = (support > 0.002) & (support < 0.998)
    # of rules that hold for the same rows, the first
    _, first = np.unique(np.packbits(z.astype(bool), axis=0), axis=1, return_index=True)
    keep &= np.isin(np.arange(len(rules)), first)
    rules, z = tuple(r for r, k in zip(rules, keep, strict=True) if k), z[:, keep]
    if not rules:
        return RuleEnsemble(names, (), (), prior)
    scale = np.sqrt(z.mean(0) * (1 - z.mean(0)))
    z = z / scale
    top = np.abs(z.T @ (y - y.mean())).max() / len(y)
    path = top * np.logspace(-0.5, -3, 6)

    def loss(w: np.ndarray, b: float, rows: np.ndarray) -> float:
        m = z[rows] @ w + b
        return float(np.mean(np.logaddexp(0, m) - y[rows] * m))

    best, w, b = (np.inf, path[0]), np.zeros(z.shape[1]), prior
    if len(np.unique(y[~held])) == 2 and held.any():
        for strength in path:
            w, b = _lasso(z[~held], y[~held], strength, w, b)
            best = min(best, (loss(w, b, held), strength))
    w, b = np.zeros(z.shape[1]), prior
    for strength in path[path >= best[1]]:
        w, b = _lasso(z, y, strength, w, b)
    used = np.flatnonzero(np.abs(w) > 1e-6)
    return RuleEnsemble(names, tuple(rules[i] for i in used), tuple((w[used] / scale[used]).tolist()), float(b))


def with_statistics(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``docs``' columns in ``keep`` with the statistics of their texts."""
    small_batches(docs.sparkSession)
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep) + "".join(f", {c} double" for c in NAMES)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = statistics(batch.column(len(keep)))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), *(pa.array(x[:, i]) for i in range(len(NAMES)))], names=[*keep, *NAMES])

    return docs.select(*keep, F.col(text).alias("_text")).mapInArrow(add, schema)


def held_out(doc_id: Column) -> Column:
    """Whether a document's labels may not be learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit_on(measured: DataFrame, labels: DataFrame, label: str, fit_rows: int = FIT_ROWS) -> RuleEnsemble:
    """A model from the labelled rows of ``measured`` that are not held out."""
    marks = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("_y"))
    rows = measured.where(~held_out(F.col("doc_id"))).join(marks, "doc_id").select(*NAMES, "_y", F.xxhash64("doc_id").alias("_h"), "doc_id")
    # the ids only make the sample the same in every run; they are not inputs. A bound on the hash
    # goes before the sort, so that tasks together send twice the sample and not one sample each
    share = min(1.0, 2 * fit_rows / max(1, rows.count()))
    rows = rows.where(F.pmod("_h", F.lit(1 << 20)) <= int(share * (1 << 20)))
    sample = rows.orderBy("_h", "doc_id").limit(fit_rows).drop("_h", "doc_id").toPandas()
    return fit(sample[list(NAMES)].to_numpy(float), (sample["_y"].to_numpy() > 0).astype(float))


def scored(measured: DataFrame, model: RuleEnsemble, cut: float = 0.5) -> DataFrame:
    return measured.withColumn("score", model.column()).withColumn("predicted", (F.col("score") >= cut).cast("int"))


def op1_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = store(with_statistics(read_table(spark, sf_dir, "documents")))
    model = fit_on(measured, read_table(spark, sf_dir, "labels"), "quality")
    return scored(measured, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")

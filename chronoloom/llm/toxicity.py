"""Toxicity by a support vector machine on a subsequence string kernel, trained on sentences.

The kernel counts the subsequences of three characters that two strings share,
each weighted by a decay to the power of the lengths it spans in both, so
characters inserted into a word, or gaps, lower the likeness but do not remove it.
A Nystroem map turns the kernel into features, the likeness to landmark strings,
on which the machine is linear.

A sentence is compared with a landmark by the most alike of its units: the letters
and digits of its words in lower case ("i-d-i-o-t" is one, "idioooot" the same),
neighbouring fragments of up to four characters joined ("idi ot"), runs of single
characters joined ("i d i o t"), one character between all others also left out
("ixdxixoxt"), characters between letters read as those they look like ("id1ot"), in
pieces of 6, 8 and 16 characters where they are longer.
Normalised kernel values under 0.45 count as none; a pair is passed over only where
the characters that they share prove that its value is below (``StringKernel.java``,
see jvm.py).

Only documents carry labels, so the sentences' labels are found by iteration
(multiple instances): at first the sentences of toxic documents that are much like
a landmark are toxic and those of clean documents are not; the machine is trained,
toxic documents' sentences are labelled anew by its margins, at least the highest of
each document that had one at first as toxic, and so on until no label changes. A
toxic document's other sentences are neither. Toxic examples are given again with
characters inserted, doubled or replaced, and pulled apart. Sentences that are not
toxic weigh ten times the others, since a document has many and needs one to be found.

Landmarks are strings that occur in significantly more toxic than clean documents
(of near copies one counts), the most frequent and longest first, each unless one before it is
like it; their number is not bounded. A document's score is a logistic function of its most toxic sentence's
margin and of how many of its sentences are on the toxic side.

Training reads at most ``FIT_TOXIC`` toxic and ``FIT_CLEAN`` clean documents, those
with the smallest hashes of their ids, and of each at most ``FIT_SENTENCES``
sentences that are like a landmark, those with the smallest hashes. All documents
are scored whole.

Defined results: a null or empty text has no sentences and gets the lowest margin;
a text without line ends or stops has sentences of 40 words; characters beyond
U+FFFF are not read; a document labelled several times is toxic if one label says
so; of rows that share a labelled doc_id, and of near copies with one label, one is
learned from; labels
that are null or belong to no document are ignored; without both classes, or
without landmarks, every score is the smoothed share of toxic labels; rows without
a doc_id are scored and not held out; repeated rows are scored alike; landmarks of
equal frequency are taken in alphabetical order; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.llm import jvm
from chronoloom.llm.common import discard, read_table, store
from chronoloom.llm.near_dedup import near_duplicates
from chronoloom.llm.rule_ensemble import held_out

FIT_TOXIC, FIT_CLEAN, FIT_SENTENCES = 1500, 3000, 20
#: A string as like as this to a landmark needs no landmark of its own (normalised kernel).
COVERED = 0.5
#: Documents that must hold a landmark, share of them that must be toxic, and probability of a chance find among all.
LEAST_DOCUMENTS, LEAST_SHARE, CHANCE = 5, 0.95, 0.02
ROUNDS = 5
_FUNCTIONS = {
    "chronoloom_toxic_units": ("Units", "array<string>"),
    "chronoloom_toxic_candidates": ("Candidates", "array<string>"),
    "chronoloom_string_kernel": ("Normalised", "double"),
    "chronoloom_covering": ("Covering", "array<string>"),
    "chronoloom_toxic_features": ("Features", "binary"),
    "chronoloom_toxic_profile": ("Profile", "array<double>"),
}


def functions(spark: SparkSession) -> None:
    jvm.register(spark, "StringKernel", _FUNCTIONS)


@dataclass
class Machine:
    """Landmarks, the weights of sentences' likenesses to them, and the document's logistic function."""

    landmarks: list[str]
    weights: np.ndarray
    bias: float
    document: tuple[float, ...]  # weights of the most toxic margin up to 1 and from 1 to 3, of log(1 + toxic sentences), intercept

    def profile(self, text: Column) -> Column:
        """[most toxic sentence's margin, sentences on the toxic side, the most toxic one's number]."""
        packed = np.append(self.weights, self.bias).astype("<f8").tobytes()
        return jvm.call("chronoloom_toxic_profile", text, F.lit("\n".join(self.landmarks)), F.lit(packed))

    def score(self, profile: Column) -> Column:
        between = lambda x, low, high: F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x))
        a, b, c, d = map(F.lit, self.document)
        z = a * between(profile[0], -1, 1) + b * between(profile[0] - 1, 0, 2) + c * F.log1p(profile[1]) + d
        return 1 / (1 + F.exp(-between(z, -50, 50)))


def landmark_strings(sample: DataFrame) -> list[str]:
    """Strings that mark toxic documents of ``sample`` (text, y), none like another."""
    spark = sample.sparkSession
    functions(spark)
    share = sample.agg(F.avg("y").alias("p")).first()["p"]
    held = sample.select("y", F.explode(jvm.call("chronoloom_toxic_candidates", F.col("text"))).alias("s"))
    counts = store(held.groupBy("s").agg(F.sum("y").alias("toxic"), F.count(F.lit(1)).alias("n")).where(f"n >= {LEAST_DOCUMENTS}"))
    tests = max(2, counts.count())
    # a share p of n documents has less than this probability under the share of all (Chernoff)
    p = F.col("toxic") / F.col("n")
    divergence = p * F.log(p / share) + F.when(p < 1, (1 - p) * F.log((1 - p) / (1 - share))).otherwise(0.0)
    marks = counts.where((p >= LEAST_SHARE) & (F.col("n") * divergence > float(np.log(tests / CHANCE)))).collect()
    discard(counts)
    strings = [r["s"] for r in sorted(marks, key=lambda r: (-r["toxic"] * len(r["s"]), r["s"]))]
    if not strings:
        return []
    return list(spark.range(1).select(jvm.call("chronoloom_covering", F.lit("\n".join(strings)), F.lit(COVERED)).alias("x")).first()["x"])


def disguised(words: list[str], rng: np.random.Generator) -> list[str]:
    """Words with a character inserted, doubled or replaced, pulled apart, and with one between all others."""
    out = []
    for w in words:
        if len(w) < 4:
            continue
        a, b, c = rng.integers(1, len(w), 3)
        new = "xz10"[int(rng.integers(4))]
        out += [w[:a] + new + w[a:], w[:b] + w[b - 1] + w[b:], w[:c] + "*" + w[c + 1 :], w[: len(w) // 2] + " " + w[len(w) // 2 :], "x".join(w)]
    return out


def _rows(features: list[bytes], n: int, most: int = FIT_SENTENCES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A row of likenesses for each sentence that has some, its text's number, and how many sentences have none."""
    rows, text, empty = [], [], np.zeros(len(features))
    for i, packed in enumerate(features):
        x = np.frombuffer(packed, "<f4")
        at, found = 1, []
        while at < len(x):
            k = int(x[at + 1])
            own = x[at + 2 : at + 2 + 2 * k]
            found.append((-own[1::2].max(), x[at], own))
            at += 2 + 2 * k
        empty[i] = x[0] - len(found)
        for _, _, own in sorted(found, key=lambda f: f[:2])[:most]:
            row = np.zeros(n, np.float32)
            row[own[::2].astype(int)] = own[1::2]
            rows.append(row)
            text.append(i)
    return np.array(rows, np.float32).reshape(-1, n), np.array(text, int), empty


def _machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, float]:
    """A linear machine on the rows of x times ``root`` (labels 1 and -1), squared hinge loss by Newton
    steps; sentences that are not toxic weigh ten times those that are: a document has many."""
    z = np.hstack([x @ root.astype(np.float32), np.ones((len(x), 1), np.float32)])
    y, weight = y.astype(np.float32), weight.astype(np.float32)
    for side, all_ in ((1, 20_000), (-1, 200_000)):
        weight[y == side] *= all_ / max(1e-9, weight[y == side].sum())
    ridge = np.eye(z.shape[1])
    ridge[-1, -1] = 1e-6
    w = np.zeros(z.shape[1])
    for _ in range(15):
        on = 1 - y * (z @ w.astype(np.float32)) > 0
        own = z[on]
        held = own * weight[on][:, None]
        new = np.linalg.solve(ridge + (held.T @ own).astype(float), (held.T @ y[on]).astype(float))
        if np.abs(new - w).max() < 1e-3:
            break
        w = 0.5 * w + 0.5 * new
    return root @ w[:-1], float(w[-1])


def fit(sample: DataFrame, seed: int = 5) -> Machine | float:
    """A machine from ``sample`` (text, y: 1 for toxic, else 0), a table that is read several times; where
    nothing can be learned the smoothed share of toxic documents."""
    spark = sample.sparkSession
    n_toxic, n = sample.agg(F.coalesce(F.sum("y"), F.lit(0)), F.count(F.lit(1))).first()
    prior = (n_toxic + 1) / (n + 2)
    landmarks = landmark_strings(sample) if 0 < n_toxic < n else []
    if not landmarks:
        return float(prior)
    joined, rng = F.lit("\n".join(landmarks)), np.random.default_rng(seed)
    features = lambda rows: rows.select("y", jvm.call("chronoloom_toxic_features", F.col("text"), joined).alias("f")).collect()
    found = features(sample)
    toxic = np.array([r["y"] > 0 for r in found])
    x, text, empty = _rows([r["f"] for r in found], len(landmarks))
    del found
    own = features(spark.createDataFrame([(0, w) for w in [*landmarks, *disguised(landmarks, rng)]], "y int, text string"))
    extra, which, _ = _rows([r["f"] for r in own], len(landmarks))
    # the landmarks' own likenesses make the map; values that count as none are none either way round
    gram = np.zeros((len(landmarks), len(landmarks)))
    gram[which[which < len(landmarks)]] = extra[which < len(landmarks)]
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    root = vectors / np.sqrt(np.maximum(values, 1e-3)) @ vectors.T

    bag = toxic[text]
    z = np.vstack([x, extra, np.zeros((1, len(landmarks)), np.float32)])
    first = np.where(bag, x.max(1, initial=0) >= 0.3, False)
    explained = np.isin(text, np.unique(text[first]))
    # 1 toxic, -1 not, 0 neither: in a toxic document, and not known to be what makes it so
    label = np.where(first, 1, np.where(bag, 0, -1))
    weights, bias = np.zeros(len(landmarks)), -1.0
    for _ in range(ROUNDS):
        y = np.concatenate([label, np.ones(len(extra)), [-1]])
        # disguises together weigh three times the sentences found; sentences like nothing are one row
        weight = np.concatenate([np.ones(len(x)), np.full(len(extra), 3 * max(1, (label > 0).sum()) / len(extra)), [max(1.0, empty.sum())]])
        weights, bias = _machine(z[y != 0], y[y != 0], weight[y != 0], root)
        margin = x @ weights + bias
        new = np.where(bag, (margin > 0).astype(int), -1)
        # some sentence makes a document toxic: if none is on that side, the one that comes nearest
        order = np.lexsort((-margin, text))
        best = order[np.flatnonzero(np.diff(text[order], prepend=-1))]
        new[best[bag[best] & explained[best]]] = 1
        if (new == label).all():
            break
        label = new

    machine = Machine(landmarks, weights, bias, (0.0,) * 4)
    rows = sample.select("y", machine.profile(F.col("text")).alias("p")).collect()
    most, count = np.array([r["p"][0] for r in rows]), np.array([r["p"][1] for r in rows])
    z, y = np.stack([np.clip(most, -1, 1), np.clip(most - 1, 0, 2), np.log1p(count), np.ones(len(rows))], 1), np.array([float(r["y"]) for r in rows])
    d, ridge = np.zeros(4), 0.1 * np.eye(4)
    for _ in range(30):  # ridge logistic regression by Newton steps
        p = 1 / (1 + np.exp(-np.clip(z @ d, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (p - y) + ridge @ d)
        d = d - np.clip(step, -2, 2)
    machine.document = tuple(map(float, d))
    return machine


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str = "toxic", text: str = "text", fit_toxic: int = FIT_TOXIC, fit_clean: int = FIT_CLEAN) -> DataFrame:
    """(doc_id, text, y) of at most so many labelled documents that are not held out, as a table in the shared folder."""
    marks = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.max(label) > 0).cast("int").alias("y"))
    marks = marks.where(~held_out(F.col("doc_id"))).withColumn("_h", F.xxhash64("doc_id"))
    ids = None
    for side, bound in ((1, fit_toxic), (0, fit_clean)):
        own = marks.where(F.col("y") == side)
        # a bound on the hash first: tasks together send twice the sample and not one sample each
        share = min(1.0, 2 * bound / max(1, own.count()))
        own = own.where(F.pmod("_h", F.lit(1 << 20)) <= int(share * (1 << 20))).orderBy("_h", "doc_id").limit(bound).select(F.col("doc_id").alias("_id"), "y")
        ids = own if ids is None else ids.unionByName(own)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(ids), F.col("doc_id") == F.col("_id"))
    # a sample's rows are few and its texts long: dealt out, so that many tasks read them
    rows = store(rows.groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.first("y").alias("y")).repartition(16, "doc_id"))
    # what a document's copies share would look like a mark of their label
    groups = near_duplicates(rows).select(F.col("doc_id").alias("_id"), F.coalesce("component_id", "doc_id").alias("group"))
    one = rows.join(groups, F.col("doc_id") == F.col("_id")).groupBy("group", "y").agg(F.min("doc_id").alias("_id")).select("_id")
    return store(rows.join(one, F.col("doc_id") == F.col("_id"), "left_semi").repartition(16, "doc_id"))


def fit_on(docs: DataFrame, labels: DataFrame, label: str = "toxic", text: str = "text", fit_toxic: int = FIT_TOXIC, fit_clean: int = FIT_CLEAN) -> Machine | float:
    """A machine from a bounded sample of labelled documents that are not held out; no text leaves the tasks."""
    sample = labelled_sample(docs, labels, label, text, fit_toxic, fit_clean)
    machine = fit(sample.select("text", "y"))
    discard(sample)
    return machine


def scored(docs: DataFrame, machine: Machine | float, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, score, n_toxic, worst) for each row of ``docs``: ``n_toxic`` sentences on the toxic side, ``worst`` the number of the most toxic one."""
    rows = docs.select(doc_id, F.col(text).alias("_text"))
    if isinstance(machine, float):
        return rows.select(doc_id, F.lit(machine).alias("score"), F.lit(0).cast("long").alias("n_toxic"), F.lit(None).cast("long").alias("worst"))
    functions(docs.sparkSession)
    # computed once a row: what follows reads its parts
    profiled = rows.select(doc_id, F.explode(F.array(machine.profile(F.col("_text")))).alias("p"))
    return profiled.select(doc_id, machine.score(F.col("p")).alias("score"), F.col("p")[1].cast("long").alias("n_toxic"), F.nullif(F.col("p")[2].cast("long"), F.lit(-1)).alias("worst"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    rows = scored(docs, fit_on(docs, read_table(spark, sf_dir, "labels")))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "n_toxic")

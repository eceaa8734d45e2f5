"""Quality rules judged at the level of the host that a document comes from.

Every document is measured (words, symbols, repeated lines and word windows),
each rule marks it as failing or not, and failures are counted by host. A rate
over few documents says little, so a host's rate of a rule is shrunk towards
the rate of all hosts: the prior is a beta distribution fitted to the hosts'
rates by moments. Hosts whose shrunk rate of some rule is above that rule's
limit are rejected, and the verdict is joined back to their documents.

Defined results: a null text has no words, symbols or lines, so it fails the
base rule; a null host is no host: its documents are judged by the base rule
alone; repeated rows count as often as they occur; texts of any length are
measured whole; a rate equal to its limit rejects nothing; an empty table gives an
empty result; other columns pass through, and those that clash with a column
made here are replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoloom.llm.common import read_table, small_batches, store
from chronoloom.llm.textops import SPACE, Bytes, Words, slices, spans

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(b"#*$%&|<>")] = True
_LEAD = np.ones(256, bool)
_LEAD[0x80:0xC0] = False
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)

#: rule -> (condition for failing, share of a host's documents that may fail)
RULES: dict[str, tuple[str, float]] = {
    "base": ("n_words < 50 OR 100 * n_repeat_words > 50 * n_words", 0.8),
    "symbols": ("10 * n_symbols > n_words", 0.5),
    "word_length": ("word_chars < 3 * n_words OR word_chars > 12 * n_words", 0.5),
    "lines": ("4 * n_dup_lines > n_words", 0.5),
}


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Which entries have an equal one."""
    order = np.argsort(keys)
    ranked = keys[order]
    same = np.zeros(len(keys) + 1, bool)
    same[1:-1] = ranked[1:] == ranked[:-1]
    out = np.empty(len(keys), bool)
    out[order] = same[1:] | same[:-1]
    return out


def measure(texts: pa.Array) -> np.ndarray:
    """A row of COUNTS for each text."""
    found = []
    for _, part in slices(texts):
        b, n = Bytes.of(part), len(part)
        w = Words.of(b, lower=False)
        n_words = np.diff(w.first)

        at, h = w.windows(3)
        again = at[_repeated(h + w.doc[at].astype(np.uint64) * _GOLDEN)]
        cover = np.zeros(len(w.hash) + 3, np.int64)
        np.add.at(cover, again, 1)
        np.add.at(cover, again + 3, -1)
        covered = np.concatenate([[0], np.cumsum(np.cumsum(cover)[: len(w.hash)] > 0)])

        breaks = np.flatnonzero(b.raw == 10)
        ends = np.sort(np.concatenate([breaks, b.off[1:]]))
        starts = np.sort(np.concatenate([breaks + 1, b.off[:-1]]))
        doc = np.repeat(np.arange(n), np.diff(np.searchsorted(breaks, b.off)) + 1)
        inked = np.concatenate([[0], np.cumsum(~SPACE[b.raw])])
        has = inked[ends] > inked[starts]
        starts, ends, doc = starts[has], ends[has], doc[has]
        key = spans(b.raw, starts, ends) + doc.astype(np.uint64) * _GOLDEN
        _, first = np.unique(key, return_index=True)
        distinct = np.bincount(doc[first], minlength=n)

        found.append(np.stack([n_words, b.counts(_LEAD[b.raw] & ~SPACE[b.raw]), b.counts(_IS_SYMBOL[b.raw]), np.bincount(doc, minlength=n) - distinct, covered[w.first[1:]] - covered[w.first[:-1]]], 1))
    return np.concatenate(found) if found else np.zeros((0, len(COUNTS)), np.int64)


def measured(docs: DataFrame, text: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """``docs`` (its columns in ``keep``, or all) with COUNTS."""
    keep = tuple(c for c in (docs.columns if keep is None else keep) if c not in COUNTS)
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(c, T.LongType()) for c in COUNTS])
    source = docs.select(*keep, *([] if text in keep else [text]))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = measure(batch.column(text))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array(counts[:, i]) for i in range(len(COUNTS)))], names=[*keep, *COUNTS])

    return source.mapInArrow(add, schema)


def host_verdicts(counts: DataFrame, host: str = "source", rules: dict[str, tuple[str, float]] = RULES) -> DataFrame:
    """One row per host: ``n_host``, the shrunk rate of each rule, ``host_rejected``.

    The counts are summed before the shuffle, so a host's size does not matter. The prior needs
    sums over hosts only: with m the pooled rate, v the variance of the hosts' rates around it
    and h the mean of 1 / n, moments give a strength m(1-m)(1-h) / (v - m(1-m)h) - 1, held
    between 2 and 10,000 documents; where rates vary no more than chance would make them, it is
    the latter.
    """
    per_host = counts.where(F.col(host).isNotNull()).groupBy(host).agg(F.count(F.lit(1)).alias("n_host"), *(F.sum(F.expr(f"CASE WHEN {c} THEN 1 ELSE 0 END")).alias(f"f_{r}") for r, (c, _) in rules.items()))
    pooled = per_host.agg(F.avg(1 / F.col("n_host")).alias("h"), *(F.expr(f"try_divide(CAST(sum(f_{r}) AS DOUBLE), CAST(sum(n_host) AS DOUBLE))").alias(f"m_{r}") for r in rules))
    # one row: the broadcast side of these joins is of fixed size
    near = per_host.crossJoin(F.broadcast(pooled))
    spread = near.agg(*(F.avg((F.col(f"f_{r}") / F.col("n_host") - F.col(f"m_{r}")) ** 2).alias(f"v_{r}") for r in rules))
    out = near.crossJoin(F.broadcast(spread))
    for r in rules:
        chance = f"m_{r} * (1 - m_{r})"
        strength = f"CASE WHEN v_{r} > {chance} * h THEN least(10000.0D, greatest(2.0D, {chance} * (1 - h) / (v_{r} - {chance} * h) - 1)) ELSE 10000.0D END"
        out = out.withColumn(f"s_{r}", F.expr(strength)).withColumn(f"rate_{r}", F.expr(f"(f_{r} + m_{r} * s_{r}) / (n_host + s_{r})"))
    bad = F.lit(False)
    for r, (_, limit) in rules.items():
        bad = bad | (F.col(f"rate_{r}") > limit)
    return out.select(host, "n_host", *(f"rate_{r}" for r in rules), bad.alias("host_rejected"))


def base_failed(rules: dict[str, tuple[str, float]] = RULES) -> Column:
    return F.expr(rules["base"][0])


def judged(counts: DataFrame, host: str = "source", per_host: DataFrame | None = None) -> DataFrame:
    """``counts`` with ``base_failed``, ``host_rejected`` and ``kept``.

    ``per_host`` are the verdicts where they come from another frame of the same documents.
    """
    verdicts = (host_verdicts(counts, host) if per_host is None else per_host).select(F.col(host).alias("_host"), F.col("host_rejected").alias("_bad"))
    out = counts.drop("base_failed", "host_rejected", "kept").join(verdicts, F.col(host) == F.col("_host"), "left")
    out = out.withColumn("base_failed", base_failed()).withColumn("host_rejected", F.coalesce("_bad", F.lit(False)))
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected")).drop("_host", "_bad")


def apply_host_rules(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """The documents that pass, with their own columns.

    Texts are measured twice, once for the hosts and once to filter, which costs less than
    carrying them through a shuffle.
    """
    small_batches(docs.sparkSession)
    per_host = store(host_verdicts(measured(docs, text, (host,)), host))
    tagged = docs.withColumnsRenamed({c: f"_own_{c}" for c in docs.columns if c in COUNTS or c in ("base_failed", "host_rejected", "kept")})
    return judged(measured(tagged, text), host, per_host).where("kept").select(*(F.col(f"_own_{c}").alias(c) if f"_own_{c}" in tagged.columns else F.col(c) for c in docs.columns))


def op4_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    counts = store(measured(read_table(spark, sf_dir, "documents"), keep=("doc_id", "source")))
    # a stored table has a known size: hosts are broadcast if few, else split where one is hot
    return judged(counts, per_host=store(host_verdicts(counts))).select("doc_id", *COUNTS, "base_failed", "kept", "host_rejected")


def _sql() -> str:
    rules = {r: (c, limit) for r, (c, limit) in RULES.items()}
    fails = ", ".join(f"sum(CASE WHEN {c} THEN 1 ELSE 0 END) AS f_{r}" for r, (c, _) in rules.items())
    pooled = ", ".join(f"sum(f_{r})::DOUBLE / sum(n_host)::DOUBLE AS m_{r}" for r in rules)
    spread = ", ".join(f"avg((f_{r} / n_host - m_{r}) ** 2) AS v_{r}" for r in rules)
    strength = ", ".join(f"CASE WHEN v_{r} > m_{r} * (1 - m_{r}) * h THEN least(10000.0, greatest(2.0, m_{r} * (1 - m_{r}) * (1 - h) / (v_{r} - m_{r} * (1 - m_{r}) * h) - 1)) ELSE 10000.0 END AS s_{r}" for r in rules)
    bad = " OR ".join(f"(f_{r} + m_{r} * s_{r}) / (n_host + s_{r}) > {limit}" for r, (_, limit) in rules.items())
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, source, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words FROM d),
tri AS (SELECT rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) >= 3)),
again AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM tri) WHERE n >= 2),
covered AS (SELECT rid, count(DISTINCT i + k) AS n FROM again, (SELECT unnest([0, 1, 2]) AS k) GROUP BY rid),
lines AS (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d),
dup AS (SELECT rid, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY rid),
counts AS (
  SELECT w.rid, doc_id, source, len(words)::BIGINT AS n_words,
    coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN covered USING (rid) LEFT JOIN dup USING (rid)),
hosts AS (SELECT source, count(*)::DOUBLE AS n_host, {fails} FROM counts WHERE source IS NOT NULL GROUP BY source),
pooled AS (SELECT avg(1 / n_host) AS h, {pooled} FROM hosts),
spread AS (SELECT {spread} FROM hosts, pooled),
strength AS (SELECT hosts.*, pooled.*, {strength} FROM hosts, pooled, spread),
bad AS (SELECT source, ({bad}) AS host_rejected FROM strength)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce(host_rejected, FALSE) AS kept, coalesce(host_rejected, FALSE) AS host_rejected
FROM (SELECT *, ({rules['base'][0]}) AS base_failed FROM counts) LEFT JOIN bad USING (source)
"""


ORACLE_SQL = _sql()

"""Removal of lines that an earlier document already holds.

The lines seen so far are kept as sorted runs of 128-bit line hashes in levels,
like a log-structured merge tree: each batch of documents contributes one run
at level 0, made of the hashes that no older run has, and when a level holds
``fanout`` runs they are merged into one run of the next level. A run is a
table bucketed and sorted by hash, so a batch shuffles its own new hashes once
and merges them with each run in place; old runs never move. With r runs in
all, a level holds under ``fanout`` of them and r grows with the logarithm of
the number of batches.

A line's key is the line without ``[\\x20\\x09-\\x0D]`` at both ends and with
A-Z in lower case. Keys of under ``min_chars`` code points are never removed.

Defined results: a null or empty text is one empty line; rows that share a
doc_id are one document, each row keeping what the document owns; rows without
a doc_id count as one document that comes after all others; texts of any length are
split whole; an empty table gives an empty result; other columns pass through unread,
and those that clash with a count made here are replaced by it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoloom.llm.common import discard, read_table, shuffle_partitions, small_batches, store

MIN_CHARS = 10
N_BATCHES = 4
FANOUT = 3
_LAST = (1 << 63) - 1
_SPACE = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    return F.translate(F.trim(line, F.lit(_SPACE)), _UPPER, _LOWER)


class SortedRuns:
    """Levelled sorted runs of (h1, h2, owner) that persist between batches."""

    def __init__(self, spark: SparkSession, buckets: int, fanout: int = FANOUT):
        self.spark, self.buckets, self.fanout = spark, buckets, fanout
        self.name = f"line_runs_{uuid.uuid4().hex}"
        self.levels: list[list[str]] = []
        self.written = 0

    def runs(self) -> list[str]:
        return [run for level in self.levels for run in level]

    def _write(self, rows: DataFrame) -> str:
        table = f"{self.name}_{self.written}"
        self.written += 1
        dealt = rows.repartition(self.buckets, "h1", "h2")
        dealt.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").format("parquet").saveAsTable(table)
        return table

    def add(self, firsts: DataFrame) -> str:
        """Write the rows of ``firsts`` whose hash no run has as a run of level 0; its name.

        ``firsts`` has distinct hashes. The run is merged into higher levels by ``compact``.
        """
        for run in self.runs():
            firsts = firsts.join(self.spark.table(run).select("h1", "h2"), ["h1", "h2"], "left_anti")
        table = self._write(firsts)
        self.levels = self.levels or [[]]
        self.levels[0].append(table)
        return table

    def compact(self) -> None:
        """Merge full levels. Runs hold disjoint hashes, so merging is a union."""
        at = 0
        while at < len(self.levels):
            if len(self.levels[at]) >= self.fanout:
                merged = self.spark.table(self.levels[at][0])
                for run in self.levels[at][1:]:
                    merged = merged.unionByName(self.spark.table(run))
                table = self._write(merged)
                for run in self.levels[at]:
                    self.spark.sql(f"DROP TABLE {run}")
                self.levels[at] = []
                if at + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[at + 1].append(table)
            at += 1

    def drop(self) -> None:
        for run in self.runs():
            self.spark.sql(f"DROP TABLE IF EXISTS {run}")
        self.levels = []


def text_key(text: Column) -> list[Column]:
    """(f1, f2): which of the texts under one doc_id, or under none, a row has."""
    whole = F.coalesce(text, F.lit(""))
    return [F.xxhash64(whole).alias("f1"), F.xxhash64(F.lit(1), whole).alias("f2")]


def hashed_lines(docs: DataFrame, text: str, doc_id: str, min_chars: int) -> DataFrame:
    """(d, f1, f2, line_no, h1, h2) of the lines that may be removed."""
    lines = docs.select(F.coalesce(doc_id, F.lit(_LAST)).alias("d"), *text_key(docs[text]), F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n", -1)).alias("line_no", "line"))
    keyed = lines.withColumn("line", line_key("line")).where(F.char_length("line") >= min_chars)
    return keyed.select("d", "f1", "f2", "line_no", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))


def removed_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_chars: int = MIN_CHARS, n_batches: int = N_BATCHES, fanout: int = FANOUT) -> DataFrame:
    """(d, f1, f2, gone): for the texts of documents that lose lines, the numbers of those lines.

    Documents go through the runs in ``n_batches`` ranges of doc_id, as if they arrived so; the
    number of batches changes the work, not the result. A hash found in a run belongs to a
    document of an earlier batch, so its line goes; otherwise it belongs to the smallest doc_id
    of its own batch.
    """
    spark = docs.sparkSession
    cuts = docs.select(F.percentile_approx(doc_id, [i / n_batches for i in range(1, n_batches)], 1000).alias("c")).first()["c"] if n_batches > 1 else None
    batch = F.lit(0)
    for cut in cuts or []:
        batch = batch + (F.col("d") > cut).cast("int")
    lines = store(hashed_lines(docs, text, doc_id, min_chars).withColumn("batch", batch), "batch")
    runs = SortedRuns(spark, shuffle_partitions(spark), fanout)
    gone = None
    try:
        for i in range(len(cuts or []) + 1):
            own = lines.where(F.col("batch") == i)
            fresh = spark.table(runs.add(own.groupBy("h1", "h2").agg(F.min("d").alias("owner"))))
            # read as a plain table: a line of very many documents is split between tasks only
            # where both sides of the join are shuffled
            fresh = fresh.select(F.expr("h1 ^ 0L").alias("h1"), F.expr("h2 ^ 0L").alias("h2"), "owner")
            lost = own.join(fresh.hint("merge"), ["h1", "h2"], "left").where(~F.col("d").eqNullSafe(F.col("owner"))).select("d", "f1", "f2", "line_no")
            # each batch's verdict is written: the runs may be merged or dropped afterwards
            lost = store(lost.groupBy("d", "f1", "f2").agg(F.collect_set("line_no").alias("gone")))
            gone = lost if gone is None else gone.unionByName(lost)
            runs.compact()
    finally:
        runs.drop()
        discard(lines)
    return gone


def drop_repeated_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_chars: int = MIN_CHARS, n_batches: int = N_BATCHES, fanout: int = FANOUT) -> DataFrame:
    """``docs`` with ``text`` reduced to its kept lines, and ``n_lines`` and ``n_dropped``.

    A null text stays null where nothing is counted against it: it has one line and loses none.
    """
    small_batches(docs.sparkSession)
    gone = removed_lines(docs, text, doc_id, min_chars, n_batches, fanout)
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    schema = T.StructType([docs.schema[c] for c in names] + [T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lost = batch.column(text).to_pylist(), batch.column("_gone")
            n_lines, n_dropped = [], []
            for i, x in enumerate(texts):
                n_lines.append(1 if x is None else x.count("\n") + 1)
                n_dropped.append(0)
                if x is not None and lost[i].is_valid:
                    off = set(lost[i].as_py())
                    n_dropped[-1] = len(off)
                    texts[i] = "\n".join(line for k, line in enumerate(x.split("\n")) if k not in off)
            kept = pa.array(texts, batch.column(text).type)
            yield pa.RecordBatch.from_arrays([*(kept if c == text else batch.column(c) for c in names), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names=[*names, "n_lines", "n_dropped"])

    own = docs.select(*names)
    # always a merge join, so that the plan and its shuffle do not change with the size of ``gone``
    lost = gone.select(*(F.col(c).alias(f"_{c}") for c in ("d", "f1", "f2", "gone"))).hint("merge")
    f1, f2 = text_key(own[text])
    joined = own.join(lost, (F.coalesce(own[doc_id], F.lit(_LAST)) == F.col("_d")) & (f1 == F.col("_f1")) & (f2 == F.col("_f2")), "left").drop("_d", "_f1", "_f2")
    return joined.mapInArrow(cut, schema)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_repeated_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLE_SQL = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT rid, doc_id, i, lines[i] AS line, translate(trim(lines[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM (SELECT rid, doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM d)),
o AS (SELECT k, min(doc_id) AS owner FROM l WHERE length(k) >= 10 GROUP BY k),
v AS (SELECT rid, l.doc_id, i, line, coalesce(l.doc_id <> o.owner, FALSE) AS gone FROM l LEFT JOIN o USING (k))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM v GROUP BY rid, doc_id
"""

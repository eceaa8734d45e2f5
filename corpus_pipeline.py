"""A corpus pipeline made of the text operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run``
writes as Parquet in the shared folder and reads again as the next stage's docs.
All stages but the last return the columns of ``documents``:

1. quality rules: documents that fail the base rule, or whose host is rejected, go;
2. line dedup: lines that an earlier document holds go;
3. near dedup: of each group of near-duplicates (5-word shingles, similarity 0.8
   or more) the document with the smallest doc_id stays;
4. decontamination: documents that hold a passage of a benchmark item go;
5. byte-level BPE: each document's token ids, with its text decoded from them.

Defined results: nulls, empty texts, repeated rows, empty tables and other
columns are handled by each stage as its operator's docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chronoloom.llm.byte_bpe import decode, encode
from chronoloom.llm.common import discard, read_table, store
from chronoloom.llm.decontaminate import drop_contaminated
from chronoloom.llm.host_rules import apply_host_rules
from chronoloom.llm.line_dedup import drop_repeated_lines
from chronoloom.llm.near_dedup import keep_one_of_each


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return apply_host_rules(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_repeated_lines(docs).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = decode(encode(docs))
    return rows.selectExpr("doc_id", "ids", "decode(decoded, 'UTF-8') AS text")


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("byte_bpe", byte_bpe),
]

#: Spaced seeds and byte-pair merges are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs, before = read_table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir))
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)

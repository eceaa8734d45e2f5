"""Registered queries that generate series, one for each family."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession

from chronoloom.sources import generators

#: Series and length that the queries make; sources take any.
N_SERIES, LENGTH = 64, 1024


def synth(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return generators.corpus(spark, name, N_SERIES, 42, LENGTH)


def synth_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generators.summary(generators.corpora(spark, None, (42, 43), 16, LENGTH))


QUERIES = {f"synth_{name}": partial(synth, name) for name in generators.FAMILIES} | {"synth_summary": synth_summary}
SQL: dict[str, str] = {}

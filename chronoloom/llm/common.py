"""Session helpers shared by the text operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A folder of our own under the one the cluster names in spark.checkpoint.dir.

    Only where that setting is absent (tests, single-machine sessions) is the
    warehouse used, which the session's readers and writers share as well.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/_shared"
    return f"{root.rstrip('/')}/chronoloom-{uuid.uuid4().hex}"


def store(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage with a copy that all executors reach: a lost executor costs no
    recomputation of what stands above.
    """
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    (df.write.partitionBy(*partition_by) if partition_by else df.write).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a table made by ``store`` that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._stored_at)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def small_batches(spark: SparkSession, limit: int = 4_000_000) -> None:
    """Bound the bytes of the session's Arrow batches.

    The default bounds rows, made for narrow ones: 10,000 texts are tens of megabytes, held
    several times over by the JVM and the Python worker of each task.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(limit))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))

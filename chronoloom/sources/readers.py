"""Reading and writing the engine's tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from chronoloom.schema import PROPERTIES, RESULTS, nulls_for_nan, require

#: Directory names of conditions, and the conditions they hold (fixed values).
CONDITION_ALIASES = {"center_waveform": "waveform", "fringe_ets": "ets", "baseline_fbm": "fbm"}


class Options:
    """Settings from a mapping (such as the environment), else their defaults."""

    DEFAULTS: Mapping[str, str] = {"data_dir": "data", "output_dir": "outputs", "results_dir": "results", "index_path": "outputs/pretrain_index.csv"}

    def __init__(self, given: Mapping[str, str] | None = None, prefix: str = "CHRONOLOOM_"):
        given = given or {}
        self.values = {k: given.get(prefix + k.upper(), v) for k, v in self.DEFAULTS.items()}

    def __getattr__(self, name: str) -> str:
        try:
            return self.__dict__["values"][name]
        except KeyError:
            raise AttributeError(name) from None


def shared_folder(spark: SparkSession) -> str:
    """A new folder that the driver and all executors reach: under the one the cluster names in spark.checkpoint.dir."""
    root = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/_shared"
    return f"{root.rstrip('/')}/chronoloom-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in a shared folder and read back: what stands above is computed once, and
    not again if an executor is lost."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def csv(spark: SparkSession, path: str | Sequence[str], schema: T.StructType | str | None = None, columns: Sequence[str] = ()) -> DataFrame:
    """A CSV table with a header; ``columns`` must be there, NaN and infinities become NULL, empty strings stay."""
    reader = spark.read.option("header", True).option("nanValue", "NaN").option("emptyValue", "").option("nullValue", "\\N")
    # without a schema one more pass over the table tells numbers from text
    out = reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", True).csv(path)
    return nulls_for_nan(require(out, *columns))


def write_csv(df: DataFrame, path: str, one_file: bool = True, mode: str = "error") -> None:
    """CSV with a header; tables for people in one file."""
    (df.coalesce(1) if one_file else df).write.mode(mode).csv(path, header=True)


def write_json(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).json(path)


def append(df: DataFrame, path: str) -> None:
    """Adds rows to a Parquet table; what is there stays as it is."""
    df.write.mode("append").parquet(path)


def write_new(df: DataFrame, path: str, keys: Sequence[str], partition_by: Sequence[str] = ()) -> int:
    """Appends the rows whose keys the table lacks, so a run can be repeated; the number of partitions of keys written."""
    try:
        done = df.sparkSession.read.parquet(path).select(*keys).distinct()
        df = df.join(done, list(keys), "left_anti")
    except Exception as e:  # no table yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
    new = df.select(*keys).distinct().count()
    if new:
        df.write.mode("append").partitionBy(*partition_by).parquet(path)
    return new


class Stage:
    """Intermediate tables by key in one folder, such as forecasts between prediction and scoring."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def write(self, key: str, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/{key}")

    def read(self, key: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{key}")

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path, path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def keys(self) -> list[str]:
        """Keys of the tables that were written whole."""
        path, fs = self._fs()
        done = fs.globStatus(self.spark._jvm.org.apache.hadoop.fs.Path(path, "*/_SUCCESS"))
        return sorted(s.getPath().getParent().getName() for s in done or [])

    def drop(self, key: str) -> None:
        path, fs = self._fs()
        fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(path, key), True)


def properties(spark: SparkSession, path: str) -> DataFrame:
    """(key, domain, frequency, num_variates) from a JSON object keyed by dataset."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", PROPERTIES)).alias("key", "p")).select("key", "p.*")


def results(spark: SparkSession, root: str) -> DataFrame:
    """All result tables under root/{model}/seed_{seed}/{condition}/, tagged from their paths.

    The table's own ``model`` column names the condition, so it is dropped; what is missing is
    simply not found.
    """
    raw = spark.read.option("header", True).option("nanValue", "NaN").schema(RESULTS).csv(f"{root}/*/seed_*/*/all_results.csv")
    # paths are given as URIs
    at = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    part = lambda i: F.regexp_extract(at, r"/([^/]+)/seed_(\d+)/([^/]+)/all_results\.csv(?:/[^/]+)?$", i)
    tagged = raw.withColumns({"model_family": part(1), "seed": part(2).cast("int"), "_c": part(3)}).drop("model")
    names = F.create_map(*[F.lit(x) for kv in CONDITION_ALIASES.items() for x in kv])
    return nulls_for_nan(tagged.withColumn("condition", F.coalesce(names[F.col("_c")], F.col("_c"))).drop("_c"))


def corpora(spark: SparkSession, path: str) -> DataFrame:
    """A corpus table partitioned by generator and seed; filters on them prune directories."""
    return spark.read.parquet(path)


def discovered(spark: SparkSession, path: str) -> DataFrame:
    """(generator, seed, n_files) of a partitioned corpus, from file names alone."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path).select("path")
    part = lambda k: F.regexp_extract("path", rf"/{k}=([^/]+)/", 1)
    return files.groupBy(part("generator").alias("generator"), part("seed").cast("int").alias("seed")).agg(F.count(F.lit(1)).alias("n_files")).orderBy("generator", "seed")


def literal(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


# -- Arrow files ---------------------------------------------------------------------------------


class _ArrowFile(InputPartition):
    def __init__(self, path: str):
        self.path = path


class ArrowReader(DataSourceReader):
    def __init__(self, schema: T.StructType, paths: list[str]):
        self.schema, self.paths = schema, paths

    def partitions(self) -> list[InputPartition]:
        return [_ArrowFile(p) for p in self.paths]

    def read(self, partition: _ArrowFile) -> Iterator[pa.RecordBatch]:
        """The file's batches, one by one, whether it is in the file or the stream format."""
        from pyarrow import fs, ipc
        from pyspark.sql.pandas.types import to_arrow_schema

        store, path = fs.FileSystem.from_uri(partition.path) if "://" in partition.path else (fs.LocalFileSystem(), partition.path)
        want = to_arrow_schema(self.schema)
        with store.open_input_file(path) as f:
            try:
                file = ipc.open_file(f)
                batches = (file.get_batch(i) for i in range(file.num_record_batches))
            except pa.ArrowInvalid:
                f.seek(0)
                batches = ipc.open_stream(f)
            for batch in batches:
                table = pa.Table.from_batches([batch]).select(want.names).cast(want)
                yield from table.to_batches()


class ArrowSource(DataSource):
    """``spark.read.format("arrow_files").schema(...).option("path", "a.arrow;b.arrow").load()``."""

    @classmethod
    def name(cls) -> str:
        return "arrow_files"

    def schema(self) -> T.StructType:
        raise ValueError("give a schema: Arrow files are read on the executors")

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return ArrowReader(schema, [p for p in self.options["path"].split(";") if p])


def arrow_files(spark: SparkSession, paths: Sequence[str], schema: T.StructType) -> DataFrame:
    """Series in Arrow files, a task for each file."""
    spark.dataSource.register(ArrowSource)
    return nulls_for_nan(spark.read.format("arrow_files").schema(schema).option("path", ";".join(paths)).load())

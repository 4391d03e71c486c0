"""Readers and writers of tables."""

from __future__ import annotations

import logging
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader

log = logging.getLogger(__name__)


class SasDataSource(DataSource):
    """SAS tables, where pyreadstat is installed; only the asked columns are read."""

    @classmethod
    def name(cls) -> str:
        return "sas"

    def schema(self) -> str:
        raise ValueError("give the schema of a SAS table: spark.read.format('sas').schema(...)")

    def reader(self, schema) -> DataSourceReader:
        return _SasReader(schema, self.options)


class _SasReader(DataSourceReader):
    def __init__(self, schema, options):
        self.schema, self.options = schema, options

    def read(self, partition):
        try:
            import pyreadstat
        except ImportError as e:
            raise RuntimeError("reading SAS tables needs pyreadstat") from e
        frame, _ = pyreadstat.read_sas7bdat(self.options["path"], usecols=self.schema.names)
        yield from frame.itertuples(index=False, name=None)


def read_file(spark: SparkSession, path: str, columns: list[str] | None = None, schema: str | None = None) -> DataFrame:
    """Read by extension (csv, parquet, json, sas7bdat); with ``columns``, names in lower case and only these."""
    kind = PurePosixPath(path).suffix.lower()
    if kind == ".csv":
        df = spark.read.csv(path, header=True, schema=schema, inferSchema=schema is None)
    elif kind == ".parquet":
        df = spark.read.parquet(path)
    elif kind == ".json":
        df = spark.read.json(path, schema=schema)
    elif kind == ".sas7bdat":
        spark.dataSource.register(SasDataSource)
        df = spark.read.format("sas").schema(schema).option("path", path).load()
    elif kind in (".pkl", ".pickle"):
        import pandas as pd  # a pickle runs code when read: trusted local files only

        df = spark.createDataFrame(pd.read_pickle(path))
    else:
        raise ValueError(f"unsupported file type: {kind!r}")
    if columns is None:
        return df
    return df.toDF(*[c.lower() for c in df.columns]).select(*[c.lower() for c in columns])


def batch_load(spark: SparkSession, folder: str, files: dict[str, list[str] | None] | list[str]) -> dict[str, DataFrame]:
    """Several files by their stem; a missing file is a warning."""
    wanted = files if isinstance(files, dict) else dict.fromkeys(files)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = {}
    for name, columns in wanted.items():
        path = f"{folder.rstrip('/')}/{name}"
        where = jvm.org.apache.hadoop.fs.Path(path)
        if not where.getFileSystem(conf).exists(where):
            log.warning("no such file: %s", path)
            continue
        out[PurePosixPath(name).stem] = read_file(spark, path, columns)
    return out


def save_table(df: DataFrame, path: str) -> None:
    """Write a table as Parquet."""
    df.write.mode("overwrite").parquet(path)


def save_vocabulary(vocab: DataFrame, path: str) -> None:
    """Text file(s) whose lines are field_token in the order of the global ids."""
    vocab.repartitionByRange("global_id").sortWithinPartitions("global_id").select(F.concat_ws("_", "field", "token").alias("value")).write.mode("overwrite").text(path)

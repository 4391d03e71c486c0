"""Tables in the shared folder: what is read more than once is written once.

A written table cuts lineage, so a lost executor costs a re-read, and numbers
such as a partition's place mean the same in every later job.  The folder is
``spark.checkpoint.dir``, which driver and executors share; only a local session
without that setting gets a temporary folder of its own.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Whether the shuffle files of a statement go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_made: list[tuple[SparkSession, str]] = []


def shared_root(spark: SparkSession) -> str:
    """The session's shared folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="trialspark-")
        spark.conf.set("spark.checkpoint.dir", root)
        _made.append((spark, root))
    return root.rstrip("/")


def scratch(spark: SparkSession, tag: str) -> str:
    """Path of a new folder below the shared folder; it goes when the driver ends."""
    path = f"{shared_root(spark)}/{tag}-{uuid.uuid4().hex[:12]}"
    _made.append((spark, path))
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder, whatever file system it is on."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _remove_all() -> None:
    for spark, path in _made:
        try:
            if spark.sparkContext._jsc is not None:
                remove(spark, path)
        except Exception:  # the session is gone; its files go with the shared folder's own retention
            return


def write_table(df: DataFrame, path: str, mode: str = "errorifexists", codec: str = "zstd") -> None:
    """Write a table as Parquet; the shuffle files behind it serve nothing else, so they go with the statement."""
    spark = df.sparkSession
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", codec).mode(mode).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)


def materialise(df: DataFrame, tag: str, codec: str = "zstd") -> DataFrame:
    """Write a DataFrame to the shared folder and read it again: runs once, no lineage."""
    path = scratch(df.sparkSession, tag)
    write_table(df, path, codec=codec)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def release(*frames: DataFrame) -> None:
    """Delete what ``materialise`` wrote, once nothing will read it again."""
    for df in frames:
        remove(df.sparkSession, df._scratch)

"""Writing intermediate tables to the shared folder and reading them back.

A staged table cuts the lineage: an executor lost later re-reads files, and the readers of
the table scan only the columns they need.
"""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in `spark.checkpoint.dir`; a temporary one only in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        current = spark.sparkContext.getCheckpointDir()
        if current is not None:
            return current
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="haulmetrics-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/haulmetrics/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write `df` as Parquet under the shared folder and return a scan of it."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path, compression=compression)
    return spark.read.parquet(path)


def stage_dense(df: DataFrame, name: str) -> DataFrame:
    """The same for large tables that are kept: fewer bytes at the cost of some time."""
    return stage(df, name, "zstd")

"""Partitioned writes of books, features and results."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_FOLDERS: list[str] = []


def work_folder(spark: SparkSession) -> str:
    """Fresh folder under the shared folder named by ``spark.checkpoint.dir``.

    Only a local session may go without that setting; it then gets a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tickloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/{uuid.uuid4().hex}"
    _FOLDERS.append(path)
    return path


def release(spark: SparkSession) -> int:
    """Delete all work folders that this process has made; gives their number.

    Call it when the results that read them are written: a staged table must not be used
    afterwards.
    """
    files = spark._jvm.org.apache.hadoop.fs
    for path in _FOLDERS:
        folder = files.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    n = len(_FOLDERS)
    _FOLDERS.clear()
    return n


def as_float32(df: DataFrame) -> DataFrame:
    """Doubles become floats at rest."""
    return df.select(*[F.col(c).cast("float").alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def write_partitioned(df: DataFrame, path: str, by: list[str]) -> str:
    """One write for the whole table.

    Rows are spread over (partition, hour) before the write, so a hot day is written by
    many tasks and no task opens every partition.
    """
    spread = [F.col(c) for c in by]
    if "ep" in df.columns:
        spread.append(F.floor(F.col("ep") / 3600))
    df.repartition(*spread).write.mode("overwrite").partitionBy(*by).parquet(path)
    return path


def write_book(df: DataFrame, path: str) -> str:
    return write_partitioned(as_float32(df), path, ["role", "d"])


def write_features(df: DataFrame, path: str) -> str:
    return write_partitioned(as_float32(df), path, ["d"])


def write_results(df: DataFrame, path: str, config: list[str]) -> str:
    return write_partitioned(df, path, config)


def stage(df: DataFrame) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back.

    For a reduced table that several branches use: its input is scanned once, lost
    executors cost nothing, and Spark knows the written size when it plans the joins, so
    a small table is broadcast and a large one is not.
    """
    spark = df.sparkSession
    path = work_folder(spark)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)

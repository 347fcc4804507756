"""Trees of daily book files, and the partitioned store that they are read into.

Raw files stand as ticker / role / year / month / <role>_lob_freq_1s_<day>.parquet with the
file's own column names.  The store has the same order of folders as partitions, down to the
day, and rows sorted by time of day inside its files: ticker, role, month and day choose
folders before anything is read, and a time of day skips row groups by their statistics.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.expr import US, day_of, epoch_us, null_nan
from tickloom.schema import book_columns
from tickloom.sources.readers import conform, native_names, raw_layout, time_column, with_file_date
from tickloom.sources.sinks import stage

PARTS = ["ticker", "role", "yyyy", "mm", "d"]


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder with its scheme, also where the cluster's default file system is implied."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def file_name(role: Column, d: Column) -> Column:
    return F.concat(role, F.lit("_lob_freq_1s_"), F.date_format(d, "yyyy_MM_dd"), F.lit(".parquet"))


def write_daily_files(df: DataFrame, root: str, name: Column | None = None, folder: Column | None = None) -> DataFrame:
    """Write one native file per (ticker, role, d) of ``df`` (ticker, role, d, ts, line and book columns); (path, rows) of each.

    Rows stand by ``line``.  A file is written as its rows stream in, under a temporary name,
    then moved, so a repeated task replaces its own files.  ``name`` and ``folder`` replace the
    usual ones.
    """
    root = qualified(df.sparkSession, root)
    name = file_name(F.col("role"), F.col("d")) if name is None else name
    folder = F.concat_ws("/", "ticker", "role", F.date_format("d", "yyyy"), F.date_format("d", "MM")) if folder is None else folder
    columns = [c for c in df.columns if c not in ("ticker", "role", "d", "ts", "line")]
    to_native = {v: k for k, v in native_names().items()}
    path = F.concat_ws("/", F.when(folder != "", folder), name).alias("path")
    rows = df.select(path, "line", F.col("ts").alias("timestamp"), *[F.col(c).alias(to_native.get(c, c)) for c in columns])

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(root)
        now, writer, hidden, count = None, None, "", 0

        def close() -> pa.RecordBatch:
            writer.close()
            store.move(hidden, f"{base}/{now}")
            return pa.record_batch([pa.array([now]), pa.array([count], pa.int64())], ["path", "rows"])

        for batch in batches:
            data = pa.Table.from_batches([batch])
            ends = [i for i in range(1, len(batch)) if batch.column(0)[i] != batch.column(0)[i - 1]] if len(batch) and batch.column(0)[0] != batch.column(0)[len(batch) - 1] else []
            for a, b in zip([0, *ends], [*ends, len(batch)]):
                if a == b:
                    continue
                this, part = batch.column(0)[a].as_py(), data.slice(a, b - a).drop_columns(["path", "line"])
                if this != now:
                    if writer:
                        yield close()
                    now, count = this, 0
                    parent = f"{base}/{now}".rpartition("/")[0]
                    store.create_dir(parent, recursive=True)
                    hidden = f"{parent}/.{uuid.uuid4().hex}"
                    writer = pq.ParquetWriter(hidden, part.schema, filesystem=store)
                writer.write_table(part)
                count += b - a
        if writer:
            yield close()

    return stage(rows.repartition("path").sortWithinPartitions("path", "line").mapInArrow(files, "path string, rows long"))


def months(first: dt.date, last: dt.date) -> list[str]:
    """Folders yyyy/mm from one day's to another's."""
    return [f"{m // 12:04d}/{m % 12 + 1:02d}" for m in range(first.year * 12 + first.month - 1, last.year * 12 + last.month)]


def read_daily_files(spark: SparkSession, root: str, ticker: str = "*", role: str = "*", first: dt.date | None = None, last: dt.date | None = None, levels: int = 10) -> DataFrame:
    """Rows of a raw tree: ticker, role, d (from the file's name), file, line (place in the file), ts and the book columns, NaN as NULL.

    Folders outside the wanted ticker, role and months are not listed; files whose name holds
    no day or a day out of range are not read.  Both ends of the range are given or none.
    """
    if (first is None) != (last is None):
        raise ValueError("give both ends of the range or none")
    dates = f"{{{','.join(months(first, last))}}}" if first else "*/*"
    raw = spark.read.option("mergeSchema", "true").parquet(f"{root}/{ticker}/{role}/{dates}/*.parquet")
    place = F.split("_metadata.file_path", "/")
    named = with_file_date(raw.select("*", F.element_at(place, -5).alias("ticker"), F.element_at(place, -4).alias("role"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("line")))
    named = named.where(F.col("session_date").isNotNull())
    if first:
        named = named.where(F.col("session_date").between(F.lit(first), F.lit(last)))
    named = time_column(named.withColumnRenamed("session_date", "d")).withColumnsRenamed(native_names(levels))
    return conform(named, book_columns(levels), ["ticker", "role", "d", "file", "line", "ts"])


def organize(spark: SparkSession, flat: str, root: str, ticker: str) -> DataFrame:
    """Read raw files of one flat folder into a store by the role and day in their names; (file, role, yyyy, mm, rows) of every file.

    Files whose name does not match have a null role and are left out of the store.
    """
    raw = time_column(spark.read.parquet(f"{flat}/*.parquet"))
    rows = with_file_date(raw.select("*", F.col("_metadata.file_name").alias("file"))).withColumnsRenamed(native_names())
    rows = rows.select("*", *raw_layout(F.col("file")))
    values = [c for c in book_columns(10) if c in rows.columns]
    write_store(rows.where("role IS NOT NULL").select(F.lit(ticker).alias("ticker"), "role", F.col("session_date").alias("d"), epoch_us("ts").alias("us"), *[null_nan(c).alias(c) for c in values]), root)
    return rows.groupBy("file", "role", "yyyy", "mm").agg(F.count("*").alias("rows"))


def write_store(df: DataFrame, root: str) -> str:
    """Write rows (ticker, role, us, values; d if the day is not that of us) as partitions, by time of day inside a file.

    A day is dealt over its hours, so a hot day is written by several tasks and each file
    covers a stretch of the day.
    """
    day = F.col("d") if "d" in df.columns else day_of(F.floor(F.col("us") / US))
    micros = F.pmod(F.col("us"), F.lit(86_400 * US)).alias("micros")
    rows = df.withColumn("d", day).select("ticker", "role", F.date_format("d", "yyyy").alias("yyyy"), F.date_format("d", "MM").alias("mm"), "d", micros, *[c for c in df.columns if c not in ("ticker", "role", "d")])
    hour = F.floor(F.col("micros") / (3_600 * US))
    rows.repartition(*PARTS, hour).sortWithinPartitions(*PARTS, "micros").write.mode("overwrite").partitionBy(*PARTS).parquet(root)
    return root


def read_store(spark: SparkSession, root: str, ticker: str | None = None, role: str | None = None, first: dt.date | None = None, last: dt.date | None = None,
               include: list[dt.date] | DataFrame | None = None, exclude: list[dt.date] | None = None, opens: int | None = None, closes: int | None = None) -> DataFrame:
    """Rows of a store.  Every condition is one on a partition or on the sorted time of day, so folders, files and row groups are skipped.

    ``include`` may be a list of days or a table with the column d, then its days prune the
    folders when the query runs.  ``opens`` and ``closes`` are seconds of the day, both inclusive.
    """
    if include is not None and exclude is not None:
        raise ValueError("include and exclude cannot be combined")
    df = spark.read.schema(with_string_parts(spark, root)).parquet(root)
    if ticker is not None:
        df = df.where(F.col("ticker") == ticker)
    if role is not None:
        df = df.where(F.col("role") == role)
    if first is not None:
        df = df.where(F.col("d") >= F.lit(first))
    if last is not None:
        df = df.where(F.col("d") <= F.lit(last))
    if exclude is not None:
        df = df.where(~F.col("d").isin(exclude))
    if isinstance(include, list):
        df = df.where(F.col("d").isin(include))
    elif include is not None:
        # One row per calendar day.
        df = df.join(F.broadcast(include.select("d").distinct()), "d", "left_semi")
    if opens is not None:
        df = df.where(F.col("micros") >= opens * US)
    if closes is not None:
        df = df.where(F.col("micros") <= closes * US)
    return df


def with_string_parts(spark: SparkSession, root: str):
    """The store's schema with year and month as text, not as the numbers that Spark infers."""
    from pyspark.sql import types as T

    found = spark.read.parquet(root).schema
    kinds = {"ticker": T.StringType(), "role": T.StringType(), "yyyy": T.StringType(), "mm": T.StringType(), "d": T.DateType()}
    return T.StructType([T.StructField(f.name, kinds.get(f.name, f.dataType)) for f in found])

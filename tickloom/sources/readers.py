"""Scans of books, series and reference files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions.expr import US, epoch_us, null_nan
from tickloom.schema import KINDS, MARKET_ZONE, SIDES, book_column, book_columns
from tickloom.sources.sinks import stage

# File name patterns.
FILE_DATE = r"(\d{4})_(\d{2})_(\d{2})\.parquet$"
RAW_NAME = r"^(ctd|futures|fut)_.*?(\d{4})_(\d{2})_(\d{2})\.parquet$"


def time_column(df: DataFrame) -> DataFrame:
    """Rename the one time column, ``timestamp`` or ``Date-Time``, to ``ts``."""
    found = [c for c in ("timestamp", "Date-Time") if c in df.columns]
    if len(found) != 1:
        raise ValueError("need exactly one of the columns 'timestamp' and 'Date-Time'")
    return df.withColumnRenamed(found[0], "ts")


def utc_wall(ts: Column) -> Column:
    """Wall clock in UTC of an instant, whatever the session time zone."""
    seconds = (F.unix_micros(ts).cast("decimal(24,6)") / 1_000_000).cast("decimal(18,6)")
    return F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'") + F.make_dt_interval(secs=seconds)


def market_time(df: DataFrame, time: str = "ts", zone: str = MARKET_ZONE) -> tuple[Column, bool]:
    """Wall clock of the market and whether it was converted: a time without zone is the market's already, an instant is converted."""
    kind = dict(df.dtypes)[time]
    if kind == "timestamp_ntz":
        return F.col(time), False
    if kind == "timestamp":
        return F.convert_timezone(F.lit("UTC"), F.lit(zone), utc_wall(F.col(time))), True
    raise ValueError(f"column {time} is {kind}, not a time")


def native_names(levels: int = 10) -> dict[str, str]:
    """File column -> canonical column, as in ``L3-BidPrice`` -> ``l3_bid_price``."""
    return {f"L{lv}-{side.title()}{kind.title()}": book_column(lv, side, kind) for lv in range(1, levels + 1) for side in SIDES for kind in KINDS}


def read_book(spark: SparkSession, path: str, levels: int = 10) -> DataFrame:
    """Read book files under file or canonical names, keep canonical columns, turn NaN into NULL.

    An input without rows or without any book column is an error.
    """
    df = time_column(spark.read.parquet(path)).withColumnsRenamed(native_names(levels))
    if not set(df.columns) & set(book_columns(levels)):
        raise ValueError(f"{path}: no book column among {', '.join(df.columns)}")
    if df.isEmpty():
        raise ValueError(f"{path}: no rows")
    return conform(df, book_columns(levels), keep=[c for c in df.columns if c in ("ts", "ticker", "role", "session_date", "yyyy", "mm")])


def conform(df: DataFrame, expected: list[str], keep: list[str]) -> DataFrame:
    """Canonical columns in order: missing ones become NULL, others are dropped."""
    types = dict(df.dtypes)

    def one(c):
        if c not in types:
            return F.lit(None).cast("double").alias(c)
        return (null_nan(c) if types[c] in ("double", "float") else F.col(c).cast("double")).alias(c)

    return df.select(*keep, *[one(c) for c in expected])


def column_report(df: DataFrame, expected: list[str], keep: list[str]) -> tuple[list[str], list[str]]:
    """(missing, extra) columns against the canonical list."""
    have = set(df.columns) - set(keep)
    return sorted(set(expected) - have), sorted(have - set(expected))


def file_date(name) -> Column:
    """Day encoded in a file name, NULL when the name does not match."""
    part = [F.regexp_extract(name, FILE_DATE, i) for i in (1, 2, 3)]
    return F.when(part[0] != "", F.make_date(*[p.try_cast("int") for p in part]))


def with_file_date(df: DataFrame) -> DataFrame:
    return df.withColumn("session_date", file_date(F.col("_metadata.file_name")))


def raw_layout(name) -> list[Column]:
    """role, yyyy and mm of a raw file name; NULL role marks a name to skip."""
    role = F.regexp_extract(name, RAW_NAME, 1)
    role = F.when(role == "futures", "fut").when(role != "", role)
    return [role.alias("role"), F.regexp_extract(name, RAW_NAME, 2).alias("yyyy"), F.regexp_extract(name, RAW_NAME, 3).alias("mm")]


def merge_deliveries(df: DataFrame, keys: list[str], number: str = "delivery_no") -> DataFrame:
    """Keep, per key, only the rows of its latest delivery.

    The maxima are one row per key, written so that Spark broadcasts them when they are
    small instead of shuffling the whole table by a possibly hot key.
    """
    latest = stage(df.groupBy(*keys).agg(F.max(number).alias(number)))
    return df.join(latest, [*keys, number], "left_semi")


def filter_series(df: DataFrame, opens: int, closes: int, include=None, exclude=None) -> DataFrame:
    """Series rows by time of day and day list; include and exclude exclude each other."""
    if include is not None and exclude is not None:
        raise ValueError("include and exclude cannot be combined")
    if include is not None:
        df = df.where(F.col("d").isin(*include))
    if exclude is not None:
        df = df.where(~F.col("d").isin(*exclude))
    us = F.pmod(F.col("us"), F.lit(86_400 * US))
    return df.where(us.between(opens * US, closes * US))


def read_daily_cf(spark: SparkSession, path: str) -> DataFrame:
    schema = "Date date, CF double, ISIN string, CUSIP string"
    df = spark.read.schema(schema).csv(path, header=True)
    return df.toDF("d", "cf", "isin", "cusip").withColumn("cf", null_nan("cf"))


def read_event_dates(spark: SparkSession, path: str, column: str) -> DataFrame:
    """Distinct non-null dates of one CSV column."""
    df = spark.read.csv(path, header=True)
    return event_dates(df, F.to_date(F.col(f"`{column}`")))


def event_dates(df: DataFrame, column: Column) -> DataFrame:
    return df.select(column.alias("d")).where("d IS NOT NULL").distinct()


def read_bonds(spark: SparkSession, path: str) -> DataFrame:
    schema = T.StructType([
        T.StructField("ISIN", T.StringType()), T.StructField("Coupon Annual Rate", T.DoubleType()),
        T.StructField("Coupon Frequency", T.IntegerType()), T.StructField("First Coupon Date", T.DateType()),
        T.StructField("Maturity Date", T.DateType())])
    return spark.read.schema(schema).csv(path, header=True).toDF("isin", "coupon_rate", "coupon_freq", "first_coupon", "maturity")


def read_futures(spark: SparkSession, path: str) -> DataFrame:
    schema = T.StructType([T.StructField("Last Trading Date", T.DateType()), T.StructField("Delivery Date", T.DateType())])
    return spark.read.schema(schema).csv(path, header=True).toDF("last_trading", "delivery")


def read_ticks(spark: SparkSession, path: str, instrument: str, schema: str) -> DataFrame:
    """Ticks of one instrument with their mid price and ``us``, the market's clock; rows without a time are left out."""
    df = time_column(spark.read.schema(schema).csv(path, header=True).where(F.col("`#RIC`") == instrument).drop("#RIC")).where("ts IS NOT NULL")
    df = df.withColumnsRenamed(native_names(1)).withColumn("us", epoch_us(market_time(df)[0]))
    return df.withColumn("mid", (F.col("l1_bid_price") + F.col("l1_ask_price")) / 2)


def valid_proposals(df: DataFrame, bond: str) -> DataFrame:
    """Active, logged-on orders of one bond."""
    return df.where((F.col("bond_code") == bond) & (F.col("status") == 0) & (F.col("check_logon") == 0))


def read_proposals(spark: SparkSession, path: str, bond: str) -> DataFrame:
    """Active orders of one bond; start_us and end_us are the market's clock."""
    raw = spark.read.parquet(path)
    names = {"BONDCODE": "bond_code", "STATUS": "status", "CHECK_LOGON": "check_logon", "updateTS": "update_ts", "endTS": "end_ts",
             "BIDPRICE": "bid_price", "BIDQTY": "bid_qty", "ASKPRICE": "ask_price", "ASKQTY": "ask_qty"}
    df = raw.withColumnsRenamed(names)
    df = valid_proposals(df, bond)
    return df.withColumns({"start_us": epoch_us(market_time(df, "update_ts")[0]), "end_us": epoch_us(market_time(df, "end_ts")[0])})

"""Shared column formulas and row handling of the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.sources.sinks import stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, a null one as the empty string."""
    return F.coalesce(F.col(column), F.lit(""))


def words(text: Column) -> Column:
    """Runs of characters other than space and U+0009 to U+000D."""
    return F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), "")


def ascii_lower(text: Column) -> Column:
    """A-Z become a-z, every other character stays."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def row_key(columns: list[str]) -> list[Column]:
    """Two 64-bit hashes of a row's values and nulls, k1 and k2: equal for equal rows, on every reading of the table."""
    values = [F.col(f"`{c}`") for c in columns]
    nulls = F.concat(*[F.when(v.isNull(), "1").otherwise("0") for v in values])
    return [F.xxhash64(nulls, *values).alias("k1"), F.xxhash64(*values, F.lit(1), nulls).alias("k2")]


def take_rows(docs: DataFrame, chosen: DataFrame, many: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``chosen`` (k1, k2, copies) names, each as often as it says, all columns.

    ``many`` (k1, k2) lists the keys of repeated rows; such rows are alike in every column, so
    one stands for all.  The texts are dealt out once, against a hash table of narrow rows;
    they are neither written beside the input nor sorted, at any size.
    """
    rows = docs.select(F.struct(*docs.columns).alias("row"), *row_key(docs.columns))
    many = stage(many)
    if many.isEmpty():
        found = rows.join(chosen.hint("shuffle_hash"), ["k1", "k2"])
    else:
        once = rows.join(chosen.join(many, ["k1", "k2"], "left_anti").hint("shuffle_hash"), ["k1", "k2"])
        often = rows.join(chosen.join(many, ["k1", "k2"], "left_semi").hint("shuffle_hash"), ["k1", "k2"])
        found = once.unionByName(often.dropDuplicates(["k1", "k2"]))
    return found.select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies"))).alias("copy")).select("row.*")


def repeated(keyed: DataFrame) -> DataFrame:
    """(k1, k2) of the rows that stand more than once."""
    return keyed.groupBy("k1", "k2").agg(F.count("*").alias("n")).where("n > 1").select("k1", "k2")

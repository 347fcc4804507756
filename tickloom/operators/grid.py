"""Snapping to a regular time grid, resampling and role joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.expr import US, day_of
from tickloom.schema import market_keys


def _bin(step_s: int):
    return F.expr(f"us div {step_s * US} * {step_s}")


def snap(df: DataFrame, keys: list[str], step_s: int) -> DataFrame:
    """Last row per key and time bin of ``step_s`` seconds.

    Input carries ``us`` (wall-clock microseconds, unique per key); output carries ``ep``,
    the bin start.  One maximum-by per column keeps every aggregation buffer primitive, so
    Spark hash-aggregates on the map side and a hot bin shrinks to one row per task before
    anything is shuffled.
    """
    rest = [c for c in df.columns if c not in keys and c not in ("ts", "d", "ep", "us")]
    last = [F.max_by(c, "us").alias(c) for c in rest]
    return df.groupBy(*keys, _bin(step_s).alias("ep")).agg(*last, F.max("us").alias("us"))


def snap_roles(df: DataFrame, step_s: int) -> DataFrame:
    """Last level-1 quotes of bond and future per bin in which both are quoted, side by side.

    Same result as snapping each role and joining them, from one scan and one shuffle.
    Markets of a table with a ticker stay apart.
    """
    keys = market_keys(df)
    aggs = []
    for role in ("ctd", "fut"):
        when = F.when(F.col("role") == role, F.col("us"))
        aggs += [F.max_by(f"l1_{s}_{k}", when).alias(f"{role}_{s}_{k}") for k in ("price", "size") for s in ("bid", "ask")]
        aggs.append(F.max(when).alias(f"_{role}"))
    both = df.groupBy(*keys, _bin(step_s).alias("ep")).agg(*aggs).where("_ctd IS NOT NULL AND _fut IS NOT NULL")
    return both.drop("_ctd", "_fut").withColumn("d", day_of("ep"))


def full_grid(span: DataFrame, keys: list[str], step_s: int) -> DataFrame:
    """All bins from ``_a`` to ``_b`` of one row per key, spread over tasks by day."""
    per_day = F.explode(F.sequence(F.expr("_a div 86400"), F.expr("_b div 86400"))).alias("_day")
    days = span.select(*keys, "_a", "_b", per_day).repartition(*keys, "_day")
    first = F.greatest(F.col("_a"), F.ceil(F.col("_day") * 86_400 / step_s) * step_s)
    last = F.least(F.col("_b"), F.col("_day") * 86_400 + 86_399)
    days = days.withColumns({"_from": first.cast("long"), "_to": last.cast("long")}).where("_from <= _to")
    return days.select(*keys, F.explode(F.sequence("_from", "_to", F.lit(step_s).cast("long"))).alias("ep"))


def resample_last(df: DataFrame, keys: list[str], step_s: int, values: list[str]) -> DataFrame:
    """Last non-null value of every column per bin; empty bins between first and last stay as null rows.

    ``df`` has ``ep``.  The empty bins come from one row per key that holds its first and
    last bin, so the only rows added are rows of the result.
    """
    ep = F.col("ep") - F.pmod(F.col("ep"), F.lit(step_s))
    aggs = [F.max_by(v, F.when(F.col(v).isNotNull(), F.col("ep"))).alias(v) for v in values]
    bins = df.groupBy(*keys, ep.alias("ep")).agg(*aggs)
    span = df.groupBy(*keys).agg(F.min(ep).alias("_a"), F.max(ep).alias("_b"))
    return full_grid(span, keys, step_s).join(bins, [*keys, "ep"], "left")


def join_roles(grid: DataFrame) -> DataFrame:
    """Level-1 quotes of bond and future on their common timestamps, one wide row each."""
    keys = [*market_keys(grid), "ep"]

    def side(role):
        names = [F.col(f"l1_{s}_{k}").alias(f"{role}_{s}_{k}") for k in ("price", "size") for s in ("bid", "ask")]
        return grid.where(F.col("role") == role).select(*keys, *names)

    return side("ctd").join(side("fut"), keys).withColumn("d", day_of("ep"))


def align_daily(df: DataFrame, daily: DataFrame, on: str = "d") -> DataFrame:
    """Left join of one row per day onto finer rows; daily tables hold one row per calendar day."""
    return df.join(F.broadcast(daily), on, "left")


def check_daily(df: DataFrame, daily: DataFrame, on: str = "d") -> DataFrame:
    """One row: duplicated days of the daily table and days of ``df`` it does not cover."""
    dup = daily.groupBy(on).count().where("count > 1").agg(F.count("*").alias("duplicate_days"))
    miss = df.select(on).distinct().join(daily.select(on), on, "left_anti").agg(F.count("*").alias("missing_days"))
    return dup.crossJoin(miss)  # one row each


def require_daily(df: DataFrame, daily: DataFrame, on: str = "d") -> None:
    """Raise when the daily table has duplicate days or misses a day of ``df``."""
    row = check_daily(df, daily, on).first()
    if row["duplicate_days"] or row["missing_days"]:
        raise ValueError(f"daily table: {row['duplicate_days']} duplicate days, {row['missing_days']} missing days")

"""Raw book rows to a clean grid, with a fate for every row and every slot.

One shuffle by (series, day, slot) meets the raw rows and the day's grid.  A row without a
time, outside the market hours, kept or a duplicate of a kept one is counted as that; a slot
of the grid is observed or added.  The cleaned book and the report are two readings of the
same written table, so rows in = null_time + outside + duplicate + kept, and slots of the
grid = kept + added.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.expr import US, day_start, epoch_us
from tickloom.schema import CONTRACTS, MARKET_ZONE, TICKER_CONTRACTS, market_keys
from tickloom.sources.readers import column_report, conform, market_time
from tickloom.sources.sinks import stage

NULL_TIME, OUTSIDE, INSIDE = range(3)

# Names of the records.
RECORDS = ("TIMEZONE_LOCALIZED", "TIMEZONE_CONVERTED", "INDEX_SORTED", "INDEX_WINDOW_CUT", "INDEX_DROP_NANS", "INDEX_DROP_DUPS", "INDEX_GRID_ADJUSTED", "COLUMNS_MISSING_ADD",
           "COLUMNS_EXTRA_DROP")


@dataclass(frozen=True)
class Cleaned:
    """``book``: a row per slot of the grid with ep, fate and the book columns.  ``report``: fates per series and day.
    ``records``: (series, d, id, n) of what was changed, in long form."""

    book: DataFrame
    report: DataFrame
    records: DataFrame


def market_hours(df: DataFrame) -> tuple[Column, Column]:
    """Opening and closing second of the row's market."""
    opens, closes = F.lit(None).cast("long"), F.lit(None).cast("long")
    terms = {(t, r): c for (t, r), c in TICKER_CONTRACTS.items()} if "ticker" in df.columns else {(None, r): c for r, c in CONTRACTS.items()}
    for (ticker, role), c in terms.items():
        mine = F.col("role") == role if ticker is None else (F.col("role") == role) & (F.col("ticker") == ticker)
        opens, closes = F.when(mine, F.lit(c.opens).cast("long")).otherwise(opens), F.when(mine, F.lit(c.closes).cast("long")).otherwise(closes)
    return opens, closes


def slots(raw: DataFrame, columns: list[str], line: str, zone: str, step: int) -> DataFrame:
    """Written table, one row per (series, d, kind, slot): n rows, the first of them, and how they stood in the file.

    ``line`` numbers the rows of a file; the rows of one slot meet in one task.
    """
    keys = [*market_keys(raw), "role", "d"]
    opens, closes = market_hours(raw)
    wall, _ = market_time(raw, "ts", zone)
    rows = conform(raw, columns, [*keys, "ts", line]).select(*keys, F.col(line).cast("long").alias("line"), epoch_us(wall).alias("us"), F.struct(*columns).alias("row"), opens.alias("opens"), closes.alias("closes"))
    since = F.col("us") - day_start("d") * US
    inside = since.between(F.col("opens") * US, F.col("closes") * US)
    kind = F.when(F.col("us").isNull(), NULL_TIME).when(inside, INSIDE).otherwise(OUTSIDE)
    slot = F.col("opens") + F.floor((since / US - F.col("opens")) / step) * step
    slot = F.when(kind == INSIDE, slot).when(kind == OUTSIDE, F.floor(since / US))
    rows = rows.select(*keys, kind.alias("kind"), slot.cast("long").alias("slot"), "us", "line", "row")
    days = raw.select(*keys).distinct()
    opens, closes = market_hours(days)
    grid = days.select(*keys, F.lit(INSIDE).alias("kind"), F.explode(F.sequence(opens, closes, F.lit(step).cast("long"))).alias("slot"))
    grid = grid.select("*", *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ("us", "line", "row")])
    seen = F.when(F.col("line").isNotNull() & F.col("us").isNotNull(), F.struct("us", "line"))
    met = rows.unionByName(grid).groupBy(*keys, "kind", "slot").agg(F.count("line").alias("n"), F.min_by("row", seen).alias("row"), F.sort_array(F.collect_list(seen)).alias("seen"))
    lines = F.transform("seen", lambda x: x["line"])
    mixed = F.exists(F.zip_with(lines, F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1))), lambda a, b: a > b), lambda x: F.coalesce(x, F.lit(False)))
    return stage(met.select(*keys, "kind", "slot", "n", "row", F.array_min(lines).alias("lo"), F.array_max(lines).alias("hi"), mixed.alias("mixed")))


def clean(raw: DataFrame, columns: list[str], line: str, zone: str = MARKET_ZONE, step: int = 1) -> Cleaned:
    """Clean raw rows with role, d (the file's day), ts, ``line`` (place in the file) and book columns; runs one job.

    Rows are put on a grid of ``step`` seconds from opening to closing time; of the rows in
    one slot the earliest stays, of equal times the first in the file.  Missing columns are
    added as NULL, others dropped.
    """
    keys = [*market_keys(raw), "role", "d"]
    met = slots(raw, columns, line, zone, step)
    inside = met.where(F.col("kind") == INSIDE)
    book = inside.select(*keys, (day_start("d") + F.col("slot")).alias("ep"), F.when(F.col("n") > 0, "observed").otherwise("added").alias("fate"), *[F.col("row")[c].alias(c) for c in columns])
    before = Window.partitionBy(*keys).orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    late = met.withColumn("late", F.coalesce(F.max("hi").over(before) > F.col("lo"), F.lit(False)) | F.col("mixed"))
    n, of = F.col("n"), F.col("kind")
    report = late.groupBy(*keys).agg(
        F.sum("n").alias("rows"), F.sum(F.when(of == NULL_TIME, n).otherwise(0)).alias("null_time"), F.sum(F.when(of == OUTSIDE, n).otherwise(0)).alias("outside"),
        F.sum(F.when((of == INSIDE) & (n > 0), n - 1).otherwise(0)).alias("duplicate"), F.count_if((of == INSIDE) & (n > 0)).alias("kept"), F.count_if((of == INSIDE) & (n == 0)).alias("added"),
        F.bool_or("late").alias("unsorted"))
    missing, extra = column_report(raw, columns, [*keys, "ts", line])
    _, converted = market_time(raw, "ts", zone)
    counts = dict(zip(RECORDS, (F.lit(0) if converted else F.col("rows"), F.col("rows") if converted else F.lit(0), F.col("unsorted").cast("int"), F.col("outside"), F.col("null_time"),
                                F.col("duplicate"), F.col("added"), F.lit(len(missing)), F.lit(len(extra)))))
    long = F.array(*[F.struct(F.lit(i).alias("id"), v.cast("long").alias("n")) for i, v in counts.items()])
    records = report.select(*keys, F.inline(F.filter(long, lambda x: x["n"] > 0)))
    return Cleaned(book, report, records)


def require_conserved(report: DataFrame, step: int = 1) -> None:
    """Raise unless every row and every slot of every day has exactly one fate."""
    opens, closes = market_hours(report)
    whole = F.col("null_time") + F.col("outside") + F.col("duplicate") + F.col("kept")
    bad = report.where((whole != F.col("rows")) | (F.col("kept") + F.col("added") != F.floor((closes - opens) / step) + 1)).first()
    if bad:
        raise ValueError(f"fates do not add up: {bad}")

"""Book, market and record tables derived from an ``events`` table.

``Tables`` turns one event stream into the inputs the analytics need.  Every table is
a DataFrame over the whole stream.  Tables used by day windows are first reduced to one
row per second (or coarser) with a map-side combinable aggregate, so a (series, day) group
never exceeds 86,400 rows however dense the stream is.  Reduced tables that a study reads
several times are written once, so the stream is scanned once.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.functions.expr import day_of, epoch_us
from tickloom.operators.grid import snap, snap_roles
from tickloom.schema import book_columns
from tickloom.sources.sinks import stage
from tickloom.sources.static import BOND_COLUMNS, CTD_BONDS, EXCLUDED, EXCLUDED_COLUMNS, FUTURE_COLUMNS, FUTURES, values_sql

def deep_levels() -> str:
    """Levels 4 to 10 of the derived book, with one planted defect each: wrong price order, non-positive size, off-tick price, missing size."""
    out = []
    for lv in range(4, 11):
        bid, ask = f"mid_c - half - {lv - 1} * (1 + h % 2)", f"mid_c + half + {lv - 1} * (1 + h % 2)"
        out.append(f" CAST({bid} + CASE WHEN h % {60 + lv} = 0 THEN 40 ELSE 0 END AS DOUBLE) / 100.0 AS l{lv}_bid_price")
        out.append(f" CASE WHEN h % {80 + lv} = 0 THEN NULL WHEN h % {70 + lv} = 0 THEN 0.0E0 ELSE CAST(1 + (h + {lv}) % 9 AS DOUBLE) * 0.5 END AS l{lv}_bid_size")
        out.append(f" CAST({ask} AS DOUBLE) / 100.0 + CASE WHEN h % {90 + lv} = 0 THEN 0.005 ELSE 0.0 END AS l{lv}_ask_price")
        out.append(f" CAST(1 + (h * {lv + 1}) % 7 AS DOUBLE) * 0.5 AS l{lv}_ask_size")
    return ",\n".join(out)


# Text that runs unchanged on Spark and on DuckDB.
LOB = """
SELECT event_id, ts, d, role,
 CASE WHEN h % 23 = 0 THEN NULL ELSE CAST(CASE WHEN h % 37 = 0 THEN -1 WHEN h % 31 = 0 THEN mid_c + half + 1
      ELSE mid_c - half END AS DOUBLE) / 100.0 + CASE WHEN h % 41 = 0 THEN 0.005 ELSE 0.0 END END AS l1_bid_price,
 CASE WHEN h % 23 = 0 OR h % 29 = 0 THEN NULL WHEN h % 43 = 0 THEN 0.25
      ELSE CAST(1 + h % 9 AS DOUBLE) * 0.5 END AS l1_bid_size,
 CAST(mid_c + half AS DOUBLE) / 100.0 AS l1_ask_price,
 CASE WHEN h % 47 = 0 THEN 0.0E0 ELSE CAST(1 + (h * 2) % 7 AS DOUBLE) * 0.5 END AS l1_ask_size,
 CAST(mid_c - half - 1 * (1 + h % 2) AS DOUBLE) / 100.0 AS l2_bid_price,
 CAST(1 + (h + 2) % 9 AS DOUBLE) * 0.5 AS l2_bid_size,
 CAST(mid_c + half + CASE WHEN h % 53 = 0 THEN -1 ELSE 1 + h % 2 END AS DOUBLE) / 100.0 AS l2_ask_price,
 CAST(1 + (h * 3) % 7 AS DOUBLE) * 0.5 AS l2_ask_size,
 CAST(mid_c - half - 2 * (1 + h % 2) AS DOUBLE) / 100.0 AS l3_bid_price,
 CAST(1 + (h + 3) % 9 AS DOUBLE) * 0.5 AS l3_bid_size,
 CAST(mid_c + half + 2 * (1 + h % 2) AS DOUBLE) / 100.0 AS l3_ask_price,
 CAST(1 + (h * 4) % 7 AS DOUBLE) * 0.5 AS l3_ask_size,
""" + deep_levels() + """
FROM (SELECT *, 1 + h % 3 AS half FROM (
 SELECT event_id, ts, CAST(ts AS DATE) AS d, CASE WHEN user_id % 2 = 0 THEN 'ctd' ELSE 'fut' END AS role,
        (event_id * 7919 + user_id * 104729) % 1000003 AS h,
        10000 + CAST(FLOOR(value) AS BIGINT) % 50 AS mid_c
 FROM {events}) b) s
"""

CLEAN = ("l1_bid_price IS NOT NULL AND l1_bid_size IS NOT NULL AND l1_bid_price > 0 "
         "AND l1_bid_price < l1_ask_price")

# Rows of the flawed book whose level 1 is missing: mornings of a few days, a third of the bond's rows of others.
FLAWED = "(DAY(d) % 11 = 3 AND us % 86400000000 < 36000000000) OR (role = 'ctd' AND DAY(d) % 9 = 4 AND event_id % 3 = 0)"

DAILY_CF = """
SELECT d, CAST(90 + DAY(d) % 7 AS DOUBLE) / 100.0 AS cf,
       CASE WHEN DAY(d) <= 10 THEN 'IT0001' WHEN DAY(d) <= 20 THEN 'IT0002' ELSE 'IT0003' END AS isin,
       CASE WHEN DAY(d) <= 10 THEN 'CU0001' WHEN DAY(d) <= 20 THEN 'CU0002' ELSE 'CU0003' END AS cusip
FROM (SELECT DISTINCT CAST(ts AS DATE) AS d FROM {events}) days
"""

PROPOSALS = """
SELECT event_id AS order_id, ts AS update_ts, 30 + (event_id * 7919 + user_id * 104729) % 3600 AS life_s,
       CASE WHEN event_id % 2 = 0 THEN 'IT0001' ELSE 'IT0002' END AS bond_code,
       CASE WHEN event_id % 19 = 0 THEN 0.0E0 ELSE CAST(10000 - event_id % 12 AS DOUBLE) / 100.0 END AS bid_price,
       CAST(1 + event_id % 5 AS DOUBLE) AS bid_qty,
       CASE WHEN event_id % 17 = 0 THEN 0.0E0 ELSE CAST(10001 + event_id % 11 AS DOUBLE) / 100.0 END AS ask_price,
       CAST(1 + event_id % 4 AS DOUBLE) AS ask_qty,
       CASE WHEN event_id % 13 = 0 THEN 1 ELSE 0 END AS status,
       CASE WHEN event_id % 29 = 0 THEN 1 ELSE 0 END AS check_logon
FROM {events}
"""

EXEC_RECORDS = """
SELECT event_id % 7 AS seed, CASE WHEN episode % 2 = 0 THEN 'bid' ELSE 'ask' END AS side, episode, step, ts,
       step = 2 AS terminal, h % 11 AS action, CAST(10000 + episode % 50 AS DOUBLE) / 100.0 AS benchmark_price,
       CASE WHEN step = 2 THEN CAST(10000 + episode % 50 + h % 9 - 4 AS DOUBLE) / 100.0 END AS execution_price,
       CASE WHEN step = 2 THEN CASE WHEN h % 3 = 0 THEN 'market' WHEN h % 3 = 1 THEN 'limit' ELSE 'forced' END END AS status
FROM (SELECT event_id - event_id % 3 AS event_id, ts, event_id - event_id % 3 AS episode, event_id % 3 AS step,
             (event_id * 7919 + user_id * 104729) % 1000003 AS h FROM {events}) b
"""

PREDICTIONS = """
SELECT seed, event_id, value AS y_true, value + CAST(h % 101 - 50 AS DOUBLE) / 10.0 AS y_pred, c_true, c_pred,
       CAST(CASE WHEN c_pred = 0 THEN 0.8 ELSE 0.1 END AS DOUBLE) AS p0,
       CAST(CASE WHEN c_pred = 1 THEN 0.8 ELSE 0.1 END AS DOUBLE) AS p1,
       CAST(CASE WHEN c_pred = 2 THEN 0.8 ELSE 0.1 END AS DOUBLE) AS p2
FROM (SELECT *, h % 3 AS c_true, CASE WHEN h % 7 = 0 THEN (h + 1) % 3 ELSE h % 3 END AS c_pred FROM (
 SELECT event_id, event_id % 3 AS seed, value, (event_id * 7919 + user_id * 104729) % 1000003 AS h FROM {events}) b) c
"""

MARKET_STEP = 300


class Tables:
    """Lazy input tables over one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _sql(self, text: str) -> DataFrame:
        return self.spark.sql(text, events=self.events)

    @cached_property
    def events(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/events.parquet")

    @cached_property
    def lob(self) -> DataFrame:
        """Raw ten-level book snapshots, defects included."""
        return self._sql(LOB).withColumn("us", epoch_us("ts"))

    @cached_property
    def flawed(self) -> DataFrame:
        """The raw book with level 1 missing on some days, for the rules on critical days."""
        return self.lob.withColumns({c: F.when(~F.expr(FLAWED), F.col(c)) for c in book_columns(1)})

    @cached_property
    def flawed1(self) -> DataFrame:
        """Last flawed snapshot per role and second."""
        return snap(self.flawed, ["role"], 1).withColumn("d", day_of("ep"))

    def stream_lob(self) -> DataFrame:
        """The book as a stream over the same files."""
        from tickloom.streaming.book import read_stream

        source = read_stream(self.spark, self.folder, "events.parquet", self.events.schema)
        return self.spark.sql(LOB, events=source).withColumn("us", epoch_us("ts"))

    @cached_property
    def lob_clean(self) -> DataFrame:
        return self.lob.where(CLEAN)

    @cached_property
    def book1(self) -> DataFrame:
        """Last raw snapshot per role and second."""
        return snap(self.lob, ["role"], 1).withColumn("d", day_of("ep"))

    @cached_property
    def quotes1(self) -> DataFrame:
        """Last clean snapshot per role and second."""
        return snap(self.lob_clean, ["role"], 1).withColumn("d", day_of("ep"))

    @cached_property
    def grid5(self) -> DataFrame:
        """Last clean level-1 quote per role and five-minute bin."""
        quotes = self.lob_clean.select("role", "us", "event_id", "l1_bid_price", "l1_ask_price", "l1_bid_size", "l1_ask_size")
        return snap(quotes, ["role"], MARKET_STEP).drop("us", "event_id").withColumn("d", day_of("ep"))

    @cached_property
    def book5(self) -> DataFrame:
        """Last clean snapshot, all levels, per role and five-minute bin."""
        return stage(snap(self.lob_clean, ["role"], MARKET_STEP).withColumn("d", day_of("ep")))

    @cached_property
    def terms(self) -> DataFrame:
        """Repo-rate terms per day."""
        from tickloom.plans.repo_rate import daily_terms

        return daily_terms(self.daily_cf, self.ctd_metadata, self.fut_metadata)

    @cached_property
    def market5(self) -> DataFrame:
        """Both roles side by side on the five-minute grid, with the day's factor and bond."""
        daily = self.daily_cf.select("d", "cf", "isin")
        return stage(snap_roles(self.lob_clean, MARKET_STEP).join(F.broadcast(daily), "d", "left"))

    @cached_property
    def market1(self) -> DataFrame:
        """Both roles second by second, as intervals [ep, until) of standing quotes, with the day's factor and bond."""
        from tickloom.operators.intervals import quote_intervals

        daily = self.daily_cf.select("d", "cf", "isin")
        return stage(quote_intervals(self.lob_clean).join(F.broadcast(daily), "d", "left"))

    @cached_property
    def basis5(self) -> DataFrame:
        """(d, ep, basis) on the five-minute grid, mid prices."""
        from tickloom.functions.cross import basis_column

        return self.market5.select("d", "ep", basis_column("mid").alias("basis"))

    @cached_property
    def daily_cf(self) -> DataFrame:
        return self._sql(DAILY_CF)

    @cached_property
    def ctd_metadata(self) -> DataFrame:
        return self.spark.sql(values_sql(CTD_BONDS, BOND_COLUMNS))

    @cached_property
    def fut_metadata(self) -> DataFrame:
        return self.spark.sql(values_sql(FUTURES, FUTURE_COLUMNS))

    @cached_property
    def excluded_raw(self) -> DataFrame:
        return self.spark.sql(values_sql(EXCLUDED, EXCLUDED_COLUMNS))

    @cached_property
    def proposals(self) -> DataFrame:
        raw = self._sql(PROPOSALS).withColumn("start_us", epoch_us("update_ts"))
        return raw.withColumn("end_us", F.col("start_us") + F.col("life_s") * 1_000_000)

    @cached_property
    def exec_records(self) -> DataFrame:
        return self._sql(EXEC_RECORDS).withColumn("us", epoch_us("ts")).drop("ts")

    @cached_property
    def predictions(self) -> DataFrame:
        return self._sql(PREDICTIONS)

    @cached_property
    def records(self) -> DataFrame:
        """Trading records: at most one decision per seed and second, one episode per calendar day."""
        e = F.col("event_id")
        steps = self.events.select(
            (F.col("user_id") % 3).alias("seed"), "event_id", epoch_us("ts").alias("us"),
            ((e * 7919 + F.col("user_id") * 104729) % 1000003).alias("h"))
        steps = snap(steps, ["seed"], 1).withColumn("d", day_of("ep")).withColumn("episode", F.unix_date("d").cast("long"))
        w = Window.partitionBy("seed", "episode").orderBy("ep")
        first = F.lag("ep").over(w).isNull()
        last = F.lead("ep").over(w).isNull()
        steps = steps.select("*", first.alias("is_first"), last.alias("terminal")).withColumn(
            "position", F.when(F.col("is_first") | F.col("terminal"), 0).otherwise(F.col("h") % 3 - 1).cast("long"))
        steps = steps.withColumn("allocation", F.coalesce(F.lag("position").over(w), F.lit(0)).cast("long"))
        gross = F.when(F.col("is_first"), 0.0).otherwise((F.col("h") % 201 - 100).cast("double"))
        cost = F.abs(F.col("position") - F.col("allocation")).cast("double") * 12.5
        return stage(steps.select(
            "seed", "episode", "ep", "d", "terminal", "allocation", "position", cost.alias("cost"),
            gross.alias("gross_reward"), (gross - cost).alias("reward"),
            ((1 + F.col("h") % 3).cast("double") * 200.0).alias("ctd_spread"), F.lit(1.0).alias("ctd_contracts"),
            ((1 + F.col("h") % 2).cast("double") * 10.0).alias("fut_spread"), F.lit(18.0).alias("fut_contracts"),
            (F.lit(100.0) + (F.col("h") % 17).cast("double") / 100.0).alias("ctd_mid"),
            (F.lit(110.0) + (F.col("h") % 13).cast("double") / 100.0).alias("fut_mid")))

"""Date sets, calendar filters and time-of-day filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.expr import US, col, div
from tickloom.schema import CONTRACTS, DATE_MARGINS


def expand_dates(dates: DataFrame, before: int | Column = 0, after: int | Column = 0) -> DataFrame:
    """Every day from d - before to d + after."""
    before, after = (F.lit(x) if isinstance(x, int) else x for x in (before, after))
    return dates.select(F.explode(F.sequence(F.date_sub("d", before), F.date_add("d", after))).alias("d")).distinct()


def excluded_dates(raw: DataFrame, kinds=tuple(DATE_MARGINS)) -> DataFrame:
    """Union of all special dates, each widened by its own margin (columns kind, d, days_before, days_after)."""
    return expand_dates(raw.where(F.col("kind").isin(*kinds)), F.col("days_before"), F.col("days_after"))


def switch_dates(daily: DataFrame) -> DataFrame:
    """Days on which the bond changes, the first day included: columns d, isin, cusip.

    A bond that comes back counts again.  Raises when ISIN and CUSIP do not change on the
    same days; that check runs at once, over one row per calendar day.
    """
    w = Window.orderBy("d")
    isin, cusip = (~F.col(c).eqNullSafe(F.lag(c).over(w)) for c in ("isin", "cusip"))
    changed = daily.select("d", "isin", "cusip", isin.alias("_i"), cusip.alias("_c"))
    wrong = changed.where("_i <> _c").orderBy("d").first()
    if wrong:
        raise ValueError(f"{wrong['d']}: ISIN and CUSIP do not change together")
    return changed.where("_i").drop("_i", "_c")


def drop_dates(df: DataFrame, dates: DataFrame) -> DataFrame:
    """Anti-join; a date list holds at most one row per calendar day, so it is broadcast."""
    return df.join(F.broadcast(dates.select("d").distinct()), "d", "left_anti")


def keep_dates(df: DataFrame, dates: DataFrame) -> DataFrame:
    return df.join(F.broadcast(dates.select("d").distinct()), "d", "left_semi")


def filter_time(df: DataFrame, opens: int, closes: int, lookback_s: int = 0) -> DataFrame:
    """Time of day in [opens - lookback, closes], exact to the microsecond."""
    us = F.pmod(F.col("us"), F.lit(86_400 * US)) if "us" in df.columns else F.pmod(F.col("ep"), F.lit(86_400)) * US
    return df.where(us.between((opens - lookback_s) * US, closes * US))


def in_market_hours(role="role") -> Column:
    """True inside the hours of the row's own market."""
    us = F.pmod(F.col("us"), F.lit(86_400 * US))
    out = F.lit(False)
    for name, c in CONTRACTS.items():
        out = out | ((col(role) == name) & us.between(c.opens * US, c.closes * US))
    return out


def event_distance(days: DataFrame, events: DataFrame, strict: bool = False) -> DataFrame:
    """Next (>= d, or > d when strict) and previous (<= d) event per day with signed day counts.

    Both sides hold at most one row per calendar day, so they are folded into one array.
    """
    packed = events.agg(F.sort_array(F.collect_set("d")).alias("_ev"))
    out = days.select("d").distinct().join(F.broadcast(packed))
    ahead = F.filter("_ev", lambda e: (e > F.col("d")) if strict else (e >= F.col("d")))
    behind = F.filter("_ev", lambda e: e <= F.col("d"))
    out = out.select("d", F.array_min(ahead).alias("next_event"), F.array_max(behind).alias("prev_event"))
    return out.select("*", F.datediff("next_event", "d").alias("days_to_next"), F.datediff("prev_event", "d").alias("days_to_prev"))


def event_between(pairs: DataFrame, events: DataFrame, entry: str, exit_: str, *, entry_inclusive: bool,
                  exit_inclusive: bool, name: str = "hit") -> DataFrame:
    """Flag rows whose [entry, exit] day range holds an event; each end open or closed."""
    packed = events.agg(F.sort_array(F.collect_set("d")).alias("_ev"))

    def inside(e):
        lo = e >= F.col(entry) if entry_inclusive else e > F.col(entry)
        hi = e <= F.col(exit_) if exit_inclusive else e < F.col(exit_)
        return lo & hi

    return pairs.join(F.broadcast(packed)).withColumn(name, F.exists("_ev", inside)).drop("_ev")


def date_ranks(df: DataFrame) -> DataFrame:
    """(d, i, n): position of every distinct day; one row per calendar day."""
    packed = df.agg(F.sort_array(F.collect_set("d")).alias("_ds"))
    return packed.select(F.size("_ds").alias("n"), F.posexplode("_ds").alias("i", "d"))


def split_by_date_share(df: DataFrame, p_train: float, p_val: float) -> DataFrame:
    """Column ``split``: whole days go to train, validation and test in time order."""
    ranks = date_ranks(df)
    a, b = F.floor(F.col("n") * F.lit(p_train)), F.floor(F.col("n") * F.lit(p_train + p_val))
    label = F.when(F.col("i") < a, "train").when(F.col("i") < b, "val").otherwise("test")
    return df.join(F.broadcast(ranks.select("d", label.alias("split"))), "d")


def time_folds(df: DataFrame, folds: int) -> DataFrame:
    """Expanding-window folds by day: row (fold k) is train before block k and validation in it."""
    ranks = date_ranks(df)
    block = F.floor(F.col("i") * F.lit(folds + 1) / F.col("n")).cast("int")
    ranks = ranks.select("d", block.alias("_b"), F.explode(F.sequence(F.lit(1), F.lit(folds))).alias("fold"))
    part = F.when(F.col("_b") < F.col("fold"), "train").when(F.col("_b") == F.col("fold"), "val")
    ranks = ranks.withColumn("part", part).where("part IS NOT NULL").drop("_b")
    return df.join(F.broadcast(ranks), "d")


def split_by_month(df: DataFrame, last_train_month: str) -> DataFrame:
    """Days up to the end of the month are train, later days test."""
    limit = F.add_months(F.lit(f"{last_train_month}-01").cast("date"), 1)
    return df.withColumn("split", F.when(F.col("d") < limit, "train").otherwise("test"))


def time_to_daily_event(ts: Column, market_zone: str, event_zone: str, event_time: str, unit_s: int = 3600,
                        absolute: bool = False) -> Column:
    """Units from ``ts`` (market wall clock) to the event's clock time on the same event-zone day, cut toward zero."""
    there = F.convert_timezone(F.lit(market_zone), F.lit(event_zone), ts)
    event = F.to_timestamp_ntz(F.concat(F.to_date(there).cast("string"), F.lit(f" {event_time}")))
    back = F.convert_timezone(F.lit(event_zone), F.lit(market_zone), event)
    from tickloom.functions.expr import epoch_us

    out = ((epoch_us(back) - epoch_us(ts)) / F.lit(float(unit_s * US))).cast("int")
    return F.abs(out) if absolute else out


def sampling_bounds(opens: int, closes: int, horizon: int, deltas=(), windows=(), lags=()) -> dict[str, tuple[int, int]]:
    """Seconds-of-day windows for sampling, features and target."""
    lookback = max([0, *deltas, *windows]) + max([0, *lags])
    if opens - lookback < 0:
        raise ValueError("lookback reaches the previous day")
    return {"sampling": (opens, closes - horizon), "features": (opens - lookback, closes - horizon), "target": (opens, closes)}


def benchmark_distance(benchmark, price, side, tick: float) -> Column:
    """Ticks saved against the benchmark: lower is better for a buyer, higher for a seller."""
    d = col(benchmark) - col(price)
    return div(F.when(col(side) == "bid", d).otherwise(-d), F.lit(tick))

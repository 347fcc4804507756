"""Second-by-second studies on quotes that stand, without a row per second.

A quote holds from its second until the next one of its role.  The market of both roles is a
list of intervals [ep, until); entering in one and leaving ``horizon`` seconds later in
another is one row per pair of intervals that overlap after the shift, with the seconds that
it stands for.  A day holds at most one interval per second and role, so day windows are
bounded; a quiet day is a few rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.expr import day_of, day_start
from tickloom.operators.grid import snap
from tickloom.operators.profit import CONFIGS, pair_pnl
from tickloom.schema import DAY_S, ROLES, SIDES, WINDOW_CLOSE, WINDOW_OPEN, market_keys

QUOTES = [f"{role}_{side}_{kind}" for role in ROLES for kind in ("price", "size") for side in SIDES]


def quote_intervals(quotes: DataFrame, opens: int = WINDOW_OPEN, closes: int = WINDOW_CLOSE) -> DataFrame:
    """(d, ep, until, level-1 quotes of both roles) from quotes (role, us, level 1): the last of a second counts.

    Quotes carry on within their day, from before the opening too; the last second is ``closes``.
    """
    keys = market_keys(quotes)
    level = quotes.select(*keys, "role", "us", *[f"l1_{s}_{k}" for s in SIDES for k in ("price", "size")])
    seconds = snap(level, [*keys, "role"], 1)
    own = F.struct(*[F.col(f"l1_{s}_{k}").alias(f"{s}_{k}") for k in ("price", "size") for s in SIDES])
    both = seconds.groupBy(*keys, "ep").agg(*[F.max(F.when(F.col("role") == r, own)).alias(r) for r in ROLES]).withColumn("d", day_of("ep"))
    day = Window.partitionBy(*keys, "d").orderBy("ep")
    held = both.select(*keys, "d", "ep", F.lead("ep").over(day).alias("next"), *[F.last(r, ignorenulls=True).over(day.rowsBetween(Window.unboundedPreceding, 0)).alias(r) for r in ROLES])
    start, end = day_start("d") + opens, day_start("d") + closes + 1
    held = held.where(" AND ".join(f"{r} IS NOT NULL" for r in ROLES)).withColumns({"ep": F.greatest("ep", start), "until": F.least(F.coalesce("next", end), end)})
    return held.where("ep < until").select(*keys, "d", "ep", "until", *[F.col(r)[f"{s}_{k}"].alias(f"{r}_{s}_{k}") for r in ROLES for k in ("price", "size") for s in SIDES])


def horizon_pieces(intervals: DataFrame, horizons, names: list[str]) -> DataFrame:
    """Entries paired with the market ``horizon`` seconds later: horizon, d, ep, until, seconds, exit_ep, ``names`` now and x_names then (NULL where there is no market).

    Both are cut at every start and end of either, in one window per horizon and day of entry.
    """
    keys = market_keys(intervals)
    state = F.struct("until", *names)
    each = F.explode(F.array(*[F.lit(int(h)).cast("long") for h in horizons]))
    rows = intervals.select(*keys, "ep", "until", *names).withColumn("horizon", each)
    none = F.lit(None).cast(rows.select(state.alias("s")).schema["s"].dataType)
    entry = rows.select(*keys, "horizon", F.col("ep").alias("t"), state.alias("e"), none.alias("x"))
    # An exit interval, shifted back, may cross midnight; it counts on both days of entry.
    back = rows.withColumns({"ep": F.col("ep") - F.col("horizon"), "until": F.col("until") - F.col("horizon")})
    back = back.withColumn("day", F.explode(F.sequence(F.floor(F.col("ep") / DAY_S), F.floor((F.col("until") - 1) / DAY_S))))
    back = back.withColumns({"ep": F.greatest("ep", F.col("day") * DAY_S), "until": F.least("until", (F.col("day") + 1) * DAY_S)}).drop("day")
    start = back.select(*keys, "horizon", F.col("ep").alias("t"), none.alias("e"), state.alias("x"))
    stop = back.where(F.pmod("until", F.lit(DAY_S)) != 0).select(*keys, "horizon", F.col("until").alias("t"), none.alias("e"), none.alias("x"))
    marks = entry.unionByName(start).unionByName(stop).withColumn("d", day_of("t"))
    day = Window.partitionBy(*keys, "horizon", "d").orderBy("t")
    so_far = day.rowsBetween(Window.unboundedPreceding, 0)
    cut = marks.select(*keys, "horizon", "d", "t", F.lead("t").over(day).alias("next"), F.last("e", ignorenulls=True).over(so_far).alias("e"), F.last("x", ignorenulls=True).over(so_far).alias("x"))
    cut = cut.where("e IS NOT NULL").withColumn("until", F.least(F.coalesce("next", "e.until"), "e.until")).where("t < until")
    there = F.col("x.until") > F.col("t")
    return cut.select(*keys, "horizon", "d", F.col("t").alias("ep"), "until", (F.col("until") - F.col("t")).alias("seconds"), (F.col("t") + F.col("horizon")).alias("exit_ep"),
                      *[F.col("e")[n].alias(n) for n in names], *[F.when(there, F.col("x")[n]).alias(f"x_{n}") for n in names])


def fixed_horizon_seconds(intervals: DataFrame, horizons, configs=CONFIGS, n_bonds: float = 1.0, exit_side: str = "entry") -> DataFrame:
    """PnL of entering at every second and leaving after each horizon, long and short; a row stands for ``seconds`` seconds from ep.

    ``intervals`` has the quotes and the day's conversion factor ``cf``.
    """
    pieces = horizon_pieces(intervals, horizons, [*QUOTES, "cf"])
    return pair_pnl(pieces, [*market_keys(intervals), "horizon", "d", "ep", "until", "seconds", "exit_ep"], configs, n_bonds, exit_side)

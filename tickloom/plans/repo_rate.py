"""Coupon schedules, accrued interest and the implied repo rate.

Everything that depends on the day and the bond is computed once per (day, bond) and
broadcast: the table has one row per calendar day, bonds a few dozen coupons.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.cross import irr_column, leg_prices
from tickloom.functions.expr import div

NOTIONAL = 100.0


def with_schedule(bonds: DataFrame) -> DataFrame:
    """Array of coupon dates from the first coupon to maturity every 12 / frequency months."""
    step = F.make_ym_interval(F.lit(0), (F.lit(12) / F.col("coupon_freq")).cast("int"))
    return bonds.withColumn("schedule", F.sequence("first_coupon", "maturity", step))


def coupon_schedule(bonds: DataFrame) -> DataFrame:
    return with_schedule(bonds).select("isin", F.explode("schedule").alias("coupon_date"))


def require_regular(bonds: DataFrame) -> None:
    """Raise for a frequency that does not divide 12 or a first coupon after maturity."""
    bad = bonds.where((F.col("coupon_freq") <= 0) | (F.lit(12) % F.col("coupon_freq") != 0) | (F.col("first_coupon") > F.col("maturity"))).first()
    if bad:
        raise ValueError(f"irregular coupon terms for {bad['isin']}")


def accrued(day: Column) -> Column:
    """Accrued interest on a day; a coupon on the day itself is the previous one, outside the schedule it is 0."""
    prev = F.array_max(F.filter("schedule", lambda c: c <= day))
    nxt = F.array_min(F.filter("schedule", lambda c: c > day))
    part = div(F.datediff(day, prev), F.datediff(nxt, prev))
    return F.coalesce(F.lit(NOTIONAL) * F.col("coupon_rate") / F.col("coupon_freq") * part, F.lit(0.0))


def delivery_after(days: DataFrame, futures: DataFrame) -> DataFrame:
    """First delivery date strictly after each day."""
    packed = futures.agg(F.sort_array(F.collect_set("delivery")).alias("_dl"))
    return days.join(F.broadcast(packed)).withColumn("delivery", F.array_min(F.filter("_dl", lambda x: x > F.col("d")))).drop("_dl")


def daily_terms(daily: DataFrame, bonds: DataFrame, futures: DataFrame) -> DataFrame:
    """Per day: cf, delivery, years to delivery, coupons until then, accrued interest at both ends."""
    df = delivery_after(daily, futures).join(F.broadcast(with_schedule(bonds)), "isin")
    amount = F.lit(NOTIONAL) * F.col("coupon_rate") / F.col("coupon_freq")
    due = F.filter("schedule", lambda c: (c > F.col("d")) & (c <= F.col("delivery")))
    weighted = F.aggregate(due, F.lit(0.0), lambda s, c: s + amount * F.datediff(F.col("delivery"), c) / 360.0)
    return df.select("d", "isin", "cf", "delivery", (F.datediff("delivery", "d") / 360.0).alias("years"), (amount * F.size(due)).alias("coupons"),
                     weighted.alias("weighted_coupons"), accrued(F.col("d")).alias("ai_now"), accrued(F.col("delivery")).alias("ai_delivery"))


def irr(market: DataFrame, terms: DataFrame, modes=("mid", "long", "short")) -> DataFrame:
    """Implied repo rate per row: mid, long (buy bond, sell future) and short."""
    df = market.drop("cf", "isin").join(F.broadcast(terms), "d")
    side = {"mid": "mid", "long": "ask", "short": "bid"}
    return df.withColumns({f"irr_{m}": irr_column(*leg_prices(side[m])) for m in modes})

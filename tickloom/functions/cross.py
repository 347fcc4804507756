"""Cross-asset formulas: basis, contracts, conversion factors, repo rate."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tickloom.functions.expr import col, div
from tickloom.schema import BOND, LONG_FUTURE


def mid(role: str) -> Column:
    return (F.col(f"{role}_ask_price") + F.col(f"{role}_bid_price")) / 2


def leg_prices(mode: str) -> tuple[Column, Column]:
    """(bond, future) prices: mid/mid, ask/bid for ``ask`` and bid/ask for ``bid``."""
    if mode == "mid":
        return mid("ctd"), mid("fut")
    if mode == "ask":
        return F.col("ctd_ask_price"), F.col("fut_bid_price")
    if mode == "bid":
        return F.col("ctd_bid_price"), F.col("fut_ask_price")
    raise ValueError(f"unknown price mode {mode!r}")


def basis_column(mode: str = "mid") -> Column:
    """Bond price minus conversion factor times futures price."""
    bond, future = leg_prices(mode)
    return bond - F.col("cf") * future


def fractional_contracts(cf, n_bonds) -> Column:
    """Futures that hedge ``n_bonds`` bonds."""
    return col(cf) * F.lit(float(n_bonds)) * F.lit(BOND.face / LONG_FUTURE.face)


def rounded_contracts(cf, n_bonds) -> Column:
    """Half-even whole number of futures."""
    return F.rint(fractional_contracts(cf, n_bonds)).cast("long")


def effective_cf(n_futures, n_bonds) -> Column:
    """Factor implied by a whole number of contracts."""
    return div(col(n_futures) * F.lit(LONG_FUTURE.face), col(n_bonds) * F.lit(BOND.face))


def irr_column(bond: Column, future: Column) -> Column:
    """Implied repo rate from the day's terms (see ``irr_daily_terms``)."""
    dirty = bond + F.col("ai_now")
    invoice = future * F.col("cf") + F.col("ai_delivery")
    return div(invoice - (dirty - F.col("coupons")), dirty * F.col("years") - F.col("weighted_coupons"))

"""Microstructure formulas over the wide book; ``w`` is the window of one series and day."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tickloom.functions.expr import div, row_sum
from tickloom.schema import book_column


def price(level: int, side: str) -> Column:
    return F.col(book_column(level, side, "price"))


def size(level: int, side: str) -> Column:
    return F.col(book_column(level, side, "size"))


def mid_price() -> Column:
    return (price(1, "ask") + price(1, "bid")) / 2


def spread() -> Column:
    return price(1, "ask") - price(1, "bid")


def micro_price() -> Column:
    b, a = size(1, "bid"), size(1, "ask")
    return div(price(1, "ask") * b + price(1, "bid") * a, b + a)


def imbalance(levels: int, ratio: bool = False) -> Column:
    """Bid minus ask size over the first levels, optionally relative to their sum."""
    n = range(1, levels + 1)
    bids, asks = row_sum(size(i, "bid") for i in n), row_sum(size(i, "ask") for i in n)
    return div(bids - asks, bids + asks) if ratio else bids - asks


def flow(side: str, level: int, w) -> Column:
    """Order flow of one side against the previous row of the day.

    Better price: the new size (bid) or minus the old size (ask); equal price: size change;
    worse price: minus the old size (bid) or the new size (ask).
    """
    p, s = price(level, side), size(level, side)
    p0, s0 = F.lag(p).over(w), F.lag(s).over(w)
    up, down = (s, -s0) if side == "bid" else (-s0, s)
    return F.when(p > p0, up).when(p == p0, s - s0).when(p < p0, down)


def flow_imbalance(level: int, w) -> Column:
    return flow("bid", level, w) + flow("ask", level, w)


def slope_relative(levels: int, side: str) -> Column:
    """Size change over relative price change, averaged over levels."""
    first = div(size(1, side), F.nullif(F.abs(div(price(1, side), mid_price()) - 1), F.lit(0.0)))
    if levels == 1:
        return first
    rest = []
    for i in range(2, levels + 1):
        grow = div(size(i, side), size(i - 1, side)) - 1
        move = F.abs(div(price(i, side), price(i - 1, side)) - 1)
        rest.append(div(grow, move))
    return (first + row_sum(rest)) / levels


def slope_depth(levels: int, side: str) -> Column:
    """Cumulated size over the distance of the last level from the mid."""
    total = row_sum(size(i, side) for i in range(1, levels + 1))
    return div(total, F.abs(price(levels, side) - mid_price()))

"""Streaming twin of the grid snapshot."""

from registry.base import query
from tickloom.sources.derived import CLEAN
from tickloom.streaming import book as B


@query("stream_resample", "role:s ep:i l1_bid_price:f l1_ask_price:f", "SELECT role, ep, l1_bid_price, l1_ask_price FROM grid5")
def _(t):
    quotes = t.stream_lob().where(CLEAN).select("role", "us", "l1_bid_price", "l1_ask_price")
    return B.latest(B.run_to_table(B.stream_snap(quotes, ["role"], 300, delay="31 days"), "update"), ["role", "ep"])

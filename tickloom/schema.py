"""Data model: contracts, book columns and fixed settings.

A book row is keyed by (role, session day, second).  ``ep`` is the wall-clock second
since 1970-01-01 and ``us`` the wall-clock microsecond; both are plain integers, so
no session time zone can shift them.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

DAY_S = 86_400
ROLES = ("ctd", "fut")
SIDES = ("bid", "ask")
KINDS = ("price", "size")


@dataclass(frozen=True)
class Contract:
    """Quotation rules and market hours (seconds of day) of one instrument."""

    par: float
    face: float
    price_tick: float
    size_tick: float
    opens: int
    closes: int

    @property
    def scale(self) -> float:
        """Money per price point of one contract."""
        return self.face / self.par


# Contract terms.
BOND = Contract(100.0, 2_000_000.0, 0.01, 0.5, 8 * 3600, 17 * 3600 + 1800)
LONG_FUTURE = Contract(100.0, 100_000.0, 0.01, 1.0, 8 * 3600, 19 * 3600)
SHORT_FUTURE = Contract(100.0, 100_000.0, 0.005, 1.0, 8 * 3600, 19 * 3600)
CONTRACTS = {"ctd": BOND, "fut": LONG_FUTURE}

# The contract of each role by future; tables without a ticker are about the first.
TICKERS = ("fbtp", "fbts")
TICKER_CONTRACTS = {("fbtp", "ctd"): BOND, ("fbtp", "fut"): LONG_FUTURE, ("fbts", "ctd"): BOND, ("fbts", "fut"): SHORT_FUTURE}

# Time zone of both markets.
MARKET_ZONE = "Europe/Berlin"

# Analysis window, both ends inclusive.
WINDOW_OPEN = 9 * 3600
WINDOW_CLOSE = 17 * 3600

# Fixed values: (days before, days after) dropped around each kind of special date.
DATE_MARGINS = {"Critical": (0, 0), "Rollover": (2, 0), "Extra": (0, 0)}


def book_column(level: int, side: str, kind: str) -> str:
    return f"l{level}_{side}_{kind}"


def book_columns(levels=3, sides=SIDES, kinds=KINDS) -> list[str]:
    """Canonical column order: level, then side, then price before size."""
    if isinstance(levels, int):
        levels = range(1, levels + 1)
    return [book_column(lv, sd, kd) for lv, sd, kd in product(levels, sides, kinds)]


def book_levels(df) -> int:
    """Number of levels of a book table, from its columns."""
    found = [int(m[1]) for c in df.columns if (m := re.fullmatch(r"l(\d+)_(?:bid|ask)_(?:price|size)", c))]
    if not found:
        raise ValueError("the table has no book column")
    return max(found)


def market_keys(df) -> list[str]:
    """The key of a market beside time: its ticker, where the table has one."""
    return ["ticker"] if "ticker" in df.columns else []


def require_columns(df, names) -> None:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")

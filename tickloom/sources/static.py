"""Small literal reference tables used with the sample data."""

import datetime as dt

# Sample bond, futures and special-date tables.
CTD_BONDS = [
    ("IT0001", 0.04, 2, dt.date(2019, 2, 10), dt.date(2029, 8, 10)),
    ("IT0002", 0.035, 2, dt.date(2019, 1, 20), dt.date(2030, 7, 20)),
    ("IT0003", 0.05, 1, dt.date(2020, 1, 25), dt.date(2031, 1, 25)),
]
FUTURES = [
    (dt.date(2024, 1, 9), dt.date(2024, 1, 11)),
    (dt.date(2024, 1, 19), dt.date(2024, 1, 22)),
    (dt.date(2024, 3, 6), dt.date(2024, 3, 8)),
]
EXCLUDED = [
    ("Critical", dt.date(2024, 1, 5), 0, 0),
    ("Critical", dt.date(2024, 1, 17), 0, 0),
    ("Rollover", dt.date(2024, 1, 9), 2, 0),
    ("Rollover", dt.date(2024, 1, 19), 2, 0),
    ("Extra", dt.date(2024, 1, 24), 0, 0),
]


def values_sql(rows, names: str) -> str:
    """Literal rows as a SQL query."""
    def lit(v):
        if hasattr(v, "isoformat"):
            return f"DATE '{v}'"
        return f"'{v}'" if isinstance(v, str) else (f"CAST({v} AS DOUBLE)" if isinstance(v, float) else str(v))

    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {body}) AS t({names})"


BOND_COLUMNS = "isin, coupon_rate, coupon_freq, first_coupon, maturity"
FUTURE_COLUMNS = "last_trading, delivery"
EXCLUDED_COLUMNS = "kind, d, days_before, days_after"

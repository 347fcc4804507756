"""Column helpers shared by every operator."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

US = 1_000_000


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def null_nan(c) -> Column:
    """Turn NaN into NULL; done once, at the scan."""
    c = col(c)
    return F.when(~F.isnan(c), c)


def div(a, b) -> Column:
    """Division that gives NULL for a zero divisor."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def micros_of_day(ts) -> Column:
    """Exact microsecond of the wall-clock day of a TIMESTAMP_NTZ."""
    ts = col(ts)
    whole = F.hour(ts) * 3600 + F.minute(ts) * 60
    return whole.cast("long") * US + (F.date_part(F.lit("SECOND"), ts) * US).cast("long")


def epoch_us(ts) -> Column:
    """Wall-clock microseconds since 1970-01-01, independent of the session zone."""
    day = F.unix_date(F.to_date(col(ts))).cast("long")
    return day * (86_400 * US) + micros_of_day(ts)


def day_of(ep) -> Column:
    """Calendar day of an epoch second."""
    return F.date_from_unix_date(F.floor(col(ep) / 86_400).cast("int"))


def sod(ep) -> Column:
    """Second of day of an epoch second."""
    return F.pmod(col(ep), F.lit(86_400))


def day_start(d) -> Column:
    """Epoch second of midnight of a date."""
    return F.unix_date(col(d)).cast("long") * 86_400


def close_to(a, b) -> Column:
    """|a - b| <= 1e-8 + 1e-5 * |b|."""
    return F.abs(col(a) - col(b)) <= F.lit(1e-8) + F.lit(1e-5) * F.abs(col(b))


def row_sum(cols) -> Column:
    """Sum over columns with NULL counted as zero."""
    out = F.lit(0.0)
    for c in cols:
        out = out + F.coalesce(col(c), F.lit(0.0))
    return out


def all_of(conds) -> Column:
    out = F.lit(True)
    for c in conds:
        out = out & c
    return out


def any_of(conds) -> Column:
    out = F.lit(False)
    for c in conds:
        out = out | c
    return out


def normal_cdf(x) -> Column:
    """Normal distribution function by the published rational erf approximation."""
    x = col(x)
    # Coefficients of the erf approximation.
    p = 0.3275911
    a = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
    z = F.abs(x) / F.lit(2.0 ** 0.5)
    t = F.lit(1.0) / (F.lit(1.0) + p * z)
    poly = F.lit(0.0)
    for k in reversed(a):
        poly = (poly + k) * t
    upper = F.lit(0.5) * poly * F.exp(-z * z)
    return F.when(x >= 0, 1.0 - upper).otherwise(upper)

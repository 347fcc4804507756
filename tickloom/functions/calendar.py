"""Calendar features of an epoch second ``ep`` and its day ``d``."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tickloom.functions.expr import sod



def calendar() -> dict[str, Column]:
    s, d = sod("ep"), F.col("d")
    return {
        "year": F.year(d), "month": F.month(d), "week_of_year": F.weekofyear(d), "day_of_year": F.dayofyear(d),
        "day_of_month": F.dayofmonth(d), "day_of_week": F.weekday(d) + 1, "hour_of_day": F.floor(s / 3600),
        "minute_of_day": F.floor(s / 60), "minute_of_hour": F.floor(s / 60) % 60, "second_of_day": s,
        "second_of_hour": s % 3600, "second_of_minute": s % 60}


# Periods of the cyclic features.
PERIODS = {"hour_of_day": 24, "minute_of_day": 1440, "minute_of_hour": 60, "second_of_day": 86_400, "second_of_hour": 3600, "second_of_minute": 60}


def cyclic(names=tuple(PERIODS)) -> dict[str, Column]:
    """Sine and cosine of each feature over its period."""
    plain = calendar()
    out = {}
    for n in names:
        angle = plain[n] * F.lit(2 * math.pi / PERIODS[n])
        out[f"{n}_sin"], out[f"{n}_cos"] = F.sin(angle), F.cos(angle)
    return out

"""Feature language: names such as ``basis_delta_60s_lag_300s`` compiled to window columns.

A name is a base id, an optional transform and an optional lag.  All transforms of a
table share one window per day; lags of transforms need a second projection over the
same window, so the rows are shuffled and sorted once.  Numbers count rows, which are
seconds on a full one-second grid.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.calendar import PERIODS, calendar, cyclic
from tickloom.functions.expr import div, sod
from tickloom.plans.catalog import base_ids

STATS = ("mean", "std", "min", "max")
REFERENCES = ("day", "hour")
CALENDAR_NAMES = ("year", "month", "week_of_year", "day_of_year", "day_of_month", "day_of_week", "hour_of_day", "minute_of_day",
                  "minute_of_hour", "second_of_day", "second_of_hour", "second_of_minute")
GRAMMAR = re.compile(r"(?:_delta_(?P<delta>\d+)s|_roll_(?P<stat>[a-z]+)_(?P<window>\d+)s|_(?P<ref>[a-z]+)_ratio)?(?:_lag_(?P<lag>\d+)s)?")


@dataclass(frozen=True)
class Feature:
    """One parsed feature name."""

    base: str
    kind: str = "identity"
    stat: str = ""
    size: int = 0
    lag: int = 0

    @property
    def stem(self) -> str:
        """Name without the lag."""
        if self.kind == "delta":
            return f"{self.base}_delta_{self.size}s"
        if self.kind == "roll":
            return f"{self.base}_roll_{self.stat}_{self.size}s"
        return f"{self.base}_{self.stat}_ratio" if self.kind == "ratio" else self.base

    @property
    def name(self) -> str:
        return f"{self.stem}_lag_{self.lag}s" if self.lag else self.stem

    @property
    def lookback(self) -> int:
        return self.size + self.lag


@dataclass(frozen=True)
class Spec:
    """Several transforms of one base: row lags, differences, rolling statistics and ratios, each with optional lags."""

    base: str
    identity: bool = True
    deltas: tuple[int, ...] = ()
    rolls: tuple[tuple[str, int], ...] = ()
    ratios: tuple[str, ...] = ()
    lags: tuple[int, ...] = ()
    keep_original: bool = True
    extra: tuple[Feature, ...] = field(default=())

    def features(self) -> list[Feature]:
        _positive(self.deltas, "deltas"), _positive(self.lags, "lags"), _positive([w for _, w in self.rolls], "windows", unique=False)
        if not self.keep_original and not self.lags:
            raise ValueError("nothing to compute: no original and no lags")
        stems = [Feature(self.base)] if self.identity else []
        stems += [Feature(self.base, "delta", size=n) for n in sorted(self.deltas)]
        stems += [Feature(self.base, "roll", s, w) for s, w in self.rolls]
        stems += [Feature(self.base, "ratio", r) for r in self.ratios]
        out = []
        for f in stems:
            out += [f] if self.keep_original else []
            out += [Feature(f.base, f.kind, f.stat, f.size, n) for n in sorted(self.lags)]
        return check_unique([*out, *self.extra])


def _positive(values, what: str, unique: bool = True) -> None:
    if any(type(v) is not int or v <= 0 for v in values) or (unique and len(set(values)) != len(tuple(values))):
        raise ValueError(f"{what} must be distinct positive integers")


def check_unique(features: list[Feature]) -> list[Feature]:
    names = [f.name for f in features]
    twice = sorted({n for n in names if names.count(n) > 1})
    if twice:
        raise ValueError(f"duplicate features: {', '.join(twice)}")
    return features


def parse(name: str, bases=None) -> Feature:
    """Parse one market feature name; the longest base id wins and the name must round-trip."""
    bases = base_ids() if bases is None else bases
    fits = [b for b in bases if name == b or name.startswith(b + "_")]
    if not fits:
        raise ValueError(f"no base feature in {name!r}")
    base = max(fits, key=len)
    m = GRAMMAR.fullmatch(name[len(base):])
    if not m:
        raise ValueError(f"unknown transform in {name!r}")
    g = m.groupdict()
    lag = int(g["lag"] or 0)
    if g["delta"]:
        out = Feature(base, "delta", size=int(g["delta"]), lag=lag)
    elif g["stat"]:
        if g["stat"] not in STATS:
            raise ValueError(f"unknown statistic in {name!r}")
        out = Feature(base, "roll", g["stat"], int(g["window"]), lag)
    elif g["ref"]:
        if g["ref"] not in REFERENCES:
            raise ValueError(f"unknown reference in {name!r}")
        out = Feature(base, "ratio", g["ref"], lag=lag)
    else:
        out = Feature(base, lag=lag)
    if out.name != name or (out.kind in ("delta", "roll") and out.size == 0) or (g["lag"] and lag == 0):
        raise ValueError(f"{name!r} does not round-trip")
    return out


def split_names(names: list[str]) -> tuple[list[str], list[str], list[str]]:
    """(market, calendar, cyclic calendar) names."""
    encoded = {f"{p}_{t}" for p in PERIODS for t in ("sin", "cos")}
    cal = [n for n in names if n in CALENDAR_NAMES]
    enc = [n for n in names if n in encoded]
    return [n for n in names if n not in CALENDAR_NAMES and n not in encoded], cal, enc


def lookback(features: list[Feature]) -> int:
    """Rows to read before the first wanted row: longest transform plus longest lag."""
    return max([f.size for f in features], default=0) + max([f.lag for f in features], default=0)


def delta(c: str, n: int, w) -> Column:
    return F.col(c) - F.lag(c, n).over(w)


def rolling(c: str, stat: str, rows: int, w) -> Column:
    """Statistic of the last ``rows`` rows, given where at least half of them are non-null."""
    span = w.rowsBetween(1 - rows, 0)
    agg = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}[stat](c)
    enough = max(rows // 2, 2 if stat == "std" else 1)
    return F.when(F.count(c).over(span) >= enough, agg.over(span))


def rolling_time(c: str, stat: str, seconds: int, w) -> Column:
    """Statistic over the time span (t - seconds, t]."""
    span = w.rangeBetween(1 - seconds, 0)
    return {"mean": F.avg, "std": F.stddev_samp}[stat](c).over(span)


def ratio(c: str, keys: list[str], order: str = "ep", lone_is_one: bool = True) -> Column:
    """Value over the first non-null non-zero value of its group; a lone null or zero row counts as reference 1."""
    whole = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ref = F.first(F.when(F.col(c) != 0, F.col(c)), ignorenulls=True).over(whole)
    if lone_is_one:
        ref = F.coalesce(ref, F.when(F.count(F.lit(1)).over(whole) == 1, F.lit(1.0)))
    return div(c, ref)


def ratio_violations(df: DataFrame, c: str, keys: list[str]) -> DataFrame:
    """Groups of more than one row that hold no usable reference value."""
    g = df.groupBy(*keys).agg(F.count("*").alias("rows"), F.count_if(F.coalesce(F.col(c) != 0, F.lit(False))).alias("usable"))
    return g.where("rows > 1 AND usable = 0")


def compile_features(df: DataFrame, names: list[str], series=(), bases=None) -> DataFrame:
    """Add the named features to a table with columns d, ep and the base ids it has.

    ``series`` are key columns besides the day.
    """
    market, cal, enc = split_names(names)
    features = check_unique([parse(n, bases) for n in market])
    keys = [*series, "d"]
    w = Window.partitionBy(*keys).orderBy("ep")
    df = df.withColumn("_hour", F.floor(sod("ep") / 3600))
    stems: dict[str, Column] = {}
    for f in features:
        if f.kind == "delta":
            stems[f.stem] = delta(f.base, f.size, w)
        elif f.kind == "roll":
            stems[f.stem] = rolling(f.base, f.stat, f.size, w)
        elif f.kind == "ratio":
            stems[f.stem] = ratio(f.base, keys if f.stat == "day" else [*keys, "_hour"])
    if stems:
        df = df.withColumns(stems)
    lags = {f.name: F.lag(f.stem, f.lag).over(w) for f in features if f.lag}
    if lags:
        df = df.withColumns(lags)
    times = {n: c for n, c in {**calendar(), **cyclic()}.items() if n in (*cal, *enc)}
    if times:
        df = df.withColumns(times)
    return df.select(*series, "d", "ep", *names)


def ffill(df: DataFrame, columns: list[str], series: list[str]) -> DataFrame:
    """Forward fill across days: inside the day by window, over the day edge by one carried row per day."""
    inside = Window.partitionBy(*series, "d").orderBy("ep").rowsBetween(Window.unboundedPreceding, 0)
    ends = df.groupBy(*series, "d").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("ep"))).alias(f"_e_{c}") for c in columns])
    before = Window.partitionBy(*series).orderBy("d").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(*series, "d", *[F.last(f"_e_{c}", ignorenulls=True).over(before).alias(f"_c_{c}") for c in columns])
    out = df.join(carry, [*series, "d"])
    out = out.withColumns({c: F.coalesce(F.last(c, ignorenulls=True).over(inside), F.col(f"_c_{c}")) for c in columns})
    return out.drop(*[f"_c_{c}" for c in columns])


def target_shift(df: DataFrame, value: str, rows: int, series=(), change: int | None = None) -> DataFrame:
    """Value (or its difference over ``change`` rows) ``rows`` later inside the day as column ``target``; nulls dropped."""
    w = Window.partitionBy(*series, "d").orderBy("ep")
    base = value
    if change:
        df, base = df.withColumn("_z", delta(value, change, w)), "_z"
    return df.withColumn("target", F.lead(base, rows).over(w)).where("target IS NOT NULL").drop("_z")


# Named feature sets.
FEATURE_SETS: dict[str, tuple[str, ...]] = {
    "dummy": ("basis",),
    "baseline": (
        "basis", "basis_lag_60s", "basis_lag_300s", "basis_delta_60s", "basis_delta_60s_lag_60s", "basis_delta_60s_lag_300s",
        "ctd_mid_price", "ctd_mid_price_delta_60s", "ctd_mid_price_delta_60s_lag_60s", "ctd_mid_price_delta_60s_lag_300s",
        "fut_mid_price", "fut_mid_price_delta_60s", "fut_mid_price_delta_60s_lag_60s", "fut_mid_price_delta_60s_lag_300s",
        "ctd_obi_1", "fut_obi_1", "ctd_bof_1", "fut_bof_1", "ctd_aof_1", "fut_aof_1"),
    "execution": (
        "ctd_mid_price_lag_60s", "ctd_mid_price_lag_300s", "ctd_mid_price_delta_60s", "ctd_mid_price_delta_60s_lag_60s",
        "ctd_mid_price_delta_60s_lag_300s", "ctd_obi_1", "ctd_bof_1", "ctd_aof_1"),
    "xgb_cls": (
        "basis", "basis_delta_60s", "basis_delta_60s_lag_60s", "basis_roll_std_300s", "basis_roll_std_1800s", "basis_roll_mean_1800s",
        "basis_hour_ratio", "basis_day_ratio", "irr", "irr_roll_mean_300s", "irr_roll_mean_1800s", "irr_hour_ratio", "irr_day_ratio",
        "ctd_obi_1", "ctd_spread"),
    "xgb_reg": (
        "basis", "basis_delta_60s", "basis_roll_min_300s", "basis_roll_min_1800s", "basis_hour_ratio", "basis_day_ratio",
        "irr", "irr_hour_ratio", "irr_day_ratio", "ctd_spread", "ctd_spread_hour_ratio", "ctd_spread_day_ratio",
        "ctd_obi_1", "ctd_obi_3", "ctd_ofi_3"),
    "xgb_reg_it": (
        "basis_delta_60s", "basis_delta_60s_lag_840s", "basis_roll_min_300s", "basis_roll_min_1800s", "irr_hour_ratio", "irr_day_ratio",
        "ctd_spread_day_ratio", "fut_ofi_1", "fut_ofi_1_hour_ratio", "fut_ofi_2", "fut_ofi_2_hour_ratio", "fut_ofi_2_day_ratio",
        "fut_ofi_3", "fut_ofi_3_hour_ratio", "fut_ofi_3_day_ratio"),
}
# Named calendar sets (plain and cyclic).
CALENDAR_SETS: dict[str, tuple[str, ...]] = {"dummy": (), "default": ()}
CYCLIC_SETS: dict[str, tuple[str, ...]] = {"dummy": (), "default": ("hour_of_day", "minute_of_hour", "second_of_minute")}


def feature_set(name: str, calendar_name: str = "dummy", cyclic_name: str = "dummy") -> list[str]:
    """Names of a market set followed by its calendar columns."""
    for given, known in ((name, FEATURE_SETS), (calendar_name, CALENDAR_SETS), (cyclic_name, CYCLIC_SETS)):
        if given not in known:
            raise ValueError(f"unknown feature set {given!r}")
    enc = [f"{n}_{t}" for n in CYCLIC_SETS[cyclic_name] for t in ("sin", "cos")]
    return [*FEATURE_SETS[name], *CALENDAR_SETS[calendar_name], *enc]

"""Model-ready datasets: features, calendar, prices and contracts in one wide table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.cross import rounded_contracts
from tickloom.operators import dates as D
from tickloom.plans import features as X
from tickloom.plans.catalog import base_ids, market_features
from tickloom.sources.sinks import stage


def bases_of(names: list[str]) -> list[str]:
    """Base ids the named features need."""
    market, _, _ = X.split_names(names)
    ids = base_ids()
    return list(dict.fromkeys(X.parse(n, ids).base for n in market))


def feature_table(book: DataFrame, terms: DataFrame, names: list[str], opens: int, closes: int, step_s: int = 1) -> DataFrame:
    """Named features inside [opens, closes].

    Rows before the window that the lookback needs are read and dropped after the
    transforms; a filter above a window cannot be pushed below it, so the early cut is
    made here.
    """
    market, _, _ = X.split_names(names)
    back = X.lookback([X.parse(n) for n in market]) * step_s
    early = D.filter_time(book.drop("us"), max(opens - back, 0), closes)
    wide = market_features(early, terms, bases_of(names))
    return D.filter_time(X.compile_features(wide, names), opens, closes)


def build_dataset(book: DataFrame, terms: DataFrame, names: list[str], opens: int, closes: int, step_s: int = 1, n_bonds: float = 1.0) -> DataFrame:
    """Forward-filled features plus mid, spread, bid, ask and contracts of both legs.

    Bid and ask are rebuilt from the filled mid and spread.
    """
    base = ["ctd_mid_price", "ctd_spread", "fut_mid_price", "fut_spread"]
    extra = [b for b in base if b not in names]
    df = stage(feature_table(book, terms, [*names, *extra], opens, closes, step_s))
    df = X.ffill(df, [c for c in df.columns if c not in ("d", "ep")], [])
    df = df.join(F.broadcast(terms.select("d", "cf")), "d")
    out = {"ctd_contracts": F.lit(n_bonds), "fut_contracts": rounded_contracts("cf", n_bonds)}
    for role in ("ctd", "fut"):
        half = F.col(f"{role}_spread") / 2
        out |= {f"{role}_bid": F.col(f"{role}_mid_price") - half, f"{role}_ask": F.col(f"{role}_mid_price") + half}
    return df.withColumns(out).drop("cf")


def temporal_features(df: DataFrame, events: dict[str, DataFrame]) -> DataFrame:
    """Calendar, cyclic and day-distance columns of (d, ep) rows, one projection after tiny day joins."""
    from tickloom.functions.calendar import calendar, cyclic

    for name, dates in events.items():
        dist = D.event_distance(df, dates).select("d", F.col("days_to_next").alias(f"days_to_next_{name}"), F.col("days_to_prev").alias(f"days_to_prev_{name}"))
        df = df.join(F.broadcast(dist), "d", "left")
    return df.withColumns({**calendar(), **cyclic()})


def sampled_dataset(features: DataFrame, target: DataFrame, sampled: DataFrame, p_train: float, p_val: float) -> DataFrame:
    """Features and target at sampled times, split by whole days.

    Features are computed only on the days that hold a sample (semi-join on days first).
    """
    days = sampled.select("d").distinct()
    x = D.keep_dates(features, days).join(sampled.select("ep"), "ep", "left_semi")
    y = target.join(sampled.select("ep"), "ep", "left_semi").select("ep", "target")
    return D.split_by_date_share(x.join(y, "ep").dropna(subset=["target"]), p_train, p_val)

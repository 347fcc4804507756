"""Catalog of base features: id -> column over one role's book, and wide joins of series."""

from __future__ import annotations

from functools import partial, reduce
from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions import micro
from tickloom.operators.ordered import day_window
from tickloom.schema import ROLES, SIDES, book_levels, market_keys

FLOW_LEVELS = (1, 2, 3)


def role_features(role: str, levels: int = 10, keys=()) -> dict[str, Callable[[], Column]]:
    """Builders of every base feature of one role; flows look at the previous row of the day."""
    w = lambda: day_window((*keys, "role", "d"))
    out: dict[str, Callable[[], Column]] = {}
    for kind, get in (("price", micro.price), ("size", micro.size)):
        for side in SIDES:
            for lv in range(1, levels + 1):
                out[f"{role}_{side}_{kind}_{lv}"] = partial(get, lv, side)
    out[f"{role}_mid_price"] = micro.mid_price
    out[f"{role}_micro_price"] = micro.micro_price
    out[f"{role}_spread"] = micro.spread
    for k in FLOW_LEVELS:
        out[f"{role}_obi_{k}"] = partial(micro.imbalance, k)
        out[f"{role}_bof_{k}"] = lambda k=k: micro.flow("bid", k, w())
        out[f"{role}_aof_{k}"] = lambda k=k: micro.flow("ask", k, w())
        out[f"{role}_ofi_{k}"] = lambda k=k: micro.flow_imbalance(k, w())
        for side in SIDES:
            out[f"{role}_{side}_slope_{k}_v1"] = partial(micro.slope_relative, k, side)
            out[f"{role}_{side}_slope_{k}_v2"] = partial(micro.slope_depth, k, side)
    return out


def base_ids(levels: int = 10) -> list[str]:
    """All base feature ids; with ten levels there are 136."""
    out = ["basis", "irr"]
    for role in ROLES:
        out += [f"{role}_{s}_{k}_{n}" for k in ("price", "size") for s in SIDES for n in range(1, levels + 1)]
        out += [f"{role}_{x}" for x in ("mid_price", "micro_price", "spread")]
        for n in FLOW_LEVELS:
            out += [f"{role}_{x}_{n}" for x in ("obi", "bof", "aof", "ofi")]
            out += [f"{role}_{s}_slope_{n}_{v}" for s in SIDES for v in ("v1", "v2")]
    return out


def load_feature(book: DataFrame, base_id: str) -> DataFrame:
    """One base feature of the role named in its id, for any level that the book has."""
    role = base_id.split("_", 1)[0]
    columns = role_features(role, book_levels(book), market_keys(book))
    if base_id not in columns:
        raise ValueError(f"unknown base feature {base_id!r}")
    return book.where(F.col("role") == role).select(*market_keys(book), "role", "d", "ep", columns[base_id]().alias(base_id))


def role_table(book: DataFrame, role: str, ids: list[str]) -> DataFrame:
    """All wanted features of a role in one projection, hence one scan and one window sort."""
    columns = role_features(role, book_levels(book), market_keys(book))
    return book.where(F.col("role") == role).select(*market_keys(book), "ep", *[columns[i]().alias(i) for i in ids])


def join_series(series: dict[str, DataFrame]) -> DataFrame:
    """Full outer join of (ep, v) series, one column each.

    The series are stacked and grouped once, so any number of them costs one shuffle.
    """
    long = reduce(DataFrame.unionByName, [s.select("ep", F.col("v").alias("v"), F.lit(n).alias("n")) for n, s in series.items()])
    return long.groupBy("ep").agg(*[F.max(F.when(F.col("n") == n, F.col("v"))).alias(n) for n in series])


def market_features(book: DataFrame, terms: DataFrame, ids: list[str]) -> DataFrame:
    """Wide table (d, ep, ids) over the common times of both roles, with basis and implied repo rate.

    ``terms`` holds the day's cf and repo-rate terms.  Each role is one projection over
    one window sort; the two meet in one join.
    """
    from tickloom.functions.cross import irr_column
    from tickloom.functions.expr import day_of

    wanted = [i for i in ids if i not in ("basis", "irr")]
    need = list(dict.fromkeys([*wanted, "ctd_mid_price", "fut_mid_price"]))
    sides = [role_table(book, r, [i for i in need if i.startswith(r + "_")]) for r in ROLES]
    df = sides[0].join(sides[1], [*market_keys(book), "ep"]).withColumn("d", day_of("ep")).join(F.broadcast(terms), "d")
    bond, future = F.col("ctd_mid_price"), F.col("fut_mid_price")
    df = df.withColumns({"basis": bond - F.col("cf") * future, "irr": irr_column(bond, future)})
    return df.select(*market_keys(book), "d", "ep", *ids)

"""Profitability studies: fixed horizon, fixed profit, min-max and limit orders.

Market rows are keyed by ``ep`` (one row per grid step) and carry ``d``, level-1 quotes
of both roles (``ctd_bid_price`` ...) and the day's conversion factor ``cf``.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.cross import fractional_contracts, rounded_contracts
from tickloom.functions.expr import col, day_of, div
from tickloom.operators.dates import event_between
from tickloom.operators.ordered import exact_quantiles, hash_text
from tickloom.schema import BOND, LONG_FUTURE
from tickloom.sources.sinks import stage

# Study grids.
HORIZONS = (10, 30, 60, 300, 600, 900, 1800, 2700, 3600, 7200, 10800, 86_400, 3 * 86_400, 5 * 86_400)
PROFITS = (100.0, 500.0, 1000.0, 2500.0)
CONFIGS = tuple(product(("mid", "quoted"), ("frac", "round"), ("ignore", "level")))
CONFIG_COLUMNS = ["price_mode", "contract_mode", "volume_mode"]
LEGS = ("ctd_bid_price", "ctd_ask_price", "fut_bid_price", "fut_ask_price")


def execution_prices(df: DataFrame) -> DataFrame:
    """Replace both sides of a leg by their mid where ``price_mode`` is mid."""
    out = {}
    for role in ("ctd", "fut"):
        bid, ask = F.col(f"{role}_bid_price"), F.col(f"{role}_ask_price")
        for side, c in (("bid", bid), ("ask", ask)):
            out[f"{role}_{side}_price"] = F.when(F.col("price_mode") == "mid", (bid + ask) / 2).otherwise(c)
    return df.withColumns(out)


def _sizes_allow(ctd_side: str, fut_side: str, n_bonds, n_futures) -> Column:
    enough = (F.col(f"ctd_{ctd_side}_size") >= n_bonds) & (F.col(f"fut_{fut_side}_size") >= n_futures)
    return (F.col("volume_mode") == "ignore") | F.coalesce(enough, F.lit(False))


def execution_masks(df: DataFrame, n_bonds: float, n_futures: Column) -> DataFrame:
    """Entry and exit permission per direction; ``level`` asks for enough size on the side that trades."""
    n = F.lit(float(n_bonds))
    buy_bond = _sizes_allow("ask", "bid", n, n_futures)
    sell_bond = _sizes_allow("bid", "ask", n, n_futures)
    return df.withColumns({"long_entry": buy_bond, "short_entry": sell_bond, "long_exit": sell_bond, "short_exit": buy_bond})


def contracts(cf, n_bonds: float) -> Column:
    """Futures per trade by contract mode."""
    whole = rounded_contracts(cf, n_bonds).cast("double")
    return F.when(F.col("contract_mode") == "frac", fractional_contracts(cf, n_bonds)).otherwise(whole)


def with_configs(df: DataFrame, configs=CONFIGS) -> DataFrame:
    """One copy of each row per (price, contract, volume) mode; a map-side explode of literals."""
    cells = [F.struct(*[F.lit(v).alias(n) for n, v in zip(CONFIG_COLUMNS, c)]) for c in configs]
    return df.withColumn("_cfg", F.explode(F.array(*cells))).select(*df.columns, "_cfg.*")


def shift_forward(df: DataFrame, horizons, names: list[str], prefix: str = "x_") -> DataFrame:
    """Each row once per horizon, with the named columns of the row at exactly ep + horizon (NULL if absent)."""
    later = df.select(F.col("ep").alias("exit_ep"), *[F.col(n).alias(prefix + n) for n in names])
    wide = df.withColumn("horizon", F.explode(F.array(*[F.lit(int(h)) for h in horizons])))
    return wide.withColumn("exit_ep", F.col("ep") + F.col("horizon")).join(later, "exit_ep", "left")


def fixed_horizon(market: DataFrame, horizons, configs=CONFIGS, n_bonds: float = 1.0, exit_side: str = "entry") -> DataFrame:
    """PnL of entering at every row and leaving after each horizon, long and short.

    One shuffle pairs entries with exits for all horizons; the modes are unfolded after
    it.  ``exit_side`` says which mask the exit row has to satisfy.
    """
    names = [*LEGS, "ctd_bid_size", "ctd_ask_size", "fut_bid_size", "fut_ask_size", "cf"]
    paired = shift_forward(market.select("d", "ep", *names), horizons, names)
    return pair_pnl(paired, ["horizon", "d", "ep", "exit_ep"], configs, n_bonds, exit_side)


def pair_pnl(paired: DataFrame, keep: list[str], configs=CONFIGS, n_bonds: float = 1.0, exit_side: str = "entry") -> DataFrame:
    """PnL per configuration and direction of pairs of an entry and, with the prefix x_, its exit; NULL where the exit or a mask is missing."""
    def price(mode, name, prefix=""):
        if mode == "quoted":
            return F.col(prefix + name)
        return (F.col(f"{prefix}{name[:3]}_bid_price") + F.col(f"{prefix}{name[:3]}_ask_price")) / 2

    def futures(mode, cf):
        return fractional_contracts(cf, n_bonds) if mode == "frac" else rounded_contracts(cf, n_bonds).cast("double")

    def allowed(direction, n_fut, prefix=""):
        a, b = ("ask", "bid") if direction == "long" else ("bid", "ask")
        return (F.col(f"{prefix}ctd_{a}_size") >= float(n_bonds)) & (F.col(f"{prefix}fut_{b}_size") >= n_fut)

    # Legs per price mode, contracts per contract mode and masks are columns of the pair;
    # the configurations then only combine them.
    bond, fut = F.lit(n_bonds * BOND.face / 100), F.lit(LONG_FUTURE.face / 100)
    parts = {}
    for mode in {c[0] for c in configs}:
        parts[f"{mode}_long_bond"] = bond * (price(mode, "ctd_bid_price", "x_") - price(mode, "ctd_ask_price"))
        parts[f"{mode}_long_fut"] = fut * (price(mode, "fut_bid_price") - price(mode, "fut_ask_price", "x_"))
        parts[f"{mode}_short_bond"] = bond * (price(mode, "ctd_bid_price") - price(mode, "ctd_ask_price", "x_"))
        parts[f"{mode}_short_fut"] = fut * (price(mode, "fut_bid_price", "x_") - price(mode, "fut_ask_price"))
    for mode in {c[1] for c in configs}:
        now, then = futures(mode, "cf"), futures(mode, "x_cf")
        parts[f"n_{mode}"] = now
        for direction, other in (("long", "short"), ("short", "long")):
            leave = allowed(direction if exit_side == "entry" else other, then, "x_")
            parts[f"ok_{mode}_{direction}"] = allowed(direction, now) & leave
    paired = paired.select(*keep, F.col("x_cf").isNotNull().alias("_there"), *[c.alias(n) for n, c in parts.items()])
    cells = []
    for (mode, contract, volume), direction in product(configs, ("long", "short")):
        pnl = F.col(f"{mode}_{direction}_bond") + F.col(f"n_{contract}") * F.col(f"{mode}_{direction}_fut")
        ok = F.col("_there") if volume == "ignore" else F.col("_there") & F.col(f"ok_{contract}_{direction}")
        labels = [F.lit(v).alias(n) for n, v in zip(CONFIG_COLUMNS, (mode, contract, volume))]
        cells.append(F.struct(*labels, F.lit(direction).alias("direction"), F.when(ok, pnl).alias("pnl")))
    return paired.select(*keep, F.inline(F.array(*cells)))


def invalidate_overnight(trades: DataFrame, last_trading: DataFrame, switches: DataFrame) -> DataFrame:
    """Null the PnL of trades that span a last trading date in [entry, exit) or a switch date in (entry, exit]."""
    df = trades.withColumn("_exit_d", day_of("exit_ep"))
    df = event_between(df, last_trading, "d", "_exit_d", entry_inclusive=True, exit_inclusive=False, name="_roll")
    df = event_between(df, switches, "d", "_exit_d", entry_inclusive=False, exit_inclusive=True, name="_switch")
    return df.withColumn("pnl", F.when(~F.col("_roll") & ~F.col("_switch"), F.col("pnl"))).drop("_exit_d", "_roll", "_switch")


def runs_by_gap(df: DataFrame, keys: list[str], gap_s: int, value: str | None = None) -> DataFrame:
    """Runs of rows at most ``gap_s`` seconds apart: keys, first_ep, last_ep, n, total.

    Rows may stand for the ``seconds`` seconds from ep up to ``until``; they count as many.  Runs form inside each (keys, day); only the first and last run of a day can continue
    into a neighbour day, so at most two rows per day meet in the second pass.
    """
    if "seconds" not in df.columns:
        df = df.withColumns({"seconds": F.lit(1), "until": F.col("ep") + 1})
    day = Window.partitionBy(*keys, "d").orderBy("ep")
    new = F.coalesce((F.col("ep") - F.lag("until").over(day) + 1) > gap_s, F.lit(True))
    rows = df.withColumn("_new", new.cast("int")).withColumn("_run", F.sum("_new").over(day.rowsBetween(Window.unboundedPreceding, 0)))
    total = F.sum(F.col(value) * F.col("seconds")) if value else F.lit(None).cast("double")
    runs = rows.groupBy(*keys, "d", "_run").agg(
        F.min("ep").alias("first_ep"), (F.max("until") - 1).alias("last_ep"), F.sum("seconds").alias("n"), total.alias("total"))
    ends = Window.partitionBy(*keys, "d")
    runs = runs.withColumn("_edge", (F.col("_run") == F.min("_run").over(ends)) | (F.col("_run") == F.max("_run").over(ends)))
    series = Window.partitionBy(*keys).orderBy("first_ep")
    edge = runs.where("_edge")
    joined = F.coalesce((F.col("first_ep") - F.lag("last_ep").over(series)) > gap_s, F.lit(True)).cast("int")
    edge = edge.withColumn("_j", joined).withColumn("_g", F.sum("_j").over(series.rowsBetween(Window.unboundedPreceding, 0)))
    names = ["first_ep", "last_ep", "n", "total"]
    merged = edge.groupBy(*keys, "_g").agg(
        F.min("first_ep").alias("first_ep"), F.max("last_ep").alias("last_ep"), F.sum("n").alias("n"), F.sum("total").alias("total"))
    return runs.where("NOT _edge").select(*keys, *names).unionByName(merged.select(*keys, *names))


def profitable_episodes(pnl: DataFrame, keys: list[str], step_s: int, tolerance_s: int = 0) -> DataFrame:
    """Runs of positive PnL: mean PnL and length of each."""
    runs = runs_by_gap(pnl.where("pnl > 0"), keys, step_s + tolerance_s, "pnl")
    return runs.withColumn("mean_pnl", F.col("total") / F.col("n")).withColumnRenamed("n", "length").drop("total")


def summarize_horizon(pnl: DataFrame, keys: list[str], step_s: int, tolerance_s: int = 0) -> DataFrame:
    """31 metrics per key: days, PnL, profitable observations, profitable episodes; a row with ``seconds`` counts as so many."""
    if "seconds" not in pnl.columns:
        pnl = pnl.withColumns({"seconds": F.lit(1), "until": F.col("ep") + 1})
    pnl = stage(pnl.select(*keys, "d", "ep", "until", "seconds", "pnl"))
    # Equal values of a day collapse to their seconds; days, sums and medians need no more.
    counts = stage(pnl.groupBy(*keys, "d", "pnl").agg(F.sum("seconds").alias("w")))
    p, w = F.col("pnl"), F.col("w")
    good = F.when(p > 0, p)

    def sums(v, name):
        """seconds, sum and sum of squares of v"""
        return F.sum(F.when(v.isNotNull(), w)).alias(f"_n_{name}"), F.sum(v * w).alias(f"_s_{name}"), F.sum(v * v * w).alias(f"_q_{name}")

    def weighted(name):
        """count, sum, mean and sample deviation of the values of all days"""
        n, total, squares = (F.sum(f"_{x}_{name}") for x in "nsq")
        return F.coalesce(n, F.lit(0)), total, total / n, F.when(n > 1, F.sqrt(F.greatest((squares - total * total / n) / (n - 1), F.lit(0.0))))

    days = counts.groupBy(*keys, "d").agg(
        *sums(p, "all"), *sums(good, "good"), F.max(p).alias("_max"), F.min(p).alias("_min"), F.max(good).alias("_good_max"), F.min(good).alias("_good_min"))
    n_all, sum_all, mean_all, std_all = weighted("all")
    n_good, sum_good, mean_good, std_good = weighted("good")
    base = days.groupBy(*keys).agg(
        F.count_if(F.col("d").isNotNull() & F.col("_n_all").isNotNull()).alias("n_days"), F.count("d").alias("trading_days"),
        n_all.alias("_valid"), F.coalesce(sum_all, F.lit(0.0)).alias("total_pnl"), mean_all.alias("mean_pnl"),
        std_all.alias("std_pnl"), F.max("_max").alias("max_pnl"), F.min("_min").alias("min_pnl"),
        n_good.alias("profitable_observations"), F.coalesce(sum_good, F.lit(0.0)).alias("profitable_total_pnl"),
        mean_good.alias("profitable_mean_pnl"), std_good.alias("profitable_std_pnl"),
        F.max("_good_max").alias("profitable_max_pnl"), F.min("_good_min").alias("profitable_min_pnl"))
    runs = stage(profitable_episodes(pnl, keys, step_s, tolerance_s))
    per_run = runs.groupBy(*keys).agg(
        F.count("*").alias("profitable_episodes"), F.sum("mean_pnl").alias("episode_total_pnl"), F.avg("mean_pnl").alias("episode_mean_pnl"),
        F.stddev_samp("mean_pnl").alias("episode_std_pnl"), F.max("mean_pnl").alias("episode_max_pnl"), F.min("mean_pnl").alias("episode_min_pnl"),
        F.avg("length").alias("mean_episode_length"), F.max("length").alias("max_episode_length"), F.min("length").alias("min_episode_length"))
    cells = F.array(F.struct(F.lit("all").alias("what"), p.alias("v")), F.struct(F.lit("good").alias("what"), good.alias("v")))
    values = counts.where(p.isNotNull()).select(*keys, w.alias("w"), F.inline(cells))
    cells = F.array(F.struct(F.lit("run").alias("what"), F.col("mean_pnl").alias("v")),
                    F.struct(F.lit("length").alias("what"), F.col("length").cast("double").alias("v")))
    values = values.unionByName(runs.select(*keys, F.lit(1).alias("w"), F.inline(cells)))
    mid = exact_quantiles(values, [*keys, "what"], "v", {"median": 0.5}, weight="w")
    mid = mid.groupBy(*keys).agg(*[F.max(F.when(F.col("what") == x, F.col("median"))).alias(n) for x, n in (
        ("all", "median_pnl"), ("good", "profitable_median_pnl"), ("run", "episode_median_pnl"), ("length", "median_episode_length"))])
    out = base.join(per_run, keys, "left").join(mid, keys, "left")
    out = out.withColumns({"profitable_episodes": F.coalesce("profitable_episodes", F.lit(0)),
                           "episode_total_pnl": F.coalesce("episode_total_pnl", F.lit(0.0))})
    return out.withColumns({
        "profitable_observations_pct": div("profitable_observations", "_valid") * 100,
        "profitable_observations_per_day": div("profitable_observations", "n_days"),
        "profitable_pnl_per_day": div("profitable_total_pnl", "n_days"),
        "profitable_episodes_pct": div("profitable_episodes", "profitable_observations") * 100,
        "profitable_episodes_per_day": div("profitable_episodes", "n_days")}).drop("_valid")


# ---- fixed profit


def position_marks(market: DataFrame, n_bonds: float = 1.0) -> DataFrame:
    """Entry cash flow and mark of a long and a short basis position per row."""
    df = execution_prices(market)
    n_fut = contracts("cf", n_bonds)
    df = execution_masks(df, n_bonds, n_fut)
    bond, fut = F.lit(n_bonds * BOND.face / 100), n_fut * F.lit(LONG_FUTURE.face / 100)
    sell = bond * F.col("ctd_bid_price") - fut * F.col("fut_ask_price")
    buy = fut * F.col("fut_bid_price") - bond * F.col("ctd_ask_price")
    return df.withColumns({"long_mark": sell, "long_cash": buy, "short_mark": buy, "short_cash": sell})


def fixed_profit(market: DataFrame, profits, step_s: int, configs=CONFIGS, n_bonds: float = 1.0,
                 max_holding_s: int | None = None) -> DataFrame:
    """First later row of the session where the open profit reaches each target.

    Market rows are restricted to the analysis window, so a session never crosses
    midnight and one (configuration, day) group has at most 86,400 rows.  The search for
    the first exceedance has no closed window form; inside a group it is a vectorised
    descent over range maxima, O(n log n) time and memory.
    """
    marked = position_marks(with_configs(market, configs), n_bonds)
    cols = ["ep", "long_mark", "long_cash", "long_entry", "long_exit", "short_mark", "short_cash", "short_entry", "short_exit"]
    targets = [float(p) for p in profits]
    holding = max_holding_s
    step = step_s

    def search(pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values("ep", kind="stable")
        ep = pdf["ep"].to_numpy()
        n = len(ep)
        at = np.arange(n)
        breaks = np.append(np.flatnonzero(np.diff(ep) > step), n - 1)
        limit = breaks[np.searchsorted(breaks, at)]
        if holding is not None:
            limit = np.minimum(limit, np.searchsorted(ep, ep + holding, side="right") - 1)

        def levels(values, pick):
            out = [values]
            while (1 << len(out)) <= n:
                half = 1 << (len(out) - 1)
                out.append(pick(out[-1][:-half], out[-1][half:]))
            return out

        frames = []
        for direction in ("long", "short"):
            mark = pdf[f"{direction}_mark"].to_numpy(dtype=float)
            cash = pdf[f"{direction}_cash"].to_numpy(dtype=float)
            allowed = pdf[f"{direction}_exit"].to_numpy(dtype=bool)
            enter = pdf[f"{direction}_entry"].to_numpy(dtype=bool)
            high = levels(np.where(allowed & np.isfinite(mark), mark, -np.inf), np.maximum)
            low = levels(np.where(np.isfinite(mark), mark, np.inf), np.minimum)
            for target in targets:
                place = at + 1
                worst = np.full(n, np.inf)
                with np.errstate(invalid="ignore"):
                    for k in range(len(high) - 1, -1, -1):
                        width = 1 << k
                        fits = place + width - 1 <= limit
                        here = np.clip(place, 0, len(high[k]) - 1)
                        skip = fits & ~(high[k][here] + cash >= target)
                        worst = np.where(skip, np.minimum(worst, low[k][here]), worst)
                        place = np.where(skip, place + width, place)
                    inside = np.clip(place, 0, n - 1)
                    hit = (place <= limit) & (high[0][inside] + cash >= target) & enter
                    worst = np.minimum(worst, low[0][inside])
                    mae = np.maximum(0.0, -(worst + cash))
                frames.append(pd.DataFrame({
                    "profit": target, "direction": direction, "ep": ep, "allowed": enter, "hit": hit,
                    "seconds": np.where(hit, ep[inside] - ep, np.nan).astype(float), "mae": np.where(hit, mae, np.nan)}))
        out = pd.concat(frames, ignore_index=True)
        for name in ("price_mode", "contract_mode", "volume_mode", "d"):
            out[name] = pdf[name].iloc[0]
        return out

    schema = ("price_mode string, contract_mode string, volume_mode string, d date, profit double, direction string, ep long, "
              "allowed boolean, hit boolean, seconds double, mae double")
    found = marked.select(*CONFIG_COLUMNS, "d", *cols).groupBy(*CONFIG_COLUMNS, "d").applyInPandas(search, schema)
    return found.withColumns({"seconds": F.when(F.col("hit"), F.col("seconds")),
                              "mae": F.when(F.col("hit"), F.col("mae"))})


def summarize_profit(found: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates, hits and time / adverse-excursion statistics per key."""
    found = stage(found.select(*keys, "d", "allowed", "hit", "seconds", "mae"))
    base = found.groupBy(*keys).agg(
        F.count_if("allowed").alias("candidate_entries"), F.count_if("hit").alias("profit_hits"), F.countDistinct("d").alias("_days"),
        F.avg("seconds").alias("mean_time_to_profit"), F.max("seconds").alias("max_time_to_profit"),
        F.avg("mae").alias("mean_mae"), F.max("mae").alias("max_mae"))
    cells = F.array(F.struct(F.lit("s").alias("what"), F.col("seconds").alias("v")), F.struct(F.lit("m").alias("what"), F.col("mae").alias("v")))
    values = found.where("hit").select(*keys, F.inline(cells))
    mid = exact_quantiles(values, [*keys, "what"], "v", {"median": 0.5}).groupBy(*keys).agg(
        F.max(F.when(F.col("what") == "s", F.col("median"))).alias("median_time_to_profit"),
        F.max(F.when(F.col("what") == "m", F.col("median"))).alias("median_mae"))
    return base.join(mid, keys, "left").withColumns({
        "profit_hit_pct": div("profit_hits", "candidate_entries") * 100, "profit_hits_per_day": div("profit_hits", "_days")}).drop("_days")


# ---- min-max


def euro_market(market: DataFrame, n_bonds: float = 1.0) -> DataFrame:
    """Mids and spreads in money, and the basis position built from them."""
    n_fut = rounded_contracts("cf", n_bonds).cast("double")
    ctd = lambda s: F.col(f"ctd_{s}_price") * F.lit(n_bonds * BOND.scale)
    fut = lambda s: F.col(f"fut_{s}_price") * n_fut * F.lit(LONG_FUTURE.scale)
    df = market.select("d", "ep", ((ctd("bid") + ctd("ask")) / 2).alias("ctd_mid"), ((fut("bid") + fut("ask")) / 2).alias("fut_mid"),
                       (ctd("ask") - ctd("bid")).alias("ctd_spread"), (fut("ask") - fut("bid")).alias("fut_spread"))
    return df.withColumns({"basis_mid": F.col("ctd_mid") - F.col("fut_mid"), "basis_spread": F.col("ctd_spread") + F.col("fut_spread")})


def minmax_period(money: DataFrame, days: int) -> DataFrame:
    """Lowest and highest basis of every period of ``days`` days and the trade between them.

    Both extremes are ordinary combinable aggregates over structs; ties go to the first time.
    """
    start = money.agg(F.min("d").alias("_d0"))
    df = money.join(F.broadcast(start)).withColumn("_p", F.floor(F.datediff("d", "_d0") / days))
    df = df.withColumn("period", F.expr(f"date_add(_d0, cast(_p * {int(days)} as int))"))
    names = ["basis_mid", "ep", "ctd_mid", "fut_mid", "ctd_spread", "fut_spread", "basis_spread"]
    low = F.min(F.when(F.col("basis_mid").isNotNull(), F.struct(*names))).alias("lo")
    flip = [F.col("basis_mid"), (-F.col("ep")).alias("back"), *[F.col(n) for n in names[1:]]]
    high = F.max(F.when(F.col("basis_mid").isNotNull(), F.struct(*flip))).alias("hi")
    g = df.groupBy("period").agg(F.min("d").alias("opening_date"), F.max("d").alias("closing_date"), low, high).where("lo.ep <> hi.ep")
    up = F.col("lo.ep") < F.col("hi.ep")
    out = {"min_time": F.col("lo.ep"), "max_time": F.col("hi.ep"), "direction": F.when(up, "long").otherwise("short"),
           "entry_time": F.least("lo.ep", "hi.ep"), "exit_time": F.greatest("lo.ep", "hi.ep"),
           "holding_time": F.abs(F.col("hi.ep") - F.col("lo.ep"))}
    money2 = {}
    for side in ("lo", "hi"):
        name = "min" if side == "lo" else "max"
        for n in names:
            if n != "ep":
                money2[f"{name}_{n}"] = F.col(f"{side}.{n}")
    money2["entry_basis"] = F.when(up, F.col("lo.basis_mid")).otherwise(F.col("hi.basis_mid"))
    money2["exit_basis"] = F.when(up, F.col("hi.basis_mid")).otherwise(F.col("lo.basis_mid"))
    gross = F.abs(F.col("hi.basis_mid") - F.col("lo.basis_mid"))
    cost = (F.col("lo.basis_spread") + F.col("hi.basis_spread")) / 2
    money2 |= {"gross_pnl": gross, "cost": cost, "net_pnl": gross - cost}
    return g.select("period", "opening_date", "closing_date", *[c.alias(n) for n, c in out.items()],
                    *[F.bround(c, 2).alias(n) for n, c in money2.items()])


def minmax_summary(periods: DataFrame) -> DataFrame:
    """Counts, totals and means over all periods and over those with a net gain."""
    both = periods.withColumn("part", F.explode(F.when(F.col("net_pnl") > 0, F.array(F.lit("overall"), F.lit("net_gain"))).otherwise(F.array(F.lit("overall")))))
    is_long = (F.col("direction") == "long").cast("double")
    aggs = [F.count("*").alias("periods")]
    aggs += [f(c).alias(f"{n}_{c}") for n, f in (("total", F.sum), ("mean", F.avg)) for c in ("gross_pnl", "cost", "net_pnl")]
    aggs += [F.sum(is_long).alias("long_trades"), F.sum(1 - is_long).alias("short_trades"),
             (F.avg(is_long) * 100).alias("long_pct"), (F.avg(1 - is_long) * 100).alias("short_pct")]
    return both.groupBy("part").agg(*aggs)


# ---- trades and limit orders


def trades_from_records(records: DataFrame, keys=("seed", "episode")) -> DataFrame:
    """One row per trade: opening, closing (first other position) and stopping time, with both records.

    An episode is one day with at most one decision per second.
    """
    w = Window.partitionBy(*keys).orderBy("ep")
    moved = F.coalesce(F.col("position") != F.lag("position").over(w), F.lit(True))
    df = records.withColumn("_run", F.sum(moved.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    legs = ["ctd_mid", "ctd_spread", "fut_mid", "fut_spread"]
    first = F.struct("ep", "position", "allocation", "ctd_contracts", "fut_contracts", *legs)
    runs = df.groupBy(*keys, "_run").agg(F.min(first).alias("head"), F.max("ep").alias("last_ep"))
    nxt = Window.partitionBy(*keys).orderBy("_run")
    runs = runs.withColumns({"next": F.lead("head").over(nxt), "stopping_time": F.lead("last_ep").over(nxt)})
    opened = runs.where((F.col("head.position") != 0) & (F.col("head.position") != F.col("head.allocation")) & F.col("next").isNotNull())
    return opened.select(*keys, F.col("head.ep").alias("opening_time"), F.col("next.ep").alias("closing_time"), "stopping_time",
                         F.col("head.position").alias("direction"), F.col("head.ctd_contracts").alias("ctd_contracts"),
                         F.col("head.fut_contracts").alias("fut_contracts"),
                         *[F.col(f"head.{c}").alias(f"{c}_opening") for c in legs], *[F.col(f"next.{c}").alias(f"{c}_closing") for c in legs])


def _pnl(df: DataFrame, suffix: str = "") -> DataFrame:
    """Basis legs, half-spread costs and PnL from the four leg columns per end."""
    n_c, n_f = F.col("ctd_contracts"), F.col("fut_contracts")
    out = {}
    for end in ("opening", "closing"):
        c = lambda name: F.col(f"{name}_{end}{suffix}")
        out[f"basis_mid_{end}{suffix}"] = c("ctd_mid") * n_c - c("fut_mid") * n_f
        out[f"cost_{end}{suffix}"] = (c("ctd_spread") * n_c + c("fut_spread") * n_f) / 2
    gross = F.col("direction") * (out[f"basis_mid_closing{suffix}"] - out[f"basis_mid_opening{suffix}"])
    out[f"gross_pnl{suffix}"] = gross
    out[f"net_pnl{suffix}"] = gross - (out[f"cost_opening{suffix}"] + out[f"cost_closing{suffix}"])
    return df.withColumns(out)


def original_trade_pnl(trades: DataFrame) -> DataFrame:
    return _pnl(trades)


def _minute(c: str) -> Column:
    return F.expr(f"{c} div 60")


def pack_quotes(quotes: DataFrame) -> DataFrame:
    """Quotes (ep, bid, ask; one per second) as one array per minute with its extremes, written once for repeated searches."""
    return stage(quotes.groupBy(_minute("ep").alias("_m")).agg(
        F.collect_list(F.struct("ep", "bid", "ask")).alias("_q"), F.min("ask").alias("low"), F.max("bid").alias("high")))


def first_hit(orders: DataFrame, packed: DataFrame, keys: list[str], start: str, end: str, limit: str, side: str, out: str) -> DataFrame:
    """First quote time in [start, end] that crosses the limit: ask <= limit to buy (1), bid >= limit to sell (-1).

    ``packed`` comes from ``pack_quotes``; minutes are folded again into one array of
    extremes per hour, so no array exceeds 60 entries.  An order meets one row per hour it
    spans to find its first promising inner minute, then the arrays of that minute and of
    its two end minutes; no (order, quote) pairs are formed.
    """
    per_hour = packed.groupBy(F.expr("_m div 60").alias("_h")).agg(
        F.collect_list(F.struct(F.col("_m").alias("m"), "low", "high")).alias("_ms"), F.min("low").alias("_low"), F.max("high").alias("_high"))
    base = orders.select(*keys, F.col(start).alias("_s"), F.col(end).alias("_e"), F.col(limit).alias("_l"), F.col(side).alias("_side"))
    base = stage(base.withColumns({"_ma": _minute("_s"), "_mb": _minute("_e")}))

    def reaches(low, high):
        return F.when(F.col("_side") == 1, low <= F.col("_l")).otherwise(high >= F.col("_l"))

    spans = base.withColumn("_h", F.explode(F.sequence(F.expr("_ma div 60"), F.expr("_mb div 60"))))
    good = F.filter("_ms", lambda x: (x["m"] > F.col("_ma")) & (x["m"] < F.col("_mb")) & reaches(x["low"], x["high"]))
    inner = spans.join(per_hour, "_h").where(reaches(F.col("_low"), F.col("_high"))).withColumn("_m", F.array_min(F.transform(good, lambda x: x["m"]))).where("_m IS NOT NULL")
    names = [*keys, "_s", "_e", "_l", "_side"]
    inner = inner.groupBy(*names).agg(F.min("_m").alias("_m"))
    ends = base.select(*names, F.explode(F.array_distinct(F.array("_ma", "_mb"))).alias("_m"))
    looks = ends.unionByName(inner).join(packed.select("_m", "_q"), "_m")
    hits = F.filter("_q", lambda q: (q["ep"] >= F.col("_s")) & (q["ep"] <= F.col("_e")) & reaches(q["ask"], q["bid"]))
    best = looks.select(*keys, F.array_min(F.transform(hits, lambda q: q["ep"])).alias("_hit")).groupBy(*keys).agg(F.min("_hit").alias(out))
    return orders.join(best, keys, "left")


def limit_order_analysis(trades: DataFrame, market: DataFrame, opening_limit: bool = True, closing_limit: bool = True) -> DataFrame:
    """Would limit orders at the recorded bond mids have filled, and with which PnL.

    ``market`` has ep, bid, ask (bond quotes) and fut_mid, fut_spread; it is read several
    times, so pass a written table.  An end without a limit order trades at its own time
    at the bond's market mid and spread.
    """
    keys = ["seed", "episode", "opening_time"]
    trades, packed = stage(trades), pack_quotes(market)
    df = original_trade_pnl(trades).withColumn("_other", -F.col("direction"))
    uses = {"opening": opening_limit, "closing": closing_limit}
    after = {"opening": "closing_time", "closing": "stopping_time"}
    for end, side in (("opening", "direction"), ("closing", "_other")):
        if uses[end]:
            df = df.withColumn(f"{end}_limit_price", F.col(f"ctd_mid_{end}"))
            df = first_hit(df, packed, keys, f"{end}_time", after[end], f"{end}_limit_price", side, f"{end}_hit_time")
        else:
            df = df.withColumns({f"{end}_limit_price": F.lit(None).cast("double"), f"{end}_hit_time": F.col(f"{end}_time")})
        leg = market.select(F.col("ep").alias(f"{end}_hit_time"), F.col("fut_mid").alias(f"_fm_{end}"), F.col("fut_spread").alias(f"_fs_{end}"),
                            ((F.col("bid") + F.col("ask")) / 2).alias(f"_cm_{end}"), (F.col("ask") - F.col("bid")).alias(f"_cs_{end}"))
        df = df.join(leg, f"{end}_hit_time", "left")
    feasible = F.col("opening_hit_time").isNotNull() & F.col("closing_hit_time").isNotNull()
    cols = {"limit_trade_feasible": feasible}
    for end in ("opening", "closing"):
        mid, spread = (F.col(f"ctd_mid_{end}"), F.lit(0.0)) if uses[end] else (F.col(f"_cm_{end}"), F.col(f"_cs_{end}"))
        cols |= {f"{end}_limit_hit": F.col(f"{end}_hit_time").isNotNull(), f"{end}_time_to_hit": F.col(f"{end}_hit_time") - F.col(f"{end}_time"),
                 f"ctd_mid_{end}_limit": F.when(feasible, mid), f"ctd_spread_{end}_limit": F.when(feasible, spread),
                 f"fut_mid_{end}_limit": F.when(feasible, F.col(f"_fm_{end}")), f"fut_spread_{end}_limit": F.when(feasible, F.col(f"_fs_{end}"))}
    out = _pnl(df.withColumns(cols), "_limit")
    return out.drop("_other", *[f"_{n}_{e}" for n in ("fm", "fs", "cm", "cs") for e in uses])


# ---- positions and execution


def decision_grid(market: DataFrame, persistence_s: int, offset_s: int = 0) -> DataFrame:
    """Decision rows of each day: every ``persistence_s`` seconds from the first row plus offset, the last before the day's last row."""
    bounds = market.groupBy("d").agg(F.min("ep").alias("_first"), F.max("ep").alias("last_ep"))
    df = market.join(F.broadcast(bounds), "d")
    since = F.col("ep") - F.col("_first") - offset_s
    return df.where((since >= 0) & (since % persistence_s == 0) & (F.col("ep") < F.col("last_ep"))).drop("_first")


def backtest_positions(decisions: DataFrame, market: DataFrame, quoted: bool = True) -> DataFrame:
    """Reward of a table of positions (d, ep, position): hold to the next decision or the day's last row.

    ``market`` has d, ep, basis_mid, basis_spread.  The last decision of a day is forced flat.
    """
    w = Window.partitionBy("d").orderBy("ep")
    ends = market.groupBy("d").agg(F.max("ep").alias("_last"))
    df = decisions.join(F.broadcast(ends), "d")
    df = df.withColumn("_next", F.lead("ep").over(w))
    df = df.withColumn("position", F.when(F.col("_next").isNull(), F.lit(0)).otherwise(F.col("position")))
    df = df.withColumn("allocation", F.coalesce(F.lag("position").over(w), F.lit(0)))
    df = df.withColumn("next_ep", F.coalesce("_next", "_last"))
    here = market.select("ep", "basis_mid", "basis_spread")
    later = market.select(F.col("ep").alias("next_ep"), F.col("basis_mid").alias("_later"))
    df = df.join(here, "ep").join(later, "next_ep")
    cost = F.lit(0.5) * F.col("basis_spread") * F.abs(F.col("position") - F.col("allocation")) if quoted else F.lit(0.0)
    gross = F.col("position") * (F.col("_later") - F.col("basis_mid"))
    return df.select("d", "ep", "next_ep", "allocation", "position", gross.alias("gross_reward"), cost.alias("cost"), (gross - cost).alias("reward"))


def encode_position(position, encoding: str = "int") -> dict[str, Column]:
    p = col(position)
    if encoding == "int":
        return {"position": p}
    if encoding == "ohe":
        return {f"position_{n}": (p == v).cast("int") for n, v in (("short", -1), ("flat", 0), ("long", 1))}
    raise ValueError(f"unknown encoding {encoding!r}")


def policy(name: str, key: str = "ep", seed: int = 42) -> Column:
    """Position chosen by a baseline policy."""
    fixed = {"long": 1, "flat": 0, "short": -1}
    if name in fixed:
        return F.lit(fixed[name])
    if name == "random":
        digits = F.conv(F.substring(hash_text(key, seed), 1, 8), 16, 10).cast("long")
        return (digits % 3 - 1).cast("int")
    raise ValueError(f"unknown policy {name!r}")


def execution_windows(quotes: DataFrame, horizon_s: int) -> DataFrame:
    """Back-to-back windows per day from its first row, each ending by the day's last row."""
    bounds = quotes.groupBy("d").agg(F.min("ep").alias("_a"), F.max("ep").alias("_b")).where(F.col("_b") - F.col("_a") >= horizon_s)
    opens = F.explode(F.sequence(F.col("_a"), F.col("_b") - horizon_s, F.lit(horizon_s).cast("long")))
    return bounds.select("d", opens.alias("opening_time")).withColumn("closing_time", F.col("opening_time") + horizon_s)


def random_openings(quotes: DataFrame, horizon_s: int) -> DataFrame:
    """Every row that leaves a full horizon before the day's last row."""
    last = quotes.groupBy("d").agg((F.max("ep") - horizon_s).alias("_latest"))
    opens = quotes.join(F.broadcast(last), "d").where(F.col("ep") <= F.col("_latest"))
    return opens.select("d", F.col("ep").alias("opening_time"), (F.col("ep") + horizon_s).alias("closing_time"))


def execution_outcome(windows: DataFrame, quotes: DataFrame, packed: DataFrame, side: str, ticks: int, step_s: int, tick: float) -> DataFrame:
    """Outcome of quoting ``ticks`` away, re-posted every step, until filled or forced at the window end.

    ``quotes`` has ep, bid, ask and ``packed`` the same packed.  Windows whose opening has no quote are left out.
    """
    buy = side == "bid"
    price = F.col("ask") if buy else F.col("bid")
    sign = 1 if buy else -1
    at = quotes.select(F.col("ep").alias("_t"), price.alias("_p"))
    df = windows.join(at.select(F.col("_t").alias("opening_time"), F.col("_p").alias("benchmark_price")), "opening_time")
    if ticks == 0:
        return df.withColumns({"status": F.lit("market"), "execution_time": F.col("opening_time"), "execution_price": F.col("benchmark_price"),
                               "limit_price": F.lit(None).cast("double"), "improvement": F.lit(0).cast("long")})
    span = F.col("closing_time") - F.lit(step_s)
    steps = df.withColumn("_t", F.explode(F.sequence("opening_time", span, F.lit(step_s).cast("long")))).join(at, "_t")
    steps = steps.select("opening_time", "_t", (F.col("_t") + step_s - 1).alias("_end"), (F.col("_p") - sign * ticks * tick).alias("_limit"), F.lit(sign).alias("_side"))
    hit = first_hit(steps, packed, ["opening_time", "_t"], "_t", "_end", "_limit", "_side", "_hit").where("_hit IS NOT NULL")
    first = hit.groupBy("opening_time").agg(F.min(F.struct("_t", "_hit", "_limit")).alias("f"))
    df = df.join(first, "opening_time", "left").withColumn("execution_time", F.coalesce("f._hit", "closing_time"))
    df = df.join(at.select(F.col("_t").alias("execution_time"), F.col("_p").alias("execution_price")), "execution_time", "left")
    filled = F.col("f").isNotNull()
    paid = F.when(filled, F.col("f._limit")).otherwise(F.col("execution_price"))
    gain = F.rint(sign * (F.col("benchmark_price") - paid) / tick).cast("long")
    return df.withColumns({"status": F.when(filled, "limit").otherwise("forced"), "limit_price": F.col("f._limit"), "improvement": gain}).drop("f")

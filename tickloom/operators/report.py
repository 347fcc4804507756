"""Reports over trading and execution records.

Records are keyed (seed, episode, ep).  An episode is one day of decisions, at most one
per second, so episode windows are bounded; anything across episodes is carried by one
summary row per episode or day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.expr import div, sod
from tickloom.operators.ordered import exact_quantiles
from tickloom.schema import BOND, LONG_FUTURE

TRADING_DAYS = 252


def drop_reset(records: DataFrame, keys=("seed", "episode")) -> DataFrame:
    """Drop the first row of every episode."""
    first = F.min("ep").over(Window.partitionBy(*keys))
    return records.withColumn("_first", first).where(F.col("ep") > F.col("_first")).drop("_first")


def append_episodes(train: DataFrame, test: DataFrame) -> DataFrame:
    """Union of two record tables; test episodes continue after the last train episode of their seed."""
    last = train.groupBy("seed").agg(F.max("episode").alias("_m"))
    moved = test.join(last, "seed").withColumn("episode", F.col("episode") + F.col("_m")).drop("_m")
    return train.withColumn("part", F.lit("train")).unionByName(moved.withColumn("part", F.lit("test")))


def derive_records(records: DataFrame) -> DataFrame:
    """Trade flags, turnover, leg costs, outcome flags, notionals and returns; row arithmetic only."""
    c = F.col
    turnover = F.abs(c("position") - c("allocation"))
    trade = c("position") != c("allocation")
    df = records.withColumns({"trade": trade, "turnover": turnover})
    df = df.withColumns({"ctd_cost_per_contract": 0.5 * c("turnover") * c("ctd_spread"), "fut_cost_per_contract": 0.5 * c("turnover") * c("fut_spread")})
    notional = c("ctd_contracts") * F.lit(BOND.face) + c("fut_contracts") * F.lit(LONG_FUTURE.face)
    return df.withColumns({
        "ctd_cost": c("ctd_cost_per_contract") * c("ctd_contracts"), "fut_cost": c("fut_cost_per_contract") * c("fut_contracts"),
        "basis_cost_per_contract": c("ctd_cost_per_contract") + c("fut_cost_per_contract"),
        "basis_cost": c("ctd_cost_per_contract") * c("ctd_contracts") + c("fut_cost_per_contract") * c("fut_contracts"),
        "profit": c("trade") & (c("reward") > 0), "neutral": c("trade") & (c("reward") == 0), "loss": c("trade") & (c("reward") < 0),
        "notional": notional, "gross_return": c("gross_reward") / notional, "return": c("reward") / notional})


def cumulative(records: DataFrame) -> DataFrame:
    """Running reward, gross reward and cost per seed over all episodes, running maximum and drawdown.

    Episodes are summed and maximised in parallel; the carry over earlier episodes is one
    row per (seed, episode).
    """
    names = {"reward": "cum_reward", "gross_reward": "cum_gross_reward", "cost": "cum_cost"}
    inside = Window.partitionBy("seed", "episode").orderBy("ep").rowsBetween(Window.unboundedPreceding, 0)
    local = records.select("*", *[F.sum(s).over(inside).alias(f"_{o}") for s, o in names.items()])
    local = local.select("*", *[F.max(f"_{o}").over(inside).alias(f"_m_{o}") for o in ("cum_reward", "cum_gross_reward")])
    per = local.groupBy("seed", "episode").agg(
        *[F.sum(s).alias(f"_t_{o}") for s, o in names.items()], *[F.max(f"_{o}").alias(f"_x_{o}") for o in ("cum_reward", "cum_gross_reward")])
    before = Window.partitionBy("seed").orderBy("episode").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("*", *[F.coalesce(F.sum(f"_t_{o}").over(before), F.lit(0.0)).alias(f"_b_{o}") for o in names.values()])
    per = per.select("seed", "episode", *[f"_b_{o}" for o in names.values()],
                     *[F.max(F.col(f"_b_{o}") + F.col(f"_x_{o}")).over(before).alias(f"_p_{o}") for o in ("cum_reward", "cum_gross_reward")])
    df = local.join(per, ["seed", "episode"])
    out = {o: F.col(f"_b_{o}") + F.col(f"_{o}") for o in names.values()}
    for o, top, down in (("cum_reward", "cum_max_reward", "drawdown"), ("cum_gross_reward", "cum_max_gross_reward", "gross_drawdown")):
        peak = F.greatest(F.col(f"_p_{o}"), F.col(f"_b_{o}") + F.col(f"_m_{o}"))
        out |= {top: peak, down: out[o] - peak}
    return df.select(*records.columns, *[c.alias(n) for n, c in out.items()])


def daily_pnl(records: DataFrame) -> DataFrame:
    return records.groupBy("seed", "d").agg(F.sum("gross_reward").alias("gross_pnl"), F.sum("reward").alias("net_pnl"), F.sum("cost").alias("cost"))


def daily_return(derived: DataFrame) -> DataFrame:
    return derived.groupBy("seed", "d").agg(F.sum("gross_return").alias("gross_return"), F.sum("return").alias("net_return"))


def daily_drawdown(daily: DataFrame) -> DataFrame:
    """Cumulative daily PnL, running maximum and drawdown; one row per seed and day."""
    w = Window.partitionBy("seed").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    df = daily.withColumn("cum_pnl", F.sum("net_pnl").over(w))
    return df.withColumn("drawdown", F.col("cum_pnl") - F.max("cum_pnl").over(w))


def trade_metrics(derived: DataFrame) -> DataFrame:
    """43 performance metrics per seed."""
    c = F.col
    per_day = derived.groupBy("seed", "d").agg(
        F.sum("gross_reward").alias("gross_pnl"), F.sum("reward").alias("net_pnl"), F.sum("cost").alias("cost"),
        F.sum("gross_return").alias("gross_return"), F.sum("return").alias("net_return"))
    day = daily_drawdown(per_day).groupBy("seed").agg(
        F.count("*").cast("double").alias("n_days"), F.avg("gross_pnl").alias("gross_pnl_per_day"), F.avg("net_pnl").alias("net_pnl_per_day"),
        F.avg("cost").alias("cost_per_day"), F.avg("gross_return").alias("gross_return_mean"), F.avg("net_return").alias("net_return_mean"),
        F.stddev_samp("net_return").alias("net_return_std"), F.sqrt(F.avg(F.when(c("net_return") < 0, c("net_return") ** 2))).alias("_down"),
        F.avg("net_pnl").alias("daily_pnl_mean"), F.stddev_samp("net_pnl").alias("daily_pnl_std"), F.min("drawdown").alias("max_drawdown"),
        F.min("net_pnl").alias("worst_day"), F.max("net_pnl").alias("best_day"),
        *[F.avg(cond.cast("double")).alias(n) for n, cond in (
            ("profitable_days", c("net_pnl") > 0), ("neutral_days", c("net_pnl") == 0), ("losing_days", c("net_pnl") < 0))])
    n = lambda cond: F.count_if(cond).cast("double")
    share = lambda cond: F.avg(cond.cast("double"))
    rows = derived.groupBy("seed").agg(
        F.count("*").cast("double").alias("n_steps"), F.sum("gross_reward").alias("gross_pnl"), F.sum("reward").alias("net_pnl"), F.sum("cost").alias("cost"),
        *[n(c("position") == v).alias(k) for k, v in (("short", -1), ("flat", 0), ("long", 1))],
        *[share(c("position") == v).alias(f"{k}_pct") for k, v in (("short", -1), ("flat", 0), ("long", 1))],
        n(c("trade")).alias("trades"), F.sum("turnover").alias("turnover"), n(c("profit")).alias("profitable_trades"),
        n(c("neutral")).alias("neutral_trades"), n(c("loss")).alias("losing_trades"),
        share(c("return") > 0).alias("positive_returns"), share(c("return") == 0).alias("zero_returns"), share(c("return") < 0).alias("negative_returns"),
        F.sum("ctd_cost").alias("_ctd"), F.sum("fut_cost").alias("_fut"), F.sum("basis_cost").alias("_basis"))
    year = F.sqrt(F.lit(float(TRADING_DAYS)))
    out = rows.join(day, "seed").withColumns({
        "steps_per_day": c("n_steps") / c("n_days"), "annualized_return": c("net_return_mean") * TRADING_DAYS,
        "annualized_volatility": c("net_return_std") * year, "sharpe": div("net_return_mean", "net_return_std") * year,
        "sortino": div("net_return_mean", "_down") * year, "win_rate": div("profitable_trades", "trades"),
        "break_even_cost_per_trade": div("gross_pnl", "trades"), "ctd_cost_per_trade": div("_ctd", "trades"),
        "fut_cost_per_trade": div("_fut", "trades"), "basis_cost_per_trade": div("_basis", "trades")})
    return out.drop("_down", "_ctd", "_fut", "_basis")


def aggregate_seeds(metrics: DataFrame, names: list[str], by: list[str] | None = None) -> DataFrame:
    """Mean and sample deviation of each metric over seeds, in long form."""
    by = by or []
    cells = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])
    long = metrics.select(*by, F.inline(cells))
    return long.groupBy(*by, "metric").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))


def seed_band(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean and deviation over seeds per point."""
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count(value).alias("seeds"))


def action_heatmap(records: DataFrame) -> DataFrame:
    """Position and sign of the reward by day and minute of day, long form; the last record of a minute counts."""
    minute = F.floor(sod("ep") / 60)
    return records.groupBy("seed", "d", minute.alias("minute")).agg(
        F.max_by("position", "ep").alias("position"), F.signum(F.max_by("reward", "ep")).alias("reward_sign"))


def compare_runs(a: DataFrame, b: DataFrame, on: str, value: str, excluded=()) -> DataFrame:
    """Two summaries side by side with their difference and whether they agree."""
    left = a.select(on, F.col(value).alias("run_a")).where(~F.col(on).isin(*excluded)) if excluded else a.select(on, F.col(value).alias("run_a"))
    right = b.select(on, F.col(value).alias("run_b")).where(~F.col(on).isin(*excluded)) if excluded else b.select(on, F.col(value).alias("run_b"))
    both = left.join(right, on, "full")
    return both.withColumns({"difference": F.col("run_a") - F.col("run_b"), "same": F.col("run_a").eqNullSafe(F.col("run_b"))})


# ---- execution records


def exec_terminal(records: DataFrame, keys=("seed", "side", "episode")) -> DataFrame:
    """One terminal row per episode with its opening time and seconds to execution.

    A single aggregate finds both ends; more than one terminal row shows in ``terminals``.
    """
    end = F.max(F.when(F.col("terminal"), F.struct("us", "step", "action", "status", "benchmark_price", "execution_price"))).alias("t")
    g = records.groupBy(*keys).agg(F.min("us").alias("opening_us"), F.count_if("terminal").alias("terminals"), end).where("terminals > 0")
    return g.select(*keys, "opening_us", "terminals", "t.*").withColumn("execution_seconds", (F.col("us") - F.col("opening_us")) / 1e6)


def require_single_terminal(terminal: DataFrame) -> None:
    if not terminal.where("terminals > 1").isEmpty():
        raise ValueError("more than one terminal record in an episode")


def exec_metrics(terminal: DataFrame, tick: float, keys=("seed", "side")) -> DataFrame:
    """Counts by status, fill rate and statistics of improvement, time and quote distance."""
    c = F.col
    gain = F.when(c("side") == "bid", c("benchmark_price") - c("execution_price")).otherwise(c("execution_price") - c("benchmark_price")) / tick
    df = terminal.withColumns({"improvement": gain, "distance": F.when(c("action") > 0, c("action").cast("double"))})
    keys = list(keys)
    stats = {"execution_improvement": "improvement", "execution_time": "execution_seconds", "passive_quote_distance": "distance"}
    base = df.groupBy(*keys).agg(
        F.count("*").alias("episodes"), *[F.count_if(c("status") == s).alias(s) for s in ("market", "limit", "forced")],
        *[F.avg(v).alias(f"{n}_mean") for n, v in stats.items()])
    cells = F.array(*[F.struct(F.lit(n).alias("what"), c(v).alias("v")) for n, v in stats.items()])
    long = df.select(*keys, F.inline(cells))
    mid = exact_quantiles(long, [*keys, "what"], "v", {"median": 0.5}).groupBy(*keys).agg(
        *[F.max(F.when(c("what") == n, c("median"))).alias(f"{n}_median") for n in stats])
    return base.join(mid, keys, "left").withColumns({
        **{f"{s}_pct": c(s) / c("episodes") for s in ("market", "limit", "forced")}, "limit_fill_rate": div("limit", c("limit") + c("forced"))})

"""Searches and studies against brute force on random walks."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.operators import profit as P
from tickloom.operators import stats as T

DAY = dt.date(2024, 1, 2)
BASE = (DAY - dt.date(1970, 1, 1)).days * 86_400 + 9 * 3600


def walk(n, seed, gaps=True):
    rng = np.random.default_rng(seed)
    keep = np.sort(rng.choice(n * 2, n, replace=False)) if gaps else np.arange(n)
    mid = 100 + np.round(rng.normal(0, 0.02, n).cumsum(), 2)
    fut = 110 + np.round(rng.normal(0, 0.02, n).cumsum(), 2)
    half = rng.integers(1, 3, n) / 100
    return pd.DataFrame({"d": DAY, "ep": BASE + keep, "ctd_bid_price": mid - half, "ctd_ask_price": mid + half, "fut_bid_price": fut - half,
                         "fut_ask_price": fut + half, "ctd_bid_size": rng.integers(0, 4, n) * 0.5, "ctd_ask_size": rng.integers(0, 4, n) * 0.5,
                         "fut_bid_size": rng.integers(0, 4, n) * 1.0, "fut_ask_size": rng.integers(0, 4, n) * 1.0, "cf": 0.95})


@pytest.mark.parametrize("holding", [None, 40])
def test_fixed_profit_equals_brute_force(spark, holding):
    pdf = walk(200, 1)
    pdf.loc[::17, "ctd_bid_price"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("ctd_bid_price", F.when(~F.isnan("ctd_bid_price"), F.col("ctd_bid_price")))
    cfg = (("quoted", "round", "level"),)
    got = P.fixed_profit(df, (20.0, 60.0), 3, cfg, n_bonds=0.05, max_holding_s=holding).toPandas()
    n_fut, n_bond = np.rint(0.95 * 0.05 * 20), 0.05
    sell = n_bond * 20_000 * pdf.ctd_bid_price - n_fut * 1000 * pdf.fut_ask_price
    buy = n_fut * 1000 * pdf.fut_bid_price - n_bond * 20_000 * pdf.ctd_ask_price
    up = ((pdf.ctd_ask_size >= n_bond) & (pdf.fut_bid_size >= n_fut)).to_numpy()
    down = ((pdf.ctd_bid_size >= n_bond) & (pdf.fut_ask_size >= n_fut)).to_numpy()
    ep = pdf.ep.to_numpy()
    session = np.r_[0, np.cumsum(np.diff(ep) > 3)]
    hits = 0
    for direction, mark, cash, enter, leave in (("long", sell, buy, up, down), ("short", buy, sell, down, up)):
        mark, cash = mark.to_numpy(), cash.to_numpy()
        for target in (20.0, 60.0):
            part = got[(got.direction == direction) & (got.profit == target)].sort_values("ep").reset_index(drop=True)
            for i in range(len(ep)):
                found, low = None, np.inf
                for j in range(i + 1, len(ep)):
                    if session[j] != session[i] or (holding and ep[j] - ep[i] > holding) or not enter[i]:
                        break
                    path = mark[j] + cash[i]
                    if np.isnan(path):
                        continue
                    low = min(low, path)
                    if leave[j] and path >= target:
                        found = j
                        break
                row = part.iloc[i]
                assert bool(row.hit) == (found is not None)
                if found is not None:
                    hits += 1
                    assert row.seconds == ep[found] - ep[i]
                    assert row.mae == pytest.approx(max(0.0, -low))
    assert hits > 20


def test_crossover_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    frames = []
    for k in range(5):
        n = 60
        x = np.round(rng.normal(0, 0.3, n).cumsum(), 1)
        x[rng.random(n) < 0.15] = np.nan
        frames.append(pd.DataFrame({"d": DAY + dt.timedelta(k), "ep": BASE + k * 86_400 + np.arange(n) * 2, "x": x}))
    pdf = pd.concat(frames, ignore_index=True)
    df = spark.createDataFrame(pdf).withColumn("x", F.when(~F.isnan("x"), F.col("x"))).repartition(5)
    got = T.crossover_time(df, "x", 2).toPandas().sort_values("ep").reset_index(drop=True)
    days = sorted(pdf.d.unique())
    at = 0
    for k, day in enumerate(days):
        part = pdf[pdf.d == day].reset_index(drop=True)
        mean = pdf[pdf.d.isin(days[k - 2:k])]["x"].mean() if k >= 2 else np.nan
        for i in range(len(part)):
            row = got.iloc[at]
            at += 1
            delta = part.x[i] - mean
            if np.isnan(delta):
                assert pd.isna(row.delta) and pd.isna(row.seconds) and not row.no_crossover
                continue
            assert row.delta == pytest.approx(delta)
            later = [j for j in range(i + 1, len(part)) if not np.isnan(part.x[j])]
            other = [j for j in later if np.sign(part.x[j] - mean) != np.sign(delta)]
            if i == len(part) - 1 or np.isclose(delta, 0):
                assert pd.isna(row.seconds) and not row.no_crossover
            elif other:
                assert row.seconds == part.ep[other[0]] - part.ep[i]
            else:
                assert pd.isna(row.seconds) and bool(row.no_crossover) == bool(later)


def test_first_hit_edges(spark):
    quotes = spark.createDataFrame([(0, 9.0, 10.0), (5, 9.0, 10.0), (60, 9.0, 8.0), (3600, 11.0, 12.0), (7199, 9.0, 7.0), (7200, 9.0, 6.0)], "ep long, bid double, ask double")
    orders = spark.createDataFrame([
        (1, 0, 100, 10.0, 1, 0), (2, 1, 59, 10.0, 1, 5), (3, 6, 7199, 8.5, 1, 60), (4, 61, 7199, 7.5, 1, 7199), (5, 61, 7198, 7.5, 1, None),
        (6, 0, 7200, 10.5, -1, 3600), (7, 61, 7200, 6.0, 1, 7200), (8, 10, 20, 10.0, 1, None)],
        "id int, s long, e long, lim double, side int, want long")
    got = P.first_hit(orders, P.pack_quotes(quotes), ["id"], "s", "e", "lim", "side", "hit").collect()
    assert len(got) == 8 and all(r.hit == r.want for r in got)


def test_first_hit_random(spark):
    rng = np.random.default_rng(9)
    ep = np.sort(rng.choice(9000, 700, replace=False))
    mid = 100 + rng.normal(0, 0.05, 700).cumsum()
    quotes = pd.DataFrame({"ep": ep, "bid": mid - 0.02, "ask": mid + 0.02})
    start = rng.integers(0, 8000, 120)
    orders = pd.DataFrame({"id": np.arange(120), "s": start, "e": start + rng.integers(0, 4000, 120), "lim": 100 + rng.normal(0, 0.5, 120), "side": rng.choice([-1, 1], 120)})
    got = P.first_hit(spark.createDataFrame(orders), P.pack_quotes(spark.createDataFrame(quotes)), ["id"], "s", "e", "lim", "side", "hit").toPandas().sort_values("id")
    for o, h in zip(orders.itertuples(), got["hit"]):
        q = quotes[(quotes.ep >= o.s) & (quotes.ep <= o.e)]
        q = q[q.ask <= o.lim] if o.side == 1 else q[q.bid >= o.lim]
        assert (pd.isna(h) and q.empty) or h == q.ep.iloc[0]


def test_runs_cross_midnight(spark):
    rows = [(DAY, BASE, 1.0), (DAY, BASE + 1, 2.0), (DAY, BASE + 10, 3.0), (DAY, BASE + 54_000 - 1, 4.0),
            (DAY + dt.timedelta(1), BASE + 54_000, 5.0), (DAY + dt.timedelta(1), BASE + 60_000, 6.0)]
    df = spark.createDataFrame([("k", *r) for r in rows], "k string, d date, ep long, pnl double")
    got = P.runs_by_gap(df, ["k"], 1, "pnl").orderBy("first_ep").select("n", "total").collect()
    assert [tuple(r) for r in got] == [(2, 3.0), (1, 3.0), (2, 9.0), (1, 6.0)]


def test_exit_side_is_a_choice(spark):
    pdf = walk(30, 4, gaps=False)
    df = spark.createDataFrame(pdf)
    cfg = (("quoted", "round", "level"),)
    n = {s: P.fixed_horizon(df, (5,), cfg, 0.05, exit_side=s).where("pnl IS NOT NULL").count() for s in ("entry", "exit")}
    up = ((pdf.ctd_ask_size >= 0.05) & (pdf.fut_bid_size >= 1)).to_numpy()
    down = ((pdf.ctd_bid_size >= 0.05) & (pdf.fut_ask_size >= 1)).to_numpy()
    same = (up[:-5] & up[5:]).sum() + (down[:-5] & down[5:]).sum()
    other = (up[:-5] & down[5:]).sum() + (down[:-5] & up[5:]).sum()
    assert n == {"entry": same, "exit": other}


def test_market_orders_replace_limit_orders(spark):
    market = spark.createDataFrame([(BASE + i, 99.0, 101.0, 110.0 + i, 0.5) for i in range(10)], "ep long, bid double, ask double, fut_mid double, fut_spread double")
    trades = spark.createDataFrame([(0, 1, BASE + 1, BASE + 3, BASE + 6, 1, 1.0, 2.0, 50.0, 0.0, 110.0, 0.0, 500.0, 0.0, 111.0, 0.0)],
        "seed int, episode int, opening_time long, closing_time long, stopping_time long, direction int, ctd_contracts double, fut_contracts double, "
        "ctd_mid_opening double, ctd_spread_opening double, fut_mid_opening double, fut_spread_opening double, "
        "ctd_mid_closing double, ctd_spread_closing double, fut_mid_closing double, fut_spread_closing double")
    limit = P.limit_order_analysis(trades, market).first()
    assert not limit.limit_trade_feasible and limit.net_pnl_limit is None
    plain = P.limit_order_analysis(trades, market, opening_limit=False, closing_limit=False).first()
    assert plain.limit_trade_feasible and plain.opening_hit_time == BASE + 1
    assert plain.gross_pnl_limit == pytest.approx(-2 * (113.0 - 111.0)) and plain.cost_opening_limit == pytest.approx((2.0 + 2 * 0.5) / 2)


def ols_t(y, x):
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    e = y - x @ beta
    return beta[0] / np.sqrt(e @ e / (len(y) - x.shape[1]) * np.linalg.inv(x.T @ x)[0, 0])


@pytest.mark.parametrize("lags,trend", [(0, "c"), (2, "c"), (3, "ct")])
def test_adf_equals_least_squares(spark, lags, trend):
    y = np.random.default_rng(2).normal(0, 1, 80).cumsum() + 1000
    df = spark.createDataFrame([(DAY, int(i), float(v)) for i, v in enumerate(y)], "d date, ep long, x double")
    row = T.adf(df, ["d"], "x", lags, trend).first()
    dy = np.diff(y)
    t = np.arange(lags, len(dy))
    cols = [y[t]] + [dy[t - k] for k in range(1, lags + 1)] + [np.ones(len(t))] + ([t.astype(float)] if trend == "ct" else [])
    assert row["nobs"] == len(t)
    assert row["stat"] == pytest.approx(ols_t(dy[t], np.column_stack(cols)), rel=1e-6)


def test_adf_pvalue_and_kpss_ends(spark):
    df = spark.createDataFrame([(-2.86154,), (-3.43035,), (5.0,), (-30.0,)], "s double")
    p = [r[0] for r in df.select(T.adf_pvalue("s")).collect()]
    assert p[0] == pytest.approx(0.05, abs=2e-3) and p[1] == pytest.approx(0.01, abs=1e-3) and p[2:] == [1.0, 0.0]
    k = [r[0] for r in spark.createDataFrame([(0.1,), (0.463,), (9.0,)], "s double").select(T.kpss_pvalue("s")).collect()]
    assert k == pytest.approx([0.1, 0.05, 0.01])


@pytest.mark.parametrize("lags, trend", [(0, "c"), (3, "ct"), (300, "c"), (300, "ct")])
def test_adf_statistic_equals_least_squares(lags, trend):
    y = np.random.default_rng(lags).normal(size=2000).cumsum()
    d, m = np.diff(y), len(y) - 1
    x = [np.ones(m - lags), y[lags:-1], *([np.arange(m - lags) + 1.0] if trend == "ct" else []), *[d[lags - i:m - i] for i in range(1, lags + 1)]]
    x = np.column_stack(x)
    beta = np.linalg.lstsq(x, d[lags:], rcond=None)[0]
    rest = d[lags:] - x @ beta
    var = rest @ rest / (len(rest) - x.shape[1]) * np.linalg.inv(x.T @ x)[1, 1]
    n, stat = T.adf_statistic(y, lags, trend)
    assert n == m - lags and abs(stat - beta[1] / np.sqrt(var)) < 1e-8


@pytest.mark.parametrize("lags, trend", [(2, "c"), (300, "ct"), (1800, "c")])
def test_kpss_statistic_equals_loop(lags, trend):
    y = np.random.default_rng(lags).normal(size=4000)
    t = np.arange(len(y))
    e = y - np.polyval(np.polyfit(t, y, 1 if trend == "ct" else 0), t)
    var = e @ e + 2 * sum((1 - k / (lags + 1)) * (e[k:] @ e[:-k]) for k in range(1, lags + 1))
    assert abs(T.kpss_statistic(y, lags, trend)[1] - (e.cumsum() ** 2).sum() / len(y) / var) < 1e-8


def test_tests_of_a_full_day_at_1800_lags(spark):
    r = np.random.default_rng(9)
    n = 28_801
    df = spark.createDataFrame(pd.DataFrame({"d": DAY, "ep": BASE + np.arange(n), "x": r.normal(size=n).cumsum()}))
    rows = T.stationarity_run(df, "x", {"daily": ["d"]}, {"daily": [1800]}).collect()
    assert {(r.test, r.regression) for r in rows} == {(a, b) for a in ("adf", "kpss") for b in ("c", "ct")}
    assert all(r.stat is not None and 0 <= r.pvalue <= 1 for r in rows)
    assert T.acf(df, ["d"], "x", 300).count() == 300


# ---- one second


def second_loop(quotes, opens, closes, horizons):
    """Per second: the last quote of each role so far; entries and exits one by one."""
    state, market = {}, {}
    by = {}
    for role, ep, q in quotes:
        by.setdefault(ep, []).append((role, q))
    days = sorted({ep // 86400 for _, ep, _ in quotes})
    for day in days:
        state = {}
        for s in range(closes + 1):
            for role, q in by.get(day * 86400 + s, []):
                state[role] = q
            if s >= opens and len(state) == 2:
                market[day * 86400 + s] = (state["ctd"], state["fut"])
    out = {}
    for h in horizons:
        for ep, (c, f) in market.items():
            x = market.get(ep + h)
            long = x and 20_000 * (x[0][0] - c[1]) + 20 * 0.9 * 1000 * (f[0] - x[1][1])
            out[h, ep] = long
    return out


def test_intervals_equal_a_loop_over_seconds(spark):
    import random

    from tickloom.operators import intervals as V

    r, opens, closes, rows = random.Random(5), 40, 400, []
    for day in (19_000, 19_001, 19_003):
        for _ in range(60):
            s = r.randrange(0, 450)
            rows.append((r.choice(["ctd", "fut"]), day * 86400 + s, (round(100 - r.random(), 2), round(100 + r.random(), 2))))
    rows = list({(a, b): (a, b, c) for a, b, c in rows}.values())
    df = spark.createDataFrame([(a, b * 1_000_000 + 7, c[0], c[1], 5.0, 5.0) for a, b, c in rows], "role string, us long, l1_bid_price double, l1_ask_price double, l1_bid_size double, l1_ask_size double")
    market = V.quote_intervals(df, opens, closes).withColumn("cf", F.lit(0.9))
    horizons = [10, 30, 86_400, 3 * 86_400]
    got = V.fixed_horizon_seconds(market, horizons, (("quoted", "frac", "ignore"),), 1.0).where("direction = 'long'").collect()
    want = second_loop(rows, opens, closes, horizons)
    seen = {}
    for x in got:
        for ep in range(x.ep, x.until):
            assert (x.horizon, ep) not in seen
            seen[x.horizon, ep] = x.pnl
        assert x.seconds == x.until - x.ep
    assert seen.keys() == want.keys() and sum(v is not None for v in want.values()) > 500
    for k, v in want.items():
        assert (seen[k] is None) == (v is None) and (v is None or abs(seen[k] - v) < 1e-6), k
    keys = ["horizon", "direction"]
    pieces = spark.createDataFrame(got).select(*keys, "d", "ep", "until", "seconds", "pnl")
    single = pieces.withColumn("ep", F.explode(F.sequence("ep", F.col("until") - 1))).drop("until", "seconds")
    a, b = (sorted(P.summarize_horizon(x, keys, 1, 5).collect()) for x in (pieces, single))
    for x, y in zip(a, b):
        assert all((u is None) == (v is None) and (u == v or abs(u - v) <= 1e-6 * max(1, abs(u))) for u, v in zip(x, y) if not isinstance(u, str))
    assert len(a) == len(b) == 4


def test_exit_over_midnight(spark):
    """A market open all day: exits after midnight belong to the entry's day."""
    from tickloom.operators import intervals as V

    rows = [("ctd", 0), ("fut", 0), ("ctd", 86_400), ("fut", 86_400), ("ctd", 86_500)]
    df = spark.createDataFrame([(a, b * 1_000_000, 99.0 + b / 1e6, 100.0, 5.0, 5.0) for a, b in rows], "role string, us long, l1_bid_price double, l1_ask_price double, l1_bid_size double, l1_ask_size double")
    market = V.quote_intervals(df, 0, 86_399).withColumn("cf", F.lit(1.0))
    got = V.horizon_pieces(market, [50], ["ctd_bid_price"]).orderBy("ep").collect()
    assert [(x.ep, x.until, x.x_ctd_bid_price) for x in got if x.d.day == 1] == [(0, 86_350, 99.0), (86_350, 86_400, 99.0864)]
    assert [(x.ep, x.until, x.x_ctd_bid_price) for x in got if x.d.day == 2][:2] == [(86_400, 86_450, 99.0864), (86_450, 86_500, 99.0865)]


def test_summary_counts_equal_values_once(spark):
    """Days, sums and medians of rows that stand for seconds, null days and values too, without a copy of the rows per distinct count."""
    import statistics

    days = [dt.date(2024, 1, 1), dt.date(2024, 1, 2), dt.date(2024, 1, 3), None]
    rows = [("x", days[k % 4], 10_000 * (k % 4) + 10 * k, 10_000 * (k % 4) + 10 * k + 1 + k % 3, 1 + k % 3, None if k % 4 == 2 or k % 7 == 0 else float(k % 5 - 1)) for k in range(200)]
    out = P.summarize_horizon(spark.createDataFrame(rows, "k string, d date, ep long, until long, seconds long, pnl double"), ["k"], 1)
    assert "Expand" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = out.first()
    every = [r[5] for r in rows if r[5] is not None for _ in range(r[4])]
    good = [v for v in every if v > 0]
    assert (got.n_days, got.trading_days, got.profitable_observations) == (2, 3, len(good))
    for name, v in (("", every), ("profitable_", good)):
        want = (sum(v), statistics.mean(v), statistics.median(v), statistics.stdev(v), max(v), min(v))
        assert [got[f"{name}{x}_pnl"] for x in ("total", "mean", "median", "std", "max", "min")] == pytest.approx(want)

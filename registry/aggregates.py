"""Aggregations and reports."""

from pyspark.sql import functions as F

from registry.base import query
from tickloom import schema as S
from tickloom.functions.expr import sod
from tickloom.operators import book as B
from tickloom.operators import grid as G
from tickloom.operators import model as M
from tickloom.operators import quality as Q
from tickloom.operators import report as R
from tickloom.operators import stats as T
from tickloom.sources.readers import valid_proposals

LEV, BOOK_STEP = 10, 60
WIDE = " ".join(f"l{n}_{s}_{k}:f" for n in range(1, LEV + 1) for s in S.SIDES for k in S.KINDS)


def _pivot():
    return ", ".join(f"MAX(price) FILTER (rk = {n} AND side = '{s}') AS l{n}_{s}_price, MAX(qty) FILTER (rk = {n} AND side = '{s}') AS l{n}_{s}_size"
                     for n in range(1, LEV + 1) for s in S.SIDES)


@query("book_aggregate", f"ep:i {WIDE} mid:f", f"""
       WITH o AS (SELECT * FROM proposals WHERE bond_code = 'IT0001' AND status = 0 AND check_logon = 0),
            g AS (SELECT unnest(generate_series(a, z, {BOOK_STEP})) AS ep FROM (SELECT MIN(start_us) // {BOOK_STEP * 1000000} * {BOOK_STEP} AS a, MAX(end_us) // {BOOK_STEP * 1000000} * {BOOK_STEP} AS z FROM o)),
            q AS (SELECT ep, 'bid' AS side, bid_price AS price, SUM(bid_qty) AS qty FROM g JOIN o ON g.ep * 1000000 BETWEEN start_us AND end_us WHERE bid_price <> 0 GROUP BY ALL
                  UNION ALL SELECT ep, 'ask', ask_price, SUM(ask_qty) FROM g JOIN o ON g.ep * 1000000 BETWEEN start_us AND end_us WHERE ask_price <> 0 GROUP BY ALL),
            r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY ep, side ORDER BY CASE side WHEN 'bid' THEN -price ELSE price END) AS rk FROM q),
            w AS (SELECT ep, {_pivot()} FROM r WHERE rk <= {LEV} GROUP BY ep)
       SELECT g.ep, w.* EXCLUDE (ep), (l1_bid_price + l1_ask_price) / 2 AS mid FROM g LEFT JOIN w ON w.ep = g.ep""")
def _(t):
    return B.rebuild_book(valid_proposals(t.proposals, "IT0001"), BOOK_STEP, LEV)


@query("resample_last", "role:s ep:i l1_bid_price:f l1_bid_size:f", """
       WITH b AS (SELECT role, ep // 600 * 600 AS ep, arg_max(l1_bid_price, ep) FILTER (l1_bid_price IS NOT NULL) AS l1_bid_price,
                         arg_max(l1_bid_size, ep) FILTER (l1_bid_size IS NOT NULL) AS l1_bid_size FROM book1 GROUP BY 1, 2)
       SELECT g.role, g.ep, b.l1_bid_price, b.l1_bid_size FROM (SELECT role, unnest(generate_series(MIN(ep), MAX(ep), 600)) AS ep FROM b GROUP BY role) g
       LEFT JOIN b ON b.role = g.role AND b.ep = g.ep""")
def _(t):
    return G.resample_last(t.book1, ["role"], 600, ["l1_bid_price", "l1_bid_size"])


STATS = "n:i mean:f std:f low:f q25:f q50:f q75:f high:f skew:f kurt:f"
DESC = """COUNT(v) AS n, AVG(v) AS mean, STDDEV_SAMP(v) AS std, MIN(v) AS low, quantile_cont(v, 0.25) AS q25, quantile_cont(v, 0.5) AS q50,
          quantile_cont(v, 0.75) AS q75, MAX(v) AS high, skewness(v) AS skew, kurtosis(v) AS kurt"""


@query("describe", f"event_type:s {STATS}", f"SELECT event_type, {DESC} FROM (SELECT event_type, value AS v FROM events) x GROUP BY event_type")
def _(t):
    return T.describe(t.events, ["event_type"], "value")


@query("intraday_profile", "role:s slot:i mean:f std:f days:i", """
       SELECT role, slot, AVG(v) AS mean, STDDEV_SAMP(v) AS std, COUNT(v) AS days FROM (
        SELECT role, d, ep % 86400 // 3600 * 3600 AS slot, arg_max(l1_ask_price - l1_bid_price, ep) AS v FROM quotes1 GROUP BY ALL) x GROUP BY role, slot""")
def _(t):
    return T.intraday_profile(t.quotes1.withColumn("spread", F.col("l1_ask_price") - F.col("l1_bid_price")), "spread", 3600)


def box_sql(source, key):
    return f"""
       WITH x AS ({source}), q AS (SELECT {key}, quantile_cont(v, 0.25) AS q25, quantile_cont(v, 0.5) AS q50, quantile_cont(v, 0.75) AS q75 FROM x GROUP BY {key})
       SELECT x.{key}, q25, q50, q75, COUNT(*) AS n, MIN(v) FILTER (ok) AS whisker_low, MAX(v) FILTER (ok) AS whisker_high, COUNT(*) FILTER (NOT ok) AS outliers
       FROM (SELECT x.{key}, v, q25, q50, q75, v BETWEEN q25 - 1.5e0 * (q75 - q25) AND q75 + 1.5e0 * (q75 - q25) AS ok FROM x JOIN q ON x.{key} = q.{key}) x
       GROUP BY x.{key}, q25, q50, q75"""


@query("box_by_bucket", "bucket:s q25:f q50:f q75:f n:i whisker_low:f whisker_high:f outliers:i", box_sql("""
       SELECT unnest(['hour' || HOUR(ts), 'weekday' || isodow(ts), 'week' || WEEK(ts), 'month' || MONTH(ts), 'year' || YEAR(ts)]) AS bucket, value AS v FROM events""", "bucket"))
def _(t):
    ts = F.col("ts")
    buckets = F.array(F.concat(F.lit("hour"), F.hour(ts)), F.concat(F.lit("weekday"), F.weekday(ts) + 1), F.concat(F.lit("week"), F.weekofyear(ts)),
                      F.concat(F.lit("month"), F.month(ts)), F.concat(F.lit("year"), F.year(ts)))
    return T.box_stats(t.events.select(F.explode(buckets).alias("bucket"), "value"), ["bucket"], "value")


@query("histogram", "role:s bin:i n:i share:f", """
       SELECT role, bin, n, n / SUM(n) OVER (PARTITION BY role) AS share FROM (SELECT role, CAST(FLOOR((l1_bid_size - 0.25e0) / 0.5e0) AS BIGINT) AS bin, COUNT(*) AS n
       FROM lob WHERE l1_bid_size IS NOT NULL GROUP BY 1, 2) x""")
def _(t):
    return T.histogram(t.lob, ["role"], "l1_bid_size", 0.25, 0.5, share=True)


@query("symmetric_histogram", "bin:i n:i", """
       SELECT CAST(LEAST(FLOOR((reward + m) / (2 * m) * 31), 30) AS BIGINT) AS bin, COUNT(*) AS n FROM records, (SELECT MAX(ABS(reward)) AS m FROM records) x GROUP BY 1""")
def _(t):
    return T.symmetric_histogram(t.records, "reward", 31)


@query("open_close_histogram", "edge:s role:s bin:i n:i", """
       SELECT edge, role, CAST(FLOOR(us % 86400000000 // 1000000 / 600) AS BIGINT) AS bin, COUNT(*) AS n FROM (
        SELECT role, d, 'open' AS edge, MIN(us) AS us FROM lob WHERE l1_bid_price IS NOT NULL AND l1_bid_size IS NOT NULL GROUP BY role, d UNION ALL
        SELECT role, d, 'close', MAX(us) FROM lob WHERE l1_bid_price IS NOT NULL AND l1_bid_size IS NOT NULL GROUP BY role, d) x GROUP BY 1, 2, 3""")
def _(t):
    r = Q.valid_range(t.lob).where("scope = 'level_1'")
    edges = F.array(F.struct(F.lit("open").alias("edge"), F.col("first_us").alias("us")), F.struct(F.lit("close").alias("edge"), F.col("last_us").alias("us")))
    df = r.select("role", F.inline(edges)).select("role", "edge", sod(F.floor(F.col("us") / 1_000_000)).alias("s"))
    return T.histogram(df, ["edge", "role"], "s", 0, 600)


@query("daily_pnl", "seed:i d:d gross_pnl:f net_pnl:f cost:f", """
       SELECT seed, d, SUM(gross_reward) AS gross_pnl, SUM(reward) AS net_pnl, SUM(cost) AS cost FROM records GROUP BY seed, d""")
def _(t):
    return R.daily_pnl(t.records)


NOT = "(ctd_contracts * 2000000e0 + fut_contracts * 100000e0)"


@query("daily_return", "seed:i d:d gross_return:f9 net_return:f9", f"""
       SELECT seed, d, SUM(gross_reward / {NOT}) AS gross_return, SUM(reward / {NOT}) AS net_return FROM records GROUP BY seed, d""")
def _(t):
    return R.daily_return(R.derive_records(t.records))


METRICS = ("n_days n_steps steps_per_day gross_pnl net_pnl cost gross_pnl_per_day net_pnl_per_day cost_per_day gross_return_mean net_return_mean net_return_std "
           "annualized_return annualized_volatility sharpe sortino daily_pnl_mean daily_pnl_std max_drawdown worst_day best_day profitable_days neutral_days "
           "losing_days short flat long short_pct flat_pct long_pct trades turnover profitable_trades neutral_trades losing_trades win_rate positive_returns "
           "zero_returns negative_returns break_even_cost_per_trade ctd_cost_per_trade fut_cost_per_trade basis_cost_per_trade").split()
TRADE_SQL = f"""
   WITH r AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY seed, episode ORDER BY ep) AS rn FROM records) x WHERE rn > 1),
   v AS (SELECT *, position <> allocation AS tr, ABS(position - allocation) AS turn, reward / {NOT} AS ret, gross_reward / {NOT} AS gret FROM r),
   dd AS (SELECT seed, d, SUM(gross_reward) AS g, SUM(reward) AS n, SUM(cost) AS c, SUM(gret) AS gr, SUM(ret) AS nr FROM v GROUP BY seed, d),
   cu AS (SELECT *, SUM(n) OVER (PARTITION BY seed ORDER BY d) AS cum FROM dd),
   dw AS (SELECT *, cum - MAX(cum) OVER (PARTITION BY seed ORDER BY d) AS down FROM cu),
   dm AS (SELECT seed, COUNT(*) AS n_days, AVG(g) AS gross_pnl_per_day, AVG(n) AS net_pnl_per_day, AVG(c) AS cost_per_day, AVG(gr) AS gross_return_mean,
            AVG(nr) AS net_return_mean, STDDEV_SAMP(nr) AS net_return_std, AVG(nr) * 252 AS annualized_return, STDDEV_SAMP(nr) * SQRT(252) AS annualized_volatility,
            AVG(nr) / STDDEV_SAMP(nr) * SQRT(252) AS sharpe, AVG(nr) / SQRT(AVG(nr * nr) FILTER (nr < 0)) * SQRT(252) AS sortino, AVG(n) AS daily_pnl_mean,
            STDDEV_SAMP(n) AS daily_pnl_std, MIN(down) AS max_drawdown, MIN(n) AS worst_day, MAX(n) AS best_day, AVG((n > 0)::INT) AS profitable_days,
            AVG((n = 0)::INT) AS neutral_days, AVG((n < 0)::INT) AS losing_days FROM dw GROUP BY seed),
   rm AS (SELECT seed, COUNT(*) AS n_steps, SUM(gross_reward) AS gross_pnl, SUM(reward) AS net_pnl, SUM(cost) AS cost, SUM((position = -1)::INT) AS short,
            SUM((position = 0)::INT) AS flat, SUM((position = 1)::INT) AS long, AVG((position = -1)::INT) AS short_pct, AVG((position = 0)::INT) AS flat_pct,
            AVG((position = 1)::INT) AS long_pct, SUM(tr::INT) AS trades, SUM(turn) AS turnover, SUM((tr AND reward > 0)::INT) AS profitable_trades,
            SUM((tr AND reward = 0)::INT) AS neutral_trades, SUM((tr AND reward < 0)::INT) AS losing_trades,
            SUM((tr AND reward > 0)::INT) / SUM(tr::INT) AS win_rate, AVG((ret > 0)::INT) AS positive_returns, AVG((ret = 0)::INT) AS zero_returns,
            AVG((ret < 0)::INT) AS negative_returns, SUM(gross_reward) / SUM(tr::INT) AS break_even_cost_per_trade,
            SUM(0.5e0 * turn * ctd_spread * ctd_contracts) / SUM(tr::INT) AS ctd_cost_per_trade, SUM(0.5e0 * turn * fut_spread * fut_contracts) / SUM(tr::INT) AS fut_cost_per_trade,
            SUM(0.5e0 * turn * (ctd_spread * ctd_contracts + fut_spread * fut_contracts)) / SUM(tr::INT) AS basis_cost_per_trade FROM v GROUP BY seed),
   tm AS (SELECT *, n_steps / n_days AS steps_per_day FROM rm JOIN dm USING (seed))"""


def _metrics(t):
    return R.trade_metrics(R.derive_records(R.drop_reset(t.records)))


@query("trade_metrics", "seed:i " + " ".join(f"{m}:f" for m in METRICS), TRADE_SQL + " SELECT * FROM tm")
def _(t):
    return _metrics(t)


@query("aggregate_seeds", "metric:s mean:f std:f", TRADE_SQL + " " + " UNION ALL ".join(
    f"SELECT '{m}' AS metric, AVG({m}) AS mean, STDDEV_SAMP({m}) AS std FROM tm" for m in METRICS))
def _(t):
    return R.aggregate_seeds(_metrics(t), METRICS)


@query("derive_records", "seed:i episode:i ep:i trade:b turnover:i ctd_cost:f fut_cost:f basis_cost:f profit:b neutral:b loss:b notional:f return:f9", f"""
       SELECT *, position <> allocation AS trade, ABS(position - allocation) AS turnover, 0.5e0 * ABS(position - allocation) * ctd_spread * ctd_contracts AS ctd_cost,
              0.5e0 * ABS(position - allocation) * fut_spread * fut_contracts AS fut_cost,
              0.5e0 * ABS(position - allocation) * (ctd_spread * ctd_contracts + fut_spread * fut_contracts) AS basis_cost,
              position <> allocation AND reward > 0 AS profit, position <> allocation AND reward = 0 AS neutral, position <> allocation AND reward < 0 AS loss,
              {NOT} AS notional, reward / {NOT} AS return FROM records""")
def _(t):
    return R.derive_records(t.records)


@query("cum_pnl_drawdown", "seed:i episode:i ep:i cum_reward:f cum_gross_reward:f cum_cost:f cum_max_reward:f drawdown:f gross_drawdown:f", """
       SELECT *, cum_reward - cum_max_reward AS drawdown, cum_gross_reward - MAX(cum_gross_reward) OVER w AS gross_drawdown FROM (
        SELECT *, MAX(cum_reward) OVER w AS cum_max_reward FROM (
         SELECT *, SUM(reward) OVER w AS cum_reward, SUM(gross_reward) OVER w AS cum_gross_reward, SUM(cost) OVER w AS cum_cost FROM records
         WINDOW w AS (PARTITION BY seed ORDER BY episode, ep ROWS UNBOUNDED PRECEDING)) a
        WINDOW w AS (PARTITION BY seed ORDER BY episode, ep ROWS UNBOUNDED PRECEDING)) b
       WINDOW w AS (PARTITION BY seed ORDER BY episode, ep ROWS UNBOUNDED PRECEDING)""")
def _(t):
    return R.cumulative(t.records)


@query("daily_drawdown", "seed:i d:d cum_pnl:f drawdown:f", """
       SELECT seed, d, cum_pnl, cum_pnl - MAX(cum_pnl) OVER (PARTITION BY seed ORDER BY d) AS drawdown FROM (
        SELECT seed, d, SUM(n) OVER (PARTITION BY seed ORDER BY d) AS cum_pnl FROM (SELECT seed, d, SUM(reward) AS n FROM records GROUP BY seed, d) x) y""")
def _(t):
    return R.daily_drawdown(R.daily_pnl(t.records))


@query("seed_band", "d:d mean:f std:f seeds:i", """
       SELECT d, AVG(n) AS mean, STDDEV_SAMP(n) AS std, COUNT(n) AS seeds FROM (SELECT seed, d, SUM(reward) AS n FROM records GROUP BY seed, d) x GROUP BY d""")
def _(t):
    return R.seed_band(R.daily_pnl(t.records), ["d"], "net_pnl")


@query("action_heatmap", "seed:i d:d minute:i position:i reward_sign:i", """
       SELECT seed, d, ep % 86400 // 60 AS minute, arg_max(position, ep) AS position, SIGN(arg_max(reward, ep)) AS reward_sign FROM records GROUP BY 1, 2, 3""")
def _(t):
    return R.action_heatmap(t.records)


TERM = """SELECT seed, side, episode, MIN(us) AS opening_us, MAX(us) FILTER (terminal) AS us, MAX(action) FILTER (terminal) AS action, MAX(status) FILTER (terminal) AS status,
                 MAX(benchmark_price) FILTER (terminal) AS benchmark_price, MAX(execution_price) FILTER (terminal) AS execution_price,
                 (MAX(us) FILTER (terminal) - MIN(us)) / 1e6 AS execution_seconds FROM exec_records GROUP BY seed, side, episode HAVING COUNT(*) FILTER (terminal) > 0"""


@query("exec_terminal", "seed:i side:s episode:i opening_us:i action:i status:s benchmark_price:f execution_price:f execution_seconds:f", TERM)
def _(t):
    return R.exec_terminal(t.exec_records)


EXEC = ("episodes market limit forced market_pct limit_pct forced_pct limit_fill_rate execution_improvement_mean execution_improvement_median execution_time_mean "
        "execution_time_median passive_quote_distance_mean passive_quote_distance_median").split()
EXEC_SQL = f"""
   WITH m AS (SELECT seed, side, COUNT(*) AS episodes, SUM((status = 'market')::INT) AS market, SUM((status = 'limit')::INT) AS "limit", SUM((status = 'forced')::INT) AS forced,
     AVG((status = 'market')::INT) AS market_pct, AVG((status = 'limit')::INT) AS limit_pct, AVG((status = 'forced')::INT) AS forced_pct,
     SUM((status = 'limit')::INT) / NULLIF(SUM((status <> 'market')::INT), 0) AS limit_fill_rate, AVG(g) AS execution_improvement_mean, quantile_cont(g, 0.5) AS execution_improvement_median,
     AVG(execution_seconds) AS execution_time_mean, quantile_cont(execution_seconds, 0.5) AS execution_time_median,
     AVG(action) FILTER (action > 0) AS passive_quote_distance_mean, quantile_cont(action::DOUBLE, 0.5) FILTER (action > 0) AS passive_quote_distance_median
   FROM (SELECT *, CASE side WHEN 'bid' THEN benchmark_price - execution_price ELSE execution_price - benchmark_price END / 0.01e0 AS g FROM ({TERM}) t) x GROUP BY seed, side)"""


@query("exec_metrics", "seed:i side:s " + " ".join(f"{m}:f" for m in EXEC), EXEC_SQL + " SELECT * FROM m")
def _(t):
    return R.exec_metrics(R.exec_terminal(t.exec_records), 0.01)


@query("exec_summary", "side:s metric:s mean:f std:f", EXEC_SQL + " " + " UNION ALL ".join(
    f"""SELECT side, '{m}' AS metric, AVG("{m}") AS mean, STDDEV_SAMP("{m}") AS std FROM m GROUP BY side""" for m in EXEC))
def _(t):
    return R.aggregate_seeds(R.exec_metrics(R.exec_terminal(t.exec_records), 0.01), EXEC, ["side"])


@query("count_days", "role:s days:i", "SELECT role, COUNT(DISTINCT d) AS days FROM lob GROUP BY role")
def _(t):
    return t.lob.groupBy("role").agg(F.countDistinct("d").alias("days"))


SCORES = "SELECT event_id % 3 AS seed, event_type || '_' || (user_id % 10) AS feature, SUM(value) AS gain FROM events GROUP BY 1, 2"


def _scores(t):
    name = F.concat("event_type", F.lit("_"), F.col("user_id") % 10)
    return t.events.groupBy((F.col("event_id") % 3).alias("seed"), name.alias("feature")).agg(F.sum("value").alias("gain"))


@query("importance_ranking", "feature:s mean:f std:f", f"""
       SELECT feature, AVG(gain) AS mean, COALESCE(STDDEV_SAMP(gain), 0) AS std FROM ({SCORES}) s GROUP BY feature ORDER BY mean DESC, feature LIMIT 12""")
def _(t):
    return M.importance_ranking(_scores(t), "feature", "gain", 12)


@query("rank_matrix", "feature:s mean_rank:f std_rank:f best_rank:i", f"""
       SELECT feature, AVG(rk) AS mean_rank, STDDEV_SAMP(rk) AS std_rank, MIN(rk) AS best_rank FROM (
        SELECT *, ROW_NUMBER() OVER (PARTITION BY seed ORDER BY gain DESC, feature) AS rk FROM ({SCORES}) s) x GROUP BY feature""")
def _(t):
    return M.rank_matrix(_scores(t), "feature", "gain")


@query("selection_curve", "iteration:i mean_train_rmse:f std_train_rmse:f mean_val_rmse:f std_val_rmse:f", """
       WITH h AS (SELECT event_id % 3 AS seed, user_id % 20 AS iteration, AVG(value) AS train_rmse, MAX(value) AS val_rmse FROM events
                  WHERE NOT (event_id % 3 = 1 AND user_id % 20 > 15) GROUP BY 1, 2)
       SELECT iteration, AVG(train_rmse) AS mean_train_rmse, STDDEV_POP(train_rmse) AS std_train_rmse, AVG(val_rmse) AS mean_val_rmse, STDDEV_POP(val_rmse) AS std_val_rmse
       FROM h GROUP BY iteration HAVING COUNT(*) = 3""")
def _(t):
    seed, it = F.col("event_id") % 3, F.col("user_id") % 20
    h = t.events.where(~((seed == 1) & (it > 15))).groupBy(seed.alias("seed"), it.alias("iteration")).agg(
        F.avg("value").alias("train_rmse"), F.max("value").alias("val_rmse"))
    return M.selection_curve(h, ["train_rmse", "val_rmse"])


@query("top_features", "seed:i feature:s gain:f rank:i", f"""
       SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY seed ORDER BY gain DESC, feature) AS rank FROM ({SCORES}) s) x WHERE rank <= 5""")
def _(t):
    return M.top_features(_scores(t), ["seed"], "gain", 5)


@query("topk_features", "feature:s gain:f", f"SELECT feature, SUM(gain) AS gain FROM ({SCORES}) s GROUP BY feature ORDER BY gain DESC, feature LIMIT 7")
def _(t):
    return _scores(t).groupBy("feature").agg(F.sum("gain").alias("gain")).orderBy(F.desc("gain"), "feature").limit(7)

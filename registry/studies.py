"""Profitability studies, limit orders, position and execution replays."""

from pyspark.sql import functions as F

from registry.base import query
from registry.scans import EXCL
from tickloom import schema as S
from tickloom.functions import cross
from tickloom.operators import dates as D
from tickloom.operators import intervals as V
from tickloom.operators import profit as P
from tickloom.plans import dataset as DS
from tickloom.sources.sinks import stage

STEP = 300
GAP = 3600
BONDS = 0.1
KEY = "price_mode:s contract_mode:s volume_mode:s"
CFG = "cfg AS (SELECT * FROM (VALUES " + ", ".join(str(c) for c in P.CONFIGS) + ") v(price_mode, contract_mode, volume_mode))"


def legs_sql(source="market5"):
    return f"""{CFG}, pr AS (SELECT m.d, m.ep, c.*, CASE price_mode WHEN 'mid' THEN (ctd_bid_price + ctd_ask_price) / 2 ELSE ctd_bid_price END AS cb,
        CASE price_mode WHEN 'mid' THEN (ctd_bid_price + ctd_ask_price) / 2 ELSE ctd_ask_price END AS ca,
        CASE price_mode WHEN 'mid' THEN (fut_bid_price + fut_ask_price) / 2 ELSE fut_bid_price END AS fb,
        CASE price_mode WHEN 'mid' THEN (fut_bid_price + fut_ask_price) / 2 ELSE fut_ask_price END AS fa, ctd_bid_size, ctd_ask_size, fut_bid_size, fut_ask_size,
        CASE contract_mode WHEN 'frac' THEN cf * {BONDS}e0 * 20 ELSE round_even(cf * {BONDS}e0 * 20, 0) END AS nf FROM {source} m, cfg c),
      lg AS (SELECT *, volume_mode = 'ignore' OR (ctd_ask_size >= {BONDS}e0 AND fut_bid_size >= nf) AS le, volume_mode = 'ignore' OR (ctd_bid_size >= {BONDS}e0 AND fut_ask_size >= nf) AS se FROM pr)"""


QUOTE = [f"{r}_{x}_{k}" for r in ("ctd", "fut") for k in ("price", "size") for x in ("bid", "ask")]


def horizon_sql(horizons, overnight=False):
    """Every second paired with the second ``horizon`` later; equal pairs of standing quotes are counted as seconds."""
    hz = ", ".join(f"({h})" for h in horizons)
    ok = ""
    if overnight:
        ok = """AND NOT EXISTS (SELECT 1 FROM fut_metadata f WHERE f.last_trading >= a.d AND f.last_trading < a.xd)
                AND NOT EXISTS (SELECT 1 FROM (SELECT d AS s FROM (SELECT d, isin, LAG(isin) OVER (ORDER BY d) AS p FROM daily_cf) v WHERE isin IS DISTINCT FROM p) w WHERE w.s > a.d AND w.s <= a.xd)"""
    now = ", ".join(f"ANY_VALUE(a.{q}) AS {q}" for q in [*QUOTE, "cf"])
    then = ", ".join(f"ANY_VALUE(b.{q}) AS x_{q}" for q in [*QUOTE, "cf"])

    def price(q, prefix=""):
        role = q[:3]
        return f"CASE price_mode WHEN 'mid' THEN ({prefix}{role}_bid_price + {prefix}{role}_ask_price) / 2 ELSE {prefix}{q} END"

    def futures(prefix=""):
        return f"CASE contract_mode WHEN 'frac' THEN {prefix}cf * {BONDS}e0 * 20 ELSE round_even({prefix}cf * {BONDS}e0 * 20, 0) END"

    def allowed(x, y, prefix=""):
        return f"(volume_mode = 'ignore' OR ({prefix}ctd_{x}_size >= {BONDS}e0 AND {prefix}fut_{y}_size >= {futures(prefix)}))"

    long = f"{BONDS}e0 * 2000000 * ({price('ctd_bid_price', 'x_')} - {price('ctd_ask_price')}) / 100 + {futures()} * 100000 * ({price('fut_bid_price')} - {price('fut_ask_price', 'x_')}) / 100"
    short = f"{BONDS}e0 * 2000000 * ({price('ctd_bid_price')} - {price('ctd_ask_price', 'x_')}) / 100 + {futures()} * 100000 * ({price('fut_bid_price', 'x_')} - {price('fut_ask_price')}) / 100"
    return f"""{CFG}, jn AS (SELECT h.horizon, a.d, MIN(a.ep) AS ep, COUNT(*) AS seconds, ANY_VALUE(make_date(1970, 1, 1) + ((a.ep + h.horizon) // 86400)::INT) AS xd, b.cep IS NOT NULL AS there, {now}, {then}
          FROM market1 a CROSS JOIN (VALUES {hz}) h(horizon) LEFT JOIN market1 b ON b.ep = a.ep + h.horizon GROUP BY h.horizon, a.d, a.cep, a.fep, b.cep, b.fep, (a.ep + h.horizon) // 86400),
        fh AS (SELECT c.*, horizon, d, ep, seconds, there, 'long' AS direction, CASE WHEN there AND {allowed("ask", "bid")} AND {allowed("ask", "bid", "x_")} {ok} THEN {long} END AS pnl FROM jn a, cfg c UNION ALL
               SELECT c.*, horizon, d, ep, seconds, there, 'short', CASE WHEN there AND {allowed("bid", "ask")} AND {allowed("bid", "ask", "x_")} {ok} THEN {short} END FROM jn a, cfg c)"""


def _names(configs=P.CONFIGS):
    return [(c, x, "_".join((*c, x))) for c in configs for x in ("long", "short")]


def _wide(pnl):
    """A row per piece with an exit, a column per configuration and direction."""
    cells = [F.max(F.when((F.concat_ws("_", *P.CONFIG_COLUMNS, "direction") == n), F.col("pnl"))).alias(n) for _, _, n in _names()]
    return pnl.where("there").groupBy("horizon", "d", "ep", "seconds").agg(*cells)


WIDE_OUT = "horizon:i d:d ep:i seconds:i " + " ".join(f"{n}:f4" for _, _, n in _names())
WIDE_SQL = "SELECT horizon, d, ep, seconds, " + ", ".join(
    f"MAX(pnl) FILTER (price_mode = '{c[0]}' AND contract_mode = '{c[1]}' AND volume_mode = '{c[2]}' AND direction = '{x}') AS {n}" for c, x, n in _names()) + " FROM fh WHERE there GROUP BY ALL"


def _seconds(t, horizons=P.HORIZONS):
    """PnL of all configurations second by second; ``there`` marks pieces with an exit."""
    pieces = V.horizon_pieces(t.market1, horizons, [*V.QUOTES, "cf"]).withColumn("there", F.col("x_ctd_bid_price").isNotNull())
    return P.pair_pnl(pieces, ["horizon", "d", "ep", "until", "seconds", "exit_ep", "there"], P.CONFIGS, BONDS)


def _valid(t, horizons=P.HORIZONS):
    rolls = t.fut_metadata.select(F.col("last_trading").alias("d"))
    switches = D.switch_dates(t.daily_cf).select("d")
    return P.invalidate_overnight(_seconds(t, horizons), rolls, switches)


@query("scan_market", f"d:d ep:i until:i {' '.join(f'{q}:f' for q in QUOTE)} cf:f isin:s", f"""SELECT d, MIN(ep) AS ep, MAX(ep) + 1 AS until, {", ".join(f"ANY_VALUE({q}) AS {q}" for q in [*QUOTE, "cf", "isin"])}
       FROM market1 WHERE d NOT IN ({EXCL}) GROUP BY d, cep, fep""")
def _(t):
    """The one-second market as intervals of standing quotes, without the excluded dates."""
    return D.drop_dates(t.market1, D.excluded_dates(t.excluded_raw))


@query("fixed_horizon", WIDE_OUT, f"WITH {horizon_sql(P.HORIZONS)} {WIDE_SQL}")
def _(t):
    return _wide(_seconds(t))


@query("invalidate_overnight", WIDE_OUT, f"WITH {horizon_sql(P.HORIZONS[-5:], True)} {WIDE_SQL}")
def _(t):
    return _wide(_valid(t, P.HORIZONS[-5:]))


HKEYS = ["price_mode", "contract_mode", "volume_mode", "horizon", "direction"]
HK = ", ".join(HKEYS)
SUMMARY = ("n_days trading_days total_pnl mean_pnl median_pnl std_pnl max_pnl min_pnl profitable_observations profitable_observations_pct profitable_observations_per_day "
           "profitable_total_pnl profitable_pnl_per_day profitable_mean_pnl profitable_median_pnl profitable_std_pnl profitable_max_pnl profitable_min_pnl profitable_episodes "
           "profitable_episodes_pct profitable_episodes_per_day episode_total_pnl episode_mean_pnl episode_median_pnl episode_std_pnl episode_max_pnl episode_min_pnl "
           "mean_episode_length median_episode_length max_episode_length min_episode_length").split()


def runs_sql(gap):
    return f"""rn AS (SELECT *, ep - LAG(ep + seconds - 1) OVER w > {gap} AS nw FROM fh WHERE pnl > 0 WINDOW w AS (PARTITION BY {HK} ORDER BY ep)),
      gr AS (SELECT *, SUM(CASE WHEN nw THEN 1 ELSE 0 END) OVER (PARTITION BY {HK} ORDER BY ep) AS g FROM rn),
      epi AS (SELECT {HK}, g, MIN(ep) AS first_ep, MAX(ep + seconds - 1) AS last_ep, SUM(seconds) AS length, SUM(pnl * seconds) / SUM(seconds) AS mean_pnl FROM gr GROUP BY {HK}, g)"""


def median_sql(name, cond):
    """Median of pnl over seconds: values in order with the seconds up to each."""
    return f"""{name} AS (SELECT {HK}, (MIN(pnl) FILTER (upto > (n - 1) // 2) + MIN(pnl) FILTER (upto > n // 2)) / 2 AS median FROM (SELECT {HK}, pnl, SUM(seconds) OVER (PARTITION BY {HK} ORDER BY pnl) AS upto, SUM(seconds) OVER (PARTITION BY {HK}) AS n
       FROM fh WHERE {cond}) z GROUP BY {HK})"""


def summary_sql(horizons, gap, overnight):
    std = "SQRT(GREATEST((SUM(pnl * pnl * seconds){f} - POW(SUM(pnl * seconds){f}, 2) / SUM(seconds){f}) / (SUM(seconds){f} - 1), 0))"
    good = " FILTER (pnl > 0)"
    return f"""WITH {horizon_sql(horizons, overnight)}, {runs_sql(gap)}, {median_sql("md", "pnl IS NOT NULL")}, {median_sql("mg", "pnl > 0")},
     b AS (SELECT {HK}, COUNT(DISTINCT d) FILTER (pnl IS NOT NULL) AS n_days, COUNT(DISTINCT d) AS trading_days, COALESCE(SUM(seconds) FILTER (pnl IS NOT NULL), 0) AS valid, COALESCE(SUM(pnl * seconds), 0) AS total_pnl,
       SUM(pnl * seconds) / SUM(seconds) FILTER (pnl IS NOT NULL) AS mean_pnl, CASE WHEN SUM(seconds) FILTER (pnl IS NOT NULL) > 1 THEN {std.format(f=" FILTER (pnl IS NOT NULL)")} END AS std_pnl, MAX(pnl) AS max_pnl, MIN(pnl) AS min_pnl,
       COALESCE(SUM(seconds){good}, 0) AS profitable_observations, COALESCE(SUM(pnl * seconds){good}, 0) AS profitable_total_pnl, SUM(pnl * seconds){good} / SUM(seconds){good} AS profitable_mean_pnl,
       CASE WHEN SUM(seconds){good} > 1 THEN {std.format(f=good)} END AS profitable_std_pnl, MAX(pnl){good} AS profitable_max_pnl, MIN(pnl){good} AS profitable_min_pnl FROM fh GROUP BY {HK}),
     e AS (SELECT {HK}, COUNT(*) AS k, SUM(mean_pnl) AS episode_total_pnl, AVG(mean_pnl) AS episode_mean_pnl, quantile_cont(mean_pnl, 0.5) AS episode_median_pnl, STDDEV_SAMP(mean_pnl) AS episode_std_pnl,
       MAX(mean_pnl) AS episode_max_pnl, MIN(mean_pnl) AS episode_min_pnl, AVG(length) AS mean_episode_length, quantile_cont(length::DOUBLE, 0.5) AS median_episode_length,
       MAX(length) AS max_episode_length, MIN(length) AS min_episode_length FROM epi GROUP BY {HK})
     SELECT b.*, e.* EXCLUDE ({HK}, k, episode_total_pnl), md.median AS median_pnl, mg.median AS profitable_median_pnl, COALESCE(episode_total_pnl, 0) AS episode_total_pnl, COALESCE(k, 0) AS profitable_episodes,
       profitable_observations * 100e0 / NULLIF(valid, 0) AS profitable_observations_pct, COALESCE(k, 0) * 100e0 / NULLIF(profitable_observations, 0) AS profitable_episodes_pct,
       COALESCE(k, 0) / NULLIF(n_days, 0) AS profitable_episodes_per_day, profitable_observations / NULLIF(n_days, 0) AS profitable_observations_per_day,
       profitable_total_pnl / NULLIF(n_days, 0) AS profitable_pnl_per_day FROM b LEFT JOIN e USING ({HK}) LEFT JOIN md USING ({HK}) LEFT JOIN mg USING ({HK})"""


SUMMARY_OUT = f"{KEY} horizon:i direction:s " + " ".join(f"{m}:f4" for m in SUMMARY)
TOLERANCE = 60


@query("run_fixed_horizon", SUMMARY_OUT, summary_sql(P.HORIZONS, 1 + TOLERANCE, True))
def _(t):
    """The whole study: every configuration, horizon and direction, trades over rollovers left out."""
    return P.summarize_horizon(_valid(t), HKEYS, 1, TOLERANCE)


@query("profitable_episodes", f"{KEY} horizon:i direction:s first_ep:i last_ep:i length:i mean_pnl:f4", f"WITH {horizon_sql(P.HORIZONS)}, {runs_sql(1 + TOLERANCE)} SELECT * FROM epi")
def _(t):
    return P.profitable_episodes(_seconds(t), HKEYS, 1, TOLERANCE)


@query("summarize_horizon", SUMMARY_OUT, summary_sql(P.HORIZONS, 1, False))
def _(t):
    return P.summarize_horizon(_seconds(t), HKEYS, 1)


def profit_sql(profits):
    pr = ", ".join(f"({p}e0)" for p in profits)
    return f"""
     WITH day AS (SELECT * FROM market5 WHERE ep % 86400 BETWEEN 32400 AND 61200), {legs_sql('day')},
     ss AS (SELECT ep, SUM(CASE WHEN nw THEN 1 ELSE 0 END) OVER (ORDER BY ep) AS s FROM (SELECT ep, ep - LAG(ep) OVER (ORDER BY ep) > {GAP} AS nw FROM day) q),
     mk AS (SELECT l.price_mode, l.contract_mode, l.volume_mode, l.d, l.ep, s, 'long' AS direction, {BONDS}e0 * 20000 * cb - nf * 1000 * fa AS mark, nf * 1000 * fb - {BONDS}e0 * 20000 * ca AS cash,
              le AS entry_ok, volume_mode = 'ignore' OR (ctd_bid_size >= {BONDS}e0 AND fut_ask_size >= nf) AS exit_ok FROM lg l JOIN ss ON ss.ep = l.ep UNION ALL
            SELECT l.price_mode, l.contract_mode, l.volume_mode, l.d, l.ep, s, 'short', nf * 1000 * fb - {BONDS}e0 * 20000 * ca, {BONDS}e0 * 20000 * cb - nf * 1000 * fa,
              se, volume_mode = 'ignore' OR (ctd_ask_size >= {BONDS}e0 AND fut_bid_size >= nf) FROM lg l JOIN ss ON ss.ep = l.ep),
     ht AS (SELECT a.price_mode, a.contract_mode, a.volume_mode, a.direction, p.profit, a.ep, MIN(b.ep) AS hit_ep FROM mk a CROSS JOIN (VALUES {pr}) p(profit)
            JOIN mk b ON b.s = a.s AND b.ep > a.ep AND b.price_mode = a.price_mode AND b.contract_mode = a.contract_mode AND b.volume_mode = a.volume_mode AND b.direction = a.direction
             AND b.exit_ok AND b.mark + a.cash >= p.profit WHERE a.entry_ok GROUP BY ALL),
     fp AS (SELECT a.price_mode, a.contract_mode, a.volume_mode, a.d, a.direction, p.profit, a.ep, a.entry_ok AS allowed, h.hit_ep IS NOT NULL AS hit, (h.hit_ep - a.ep)::DOUBLE AS seconds,
              CASE WHEN h.hit_ep IS NOT NULL THEN GREATEST(0, -(a.cash + (SELECT MIN(b.mark) FROM mk b WHERE b.s = a.s AND b.ep > a.ep AND b.ep <= h.hit_ep AND b.price_mode = a.price_mode
                AND b.contract_mode = a.contract_mode AND b.volume_mode = a.volume_mode AND b.direction = a.direction))) END AS mae
            FROM mk a CROSS JOIN (VALUES {pr}) p(profit) LEFT JOIN ht h ON h.price_mode = a.price_mode AND h.contract_mode = a.contract_mode AND h.volume_mode = a.volume_mode
             AND h.direction = a.direction AND h.profit = p.profit AND h.ep = a.ep)"""


def _in_hours(t):
    return D.filter_time(t.market5, S.WINDOW_OPEN, S.WINDOW_CLOSE)


@query("fixed_profit", f"{KEY} direction:s profit:f ep:i hit:b seconds:f mae:f4", profit_sql(P.PROFITS) + " SELECT * FROM fp")
def _(t):
    return P.fixed_profit(_in_hours(t), P.PROFITS, GAP, P.CONFIGS, BONDS)


PK = [*P.CONFIG_COLUMNS, "profit", "direction"]
PKS = ", ".join(PK)


@query("run_fixed_profit", f"{KEY} profit:f direction:s rows:i hits:i seconds:f mae:f3", profit_sql(P.PROFITS) + f"""
     SELECT {PKS}, COUNT(*) AS rows, SUM(hit::INT) AS hits, SUM(seconds) AS seconds, SUM(mae) AS mae FROM fp GROUP BY {PKS}""")
def _(t):
    found = P.fixed_profit(_in_hours(t), P.PROFITS, GAP, P.CONFIGS, BONDS)
    return found.groupBy(*PK).agg(F.count("*").alias("rows"), F.count_if("hit").alias("hits"), F.sum("seconds").alias("seconds"), F.sum("mae").alias("mae"))


PSUM = ("candidate_entries profit_hits profit_hit_pct profit_hits_per_day mean_time_to_profit median_time_to_profit max_time_to_profit mean_mae median_mae max_mae").split()


@query("summarize_profit", f"{KEY} profit:f direction:s " + " ".join(f"{m}:f3" for m in PSUM), profit_sql(P.PROFITS) + f"""
     SELECT {PKS}, SUM(allowed::INT) AS candidate_entries, SUM(hit::INT) AS profit_hits, SUM(hit::INT) * 100e0 / NULLIF(SUM(allowed::INT), 0) AS profit_hit_pct,
       SUM(hit::INT) / COUNT(DISTINCT d) AS profit_hits_per_day, AVG(seconds) AS mean_time_to_profit, quantile_cont(seconds, 0.5) AS median_time_to_profit, MAX(seconds) AS max_time_to_profit,
       AVG(mae) AS mean_mae, quantile_cont(mae, 0.5) AS median_mae, MAX(mae) AS max_mae FROM fp GROUP BY {PKS}""")
def _(t):
    return P.summarize_profit(P.fixed_profit(_in_hours(t), P.PROFITS, GAP, P.CONFIGS, BONDS), PK)


EURO = """mn AS (SELECT d, ep, (ctd_bid_price + ctd_ask_price) / 2 * 20000 AS ctd_mid, (fut_bid_price + fut_ask_price) / 2 * round_even(cf * 20, 0) * 1000 AS fut_mid,
      (ctd_ask_price - ctd_bid_price) * 20000 AS ctd_spread, (fut_ask_price - fut_bid_price) * round_even(cf * 20, 0) * 1000 AS fut_spread FROM market5),
      mb AS (SELECT *, ctd_mid - fut_mid AS basis_mid, ctd_spread + fut_spread AS basis_spread FROM mn)"""


@query("minmax", "ep:i ctd_mid:f2 fut_mid:f2 ctd_spread:f2 fut_spread:f2 basis_mid:f2 basis_spread:f2", f"WITH {EURO} SELECT * FROM mb")
def _(t):
    return P.euro_market(t.market5)


NAMES = ["basis_mid", "ctd_mid", "fut_mid", "ctd_spread", "fut_spread", "basis_spread"]
MM = f"""WITH {EURO}, pp AS (SELECT *, (SELECT MIN(d) FROM mb) + (((d - (SELECT MIN(d) FROM mb)) // 3) * 3)::INT AS period FROM mb),
     rk AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY period ORDER BY basis_mid, ep) AS lo, ROW_NUMBER() OVER (PARTITION BY period ORDER BY basis_mid DESC, ep) AS hi FROM pp),
     od AS (SELECT period, MIN(d) AS opening_date, MAX(d) AS closing_date FROM pp GROUP BY period),
     mm AS (SELECT od.*, a.ep AS min_time, b.ep AS max_time, CASE WHEN a.ep < b.ep THEN 'long' ELSE 'short' END AS direction, LEAST(a.ep, b.ep) AS entry_time, GREATEST(a.ep, b.ep) AS exit_time,
       ABS(a.ep - b.ep) AS holding_time, """ + ", ".join(f"ROUND(a.{n}, 2) AS min_{n}, ROUND(b.{n}, 2) AS max_{n}" for n in NAMES) + """,
       ROUND(CASE WHEN a.ep < b.ep THEN a.basis_mid ELSE b.basis_mid END, 2) AS entry_basis, ROUND(CASE WHEN a.ep < b.ep THEN b.basis_mid ELSE a.basis_mid END, 2) AS exit_basis,
       ROUND(ABS(b.basis_mid - a.basis_mid), 2) AS gross_pnl, ROUND((a.basis_spread + b.basis_spread) / 2, 2) AS cost,
       ROUND(ABS(b.basis_mid - a.basis_mid) - (a.basis_spread + b.basis_spread) / 2, 2) AS net_pnl
       FROM od JOIN rk a ON a.period = od.period AND a.lo = 1 JOIN rk b ON b.period = od.period AND b.hi = 1 WHERE a.ep <> b.ep)"""
MONEY = [f"{m}_{n}" for n in NAMES for m in ("min", "max")] + ["entry_basis", "exit_basis", "gross_pnl", "cost", "net_pnl"]


@query("minmax_period", "period:d opening_date:d closing_date:d min_time:i max_time:i direction:s entry_time:i exit_time:i holding_time:i " + " ".join(f"{m}:f2" for m in MONEY), MM + " SELECT * FROM mm")
def _(t):
    return P.minmax_period(P.euro_market(t.market5), 3)


MSUM = [f"{a}_{b}" for b in ("gross_pnl", "cost", "net_pnl") for a in ("total", "mean")]


@query("minmax_summary", "part:s periods:i " + " ".join(f"{m}:f2" for m in MSUM) + " long_trades:i short_trades:i long_pct:f short_pct:f", MM + " " + """
     SELECT part, COUNT(*) AS periods, SUM(gross_pnl) AS total_gross_pnl, AVG(gross_pnl) AS mean_gross_pnl, SUM(cost) AS total_cost, AVG(cost) AS mean_cost, SUM(net_pnl) AS total_net_pnl,
       AVG(net_pnl) AS mean_net_pnl, SUM((direction = 'long')::INT) AS long_trades, SUM((direction = 'short')::INT) AS short_trades, AVG((direction = 'long')::INT) * 100 AS long_pct,
       AVG((direction = 'short')::INT) * 100 AS short_pct FROM (SELECT 'overall' AS part, * FROM mm UNION ALL SELECT 'net_gain', * FROM mm WHERE net_pnl > 0) u GROUP BY part""")
def _(t):
    return P.minmax_summary(P.minmax_period(P.euro_market(t.market5), 3))


LEG = ["ctd_mid", "ctd_spread", "fut_mid", "fut_spread"]
TRADES = """rr AS (SELECT *, CASE WHEN position IS DISTINCT FROM LAG(position) OVER w THEN 1 ELSE 0 END AS mv FROM records WINDOW w AS (PARTITION BY seed, episode ORDER BY ep)),
     tr AS (SELECT o.seed, o.episode, o.ep AS opening_time, o.position AS direction, o.ctd_contracts, o.fut_contracts, """ + ", ".join(f"o.{c} AS {c}_opening" for c in LEG) + """,
       (SELECT MIN(q.ep) FROM records q WHERE q.seed = o.seed AND q.episode = o.episode AND q.ep > o.ep AND q.position <> o.position) AS closing_time FROM records o
       WHERE o.position <> 0 AND o.position <> o.allocation),
     tc AS (SELECT tr.*, """ + ", ".join(f"c.{c} AS {c}_closing" for c in LEG) + """, (SELECT MAX(q.ep) FROM records q WHERE q.seed = tr.seed AND q.episode = tr.episode AND q.ep >= tr.closing_time AND q.ep <
         COALESCE((SELECT MIN(z.ep) FROM records z WHERE z.seed = tr.seed AND z.episode = tr.episode AND z.ep > tr.closing_time AND z.position <> c.position), 99999999999)) AS stopping_time
       FROM tr JOIN records c ON c.seed = tr.seed AND c.episode = tr.episode AND c.ep = tr.closing_time),
     tp AS (SELECT *, direction * ((ctd_mid_closing * ctd_contracts - fut_mid_closing * fut_contracts) - (ctd_mid_opening * ctd_contracts - fut_mid_opening * fut_contracts)) AS gross_pnl,
       (ctd_spread_opening * ctd_contracts + fut_spread_opening * fut_contracts) / 2 AS cost_opening, (ctd_spread_closing * ctd_contracts + fut_spread_closing * fut_contracts) / 2 AS cost_closing FROM tc)"""
TRADE_COLS = "seed:i episode:i opening_time:i closing_time:i stopping_time:i direction:i ctd_contracts:f fut_contracts:f"


@query("trades_from_records", TRADE_COLS + " " + " ".join(f"{c}_{e}:f" for c in LEG for e in ("opening", "closing")), f"WITH {TRADES} SELECT * FROM tc")
def _(t):
    return P.trades_from_records(t.records)


@query("original_trade_pnl", TRADE_COLS + " cost_opening:f cost_closing:f gross_pnl:f net_pnl:f", f"WITH {TRADES} SELECT *, gross_pnl - (cost_opening + cost_closing) AS net_pnl FROM tp")
def _(t):
    return P.original_trade_pnl(P.trades_from_records(t.records))


LIMIT = TRADES + """,
     mk AS (SELECT d, ep, ctd_bid_price AS bid, ctd_ask_price AS ask, (fut_bid_price + fut_ask_price) / 2 AS fut_mid, fut_ask_price - fut_bid_price AS fut_spread FROM market5),
     h AS (SELECT tp.*, (SELECT MIN(q.ep) FROM mk q WHERE q.ep BETWEEN opening_time AND closing_time AND CASE direction WHEN 1 THEN q.ask <= ctd_mid_opening ELSE q.bid >= ctd_mid_opening END) AS opening_hit_time,
       (SELECT MIN(q.ep) FROM mk q WHERE q.ep BETWEEN closing_time AND stopping_time AND CASE direction WHEN -1 THEN q.ask <= ctd_mid_closing ELSE q.bid >= ctd_mid_closing END) AS closing_hit_time FROM tp),
     l AS (SELECT h.*, opening_hit_time IS NOT NULL AND closing_hit_time IS NOT NULL AS limit_trade_feasible, opening_hit_time - opening_time AS opening_time_to_hit,
       closing_hit_time - closing_time AS closing_time_to_hit, a.fut_mid AS fo, a.fut_spread AS so, b.fut_mid AS fc, b.fut_spread AS sc FROM h LEFT JOIN mk a ON a.ep = opening_hit_time LEFT JOIN mk b ON b.ep = closing_hit_time),
     lp AS (SELECT *, CASE WHEN limit_trade_feasible THEN direction * ((ctd_mid_closing * ctd_contracts - fc * fut_contracts) - (ctd_mid_opening * ctd_contracts - fo * fut_contracts)) END AS gross_pnl_limit,
       CASE WHEN limit_trade_feasible THEN so * fut_contracts / 2 END AS cost_opening_limit, CASE WHEN limit_trade_feasible THEN sc * fut_contracts / 2 END AS cost_closing_limit FROM l)"""


def _limits(t):
    market = t.market5.select("ep", F.col("ctd_bid_price").alias("bid"), F.col("ctd_ask_price").alias("ask"), cross.mid("fut").alias("fut_mid"),
                              (F.col("fut_ask_price") - F.col("fut_bid_price")).alias("fut_spread"))
    return P.limit_order_analysis(P.trades_from_records(t.records), market)


@query("limit_trade_pnl", "seed:i episode:i opening_time:i cost_opening_limit:f cost_closing_limit:f gross_pnl_limit:f net_pnl_limit:f",
       f"WITH {LIMIT} SELECT *, gross_pnl_limit - (cost_opening_limit + cost_closing_limit) AS net_pnl_limit FROM lp WHERE limit_trade_feasible")
def _(t):
    return _limits(t).where("limit_trade_feasible")


@query("limit_order_analysis", TRADE_COLS + " ctd_mid_opening:f ctd_mid_closing:f opening_hit_time:i closing_hit_time:i opening_time_to_hit:i closing_time_to_hit:i opening_limit_hit:b "
       "closing_limit_hit:b limit_trade_feasible:b gross_pnl:f net_pnl:f gross_pnl_limit:f net_pnl_limit:f",
       f"""WITH {LIMIT} SELECT *, opening_hit_time IS NOT NULL AS opening_limit_hit, closing_hit_time IS NOT NULL AS closing_limit_hit, gross_pnl - (cost_opening + cost_closing) AS net_pnl,
       gross_pnl_limit - (cost_opening_limit + cost_closing_limit) AS net_pnl_limit FROM lp""")
def _(t):
    return _limits(t)


DEC = """dc AS (SELECT m.* FROM mb m JOIN (SELECT d, MIN(ep) AS a, MAX(ep) AS z FROM mb GROUP BY d) x ON x.d = m.d WHERE (m.ep - a - 300) % 900 = 0 AND m.ep - a >= 300 AND m.ep < z)"""


@query("decision_grid", "d:d ep:i", f"WITH {EURO}, {DEC} SELECT d, ep FROM dc")
def _(t):
    return P.decision_grid(P.euro_market(t.market5), 900, 300)


@query("backtest_positions", "d:d ep:i next_ep:i allocation:i position:i gross_reward:f2 cost:f2 reward:f2", f"""
     WITH {EURO}, {DEC}, en AS (SELECT d, MAX(ep) AS z FROM mb GROUP BY d),
     ps AS (SELECT dc.*, LEAD(dc.ep) OVER w AS nx, z, CASE WHEN LEAD(dc.ep) OVER w IS NULL THEN 0 ELSE dc.ep // 900 % 3 - 1 END AS position FROM dc JOIN en ON en.d = dc.d WINDOW w AS (PARTITION BY dc.d ORDER BY dc.ep)),
     al AS (SELECT *, COALESCE(LAG(position) OVER (PARTITION BY d ORDER BY ep), 0) AS allocation, COALESCE(nx, z) AS next_ep FROM ps),
     rw AS (SELECT a.d, a.ep, next_ep, allocation, position, position * (m.basis_mid - a.basis_mid) AS gross_reward, 0.5e0 * a.basis_spread * ABS(position - allocation) AS cost FROM al a JOIN mb m ON m.ep = next_ep)
     SELECT *, gross_reward - cost AS reward FROM rw""")
def _(t):
    money = P.euro_market(t.market5)
    grid = P.decision_grid(money, 900, 300).select("d", "ep", (F.floor(F.col("ep") / 900) % 3 - 1).cast("int").alias("position"))
    return P.backtest_positions(grid, money)


@query("encode_position", "seed:i episode:i ep:i position_short:i position_flat:i position_long:i", """
     SELECT seed, episode, ep, (position = -1)::INT AS position_short, (position = 0)::INT AS position_flat, (position = 1)::INT AS position_long FROM records""")
def _(t):
    return t.records.select("seed", "episode", "ep", *[c.alias(n) for n, c in P.encode_position("position", "ohe").items()])


@query("benchmark_distance", "seed:i episode:i step:i distance:f steps_remaining:i", """
     SELECT seed, episode, step, CASE side WHEN 'bid' THEN benchmark_price - execution_price ELSE execution_price - benchmark_price END / 0.01e0 AS distance, 3 - step AS steps_remaining
     FROM exec_records""")
def _(t):
    return t.exec_records.withColumns({"distance": D.benchmark_distance("benchmark_price", "execution_price", "side", 0.01), "steps_remaining": 3 - F.col("step")})


@query("baseline_policies", "policy:s d:d gross:f2", f"""WITH {EURO}, {DEC}, ps AS (SELECT dc.*, LEAD(dc.ep) OVER w AS nx FROM dc WINDOW w AS (PARTITION BY d ORDER BY ep))
     SELECT policy, ps.d, SUM(CASE policy WHEN 'long' THEN 1 WHEN 'short' THEN -1 ELSE 0 END * COALESCE(m.basis_mid - ps.basis_mid, 0)) AS gross
     FROM ps LEFT JOIN mb m ON m.ep = ps.nx CROSS JOIN (VALUES ('long'), ('flat'), ('short')) v(policy) GROUP BY 1, 2""")
def _(t):
    money = P.euro_market(t.market5)
    grid = P.decision_grid(money, 900, 300).select("d", "ep")
    out = None
    for name in ("long", "flat", "short"):
        r = P.backtest_positions(grid.withColumn("position", P.policy(name)), money, quoted=False)
        one = r.groupBy("d").agg(F.sum("gross_reward").alias("gross")).withColumn("policy", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


@query("random_policy", "d:d ep:i position:i reward:f2", f"""
     WITH {EURO}, {DEC}, en AS (SELECT d, MAX(ep) AS z FROM mb GROUP BY d),
     ps AS (SELECT dc.*, LEAD(dc.ep) OVER w AS nx, z, CASE WHEN LEAD(dc.ep) OVER w IS NULL THEN 0 ELSE ('0x' || substr(md5('42:' || dc.ep), 1, 8))::BIGINT % 3 - 1 END AS position
            FROM dc JOIN en ON en.d = dc.d WINDOW w AS (PARTITION BY dc.d ORDER BY dc.ep)),
     al AS (SELECT *, COALESCE(LAG(position) OVER (PARTITION BY d ORDER BY ep), 0) AS allocation, COALESCE(nx, z) AS next_ep FROM ps)
     SELECT a.d, a.ep, position, position * (m.basis_mid - a.basis_mid) - 0.5e0 * a.basis_spread * ABS(position - allocation) AS reward FROM al a JOIN mb m ON m.ep = next_ep""")
def _(t):
    money = P.euro_market(t.market5)
    grid = P.decision_grid(money, 900, 300).select("d", "ep", P.policy("random").alias("position"))
    return P.backtest_positions(grid, money)


QT = "qt AS (SELECT d, ep, l1_bid_price AS bid, l1_ask_price AS ask FROM grid5 WHERE role = 'ctd')"
WIN = """wn AS (SELECT d, unnest(generate_series(a, z - 3600, 3600)) AS opening_time FROM (SELECT d, MIN(ep) AS a, MAX(ep) AS z FROM qt GROUP BY d) x WHERE z - a >= 3600)"""


@query("execution_windows", "d:d opening_time:i closing_time:i", f"WITH {QT}, {WIN} SELECT *, opening_time + 3600 AS closing_time FROM wn")
def _(t):
    return P.execution_windows(t.grid5.where("role = 'ctd'"), 3600)


@query("random_openings", "d:d opening_time:i closing_time:i", f"""WITH {QT} SELECT q.d, ep AS opening_time, ep + 3600 AS closing_time FROM qt q
     JOIN (SELECT d, MAX(ep) AS z FROM qt GROUP BY d) x ON x.d = q.d WHERE ep <= z - 3600""")
def _(t):
    return P.random_openings(t.grid5.where("role = 'ctd'"), 3600)


def outcome_sql(side, k):
    px, sg, op = ("ask", 1, "<=") if side == "bid" else ("bid", -1, ">=")
    lim = f"(p.{px} - {sg} * {k} * 0.01e0)"
    return f"""SELECT '{side}' AS side, {k} AS ticks, w.opening_time, w.b AS benchmark_price, CASE WHEN f.h IS NULL THEN 'forced' ELSE 'limit' END AS status, COALESCE(f.h, w.opening_time + 3600) AS execution_time,
        e.{px} AS execution_price, f.lim AS limit_price, round_even({sg} * (w.b - COALESCE(f.lim, e.{px})) / 0.01e0, 0) AS improvement
      FROM (SELECT wn.opening_time, qt.{px} AS b FROM wn JOIN qt ON qt.ep = wn.opening_time) w LEFT JOIN (
        SELECT opening_time, arg_min(h, st) AS h, arg_min(lim, st) AS lim FROM (SELECT s.opening_time, s.st, {lim} AS lim, MIN(q.ep) AS h FROM (SELECT opening_time, unnest(generate_series(opening_time, opening_time + 2700, 900)) AS st FROM wn) s
          JOIN qt p ON p.ep = s.st JOIN qt q ON q.ep >= s.st AND q.ep < s.st + 900 AND q.{px} {op} {lim} GROUP BY ALL) y GROUP BY opening_time) f ON f.opening_time = w.opening_time
      LEFT JOIN qt e ON e.ep = COALESCE(f.h, w.opening_time + 3600)"""


@query("execution_outcome", "side:s ticks:i opening_time:i benchmark_price:f status:s execution_time:i execution_price:f limit_price:f improvement:i",
       f"WITH {QT}, {WIN} " + " UNION ALL ".join(outcome_sql(s, k) for s in ("bid", "ask") for k in (1, 4)) + """ UNION ALL
       SELECT 'bid', 0, opening_time, ask, 'market', opening_time, ask, NULL, 0 FROM wn JOIN qt ON qt.ep = wn.opening_time""")
def _(t):
    q = t.grid5.where("role = 'ctd'").select("d", "ep", F.col("l1_bid_price").alias("bid"), F.col("l1_ask_price").alias("ask"))
    q = stage(q)
    windows, packed = P.execution_windows(q, 3600), P.pack_quotes(q)
    out = None
    for side, ticks in (("bid", 1), ("bid", 4), ("ask", 1), ("ask", 4), ("bid", 0)):
        one = P.execution_outcome(windows, q.drop("d"), packed, side, ticks, 900, 0.01).select(
            F.lit(side).alias("side"), F.lit(ticks).alias("ticks"), "opening_time", "benchmark_price", "status", "execution_time", "execution_price", "limit_price", "improvement")
        out = one if out is None else out.unionByName(one)
    return out


SET = ["basis", "basis_lag_2s", "basis_delta_2s", "ctd_obi_1", "hour_of_day"]


@query("build_dataset", "d:d ep:i basis:f basis_lag_2s:f basis_delta_2s:f ctd_obi_1:f hour_of_day:i ctd_mid_price:f fut_spread:f ctd_bid:f ctd_ask:f fut_bid:f fut_ask:f fut_contracts:i", """
     WITH e AS (SELECT * FROM wide5 WHERE ep % 86400 BETWEEN 31200 AND 61200), x AS (SELECT d, ep, basis, LAG(basis, 2) OVER w AS basis_lag_2s, basis - LAG(basis, 2) OVER w AS basis_delta_2s, ctd_obi_1, ep % 86400 // 3600 AS hour_of_day, ctd_mid_price, fut_mid_price,
       ctd_spread, fut_spread, cf FROM e WINDOW w AS (PARTITION BY d ORDER BY ep)), y AS (SELECT * FROM x WHERE ep % 86400 BETWEEN 32400 AND 61200),
     f AS (SELECT d, ep, cf, """ + ", ".join(f"LAST_VALUE({c} IGNORE NULLS) OVER w AS {c}" for c in ("basis", "basis_lag_2s", "basis_delta_2s", "ctd_obi_1", "hour_of_day", "ctd_mid_price", "fut_mid_price", "ctd_spread", "fut_spread")) + """
       FROM y WINDOW w AS (ORDER BY ep ROWS UNBOUNDED PRECEDING))
     SELECT *, ctd_mid_price - ctd_spread / 2 AS ctd_bid, ctd_mid_price + ctd_spread / 2 AS ctd_ask, fut_mid_price - fut_spread / 2 AS fut_bid, fut_mid_price + fut_spread / 2 AS fut_ask,
       round_even(cf * 20, 0) AS fut_contracts FROM f""")
def _(t):
    return DS.build_dataset(t.book5, t.terms, SET, S.WINDOW_OPEN, S.WINDOW_CLOSE, STEP)

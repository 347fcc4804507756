"""Window transforms, the feature language, formulas and statistical tests."""

from pyspark.sql import functions as F

from registry.base import query
from registry.sources_sql import flow_sql
from tickloom import schema as S
from tickloom.functions import calendar as C
from tickloom.functions import cross, micro
from tickloom.sources.sinks import stage
from tickloom.functions.expr import sod
from tickloom.operators import dates as D
from tickloom.operators import profit as P
from tickloom.operators import stats as T
from tickloom.operators.grid import align_daily, join_roles, resample_last
from tickloom.operators.ordered import day_window
from tickloom.plans import catalog as K
from tickloom.plans import dataset as DS
from tickloom.plans import features as X
from tickloom.plans import repo_rate as RR

W = "WINDOW w AS (PARTITION BY role, d ORDER BY ep)"
DW = "WINDOW w AS (PARTITION BY d ORDER BY ep)"


def mids(t):
    return t.quotes1.select("role", "d", "ep", micro.mid_price().alias("x"))


MID = "(SELECT role, d, ep, (l1_bid_price + l1_ask_price) / 2 AS x FROM quotes1) m"


# ---- the flagship: grid, join, factor, basis, change, rolling mean, description


@query("flagship", "d:d n:i mean:f std:f low:f q50:f high:f mean_change:f mean_roll:f", """
       SELECT d, COUNT(basis) AS n, AVG(basis) AS mean, STDDEV_SAMP(basis) AS std, MIN(basis) AS low, quantile_cont(basis, 0.5) AS q50, MAX(basis) AS high,
              AVG(ch) AS mean_change, AVG(rl) AS mean_roll FROM (
        SELECT d, basis, basis - LAG(basis, 3) OVER w AS ch,
               CASE WHEN COUNT(basis) OVER (w ROWS 11 PRECEDING) >= 6 THEN AVG(basis) OVER (w ROWS 11 PRECEDING) END AS rl FROM basis5
        WINDOW w AS (PARTITION BY d ORDER BY ep)) x GROUP BY d""")
def _(t):
    names = ["basis", "basis_delta_3s", "basis_roll_mean_12s"]
    f = X.compile_features(t.basis5, names)
    extra = [F.avg("basis_delta_3s").alias("mean_change"), F.avg("basis_roll_mean_12s").alias("mean_roll")]
    return T.describe(f, ["d"], "basis", bounded=True, extra=extra)


@query("lag", "role:s ep:i lag_1:f lag_5:f", f"SELECT role, ep, LAG(x, 1) OVER w AS lag_1, LAG(x, 5) OVER w AS lag_5 FROM {MID} {W}")
def _(t):
    out = X.compile_features(mids(t), ["x_lag_1s", "x_lag_5s"], ["role"], bases=["x"])
    return out.withColumnsRenamed({"x_lag_1s": "lag_1", "x_lag_5s": "lag_5"})


@query("identity", "role:s ep:i x:f x_lag_2s:f", f"SELECT role, ep, x, LAG(x, 2) OVER w AS x_lag_2s FROM {MID} {W}")
def _(t):
    names = [f.name for f in X.Spec("x", lags=(2,)).features()]
    return X.compile_features(mids(t), names, ["role"], bases=["x"])


@query("delta", "role:s ep:i x_delta_1s:f x_delta_10s:f", f"SELECT role, ep, x - LAG(x, 1) OVER w AS x_delta_1s, x - LAG(x, 10) OVER w AS x_delta_10s FROM {MID} {W}")
def _(t):
    return X.compile_features(mids(t), ["x_delta_1s", "x_delta_10s"], ["role"], bases=["x"])


ROLL = ", ".join(f"CASE WHEN COUNT(x) OVER (w ROWS {n - 1} PRECEDING) >= {m} THEN {f}(x) OVER (w ROWS {n - 1} PRECEDING) END AS x_roll_{s}_{n}s"
                 for s, f in (("mean", "AVG"), ("std", "STDDEV_SAMP"), ("min", "MIN"), ("max", "MAX")) for n, m in ((6, 3), (3, 2 if s == "std" else 1)))
ROLL_NAMES = [f"x_roll_{s}_{n}s" for s in X.STATS for n in (6, 3)]
SIZES = "(SELECT role, d, ep, l1_bid_size AS x FROM book1) m"


@query("rolling", "role:s ep:i " + " ".join(f"{n}:f" for n in ROLL_NAMES), f"SELECT role, ep, {ROLL} FROM {SIZES} {W}")
def _(t):
    sizes = t.book1.select("role", "d", "ep", F.col("l1_bid_size").alias("x"))
    return X.compile_features(sizes, ROLL_NAMES, ["role"], bases=["x"])


@query("rolling_time", "role:s ep:i mean:f std:f", f"""
       SELECT role, ep, AVG(x) OVER v AS mean, STDDEV_SAMP(x) OVER v AS std FROM {MID} WINDOW v AS (PARTITION BY role, d ORDER BY ep RANGE 1799 PRECEDING)""")
def _(t):
    w = day_window()
    return mids(t).select("role", "ep", X.rolling_time("x", "mean", 1800, w).alias("mean"), X.rolling_time("x", "std", 1800, w).alias("std"))


def ratio_sql(part):
    ref = f"FIRST_VALUE(CASE WHEN x <> 0 THEN x END IGNORE NULLS) OVER (PARTITION BY role, {part} ORDER BY ep ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    return f"x / COALESCE({ref}, CASE WHEN COUNT(*) OVER (PARTITION BY role, {part}) = 1 THEN 1e0 END)"


@query("ratio_day", "role:s ep:i x_day_ratio:f", f"SELECT role, ep, {ratio_sql('d')} AS x_day_ratio FROM {SIZES}")
def _(t):
    return X.compile_features(t.book1.select("role", "d", "ep", F.col("l1_bid_size").alias("x")), ["x_day_ratio"], ["role"], bases=["x"])


@query("ratio_hour", "role:s ep:i x_hour_ratio:f", f"SELECT role, ep, {ratio_sql('ep // 3600')} AS x_hour_ratio FROM {SIZES}")
def _(t):
    return X.compile_features(t.book1.select("role", "d", "ep", F.col("l1_bid_size").alias("x")), ["x_hour_ratio"], ["role"], bases=["x"])


BY_NAME = ["basis", "basis_lag_2s", "basis_delta_2s", "basis_delta_2s_lag_3s", "basis_roll_mean_4s", "basis_roll_std_4s_lag_1s", "basis_day_ratio",
           "irr", "irr_hour_ratio", "ctd_mid_price_delta_1s", "ctd_obi_1", "fut_obi_1_roll_max_5s_lag_2s", "ctd_spread", "hour_of_day", "minute_of_hour_sin"]
BY_NAME_SQL = """
    WITH a AS (SELECT *, basis - LAG(basis, 2) OVER w AS d2, CASE WHEN COUNT(basis) OVER (w ROWS 3 PRECEDING) >= 2 THEN AVG(basis) OVER (w ROWS 3 PRECEDING) END AS m4,
      CASE WHEN COUNT(basis) OVER (w ROWS 3 PRECEDING) >= 2 THEN STDDEV_SAMP(basis) OVER (w ROWS 3 PRECEDING) END AS s4,
      CASE WHEN COUNT(fut_obi_1) OVER (w ROWS 4 PRECEDING) >= 2 THEN MAX(fut_obi_1) OVER (w ROWS 4 PRECEDING) END AS x5,
      FIRST_VALUE(CASE WHEN basis <> 0 THEN basis END IGNORE NULLS) OVER (PARTITION BY d ORDER BY ep ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS rd,
      FIRST_VALUE(CASE WHEN irr <> 0 THEN irr END IGNORE NULLS) OVER (PARTITION BY ep // 3600 ORDER BY ep ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS rh
      FROM wide5 WINDOW w AS (PARTITION BY d ORDER BY ep))
    SELECT d, ep, basis, LAG(basis, 2) OVER w AS basis_lag_2s, d2 AS basis_delta_2s, LAG(d2, 3) OVER w AS basis_delta_2s_lag_3s, m4 AS basis_roll_mean_4s,
      LAG(s4, 1) OVER w AS basis_roll_std_4s_lag_1s, basis / rd AS basis_day_ratio, irr, irr / rh AS irr_hour_ratio, ctd_mid_price - LAG(ctd_mid_price) OVER w AS ctd_mid_price_delta_1s,
      ctd_obi_1, LAG(x5, 2) OVER w AS fut_obi_1_roll_max_5s_lag_2s, ctd_spread, ep % 86400 // 3600 AS hour_of_day, SIN(2 * PI() * (ep % 3600 // 60) / 60) AS minute_of_hour_sin
    FROM a WINDOW w AS (PARTITION BY d ORDER BY ep)"""


@query("features_by_name", "d:d ep:i " + " ".join(f"{n}:{'i' if n == 'hour_of_day' else 'f'}" for n in BY_NAME), BY_NAME_SQL)
def _(t):
    return X.compile_features(K.market_features(t.book5, t.terms, DS.bases_of(BY_NAME)), BY_NAME)


SPEC = X.Spec("basis", deltas=(2, 4), rolls=(("mean", 4),), ratios=("day",), lags=(1,))
SPEC_NAMES = [f.name for f in SPEC.features()]


@query("feature_spec", "d:d ep:i " + " ".join(f"{n}:f" for n in SPEC_NAMES), """
    WITH a AS (SELECT d, ep, basis, basis - LAG(basis, 2) OVER w AS basis_delta_2s, basis - LAG(basis, 4) OVER w AS basis_delta_4s,
       CASE WHEN COUNT(basis) OVER (w ROWS 3 PRECEDING) >= 2 THEN AVG(basis) OVER (w ROWS 3 PRECEDING) END AS basis_roll_mean_4s,
       basis / FIRST_VALUE(CASE WHEN basis <> 0 THEN basis END IGNORE NULLS) OVER (PARTITION BY d ORDER BY ep ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS basis_day_ratio
       FROM basis5 WINDOW w AS (PARTITION BY d ORDER BY ep))
    SELECT *, """ + ", ".join(f"LAG({n}) OVER w AS {n}_lag_1s" for n in SPEC_NAMES if not n.endswith("_lag_1s")) + " FROM a " + DW)
def _(t):
    return X.compile_features(t.basis5, SPEC_NAMES)


SET_COLUMNS = [*X.FEATURE_SETS["baseline"]]


def set_sql():
    out = []
    for n in SET_COLUMNS:
        f = X.parse(n, ["basis", "ctd_mid_price", "fut_mid_price", "ctd_obi_1", "fut_obi_1", "ctd_bof_1", "fut_bof_1", "ctd_aof_1", "fut_aof_1"])
        c = f"LAG({f.base}, {f.lag}) OVER w" if f.lag else f.base
        out.append(f"{c}{f' - LAG({f.base}, {f.lag + f.size}) OVER w' if f.kind == 'delta' else ''} AS {n}")
    return f"SELECT d, ep, {', '.join(out)} FROM wide5 {DW}"


@query("feature_sets", "d:d ep:i " + " ".join(f"{n}:f" for n in SET_COLUMNS), set_sql())
def _(t):
    names = X.feature_set("baseline")
    return X.compile_features(K.market_features(t.book5, t.terms, DS.bases_of(names)), names)


@query("ffill", "role:s ep:i l1_bid_price:f l1_bid_size:f", """
       SELECT role, ep, LAST_VALUE(l1_bid_price IGNORE NULLS) OVER w AS l1_bid_price, LAST_VALUE(l1_bid_size IGNORE NULLS) OVER w AS l1_bid_size FROM book1
       WINDOW w AS (PARTITION BY role ORDER BY ep ROWS UNBOUNDED PRECEDING)""")
def _(t):
    return X.ffill(t.book1, ["l1_bid_price", "l1_bid_size"], ["role"])


@query("target_shift", "role:s ep:i target:f", f"""
       SELECT role, ep, target FROM (SELECT role, ep, LEAD(z, 3) OVER w AS target FROM (SELECT *, x - LAG(x, 2) OVER w AS z FROM {MID} {W}) y {W}) q WHERE target IS NOT NULL""")
def _(t):
    return X.target_shift(mids(t), "x", 3, ["role"], change=2)


def switch_sql(c):
    return f"SELECT d, isin, cusip FROM (SELECT *, LAG({c}) OVER (ORDER BY d) AS p FROM daily_cf) x WHERE {c} IS DISTINCT FROM p"


@query("switch_dates", "d:d isin:s cusip:s", f"{switch_sql('isin')} INTERSECT {switch_sql('cusip')}")
def _(t):
    return D.switch_dates(t.daily_cf)


CROSS = """
    WITH x AS (SELECT d, ep, CASE WHEN ep % 7 <> 0 THEN basis END AS v FROM basis5),
         dd AS (SELECT d, SUM(v) AS s, COUNT(v) AS n, ROW_NUMBER() OVER (ORDER BY d) AS i FROM x GROUP BY d),
         mm AS (SELECT a.d, SUM(b.s) / SUM(b.n) AS mean FROM dd a JOIN dd b ON b.i BETWEEN a.i - 3 AND a.i - 1 WHERE a.i > 3 GROUP BY a.d),
         y AS (SELECT x.d, x.ep, v, v - mean AS delta, LEAD(x.ep) OVER (PARTITION BY x.d ORDER BY x.ep) IS NULL AS is_last FROM x LEFT JOIN mm ON mm.d = x.d),
         z AS (SELECT y.*, (SELECT MIN(q.ep) FROM y q WHERE q.d = y.d AND q.ep > y.ep AND q.delta IS NOT NULL AND SIGN(q.delta) <> SIGN(y.delta)) AS nxt,
                      EXISTS (SELECT 1 FROM y q WHERE q.d = y.d AND q.ep > y.ep AND q.delta IS NOT NULL) AS later FROM y),
         ct AS (SELECT d, ep, delta, CASE WHEN NOT is_last AND ABS(delta) > 1e-8 THEN nxt - ep END AS seconds,
                       COALESCE(NOT is_last AND ABS(delta) > 1e-8 AND nxt IS NULL AND later, FALSE) AS no_crossover FROM z),
         fc AS (SELECT *, seconds IS NOT NULL AND NOT COALESCE(seconds = LAST_VALUE(seconds IGNORE NULLS) OVER (ORDER BY ep ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 300, FALSE)
                       AS first_crossover FROM ct)"""


def crossings(t):
    v = t.basis5.withColumn("v", F.when(F.col("ep") % 7 != 0, F.col("basis")))
    return T.crossover_time(v, "v", 3)


@query("crossover_time", "d:d ep:i delta:f seconds:f no_crossover:b", CROSS + " SELECT * FROM ct")
def _(t):
    return crossings(t)


@query("first_crossover", "d:d ep:i seconds:f first_crossover:b", CROSS + " SELECT * FROM fc")
def _(t):
    return T.first_crossover(crossings(t), 300)


INTEG = ("delta_finite", "delta_null", "time_finite", "time_infinite", "time_null")
INTEG_SQL = """SELECT part, n, {0}, {1} FROM (SELECT part, COUNT(*) AS n, COUNT(delta) AS delta_finite, COUNT(*) - COUNT(delta) AS delta_null, COUNT(seconds) AS time_finite,
    SUM(no_crossover::INT) AS time_infinite, SUM((seconds IS NULL AND NOT no_crossover)::INT) AS time_null FROM (SELECT 'all' AS part, * FROM fc UNION ALL
    SELECT 'first', * FROM fc WHERE first_crossover) u GROUP BY part) v""".format(", ".join(INTEG), ", ".join(f"{c} * 100e0 / n AS {c}_pct" for c in INTEG))


@query("crossover_integrity", "part:s n:i " + " ".join(f"{c}:i {c}_pct:f" for c in INTEG), CROSS + " " + INTEG_SQL)
def _(t):
    return T.crossover_integrity(T.first_crossover(crossings(t), 300))


@query("crossover_by_quantile", "bin:i n:i mean_seconds:f low:f high:f q25:f q50:f q75:f", CROSS + """
       SELECT bin, COUNT(*) AS n, AVG(seconds) AS mean_seconds, MIN(delta) AS low, MAX(delta) AS high, quantile_cont(seconds, 0.25) AS q25,
              quantile_cont(seconds, 0.5) AS q50, quantile_cont(seconds, 0.75) AS q75 FROM (
        SELECT fc.*, (delta > q[1])::INT + (delta > q[2])::INT + (delta > q[3])::INT + (delta > q[4])::INT AS bin FROM fc,
          (SELECT quantile_cont(delta, [0.2, 0.4, 0.6, 0.8]) AS q FROM fc WHERE first_crossover AND delta IS NOT NULL) e WHERE first_crossover AND delta IS NOT NULL) b GROUP BY bin""")
def _(t):
    return T.crossover_by_quantile(T.first_crossover(crossings(t), 300), 5)


@query("crossover_by_threshold", "threshold:f sign:i n:i mean:f std:f low:f q25:f q50:f q75:f high:f", CROSS + """
       SELECT threshold, SIGN(delta) AS sign, COUNT(*) AS n, AVG(seconds) AS mean, STDDEV_SAMP(seconds) AS std, MIN(seconds) AS low, quantile_cont(seconds::DOUBLE, 0.25) AS q25,
              quantile_cont(seconds::DOUBLE, 0.5) AS q50, quantile_cont(seconds::DOUBLE, 0.75) AS q75, MAX(seconds) AS high FROM fc JOIN (VALUES (0e0), (0.05e0), (0.1e0), (0.2e0)) v(threshold) ON ABS(delta) >= threshold
       WHERE first_crossover AND delta IS NOT NULL GROUP BY 1, 2""")
def _(t):
    return T.crossover_by_threshold(T.first_crossover(crossings(t), 300), [0.0, 0.05, 0.1, 0.2])


@query("sessions", "first_ep:i last_ep:i n:i", """
       SELECT MIN(ep) AS first_ep, MAX(ep) AS last_ep, COUNT(*) AS n FROM (SELECT ep, SUM(nw) OVER (ORDER BY ep) AS g FROM (
        SELECT ep, CASE WHEN ep - LAG(ep) OVER (ORDER BY ep) > 1800 THEN 1 ELSE 0 END AS nw FROM market5) x) y GROUP BY g""")
def _(t):
    return P.runs_by_gap(t.market5.select("d", "ep", F.lit("market").alias("k")), ["k"], 1800)


LAGS, PARTIAL_LAGS = 60, 12
ACF_SQL = """
    WITH x AS (SELECT role, d, ep, l1_ask_size AS v FROM quotes1), c AS (SELECT role, d, ep, v - AVG(v) OVER (PARTITION BY role, d) AS e FROM x),
         l AS (SELECT role, d, e, """ + ", ".join(f"LAG(e, {k}) OVER w AS l{k}" for k in range(1, LAGS + 1)) + """ FROM c WINDOW w AS (PARTITION BY role, d ORDER BY ep)),
         g AS (SELECT role, d, COUNT(*) AS n, """ + ", ".join(f"SUM(e * l{k}) / SUM(e * e) AS r{k}" for k in range(1, LAGS + 1)) + f""" FROM l GROUP BY role, d HAVING COUNT(*) > {LAGS}),
         h AS (SELECT role, d, n, unnest(range(1, {LAGS + 1})) AS lag, unnest([{", ".join(f"r{k}" for k in range(1, LAGS + 1))}]) AS acf FROM g)
    SELECT role, d, n, lag, acf, 1.959963984540054 * SQRT((1 + 2 * COALESCE(SUM(acf * acf) OVER (PARTITION BY role, d ORDER BY lag ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / n) AS band FROM h"""


def _acf(t):
    return T.acf(t.quotes1, ["role", "d"], "l1_ask_size", LAGS)


@query("acf", "role:s d:d n:i lag:i acf:f band:f", ACF_SQL)
def _(t):
    return _acf(t)


@query("acf_mean", "role:s lag:i days:i acf:f band:f", f"SELECT role, lag, COUNT(*) AS days, AVG(acf) AS acf, AVG(band) AS band FROM ({ACF_SQL}) q GROUP BY role, lag")
def _(t):
    return T.over_days(_acf(t), ["role"], ["acf", "band"])


def burg_sql(lags):
    """One step of the recursion per lag: coefficient of the step, then both residuals moved on."""
    out = [f"""WITH x AS (SELECT role, d, ep, l1_ask_size - AVG(l1_ask_size) OVER (PARTITION BY role, d) AS e, COUNT(*) OVER (PARTITION BY role, d) AS n FROM quotes1 WHERE l1_ask_size IS NOT NULL),
         u0 AS (SELECT role, d, ep, e AS f, e AS b FROM x WHERE n > {lags + 1})"""]
    for k in range(1, lags + 1):
        out.append(f"s{k} AS (SELECT role, d, ep, f, LAG(b) OVER (PARTITION BY role, d ORDER BY ep) AS b FROM u{k - 1})")
        out.append(f"k{k} AS (SELECT role, d, 2 * SUM(f * b) / SUM(f * f + b * b) AS k FROM s{k} WHERE b IS NOT NULL GROUP BY role, d)")
        out.append(f"u{k} AS (SELECT role, d, ep, f - k * b AS f, b - k * f AS b FROM s{k} JOIN k{k} USING (role, d) WHERE b IS NOT NULL)")
    return ", ".join(out) + " " + " UNION ALL ".join(f"SELECT role, d, {k} AS lag, k AS pacf FROM k{k}" for k in range(1, lags + 1))


PACF_SQL = burg_sql(PARTIAL_LAGS)


def _pacf(t):
    return T.pacf(t.quotes1.withColumn("v", F.col("l1_ask_size")), ["role", "d"], "v", PARTIAL_LAGS)


@query("pacf", "role:s d:d lag:i pacf:f", PACF_SQL)
def _(t):
    return _pacf(t)


@query("pacf_mean", "role:s lag:i days:i pacf:f", f"SELECT role, lag, COUNT(*) AS days, AVG(pacf) AS pacf FROM ({PACF_SQL}) q GROUP BY role, lag")
def _(t):
    return T.over_days(_pacf(t), ["role"], ["pacf"])


def phi(z):
    t = f"(1 / (1 + 0.3275911e0 * ABS({z}) / SQRT(2e0)))"
    poly = f"((((1.061405429e0 * {t} - 1.453152027e0) * {t} + 1.421413741e0) * {t} - 0.284496736e0) * {t} + 0.254829592e0) * {t}"
    tail = f"0.5e0 * {poly} * EXP(-({z}) * ({z}) / 2)"
    return f"CASE WHEN {z} >= 0 THEN 1 - {tail} ELSE {tail} END"


ADF_SQL = f"""
    WITH x AS (SELECT d, ep, basis AS y FROM basis5), l AS (SELECT d, y - LAG(y) OVER w AS dy, LAG(y) OVER w AS yl FROM x {DW}),
         g AS (SELECT d, COUNT(*) AS nobs, regr_slope(dy, yl) AS b, regr_sxx(dy, yl) AS sxx, regr_syy(dy, yl) AS syy FROM l WHERE dy IS NOT NULL GROUP BY d HAVING COUNT(*) > 3),
         s AS (SELECT d, nobs, b / SQRT((syy - b * b * sxx) / (nobs - 2) / sxx) AS stat FROM g),
         z AS (SELECT *, CASE WHEN stat <= -1.61 THEN 2.1659e0 + 1.4412e0 * stat + 0.038269e0 * stat * stat
                ELSE 1.7339e0 + 0.93202e0 * stat - 0.12745e0 * stat * stat - 0.010368e0 * stat * stat * stat END AS z FROM s)
    SELECT d, nobs, stat, CASE WHEN stat > 2.74 THEN 1 WHEN stat < -18.83 THEN 0 ELSE {phi('z')} END AS pvalue FROM z"""


CRITICAL = ", ".join(f"{c[0]}e0 + {c[1]}e0 / nobs + {c[2]}e0 / (nobs * nobs) + {c[3]}e0 / (nobs * nobs * nobs) AS critical_{p}" for p, c in zip((1, 5, 10), T.ADF_CRITICAL["c"]))


@query("adf", "d:d nobs:i stat:f pvalue:f critical_1:f critical_5:f critical_10:f", f"SELECT *, {CRITICAL} FROM ({ADF_SQL}) r")
def _(t):
    out = T.adf(t.basis5, ["d"], "basis", lags=0, trend="c")
    return out.withColumns({f"critical_{p}": c for p, c in zip((1, 5, 10), T.adf_critical("nobs"))})


@query("adf_lagged", "d:d nobs:i stat:f", f"""
    WITH l AS (SELECT d, ep, basis - LAG(basis) OVER w AS dy, LAG(basis) OVER w AS yl FROM basis5 {DW}), m AS (SELECT d, dy AS y, yl AS a, LAG(dy) OVER w AS b FROM l {DW}),
         g AS (SELECT d, COUNT(*) AS n, regr_sxx(y, a) AS saa, regr_sxx(y, b) AS sbb, regr_syy(y, a) AS syy, regr_sxy(y, a) AS say, regr_sxy(y, b) AS sby, regr_sxy(a, b) AS sab
               FROM m WHERE b IS NOT NULL GROUP BY d HAVING COUNT(*) > 4),
         c AS (SELECT *, saa * sbb - sab * sab AS det, (say * sbb - sby * sab) / (saa * sbb - sab * sab) AS ba, (sby * saa - say * sab) / (saa * sbb - sab * sab) AS bb FROM g)
    SELECT d, n AS nobs, ba / SQRT((syy - ba * say - bb * sby) / (n - 3) * sbb / det) AS stat FROM c""")
def _(t):
    return T.adf(t.basis5, ["d"], "basis", lags=1, trend="c")


def kpss_sql(resid, crit):
    (a, b, c, d) = crit
    p = (f"CASE WHEN stat <= {a} THEN 0.10 WHEN stat <= {b} THEN 0.10e0 + (stat - {a}) * (-0.05e0 / ({b} - {a})) WHEN stat <= {c} THEN 0.05e0 + (stat - {b}) * (-0.025e0 / ({c} - {b})) "
         f"WHEN stat <= {d} THEN 0.025e0 + (stat - {c}) * (-0.015e0 / ({d} - {c})) ELSE 0.01 END")
    return f"""
    WITH e AS ({resid}), s AS (SELECT d, e, SUM(e) OVER (w ROWS UNBOUNDED PRECEDING) AS s, LAG(e, 1) OVER w AS l1, LAG(e, 2) OVER w AS l2 FROM e {DW}),
         g AS (SELECT d, COUNT(*) AS nobs, (SUM(s * s) / (COUNT(*) * COUNT(*))) / ((SUM(e * e) + 2 * (1 - 1 / 3e0) * SUM(e * l1) + 2 * (1 - 2 / 3e0) * SUM(e * l2)) / COUNT(*)) AS stat
               FROM s GROUP BY d HAVING COUNT(*) > 3)
    SELECT d, nobs, stat, {p} AS pvalue FROM g"""


LEVEL = "SELECT d, ep, basis - AVG(basis) OVER (PARTITION BY d) AS e FROM basis5"
TREND = """SELECT b.d, b.ep, b.basis - (g.a + g.s * b.t) AS e FROM (SELECT d, ep, basis, ROW_NUMBER() OVER (PARTITION BY d ORDER BY ep) AS t FROM basis5) b
           JOIN (SELECT d, regr_intercept(basis, t) AS a, regr_slope(basis, t) AS s FROM (SELECT d, basis, ROW_NUMBER() OVER (PARTITION BY d ORDER BY ep) AS t FROM basis5) q GROUP BY d) g
           ON g.d = b.d"""


@query("kpss", "d:d nobs:i stat:f pvalue:f", kpss_sql(LEVEL, T.KPSS_CRITICAL["c"]))
def _(t):
    return T.kpss(t.basis5, ["d"], "basis", 2, "c")


@query("kpss_trend", "d:d nobs:i stat:f pvalue:f", kpss_sql(TREND, T.KPSS_CRITICAL["ct"]))
def _(t):
    return T.kpss(t.basis5, ["d"], "basis", 2, "ct")


RUN = [("adf", "c", 0, ADF_SQL), ("kpss", "c", 2, kpss_sql(LEVEL, T.KPSS_CRITICAL["c"])), ("kpss", "ct", 2, kpss_sql(TREND, T.KPSS_CRITICAL["ct"]))]
DELTAS = (0, 1)
# The series of each kind of window; its key takes the place of the day.
WINDOWS = {"daily": "SELECT CAST(d AS VARCHAR) AS d, ep, basis FROM basis5", "hourly": "SELECT CAST(d AS VARCHAR) || ' ' || (ep % 86400 // 3600) AS d, ep, basis FROM basis5"}


def windows_sql():
    for kind, rows in WINDOWS.items():
        for delta in DELTAS:
            moved = rows if not delta else f"SELECT * FROM (SELECT d, ep, basis - LAG(basis, {delta}) OVER (PARTITION BY d ORDER BY ep) AS basis FROM ({rows}) r) q WHERE basis IS NOT NULL"
            for test, trend, lag, sql in RUN:
                yield (f"SELECT '{test}' AS test, '{trend}' AS regression, '{kind}' AS frequency, {lag} AS lag, {delta} AS delta, d AS \"window\", nobs, "
                       f"CASE WHEN isfinite(stat) THEN stat END AS stat, CASE WHEN isfinite(stat) THEN pvalue END AS pvalue FROM ({sql.replace('basis5', f'({moved}) b5')}) x")


RUN_SQL = " UNION ALL ".join(windows_sql())


def stationarity(t):
    """Both tests, trends and differences of every day and hour, in one pass per kind of window; windows of at least six rows."""
    rows = stage(t.basis5.withColumn("hour", F.floor(F.pmod("ep", F.lit(86_400)) / 3600)))
    run = T.stationarity_run(rows, "basis", {"daily": ["d"], "hourly": ["d", "hour"]}, {k: [0, 2] for k in WINDOWS}, deltas=DELTAS, only={(test, trend, lag) for test, trend, lag, _ in RUN})
    return run.where("nobs > 5")


@query("stationarity_run", "test:s regression:s frequency:s lag:i delta:i window:s nobs:i stat:f pvalue:f", f"SELECT * FROM ({RUN_SQL}) y WHERE nobs > 5")
def _(t):
    return stationarity(t)


@query("stationarity_share", "frequency:s delta:i regression:s test:s share:f windows:i", f"""SELECT frequency, delta, regression, test, AVG(CASE test WHEN 'adf' THEN pvalue <= 0.05 ELSE pvalue > 0.05 END::INT) AS share, COUNT(*) AS windows
       FROM (SELECT * FROM ({RUN_SQL}) y WHERE nobs > 5 AND pvalue IS NOT NULL) z GROUP BY ALL""")
def _(t):
    return T.stationarity_share(stationarity(t), ["frequency", "delta", "regression"])


@query("split_daily", "d:d first_ep:i n:i", "SELECT d, MIN(ep) AS first_ep, COUNT(*) AS n FROM basis5 GROUP BY d")
def _(t):
    return T.split_daily(t.basis5).groupBy("d", "first_ep").agg(F.count("*").alias("n"))


@query("split_hourly", "d:d hour:i n:i", "SELECT d, ep % 86400 // 3600 AS hour, COUNT(*) AS n FROM basis5 GROUP BY 1, 2")
def _(t):
    return T.split_hourly(t.basis5).groupBy("d", "hour").agg(F.count("*").alias("n"))


@query("interpolate_time", "d:d ep:i v:f", """
       WITH b AS (SELECT d, ep // 900 * 900 AS ep, arg_max(basis, ep) AS v FROM basis5 GROUP BY 1, 2),
            g AS (SELECT d, unnest(generate_series(MIN(ep), MAX(ep), 900)) AS ep FROM b GROUP BY d),
            f AS (SELECT g.d, g.ep, b.v, CASE WHEN b.v IS NOT NULL THEN g.ep END AS t FROM g LEFT JOIN b ON b.ep = g.ep),
            n AS (SELECT d, ep, v, LAST_VALUE(v IGNORE NULLS) OVER p AS v0, LAST_VALUE(t IGNORE NULLS) OVER p AS t0, FIRST_VALUE(v IGNORE NULLS) OVER q AS v1, FIRST_VALUE(t IGNORE NULLS) OVER q AS t1
                  FROM f WINDOW p AS (PARTITION BY d ORDER BY ep ROWS UNBOUNDED PRECEDING), q AS (PARTITION BY d ORDER BY ep ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
       SELECT d, ep, COALESCE(v, v0 + (v1 - v0) * (ep - t0) / NULLIF(t1 - t0, 0), v0) AS v FROM n WHERE v0 IS NOT NULL""")
def _(t):
    return T.interpolate_time(resample_last(t.basis5.withColumnRenamed("basis", "v"), ["d"], 900, ["v"]), ["d"], "v")


# ---- formulas


def _formula(name, kinds, sql, columns):
    @query(name, "role:s ep:i " + kinds, f"SELECT role, ep, {sql} FROM quotes1")
    def _(t):
        return t.quotes1.select("role", "ep", *[c.alias(n) for n, c in columns().items()])


SUMS = {k: (" + ".join(f"l{i}_bid_size" for i in range(1, k + 1)), " + ".join(f"l{i}_ask_size" for i in range(1, k + 1))) for k in (1, 2, 3)}
_formula("mid_price", "mid:f", "(l1_ask_price + l1_bid_price) / 2 AS mid", lambda: {"mid": micro.mid_price()})
_formula("spread", "spread:f", "l1_ask_price - l1_bid_price AS spread", lambda: {"spread": micro.spread()})
_formula("micro_price", "micro:f", "(l1_ask_price * l1_bid_size + l1_bid_price * l1_ask_size) / NULLIF(l1_bid_size + l1_ask_size, 0) AS micro", lambda: {"micro": micro.micro_price()})
_formula("obi", " ".join(f"obi_{k}:f ratio_{k}:f" for k in SUMS),
         ", ".join(f"{b} - ({a}) AS obi_{k}, ({b} - ({a})) / NULLIF({b} + {a}, 0) AS ratio_{k}" for k, (b, a) in SUMS.items()),
         lambda: {n: c for k in SUMS for n, c in ((f"obi_{k}", micro.imbalance(k)), (f"ratio_{k}", micro.imbalance(k, True)))})


def slope1(k, s):
    p, z = (lambda i: f"l{i}_{s}_price"), (lambda i: f"l{i}_{s}_size")
    out = f"{z(1)} / NULLIF(ABS({p(1)} / ((l1_ask_price + l1_bid_price) / 2) - 1), 0)"
    if k == 1:
        return out
    rest = " + ".join(f"COALESCE(({z(i)} / NULLIF({z(i - 1)}, 0) - 1) / NULLIF(ABS({p(i)} / NULLIF({p(i - 1)}, 0) - 1), 0), 0)" for i in range(2, k + 1))
    return f"({out} + {rest}) / {k}"


def slope2(k, s):
    return f"({' + '.join(f'l{i}_{s}_size' for i in range(1, k + 1))}) / NULLIF(ABS(l{k}_{s}_price - (l1_ask_price + l1_bid_price) / 2), 0)"


PAIRS = [(k, s) for k in (1, 2, 3) for s in S.SIDES]
_formula("slope_v1", " ".join(f"{s}_{k}:f2" for k, s in PAIRS), ", ".join(f"{slope1(k, s)} AS {s}_{k}" for k, s in PAIRS),
         lambda: {f"{s}_{k}": micro.slope_relative(k, s) for k, s in PAIRS})
_formula("slope_v2", " ".join(f"{s}_{k}:f4" for k, s in PAIRS), ", ".join(f"{slope2(k, s)} AS {s}_{k}" for k, s in PAIRS),
         lambda: {f"{s}_{k}": micro.slope_depth(k, s) for k, s in PAIRS})


def _flow(name, sql, column):
    @query(name, "role:s ep:i " + " ".join(f"{name}_{k}:f" for k in (1, 2, 3)),
           f"SELECT role, ep, {', '.join(f'{sql(k)} AS {name}_{k}' for k in (1, 2, 3))} FROM quotes1 {W}")
    def _(t):
        w = day_window()
        return t.quotes1.select("role", "ep", *[column(k, w).alias(f"{name}_{k}") for k in (1, 2, 3)])


_flow("bof", lambda k: flow_sql("bid", k), lambda k, w: micro.flow("bid", k, w))
_flow("aof", lambda k: flow_sql("ask", k), lambda k, w: micro.flow("ask", k, w))
_flow("ofi", lambda k: f"{flow_sql('bid', k)} + {flow_sql('ask', k)}", lambda k, w: micro.flow_imbalance(k, w))


@query("basis", "ep:i basis_mid:f basis_ask:f basis_bid:f", """
       SELECT ep, (ctd_ask_price + ctd_bid_price) / 2 - cf * (fut_ask_price + fut_bid_price) / 2 AS basis_mid, ctd_ask_price - cf * fut_bid_price AS basis_ask,
              ctd_bid_price - cf * fut_ask_price AS basis_bid FROM market5""")
def _(t):
    df = align_daily(join_roles(t.grid5), t.daily_cf)
    return df.select("ep", *[cross.basis_column(m).alias(f"basis_{m}") for m in ("mid", "ask", "bid")])


@query("coupon_schedule", "isin:s coupon_date:d n:i", """
       SELECT s.isin, s.c AS coupon_date, n FROM coupons s JOIN (SELECT isin, COUNT(*) AS n FROM quotes1 q JOIN daily_cf k ON k.d = q.d GROUP BY isin) u ON u.isin = s.isin""")
def _(t):
    n = align_daily(t.quotes1.select("d"), t.daily_cf).groupBy("isin").agg(F.count("*").alias("n"))
    return n.join(F.broadcast(RR.coupon_schedule(t.ctd_metadata)), "isin")


@query("accrued_interest", "d:d isin:s delivery:d ai_now:f ai_delivery:f coupons:f weighted_coupons:f years:f", "SELECT * FROM terms")
def _(t):
    return t.terms


def irr_sql(b, f):
    return f"(({f}) * t.cf + ai_delivery - (({b}) + ai_now - coupons)) / ((({b}) + ai_now) * years - weighted_coupons)"


@query("irr", "ep:i irr_mid:f irr_long:f irr_short:f", f"""
       SELECT ep, {irr_sql('(ctd_bid_price + ctd_ask_price) / 2', '(fut_bid_price + fut_ask_price) / 2')} AS irr_mid, {irr_sql('ctd_ask_price', 'fut_bid_price')} AS irr_long,
              {irr_sql('ctd_bid_price', 'fut_ask_price')} AS irr_short FROM market5 m JOIN terms t ON t.d = m.d""")
def _(t):
    return RR.irr(t.market5, t.terms)


@query("fut_contracts", "ep:i frac:f whole:i", "SELECT ep, cf * 1.5e0 * 20 AS frac, round_even(cf * 1.5e0 * 20, 0) AS whole FROM market5")
def _(t):
    return t.market5.select("ep", cross.fractional_contracts("cf", 1.5).alias("frac"), cross.rounded_contracts("cf", 1.5).alias("whole"))


@query("effective_cf", "ep:i eff:f", "SELECT ep, round_even(cf * 1.5e0 * 20, 0) * 100000 / (1.5e0 * 2000000) AS eff FROM market5")
def _(t):
    return t.market5.select("ep", cross.effective_cf(cross.rounded_contracts("cf", 1.5), F.lit(1.5)).alias("eff"))


CAL = {"year": "YEAR(d)", "month": "MONTH(d)", "week_of_year": "WEEK(d)", "day_of_year": "dayofyear(d)", "day_of_month": "DAY(d)", "day_of_week": "isodow(d)",
       "hour_of_day": "ep % 86400 // 3600", "minute_of_day": "ep % 86400 // 60", "minute_of_hour": "ep % 3600 // 60", "second_of_day": "ep % 86400",
       "second_of_hour": "ep % 3600", "second_of_minute": "ep % 60"}


@query("calendar", "role:s ep:i " + " ".join(f"{n}:i" for n in CAL), "SELECT role, ep, " + ", ".join(f"{e} AS {n}" for n, e in CAL.items()) + " FROM quotes1")
def _(t):
    return t.quotes1.select("role", "ep", *[c.alias(n) for n, c in C.calendar().items()])


CYC = {f"{n}_{f}": f"{f}(2 * PI() * ({CAL[n]}) / {p})" for n, p in C.PERIODS.items() for f in ("sin", "cos")}


@query("calendar_cyclic", "role:s ep:i " + " ".join(f"{n}:f" for n in CYC), "SELECT role, ep, " + ", ".join(f"{e} AS {n}" for n, e in CYC.items()) + " FROM quotes1")
def _(t):
    return t.quotes1.select("role", "ep", *[c.alias(n) for n, c in C.cyclic().items()])


DIST = """(SELECT x.d, (SELECT MIN(last_trading) FROM fut_metadata WHERE last_trading >= x.d) - x.d AS days_to_next_roll,
           (SELECT MAX(last_trading) FROM fut_metadata WHERE last_trading <= x.d) - x.d AS days_to_prev_roll FROM (SELECT DISTINCT d FROM quotes1) x)"""


@query("days_to_event", "role:s ep:i days_to_next:i days_to_prev:i", f"""
       SELECT role, ep, days_to_next_roll AS days_to_next, days_to_prev_roll AS days_to_prev FROM quotes1 q JOIN {DIST} e ON e.d = q.d""")
def _(t):
    rolls = t.fut_metadata.select(F.col("last_trading").alias("d"))
    q = t.quotes1.select("role", "d", "ep")
    return q.join(F.broadcast(D.event_distance(q, rolls)), "d", "left")


@query("time_to_daily_event", "event_id:i hours:i minutes_abs:i", """
       SELECT event_id, trunc((epoch_us(back) - us) / 3600e6) AS hours, ABS(trunc((epoch_us(back) - us) / 60e6)) AS minutes_abs FROM (
        SELECT event_id, us, timezone('Europe/Berlin', timezone('America/New_York', (timezone('America/New_York', timezone('Europe/Berlin', ts)))::DATE + TIME '09:30:00')) AS back FROM lob) x""")
def _(t):
    ts = F.col("ts")
    zones = ("Europe/Berlin", "America/New_York", "09:30:00")
    return t.lob.select("event_id", D.time_to_daily_event(ts, *zones, unit_s=3600).alias("hours"),
                        D.time_to_daily_event(ts, *zones, unit_s=60, absolute=True).alias("minutes_abs"))


TEMP = ["hour_of_day", "day_of_week", "minute_of_day", "second_of_minute"]
TEMP_ENC = ["hour_of_day_sin", "minute_of_hour_cos"]


@query("temporal_features", "role:s ep:i days_to_next_roll:i days_to_prev_roll:i " + " ".join(f"{n}:i" for n in TEMP) + " " + " ".join(f"{n}:f" for n in TEMP_ENC),
       "SELECT role, ep, days_to_next_roll, days_to_prev_roll, " + ", ".join(f"{CAL[n].replace('(d)', '(q.d)')} AS {n}" for n in TEMP) + ", "
       + ", ".join(f"{CYC[n]} AS {n}" for n in TEMP_ENC) + f" FROM quotes1 q JOIN {DIST} e ON e.d = q.d")
def _(t):
    return DS.temporal_features(t.quotes1.select("role", "d", "ep"), {"roll": t.fut_metadata.select(F.col("last_trading").alias("d"))})


@query("clock_math", "role:s ep:i back:i ahead:i", "SELECT role, ep, (ep % 86400 - 5400 + 86400) % 86400 AS back, (ep % 86400 + 5400) % 86400 AS ahead FROM quotes1")
def _(t):
    s = sod("ep")
    return t.quotes1.select("role", "ep", F.pmod(s - 5400, F.lit(86_400)).alias("back"), F.pmod(s + 5400, F.lit(86_400)).alias("ahead"))

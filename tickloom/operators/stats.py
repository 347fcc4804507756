"""Descriptive statistics, profiles, unit-root tests and mean-crossover times.

Day windows run on series with at most one row per second.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.expr import col, div, normal_cdf
from tickloom.operators.ordered import _attach, exact_quantiles
from tickloom.sources.sinks import stage

QUARTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75}


def moments(value: str) -> dict[str, Column]:
    """Count, mean, deviation, range and bias-corrected skewness and kurtosis."""
    v = F.col(value)
    n = F.count(v).cast("double")
    skew = F.when(n > 2, F.skewness(v) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)))
    kurt = F.when(n > 3, (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0.0)) * ((n + 1) * F.kurtosis(v) + 6))
    return {"n": F.count(v), "mean": F.avg(v), "std": F.stddev_samp(v), "low": F.min(v), "high": F.max(v), "skew": skew, "kurt": kurt}


def describe(df: DataFrame, keys: list[str], value: str, bounded: bool = False, extra=()) -> DataFrame:
    """Moments and quartiles per key, plus extra aggregates.  ``bounded`` groups (one day of a grid) use the plain percentile."""
    aggs = [*[c.alias(n) for n, c in moments(value).items()], *extra]
    if bounded:
        return df.groupBy(*keys).agg(*aggs, *[F.percentile(value, p).alias(n) for n, p in QUARTILES.items()])
    base = df.groupBy(*keys).agg(*aggs)
    quart = exact_quantiles(df, keys, value, QUARTILES)
    return base.join(quart, keys, "left") if keys else base.join(F.broadcast(quart), how="left")


def trim(df: DataFrame, value: str, low: float, high: float) -> DataFrame:
    """Rows between two quantiles of the whole table."""
    q = exact_quantiles(df, [], value, {"_lo": low, "_hi": high})
    return df.join(F.broadcast(q)).where(F.col(value).between(F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")


def histogram(df: DataFrame, keys: list[str], value: str, start: float, width: float, share: bool = False) -> DataFrame:
    """Counts per fixed-width bin."""
    b = F.floor((F.col(value) - start) / width).cast("long")
    out = df.where(F.col(value).isNotNull()).groupBy(*keys, b.alias("bin")).agg(F.count("*").alias("n"))
    if share:
        whole = out.groupBy(*keys).agg(F.sum("n").alias("_all"))
        out = out.join(F.broadcast(whole)) if not keys else out.join(whole, keys)
        out = out.withColumn("share", F.col("n") / F.col("_all")).drop("_all")
    return out


def symmetric_histogram(df: DataFrame, value: str, bins: int = 31) -> DataFrame:
    """``bins`` equal bins over [-m, m] with m the largest absolute value; the last bin is closed."""
    top = df.agg(F.max(F.abs(F.col(value))).alias("_m"))
    spread = df.join(F.broadcast(top)).where(F.col(value).isNotNull())
    b = F.least(F.floor(div(F.col(value) + F.col("_m"), 2 * F.col("_m")) * bins), F.lit(bins - 1)).cast("long")
    return spread.groupBy(b.alias("bin")).agg(F.count("*").alias("n"))


def intraday_profile(df: DataFrame, value: str, step_s: int) -> DataFrame:
    """Mean and deviation over days of the last value in each time-of-day bin."""
    slot = F.floor(F.pmod(F.col("ep"), F.lit(86_400)) / step_s) * step_s
    last = df.groupBy("role", "d", slot.alias("slot")).agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col("ep"))).alias("v"))
    return last.groupBy("role", "slot").agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.count("v").alias("days"))


def box_stats(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Quartiles, whiskers within 1.5 interquartile ranges and outlier count per bucket.

    A bucket may hold any share of the rows.  The quartiles are a written table, so Spark
    broadcasts them while they are small.
    """
    q = stage(exact_quantiles(df, keys, value, QUARTILES))
    reach = 1.5 * (F.col("q75") - F.col("q25"))
    q = q.withColumns({"_a": F.col("q25") - reach, "_b": F.col("q75") + reach})
    v = F.col(value)
    inside = v.between(F.col("_a"), F.col("_b"))
    return _attach(df, q, keys).where(v.isNotNull()).groupBy(*keys, *QUARTILES).agg(
        F.count("*").alias("n"), F.min(F.when(inside, v)).alias("whisker_low"), F.max(F.when(inside, v)).alias("whisker_high"),
        F.count_if(~inside).alias("outliers"))


# ---- series preparation and unit-root tests


def split_hourly(df: DataFrame) -> DataFrame:
    """Window key: day and clock hour, half-open."""
    return df.withColumn("hour", F.floor(F.pmod(F.col("ep"), F.lit(86_400)) / 3600))


def split_daily(df: DataFrame) -> DataFrame:
    """Window key: day with its first time."""
    first = df.groupBy("d").agg(F.min("ep").alias("first_ep"))
    return df.join(F.broadcast(first), "d")


def interpolate_time(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Fill nulls linearly in time between neighbours, keep the last value after the end, drop leading nulls."""
    w = Window.partitionBy(*keys).orderBy("ep")
    back = w.rowsBetween(Window.unboundedPreceding, 0)
    ahead = w.rowsBetween(0, Window.unboundedFollowing)
    t = F.when(F.col(value).isNotNull(), F.col("ep"))
    df = df.withColumns({"_v0": F.last(value, ignorenulls=True).over(back), "_t0": F.last(t, ignorenulls=True).over(back),
                         "_v1": F.first(value, ignorenulls=True).over(ahead), "_t1": F.first(t, ignorenulls=True).over(ahead)})
    line = F.col("_v0") + (F.col("_v1") - F.col("_v0")) * div(F.col("ep") - F.col("_t0"), F.col("_t1") - F.col("_t0"))
    filled = F.coalesce(F.col(value), line, F.col("_v0"))
    return df.withColumn(value, filled).where("_v0 IS NOT NULL").drop("_v0", "_t0", "_v1", "_t1")


def per_window(df: DataFrame, keys: list[str], value: str, solve, fields: str) -> DataFrame:
    """``solve(y)`` of every window's non-null values in time order, as Arrow groups.

    A window is an hour or a day of a series, at most 86,400 rows.  ``solve`` gives a list of
    rows with ``fields``; an empty list leaves the window out.
    """
    rows = df.where(F.col(value).isNotNull()).select(*keys, "ep", F.col(value).cast("double").alias("_y"))
    types = dict(rows.dtypes)
    schema = ", ".join([*[f"`{k}` {types[k]}" for k in keys], fields])
    names = [f.split()[0] for f in fields.split(", ")]
    keys = list(keys)

    def run(group):
        import pandas as pd

        group = group.sort_values("ep", kind="stable")
        out = pd.DataFrame(solve(group["_y"].to_numpy(dtype=float)), columns=names)
        for i, k in enumerate(keys):
            out.insert(i, k, group[k].iloc[0])
        return out

    return rows.groupBy(*keys).applyInPandas(run, schema)


def lag_products(e, lags: int):
    """Sums of e[t] * e[t - k] for k = 0 to ``lags``, by one transform."""
    import numpy as np

    size = 1 << int(np.ceil(np.log2(len(e) + lags + 1)))
    f = np.fft.rfft(e, size)
    return np.fft.irfft(f * np.conj(f), size)[:lags + 1]


def acf(df: DataFrame, keys: list[str], value: str, lags: int, z: float = 1.959963984540054) -> DataFrame:
    """Autocorrelation up to ``lags`` per window with its Bartlett band, one row per lag."""
    def solve(y):
        import numpy as np

        n, e = len(y), y - y.mean()
        if n <= lags or e @ e <= 0:
            return []
        r = lag_products(e, lags)[1:] / (e @ e)
        band = z * np.sqrt((1 + 2 * np.append(0.0, np.cumsum(r * r)[:-1])) / n)
        return [(n, k, float(a), float(b)) for k, (a, b) in enumerate(zip(r, band), 1)]

    return per_window(df, keys, value, solve, "n long, lag int, acf double, band double")


def over_days(per_day: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Means over days of autocorrelations per key and lag, with the number of days."""
    return per_day.groupBy(*keys, "lag").agg(F.count("*").alias("days"), *[F.avg(v).alias(v) for v in values])


def pacf(df: DataFrame, keys: list[str], value: str, lags: int) -> DataFrame:
    """Partial autocorrelation by Burg's recursion; each window (one day of a series) is one numpy array."""
    order, names, v = lags, list(keys), value

    def burg(pdf):
        import numpy as np
        import pandas as pd

        x = pdf.sort_values("ep")[v].dropna().to_numpy(float)
        n = len(x)
        if n <= order + 1:
            return pd.DataFrame({**{k: [] for k in names}, "lag": [], "pacf": []})
        f = b = x - x.mean()
        out = []
        for _ in range(order):
            f, b = f[1:], b[:-1]
            scale = float(f @ f + b @ b)
            k = 2.0 * float(f @ b) / scale if scale > 0 else 0.0
            f, b = f - k * b, b - k * f
            out.append(k)
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] * order for k in names}, "lag": range(1, order + 1), "pacf": out})

    types = dict(df.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", lag int, pacf double"
    return df.select(*keys, "ep", value).groupBy(*keys).applyInPandas(burg, schema)


# Published response surfaces for unit-root p-values, by trend.
TAU = {
    "c": {"star": -1.61, "low": -18.83, "high": 2.74, "small": (2.1659, 1.4412, 0.038269), "large": (1.7339, 0.93202, -0.12745, -0.010368)},
    "ct": {"star": -2.89, "low": -16.18, "high": 0.7, "small": (3.2512, 1.6047, 0.049588), "large": (2.5261, 0.61654, -0.37956, -0.060285)},
}
# Published critical-value surfaces (1 %, 5 %, 10 %) in powers of 1/n, by trend.
ADF_CRITICAL = {
    "c": ((-3.43035, -6.5393, -16.786, -79.433), (-2.86154, -2.8903, -4.234, -40.040), (-2.56677, -1.5384, -2.809, 0.0)),
    "ct": ((-3.95877, -9.0531, -28.428, -134.155), (-3.41049, -4.3904, -9.036, -45.374), (-3.12705, -2.5856, -3.925, -22.380)),
}
# Published critical values at 10 %, 5 %, 2.5 % and 1 %, by trend.
KPSS_CRITICAL = {"c": (0.347, 0.463, 0.574, 0.739), "ct": (0.119, 0.146, 0.176, 0.216)}
KPSS_LEVELS = (0.10, 0.05, 0.025, 0.01)


def _poly(x: Column, coefs) -> Column:
    out = F.lit(0.0)
    for c in reversed(coefs):
        out = out * x + F.lit(float(c))
    return out


def adf_pvalue(stat, trend: str = "c") -> Column:
    """P-value of a unit-root statistic."""
    s, t = col(stat), TAU[trend]
    z = F.when(s <= t["star"], _poly(s, t["small"])).otherwise(_poly(s, t["large"]))
    return F.when(s > t["high"], 1.0).when(s < t["low"], 0.0).otherwise(normal_cdf(z))


def adf_critical(n, trend: str = "c") -> list[Column]:
    """Critical values at 1 %, 5 % and 10 % for a sample size."""
    inv = F.lit(1.0) / col(n)
    return [_poly(inv, c) for c in ADF_CRITICAL[trend]]


def kpss_pvalue(stat, trend: str = "c") -> Column:
    """P-value by interpolation between the published critical values, held at the ends."""
    s, crit = col(stat), KPSS_CRITICAL[trend]
    out = F.when(s <= crit[0], KPSS_LEVELS[0])
    for a, b, pa, pb in zip(crit, crit[1:], KPSS_LEVELS, KPSS_LEVELS[1:]):
        out = out.when(s <= b, pa + (s - a) * ((pb - pa) / (b - a)))
    return out.otherwise(KPSS_LEVELS[-1])


def adf_statistic(y, lags: int, trend: str):
    """(nobs, statistic) of the regression of the difference on the level, ``lags`` lagged differences and the trend terms.

    The cross products of lagged differences follow from one row of them: the next row adds
    one product at the front and drops one at the end, so no regressor matrix is built.
    """
    import numpy as np

    y = y - y.mean()
    d = np.diff(y)
    m = len(d)
    n = m - lags
    k = 1 + (trend == "ct") + 1 + lags
    if n <= k + 1:
        return None
    g = np.empty((lags + 1, lags + 1))
    first = np.correlate(d, d[lags:], "valid")[::-1]
    g[0], g[:, 0] = first, first
    for i in range(lags):
        g[i + 1, 1:] = g[i, :-1] + d[lags - 1 - i] * d[lags - 1::-1][:lags] - d[m - 1 - i] * d[m - 1:m - 1 - lags:-1]
    level = y[lags:-1]
    extra = [np.ones(n), level] + ([np.arange(lags + 2, m + 2, dtype=float)] if trend == "ct" else [])
    cross = np.array([np.correlate(d, x, "valid")[::-1] for x in extra])
    inner = np.array([[a @ b for b in extra] for a in extra])
    a = np.block([[inner, cross[:, 1:]], [cross[:, 1:].T, g[1:, 1:]]])
    b = np.append(cross[:, 0], g[0, 1:])
    scale = np.sqrt(np.diag(a))
    if not (scale > 0).all():
        return n, None
    a, b = a / np.outer(scale, scale), b / scale
    pick = np.zeros(len(b))
    pick[1] = 1
    try:
        beta, unit = np.linalg.solve(a, np.column_stack([b, pick])).T
    except np.linalg.LinAlgError:
        return n, None
    var = (g[0, 0] - beta @ b) / (n - k) * unit[1]
    return n, float(beta[1] / np.sqrt(var)) if var > 0 else None


def adf(df: DataFrame, keys: list[str], value: str, lags: int = 0, trend: str = "c") -> DataFrame:
    """Augmented Dickey-Fuller test per window with a fixed number of lagged differences."""
    def solve(y):
        found = adf_statistic(y, lags, trend) if len(y) else None
        return [found] if found else []

    return per_window(df, keys, value, solve, "nobs long, stat double").withColumn("pvalue", adf_pvalue("stat", trend))


def kpss_statistic(y, lags: int, trend: str):
    """(nobs, statistic): cumulated residuals over a Bartlett-weighted long-run variance."""
    import numpy as np

    n = len(y)
    if n <= lags + 1:
        return None
    e = y - y.mean()
    if trend == "ct":
        t = np.arange(n) - (n - 1) / 2
        e = e - (t @ e) / (t @ t) * t
    products = lag_products(e, lags)
    weights = 1 - np.arange(1, lags + 1) / (lags + 1.0)
    variance = (e @ e + 2 * weights @ products[1:]) / n
    return n, float((np.cumsum(e) ** 2).sum() / (n * n) / variance) if variance else None


def kpss(df: DataFrame, keys: list[str], value: str, lags: int, trend: str = "c") -> DataFrame:
    """Stationarity test per window; p-values are held at the ends of the published table (0.01 and 0.10)."""
    if trend not in KPSS_CRITICAL:
        raise ValueError(f"unknown trend {trend!r}")

    def solve(y):
        found = kpss_statistic(y, lags, trend)
        return [found] if found else []

    return per_window(df, keys, value, solve, "nobs long, stat double").withColumn("pvalue", kpss_pvalue("stat", trend))


def stationarity_run(df: DataFrame, value: str, windows: dict[str, list[str]], lags: dict[str, list[int]], trends=("c", "ct"), deltas=(0,), tests=("adf", "kpss"), only=None) -> DataFrame:
    """One row per test, trend, window kind, window, delta and lag: test, regression, frequency, lag, delta, window, nobs, stat, pvalue.

    ``windows`` names the key columns of each kind of window ({"daily": ["d"], "hourly": ["d", "hour"]}).
    A delta takes differences over as many rows inside the window, 0 the series itself.  ``only``
    restricts the table to some (test, trend, lag).  All of them are computed in one grouped
    pass per kind of window.
    """
    statistic = {"adf": adf_statistic, "kpss": kpss_statistic}
    out = None
    for kind, keys in windows.items():
        cases = [(t, r, lag) for lag in lags[kind] for r in trends for t in tests if only is None or (t, r, lag) in only]

        def solve(y, cases=cases):
            rows = []
            for delta in deltas:
                x = y[delta:] - y[:-delta] if delta else y
                for test, trend, lag in cases:
                    found = statistic[test](x, lag, trend) if len(x) else None
                    if found:
                        rows.append((test, trend, lag, delta, *found))
            return rows

        part = per_window(df, keys, value, solve, "test string, regression string, lag long, delta long, nobs long, stat double")
        p = F.lit(None).cast("double")
        for trend in trends:
            here = F.col("regression") == trend
            p = F.when(here & (F.col("test") == "adf"), adf_pvalue("stat", trend)).when(here, kpss_pvalue("stat", trend)).otherwise(p)
        window = F.concat_ws(" ", *[F.col(k).cast("string") for k in keys]).alias("window")
        part = part.select("test", "regression", F.lit(kind).alias("frequency"), "lag", "delta", window, "nobs", "stat", p.alias("pvalue"))
        out = part if out is None else out.unionByName(part)
    return out


def stationarity_share(results: DataFrame, keys: list[str], level: float = 0.05) -> DataFrame:
    """Share of windows that look stationary by each test; input columns test, pvalue."""
    ok = F.when(F.col("test") == "adf", F.col("pvalue") <= level).otherwise(F.col("pvalue") > level)
    return results.where("pvalue IS NOT NULL").groupBy(*keys, "test").agg(F.avg(ok.cast("double")).alias("share"), F.count("*").alias("windows"))


# ---- mean crossover


def crossover_time(df: DataFrame, value: str, days: int) -> DataFrame:
    """Distance to the mean of the previous ``days`` days and seconds until its sign changes.

    Linear in the rows: the mean comes from one row per day, the next change from sign
    runs inside the day.  ``no_crossover`` marks later data without a change.
    """
    per_day = df.groupBy("d").agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
    back = Window.orderBy("d").rowsBetween(-days, -1)  # one row per calendar day
    per_day = per_day.select("d", F.sum("_s").over(back).alias("_s"), F.sum("_n").over(back).alias("_n"),
                             F.row_number().over(Window.orderBy("d")).alias("_i"))
    mean = F.when(F.col("_i") > days, div("_s", "_n"))
    x = df.join(F.broadcast(per_day.select("d", mean.alias("_mean"))), "d").withColumn("delta", F.col(value) - F.col("_mean"))
    w = Window.partitionBy("d").orderBy("ep")
    x = x.withColumn("_last", F.lead("ep").over(w).isNull())
    seen = x.where("delta IS NOT NULL").withColumn("_sign", F.signum("delta"))
    change = F.coalesce(F.col("_sign") != F.lag("_sign").over(w), F.lit(True)).cast("int")
    seen = seen.withColumn("_run", F.sum(change).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = seen.groupBy("d", "_run").agg(F.min("ep").alias("_from"))
    runs = runs.withColumn("_next", F.lead("_from").over(Window.partitionBy("d").orderBy("_run"))).drop("_from")
    seen = seen.withColumn("_later", F.lead("ep").over(w).isNotNull()).join(runs, ["d", "_run"])
    usable = ~F.col("_last") & (F.abs("delta") > 1e-8)
    seen = seen.select("d", "ep", F.when(usable, (F.col("_next") - F.col("ep")).cast("double")).alias("seconds"),
                       (usable & F.col("_next").isNull() & F.col("_later")).alias("no_crossover"))
    out = x.select("d", "ep", value, "delta").join(seen, ["d", "ep"], "left")
    return out.withColumn("no_crossover", F.coalesce("no_crossover", F.lit(False)))


def first_crossover(times: DataFrame, step_s: int = 1) -> DataFrame:
    """Flag finite times that are not the countdown of the previous finite time.

    The previous finite time of earlier days is carried by one row per day.
    """
    w = Window.partitionBy("d").orderBy("ep").rowsBetween(Window.unboundedPreceding, -1)
    ends = times.groupBy("d").agg(F.max_by("seconds", F.when(F.col("seconds").isNotNull(), F.col("ep"))).alias("_end"))
    ends = ends.select("d", F.last("_end", ignorenulls=True).over(Window.orderBy("d").rowsBetween(Window.unboundedPreceding, -1)).alias("_carry"))
    prev = F.coalesce(F.last("seconds", ignorenulls=True).over(w), F.col("_carry"))
    going = F.coalesce(F.col("seconds") == prev - step_s, F.lit(False))
    return times.join(F.broadcast(ends), "d").withColumn("first_crossover", F.col("seconds").isNotNull() & ~going).drop("_carry")


def crossover_integrity(times: DataFrame) -> DataFrame:
    """Counts and shares of finite, infinite and null values, before and after the first-crossover filter."""
    parts = times.withColumn("part", F.explode(F.when(F.col("first_crossover"), F.array(F.lit("all"), F.lit("first"))).otherwise(F.array(F.lit("all")))))
    delta, sec, inf = F.col("delta"), F.col("seconds"), F.col("no_crossover")
    aggs = {"delta_finite": F.count(delta), "delta_null": F.count_if(delta.isNull()), "time_finite": F.count(sec),
            "time_infinite": F.count_if(inf), "time_null": F.count_if(sec.isNull() & ~inf)}
    out = parts.groupBy("part").agg(F.count("*").alias("n"), *[c.alias(n) for n, c in aggs.items()])
    return out.withColumns({f"{n}_pct": F.col(n) * 100.0 / F.col("n") for n in aggs})


def crossover_by_quantile(times: DataFrame, bins: int) -> DataFrame:
    """Time statistics by quantile bin of the distance, over first crossovers."""
    df = stage(times.where("first_crossover AND delta IS NOT NULL").select("delta", "seconds"))
    edges = exact_quantiles(df, [], "delta", {f"e{i}": i / bins for i in range(1, bins)})
    b = F.lit(0)
    for i in range(1, bins):
        b = b + (F.col("delta") > F.col(f"e{i}")).cast("int")
    df = df.join(F.broadcast(edges)).select(b.alias("bin"), "seconds", "delta")
    q = exact_quantiles(df, ["bin"], "seconds", QUARTILES)
    g = df.groupBy("bin").agg(F.count("*").alias("n"), F.avg("seconds").alias("mean_seconds"), F.min("delta").alias("low"), F.max("delta").alias("high"))
    return g.join(q, "bin")


def crossover_by_threshold(times: DataFrame, thresholds: list[float]) -> DataFrame:
    """Time statistics of first crossovers at least a threshold away from the mean, by sign of the distance."""
    df = times.where("first_crossover AND delta IS NOT NULL").select("delta", "seconds")
    hit = F.filter(F.array(*[F.lit(float(x)) for x in thresholds]), lambda x: F.abs(F.col("delta")) >= x)
    long = stage(df.select(F.explode(hit).alias("threshold"), F.signum("delta").cast("int").alias("sign"), "seconds"))
    return describe(long, ["threshold", "sign"], "seconds")

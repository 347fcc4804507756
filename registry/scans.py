"""Scans, sinks, projections and filters."""

import datetime as dt

from pyspark.sql import functions as F

from registry.base import query
from tickloom import schema as S
from tickloom.functions.expr import US, day_start, epoch_us
from tickloom.operators import dates as D
from tickloom.operators import grid as G
from tickloom.operators import ordered as O
from tickloom.operators import profit as P
from tickloom.sources import readers as R
from tickloom.sources import sinks as K
from tickloom.sources import tree as X

COLS = S.book_columns(10)
TICKER = S.TICKERS[0]
BOOK = "role:s us:i " + " ".join(f"{c}:f" for c in COLS)


def daily_files(t):
    """A raw tree of the day files, native names, rows in the order they came."""
    root = K.work_folder(t.spark)
    X.write_daily_files(t.lob.select(F.lit(TICKER).alias("ticker"), "role", "d", "ts", F.col("event_id").alias("line"), *COLS), root)
    return root


@query("scan_lob", f"role:s d:d file:s line:i us:i {' '.join(f'{c}:f' for c in COLS)}", f"""
       SELECT role, d, role || '_lob_freq_1s_' || strftime(d, '%Y_%m_%d') || '.parquet' AS file, ROW_NUMBER() OVER (PARTITION BY role, d ORDER BY event_id) - 1 AS line, us, {', '.join(COLS)} FROM lob""")
def _(t):
    return X.read_daily_files(t.spark, daily_files(t)).withColumn("us", epoch_us("ts"))


def store(t, *columns):
    """The book as a partitioned store."""
    rows = t.lob.select(F.lit(TICKER).alias("ticker"), "role", "d", "us", *columns)
    return X.write_store(rows, K.work_folder(t.spark))


@query("scan_lob_partition", "role:s d:d us:i l1_bid_price:f l1_ask_price:f",
       "SELECT role, d, us, l1_bid_price, l1_ask_price FROM lob WHERE role = 'ctd' AND d BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'")
def _(t):
    root = store(t, "l1_bid_price", "l1_ask_price", "l1_bid_size", "l1_ask_size")
    return X.read_store(t.spark, root, TICKER, "ctd", dt.date(2024, 1, 5), dt.date(2024, 1, 20))


@query("scan_lob_day", "role:s us:i l1_bid_price:f l1_ask_price:f",
       "SELECT role, us, l1_bid_price, l1_ask_price FROM lob WHERE role = 'fut' AND d = DATE '2024-01-09'")
def _(t):
    day = dt.date(2024, 1, 9)
    return X.read_daily_files(t.spark, daily_files(t), TICKER, "fut", day, day).withColumn("us", epoch_us("ts"))


@query("file_date", "name:s file_day:d n:i", """
       SELECT role || '_lob_freq_1s_' || strftime(d, '%Y_%m_%d') || CASE WHEN DAY(d) % 5 = 0 THEN '.old.parquet' ELSE '.parquet' END AS name, CASE WHEN DAY(d) % 5 <> 0 THEN d END AS file_day, COUNT(*) AS n
       FROM lob GROUP BY role, d""")
def _(t):
    """Days from the names of the files that rows come from; names of another form have none."""
    ext = F.when(F.dayofmonth("d") % 5 == 0, ".old.parquet").otherwise(".parquet")
    root = K.work_folder(t.spark)
    rows = t.lob.select(F.lit(TICKER).alias("ticker"), "role", "d", "ts", F.col("event_id").alias("line"), "l1_bid_price")
    X.write_daily_files(rows, root, F.concat("role", F.lit("_lob_freq_1s_"), F.date_format("d", "yyyy_MM_dd"), ext), F.lit(""))
    found = R.with_file_date(t.spark.read.parquet(root).select("*", F.col("_metadata.file_name").alias("name")))
    return found.groupBy("name", F.col("session_date").alias("file_day")).agg(F.count("*").alias("n"))


@query("scan_series_filtered", "role:s us:i value:f", """
       SELECT role, us, l1_ask_price AS value FROM lob WHERE d IN (DATE '2024-01-03', DATE '2024-01-04', DATE '2024-01-15')
       AND us % 86400000000 BETWEEN 32400000000 AND 61200000000""")
def _(t):
    days = [dt.date(2024, 1, 3), dt.date(2024, 1, 4), dt.date(2024, 1, 15)]
    return X.read_store(t.spark, store(t, F.col("l1_ask_price").alias("value")), TICKER, include=days, opens=S.WINDOW_OPEN, closes=S.WINDOW_CLOSE)


@query("scan_daily_cf", "d:d cf:f isin:s cusip:s", "SELECT * FROM daily_cf")
def _(t):
    return t.daily_cf


@query("scan_event_dates", "kind:s d:d", """
       SELECT 'rollover' AS kind, last_trading AS d FROM fut_metadata UNION SELECT 'delivery', delivery FROM fut_metadata
       UNION SELECT 'critical', d FROM excluded_raw WHERE kind = 'Critical' UNION SELECT 'extra', d FROM excluded_raw WHERE kind = 'Extra'
       UNION SELECT 'switch', d FROM (SELECT d, isin, LAG(isin) OVER (ORDER BY d) AS p FROM daily_cf) v WHERE isin IS DISTINCT FROM p""")
def _(t):
    parts = [("rollover", t.fut_metadata, F.col("last_trading")), ("delivery", t.fut_metadata, F.col("delivery")),
             ("critical", t.excluded_raw.where("kind = 'Critical'"), F.col("d")),
             ("extra", t.excluded_raw.where("kind = 'Extra'"), F.col("d")),
             ("switch", D.switch_dates(t.daily_cf), F.col("d"))]
    out = None
    for kind, df, c in parts:
        one = R.event_dates(df, c).withColumn("kind", F.lit(kind))
        out = one if out is None else out.unionByName(one)
    return out


@query("scan_static", "isin:s coupon_rate:f coupon_freq:i first_coupon:d maturity:d n_days:i", """
       SELECT m.*, COUNT(k.d) AS n_days FROM ctd_metadata m LEFT JOIN daily_cf k ON k.isin = m.isin GROUP BY ALL""")
def _(t):
    n = t.daily_cf.groupBy("isin").agg(F.count("*").alias("n_days"))
    return t.ctd_metadata.join(n, "isin", "left").fillna(0, ["n_days"])


BERLIN = "epoch_us(timezone('Europe/Berlin', timezone('UTC', {})))"


@query("scan_ticks", "ep:i l1_bid_price:f l1_ask_price:f mid:f", f"""
       WITH k AS (SELECT {BERLIN.format("ts")} AS us, l1_bid_price, l1_ask_price FROM lob WHERE role = 'fut')
       SELECT b.ep, l1_bid_price, l1_ask_price, mid FROM (SELECT unnest(generate_series(a, z, 60)) AS ep FROM
        (SELECT MIN(us // 60000000 * 60) AS a, MAX(us // 60000000 * 60) AS z FROM k)) b
       LEFT JOIN (SELECT us // 60000000 * 60 AS ep, arg_max(l1_bid_price, us) AS l1_bid_price, arg_max(l1_ask_price, us) AS l1_ask_price,
        arg_max((l1_bid_price + l1_ask_price) / 2, us) AS mid FROM k GROUP BY 1) x ON x.ep = b.ep""")
def _(t):
    """Tick files of all instruments, read for one, on the market's clock."""
    path = K.work_folder(t.spark)
    t.lob.select(F.col("role").alias("#RIC"), F.date_format(F.timestamp_micros("us"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("Date-Time"), F.col("l1_bid_price").alias("L1-BidPrice"), F.col("l1_ask_price").alias("L1-AskPrice")).write.csv(path, header=True)
    ticks = R.read_ticks(t.spark, path, "fut", "`#RIC` string, `Date-Time` timestamp, `L1-BidPrice` double, `L1-AskPrice` double").withColumn("role", F.lit("fut"))
    bins = ticks.groupBy("role", (F.floor(F.col("us") / (60 * US)) * 60).alias("ep")).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("us"))).alias(c) for c in ("l1_bid_price", "l1_ask_price", "mid")])
    return G.resample_last(bins, ["role"], 60, ["l1_bid_price", "l1_ask_price", "mid"])


@query("scan_proposals", "order_id:i start_us:i end_us:i bid_price:f bid_qty:f ask_price:f ask_qty:f", f"""
       SELECT order_id, {BERLIN.format("make_timestamp(start_us)")} AS start_us, {BERLIN.format("make_timestamp(end_us)")} AS end_us, bid_price, bid_qty, ask_price, ask_qty
       FROM proposals WHERE bond_code = 'IT0001' AND status = 0 AND check_logon = 0""")
def _(t):
    """Order files under their own names, on the market's clock."""
    names = {"bond_code": "BONDCODE", "status": "STATUS", "check_logon": "CHECK_LOGON", "bid_price": "BIDPRICE", "bid_qty": "BIDQTY", "ask_price": "ASKPRICE", "ask_qty": "ASKQTY"}
    path = K.work_folder(t.spark)
    t.proposals.select("order_id", *[F.col(a).alias(b) for a, b in names.items()], F.timestamp_micros("start_us").alias("updateTS"), F.timestamp_micros("end_us").alias("endTS")).write.parquet(path)
    return R.read_proposals(t.spark, path, "IT0001")


@query("scan_feature_catalog", "role:s ep:i ctd_mid_price:f", """
       SELECT role, ep, (l1_bid_price + l1_ask_price) / 2 AS ctd_mid_price FROM quotes1 WHERE role = 'ctd'""")
def _(t):
    from tickloom.plans.catalog import load_feature

    return load_feature(t.quotes1, "ctd_mid_price")


@query("scan_wide_features", "ep:i a:f b:f", """
       SELECT COALESCE(a.ep, b.ep) AS ep, a.v AS a, b.v AS b FROM
        (SELECT ep, l1_bid_size AS v FROM quotes1 WHERE role = 'ctd') a FULL JOIN
        (SELECT ep, l1_ask_size AS v FROM quotes1 WHERE role = 'fut') b ON a.ep = b.ep""")
def _(t):
    from tickloom.plans.catalog import join_series

    a = t.quotes1.where("role = 'ctd'").select("ep", F.col("l1_bid_size").alias("v"))
    b = t.quotes1.where("role = 'fut'").select("ep", F.col("l1_ask_size").alias("v"))
    return join_series({"a": a, "b": b})


MARKET = "ctd_bid_price:f ctd_ask_price:f ctd_bid_size:f ctd_ask_size:f fut_bid_price:f fut_ask_price:f fut_bid_size:f fut_ask_size:f"
EXCL = "SELECT unnest(generate_series(d - days_before, d + days_after, INTERVAL 1 DAY))::DATE AS d FROM excluded_raw"


@query("sink_lob", "role:s d:d n:i bid:f3", """
       SELECT role, d, COUNT(*) AS n, SUM(l1_bid_price) AS bid FROM quotes1 GROUP BY role, d""")
def _(t):
    path = K.write_book(t.quotes1, K.work_folder(t.spark))
    back = t.spark.read.parquet(path)
    return back.groupBy("role", "d").agg(F.count("*").alias("n"), F.sum(F.round(F.col("l1_bid_price").cast("double"), 4)).alias("bid"))


@query("sink_features", "d:d n:i spread:f3", """
       SELECT d, COUNT(*) AS n, SUM(l1_ask_price - l1_bid_price) AS spread FROM quotes1 GROUP BY d""")
def _(t):
    f = t.quotes1.select("role", "d", "ep", (F.col("l1_ask_price") - F.col("l1_bid_price")).alias("spread"))
    back = t.spark.read.parquet(K.write_features(f, K.work_folder(t.spark)))
    return back.groupBy("d").agg(F.count("*").alias("n"), F.sum(F.round(F.col("spread").cast("double"), 4)).alias("spread"))


@query("sink_results", "price_mode:s role:s n:i", """
       SELECT m AS price_mode, role, COUNT(*) AS n FROM lob CROSS JOIN (VALUES ('mid'), ('quoted')) v(m) GROUP BY ALL""")
def _(t):
    modes = F.explode(F.array(F.lit("mid"), F.lit("quoted"))).alias("price_mode")
    counts = t.lob.groupBy("role").agg(F.count("*").alias("n")).select(modes, "role", "n")
    return t.spark.read.parquet(K.write_results(counts, K.work_folder(t.spark), ["price_mode"]))


@query("organize_raw", "name:s role:s yyyy:s mm:s n:i stored:i", """
       SELECT name, CASE WHEN ok THEN role END AS role, CASE WHEN ok THEN strftime(d, '%Y') ELSE '' END AS yyyy,
              CASE WHEN ok THEN strftime(d, '%m') ELSE '' END AS mm, n, CASE WHEN ok THEN n ELSE 0 END AS stored FROM (
        SELECT CASE WHEN role = 'fut' THEN 'futures' ELSE role END || CASE WHEN DAY(d) = 7 THEN '-' ELSE '_lob_freq_1s_' END
               || strftime(d, '%Y_%m_%d') || '.parquet' AS name, role, d, DAY(d) <> 7 AS ok, COUNT(*) AS n FROM lob GROUP BY role, d)""")
def _(t):
    """Files of one flat folder, a few with names that do not fit, laid out as a store and counted there."""
    raw = F.when(F.col("role") == "fut", "futures").otherwise(F.col("role"))
    gap = F.when(F.dayofmonth("d") == 7, "-").otherwise("_lob_freq_1s_")
    flat, root = K.work_folder(t.spark), K.work_folder(t.spark)
    rows = t.lob.select(F.lit(TICKER).alias("ticker"), "role", "d", "ts", F.col("event_id").alias("line"), *S.book_columns(1))
    X.write_daily_files(rows, flat, F.concat(raw, gap, F.date_format("d", "yyyy_MM_dd"), F.lit(".parquet")), F.lit(""))
    files = X.organize(t.spark, flat, root, TICKER).withColumn("d", R.file_date(F.col("file")))
    stored = X.read_store(t.spark, root).groupBy("role", "d").agg(F.count("*").alias("stored"))
    return files.join(stored, ["role", "d"], "left").select(F.col("file").alias("name"), "role", "yyyy", "mm", F.col("rows").alias("n"), F.coalesce("stored", F.lit(0)).alias("stored"))


@query("merge_deliveries", "role:s us:i delivery_no:i l1_ask_price:f", """
       SELECT role, us, delivery_no, l1_ask_price FROM (
        SELECT role, d, us, 1 AS delivery_no, l1_ask_price FROM lob UNION ALL
        SELECT role, d, us, 2, l1_ask_price + 1 FROM lob WHERE DAY(d) % 3 = 0) u
       WHERE delivery_no = CASE WHEN DAY(d) % 3 = 0 THEN 2 ELSE 1 END""")
def _(t):
    first = t.lob.select("role", "d", "us", F.lit(1).alias("delivery_no"), "l1_ask_price")
    second = first.where("DAY(d) % 3 = 0").withColumn("delivery_no", F.lit(2)).withColumn("l1_ask_price", F.col("l1_ask_price") + 1)
    return R.merge_deliveries(first.unionByName(second), ["role", "d"])


# ---- projections and filters


@query("select_levels", "role:s us:i l2_bid_price:f l2_bid_size:f", "SELECT role, us, l2_bid_price, l2_bid_size FROM lob")
def _(t):
    names = S.book_columns([2], ["bid"])
    S.require_columns(t.lob, names)
    return t.lob.select("role", "us", *names)


@query("filter_time", "role:s us:i", "SELECT role, us FROM lob WHERE us % 86400000000 BETWEEN 31500000000 AND 61200000000")
def _(t):
    return D.filter_time(t.lob, S.WINDOW_OPEN, S.WINDOW_CLOSE, lookback_s=900)


@query("filter_market_hours", "role:s d:d kept:i dropped:i", """
       SELECT role, d, COUNT(*) FILTER (ok) AS kept, COUNT(*) FILTER (NOT ok) AS dropped FROM (
        SELECT role, d, us % 86400000000 BETWEEN 28800000000 AND CASE role WHEN 'ctd' THEN 63000000000 ELSE 68400000000 END AS ok FROM lob)
       GROUP BY role, d""")
def _(t):
    ok = D.in_market_hours()
    return t.lob.groupBy("role", "d").agg(F.count_if(ok).alias("kept"), F.count_if(~ok).alias("dropped"))


@query("filter_dates", "role:s us:i", f"SELECT role, us FROM lob WHERE d NOT IN ({EXCL})")
def _(t):
    return D.drop_dates(t.lob, D.excluded_dates(t.excluded_raw))


@query("expand_dates", "d:d n:i", """
       SELECT x.d, COUNT(l.us) AS n FROM (SELECT DISTINCT unnest(generate_series(last_trading - 2, last_trading + 1, INTERVAL 1 DAY))::DATE AS d
        FROM fut_metadata) x LEFT JOIN lob l ON l.d = x.d GROUP BY x.d""")
def _(t):
    days = D.expand_dates(t.fut_metadata.select(F.col("last_trading").alias("d")), 2, 1)
    n = t.lob.groupBy("d").agg(F.count("*").alias("n"))
    return F.broadcast(days).join(n, "d", "left").fillna(0, ["n"])


@query("excluded_dates", "d:d n:i", f"SELECT x.d, COUNT(l.us) AS n FROM (SELECT DISTINCT d FROM ({EXCL})) x LEFT JOIN lob l ON l.d = x.d GROUP BY x.d")
def _(t):
    n = t.lob.groupBy("d").agg(F.count("*").alias("n"))
    return D.excluded_dates(t.excluded_raw).join(n, "d", "left").fillna(0, ["n"])


@query("tz_normalize", "us:i localized_us:i converted_us:i", """
       SELECT us, us AS localized_us, epoch_us(timezone('Europe/Berlin', timezone('UTC', ts))) AS converted_us FROM lob""")
def _(t):
    """A time without zone is the market's already, an instant is converted."""
    both = t.lob.select("us", "ts", F.timestamp_micros("us").alias("instant"))
    return both.select("us", epoch_us(R.market_time(both, "ts")[0]).alias("localized_us"), epoch_us(R.market_time(both, "instant")[0]).alias("converted_us"))


DUPS = "SELECT role, us // 60000000 AS m, us, event_id, l1_ask_price FROM lob WHERE event_id % 50 <> 0"


@query("drop_null_ts", "role:s us:i", "SELECT role, us FROM lob WHERE event_id % 50 <> 0")
def _(t):
    broken = t.lob.withColumn("ts", F.when(F.col("event_id") % 50 != 0, F.col("ts")))
    return broken.dropna(subset=["ts"])


@query("dedup_ts", "role:s m:i us:i l1_ask_price:f", f"""
       SELECT role, m, us, l1_ask_price FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY role, m ORDER BY us, event_id) AS rn FROM ({DUPS}) x)
       WHERE rn = 1""")
def _(t):
    from tickloom.operators.quality import keep_first

    coarse = t.lob.where("event_id % 50 <> 0").select("role", F.floor(F.col("us") / (60 * US)).alias("m"), "us", "event_id", "l1_ask_price")
    return keep_first(coarse, ["role", "m"], ["us", "event_id"])


@query("conform_columns", "role:s us:i l1_bid_price:f l1_bid_size:f l1_ask_price:f l1_ask_size:f l11_bid_price:f",
       "SELECT role, us, l1_bid_price, l1_bid_size, l1_ask_price, l1_ask_size, CAST(NULL AS DOUBLE) AS l11_bid_price FROM lob")
def _(t):
    return R.conform(t.lob, S.book_columns(1) + ["l11_bid_price"], ["role", "us"])


@query("naive_dates", "role:s midnight:i n:i", "SELECT role, us - us % 86400000000 AS midnight, COUNT(*) AS n FROM lob GROUP BY 1, 2")
def _(t):
    midnight = day_start(F.to_date("ts")) * US
    return t.lob.groupBy("role", midnight.alias("midnight")).agg(F.count("*").alias("n"))


query("session_date", "event_id:i session_date:d", "SELECT event_id, CAST(ts AS DATE) AS session_date FROM lob")(
    lambda t: t.lob.select("event_id", F.to_date("ts").alias("session_date")))


@query("drop_reset_obs", "seed:i episode:i ep:i reward:f", """
       SELECT seed, episode, ep, reward FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY seed, episode ORDER BY ep) AS rn FROM records) WHERE rn > 1""")
def _(t):
    from tickloom.operators.report import drop_reset

    return drop_reset(t.records)


@query("drop_terminal_obs", "seed:i episode:i ep:i reward:f", "SELECT seed, episode, ep, reward FROM records WHERE NOT terminal")
def _(t):
    return t.records.where(~F.col("terminal"))


@query("trim_quantiles", "event_id:i value:f", """
       SELECT event_id, value FROM events, (SELECT quantile_cont(value, 0.05) AS lo, quantile_cont(value, 0.95) AS hi FROM events) q
       WHERE value BETWEEN lo AND hi""")
def _(t):
    from tickloom.operators.stats import trim

    return trim(t.events.select("event_id", "value"), "value", 0.05, 0.95)


@query("match_xy", "ep:i x:f y:f", """
       SELECT a.ep, a.l1_bid_size AS x, b.l1_ask_size AS y FROM (SELECT * FROM book1 WHERE role = 'ctd') a
       JOIN (SELECT ep + 1 AS ep, l1_ask_size FROM book1 WHERE role = 'ctd') b ON a.ep = b.ep WHERE a.l1_bid_size IS NOT NULL AND b.l1_ask_size IS NOT NULL
       UNION ALL SELECT ep, l1_bid_size, l1_bid_price FROM book1 WHERE l1_bid_price IS NOT NULL AND l1_bid_size IS NOT NULL AND role = 'fut'""")
def _(t):
    from tickloom.operators.model import match_xy

    a = t.book1.where("role = 'ctd'")
    x = a.select("ep", F.col("l1_bid_size").alias("x"))
    y = a.select((F.col("ep") + 1).alias("ep"), F.col("l1_ask_size").alias("y"))
    b = t.book1.where("role = 'fut'")
    first = match_xy(x, y, "ep", "y", drop_null_features=True)
    second = match_xy(b.select("ep", F.col("l1_bid_size").alias("x")), b.select("ep", F.col("l1_bid_price").alias("y")), "ep", "y", True)
    return first.unionByName(second)


@query("split_by_date_share", "role:s us:i split:s", """
       SELECT role, us, CASE WHEN i < floor(n * 0.6) THEN 'train' WHEN i < floor(n * (0.6e0 + 0.2e0)) THEN 'val' ELSE 'test' END AS split
       FROM lob JOIN (SELECT d, ROW_NUMBER() OVER (ORDER BY d) - 1 AS i, COUNT(*) OVER () AS n FROM (SELECT DISTINCT d FROM lob)) r USING (d)""")
def _(t):
    return D.split_by_date_share(t.lob.select("role", "us", "d"), 0.6, 0.2)


@query("split_by_month", "event_id:i split:s", """
       SELECT event_id, CASE WHEN d + 14 < DATE '2024-02-01' THEN 'train' ELSE 'test' END AS split FROM lob""")
def _(t):
    shifted = t.lob.select("event_id", F.date_add("d", 14).alias("d"))
    return D.split_by_month(shifted, "2024-01")


@query("restrict_sampled_dates", "role:s us:i", """
       SELECT role, us FROM lob WHERE d IN (SELECT d FROM lob WHERE event_id % 997 = 0)""")
def _(t):
    """The sampled days choose the folders when the query runs."""
    return X.read_store(t.spark, store(t, "l1_bid_price"), TICKER, include=t.lob.where("event_id % 997 = 0").select("d"))


@query("price_mode", "ep:i mode:s ctd_bid_price:f ctd_ask_price:f fut_bid_price:f fut_ask_price:f", """
       SELECT ep, 'quoted' AS mode, ctd_bid_price, ctd_ask_price, fut_bid_price, fut_ask_price FROM market5 UNION ALL
       SELECT ep, 'mid', (ctd_bid_price + ctd_ask_price) / 2, (ctd_bid_price + ctd_ask_price) / 2, (fut_bid_price + fut_ask_price) / 2,
              (fut_bid_price + fut_ask_price) / 2 FROM market5""")
def _(t):
    modes = F.explode(F.array(F.lit("quoted"), F.lit("mid"))).alias("price_mode")
    return P.execution_prices(t.market5.select("*", modes)).withColumn("mode", F.col("price_mode"))


MASK_COLS = "ep:i volume_mode:s long_entry:b short_entry:b long_exit:b short_exit:b"
MASK_SQL = """
    SELECT ep, volume_mode, volume_mode = 'ignore' OR (ctd_ask_size >= 2 AND fut_bid_size >= 2) AS {0},
           volume_mode = 'ignore' OR (ctd_bid_size >= 2 AND fut_ask_size >= 2) AS {1}
    FROM market5 CROSS JOIN (VALUES ('ignore'), ('level')) v(volume_mode)"""


def _masks(t):
    modes = F.explode(F.array(F.lit("ignore"), F.lit("level"))).alias("volume_mode")
    return P.execution_masks(t.market5.select("*", modes), n_bonds=2.0, n_futures=F.lit(2.0))


query("entry_mask", "ep:i volume_mode:s long_entry:b short_entry:b", MASK_SQL.format("long_entry", "short_entry"))(_masks)
query("exit_mask", "ep:i volume_mode:s long_exit:b short_exit:b", MASK_SQL.format("short_exit", "long_exit"))(_masks)


@query("sampling_windows", "part:s role:s n:i", """
       SELECT part, role, COUNT(*) AS n FROM lob JOIN (VALUES ('sampling', 32400, 60600), ('features', 30240, 60600), ('target', 32400, 61200))
        v(part, a, z) ON us % 86400000000 BETWEEN a * 1000000::BIGINT AND z * 1000000::BIGINT GROUP BY part, role""")
def _(t):
    bounds = D.sampling_bounds(S.WINDOW_OPEN, S.WINDOW_CLOSE, 600, deltas=(60,), windows=(300, 1800), lags=(60, 360))
    out = None
    for part, (a, z) in bounds.items():
        n = D.filter_time(t.lob, a, z).groupBy("role").agg(F.count("*").alias("n")).withColumn("part", F.lit(part))
        out = n if out is None else out.unionByName(n)
    return out


@query("sort_ts", "role:s us:i place:i", """
       SELECT role, us, us // 60000000 * 100 + ROW_NUMBER() OVER (PARTITION BY role, us // 60000000 ORDER BY us) AS place FROM lob""")
def _(t):
    from pyspark.sql import Window

    minute = F.floor(F.col("us") / (60 * US))
    # Ranges of (role, minute) hold whole minutes, so the window needs no other shuffle.
    sorted_ = t.lob.select("role", "us", minute.alias("m")).repartitionByRange("role", "m")
    w = Window.partitionBy("role", "m").orderBy("us")
    return sorted_.withColumn("place", F.col("m") * 100 + F.row_number().over(w))


LONG = " UNION ALL ".join(f"SELECT role, us, '{s}' AS side, l{n}_{s}_price AS price FROM lob" for s in S.SIDES for n in (1, 2, 3))


@query("top_levels", "role:s us:i side:s rank:i price:f", f"""
       SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY role, us, side ORDER BY CASE side WHEN 'bid' THEN -price ELSE price END NULLS LAST) AS rank
        FROM ({LONG}) x) y WHERE rank <= 2""")
def _(t):
    from tickloom.operators.book import row_levels

    return row_levels(t.lob, 3, 2)


@query("cf_segments", "isin:s first_day:d last_day:d n:i", """
       SELECT isin, MIN(d) AS first_day, MAX(d) AS last_day, COUNT(*) AS n FROM daily_cf GROUP BY isin""")
def _(t):
    return t.daily_cf.groupBy("isin").agg(F.min("d").alias("first_day"), F.max("d").alias("last_day"), F.count("*").alias("n"))


@query("union_days", "part:s seed:i episode:i ep:i", """
       SELECT 'train' AS part, seed, episode, ep FROM records WHERE episode <= 19742 UNION ALL
       SELECT 'test', seed, episode + m, ep FROM records JOIN (SELECT seed, MAX(episode) AS m FROM records WHERE episode <= 19742 GROUP BY seed) USING (seed)
       WHERE episode > 19742""")
def _(t):
    from tickloom.operators.report import append_episodes

    return append_episodes(t.records.where("episode <= 19742"), t.records.where("episode > 19742"))


@query("date_set_ops", "op:s d:d", """
       SELECT 'union' AS op, d FROM (SELECT last_trading AS d FROM fut_metadata UNION SELECT d FROM excluded_raw) UNION ALL
       SELECT 'present', d FROM (SELECT d FROM lob INTERSECT SELECT d FROM excluded_raw) UNION ALL
       SELECT 'left', d FROM (SELECT d FROM lob EXCEPT SELECT d FROM excluded_raw)""")
def _(t):
    days = t.lob.select("d").distinct()
    special = t.excluded_raw.select("d")
    rolls = t.fut_metadata.select(F.col("last_trading").alias("d"))
    parts = {"union": rolls.union(special).distinct(), "present": days.intersect(special), "left": days.exceptAll(special.distinct())}
    out = None
    for op, df in parts.items():
        one = df.withColumn("op", F.lit(op))
        out = one if out is None else out.unionByName(one)
    return out


@query("sample_uniform", "event_id:i value:f", """
       SELECT event_id, value FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY md5('42:' || event_id), event_id) AS k, COUNT(*) OVER () AS n FROM events) x
       WHERE k <= GREATEST(1, floor(n * 0.05))""")
def _(t):
    return O.sample_exact(t.events.select("event_id", "value"), "event_id", ratio=0.05, seed=42)

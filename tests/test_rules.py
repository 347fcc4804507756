"""Edge rules of sources, dates, joins, coupons and quality checks on tiny tables."""

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from tickloom import schema as S
from tickloom.functions.expr import epoch_us
from tickloom.operators import book as B
from tickloom.operators import dates as D
from tickloom.operators import grid as G
from tickloom.operators import model as M
from tickloom.operators import quality as Q
from tickloom.operators import report as R
from tickloom.plans import repo_rate as RR
from tickloom.sources import readers, sinks
from tickloom.streaming import book as ST

D1, D2 = dt.date(2024, 1, 2), dt.date(2024, 1, 3)


def dates(spark, *ds):
    return spark.createDataFrame([(d,) for d in ds], "d date")


def test_asof_on_the_event_day(spark):
    row = D.event_distance(dates(spark, D1), dates(spark, D1, D2)).first()
    assert (row.days_to_next, row.days_to_prev) == (0, 0)
    strict = D.event_distance(dates(spark, D1), dates(spark, D1, D2), strict=True).first()
    assert strict.days_to_next == 1
    none = D.event_distance(dates(spark, D2), dates(spark, D1), strict=True).first()
    assert none.next_event is None and none.days_to_prev == -1


def test_delivery_is_strictly_later(spark):
    fut = spark.createDataFrame([(D1, D1), (D2, D2)], "last_trading date, delivery date")
    assert RR.delivery_after(dates(spark, D1), fut).first().delivery == D2


def test_coupon_month_end_does_not_drift(spark):
    bond = spark.createDataFrame([("A", 0.04, 2, dt.date(2023, 8, 31), dt.date(2025, 8, 31))], "isin string, coupon_rate double, coupon_freq int, first_coupon date, maturity date")
    got = [r.coupon_date for r in RR.coupon_schedule(bond).orderBy("coupon_date").collect()]
    assert got == [dt.date(2023, 8, 31), dt.date(2024, 2, 29), dt.date(2024, 8, 31), dt.date(2025, 2, 28), dt.date(2025, 8, 31)]
    RR.require_regular(bond)
    with pytest.raises(ValueError):
        RR.require_regular(bond.withColumn("coupon_freq", F.lit(5)))


def test_accrued_interest_rules(spark):
    bond = spark.createDataFrame([("A", 0.04, 2, dt.date(2024, 1, 1), dt.date(2025, 1, 1))], "isin string, coupon_rate double, coupon_freq int, first_coupon date, maturity date")
    df = RR.with_schedule(bond).crossJoin(dates(spark, dt.date(2024, 1, 1), dt.date(2024, 4, 1), dt.date(2023, 12, 31), dt.date(2025, 1, 1)))
    got = {r.d: r.ai for r in df.select("d", RR.accrued(F.col("d")).alias("ai")).collect()}
    assert got[dt.date(2024, 1, 1)] == 0 and got[dt.date(2023, 12, 31)] == 0 and got[dt.date(2025, 1, 1)] == 0
    assert got[dt.date(2024, 4, 1)] == pytest.approx(2.0 * 91 / 182)


def test_daily_table_guards(spark):
    rows = dates(spark, D1, D2)
    with pytest.raises(ValueError, match="1 duplicate"):
        G.require_daily(rows, dates(spark, D1, D1, D2))
    with pytest.raises(ValueError, match="1 missing"):
        G.require_daily(rows, dates(spark, D1))
    G.require_daily(rows, rows)


def test_include_and_exclude_exclude_each_other(spark):
    with pytest.raises(ValueError):
        readers.filter_series(spark.createDataFrame([(D1, 1)], "d date, us long"), 0, 1, include=[D1], exclude=[D2])


def test_filter_time_is_exact_below_a_second(spark):
    us = [17 * 3600 * 10**6, 17 * 3600 * 10**6 + 400_000, 9 * 3600 * 10**6, 9 * 3600 * 10**6 - 1]
    df = spark.createDataFrame([(u,) for u in us], "us long")
    assert {r.us for r in D.filter_time(df, S.WINDOW_OPEN, S.WINDOW_CLOSE).collect()} == {us[0], us[2]}


def test_tick_tolerance_grows_with_the_price(spark):
    df = spark.createDataFrame([("ctd", 100.001), ("ctd", 100.005), ("ctd", 1.001), ("ctd", 100.01)], "role string, p double")
    got = [r[0] for r in df.select(Q.off_multiple("p", "price")).collect()]
    assert got == [False, True, True, False]


def test_gaps_touch_the_edges(spark):
    base = 19_724 * 86_400
    cols = {c: "double" for c in S.book_columns(3)}
    rows = [("ctd", dt.date(2024, 1, 2), base + i, *([None if i in (0, 1, 4, 7) else 1.0] * 12)) for i in range(8)]
    df = spark.createDataFrame(rows, "role string, d date, ep long, " + ", ".join(f"{n} {t}" for n, t in cols.items()))
    got = [(r.first_ep - base, r.last_ep - base, r.rows) for r in Q.gaps(df).orderBy("first_ep").collect()]
    assert got == [(0, 1, 2), (4, 4, 1), (7, 7, 1)]
    open_day = spark.createDataFrame([("ctd", D1, "level_1", 32_300, 32_459), ("fut", D1, "level_1", 32_300, 32_460), ("fut", D2, "level_1", 0, 30_000)],
                                     "role string, d date, scope string, first_ep long, last_ep long")
    assert [r.role for r in Q.critical_gaps(open_day).collect()] == ["fut"]


def test_day_without_valid_rows_is_critical(spark):
    df = spark.createDataFrame([("ctd", D1, "level_1", None, None)], "role string, d date, scope string, first_us long, last_us long")
    assert Q.critical_window(df).count() == 1


def test_series_guard(spark):
    good = spark.createDataFrame([("a", 1), ("a", 2)], "k string, t long")
    Q.require_series(good, "k", "t")
    for bad in (good.union(good), good.withColumn("t", F.lit(None).cast("long")), good.limit(0)):
        with pytest.raises(ValueError):
            Q.require_series(bad, "k", "t")


def test_book_pads_and_sorts_levels(spark):
    orders = spark.createDataFrame([(0, 10, 100.0, 1.0, 101.0, 2.0), (0, 20, 100.0, 4.0, 0.0, 9.0), (10, 20, 99.0, 1.0, 102.0, 3.0)],
                                   "s long, e long, bid_price double, bid_qty double, ask_price double, ask_qty double")
    orders = orders.withColumn("start_us", F.col("s") * 10**6).withColumn("end_us", F.col("e") * 10**6)
    got = {r.ep: r for r in B.rebuild_book(orders, 10, 2).collect()}
    assert (got[0].l1_bid_size, got[0].l1_ask_size, got[0].l2_bid_price) == (5.0, 2.0, None)
    assert (got[10].l1_bid_size, got[10].l2_bid_price, got[10].l2_ask_price) == (5.0, 99.0, 102.0)
    assert (got[20].l1_bid_size, got[20].l1_ask_price, got[20].mid) == (4.0, 102.0, 101.0)


def test_resample_keeps_empty_bins_and_columns_apart(spark):
    df = spark.createDataFrame([("k", 1, 1.0, None), ("k", 4, None, 2.0), ("k", 31, 3.0, 4.0)], "k string, ep long, a double, b double")
    got = [tuple(r) for r in G.resample_last(df, ["k"], 10, ["a", "b"]).orderBy("ep").select("ep", "a", "b").collect()]
    assert got == [(0, 1.0, 2.0), (10, None, None), (20, None, None), (30, 3.0, 4.0)]


def test_classes_are_right_closed(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (2.5,), (None,)], "y double")
    assert [r[0] for r in df.select(M.classify("y", [1.0, 2.0])).collect()] == [0, 1, 2, None]
    with pytest.raises(ValueError):
        M.class_edges(spark.createDataFrame([(1.0,)] * 5, "y double"), "y", 3)


def test_short_tasks_carry_an_error(spark):
    df = spark.createDataFrame([("a", float(i), float(i)) for i in range(9)] + [("b", float(i), float(-i)) for i in range(10)], "k string, x double, y double")
    got = {r.k: r for r in M.pearson(df, ["k"], "x", "y").collect()}
    assert got["a"].pc is None and got["a"].error and got["b"].pc == pytest.approx(-1) and got["b"].error is None


def test_two_terminal_rows_are_an_error(spark):
    df = spark.createDataFrame([(1, "bid", 1, 10, 0, 1, True), (1, "bid", 1, 20, 1, 1, True)], "seed int, side string, episode int, us long, step int, action int, terminal boolean")
    df = df.withColumns({"status": F.lit("limit"), "benchmark_price": F.lit(1.0), "execution_price": F.lit(1.0)})
    with pytest.raises(ValueError):
        R.require_single_terminal(R.exec_terminal(df))


def test_wall_clock_ignores_the_session_zone(spark):
    df = spark.sql("SELECT timestamp_ntz'2024-03-31 02:30:00.123456' AS ts")
    want = df.select(epoch_us("ts")).first()[0]
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for other in ("Europe/Berlin", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", other)
            assert df.select(epoch_us("ts")).first()[0] == want == 1_711_852_200_123_456
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_daily_event_respects_summer_time(spark):
    df = spark.sql("SELECT timestamp_ntz'2024-03-11 12:00:00' AS a, timestamp_ntz'2024-04-02 12:00:00' AS b")
    f = lambda c: D.time_to_daily_event(F.col(c), "Europe/Berlin", "America/New_York", "09:30:00", unit_s=60)
    assert tuple(df.select(f("a"), f("b")).first()) == (150, 210)


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "cf.csv").write_text("Date,CF,ISIN,CUSIP\n2024-01-02,0.95,A,B\n2024-01-03,NaN,A,B\n")
    got = readers.read_daily_cf(spark, str(tmp_path / "cf.csv")).orderBy("d").collect()
    assert got[0].cf == 0.95 and got[1].cf is None
    (tmp_path / "sw.csv").write_text("CTD Switch Date\n2024-01-03\n2024-01-03\n\n")
    assert [r.d for r in readers.read_event_dates(spark, str(tmp_path / "sw.csv"), "CTD Switch Date").collect()] == [D2]
    (tmp_path / "bond.csv").write_text("ISIN,Coupon Annual Rate,Coupon Frequency,First Coupon Date,Maturity Date\nA,0.04,2,2020-01-01,2030-01-01\n")
    assert readers.read_bonds(spark, str(tmp_path / "bond.csv")).first().coupon_freq == 2
    (tmp_path / "fut.csv").write_text("Last Trading Date,Delivery Date\n2024-01-02,2024-01-03\n")
    assert readers.read_futures(spark, str(tmp_path / "fut.csv")).first().delivery == D2
    (tmp_path / "ticks.csv").write_text("#RIC,Date-Time,L1-BidPrice,L1-AskPrice\nF,2024-01-02 09:00:00,99,101\nG,2024-01-02 09:00:01,1,2\n")
    schema = "`#RIC` string, `Date-Time` timestamp_ntz, `L1-BidPrice` double, `L1-AskPrice` double"
    ticks = readers.read_ticks(spark, str(tmp_path / "ticks.csv"), "F", schema).collect()
    assert len(ticks) == 1 and ticks[0].mid == 100


def test_proposals_file(spark, tmp_path):
    spark.sql("""SELECT 'A' AS BONDCODE, 0 AS STATUS, 0 AS CHECK_LOGON, timestamp_ntz'2024-01-02 09:00:00' AS updateTS, timestamp_ntz'2024-01-02 09:00:05' AS endTS,
                 1.0D AS BIDPRICE, 1.0D AS BIDQTY, 2.0D AS ASKPRICE, 1.0D AS ASKQTY UNION ALL SELECT 'A', 1, 0, timestamp_ntz'2024-01-02 09:00:00', timestamp_ntz'2024-01-02 09:00:05', 1, 1, 2, 1
              """).write.parquet(str(tmp_path / "p"))
    rows = readers.read_proposals(spark, str(tmp_path / "p"), "A").collect()
    assert len(rows) == 1 and rows[0].end_us - rows[0].start_us == 5_000_000


def test_book_files_and_partition_pruning(spark, tmp_path):
    raw = spark.sql("SELECT timestamp_ntz'2024-01-02 09:00:00' AS timestamp, double('nan') AS l1_bid_price, 2.0D AS l1_ask_price, 1 AS junk")
    raw.write.parquet(str(tmp_path / "fut_lob_2024_01_02.parquet"))
    book = readers.read_book(spark, str(tmp_path / "fut_lob_2024_01_02.parquet"), levels=1)
    row = book.first()
    assert book.columns == ["ts", *S.book_columns(1)] and row.l1_bid_price is None and row.l1_ask_price == 2.0
    assert readers.column_report(raw, S.book_columns(1), ["timestamp"]) == (["l1_ask_size", "l1_bid_size"], ["junk"])
    with pytest.raises(ValueError):
        readers.time_column(raw.drop("timestamp"))
    with pytest.raises(ValueError):
        readers.time_column(raw.withColumn("Date-Time", F.col("timestamp")))
    with pytest.raises(ValueError):
        S.require_columns(raw, ["l9_bid_price"])
    df = spark.range(48).select(F.when(F.col("id") % 2 == 0, "ctd").otherwise("fut").alias("role"), F.date_add(F.lit(D1), (F.col("id") / 24).cast("int")).alias("d"),
                                (F.col("id") * 3600).alias("ep"), F.col("id").cast("double").alias("x"))
    path = sinks.write_book(df, str(tmp_path / "table"))
    back = spark.read.parquet(path).where((F.col("role") == "ctd") & (F.col("d") == F.lit(D1)))
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert back.count() == 12 and "PartitionFilters: [isnotnull(role" in plan and dict(back.dtypes)["x"] == "float"


def test_file_names(spark):
    df = spark.createDataFrame([("ctd_lob_2024_01_02.parquet",), ("x.csv",)], "n string")
    assert [r[0] for r in df.select(readers.file_date(F.col("n"))).collect()] == [D1, None]
    names = spark.createDataFrame([("futures_lob_freq_1s_2024_01_02.parquet",), ("bad.parquet",)], "n string")
    assert [r.role for r in names.select(*readers.raw_layout(F.col("n"))).collect()] == ["fut", None]


def test_time_column_of_a_written_file_name(spark, tmp_path):
    spark.range(1).write.parquet(str(tmp_path / "t"))
    assert readers.with_file_date(spark.read.parquet(str(tmp_path / "t"))).first().session_date is None


def test_stream_flow_equals_batch(spark, tmp_path):
    from tickloom.functions import micro
    from tickloom.operators.ordered import day_window

    rows = [("fut" if i % 3 else "ctd", 86_400 * (1 + i // 40) + i * 7, 100.0 + (i * 7919 % 5) / 100, 1.0 + i % 4, 101.0 + (i * 31 % 3) / 100, 2.0 + i % 3) for i in range(80)]
    schema = "role string, ep long, l1_bid_price double, l1_bid_size double, l1_ask_price double, l1_ask_size double"
    df = spark.createDataFrame(rows, schema).withColumn("us", F.col("ep") * 10**6).withColumn("d", F.date_from_unix_date(F.floor(F.col("ep") / 86_400).cast("int")))
    df.drop("d").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = ST.read_stream(spark, str(tmp_path / "in"), "*.parquet", df.drop("d").schema)
    got = ST.run_to_table(ST.stream_flow(stream, "role"), "append").select("key", "ep", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("bof_1", "aof_1")])
    w = day_window()
    want = df.select("role", "ep", micro.flow("bid", 1, w).alias("bof_1"), micro.flow("ask", 1, w).alias("aof_1"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_order_flow_is_the_sum_of_both_sides(spark):
    from tickloom.functions import micro
    from tickloom.operators.ordered import day_window

    rows = [("ctd", D1, i, 100.0 + i % 3, 1.0 + i % 2, 105.0 + i % 2, 2.0 + i % 3) for i in range(20)]
    df = spark.createDataFrame(rows, "role string, d date, ep long, l1_bid_price double, l1_bid_size double, l1_ask_price double, l1_ask_size double")
    w = day_window()
    out = df.select(micro.flow("bid", 1, w).alias("b"), micro.flow("ask", 1, w).alias("a"), micro.flow_imbalance(1, w).alias("o")).collect()
    assert all((r.o is None and r.b is None) or r.o == r.a + r.b for r in out) and sum(r.o is None for r in out) == 1


def test_one_second_day_runs(spark):
    """A full one-second analysis day through the feature compiler."""
    from tickloom.plans import features as X

    base = 19_724 * 86_400 + 32_400
    day = spark.range(28_801).select(F.lit(D1).alias("d"), (F.col("id") + base).alias("ep"), F.sin(F.col("id") / 500).alias("x"))
    out = X.compile_features(day, ["x_roll_mean_1800s", "x_delta_60s_lag_300s", "x_hour_ratio"], bases=["x"])
    assert out.where("x_delta_60s_lag_300s IS NULL").count() == 360 and out.where("x_roll_mean_1800s IS NULL").count() == 899


def test_hot_second_and_hot_role_collapse(spark):
    """A third of all rows in one second of one role leaves one row, the last one."""
    hot = spark.range(20_000).select(F.lit("ctd").alias("role"), (F.lit(5_000_000) + F.col("id")).alias("us"), F.col("id").cast("double").alias("l1_bid_price"))
    rest = spark.range(40_000).select(F.lit("fut").alias("role"), (F.col("id") * 250_000).alias("us"), F.lit(None).cast("double").alias("l1_bid_price"))
    got = G.snap(hot.unionByName(rest).repartition(9), ["role"], 1)
    assert got.where("role = 'ctd'").collect()[0].l1_bid_price == 19_999 and got.where("role = 'ctd'").count() == 1
    assert got.where("role = 'fut'").count() == 10_000 and got.where("role = 'fut' AND l1_bid_price IS NOT NULL").isEmpty()


def test_latest_delivery_wins_per_key(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 2.0), ("a", 2, 3.0), ("b", 1, 4.0)], "k string, delivery_no int, x double")
    assert sorted(r.x for r in readers.merge_deliveries(df, ["k"]).collect()) == [2.0, 3.0, 4.0]


def test_native_names_are_read(spark, tmp_path):
    rows = [(dt.datetime(2024, 1, 2, 9), 100.0, 2.0, 99.5, float("nan"))]
    raw = spark.createDataFrame(rows, "timestamp timestamp_ntz, `L1-BidPrice` double, `L1-AskSize` double, `L10-BidPrice` double, `L10-AskPrice` double")
    raw.write.parquet(str(tmp_path / "a.parquet"))
    book = readers.read_book(spark, str(tmp_path / "a.parquet"))
    row = book.first()
    assert book.columns == ["ts", *S.book_columns(10)]
    assert (row.l1_bid_price, row.l1_ask_size, row.l10_bid_price, row.l10_ask_price, row.l5_bid_size) == (100.0, 2.0, 99.5, None, None)
    raw.select("timestamp").withColumn("mid", F.lit(1.0)).write.parquet(str(tmp_path / "b.parquet"))
    with pytest.raises(ValueError, match="no book column"):
        readers.read_book(spark, str(tmp_path / "b.parquet"))


def test_checks_keep_tickers_and_deep_levels_apart(spark):
    base = {c: (100.005 if "price" in c else 1.0) for c in S.book_columns(10)}
    for lv in range(1, 11):
        base[f"l{lv}_bid_price"], base[f"l{lv}_ask_price"] = 100.005 - lv, 100.005 + lv
    deep = {**base, "l9_bid_size": -1.0, "l10_ask_price": None}
    rows = [(ticker, "fut", D1, 36_000_000_000, *values.values()) for ticker, values in (("fbtp", base), ("fbts", base), ("fbts", deep))]
    book = spark.createDataFrame(rows, "ticker string, role string, d date, us long, " + ", ".join(f"{c} double" for c in base))
    found = {(r.ticker, r.check_id): r.n for r in Q.issues(book, Q.consistency_checks(book)).groupBy("ticker", "check_id").agg(F.sum("n").alias("n")).collect()}
    # The half tick is a defect of the long future only; the deep defects belong to the short one.
    assert found == {("fbtp", "PRICE_NON_MULTIPLE"): 20, ("fbts", "SIZE_NON_POSITIVE"): 1, ("fbts", "PRICE_SIZE_PARTIAL"): 1}
    nulls = {(r.ticker, r.scope): r.n_null for r in Q.null_stats(book).collect()}
    assert nulls["fbts", "book"] == 1 and nulls["fbtp", "book"] == 0
    quotes = book.withColumn("ep", F.lit(36_000)).unionByName(book.withColumns({"ep": F.lit(36_000), "role": F.lit("ctd")}))
    assert G.snap_roles(quotes, 1).count() == 2 and G.join_roles(quotes.dropDuplicates(["ticker", "role"])).count() == 2


def test_switch_dates_count_a_bond_that_comes_back(spark):
    days = [dt.date(2024, 1, i) for i in range(1, 6)]
    daily = spark.createDataFrame([(d, i, c) for d, i, c in zip(days, "AABBA", "XXYYX")], "d date, isin string, cusip string")
    assert [r.d.day for r in D.switch_dates(daily).orderBy("d").collect()] == [1, 3, 5]
    with pytest.raises(ValueError, match="do not change together"):
        D.switch_dates(daily.withColumn("cusip", F.lit("X")))


def test_late_rows_are_not_lost_in_silence(spark, tmp_path):
    schema = "us long, role string, l1_bid_price double"
    day = 86_400_000_000
    for n, shift in enumerate((0, 2 * day, -2 * day)):
        spark.createDataFrame([(3 * day + shift + i * 1_000_000, "ctd", float(n)) for i in range(5)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)
    read = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    whole = ST.latest(ST.run_to_table(ST.stream_snap(read(), ["role"], 60, "30 days"), "update"), ["role", "ep"])
    assert whole.count() == 3
    with pytest.raises(ValueError, match="later than the delay"):
        ST.run_to_table(ST.stream_snap(read(), ["role"], 60, "1 minute"), "update")


def test_release_deletes_staged_folders(spark):
    path = sinks.work_folder(spark)
    spark.range(3).write.parquet(path)
    assert spark.read.parquet(path).count() == 3 and sinks.release(spark) >= 1
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)

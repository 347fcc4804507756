"""Cleaning with a fate per row, and trees of files with what they skip."""

import datetime as dt
import os
import re

import pytest
from pyspark.sql import functions as F

from tickloom.operators import clean as C
from tickloom.schema import book_columns
from tickloom.sources import tree as T

DAY = dt.date(2024, 3, 5)
ONE = book_columns(1)


def at(h, m=0, s=0, us=0, day=DAY):
    return dt.datetime.combine(day, dt.time(h, m, s, us))


def raw(spark, times, role="ctd", d=DAY, columns=ONE, kind="timestamp_ntz"):
    rows = [(role, d, t, i, *[float(i)] * len(columns)) for i, t in enumerate(times)]
    return spark.createDataFrame(rows, f"role string, d date, ts {kind}, line long, " + ", ".join(f"`{c}` double" for c in columns))


def records(found):
    return {r.id: r.n for r in found.records.collect()}


def test_every_record(spark):
    """Planted: a null time, two rows outside, a repeated second, disorder, a missing column and two extra ones."""
    times = [at(8), None, at(7, 59, 59), at(9, 0, 1, 5), at(9, 0, 1, 2), at(17, 30), at(17, 30, 1)]
    got = C.clean(raw(spark, times, columns=[*ONE[:3], "other", "more"]), ONE, "line")
    assert records(got) == {"TIMEZONE_LOCALIZED": 7, "INDEX_SORTED": 1, "INDEX_WINDOW_CUT": 2, "INDEX_DROP_NANS": 1, "INDEX_DROP_DUPS": 1, "INDEX_GRID_ADJUSTED": 34_198,
                            "COLUMNS_MISSING_ADD": 1, "COLUMNS_EXTRA_DROP": 2}
    C.require_conserved(got.report)
    kept = got.book.where("fate = 'observed'").orderBy("ep").collect()
    assert [r.l1_bid_price for r in kept] == [0.0, 4.0, 5.0] and all(r.l1_ask_size is None for r in kept)
    assert got.book.count() == 34_201 and got.book.columns == ["role", "d", "ep", "fate", *ONE]


def test_instants_are_converted(spark):
    """An instant is the market's clock whatever the session zone; summer and winter differ by an hour."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for name in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", name)
            for day, hour in ((dt.date(2024, 1, 10), 9), (dt.date(2024, 7, 10), 10)):
                us = int(dt.datetime(day.year, day.month, day.day, 8, tzinfo=dt.timezone.utc).timestamp()) * 10**6
                df = spark.range(1).select(F.lit("fut").alias("role"), F.lit(day).alias("d"), F.timestamp_micros(F.lit(us)).alias("ts"), F.lit(0).alias("line"), *[F.lit(1.0).alias(c) for c in ONE])
                got = C.clean(df, ONE, "line")
                assert records(got) == {"TIMEZONE_CONVERTED": 1, "INDEX_GRID_ADJUSTED": 39_600}
                assert got.book.where("fate = 'observed'").first().ep % 86_400 == hour * 3600
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


@pytest.mark.parametrize("times,late", [([at(9), at(10), at(10), at(11)], False), ([at(9, us=1), at(9, us=3), at(9, us=2)], True), ([at(9), at(11), at(10)], True), ([at(9), at(8), at(9)], True)])
def test_order(spark, times, late):
    assert C.clean(raw(spark, times), ONE, "line").report.first().unsorted is late


def test_coarse_grid_and_two_days(spark):
    both = raw(spark, [at(8), at(8, 4), at(12, 7)]).unionByName(raw(spark, [at(9, day=DAY), at(9, day=dt.date(2024, 3, 6))], d=dt.date(2024, 3, 6)))
    got = C.clean(both, ONE, "line", step=300)
    C.require_conserved(got.report, 300)
    rows = {r.d: r for r in got.report.collect()}
    assert (rows[DAY].kept, rows[DAY].duplicate) == (2, 1) and rows[dt.date(2024, 3, 6)].outside == 1
    assert C.clean(raw(spark, []), ONE, "line").book.count() == 0


def test_not_a_time(spark):
    with pytest.raises(ValueError):
        C.clean(raw(spark, []).withColumn("ts", F.lit("x")), ONE, "line")


# ---- trees


def market(spark):
    """Two tickers and roles, forty days of four quotes, a NaN among them."""
    days = spark.range(40).select(F.date_add(F.lit(dt.date(2024, 1, 20)), F.col("id").cast("int")).alias("d"))
    hours = F.explode(F.array(*[F.lit(h) for h in (7, 10, 13, 19)])).alias("h")
    who = F.explode(F.array(*[F.struct(F.lit(t).alias("ticker"), F.lit(r).alias("role")) for t in ("fbtp", "fbts") for r in ("ctd", "fut")])).alias("w")
    rows = days.select("d", who).select("d", "w.*", hours)
    us = F.unix_date("d").cast("long") * 86_400_000_000 + F.col("h").cast("long") * 3_600_000_000
    price = F.when(F.col("h") == 13, F.lit(float("nan"))).otherwise(F.col("h") + F.day("d") / 100)
    ts = F.expr("CAST(d AS TIMESTAMP_NTZ) + make_dt_interval(0, h, 0, 0)")
    return rows.select("ticker", "role", "d", ts.alias("ts"), F.col("h").alias("line"), us.alias("us"), price.alias("l1_bid_price"), F.lit(1.0).alias("l1_bid_size"))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def files_read(df):
    """Files that the scans of an executed query have opened."""
    df.collect()
    run = df._jdf.queryExecution().executedPlan()
    text = run.toString()
    total, todo = 0, [run]
    while todo:
        node = todo.pop()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            todo.append(node.executedPlan())
        if "QueryStage" in node.nodeName():
            todo.append(node.plan())
        if node.metrics().contains("numFiles"):
            total += node.metrics().apply("numFiles").value()
    return total, text


def test_raw_tree(spark, tmp_path):
    root = str(tmp_path / "raw")
    written = T.write_daily_files(market(spark).drop("us"), root)
    assert written.count() == 160 and written.agg(F.sum("rows")).first()[0] == 640
    assert os.path.exists(f"{root}/fbtp/ctd/2024/02/ctd_lob_freq_1s_2024_02_05.parquet")
    open(f"{root}/fbtp/ctd/2024/02/notes.txt", "w").close()
    all_rows = T.read_daily_files(spark, root)
    assert all_rows.count() == 640 and all_rows.where("l1_bid_price IS NULL").count() == 160 and all_rows.where("l10_ask_size IS NOT NULL").count() == 0
    assert [r.line for r in all_rows.where("ticker = 'fbts' AND role = 'fut' AND d = DATE '2024-02-05'").orderBy("ts").collect()] == [0, 1, 2, 3]
    few = T.read_daily_files(spark, root, "fbtp", "ctd", dt.date(2024, 2, 3), dt.date(2024, 2, 6))
    assert {r.d.day for r in few.select("d").distinct().collect()} == {3, 4, 5, 6} and few.count() == 16
    n, _ = files_read(few)
    assert n == 4
    with pytest.raises(ValueError):
        T.read_daily_files(spark, root, first=DAY)


def test_store_skips(spark, tmp_path):
    root = T.write_store(market(spark).drop("ts", "line"), str(tmp_path / "store"))
    every, _ = files_read(T.read_store(spark, root))
    some = T.read_store(spark, root, "fbtp", "fut", dt.date(2024, 2, 1), dt.date(2024, 2, 10), opens=9 * 3600, closes=11 * 3600)
    n, text = files_read(some)
    assert some.count() == 10 and n < every / 10
    assert re.search(r"PartitionFilters: \[[^\]]*ticker[^\]]*role[^\]]*d#", text) and re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(micros,32400000000\)[^\]]*LessThanOrEqual\(micros,39600000000\)", text)
    days = [dt.date(2024, 2, 2), dt.date(2024, 2, 20)]
    assert T.read_store(spark, root, include=days).count() == 32 and T.read_store(spark, root, exclude=days).count() == 608
    with pytest.raises(ValueError):
        T.read_store(spark, root, include=days, exclude=days)


def test_sampled_days_prune_at_run_time(spark, tmp_path):
    root = T.write_store(market(spark).drop("ts", "line"), str(tmp_path / "store"))
    every, _ = files_read(T.read_store(spark, root))
    days = spark.createDataFrame([(dt.date(2024, 2, 2), 1), (dt.date(2024, 2, 20), 0)], "d date, k int").where("k = 1")
    some = T.read_store(spark, root, include=days)
    n, text = files_read(some)
    assert "dynamicpruning" in text and n <= every / 40 and some.count() == 16


def test_organize(spark, tmp_path):
    flat, root = str(tmp_path / "flat"), str(tmp_path / "store")
    rows = market(spark).where("ticker = 'fbtp'").drop("us")
    raw_name = F.concat(F.when(F.col("role") == "fut", "futures").otherwise(F.col("role")), F.when(F.day("d") == 7, "-").otherwise("_lob_freq_1s_"), F.date_format("d", "yyyy_MM_dd"), F.lit(".parquet"))
    T.write_daily_files(rows, flat, raw_name, F.lit(""))
    found = T.organize(spark, flat, root, "fbtp").collect()
    assert len(found) == 80 and sum(r.role is None for r in found) == 2
    back = T.read_store(spark, root)
    assert back.count() == 312 and {r.mm for r in back.select("mm").distinct().collect()} == {"01", "02"} and back.where("isnan(l1_bid_price)").count() == 0

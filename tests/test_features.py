"""Feature names, transforms and null rules."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.plans import catalog as K
from tickloom.plans import features as X

# Names that must survive a round trip.
NAMES = """basis irr fut_mid_price basis_lag_1s fut_mid_price_lag_300s basis_delta_60s basis_delta_60s_lag_300s basis_roll_mean_30s
basis_roll_mean_30s_lag_10s basis_roll_std_60s basis_roll_min_300s_lag_60s basis_day_ratio basis_hour_ratio_lag_300s fut_bid_price_1 fut_ask_size_10
fut_bid_price_1_delta_60s fut_ask_size_10_roll_std_300s fut_ask_price_5_delta_60s_lag_300s fut_obi_3_delta_60s fut_bof_1 fut_ofi_2_roll_std_300s
fut_micro_price_lag_300s fut_spread_roll_max_300s_lag_60s""".split()


def test_catalog_has_136_ids():
    ids = K.base_ids()
    assert len(ids) == 136 and len(set(ids)) == 136


def test_catalog_columns_match_ids(spark):
    built = [n for r in ("ctd", "fut") for n in K.role_features(r)]
    assert sorted(["basis", "irr", *built]) == sorted(K.base_ids())


@pytest.mark.parametrize("name", NAMES)
def test_round_trip(name):
    assert X.parse(name).name == name


def test_longest_base_wins():
    assert X.parse("fut_bid_price_10").base == "fut_bid_price_10"
    assert X.parse("fut_bid_price_1_lag_3s").base == "fut_bid_price_1"


@pytest.mark.parametrize("name", ["nope", "basis_delta_0s", "basis_lag_0s", "basis_roll_sum_3s", "basis_week_ratio", "basis_lag_1s_lag_2s", "basis_delta_5"])
def test_bad_names(name):
    with pytest.raises(ValueError):
        X.parse(name)


def test_calendar_names_are_split_off():
    assert X.split_names(["basis", "hour_of_day", "hour_of_day_sin"]) == (["basis"], ["hour_of_day"], ["hour_of_day_sin"])


def test_spec_rules():
    names = [f.name for f in X.Spec("basis", deltas=(5, 2), lags=(3,)).features()]
    assert names == ["basis", "basis_lag_3s", "basis_delta_2s", "basis_delta_2s_lag_3s", "basis_delta_5s", "basis_delta_5s_lag_3s"]
    for bad in (dict(deltas=(2, 2)), dict(lags=(0,)), dict(keep_original=False)):
        with pytest.raises(ValueError):
            X.Spec("basis", **bad).features()
    with pytest.raises(ValueError):
        X.Spec("basis", rolls=(("mean", 3), ("mean", 3))).features()
    assert X.lookback([X.parse("basis_roll_mean_30s"), X.parse("irr_lag_10s")]) == 40


@pytest.mark.parametrize("name", list(X.FEATURE_SETS))
def test_feature_sets_parse(name):
    for n in X.feature_set(name, "default", "default"):
        assert n in X.CALENDAR_NAMES or n.endswith(("_sin", "_cos")) or X.parse(n).name == n


def series(spark, values, start=9 * 3600, day=dt.date(2024, 1, 2)):
    base = (day - dt.date(1970, 1, 1)).days * 86_400 + start
    rows = [(day, base + i, None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "d date, ep long, x double")


def column(df, name):
    return [r[name] for r in df.orderBy("ep").collect()]


def test_rolling_counts_non_null_values(spark):
    values = [1, None, 3, 4, None, None, None, 9]
    df = X.compile_features(series(spark, values), ["x_roll_mean_4s", "x_roll_std_4s", "x_roll_mean_1s"], bases=["x"])
    s = pd.Series(values, dtype=float)
    for name, want in (("x_roll_mean_4s", s.rolling(4, min_periods=2).mean()), ("x_roll_std_4s", s.rolling(4, min_periods=2).std()),
                       ("x_roll_mean_1s", s)):
        got = pd.Series(column(df, name), dtype=float)
        np.testing.assert_allclose(got, want)


def test_ratio_references(spark):
    assert column(X.compile_features(series(spark, [0, None, 4, 8]), ["x_day_ratio"], bases=["x"]), "x_day_ratio") == [0, None, 1, 2]
    lone = X.compile_features(series(spark, [0]), ["x_day_ratio"], bases=["x"])
    assert column(lone, "x_day_ratio") == [0]
    zeros = series(spark, [0, 0, None])
    assert X.ratio_violations(zeros, "x", ["d"]).count() == 1
    assert column(X.compile_features(zeros, ["x_day_ratio"], bases=["x"]), "x_day_ratio") == [None, None, None]


def test_hour_ratio_uses_clock_hours(spark):
    df = X.compile_features(series(spark, [2, 4, 8, 16], start=10 * 3600 - 2), ["x_hour_ratio"], bases=["x"])
    assert column(df, "x_hour_ratio") == [1, 2, 1, 2]


def test_lag_stays_inside_the_day(spark):
    two = series(spark, [1, 2]).unionByName(series(spark, [3, 4], day=dt.date(2024, 1, 3)))
    assert column(X.compile_features(two, ["x_lag_1s"], bases=["x"]), "x_lag_1s") == [None, 1, None, 3]


def test_ffill_crosses_days(spark):
    two = series(spark, [None, 2, None]).unionByName(series(spark, [None, None], day=dt.date(2024, 1, 3)))
    two = two.unionByName(series(spark, [None, 5, None], day=dt.date(2024, 1, 4)))
    assert column(X.ffill(two, ["x"], []), "x") == [None, 2, 2, 2, 2, 2, 5, 5]


def test_partitioning_does_not_change_results(spark):
    df = series(spark, range(50))
    names = ["x_delta_3s", "x_roll_max_5s_lag_2s"]
    a = X.compile_features(df.repartition(1), names, bases=["x"]).orderBy("ep").collect()
    b = X.compile_features(df.repartition(11, F.rand(1)), names, bases=["x"]).orderBy("ep").collect()
    assert a == b

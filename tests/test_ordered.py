"""Slot-wise computations against plain pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.operators import ordered as O


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds most rows and one value repeats in a third of them."""
    rng = np.random.default_rng(3)
    n = 6000
    key = np.where(rng.random(n) < 0.7, "hot", rng.choice(["a", "b", "c"], n))
    value = np.where(rng.random(n) < 0.33, 1.5, np.round(rng.normal(0, 10, n), 3))
    pdf = pd.DataFrame({"k": key, "v": value, "i": np.arange(n)})
    pdf.loc[::97, "v"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("v", F.when(~F.isnan("v"), F.col("v"))).repartition(7)
    return pdf, df


@pytest.mark.parametrize("slots", [2, 64])
def test_exact_quantiles_per_key(skewed, slots):
    pdf, df = skewed
    probs = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    got = O.exact_quantiles(df, ["k"], "v", probs, slots).toPandas().set_index("k").sort_index()
    want = pdf.groupby("k")["v"].quantile(list(probs.values())).unstack()
    np.testing.assert_allclose(got[list(probs)].to_numpy(), want.to_numpy())


@pytest.mark.parametrize("most", [3, 400])
def test_exact_quantiles_in_rounds(skewed, most):
    """Slots that hold a target are cut until few values are left, for all keys together."""
    pdf, df = skewed
    probs = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p999": 0.999, "p100": 1.0}
    got = O.exact_quantiles(df, ["k"], "v", probs, 4, most=most).toPandas().set_index("k").sort_index()
    np.testing.assert_allclose(got[list(probs)].to_numpy(), pdf.groupby("k")["v"].quantile(list(probs.values())).unstack().to_numpy())


def test_exact_quantiles_of_a_million_values(spark):
    """A key with a million different values next to one with two, squared so that they crowd at zero."""
    n = 1_000_000
    df = spark.range(n).select(F.lit("many").alias("k"), (F.col("id") * F.col("id")).cast("double").alias("v"), F.lit(1).alias("w"))
    df = df.unionByName(spark.createDataFrame([("few", 1.0, 2), ("few", 4.0, 1)], "k string, v double, w int"))
    got = {r["k"]: r for r in O.exact_quantiles(df, ["k"], "v", {"a": 0.3, "b": 0.5, "c": 1.0}, weight="w", most=500).collect()}
    ids = np.arange(n, dtype=float) ** 2
    np.testing.assert_allclose([got["many"][x] for x in "abc"], np.quantile(ids, [0.3, 0.5, 1.0]))
    assert [got["few"][x] for x in "abc"] == [1.0, 1.0, 4.0]


def test_exact_quantiles_without_keys(skewed):
    pdf, df = skewed
    row = O.exact_quantiles(df, [], "v", {"m": 0.5, "q": 0.123}).first()
    np.testing.assert_allclose([row["m"], row["q"]], pdf["v"].quantile([0.5, 0.123]))


def test_running_total(skewed):
    pdf, df = skewed
    slotted = df.withColumn("slot", F.floor(F.col("i") / 50)).fillna(0.0, ["v"])
    got = O.running(slotted, ["k"], "slot", ["i"], {"total": "v"}).toPandas().sort_values("i")
    want = pdf.fillna({"v": 0.0}).groupby("k")["v"].cumsum()
    np.testing.assert_allclose(got["total"].to_numpy(), want.to_numpy(), atol=1e-8)


@pytest.mark.parametrize("ratio,size", [(0.05, None), (None, 1), (None, 777), (1.0, None)])
def test_sample_size_is_exact_and_repeatable(skewed, ratio, size):
    _, df = skewed
    a = O.sample_exact(df, "i", ratio, size).toPandas()["i"]
    b = O.sample_exact(df.repartition(3), "i", ratio, size).toPandas()["i"]
    assert len(a) == (size or int(6000 * ratio)) and a.is_unique and set(a) == set(b)


def test_sample_needs_one_size(skewed):
    with pytest.raises(ValueError):
        O.sample_exact(skewed[1], "i", 0.1, 5)

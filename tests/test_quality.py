"""Consistency counts against a loop over rows, and the plan that makes them."""

import datetime as dt
from collections import defaultdict

from pyspark.sql import functions as F

from tickloom.operators import quality as Q
from tickloom.schema import book_columns

COLS = book_columns(2)
DAYS = [dt.date(2024, 1, 1), dt.date(2024, 1, 2), None]


def rows(n=400):
    out = []
    for k in range(n):
        cells = [None if (k + i) % 11 == 0 else float((k * (i + 3)) % 9 - 1) + (0.005 if (k + i) % 7 == 0 else 0.0) for i in range(len(COLS))]
        out.append((("ctd", "fut", None)[k % 3], DAYS[k // 7 % 3], None if k % 13 == 0 else 1000 * k, *cells))
    return out


def book(spark, data):
    return spark.createDataFrame(data, "role string, d date, us long, " + ", ".join(f"{c} double" for c in COLS))


def test_issues_equal_a_loop(spark):
    df = book(spark, rows())
    checks = Q.consistency_checks(df)
    inside = F.col("us") % 2000 == 0
    flagged = df.select("role", "d", "us", inside.alias("in"), *[f.alias(f"f{i}") for i, (_, _, f) in enumerate(checks)]).collect()
    want = defaultdict(lambda: [0, 0, []])
    for r in flagged:
        for i, (name, columns, _) in enumerate(checks):
            if r[f"f{i}"]:
                cell = want[r["role"], r["d"], name, tuple(columns)]
                cell[0] += 1
                cell[1] += bool(r["in"])
                cell[2] += [r["us"]] if r["us"] is not None else []
    got = {(r["role"], r["d"], r["check_id"], tuple(r["columns"])): (r["n"], r["n_inside"], r["first_us"], r["last_us"]) for r in Q.issues(df, checks, inside).collect()}
    assert got == {k: (n, m, min(u, default=None), max(u, default=None)) for k, (n, m, u) in want.items()}


def test_issues_of_no_rows(spark):
    df = book(spark, [])
    assert Q.issues(df, Q.consistency_checks(df)).collect() == []


def test_checks_are_not_repeated_as_a_filter(spark):
    df = book(spark, rows(10))
    checks, n = Q.consistency_checks(df), len(COLS)
    narrow = df.select("role", "d", "us", F.lit(True).alias("_in"), Q.fired(checks).alias("_fired"))
    for found in (Q.issues(df, checks), Q.fired_counts(narrow, ["role", "d"], checks)):
        plan = found._jdf.queryExecution().optimizedPlan()
        assert str(plan.toString()).count("Filter (size") == 0
    assert n == 8

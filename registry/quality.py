"""Book quality checks and critical days."""

from pyspark.sql import functions as F

from registry.base import query
from tickloom import schema as S
from tickloom.functions.expr import US
from tickloom.operators import clean as C
from tickloom.operators import quality as Q

LEVELS = 10
COLS = S.book_columns(LEVELS)
P = S.book_columns(LEVELS, kinds=["price"])
Z = S.book_columns(LEVELS, kinds=["size"])
OUT = "role:s d:d check_id:s columns:s n:i first_us:i last_us:i"
INSIDE_SQL = "us % 86400000000 BETWEEN 32400000000 AND 61200000000"


def one(check: str, columns: list[str], cond: str) -> str:
    return (f"SELECT role, d, '{check}' AS check_id, '{','.join(columns)}' AS columns, COUNT(*) AS n, MIN(us) AS first_us, MAX(us) AS last_us, "
            f"COUNT(*) FILTER ({INSIDE_SQL}) AS n_inside FROM lob WHERE {cond} GROUP BY role, d")


def off(c: str, kind: str) -> str:
    tick = "CASE role WHEN 'ctd' THEN 0.01e0 ELSE 0.01e0 END" if kind == "price" else "CASE role WHEN 'ctd' THEN 0.5e0 ELSE 1e0 END"
    q = f"({c} / ({tick}))"
    return f"abs({q} - round_even({q}, 0)) > 1e-8 + 1e-5 * abs(round_even({q}, 0))"


SQL = {
    "dq_price_non_positive": [one("PRICE_NON_POSITIVE", [c], f"{c} <= 0") for c in P],
    "dq_size_non_positive": [one("SIZE_NON_POSITIVE", [c], f"{c} <= 0") for c in Z],
    "dq_price_non_multiple": [one("PRICE_NON_MULTIPLE", [c], off(c, "price")) for c in P],
    "dq_size_non_multiple": [one("SIZE_NON_MULTIPLE", [c], off(c, "size")) for c in Z],
    "dq_bid_order": [one("BID_ORDER", [f"l{i}_bid_price", f"l{i + 1}_bid_price"], f"l{i}_bid_price <= l{i + 1}_bid_price") for i in range(1, LEVELS)],
    "dq_ask_order": [one("ASK_ORDER", [f"l{i}_ask_price", f"l{i + 1}_ask_price"], f"l{i}_ask_price >= l{i + 1}_ask_price") for i in range(1, LEVELS)],
    "dq_crossed": [one("CROSSED", ["l1_bid_price", "l1_ask_price"], "l1_bid_price >= l1_ask_price")],
    "dq_price_size_partial": [one("PRICE_SIZE_PARTIAL", [f"l{i}_{s}_price", f"l{i}_{s}_size"], f"(l{i}_{s}_price IS NULL) <> (l{i}_{s}_size IS NULL)")
                              for i in range(1, LEVELS + 1) for s in S.SIDES],
}
CHECKS = {
    "dq_price_non_positive": lambda: Q.sign_checks("price", LEVELS), "dq_size_non_positive": lambda: Q.sign_checks("size", LEVELS),
    "dq_price_non_multiple": lambda: Q.multiple_checks("price", LEVELS), "dq_size_non_multiple": lambda: Q.multiple_checks("size", LEVELS),
    "dq_bid_order": lambda: Q.order_checks("bid", LEVELS), "dq_ask_order": lambda: Q.order_checks("ask", LEVELS),
    "dq_crossed": Q.crossed_checks, "dq_price_size_partial": lambda: Q.partial_checks(LEVELS)}
ALL = " UNION ALL ".join(s for part in SQL.values() for s in part)


def _register(name):
    @query(name, OUT, " UNION ALL ".join(SQL[name]))
    def _(t):
        return Q.issues(t.lob, CHECKS[name]()).withColumn("columns", F.array_join("columns", ","))


for _name in SQL:
    _register(_name)


@query("dq_issue_counts", "check_id:s issues:i days:i", f"SELECT check_id, SUM(n) AS issues, COUNT(DISTINCT d) AS days FROM ({ALL}) x GROUP BY check_id")
def _(t):
    return Q.issue_counts(Q.issues(t.lob, Q.consistency_checks(t.lob)))


def raw_files(t):
    """Rows as raw files have them: every fiftieth without a time, bond times without zone, future times as instants, a column short and one too many."""
    rows = t.lob.select("role", "d", F.when(F.col("event_id") % 50 != 0, F.col("ts")).alias("ts"), "us", "event_id", F.lit(1).alias("other"), *[c for c in COLS if c != "l10_ask_size"])
    instant = F.when(F.col("event_id") % 50 != 0, F.timestamp_micros("us"))
    return rows.where("role = 'ctd'").drop("us"), rows.where("role = 'fut'").withColumn("ts", instant).drop("us")


def cleaned(t, step):
    return [C.clean(raw, COLS, "event_id", step=step) for raw in raw_files(t)]


RAW_SQL = """raw AS (SELECT *, us - epoch_us(d::TIMESTAMP) AS since, us - epoch_us(d::TIMESTAMP) BETWEEN 28800000000 AND closes::BIGINT * 1000000 AS inside FROM (
       SELECT * REPLACE (CASE WHEN event_id % 50 <> 0 THEN CASE role WHEN 'ctd' THEN us ELSE epoch_us(timezone('Europe/Berlin', timezone('UTC', ts))) END END AS us, CAST(NULL AS DOUBLE) AS l10_ask_size),
              CASE role WHEN 'ctd' THEN 63000 ELSE 68400 END AS closes FROM lob) z)"""


@query("dq_normalization", "role:s d:d id:s n:i", f"""WITH {RAW_SQL}, o AS (SELECT *, us < MAX(us) OVER (PARTITION BY role, d ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS late FROM raw),
       f AS (SELECT role, d, COUNT(*) AS rows, COUNT(*) FILTER (us IS NULL) AS nulls, COUNT(*) FILTER (NOT inside) AS outside, COUNT(DISTINCT since // 1000000) FILTER (inside) AS kept,
                    COUNT(*) FILTER (inside) AS ins, COALESCE(bool_or(late), FALSE) AS unsorted, ANY_VALUE(closes) - 28800 + 1 AS grid FROM o GROUP BY role, d)
       SELECT * FROM (SELECT role, d, unnest(['TIMEZONE_LOCALIZED', 'TIMEZONE_CONVERTED', 'INDEX_SORTED', 'INDEX_WINDOW_CUT', 'INDEX_DROP_NANS', 'INDEX_DROP_DUPS', 'INDEX_GRID_ADJUSTED', 'COLUMNS_MISSING_ADD', 'COLUMNS_EXTRA_DROP']) AS id,
              unnest([CASE role WHEN 'ctd' THEN rows ELSE 0 END, CASE role WHEN 'fut' THEN rows ELSE 0 END, unsorted::INT, outside, nulls, ins - kept, grid - kept, 1, 1]) AS n FROM f) x WHERE n > 0""")
def _(t):
    """What cleaning changed, by the nine records; every row and slot has one fate."""
    ctd, fut = cleaned(t, 1)
    return ctd.records.unionByName(fut.records)


@query("clean_book", f"role:s d:d ep:i fate:s {' '.join(f'{c}:f' for c in COLS)}", f"""WITH {RAW_SQL}, g AS (SELECT role, d, unnest(generate_series(28800, closes, 300)) AS slot FROM (SELECT DISTINCT role, d, closes FROM raw) z),
       k AS (SELECT * FROM raw WHERE inside QUALIFY ROW_NUMBER() OVER (PARTITION BY role, d, (since // 1000000 - 28800) // 300 ORDER BY us, event_id) = 1)
       SELECT g.role, g.d, epoch_us(g.d::TIMESTAMP) // 1000000 + g.slot AS ep, CASE WHEN k.us IS NULL THEN 'added' ELSE 'observed' END AS fate, {', '.join(f'k.{c}' for c in COLS)}
       FROM g LEFT JOIN k ON k.role = g.role AND k.d = g.d AND (k.since // 1000000 - 28800) // 300 = (g.slot - 28800) // 300""")
def _(t):
    """Raw rows on the five-minute grid of the market's hours."""
    ctd, fut = cleaned(t, 300)
    return ctd.book.unionByName(fut.book)


@query("dq_shape", "role:s d:d rows:i columns:i size:i", "SELECT role, d, COUNT(*) AS rows, 40 AS columns, COUNT(*) * 40 AS size FROM lob GROUP BY role, d")
def _(t):
    return Q.shape(t.lob, len(S.book_columns(LEVELS)))


SCOPES = {"book": S.book_columns(LEVELS), "level_1": S.book_columns(1), "level_1_bid": S.book_columns(1, ["bid"]), "level_1_ask": S.book_columns(1, ["ask"]),
          **{c: [c] for c in S.book_columns(1)}}


def nulls_sql(name, cols):
    n = " + ".join(f"COUNT(*) FILTER ({c} IS NULL)" for c in cols)
    every = " AND ".join(f"{c} IS NULL" for c in cols)
    some = " OR ".join(f"{c} IS NULL" for c in cols)
    return (f"SELECT role, d, '{name}' AS scope, {n} AS n_null, ({n}) * 100e0 / (COUNT(*) * {len(cols)}) AS pct_null, COUNT(*) FILTER ({every}) AS rows_all_null, "
            f"COUNT(*) FILTER ({every}) * 100e0 / COUNT(*) AS pct_all_null, COUNT(*) FILTER ({some}) AS rows_any_null, "
            f"COUNT(*) FILTER ({some}) * 100e0 / COUNT(*) AS pct_any_null FROM lob GROUP BY role, d")


@query("dq_nulls", "role:s d:d scope:s n_null:i pct_null:f rows_all_null:i pct_all_null:f rows_any_null:i pct_any_null:f",
       " UNION ALL ".join(nulls_sql(n, c) for n, c in SCOPES.items()))
def _(t):
    return Q.null_stats(t.lob)


def range_sql(name, cols):
    ok = " AND ".join(f"{c} IS NOT NULL" for c in cols)
    return f"SELECT role, d, '{name}' AS scope, MIN(us) FILTER ({ok}) AS first_us, MAX(us) FILTER ({ok}) AS last_us FROM lob GROUP BY role, d"


RANGES = " UNION ALL ".join(range_sql(n, c) for n, c in SCOPES.items())


@query("dq_valid_range", "role:s d:d scope:s first_us:i last_us:i", RANGES)
def _(t):
    return Q.valid_range(t.lob)


def gaps_sql(name, cols):
    e = " AND ".join(f"{c} IS NULL" for c in cols)
    return f"""SELECT role, d, '{name}' AS scope, MIN(ep) AS first_ep, MAX(ep) AS last_ep, COUNT(*) AS rows FROM (
        SELECT *, SUM(CASE WHEN e <> pe THEN 1 ELSE 0 END) OVER (PARTITION BY role, d ORDER BY ep) AS island FROM (
         SELECT *, LAG(e) OVER (PARTITION BY role, d ORDER BY ep) AS pe FROM (SELECT role, d, ep, {e} AS e FROM book1) a) b) c
        WHERE e GROUP BY role, d, island"""


GAP_SCOPES = tuple(SCOPES)


@query("dq_gaps", "role:s d:d scope:s first_ep:i last_ep:i rows:i", " UNION ALL ".join(gaps_sql(n, SCOPES[n]) for n in GAP_SCOPES))
def _(t):
    return Q.gaps(t.book1, GAP_SCOPES)


CONS = f"SELECT DISTINCT d, role, check_id FROM ({ALL.replace("FROM lob", "FROM flawed")}) x WHERE n_inside > 0 AND NOT regexp_matches(columns, 'l([3-9]|10)_')"
RELEVANT = S.book_columns(2)
NANS = "SELECT d, role, 'NANS_LEVEL_1' AS check_id FROM flawed GROUP BY d, role HAVING COUNT(*) FILTER (" + " AND ".join(
    f"{c} IS NULL" for c in S.book_columns(1)) + ") * 100e0 / COUNT(*) >= {0}"
WINDOW = f"""SELECT d, role, 'VALID_WINDOW' AS check_id FROM ({range_sql('level_1', SCOPES['level_1']).replace('FROM lob', 'FROM flawed')}) x
       WHERE NOT COALESCE(first_us % 86400000000 <= 32400000000 AND last_us % 86400000000 >= 61200000000, FALSE)"""
GAPS = f"""SELECT DISTINCT d, role, 'GAPS_LEVEL_1' AS check_id FROM ({gaps_sql('level_1', SCOPES['level_1']).replace('FROM book1', 'FROM flawed1')}) x
       WHERE LEAST(last_ep % 86400, 61200) >= GREATEST(first_ep % 86400, 32400)
       AND LEAST(last_ep % 86400, 61200) - GREATEST(first_ep % 86400, 32400) + 1 > 60"""
CRIT = "d:d role:s check_id:s"


def _inside():
    return F.pmod(F.col("us"), F.lit(86_400 * US)).between(S.WINDOW_OPEN * US, S.WINDOW_CLOSE * US)


@query("crit_consistency", CRIT, CONS)
def _(t):
    return Q.critical_consistency(Q.issues(t.flawed, Q.consistency_checks(t.flawed), _inside()), RELEVANT)


@query("crit_nans", CRIT, NANS.format("25"))
def _(t):
    return Q.critical_nulls(Q.null_stats(t.flawed))


@query("crit_window", CRIT, WINDOW)
def _(t):
    return Q.critical_window(Q.valid_range(t.flawed))


@query("crit_gaps", CRIT, GAPS)
def _(t):
    return Q.critical_gaps(Q.gaps(t.flawed1))


EVERY = f"{CONS} UNION ALL {NANS.format('25')} UNION ALL {WINDOW} UNION ALL {GAPS}"


@query("find_criticalities", CRIT, EVERY)
def _(t):
    return Q.find_criticalities(t.flawed, RELEVANT)


@query("critical_dates", "d:d", f"SELECT DISTINCT d FROM ({EVERY}) x")
def _(t):
    return Q.find_criticalities(t.flawed, RELEVANT).select("d").distinct()


@query("assert_sampling", "role:s d:d violations:i first_ep:i", """
       SELECT role, d, COUNT(*) FILTER (bad) AS violations, MIN(ep) FILTER (bad) AS first_ep FROM (
        SELECT role, d, ep, ep - LAG(ep) OVER (PARTITION BY role, d ORDER BY ep) <> 300 AS bad FROM grid5) x GROUP BY role, d""")
def _(t):
    return Q.sampling_report(t.grid5, 300)


@query("assert_series", "role:s rows:i null_times:i repeated_times:i", """
       SELECT role, COUNT(*) AS rows, COUNT(*) - COUNT(s) AS null_times, COUNT(s) - COUNT(DISTINCT s) AS repeated_times FROM (
        SELECT role, CASE WHEN event_id % 50 <> 0 THEN us // 60000000 END AS s FROM lob) x GROUP BY role""")
def _(t):
    s = F.when(F.col("event_id") % 50 != 0, F.floor(F.col("us") / (60 * US)))
    return Q.series_report(t.lob.select("role", s.alias("s")), "role", "s")

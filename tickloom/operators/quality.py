"""Book quality checks.

All consistency checks are flags on one row: one scan computes them as columns,
batches of rows count them per series and day, and one aggregate adds the counts.
Ordered checks run on the one-row-per-second book.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.expr import US, all_of, any_of, close_to, day_of, sod
from tickloom.operators.grid import snap
from tickloom.operators.ordered import day_window, islands
from tickloom.schema import CONTRACTS, SIDES, TICKER_CONTRACTS, WINDOW_CLOSE, WINDOW_OPEN, book_column, book_columns, book_levels, market_keys
from tickloom.sources.sinks import stage

GAP_SECONDS = 60
NULL_PERCENT = 25.0

Check = tuple[str, list[str], Column]


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row per key in the given order, as a map-side combined aggregate."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("row")).select(*keys, "row.*")


def series_keys(df: DataFrame) -> list[str]:
    return [*market_keys(df), "role"]


def tick_of(kind: str, by_ticker: bool = False) -> Column:
    """Price or size tick of the row's contract."""
    out = F.lit(None).cast("double")
    terms = {(None, role): c for role, c in CONTRACTS.items()} if not by_ticker else TICKER_CONTRACTS
    for (ticker, role), c in terms.items():
        mine = F.col("role") == role if ticker is None else (F.col("role") == role) & (F.col("ticker") == ticker)
        out = F.when(mine, c.price_tick if kind == "price" else c.size_tick).otherwise(out)
    return out


def off_multiple(column: str, kind: str, by_ticker: bool = False) -> Column:
    q = F.col(column) / tick_of(kind, by_ticker)
    return ~close_to(q, F.rint(q))


def sign_checks(kind: str, levels: int) -> list[Check]:
    return [(f"{kind.upper()}_NON_POSITIVE", [c], F.col(c) <= 0) for c in book_columns(levels, kinds=[kind])]


def multiple_checks(kind: str, levels: int, by_ticker: bool = False) -> list[Check]:
    return [(f"{kind.upper()}_NON_MULTIPLE", [c], off_multiple(c, kind, by_ticker)) for c in book_columns(levels, kinds=[kind])]


def order_checks(side: str, levels: int) -> list[Check]:
    out = []
    for lv in range(1, levels):
        a, b = book_column(lv, side, "price"), book_column(lv + 1, side, "price")
        wrong = F.col(a) <= F.col(b) if side == "bid" else F.col(a) >= F.col(b)
        out.append((f"{side.upper()}_ORDER", [a, b], wrong))
    return out


def crossed_checks() -> list[Check]:
    a, b = book_column(1, "bid", "price"), book_column(1, "ask", "price")
    return [("CROSSED", [a, b], F.col(a) >= F.col(b))]


def partial_checks(levels: int) -> list[Check]:
    out = []
    for lv in range(1, levels + 1):
        for side in SIDES:
            p, s = book_column(lv, side, "price"), book_column(lv, side, "size")
            out.append(("PRICE_SIZE_PARTIAL", [p, s], F.col(p).isNull() != F.col(s).isNull()))
    return out


def consistency_checks(book: DataFrame) -> list[Check]:
    """All checks for the levels that the book has."""
    n, by_ticker = book_levels(book), bool(market_keys(book))
    return [*sign_checks("price", n), *sign_checks("size", n), *multiple_checks("price", n, by_ticker), *multiple_checks("size", n, by_ticker),
            *order_checks("bid", n), *order_checks("ask", n), *crossed_checks(), *partial_checks(n)]


def issues(df: DataFrame, checks: list[Check], inside: Column | None = None) -> DataFrame:
    """(role, d, check_id, columns, n, n_inside, first_us, last_us) for every check that fired, per ticker if there is one.

    ``inside`` marks rows of the analysis window; its count decides criticality later.  A
    column per flag is compiled in small methods; one expression of all flags is interpreted.
    """
    keys = [*series_keys(df), "d"]
    flags = [f"_f{i}" for i in range(1, len(checks) + 1)]
    rows = df.select(*keys, "us", (F.lit(True) if inside is None else inside).alias("_in"), *[flag.alias(f) for (_, _, flag), f in zip(checks, flags)])
    types = dict(rows.dtypes)
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", _i int, n long, n_inside long, first_us long, last_us long"

    def counted(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            table = pa.Table.from_batches([batch])
            if not table.num_rows:
                continue
            group = table.select(keys).to_pandas().groupby(keys, dropna=False, sort=False).ngroup().to_numpy()
            order = np.argsort(group, kind="stable")
            starts = np.flatnonzero(np.diff(group[order], prepend=-1))
            us, timed = table["us"].fill_null(0).to_numpy()[order, None], table["us"].is_valid().to_numpy()[order, None]
            fails = np.stack([table[f].fill_null(False).to_numpy() for f in flags], axis=1)[order]
            within = fails & table["_in"].fill_null(False).to_numpy()[order, None]
            n, n_inside = (np.add.reduceat(x, starts, axis=0, dtype=np.int64) for x in (fails, within))
            low, high = np.iinfo(np.int64).min, np.iinfo(np.int64).max
            first = np.minimum.reduceat(np.where(fails & timed, us, high), starts, axis=0)
            last = np.maximum.reduceat(np.where(fails & timed, us, low), starts, axis=0)
            known = np.add.reduceat(fails & timed, starts, axis=0, dtype=np.int64) > 0
            g, i = np.nonzero(n)
            if len(g):
                of = table.select(keys).take(pa.array(order[starts][g]))
                none = ~known[g, i]
                cells = [pa.array((i + 1).astype(np.int32)), pa.array(n[g, i]), pa.array(n_inside[g, i]), pa.array(first[g, i], mask=none), pa.array(last[g, i], mask=none)]
                out = pa.Table.from_arrays([*of.columns, *cells], names=[*keys, "_i", "n", "n_inside", "first_us", "last_us"])
                yield from out.combine_chunks().to_batches()

    counts = rows.mapInArrow(counted, schema).groupBy(*keys, "_i").agg(
        F.sum("n").alias("n"), F.sum("n_inside").alias("n_inside"), F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"))
    return named(counts, keys, checks)


def fired(checks: list[Check]) -> Column:
    """Numbers, from 1, of the checks that a row fails."""
    return F.array_compact(F.array(*[F.when(flag, F.lit(i)) for i, (_, _, flag) in enumerate(checks, 1)]))


def fired_counts(rows: DataFrame, keys: list[str], checks: list[Check]) -> DataFrame:
    """Issues from rows (keys, us, _in, _fired).

    A plain explode would infer a filter on the size of ``_fired``, and Spark would push it to the
    scan as all checks over the formulas of all columns, computed once more per row.
    """
    long = rows.select(*keys, "us", "_in", F.explode_outer("_fired").alias("_i")).where("_i IS NOT NULL")
    counts = long.groupBy(*keys, "_i").agg(F.count("*").alias("n"), F.count_if("_in").alias("n_inside"), F.min("us").alias("first_us"), F.max("us").alias("last_us"))
    return named(counts, keys, checks)


def named(counts: DataFrame, keys: list[str], checks: list[Check]) -> DataFrame:
    """Counts per check number ``_i`` with the check's name and columns."""
    names = F.array(*[F.struct(F.lit(name).alias("check_id"), F.array(*[F.lit(c) for c in columns]).alias("columns")) for name, columns, _ in checks])
    return counts.withColumn("_c", F.element_at(names, F.col("_i"))).select(*keys, "_c.check_id", "_c.columns", "n", "n_inside", "first_us", "last_us")


def issue_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("check_id").agg(F.sum("n").alias("issues"), F.countDistinct("d").alias("days"))


def scopes(levels: int) -> dict[str, list[str]]:
    """Column sets the integrity statistics are reported for."""
    out = {"book": book_columns(levels), "level_1": book_columns(1)}
    for side in SIDES:
        out[f"level_1_{side}"] = book_columns(1, [side])
    for c in book_columns(1):
        out[c] = [c]
    return out


def _per_scope(df: DataFrame, cell) -> DataFrame:
    named, keys = scopes(book_levels(df)), [*series_keys(df), "d"]
    per_day = df.groupBy(*keys).agg(*[cell(name, cols).alias(f"s{i}") for i, (name, cols) in enumerate(named.items())])
    rows = F.array(*[f"s{i}" for i in range(len(named))])
    return per_day.select(*keys, F.inline(rows))


def shape(df: DataFrame, n_columns: int) -> DataFrame:
    n = F.count("*")
    return df.groupBy(*series_keys(df), "d").agg(n.alias("rows"), F.lit(n_columns).alias("columns"), (n * n_columns).alias("size"))


def null_stats(df: DataFrame) -> DataFrame:
    """Null counts and percentages per scope, from one aggregate over the whole book."""
    def cell(name, cols):
        rows = F.count("*")
        nulls = sum((F.count_if(F.col(c).isNull()) for c in cols[1:]), F.count_if(F.col(cols[0]).isNull()))
        empty = F.count_if(all_of(F.col(c).isNull() for c in cols))
        partly = F.count_if(any_of(F.col(c).isNull() for c in cols))
        return F.struct(F.lit(name).alias("scope"), nulls.alias("n_null"), (nulls * 100.0 / (rows * len(cols))).alias("pct_null"),
                        empty.alias("rows_all_null"), (empty * 100.0 / rows).alias("pct_all_null"),
                        partly.alias("rows_any_null"), (partly * 100.0 / rows).alias("pct_any_null"))
    return _per_scope(df, cell)


def valid_range(df: DataFrame) -> DataFrame:
    """First and last time with every scope column present."""
    def cell(name, cols):
        us = F.when(all_of(F.col(c).isNotNull() for c in cols), F.col("us"))
        return F.struct(F.lit(name).alias("scope"), F.min(us).alias("first_us"), F.max(us).alias("last_us"))
    return _per_scope(df, cell)


def gaps(book: DataFrame, wanted: tuple[str, ...] = ("level_1",)) -> DataFrame:
    """Runs of consecutive rows whose scope columns are all null, as (scope, first, last, rows).

    ``book`` has one row per second, so a (role, day) window holds at most 86,400 rows.
    """
    named = {k: v for k, v in scopes(book_levels(book)).items() if k in wanted}
    keys = [*series_keys(book), "d"]
    w = day_window(keys)
    parts = book.select(*keys, "ep", *[all_of(F.col(c).isNull() for c in cols).alias(f"_e_{k}") for k, cols in named.items()])
    ids = parts
    for k in named:
        change = F.lag(f"_e_{k}").over(w) != F.col(f"_e_{k}")
        ids = islands(ids, keys, "ep", change, f"_i_{k}")
    cells = F.array(*[F.struct(F.lit(k).alias("scope"), F.col(f"_e_{k}").alias("empty"), F.col(f"_i_{k}").alias("island")) for k in named])
    long = ids.select(*keys, "ep", F.inline(cells)).where("empty")
    return long.groupBy(*keys, "scope", "island").agg(
        F.min("ep").alias("first_ep"), F.max("ep").alias("last_ep"), F.count("*").alias("rows")).drop("island")


# ---- critical days


def _found(df: DataFrame, check: Column | str) -> DataFrame:
    return df.select(*market_keys(df), "d", "role", (F.lit(check) if isinstance(check, str) else check).alias("check_id")).distinct()


def critical_consistency(found: DataFrame, relevant: list[str]) -> DataFrame:
    """Days with an issue on relevant columns only and inside the analysis window."""
    known = F.array(*[F.lit(c) for c in relevant])
    return _found(found.where((F.size(F.array_except("columns", known)) == 0) & (F.col("n_inside") > 0)), F.col("check_id"))


def critical_nulls(nulls: DataFrame, percent: float = NULL_PERCENT) -> DataFrame:
    return _found(nulls.where((F.col("scope") == "level_1") & (F.col("pct_all_null") >= percent)), "NANS_LEVEL_1")


def critical_window(ranges: DataFrame, opens: int = WINDOW_OPEN, closes: int = WINDOW_CLOSE) -> DataFrame:
    """Days whose valid range misses the analysis window; a day without any valid row counts."""
    us = lambda c: F.pmod(F.col(c), F.lit(86_400 * US))
    covers = (us("first_us") <= opens * US) & (us("last_us") >= closes * US)
    return _found(ranges.where((F.col("scope") == "level_1") & ~F.coalesce(covers, F.lit(False))), "VALID_WINDOW")


def critical_gaps(gap_rows: DataFrame, opens: int = WINDOW_OPEN, closes: int = WINDOW_CLOSE, limit: int = GAP_SECONDS) -> DataFrame:
    """Days with a level-1 gap longer than the limit after clipping to the analysis window."""
    a = F.greatest(sod("first_ep"), F.lit(opens))
    b = F.least(sod("last_ep"), F.lit(closes))
    return _found(gap_rows.where((F.col("scope") == "level_1") & (b >= a) & (b - a + 1 > limit)), "GAPS_LEVEL_1")


def find_criticalities(lob: DataFrame, relevant: list[str]) -> DataFrame:
    """(d, role, check_id) of all four rules.

    The wide book is scanned once and written as level 1 and the numbers of the checks that
    fired; all rules read that.
    """
    keys, checks = [*series_keys(lob), "d"], consistency_checks(lob)
    inside = F.pmod(F.col("us"), F.lit(86_400 * US)).between(WINDOW_OPEN * US, WINDOW_CLOSE * US)
    narrow = stage(lob.select(*keys, "us", *book_columns(1), inside.alias("_in"), fired(checks).alias("_fired")))
    level = narrow.drop("_in", "_fired")
    seconds = snap(level, series_keys(level), 1).withColumn("d", day_of("ep"))
    parts = [critical_consistency(fired_counts(narrow, keys, checks), relevant), critical_nulls(null_stats(level)), critical_window(valid_range(level)), critical_gaps(gaps(seconds))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy("d", "role", "check_id")


# ---- index assertions


def sampling_report(df: DataFrame, step: int, keys=("role", "d")) -> DataFrame:
    """Per day: steps that differ from ``step`` and the first time it happens."""
    w = day_window(keys)
    bad = F.col("ep") - F.lag("ep").over(w) != step
    rows = df.select(*keys, "ep", bad.alias("bad"))
    return rows.groupBy(*keys).agg(F.count_if("bad").alias("violations"), F.min(F.when(F.col("bad"), F.col("ep"))).alias("first_ep"))


def series_report(df: DataFrame, key: str, time: str) -> DataFrame:
    """Rows, null times and repeated times of a series, from counts per (key, time)."""
    per = df.groupBy(key, time).agg(F.count("*").alias("_n"))
    return per.groupBy(key).agg(
        F.sum("_n").alias("rows"), F.sum(F.when(F.col(time).isNull(), F.col("_n")).otherwise(0)).alias("null_times"),
        F.sum(F.when(F.col(time).isNotNull(), F.col("_n") - 1).otherwise(0)).alias("repeated_times"))


def require_series(df: DataFrame, key: str, time: str) -> None:
    """Raise for an empty series, null times or repeated times."""
    bad = series_report(df, key, time)
    if bad.isEmpty():
        raise ValueError("the series is empty")
    row = bad.where("null_times > 0 OR repeated_times > 0").first()
    if row:
        raise ValueError(f"{row[key]}: {row['null_times']} null and {row['repeated_times']} repeated times")

"""Ordered computations over groups of any size.

A plain window sorts a whole group in one task.  These helpers cut a group into slots,
work inside the slots in parallel, and carry one summary row per slot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.sources.sinks import stage


def _attach(df: DataFrame, small: DataFrame, keys: list[str]) -> DataFrame:
    """Join a per-key summary back; without keys the summary is a single row."""
    return df.join(small, keys) if keys else df.join(F.broadcast(small))


def running(df: DataFrame, keys: list[str], slot: str, order: list[str], sums: dict[str, str]) -> DataFrame:
    """Running totals ``{output: input}`` per key in order of (slot, order).

    The slot must be monotone in the order.  Rows meet only inside (keys, slot); the
    totals of earlier slots arrive as one row per slot.
    """
    w_slots = Window.partitionBy(*keys).orderBy(slot).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*keys, slot).agg(*[F.sum(v).alias(f"_t_{n}") for n, v in sums.items()])
    carry = totals.select(*keys, slot, *[F.coalesce(F.sum(f"_t_{n}").over(w_slots), F.lit(0)).alias(f"_b_{n}") for n in sums])
    w_rows = Window.partitionBy(*keys, slot).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = df.join(carry, [*keys, slot])
    out = out.select("*", *[(F.col(f"_b_{n}") + F.sum(v).over(w_rows)).alias(n) for n, v in sums.items()])
    return out.drop(*[f"_b_{n}" for n in sums])


#: Most different values of one slot that are ranked in one task.
RANKED = 1 << 16


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float], slots: int = 64, weight: str | None = None, most: int = RANKED) -> DataFrame:
    """Exact quantiles with linear interpolation, one column per entry of ``probs``; a row counts ``weight`` times.

    Equal values collapse to a count before the shuffle.  Approximate quantiles only cut the
    values into slots of similar size.  The slots of all keys that hold a target are cut
    again, round by round, until none has more than ``most`` different values; only those are
    ranked.  The counts, the slot edges and the target slots are written tables, so a hot key
    is never shuffled to one task: small tables are broadcast to it.  Runs a few jobs at call.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg((F.sum(weight) if weight else F.count("*")).alias("_c"))
    counts = stage(counts)
    totals = stage(counts.groupBy(*keys).agg(F.sum("_c").alias("_total")))
    grid = [i / slots for i in range(1, slots)]

    def target(p: float) -> Column:
        return F.lit(float(p)) * (F.col("_total") - 1)

    def cut(rows: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
        """Rows with a slot, and the slots that hold a target: _before counts what is below them, _d their different values."""
        edges = stage(rows.groupBy(*by).agg(F.percentile_approx("_v", grid, 1000).alias("_edges")))
        sub = F.size(F.filter("_edges", lambda e: e < F.col("_v")))
        slotted = _attach(rows, edges, by).withColumn("_sub", sub).drop("_edges")
        inside = Window.partitionBy(*by).orderBy("_sub").rowsBetween(Window.unboundedPreceding, -1)
        sums = slotted.groupBy(*by, "_total", "_start", "_sub").agg(F.sum("_c").alias("_n"), F.count("*").alias("_d"))
        sums = sums.withColumn("_before", F.col("_start") + F.coalesce(F.sum("_n").over(inside), F.lit(0)))
        hit = F.lit(False)
        for p in probs.values():
            for t in (F.floor(target(p)), F.ceil(target(p))):
                hit = hit | ((F.col("_before") <= t) & (t < F.col("_before") + F.col("_n")))
        path = F.concat_ws(".", *(["_slot"] if "_slot" in by else []), F.col("_sub").cast("string"))
        wanted = stage(sums.where(hit).select(*by, "_sub", path.alias("_path"), "_before", "_d"))
        kept = slotted.drop("_start").join(wanted, [*by, "_sub"]).select(*keys, F.col("_path").alias("_slot"), "_total", "_before", "_d", "_v", "_c")
        return kept, wanted

    found, open_ = cut(_attach(counts, totals, keys).withColumn("_start", F.lit(0).cast("long")), list(keys))
    done = found.where(F.col("_d") <= most)
    while not open_.where(F.col("_d") > most).isEmpty():
        wide = stage(found.where(F.col("_d") > most)).withColumnRenamed("_before", "_start").drop("_d")
        found, open_ = cut(wide, [*keys, "_slot"])
        done = done.unionByName(found.where(F.col("_d") <= most))

    inside = Window.partitionBy(*keys, "_slot").orderBy("_v")
    ranked = done.withColumn("_to", F.col("_before") + F.sum("_c").over(inside)).withColumn("_from", F.col("_to") - F.col("_c"))

    aggs = []
    for name, p in probs.items():
        def at(t):
            return F.max(F.when((F.col("_from") <= t) & (t < F.col("_to")), F.col("_v")))
        aggs += [at(F.floor(target(p))).alias(f"_lo_{name}"), at(F.ceil(target(p))).alias(f"_hi_{name}")]
    picked = ranked.groupBy(*keys).agg(F.max("_total").alias("_total"), *aggs)
    return picked.select(*keys, *[
        (F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * (target(p) - F.floor(target(p)))).alias(n)
        for n, p in probs.items()])


def hash_text(key: str, seed: int) -> Column:
    """Seeded 32-digit hexadecimal hash of a key, the same on every engine that has md5."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def sample_exact(df: DataFrame, key: str, ratio: float | None = None, size: int | None = None, seed: int = 42, by: list[str] | None = None) -> DataFrame:
    """Seeded uniform sample without replacement of exactly max(1, int(N * ratio)) or ``size`` rows, of each group ``by`` if given.

    Rows are ordered by a hash of their key.  Counts per hash prefix (65,536 of them)
    locate the cut, and only the rows of the cut's prefix are ranked, so no task ever
    holds the sample.
    """
    if (ratio is None) == (size is None):
        raise ValueError("give exactly one of ratio and size")
    by = by or []
    rows = df.withColumn("_h", hash_text(key, seed)).withColumn("_p", F.substring("_h", 1, 4))
    per = rows.groupBy(*by, "_p").agg(F.count("*").alias("_n")).withColumn("_g", F.substring("_p", 1, 2))
    per = running(per, by, "_g", ["_p"], {"_to": "_n"})
    total = rows.groupBy(*by).agg(F.count("*").alias("_total"))
    want = F.lit(size) if size is not None else F.greatest(F.lit(1), F.floor(F.col("_total") * F.lit(float(ratio))))
    cut = _attach(per, total.select(*by, want.cast("long").alias("_want")), by)
    cut = cut.where((F.col("_to") - F.col("_n") < F.col("_want")) & (F.col("_want") <= F.col("_to")))
    cut = cut.select(*by, F.col("_p").alias("_cut"), (F.col("_want") - F.col("_to") + F.col("_n")).alias("_need"))
    tagged = _attach(rows, cut, by).where(F.col("_p") <= F.col("_cut"))
    below = tagged.where("_p < _cut")
    edge = tagged.where("_p = _cut").withColumn("_k", F.row_number().over(Window.partitionBy(*by, "_p").orderBy("_h", key)))
    edge = edge.where("_k <= _need").drop("_k")
    return below.unionByName(edge).drop("_h", "_p", "_cut", "_need").select(*df.columns)


def islands(df: DataFrame, keys: list[str], order: str, new_island: Column, name: str = "island") -> DataFrame:
    """Number the runs of rows; ``new_island`` may look at earlier rows of ``keys`` by window."""
    w = Window.partitionBy(*keys).orderBy(order)
    out = df.withColumn("_new", F.coalesce(new_island, F.lit(False)).cast("int"))
    return out.withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def day_window(keys=("role", "d"), order="ep"):
    """Rows of one series and day in time order; at most one row per second."""
    return Window.partitionBy(*keys).orderBy(order)

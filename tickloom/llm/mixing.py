"""Mixing sources to target weights by weighted fair queueing.

Every source queues its documents in a shuffled order, pass after pass.  A copy's virtual
finish time is the source's words up to and with it, divided by the source's weight.
Taking copies in order of finish time serves sources in proportion to their weights; a
source that has spent its passes drops out and the rest share what it leaves, which is
the same water level that the targets follow.  The mix ends where the budget does.

Finish times are whole numbers (words times lcm(weights) / weight), so reruns and other
engines agree on every comparison.  DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.llm.common import repeated, row_key, stage, table, take_rows, text_of, words

WEIGHTS = (5, 2, 1)
PASSES = 3
PIECE = 4096
SLOTS = 4096
SORTED = 10_000


def queue_rows(docs: DataFrame, keep: list) -> DataFrame:
    """``keep`` plus source, size in words and a 60-bit shuffle key made of doc_id and text."""
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), text_of()))
    return docs.select(*keep, F.col("source").alias("src"), F.col("doc_id").alias("id"), F.size(words(text_of())).cast("long").alias("size"),
                       F.conv(F.substring(key, 1, 15), 16, 10).cast("long").alias("key"))


def source_targets(rows: DataFrame, weights=WEIGHTS, passes: int = PASSES) -> DataFrame:
    """One row per source: size, rows, weight, target.

    Sources fill in order of cap / weight; those at or under the water level take their cap
    and the rest share what is left by weight.  The window runs over one row per source.
    """
    per = rows.groupBy("src").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    everything = Window.partitionBy()
    ranked = per.select("*", (F.row_number().over(everything.orderBy(F.asc_nulls_last("src"))) - 1).alias("rank"))
    ranked = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")).cast("long"))
    ranked = ranked.withColumn("cap", F.col("source_size") * passes)
    first = everything.orderBy(F.col("cap").cast("double") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    filled = ranked.select(
        "*", F.coalesce(F.sum("cap").over(first), F.lit(0)).alias("cap_before"), F.coalesce(F.sum("weight").over(first), F.lit(0)).alias("weight_before"),
        F.sum("source_size").over(everything).alias("budget"), F.sum("weight").over(everything).alias("weight_all"))
    full = F.col("cap").cast("double") * (F.col("weight_all") - F.col("weight_before")) <= (F.col("budget") - F.col("cap_before")).cast("double") * F.col("weight")
    filled = filled.withColumn("full", full)
    level = ((F.max("budget").over(everything) - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(everything)).cast("double")
             / F.nullif(F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(everything), F.lit(0)))
    return filled.select("src", "source_size", "rows", "rank", "weight", "budget",
                         F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("weight") * level).alias("target"))


def queue(rows: DataFrame, sources: DataFrame, weights=WEIGHTS) -> DataFrame:
    """Add ``upto``: words of the source's shuffled queue up to and with the row.

    A source is cut into pieces of about 4,096 rows by its shuffle key, so a source with a
    third of all rows is summed by many tasks; one total per piece says where it starts.
    """
    scale = math.lcm(*weights)
    rows = rows.join(sources, rows["src"].eqNullSafe(sources["src"])).drop(sources["src"])
    pieces = 1 + F.floor(F.col("rows") / PIECE)
    rows = rows.withColumn("piece", F.shiftright(F.shiftright("key", 30) * pieces, 30))
    before = Window.partitionBy("rank").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("rank", "piece").agg(F.sum("size").alias("n"))
    starts = starts.select("rank", "piece", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("rank", "piece").orderBy("key", F.asc_nulls_first("id"), "size").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn("inside", F.sum("size").over(inside)).join(starts, ["rank", "piece"])
    return out.withColumn("upto", F.col("start") + F.col("inside")).withColumn("step", F.floor(F.lit(scale) / F.col("weight")).cast("long")).drop("piece", "start", "inside", "rows", "key")


def cut_point(queued: DataFrame, passes: int = PASSES) -> tuple[int, int]:
    """(finish, rank) of the last copy that the budget holds.

    Copies are dealt into 4,096 ranges of finish time and summed; the range in which the
    budget ends is dealt again until few rows are left, and only those are sorted.
    """
    copies = queued.where("size > 0").select(
        "rank", "size", "budget", F.explode(F.array(*[F.lit(i) for i in range(passes)])).alias("pass"), "source_size", "upto", "step")
    copies = copies.select("rank", "size", "budget", ((F.col("pass") * F.col("source_size") + F.col("upto")) * F.col("step")).alias("finish"))
    low, high, budget, n = copies.agg(F.min("finish"), F.max("finish") + 1, F.max("budget"), F.count("*")).first()
    if not n:
        return -1, -1
    taken = 0
    while n > SORTED and high - low > 1:
        width = -(-(high - low) // SLOTS)
        part = copies.where((F.col("finish") >= low) & (F.col("finish") < high))
        part = part.groupBy(F.floor((F.col("finish") - low) / width).cast("long").alias("range")).agg(F.sum("size").alias("words"), F.count("*").alias("n"))
        # At most 4,096 rows.
        upto = F.lit(taken) + F.sum("words").over(Window.partitionBy().orderBy("range"))
        hit = part.withColumn("upto", upto).where(F.col("upto") > budget).orderBy("range").first()
        if hit is None:
            return high, 1 << 40
        taken = hit["upto"] - hit["words"]
        low, high, n = low + hit["range"] * width, min(high, low + (hit["range"] + 1) * width), hit["n"]
    part = copies.where((F.col("finish") >= low) & (F.col("finish") < high))
    upto = F.lit(taken) + F.sum("size").over(Window.partitionBy().orderBy("finish", "rank").rowsBetween(Window.unboundedPreceding, 0))
    last = part.withColumn("upto", upto).where(F.col("upto") <= budget).orderBy(F.desc("finish"), F.desc("rank")).first()
    return (last["finish"], last["rank"]) if last else (low, -1)


def mix(rows: DataFrame, weights=WEIGHTS, passes: int = PASSES) -> DataFrame:
    """Rows of ``queue_rows`` with source_size, target and ``finish``: the finish times of the copies taken.

    A document without words has no finish time and is not taken.  Documents that share a
    doc_id count one by one.  A source whose name is null is the last source.
    """
    sources = stage(source_targets(rows, weights, passes))
    queued = stage(queue(rows, sources, weights))
    finish, rank = cut_point(queued, passes)

    def at(i: int):
        return (F.lit(i) * F.col("source_size") + F.col("upto")) * F.col("step")

    times = F.array(*[at(i) for i in range(passes)])
    taken = F.filter(times, lambda t: (F.col("size") > 0) & ((t < F.lit(finish)) | ((t == F.lit(finish)) & (F.col("rank") <= F.lit(rank)))))
    return queued.withColumn("finish", taken)


def op4_weighted_fair_queueing(spark: SparkSession, folder: str) -> DataFrame:
    """Words that the mix takes of every document, repeats counted."""
    rows = stage(queue_rows(table(spark, folder, "documents"), []))
    return mix(rows).select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.size("finish")).alias("taken"))


def mixed_documents(docs: DataFrame, weights=WEIGHTS, passes: int = PASSES) -> DataFrame:
    """The documents in their mix: one row per copy taken, all columns."""
    narrow = stage(queue_rows(docs, row_key(docs.columns)))
    mixed = mix(narrow, weights, passes).groupBy("k1", "k2").agg(F.sum(F.size("finish")).cast("int").alias("copies")).where("copies > 0")
    return take_rows(docs, stage(mixed), repeated(narrow))


MIXING_SQL = """
WITH q AS (
 SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')) AS size,
        CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 15) AS BIGINT) AS key
 FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM q GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM s0),
s2 AS (SELECT *, [5, 2, 1][1 + rank % 3] AS weight, 3 * source_size AS cap FROM s1),
s3 AS (
 SELECT *, coalesce(sum(cap) OVER f, 0) AS cap_before, coalesce(sum(weight) OVER f, 0) AS weight_before,
        sum(source_size) OVER () AS budget, sum(weight) OVER () AS weight_all
 FROM s2 WINDOW f AS (ORDER BY CAST(cap AS DOUBLE) / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s4 AS (SELECT *, CAST(cap AS DOUBLE) * (weight_all - weight_before) <= CAST(budget - cap_before AS DOUBLE) * weight AS is_full FROM s3),
s5 AS (
 SELECT *, CAST(budget - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER () AS DOUBLE)
           / nullif(sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER (), 0) AS level FROM s4),
s AS (SELECT source, source_size, rank, 10 // weight AS step, CAST(budget AS BIGINT) AS budget, CASE WHEN is_full THEN CAST(cap AS DOUBLE) ELSE weight * level END AS target FROM s5),
u AS (
 SELECT q.doc_id, q.size, s.source_size, s.target, s.rank, s.step, s.budget, q.key,
        sum(q.size) OVER (PARTITION BY s.rank ORDER BY q.key, q.doc_id NULLS FIRST, q.size ROWS UNBOUNDED PRECEDING) AS upto,
        row_number() OVER () AS rid
 FROM q JOIN s ON q.source IS NOT DISTINCT FROM s.source),
c AS (
 SELECT rid, size, budget, sum(size) OVER (ORDER BY (p * source_size + upto) * step, rank ROWS UNBOUNDED PRECEDING) AS total
 FROM u, range(3) r(p) WHERE size > 0),
t AS (SELECT rid, count(*) AS copies FROM c WHERE total <= budget GROUP BY rid)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, CAST(target AS DOUBLE) AS target, CAST(size * coalesce(copies, 0) AS BIGINT) AS taken
FROM u LEFT JOIN t USING (rid)
"""

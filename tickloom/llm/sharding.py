"""Sharding through fixed virtual slots.

Rows hash into a few thousand slots that never change.  Bytes are summed per slot, and a
versioned table maps slots to shards.  Moving data means editing that table: a row's slot
stays, and only the rows of the slots that an edit names move.

Sizes and the map are bounded by the number of slots; the rows are never gathered.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.llm.common import stage, table, text_of

SLOTS = 4096
ROWS_PER_TASK = 1_000_000
MAP_SCHEMA = "version int, slot int, shard int, bytes long"


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    return F.pmod(key, F.lit(slots)).cast("int")


def slot_sizes(rows: DataFrame) -> tuple[list[tuple[int, int]], dict[int, int]]:
    """Bytes and rows per slot, at most one entry per slot on the driver."""
    found = rows.groupBy("vslot").agg(F.sum("size"), F.count("*")).collect()
    return [(r[0], r[1]) for r in found], {r[0]: r[2] for r in found}


def first_map(sizes: list[tuple[int, int]], shards: int, slots: int = SLOTS) -> dict[int, int]:
    """Largest slot first onto the lightest shard; empty slots are dealt in turn."""
    load = [(0, s) for s in range(shards)]
    heapq.heapify(load)
    out = {}
    known = dict(sizes)
    for slot in sorted(range(slots), key=lambda x: (-known.get(x, 0), x)):
        total, shard = heapq.heappop(load)
        out[slot] = shard
        heapq.heappush(load, (total + max(known.get(slot, 0), 1), shard))
    return out


def rebalance(current: dict[int, int], sizes: list[tuple[int, int]], shards: int, tolerance: float = 0.01) -> dict[int, int]:
    """Edit a map for new sizes or more shards with few moves.

    Slots leave the heaviest shard for the lightest while that narrows the gap between them
    by a slot that fits; shards that the map does not know yet start empty.
    """
    known, out = dict(sizes), dict(current)
    held: dict[int, list[int]] = {s: [] for s in range(shards)}
    for slot, shard in sorted(out.items()):
        if shard >= shards:
            raise ValueError(f"shard {shard} is not below {shards}; shards are only added")
        held[shard].append(slot)
    load = {s: sum(known.get(x, 0) for x in held[s]) for s in held}
    mean = sum(load.values()) / shards
    while True:
        heavy = max(load, key=lambda s: (load[s], -s))
        light = min(load, key=lambda s: (load[s], s))
        gap = load[heavy] - load[light]
        if gap <= tolerance * mean:
            return out
        fits = [x for x in held[heavy] if 0 < known.get(x, 0) < gap]
        if not fits:
            return out
        slot = min(fits, key=lambda x: (abs(gap / 2 - known[x]), x))
        held[heavy].remove(slot)
        held[light].append(slot)
        out[slot] = light
        load[heavy] -= known[slot]
        load[light] += known[slot]


def map_table(spark: SparkSession, versions: list[dict[int, int]], sizes: list[tuple[int, int]]) -> DataFrame:
    """All versions of a map as one written table; the last one is in force."""
    known = dict(sizes)
    rows = [(v, slot, shard, known.get(slot, 0)) for v, m in enumerate(versions) for slot, shard in sorted(m.items())]
    return stage(spark.createDataFrame(rows, MAP_SCHEMA))


def place(rows: DataFrame, slot_map: DataFrame, counts: dict[int, int], order: list[str]) -> DataFrame:
    """Add ``shard`` and the gapless position ``slot`` inside the shard.

    ``rows`` has ``vslot`` and a long ``key`` that spreads the rows of a slot; ``counts`` has
    its rows per slot.  A shard is numbered in pieces of about a million rows; one count per
    piece says where it starts.
    """
    newest = slot_map.agg(F.max("version")).first()[0]
    slot_map = slot_map.where(F.col("version") == newest).select(F.col("slot").alias("vslot"), "shard")
    pieces = 1 + sum(counts.values()) // (SLOTS * ROWS_PER_TASK)
    rows = rows.join(F.broadcast(slot_map), "vslot").withColumn("piece", F.pmod(F.shiftright("key", 24), F.lit(pieces)).cast("long"))
    if pieces == 1:
        per = rows.sparkSession.createDataFrame(sorted(counts.items()), "vslot int, n long").withColumn("piece", F.lit(0).cast("long")).join(F.broadcast(slot_map), "vslot")
    else:
        per = rows.groupBy("shard", "vslot", "piece").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("vslot", "piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = stage(per.select("vslot", "piece", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")))
    inside = Window.partitionBy("vslot", "piece").orderBy(*order)
    out = rows.withColumn("at", F.row_number().over(inside)).join(starts, ["vslot", "piece"])
    return out.withColumn("slot", F.col("start") + F.col("at") - 1).drop("start", "at", "piece")


def spread_copies(rows: DataFrame) -> DataFrame:
    """Written ``rows`` (key, line) with a key of their own for the second and later rows of equal key.

    Copies are numbered inside each part of the input, after the number of copies in the
    parts before, so a key with any number of rows is spread over tasks and slots.
    """
    several = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    several = stage(several)
    if several.isEmpty():
        return rows.drop("line")
    often = rows.join(several, "key", "left_semi").withColumn("part", F.shiftright("line", 33))
    parts = often.groupBy("key", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("key", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("key", "part").orderBy("line")
    number = F.col("before") + F.row_number().over(inside) - 1
    copies = often.join(parts, ["key", "part"]).withColumn("copy", number)
    copies = copies.withColumn("key", F.when(F.col("copy") == 0, F.col("key")).otherwise(F.xxhash64("key", "copy")))
    names = [c for c in rows.columns if c != "line"]
    return stage(rows.join(several, "key", "left_anti").select(*names).unionByName(copies.select(*names)))


def shard(docs: DataFrame, shards: int = 16, keep: list[str] | None = None) -> DataFrame:
    """Place every row of ``docs``: ``keep`` columns (all by default) as struct ``row`` plus size, text_crc32, vslot, shard, slot.

    A row's slot is a hash of its doc_id and text, so equal ids or missing ids spread too.
    Null text: no bytes, size 1, crc32 0.  Repeated rows get positions of their own; with
    ``keep`` their running number enters the hash, so they spread over the slots, however many
    they are; whole rows share a virtual slot with their copies.  An empty table gives an
    empty result.

    Narrow rows are written once and read for the map and for the positions; whole rows are
    read twice instead and dealt out once, to the slots that they are written in.
    """
    spark = docs.sparkSession
    key = F.xxhash64("doc_id", "text")
    rows = docs.select(
        F.struct(*(docs.columns if keep is None else keep)).alias("row"), F.col("doc_id").alias("id"),
        (F.octet_length(text_of()) + 1).cast("long").alias("size"), F.crc32(text_of().cast("binary")).alias("text_crc32"),
        key.alias("key"))
    if keep is not None:
        rows = spread_copies(stage(rows.withColumn("line", F.monotonically_increasing_id())))
    rows = rows.withColumn("vslot", slot_of(F.col("key")))
    sizes, counts = slot_sizes(rows)
    slot_map = map_table(spark, [first_map(sizes, shards)], sizes)
    return place(rows, slot_map, counts, ["key", "id", "size", "text_crc32"])


def op1_virtual_slots(spark: SparkSession, folder: str) -> DataFrame:
    """All documents over 16 shards of near equal bytes.

    ``slot`` counts 0, 1, 2 ... inside a shard; ``virtual_slot`` is the hash slot.  A null text
    has size 1, a null doc_id is a value like others, repeated rows are dealt one by one and an
    empty table gives no rows.
    """
    out = shard(table(spark, folder, "documents"), 16, ["doc_id"])
    return out.select(F.col("row.doc_id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                      F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col("vslot").alias("virtual_slot"))

"""Near duplicates by SimHash fingerprints and anchor points.

Fingerprints within two bits of each other are linked.  Of two such fingerprints at least
one 32-bit half differs in at most one bit.  In each half the anchors are the words of the
perfect [31, 26] Hamming code, a covering code of radius 1: every half has exactly one
anchor within the covering radius, its home, and 16 within radius plus threshold.  A
fingerprint stands once at its home and is replicated to those 16; a linked pair meets
where the home of one is an anchor of the other, and is compared there.

An anchor with many fingerprints is split by three blocks of the other half: two other
halves within two bits agree on one block at least, so nothing is lost.

Links join distinct fingerprints only, copies are counted before.  Components come from
minimum labels with pointer jumping; every round is a written table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import stage, table

SHINGLE = 3
SEED = 42
BITS = 2
CHUNK = 1 << 15
HOT_ANCHOR = 512
HALF = (1 << 32) - 1
BLOCKS = ((0, 11), (11, 11), (22, 10))
#: Columns of the code's parity check: bit b of a half (0 to 30) has the syndrome b + 1; bit 31 is outside the code.
CODE_BITS = 31


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64-bit SimHash of a text as an unsigned number.

    bytes.lower() and bytes.split() know ASCII only: A-Z, and space with U+0009 to U+000D.
    Hashes are counted in chunks, so a long text needs a bounded array.
    """
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        grams: list[bytes] = [b" ".join(words)]
    else:
        grams = list(map(b" ".join, zip(*(words[i:] for i in range(shingle)))))
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, len(grams), CHUNK):
        part = grams[at:at + CHUNK]
        hashes = np.fromiter((digest(g, seed) for g in part), np.uint64, len(part))
        ones += np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(grams)).tobytes(), "big")


def fingerprint_batches(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        values = np.fromiter((fingerprint(t) for t in batch), np.uint64, len(batch))
        yield pd.Series(values.view(np.int64))


def fingerprints(text: str) -> Column:
    return F.pandas_udf(fingerprint_batches, "long")(text)


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def half(fp: Column, k: int) -> Column:
    return F.shiftrightunsigned(fp, 32).bitwiseAND(F.lit(HALF)) if k == 0 else fp.bitwiseAND(F.lit(HALF))


def syndrome(h: Column) -> Column:
    """XOR of b + 1 over the set bits b of the code's 31 positions: the position to flip, or 0 for a code word.

    Bit j of the syndrome is the parity of the positions whose number has bit j.
    """
    out = F.lit(0).cast("long")
    for j in range(5):
        mask = sum(1 << b for b in range(CODE_BITS) if (b + 1) >> j & 1)
        parity = (F.bit_count(h.bitwiseAND(F.lit(mask))) % 2).cast("long")
        out = out.bitwiseOR(F.shiftleft(parity, j))
    return out


def flip(h: Column, s: Column) -> Column:
    """Flip the position with number s (1 to 31); 0 flips nothing."""
    return F.when(s == 0, h).otherwise(h.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), (s - 1).cast("int"))))


def home(h: Column) -> Column:
    """The one anchor within the covering radius of a half."""
    h = h.bitwiseAND(F.lit((1 << CODE_BITS) - 1))
    return flip(h, syndrome(h))


def near_anchors(h: Column) -> Column:
    """All anchors within radius plus threshold, two bits, of a half: the homes of all halves one flip away and its own.

    With syndrome s, flipping position q leads to the anchor that also flips s ^ q.
    """
    h = h.bitwiseAND(F.lit((1 << CODE_BITS) - 1))
    s = syndrome(h)
    own = F.array(flip(h, s))
    flips = F.array(*[F.lit(q).cast("long") for q in range(1, CODE_BITS + 1)])
    others = F.transform(flips, lambda q: flip(flip(h, q), s.bitwiseXOR(q)))
    return F.array_distinct(F.concat(own, others))


def links(nodes: DataFrame, hot: int = HOT_ANCHOR) -> DataFrame:
    """(a, b) with a < b of all distinct fingerprints ``fp`` within two bits."""
    homes = nodes.select("fp", F.explode(F.array(*[
        F.struct(F.lit(k).alias("k"), home(half(F.col("fp"), k)).alias("anchor"), half(F.col("fp"), 1 - k).alias("other")) for k in (0, 1)])).alias("x")).select("fp", "x.*")
    homes = stage(homes)
    crowded = stage(homes.groupBy("k", "anchor").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("k", "anchor", F.lit(True).alias("crowded")))
    # A few small files hold all nodes; the replication is the work, so it gets a task per shuffle partition.
    dealt = nodes.repartition(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    spread = dealt.select("fp", F.explode(F.array(*[
        F.struct(F.lit(k).alias("k"), near_anchors(half(F.col("fp"), k)).alias("anchors"), half(F.col("fp"), 1 - k).alias("other")) for k in (0, 1)])).alias("x"))
    spread = spread.select("fp", "x.k", F.explode("x.anchors").alias("anchor"), "x.other")

    def split(rows: DataFrame) -> DataFrame:
        """Block 0 with value 0 at a quiet anchor, three blocks of the other half at a crowded one."""
        def block(i: int, at: int, bits: int) -> Column:
            return F.lit(i + 1).cast("long") * (1 << 32) + F.shiftright(F.col("other"), at).bitwiseAND(F.lit((1 << bits) - 1))

        blocks = F.array(*[block(i, at, bits) for i, (at, bits) in enumerate(BLOCKS)])
        rows = rows.join(crowded, ["k", "anchor"], "left")
        return rows.select("fp", "k", "anchor", F.explode(F.when(F.col("crowded"), blocks).otherwise(F.array(F.lit(0).cast("long")))).alias("block"))

    a, b = split(homes).withColumnRenamed("fp", "a"), split(spread).withColumnRenamed("fp", "b")
    # Spark sizes b as before its explodes, a thirtieth of it, and would broadcast that.
    met = a.join(b.hint("merge"), (a["k"] == b["k"]) & (a["anchor"] == b["anchor"]) & (a["block"] == b["block"])
                 & (a["a"] != b["b"]) & (F.bit_count(a["a"].bitwiseXOR(b["b"])) <= BITS))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with a link; the root is the smallest node of its component.

    Each round takes the smallest label among a node and its neighbours, then jumps to the
    label's own label, in one job.  It ends when a round changes nothing, after a number of
    rounds near the logarithm of the longest path.
    """
    both = stage(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = stage(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")).select(F.col("a").alias("node"), "root"))
    while True:
        seen = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("root").alias("near"))
        lower = labels.join(seen, labels["node"] == seen["a"], "left").select("node", "root", F.least("root", "near").alias("low"))
        # Hooking: the old root learns the smallest label that any of its nodes has seen.
        hooks = lower.groupBy(F.col("root").alias("of")).agg(F.min("low").alias("hook"))
        hooked = lower.join(hooks, F.col("node") == F.col("of"), "left").select("node", F.col("root").alias("was"), F.least("low", "hook").alias("root"))
        up = hooked.select(F.col("node").alias("parent"), F.col("root").alias("grand"))
        jumped = stage(hooked.join(up, F.col("root") == F.col("parent"), "left").select("node", "was", F.least("root", "grand").alias("root")))
        labels = jumped.select("node", "root")
        if jumped.where(F.col("root") < F.col("was")).isEmpty():
            return labels


def with_components(rows: DataFrame) -> DataFrame:
    """``rows`` (a written table with doc_id and fp) plus root, the fingerprint that stands for its component."""
    nodes = stage(rows.select("fp").distinct())
    roots = components(stage(links(nodes)))
    return rows.join(roots, rows["fp"] == roots["node"], "left").select(rows["*"], F.coalesce("root", "fp").alias("root"))


def op8_anchor_points(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and component of every document.

    Null and empty texts have the fingerprint zero and are linked like others.  A component's
    id is its smallest doc_id; null only if none of its documents has one.
    """
    rows = stage(table(spark, folder, "documents").select("doc_id", fingerprints("text").alias("fp")))
    grouped = stage(with_components(rows))
    least = grouped.groupBy("root").agg(F.min("doc_id").alias("component_id")).withColumnRenamed("root", "of")
    out = grouped.join(stage(least), F.col("root") == F.col("of"))
    return out.select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")


assert math.prod((CODE_BITS + 1, 1 << 26)) == 1 << CODE_BITS  # the code is perfect

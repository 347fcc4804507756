"""Near copies by the sets of five-word shingles: Jaccard similarity of 0.8 or more.

Fingerprints of the five-word shingles, linked by the anchor points of ``simhash_dedup``,
give the first pairs; their sets are compared.  Two bits see the closest copies only, so
what they leave apart is searched on, and every linked pair is found.  Of two such sets each holds at least four fifths of the
other, so in any common order of all shingles their first n - ceil(0.8 n) + k share k.
A first pass in order of the hashes, k a twentieth of the set, leaves the texts of which
so many shingles stand in other texts too; for these k is one and the order rarest first,
so a passage that many texts hold makes no candidates unless it is nearly all of them.

Texts that meet at a shingle are compared with one of them, the one with the fewest
shingles of its own, and components are formed, round by round.  Where a shingle still
joins several components, those outside its largest one look for partners, among the sizes
that are possible: at the first shingle that two linked sets share, both must have enough
left.  Equal sets are one node.  Shingles and sets are compared by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import repeated, row_key, stage, take_rows
from tickloom.llm.simhash_dedup import SEED, components, fingerprint, links

SHINGLE = 5
#: Most rounds that compare with one text per shingle before pairs across components are.
STARS = 2


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Ascending hashes of a text's distinct shingles; fewer words than ``shingle`` are one, no words none."""
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return np.zeros(0, np.int64)
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else iter([b" ".join(words)])
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(g, SEED) for g in grams), np.uint64).view(np.int64))


def depth(n: int) -> int:
    """How many shingles two sets must share among their first ones; it does not fall with n."""
    return max(1, n // 20)


def ahead(n: int) -> int:
    """n - ceil(0.8 n) + depth: so many first shingles of two linked sets share the smaller depth."""
    return n - (4 * n + 4) // 5 + depth(n)


def set_ids(sets: list[np.ndarray]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets), np.uint64, len(sets)).view(np.int64)


def leading(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in texts:
        sets = [shingle_set(t) for t in batch]
        sizes = [len(s) for s in sets]
        # A linked set has at least four fifths of the size, so its depth is at least this.
        yield pd.DataFrame({"id": set_ids(sets), "need": [depth((4 * n + 4) // 5) for n in sizes], "lead": [s[:ahead(n)] for s, n in zip(sets, sizes)]})


def whole(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in texts:
        sets = [shingle_set(t) for t in batch]
        fps = np.fromiter((fingerprint(t, SHINGLE) for t in batch), np.uint64, len(batch))
        yield pd.DataFrame({"id": set_ids(sets), "s": sets, "fp": fps.view(np.int64)})


def alike(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of distinct values is 0.8 or more, in whole numbers."""
    return 9 * F.size(F.array_intersect(a, b)) >= 4 * (F.size(a) + F.size(b))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are alike."""
    left, right = sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), sets.select(F.col("id").alias("b"), F.col("s").alias("sb"))
    return stage(pairs.join(left, "a").join(right, "b").where(alike(F.col("sa"), F.col("sb"))).select("a", "b"))


def anchor_links(sets: DataFrame) -> DataFrame:
    """Links (a, b) of the sets (id, s, fp) whose fingerprints are within two bits and which are alike.

    One set stands for a fingerprint, the others that have it are compared with that one.
    """
    stands = stage(sets.groupBy("fp").agg(F.min("id").alias("id")))
    near = stage(links(stands.select("fp")))
    left, right = stands.select(F.col("fp").alias("a"), F.col("id").alias("ia")), stands.select(F.col("fp").alias("b"), F.col("id").alias("ib"))
    pairs = near.join(left, "a").join(right, "b").select(F.col("ia").alias("a"), F.col("ib").alias("b"))
    same = sets.select("id", "fp").join(stands.withColumnRenamed("id", "a"), "fp").where("id <> a").select("a", F.col("id").alias("b"))
    return verified(pairs.unionByName(same), sets)


def meeting_points(sets: DataFrame) -> DataFrame:
    """(h, id, n, own, pos): the shingles among the first n - ceil(0.8 n) + 1 of each set, rarest first, that another set holds too.

    ``own`` counts the shingles that no other set holds; they come first in the order and
    meet nobody.  ``pos`` is the shingle's place in the order, from 0.
    """
    held = sets.select("id", F.size("s").alias("n"), F.explode("s").alias("h"))
    several = stage(held.groupBy("h").agg(F.count("*").alias("c")).where("c > 1"))
    shared = held.join(several, "h").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("c", "h"))).alias("x")).withColumn("own", F.expr("n - size(x)"))
    left = F.expr("n - (4 * n + 4) div 5 + 1 - own").cast("int")
    points = shared.select("id", "n", "own", F.posexplode(F.slice("x", 1, F.greatest(left, F.lit(0)))).alias("at", "y"))
    return points.select("y.h", "id", "n", "own", (F.col("own") + F.col("at")).alias("pos"))


#: At the first shingle that two linked sets share, what is left of either is enough for a similarity of 0.8.
ENOUGH = "9 * least(na - pa, nb - pb) >= 4 * (na + nb)"


def size_bin(n: Column) -> Column:
    """Bins of sizes, each a twenty-fifth wider than the one before."""
    return F.floor(F.log(F.greatest(n, F.lit(1))) / F.lit(math.log(1.04))).cast("int")


def side(rows: DataFrame, x: str, *more: str) -> DataFrame:
    return rows.select("h", *more, F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("pos").alias(f"p{x}"), F.col("root").alias(f"r{x}"))


def centres(live: DataFrame) -> DataFrame:
    """One set per shingle: the one with the fewest shingles of its own, which is the original of a group of edited copies."""
    return live.groupBy("h").agg(F.min(F.struct("own", "id", "n", "pos", "root")).alias("x")).select("h", "x.*")


def across(live: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components that meet at a shingle and may be linked.

    Of such a pair at least one is outside the shingle's largest component, so only those
    look for partners, among the sizes that their place in the order allows.
    """
    most = live.groupBy("h", "root").agg(F.count("*").alias("k")).groupBy("h").agg(F.max(F.struct("k", "root")).alias("m")).select("h", F.col("m.root").alias("most"))
    few = live.join(most, "h").where("root <> most")
    low, high = F.expr("(4 * n + 4) div 5"), F.expr("9 * (n - pos) div 4 - n")
    few = few.where(low <= high).withColumn("bin", F.explode(F.sequence(size_bin(low), size_bin(high))))
    met = side(few, "a", "bin").join(side(live.withColumn("bin", size_bin(F.col("n"))), "b", "bin"), ["h", "bin"]).where(f"ra <> rb and {ENOUGH}")
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def near_sets(sets: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """(node, root) of the sets (id, s) that are linked with another; ``edges`` are links (a, b) known before.

    Rounds compare what meets at a shingle with one set, its centre, which then is done
    there; when a round joins nothing any more, the rest is compared across components.
    """
    live, roots = stage(meeting_points(sets)), None
    if edges is not None:
        edges = stage(edges.distinct())
        roots = components(edges)
    for turn in range(STARS + 1):
        rooted = live.withColumn("root", F.col("id"))
        if roots is not None:
            rooted = live.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
        busy = rooted.groupBy("h").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("h")
        rooted = stage(rooted.join(busy, "h", "left_semi"))
        if rooted.isEmpty():
            break
        last = turn == STARS
        if last:
            met = across(rooted)
        else:
            centre = stage(centres(rooted))
            met = side(rooted, "a").join(side(centre, "b"), "h").where(f"a <> b and ra <> rb and {ENOUGH}")
            met = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
            live = rooted.join(centre.select("h", F.col("id").alias("c")), "h").where("id <> c").select(*live.columns)
        found = verified(met.distinct(), sets)
        if found.isEmpty():
            if last:
                break
            found = verified(across(rooted).distinct(), sets)
            last = True
        edges = found if edges is None else edges.unionByName(found)
        roots = components(stage(edges.distinct()))
        if last:
            break
    return roots if roots is not None else sets.sparkSession.createDataFrame([], "node long, root long")


def without_near_copies(docs: DataFrame) -> DataFrame:
    """One document of each component, all columns: the one with the smallest doc_id (null last), the first row of equal ids."""
    marked = docs.select("doc_id", *row_key(docs.columns), F.pandas_udf(leading, "id long, need long, lead array<long>")("text").alias("x"))
    marked = stage(marked.select("doc_id", "k1", "k2", "x.*"))
    leads = marked.select("id", "need", F.explode("lead").alias("h"))
    shared = leads.groupBy("h").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("h")
    some = stage(leads.join(stage(shared), "h", "left_semi").distinct().groupBy("id", "need").agg(F.count("*").alias("n")).where("n >= need").select("id"))
    rows = marked.select("doc_id", "k1", "k2", "id")
    chosen = stage(rows.join(some, "id", "left_semi").groupBy("id").agg(F.min(F.struct("k1", "k2")).alias("k")).select("id", "k.k1", "k.k2", F.lit(1).alias("copies")))
    many = stage(repeated(rows))
    texts = take_rows(docs, chosen.select("k1", "k2", "copies"), many)
    sets = stage(texts.select(F.pandas_udf(whole, "id long, s array<long>, fp long")("text").alias("x")).select("x.*"))
    found = anchor_links(sets)
    roots = near_sets(sets, None if found.isEmpty() else found)
    grouped = rows.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    first = grouped.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "k1", "k2")).alias("first"))
    return take_rows(docs, stage(first.select("first.k1", "first.k2", F.lit(1).alias("copies"))), many)

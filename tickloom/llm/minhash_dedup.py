"""Near duplicates by MinHash with tensored banding.

Texts are sets of two-word shingles; sets with a Jaccard similarity of 0.8 or more are
linked.  Two collections hold GROUPS groups of WIDTH minima each.  A table's key is a pair,
one group of either collection, so GROUPS * GROUPS tables of 2 * WIDTH minima take
2 * GROUPS * WIDTH minima, not GROUPS * GROUPS * 2 * WIDTH: 48 instead of 576.  A linked pair
misses all tables only if it differs in every group of one collection: at a similarity of
0.8 with probability 2 * (1 - 0.8 ** WIDTH) ** GROUPS, about one in 100,000, at 0.9 one in a
billion.

Sets that share a key are compared with one of them, its centre, round by round.  A pair
goes on if the 48 minima agree often enough (at least LIKE of them; a linked pair fails with
probability below one in ten million), and is then verified on the full sets.  Keys that
still hold several components after that are crowded by texts that are alike, but not
enough; their sets go through the exact prefix join of ``set_dedup``.  So nothing grows with
the square of a group, and no table has a cap.

Equal sets are one node.  Shingles and sets are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import repeated, row_key, stage, table, take_rows
from tickloom.llm.set_dedup import near_sets, set_ids, verified
from tickloom.llm.simhash_dedup import SEED, components

WIDTH, GROUPS = 2, 12
MINIMA = 2 * WIDTH * GROUPS
#: Minima of a pair that must agree before its sets are compared; at a similarity of 0.8 about 38 of 48 do.
LIKE = 22
#: Rounds that compare with one set per key before the rest goes through the prefix join.
ROUNDS = 2
CHUNK = 1 << 20
WORDS = 1 << 20
A, B, C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_r = np.random.default_rng(SEED)
MASKS, ODD = _r.integers(0, 1 << 63, MINIMA, dtype=np.uint64), _r.integers(0, 1 << 63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class WordHashes(dict):
    """64-bit hashes of words, kept up to a bound."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word, SEED)
        if len(self) < WORDS:
            self[word] = value
        return value


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * C
    return x ^ (x >> np.uint64(29))


def pair_set(text: str | None, known: WordHashes) -> np.ndarray:
    """Ascending hashes of a text's distinct two-word shingles; one word is one, no words none.

    bytes.lower() and bytes.split() know ASCII only: A-Z, and space with U+0009 to U+000D.
    """
    words = (text or "").encode("utf-8").lower().split()
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    if len(h) < 2:
        return mixed(h * A).view(np.int64)
    return np.unique(mixed(h[:-1] * A + h[1:] * B).view(np.int64))


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """The MINIMA smallest values of each set under as many hash functions, 32 bits each; -1 for an empty set."""
    out = np.full((len(sets), MINIMA), -1, np.int32)
    full = [k for k, s in enumerate(sets) if len(s)]
    if full:
        ends = np.cumsum([len(sets[k]) for k in full])
        starts, at = np.concatenate([[0], ends[:-1]]), 0
        while at < len(full):
            to = max(at + 1, int(np.searchsorted(ends, starts[at] + CHUNK, side="right")))
            values = np.concatenate([sets[k] for k in full[at:to]]).view(np.uint64)
            for i in range(MINIMA):
                low = np.minimum.reduceat(mixed((values ^ MASKS[i]) * ODD[i]), starts[at:to] - starts[at])
                out[full[at:to], i] = (low >> np.uint64(32)).astype(np.uint32).view(np.int32)
            at = to
    return out


def described(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    known = WordHashes()
    for batch in texts:
        sets = [pair_set(t, known) for t in batch]
        yield pd.DataFrame({"id": set_ids(sets), "n": [len(s) for s in sets], "sig": list(minima(sets))})


def whole(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    known = WordHashes()
    for batch in texts:
        sets = [pair_set(t, known) for t in batch]
        yield pd.DataFrame({"id": set_ids(sets), "s": sets})


def table_keys(sigs: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Keys of all tables: every group of the first collection with every group of the second."""
    number = np.arange(GROUPS * GROUPS, dtype=np.uint64).reshape(GROUPS, GROUPS) * C
    for batch in sigs:
        groups = np.stack(list(batch)).view(np.uint32).astype(np.uint64).reshape(len(batch), 2, GROUPS, WIDTH)
        one = groups[..., 0]
        for k in range(1, WIDTH):
            one = mixed(one * A + groups[..., k])
        keys = mixed(one[:, 0, :, None] * A + one[:, 1, None, :] * B + number)
        yield pd.Series(list(keys.reshape(len(batch), -1).view(np.int64)))


def shared_keys(nodes: DataFrame) -> DataFrame:
    """(key, id, n, weight) of ``nodes`` (id, n, sig) where several sets have a key; weight is a set's company over all tables."""
    # A few files hold all nodes; making their keys is the work, so it gets a task per shuffle partition.
    dealt = nodes.repartition(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id")
    rows = dealt.select("id", "n", F.explode(F.pandas_udf(table_keys, "array<long>")("sig")).alias("key"))
    several = rows.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    live = stage(rows.join(several, "key"))
    weight = live.groupBy("id").agg(F.sum("c").alias("weight"))
    return stage(live.join(weight, "id").select("key", "id", "n", "weight"))


def busy_keys(live: DataFrame, roots: DataFrame | None) -> DataFrame:
    """The rows, with their root, of keys that hold several components."""
    rooted = live.withColumn("root", F.col("id"))
    if roots is not None:
        rooted = live.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    busy = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
    return stage(rooted.join(busy, "key", "left_semi"))


def with_centres(live: DataFrame) -> DataFrame:
    """The rows but for their key's centre, the set with the most company, and that centre as c, nc, rc."""
    centre = live.groupBy("key").agg(F.max(F.struct("weight", "id", "n", "root")).alias("x")).select("key", F.col("x.id").alias("c"), F.col("x.n").alias("nc"), F.col("x.root").alias("rc"))
    return stage(live.join(centre, "key").where("id <> c"))


def alike_enough(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose minima agree at least LIKE times."""
    left, right = nodes.select(F.col("id").alias("a"), F.col("sig").alias("sa")), nodes.select(F.col("id").alias("b"), F.col("sig").alias("sb"))
    agree = F.aggregate(F.zip_with("sa", "sb", lambda x, y: (x == y).cast("int")), F.lit(0), lambda total, x: total + x)
    return stage(pairs.join(left, "a").join(right, "b").where(agree >= LIKE).select("a", "b"))


def similar_sets(nodes: DataFrame, sets_of) -> DataFrame:
    """(node, root) of the ``nodes`` (id, n, sig) that are linked with another; ``sets_of(ids)`` gives written sets (id, s)."""
    live = busy_keys(shared_keys(nodes), None)
    sets = edges = roots = None
    for _ in range(ROUNDS):
        if live.isEmpty():
            break
        rest = with_centres(live)
        pairs = rest.where("root <> rc and 5 * n >= 4 * nc and 5 * nc >= 4 * n").select(F.least("id", "c").alias("a"), F.greatest("id", "c").alias("b")).distinct()
        pairs = alike_enough(pairs, nodes)
        live = rest.select("key", "id", "n", "weight")
        if sets is None:
            # Texts are read once more, for the sets of these pairs and of keys that go on.
            more = live.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
            needed = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).union(live.join(more, "key", "left_semi").select("id"))
            sets = sets_of(needed.distinct())
        found = verified(pairs, sets)
        if not found.isEmpty():
            edges = found if edges is None else edges.unionByName(found)
            roots = components(stage(edges.distinct()))
        live = busy_keys(live, roots)
    if not live.isEmpty():
        crowd = stage(sets.join(live.select("id").distinct(), "id", "left_semi"))
        inside = near_sets(crowd)
        links = inside.where("node <> root").select(F.col("root").alias("a"), F.col("node").alias("b"))
        edges = links if edges is None else edges.unionByName(links)
        roots = components(stage(edges.distinct()))
    return roots if roots is not None else nodes.sparkSession.createDataFrame([], "node long, root long")


def grouped(docs: DataFrame) -> DataFrame:
    """Written rows (doc_id, n, root) of ``docs`` (doc_id, text): rows of a component share the root, texts without words have none."""
    docs = docs.select("doc_id", "text")
    marked = stage(docs.select("doc_id", *row_key(docs.columns), F.pandas_udf(described, "id long, n long, sig array<int>")("text").alias("x")).select("doc_id", "k1", "k2", "x.*"))
    rows = marked.where("n > 0")
    nodes = stage(rows.select("id", "n", "sig").dropDuplicates(["id"]))

    def sets_of(ids: DataFrame) -> DataFrame:
        first = rows.join(ids, "id", "left_semi").groupBy("id").agg(F.min(F.struct("k1", "k2")).alias("k"))
        chosen = stage(first.select("k.k1", "k.k2", F.lit(1).alias("copies")))
        texts = take_rows(docs, chosen, repeated(marked.select("k1", "k2")))
        return stage(texts.select(F.pandas_udf(whole, "id long, s array<long>")("text").alias("x")).select("x.*"))

    roots = similar_sets(nodes, sets_of)
    out = marked.select("doc_id", "n", "id").join(roots, F.col("id") == F.col("node"), "left")
    return stage(out.select("doc_id", "n", F.when(F.col("n") > 0, F.coalesce("root", "id")).alias("root")))


def op12_tensored_minhash(spark: SparkSession, folder: str) -> DataFrame:
    """Size, component and verdict of every document.

    Texts without words, null ones too, have no shingles and are linked with nothing.
    Repeated rows are rows of one component.  A component's id is its smallest doc_id, null
    only if none of its documents has one; kept compares with nulls as equal.
    """
    rows = grouped(table(spark, folder, "documents"))
    least = stage(rows.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("least")).withColumnRenamed("root", "of"))
    out = rows.join(least, F.col("root") == F.col("of"), "left").withColumn("component_id", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("least")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))

"""Benchmark decontamination by a prefix-filtered join.

An item is cut into windows of ten consecutive words (one window if it is shorter).  A
window's tokens are its three-word shingles, ordered by rarity in the documents.  A window
that occurs whole in a text holds all of its tokens, so its necessary prefix is the one
rarest token: documents join on that token alone.  The token's position fixes where the
window would start; it must fit inside the text, and the words there must equal the window.

The benchmark side is broadcast in blocks of bounded size; one block is the rule, and a
benchmark beyond the bound is worked off block by block.  DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.llm.common import ascii_lower, let, stage, table, text_of

WINDOW = 10
TOKEN = 3
#: Windows (a few hundred bytes each) in one broadcast block.
BLOCK = 200_000
NOT_WORD = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def word_list(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(text), NOT_WORD), "")


def shingles(w: Column, n: int) -> Column:
    """Hashes of all runs of n words, by position, made of the words' hashes; none if the list is shorter."""
    def run(h: Column) -> Column:
        first = F.slice(h, F.lit(1), F.greatest(F.size(h) - (n - 1), F.lit(0)))
        return F.transform(first, lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, n)]))

    return let(F.transform(w, lambda x: F.xxhash64(x)), run)


def item_windows(items: DataFrame, window: int = WINDOW, token: int = TOKEN) -> DataFrame:
    """(item, words, size, n, tokens): every distinct window of every item; n is the length of its tokens.

    A null item_id is the item ''.
    """
    w = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), word_list(text_of()).alias("w")).where(F.size("w") > 0)
    size = F.least(F.size("w"), F.lit(window))
    w = w.select("item", "w", F.explode(F.sequence(F.lit(1), F.size("w") - size + 1)).alias("at"), size.alias("size"))
    w = w.select("item", F.slice("w", F.col("at"), F.col("size")).alias("words"), "size", F.least("size", F.lit(token)).alias("n")).distinct()
    return w.withColumn("tokens", F.coalesce(*[F.when(F.col("n") == n, shingles(F.col("words"), n)) for n in range(1, token + 1)]))


def meet(docs: DataFrame, lengths: list[int], side: DataFrame, *keep: str) -> list[DataFrame]:
    """Tokens of the documents joined to ``side`` on (n, token), one table per token length, with the word list ``w``.

    The tokens are a column before they are exploded, so that the explosion and the broadcast
    join behind it are one generated loop: the word list stays a reference, and nothing may
    stand between the two that would copy it for every token.  The outer form keeps Spark
    from testing the token array in a filter below, which would split the text once more for
    every token.
    """
    out = []
    for n in lengths:
        tokens = docs.select(*keep, "w", shingles(F.col("w"), n).alias("tokens"))
        rows = tokens.select(*keep, "w", F.posexplode_outer("tokens").alias("at", "token"))
        out.append(rows.join(F.broadcast(side.where(F.col("n") == n)), "token"))
    return out


def stacked(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def prefix_tokens(windows: DataFrame, docs: DataFrame, lengths: list[int], blocks: int) -> DataFrame:
    """Every window with its rarest token: ``token`` and ``offset``, the token's place in the window.

    Rarity counts the token in all documents; ties go to the smaller hash, then the first place.
    """
    pool = stage(windows.select("n", F.explode("tokens").alias("token")).distinct())
    hits = []
    for b in range(blocks):
        part = pool.where(F.pmod(F.xxhash64("token"), F.lit(blocks)) == b) if blocks > 1 else pool
        hits += [x.groupBy("n", "token").agg(F.count("*").alias("seen")) for x in meet(docs, lengths, part)]
    counts = stage(stacked(hits))
    places = windows.select("wid", "n", F.posexplode("tokens").alias("offset", "token"))
    best = places.join(counts, ["n", "token"], "left").groupBy("wid").agg(F.min(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "token", "offset")).alias("best"))
    # A window whose rarest token no document has cannot occur.
    return stage(windows.join(best.where("best.seen > 0"), "wid").select("wid", "item", "words", "size", "n", F.col("best.token").alias("token"), F.col("best.offset").alias("offset")))


def occurrences(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(key, start, size, item) of all window occurrences in ``docs`` (key, w); starts count from 0."""
    windows = stage(item_windows(items).withColumn("wid", F.monotonically_increasing_id()))
    lengths = [r[0] for r in windows.select("n").distinct().orderBy("n").collect()]  # at most TOKEN values
    none = docs.select("key").where(F.lit(False)).select("key", F.lit(0).alias("start"), F.lit(0).alias("size"), F.lit("").alias("item"))
    if not lengths:
        return none
    blocks = 1 + windows.count() // BLOCK
    windows = prefix_tokens(windows, docs, lengths, blocks)
    start = F.col("at") - F.col("offset")
    fits = (start >= 0) & (start + F.col("size") <= F.size("w"))
    same = F.slice("w", F.greatest(start, F.lit(0)) + 1, F.col("size")) == F.col("words")
    found = []
    for b in range(blocks):
        part = windows.where(F.pmod(F.xxhash64("wid"), F.lit(blocks)) == b) if blocks > 1 else windows
        part = part.select("n", "token", "offset", "words", "size", "item")
        found += [x.where(fits & same).select("key", start.cast("int").alias("start"), "size", "item") for x in meet(docs, lengths, part, "key")]
    return stacked(found)


def hit_summary(found: DataFrame) -> DataFrame:
    """(key, n_hit, n_items, items) per key with an occurrence.

    Occurrences collapse to distinct (start, size) and distinct items before they meet; both
    are bounded by the words of one text and the items of the benchmark.
    """
    found = stage(found.distinct())
    spans = found.groupBy("key", "start").agg(F.max("size").alias("size"))
    order = Window.partitionBy("key").orderBy("start")
    ends = F.max(F.col("start") + F.col("size")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("fresh", F.greatest(F.lit(0), F.col("start") + F.col("size") - F.greatest(F.col("start"), F.coalesce(ends, F.lit(0)))))
    hit = spans.groupBy("key").agg(F.sum("fresh").cast("long").alias("n_hit"))
    item = found.select("key", "item").distinct().groupBy("key").agg(F.sort_array(F.collect_list("item")).alias("items"))
    return hit.join(item, "key").select("key", "n_hit", F.size("items").cast("long").alias("n_items"), "items")


def keyed(docs: DataFrame, text: Column, *keep: Column) -> DataFrame:
    """``keep`` plus key, a hash of the text (copies share their hits), and the words ``w``."""
    return docs.select(*keep, F.md5(text.cast("binary")).alias("key"), word_list(text).alias("w"))


def op9_prefix_join(spark: SparkSession, folder: str) -> DataFrame:
    """Hits of the benchmark in every document.

    A null text has no words; a document without hits has the hash of the empty string;
    repeated item ids count once; windows shared by items count for each of them.
    """
    docs, items = table(spark, folder, "documents"), table(spark, folder, "benchmark")
    rows = keyed(docs, text_of(), F.col("doc_id"))
    hits = stage(hit_summary(occurrences(rows.select("key", "w"), items)))
    base = stage(rows.select("doc_id", "key", F.size("w").cast("long").alias("n_words")))
    out = base.join(hits, "key", "left")
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
                      F.sha2(F.array_join(F.coalesce("items", F.array().cast("array<string>")), ",").cast("binary"), 256).alias("items_sha256"), F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"))


def clean_documents(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents without any benchmark window, all columns."""
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    text = F.coalesce(F.col("row.text"), F.lit(""))
    found = occurrences(keyed(rows, text).select("key", "w"), items)
    bad = stage(found.select("key").distinct())
    return rows.withColumn("key", F.md5(text.cast("binary"))).join(bad, "key", "left_anti").select("row.*")


DECONTAMINATION_SQL = """
WITH i AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, list_filter(regexp_split_to_array(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS w FROM benchmark),
i1 AS (SELECT item, w, least(len(w), 10) AS size, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS k FROM i WHERE len(w) > 0),
win AS (SELECT DISTINCT item, size, array_to_string(w[k:k + size - 1], ' ') AS g FROM i1),
sizes AS (SELECT DISTINCT size FROM win),
d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS w FROM documents),
d1 AS (SELECT rid, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM d, sizes WHERE len(w) >= size),
hit AS (SELECT d1.rid, d1.k, d1.size, win.item FROM d1 JOIN win ON win.size = d1.size AND win.g = array_to_string(d1.w[d1.k:d1.k + d1.size - 1], ' ')),
pos AS (SELECT DISTINCT rid, unnest(range(k, k + size)) AS p FROM hit),
n AS (SELECT rid, count(*) AS n_hit FROM pos GROUP BY rid),
its AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM hit) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (rid) LEFT JOIN its USING (rid)
"""

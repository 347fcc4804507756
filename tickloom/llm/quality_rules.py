"""Document rules and host verdicts.

Rules fail single documents.  Failures are then counted per host (``source``); a host's
rate is shrunk towards the rate of all hosts by a beta prior whose two parameters come
from the hosts themselves (method of moments), so that a host of three documents is not
judged by one bad one.  Hosts above the limit fail as a whole and the verdict is joined
back to their documents.  DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import let, stage, table, text_of, words

WINDOW = 8
MIN_WORDS = 20
REPEAT_PERCENT = 30
HOST_LIMIT = 0.5
FLAT_STRENGTH = 100.0
SYMBOLS = "[^#*$%&|<>]+"


def covered(starts: Column, width: int) -> Column:
    """Positions inside intervals of one width that start at the ascending ``starts``."""
    steps = F.transform(starts, lambda p, k: F.least(F.lit(width), F.coalesce(F.get(starts, k + 1) - p, F.lit(width))))
    return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)


def repeated_words(words_of: Column, width: int = WINDOW) -> Column:
    """Words inside windows of ``width`` words that occur twice or more in the same text.

    Windows compare by a 64-bit hash of their words.  A text without an equal pair stops
    after one hash set; others sort their windows once.  The list is bound before use, so a
    filter that Spark moves below computes it once, not once per window.
    """
    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(w) - (width - 1)), lambda i: F.xxhash64(F.slice(w, i, width)))

    def count(h: Column) -> Column:
        ordered = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            twice = F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]))
            return F.array_sort(F.transform(twice, lambda x: x["i"]))

        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(
            let(ordered, lambda s: let(starts(s), lambda p: covered(p, width))))

    return let(words_of, lambda w: F.when(F.size(w) < width, F.lit(0).cast("long")).otherwise(let(windows(w), count)))


def rule_counts(docs: DataFrame, text: Column, *keep: Column) -> DataFrame:
    """``keep`` columns plus n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    rows = docs.select(*keep, text.alias("t"), words(text).alias("w"))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    rows = rows.select(
        "*", F.size("w").cast("long").alias("n_words"),
        F.length(F.regexp_replace("t", "[\\x20\\x09-\\x0D]+", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("t", SYMBOLS, "")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("w")).alias("n_repeat_words"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return rows.drop("t", "w").withColumn("base_failed", failed)


def host_verdicts(flagged: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """One row per named host: host, docs, failed, shrunk rate, rejected.

    Prior strength is mean * (1 - mean) / variance - 1 over the hosts' rates, between 1 and
    a million; hosts of equal rates get a fixed strength.  Counts combine on the map side,
    so a host of any size travels as one row per task.
    """
    hosts = flagged.where(F.col("host").isNotNull()).groupBy("host").agg(F.count("*").alias("docs"), F.sum(F.col("base_failed").cast("long")).alias("failed"))
    hosts = stage(hosts)
    rate = F.col("failed").cast("double") / F.col("docs")
    mean, variance = hosts.agg(F.avg(rate), F.var_pop(rate)).first()
    mean, variance = mean or 0.0, variance or 0.0
    strength = FLAT_STRENGTH if variance <= 1e-12 else min(max(mean * (1 - mean) / variance - 1, 1.0), 1e6)
    shrunk = (F.col("failed") + F.lit(mean * strength)) / (F.col("docs") + F.lit(strength))
    return hosts.withColumn("rate", shrunk).withColumn("rejected", shrunk > limit)


def with_verdicts(flagged: DataFrame) -> DataFrame:
    """``flagged`` (a table with host and base_failed) plus ``kept``.

    The rejected hosts are a written table too: Spark knows its size and broadcasts it while
    it is small; beyond that a hot host is split at run time by the skew join.
    """
    bad = stage(host_verdicts(flagged).where("rejected").select(F.col("host").alias("bad_host")))
    out = flagged.join(bad, flagged["host"] == bad["bad_host"], "left")
    return out.withColumn("kept", ~F.col("base_failed") & F.col("bad_host").isNull()).drop("bad_host")


def op2_host_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Counts, rule result and verdict of every document.

    A null text has no words and fails; a null source has no host verdict; repeated rows are
    judged one by one.
    """
    docs = table(spark, folder, "documents")
    flagged = stage(rule_counts(docs, text_of(), F.col("doc_id"), F.col("source").alias("host")))
    return with_verdicts(flagged).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def kept_documents(docs: DataFrame) -> DataFrame:
    """The documents whose own rules and host pass, all columns.

    The rules run twice, once to count the hosts and once to pass the rows on, so that no
    text is written or dealt out; only the rejected hosts are joined.
    """
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    flagged = rule_counts(rows, F.coalesce(F.col("row.text"), F.lit("")), F.col("row"), F.col("row.source").alias("host"))
    return with_verdicts(flagged).where("kept").select("row.*")


RULES_SQL = """
WITH d AS (
 SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t,
        list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w
 FROM documents),
x AS (SELECT rid, len(w) AS n, unnest(range(1, greatest(len(w) - 6, 1))) AS i, w FROM d),
g AS (SELECT rid, n, i, array_to_string(w[i:i + 7], ' ') AS g FROM x),
r AS (SELECT rid, i FROM g QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
p AS (SELECT rid, sum(least(8, coalesce(nxt - i, 8))) AS n_rep FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM r) GROUP BY rid),
m AS (
 SELECT d.doc_id, d.source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')))
             - len(list_distinct(list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')))) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(n_rep, 0) AS BIGINT) AS n_repeat_words
 FROM d LEFT JOIN p USING (rid)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
h AS (SELECT source, count(*) AS docs, sum(base_failed::INT) AS failed FROM f WHERE source IS NOT NULL GROUP BY source),
a AS (SELECT coalesce(avg(failed::DOUBLE / docs), 0) AS mean, coalesce(var_pop(failed::DOUBLE / docs), 0) AS variance FROM h),
k AS (SELECT mean, CASE WHEN variance <= 1e-12 THEN 100.0 ELSE least(greatest(mean * (1 - mean) / variance - 1, 1.0), 1e6) END AS strength FROM a),
bad AS (SELECT source FROM h, k WHERE (failed + mean * strength) / (docs + strength) > 0.5)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND bad.source IS NULL AS kept
FROM f LEFT JOIN bad ON f.source = bad.source
"""

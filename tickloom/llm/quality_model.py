"""Quality classifier: gradient-boosted trees on histograms of document statistics.

Statistics are DataFrame columns, one pass over the texts.  Trees are fitted in numpy on a
bounded sample of labelled rows: columns are cut into 64 bins at sample quantiles, splits
come from gradient and hessian sums per bin.  A fitted forest is four flat arrays of
complete trees; scoring walks all rows of a batch down one level at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import stage, table, text_of
from tickloom.llm.quality_rules import rule_counts

#: Labelled rows that a model is fitted on; the smallest hashes of doc_id, the same at every size.
FIT_ROWS = 20_000
FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct", "longest", "n_chars", "n_lines", "n_upper", "n_digits", "n_points", "n_calls", "n_letters"]


def remainder(doc_id: Column, folds: int) -> Column:
    """crc32(doc_id as text) mod folds; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def statistics(docs: DataFrame, *keep: Column) -> DataFrame:
    """``keep`` plus the counts of COUNTS."""
    def count(kept: str) -> Column:
        return F.length(F.regexp_replace(text_of("t0"), f"[^{kept}]+", "")).cast("long")

    rows = docs.select(*keep, text_of().alias("t0"))
    names = [c for c in rows.columns if c != "t0"]
    counted = rule_counts(rows, F.col("t0"), *names, F.col("t0"))
    w = F.array_remove(F.split("t0", "[\\x20\\x09-\\x0D]+"), "")
    return counted.select(
        *names, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", F.size(F.array_distinct(w)).cast("long").alias("n_distinct"),
        F.coalesce(F.array_max(F.transform(w, F.length)), F.lit(0)).cast("long").alias("longest"),
        F.length("t0").cast("long").alias("n_chars"), F.size(F.split("t0", "\n")).cast("long").alias("n_lines"),
        count("\\p{Lu}").alias("n_upper"), count("\\p{N}").alias("n_digits"), count(".,;:").alias("n_points"), count("!?").alias("n_calls"), count("\\p{L}").alias("n_letters"))


def ratios(counts: np.ndarray) -> np.ndarray:
    """Features from the columns of COUNTS; an empty text has zeros."""
    c = dict(zip(COUNTS, counts.T.astype(np.float64)))
    n, chars, lines = np.maximum(c["n_words"], 1), np.maximum(c["n_chars"], 1), np.maximum(c["n_lines"], 1)
    return np.column_stack([
        np.log1p(c["n_words"]), c["word_chars"] / n, c["n_symbols"] / n, c["n_dup_lines"] / lines, c["n_repeat_words"] / n, c["n_distinct"] / n, c["longest"],
        c["n_lines"] / n, c["n_upper"] / chars, c["n_digits"] / chars, c["n_points"] / n, c["n_calls"] / n, c["n_letters"] / chars])


@dataclass
class Forest:
    """Complete binary trees: node k's children are 2k + 1 and 2k + 2; a closed node sends all rows left."""

    feature: np.ndarray
    limit: np.ndarray
    leaf: np.ndarray
    base: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        depth = (inner + 1).bit_length() - 1
        for feature, limit, leaf in zip(self.feature, self.limit, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > limit[node])
            total += leaf[node - inner]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 120, depth: int = 4, rate: float = 0.1, bins: int = 64, ridge: float = 1.0, least: float = 1.0) -> Forest:
    """Boost logistic loss; without two classes the forest is the smoothed share of ones."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    inner, leaves = 2**depth - 1, 2**depth
    base = float(np.log(share / (1 - share)))
    if len(np.unique(y)) < 2:
        return Forest(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)), base)
    k = x.shape[1]
    cuts = [np.unique(np.quantile(x[:, j], np.arange(1, bins) / bins)) for j in range(k)]
    code = np.column_stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(k)])
    score = np.full(len(y), base)
    features, limits, values = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, p * (1 - p)
        feature, limit = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            width, first = 2**level, 2**level - 1
            at = node - first
            best, arg, cut = np.full(width, 1e-6), np.zeros(width, np.int64), np.full(width, -1)
            for j in range(k):
                if not len(cuts[j]):
                    continue
                cell = at * bins + code[:, j]
                gs = np.bincount(cell, g, width * bins).reshape(width, bins).cumsum(1)
                hs = np.bincount(cell, h, width * bins).reshape(width, bins).cumsum(1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + ridge) + (gt - gs)**2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
                gain[(hs < least) | (ht - hs < least)] = 0
                gain = gain[:, :len(cuts[j])]
                top = gain.argmax(1)
                better = gain[np.arange(width), top] > best
                best[better], arg[better], cut[better] = gain[np.arange(width), top][better], j, top[better]
            for i in np.flatnonzero(cut >= 0):
                feature[first + i], limit[first + i] = arg[i], cuts[arg[i]][cut[i]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > limit[node])
        end = node - inner
        leaf = -rate * np.bincount(end, g, leaves) / (np.bincount(end, h, leaves) + ridge)
        score += leaf[end]
        features.append(feature)
        limits.append(limit)
        values.append(leaf)
    return Forest(np.array(features), np.array(limits), np.array(values), base)


def labelled(labels: DataFrame, column: str, folds: int, held_out: int, rows: int = FIT_ROWS) -> DataFrame:
    """(id, label) of at most ``rows`` labelled rows outside the held-out fold, by hash of their id."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1) & (remainder(F.col("doc_id"), folds) != held_out))
    known = known.select(F.col("doc_id").alias("id"), F.col(column).cast("int").alias("label"))
    return stage(known.orderBy(F.xxhash64("id"), "id", "label").limit(rows))


def fit_forest(counted: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Forest:
    """Fit on the sample's rows of ``counted`` (doc_id and COUNTS)."""
    sample = counted.join(F.broadcast(labelled(labels, "quality", FOLDS, HELD_OUT, rows)), F.col("doc_id") == F.col("id"))
    sample = sample.orderBy(F.xxhash64("id"), "id", *COUNTS).limit(rows).select(*COUNTS, "label").toPandas()
    return fit(ratios(sample[COUNTS].to_numpy()), sample["label"].to_numpy(np.float64))


def with_scores(counted: DataFrame, forest: Forest) -> DataFrame:
    def scored(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in batches:
            yield pd.Series(forest.scores(ratios(np.column_stack([c.to_numpy() for c in columns]))))

    return counted.withColumn("score", F.pandas_udf(scored, "double")(*COUNTS))


def op3_histogram_trees(spark: SparkSession, folder: str) -> DataFrame:
    """Score of every document, 0 to 1, higher for quality 1.

    Empty and null texts are scored by zero statistics.  Repeated rows are scored one by one.
    """
    counted = stage(statistics(table(spark, folder, "documents"), F.col("doc_id")))
    forest = fit_forest(counted, table(spark, folder, "labels"))
    out = with_scores(counted, forest)
    return out.select("doc_id", (remainder(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

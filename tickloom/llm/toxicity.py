"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic rows are the positives; all labelled rows of the fitting folds, their
labels set aside, are the unlabelled text, in which the class prior is the share of
positives.  A linear model over words and word beginnings minimises

    prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))

with logistic loss: what the positives would cost as negatives is taken out of the
unlabelled risk, and that difference is not allowed below zero (Kiryo et al., 2017).
Fitting uses a bounded sample of labelled rows; features are presence, so the score of a
long text is as sensitive to one word as that of a short one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import stage, table
from tickloom.llm.quality_model import FIT_ROWS, THRESHOLD, labelled, remainder

FOLDS, HELD_OUT = 4, 2
#: Features of a model, those that positives and unlabelled rows differ in most.
FEATURES = 4096
#: Least distance of a feature's positives from their expected number, in standard deviations.
SIGNIFICANT = 3.0
PREFIXES = (4, 5)
CACHE = 400_000
WORD = re.compile(r"\w+")


def word_features(word: str) -> list[str]:
    return [f"={word}", *(f"^{word[:n]}" for n in PREFIXES if len(word) >= n)]


def text_features(text: str | None) -> set[str]:
    """Words and word beginnings that a text holds."""
    return {f for w in set(WORD.findall((text or "").lower())) for f in word_features(w)}


@dataclass
class Linear:
    weights: dict[str, float]
    bias: float

    def scorer(self):
        """A function from text to score; words without a weight cost one lookup."""
        known: dict[str, tuple[str, ...]] = {}
        weights, bias = self.weights, self.bias

        def score(text: str | None) -> float:
            hits = set()
            for w in set(WORD.findall((text or "").lower())):
                found = known.get(w)
                if found is None:
                    found = tuple(f for f in word_features(w) if f in weights)
                    if len(known) < CACHE:
                        known[w] = found
                hits.update(found)
            return float(1 / (1 + np.exp(-np.clip(bias + sum(weights[f] for f in sorted(hits)), -30, 30))))

        return score


def fit(rows: list[list[int]], positive: np.ndarray, features: int, prior: float, steps: int = 400, rate: float = 0.05, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of the non-negative risk; ``rows`` lists each row's features, all rows are unlabelled."""
    lengths = np.array([len(r) for r in rows])
    flat = np.fromiter((f for r in rows for f in r), np.int64, int(lengths.sum()))
    owner = np.repeat(np.arange(len(rows)), lengths)
    n_p, n_u = max(int(positive.sum()), 1), len(rows)
    w, b = np.zeros(features), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(features + 1), np.zeros(features + 1)
    for step in range(1, steps + 1):
        z = b + np.bincount(owner, w[flat], len(rows))
        s = 1 / (1 + np.exp(-z))
        as_negative = np.logaddexp(0, z)
        rest = as_negative.mean() - prior * as_negative[positive].sum() / n_p
        # Derivatives of the two risks by each row's z.
        plus = np.where(positive, prior * (s - 1) / n_p, 0.0)
        minus = s / n_u - np.where(positive, prior * s / n_p, 0.0)
        by_z = plus + minus if rest >= 0 else -minus
        g = np.append(np.bincount(flat, by_z[owner], features) + (2 * ridge * w if rest >= 0 else 0), by_z.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-10)
        w, b = w - move[:-1], b - move[-1]
    return w, b


def fit_linear(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, features: int = FEATURES, significant: float = SIGNIFICANT) -> Linear:
    """Choose features on the sample with Spark, then fit in numpy on their indices alone."""
    def held(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda t: sorted(text_features(t)), na_action=None)

    chosen = labelled(labels, "toxic", FOLDS, HELD_OUT, rows)
    sample = docs.join(F.broadcast(chosen), F.col("doc_id") == F.col("id"))
    sample = stage(sample.select("label", F.xxhash64("id", "text", "label").alias("place"), F.pandas_udf(held, "array<string>")("text").alias("features")))
    # Ids that stand more than once can give more rows than the bound; an even share of their hashes stays.
    sample = sample.where(F.pmod("place", F.lit(1 + (sample.count() - 1) // rows)) == 0)
    n_u, n_p = sample.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    if not n_p or n_p == n_u:
        share = (n_p + 0.5) / (n_u + 1)
        return Linear({}, float(np.log(share / (1 - share))))
    expected = F.col("u") * F.lit(n_p / n_u)
    distance = F.abs(F.col("p") - expected) / F.sqrt(expected + 1)
    counts = sample.select("label", F.explode("features").alias("feature")).groupBy("feature").agg(F.count("*").alias("u"), F.sum("label").alias("p"))
    top = counts.where(distance >= significant).orderBy(F.desc(distance), "feature").limit(features)
    names = [r[0] for r in top.select("feature").collect()]  # at most ``features`` strings
    index = {f: i for i, f in enumerate(names)}

    def indices(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda fs: [index[f] for f in fs if f in index])

    data = sample.select("place", "label", F.pandas_udf(indices, "array<int>")("features").alias("f")).toPandas()
    data = data.sort_values("place", kind="stable")  # the same sums whatever order the tasks end in
    w, b = fit([list(f) for f in data["f"]], data["label"].to_numpy() == 1, len(names), n_p / n_u)
    return Linear({f: float(x) for f, x in zip(names, w)}, float(b))


def with_scores(docs: DataFrame, model: Linear) -> DataFrame:
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        score = model.scorer()
        for batch in batches:
            yield pd.Series(np.fromiter((score(t) for t in batch), np.float64, len(batch)))

    return docs.withColumn("score", F.pandas_udf(scored, "double")("text"))


def op7_positive_unlabelled(spark: SparkSession, folder: str) -> DataFrame:
    """Score of every document, 0 to 1, higher for toxic.

    Empty and null texts get the bias alone.  Repeated rows are scored one by one.
    """
    docs = table(spark, folder, "documents").select("doc_id", "text")
    out = with_scores(docs, fit_linear(docs, table(spark, folder, "labels")))
    return out.select("doc_id", (remainder(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

"""Quality trees and toxicity: model code against plain versions, held-out accuracy, awkward tables."""

import random
import zlib

import duckdb
import numpy as np
import pytest
import tables

from tickloom.llm import quality_model, toxicity

SF = "/root/testdata/sf0.1"
LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def labels():
    return {r[0]: r[1:] for r in duckdb.connect().execute(f"SELECT doc_id, quality, toxic FROM '{SF}/labels.parquet'").fetchall()}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows = [(d[0], i % 2, int(i % 7 == 0)) for i, d in enumerate(tables.documents())]
    rows += [(None, 1, 1), (0, None, None), (0, 1, 0), (0, 0, 1), (99999, 1, 1)]
    return tables.write(spark, tmp_path_factory.mktemp("rows"), labels=(LABELS, rows))


def held_out(doc_id, folds, fold):
    return zlib.crc32(str(doc_id).encode()) % folds == fold


def check(rows, labels, column, folds, fold):
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) and r.held_out == held_out(r.doc_id, folds, fold) for r in rows)
    return [(labels[r.doc_id][column], r.predicted) for r in rows if r.held_out and r.doc_id in labels]


def test_quality_held_out(spark, labels):
    pairs = check(quality_model.op3_histogram_trees(spark, SF).collect(), labels, 0, 5, 0)
    assert len(pairs) > 500 and np.mean([a == b for a, b in pairs]) > 0.98
    assert np.mean([b == 0 for a, b in pairs if a == 0]) > 0.9


def test_toxicity_held_out(spark, labels):
    pairs = check(toxicity.op7_positive_unlabelled(spark, SF).collect(), labels, 1, 4, 2)
    assert np.mean([b for a, b in pairs if a == 1]) > 0.85
    assert np.mean([b for a, b in pairs if a == 0]) < 0.01


def test_forest_walks_like_a_loop():
    r = np.random.default_rng(1)
    x = r.normal(size=(500, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] * x[:, 2] > 0)).astype(float)
    forest = quality_model.fit(x, y, trees=80)
    scores = forest.scores(x)
    assert ((scores > 0.5) == (y > 0.5)).mean() > 0.95
    for i in range(20):
        total = forest.base
        for feature, limit, leaf in zip(forest.feature, forest.limit, forest.leaf):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if x[i, feature[node]] > limit[node] else 1)
            total += leaf[node - len(feature)]
        assert abs(1 / (1 + np.exp(-total)) - scores[i]) < 1e-12


def test_forest_of_one_class_is_constant():
    x = np.ones((5, 3))
    assert np.allclose(quality_model.fit(x, np.ones(5)).scores(x), 5.5 / 6)
    assert len(quality_model.fit(x, np.array([0, 1, 0, 1, 1.0])).scores(x)) == 5


def test_non_negative_risk_learns_from_positives_and_unlabelled():
    r = random.Random(2)
    rows, positive = [], []
    for i in range(2000):
        toxic = i % 5 == 0
        rows.append(([0] if toxic else []) + [r.randrange(1, 50) for _ in range(5)])
        positive.append(toxic and i % 10 == 0)  # half of the toxic rows are not confirmed
    w, b = toxicity.fit(rows, np.array(positive), 50, prior=0.2)
    score = np.array([b + sum(w[f] for f in set(x)) for x in rows])
    assert score[::5].min() > np.delete(score, np.arange(0, 2000, 5)).max()


@pytest.mark.parametrize("query", [quality_model.op3_histogram_trees, toxicity.op7_positive_unlabelled])
def test_awkward_rows(spark, folder, query):
    rows = query(spark, folder).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(d[0]) for d in tables.documents())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) and r.held_out is not None for r in rows)


@pytest.mark.parametrize("query", [quality_model.op3_histogram_trees, toxicity.op7_positive_unlabelled])
def test_empty(spark, tmp_path, query):
    none = tables.write(spark, tmp_path / "a", docs=[], labels=(LABELS, []))
    assert query(spark, none).count() == 0
    unlabelled = tables.write(spark, tmp_path / "b", docs=tables.documents()[:5], labels=(LABELS, []))
    assert {r.score for r in query(spark, unlabelled).collect()} == {0.5}


def test_scores_do_not_use_held_out_labels(spark, tmp_path):
    docs = tables.documents()[:40]
    rows = [(d[0], i % 2, i % 2) for i, d in enumerate(docs) if d[0] is not None]
    for query, folds, fold in ((quality_model.op3_histogram_trees, 5, 0), (toxicity.op7_positive_unlabelled, 4, 2)):
        flipped = [(d, 1 - q, 1 - t) if held_out(d, folds, fold) else (d, q, t) for d, q, t in rows]
        a = tables.write(spark, tmp_path / f"{folds}a", docs=docs, labels=(LABELS, rows))
        b = tables.write(spark, tmp_path / f"{folds}b", docs=docs, labels=(LABELS, flipped))
        assert sorted(r.score for r in query(spark, a).collect()) == sorted(r.score for r in query(spark, b).collect())

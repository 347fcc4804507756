"""Node tables, importance kinds, test predictions and the search."""

import time

import pytest
from pyspark.sql import functions as F

from tickloom.operators import ensemble as E

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.range(600).select("id", (F.col("id") * 7919 % 101 / 101).alias("a"), (F.col("id") * 104729 % 97 / 97).alias("b"), (F.col("id") * 31 % 89 / 89).alias("c"))
    return df.withColumn("y", 10 * F.floor(F.col("b") * 4) + F.col("a"))


def hand(nodes, x):
    """Prediction of one tree, node by node."""
    at = 0
    while nodes[at].feature is not None:
        at = nodes[at].left if x[nodes[at].feature] <= nodes[at].threshold else nodes[at].right
    return nodes[at].prediction


def test_nodes_walk_like_the_model(spark, rows):
    nodes, found, scored = E.importance_run(rows.where("id < 400"), rows.where("id >= 400"), FEATURES, "y", "reg", (1, 2), "id", maxIter=3, maxDepth=3)
    one = nodes.where("seed = 1").collect()
    trees = {t: {n.node: n for n in one if n.tree == t} for t in {n.tree for n in one}}
    assert all(t[0].cover == 400 and sum(n.cover for n in t.values() if n.feature is None) == 400 for t in trees.values())
    walked = {}
    for r in E.leaves_of(nodes.where("seed = 1"), rows.where("id >= 400"), "id", FEATURES, 3).collect():
        walked.setdefault(r.id, {})[r.tree] = r.prediction
    truth = {r.id: (r.a, r.b, r.c) for r in rows.collect()}
    pred = {r.id: r.y_pred for r in scored.where("seed = 1").collect()}
    assert len(pred) == 200
    for i, p in pred.items():
        by_hand = {t: hand(n, truth[i]) for t, n in trees.items()}
        assert by_hand == walked[i]
        assert abs(by_hand[0] + 0.1 * sum(v for t, v in by_hand.items() if t) - p) < 1e-9
    kinds = {r.feature: r for r in found.where("seed = 1").collect()}
    splits = [n for n in one if n.feature is not None]
    for i, f in enumerate(FEATURES):
        mine = [n for n in splits if n.feature == i]
        assert kinds[f].weight == len(mine) and abs(kinds[f].total_gain - sum(n.gain * n.cover for n in mine)) < 1e-6 and kinds[f].total_cover == sum(n.cover for n in mine)
        assert (kinds[f].gain is None) == (not mine) and (not mine or abs(kinds[f].cover - kinds[f].total_cover / len(mine)) < 1e-9)
    assert max(kinds.values(), key=lambda r: r.total_gain).feature == "b"
    metrics = E.metrics_by_seed(scored, "reg").collect()
    assert len(metrics) == 2 and all(m.rmse < 8 for m in metrics)


def test_classes(spark, rows):
    cls = rows.withColumn("k", F.floor(F.col("b") * 3))
    nodes, found, scored = E.importance_run(cls.where("id < 400"), cls.where("id >= 400"), FEATURES, "k", "cls", (5,), "id", classes=3, maxIter=8, maxDepth=4)
    assert found.orderBy(F.desc("total_gain")).first().feature == "b" and nodes.select("tree").distinct().count() == 8
    row = E.metrics_by_seed(scored, "cls", 3).first()
    assert row.accuracy > 0.8 and row.logloss < 0.8 and row.auc > 0.9
    assert scored.where("abs(p0 + p1 + p2 - 1) > 1e-9").count() == 0


def test_draws():
    many = [E.draw(t, 1, 50) for t in range(400)]
    assert many[7] == E.draw(7, 1, 50) != E.draw(7, 2, 50)
    rates = [p["stepSize"] for p in many]
    assert all(1e-3 <= x <= 2e-1 for x in rates) and 0.4 < sum(x < (1e-3 * 2e-1) ** 0.5 for x in rates) / 400 < 0.6
    assert {p["maxDepth"] for p in many} == set(E.DEPTHS) and all(1 <= p["minInstancesPerNode"] <= 100 for p in many)


def test_search(spark, rows):
    """Reproducible, means over folds and seeds, early stopping below the limit of trees."""
    folded = rows.withColumn("fold", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("part", F.when(F.col("id") % 3 == F.col("fold"), "val").otherwise("train"))
    args = dict(trials=2, seeds=(1, 2), trees=4, max_depth=3)
    got = E.tune(folded, FEATURES, "y", **args)
    results = got.collect()
    assert len(results) == 8 and {(r.trial, r.fold, r.seed) for r in results} == {(t, f, s) for t in range(2) for f in (1, 2) for s in (1, 2)} and all(1 <= r.trees <= 4 for r in results)
    again = E.tune(folded, FEATURES, "y", threads=1, **args).collect()
    assert sorted(results) == sorted(again)
    best = E.trial_scores(got).collect()
    for b in best:
        mine = [r.score for r in results if r.trial == b.trial]
        assert b.fits == 4 and abs(b.score - sum(mine) / 4) < 1e-12
    assert best[0].score <= best[1].score
    classes = folded.withColumn("k", F.floor(F.col("b") * 3))
    one = E.tune(classes, FEATURES, "k", "cls", trials=1, seeds=(1,), trees=3, classes=3, max_depth=3).collect()
    assert len(one) == 2 and all(0 < r.score < 3 for r in one)


def test_jobs_run_side_by_side(spark):
    started = time.perf_counter()
    assert E.parallel(spark, [lambda i=i: (time.sleep(0.5), i)[1] for i in range(4)]) == [0, 1, 2, 3]
    assert time.perf_counter() - started < 1.6
    with pytest.raises(ZeroDivisionError):
        E.parallel(spark, [lambda: 1 / 0])

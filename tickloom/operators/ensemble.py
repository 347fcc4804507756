"""Tree ensembles as node tables, importance runs and parameter search.

A fitted ensemble is a table with a row per node; importances of every kind, predictions and
checks are queries over it.  Independent fits run side by side in threads, each in a pool of
its own, so a cluster in FAIR mode shares its cores among them.
"""

from __future__ import annotations

import hashlib
import math
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel  # noqa: F401  registers the model readers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators.model import assemble, metrics_cls, metrics_reg
from tickloom.sources.sinks import stage, work_folder

KINDS = ["weight", "gain", "cover", "total_gain", "total_cover"]

# The ranges of the search.
LEARNING_RATE, DEPTHS, CHILD_ROWS, MIN_GAIN = (1e-3, 2e-1), (3, 5, 7, 9, 11, 13), (1.0, 1e2), (1e-8, 1.0)


def parallel(spark: SparkSession, jobs: list, threads: int = 4) -> list:
    """Results of functions without arguments, run side by side; job i runs in pool ``fit<i>``."""
    def run(i, job):
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"fit{i}")
        try:
            return job()
        finally:
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", None)

    with ThreadPoolExecutor(max(1, min(threads, len(jobs)))) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(run), i, job) for i, job in enumerate(jobs)]]


def node_table(model, spark: SparkSession) -> DataFrame:
    """(tree, node, left, right, feature, threshold, gain, cover, prediction) of a fitted ensemble, a leaf without children.

    ``gain`` is the split's decrease of impurity per row, ``cover`` the training rows that reach the node.
    """
    path = work_folder(spark)
    model.write().overwrite().save(path)
    rows = spark.read.parquet(f"{path}/data").select(F.col("treeID").alias("tree"), "nodeData.*")
    inner = F.col("leftChild") >= 0
    return stage(rows.select(
        "tree", F.col("id").alias("node"), F.when(inner, F.col("leftChild")).alias("left"), F.when(inner, F.col("rightChild")).alias("right"), F.when(inner, F.col("split.featureIndex")).alias("feature"),
        F.when(inner, F.element_at("split.leftCategoriesOrThreshold", 1)).alias("threshold"), F.when(inner, F.col("gain")).alias("gain"), F.col("rawCount").alias("cover"), "prediction"))


def importances(nodes: DataFrame, features: list[str], keys: list[str]) -> DataFrame:
    """Per key and feature: weight (splits), total gain and cover over them, and their means gain and cover; 0 splits give NULL means.

    A split's gain counts for every row that it covers.
    """
    g = nodes.where("feature IS NOT NULL").groupBy(*keys, "feature").agg(F.count("*").alias("weight"), F.sum(F.col("gain") * F.col("cover")).alias("total_gain"), F.sum(F.col("cover")).cast("double").alias("total_cover"))
    names = nodes.sparkSession.createDataFrame(list(enumerate(features)), "feature int, name string")
    every = nodes.select(*keys).distinct().join(F.broadcast(names))
    out = every.join(g, [*keys, "feature"], "left").fillna(0, ["weight", "total_gain", "total_cover"])
    mean = {k: F.when(F.col("weight") > 0, F.col(f"total_{k}") / F.col("weight")) for k in ("gain", "cover")}
    return out.select(*keys, F.col("name").alias("feature"), "weight", *[c.alias(k) for k, c in mean.items()], "total_gain", "total_cover")


def leaves_of(nodes: DataFrame, rows: DataFrame, key: str, features: list[str], depth: int) -> DataFrame:
    """(key, tree, prediction) of every row by walking each tree: one join per level on the node; nodes are bounded by the trees and their depth."""
    at = rows.select(key, F.array(*[F.col(f).cast("double") for f in features]).alias("x")).join(F.broadcast(nodes.select("tree").distinct())).withColumn("node", F.lit(0))
    for _ in range(depth):
        here = nodes.select("tree", "node", "left", "right", "feature", "threshold")
        step = at.join(F.broadcast(here), ["tree", "node"])
        goes_left = F.element_at("x", F.col("feature") + 1) <= F.col("threshold")
        at = step.select(key, "x", "tree", F.when(F.col("feature").isNull(), F.col("node")).when(goes_left, F.col("left")).otherwise(F.col("right")).alias("node"))
    return at.join(F.broadcast(nodes.select("tree", "node", "prediction")), ["tree", "node"]).select(key, "tree", "prediction")


def _learner(kind: str, seed: int, params: dict):
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.regression import GBTRegressor

    if kind == "reg":
        return GBTRegressor(seed=seed, **params)
    trees = params.get("maxIter", 20)
    return RandomForestClassifier(seed=seed, numTrees=trees, **{k: v for k, v in params.items() if k not in ("maxIter", "stepSize", "validationIndicatorCol", "validationTol")})


def predictions(model, data: DataFrame, kind: str, classes: int, keep: list[str]) -> DataFrame:
    """y_true and y_pred, for classes c_true, c_pred and their probabilities p0 .. too."""
    out = model.transform(data)
    if kind == "reg":
        return out.select(*keep, F.col("label").alias("y_true"), F.col("prediction").alias("y_pred"))
    from pyspark.ml.functions import vector_to_array

    p = vector_to_array("probability")
    return out.select(*keep, F.col("label").cast("int").alias("c_true"), F.col("prediction").cast("int").alias("c_pred"), *[p[k].alias(f"p{k}") for k in range(classes)])


def importance_run(train: DataFrame, test: DataFrame, features: list[str], label: str, kind: str, seeds, key: str, classes: int = 0, **params) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Fit once per seed: node tables, importances of every kind, and test predictions (seed, key, ...), the fits side by side."""
    spark = train.sparkSession
    fit, held = stage(assemble(train, features, label)), stage(assemble(test, features, label, keep=[key]))

    def one(seed):
        model = _learner(kind, seed, params).fit(fit)
        return node_table(model, spark).withColumn("seed", F.lit(seed)), stage(predictions(model, held, kind, classes, [key]).withColumn("seed", F.lit(seed)))

    done = parallel(spark, [lambda s=s: one(s) for s in seeds])
    nodes, scored = done[0]
    for n, p in done[1:]:
        nodes, scored = nodes.unionByName(n), scored.unionByName(p)
    return nodes, importances(nodes, features, ["seed"]), scored


def metrics_by_seed(scored: DataFrame, kind: str, classes: int = 0) -> DataFrame:
    return metrics_reg(scored, ["seed"]) if kind == "reg" else metrics_cls(scored, ["seed"], classes)


# ---- search


def _share(*parts) -> float:
    """A number in [0, 1) from a seeded hash."""
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:13], 16) / 16 ** 13


def draw(trial: int, seed: int, trees: int) -> dict:
    """Parameters of a trial: learning rate, rows per child and least gain log-uniform, depth uniform."""
    def log_uniform(name, low, high):
        return math.exp(math.log(low) + _share(seed, trial, name) * (math.log(high) - math.log(low)))

    return {"maxIter": trees, "stepSize": log_uniform("rate", *LEARNING_RATE), "maxDepth": DEPTHS[int(_share(seed, trial, "depth") * len(DEPTHS))],
            "minInstancesPerNode": round(log_uniform("rows", *CHILD_ROWS)), "minInfoGain": log_uniform("gain", *MIN_GAIN)}


def log_loss(classes: int) -> Column:
    p = F.lit(None).cast("double")
    for k in range(classes):
        p = F.when(F.col("c_true") == k, F.col(f"p{k}")).otherwise(p)
    return F.avg(-F.log(F.greatest(F.least(p, F.lit(1 - 2.220446049250313e-16)), F.lit(2.220446049250313e-16))))


def tune(folded: DataFrame, features: list[str], label: str, kind: str = "reg", trials: int = 3, seeds=(1, 2), seed: int = 42, trees: int = 20, classes: int = 0, max_depth: int | None = None, threads: int = 4) -> DataFrame:
    """(trial, params, fold, seed, score, trees) of a random search over rows with fold and part.

    Boosting stops early on the fold's validation rows; the score is the root mean squared
    error, for classes the log-loss.  Every fit is a job of its own; all of them share one
    written table.
    """
    folds = [r["fold"] for r in folded.select("fold").distinct().orderBy("fold").collect()]
    data = stage(assemble(folded, features, label, keep=["fold", "part"]).withColumn("is_val", F.col("part") == "val"))

    def fit(trial, fold, s):
        params = draw(trial, seed, trees)
        if max_depth is not None:
            params["maxDepth"] = min(params["maxDepth"], max_depth)
        rows = data.where(F.col("fold") == fold)
        early = {"validationIndicatorCol": "is_val"} if kind == "reg" else {}
        model = _learner(kind, s, params | early).fit(rows if early else rows.where("NOT is_val"))
        scored = predictions(model, rows.where("is_val"), kind, classes, [])
        score = F.sqrt(F.avg((F.col("y_true") - F.col("y_pred")) ** 2)) if kind == "reg" else log_loss(classes)
        return trial, str(sorted(params.items())), int(fold), int(s), float(scored.agg(score).first()[0]), int(model.getNumTrees)

    jobs = [lambda a=(t, f, s): fit(*a) for t in range(trials) for f in folds for s in seeds]
    return folded.sparkSession.createDataFrame(parallel(folded.sparkSession, jobs, threads), "trial int, params string, fold int, seed int, score double, trees int")


def trial_scores(results: DataFrame) -> DataFrame:
    """Mean score per trial over folds and seeds, best first."""
    g = results.groupBy("trial", "params").agg(F.avg("score").alias("score"), F.count("*").alias("fits"), F.avg("trees").alias("mean_trees"))
    return g.orderBy("score", "trial")

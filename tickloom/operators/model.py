"""Feature importance, model metrics, selection and tuning."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.expr import div
from tickloom.operators.ordered import exact_quantiles, hash_text, running
from tickloom.sources.sinks import stage


def match_xy(x: DataFrame, y: DataFrame, on, target: str, drop_null_features: bool = False) -> DataFrame:
    """Inner join of features and target, without null targets and optionally without null features."""
    out = x.join(y, on)
    return out.dropna() if drop_null_features else out.dropna(subset=[target])


def bin_edges(train: DataFrame, target: str, classes: int) -> DataFrame:
    """Inner bin edges of the target as rows (edge, value)."""
    row = exact_quantiles(train, [], target, {f"e{i}": i / classes for i in range(1, classes)})
    return row.select(F.inline(F.array(*[F.struct(F.lit(i).alias("edge"), F.col(f"e{i}").alias("value")) for i in range(1, classes)])))


def class_edges(train: DataFrame, target: str, classes: int) -> list[float]:
    """Inner bin edges of the target by exact quantiles; a handful of numbers."""
    edges = [r["value"] for r in bin_edges(train, target, classes).orderBy("edge").collect()]
    if len(set(edges)) != len(edges):
        raise ValueError("duplicate bin edges")
    return edges


def classify(target: str, edges: list[float]) -> Column:
    """Class 0..n-1 by right-closed bins."""
    out = F.lit(0)
    for e in edges:
        out = out + (F.col(target) > F.lit(float(e))).cast("int")
    return F.when(F.col(target).isNotNull(), out)


# ---- information measures


def information_tasks(df: DataFrame, horizons, targets: list[str], features: list[str]) -> DataFrame:
    """One row per (horizon, target, feature, time): x the feature now, y the target ``horizon`` rows later, z the target now, p the target one row before.

    ``df`` has d, ep and the columns; earlier and later targets are those of the same day.
    """
    w = Window.partitionBy("d").orderBy("ep")
    wide = df.select("*", *[F.lead(c, h).over(w).alias(f"_y{h}_{c}") for h in horizons for c in targets], *[F.lag(c).over(w).alias(f"_p_{c}") for c in targets])
    cells = [F.struct(F.lit(h).alias("horizon"), F.lit(c).alias("target"), F.lit(f).alias("feature"), F.col(f).alias("x"), F.col(f"_y{h}_{c}").alias("y"), F.col(c).alias("z"), F.col(f"_p_{c}").alias("p"))
             for h in horizons for c in targets for f in features if f != c]
    return wide.select("d", "ep", F.explode(F.array(*cells)).alias("c")).select("d", "ep", "c.*")


def pearson(long: DataFrame, keys: list[str], x: str, y: str, least: int = 10) -> DataFrame:
    """Correlation per task over rows with x, y and, if there is one, z; tasks with fewer rows carry an error text."""
    ok = F.col(x).isNotNull() & F.col(y).isNotNull()
    if "z" in long.columns:
        ok = ok & F.col("z").isNotNull()
    g = long.groupBy(*keys).agg(F.count_if(ok).alias("n_samples"), F.corr(F.when(ok, F.col(x)), F.when(ok, F.col(y))).alias("_r"))
    few = F.col("n_samples") < least
    return g.withColumns({"pc": F.when(~few, F.col("_r")), "error": F.when(few, F.lit("too few samples"))}).drop("_r")


def _entropy_sum(counts: DataFrame, keys: list[str], variables: list[str]) -> DataFrame:
    """Per task: entropy in nats of the joint distribution of some binned variables."""
    cells = counts.groupBy(*keys, *variables).agg(F.sum("_n").alias("_m"))
    g = cells.groupBy(*keys).agg(F.sum("_m").alias("_t"), F.sum(F.col("_m") * F.log(F.col("_m").cast("double"))).alias("_s"))
    return g.select(*keys, (F.log(F.col("_t").cast("double")) - F.col("_s") / F.col("_t")).alias("h"))


def information(binned: DataFrame, keys: list[str], least: int = 10) -> DataFrame:
    """Plug-in information measures of binned x, future y, past target p and condition z.

    Rows with any of the four missing are left out.  Rows shrink at once to counts per cell
    (bins ** 4 per task at most); every entropy is an aggregate of those counts.
    MI(x;y), CMI(x;y|z), TE = I(x; y | p), CTE = I(x; y | p, z).
    """
    counts = binned.dropna(subset=["x", "y", "p", "z"]).groupBy(*keys, "x", "y", "p", "z").agg(F.count("*").alias("_n"))
    wanted = {"x": "x", "y": "y", "xy": "x y", "z": "z", "xz": "x z", "yz": "y z", "xyz": "x y z", "p": "p", "xp": "x p", "yp": "y p",
              "xyp": "x y p", "pz": "p z", "xpz": "x p z", "ypz": "y p z", "xypz": "x y p z"}
    cells = F.array(*[F.struct(F.lit(n).alias("w"), *[(F.col(v) if v in vs.split() else F.lit(None).cast("int")).alias(v) for v in ("x", "y", "p", "z")])
                      for n, vs in wanted.items()])
    long = counts.select(*keys, "_n", F.explode(cells).alias("c")).select(*keys, "_n", "c.*")
    h = _entropy_sum(long, [*keys, "w"], ["x", "y", "p", "z"])
    h = h.groupBy(*keys).agg(*[F.max(F.when(F.col("w") == n, F.col("h"))).alias(f"h_{n}") for n in wanted])
    n = counts.groupBy(*keys).agg(F.sum("_n").alias("n_samples")).where(F.col("n_samples") >= least)
    c = F.col
    return h.join(n, keys).select(
        *keys, "n_samples", (c("h_x") + c("h_y") - c("h_xy")).alias("mi"), (c("h_xz") + c("h_yz") - c("h_z") - c("h_xyz")).alias("cmi"),
        (c("h_xp") + c("h_yp") - c("h_p") - c("h_xyp")).alias("te"), (c("h_xpz") + c("h_ypz") - c("h_pz") - c("h_xypz")).alias("cte"))


def quantile_bin(df: DataFrame, columns: list[str], bins: int) -> DataFrame:
    """Replace each column by its equal-count bin; all columns share one quantile job."""
    cells = F.array(*[F.struct(F.lit(c).alias("what"), F.col(c).alias("v")) for c in columns])
    long = df.select(F.inline(cells))
    q = exact_quantiles(long, ["what"], "v", {f"e{i}": i / bins for i in range(1, bins)})
    row = q.agg(*[F.max(F.when(F.col("what") == c, F.array(*[f"e{i}" for i in range(1, bins)]))).alias(f"_q_{c}") for c in columns])
    out = df.join(F.broadcast(row))

    def bin_of(c):
        return F.when(F.col(c).isNotNull(), F.size(F.filter(f"_q_{c}", lambda e: e < F.col(c))))

    cut = {c: bin_of(c) for c in columns}
    return out.withColumns(cut).drop(*[f"_q_{c}" for c in columns])


# ---- model metrics


def metrics_reg(pred: DataFrame, keys: list[str]) -> DataFrame:
    """Root mean squared error and coefficient of determination."""
    e2 = (F.col("y_true") - F.col("y_pred")) ** 2
    g = pred.groupBy(*keys).agg(F.avg(e2).alias("_mse"), F.var_pop("y_true").alias("_var"))
    return g.select(*keys, F.sqrt("_mse").alias("rmse"), (1 - div("_mse", "_var")).alias("r2"))


def confusion_counts(pred: DataFrame, keys: list[str]) -> DataFrame:
    return pred.groupBy(*keys, "c_true", "c_pred").agg(F.count("*").alias("n"))


def confusion(pred: DataFrame, keys: list[str], classes: int) -> DataFrame:
    """Row-normalised confusion matrix, averaged over the keys (seeds); absent cells count as 0."""
    n = confusion_counts(pred, keys)
    whole = n.groupBy(*keys, "c_true").agg(F.sum("n").alias("_t"))
    grid = whole.select(*keys, "c_true", "_t", F.explode(F.sequence(F.lit(0), F.lit(classes - 1))).alias("c_pred"))
    full = grid.join(n, [*keys, "c_true", "c_pred"], "left")
    return full.groupBy("c_true", "c_pred").agg(F.avg(F.coalesce("n", F.lit(0)) / F.col("_t")).alias("share"))


def pairwise_auc(pred: DataFrame, keys: list[str], classes: int) -> DataFrame:
    """Macro one-versus-one area under the curve.

    Scores collapse to counts per distinct value before they are ordered, and running
    counts are carried over slots with about as many distinct scores each, however the
    scores are spread.
    """
    cells = []
    for a in range(classes):
        for b in range(classes):
            if a != b:
                here = F.col("c_true").isin(a, b)
                cells.append(F.when(here, F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"p{a}").alias("score"), (F.col("c_true") == a).cast("int").alias("pos"))))
    long = pred.select(*keys, F.inline(F.array_compact(F.array(*cells))))
    pair = [*keys, "a", "b"]
    per = long.groupBy(*pair, "score").agg(F.sum("pos").alias("_p"), F.sum(1 - F.col("pos")).alias("_q"))
    per = stage(per)
    edges = stage(per.groupBy(*pair).agg(F.percentile_approx("score", [i / 1024 for i in range(1, 1024)], 10_000).alias("_edges")))
    per = per.join(edges, pair).withColumn("_slot", F.size(F.filter("_edges", lambda e: e < F.col("score")))).drop("_edges")
    per = running(per, pair, "_slot", ["score"], {"_below": "_q"})
    wins = F.col("_p") * ((F.col("_below") - F.col("_q")) + F.col("_q") / 2)
    auc = per.groupBy(*pair).agg(div(F.sum(wins), F.sum("_p") * F.sum("_q")).alias("auc"))
    return auc.groupBy(*keys).agg(F.avg("auc").alias("auc"))


def metrics_cls(pred: DataFrame, keys: list[str], classes: int) -> DataFrame:
    """Log-loss, accuracy, balanced accuracy, macro precision / recall / F1, one-versus-one AUC, correlation coefficient."""
    c = F.col
    p_true = F.lit(None).cast("double")
    for k in range(classes):
        p_true = F.when(c("c_true") == k, c(f"p{k}")).otherwise(p_true)
    eps = 2.220446049250313e-16
    tp = {k: F.count_if((c("c_true") == k) & (c("c_pred") == k)).cast("double").alias(f"_tp{k}") for k in range(classes)}
    tr = {k: F.count_if(c("c_true") == k).cast("double").alias(f"_t{k}") for k in range(classes)}
    pr = {k: F.count_if(c("c_pred") == k).cast("double").alias(f"_p{k}") for k in range(classes)}
    g = pred.groupBy(*keys).agg(F.avg(-F.log(F.greatest(F.least(p_true, F.lit(1 - eps)), F.lit(eps)))).alias("logloss"),
                                F.count("*").cast("double").alias("_n"), *tp.values(), *tr.values(), *pr.values())

    def total(f):
        out = f(0)
        for k in range(1, classes):
            out = out + f(k)
        return out

    recall = lambda k: F.coalesce(div(f"_tp{k}", f"_t{k}"), F.lit(0.0))
    precision = lambda k: F.coalesce(div(f"_tp{k}", f"_p{k}"), F.lit(0.0))
    f1 = lambda k: F.coalesce(div(2 * c(f"_tp{k}"), c(f"_t{k}") + c(f"_p{k}")), F.lit(0.0))
    present = total(lambda k: (c(f"_t{k}") > 0).cast("double"))
    seen = total(lambda k: ((c(f"_t{k}") > 0) | (c(f"_p{k}") > 0)).cast("double"))
    hits, n = total(lambda k: c(f"_tp{k}")), c("_n")
    cov = hits * n - total(lambda k: c(f"_t{k}") * c(f"_p{k}"))
    side = lambda s: n * n - total(lambda k: c(f"_{s}{k}") * c(f"_{s}{k}"))
    out = g.select(*keys, "logloss", (hits / n).alias("accuracy"), div(total(recall), present).alias("balanced_accuracy"),
                   div(total(precision), seen).alias("precision"), div(total(recall), seen).alias("recall"), div(total(f1), seen).alias("f1"),
                   F.coalesce(div(cov, F.sqrt(side("t") * side("p"))), F.lit(0.0)).alias("mcc"))
    return out.join(pairwise_auc(pred, keys, classes), keys)


# ---- rankings


def importance_ranking(scores: DataFrame, feature: str, metric: str, top: int) -> DataFrame:
    """Mean and deviation over seeds per feature, best first."""
    g = scores.groupBy(feature).agg(F.avg(metric).alias("mean"), F.coalesce(F.stddev_samp(metric), F.lit(0.0)).alias("std"))
    return g.orderBy(F.desc("mean"), feature).limit(top)


def rank_matrix(scores: DataFrame, feature: str, metric: str) -> DataFrame:
    """Rank of each feature per seed with mean and deviation; one row per feature and seed is all that is ranked."""
    w = Window.partitionBy("seed").orderBy(F.desc(metric), feature)
    ranked = scores.withColumn("rank", F.row_number().over(w))
    return ranked.groupBy(feature).agg(F.avg("rank").alias("mean_rank"), F.stddev_samp("rank").alias("std_rank"), F.min("rank").alias("best_rank"))


def selection_curve(history: DataFrame, metrics: list[str]) -> DataFrame:
    """Mean and population deviation over seeds per iteration, cut at the shortest seed."""
    seeds = history.agg(F.countDistinct("seed").alias("_s"))
    g = history.groupBy("iteration").agg(F.countDistinct("seed").alias("_k"), *[f(m).alias(f"{n}_{m}") for m in metrics for n, f in (("mean", F.avg), ("std", F.stddev_pop))])
    return g.join(F.broadcast(seeds)).where("_k = _s").drop("_k", "_s")


def top_features(results: DataFrame, by: list[str], metric: str, top: int) -> DataFrame:
    """Best features per (horizon, target); one row per feature is all that is ranked."""
    w = Window.partitionBy(*by).orderBy(F.desc(metric), "feature")
    return results.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def importance_groups(scores: DataFrame, families: list[str], feature: str, metric: str) -> DataFrame:
    """Importance summed by transform family; the first family named in a feature wins."""
    family = F.lit("other")
    for f in reversed(families):
        family = F.when(F.col(feature).contains(f), f).otherwise(family)
    return scores.groupBy(family.alias("family")).agg(F.sum(metric).alias("total"), F.count("*").alias("features"))


def normalize(train: DataFrame, df: DataFrame, columns: list[str]) -> DataFrame:
    """Standardise columns with the mean and deviation of the training rows."""
    stats = train.agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("v", F.var_pop))])
    out = df.join(F.broadcast(stats))
    out = out.withColumns({c: (F.col(c) - F.col(f"_m_{c}")) / F.sqrt(F.col(f"_v_{c}") + 1e-8) for c in columns})
    return out.drop(*[f"_{n}_{c}" for c in columns for n in ("m", "v")])


# ---- models


def assemble(df: DataFrame, features: list[str], label: str, keep=()) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    clean = df.dropna(subset=[*features, label]).select(*keep, *features, F.col(label).cast("double").alias("label"))
    return VectorAssembler(inputCols=features, outputCol="features").transform(clean).select(*keep, "features", "label")


def _rmse(model, data: DataFrame) -> tuple[float, float]:
    scored = model.transform(data).select(F.col("label").alias("y_true"), F.col("prediction").alias("y_pred"))
    row = metrics_reg(scored, []).first()
    return row["rmse"], row["r2"]


def greedy_selection(train: DataFrame, val: DataFrame, features: list[str], label: str, trees: int = 3, depth: int = 3) -> DataFrame:
    """Rank features on the residual, add the best, refit and score, until no feature is left."""
    from pyspark.ml.regression import GBTRegressor

    left, chosen, rows = list(features), [], []
    residual = train.withColumn("_res", F.col(label).cast("double"))
    while left:
        ranker = GBTRegressor(maxIter=trees, maxDepth=depth, seed=1).fit(assemble(residual, left, "_res"))
        best, gain = max(zip(left, ranker.featureImportances.toArray()), key=lambda p: p[1])
        chosen.append(best)
        left.remove(best)
        model = GBTRegressor(maxIter=trees, maxDepth=depth, seed=1).fit(assemble(train, chosen, label))
        (tr, tr2), (va, va2) = (_rmse(model, assemble(d, chosen, label)) for d in (train, val))
        rows.append((len(chosen), best, float(gain), tr, va, tr2, va2))
        from pyspark.ml.feature import VectorAssembler

        vec = VectorAssembler(inputCols=chosen, outputCol="features").transform(train.dropna(subset=[*features, label]))
        residual = model.transform(vec).withColumn("_res", F.col(label) - F.col("prediction")).drop("features", "prediction")
    schema = "iteration long, selected_feature string, gain double, train_rmse double, val_rmse double, train_r2 double, val_r2 double"
    return train.sparkSession.createDataFrame(rows, schema)


def shuffled(df: DataFrame, key: str, seed: int) -> DataFrame:
    """``df`` with ``_i``, the row's place in the order of a seeded hash of its key, counted by hash prefix."""
    rows = df.withColumn("_h", hash_text(key, seed)).withColumn("_p", F.substring("_h", 1, 3)).withColumn("_one", F.lit(1))
    return running(rows, [], "_p", ["_h", key], {"_i": "_one"}).drop("_h", "_p", "_one")


def permutation_importance(df: DataFrame, features: list[str], label: str, key: str, seed: int = 42) -> DataFrame:
    """Loss increase when one column is permuted over all rows, for a boosted-tree model.

    The permutation pairs two seeded hash orders of the whole table; 4,096 hash prefixes are
    ordered in parallel.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    model = GBTRegressor(maxIter=3, maxDepth=3, seed=1).fit(assemble(df, features, label))
    rows = df.dropna(subset=[*features, label]).select(key, *features, label)
    base, mixed = stage(shuffled(rows, key, seed)), stage(shuffled(rows, key, seed + 1))
    vec = VectorAssembler(inputCols=features, outputCol="features")
    out = None
    for f in [None, *features]:
        data = base if f is None else base.drop(f).join(mixed.select("_i", f), "_i")
        mse = model.transform(vec.transform(data)).agg(F.avg((F.col("prediction") - F.col(label)) ** 2).alias("mse"))
        one = mse.withColumn("feature", F.lit(f or ""))
        out = one if out is None else out.unionByName(one)
    plain = out.where("feature = ''").select(F.col("mse").alias("_base"))
    return out.where("feature <> ''").join(F.broadcast(plain)).select("feature", (F.sqrt("mse") - F.sqrt("_base")).alias("loss_increase"))

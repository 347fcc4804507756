"""Feature importance, information measures, model metrics and selection."""

import math

from pyspark.sql import functions as F

from registry.base import query
from tickloom import schema as S
from tickloom.operators import dates as D
from tickloom.operators import ensemble as E
from tickloom.operators import model as M
from tickloom.operators import neighbours as N
from tickloom.operators.ordered import sample_exact
from tickloom.plans import catalog as K
from tickloom.plans import dataset as DS
from tickloom.plans import features as X
from tickloom.sources.sinks import stage

FEATS = ["basis", "basis_lag_2s", "basis_delta_2s", "irr", "ctd_obi_1", "fut_obi_1", "ctd_spread"]
TASKS = FEATS[1:]
TARGETS = ["basis", "irr"]
HORIZONS = (2, 6)
TASK = ["horizon", "target", "feature"]


def features(t, names=FEATS):
    return X.compile_features(K.market_features(t.book5, t.terms, DS.bases_of(names)), names)


FEAT_SQL = """ft AS (SELECT d, ep, basis, LAG(basis, 2) OVER w AS basis_lag_2s, basis - LAG(basis, 2) OVER w AS basis_delta_2s, irr, ctd_obi_1, fut_obi_1, ctd_spread FROM wide5
     WINDOW w AS (PARTITION BY d ORDER BY ep))"""


def task_sql(source):
    """x the feature, y the later target, z the target, p the target before."""
    return " UNION ALL ".join(
        f"SELECT {h} AS horizon, '{c}' AS target, '{f}' AS feature, d, ep, {f} AS x, LEAD({c}, {h}) OVER w AS y, LAG({c}) OVER w AS p, {c} AS z FROM {source} WINDOW w AS (PARTITION BY d ORDER BY ep)"
        for h in HORIZONS for c in TARGETS for f in TASKS if f != c)


TASK_SQL = f"{FEAT_SQL}, tk AS ({task_sql('ft')})"


def tasks(df):
    """The condition is the target now; the past target of the transfer measures is the target one step before."""
    return M.information_tasks(df, HORIZONS, TARGETS, TASKS)


PEARSON = "COUNT(*) FILTER (x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL) AS n_samples, CORR(x, y) FILTER (z IS NOT NULL) AS pc, NULL AS error"


@query("pearson", "horizon:i target:s feature:s n_samples:i pc:f error:s", f"WITH {TASK_SQL} SELECT horizon, target, feature, {PEARSON} FROM tk GROUP BY ALL")
def _(t):
    return M.pearson(tasks(features(t)), TASK, "x", "y")


# Nearest neighbours: the SQL compares all pairs of a task.

PSI = "[" + ", ".join(f"{math.fsum(1.0 / i for i in range(1, m)) - N.EULER!r}e0" for m in range(1, 17)) + "]"


def psi_sql(n):
    return f"(CASE WHEN {n} <= 16 THEN list_extract({PSI}, ({n})::INT) ELSE LN({n}) - 1 / (2e0 * {n}) - 1 / (12 * POW({n}, 2)) + 1 / (120 * POW({n}, 4)) - 1 / (252 * POW({n}, 6)) END)"


def jitter_sql(v):
    return f"{v} + (('0x' || substr(md5('42:{v}:' || ep), 1, 12))::BIGINT::DOUBLE / 281474976710656e0 - 0.5e0) * {N.NOISE!r}::DOUBLE AS {v}"


def near_sql(measure, rows):
    """CTE v_<measure>: the estimate per task from all pairs of ``rows``."""
    names, parts = N.SPACES[measure]
    k = N.NEIGHBOURS[measure]
    ok = f"o_{measure} AS (SELECT horizon, target, feature, ep, {', '.join(jitter_sql(v) for v in 'xyzp')} FROM {rows}" + (" WHERE p IS NOT NULL)" if "p" in names else ")")

    def far(vs):
        gaps = [f"abs(a.{v} - b.{v})" for v in vs]
        return gaps[0] if len(gaps) == 1 else f"greatest({', '.join(gaps)})"

    return f"""{ok}, r_{measure} AS (SELECT horizon, target, feature, a.ep, list_extract(min({far(names)}, {k}), {k}) AS r FROM o_{measure} a JOIN o_{measure} b USING (horizon, target, feature) WHERE a.ep <> b.ep GROUP BY ALL),
     c_{measure} AS (SELECT horizon, target, feature, ep, {', '.join(f"COUNT(*) FILTER ({far(p)} < r) AS n_{p}" for p in parts)} FROM (SELECT * FROM o_{measure} JOIN r_{measure} USING (horizon, target, feature, ep)) a
       JOIN (SELECT horizon, target, feature, x, y, z, p FROM o_{measure}) b USING (horizon, target, feature) GROUP BY ALL),
     v_{measure} AS (SELECT horizon, target, feature, {psi_sql(str(k))} + {psi_sql("COUNT(*)") if measure == "mi" else "0e0"} + AVG({" ".join(f"{'+' if s > 0 else '-'} {psi_sql(f'greatest(n_{p}, 1)')}" for p, s in parts.items())}) AS {measure}
       FROM c_{measure} GROUP BY ALL)"""


OK_SQL = f"WITH {TASK_SQL}, ok AS (SELECT * FROM tk WHERE x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL), nk AS (SELECT horizon, target, feature, COUNT(*) AS n_samples FROM ok GROUP BY ALL)"


def nearest(measure):
    def run(t):
        return N.neighbour_information(tasks(stage(features(t))), TASK, "ep", (measure,))

    query(measure, f"horizon:i target:s feature:s n_samples:i {measure}:f", f"{OK_SQL}, {near_sql(measure, 'ok')} SELECT horizon, target, feature, n_samples, {measure} FROM v_{measure} JOIN nk USING (horizon, target, feature)")(run)


for _name in N.SPACES:
    nearest(_name)


# Plug-in estimates over quantile bins, the second estimator.

BINS = 4


def bin_sql(c, out):
    return f"(CASE WHEN {c} IS NOT NULL THEN ({c} > q_{out}[1])::INT + ({c} > q_{out}[2])::INT + ({c} > q_{out}[3])::INT END)"


INFO = f"""WITH {FEAT_SQL}, qs AS (SELECT """ + ", ".join(f"quantile_cont({f}, [0.25, 0.5, 0.75]) AS q_{f}" for f in FEATS) + f""" FROM ft),
     bn AS (SELECT d, ep, """ + ", ".join(f"{bin_sql(f, f)} AS {f}" for f in FEATS) + f""" FROM ft, qs), tk AS ({task_sql('bn')}),
     ok AS (SELECT * FROM tk WHERE x IS NOT NULL AND y IS NOT NULL AND p IS NOT NULL AND z IS NOT NULL)"""
PARTS = ("x", "y", "xy", "z", "xz", "yz", "xyz", "p", "xp", "yp", "xyp", "pz", "xpz", "ypz", "xypz")
PLUGIN = {"mi": "h_x.h + h_y.h - h_xy.h", "cmi": "h_xz.h + h_yz.h - h_z.h - h_xyz.h", "te": "h_xp.h + h_yp.h - h_p.h - h_xyp.h", "cte": "h_xpz.h + h_ypz.h - h_pz.h - h_xypz.h"}


def entropy(vs):
    return (f"h_{vs} AS (SELECT horizon, target, feature, LN(SUM(n)) - SUM(n * LN(n)) / SUM(n) AS h FROM (SELECT horizon, target, feature, {', '.join(vs)}, COUNT(*) AS n FROM ok "
            f"GROUP BY ALL) c GROUP BY ALL)")


@query("information_plugin", "horizon:i target:s feature:s n_samples:i mi:f cmi:f te:f cte:f", f"""{INFO}, {", ".join(map(entropy, PARTS))}
     SELECT horizon, target, feature, n_samples, {", ".join(f"{v} AS {k}" for k, v in PLUGIN.items())} FROM (SELECT horizon, target, feature, COUNT(*) AS n_samples FROM ok GROUP BY ALL) c
       {" ".join(f"JOIN h_{p} USING (horizon, target, feature)" for p in PARTS)}""")
def _(t):
    return M.information(tasks(M.quantile_bin(stage(features(t)), FEATS, BINS)), TASK)


@query("mi_dataset", "d:d ep:i basis:f basis_lag_2s:f basis_delta_2s:f ctd_spread:f", """
     SELECT d, ep, basis, basis_lag_2s, basis_delta_2s, ctd_spread FROM (SELECT d, ep, basis, LAG(basis, 2) OVER w AS basis_lag_2s, basis - LAG(basis, 2) OVER w AS basis_delta_2s, ctd_spread
       FROM wide5 WHERE ep % 86400 BETWEEN 31200 AND 61200 AND d NOT IN (SELECT unnest(generate_series(d - days_before, d + days_after, INTERVAL 1 DAY))::DATE FROM excluded_raw)
       WINDOW w AS (PARTITION BY d ORDER BY ep)) x WHERE ep % 86400 BETWEEN 32400 AND 61200""")
def _(t):
    book = D.drop_dates(t.book5, D.excluded_dates(t.excluded_raw))
    return DS.feature_table(book, t.terms, ["basis", "basis_lag_2s", "basis_delta_2s", "ctd_spread"], S.WINDOW_OPEN, S.WINDOW_CLOSE, 300)


RATIO = 0.5


@query("mi_run", "horizon:i target:s feature:s n_samples:i pc:f error:s mi:f cmi:f te:f cte:f", f"""{OK_SQL}, pk AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY horizon, target, feature ORDER BY md5('42:' || ep), ep) AS k FROM ok) x
       JOIN nk USING (horizon, target, feature) WHERE k <= GREATEST(1, floor(n_samples * {RATIO}))), {", ".join(near_sql(m, "pk") for m in N.SPACES)}
     SELECT horizon, target, feature, c.n_samples, pc, error, mi, cmi, te, cte FROM (SELECT horizon, target, feature, {PEARSON} FROM pk GROUP BY ALL) c {" ".join(f"LEFT JOIN v_{m} USING (horizon, target, feature)" for m in N.SPACES)}""")
def _(t):
    """Every task draws its own sample of its complete rows."""
    whole = tasks(features(t)).dropna(subset=["x", "y", "z"])
    picked = stage(sample_exact(whole, "ep", ratio=RATIO, by=TASK))
    return M.pearson(picked, TASK, "x", "y").join(N.neighbour_information(picked, TASK, "ep").drop("n_samples"), TASK, "left")


def dataset(t):
    df = stage(features(t))
    target = X.target_shift(df.select("d", "ep", "basis"), "basis", 2, change=1).select("ep", "target")
    sampled = sample_exact(df.select("d", "ep"), "ep", ratio=0.5)
    return DS.sampled_dataset(df, target, sampled, 0.6, 0.2)


XGB_SQL = f"""WITH {FEAT_SQL}, tg AS (SELECT ep, LEAD(z, 2) OVER w AS target FROM (SELECT *, basis - LAG(basis) OVER w AS z FROM ft WINDOW w AS (PARTITION BY d ORDER BY ep)) y WINDOW w AS (PARTITION BY d ORDER BY ep)),
     pk AS (SELECT ep FROM (SELECT ep, ROW_NUMBER() OVER (ORDER BY md5('42:' || ep), ep) AS k, COUNT(*) OVER () AS n FROM ft) x WHERE k <= GREATEST(1, floor(n * 0.5))),
     sm AS (SELECT ft.*, target FROM ft JOIN tg ON tg.ep = ft.ep JOIN pk ON pk.ep = ft.ep WHERE target IS NOT NULL), r AS (SELECT d, ROW_NUMBER() OVER (ORDER BY d) - 1 AS i, COUNT(*) OVER () AS n FROM (SELECT DISTINCT d FROM sm) x),
     ds AS (SELECT sm.*, CASE WHEN i < floor(n * 0.6) THEN 'train' WHEN i < floor(n * (0.6e0 + 0.2e0)) THEN 'val' ELSE 'test' END AS split FROM sm JOIN r ON r.d = sm.d)"""


@query("xgb_dataset", "d:d ep:i basis:f basis_lag_2s:f irr:f ctd_obi_1:f target:f split:s", XGB_SQL + " SELECT * FROM ds")
def _(t):
    return dataset(t)


@query("time_series_folds", "role:s us:i fold:i part:s", """
     SELECT role, us, fold, CASE WHEN b < fold THEN 'train' ELSE 'val' END AS part FROM lob JOIN (SELECT d, (ROW_NUMBER() OVER (ORDER BY d) - 1) * 4 // COUNT(*) OVER () AS b FROM (SELECT DISTINCT d FROM lob) x) r
       ON r.d = lob.d JOIN (VALUES (1), (2), (3)) f(fold) ON b <= fold""")
def _(t):
    return D.time_folds(t.lob.select("role", "us", "d"), 3)


SPLIT_SQL = f"""WITH {FEAT_SQL}, r AS (SELECT d, ROW_NUMBER() OVER (ORDER BY d) - 1 AS i, COUNT(*) OVER () AS n FROM (SELECT DISTINCT d FROM ft) x),
     s AS (SELECT ft.ep, basis_delta_2s AS target, CASE WHEN i < floor(n * 0.6) THEN 'train' WHEN i < floor(n * (0.6e0 + 0.2e0)) THEN 'val' ELSE 'test' END AS split FROM ft JOIN r ON r.d = ft.d WHERE basis_delta_2s IS NOT NULL),
     q AS (SELECT quantile_cont(target, 1 / 3e0) AS a, quantile_cont(target, 2 / 3e0) AS b FROM s WHERE split = 'train')"""


def split_target(t):
    df = features(t, ["basis", "basis_delta_2s"]).withColumnRenamed("basis_delta_2s", "target")
    return stage(D.split_by_date_share(df.dropna(subset=["target"]), 0.6, 0.2))


@query("quantile_bins", "edge:i value:f", SPLIT_SQL + " SELECT 1 AS edge, a AS value FROM q UNION ALL SELECT 2, b FROM q")
def _(t):
    return M.bin_edges(split_target(t).where("split = 'train'"), "target", 3)


@query("classify", "ep:i split:s target:f target_class:i", SPLIT_SQL + " SELECT ep, split, target, (target > a)::INT + (target > b)::INT AS target_class FROM s, q")
def _(t):
    df = split_target(t)
    edges = M.class_edges(df.where("split = 'train'"), "target", 3)
    return df.withColumn("target_class", M.classify("target", edges))


def model_table(t):
    return stage(dataset(t))


SEEDS, TREES = (1, 2), 3
KIND_OUT = "seed:i feature:s weight:i gain:f cover:f total_gain:f total_cover:f"


def regression_run(t):
    df = model_table(t)
    return E.importance_run(df.where("split <> 'test'"), df.where("split = 'test'"), FEATS, "target", "reg", SEEDS, "ep", maxIter=TREES, maxDepth=3)


def class_run(t):
    df = model_table(t)
    edges = M.class_edges(df.where("split = 'train'"), "target", 3)
    df = df.withColumn("y", M.classify("target", edges))
    return E.importance_run(df.where("split <> 'test'"), df.where("split = 'test'"), FEATS, "y", "cls", SEEDS, "ep", classes=3, maxIter=TREES, maxDepth=3)


@query("gbt_importance_reg", KIND_OUT)
def _(t):
    return regression_run(t)[1]


@query("rf_importance_cls", KIND_OUT)
def _(t):
    return class_run(t)[1]


COMPLETE = " AND ".join(f"{f} IS NOT NULL" for f in FEATS)
SEED_SQL = f"(VALUES {', '.join(f'({s})' for s in SEEDS)}) s(seed)"


@query("ensemble_nodes", "seed:i tree:i root_rows:i leaf_rows:i nodes_of_leaves:i", f"""{XGB_SQL} SELECT seed, tree, n AS root_rows, n AS leaf_rows, 0 AS nodes_of_leaves
       FROM {SEED_SQL}, (VALUES {", ".join(f"({k})" for k in range(TREES))}) k(tree), (SELECT COUNT(*) AS n FROM ds WHERE split <> 'test' AND {COMPLETE}) c""")
def _(t):
    """Every training row reaches the root and one leaf of each tree; a tree has one leaf more than splits."""
    leaf = F.col("feature").isNull()
    return regression_run(t)[0].groupBy("seed", "tree").agg(
        F.sum(F.when(F.col("node") == 0, F.col("cover"))).alias("root_rows"), F.sum(F.when(leaf, F.col("cover"))).alias("leaf_rows"), (F.count_if(leaf) - F.count_if(~leaf) - 1).alias("nodes_of_leaves"))


@query("importance_predictions", "seed:i ep:i y_true:f answered:b", f"""{XGB_SQL} SELECT seed, ep, target AS y_true, TRUE AS answered FROM {SEED_SQL}, ds WHERE split = 'test' AND {COMPLETE}""")
def _(t):
    """Test predictions of every seed: each test row once, with a number."""
    return regression_run(t)[2].withColumn("answered", F.col("y_pred").isNotNull() & ~F.isnan("y_pred"))


@query("importance_metrics", "seed:i " + " ".join(f"{m}:f" for m in ("logloss", "accuracy", "balanced_accuracy", "precision", "recall", "f1", "mcc", "auc")))
def _(t):
    """Metrics of the class predictions per seed."""
    return E.metrics_by_seed(class_run(t)[2], "cls", 3)


@query("tune_grid", "trial:i params:s score:f fits:i mean_trees:f")
def _(t):
    df = D.time_folds(model_table(t), 2)
    return E.trial_scores(E.tune(df, FEATS, "target", trials=2, seeds=SEEDS, trees=5, max_depth=5))


@query("greedy_selection", "iteration:i selected_feature:s gain:f train_rmse:f val_rmse:f train_r2:f val_r2:f")
def _(t):
    df = model_table(t)
    return M.greedy_selection(df.where("split = 'train'"), df.where("split = 'val'"), FEATS, "target", trees=2, depth=2)


@query("permutation_importance", "feature:s loss_increase:f")
def _(t):
    return M.permutation_importance(model_table(t), FEATS, "target", "ep")


FAMILIES = ["lag", "delta", "roll", "ratio"]


@query("importance_groups", "family:s total:f features:i", f"""WITH {TASK_SQL}, c AS (SELECT horizon, target, feature, ABS(CORR(x, y) FILTER (z IS NOT NULL)) AS pc FROM tk GROUP BY ALL)
     SELECT CASE WHEN contains(feature, 'lag') THEN 'lag' WHEN contains(feature, 'delta') THEN 'delta' ELSE 'other' END AS family, SUM(pc) AS total, COUNT(*) AS features FROM c GROUP BY 1""")
def _(t):
    p = M.pearson(tasks(features(t)), TASK, "x", "y").withColumn("pc", F.abs("pc"))
    return M.importance_groups(p, FAMILIES, "feature", "pc")


REG = "SELECT seed, SQRT(AVG((y_true - y_pred) * (y_true - y_pred))) AS rmse, 1 - AVG((y_true - y_pred) * (y_true - y_pred)) / VAR_POP(y_true) AS r2 FROM predictions GROUP BY seed"


@query("metrics_reg", "seed:i rmse:f r2:f", REG)
def _(t):
    return M.metrics_reg(t.predictions, ["seed"])


CLS = ("logloss", "accuracy", "balanced_accuracy", "precision", "recall", "f1", "mcc", "auc")
CLS_SQL = """WITH p AS (SELECT *, [p0, p1, p2] AS pp FROM predictions), s AS (SELECT DISTINCT seed FROM p),
     pc AS (SELECT p.seed, k, SUM((c_true = k AND c_pred = k)::INT) AS tp, SUM((c_true = k)::INT) AS t, SUM((c_pred = k)::INT) AS q FROM p, (VALUES (0), (1), (2)) v(k) GROUP BY 1, 2),
     m AS (SELECT seed, AVG(tp / t) AS balanced_accuracy, AVG(tp / q) AS "precision", AVG(tp / t) AS recall, AVG(2 * tp / (t + q)) AS f1, SUM(tp) AS c, SUM(t) AS n, SUM(t * q) AS tq, SUM(t * t) AS tt, SUM(q * q) AS qq FROM pc GROUP BY seed),
     a AS (SELECT seed, AVG(u) AS auc FROM (SELECT x.seed, x.a, x.b, SUM(CASE WHEN x.s > y.s THEN x.n * y.n WHEN x.s = y.s THEN 0.5 * x.n * y.n ELSE 0 END) / SUM(x.n * y.n) AS u FROM
        (SELECT seed, c_true AS a, b, pp[c_true + 1] AS s, COUNT(*) AS n FROM p, (VALUES (0), (1), (2)) w(b) WHERE b <> c_true GROUP BY ALL) x
        JOIN (SELECT seed, c_true AS b, a, pp[a + 1] AS s, COUNT(*) AS n FROM p, (VALUES (0), (1), (2)) w(a) WHERE a <> c_true GROUP BY ALL) y ON x.seed = y.seed AND x.a = y.a AND x.b = y.b GROUP BY 1, 2, 3) z GROUP BY seed),
     cl AS (SELECT m.seed, (SELECT AVG(-LN(pp[c_true + 1])) FROM p WHERE p.seed = m.seed) AS logloss, c / n AS accuracy, balanced_accuracy, "precision", recall, f1,
        (c * n - tq) / SQRT((n * n - tt)::DOUBLE * (n * n - qq)) AS mcc, auc FROM m JOIN a ON a.seed = m.seed)"""


@query("metrics_cls", "seed:i " + " ".join(f"{m}:f" for m in CLS), CLS_SQL + " SELECT * FROM cl")
def _(t):
    return M.metrics_cls(t.predictions, ["seed"], 3)


@query("metrics_mean", "metric:s mean:f std:f", CLS_SQL + f", rg AS ({REG}) " + " UNION ALL ".join(
    [f"""SELECT '{m}' AS metric, AVG("{m}") AS mean, STDDEV_SAMP("{m}") AS std FROM cl""" for m in CLS] + [f"SELECT '{m}', AVG({m}), STDDEV_SAMP({m}) FROM rg" for m in ("rmse", "r2")]))
def _(t):
    from tickloom.operators.report import aggregate_seeds

    both = M.metrics_cls(t.predictions, ["seed"], 3).join(M.metrics_reg(t.predictions, ["seed"]), "seed")
    return aggregate_seeds(both, [*CLS, "rmse", "r2"])


@query("confusion", "c_true:i c_pred:i share:f", """
     SELECT c_true, c_pred, AVG(s) AS share FROM (SELECT g.seed, g.c_true, g.c_pred, COALESCE(n, 0) / t AS s FROM (SELECT DISTINCT seed, c_true, k AS c_pred FROM predictions, (VALUES (0), (1), (2)) v(k)) g
       LEFT JOIN (SELECT seed, c_true, c_pred, COUNT(*) AS n FROM predictions GROUP BY ALL) n ON n.seed = g.seed AND n.c_true = g.c_true AND n.c_pred = g.c_pred
       JOIN (SELECT seed, c_true, COUNT(*) AS t FROM predictions GROUP BY ALL) t ON t.seed = g.seed AND t.c_true = g.c_true) x GROUP BY 1, 2""")
def _(t):
    return M.confusion(t.predictions, ["seed"], 3)


@query("normalize_obs", "event_id:i l1_bid_size:f l1_ask_size:f", """
     SELECT event_id, (l1_bid_size - mb) / SQRT(vb + 1e-8) AS l1_bid_size, (l1_ask_size - ma) / SQRT(va + 1e-8) AS l1_ask_size FROM lob,
       (SELECT AVG(l1_bid_size) AS mb, VAR_POP(l1_bid_size) AS vb, AVG(l1_ask_size) AS ma, VAR_POP(l1_ask_size) AS va FROM lob WHERE d < DATE '2024-01-20') s""")
def _(t):
    return M.normalize(t.lob.where("d < '2024-01-20'"), t.lob, ["l1_bid_size", "l1_ask_size"])

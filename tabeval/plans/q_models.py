"""Registered queries: models, neighbours, resampling by synthesis, attribution
(SURVEY 2.5 smote/adasyn, 2.7 rfecv, 2.8, 2.9 knn_topk, 2.11)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import attribute as at
from ..operators import evaluate as ev
from ..operators import models as md
from ..operators import neighbors as nb
from ..operators import sample as sp
from ..operators import workflow as wf
from ..session import ensure_checkpoint_dir
from ..sources.io import read_table
from .registry import register, rounded

FEATS = ["price", "odays", "prio"]
STANDARD, IMPUTED = wf.Options(impute="mean", scaling="StandardScaler"), wf.Options(impute="mean")


def orders_features(spark, d):
    """y = fulfilled order; features: total price, days since 1995-01-01, priority code
    (``odays < 1096``: orders before 1998, the provided-test split)."""
    o = read_table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("row_id"), (F.col("o_orderstatus") == "F").cast("int").alias("y"),
                    (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("y_urgent"),
                    F.col("o_totalprice").alias("price"),
                    F.datediff(F.col("o_orderdate"), F.lit("1995-01-01").cast("date")).cast("double").alias("odays"),
                    F.substring("o_orderpriority", 1, 1).cast("double").alias("prio"), "o_orderpriority")


def _metrics(preds, group):
    res = ev.evaluate(preds, group)
    return rounded(res.select(*group, "auc", "auc_cilow", "auc_cihigh", "cutoff_youden", "P", "N"))


def _fit_query(alg: str, params: dict):
    def q(spark, d):
        preds = wf.train_test(orders_features(spark, d), FEATS, "y", "row_id", alg, params, STANDARD)
        return _metrics(preds, ["split"])
    return q


for _name, _alg, _params in [
        ("fit_rf", "rf", {"n_estimators": 100, "max_depth": 5}),
        ("fit_dt", "dt", {"max_depth": 5}),
        ("fit_gbt", "xgb", {"n_estimators": 50, "max_depth": 3, "learning_rate": 0.1}),
        ("fit_lr", "lr", {}),
        ("fit_sgd_elastic", "sgd_elastic", {"alpha": 1e-4, "l1_ratio": 0.15}),
        ("fit_sgd_l2", "sgd_l2", {"alpha": 1e-4}),
        ("fit_svm_linear", "svm", {"C": 1.0}),
        ("fit_mlp", "mlp", {"hidden_layer_sizes": (8,), "max_iter": 200})]:
    register(_name)(_fit_query(_alg, _params))


@register("calibrate_sigmoid")
def q_calibrate(spark, d):
    """Cross-fitted: every fold's scores are calibrated by a curve fitted on the other folds'."""
    cal = wf.calibrate_cv(orders_features(spark, d), FEATS, "y", "row_id", "rf", {}, IMPUTED, k=5)
    return rounded(cal.groupBy("fold").agg(F.avg("calibrated").alias("mean_calibrated"), F.avg("y").alias("positive_rate")))


# ------------------------------------------------------ isotonic (SQL)
@register("calibrate_isotonic", """WITH g AS (SELECT l_quantity AS x, CAST(COUNT(*) AS DOUBLE) AS w, CAST(SUM(CAST(l_linestatus = 'O' AS INTEGER)) AS DOUBLE) AS s
  FROM lineitem GROUP BY l_quantity),
p AS (SELECT x, row_number() OVER (ORDER BY x) AS i, SUM(w) OVER (ORDER BY x) AS cw, SUM(s) OVER (ORDER BY x) AS cs, w, s FROM g),
means AS (SELECT a.i AS j, b.i AS k, (b.cs - a.cs + a.s) / (b.cw - a.cw + a.w) AS m FROM p a JOIN p b ON a.i <= b.i)
SELECT x AS score, round((SELECT MAX(least_mean) FROM (SELECT j, MIN(m) AS least_mean FROM means WHERE j <= p.i AND k >= p.i GROUP BY j)), 6) AS calibrated FROM p""")
def q_isotonic(spark, d):
    """Open lineitems by quantity: the nearest rising step function, at every quantity."""
    from ..operators import calibrate as ca
    li = read_table(spark, d, "lineitem").select(F.col("l_quantity").alias("score"), (F.col("l_linestatus") == "O").cast("int").alias("y"))
    return rounded(ca.apply_isotonic(ca.fit_isotonic(li), li.select("score").distinct()))


# ------------------------------------------------------ weighted ensemble (SQL)
_NOISY = {"late": "(odays + o_custkey * 37 % 1500) / 4000.0", "key": "(odays + row_id * 61 % 1900) / 4000.0",
          "price": "o_totalprice / 400000.0", "mixed": "(odays + (row_id * 17 + o_custkey * 29) % 2300) / 4300.0"}
_NOISY_STEPS = 6


def _ensemble_sql() -> str:
    n = list(_NOISY)
    steps = [f"""r0 AS MATERIALIZED (SELECT y, {', '.join(f'CAST({e} AS DOUBLE) AS {c}' for c, e in _NOISY.items())}, CAST(0.0 AS DOUBLE) AS e FROM (
  SELECT o_orderkey AS row_id, CAST(o_orderstatus <> 'F' AS INTEGER) AS y, o_custkey, o_totalprice,
         CAST(datediff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) AS odays FROM orders))"""]
    for t in range(1, _NOISY_STEPS + 1):
        tried = " UNION ALL ".join(f"SELECT {i} AS k, y, e + {c} AS x FROM r{t - 1}" for i, c in enumerate(n))
        steps += [f"""c{t} AS MATERIALIZED (SELECT k, (SUM(mr) FILTER (y = 1) - SUM(y) * (SUM(y) + 1) / 2.0) / (SUM(y) * SUM(1 - y)) AS auc FROM (
  SELECT k, y, RANK() OVER (PARTITION BY k ORDER BY x) + (COUNT(*) OVER (PARTITION BY k, x) - 1) / 2.0 AS mr FROM ({tried})) GROUP BY k)""",
                  f"b{t} AS MATERIALIZED (SELECT k, auc FROM c{t} ORDER BY round(auc, 12) DESC, k LIMIT 1)",
                  f"""r{t} AS MATERIALIZED (SELECT y, {', '.join(n)}, e + CASE (SELECT k FROM b{t}) {' '.join(f'WHEN {i} THEN {c}' for i, c in enumerate(n))} END AS e FROM r{t - 1})"""]
    board = " UNION ALL ".join(f"SELECT {t} AS step, [{', '.join(repr(c) for c in n)}][k + 1] AS learner, auc FROM b{t}" for t in range(1, _NOISY_STEPS + 1))
    steps += [f"board AS (SELECT *, auc - coalesce(lag(auc) OVER (ORDER BY step), 0) AS gain FROM ({board}))",
              "top AS (SELECT step AS last FROM board ORDER BY round(auc, 12) DESC, step LIMIT 1)"]
    return "WITH " + ",\n".join(steps) + """
SELECT step, learner, round(auc, 6) AS auc, round(gain, 6) AS gain,
  round((SELECT CAST(COUNT(*) AS DOUBLE) FROM board b2, top WHERE b2.step <= last AND b2.learner = board.learner) / (SELECT last FROM top), 6) AS weight FROM board"""


@register("weighted_ensemble", _ensemble_sql())
def q_weighted_ensemble(spark, d):
    """Four scores of every order; each step's learner, AUC and gain, and the learner's weight in the end."""
    from ..operators import ensemble as es
    o = read_table(spark, d, "orders").select(
        F.col("o_orderkey").alias("row_id"), (F.col("o_orderstatus") != "F").cast("int").alias("y"), "o_custkey", "o_totalprice",
        F.datediff(F.col("o_orderdate"), F.lit("1995-01-01").cast("date")).cast("double").alias("odays"))
    scores = o.select("y", *[F.expr(e).cast("double").alias(c) for c, e in _NOISY.items()])
    board, weights = es.greedy_ensemble(scores, list(_NOISY), "y", _NOISY_STEPS)
    weight = F.create_map(*[F.lit(x) for c in _NOISY for x in (c, float(weights.get(c, 0.0)))])
    return rounded(board.withColumn("weight", weight[F.col("learner")]))


# ------------------------------------------------- histogram boosting (SQL)
_BOOST = {"qty": "l_quantity", "disc": "CASE WHEN l_linenumber <> 7 THEN l_discount END", "tax": "CASE WHEN l_linenumber < 6 OR l_returnflag = 'R' THEN l_tax END"}
_BOOST_SETTINGS = {"reg_lambda": 2.0, "gamma": 0.25, "min_child_weight": 5.0}


def _boost_sql() -> str:
    lam, gamma, least = (_BOOST_SETTINGS[k] for k in ("reg_lambda", "gamma", "min_child_weight"))
    long = " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST({e} AS DOUBLE) AS v, CAST(l_returnflag = 'R' AS DOUBLE) AS y FROM lineitem" for c, e in _BOOST.items())
    return f"""WITH long AS ({long}),
tot AS (SELECT feature, SUM(0.5 - y) AS G, 0.25 * COUNT(*) AS H, coalesce(SUM(0.5 - y) FILTER (v IS NULL), 0) AS gm,
  0.25 * COUNT(*) FILTER (v IS NULL) AS hm, MAX(v) AS last FROM long GROUP BY feature),
val AS (SELECT feature, v, SUM(0.5 - y) AS g, 0.25 * COUNT(*) AS h FROM long WHERE v IS NOT NULL GROUP BY feature, v),
cum AS (SELECT feature, v, SUM(g) OVER (PARTITION BY feature ORDER BY v) AS gl, SUM(h) OVER (PARTITION BY feature ORDER BY v) AS hl FROM val),
side AS (SELECT c.feature, v, l AS missing_left, gl + CASE WHEN l THEN gm ELSE 0 END AS gl, hl + CASE WHEN l THEN hm ELSE 0 END AS hl, G, H
  FROM cum c JOIN tot USING (feature), (VALUES (true), (false)) t(l) WHERE v < last),
gains AS (SELECT feature, v, missing_left, 0.5 * (gl * gl / (hl + {lam}) + (G - gl) * (G - gl) / (H - hl + {lam}) - G * G / (H + {lam})) - {gamma} AS gain
  FROM side WHERE hl >= {least} AND H - hl >= {least}),
best AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY round(gain, 9) DESC, v, missing_left DESC) AS r FROM gains)
SELECT feature, round(v, 6) AS threshold, missing_left, round(gain, 6) AS gain FROM best WHERE r = 1"""


@register("fit_hist_gbt", _boost_sql())
def q_boost(spark, d):
    """The first tree's root over every lineitem: each feature's best split, with its learned side for missing values."""
    from ..operators import boosting as bs
    names = list(_BOOST)
    li = read_table(spark, d, "lineitem").select(*[F.expr(e).alias(c) for c, e in _BOOST.items()], (F.col("l_returnflag") == "R").cast("int").alias("y"))
    s = bs.Settings(**_BOOST_SETTINGS)
    edges = bs.edges_of(li, names, s.max_bins)
    rows = bs.binned(li, names, "y", edges).select("*", F.lit(0).alias("node"), (0.5 - F.col("y")).alias("g"), F.lit(0.25).alias("h"))
    best = bs.best_of(bs.split_gains(rows, range(len(names)), s), ["feature"])
    threshold = F.array(*[F.array(*[F.lit(float(v)) for v in e]) for e in edges])[F.col("feature")][F.col("bin")]
    return rounded(best.select(F.array(*[F.lit(c) for c in names])[F.col("feature")].alias("feature"), threshold.alias("threshold"), "missing_left", "gain"))


# ------------------------------------------------------- top features (SQL)
_DATE = "CAST(o_orderdate AS DATE)"
#: twelve features of an order and the weights of a fixed score
_TOP = {"price": ("o_totalprice", 1e-6), "cust": ("o_custkey", 1e-5), "odays": (None, -1e-3), "month": (f"month({_DATE})", 0.02),
        "day": (f"day({_DATE})", 0.005), "quarter": (f"quarter({_DATE})", 0.02), "prio": ("CAST(substr(o_orderpriority, 1, 1) AS DOUBLE)", 0.03),
        "size": ("length(o_orderpriority)", 0.01), "key7": ("o_orderkey % 7", 0.01), "key11": ("o_orderkey % 11", -0.01),
        "cust13": ("o_custkey % 13", -0.02), "cust5": ("o_custkey % 5", 0.015)}


def _top_sql() -> str:
    n = list(_TOP)
    value = {c: e or f"datediff('day', DATE '1995-01-01', {_DATE})" for c, (e, _) in _TOP.items()}

    def score(shuffled: str | None) -> str:
        return " + ".join(f"CAST({w!r} AS DOUBLE) * {'d' if c == shuffled else 'b'}.{c}" for c, (_, w) in _TOP.items())
    tried = " UNION ALL ".join(f"SELECT '{c or ''}' AS feature, b.y, {score(c)} AS x FROM base b JOIN base d ON b.pos = d.hash_rank" for c in (None, *n))
    return f"""WITH base AS MATERIALIZED (SELECT CAST(o_orderstatus = 'F' AS INTEGER) AS y, {', '.join(f'CAST({e} AS DOUBLE) AS {c}' for c, e in value.items())},
  row_number() OVER (ORDER BY o_orderkey) AS pos, row_number() OVER (ORDER BY md5('42:' || CAST(o_orderkey AS VARCHAR)), o_orderkey) AS hash_rank FROM orders),
ranked AS (SELECT feature, y, RANK() OVER (PARTITION BY feature ORDER BY x) + (COUNT(*) OVER (PARTITION BY feature, x) - 1) / 2.0 AS mr FROM ({tried})),
aucs AS (SELECT feature, (SUM(mr) FILTER (y = 1) - SUM(y) * (SUM(y) + 1) / 2.0) / (SUM(y) * SUM(1 - y)) AS auc FROM ranked GROUP BY feature),
drops AS (SELECT feature, (SELECT auc FROM aucs WHERE feature = '') - auc AS importance, (SELECT auc FROM aucs WHERE feature = '') AS baseline_auc FROM aucs WHERE feature <> '')
SELECT feature, round(importance, 6) AS importance, round(baseline_auc, 6) AS baseline_auc,
  CAST(row_number() OVER (ORDER BY round(abs(importance), 9) DESC, feature) AS INTEGER) AS rank FROM drops
ORDER BY round(abs(importance), 9) DESC, feature LIMIT 10"""


@register("topk_features", _top_sql())
def q_topk(spark, d):
    """The ten features of the largest permutation importance for a fixed score of every order."""
    o = read_table(spark, d, "orders")
    days = F.datediff(F.col("o_orderdate"), F.lit("1995-01-01").cast("date"))
    rows = o.select(F.col("o_orderkey").alias("row_id"), (F.col("o_orderstatus") == "F").cast("int").alias("y"),
                    *[(F.expr(e) if e else days).cast("double").alias(c) for c, (e, _) in _TOP.items()])
    drops = at.permutation_importance(at.LinearScore({c: w for c, (_, w) in _TOP.items()}), rows, list(_TOP), "row_id", "y", 42)
    return rounded(at.topk_features(drops, 10))


# ----------------------------------------------------------- gaussian NB (SQL)
NB_FEATS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _nb_stats(spark, d):
    li = read_table(spark, d, "lineitem")
    return li.select((F.col("l_returnflag") == "R").cast("int").alias("y"), *NB_FEATS)


@register("fit_gaussian_nb", f"""WITH li AS (SELECT CAST(l_returnflag = 'R' AS INTEGER) AS y, {', '.join(NB_FEATS)} FROM lineitem),
eps AS (SELECT 1e-9 * greatest({', '.join(f'VAR_POP({f})' for f in NB_FEATS)}) AS e FROM li),
cs AS (SELECT y, CAST(COUNT(*) AS DOUBLE) / (SELECT COUNT(*) FROM li) AS prior,
  {', '.join(f'AVG({f}) AS m_{f}, VAR_POP({f}) + (SELECT e FROM eps) AS v_{f}' for f in NB_FEATS)} FROM li GROUP BY y),
c0 AS (SELECT * FROM cs WHERE y = 0), c1 AS (SELECT * FROM cs WHERE y = 1),
j AS (SELECT li.*, ln(c0.prior) {''.join(f" - 0.5 * ln(2 * pi() * c0.v_{f}) - 0.5 * (li.{f} - c0.m_{f}) * (li.{f} - c0.m_{f}) / c0.v_{f}" for f in NB_FEATS)} AS j0,
  ln(c1.prior) {''.join(f" - 0.5 * ln(2 * pi() * c1.v_{f}) - 0.5 * (li.{f} - c1.m_{f}) * (li.{f} - c1.m_{f}) / c1.v_{f}" for f in NB_FEATS)} AS j1
  FROM li, c0, c1)
SELECT y, {', '.join(NB_FEATS)}, round(1.0 / (1.0 + exp(least(greatest(j0 - j1, -700), 700))), 6) AS score FROM j""")
def q_gaussian_nb(spark, d):
    df = _nb_stats(spark, d)
    model = md.fit_gaussian_nb(df, NB_FEATS, "y", 1e-9)
    return rounded(md.predict_gaussian_nb(model, df).select("y", *NB_FEATS, "score"))


# ------------------------------------------------------------------- tuning
def _tune(spark, d, alg, options, **how):
    prep = wf.Preparation(FEATS, "y", options)
    frame = prep.fit(orders_features(spark, d), "row_id")
    return wf.tune(frame, FEATS, "y", alg, **how)[1]


@register("tune_grid")
def q_tune_grid(spark, d):
    return rounded(_tune(spark, d, "dt", IMPUTED, strategy="grid", k=10))


@register("tune_random")
def q_tune_random(spark, d):
    return rounded(_tune(spark, d, "lr", STANDARD, strategy="random", n_iter=50, k=10, scoring="accuracy"))


@register("cv_results_table")
def q_cv_results(spark, d):
    return rounded(_tune(spark, d, "lr", STANDARD, grid={"C": [0.001, 0.1, 10.0]}, strategy="grid", k=10).orderBy("rank_test_score"))


# ---------------------------------------------------------------- workflows
@register("train_whole")
def q_train_whole(spark, d):
    df = orders_features(spark, d)
    models = wf.train_whole(df, FEATS, ["y", "y_urgent"], "row_id", "lr", {}, STANDARD)
    out = None
    for o, m in models.items():
        s = m.score(df, [F.lit(o).alias("outcome"), F.col(o).alias("y")])
        out = s if out is None else out.unionByName(s)
    return _metrics(out, ["outcome"])


@register("train_test")
def q_train_test(spark, d):
    """The train/test flow per outcome: stratified split, then on the training part impute -> scale ->
    undersample -> select (ANOVA F, 2 of 3), shared by the learners; each searches its grid and is
    fitted; the result table of train and test metrics."""
    from ..operators import results as rs
    opts = wf.Options(impute="mean", scaling="StandardScaler", rebalance="RandomUnderSampler", feature_selection="SelectKBest-f_classif",
                      n_features=2, min_positives=10, search="grid", search_folds=3,
                      grids={"lr": {"C": [0.1, 10.0]}, "nb": {"var_smoothing": [1e-9, 1e-6]}, "dt": {"max_depth": [3, 5]}})
    preds = wf.train_test_flow(orders_features(spark, d), FEATS, ["y", "y_urgent"], "row_id", {"lr": {}, "nb": {}, "dt": {}}, opts)
    return rounded(rs.results_table(preds))


@register("split_provided_test")
def q_provided_test(spark, d):
    """Fit the table-level preparation (one-hot, rows, inf, outliers) and the
    model on one table, apply both to another table."""
    df = orders_features(spark, d)
    train, test = df.where(F.col("odays") < 1096), df.where(F.col("odays") >= 1096)
    opts = wf.Options(impute="mean", scaling="MinMaxScaler", outliers="log", outliers_n=300000.0)
    tp = wf.TablePrep(["price", "odays"], ["o_orderpriority"], opts)
    tr = tp.fit_transform(train)
    te = tp.transform(test)
    fm = wf.fit(tr, tp.inputs, "y", "row_id", "lr", {}, opts)
    preds = fm.score(tr, [F.lit("train").alias("split"), "y"]).unionByName(fm.score(te, [F.lit("test").alias("split"), "y"]))
    return _metrics(preds, ["split"])


@register("cross_validate")
def q_cross_validate(spark, d):
    """Stratified 10-fold CV; each fold imputes (median), scales (min-max), oversamples the minority
    class and fits on its own training rows."""
    opts = wf.Options(impute="median", scaling="MinMaxScaler", rebalance="RandomOverSampler")
    oof = wf.cross_validate_flow(orders_features(spark, d), FEATS, "y", "row_id", "lr", {}, opts, k=10, n_repeats=1)
    return _metrics(oof, ["repeat", "fold", "split"])


@register("save_load_model", "SELECT CAST(COUNT(*) AS BIGINT) AS rows, CAST(0 AS BIGINT) AS differing FROM orders")
def q_save_load(spark, d):
    df = orders_features(spark, d)
    m = wf.fit(df, FEATS, "y", "row_id", "rf", {"n_estimators": 10, "max_depth": 4}, IMPUTED)
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tabeval-model-{uuid.uuid4().hex}"
    m.save(path)
    a = m.score(df, ["row_id"]).withColumnRenamed("score", "s_fit")
    b = wf.FoldModel.load(path).score(df, ["row_id"]).withColumnRenamed("score", "s_loaded")
    j = a.join(b.select("row_id", "s_loaded"), "row_id")
    return j.agg(F.count(F.lit(1)).alias("rows"),
                 F.sum((F.abs(F.col("s_fit") - F.col("s_loaded")) > 1e-12).cast("int")).alias("differing"))


@register("score_saved")
def q_score_saved(spark, d):
    """Train on orders before 1998 (table preparation + per-outcome training
    flow for two learners), save the bundle under the checkpoint folder, reload
    it and score the later orders; evaluate the scored predictions."""
    df = orders_features(spark, d)
    train, later = df.where(F.col("odays") < 1096), df.where(F.col("odays") >= 1096)
    opts = wf.Options(impute="mean", scaling="StandardScaler", outliers="log", outliers_n=300000.0)
    tp = wf.TablePrep(["price", "odays"], ["o_orderpriority"], opts)
    tr = tp.fit_transform(train)
    models = {(alg, o): wf.fit(tr, tp.inputs, o, "row_id", alg, params, opts)
              for alg, params in (("lr", {}), ("gbt", {"n_estimators": 10})) for o in ("y", "y_urgent")}
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tabeval-bundle-{uuid.uuid4().hex}"
    wf.save_bundle(path, tp, models)
    scored = wf.score_bundle(path, later, "row_id")
    return _metrics(scored, ["algorithm", "outcome"])


@register("auto_select")
def q_auto_select(spark, d):
    board, _ = wf.auto_select(orders_features(spark, d), FEATS, "y", ["lr", "rf", "gbt", "nb"],
                              {"rf": {"n_estimators": [20], "max_depth": [3, 5]}, "gbt": {"n_estimators": [10]}},
                              holdout=0.2, options=IMPUTED)
    return rounded(board)


@register("stack_oof")
def q_stack(spark, d):
    """Two learners, two bags each, stacked over two levels."""
    oof = wf.cross_validate_flow(orders_features(spark, d), FEATS, "y", "row_id", {"lr": {}, "dt": {"max_depth": 4}}, {}, STANDARD, k=3, n_repeats=2)
    oof = oof.where(F.col("split") == "test").select("algorithm", "row_id", "y", "score")
    return _metrics(wf.stack_oof(oof, "row_id", "algorithm", levels=[{"lr": {}, "dt": {"max_depth": 3}}, {"lr": {}}], k=3), [])


@register("select_rfecv")
def q_rfecv(spark, d):
    return rounded(wf.select_rfecv(orders_features(spark, d), FEATS, "y", "row_id", min_features=1, k=5))


# ------------------------------------------------------------ neighbours (SQL)
def _emb(spark, d):
    e = read_table(spark, d, "embeddings")
    return e.select(F.col("vec_id"), F.col("embedding").cast("array<double>").alias("vec"),
                    (F.col("label") == 0).cast("int").alias("y"))


_DIST = "sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)) * (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)))))"
_KNN_SQL = f"""WITH pairs AS (SELECT a.vec_id AS qid, b.vec_id AS rid, {_DIST} AS distance
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY qid ORDER BY distance, rid) AS nn_rank FROM pairs)
SELECT qid, rid, round(distance, 6) AS distance, CAST(nn_rank AS INTEGER) AS nn_rank FROM r WHERE nn_rank <= 5"""


@register("knn_topk", _KNN_SQL)
def q_knn(spark, d):
    e = _emb(spark, d)
    nn = nb.knn_topk(e.select(F.col("vec_id").alias("qid"), "vec"), e.select(F.col("vec_id").alias("rid"), "vec"), 5,
                     exclude_self=True)
    return rounded(nn.withColumn("nn_rank", F.col("nn_rank").cast("int")))


_FITKNN_SQL = f"""WITH e AS (SELECT vec_id, embedding, CAST(label = 0 AS INTEGER) AS y FROM embeddings),
s AS (SELECT *, CASE WHEN ROW_NUMBER() OVER (PARTITION BY y ORDER BY md5('42:' || CAST(vec_id AS VARCHAR)), vec_id)
        <= round(COUNT(*) OVER (PARTITION BY y) * 0.2) THEN 'test' ELSE 'train' END AS split FROM e),
pairs AS (SELECT a.vec_id AS qid, b.vec_id AS rid, b.y, {_DIST} AS distance
  FROM s a JOIN s b ON a.split = 'test' AND b.split = 'train'),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY qid ORDER BY distance, rid) AS nn_rank FROM pairs)
SELECT qid AS vec_id, round(AVG(CAST(y AS DOUBLE)), 6) AS score FROM r WHERE nn_rank <= 5 GROUP BY qid"""


@register("fit_knn", _FITKNN_SQL)
def q_fit_knn(spark, d):
    s = sp.split_stratified(_emb(spark, d), "y", "vec_id", 0.2, 42)
    res = nb.knn_classifier(s.where(F.col("split") == "train"), s.where(F.col("split") == "test"), k=5,
                            id_col="vec_id", vec="vec", y="y")
    return rounded(res)


#: all coordinates of base + u (neighbour - base): their number, sum and sum weighted by place
_COORDINATE = "CAST(b.embedding[i] AS DOUBLE) + ju.u * (CAST(n.embedding[i] AS DOUBLE) - CAST(b.embedding[i] AS DOUBLE))"
_ALL_COORDINATES_SQL = f"""CAST(len(b.embedding) AS INTEGER) AS dims,
  round(list_sum(list_transform(range(1, len(b.embedding) + 1), lambda i: {_COORDINATE})), 6) AS x_sum,
  round(list_sum(list_transform(range(1, len(b.embedding) + 1), lambda i: i * ({_COORDINATE}))), 5) AS x_weighted"""


def _all_coordinates():
    zero = F.lit(0.0)
    places = F.sequence(F.lit(1), F.size("vec"))
    return (F.size("vec").alias("dims"), F.aggregate("vec", zero, lambda a, x: a + x).alias("x_sum"),
            F.aggregate(F.zip_with("vec", places, lambda x, i: x * i), zero, lambda a, x: a + x).alias("x_weighted"))


def _rounded_samples(df):
    scale = lambda c, digits: F.round(F.col(c) * 10.0 ** digits, 0) / 10.0 ** digits
    return df.select("synth_id", "base_id", "nb_id", scale("u", 6).alias("u"), "dims", scale("x_sum", 6).alias("x_sum"),
                     scale("x_weighted", 5).alias("x_weighted"))


def _smote_sql() -> str:
    h = lambda s: f"('0x' || substr(md5({s}), 1, 15))::BIGINT"
    return f"""WITH m AS (SELECT vec_id AS id, embedding FROM embeddings WHERE label = 0),
cnt AS (SELECT COUNT(*) AS m FROM m),
need AS (SELECT (SELECT COUNT(*) FROM embeddings WHERE label <> 0) - (SELECT m FROM cnt) AS n_new),
ranked AS (SELECT id, embedding, ROW_NUMBER() OVER (ORDER BY id) AS brank FROM m),
pairs AS (SELECT a.id AS qid, b.id AS rid, {_DIST} AS distance FROM m a JOIN m b ON a.id <> b.id),
nn AS (SELECT qid, rid, ROW_NUMBER() OVER (PARTITION BY qid ORDER BY distance, rid) AS nn_rank FROM pairs),
nn5 AS (SELECT * FROM nn WHERE nn_rank <= 5),
nk AS (SELECT qid, COUNT(*) AS nk FROM nn5 GROUP BY qid),
jobs AS (SELECT j AS synth_id, ({h("'42:base:' || CAST(j AS VARCHAR)")} % (SELECT m FROM cnt)) + 1 AS brank
         FROM (SELECT UNNEST(range((SELECT n_new FROM need))) AS j)),
jb AS (SELECT jobs.synth_id, r.id AS base_id FROM jobs JOIN ranked r ON jobs.brank = r.brank),
jn AS (SELECT jb.*, ({h("'42:nb:' || CAST(jb.synth_id AS VARCHAR)")} % nk.nk) + 1 AS nn_rank FROM jb JOIN nk ON jb.base_id = nk.qid),
jp AS (SELECT jn.synth_id, jn.base_id, nn5.rid AS nb_id FROM jn JOIN nn5 ON jn.base_id = nn5.qid AND jn.nn_rank = nn5.nn_rank),
ju AS (SELECT jp.*, CAST({h("'42:u:' || CAST(jp.synth_id AS VARCHAR)")} AS DOUBLE) / 1152921504606846976.0 AS u FROM jp)
SELECT ju.synth_id, ju.base_id, ju.nb_id, round(ju.u, 6) AS u, {_ALL_COORDINATES_SQL}
FROM ju JOIN m b ON ju.base_id = b.id JOIN m n ON ju.nb_id = n.id"""


def _smote_frame(spark, d):
    e = _emb(spark, d)
    tg = sp.sampling_targets(e, "y", "over", "auto").where(F.col("y") == 1).first()
    n_new = int(tg["target"] - tg["count"])
    return nb.smote(e, "vec_id", "vec", "y", 1, n_new, k=5, seed=42)


@register("smote", _smote_sql())
def q_smote(spark, d):
    s = _smote_frame(spark, d)
    return _rounded_samples(s.select("synth_id", "base_id", "nb_id", "u", *_all_coordinates()))


def _adasyn_sql() -> str:
    h = lambda x: f"('0x' || substr(md5({x}), 1, 15))::BIGINT"
    return f"""WITH e AS (SELECT vec_id AS id, embedding, CAST(label = 0 AS INTEGER) AS y FROM embeddings),
mino AS (SELECT id, embedding FROM e WHERE y = 1),
nn AS (SELECT (SELECT COUNT(*) FROM e WHERE y = 0) - (SELECT COUNT(*) FROM mino) AS n_new),
pa AS (SELECT a.id AS qid, b.id AS rid, b.y AS ry, {_DIST} AS distance FROM mino a JOIN e b ON a.id <> b.id),
na AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY qid ORDER BY distance, rid) AS r FROM pa),
ratio AS (SELECT qid, SUM(CASE WHEN ry = 0 THEN 1 ELSE 0 END) AS m FROM na WHERE r <= 5 GROUP BY qid),
tot AS (SELECT SUM(m) AS mt FROM ratio),
share AS (SELECT qid, (m * (SELECT n_new FROM nn)) // (SELECT mt FROM tot) AS gi,
                 (m * (SELECT n_new FROM nn)) % (SELECT mt FROM tot) AS frac FROM ratio),
rm AS (SELECT (SELECT n_new FROM nn) - SUM(gi) AS rem FROM share),
sr AS (SELECT *, ROW_NUMBER() OVER (ORDER BY frac DESC, qid) AS fr FROM share),
cnts AS (SELECT qid, gi + CASE WHEN fr <= (SELECT rem FROM rm) THEN 1 ELSE 0 END AS cnt FROM sr),
c2 AS (SELECT qid, cnt, SUM(cnt) OVER (ORDER BY qid ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum
       FROM cnts WHERE cnt > 0),
jobs AS (SELECT qid AS base_id, UNNEST(range(CAST(cum - cnt AS BIGINT), CAST(cum AS BIGINT))) AS synth_id FROM c2),
pm AS (SELECT a.id AS qid, b.id AS rid, {_DIST} AS distance FROM mino a JOIN mino b ON a.id <> b.id),
nm AS (SELECT qid, rid, ROW_NUMBER() OVER (PARTITION BY qid ORDER BY distance, rid) AS nn_rank FROM pm),
nm5 AS (SELECT * FROM nm WHERE nn_rank <= 5),
nk AS (SELECT qid, COUNT(*) AS nk FROM nm5 GROUP BY qid),
jn AS (SELECT jobs.*, ({h("'42:nb:' || CAST(jobs.synth_id AS VARCHAR)")} % nk.nk) + 1 AS nn_rank
       FROM jobs JOIN nk ON jobs.base_id = nk.qid),
jp AS (SELECT jn.synth_id, jn.base_id, nm5.rid AS nb_id FROM jn JOIN nm5 ON jn.base_id = nm5.qid AND jn.nn_rank = nm5.nn_rank),
ju AS (SELECT CAST(synth_id AS BIGINT) AS synth_id, base_id, nb_id,
  CAST({h("'42:u:' || CAST(synth_id AS VARCHAR)")} AS DOUBLE) / 1152921504606846976.0 AS u FROM jp)
SELECT ju.synth_id, ju.base_id, ju.nb_id, round(ju.u, 6) AS u, {_ALL_COORDINATES_SQL}
FROM ju JOIN mino b ON ju.base_id = b.id JOIN mino n ON ju.nb_id = n.id"""


@register("adasyn", _adasyn_sql())
def q_adasyn(spark, d):
    e = _emb(spark, d)
    tg = sp.sampling_targets(e, "y", "over", "auto").where(F.col("y") == 1).first()
    a = nb.adasyn(e, "vec_id", "vec", "y", 1, int(tg["target"] - tg["count"]), k=5, seed=42)
    return _rounded_samples(a.select("synth_id", "base_id", "nb_id", "u", *_all_coordinates()))


# --------------------------------------------------------------- attribution
@register("shapley_sampled")
def q_shapley(spark, d):
    df = orders_features(spark, d)
    train = df.where(F.col("odays") < 1096)
    m = wf.fit(train, FEATS, "y", "row_id", "rf", {"n_estimators": 10, "max_depth": 4}, IMPUTED)
    return rounded(at.shapley_sampled(m, df.where(F.col("odays") >= 1096), FEATS, "row_id", train, output="prediction"))


@register("permutation_importance")
def q_perm_importance(spark, d):
    df = orders_features(spark, d)
    m = wf.fit(df, FEATS, "y", "row_id", "rf", {"n_estimators": 10, "max_depth": 4}, IMPUTED)
    return rounded(at.permutation_importance(m, df, FEATS, "row_id", "y", 42))


_LIN_W = {"l_quantity": 0.02, "l_extendedprice": 1e-5, "l_discount": -3.0, "l_tax": 2.0}


def _shap_values(spark, d):
    """Exact linear attributions of two fixed linear scores on lineitem (a values table)."""
    raw = read_table(spark, d, "lineitem")
    li = raw.withColumn("rid", F.xxhash64(*[F.col(c) for c in raw.columns]))
    a = at.linear_shap(li, _LIN_W, "rid").withColumn("algorithm", F.lit("lin_a"))
    w2 = {k: v for k, v in _LIN_W.items() if k != "l_tax"}
    b = at.linear_shap(li, w2, "rid").withColumn("algorithm", F.lit("lin_b"))
    return a.unionByName(b).withColumn("outcome", F.lit("returned"))


def _shap_mean_sql() -> str:
    parts = []
    for alg, w in (("lin_a", _LIN_W), ("lin_b", {k: v for k, v in _LIN_W.items() if k != "l_tax"})):
        cols = []
        for f in _LIN_W:
            if f in w:
                cols.append(f"round(AVG(abs({w[f]!r} * (CAST({f} AS DOUBLE) - (SELECT AVG(CAST({f} AS DOUBLE)) FROM lineitem)))), 6) AS {f}")
            else:
                cols.append(f"CAST(NULL AS DOUBLE) AS {f}")
        parts.append(f"SELECT '{alg}' AS algorithm, 'returned' AS outcome, {', '.join(cols)} FROM lineitem")
    return "\nUNION ALL\n".join(parts)


@register("shap_mean_table", _shap_mean_sql())
def q_shap_mean(spark, d):
    return rounded(at.shap_mean_table(_shap_values(spark, d), ["algorithm", "outcome"], list(_LIN_W)))


def _shap_rank_sql() -> str:
    parts = []
    for alg, w in (("lin_a", _LIN_W), ("lin_b", {k: v for k, v in _LIN_W.items() if k != "l_tax"})):
        for f in w:
            parts.append(f"SELECT '{alg}' AS algorithm, 'returned' AS outcome, '{f}' AS feature, "
                         f"AVG(abs({w[f]!r} * (CAST({f} AS DOUBLE) - (SELECT AVG(CAST({f} AS DOUBLE)) FROM lineitem)))) AS mean_abs FROM lineitem")
    return f"""WITH m AS ({' UNION ALL '.join(parts)}),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY algorithm, outcome ORDER BY mean_abs DESC, feature) AS rank FROM m),
u AS (SELECT feature, COUNT(DISTINCT algorithm || '|' || outcome) AS n_models FROM m WHERE mean_abs IS NOT NULL GROUP BY feature)
SELECT r.feature, r.algorithm, r.outcome, round(r.mean_abs, 6) AS mean_abs, CAST(r.rank AS INTEGER) AS rank,
  CAST(u.n_models AS BIGINT) AS n_models FROM r JOIN u ON r.feature = u.feature WHERE r.rank <= 3"""


@register("shap_rank", _shap_rank_sql())
def q_shap_rank(spark, d):
    v = _shap_values(spark, d)
    mean_long = v.groupBy("algorithm", "outcome", "feature").agg(F.avg(F.abs("shap_value")).alias("mean_abs"))
    return rounded(at.shap_rank(mean_long, ["algorithm", "outcome"], 3))


_FOLD_W = {"o_totalprice": 1e-5, "o_custkey": 2e-4, "odays": -1e-3}


def _shap_fold_mean_sql() -> str:
    means = ", ".join(f"AVG(CAST({f} AS DOUBLE)) AS m_{f}" for f in _FOLD_W)
    parts = " UNION ALL ".join(
        f"SELECT o.fold, {i} AS j, AVG(abs({w!r} * (CAST(o.{f} AS DOUBLE) - fm.m_{f}))) AS value "
        f"FROM of o JOIN fm ON o.fold = fm.fold GROUP BY o.fold" for i, (f, w) in enumerate(_FOLD_W.items()))
    return f"""WITH o0 AS (SELECT o_orderkey AS rid, o_totalprice, o_custkey,
    CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) AS odays FROM orders),
of AS (SELECT *, CAST((ROW_NUMBER() OVER (ORDER BY md5('42:' || CAST(rid AS VARCHAR)), rid) - 1) * 3 // COUNT(*) OVER () AS INTEGER) AS fold FROM o0),
fm AS (SELECT fold, {means} FROM of GROUP BY fold),
vals AS ({parts})
SELECT CAST(j AS INTEGER) AS j, round(AVG(value), 6) AS mean_abs_shap FROM vals GROUP BY j"""


@register("shap_fold_mean", _shap_fold_mean_sql())
def q_shap_fold_mean(spark, d):
    """Per-fold attribution tables (exact linear attributions on each fold of
    orders) cut to the smallest shape, then averaged per feature."""
    from ..operators.profile import truncate_to_smallest
    o = read_table(spark, d, "orders").select(
        F.col("o_orderkey").alias("rid"), "o_totalprice", "o_custkey",
        F.datediff(F.col("o_orderdate"), F.lit("1995-01-01").cast("date")).cast("double").alias("odays"))
    folds = sp.kfold(o, "rid", 3, 42)
    vals = None
    for f in range(3):
        v = at.linear_shap(folds.where(F.col("fold") == f), _FOLD_W, "rid").withColumn("fold", F.lit(f))
        vals = v if vals is None else vals.unionByName(v)
    m = vals.groupBy("fold", "feature").agg(F.avg(F.abs("shap_value")).alias("value"))
    fi = {f: i for i, f in enumerate(_FOLD_W)}
    mapping = F.create_map(*[x for f, i in fi.items() for x in (F.lit(f), F.lit(i))])
    long = m.select("fold", F.lit(0).alias("i"), mapping[F.col("feature")].alias("j"), "value")
    cut = truncate_to_smallest(long, "fold", "i", "j")
    return rounded(cut.groupBy("j").agg(F.avg("value").alias("mean_abs_shap")))

"""Registered queries: folds, curves, calibration, decision curves, multiclass."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.stats import t_ppf
from ..operators import curves as cv
from ..operators import evaluate as ev
from ..operators import rates as rt
from ..operators import sample as sp
from ..sources.io import read_table
from ..sources.problems import DOC_PRED_SQL, ORDERS_SQL, doc_predictions, orders_problem
from .registry import register, rounded
from .sqlgen import Z, score_groups_sql

K = 5
SEED = 42
GRID = 100
STEP = "%.17e" % cv.grid_step(GRID)
T5 = "%.17e" % t_ppf(0.975, K)


def cv_predictions(spark, d):
    """Orders with stratified 5-fold ids: each fold is one evaluation curve."""
    return sp.kfold_stratified(orders_problem(spark, d), "y", "row_id", K, SEED)


CV_SQL = ORDERS_SQL + f""",
ordf AS (SELECT *, CAST((ROW_NUMBER() OVER (PARTITION BY y ORDER BY md5('{SEED}:' || CAST(row_id AS VARCHAR)), row_id) - 1) * {K} // COUNT(*) OVER (PARTITION BY y) AS INTEGER) AS fold FROM ord)"""


def _cv_sg(spark, d):
    return ev.score_groups(cv_predictions(spark, d), ["fold"])


# -------------------------------------------------------------- interp_on_grid
_GRID_SQL = f"""grid AS (SELECT CAST(i AS INTEGER) AS i, CASE WHEN i = {GRID - 1} THEN 1.0 ELSE i * {STEP} END AS g FROM range({GRID}) t(i))"""


def _interp_sql(kind: str) -> str:
    if kind == "roc":
        seg = f"""seg AS (SELECT fold, P, N, CAST(fp - neg AS DOUBLE) / N AS x0, CAST(fp AS DOUBLE) / N AS x1,
                 CAST(tp - pos AS DOUBLE) / P AS y0, CAST(tp AS DOUBLE) / P AS y1 FROM sg)"""
        last = "1.0"
    else:
        seg = f"""seg AS (SELECT fold, P, N, CAST(tp - pos AS DOUBLE) / P AS x0, CAST(tp AS DOUBLE) / P AS x1,
                 CASE WHEN tp - pos + fp - neg = 0 THEN 1.0 ELSE CAST(tp - pos AS DOUBLE) / (tp - pos + fp - neg) END AS y0,
                 CAST(tp AS DOUBLE) / (tp + fp) AS y1 FROM sg)"""
        last = "CAST(MAX(P) AS DOUBLE) / (MAX(P) + MAX(N))"
    return f"""{seg},
{_GRID_SQL},
inner_pts AS (SELECT s.fold, g.i AS grid_index, g.g AS x,
    CASE WHEN g.g = s.x0 THEN s.y0 ELSE ((s.y1 - s.y0) / (s.x1 - s.x0)) * (g.g - s.x0) + s.y0 END AS y
  FROM seg s JOIN grid g ON s.x0 <= g.g AND g.g < s.x1 WHERE s.x1 > s.x0),
curves AS (SELECT * FROM inner_pts UNION ALL SELECT fold, {GRID - 1}, 1.0, {last} FROM sg GROUP BY fold)"""


_INTERP_SQL = f"""WITH {CV_SQL},
{score_groups_sql('ordf', ['fold'])},
{_interp_sql('roc')}
SELECT fold, grid_index, round(x, 6) AS fpr, round(y, 6) AS tpr FROM curves"""


@register("interp_on_grid", _INTERP_SQL)
def q_interp(spark, d):
    c = cv.interp_on_grid(_cv_sg(spark, d), ["fold"], GRID, "roc")
    return rounded(c.select("fold", "grid_index", F.col("x").alias("fpr"), F.col("y").alias("tpr")))


# ---------------------------------------------------------------- averaged_roc
_AVG_ROC_SQL = f"""WITH {CV_SQL},
{score_groups_sql('ordf', ['fold'])},
{_interp_sql('roc')},
c2 AS (SELECT fold, grid_index, x, CASE WHEN grid_index = 0 THEN 0.0 ELSE y END AS y FROM curves),
m AS (SELECT grid_index, MAX(x) AS fpr, CASE WHEN grid_index = {GRID - 1} THEN 1.0 ELSE AVG(y) END AS mean_tpr,
        STDDEV_POP(y) AS sd FROM c2 GROUP BY grid_index),
lagged AS (SELECT *, LAG(fpr) OVER (ORDER BY grid_index) AS x0, LAG(mean_tpr) OVER (ORDER BY grid_index) AS y0 FROM m),
mauc AS (SELECT SUM(CASE WHEN x0 IS NOT NULL THEN (fpr - x0) * (mean_tpr + y0) / 2 ELSE 0 END) AS mean_auc FROM lagged),
fauc AS (SELECT fold, SUM(pos * (CAST(N AS DOUBLE) - fp + neg / 2.0) / N) / MAX(P) AS auc FROM sg GROUP BY fold),
s AS (SELECT mean_auc, (SELECT STDDEV_POP(auc) FROM fauc) AS std_auc FROM mauc)
SELECT grid_index, round(fpr, 6) AS fpr, round(mean_tpr, 6) AS mean_tpr,
  round(least(mean_tpr + {T5} * sd / sqrt({K}), 1.0), 6) AS tpr_high,
  round(greatest(mean_tpr - {T5} * sd / sqrt({K}), 0.0), 6) AS tpr_low,
  round(mean_auc, 6) AS mean_auc, round(std_auc, 6) AS std_auc,
  round(greatest(mean_auc - {T5} * std_auc / sqrt({K}), 0.0), 6) AS auc_cilow,
  round(least(mean_auc + {T5} * std_auc / sqrt({K}), 1.0), 6) AS auc_cihigh
FROM m, s"""


@register("averaged_roc", _AVG_ROC_SQL)
def q_averaged_roc(spark, d):
    return rounded(cv.averaged_roc(_cv_sg(spark, d), [], "fold", GRID, n_curves=K))


_AVG_PR_SQL = f"""WITH {CV_SQL},
{score_groups_sql('ordf', ['fold'])},
{_interp_sql('pr')},
m AS (SELECT grid_index, MAX(x) AS recall, AVG(y) AS mean_precision FROM curves GROUP BY grid_index),
pa AS (SELECT fold, SUM((CAST(tp AS DOUBLE) / P - CAST(tp - pos AS DOUBLE) / P)
          * (CAST(tp AS DOUBLE) / (tp + fp) + CASE WHEN tp - pos + fp - neg = 0 THEN 1.0
             ELSE CAST(tp - pos AS DOUBLE) / (tp - pos + fp - neg) END) / 2) AS pr_auc FROM sg GROUP BY fold)
SELECT grid_index, round(recall, 6) AS recall, round(mean_precision, 6) AS mean_precision,
  round((SELECT AVG(pr_auc) FROM pa), 6) AS mean_pr_auc FROM m"""


@register("averaged_pr", _AVG_PR_SQL)
def q_averaged_pr(spark, d):
    return rounded(cv.averaged_pr(_cv_sg(spark, d), [], "fold", GRID))


# ----------------------------------------------------- averaged_confusion etc.
CV_CUT = 150000.0
_CV_CM_SQL = f"""{CV_SQL},
cm AS (SELECT fold,
  SUM(CASE WHEN y = 1 AND score >= {CV_CUT} THEN 1 ELSE 0 END) AS TP,
  SUM(CASE WHEN y = 0 AND score >= {CV_CUT} THEN 1 ELSE 0 END) AS FP,
  SUM(CASE WHEN y = 1 AND score < {CV_CUT} THEN 1 ELSE 0 END) AS FN,
  SUM(CASE WHEN y = 0 AND score < {CV_CUT} THEN 1 ELSE 0 END) AS TN FROM ordf GROUP BY fold)"""

_AVG_CM_SQL = f"""WITH {_CV_CM_SQL}
SELECT CAST(0 AS INTEGER) AS y, CAST(0 AS INTEGER) AS pred, round(AVG(TN), 6) AS mean_count FROM cm
UNION ALL SELECT 0, 1, round(AVG(FP), 6) FROM cm
UNION ALL SELECT 1, 0, round(AVG(FN), 6) FROM cm
UNION ALL SELECT 1, 1, round(AVG(TP), 6) FROM cm"""


def _cv_labelled(spark, d):
    return cv_predictions(spark, d).withColumn("pred", (F.col("score") >= CV_CUT).cast("int"))


@register("averaged_confusion", _AVG_CM_SQL)
def q_avg_confusion(spark, d):
    cm = rt.confusion_matrix(_cv_labelled(spark, d), ["fold"])
    # sum of fold matrices / number of folds actually run (Q14)
    return rounded(cm.groupBy("y", "pred").agg((F.sum("count") / F.countDistinct("fold")).alias("mean_count")))


_FOLD_SQL = f"""WITH {CV_SQL},
{score_groups_sql('ordf', ['fold'])},
fa AS (SELECT fold, SUM(pos * (CAST(N AS DOUBLE) - fp + neg / 2.0) / N) / MAX(P) AS auc FROM sg GROUP BY fold),
acc AS (SELECT fold, AVG(CASE WHEN CAST(score >= {CV_CUT} AS INTEGER) = y THEN 1.0 ELSE 0.0 END) AS accuracy,
          AVG(CASE WHEN y = 0 THEN 1.0 ELSE 0.0 END) AS dummy_accuracy FROM ordf GROUP BY fold),
j AS (SELECT fa.fold, auc, accuracy, dummy_accuracy FROM fa JOIN acc ON fa.fold = acc.fold)
SELECT fold, round(auc, 6) AS auc, round(accuracy, 6) AS accuracy, round(dummy_accuracy, 6) AS dummy_accuracy,
  round(AVG(auc) OVER (), 6) AS mean_auc, round(AVG(accuracy) OVER (), 6) AS mean_accuracy FROM j"""


@register("fold_metrics", _FOLD_SQL)
def q_fold_metrics(spark, d):
    lab = _cv_labelled(spark, d)
    auc = ev.auc_table(ev.score_groups(lab, ["fold"]), ["fold"])
    acc = rt.accuracy(lab, ["fold"]).select("fold", "accuracy", F.col("dummy_zero_accuracy").alias("dummy_accuracy"))
    j = auc.join(acc, "fold")
    means = j.agg(F.avg("auc").alias("mean_auc"), F.avg("accuracy").alias("mean_accuracy"))
    return rounded(cv.attach(j, means, []))


# ------------------------------------------------------------- calibration
_PROB = "n_chars / (n_chars + 1500.0)"


def _doc_probs(spark, d):
    p = doc_predictions(spark, d)
    return p.withColumn("prob", F.col("score") / (F.col("score") + F.lit(1500.0)))


_DOC_PROB_SQL = DOC_PRED_SQL + """,
dp AS (SELECT outcome, y, score / (score + 1500.0) AS prob FROM doc_pred)"""

_CAL_SQL = f"""WITH {_DOC_PROB_SQL},
b AS (SELECT outcome, y, prob, ({' + '.join(f'CAST(prob > {i} * {"%.17e" % 0.1} AS INTEGER)' for i in range(1, 10))}) AS bin FROM dp)
SELECT outcome, CAST(bin AS INTEGER) AS bin, round(AVG(CAST(y AS DOUBLE)), 6) AS prob_true, round(AVG(prob), 6) AS prob_pred,
  CAST(COUNT(*) AS BIGINT) AS count FROM b GROUP BY outcome, bin"""


@register("calibration_curve", _CAL_SQL)
def q_calibration(spark, d):
    return rounded(cv.calibration_curve(_doc_probs(spark, d), ["outcome"], "y", "prob", 10))


# ------------------------------------------------------------- net benefit
def _nb_sql(col: str) -> str:
    return f"""WITH {_DOC_PROB_SQL},
th AS (SELECT CAST(i AS INTEGER) AS i, i * {"%.17e" % 0.001} AS t FROM range(1000) r(i)),
tot AS (SELECT outcome, CAST(SUM(y) AS DOUBLE) AS P, CAST(SUM(1 - y) AS DOUBLE) AS N FROM dp GROUP BY outcome),
cnt AS (SELECT dp.outcome, th.i, th.t, SUM(CASE WHEN dp.prob > th.t AND y = 1 THEN 1 ELSE 0 END) AS TP,
          SUM(CASE WHEN dp.prob > th.t AND y = 0 THEN 1 ELSE 0 END) AS FP FROM dp, th GROUP BY dp.outcome, th.i, th.t)
SELECT c.outcome, round(c.t, 6) AS threshold,
  round({'TP / (P + N) - FP / (P + N) * (t / (1 - t))' if col == 'model' else ('P / (P + N) - N / (P + N) * (t / (1 - t))' if col == 'all' else 'CAST(0.0 AS DOUBLE)')}, 6) AS net_benefit_{col}
FROM cnt c JOIN tot ON c.outcome = tot.outcome"""


def _nb_q(col: str):
    def q(spark, d):
        nb = cv.net_benefit(_doc_probs(spark, d), ["outcome"], "y", "prob", 1000)
        return rounded(nb.select("outcome", "threshold", f"net_benefit_{col}"))
    return q


for _c in ("model", "all", "none"):
    register(f"net_benefit_{_c}", _nb_sql(_c))(_nb_q(_c))

_NBI_SQL = f"""WITH {_DOC_PROB_SQL},
th AS (SELECT i * {"%.17e" % ((1.0 - 1.0 / 20000) / 19999)} AS t FROM range(20000) r(i)),
tot AS (SELECT outcome, CAST(COUNT(*) AS DOUBLE) AS n FROM dp GROUP BY outcome),
s AS (SELECT outcome, prob, SUM(y) AS pos, SUM(1 - y) AS neg FROM dp GROUP BY outcome, prob),
c AS (SELECT s.outcome, th.t, SUM(CASE WHEN s.prob >= th.t THEN pos ELSE 0 END) AS TP,
        SUM(CASE WHEN s.prob >= th.t THEN neg ELSE 0 END) AS FP FROM s, th GROUP BY s.outcome, th.t)
SELECT c.outcome, round(t, 6) AS threshold, round(TP / n - FP / n * (t / (1 - t)), 6) AS net_benefit
FROM c JOIN tot ON c.outcome = tot.outcome"""


@register("net_benefit_interp", _NBI_SQL)
def q_nb_interp(spark, d):
    return rounded(cv.net_benefit_interp(_doc_probs(spark, d), ["outcome"], "y", "prob", 20000))


# ------------------------------------------------------------- multiclass
MC_SCORES = {"A": "l_extendedprice", "N": "l_quantity", "R": "l_discount"}
_MC_SQL = f"""WITH ovr AS (
  {' UNION ALL '.join(f"SELECT '{c}' AS curve, CAST(l_returnflag = '{c}' AS INTEGER) AS y, CAST({s} AS DOUBLE) AS score FROM lineitem" for c, s in MC_SCORES.items())}),
{score_groups_sql('ovr', ['curve'])},
pooled AS (SELECT 'micro' AS k, y, score FROM ovr),
{score_groups_sql('pooled', ['k'], 'sgm')},
verts AS (SELECT curve, CAST(fp AS DOUBLE) / N AS x, CAST(tp AS DOUBLE) / P AS y FROM sg
          UNION ALL SELECT curve, 0.0, 0.0 FROM sg GROUP BY curve),
vo AS (SELECT curve, x, y, ROW_NUMBER() OVER (PARTITION BY curve ORDER BY x, y) AS ord FROM verts),
ux AS (SELECT DISTINCT x FROM verts),
pts AS (SELECT c.curve, ux.x FROM ux, (SELECT DISTINCT curve FROM sg) c),
ao AS (SELECT p.curve, p.x, (SELECT COUNT(*) FROM vo WHERE vo.curve = p.curve AND vo.x <= p.x) AS ord FROM pts p),
iv AS (SELECT ao.curve, ao.x, l.x AS x0, l.y AS y0, r.x AS x1, r.y AS y1 FROM ao
       JOIN vo l ON l.curve = ao.curve AND l.ord = ao.ord LEFT JOIN vo r ON r.curve = ao.curve AND r.ord = ao.ord + 1),
mv AS (SELECT x, AVG(CASE WHEN x1 IS NULL OR x = x0 THEN y0 ELSE ((y1 - y0) / (x1 - x0)) * (x - x0) + y0 END) AS m FROM iv GROUP BY x),
ml AS (SELECT x, m, LAG(x) OVER (ORDER BY x) AS px, LAG(m) OVER (ORDER BY x) AS pm FROM mv)
SELECT curve, round(SUM(pos * (CAST(N AS DOUBLE) - fp + neg / 2.0) / N) / MAX(P), 6) AS auc FROM sg GROUP BY curve
UNION ALL SELECT 'micro', round(SUM(pos * (CAST(N AS DOUBLE) - fp + neg / 2.0) / N) / MAX(P), 6) FROM sgm
UNION ALL SELECT 'macro', round(SUM(CASE WHEN px IS NOT NULL THEN (x - px) * (m + pm) / 2 ELSE 0 END), 6) FROM ml"""


@register("roc_multiclass", _MC_SQL)
def q_multiclass(spark, d):
    li = read_table(spark, d, "lineitem")
    return rounded(cv.roc_multiclass(li, [], "l_returnflag", MC_SCORES))


# ------------------------------------------------------------- univariate_auc
UNI_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_UNI_SQL = f"""WITH u AS ({' UNION ALL '.join(f"SELECT '{f}' AS feature, CAST(l_returnflag = 'R' AS INTEGER) AS y, CAST({f} AS DOUBLE) AS score FROM lineitem" for f in UNI_FEATURES)}),
{score_groups_sql('u', ['feature'])},
roc AS (SELECT feature, score AS threshold, CAST(tp AS DOUBLE) / P AS tpr, CAST(fp AS DOUBLE) / N AS fpr FROM sg
        UNION ALL SELECT feature, CAST('inf' AS DOUBLE), 0.0, 0.0 FROM sg GROUP BY feature),
a AS (SELECT feature, SUM(pos * (CAST(N AS DOUBLE) - fp + neg / 2.0) / N) / MAX(P) AS auc FROM sg GROUP BY feature),
b AS (SELECT feature, FIRST(threshold ORDER BY tpr + (1 - fpr) DESC, threshold DESC) AS cutoff,
        FIRST(tpr ORDER BY tpr + (1 - fpr) DESC, threshold DESC) AS tpr,
        FIRST(1 - fpr ORDER BY tpr + (1 - fpr) DESC, threshold DESC) AS tnr FROM roc GROUP BY feature)
SELECT a.feature, round(auc, 6) AS auc, cutoff AS cutoff_youden, round(tpr, 6) AS tpr, round(tnr, 6) AS tnr
FROM a JOIN b ON a.feature = b.feature"""


@register("univariate_auc", _UNI_SQL)
def q_univariate(spark, d):
    li = read_table(spark, d, "lineitem")
    u = li.select((F.col("l_returnflag") == "R").cast("int").alias("y"),
                  F.expr("stack(4, " + ", ".join(f"'{f}', CAST({f} AS DOUBLE)" for f in UNI_FEATURES)
                         + ") as (feature, score)"))
    res = ev.evaluate(u, ["feature"])
    return rounded(res.select("feature", "auc", "cutoff_youden", "tpr", "tnr"))


# ------------------------------------------------------------ all_experiment_roc
_AER_SQL = f"""WITH e AS (
  SELECT 'price' AS experiment, CAST(l_returnflag = 'R' AS INTEGER) AS y, l_extendedprice AS score FROM lineitem
  UNION ALL SELECT 'qty', CAST(l_returnflag = 'R' AS INTEGER), l_quantity FROM lineitem),
{score_groups_sql('e', ['experiment'])},
comp AS (SELECT experiment, pos, neg, (CAST(N AS DOUBLE) - fp + neg / 2.0) / N AS v01, (tp - pos / 2.0) / P AS v10,
           CAST(P AS DOUBLE) AS P, CAST(N AS DOUBLE) AS N FROM sg),
st AS (SELECT experiment, SUM(pos * v01) / MAX(P) AS auc,
         (SUM(pos * v01 * v01) - MAX(P) * POWER(SUM(pos * v01) / MAX(P), 2)) / (MAX(P) - 1) / MAX(P)
         + (SUM(neg * v10 * v10) - MAX(N) * POWER(SUM(neg * v10) / MAX(N), 2)) / (MAX(N) - 1) / MAX(N) AS var
       FROM comp GROUP BY experiment),
pts AS (SELECT experiment, score AS threshold, CAST(tp AS DOUBLE) / P AS tpr, CAST(fp AS DOUBLE) / N AS fpr FROM sg
        UNION ALL SELECT experiment, CAST('inf' AS DOUBLE), 0.0, 0.0 FROM sg GROUP BY experiment)
SELECT p.experiment, threshold, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr, round(auc, 6) AS auc,
  round(auc - {Z} * sqrt(var), 6) AS auc_cilow, round(least(auc + {Z} * sqrt(var), 1.0), 6) AS auc_cihigh
FROM pts p JOIN st ON p.experiment = st.experiment"""


@register("all_experiment_roc", _AER_SQL)
def q_all_experiment_roc(spark, d):
    li = read_table(spark, d, "lineitem")
    y = (F.col("l_returnflag") == "R").cast("int").alias("y")
    e = li.select(F.lit("price").alias("experiment"), y, F.col("l_extendedprice").alias("score")) \
        .unionByName(li.select(F.lit("qty").alias("experiment"), y, F.col("l_quantity").alias("score")))
    sg = ev.score_groups(e, ["experiment"])
    roc = ev.roc_points(sg, ["experiment"]).select("experiment", "threshold", "fpr", "tpr")
    st = ev.evaluate(None, ["experiment"], sg=sg).select("experiment", "auc", "auc_cilow", "auc_cihigh")
    return rounded(roc.join(F.broadcast(st), "experiment"))


# ------------------------------------------------------------------ bootstrap
def _bootstrap_sql(n_boot: int = 1000, seed: int = 42) -> str:
    from ..operators.sample import poisson_cdf

    def draw(u: str, mean: float) -> str:
        return f"len(list_filter([{', '.join('%.17e' % c for c in poisson_cdf(mean))}], lambda x: x <= {u}))"

    def uni(x: str) -> str:
        return f"(CAST(('0x' || substr(md5({x}), 1, 15))::BIGINT AS DOUBLE) / 1152921504606846976.0)"
    return f"""WITH {DOC_PRED_SQL},
cells AS (SELECT outcome, CAST(score AS DOUBLE) AS score, y AS _y, COUNT(*) AS c FROM doc_pred
          WHERE y IS NOT NULL AND score IS NOT NULL GROUP BY outcome, CAST(score AS DOUBLE), y),
rep AS (SELECT cells.*, CAST(r AS BIGINT) AS replicate FROM cells, range({n_boot}) t(r)),
k AS (SELECT *, concat_ws(':', outcome, CAST(score AS VARCHAR), CAST(_y AS VARCHAR), CAST(replicate AS VARCHAR)) AS key FROM rep),
ones AS (SELECT outcome, replicate, score, _y, key, UNNEST(range(1, c % 64 + 1)) AS i FROM k),
blocks AS (SELECT outcome, replicate, score, _y, key, UNNEST(range(1, c // 64 + 1)) AS i FROM k),
u AS (SELECT outcome, replicate, score, _y, 1 AS mean, {uni(f"'{seed}:p:' || key || ':' || CAST(i AS VARCHAR)")} AS u FROM ones
      UNION ALL SELECT outcome, replicate, score, _y, 64, {uni(f"'{seed}:b:' || key || ':' || CAST(i AS VARCHAR)")} FROM blocks),
draws AS (SELECT outcome, replicate, score, _y, CASE WHEN mean = 1 THEN {draw("u", 1.0)} ELSE {draw("u", 64.0)} END AS d FROM u),
w AS (SELECT outcome, replicate, score, _y, SUM(d) AS weight FROM draws GROUP BY outcome, replicate, score, _y),
g AS (SELECT outcome, replicate, score, SUM(weight * _y) AS pos, SUM(weight * (1 - _y)) AS neg FROM w
      WHERE weight > 0 GROUP BY outcome, replicate, score),
run AS (SELECT *, SUM(neg) OVER (PARTITION BY outcome, replicate ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cneg,
          SUM(neg) OVER (PARTITION BY outcome, replicate) AS tneg, SUM(pos) OVER (PARTITION BY outcome, replicate) AS tpos FROM g),
a AS (SELECT outcome, replicate, SUM(pos * (tneg - cneg + neg / 2.0) / NULLIF(tneg, 0)) / NULLIF(MAX(tpos), 0) AS auc
      FROM run GROUP BY outcome, replicate)
SELECT outcome, round(quantile_cont(auc, 0.025), 6) AS ci_low, round(quantile_cont(auc, 0.975), 6) AS ci_high,
  CAST(COUNT(auc) AS BIGINT) AS n_boot FROM a WHERE auc IS NOT NULL GROUP BY outcome"""


@register("bootstrap_auc_ci", _bootstrap_sql())
def q_bootstrap(spark, d):
    p = doc_predictions(spark, d)
    return rounded(cv.bootstrap_auc_ci(p, ["outcome"], "doc_id", n_boot=1000, seed=SEED))

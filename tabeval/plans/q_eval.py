"""Registered queries: ROC, threshold and test statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.normal import log_sf_nonneg_sql, normal_sf_sql, two_sided_p_sql
from ..functions.scalar import dummy_predict, predict_at_cutoff, wilson_bounds
from ..operators import evaluate as ev
from ..operators import rates as rt
from ..sources.io import read_table
from ..sources.problems import (DOC_PRED_SQL, LINEITEM_PRED_SQL, ORDERS_SQL, doc_predictions,
                                lineitem_predictions, orders_problem)
from .registry import register, rounded
from .sqlgen import Z, div, r6, rates_sql, roc_sql, score_groups_sql, wilson_sql

LG = ["algorithm", "outcome"]
DG = ["outcome"]


def _li_sg(spark, d):
    return ev.score_groups(lineitem_predictions(spark, d), LG)


# ---------------------------------------------------------------- roc_points
_ROC_SQL = f"""WITH {LINEITEM_PRED_SQL},
{score_groups_sql('li_pred', LG)},
{roc_sql(LG)}
SELECT algorithm, outcome, threshold, tp, fp, P, N, {r6('tpr', 'tpr')}, {r6('fpr', 'fpr')} FROM roc"""


@register("roc_points", _ROC_SQL)
def q_roc_points(spark, d):
    roc = ev.roc_points(_li_sg(spark, d), LG)
    return rounded(roc.select(*LG, "threshold", "tp", "fp", "P", "N", "tpr", "fpr"))


# ----------------------------------------------------------- threshold_table
_R = rates_sql()
_TT_SQL = f"""WITH {LINEITEM_PRED_SQL},
{score_groups_sql('li_pred', LG)},
{roc_sql(LG)}
SELECT algorithm, outcome, threshold, {', '.join(r6(_R[c], c) for c in ev.THRESHOLD_COLS)} FROM roc"""


@register("threshold_table", _TT_SQL)
def q_threshold_table(spark, d):
    return rounded(ev.threshold_table(ev.roc_points(_li_sg(spark, d), LG), LG))


# ----------------------------------------------------------------------- auc
# Oracle: Mann-Whitney from DuckDB ranks over raw rows (independent of score groups).
_RANKS_SQL = f"""{LINEITEM_PRED_SQL},
ranked AS (
  SELECT algorithm, outcome, y, score,
    RANK() OVER (PARTITION BY algorithm, outcome ORDER BY score)
      + (COUNT(*) OVER (PARTITION BY algorithm, outcome, score) - 1) / 2.0 AS mr
  FROM li_pred),
mw AS (
  SELECT algorithm, outcome, CAST(SUM(y) AS DOUBLE) AS P, CAST(SUM(1 - y) AS DOUBLE) AS N,
         SUM(CASE WHEN y = 1 THEN mr ELSE 0 END) AS R
  FROM ranked GROUP BY algorithm, outcome)"""

_AUC_SQL = f"""WITH {_RANKS_SQL}
SELECT algorithm, outcome, round((R - P*(P + 1)/2) / (P*N), 6) AS auc FROM mw"""


@register("auc", _AUC_SQL)
def q_auc(spark, d):
    return rounded(ev.auc_table(_li_sg(spark, d), LG))


# ------------------------------------------------------------------- midrank
_MIDRANK_SQL = f"""WITH {DOC_PRED_SQL}
SELECT DISTINCT outcome, CAST(score AS DOUBLE) AS score,
  CAST(COUNT(*) OVER (PARTITION BY outcome, score) AS BIGINT) AS cnt,
  round(RANK() OVER (PARTITION BY outcome ORDER BY score)
        + (COUNT(*) OVER (PARTITION BY outcome, score) - 1) / 2.0, 6) AS midrank
FROM doc_pred"""


@register("midrank", _MIDRANK_SQL)
def q_midrank(spark, d):
    sg = ev.score_groups(doc_predictions(spark, d), DG)
    return rounded(ev.midranks(sg, DG))


# ------------------------------------------------------------- auc_delong_ci
# Oracle: per-row structural components + var_samp (the textbook DeLong form).
_DELONG_ROWS_SQL = f"""{LINEITEM_PRED_SQL},
{score_groups_sql('li_pred', LG)},
comp AS (
  SELECT r.algorithm, r.outcome, r.y,
    CASE WHEN r.y = 1 THEN (CAST(s.N AS DOUBLE) - s.fp + s.neg/2.0) / s.N END AS v01,
    CASE WHEN r.y = 0 THEN (s.tp - s.pos/2.0) / s.P END AS v10,
    CAST(s.P AS DOUBLE) AS P, CAST(s.N AS DOUBLE) AS N
  FROM li_pred r JOIN sg s ON r.algorithm = s.algorithm AND r.outcome = s.outcome AND r.score = s.score),
dl AS (
  SELECT algorithm, outcome, AVG(v01) AS auc,
    greatest(VAR_SAMP(v01) / MAX(P) + VAR_SAMP(v10) / MAX(N), 0) AS var
  FROM comp GROUP BY algorithm, outcome)"""

_DELONG_SQL = f"""WITH {_DELONG_ROWS_SQL}
SELECT algorithm, outcome, round(auc, 6) AS auc, round(var, 6) AS auc_var,
  round(CASE WHEN var > 0 THEN auc - {Z}*sqrt(var) END, 6) AS auc_cilow,
  round(CASE WHEN var > 0 THEN least(auc + {Z}*sqrt(var), 1.0) END, 6) AS auc_cihigh
FROM dl"""


@register("auc_delong_ci", _DELONG_SQL)
def q_auc_delong_ci(spark, d):
    res = ev.evaluate(None, LG, sg=_li_sg(spark, d))
    return rounded(res.select(*LG, "auc", "auc_var", "auc_cilow", "auc_cihigh"))


# ---------------------------------------------------------- auc_vs_half_test
_RANKSUM_SQL = f"""WITH {_RANKS_SQL},
zz AS (SELECT algorithm, outcome, (R - P*(P + N + 1)/2) / sqrt(P*N*(P + N + 1)/12) AS z FROM mw)
SELECT algorithm, outcome, round(z, 6) AS z, round({two_sided_p_sql('z')}, 6) AS p_value FROM zz"""


@register("auc_vs_half_test", _RANKSUM_SQL)
def q_auc_vs_half(spark, d):
    return rounded(rt.rank_sum_test(_li_sg(spark, d), LG))


# ------------------------------------------------------------ best cutoffs
def _best_sql(name: str) -> str:
    crit = _R[name] if name == "youden" else f"coalesce({_R[name]}, 0)"
    return f"""WITH {LINEITEM_PRED_SQL},
{score_groups_sql('li_pred', LG)},
{roc_sql(LG)},
c AS (SELECT algorithm, outcome, threshold, {crit} AS crit FROM roc)
SELECT algorithm, outcome,
  FIRST(threshold ORDER BY crit DESC, threshold DESC) AS cutoff,
  round(MAX(crit), 6) AS criterion
FROM c GROUP BY algorithm, outcome"""


def _best_q(name: str):
    def q(spark, d):
        return rounded(rt.best_cutoff(_li_sg(spark, d), LG, name))
    return q


for _n in ("youden", "f1", "ji", "mcc"):
    register(f"best_cutoff_{_n}", _best_sql(_n))(_best_q(_n))


# --------------------------------------------------------- metrics_at_cutoff
_AT_COLS = ["tpr", "tnr", "fpr", "fnr", "ppv", "npv"]
_MAC_SQL = f"""WITH {LINEITEM_PRED_SQL},
{score_groups_sql('li_pred', LG)},
{roc_sql(LG)},
c AS (SELECT algorithm, outcome, threshold, tp, fp, P, N, {', '.join(f'{_R[k]} AS {k}' for k in ('tpr', 'tnr', 'fpr', 'fnr', 'ppv', 'npv', 'f1', 'dor', 'youden'))} FROM roc),
b AS (
  SELECT algorithm, outcome, MAX(P) AS P, MAX(N) AS N,
    FIRST(threshold ORDER BY youden DESC, threshold DESC) AS cutoff,
    {', '.join(f'FIRST({k} ORDER BY youden DESC, threshold DESC) AS {k}' for k in ('tpr', 'tnr', 'fpr', 'fnr', 'ppv', 'npv', 'f1', 'dor', 'tp', 'fp'))}
  FROM c GROUP BY algorithm, outcome)
SELECT algorithm, outcome, cutoff, {', '.join(r6(k, k) for k in _AT_COLS)}, round(f1, 6) AS fscore, round(dor, 6) AS odds,
  P, N, tp AS TP, N - fp AS TN, fp AS FP, P - tp AS FN,
  round({div('CAST(tp AS DOUBLE)', 'tp + fp')}, 6) AS precision,
  round({div('CAST(tp AS DOUBLE)', 'P')}, 6) AS recall,
  round({div(f"2*{div('CAST(tp AS DOUBLE)', 'tp + fp')}*{div('CAST(tp AS DOUBLE)', 'P')}", f"{div('CAST(tp AS DOUBLE)', 'tp + fp')} + {div('CAST(tp AS DOUBLE)', 'P')}")}, 6) AS f1_score
FROM b"""


@register("metrics_at_cutoff", _MAC_SQL)
def q_metrics_at_cutoff(spark, d):
    res = ev.evaluate(None, LG, sg=_li_sg(spark, d), index="youden")
    return rounded(res.select(*LG, F.col("cutoff_youden").alias("cutoff"), *_AT_COLS, "fscore", "odds",
                              "P", "N", "TP", "TN", "FP", "FN", "precision", "recall", "f1_score"))


# ------------------------------------------------------------- pr / auprc
_PR_SQL = f"""WITH {LINEITEM_PRED_SQL},
{score_groups_sql('li_pred', LG)}
SELECT algorithm, outcome, score AS threshold, round(CAST(tp AS DOUBLE) / (tp + fp), 6) AS precision,
       round({div('CAST(tp AS DOUBLE)', 'P')}, 6) AS recall FROM sg
UNION ALL
SELECT algorithm, outcome, CAST('inf' AS DOUBLE), 1.0, 0.0 FROM sg GROUP BY algorithm, outcome"""


@register("pr_points", _PR_SQL)
def q_pr_points(spark, d):
    return rounded(rt.pr_points(_li_sg(spark, d), LG))


_AUPRC_SQL = f"""WITH {LINEITEM_PRED_SQL},
{score_groups_sql('li_pred', LG)},
{roc_sql(LG)},
c AS (SELECT algorithm, outcome, threshold, tpr, {_R['ppv']} AS ppv, {_R['ppv_low']} AS pl, {_R['ppv_high']} AS ph,
        CAST(tp AS DOUBLE) / NULLIF(P, 0) AS rec, CAST(tp AS DOUBLE) / NULLIF(tp + fp, 0) AS prec FROM roc),
l AS (SELECT *, LAG(tpr) OVER w AS tpr0, LAG(ppv) OVER w AS ppv0, LAG(pl) OVER w AS pl0, LAG(ph) OVER w AS ph0,
        LAG(rec) OVER w AS rec0, LAG(prec) OVER w AS prec0
      FROM c WINDOW w AS (PARTITION BY algorithm, outcome ORDER BY threshold DESC))
SELECT algorithm, outcome,
  round(SUM(CASE WHEN ppv0 IS NOT NULL THEN (tpr - tpr0)*(ppv + ppv0)/2 ELSE 0 END), 6) AS auprc,
  round(SUM(CASE WHEN pl0 IS NOT NULL THEN (tpr - tpr0)*(pl + pl0)/2 ELSE 0 END), 6) AS auprc_cilow,
  round(SUM(CASE WHEN ph0 IS NOT NULL THEN (tpr - tpr0)*(ph + ph0)/2 ELSE 0 END), 6) AS auprc_cihigh,
  round(SUM(CASE WHEN rec0 IS NOT NULL THEN (rec - rec0)*(prec + coalesce(prec0, 1.0))/2 ELSE 0 END), 6) AS pr_auc
FROM l GROUP BY algorithm, outcome"""


@register("auprc", _AUPRC_SQL)
def q_auprc(spark, d):
    sg = _li_sg(spark, d)
    res = ev.evaluate(None, LG, sg=sg).select(*LG, "auprc", "auprc_cilow", "auprc_cihigh")
    return rounded(res.join(rt.pr_auc(sg, LG), LG))


# ------------------------------------------------------------------ wilson
_wl, _wh = wilson_sql("CAST(r AS DOUBLE)", "CAST(n AS DOUBLE)")
_WILSON_SQL = f"""WITH {ORDERS_SQL},
c AS (SELECT o_orderpriority, CAST(SUM(y) AS BIGINT) AS r, CAST(COUNT(*) AS BIGINT) AS n FROM ord GROUP BY o_orderpriority)
SELECT o_orderpriority, r, n, round({_wl}, 6) AS ci_low, round({_wh}, 6) AS ci_high FROM c"""


@register("wilson_ci", _WILSON_SQL)
def q_wilson(spark, d):
    c = orders_problem(spark, d).groupBy("o_orderpriority").agg(
        F.sum("y").cast("long").alias("r"), F.count(F.lit(1)).cast("long").alias("n"))
    lo, hi = wilson_bounds("r", "n")
    return rounded(c.select("o_orderpriority", "r", "n", lo.alias("ci_low"), hi.alias("ci_high")))


# ----------------------------------------------------------- sens_spec_ci
DOC_CUTOFF = 1000.0
_sl, _sh = wilson_sql("CAST(TP AS DOUBLE)", "CAST(TP + FN AS DOUBLE)")
_pl, _ph = wilson_sql("CAST(TN AS DOUBLE)", "CAST(TN + FP AS DOUBLE)")
_SS_SQL = f"""WITH {DOC_PRED_SQL},
c AS (SELECT outcome,
  CAST(SUM(CASE WHEN y = 1 AND score >= {DOC_CUTOFF} THEN 1 ELSE 0 END) AS BIGINT) AS TP,
  CAST(SUM(CASE WHEN y = 0 AND score >= {DOC_CUTOFF} THEN 1 ELSE 0 END) AS BIGINT) AS FP,
  CAST(SUM(CASE WHEN y = 1 AND score < {DOC_CUTOFF} THEN 1 ELSE 0 END) AS BIGINT) AS FN,
  CAST(SUM(CASE WHEN y = 0 AND score < {DOC_CUTOFF} THEN 1 ELSE 0 END) AS BIGINT) AS TN
  FROM doc_pred GROUP BY outcome)
SELECT outcome, TP, FP, FN, TN,
  round({div('CAST(TP AS DOUBLE)', 'TP + FN')}, 6) AS sensitivity, round({div('CAST(TN AS DOUBLE)', 'TN + FP')}, 6) AS specificity,
  round({_sl}, 6) AS sensitivity_low, round({_sh}, 6) AS sensitivity_high,
  round({_pl}, 6) AS specificity_low, round({_ph}, 6) AS specificity_high
FROM c"""


@register("sens_spec_ci", _SS_SQL)
def q_sens_spec(spark, d):
    p = doc_predictions(spark, d).withColumn("pred", predict_at_cutoff("score", DOC_CUTOFF))
    return rounded(rt.sens_spec_ci(rt.confusion_counts(p, DG)))


# ------------------------------------------------------- predict_at_cutoff
_PAC_SQL = f"""WITH {DOC_PRED_SQL}
SELECT doc_id, outcome, y, score, CAST(score >= {DOC_CUTOFF} AS INTEGER) AS pred FROM doc_pred"""


@register("predict_at_cutoff", _PAC_SQL)
def q_predict_at_cutoff(spark, d):
    return rounded(doc_predictions(spark, d).withColumn("pred", predict_at_cutoff("score", DOC_CUTOFF)))


# ---------------------------------------------- confusion / rates / accuracy
LI_CUT_SQL = "(CASE WHEN algorithm = 'price' THEN 36000.0 ELSE 25.0 END)"


def _li_pred_labels(spark, d):
    p = lineitem_predictions(spark, d)
    cut = F.when(F.col("algorithm") == "price", F.lit(36000.0)).otherwise(F.lit(25.0))
    return p.withColumn("pred", predict_at_cutoff("score", cut))


_LI_LABELS_SQL = f"""{LINEITEM_PRED_SQL},
lab AS (SELECT algorithm, outcome, y, score, CAST(score >= {LI_CUT_SQL} AS INTEGER) AS pred FROM li_pred),
cm AS (SELECT algorithm, outcome,
  CAST(SUM(CASE WHEN y = 1 AND pred = 1 THEN 1 ELSE 0 END) AS BIGINT) AS TP,
  CAST(SUM(CASE WHEN y = 0 AND pred = 1 THEN 1 ELSE 0 END) AS BIGINT) AS FP,
  CAST(SUM(CASE WHEN y = 1 AND pred = 0 THEN 1 ELSE 0 END) AS BIGINT) AS FN,
  CAST(SUM(CASE WHEN y = 0 AND pred = 0 THEN 1 ELSE 0 END) AS BIGINT) AS TN
  FROM lab GROUP BY algorithm, outcome)"""

_CM_SQL = f"""WITH {_LI_LABELS_SQL},
cells AS (
  SELECT algorithm, outcome, 0 AS y, 0 AS pred, TN AS cnt, TN + FP AS row_total, TP + FP + TN + FN AS total FROM cm
  UNION ALL SELECT algorithm, outcome, 0, 1, FP, TN + FP, TP + FP + TN + FN FROM cm
  UNION ALL SELECT algorithm, outcome, 1, 0, FN, TP + FN, TP + FP + TN + FN FROM cm
  UNION ALL SELECT algorithm, outcome, 1, 1, TP, TP + FN, TP + FP + TN + FN FROM cm)
SELECT algorithm, outcome, CAST(y AS INTEGER) AS y, CAST(pred AS INTEGER) AS pred, cnt AS count,
  round({div('CAST(cnt AS DOUBLE)', 'row_total')}, 6) AS rate, round({div('CAST(cnt AS DOUBLE)', 'total')}, 6) AS percentage
FROM cells"""


@register("confusion_matrix", _CM_SQL)
def q_confusion(spark, d):
    return rounded(rt.confusion_matrix(_li_pred_labels(spark, d), LG))


_CR = {
    "tpr": div("CAST(TP AS DOUBLE)", "TP + FN"), "fpr": div("CAST(FP AS DOUBLE)", "FP + TN"),
    "tnr": div("CAST(TN AS DOUBLE)", "TN + FP"), "fnr": div("CAST(FN AS DOUBLE)", "FN + TP"),
}
_CRP = "CAST(TP + FN AS DOUBLE)"
_CRN = "CAST(TN + FP AS DOUBLE)"
_cr_ppv = div(f"{_CR['tpr']}*{_CRP}", f"{_CR['tpr']}*{_CRP} + {_CR['fpr']}*{_CRN}")
_cr_npv = div(f"{_CR['tnr']}*{_CRN}", f"{_CR['tnr']}*{_CRN} + {_CR['fnr']}*{_CRP}")
_CRATES_SQL = f"""WITH {_LI_LABELS_SQL}
SELECT algorithm, outcome, TP, FP, TN, FN, {', '.join(r6(v, k) for k, v in _CR.items())},
  round({_cr_ppv}, 6) AS ppv, round({_cr_npv}, 6) AS npv,
  round({div(f'2*{_cr_ppv}*{_CR["tpr"]}', f'{_cr_ppv} + {_CR["tpr"]}')}, 6) AS f1,
  round({div(f"{_CR['tpr']}*{_CR['tnr']}", f"{_CR['fpr']}*{_CR['fnr']}")}, 6) AS dor,
  round({_CR['tpr']} + {_CR['tnr']} - 1, 6) AS youden_j
FROM cm"""


@register("classification_rates", _CRATES_SQL)
def q_class_rates(spark, d):
    return rounded(rt.classification_rates(rt.confusion_counts(_li_pred_labels(spark, d), LG)))


_MACRO_SQL = f"""WITH {LINEITEM_PRED_SQL},
lab AS (SELECT algorithm, outcome, y, CAST(score >= {LI_CUT_SQL} AS INTEGER) AS pred FROM li_pred),
per AS (SELECT algorithm, outcome, y, AVG(CASE WHEN pred = y THEN 1.0 ELSE 0.0 END) AS rec FROM lab GROUP BY algorithm, outcome, y)
SELECT algorithm, outcome, round(AVG(rec), 6) AS macro_recall FROM per GROUP BY algorithm, outcome"""


@register("macro_recall", _MACRO_SQL)
def q_macro_recall(spark, d):
    return rounded(rt.macro_recall(_li_pred_labels(spark, d), LG))


_ACC_SQL = f"""WITH {_LI_LABELS_SQL}
SELECT algorithm, outcome, round(CAST(TP + TN AS DOUBLE) / (TP + TN + FP + FN), 6) AS accuracy,
  round(CAST(TN + FP AS DOUBLE) / (TP + TN + FP + FN), 6) AS dummy_zero_accuracy,
  round(CAST(TP + FN AS DOUBLE) / (TP + TN + FP + FN), 6) AS dummy_one_accuracy
FROM cm"""


@register("accuracy", _ACC_SQL)
def q_accuracy(spark, d):
    return rounded(rt.accuracy(_li_pred_labels(spark, d), LG))


_DUMMY_SQL = f"""WITH {DOC_PRED_SQL}
SELECT outcome, CAST(0 AS INTEGER) AS constant, round(AVG(CASE WHEN y = 0 THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM doc_pred GROUP BY outcome
UNION ALL
SELECT outcome, CAST(1 AS INTEGER), round(AVG(CASE WHEN y = 1 THEN 1.0 ELSE 0.0 END), 6) FROM doc_pred GROUP BY outcome"""


@register("dummy_predict", _DUMMY_SQL)
def q_dummy(spark, d):
    p = doc_predictions(spark, d)
    outs = []
    for v in (0, 1):
        outs.append(p.groupBy("outcome").agg(
            F.lit(v).cast("int").alias("constant"),
            F.avg((dummy_predict(v) == F.col("y")).cast("double")).alias("accuracy")))
    return rounded(outs[0].unionByName(outs[1]))


# ------------------------------------------------------------- auc_z_test
_ZT_SQL = f"""WITH {_RANKS_SQL},
zz AS (SELECT algorithm, outcome, ((R - P*(P + 1)/2) / (P*N)) / sqrt((2*(P + N) - 1) / (P + N)) AS z FROM mw)
SELECT algorithm, outcome, round(z, 6) AS z, round({normal_sf_sql('z')}, 6) AS p_value FROM zz"""


@register("auc_z_test", _ZT_SQL)
def q_auc_z(spark, d):
    return rounded(rt.auc_z_test(_li_sg(spark, d), LG))


# ------------------------------------------------------- auc_delong_compare
_CMP_SQL = f"""WITH base AS (
  SELECT CAST(l_returnflag = 'R' AS INTEGER) AS y, l_extendedprice AS s1, l_quantity AS s2 FROM lineitem),
a1 AS (SELECT 'r' AS k, y, s1 AS score FROM base),
a2 AS (SELECT 'r' AS k, y, s2 AS score FROM base),
{score_groups_sql('a1', ['k'], 'g1')},
{score_groups_sql('a2', ['k'], 'g2')},
comp AS (
  SELECT b.y,
    CASE WHEN b.y = 1 THEN (CAST(g1.N AS DOUBLE) - g1.fp + g1.neg/2.0) / g1.N END AS a01,
    CASE WHEN b.y = 1 THEN (CAST(g2.N AS DOUBLE) - g2.fp + g2.neg/2.0) / g2.N END AS b01,
    CASE WHEN b.y = 0 THEN (g1.tp - g1.pos/2.0) / g1.P END AS a10,
    CASE WHEN b.y = 0 THEN (g2.tp - g2.pos/2.0) / g2.P END AS b10,
    CAST(g1.P AS DOUBLE) AS P, CAST(g1.N AS DOUBLE) AS N
  FROM base b JOIN g1 ON b.s1 = g1.score JOIN g2 ON b.s2 = g2.score),
cv AS (
  SELECT AVG(a01) AS auc1, AVG(b01) AS auc2,
    VAR_SAMP(a01)/MAX(P) + VAR_SAMP(a10)/MAX(N) AS s11,
    VAR_SAMP(b01)/MAX(P) + VAR_SAMP(b10)/MAX(N) AS s22,
    COVAR_SAMP(a01, b01)/MAX(P) + COVAR_SAMP(a10, b10)/MAX(N) AS s12
  FROM comp),
zz AS (SELECT auc1, auc2, abs(auc1 - auc2) / sqrt(s11 + s22 - 2*s12) AS z FROM cv)
SELECT round(auc1, 6) AS auc_1, round(auc2, 6) AS auc_2, round(z, 6) AS z,
  round(ln(2)/ln(10) + {log_sf_nonneg_sql('z')}/ln(10), 6) AS log10_p FROM zz"""


@register("auc_delong_compare", _CMP_SQL)
def q_delong_compare(spark, d):
    li = read_table(spark, d, "lineitem").select(
        (F.col("l_returnflag") == "R").cast("int").alias("y"),
        F.col("l_extendedprice").alias("s1"), F.col("l_quantity").alias("s2"))
    return rounded(rt.delong_compare(li, [], "y", "s1", "s2"))


# -------------------------------------------------------- auc_delong_matrix
_FIVE = {"price": "l_extendedprice", "qty": "l_quantity", "disc": "l_discount", "tax": "l_tax", "part": "CAST(l_partkey AS DOUBLE)"}


def _matrix_sql() -> str:
    n = list(_FIVE)
    place = ", ".join(f"""CASE WHEN y = 1 THEN (SUM(1 - y) OVER (ORDER BY {c}) - SUM(1 - y) OVER (PARTITION BY {c}) / 2.0) / N
      ELSE (P - SUM(y) OVER (ORDER BY {c}) + SUM(y) OVER (PARTITION BY {c}) / 2.0) / P END AS v_{c}""" for c in n)
    pairs = " UNION ALL ".join(f"""SELECT '{a}' AS score_i, '{b}' AS score_j, {int(a != b)} AS other,
      AVG(v_{a}) FILTER (y = 1) AS auc_i, AVG(v_{b}) FILTER (y = 1) AS auc_j, {_cov(a, b)} AS cov, {_cov(a, a)} AS vi, {_cov(b, b)} AS vj
      FROM v""" for i, a in enumerate(n) for b in n[i:])
    return f"""WITH base AS (SELECT CAST(l_returnflag = 'R' AS INTEGER) AS y, {', '.join(f'{e} AS {c}' for c, e in _FIVE.items())} FROM lineitem),
sized AS (SELECT *, CAST(SUM(y) OVER () AS DOUBLE) AS P, CAST(SUM(1 - y) OVER () AS DOUBLE) AS N FROM base),
v AS MATERIALIZED (SELECT y, P, N, {place} FROM sized),
pairs AS ({pairs}),
zz AS (SELECT *, CASE WHEN other = 1 THEN abs(auc_i - auc_j) / sqrt(vi + vj - 2 * cov) END AS z FROM pairs)
SELECT score_i, score_j, round(auc_i, 6) AS auc_i, round(auc_j, 6) AS auc_j, round(cov * 1e9, 6) AS cov_e9, round(z, 6) AS z,
  round(CASE WHEN z IS NOT NULL THEN ln(2)/ln(10) + {log_sf_nonneg_sql('z')}/ln(10) END, 6) AS log10_p FROM zz"""


def _cov(a: str, b: str) -> str:
    return f"(COVAR_SAMP(v_{a}, v_{b}) FILTER (y = 1) / MAX(P) + COVAR_SAMP(v_{a}, v_{b}) FILTER (y = 0) / MAX(N))"


@register("auc_delong_matrix", _matrix_sql())
def q_delong_matrix(spark, d):
    """Five scores of every lineitem, two of them of few values: all AUCs, covariances and tests at once."""
    li = read_table(spark, d, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("y"),
                                                 *[F.expr(e).alias(c) for c, e in _FIVE.items()])
    found = rt.delong_covariance(li, [], "y", list(_FIVE)).withColumn("cov_e9", F.col("cov") * 1e9)
    return rounded(found.select("score_i", "score_j", "auc_i", "auc_j", "cov_e9", "z", "log10_p"))

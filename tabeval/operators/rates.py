"""Cutoffs, PR curves, confusion-based rates and two-sample tests.

All per-group, all expressed as aggregates over score groups (see
``evaluate.score_groups``) or over a labelled predictions table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import inline_rows, named
from ..functions.normal import log_sf_nonneg, normal_sf, two_sided_p
from ..functions.scalar import wilson_bounds
from ..functions.stats import Z_975
from . import evaluate as ev
from .ordered import freeze, lookup, prefix_sum

_div = F.try_divide


def rank_sum_test(sg: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Wilcoxon rank-sum z (midranks, no tie correction) and two-sided p."""
    group = list(group)
    P, N = F.col("P").cast("double"), F.col("N").cast("double")
    midrank = (P + N) - (F.col("tp") + F.col("fp")) + (F.col("pos") + F.col("neg") + 1) / 2.0
    a = sg.groupBy(*group).agg(F.sum(F.col("pos") * midrank).alias("R"), F.first("P").alias("P"),
                               F.first("N").alias("N"))
    z = _div(F.col("R") - P * (P + N + 1.0) / 2.0, F.sqrt(P * N * (P + N + 1.0) / 12.0))
    return a.select(*group, z.alias("z")).withColumn("p_value", two_sided_p("z"))


def auc_z_test(sg: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Compatibility statistic z = AUC / sqrt((2n-1)/n), p = 1 - Phi(z) (not a test of AUC = 0.5)."""
    group = list(group)
    v01 = _div(F.col("N") - F.col("fp") + F.col("neg") / 2.0, F.col("N").cast("double"))
    a = sg.groupBy(*group).agg(
        _div(F.sum(F.col("pos") * v01), F.first("P").cast("double")).alias("auc"),
        (F.first("P") + F.first("N")).cast("double").alias("n"))
    return a.select(*group, (F.col("auc") / F.sqrt((2.0 * F.col("n") - 1.0) / F.col("n"))).alias("z")) \
        .withColumn("p_value", normal_sf("z"))


def best_cutoff(sg: DataFrame, group: Sequence[str] = (), index: str = "youden", z: float = Z_975) -> DataFrame:
    """Threshold maximising the criterion; ties -> highest threshold (first index)."""
    group = list(group)
    roc = ev.roc_points(sg, group)
    r = ev._rates(F.col("tpr"), F.col("fpr"), F.col("P").cast("double"), F.col("N").cast("double"), z)
    crit = r[index] if index == "youden" else F.coalesce(r[index], F.lit(0.0))
    t = roc.select(*group, "threshold", crit.alias("crit"))
    return t.groupBy(*group).agg(F.max_by("threshold", F.struct("crit", "threshold")).alias("cutoff"),
                                 F.max("crit").alias("criterion"))


def pr_points(sg: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Precision/recall at each distinct score plus the (recall 0, precision 1) end."""
    group = list(group)
    pts = sg.select(*group, F.col("score").alias("threshold"),
                    _div(F.col("tp").cast("double"), (F.col("tp") + F.col("fp")).cast("double")).alias("precision"),
                    _div(F.col("tp").cast("double"), F.col("P").cast("double")).alias("recall"))
    end = sg.groupBy(*group).agg(F.lit(float("inf")).alias("threshold")) \
        .select(*group, "threshold", F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return pts.unionByName(end)


def pr_auc(sg: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Trapezoid area under the precision-recall curve (x = recall)."""
    group = list(group)
    P = F.col("P").cast("double")
    rec = _div(F.col("tp").cast("double"), P)
    prec = _div(F.col("tp").cast("double"), (F.col("tp") + F.col("fp")).cast("double"))
    tp0 = F.col("tp") - F.col("pos")
    fp0 = F.col("fp") - F.col("neg")
    rec0 = _div(tp0.cast("double"), P)
    prec0 = F.when(tp0 + fp0 == 0, F.lit(1.0)).otherwise(_div(tp0.cast("double"), (tp0 + fp0).cast("double")))
    return sg.groupBy(*group).agg(F.sum((rec - rec0) * (prec + prec0) / 2.0).alias("pr_auc"))


def confusion_counts(df: DataFrame, group: Sequence[str] = (), y: str = "y", pred: str = "pred") -> DataFrame:
    group = list(group)
    yc, pc = F.col(y), F.col(pred)

    def cnt(cond: Column) -> Column:
        return F.sum(F.when(cond, 1).otherwise(0)).cast("long")
    return df.groupBy(*group).agg(cnt((yc == 1) & (pc == 1)).alias("TP"), cnt((yc == 0) & (pc == 1)).alias("FP"),
                                  cnt((yc == 1) & (pc == 0)).alias("FN"), cnt((yc == 0) & (pc == 0)).alias("TN"))


def confusion_matrix(df: DataFrame, group: Sequence[str] = (), y: str = "y", pred: str = "pred") -> DataFrame:
    """Dense 2x2 matrix: count, row-normalised rate and share of the total."""
    group = list(group)
    cc = confusion_counts(df, group, y, pred)
    cells = F.expr("stack(4, 0, 0, TN, TN + FP, 0, 1, FP, TN + FP, 1, 0, FN, TP + FN, 1, 1, TP, TP + FN)"
                   " as (y, pred, count, row_total)")
    out = cc.select(*group, (F.col("TP") + F.col("FP") + F.col("TN") + F.col("FN")).alias("total"), cells)
    return out.select(*group, F.col("y").cast("int").alias("y"), F.col("pred").cast("int").alias("pred"),
                      F.col("count").cast("long").alias("count"),
                      _div(F.col("count").cast("double"), F.col("row_total").cast("double")).alias("rate"),
                      _div(F.col("count").cast("double"), F.col("total").cast("double")).alias("percentage"))


def classification_rates(cc: DataFrame) -> DataFrame:
    """tpr, fpr, tnr, fnr, ppv, npv, f1, dor, Youden J from confusion counts."""
    TP, FP, TN, FN = (F.col(c).cast("double") for c in ("TP", "FP", "TN", "FN"))
    tpr, fpr, tnr, fnr = _div(TP, TP + FN), _div(FP, FP + TN), _div(TN, TN + FP), _div(FN, FN + TP)
    P, N = TP + FN, TN + FP
    ppv = _div(tpr * P, tpr * P + fpr * N)
    npv = _div(tnr * N, tnr * N + fnr * P)
    keep = [c for c in cc.columns if c not in ("TP", "FP", "TN", "FN")]
    return cc.select(*keep, "TP", "FP", "TN", "FN", tpr.alias("tpr"), fpr.alias("fpr"), tnr.alias("tnr"),
                     fnr.alias("fnr"), ppv.alias("ppv"), npv.alias("npv"),
                     _div(2.0 * ppv * tpr, ppv + tpr).alias("f1"), _div(tpr * tnr, fpr * fnr).alias("dor"),
                     (tpr + tnr - 1.0).alias("youden_j"))


def sens_spec_ci(cc: DataFrame, z: float = Z_975) -> DataFrame:
    TP, FP, TN, FN = (F.col(c) for c in ("TP", "FP", "TN", "FN"))
    sl, sh = wilson_bounds(TP, TP + FN, z)
    pl, ph = wilson_bounds(TN, TN + FP, z)
    keep = [c for c in cc.columns if c not in ("TP", "FP", "TN", "FN")]
    return cc.select(*keep, "TP", "FP", "FN", "TN",
                     _div(TP.cast("double"), (TP + FN).cast("double")).alias("sensitivity"),
                     _div(TN.cast("double"), (TN + FP).cast("double")).alias("specificity"),
                     sl.alias("sensitivity_low"), sh.alias("sensitivity_high"),
                     pl.alias("specificity_low"), ph.alias("specificity_high"))


def macro_recall(df: DataFrame, group: Sequence[str] = (), y: str = "y", pred: str = "pred") -> DataFrame:
    """Mean of per-class recall (two-level aggregate)."""
    group = list(group)
    per = df.groupBy(*group, y).agg(F.avg((F.col(pred) == F.col(y)).cast("double")).alias("rec"))
    return per.groupBy(*group).agg(F.avg("rec").alias("macro_recall"))


def accuracy(df: DataFrame, group: Sequence[str] = (), y: str = "y", pred: str = "pred") -> DataFrame:
    """Model accuracy and the two constant-baseline accuracies."""
    group = list(group)
    return df.groupBy(*group).agg(
        F.avg((F.col(pred) == F.col(y)).cast("double")).alias("accuracy"),
        F.avg((F.col(y) == 0).cast("double")).alias("dummy_zero_accuracy"),
        F.avg((F.col(y) == 1).cast("double")).alias("dummy_one_accuracy"))


def placements(df: DataFrame, group: Sequence[str], y: str, scores: Sequence[str]) -> DataFrame:
    """One row per example: g0, g1, ... (the group), y, P, N and v0, v1, ..., its placement under each score: the
    share of the other class that it beats, ties a half. Rows with any score missing don't count.

    All scores are ranked in one running sum over (group, score, value). A value's placement comes back to
    its rows by ``lookup``, so a score of few values, or of one hot one, doesn't skew.
    """
    groups = [f"g{i}" for i in range(len(group))]
    values = [named(c).cast("double") for c in scores]
    whole = named(y).isNotNull()
    for v in values:
        whole = whole & v.isNotNull() & ~F.isnan(v)
    rows = freeze(df.where(whole).select(*[named(g).alias(n) for g, n in zip(group, groups)], named(y).cast("int").alias("y"),
                                         *[(v + 0.0).alias(f"s{i}") for i, v in enumerate(values)],
                                         F.monotonically_increasing_id().alias("row")), "examples")
    long = inline_rows(rows, [{"model": F.lit(i), "score": F.col(f"s{i}")} for i in range(len(values))], [*groups, "y", "row"])
    counts = long.groupBy(*groups, "model", "score").agg(F.sum("y").cast("long").alias("pos"), F.sum(1 - F.col("y")).cast("long").alias("neg"))
    run = prefix_sum(counts, [*groups, "model"], ["score"], ["pos", "neg"], prefix="c_", totals_prefix="t_")
    beats = _div(F.col("c_neg") - F.col("neg") / 2.0, F.col("t_neg").cast("double"))
    beaten_by = _div(F.col("t_pos") - F.col("c_pos") + F.col("pos") / 2.0, F.col("t_pos").cast("double"))
    table = freeze(run.select(*groups, "model", "score", beats.alias("v1"), beaten_by.alias("v0"), F.col("t_pos").alias("P"),
                              F.col("t_neg").alias("N"), (F.col("pos") + F.col("neg")).alias("rows")), "placements")
    placed = lookup(long, table, [*groups, "model", "score"], "rows").withColumn("v", F.when(F.col("y") == 1, F.col("v1")).otherwise(F.col("v0")))
    return placed.groupBy(*groups, "y", "row").agg(F.max("P").alias("P"), F.max("N").alias("N"), *[
        F.max(F.when(F.col("model") == i, F.col("v"))).alias(f"v{i}") for i in range(len(values))]).drop("row")


def delong_covariance(df: DataFrame, group: Sequence[str], y: str, scores: Sequence[str]) -> DataFrame:
    """AUCs of any number of scores on the same rows and their DeLong covariances, one row per group and pair
    i <= j: the group, score_i, score_j, auc_i, auc_j, cov, and of two different scores z and log10_p of the
    test that their AUCs are equal.

    The covariance is that of the placements of each class over its size: sums and products of K columns
    (their Gram block) in one aggregate.
    """
    group, scores = list(group), list(scores)
    groups = [f"g{i}" for i in range(len(group))]
    k = len(scores)
    own = [F.col(f"v{i}") - 0.5 for i in range(k)]  # placements lie in 0..1: centred, products lose nothing
    gram = placements(df, group, y, scores).groupBy(*groups, "y").agg(
        F.count(F.lit(1)).cast("double").alias("n"), *[F.sum(own[i]).alias(f"t{i}") for i in range(k)],
        *[F.sum(own[i] * own[j]).alias(f"t{i}_{j}") for i in range(k) for j in range(i, k)])

    def cov(i: int, j: int) -> Column:  # of one class's mean placements
        return _div(_div(F.col(f"t{i}_{j}") - F.col(f"t{i}") * F.col(f"t{j}") / F.col("n"), F.col("n") - 1.0), F.col("n"))

    pairs = inline_rows(gram, [{"i": F.lit(i), "j": F.lit(j), "cov": cov(i, j), "var_i": cov(i, i), "var_j": cov(j, j),
                                "a": F.col(f"t{i}") / F.col("n") + 0.5, "b": F.col(f"t{j}") / F.col("n") + 0.5}
                               for i in range(k) for j in range(i, k)], [*groups, "y"])
    whole = pairs.groupBy(*groups, "i", "j").agg(
        F.max(F.when(F.col("y") == 1, F.col("a"))).alias("auc_i"), F.max(F.when(F.col("y") == 1, F.col("b"))).alias("auc_j"),
        # both classes, or the sums tell nothing
        *[F.when(F.count(F.lit(1)) == 2, F.sum(c)).alias(c) for c in ("cov", "var_i", "var_j")])
    names = F.array(*[F.lit(c) for c in scores])
    z = F.when(F.col("i") < F.col("j"), _div(F.abs(F.col("auc_i") - F.col("auc_j")), F.sqrt(F.col("var_i") + F.col("var_j") - 2.0 * F.col("cov"))))
    return whole.withColumn("z", z).select(
        *[F.col(n).alias(g) for n, g in zip(groups, group)], names[F.col("i")].alias("score_i"), names[F.col("j")].alias("score_j"),
        "auc_i", "auc_j", "cov", "z").withColumn("log10_p", F.log10(F.lit(2.0)) + log_sf_nonneg("z") / F.log(F.lit(10.0)))


def delong_compare(df: DataFrame, group: Sequence[str], y: str, s1: str, s2: str) -> DataFrame:
    """DeLong test that two scores on the same rows have equal AUC: z and log10 p."""
    found = delong_covariance(df, group, y, [s1, s2]).where(F.col("z").isNotNull() | (F.col("score_i") != F.col("score_j")))
    return found.select(*[named(g) for g in group], F.col("auc_i").alias("auc_1"), F.col("auc_j").alias("auc_2"), "z", "log10_p")

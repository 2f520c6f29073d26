"""ROC, threshold and test statistics over a predictions table.

Every function takes a DataFrame with label ``y`` (0/1), ``score`` (double) and
any number of ``group`` columns (experiment, algorithm, outcome, fold, ...), so
all models x outcomes x folds are evaluated in one Spark job.

Plan shape: rows -> score groups (partial aggregate, one row per distinct score
per group) -> distributed running sums (``prefix_sum``) -> one grouped aggregate
that yields AUC, DeLong variance, rank-sum statistic, AUPRC, all four cutoffs and
the metrics at the chosen cutoff (``max_by`` over the threshold rows). No global
window, no per-row Python. ``evaluate`` of plain rows (no score groups given) takes the
same sums from sorted ranges that tasks merge (``scored``), without a row per score.

Arithmetic mirrors the published formulas (tpr = tp/P, tnr = 1 - fpr,
ppv = tpr*P / (tpr*P + fpr*N), ...) so that ties in the cutoff criteria break
exactly as the reference's floating point does; divisions by zero give NULL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normal import two_sided_p
from ..functions.scalar import wilson_high, wilson_low
from ..functions.stats import Z_975
from . import scored
from .ordered import group_totals, prefix_sum

INF = float("inf")


def _div(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def clean_predictions(df: DataFrame, y: str = "y", score: str = "score") -> DataFrame:
    """Drop rows whose label or score is NULL/NaN (the reference drops NaN pairs)."""
    return df.where(F.col(y).isNotNull() & F.col(score).isNotNull() & ~F.isnan(F.col(score))
                    & ~F.isnan(F.col(y).cast("double")))


def score_groups(df: DataFrame, group: Sequence[str] = (), y: str = "y", score: str = "score") -> DataFrame:
    """One row per (group, distinct score) with p, n and inclusive running tp, fp
    in descending score order, plus the group totals P, N."""
    group = list(group)
    g = (clean_predictions(df, y, score)
         .groupBy(*group, F.col(score).cast("double").alias("score"))
         .agg(F.sum(F.col(y).cast("long")).alias("pos"),
              F.sum(1 - F.col(y).cast("long")).alias("neg")))
    run = prefix_sum(g, group, ["score"], ["pos", "neg"], descending=True, prefix="cum_", totals_prefix="tot_")
    sg = run.select(*group, "score", "pos", "neg",
                    F.col("cum_pos").alias("tp"), F.col("cum_neg").alias("fp"),
                    F.col("tot_pos").alias("P"), F.col("tot_neg").alias("N"))
    sg._tabeval_totals = run._tabeval_totals
    sg._tabeval_totals_map = {"P": "tot_pos", "N": "tot_neg"}
    return sg


def _group_totals(sg: DataFrame, group: Sequence[str]) -> DataFrame:
    """(group, P, N) from the small totals table kept with the score groups."""
    return group_totals(sg, group, ["P", "N"])


def roc_points(sg: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """fpr/tpr at every distinct score plus the (0, 0) point at threshold +inf."""
    group = list(group)
    start = _group_totals(sg, group).select(
        *group, F.lit(INF).alias("threshold"), F.lit(0).cast("long").alias("tp"),
        F.lit(0).cast("long").alias("fp"), "P", "N", F.lit(0).cast("long").alias("pos"),
        F.lit(0).cast("long").alias("neg"))
    pts = sg.select(*group, F.col("score").alias("threshold"), "tp", "fp", "P", "N", "pos", "neg")
    out = start.unionByName(pts)
    return out.select(*group, "threshold", "tp", "fp", "P", "N", "pos", "neg",
                      _div(F.col("tp").cast("double"), F.col("P")).alias("tpr"),
                      _div(F.col("fp").cast("double"), F.col("N")).alias("fpr"))


def drop_collinear(sg: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Parity option (Q11): keep only ROC vertices where the curve bends, as the
    reference's ROC library does by default. An interior vertex i is dropped
    when the second differences of fp and tp are both 0, i.e. when the next
    score group has the same (pos, neg) counts; the last vertex always stays.
    The next group is found by its ordinal (distributed running count), an
    equi-join on (group, ordinal + 1)."""
    group = list(group)
    ords = prefix_sum(sg.withColumn("_one", F.lit(1).cast("long")), group, ["score"], ["_one"], descending=True,
                      prefix="_o")
    cur = ords.drop("_one").withColumnRenamed("_o_one", "_ord")
    nxt = ords.select(*group, (F.col("_o_one") - 1).alias("_ord"), F.col("pos").alias("_npos"),
                      F.col("neg").alias("_nneg"))
    j = cur.join(nxt, [*group, "_ord"], "left")
    keep = F.col("_npos").isNull() | (F.col("_ord") == 1) | (F.col("_npos") != F.col("pos")) | (F.col("_nneg") != F.col("neg"))
    out = j.where(keep).drop("_ord", "_npos", "_nneg")
    out._tabeval_totals = getattr(sg, "_tabeval_totals", None)
    out._tabeval_totals_map = getattr(sg, "_tabeval_totals_map", {})
    return out


def _rates(tpr: Column, fpr: Column, P: Column, N: Column, z: float) -> dict[str, Column]:
    fnr = 1.0 - tpr
    tnr = 1.0 - fpr
    TP = tpr * P
    ppv = _div(TP, TP + fpr * N)
    npv = _div(tnr * N, tnr * N + fnr * P)
    f1 = _div(2.0 * ppv * tpr, ppv + tpr)
    dor = _div(tpr * tnr, fpr * fnr)
    n_ppv = TP + fpr * N
    return {
        "tpr": tpr, "tnr": tnr, "fpr": fpr, "fnr": fnr, "ppv": ppv, "npv": npv, "f1": f1, "dor": dor,
        "tpr_low": wilson_low(TP, P, z), "tpr_high": wilson_high(TP, P, z),
        "ppv_low": wilson_low(TP, n_ppv, z), "ppv_high": wilson_high(TP, n_ppv, z),
        "youden": tpr + tnr,
        "mcc": F.sqrt(tpr * tnr * ppv * npv) - F.sqrt((1.0 - ppv) * fnr * fpr * (1.0 - npv)),
        "ji": _div(TP, TP + fnr * P + fpr * N),
    }


THRESHOLD_COLS = ["tpr", "tnr", "ppv", "npv", "f1", "dor", "tpr_low", "tpr_high", "ppv_low", "ppv_high"]


def threshold_table(roc: DataFrame, group: Sequence[str] = (), z: float = Z_975,
                    extra: Sequence[str] = ()) -> DataFrame:
    """Per-threshold tpr, tnr, ppv, npv, f1, dor and Wilson CIs of tpr and ppv."""
    group = list(group)
    r = _rates(F.col("tpr"), F.col("fpr"), F.col("P").cast("double"), F.col("N").cast("double"), z)
    cols = THRESHOLD_COLS + list(extra)
    return roc.select(*group, "threshold", *[r[c].alias(c) for c in cols])


def _crit(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0.0)) if name != "youden" else F.col(name)


CUTOFF_INDEXES = ("youden", "mcc", "ji", "f1")


def evaluate(df: DataFrame, group: Sequence[str] = (), y: str = "y", score: str = "score",
             index: str = "youden", z: float = Z_975, sg: DataFrame | None = None) -> DataFrame:
    """One metric record per group: AUC + DeLong CI, rank-sum p, AUPRC (+ Wilson
    bounds), the four cutoffs, and rates/counts at the ``index`` cutoff."""
    if index not in CUTOFF_INDEXES:
        raise ValueError(f"index must be one of {CUTOFF_INDEXES}")
    group = list(group)
    if sg is None and scored.groupable(df, group):
        return _records(_merged(df, group, y, score, index, z), group, z)
    if sg is None:
        sg = score_groups(df, group, y, score)
    roc = roc_points(sg, group)
    P = F.col("P").cast("double")
    N = F.col("N").cast("double")
    real = F.col("threshold") != F.lit(INF)
    r = _rates(F.col("tpr"), F.col("fpr"), P, N, z)
    # previous curve point of each score group = running sums minus the group
    prev_tpr = _div((F.col("tp") - F.col("pos")).cast("double"), F.col("P"))
    prev_fpr = _div((F.col("fp") - F.col("neg")).cast("double"), F.col("N"))
    pr = _rates(prev_tpr, prev_fpr, P, N, z)
    has_prev = real & ((F.col("tp") - F.col("pos") + F.col("fp") - F.col("neg")) > 0)
    dx = F.col("tpr") - prev_tpr
    v01 = _div(N - F.col("fp") + F.col("neg") / 2.0, N)
    v10 = _div(F.col("tp") - F.col("pos") / 2.0, P)
    midrank = (P + N) - (F.col("tp") + F.col("fp")) + (F.col("pos") + F.col("neg") + 1) / 2.0

    t = roc.select("*", *[r[k].alias(k) for k in ("tnr", "fnr", "ppv", "npv", "f1", "dor", "youden", "mcc", "ji")])
    at_cut = F.struct(*[F.col(c) for c in ("tpr", "tnr", "fpr", "fnr", "ppv", "npv", "f1", "dor", "tp", "fp")])

    def when_real(c: Column) -> Column:
        return F.when(real, c).otherwise(F.lit(0.0))

    # DeLong components lie in [0, 1]: sums of squares centred at 0.5 keep the
    # one-pass (weighted) sample variance numerically stable
    aggs = [
        F.first("P").alias("P"), F.first("N").alias("N"),
        F.sum(when_real(F.col("pos") * v01)).alias("_s01"),
        F.sum(when_real(F.col("pos") * (v01 - 0.5) * (v01 - 0.5))).alias("_q01"),
        F.sum(when_real(F.col("neg") * v10)).alias("_s10"),
        F.sum(when_real(F.col("neg") * (v10 - 0.5) * (v10 - 0.5))).alias("_q10"),
        F.sum(when_real(F.col("pos") * midrank)).alias("_rpos"),
        F.sum(F.when(has_prev, dx * (r["ppv"] + pr["ppv"]) / 2.0).otherwise(0.0)).alias("auprc"),
        F.sum(F.when(has_prev, dx * (r["ppv_low"] + pr["ppv_low"]) / 2.0).otherwise(0.0)).alias("auprc_cilow"),
        F.sum(F.when(has_prev, dx * (r["ppv_high"] + pr["ppv_high"]) / 2.0).otherwise(0.0)).alias("auprc_cihigh"),
    ]
    # argmax over (criterion, threshold): on equal criteria the highest threshold
    # wins, i.e. the first index of the descending curve (+inf point included)
    for name in ("mcc", "youden", "f1", "ji"):
        aggs.append(F.max_by("threshold", F.struct(_crit(name), F.col("threshold"))).alias(f"cutoff_{name}"))
    aggs.append(F.max_by(at_cut, F.struct(_crit(index), F.col("threshold"))).alias("_at"))
    return _records(t.groupBy(*group).agg(*aggs), group, z)


def _merged(df: DataFrame, group: Sequence[str], y: str, score: str, index: str, z: float) -> DataFrame:
    """What ``evaluate`` adds up over score groups, from sorted ranges that tasks merge (``scored``)."""
    m = scored.measured(clean_predictions(df, y, score), group, y, score, z)
    cuts = {c: F.max_by(F.struct(F.col(f"t_{c}").alias("t"), F.col(f"tp_{c}").alias("tp"), F.col(f"fp_{c}").alias("fp")),
                        F.struct(F.col(f"c_{c}"), F.col(f"t_{c}"))).alias(f"_{c}") for c in CUTOFF_INDEXES}
    a = m.groupBy(*group).agg(F.first("P").alias("P"), F.first("N").alias("N"), *[F.sum(c).alias(c) for c in scored.SUMS],
                              *[F.max(f"c_{c}").alias(f"_c_{c}") for c in CUTOFF_INDEXES], *cuts.values())
    P, N = F.col("P").cast("double"), F.col("N").cast("double")

    def at(tp: Column, fp: Column) -> dict[str, Column]:
        tpr, fpr = _div(tp.cast("double"), F.col("P")), _div(fp.cast("double"), F.col("N"))
        return {**_rates(tpr, fpr, P, N, z), "tp": tp, "fp": fp}
    # the curve's first point, at threshold +inf: it wins where no score does better, the highest threshold being taken
    start, zero = {}, F.lit(0).cast("long")
    for c in CUTOFF_INDEXES:
        first = at(zero, zero)[c]
        own, best = (first, F.col(f"_c_{c}")) if c == "youden" else (F.coalesce(first, F.lit(0.0)), F.col(f"_c_{c}"))
        start[c] = best.isNull() | (own >= best)
    cutoffs = [F.when(start[c], F.lit(INF)).otherwise(F.col(f"_{c}")["t"]).alias(f"cutoff_{c}") for c in CUTOFF_INDEXES]
    cut = at(*[F.when(start[index], zero).otherwise(F.col(f"_{index}")[k]) for k in ("tp", "fp")])
    point = F.struct(*[cut[c].alias(c) for c in ("tpr", "tnr", "fpr", "fnr", "ppv", "npv", "f1", "dor", "tp", "fp")])
    return a.select(*group, "P", "N", *scored.SUMS, *cutoffs, point.alias("_at"))


def _records(a: DataFrame, group: Sequence[str], z: float) -> DataFrame:
    """A metric record per group from its sums, its cutoffs and the rates at the chosen one."""
    Pd, Nd = F.col("P").cast("double"), F.col("N").cast("double")
    auc = _div(F.col("_s01"), Pd)
    m01 = auc
    m10 = _div(F.col("_s10"), Nd)
    var01 = _div(F.col("_q01") - Pd * (m01 - 0.5) * (m01 - 0.5), Pd - 1.0)
    var10 = _div(F.col("_q10") - Nd * (m10 - 0.5) * (m10 - 0.5), Nd - 1.0)
    var = F.greatest(_div(var01, Pd) + _div(var10, Nd), F.lit(0.0))
    std = F.sqrt(var)
    ok = (std > 0)
    rank_z = _div(F.col("_rpos") - Pd * (Pd + Nd + 1.0) / 2.0, F.sqrt(Pd * Nd * (Pd + Nd + 1.0) / 12.0))
    two_class = (F.col("P") > 0) & (F.col("N") > 0)
    at = F.col("_at")
    TP = at["tp"]
    FP = at["fp"]
    FN = F.col("P") - at["tp"]
    TN = F.col("N") - at["fp"]
    precision = _div(TP.cast("double"), (TP + FP).cast("double"))
    recall = _div(TP.cast("double"), (TP + FN).cast("double"))
    out = a.select(
        *group,
        F.when(two_class, auc).alias("auc"),
        F.when(two_class, rank_z).alias("_rz"),
        F.when(two_class & ok, auc - z * std).alias("auc_cilow"),
        F.when(two_class & ok, F.least(auc + z * std, F.lit(1.0))).alias("auc_cihigh"),
        F.when(two_class, var).alias("auc_var"),
        F.when(two_class, F.col("auprc")).alias("auprc"),
        F.when(two_class, F.col("auprc_cilow")).alias("auprc_cilow"),
        F.when(two_class, F.col("auprc_cihigh")).alias("auprc_cihigh"),
        "cutoff_mcc", "cutoff_youden", "cutoff_f1", "cutoff_ji",
        at["tpr"].alias("tpr"), at["tnr"].alias("tnr"), at["fpr"].alias("fpr"), at["fnr"].alias("fnr"),
        at["ppv"].alias("ppv"), at["npv"].alias("npv"), at["f1"].alias("fscore"), at["dor"].alias("odds"),
        F.col("P").cast("long").alias("P"), F.col("N").cast("long").alias("N"),
        TP.cast("long").alias("TP"), TN.cast("long").alias("TN"),
        FP.cast("long").alias("FP"), FN.cast("long").alias("FN"),
        precision.alias("precision"), recall.alias("recall"),
        _div(2.0 * precision * recall, precision + recall).alias("f1_score"),
    )
    return out.withColumn("p_value", two_sided_p("_rz")).drop("_rz")


def auc_table(sg: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """AUC (Mann-Whitney with midranks) per group from score groups."""
    group = list(group)
    v01 = _div(F.col("N") - F.col("fp") + F.col("neg") / 2.0, F.col("N").cast("double"))
    return sg.groupBy(*group).agg(
        _div(F.sum(F.col("pos") * v01), F.first("P").cast("double")).alias("auc"))


def midranks(sg: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Average (1-based, ascending) rank of each distinct score within its group."""
    group = list(group)
    return sg.select(*group, "score", (F.col("pos") + F.col("neg")).alias("cnt"),
                     ((F.col("P") + F.col("N")) - (F.col("tp") + F.col("fp"))
                      + (F.col("pos") + F.col("neg") + 1) / 2.0).alias("midrank"))

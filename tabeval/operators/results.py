"""Result tables, leaderboards, cross-experiment comparison and
the per-fold train/test metric table behind the cross-validation averages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import unpivot
from . import evaluate as ev
from . import rates as rt

#: fixed values: the column names of the result table, test side then train side
TEST_COLS = ["AUROC Score", "AUROC CI Lower", "AUROC CI Upper", "Accuracy", "Precision", "Recall", "F1 Score",
             "TPR", "TNR", "FPR", "FNR", "PPV", "NPV", "TP", "FP", "TN", "FN", "Cutoff value", "P", "N"]
TRAIN_COLS = ["AUROC Score (Train)", "AUROC CI Lower (Train)", "AUROC CI Upper (Train)", "P (Train)", "N (Train)",
              "TP (Train)", "FP (Train)", "TN (Train)", "FN (Train)"]
KEY_COLS = ["Outcome", "Algorithm"]


def metric_record(res: DataFrame, group: Sequence[str], index: str = "youden") -> DataFrame:
    """Map an ``evaluate`` record to the result table's names; ``index`` is the cutoff it was made with."""
    n = (F.col("P") + F.col("N")).cast("double")
    return res.select(
        *group,
        F.col("auc").alias("AUROC Score"), F.col("auc_cilow").alias("AUROC CI Lower"),
        F.col("auc_cihigh").alias("AUROC CI Upper"),
        F.try_divide((F.col("TP") + F.col("TN")).cast("double"), n).alias("Accuracy"),
        F.col("precision").alias("Precision"), F.col("recall").alias("Recall"), F.col("f1_score").alias("F1 Score"),
        F.col("tpr").alias("TPR"), F.col("tnr").alias("TNR"), F.col("fpr").alias("FPR"), F.col("fnr").alias("FNR"),
        F.col("ppv").alias("PPV"), F.col("npv").alias("NPV"), "TP", "FP", "TN", "FN",
        F.col(f"cutoff_{index}").alias("Cutoff value"), "P", "N")


def results_table(preds: DataFrame, outcome: str = "outcome", algorithm: str = "algorithm", split: str = "split",
                  y: str = "y", score: str = "score", index: str = "youden") -> DataFrame:
    """One row per (outcome, algorithm): test metrics at the cutoff of ``index``, train AUROC/CI/counts
    and ``Train vs. Test AUROC change%``; train and test evaluated in one job."""
    g = [outcome, algorithm, split]
    # one row per (outcome, algorithm, split): computed once, read by both sides
    rec = metric_record(ev.evaluate(preds, g, y, score, index=index), g, index).checkpoint(eager=True)
    test = rec.where(F.col(split) == "test").drop(split) \
        .withColumnRenamed(outcome, "Outcome").withColumnRenamed(algorithm, "Algorithm")
    tr = rec.where(F.col(split) == "train").select(
        F.col(outcome).alias("Outcome"), F.col(algorithm).alias("Algorithm"),
        *[F.col(c.replace(" (Train)", "")).alias(c) for c in TRAIN_COLS])
    out = test.join(tr, KEY_COLS, "left")
    change = F.try_divide(F.col("AUROC Score (Train)") - F.col("AUROC Score"), F.col("AUROC Score (Train)")) * 100.0
    return out.select(*KEY_COLS, *TEST_COLS, *TRAIN_COLS, change.alias("Train vs. Test AUROC change%"))


def leaderboard(results: DataFrame, by: str = "AUROC Score", within: Sequence[str] = ("Outcome",)) -> DataFrame:
    """Models ordered by the test score inside each outcome; rank 1 is the best."""
    w = Window.partitionBy(*within).orderBy(F.col(by).desc_nulls_last(), F.col("Algorithm"))
    return results.withColumn("rank", F.row_number().over(w)).withColumn("is_best", F.col("rank") == 1)


def tag_results(results: DataFrame, exp_name: str, test_set: str) -> DataFrame:
    """Add experiment keys and the CI gaps used for error bars."""
    return results.select(
        F.lit(exp_name).alias("Exp_Name"), F.lit(test_set).alias("Test Set"), "*",
        (F.col("AUROC CI Upper") - F.col("AUROC Score")).alias("Upper_CI_Gap"),
        (F.col("AUROC Score") - F.col("AUROC CI Lower")).alias("Lower_CI_Gap"),
        (F.col("AUROC CI Upper (Train)") - F.col("AUROC Score (Train)")).alias("Upper_CI_Gap (Train)"),
        (F.col("AUROC Score (Train)") - F.col("AUROC CI Lower (Train)")).alias("Lower_CI_Gap (Train)"))


def compare_results(total: DataFrame | None, new: DataFrame) -> DataFrame:
    """Union a tagged result table into the running comparison; an
    (experiment, test set) pair already present is not added again."""
    if total is None:
        return new
    keys = ["Exp_Name", "Test Set"]
    fresh = new.join(total.select(*keys).distinct(), keys, "left_anti")
    return total.unionByName(fresh, allowMissingColumns=True)


def remove_result(total: DataFrame, exp_name: str, test_set: str) -> DataFrame:
    return total.where(~((F.col("Exp_Name") == exp_name) & (F.col("Test Set") == test_set)))


NON_METRIC = {"Exp_Name", "Test Set", "Outcome", "Algorithm", "Upper_CI_Gap", "Lower_CI_Gap",
              "Upper_CI_Gap (Train)", "Lower_CI_Gap (Train)"}


def filter_results(total: DataFrame, algorithms: Sequence[str] | None = None, outcomes: Sequence[str] | None = None,
                   metrics: Sequence[str] | None = None) -> DataFrame:
    """Keep chosen algorithms/outcomes; return a metric-long view (keys, metric, value)."""
    df = total
    if algorithms:
        df = df.where(F.col("Algorithm").isin(*algorithms))
    if outcomes:
        df = df.where(F.col("Outcome").isin(*outcomes))
    mets = list(metrics) if metrics else [c for c in df.columns if c not in NON_METRIC]
    return unpivot(df, mets, "double", "metric", "value", ["Exp_Name", "Test Set", "Outcome", "Algorithm"])


def fold_split_metrics(preds: DataFrame, fold: str, k: int, cutoff: float, y: str = "y",
                       score: str = "score") -> DataFrame:
    """For every fold k: the 'test' rows are fold k, the 'train' rows all others.
    AUC, accuracy, tpr, tnr per (k, split) in one pass over the expanded table."""
    ex = preds.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))) \
        .withColumn("split", F.when(F.col(fold) == F.col("k"), F.lit("test")).otherwise(F.lit("train"))) \
        .withColumn("pred", (F.col(score) >= cutoff).cast("int"))
    g = ["k", "split"]
    auc = ev.auc_table(ev.score_groups(ex, g, y, score), g)
    cc = rt.classification_rates(rt.confusion_counts(ex, g, y, "pred"))
    acc = rt.accuracy(ex, g, y, "pred").select(*g, "accuracy")
    return auc.join(acc, g).join(cc.select(*g, "tpr", "tnr"), g)


def cv_metric_average(per_fold: DataFrame, group: Sequence[str], metrics: Sequence[str],
                      override: DataFrame | None = None) -> DataFrame:
    """Mean of each metric over folds (finite values only; NULL if none),
    per group (e.g. algorithm, outcome, split), with the number of folds.
    ``override`` (group keys + auc, auc_cilow, auc_cihigh, e.g. from the
    averaged ROC) replaces the averaged AUC and adds its CI."""
    from .profile import finite_mean
    group = list(group)
    avg = per_fold.groupBy(*group).agg(*[finite_mean(m).alias(m) for m in metrics],
                                       F.count(F.lit(1)).cast("long").alias("n_folds"))
    if override is None:
        return avg
    o = override.select(*group, F.col("auc").alias("_auc_o"), F.col("auc_cilow"), F.col("auc_cihigh"))
    j = avg.join(o, group, "left")
    return j.withColumn("auc", F.coalesce("_auc_o", "auc")).drop("_auc_o")

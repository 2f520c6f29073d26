"""Feature selection.

Scores come from one aggregate per class over all features (count, sum, sum of
squares), unpivoted to a (feature, score) table of p rows; ranking that small
table is bounded by the number of features.

* ANOVA F (the f_classif definition: between / within mean squares);
* chi2 of feature mass per class vs. class share of the total mass (features
  must be non-negative, Q17);
* percentile cut with the public tie rule (scores above the percentile, then
  tied features up to int(p * percentile / 100));
* variance > threshold (population variance);
* MRMR: greedy, relevance F over mean |corr| with the already chosen set;
* RFECV lives with the models (it needs fits).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import aggregate_rows, named
from .clean import correlation_pairs, stacked_aggregate
from .ordered import attach


def _class_moments(df: DataFrame, features: Sequence[str], y: str) -> DataFrame:
    """Long table (class, feature, rows, n, mean, var, s): per class the rows and, of each
    feature, the non-missing values' count, mean, population variance and sum (NULL and NaN
    are missing): grouped aggregates with map-side partial aggregation."""
    entries = []
    for f in features:
        x = named(f).cast("double")
        x = F.when(~F.isnan(x), x)
        entries.append(({"feature": F.lit(f)}, {"rows": F.count(F.lit(1)).cast("double"), "n": F.count(x).cast("double"),
                                                "mean": F.avg(x), "var": F.var_pop(x), "s": F.sum(x)}))
    return aggregate_rows(df, entries, [named(y).alias("class")])


def f_scores(df: DataFrame, features: Sequence[str], y: str) -> DataFrame:
    """(feature, score) with the ANOVA F statistic over each feature's non-missing values, from class
    means and variances (nothing cancels where values lie far from zero). NULL for fewer than two
    classes; a feature constant within every class but not between them gives NULL as well."""
    m = _class_moments(df, features, y).where("n > 0")
    grand = m.groupBy("feature").agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("grand"))
    t = m.join(F.broadcast(grand), "feature").groupBy("feature").agg(  # one row per feature
        F.sum("n").alias("N"), F.count(F.lit(1)).alias("C"), F.sum(F.col("n") * F.col("var")).alias("within"),
        F.sum(F.col("n") * (F.col("mean") - F.col("grand")) * (F.col("mean") - F.col("grand"))).alias("between"))
    msb = F.try_divide(F.col("between"), F.col("C") - 1)
    msw = F.try_divide(F.col("within"), F.col("N") - F.col("C"))
    names = df.sparkSession.createDataFrame([(f,) for f in features], "feature string")
    return names.join(t, "feature", "left").select("feature", F.try_divide(msb, msw).alias("score"))


def chi2_scores(df: DataFrame, features: Sequence[str], y: str) -> DataFrame:
    """(feature, score): sum over classes of (observed - expected)^2 / expected,
    observed = feature mass in the class, expected = class share x total mass."""
    low = stacked_aggregate(df, [(f, F.min(named(f)).cast("double")) for f in features], "low")
    bad = [r["column"] for r in low.where("low < 0").collect()]  # names of features
    if bad:
        raise ValueError(f"chi2 needs non-negative features; negative values in {bad}")
    m = _class_moments(df, features, y)
    w = Window.partitionBy("feature")
    tot_n = F.sum("rows").over(w)
    tot_s = F.sum("s").over(w)
    e = m.select("feature", "s", (F.col("rows") / tot_n * tot_s).alias("e"))
    return e.groupBy("feature").agg(F.sum(F.try_divide((F.col("s") - F.col("e")) ** 2, F.col("e"))).alias("score"))


def _order_index(spark, features: Sequence[str]) -> DataFrame:
    return spark.createDataFrame([(f, i) for i, f in enumerate(features)], "feature string, idx int")


def select_k_best(scores: DataFrame, features: Sequence[str], k: int) -> DataFrame:
    """Top-k by score; among equal scores the later feature wins (stable
    ascending sort, keep the last k). Adds ``rank`` and ``selected``."""
    idx = _order_index(scores.sparkSession, features)
    s = scores.join(F.broadcast(idx), "feature")  # p rows: bounded by the feature count
    w = Window.orderBy(F.col("score").desc_nulls_last(), F.col("idx").desc())  # p rows
    return s.withColumn("rank", F.row_number().over(w)).withColumn("selected", F.col("rank") <= k).drop("idx")


def select_percentile(scores: DataFrame, features: Sequence[str], percentile: float) -> DataFrame:
    """Scores strictly above the (100 - percentile) quantile, then ties at the
    quantile in feature order up to int(p * percentile / 100) kept overall."""
    p = len(features)
    idx = _order_index(scores.sparkSession, features)
    s = scores.join(F.broadcast(idx), "feature")
    thr = s.agg(F.percentile(F.col("score"), (100.0 - percentile) / 100.0).alias("thr"))
    s = attach(s, thr, [])
    max_feats = int(p * percentile / 100)
    above = F.col("score") > F.col("thr")
    w_all = Window.partitionBy()  # p rows
    n_above = F.sum(above.cast("int")).over(w_all)
    tie = F.col("score") == F.col("thr")
    tie_rank = F.sum(tie.cast("int")).over(Window.orderBy("idx").rowsBetween(Window.unboundedPreceding, 0))
    keep_tie = tie & (tie_rank <= F.lit(max_feats) - n_above)
    if percentile >= 100:
        sel = F.lit(True)
    elif percentile <= 0:
        sel = F.lit(False)
    else:
        sel = above | keep_tie
    return s.withColumn("selected", sel).select("feature", "score", "selected")


def select_variance(df: DataFrame, features: Sequence[str], threshold: float = 0.0) -> DataFrame:
    """(feature, variance, selected): population variance above the threshold."""
    features = list(features)
    v = aggregate_rows(df, [({"feature": F.lit(f)}, {"variance": F.var_pop(named(f).cast("double"))}) for f in features])
    return v.withColumn("selected", F.col("variance") > threshold)


#: lower bound on the redundancy denominator (avoids division by zero)
MRMR_FLOOR = 0.001


def select_mrmr(df: DataFrame, features: Sequence[str], y: str, k: int) -> DataFrame:
    """Greedy MRMR: first the max-F feature, then repeatedly the feature with the
    largest F / mean |corr(feature, chosen)| (floor ``MRMR_FLOOR``); ties go to
    the earlier feature. The F table and the |corr| pair table stay in Spark
    (frozen once); each of the k steps is one small aggregate that returns a
    single feature name, so nothing of size p^2 passes through the driver."""
    from .ordered import freeze
    features = list(features)
    idx = _order_index(df.sparkSession, features)
    fs = freeze(f_scores(df, features, y).join(F.broadcast(idx), "feature")
                .withColumn("score", F.coalesce("score", F.lit(0.0))), "mrmr-f")
    pairs = correlation_pairs(df, features).select("a", "b", F.coalesce(F.abs("r"), F.lit(0.0)).alias("r"))
    pairs = freeze(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "r")), "mrmr-corr")
    chosen: list[str] = []
    for _ in range(min(k, len(features))):
        cand = fs.where(~F.col("feature").isin(*chosen)) if chosen else fs
        if chosen:
            red = pairs.where(F.col("b").isin(*chosen)).groupBy("a").agg((F.sum("r") / len(chosen)).alias("red"))
            cand = cand.join(red, cand["feature"] == red["a"], "left") \
                .withColumn("crit", F.col("score") / F.greatest(F.coalesce("red", F.lit(0.0)), F.lit(MRMR_FLOOR)))
        else:
            cand = cand.withColumn("crit", F.col("score"))
        best = cand.agg(F.max_by("feature", F.struct(F.col("crit"), -F.col("idx"))).alias("f")).first()["f"]
        chosen.append(best)
    return fs.where(F.col("feature").isin(*chosen)).select(
        "feature", F.array_position(F.array(*[F.lit(c) for c in chosen]), F.col("feature")).cast("int").alias("rank"),
        F.col("score").alias("f_score"))

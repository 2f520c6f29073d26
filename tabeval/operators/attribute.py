"""Attribution.

``shapley_sampled``: permutation-sampling Shapley values of a model's output
(predicted label by default, as in the reference). Each explained row is paired with
hash-picked rows of the whole background table, each with a hash-seeded feature
permutation; the permutation and its reverse are walked prefix by prefix (antithetic
pair, 2(p+1) evaluations per pair). Masked features take the value of the paired
background row. All masked inputs of all rows are scored at once; contributions are
differences of consecutive outputs, added up as signed sums of outputs, so the values plus the base
value add up to the model output (efficiency).

Any background row may be picked: rows are numbered by a distributed running count and
met by an equi-join on the number, so work grows with the explained rows only.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import inline_rows, named
from . import batch as bt
from . import evaluate as ev
from .ordered import hash_rank
from .sample import hash_int
from .workflow import FoldModel


def shapley_sampled(model: FoldModel, rows: DataFrame, features: Sequence[str], row_id: str, background: DataFrame,
                    output: str = "prediction", n_permutations: int = 10, seed: int = 42) -> DataFrame:
    """(row_id, feature, shap_value) plus a 'base' value per row in column ``base``. ``background`` has
    the features and ``row_id``."""
    features = list(features)
    p = len(features)
    numbered = prefix_rank(background.select(named(row_id).alias("_bid"), *[named(f).cast("double").alias(f"_b{i}") for i, f in enumerate(features)]),
                           "_bid").drop("_bid")
    n = background.count()
    if not n:
        raise ValueError("the background table is empty")
    x = rows.select(named(row_id).alias("_rid"), *[named(f).cast("double").alias(f"_x{i}") for i, f in enumerate(features)]) \
        .withColumn("_m", F.explode(F.sequence(F.lit(0), F.lit(n_permutations - 1))))
    rid, m = F.col("_rid").cast("string"), F.col("_m").cast("string")
    x = x.withColumn("_pos", F.pmod(hash_int(F.lit(f"{seed}:background:"), rid, F.lit(":"), m), F.lit(n)) + 1)
    # both sides grow with the tables, and Spark's sizes don't know of the exploded permutations: never a broadcast
    ex = x.join(numbered.hint("merge"), "_pos")
    keyed = F.array(*[F.struct(hash_int(F.lit(f"{seed}:"), rid, F.lit(":"), m, F.lit(f":{i}")).alias("h"), F.lit(i).alias("i")) for i in range(p)])
    ex = ex.withColumn("_perm", F.transform(F.array_sort(keyed), lambda s: s["i"]))
    # place of every feature in the permutation, from 1
    ex = ex.withColumn("_place", F.transform(F.sequence(F.lit(0), F.lit(p - 1)), lambda i: F.array_position(F.col("_perm"), i).cast("int")))
    ex = ex.withColumn("_dir", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(p))))
    place = lambda i: F.when(F.col("_dir") == 0, F.col("_place")[i]).otherwise(p + 1 - F.col("_place")[i])
    masked = [F.when(place(i) <= F.col("_j"), F.col(f"_x{i}")).otherwise(F.col(f"_b{i}")).alias(f) for i, f in enumerate(features)]

    def added(j: Column) -> Column:  # the feature that step j adds
        return F.when((j > 0) & (j <= p), F.element_at("_perm", F.when((j < 1) | (j > p), 1).when(F.col("_dir") == 0, j).otherwise(p + 1 - j).cast("int")))
    inputs = ex.select("_rid", added(F.col("_j")).alias("_fi"), added(F.col("_j") + 1).alias("_next"), *masked)
    scored = model.score(inputs, ["_rid", "_fi", "_next"])
    scored = scored.withColumn("_f", F.col("pred").cast("double") if output == "prediction" else F.col("score"))
    # a step's contribution is its output less the one before: every output counts for the feature that its step has
    # added and against the one that the next step adds, so outputs are only summed, most of them before the shuffle
    signed = [F.sum(F.when(F.col("_fi") == i, F.col("_f")).when(F.col("_next") == i, -F.col("_f"))).alias(f"_s{i}") for i in range(p)]
    first = F.when(F.col("_fi").isNull(), F.col("_f"))
    sums = scored.groupBy("_rid").agg(*signed, F.avg(first).alias("base"), F.count(first).alias("_walks"))
    # walks per copy of a row: copies of a row share its walks, so each of d copies adds a d-th part of a contribution
    copies = F.col("_walks") / (2.0 * n_permutations)
    phi = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), (F.col(f"_s{i}") / F.col("_walks") / copies).alias("shap_value"))
                              for i, f in enumerate(features)]))
    return sums.select("_rid", phi.alias("_phi"), "base").select(F.col("_rid").alias(row_id), "_phi.feature", "_phi.shap_value", "base")


def linear_shap(df: DataFrame, weights: dict[str, float], row_id: str) -> DataFrame:
    """Exact Shapley values of a linear score sum(w_f x_f) against the data mean
    (independent features): w_f (x_f - mean_f). (row_id, feature, shap_value)."""
    feats = list(weights)
    means = df.agg(*[F.avg(named(f).cast("double")).alias(f"_{i}") for i, f in enumerate(feats)]).first()
    rows = [{"feature": F.lit(f), "shap_value": F.lit(float(weights[f])) * (named(f).cast("double") - F.lit(means[f"_{i}"]))}
            for i, f in enumerate(feats)]
    return inline_rows(df, rows, [row_id])


def shap_mean_table(values: DataFrame, keys: Sequence[str] = ("algorithm", "outcome"),
                    features: Sequence[str] | None = None) -> DataFrame:
    """Mean |shap| per (keys, feature), pivoted wide: one column per feature,
    NULL where a model does not use the feature."""
    keys = list(keys)
    m = values.groupBy(*keys, "feature").agg(F.avg(F.abs("shap_value")).alias("v"))
    feats = list(features) if features is not None else sorted(r[0] for r in m.select("feature").distinct().collect())
    return m.groupBy(*keys).pivot("feature", feats).agg(F.first("v"))


def shap_rank(mean_long: DataFrame, keys: Sequence[str], top: int = 10) -> DataFrame:
    """Top features of each model by mean |shap| and, per feature, how many
    models use it: (keys, feature, mean_abs, rank, n_models)."""
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy(F.col("mean_abs").desc(), F.col("feature"))
    used = mean_long.where(F.col("mean_abs").isNotNull()).groupBy("feature").agg(
        F.countDistinct(*keys).alias("n_models"))
    return mean_long.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).join(used, "feature")


def permutation_importance(model: FoldModel, df: DataFrame, features: Sequence[str], row_id: str, y: str, seed: int = 42) -> DataFrame:
    """AUC drop when one feature is shuffled (a hash-rank permutation of that column over all rows):
    (feature, importance, baseline_auc) of every feature. One equi-join on rank brings every row its
    donor row; each feature then takes the donor's value in its own copy of the row."""
    features = list(features)
    base = df.select(named(row_id).alias("_rid"), named(y).alias("_y"), *[named(f).cast("double").alias(f"_x{i}") for i, f in enumerate(features)])
    donors = hash_rank(base.drop("_y"), [], "_rid", seed, rank_col="_pos", size_col=None).select(
        "_pos", *[F.col(f"_x{i}").alias(f"_d{i}") for i in range(len(features))])
    # row at position i (row_id order) takes the feature from the row whose hash rank is i
    paired = prefix_rank(base, "_rid").join(donors, "_pos").withColumn("_feature", F.explode(F.sequence(F.lit(-1), F.lit(len(features) - 1))))
    rows = paired.select("_feature", "_y", *[F.when(F.col("_feature") == i, F.col(f"_d{i}")).otherwise(F.col(f"_x{i}")).alias(f)
                                             for i, f in enumerate(features)])
    preds = ev.clean_predictions(model.score(rows, ["_feature", F.col("_y").alias("y")]))
    unshuffled = model.score(base.select(*[F.col(f"_x{i}").alias(f) for i, f in enumerate(features)]), [])
    aucs = bt.auc_of_groups(preds, F.col("_feature") + 1, unshuffled, base.count())
    if 0 not in aucs:
        raise ValueError("no row has a label and a score")
    found = [(f, None if aucs[0] is None or aucs.get(i) is None else aucs[0] - aucs[i], aucs[0]) for i, f in enumerate(features, 1) if i in aucs]
    return df.sparkSession.createDataFrame(found, "feature string, importance double, baseline_auc double")


def topk_features(importance: DataFrame, k: int = 10, value: str = "importance") -> DataFrame:
    """The ``k`` features of the largest absolute importance, with their rank (to 9 digits equal ones by name)."""
    size = F.round(F.abs(named(value)), 9)
    top = importance.orderBy(size.desc(), "feature").limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(size.desc(), "feature")))  # k rows


class LinearScore:
    """A scoring model of fixed weights: the weighted sum of the features, in their order."""

    def __init__(self, weights: dict[str, float]):
        self.weights = weights

    def score(self, df: DataFrame, keep: Sequence) -> DataFrame:
        terms = [F.lit(w) * named(f) for f, w in self.weights.items()]
        return df.select(*keep, reduce(lambda a, b: a + b, terms).alias("score"))


def prefix_rank(df: DataFrame, row_id: str) -> DataFrame:
    """Position of each row in row_id order (1-based), distributed."""
    from .ordered import prefix_sum
    r = prefix_sum(df.withColumn("_one", F.lit(1).cast("long")), [], [row_id], ["_one"], prefix="_p")
    return r.withColumnRenamed("_p_one", "_pos").drop("_one")

"""Values far from zero, missing, tiny or larger than a double resolves; names with dots and quotes;
choices that must not be swallowed."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabeval.operators import clean as cl
from tabeval.operators import encode as en
from tabeval.operators import models as md
from tabeval.operators import profile as pf
from tabeval.operators import sample as sp
from tabeval.operators import select as sl
from tabeval.operators import workflow as wf
from tabeval.operators.ordered import hash_rank


def test_means_of_any_magnitude(spark):
    df = spark.createDataFrame([(-1e-14, 1e27, 1.0), (-1.2e-15, 3e27, None), (None, 2e27, float("nan"))], "a double, b double, c double")
    got = {r["column"]: r["mean"] for r in pf.profile_columns(df, ["a", "b", "c"]).collect()}
    assert got["a"] == pytest.approx(-5.6e-15) and got["b"] == pytest.approx(2e27) and got["c"] == 1.0


def test_whole_numbers_above_2_to_53_are_distinct(spark):
    df = spark.range(50).select((F.col("id") + 2 ** 60).alias("i"), F.col("id").cast("decimal(30,5)").alias("d"))
    assert {r["column"]: r["n_unique"] for r in pf.distinct_counts(df, ["i", "d"]).collect()} == {"i": 50, "d": 50}
    assert {r["column"]: r["kind"] for r in cl.infer_column_kinds(df, ["i"]).collect()} == {"i": "numeric"}
    mode = spark.createDataFrame([(2 ** 60 + 1,), (2 ** 60 + 1,), (2 ** 60,)], "i long")
    assert en.most_frequent(mode, ["i"]) == {"i": 2 ** 60 + 1}


def f_statistic(x, y):
    groups = [[a for a, b in zip(x, y) if b == c and a is not None] for c in (0, 1)]
    n, grand = sum(map(len, groups)), np.mean(sum(groups, []))
    between = sum(len(g) * (np.mean(g) - grand) ** 2 for g in groups)
    within = sum(((np.array(g) - np.mean(g)) ** 2).sum() for g in groups)
    return between / (within / (n - 2))


def test_anova_far_from_zero_and_with_missing_values(spark):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 300).tolist()
    near = [float(v) for v in rng.normal(size=300) + np.array(y)]
    far = [1e9 + v for v in near]
    holes = [None if k % 3 == 0 else v for k, v in enumerate(near)]
    df = spark.createDataFrame(list(zip(y, near, far, holes)), "y int, near double, far double, holes double")
    got = {r["feature"]: r["score"] for r in sl.f_scores(df, ["near", "far", "holes"], "y").collect()}
    assert got["near"] == pytest.approx(f_statistic(near, y), rel=1e-9)
    assert got["far"] == pytest.approx(f_statistic(far, y), rel=1e-5)
    assert got["holes"] == pytest.approx(f_statistic(holes, y), rel=1e-9)


def test_correlations_skip_nan_and_survive_offsets(spark):
    rng = np.random.default_rng(4)
    a = rng.normal(size=400)
    b = a + rng.normal(size=400)
    rows = [(float(x), None if k % 7 == 0 else float(z) if k % 5 else float("nan"), 1e9 + float(x), 3.0) for k, (x, z) in enumerate(zip(a, b))]
    df = spark.createDataFrame(rows, "a double, b double, far double, flat double").repartition(3)
    got = {(r["a"], r["b"]): r["r"] for r in cl.correlation_pairs(df, ["a", "b", "far", "flat"]).collect()}
    seen = np.array([k % 7 != 0 and k % 5 != 0 for k in range(400)])
    assert got["a", "b"] == pytest.approx(np.corrcoef(a[seen], b[seen])[0, 1], abs=1e-12)
    assert got["a", "far"] == pytest.approx(1.0, abs=1e-6) and got["a", "flat"] is None


def test_one_scan_for_the_correlations_of_a_wide_table(spark):
    df = spark.range(20).select(*[(F.col("id") * i % 7).cast("double").alias(f"c{i}") for i in range(1, 301)])
    plan = cl.correlation_pairs(df, df.columns)._jdf.queryExecution().toString()
    assert plan.split("== Physical Plan ==")[1].count("Range (0, 20") <= 1


def flow_table(spark, n=240):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(n, 3))
    rows = [(i, float(x[i, 0]), float(x[i, 1]), ["0.5", "nan", None, "it's"][i % 4], int(x[i, 0] + rng.normal() > 0)) for i in range(n)]
    return spark.createDataFrame(rows, "row_id long, `pt's age` double, `a.b` double, lvl string, y int")


def test_names_with_dots_and_quotes_through_the_flow(spark, tmp_path):
    df = flow_table(spark)
    oh = en.OneHot().fit(df, ["lvl"])
    assert oh.names() == ["lvl_0.5", "lvl_it's", "lvl_'nan'", "lvl_nan"]
    opts = wf.Options(impute="mean", scaling="StandardScaler", feature_selection="SelectKBest-f_classif", n_features=3)
    tp = wf.TablePrep(["pt's age", "a.b"], ["lvl"], opts)
    fm = wf.fit(tp.fit_transform(df), tp.inputs, "y", "row_id", "lr", {}, opts)
    assert "pt's age" in fm.selected
    a = {r["row_id"]: r["score"] for r in fm.score(tp.transform(df), ["row_id"]).collect()}
    fm.save(str(tmp_path / "m"))
    b = {r["row_id"]: r["score"] for r in wf.FoldModel.load(str(tmp_path / "m")).score(tp.transform(df), ["row_id"]).collect()}
    assert a == pytest.approx(b)
    assert pf.profile_columns(df, ["pt's age", "a.b", "lvl"]).count() == 3
    assert cl.outcome_positives(df.withColumnRenamed("y", "it's y"), ["it's y"], 1).first()["kept"]


@pytest.mark.parametrize("alg,params", [("svm", {}), ("knn", {"n_neighbors": 5, "weights": "distance"}), ("nb", {}), ("dt", {"max_depth": 3})])
def test_every_learner_gives_probabilities_and_survives_saving(spark, tmp_path, alg, params):
    df = flow_table(spark)
    fm = wf.fit(df, ["pt's age", "a.b"], "y", "row_id", alg, params, wf.Options(impute="mean", scaling="StandardScaler"))
    got = {r["row_id"]: (r["score"], r["y"]) for r in fm.score(df, ["row_id", "y"]).collect()}
    assert len(got) == 240 and all(0 <= s <= 1 for s, _ in got.values())
    mean = lambda c: np.mean([s for s, y in got.values() if y == c])
    assert mean(1) > mean(0) + 0.1
    fm.save(str(tmp_path / "m"))
    again = {r["row_id"]: r["score"] for r in wf.FoldModel.load(str(tmp_path / "m")).score(df, ["row_id"]).collect()}
    assert {k: s for k, (s, _) in got.items()} == pytest.approx(again)


def test_rfecv_keeps_the_least_number_and_uses_the_learner(spark):
    df = flow_table(spark).select("row_id", "y", *[(F.sin(F.col("`a.b`") * (i + 1)) + (F.col("`pt's age`") if i == 0 else 0)).alias(f"f{i}")
                                                  for i in range(5)])
    fm = wf.FoldModel([f"f{i}" for i in range(5)], "y", "dt", {"max_depth": 3},
                      wf.Options(feature_selection="RFECV", n_features=3, selection_folds=3)).fit(df, "row_id")
    assert len(fm.selected) >= 3 and "f0" in fm.selected
    with pytest.raises(ValueError):
        wf.FoldModel(["f0", "f1"], "y", "knn", {}, wf.Options(feature_selection="RFECV", n_features=1, selection_folds=2)).fit(df, "row_id")


def test_search_ranks_by_exact_scores_and_reports_folds(spark):
    df = flow_table(spark)
    opts = wf.Options(scaling="StandardScaler", search="grid", search_folds=3, grids={"lr": {"C": [1e-5, 1.0]}}, scoring="accuracy")
    fm = wf.FoldModel(["pt's age", "a.b"], "y", "lr", {}, opts).fit(df, "row_id")
    rows = {r["combo"]: r for r in fm.cv_results.collect()}
    assert fm.params == {"C": 1.0} and rows[1]["rank_test_score"] == 1
    assert len(rows[0]["split_test_scores"]) == 3 and len(rows[0]["split_train_scores"]) == 3
    assert rows[1]["mean_test_score"] == pytest.approx(np.mean(rows[1]["split_test_scores"]))


def test_c_changes_the_fit_and_unknown_choices_are_refused(spark):
    df = flow_table(spark)
    w = [abs(wf.fit(df, ["pt's age"], "y", "row_id", "lr", {"C": c}).learner.weights()[0]) for c in (1e-3, 1e2)]
    assert w[0] < 0.5 * w[1]
    for bad in (lambda: wf.Options(feature_selection="Boruta"), lambda: wf.Options(rebalance="x"), lambda: md.check_parameters("rf", {"gamma": 1}),
                lambda: md.family("bayes"), lambda: md.candidates("lr", None, "ray", 3)):
        with pytest.raises(ValueError):
            bad()


def test_splits_by_cutoff_equal_the_ranks(spark):
    df = spark.range(997).select(F.col("id").alias("row_id"), F.when(F.col("id") % 11 == 0, None).otherwise(F.col("id") % 3).alias("y"))
    got = {r["row_id"] for r in sp.split_stratified(df, "y", "row_id", 0.3, 7).where("split = 'test'").collect()}
    ranks = hash_rank(df, ["y"], "row_id", 7, rank_col="r", size_col="n").where(F.col("r") <= F.round(F.col("n") * 0.3))
    assert got == {r["row_id"] for r in ranks.collect()}
    plan = sp.split_stratified(df, "y", "row_id", 0.3, 7)._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert "rangepartitioning" not in plan


def test_poisson_draws_follow_the_law():
    for mean in (1.0, 64.0):
        cdf = sp.poisson_cdf(mean)
        assert all(b >= a for a, b in zip(cdf, cdf[1:])) and cdf[-1] == pytest.approx(1.0, abs=1e-15)
        pmf = np.diff([0.0, *cdf])
        assert (pmf * np.arange(len(cdf))).sum() == pytest.approx(mean, rel=1e-9)
        assert cdf[3] == pytest.approx(sum(math.exp(-mean) * mean ** k / math.factorial(k) for k in range(4)), rel=1e-9)


def test_even_quantiles_are_exact(spark):
    rng = np.random.default_rng(6)
    x = [float(v) for v in np.round(rng.normal(size=333), 1)]
    df = spark.createDataFrame([(v, 7.0) for v in x], "x double, same double")
    got = {}
    for r in en.even_quantiles(df, ["x", "same"], 41).collect():
        got.setdefault(r["column"], {})[r["i"]] = r["value"]
    assert [got["x"][i] for i in range(41)] == pytest.approx([float(q) for q in np.quantile(x, np.arange(41) / 40)], abs=1e-12)
    assert set(got["same"].values()) == {7.0} and len(got["same"]) == 41


def test_outcomes_and_ids_of_any_name(spark):
    """Names with dots in every role of splits, folds, resampling and the training flows."""
    from tabeval.operators import sample as sp
    from tabeval.operators import workflow as wf
    df = spark.range(300).select(F.col("id").alias("row.id"), (F.col("id") % 7).cast("double").alias("x.1"), (F.col("id") % 11).cast("double").alias("z"),
                                 ((F.col("id") % 3) == 0).cast("int").alias("pt.y"))
    assert {r["split"]: r["count"] for r in sp.split_stratified(df, "pt.y", "row.id").groupBy("split").count().collect()} == {"test": 60, "train": 240}
    assert {r["pt.y"]: r["count"] for r in sp.class_counts(df, "pt.y").collect()} == {0: 200, 1: 100}
    assert sp.undersample(df, "pt.y", "row.id").count() == 200 and sp.oversample(df, "pt.y", "row.id").count() == 400
    sizes = sp.kfold_stratified(df, "pt.y", "row.id", 3).groupBy("fold", F.col("`pt.y`")).count().collect()
    assert sorted(r["count"] for r in sizes) == [33, 33, 34, 66, 67, 67]
    assert sp.kfold(df, "row.id", 3).groupBy("fold").count().where("count <> 100").count() == 0
    assert wf.train_test_flow(df, ["x.1", "z"], ["pt.y"], "row.id", {"lr": {}}, wf.Options()).count() == 300
    assert wf.cross_validate_flow(df, ["x.1", "z"], "pt.y", "row.id", {"lr": {}}, {}, wf.Options(), k=3).where("split = 'test'").count() == 300

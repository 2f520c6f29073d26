"""The training-part flow: rebalancing, selection, save/load."""

from pyspark.sql import functions as F

from tabeval.operators import evaluate as ev
from tabeval.operators import workflow as wf
from tabeval.plans.q_models import FEATS, orders_features

SF = "/root/testdata/sf0.001"


def test_fold_model_smote_select_save_load(spark, tmp_path):
    df = orders_features(spark, SF)
    opts = wf.Options(impute="mean", scaling="StandardScaler", rebalance="SMOTE", k_neighbors=3,
                      feature_selection="SelectKBest-f_classif", n_features=2)
    fm = wf.FoldModel(FEATS, "y", "lr", {}, opts).fit(df, "row_id")
    assert len(fm.selected) == 2 and set(fm.selected) <= set(FEATS)
    path = str(tmp_path / "fold")
    fm.save(path)
    back = wf.FoldModel.load(path)
    a = fm.score(df, ["row_id"]).withColumnRenamed("score", "a")
    b = back.score(df, ["row_id"]).withColumnRenamed("score", "b").drop("pred")
    assert a.join(b, "row_id").where(F.abs(F.col("a") - F.col("b")) > 1e-12).count() == 0


def test_rebalanced_training_part_is_balanced(spark):
    df = orders_features(spark, SF)
    for how in ("RandomUnderSampler", "RandomOverSampler", "SMOTE"):
        fm = wf.FoldModel(FEATS, "y", "lr", {}, wf.Options(impute="mean", rebalance=how, k_neighbors=3))
        bal = fm._rebalance(df, FEATS, "row_id")
        counts = [r["count"] for r in bal.groupBy("y").count().collect()]
        assert len(counts) == 2 and counts[0] == counts[1], how


def test_train_test_flow_excludes_rare_outcomes(spark):
    df = orders_features(spark, SF).withColumn("rare", (F.col("row_id") == F.lit(1)).cast("int"))
    preds = wf.train_test_flow(df, FEATS, ["y", "rare"], "row_id", {"lr": {}}, wf.Options(min_positives=10))
    assert {r["outcome"] for r in preds.select("outcome").distinct().collect()} == {"y"}
    res = ev.evaluate(preds, ["outcome", "split"]).collect()
    assert len(res) == 2


def test_bundle_round_trip_with_quantile_and_one_hot(spark, tmp_path):
    df = orders_features(spark, SF)
    opts = wf.Options(impute="mean", scaling="MinMaxScaler", quantile=True)
    tp = wf.TablePrep(["price", "odays"], ["o_orderpriority"], opts)
    tr = tp.fit_transform(df)
    assert any(c.startswith("o_orderpriority_") for c in tp.inputs)
    fm = wf.FoldModel(tp.inputs, "y", "lr", {}, opts).fit(tr, "row_id")
    direct = {r["row_id"]: r["score"] for r in fm.score(tp.transform(df), ["row_id"]).collect()}
    path = str(tmp_path / "bundle")
    wf.save_bundle(path, tp, {("lr", "y"): fm})
    got = {r["row_id"]: r["score"] for r in wf.score_bundle(path, df, "row_id").collect()}
    assert got.keys() == direct.keys()
    assert all(abs(got[k] - direct[k]) < 1e-12 for k in got)


def test_selection_and_adasyn_paths(spark):
    df = orders_features(spark, SF)
    for sel, n in (("SelectPercentile-f_classif", 2), ("VarianceThreshold", 2), ("MRMR", 2), ("SelectKBest-chi2", 1)):
        opts = wf.Options(impute="mean", scaling="MinMaxScaler", feature_selection=sel, n_features=n, percentile=50.0)
        fm = wf.FoldModel(FEATS, "y", "lr", {}, opts).fit(df, "row_id")
        assert 1 <= len(fm.selected) <= len(FEATS), sel
        if sel in ("MRMR", "SelectKBest-chi2"):
            assert len(fm.selected) == n, sel
    fm = wf.FoldModel(FEATS, "y", "lr", {}, wf.Options(impute="mean", rebalance="ADASYN", k_neighbors=3))
    bal = fm._rebalance(df, FEATS, "row_id")
    counts = sorted(r["count"] for r in bal.groupBy("y").count().collect())
    assert counts[0] == counts[1]


def test_race_costs_and_samples():
    from tabeval.operators.workflow import Race
    assert Race().shares(9) == [1 / 9, 1 / 3]
    assert Race(trials=0.1).shares(9) == [1 / 9, 1 / 3] and Race(trials=9).shares(9) == []
    for trials, n in ((3.0, 9), (4.0, 27), (30.0, 27)):
        race = Race(trials=trials)
        left, cost = n, 0.0
        for share in race.shares(n):
            cost, left = cost + left * share, max(1, left // 3)
        assert cost + left <= trials + 1e-9


def test_race_ends_with_the_winner_of_the_full_search(spark):
    """Depths far apart: the race drops the weak ones on samples and its winner is that of the full search."""
    from tabeval.operators import workflow as wf
    import numpy as np
    rng = np.random.default_rng(12)
    x = rng.normal(size=(900, 2))
    y = (x[:, 0] * x[:, 1] > 0).astype(int)
    df = spark.createDataFrame([(k, float(a), float(b), int(t)) for k, ((a, b), t) in enumerate(zip(x, y))], "row_id int, a double, b double, y int")
    grids = {"dt": {"max_depth": [1, 6]}, "lr": {}}
    full, _ = wf.auto_select(df, ["a", "b"], "y", ["dt", "lr"], grids)
    board, model = wf.auto_select(df, ["a", "b"], "y", ["dt", "lr"], grids, race=wf.Race())
    top = full.where("rank = 1").first()
    assert [(r["algorithm"], r["params"]) for r in board.collect()] == [(top["algorithm"], top["params"])]
    assert board.first()["score_val"] == top["score_val"] and model is not None
    quick, _ = wf.auto_select(df, ["a", "b"], "y", ["dt", "lr"], grids, race=wf.Race(seconds=0.0))
    assert quick.count() == 1

"""Registry and result-table semantics."""

import pytest
from pyspark.sql import functions as F

from tabeval.operators import registry as rg
from tabeval.operators import results as rs


def models(spark):
    return spark.createDataFrame([("a", "Native", ["rf"], None), ("b", "AutoML", ["auto"], None)],
                                 "exp_name string, type string, algorithms array<string>, time_created timestamp")


def test_duplicate_model_refused(spark):
    m = models(spark)
    new = spark.createDataFrame([("a", "Native", ["lr"], None)], m.schema)
    with pytest.raises(rg.DuplicateEntry):
        rg.insert_new(m, new, ["exp_name"], strict=True)
    assert rg.insert_new(m, new, ["exp_name"]).count() == 2


def test_rename_refused_when_taken(spark):
    m = models(spark)
    r = spark.createDataFrame([("a", "t1")], "exp_name string, test_set string")
    with pytest.raises(rg.DuplicateEntry):
        rg.rename_experiment(m, r, "a", "b")
    m2, r2 = rg.rename_experiment(m, r, "a", "c")
    assert {x[0] for x in m2.select("exp_name").collect()} == {"b", "c"} and r2.first()["exp_name"] == "c"


def test_upsert_replaces(spark):
    d = spark.createDataFrame([("x", 1), ("y", 2)], "data_name string, n int")
    out = rg.upsert(d, spark.createDataFrame([("x", 9)], d.schema), ["data_name"])
    assert dict(out.collect()) == {"x": 9, "y": 2}


def test_compare_results_no_duplicate_pairs(spark):
    base = spark.createDataFrame([("o", "rf", 0.8, 0.7, 0.9, 0.85, 0.8, 0.9)],
                                 "Outcome string, Algorithm string, `AUROC Score` double, `AUROC CI Lower` double, "
                                 "`AUROC CI Upper` double, `AUROC Score (Train)` double, `AUROC CI Lower (Train)` double, "
                                 "`AUROC CI Upper (Train)` double")
    t = rs.tag_results(base, "e", "s")
    total = rs.compare_results(rs.compare_results(None, t), t)
    assert total.count() == 1
    assert total.first()["Upper_CI_Gap"] == pytest.approx(0.1)


def test_cv_average_override(spark):
    per = spark.createDataFrame([("test", 0, 0.6, float("inf")), ("test", 1, 0.8, 0.5)],
                                "split string, fold int, auc double, dor double")
    plain = rs.cv_metric_average(per, ["split"], ["auc", "dor"]).first()
    assert plain["auc"] == pytest.approx(0.7) and plain["dor"] == pytest.approx(0.5) and plain["n_folds"] == 2
    ov = spark.createDataFrame([("test", 0.72, 0.6, 0.84)], "split string, auc double, auc_cilow double, auc_cihigh double")
    r = rs.cv_metric_average(per, ["split"], ["auc"], ov).first()
    assert r["auc"] == 0.72 and r["auc_cilow"] == 0.6


def test_sort_registry_missing_time_last_both_ways(spark):
    import datetime as dt
    m = spark.createDataFrame([("b", dt.datetime(2024, 1, 2)), ("a", None), ("c", dt.datetime(2024, 1, 1))],
                              "exp_name string, time_created timestamp")
    newest = [r["exp_name"] for r in rg.sort_registry(m, "newest").collect()]
    oldest = [r["exp_name"] for r in rg.sort_registry(m, "oldest").collect()]
    alpha = [r["exp_name"] for r in rg.sort_registry(m, "alphabetical").collect()]
    assert newest == ["b", "c", "a"] and oldest == ["c", "b", "a"] and alpha == ["a", "b", "c"]
    lst = rg.list_experiments(models(spark), spark.createDataFrame([("a", "t1"), ("a", "t2")],
                                                                   "exp_name string, test_set string"), "a", "Native")
    row = lst.first()
    assert row["exp_name"] == "a" and row["n_results"] == 2 and row["n_algorithms"] == 1

"""Edge cases from the test strategy: constant and null-only columns, unseen
categories, empty groups, ANSI division by zero."""

import pytest
from pyspark.sql import functions as F

from tabeval.operators import encode as en
from tabeval.operators import evaluate as ev
from tabeval.operators import profile as pf


def test_constant_column_scalers(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0)], "a double, c double")
    for m, want in (("StandardScaler", 0.0), ("MinMaxScaler", 0.0), ("RobustScaler", 0.0), ("MaxAbsScaler", 1.0)):
        out = en.Scaler(m).fit(df, ["a", "c"]).transform(df)
        assert {r["c"] for r in out.collect()} == {want}, m


def test_null_only_column(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None)], "a double, n double")
    prof = {r["column"]: r for r in pf.profile_columns(df, ["a", "n"]).collect()}
    assert prof["n"]["missing"] == 2 and prof["n"]["n_unique"] == 0 and prof["n"]["mean"] is None
    imp = en.Imputer("mean").fit(df, ["a", "n"])
    assert imp.values["n"] is None
    assert imp.transform(df).where(F.col("n").isNull()).count() == 2  # nothing to fill with


def test_unseen_category_all_zero(spark):
    train = spark.createDataFrame([("x",), ("y",), (None,)], "c string")
    test = spark.createDataFrame([("z",), ("x",)], "c string")
    oh = en.OneHot().fit(train, ["c"])
    assert oh.names() == ["c_x", "c_y", "c_nan"]
    rows = {tuple(r) for r in oh.transform(test).collect()}
    assert rows == {(0.0, 0.0, 0.0), (1.0, 0.0, 0.0)}


def test_single_class_groups_do_not_raise(spark):
    # ANSI mode is the Spark 4 default: every ratio must be a NULL, not an error
    assert spark.conf.get("spark.sql.ansi.enabled") in ("true", "True")
    df = spark.createDataFrame([("a", 1, .9), ("a", 1, .2), ("b", 0, .3), ("c", 1, .4), ("c", 0, .1)],
                               "g string, y int, score double")
    res = {r["g"]: r for r in ev.evaluate(df, ["g"]).collect()}
    assert res["a"]["auc"] is None and res["b"]["auc"] is None and res["c"]["auc"] == 1.0
    tt = ev.threshold_table(ev.roc_points(ev.score_groups(df, ["g"]), ["g"]), ["g"]).collect()
    assert len(tt) == 8  # +inf row and one row per distinct score in every group


def test_median_with_even_count(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (10.0,), (None,)], "x double")
    assert en.Imputer("median").fit(df, ["x"]).values["x"] == pytest.approx(2.0)
    df2 = df.union(spark.createDataFrame([(4.0,)], "x double"))
    assert en.Imputer("median").fit(df2, ["x"]).values["x"] == pytest.approx(3.0)


def test_binarize_outcome_rules(spark):
    from tabeval.operators import clean as cl
    train = spark.createDataFrame([("yes",), ("no",), ("no",), (None,)], "o string")
    out = {r["o"]: r["y"] for r in cl.binarize_outcome(train, "o", out="y").collect()}
    assert out == {"no": 0, "yes": 1, None: 0}          # mode fill, smaller value -> 0
    m = cl.outcome_mapping(train, "o").first()
    test = spark.createDataFrame([("yes",), (None,)], "o string")
    mapped = [r["y"] for r in cl.binarize_outcome(test, "o", {"zero": m["zero"], "one": m["one"], "mode": m["mode"]},
                                                  out="y").collect()]
    assert sorted(mapped) == [0, 1]                      # the train mapping is reused
    three = spark.createDataFrame([("a",), ("b",), ("c",)], "o string")
    with pytest.raises(ValueError):
        cl.binarize_outcome(three, "o")


def test_drop_sparse_rows_threshold(spark):
    from tabeval.operators import clean as cl
    df = spark.createDataFrame([(1.0, 2.0, 3.0, 4.0), (None, 2.0, 3.0, 4.0), (None, None, 3.0, 4.0)],
                               "a double, b double, c double, d double")
    # threshold 0.75 of 4 inputs -> at least 3 non-missing
    assert cl.drop_sparse_rows(df, ["a", "b", "c", "d"], 0.75).count() == 2
    assert cl.drop_sparse_rows(df, ["a", "b", "c", "d"], 1.0).count() == 1


def test_apply_coding_first_bin_and_one_hot_without_cap(spark):
    from tabeval.functions.scalar import apply_coding
    df = spark.createDataFrame([("x",), ("y",), ("z",)], "v string")
    got = {r["v"]: r["c"] for r in df.select("v", apply_coding("v", [["x", "y"], ["y", "z"]], [1, 2]).alias("c")).collect()}
    assert got == {"x": 1, "y": 1, "z": 2}               # the first bin containing the value wins
    wide = spark.range(3000).select(F.col("id").cast("string").alias("c"))
    oh = en.OneHot().fit(wide, ["c"])                    # no limit on the number of categories
    v = oh.to_vector(wide.where("c = '7'")).first()["onehot"]
    assert v.size == 3000 and v.indices.tolist() == [oh.names().index("c_7")] and v.values.tolist() == [1.0]

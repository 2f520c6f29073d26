"""Cross-validation of logistic regressions for all folds together, against one fold at a time."""

from collections import Counter

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from tabeval.operators import encode as en
from tabeval.operators import evaluate as ev
from tabeval.operators import models as md
from tabeval.operators import sample as sp
from tabeval.operators import workflow as wf

K = 3


@pytest.fixture(scope="module")
def rows(spark):
    """3,000 rows, a third of label 1; values are missing, and some ids come twice or are null."""
    u = lambda i: F.pmod(F.xxhash64("id", F.lit(i)), F.lit(1000)) / 1000.0
    df = spark.range(3000).select(F.when(F.col("id") % 40 != 7, F.col("id") - F.col("id") % 10 % 2).alias("row_id"), u(1).alias("a"), F.when(u(5) > 0.1, u(2) * 50 + 7).alias("b.c"),
                                  F.when(u(6) > 0.05, F.floor(u(3) * 4).cast("int")).alias("c"), (u(1) + u(4) * 1.5 + F.floor(u(3) * 4) / 8 > 1.6).cast("int").alias("y"))
    df.write.mode("overwrite").parquet(path := f"{spark.sparkContext.getCheckpointDir()}/shared-folds")
    return sp.kfold_stratified(spark.read.parquet(path), "y", "row_id", K, 42, out="_fold").cache()


FEATS = ["a", "b.c", "c"]


@pytest.mark.parametrize("strategy", ["median", "mean", "most_frequent", "constant"])
@pytest.mark.parametrize("accuracy", [20])
def test_numbers_of_all_folds(monkeypatch, rows, strategy, accuracy):
    monkeypatch.setattr(en, "SKETCH_ACCURACY", accuracy)
    got = en.Imputer.fit_folds(strategy, rows, FEATS, "_fold", K)
    want = [en.Imputer(strategy).fit(rows.where(F.col("_fold") != f), FEATS) for f in range(K)]
    assert [g.values for g in got] == [pytest.approx(w.values, rel=1e-12) for w in want]
    if strategy == "median":
        for method in en.SCALERS:
            scalers = en.Scaler.fit_folds(method, rows, FEATS, "_fold", K, got)
            for f, s in enumerate(scalers):
                one = en.Scaler(method).fit(want[f].transform(rows.where(F.col("_fold") != f)), FEATS)
                assert all(s.params[c] == pytest.approx(one.params[c], rel=1e-9) for c in FEATS)


def test_a_median_outside_the_brackets_is_found_in_its_own_rows(spark):
    df = spark.range(2000).select(F.col("id").cast("double").alias("x"), (F.col("id") >= 500).cast("int").alias("_fold"))
    old, en.SKETCH_ACCURACY = en.SKETCH_ACCURACY, 60
    try:
        assert en.fold_medians(df, ["x"], "_fold", 2) == [{"x": 1249.5}, {"x": 249.5}]
    finally:
        en.SKETCH_ACCURACY = old


@pytest.mark.parametrize("seed, piece_rows, draws, strategy, ratio", [(42, 1 << 16, 1 << 20, "auto", None), (5, 50, 300, "auto", None),
                                                                      (5, 50, 300, "ratio", 0.7), (42, 50, 300, "ratio", 0.1)])
def test_copies_of_all_folds(monkeypatch, rows, seed, piece_rows, draws, strategy, ratio):
    monkeypatch.setattr(sp, "PIECE_ROWS", piece_rows)
    monkeypatch.setattr(sp, "SORTED_DRAWS", draws)
    got = sp.oversample_folds(rows, "y", "row_id", "_fold", K, strategy, ratio, seed).collect()
    assert len(got) == rows.count()
    for f in range(K):
        want = Counter((r["a"], r["b.c"], r["c"], r["y"]) for r in sp.oversample(rows.where(F.col("_fold") != f), "y", "row_id", strategy, ratio, seed).collect())
        mine = Counter()
        for r in got:
            mine[r["a"], r["b.c"], r["c"], r["y"]] += (r["_fold"] != f) + r[f"_copies{f}"]
            assert r["_fold"] != f or r[f"_copies{f}"] == 0
        assert sum(want.values()) == sum(mine.values())
        assert +mine == want


@pytest.mark.parametrize("options", [wf.Options(impute="median", scaling="MinMaxScaler", rebalance="RandomOverSampler"),
                                     wf.Options(impute="mean", scaling="StandardScaler"), wf.Options(impute="most_frequent", rebalance="RandomOverSampler")])
def test_folds_are_fitted_together(monkeypatch, rows, options):
    """MLlib's solver, told to stop much later, ends at the same models."""
    algorithms = {"lr": {"C": 0.01}, "sgd_elastic": {"alpha": 0.01, "l1_ratio": 0.5}}
    df, fits, fit = rows.drop("_fold"), [], md.SparkLearner.fit.__func__
    run = lambda: wf.cross_validate_flow(df, FEATS, "y", "row_id", algorithms, {}, options, k=K)
    with monkeypatch.context() as m:
        m.setattr(wf, "SHARED_ROWS", 0)
        m.setattr(md.SparkLearner, "fit", classmethod(lambda cls, *a, **k: fits.append(a) or fit(cls, *a, **k)))
        got = run()
    assert not fits
    build = md.build_classifier
    monkeypatch.setattr(md, "build_classifier", lambda *a, **k: e.setTol(1e-14).setMaxIter(1000) if isinstance(e := build(*a, **k), LogisticRegression) else e)
    want = run()
    assert got.columns == want.columns
    g = ["repeat", "fold", "split", "algorithm"]
    a, b = ({tuple(r[:4]): r[4:] for r in x.groupBy(*g).agg(F.count("score"), F.avg("score"), F.stddev("score"), F.max("score"), F.avg("pred"), F.sum("y")).collect()} for x in (got, want))
    assert a.keys() == b.keys() and len(a) == K * 2 * 2
    assert all(a[k] == pytest.approx(b[k], abs=2e-6) for k in a)
    one = lambda x: {tuple(r): 1 for r in x.select(*g, "row_id", "y").collect()}
    assert one(got).keys() == one(want).keys()
    auc = lambda x: np.array([r["auc"] for r in ev.evaluate(x, g).orderBy(*g).collect()])
    assert np.abs(auc(got) - auc(want)).max() < 2e-5


def test_what_is_left_to_mllib(monkeypatch, rows):
    monkeypatch.setattr(wf, "SHARED_ROWS", 0)
    shared = lambda df=rows, o=wf.Options(), a=("lr", {}): wf.shared_folds(df, FEATS, "y", "row_id", dict([a]), o, K)
    assert shared() is not None
    assert shared(o=wf.Options(impute=None)) is None  # values stay missing
    assert shared(a=("dt", {})) is None and shared(a=("lr", {"max_iter": 5})) is None and shared(a=("lr", {"reg": 0.0})) is None
    assert shared(o=wf.Options(normalize=True)) is None and shared(o=wf.Options(rebalance="RandomUnderSampler")) is None
    assert shared(rows.withColumn("a", F.when(F.col("row_id") == 10, float("inf")).otherwise(F.col("a")))) is None
    assert shared(rows.withColumn("y", F.lit(1))) is None and shared(rows.withColumn("c", F.lit(None).cast("double"))) is None
    monkeypatch.setattr(wf, "SHARED_ROWS", 3001)
    assert shared() is None

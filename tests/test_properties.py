"""Property checks: invariants that hold whatever the data."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tabeval.operators import evaluate as ev
from tabeval.operators import workflow as wf
from tabeval.operators import neighbors as nb
from tabeval.operators import sample as sp
from tabeval.operators.attribute import shapley_sampled
from tabeval.operators.ordered import prefix_sum

SF = "/root/testdata/sf0.001"


def test_prefix_sum_equals_global_window_with_hot_key(spark):
    # one group holds most rows (a hot key): the distributed sums must equal a plain window
    rng = np.random.default_rng(1)
    data = [("hot" if i % 10 else f"g{i % 7}", float(rng.integers(0, 500)), int(i)) for i in range(4000)]
    df = spark.createDataFrame(data, "g string, v double, id long").withColumn("one", F.lit(1).cast("long"))
    got = prefix_sum(df, ["g"], ["v", "id"], ["one"], descending=True, prefix="c_", totals_prefix="t_")
    w = Window.partitionBy("g").orderBy(F.col("v").desc(), F.col("id").desc()).rowsBetween(Window.unboundedPreceding, 0)
    want = df.select("g", "v", "id", F.sum("one").over(w).alias("c_one"), F.count("*").over(Window.partitionBy("g")).alias("t_one"))
    a = got.select("g", "v", "id", "c_one", "t_one")
    assert a.exceptAll(want).count() == 0 and want.exceptAll(a).count() == 0


def test_auc_monotone_invariance_and_flip(spark):
    from tabeval.sources.problems import lineitem_predictions
    p = lineitem_predictions(spark, SF)
    g = ["algorithm", "outcome"]
    base = {tuple(r[:2]): r[2] for r in ev.auc_table(ev.score_groups(p, g), g).collect()}
    mono = p.withColumn("score", F.log1p("score") * 3 + 1)
    flip = p.withColumn("score", -F.col("score"))
    m = {tuple(r[:2]): r[2] for r in ev.auc_table(ev.score_groups(mono, g), g).collect()}
    f = {tuple(r[:2]): r[2] for r in ev.auc_table(ev.score_groups(flip, g), g).collect()}
    for k, v in base.items():
        assert m[k] == pytest.approx(v, abs=1e-12)
        assert f[k] == pytest.approx(1 - v, abs=1e-12)


def test_folds_partition_rows(spark):
    from tabeval.sources.problems import orders_problem
    o = orders_problem(spark, SF)
    f = sp.kfold_stratified(o, "y", "row_id", 5, 42)
    assert f.count() == o.count() and f.select("row_id").distinct().count() == o.count()
    c = f.groupBy("y", "fold").count().groupBy("y").agg((F.max("count") - F.min("count")).alias("d")).collect()
    assert all(r["d"] <= 1 for r in c)


def test_resampling_targets_met(spark):
    from tabeval.sources.problems import orders_problem
    o = orders_problem(spark, SF)
    for fn, kind in ((sp.undersample, "under"), (sp.oversample, "over")):
        out = fn(o, "y", "row_id", "auto", None, 42)
        got = {r["y"]: r["count"] for r in out.groupBy("y").count().collect()}
        want = {r["y"]: r["target"] for r in sp.sampling_targets(o, "y", kind, "auto").collect()}
        assert got == want


def test_knn_exact_against_numpy(spark):
    rng = np.random.default_rng(3)
    pts = rng.normal(size=(300, 3))
    pts[:40] = pts[0]  # a block of identical vectors
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(pts)], "id long, vec array<double>")
    nn = nb.knn_topk(df.select(F.col("id").alias("qid"), "vec"), df.select(F.col("id").alias("rid"), "vec"), 4,
                     exclude_self=True)
    got = {}
    for r in nn.collect():
        got.setdefault(r["qid"], []).append(r["distance"])
    d = np.sqrt(((pts[:, None, :] - pts[None, :, :]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    for q in range(len(pts)):
        assert sorted(got[q]) == pytest.approx(sorted(np.sort(d[q])[:4]), abs=1e-9)


def test_smote_points_on_segments(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("vec"), (F.col("label") == 0).cast("int").alias("y"))
    s = nb.smote(e, "vec_id", "vec", "y", 1, 30, k=3, seed=7)
    v = {r["vec_id"]: np.array(r["vec"]) for r in e.collect()}
    rows = s.collect()
    assert len(rows) == 30
    for r in rows:
        want = v[r["base_id"]] + r["u"] * (v[r["nb_id"]] - v[r["base_id"]])
        assert np.allclose(np.array(r["vec"]), want) and 0 <= r["u"] < 1


def test_shapley_additivity_and_save_load(spark, tmp_path):
    from tabeval.plans.q_models import FEATS, orders_features
    df = orders_features(spark, SF)
    m = wf.fit(df, FEATS, "y", "row_id", "rf", {"n_estimators": 5, "max_depth": 3}, wf.Options(impute="mean"))
    rows = df.limit(20)
    vals = shapley_sampled(m, rows, FEATS, "row_id", df, n_permutations=5)
    tot = vals.groupBy("row_id").agg((F.sum("shap_value") + F.first("base")).alias("total"))
    pred = m.score(rows, ["row_id"]).select("row_id", F.col("pred").cast("double").alias("pred"))
    for r in tot.join(pred, "row_id").collect():
        assert r["total"] == pytest.approx(r["pred"], abs=1e-9)
    path = str(tmp_path / "model")
    m.save(path)
    a = m.score(df, ["row_id"]).withColumnRenamed("score", "a")
    b = wf.FoldModel.load(path).score(df, ["row_id"]).withColumnRenamed("score", "b").drop("pred")
    assert a.join(b, "row_id").where(F.abs(F.col("a") - F.col("b")) > 1e-12).count() == 0


def test_confusion_cells_sum_to_n(spark):
    from tabeval.operators import rates as rt
    from tabeval.sources.problems import doc_predictions
    p = doc_predictions(spark, SF).withColumn("pred", (F.col("score") >= 1000).cast("int"))
    cm = rt.confusion_matrix(p, ["outcome"])
    per = {r["outcome"]: r["s"] for r in cm.groupBy("outcome").agg(F.sum("count").alias("s")).collect()}
    n = {r["outcome"]: r["count"] for r in p.groupBy("outcome").count().collect()}
    assert per == n


def test_bootstrap_ci_brackets_auc(spark):
    from tabeval.operators.curves import bootstrap_auc_ci
    from tabeval.sources.problems import lineitem_predictions
    p = lineitem_predictions(spark, SF).where("algorithm = 'qty'")  # 50 distinct scores: heavy ties
    g = ["outcome"]
    ci = {r["outcome"]: r for r in bootstrap_auc_ci(p, g, "row_id", n_boot=200, seed=3).collect()}
    auc = {r["outcome"]: r["auc"] for r in ev.auc_table(ev.score_groups(p, g), g).collect()}
    for o, a in auc.items():
        assert ci[o]["n_boot"] == 200
        assert ci[o]["ci_low"] < a < ci[o]["ci_high"]
        assert ci[o]["ci_high"] - ci[o]["ci_low"] < 0.2


def test_wide_profile_chunked_equals_single_plan(spark, monkeypatch):
    from tabeval.operators import clean as cl
    from tabeval.functions import columns
    from tabeval.operators import profile as pf
    from tabeval.sources.problems import WIDE_INPUTS, wide_lineitem
    w = wide_lineitem(spark, SF)
    one = {r["column"]: tuple(r) for r in pf.profile_columns(w, WIDE_INPUTS).collect()}
    monkeypatch.setattr(columns, "EXPRESSIONS", 4)
    many = {r["column"]: tuple(r) for r in pf.profile_columns(w, WIDE_INPUTS).collect()}
    rep = {r["column"]: r["std_pop"] for r in cl.low_variance_report(w, ["qty", "price", "disc"], 0.2).collect()}
    assert one.keys() == many.keys()
    for c in one:
        for a, b in zip(one[c], many[c]):
            same_nan = isinstance(a, float) and isinstance(b, float) and np.isnan(a) and np.isnan(b)
            assert a == b or same_nan or (isinstance(a, float) and b == pytest.approx(a, rel=1e-12))
    assert set(rep) == {"qty", "price", "disc"}

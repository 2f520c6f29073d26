"""Hand-computed micro-fixtures (FIXTURES.md section C)."""

import math

import pytest
from pyspark.sql import functions as F

from tabeval.functions.stats import Z_975, t_ppf, wilson
from tabeval.operators import evaluate as ev
from tabeval.operators import rates as rt
from tabeval.operators import sample as sp


def frame(spark, pairs):
    return spark.createDataFrame([(i, y, s) for i, (y, s) in enumerate(pairs)], "row_id long, y int, score double")


def record(spark, pairs, index="youden"):
    return ev.evaluate(frame(spark, pairs), [], index=index).first().asDict()


def test_perfect(spark):
    r = record(spark, [(1, .9), (1, .8), (0, .2), (0, .1)])
    assert r["auc"] == 1.0
    assert r["cutoff_youden"] == pytest.approx(0.8)
    assert r["auc_var"] == 0.0
    assert r["auc_cilow"] is None  # zero variance: no interval, as scipy's scale=0


def test_reversed(spark):
    assert record(spark, [(0, .9), (0, .8), (1, .2), (1, .1)])["auc"] == 0.0


def test_all_ties(spark):
    df = frame(spark, [(1, .5), (0, .5), (1, .5), (0, .5)])
    sg = ev.score_groups(df)
    assert ev.auc_table(sg).first()["auc"] == 0.5
    assert [r["midrank"] for r in ev.midranks(sg).collect()] == [2.5]


def test_one_swap(spark):
    r = record(spark, [(1, .9), (0, .8), (1, .7), (0, .1)])
    assert r["auc"] == pytest.approx(0.75)
    # TPR+TNR = 1.5 at .9 and at .7: the first (highest) threshold wins
    assert r["cutoff_youden"] == pytest.approx(0.9)


def test_one_class(spark):
    r = record(spark, [(1, .9), (1, .1)])
    assert r["auc"] is None and r["auc_cilow"] is None and r["auc_cihigh"] is None


def test_nan_score(spark):
    base = record(spark, [(1, .9), (0, .8), (1, .7), (0, .1)])
    df = spark.createDataFrame([(0, 1, .9), (1, 0, .8), (2, 1, .7), (3, 0, .1), (4, 1, float("nan")), (5, None, .5)],
                               "row_id long, y int, score double")
    r = ev.evaluate(df, []).first().asDict()
    assert r["auc"] == base["auc"] and r["cutoff_youden"] == base["cutoff_youden"]


def test_wilson(spark):
    lo, hi = wilson(8, 10, 1.959964)
    assert (round(lo, 3), round(hi, 3)) == (0.490, 0.943)
    from tabeval.functions.scalar import wilson_bounds
    a, b = wilson_bounds(F.lit(8), F.lit(10), 1.959964)
    got = spark.range(1).select(a.alias("a"), b.alias("b")).first()
    assert (round(got["a"], 3), round(got["b"], 3)) == (0.490, 0.943)


def test_fold_sizes(spark):
    df = spark.createDataFrame([(i, 1 if i < 10 else 0) for i in range(35)], "row_id long, y int")
    f = sp.kfold_stratified(df, "y", "row_id", 5, 42)
    counts = {(r["fold"], r["y"]): r["n"] for r in f.groupBy("fold", "y").agg(F.count("*").alias("n")).collect()}
    assert all(counts[(k, 1)] == 2 and counts[(k, 0)] == 5 for k in range(5))


def test_delong_matches_bruteforce(spark):
    import numpy as np
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 300)
    s = np.round(rng.normal(size=300) + y, 1)  # many ties
    r = record(spark, list(zip(y.tolist(), s.tolist())))
    pos, neg = s[y == 1], s[y == 0]
    v01 = np.array([((neg < p).sum() + 0.5 * (neg == p).sum()) / len(neg) for p in pos])
    v10 = np.array([((pos > q).sum() + 0.5 * (pos == q).sum()) / len(pos) for q in neg])
    var = v01.var(ddof=1) / len(pos) + v10.var(ddof=1) / len(neg)
    assert r["auc"] == pytest.approx(v01.mean(), abs=1e-12)
    assert r["auc_var"] == pytest.approx(var, abs=1e-12)
    assert r["auc_cilow"] == pytest.approx(v01.mean() - Z_975 * math.sqrt(var), abs=1e-12)


def test_rank_sum_and_normal_tail(spark):
    df = frame(spark, [(1, .9), (0, .8), (1, .7), (0, .1), (1, .6), (0, .65)])
    res = rt.rank_sum_test(ev.score_groups(df), []).first()
    # R+ = 6 + 4 + 2 = 12, P = N = 3: z = (12 - 10.5) / sqrt(5.25)
    z = (12 - 10.5) / math.sqrt(3 * 3 * 7 / 12)
    assert res["z"] == pytest.approx(z)
    assert res["p_value"] == pytest.approx(math.erfc(abs(z) / math.sqrt(2)), rel=1e-12)


def test_t_quantile():
    assert t_ppf(0.975, 5) == pytest.approx(2.570581835636314, rel=1e-10)
    assert t_ppf(0.975, 10) == pytest.approx(2.2281388519649385, rel=1e-10)


def test_drop_collinear_matches_second_difference(spark):
    import numpy as np
    rng = np.random.default_rng(5)
    y = rng.integers(0, 2, 200)
    s = rng.integers(0, 40, 200).astype(float)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "y int, score double")
    sg = ev.score_groups(df)
    kept = sorted(r["score"] for r in ev.drop_collinear(sg).collect())
    # reference rule on the descending distinct-score curve: keep ends and bends
    order = np.sort(np.unique(s))[::-1]
    tps = np.cumsum([((s == v) & (y == 1)).sum() for v in order])
    fps = np.cumsum([((s == v) & (y == 0)).sum() for v in order])
    keep = np.r_[True, np.logical_or(np.diff(fps, 2), np.diff(tps, 2)), True]
    assert kept == sorted(order[keep].tolist())


def test_flip_low_auc_folds(spark):
    from tabeval.operators.curves import flip_low_auc_folds
    rows = [(0, 1, .9), (0, 0, .1), (0, 1, .8), (0, 0, .2), (1, 1, .1), (1, 0, .9), (1, 1, .2), (1, 0, .8)]
    df = spark.createDataFrame(rows, "fold int, y int, score double")
    out = flip_low_auc_folds(df, [], "fold")
    aucs = {r["fold"]: r["auc"] for r in ev.auc_table(ev.score_groups(out, ["fold"]), ["fold"]).collect()}
    assert aucs == {0: 1.0, 1: 1.0}


def test_normal_tail_sql_matches_erfc(spark):
    from tabeval.functions.normal import log_sf_nonneg, normal_sf, two_sided_p
    xs = [-8.0, -3.5, -1.0, 0.0, 0.3, 1.959963984540054, 2.99, 3.0, 5.5, 12.0, 40.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = df.select("x", normal_sf("x").alias("q"), two_sided_p("x").alias("p")).collect()
    for r in got:
        want = 0.5 * math.erfc(r["x"] / math.sqrt(2))
        assert r["q"] == pytest.approx(want, rel=1e-11, abs=1e-16)
        assert r["p"] == pytest.approx(math.erfc(abs(r["x"]) / math.sqrt(2)), rel=1e-11, abs=1e-16)
    big = spark.createDataFrame([(50.0,)], "x double").select(log_sf_nonneg("x").alias("l")).first()["l"]
    # asymptotic series: ln Q(x) = -x^2/2 - ln(x sqrt(2 pi)) + ln(1 - 1/x^2 + 3/x^4 - ...)
    x = 50.0
    want = -x * x / 2 - math.log(x * math.sqrt(2 * math.pi)) + math.log1p(-1 / x ** 2 + 3 / x ** 4 - 15 / x ** 6)
    assert big == pytest.approx(want, rel=1e-12)

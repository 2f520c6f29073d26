"""Curve operators against direct NumPy computations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabeval.operators import curves as cv
from tabeval.operators import evaluate as ev


def data(spark, seed=11, n=300):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, n)
    p = np.round(np.clip(rng.normal(0.4 + 0.2 * y, 0.2), 0, 1), 2)  # ties and exact grid values
    return y, p, spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p)], "y int, prob double")


def test_interp_on_grid_matches_numpy_interp(spark):
    y, p, df = data(spark)
    sg = ev.score_groups(df.withColumnRenamed("prob", "score"))
    got = {r["grid_index"]: r["y"] for r in cv.interp_on_grid(sg, [], 100, "roc").collect()}
    order = np.sort(np.unique(p))[::-1]
    tps = np.r_[0, np.cumsum([((p == v) & (y == 1)).sum() for v in order])]
    fps = np.r_[0, np.cumsum([((p == v) & (y == 0)).sum() for v in order])]
    fpr, tpr = fps / fps[-1], tps / tps[-1]
    want = np.interp(np.linspace(0, 1, 100), fpr, tpr)
    assert [got[i] for i in range(100)] == pytest.approx(want.tolist(), abs=1e-12)


def test_net_benefit_matches_threshold_loop(spark):
    y, p, df = data(spark, seed=5)
    nb = {round(r["threshold"], 6): r for r in cv.net_benefit(df, [], "y", "prob", 1000).collect()}
    n = len(y)
    for t in np.arange(0, 1, 0.001)[::37]:
        pred = p > t
        tp = int(((pred == 1) & (y == 1)).sum())
        fp = int(((pred == 1) & (y == 0)).sum())
        want = tp / n - fp / n * (t / (1 - t))
        assert nb[round(float(t), 6)]["net_benefit_model"] == pytest.approx(want, abs=1e-12)
        assert nb[round(float(t), 6)]["net_benefit_all"] == pytest.approx(y.sum() / n - (n - y.sum()) / n * (t / (1 - t)), abs=1e-12)


def test_calibration_bins_match_searchsorted(spark):
    y, p, df = data(spark, seed=9)
    got = {r["bin"]: (r["prob_true"], r["prob_pred"], r["count"]) for r in cv.calibration_curve(df, [], "y", "prob").collect()}
    bins = np.linspace(0.0, 1.0, 11)
    ids = np.searchsorted(bins[1:-1], p)
    for b in np.unique(ids):
        m = ids == b
        assert got[int(b)][2] == int(m.sum())
        assert got[int(b)][0] == pytest.approx(y[m].mean(), abs=1e-12)
        assert got[int(b)][1] == pytest.approx(p[m].mean(), abs=1e-12)
    assert set(got) == {int(b) for b in np.unique(ids)}


def test_delong_compare_matches_bruteforce(spark):
    import math
    from tabeval.operators import rates as rt
    rng = np.random.default_rng(21)
    n = 240
    y = rng.integers(0, 2, n)
    s1 = np.round(rng.normal(y * 0.8, 1.0), 1)
    s2 = np.round(rng.normal(y * 0.3, 1.0), 1)
    df = spark.createDataFrame([(int(a), float(b), float(c)) for a, b, c in zip(y, s1, s2)], "y int, s1 double, s2 double")
    got = rt.delong_compare(df, [], "y", "s1", "s2").first()

    def comps(s):
        pos, neg = s[y == 1], s[y == 0]
        v01 = np.array([((neg < q).sum() + 0.5 * (neg == q).sum()) / len(neg) for q in pos])
        v10 = np.array([((pos > q).sum() + 0.5 * (pos == q).sum()) / len(pos) for q in neg])
        return v01, v10
    a01, a10 = comps(s1)
    b01, b10 = comps(s2)
    P, N = (y == 1).sum(), (y == 0).sum()
    cov = np.cov(np.vstack([a01, b01])) / P + np.cov(np.vstack([a10, b10])) / N
    z = abs(a01.mean() - b01.mean()) / math.sqrt(cov[0, 0] + cov[1, 1] - 2 * cov[0, 1])
    log10_p = math.log10(2) + math.log(0.5 * math.erfc(z / math.sqrt(2))) / math.log(10)
    assert got["auc_1"] == pytest.approx(a01.mean(), abs=1e-12)
    assert got["auc_2"] == pytest.approx(b01.mean(), abs=1e-12)
    assert got["z"] == pytest.approx(z, rel=1e-9)
    assert got["log10_p"] == pytest.approx(log10_p, rel=1e-9)


def test_averaged_roc_summary_matches_numpy(spark):
    from tabeval.functions.stats import t_ppf
    rng = np.random.default_rng(4)
    rows, k = [], 4
    for f in range(k):
        y = rng.integers(0, 2, 120)
        s = np.round(rng.normal(y * (0.5 + 0.2 * f), 1.0), 2)
        rows += [(f, int(a), float(b)) for a, b in zip(y, s)]
    df = spark.createDataFrame(rows, "fold int, y int, score double")
    res = cv.averaged_roc(ev.score_groups(df, ["fold"]), [], "fold", 100, n_curves=k).orderBy("grid_index").collect()
    grid = np.linspace(0, 1, 100)
    tprs, aucs = [], []
    for f in range(k):
        yy = np.array([r[1] for r in rows if r[0] == f])
        ss = np.array([r[2] for r in rows if r[0] == f])
        order = np.sort(np.unique(ss))[::-1]
        tps = np.r_[0, np.cumsum([((ss == v) & (yy == 1)).sum() for v in order])]
        fps = np.r_[0, np.cumsum([((ss == v) & (yy == 0)).sum() for v in order])]
        fpr, tpr = fps / fps[-1], tps / tps[-1]
        it = np.interp(grid, fpr, tpr)
        it[0] = 0.0
        tprs.append(it)
        aucs.append(np.trapezoid(tpr, fpr))
    mean = np.mean(tprs, axis=0)
    mean[-1] = 1.0
    mean_auc = np.trapezoid(mean, grid)
    t = t_ppf(0.975, k)
    se_auc = np.std(aucs) / np.sqrt(k)
    assert [r["mean_tpr"] for r in res] == pytest.approx(mean.tolist(), abs=1e-12)
    assert res[0]["mean_auc"] == pytest.approx(mean_auc, abs=1e-12)
    assert res[0]["auc_cilow"] == pytest.approx(max(mean_auc - t * se_auc, 0.0), abs=1e-12)
    assert res[0]["auc_cihigh"] == pytest.approx(min(mean_auc + t * se_auc, 1.0), abs=1e-12)


def _roc(yy, ss):
    order = np.sort(np.unique(ss))[::-1]
    tps = np.r_[0, np.cumsum([((ss == v) & (yy == 1)).sum() for v in order])]
    fps = np.r_[0, np.cumsum([((ss == v) & (yy == 0)).sum() for v in order])]
    return fps / fps[-1], tps / tps[-1], tps, fps


def test_multiclass_macro_and_micro(spark):
    rng = np.random.default_rng(13)
    n = 180
    lab = rng.choice(["A", "B", "C"], n)
    sc = {c: np.round(rng.normal((lab == c) * 0.7, 1.0), 1) for c in "ABC"}
    df = spark.createDataFrame([(str(l), float(sc["A"][i]), float(sc["B"][i]), float(sc["C"][i])) for i, l in enumerate(lab)],
                               "lab string, sa double, sb double, sc double")
    got = {r["curve"]: r["auc"] for r in cv.roc_multiclass(df, [], "lab", {"A": "sa", "B": "sb", "C": "sc"}).collect()}
    curves = {c: _roc((lab == c).astype(int), sc[c])[:2] for c in "ABC"}
    all_fpr = np.unique(np.concatenate([curves[c][0] for c in "ABC"]))
    mean_tpr = np.mean([np.interp(all_fpr, *curves[c]) for c in "ABC"], axis=0)
    assert got["macro"] == pytest.approx(np.trapezoid(mean_tpr, all_fpr), abs=1e-12)
    yy = np.concatenate([(lab == c).astype(int) for c in "ABC"])
    ss = np.concatenate([sc[c] for c in "ABC"])
    fpr, tpr = _roc(yy, ss)[:2]
    assert got["micro"] == pytest.approx(np.trapezoid(tpr, fpr), abs=1e-12)
    for c in "ABC":
        assert got[c] == pytest.approx(np.trapezoid(curves[c][1], curves[c][0]), abs=1e-12)


def test_pr_auc_trapezoid(spark):
    from tabeval.operators import rates as rt
    y, p, df = data(spark, seed=17)
    sg = ev.score_groups(df.withColumnRenamed("prob", "score"))
    got = rt.pr_auc(sg, []).first()["pr_auc"]
    _, _, tps, fps = _roc(y, p)
    precision = np.r_[1.0, tps[1:] / (tps[1:] + fps[1:])]
    recall = tps / tps[-1]
    assert got == pytest.approx(np.trapezoid(precision, recall), abs=1e-12)


def test_net_benefit_interp_matches_direct_counts(spark):
    y, p, df = data(spark, seed=23)
    n_pts = 20000
    got = cv.net_benefit_interp(df, [], "y", "prob", n_pts).orderBy("threshold").collect()
    grid = np.linspace(0, 1 - 1 / n_pts, n_pts)
    n = len(y)
    for j in list(range(0, n_pts, 997)) + [n_pts - 1]:
        t = grid[j]
        tp = int(((p >= t) & (y == 1)).sum())
        fp = int(((p >= t) & (y == 0)).sum())
        assert got[j]["threshold"] == pytest.approx(t, abs=1e-12)
        assert got[j]["net_benefit"] == pytest.approx(tp / n - fp / n * (t / (1 - t)), abs=1e-9)

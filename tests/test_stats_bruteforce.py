"""Quantiles, selection scores and resampling targets against direct formulas."""

import numpy as np
import pytest

from tabeval.operators import encode as en
from tabeval.operators import sample as sp
from tabeval.operators import select as sl


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(2)
    a = np.round(rng.normal(size=501), 1)
    b = rng.integers(0, 5, 501).astype(float)
    rows = [(float(x), float(z)) for x, z in zip(a, b)] + [(None, float("nan"))]
    df = spark.createDataFrame(rows, "a double, b double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.77, 1.0]
    got = {(r["column"], r["prob"]): r["value"] for r in en.exact_quantiles(df, ["a", "b"], probs).collect()}
    for col, v in (("a", a), ("b", b)):
        for q in probs:
            assert got[(col, q)] == pytest.approx(np.percentile(v, q * 100), abs=1e-12)


def test_anova_f_and_mass_chi2(spark):
    rng = np.random.default_rng(8)
    n = 200
    y = rng.integers(0, 3, n)
    x1 = rng.gamma(2.0, 1.0 + y, n)
    x2 = rng.integers(0, 4, n).astype(float)
    df = spark.createDataFrame([(int(c), float(a), float(b)) for c, a, b in zip(y, x1, x2)], "y int, x1 double, x2 double")
    f = {r["feature"]: r["score"] for r in sl.f_scores(df, ["x1", "x2"], "y").collect()}
    c = {r["feature"]: r["score"] for r in sl.chi2_scores(df, ["x1", "x2"], "y").collect()}
    for name, x in (("x1", x1), ("x2", x2)):
        groups = [x[y == k] for k in np.unique(y)]
        grand = x.mean()
        msb = sum(len(g) * (g.mean() - grand) ** 2 for g in groups) / (len(groups) - 1)
        msw = sum(((g - g.mean()) ** 2).sum() for g in groups) / (n - len(groups))
        assert f[name] == pytest.approx(msb / msw, rel=1e-9)
        obs = np.array([x[y == k].sum() for k in np.unique(y)])
        exp = np.array([(y == k).mean() for k in np.unique(y)]) * x.sum()
        assert c[name] == pytest.approx(((obs - exp) ** 2 / exp).sum(), rel=1e-9)


def test_ratio_targets(spark):
    df = spark.createDataFrame([(i, 1 if i < 30 else 0) for i in range(130)], "row_id long, y int")
    over = {r["y"]: r["target"] for r in sp.sampling_targets(df, "y", "over", "ratio", 0.5).collect()}
    under = {r["y"]: r["target"] for r in sp.sampling_targets(df, "y", "under", "ratio", 0.5).collect()}
    assert over == {1: 50, 0: 100}        # minority raised to int(0.5 * 100)
    assert under == {1: 30, 0: 60}        # majority cut to int(30 / 0.5)
    auto_u = {r["y"]: r["target"] for r in sp.sampling_targets(df, "y", "under", "auto").collect()}
    assert auto_u == {1: 30, 0: 30}


def test_knn_classifier_distance_weights(spark):
    from tabeval.operators import neighbors as nb
    rng = np.random.default_rng(6)
    tr = rng.normal(size=(80, 2))
    ytr = (tr[:, 0] + rng.normal(0, 0.5, 80) > 0).astype(int)
    te = rng.normal(size=(20, 2))
    train = spark.createDataFrame([(i, [float(a), float(b)], int(c)) for i, ((a, b), c) in enumerate(zip(tr, ytr))],
                                  "id long, vec array<double>, y int")
    test = spark.createDataFrame([(1000 + i, [float(a), float(b)], 0) for i, (a, b) in enumerate(te)],
                                 "id long, vec array<double>, y int")
    got = {r["id"]: r["score"] for r in nb.knn_classifier(train, test, k=5, weights="distance").collect()}
    for i, q in enumerate(te):
        d = np.sqrt(((tr - q) ** 2).sum(1))
        idx = np.argsort(d, kind="stable")[:5]
        w = 1.0 / d[idx]
        assert got[1000 + i] == pytest.approx((w * ytr[idx]).sum() / w.sum(), abs=1e-12)


def test_repeated_folds(spark):
    df = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)], "row_id long, y int")
    f = sp.kfold_repeated(df, "y", "row_id", 3, 2, 42).collect()
    for rep in (0, 1):
        rows = [r for r in f if r["repeat"] == rep]
        assert sorted(r["row_id"] for r in rows) == list(range(90))
        for cls in (0, 1):
            sizes = [sum(1 for r in rows if r["y"] == cls and r["fold"] == k) for k in range(3)]
            assert max(sizes) - min(sizes) <= 1
    a = {r["row_id"]: r["fold"] for r in f if r["repeat"] == 0}
    b = {r["row_id"]: r["fold"] for r in f if r["repeat"] == 1}
    assert a != b  # a different seed per repeat


def test_bracketed_quantiles_are_exact_and_shuffle_few_values(spark):
    """Many rows, ties of a third of them, infinite and missing values; brackets narrower than the data."""
    import numpy as np
    from tabeval.operators import encode as en
    rng = np.random.default_rng(4)
    n = 60_000
    a = np.where(rng.random(n) < 0.33, 1.5, rng.normal(size=n))
    b = np.round(rng.gamma(2.0, size=n), 2)
    c = np.where(rng.random(n) < 0.001, np.inf, rng.random(n))
    rows = [(float(x), float(y) if k % 11 else None, float(z) if k % 13 else float("nan")) for k, (x, y, z) in enumerate(zip(a, b, c))]
    df = spark.createDataFrame(rows, "a double, `b.x` double, c double").repartition(5)
    data = {"a": a, "b.x": np.array([y for _, y, _ in rows if y is not None]), "c": np.array([z for _, _, z in rows if z == z])}
    probs = [0.0, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = {(r["column"], r["prob"]): r["value"] for r in en.exact_quantiles(df, list(data), probs).collect()}
    for col, x in data.items():
        for p in probs:
            with np.errstate(invalid="ignore"):
                want = float(np.quantile(x, p))
            assert got[col, p] == want or abs(got[col, p] - want) < 1e-12 or want != want
    inside = en.brackets(df, ["a"], [0.25, 0.5])
    ranked = en._value_ranks(df, ["a"], inside)
    assert 0 < ranked.count() < 200 and ranked.first()["tot_cnt"] == n
    missed = {"a": (np.array([9.0]), np.array([10.0]))}  # a bracket that holds no rank
    assert en._value_ranks(df, ["a"], missed).count() == 0


def test_columns_without_values_have_no_quantiles(spark):
    from tabeval.operators import encode as en
    df = spark.createDataFrame([(None, 1.0), (float("nan"), 2.0)], "x double, y double")
    assert [(r["column"], r["value"]) for r in en.exact_quantiles(df, ["x", "y"], [0.5]).collect()] == [("y", 1.5)]
    assert en.exact_quantiles(df.where("false"), ["x", "y"], [0.5]).count() == 0

"""Second-order boosting against loops over all splits."""

import numpy as np
import pytest

from tabeval.operators import boosting as bs
from tabeval.operators import models as md


def data(n=600, seed=4):
    rng = np.random.default_rng(seed)
    a, b = rng.normal(size=n), rng.integers(0, 6, n).astype(float)
    y = ((a + 0.6 * (b > 2) + rng.normal(size=n) * 0.5) > 0.3).astype(int)
    a[(rng.random(n) < 0.2) & (y == 1)] = np.nan
    return a, b, y


def frame(spark, a, b, y):
    rows = [(float(u), float(v) if k % 50 else None, int(t), k) for k, (u, v, t) in enumerate(zip(a, b, y))]
    return spark.createDataFrame(rows, f"{md.inputs(2)[0]} double, {md.inputs(2)[1]} double, {md.LABEL} int, {md.ID} int").repartition(3)


def plain_tree(x, y, m, s, some, edges):
    """One tree by loops: {node: (feature, threshold, missing left, gain)} and leaf weights."""
    p = 1 / (1 + np.exp(-m))
    g, h = p - y, p * (1 - p)
    splits, leaves = {}, {}

    def visit(node, rows, depth):
        G, H = g[rows].sum(), h[rows].sum()
        best = None
        if depth < s.max_depth:
            for f in some:
                v = x[rows, f]
                top = np.nanmax(v) if (~np.isnan(v)).any() else None
                for e in edges[f]:
                    if top is None or e >= edges_of_row(edges[f], top):
                        continue
                    for left_missing in (True, False):
                        left = np.where(np.isnan(v), left_missing, v <= e)
                        gl, hl = g[rows][left].sum(), h[rows][left].sum()
                        if hl < s.min_child_weight or H - hl < s.min_child_weight:
                            continue
                        gain = 0.5 * (gl**2 / (hl + s.reg_lambda) + (G - gl)**2 / (H - hl + s.reg_lambda) - G**2 / (H + s.reg_lambda)) - s.gamma
                        order = (round(gain, 9), -f, -e, left_missing)
                        if best is None or order > best[0]:
                            best = order, (f, e, left_missing, gain), left
        if best is None or best[1][3] <= 0:
            leaves[node] = -G / (H + s.reg_lambda) * s.learning_rate
            return
        splits[node] = best[1]
        visit(2 * node + 1, rows[best[2]], depth + 1)
        visit(2 * node + 2, rows[~best[2]], depth + 1)

    def edges_of_row(e, top):
        return e[np.searchsorted(e, top, "left")] if np.searchsorted(e, top, "left") < len(e) else np.inf

    visit(0, np.arange(len(y)), 0)
    return splits, leaves


@pytest.mark.parametrize("settings", [{"max_depth": 2, "n_estimators": 2}, {"reg_lambda": 20.0, "gamma": 1.0, "n_estimators": 1}, {"gamma": 1e9, "n_estimators": 1},
                                      {"colsample_bytree": 0.5, "n_estimators": 2, "max_depth": 1, "min_child_weight": 8.0}])
def test_trees_against_loops(spark, settings):
    a, b, y = data()
    df = frame(spark, a, b, y)
    s = bs.Settings(max_bins=16, **settings)
    x = np.column_stack([a, np.where(np.arange(len(b)) % 50, b, np.nan)])
    edges = bs.edges_of(df, md.inputs(2), s.max_bins)
    trees = bs.fit_trees(df, md.inputs(2), md.LABEL, s)
    m = np.zeros(len(y))
    for t, tree in enumerate(trees):
        some = sorted({f for f, *_ in tree.splits.values()}) if s.colsample_bytree < 1 else [0, 1]
        if s.colsample_bytree < 1:
            assert len(some) <= 1
            if not some:
                continue
        splits, leaves = plain_tree(x, y, m, s, some, edges)
        assert {k: v[:3] for k, v in tree.splits.items()} == {k: v[:3] for k, v in splits.items()}
        assert all(tree.splits[k][3] == pytest.approx(splits[k][3]) for k in splits)
        assert tree.leaves == pytest.approx(leaves)
        node = np.zeros(len(y), int)
        while any(k in splits for k in node):
            for k in [k for k in set(node) if k in splits]:
                f, e, left, _ = splits[k]
                at = node == k
                node[at] = np.where(np.where(np.isnan(x[at, f]), left, x[at, f] <= e), 2 * k + 1, 2 * k + 2)
        m += np.array([leaves[k] for k in node])
    assert len(trees) == s.n_estimators and (settings.get("gamma") != 1e9 or not trees[0].splits)
    got = {r[md.ID]: r["m"] for r in df.select(md.ID, bs.margin(trees, md.inputs(2)).alias("m")).collect()}
    assert np.allclose([got[k] for k in range(len(y))], m)


def test_learner_scores_saves_and_loads(spark, tmp_path):
    from tabeval.operators import evaluate as ev
    from pyspark.sql import functions as F
    a, b, y = data(seed=9)
    df = frame(spark, a, b, y)
    learner = md.learner_class("hist_gbt").fit(df, 2, "hist_gbt", {"n_estimators": 12, "max_depth": 2, "learning_rate": 0.3})
    scored = learner.score(df, [md.ID, F.col(md.LABEL).alias("y")])
    assert ev.auc_table(ev.score_groups(scored)).first()["auc"] > 0.9
    meta = learner.save(str(tmp_path))
    import json
    again = type(learner).load(str(tmp_path), json.loads(json.dumps(meta)))
    assert sorted(map(tuple, again.score(df, [md.ID]).collect())) == sorted(map(tuple, learner.score(df, [md.ID]).collect()))
    assert sum(learner.weights()) == pytest.approx(1) and learner.weights()[0] > learner.weights()[1]
    with pytest.raises(ValueError, match="takes"):
        md.learner_class("hist").fit(df, 2, "hist", {"unknown": 1})
    assert bs.fit_trees(df.where("false"), md.inputs(2), md.LABEL, bs.Settings()) == []

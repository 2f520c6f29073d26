"""Randomised checks of the evaluation core against NumPy brute force."""

import math

import numpy as np
from pyspark.sql import functions as F
import pytest
from hypothesis import HealthCheck, Phase, given, settings
from hypothesis import strategies as st

from tabeval.functions.stats import Z_975
from tabeval.operators import evaluate as ev

pairs = st.lists(st.tuples(st.sampled_from(["a", "b"]), st.integers(0, 1), st.integers(0, 6)), min_size=1, max_size=60)


def brute(ys, ss):
    ys, ss = np.array(ys), np.array(ss, dtype=float)
    pos, neg = ss[ys == 1], ss[ys == 0]
    if len(pos) == 0 or len(neg) == 0:
        return None
    v01 = np.array([((neg < p).sum() + 0.5 * (neg == p).sum()) / len(neg) for p in pos])
    v10 = np.array([((pos > q).sum() + 0.5 * (pos == q).sum()) / len(pos) for q in neg])
    var = (v01.var(ddof=1) / len(pos) if len(pos) > 1 else math.nan) + \
          (v10.var(ddof=1) / len(neg) if len(neg) > 1 else math.nan)
    # Youden cutoff: descending distinct scores with +inf first; first max wins
    th = [math.inf] + sorted(set(ss.tolist()), reverse=True)
    best, cut = -1.0, None
    for t in th:
        tpr = (pos >= t).sum() / len(pos)
        fpr = (neg >= t).sum() / len(neg)
        j = tpr + (1 - fpr)
        if j > best:
            best, cut = j, t
    return v01.mean(), var, cut


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(pairs)
def test_evaluate_matches_bruteforce(spark, rows):
    df = spark.createDataFrame([(g, y, float(s)) for g, y, s in rows], "g string, y int, score double")
    got = {r["g"]: r for r in ev.evaluate(df, ["g"]).collect()}
    for g in {r[0] for r in rows}:
        ys = [y for gg, y, _ in rows if gg == g]
        ss = [s for gg, _, s in rows if gg == g]
        want = brute(ys, ss)
        r = got[g]
        if want is None:
            assert r["auc"] is None
            continue
        auc, var, cut = want
        assert r["auc"] == pytest.approx(auc, abs=1e-12)
        if not math.isnan(var):
            assert r["auc_var"] == pytest.approx(max(var, 0.0), abs=1e-12)
            if var > 0:
                assert r["auc_cilow"] == pytest.approx(auc - Z_975 * math.sqrt(var), abs=1e-9)
        assert r["cutoff_youden"] == cut
        assert r["TP"] + r["FN"] == sum(ys) and r["FP"] + r["TN"] == len(ys) - sum(ys)


@settings(max_examples=3, deadline=None, phases=[Phase.generate], suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(1, 6), st.integers(1, 4), st.integers(30, 160), st.integers(0, 2 ** 31 - 1), st.sampled_from(["euclidean", "manhattan"]))
def test_knn_exact_random(spark, dim, k, n, seed, metric):
    """Small chunks, blocks and many cells; exact ids, ties cut by id, also where queries aren't references."""
    from tabeval.operators import neighbors as nb
    rng = np.random.default_rng(seed)
    pts = np.round(rng.normal(size=(n, dim)) * 4) / 4   # quarters: exact duplicates and exact ties
    pts[: n // 3] = pts[0]                              # one vector holds a third of the rows
    asked = np.round(rng.normal(size=(40, dim)) * 4) / 4
    frame = lambda v, name: spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], f"{name} long, vec array<double>")
    kept = nb.REF_CHUNK, nb.QUERY_BLOCK
    nb.REF_CHUNK, nb.QUERY_BLOCK = 8, 8
    try:
        for q, same in ((pts, True), (asked, False)):
            got = {}
            for r in nb.knn_topk(frame(q, "qid"), frame(pts, "rid"), k, exclude_self=same, metric=metric).collect():
                got.setdefault(r["qid"], {})[r["nn_rank"]] = (r["rid"], r["distance"])
            gap = q[:, None, :] - pts[None, :, :]
            d = np.sqrt((gap ** 2).sum(-1)) if metric == "euclidean" else np.abs(gap).sum(-1)
            if same:
                np.fill_diagonal(d, np.inf)
            for i in range(len(q)):
                want = sorted(range(n), key=lambda j: (round(d[i, j], 12), j))[:k]
                have = [got[i][r + 1] for r in range(k)]
                assert [round(x, 9) for _, x in have] == [round(d[i, j], 9) for j in want]
                assert [j for j, _ in have] == want
    finally:
        nb.REF_CHUNK, nb.QUERY_BLOCK = kept


def test_knn_ties_go_to_the_smallest_ids(spark):
    from tabeval.operators import neighbors as nb
    refs = spark.createDataFrame([(i, [1.0, 0.0]) for i in (4, 2, 3, 1)] + [(5, [9.0, 9.0])], "rid long, vec array<double>")
    q = spark.createDataFrame([(7, [0.0, 0.0])], "qid long, vec array<double>")
    assert [r["rid"] for r in sorted(nb.knn_topk(q, refs, 2).collect(), key=lambda r: r["nn_rank"])] == [1, 2]


def test_shipped_copies_grow_less_than_the_references():
    """Clusters: eight times the references reach fewer than twice as many groups a query."""
    from tabeval.operators import neighbors as nb
    def groups_a_query(n):
        rng = np.random.default_rng(1)
        centres = rng.normal(size=(40, 8)) * 4
        refs = centres[rng.integers(0, 40, n)] + rng.normal(size=(n, 8)) * 0.3
        balls = nb._Balls(refs[: n // 32], "euclidean")
        leaf, near, top = balls.nearest(refs)
        held = balls.measure({int(c): (near[leaf == c].max(), top[leaf == c].max(), int((leaf == c).sum())) for c in np.unique(leaf)})
        assert (held[np.searchsorted(held, leaf)] == leaf).all() and balls.size.sum() == n
        group, chunks = balls.groups(512)
        asked = refs[rng.integers(0, n, 200)]
        bound = np.sort(np.sqrt(((asked[:, None] - refs[None]) ** 2).sum(-1)), axis=1)[:, 5]
        i, reached = balls.within(asked, bound, nb._slack(asked, balls.leaves))
        q, near_by = np.nonzero(np.sqrt(((asked[:, None] - refs[None]) ** 2).sum(-1)) <= bound[:, None])
        assert set(zip(i, reached)) >= set(zip(q, np.searchsorted(held, leaf)[near_by]))  # no leaf that holds a neighbour is missed
        return len(set(zip(i, group[reached]))) / 200, group.max() + 1
    (few, groups), (many, more) = groups_a_query(2000), groups_a_query(16000)
    assert more >= 4 * groups and many < 2 * few + 1 and many < more / 4

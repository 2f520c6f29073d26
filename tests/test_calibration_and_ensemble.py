"""Isotonic calibration, greedy ensembles, DeLong covariances of many scores, category tables, side-by-side tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabeval.operators import calibrate as ca
from tabeval.operators import encode as en
from tabeval.operators import ensemble as es
from tabeval.operators import ordered as od
from tabeval.operators import rates as rt
from tabeval.sources import io


def plain_isotonic(x, y):
    """Pool-adjacent-violators in one loop: (lo, hi, w, value)."""
    out = []
    for v in sorted(set(x.tolist())):
        at = x == v
        out.append([v, v, int(at.sum()), float(y[at].sum())])
        while len(out) > 1 and out[-2][3] * out[-1][2] >= out[-1][3] * out[-2][2]:
            lo, hi, w, s = out.pop()
            out[-1][1], out[-1][2], out[-1][3] = hi, out[-1][2] + w, out[-1][3] + s
    return [(a, b, w, s / w) for a, b, w, s in out]


def scored(spark, x, y):
    return spark.createDataFrame([(float(a), int(b)) for a, b in zip(x, y)], "score double, y int").repartition(4)


@pytest.mark.parametrize(("block", "kind"), [(7, "noisy"), (7, "falling"), (5, "saw"), (10_000, "noisy"), (9, "rising")])
def test_isotonic_blocks(spark, monkeypatch, block, kind):
    """Slices of few blocks, so that pools cross their borders; falling data end in one block."""
    monkeypatch.setattr(ca, "SLICE_BLOCKS", block)
    rng = np.random.default_rng(8)
    x = np.round(rng.random(900), 2)
    p = {"noisy": x, "falling": 1 - x, "saw": (x * 10) % 1, "rising": x}[kind]
    y = (x > 0.4).astype(int) if kind == "rising" else (rng.random(900) < p).astype(int)
    got = sorted((r["lo"], r["hi"], int(r["w"]), r["value"]) for r in ca.fit_isotonic(scored(spark, x, y)).collect())
    assert [g[:3] for g in got] == [e[:3] for e in plain_isotonic(x, y)]
    assert np.allclose([g[3] for g in got], [e[3] for e in plain_isotonic(x, y)])


@pytest.mark.parametrize("limit", [1 << 30, 0])
def test_isotonic_lines_between_blocks(spark, limit):
    rng = np.random.default_rng(2)
    x, y = np.round(rng.normal(size=400), 1), rng.integers(0, 2, 400)
    blocks = plain_isotonic(x, y)
    at, to = [v for b in blocks for v in b[:2]], [b[3] for b in blocks for _ in (0, 1)]
    asked = [-9.0, *rng.normal(size=40).tolist(), *[b[0] for b in blocks], 9.0, None, float("nan")]
    df = spark.createDataFrame([(k, v, "kept") for k, v in enumerate(asked)], "id int, score double, x string")
    got = {r["id"]: (r["calibrated"], r["x"]) for r in ca.apply_isotonic(ca.fit_isotonic(scored(spark, x, y)), df, limit=limit).collect()}
    for k, v in enumerate(asked):
        assert got[k][1] == "kept" and (got[k][0] is None if v is None or v != v else got[k][0] == pytest.approx(np.interp(v, at, to)))


def test_isotonic_of_nothing(spark):
    empty = scored(spark, [0.5], [1]).where("false")
    assert ca.fit_isotonic(empty).count() == 0
    assert ca.apply_isotonic(ca.fit_isotonic(empty), scored(spark, [0.5], [1])).first()["calibrated"] is None


def auc(y, s):
    pos, neg = s[y == 1], s[y == 0]
    return np.mean([(p > neg).mean() + 0.5 * (p == neg).mean() for p in pos])


def test_greedy_ensemble(spark):
    rng = np.random.default_rng(5)
    y = rng.integers(0, 2, 300)
    cols = {c: np.round(y + rng.normal(size=300) * s, 2) for c, s in (("a.1", 1.0), ("b", 1.1), ("c", 3.0))}
    df = spark.createDataFrame([(int(t), *map(float, r)) for t, *r in zip(y, *cols.values())] + [(1, None, 0.0, 0.0), (None, 0.0, 0.0, 0.0)],
                               "y int, `a.1` double, b double, c double")
    board, weights = es.greedy_ensemble(df, list(cols), steps=5)
    total, picks, before = np.zeros(300), [], 0.0
    for r in sorted(board.collect(), key=lambda r: r["step"]):
        tried = {c: auc(y, total + v) for c, v in cols.items()}
        best = max(tried, key=lambda c: round(tried[c], 9))
        assert r["learner"] == best and r["auc"] == pytest.approx(tried[best]) and r["gain"] == pytest.approx(tried[best] - before)
        total, before = total + cols[best], tried[best]
        picks.append((tried[best], best))
    last = max(range(5), key=lambda k: (round(picks[k][0], 9), -k)) + 1
    names = [c for _, c in picks[:last]]
    assert weights == {c: names.count(c) / last for c in set(names)} and sum(weights.values()) == pytest.approx(1)
    mixed = es.blend(df.where("y is not null and `a.1` is not null"), weights)
    assert np.allclose(sorted(r["score"] for r in mixed.collect()), sorted(sum(w * cols[c] for c, w in weights.items())))
    assert es.greedy_ensemble(df.where("false"), list(cols))[1] == {}


@pytest.mark.parametrize("limit", [1 << 30, 0])
def test_delong_covariance_of_four_scores(spark, monkeypatch, limit):
    """Against placements by loops; with a limit of 0 the placements come back by the split join."""
    monkeypatch.setattr(od, "BROADCAST_BYTES", limit)
    monkeypatch.setattr(od, "HOT_KEYS", 20)
    rng = np.random.default_rng(6)
    y = rng.integers(0, 2, 240)
    s = {"u": rng.normal(size=240) + y, "few": rng.integers(0, 3, 240) + y, "hot.1": np.where(rng.random(240) < 0.4, 0.0, rng.normal(size=240)), "v": np.round(rng.normal(size=240), 1)}
    rows = [(int(t), "g", *map(float, r)) for t, *r in zip(y, *s.values())] + [(1, "g", None, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "y int, grp string, u double, few double, `hot.1` double, v double")
    place = {c: np.array([(x[y == 0] < a).mean() + 0.5 * (x[y == 0] == a).mean() if t else (x[y == 1] > a).mean() + 0.5 * (x[y == 1] == a).mean()
                          for a, t in zip(x, y)]) for c, x in s.items()}
    got = {(r["score_i"], r["score_j"]): r for r in rt.delong_covariance(df, ["grp"], "y", list(s)).collect()}
    assert len(got) == 10
    for (a, b), r in got.items():
        cov = sum(np.cov(place[a][y == c], place[b][y == c])[0, 1] / (y == c).sum() for c in (0, 1))
        assert r["cov"] == pytest.approx(cov, abs=1e-14) and r["auc_i"] == pytest.approx(auc(y, s[a])) and r["auc_j"] == pytest.approx(auc(y, s[b]))
        assert (r["z"] is None) == (a == b)


def test_lookup_of_hot_and_rare_keys(spark, monkeypatch):
    monkeypatch.setattr(od, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(od, "HOT_KEYS", 4)
    rows = spark.createDataFrame([(k, "hot" if k % 2 else None if k % 5 == 0 else f"k{k}") for k in range(100)], "id int, k string")
    table = od.freeze(rows.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("most")).where("k is null or k <> 'k2'"))
    want = {r["k"]: r["most"] for r in table.collect()}
    got = od.lookup(rows, table, ["k"], "n").collect()
    assert len(got) == 100 and all(r["most"] == want.get(r["k"]) for r in got)


def test_category_table(spark, monkeypatch):
    monkeypatch.setattr(od, "BROADCAST_BYTES", 0)
    df = spark.createDataFrame([(k, f"v{k % 700:03d}" if k % 9 else None, "x" if k % 2 else "y") for k in range(2000)], "id int, `c.1` string, d string")
    coded = en.CategoryTable.fit(df, ["c.1", "d"])
    assert coded.sizes() == {"c.1": 701, "d": 2}
    plan = coded.to_vector(df)._jdf.queryExecution().toString()
    assert "Python" not in plan
    rows = coded.to_vector(df.unionByName(spark.createDataFrame([(9999, "new", "y")], df.schema))).collect()
    values = sorted(f"v{k:03d}" for k in range(700))
    assert len(rows) == 2001
    for r in rows:
        v = r["onehot"]
        own = [700 if r["c.1"] is None else values.index(r["c.1"])] if r["c.1"] != "new" else []
        assert v.size == 703 and sorted(v.indices.tolist()) == [*own, 701 + "xy".index(r["d"])] and set(v.values) == {1.0}
    same = en.OneHot().fit(df, ["c.1", "d"])
    assert {(r["id"], r["onehot"]) for r in same.to_vector(df).collect()} == {(r["id"], r["onehot"]) for r in coded.to_vector(df).collect()}


def test_tables_side_by_side(spark, tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    spark.range(1000).repartitionByRange(5, "id").sortWithinPartitions("id").write.parquet(a)
    spark.range(1000).select((F.col("id") * 2).alias("twice"), F.lit("z").alias("file")).repartitionByRange(3, "twice").sortWithinPartitions("twice").write.parquet(b)
    got = io.concat_columns(spark, a, b)
    assert got.columns == ["id", "twice", "file"] and got.count() == 1000 and got.where("twice <> 2 * id").count() == 0
    assert sorted(r["position"] for r in io.read_positions(spark, b).collect()) == list(range(1000))
    with pytest.raises(ValueError, match="both sides"):
        io.concat_columns(spark, a, a)
    spark.range(5).toDF("other").write.parquet(str(tmp_path / "c"))
    with pytest.raises(ValueError, match="rows"):
        io.concat_columns(spark, a, str(tmp_path / "c"))

"""Metrics merged from sorted ranges are those of score groups, however many ranges and blocks there are."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tabeval.operators import evaluate as ev
from tabeval.operators import sample as sp
from tabeval.operators import scored
from tabeval.operators.ordered import class_rank, hash_rank


@pytest.fixture
def predictions(spark):
    rnd, rows = random.Random(1), []
    for g, n, ties in (("a", 1500, None), ("b", 900, 7), (None, 300, 3), ("ones", 5, 2), ("zeros", 6, 3), ("inf", 200, 5), ("x", 1, 1)):
        for i in range(n):
            s = rnd.random() if ties is None else float(rnd.randrange(ties))
            s = math.inf if g == "inf" and s == 4.0 else -0.0 if s == 0.0 and i % 2 else s
            y = 1 if g == "ones" else 0 if g == "zeros" else int(rnd.random() < 0.3 + 0.3 * min(s, 1.0))
            rows.append((g, i % 2, None if i % 97 == 3 else y, None if i % 89 == 5 else math.nan if i % 83 == 7 else s))
    return spark.createDataFrame(rows, "g string, h int, y int, score double").repartition(5)


@pytest.mark.parametrize("group, index", [(["h", "g"], "youden"), ([], "f1")])
def test_ranges_give_the_metrics_of_score_groups(predictions, monkeypatch, group, index):
    monkeypatch.setattr(scored, "RANGE_ROWS", 100)
    monkeypatch.setattr(scored, "SORTED_ROWS", 150)
    want = {tuple(r[c] for c in group): r.asDict() for r in ev.evaluate(None, group, index=index, sg=ev.score_groups(predictions, group)).collect()}
    got = {tuple(r[c] for c in group): r.asDict() for r in ev.evaluate(predictions, group, index=index).collect()}
    assert got.keys() == want.keys()
    for k in want:
        for c, v in want[k].items():
            assert got[k][c] == (pytest.approx(v, rel=1e-12, nan_ok=True) if isinstance(v, float) else v), (k, c)


def test_large_group_is_measured_in_many_ranges_none_per_score(predictions, monkeypatch):
    monkeypatch.setattr(scored, "RANGE_ROWS", 100)
    monkeypatch.setattr(scored, "SORTED_ROWS", 150)
    parts = scored.measured(ev.clean_predictions(predictions.where("g = 'a'")), ["g"], "y", "score", 1.96).count()
    assert 8 <= parts <= 30


def test_class_rank_is_hash_rank(spark):
    rows = spark.range(3000).select("id", F.when(F.col("id") % 11 != 0, F.col("id") % 3).alias("y"))
    rows = rows.unionByName(spark.createDataFrame([(None, 1)], "id long, y long"))
    want = hash_rank(rows, ["y"], "id", 42, size_col=None).select("y", "id", "rank")
    assert sorted(map(str, class_rank(rows, ["y"], "id", 42).collect())) == sorted(map(str, want.collect()))


def test_oversampling_ranks_only_classes_that_grow(spark, monkeypatch):
    ranked, rank = [], sp.class_rank
    monkeypatch.setattr(sp, "class_rank", lambda df, *a, **k: ranked.append(df.count()) or rank(df, *a, **k))
    rows = spark.range(1000).select(F.col("id").alias("row_id"), (F.col("id") % 4 == 0).cast("int").alias("y"))
    out = sp.oversample(rows, "y", "row_id")
    assert ranked == [250]
    assert {r["y"]: r["count"] for r in out.groupBy("y").count().collect()} == {0: 750, 1: 750}

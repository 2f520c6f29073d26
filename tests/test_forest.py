"""The forest grown from counted cells: its trees, its scores beside MLlib's, and what it leaves to MLlib."""

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tabeval.operators import forest as fo
from tabeval.operators import models as md
from tabeval.operators import workflow as wf

XS = md.inputs(3)


@pytest.fixture(scope="module")
def rows(spark):
    """12,000 rows in 180 cells; the label leans on all three features."""
    i = F.col("id")
    df = spark.range(12_000).select(i.alias(md.ID), (i * 7919 % 6 * 0.5).alias("_x0"), (F.pmod(F.xxhash64(i), F.lit(5)) * 1.0).alias("_x1"),
                                    (F.pmod(F.xxhash64(i, F.lit(3)), F.lit(3)) * 1.0).alias("_x2"))
    odds = F.col("_x0") * 0.2 + (F.col("_x1") >= 2).cast("int") * 0.25 - F.col("_x2") * 0.05
    noise = F.pmod(F.xxhash64(F.col(md.ID), F.lit(9)), F.lit(1000)) / 1000.0
    return df.withColumn(md.LABEL, (noise < odds).cast("double"))


def cells_of(rows, **settings):
    return fo.count_cells(rows, XS, md.LABEL, md.ID, fo.Settings(**settings))


def test_cells_hold_every_row(rows):
    c = cells_of(rows)
    want = {tuple(r[:4]): r[4] for r in rows.groupBy(*XS, md.LABEL).count().collect()}
    values = [sorted({k[f] for k in want}) for f in range(3)]
    assert [e.tolist() for e in c.edges] == [[(a + b) / 2 for a, b in zip(v, v[1:])] for v in values]
    assert {(*(values[f][c.bins[f, i]] for f in range(3)), float(c.label[i])): n for i, n in enumerate(c.count.tolist())} == want


@pytest.mark.parametrize("least", [1, 400])
def test_tree_without_draws_is_mllibs(rows, least):
    c, s = cells_of(rows), fo.Settings(max_features="all", min_samples_leaf=least)
    tree = fo.grow(c, c.count, s, np.random.default_rng(0))
    assert len(tree) > 5
    nodes = np.array(sorted((0, k, *v) for k, v in tree.items()), float)
    data = VectorAssembler(inputCols=XS, outputCol="f").transform(rows)
    model = DecisionTreeClassifier(featuresCol="f", labelCol=md.LABEL, maxDepth=5, minInstancesPerNode=least).fit(data)
    assert model.numNodes == len(tree)
    assert fo.importances(nodes, 3) == pytest.approx(model.featureImportances.toArray().tolist(), abs=1e-9)
    got = model.transform(data).select("*", fo.score(fo.shares(nodes, c.edges), c.edges, [F.col(x) for x in XS]).alias("s"),
                                       vector_to_array("probability")[1].alias("p"))
    assert got.agg(F.max(F.abs(F.col("s") - F.col("p")))).first()[0] < 1e-12


def test_scores_are_near_mllibs_and_the_same_on_other_partitions(rows):
    many = rows.where(F.col(md.ID) % 7 != 0)
    mine = md.learner_class("rf").fit(many.repartition(5), 3, "rf", {})
    assert isinstance(mine, md.RandomForest)
    assert np.array_equal(mine.nodes, md.learner_class("rf").fit(many.coalesce(1), 3, "rf", {}).nodes)
    other = md.SparkLearner.fit(many, 3, "rf", {})
    a, b = ({r[md.ID]: (r["score"], r["pred"]) for r in m.score(rows, [md.ID]).collect()} for m in (mine, other))
    assert len(a) == 12_000
    gaps = np.array([a[k][0] - b[k][0] for k in a])
    assert abs(gaps.mean()) < 0.005 and np.abs(gaps).max() < 0.05
    assert all(p == int(s > 0.5) for s, p in a.values())
    assert np.abs(np.array(mine.weights()) - other.weights()).max() < 0.1


def test_saved_forest_scores_alike_and_missing_values_count_as_largest(spark, rows, tmp_path):
    df = rows.withColumnsRenamed({"_x0": "a.b", "_x1": "b", "_x2": "c", md.LABEL: "y", md.ID: "row_id"})
    m = wf.fit(df, ["a.b", "b", "c"], "y", "row_id", "rf", {"n_estimators": 7, "max_depth": 4, "max_features": "log2"}, wf.Options(impute=None))
    assert isinstance(m.learner, md.RandomForest) and len(set(m.learner.nodes[:, 0])) == 7
    odd = spark.createDataFrame([(1, None, 1.0, 0.0), (2, float("nan"), 1.0, 0.0), (3, float("inf"), 1.0, 0.0), (4, 99.0, 1.0, 0.0)],
                                "row_id long, `a.b` double, b double, c double")
    m.save(str(tmp_path / "m"))
    back = wf.FoldModel.load(str(tmp_path / "m"))
    for part in (odd, df.drop("y")):
        assert sorted(m.score(part, ["row_id"]).collect()) == sorted(back.score(part, ["row_id"]).collect())
    assert len({r["score"] for r in back.score(odd, ["row_id"]).collect()}) == 1


def test_what_is_left_to_mllib(rows):
    assert cells_of(rows) is not None
    assert cells_of(rows.limit(9_000)) is None  # few rows
    assert cells_of(rows.withColumn("_x0", F.col(md.ID) * 1.0)) is not None  # 32 bins: 960 cells
    assert cells_of(rows.withColumn("_x0", F.col(md.ID) * 1.0).withColumn("_x2", F.sin(md.ID))) is None  # 10,240 cells
    assert cells_of(rows.withColumn("_x1", F.when(F.col(md.ID) != 5, F.col("_x1")))) is None
    assert cells_of(rows.withColumn("_x1", F.when(F.col(md.ID) == 5, float("inf")).otherwise(F.col("_x1")))) is None
    assert cells_of(rows.withColumn(md.LABEL, F.lit(0.0))) is None
    assert cells_of(rows.withColumn(md.LABEL, F.col(md.LABEL) + 1)) is None
    assert cells_of(rows, max_depth=13) is None


def test_thresholds_are_nearest_to_even_parts():
    assert fo.thresholds(np.array([3.0, 1.0, 1.0, 2.0]), 4).tolist() == [1.5, 2.5]
    assert fo.thresholds(np.array([5.0]), 4).tolist() == []
    assert fo.thresholds(np.arange(100.0), 4).tolist() == [24.5, 49.5, 74.5]

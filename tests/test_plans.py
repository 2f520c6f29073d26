"""Plan-shape checks: no cartesian products, no whole-table single-partition
windows, pruned scans, the large side never broadcast."""

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"


def plan_text(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["threshold_table", "metrics_at_cutoff", "auc_delong_ci", "kfold_stratified",
                                  "averaged_roc", "net_benefit_model", "knn_topk", "results_table", "profile_columns"])
def test_no_cartesian(spark, name):
    p = plan_text(E.queries()[name](spark, SF))
    assert "CartesianProduct" not in p
    assert "BroadcastNestedLoopJoin" not in p


def test_scan_is_pruned(spark):
    from tabeval.sources.problems import lineitem_predictions
    df = lineitem_predictions(spark, SF)
    p = df._jdf.queryExecution().executedPlan().toString()
    # only the four columns the predictions need are read
    assert "ReadSchema: struct<l_quantity:double,l_extendedprice:double,l_returnflag:string,l_linestatus:string>" in p \
        or all(c not in p.split("ReadSchema")[1].split("\n")[0] for c in ("l_partkey", "l_suppkey", "l_shipdate"))


def test_running_sums_not_single_partition(spark):
    """The big score-group window is partitioned by (slice, group), never a
    SinglePartition exchange over the whole table."""
    from pyspark.sql import functions as F
    from tabeval.operators.ordered import prefix_sum
    df = spark.range(5000).select((F.col("id") % 13).cast("double").alias("v"), F.col("id"),
                                  F.lit(1).cast("long").alias("one"))
    out = prefix_sum(df, [], ["v", "id"], ["one"])
    p = plan_text(out)
    assert "Window" in p
    big_windows = [l for l in p.split("\n") if "Window" in l and "_add0" in l]
    assert big_windows and all("_slice" in l for l in big_windows)
    assert "SinglePartition" not in p


def test_offsets_broadcast_not_big_side(spark):
    from tabeval.operators.evaluate import score_groups
    from tabeval.sources.problems import lineitem_predictions
    sg = score_groups(lineitem_predictions(spark, SF), ["algorithm", "outcome"])
    p = plan_text(sg)
    # the only broadcast is the small offsets table, never the running sums
    for block in p.split("BroadcastExchange")[1:]:
        head = block.split("\n")[1:4]
        assert not any("_add0" in h for h in head)


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 2 and set(df.columns) >= {"outcome", "auc", "auc_cilow", "auc_cihigh", "cutoff_youden"}


def test_drop_frozen_removes_only_own_tables(spark, tmp_path):
    from tabeval.operators.ordered import freeze
    from tabeval.session import drop_frozen
    sc = spark.sparkContext
    before = sc.getCheckpointDir()
    try:
        sc.setCheckpointDir(str(tmp_path / "ck"))
        f = freeze(spark.range(10), "t")
        assert f.count() == 10
        assert drop_frozen(spark) == 1
    finally:
        if before:
            sc.setCheckpointDir(before)


@pytest.mark.parametrize("name", ["threshold_table", "metrics_at_cutoff", "auc_delong_compare", "averaged_roc",
                                  "net_benefit_model", "kfold_stratified", "oversample", "profile_columns",
                                  "select_kbest_f", "results_table"])
def test_evaluation_stays_in_the_jvm(spark, name):
    """No Python evaluation nodes: every per-row expression is codegen-able SQL."""
    p = plan_text(E.queries()[name](spark, SF))
    for node in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas"):
        assert node not in p, (name, node)


def test_bootstrap_shuffles_cells_only(spark):
    """Replicates are drawn behind the shuffle of the cells: no exchange holds a replicate, and the blocks are Arrow."""
    p = plan_text(E.queries()["bootstrap_auc_ci"](spark, SF))
    assert "MapInArrow" in p and "BatchEvalPython" not in p and "replicate" not in p
    below = p[p.index("MapInArrow"):]
    assert " AS _w#" in below[:below.index("Exchange")]  # the weights

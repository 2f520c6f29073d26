"""A cross-section of the registered queries against their DuckDB oracle SQL
(sf0.001, exact float equality after both sides' rounding)."""

import duckdb
import pytest

import __spark_entry__ as E
from tabeval.sources.io import TABLES

SF = "/root/testdata/sf0.001"
NAMES = ["threshold_table", "auc_delong_ci", "metrics_at_cutoff", "auprc", "auc_delong_compare", "averaged_roc",
         "net_benefit_model", "kfold_stratified", "oversample", "profile_columns", "one_hot", "scale_robust",
         "select_kbest_chi2", "knn_topk", "smote", "results_table", "compare_results", "roc_multiclass"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def canon(rows):
    def k(row):
        return tuple((x is None, str(type(x).__name__) if x is not None else "", x if x is not None else 0) for x in row)
    return sorted(rows, key=k)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    sdf = E.queries()[name](spark, SF)
    srows = [tuple(r) for r in sdf.collect()]
    res = con.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in res.description]
    assert sorted(sdf.columns) == sorted(ocols)
    perm = [ocols.index(c) for c in sdf.columns]
    orows = [tuple(r[i] for i in perm) for r in res.fetchall()]
    assert len(srows) == len(orows)
    assert canon(srows) == canon(orows)

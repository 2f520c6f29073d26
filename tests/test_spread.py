"""Work that grows with the tables is spread over tasks and never meets in one task or in the driver."""
import hashlib

import numpy as np
from pyspark.sql import functions as F

from tabeval.operators import attribute as at
from tabeval.operators import curves as cv
from tabeval.operators import workflow as wf
from tabeval.operators.sample import poisson_cdf


def plan(df):
    return df._jdf.queryExecution().toString()


# ---------------------------------------------------------------- bootstrap
def test_bootstrap_draws_are_those_of_the_key():
    n_boot, seed, key = 7, 3, "a:1.5:1"

    def uniform(tag, r, i):
        return int(hashlib.md5(f"{seed}:{tag}:{key}:{r}:{i}".encode()).hexdigest()[:15], 16) / float(1 << 60)
    for count in (1, 63, 64, 130):
        want = [sum(np.searchsorted(poisson_cdf(64.0), uniform("b", r, i), side="right") for i in range(1, count // 64 + 1))
                + sum(np.searchsorted(poisson_cdf(1.0), uniform("p", r, i), side="right") for i in range(1, count % 64 + 1)) for r in range(n_boot)]
        assert cv._Draws(n_boot, seed).of(key, count).tolist() == want


def test_bootstrap_tasks_are_kept_apart(spark):
    """Few bytes are shuffled for much work: the ranges must not be put together by their size."""
    df = spark.range(400).select(F.lit("a").alias("g"), F.col("id").alias("row_id"), (F.col("id") % 2).cast("int").alias("y"), F.col("id").cast("double").alias("score"))
    found = plan(cv.bootstrap_auc_ci(df, ["g"], "row_id", n_boot=5))
    physical = found[found.index("== Physical Plan =="):]
    below = physical[physical.index("MapInArrow"):]
    assert "REPARTITION_BY_NUM" in below.split("Exchange", 1)[1].split("\n", 1)[0]


# ------------------------------------------------------------------ Shapley
def test_shapley_broadcasts_nothing(spark):
    df = spark.range(300).select(F.col("id").alias("row_id"), (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 5).cast("double").alias("b"),
                                 ((F.col("id") % 7) > 3).cast("int").alias("y"))
    model = wf.fit(df, ["a", "b"], "y", "row_id", "dt", {"max_depth": 3}, wf.Options(impute="mean"))
    found = at.shapley_sampled(model, df.where("row_id < 20"), ["a", "b"], "row_id", df, output="score", n_permutations=4)
    assert "Broadcast" not in plan(found) and "SortMergeJoin" in plan(found)
    values = {}
    for r in found.collect():
        values.setdefault(r.row_id, [r.base, {}])[1][r.feature] = r.shap_value
    out = {r.row_id: r.score for r in model.score(df.where("row_id < 20"), ["row_id"]).collect()}
    assert len(values) == 20 and all(set(v[1]) == {"a", "b"} and abs(v[0] + sum(v[1].values()) - out[k]) < 1e-12 for k, v in values.items())

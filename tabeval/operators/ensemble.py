"""Greedy weighted ensemble: learners are added one at a time, with replacement, to raise the AUC of the summed
out-of-fold scores.

A step's candidates are the ensemble so far plus one learner each. All are scored by one job: the rows
carry the summed score, are copied once per learner and reduced to score groups together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import inline_rows, named
from . import evaluate as ev
from .ordered import freeze


def greedy_ensemble(scores: DataFrame, learners: Sequence[str], y: str = "y", steps: int = 25) -> tuple[DataFrame, dict[str, float]]:
    """(board, weights). board: step, learner, auc and gain of each addition. weights: each learner's share of
    the additions up to the step of the highest AUC (the first of equals).

    ``scores`` has one row per example and one column of out-of-fold scores per learner; rows with a missing
    score or outcome don't count. Equal AUCs go to the learner named first.
    """
    learners = list(learners)
    names = [f"s{i}" for i in range(len(learners))]
    rows = freeze(scores.select(named(y).cast("int").alias("y"), *[named(c).cast("double").alias(n) for c, n in zip(learners, names)])
                  .dropna(), "ensemble")
    total, found, before = F.lit(0.0), [], 0.0
    for step in range(1, steps + 1):
        # the sum is an expression over the rows: the same additions in the same order in every step
        tried = inline_rows(rows, [{"k": F.lit(i), "y": F.col("y"), "score": total + F.col(n)} for i, n in enumerate(names)])
        # to 12 digits: the order in which tasks add up doesn't decide
        aucs = {r["k"]: None if r["auc"] is None else round(r["auc"], 12) for r in ev.auc_table(ev.score_groups(tried, ["k"]), ["k"]).collect()}  # one row per learner
        if not aucs or all(a is None for a in aucs.values()):
            break
        best = min(aucs, key=lambda k: (-aucs[k] if aucs[k] is not None else 1.0, k))
        found.append((step, learners[best], float(aucs[best]), float(aucs[best]) - before))
        total, before = total + F.col(names[best]), float(aucs[best])
    board = scores.sparkSession.createDataFrame(found, "step int, learner string, auc double, gain double")
    if not found:
        return board, {}
    top = max(found, key=lambda r: (r[2], -r[0]))[0]
    picked = [r[1] for r in found[:top]]
    return board, {c: picked.count(c) / top for c in dict.fromkeys(picked)}


def blend(scores: DataFrame, weights: dict[str, float], out: str = "score") -> DataFrame:
    """Add ``out``, the weighted mean of the learners' scores."""
    return scores.withColumn(out, sum((F.lit(w) * named(c) for c, w in weights.items()), F.lit(0.0)))

"""tabeval: Spark-native preparation, training and set-based evaluation of binary classifiers.

Most used entry points (imported lazily so ``import tabeval`` stays cheap)::

    tabeval.evaluate(preds, group)          # metric record per group (AUC, DeLong CI, cutoffs, rates)
    tabeval.score_groups(preds, group)      # distinct-score running counts (ROC / PR / midranks base)
    tabeval.threshold_table(roc, group)     # per-threshold rates with Wilson intervals
    tabeval.averaged_roc(sg, group, fold)   # mean ROC over folds with t bands
    tabeval.knn_topk(queries, refs, k)      # exact k nearest neighbours
    tabeval.Options / train_test_flow / cross_validate_flow / results_table
"""

from __future__ import annotations

__version__ = "0.1.0"

_EXPORTS = {
    "evaluate": ("operators.evaluate", "evaluate"),
    "score_groups": ("operators.evaluate", "score_groups"),
    "roc_points": ("operators.evaluate", "roc_points"),
    "threshold_table": ("operators.evaluate", "threshold_table"),
    "averaged_roc": ("operators.curves", "averaged_roc"),
    "net_benefit": ("operators.curves", "net_benefit"),
    "knn_topk": ("operators.neighbors", "knn_topk"),
    "prefix_sum": ("operators.ordered", "prefix_sum"),
    "Options": ("operators.workflow", "Options"),
    "train_test_flow": ("operators.workflow", "train_test_flow"),
    "cross_validate_flow": ("operators.workflow", "cross_validate_flow"),
    "results_table": ("operators.results", "results_table"),
    "build_session": ("session", "build_session"),
}


def __getattr__(name: str):
    if name in _EXPORTS:
        import importlib
        mod, attr = _EXPORTS[name]
        return getattr(importlib.import_module(f"{__name__}.{mod}"), attr)
    raise AttributeError(name)

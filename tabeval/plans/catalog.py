"""All registered queries (importing the plan modules fills the registry)."""

from __future__ import annotations

from . import q_curves, q_eval, q_models, q_prep, q_results, q_sample, q_select  # noqa: F401
from .registry import ORACLE, QUERIES


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLE)

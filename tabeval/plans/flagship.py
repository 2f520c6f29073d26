"""The flagship query: a full metric record per outcome on documents x labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.evaluate import evaluate
from ..sources.problems import doc_predictions
from .registry import rounded


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate(doc_predictions(spark, sf_dir), ["outcome"], index="youden"))

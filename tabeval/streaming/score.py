"""Scoring a stream with a saved pipeline (the ``score_saved`` operator on
Structured Streaming).

The reference has no streaming operators; this module only lets a saved
``FoldModel`` (imputer -> scaler -> model) score new rows as they arrive. Its stages
are stateless per-row maps, so they work unchanged on a streaming DataFrame (nearest
neighbours excepted); evaluation of the scored rows is done per micro-batch
with the batch operators via ``foreachBatch`` (exactly-once with an idempotent
sink keyed by batch id).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame

from ..operators.workflow import FoldModel


def score_stream(model_path: str, stream: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Streaming DataFrame of (keep..., score, pred) from a saved model."""
    return FoldModel.load(model_path).score(stream, keep)


def evaluate_batches(scored: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str,
                     trigger_once: bool = True):
    """Run ``sink(batch_df, batch_id)`` on every micro-batch of scored rows."""
    w = scored.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if trigger_once else w
    return w.start()

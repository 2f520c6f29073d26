"""Bounded concurrency for independent driver-side fits.

Spark runs the jobs submitted from several driver threads concurrently; a
small pool of model fits (folds, candidates, outcomes) keeps the cluster busy
without unbounded driver threads.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame

#: default number of concurrent fits
FIT_PARALLELISM = 4


def run_bounded(tasks: Sequence[Callable], parallelism: int = FIT_PARALLELISM) -> list:
    """Run tasks from a bounded thread pool; results keep the task order."""
    from concurrent.futures import ThreadPoolExecutor
    if parallelism <= 1 or len(tasks) <= 1:
        return [t() for t in tasks]
    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        return list(pool.map(lambda t: t(), tasks))


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    out = None
    for f in frames:
        out = f if out is None else out.unionByName(f)
    return out

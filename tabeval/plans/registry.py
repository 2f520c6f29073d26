"""Query registry shared by the plan modules.

``register(name, sql=...)`` records a ``(spark, sf_dir) -> DataFrame`` callable and,
when the operator is SQL-expressible, the DuckDB oracle text for the same result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Callable) -> Callable:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every floating column (keeps +-inf; NaN -> NULL) for engine-independent hashes.

    ``round(x * 10^d) / 10^d`` on the binary double — the same arithmetic DuckDB's
    ``round(x, d)`` performs — so exact half-steps land on the same side in both.
    """
    scale = float(10 ** digits)
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.col(f"`{f.name}`").cast("double")
            out.append(F.when(F.isnan(c), F.lit(None).cast("double"))
                       .when(c.isin(float("inf"), float("-inf")), c)
                       .otherwise(F.round(c * scale, 0) / scale).alias(f.name))
        else:
            out.append(F.col(f"`{f.name}`"))
    return df.select(*out)

"""Isotonic calibration: the increasing step function of the score nearest to the outcomes.

Pool-adjacent-violators gives the same blocks in whatever order violators are pooled. So tasks pool the
blocks of one range slice each; where the last block of a slice lies above the first of the next, the
blocks are cut into other slices and pooled again, until none does. Blocks stay on the executors; each
round reads only what the last one left.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import free_names, named
from .ordered import BROADCAST_BYTES, freeze, prefix_sum, range_bounds, slice_of, table_bytes

#: blocks that one task pools at once
SLICE_BLOCKS = 50_000
SCHEMA = "part long, lo double, hi double, w double, s double"


def pool(w: np.ndarray, s: np.ndarray) -> np.ndarray:
    """First positions of the pooled blocks of weights ``w`` and sums ``s``: every run of falling or equal means
    is one block, until means rise throughout."""
    starts = np.arange(len(w))
    while len(starts) > 1:
        weight, total = np.add.reduceat(w, starts), np.add.reduceat(s, starts)
        rises = total[:-1] * weight[1:] < total[1:] * weight[:-1]  # mean before < mean after
        if rises.all():
            break
        starts = starts[np.concatenate([[True], rises])]
    return starts


def _pool_slices(batches):
    """Rows sorted by slice and ``lo``: the pooled blocks of each slice."""
    def pooled(held: pa.Table) -> pa.RecordBatch:
        part, lo, hi, w, s = (held.column(i).to_numpy() for i in range(5))
        at = pool(w, s)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (part[at], lo[at], hi[np.append(at[1:], len(hi)) - 1],
                                                                 np.add.reduceat(w, at), np.add.reduceat(s, at))],
                                          names=["part", "lo", "hi", "w", "s"])
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        part = batch.column(0).to_numpy()
        edges = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
        for a, b in zip(edges[:-1], edges[1:]):
            if held and held[-1].column(0)[0].as_py() != part[a]:
                yield pooled(pa.Table.from_batches(held))
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pooled(pa.Table.from_batches(held))


def fit_isotonic(df: DataFrame, y: str = "y", score: str = "score") -> DataFrame:
    """The blocks (lo, hi, w, value), one row each: scores from lo to hi have the mean outcome ``value``.

    Rows without a score or an outcome don't count. An empty table gives no blocks.
    """
    x, t = named(score).cast("double"), named(y).cast("double")
    groups = df.where(x.isNotNull() & ~F.isnan(x) & t.isNotNull() & ~F.isnan(t)).groupBy((x + 0.0).alias("lo")).agg(
        F.count(F.lit(1)).cast("double").alias("w"), F.sum(t).alias("s"))
    blocks = freeze(groups.select("lo", F.col("lo").alias("hi"), "w", "s"), "scores")
    turn = 0
    while True:
        n = blocks.count()
        slices = max(1, -(-n // SLICE_BLOCKS))
        # every other round cuts in the middle of the last one's slices
        bounds = range_bounds(blocks, ["lo"], 2 * slices)[turn % 2::2] if slices > 1 else []
        dealt = blocks.select(slice_of(blocks, ["lo"], bounds).cast("long").alias("part"), "lo", "hi", "w", "s")
        pooled = dealt.repartition(max(1, len(bounds) + 1), "part").sortWithinPartitions("part", "lo").mapInArrow(_pool_slices, SCHEMA)
        blocks = freeze(pooled, "blocks")
        turn += 1
        if not bounds:
            break
        # one row per slice: does its first block lie below the last one of the slice before?
        ends = blocks.groupBy("part").agg(F.min_by(F.struct("w", "s"), "lo").alias("first"), F.max_by(F.struct("w", "s"), "lo").alias("last"))
        before = F.lag("last").over(Window.partitionBy(F.pmod(F.hash("part"), F.lit(1))).orderBy("part"))
        falls = before["s"] * F.col("first.w") >= F.col("first.s") * before["w"]
        if not ends.select(falls.alias("falls")).where("falls").head(1):
            break
    return blocks.select("lo", "hi", "w", (F.col("s") / F.col("w")).alias("value"))


def apply_isotonic(blocks: DataFrame, df: DataFrame, score: str = "score", out: str = "calibrated",
                   limit: int = BROADCAST_BYTES) -> DataFrame:
    """Add ``out``: the block's value, between two blocks the straight line from one to the other, beyond the
    ends the first or last value; NULL for a missing score or without blocks.

    Blocks of up to ``limit`` bytes go to every task (rising means of m blocks of 0/1 outcomes need at least
    about m^1.5 rows, so there are few); beyond, rows and blocks are put in one order and joined by place.
    """
    blocks = freeze(blocks, "isotonic")
    x = named(score).cast("double")
    known = x.isNotNull() & ~F.isnan(x)
    if table_bytes(blocks) <= limit:
        rows = sorted(tuple(r) for r in blocks.select("lo", "hi", "value").collect())
        if not rows:
            return df.withColumn(out, F.lit(None).cast("double"))
        shared = df.sparkSession.sparkContext.broadcast(
            (np.array([v for r in rows for v in r[:2]]), np.repeat([r[2] for r in rows], 2)))

        @F.pandas_udf("double")
        def steps(values: pd.Series) -> pd.Series:
            at, to = shared.value
            return pd.Series(np.interp(values.to_numpy(dtype=float, na_value=np.nan), at, to))
        return df.withColumn(out, F.when(known, steps(x)))
    place, row, point = free_names(df.columns, ["place", "row", "x"])
    marks = blocks.select(F.col("lo").alias("x"), F.lit(0).alias("kind"), F.lit(1).cast("long").alias("one"), F.lit(None).cast("long").alias("row"))
    rows = freeze(df.withColumn(row, F.monotonically_increasing_id()), "rows")
    asked = rows.where(known).select((x + 0.0).alias("x"), F.lit(1).alias("kind"), F.lit(0).cast("long").alias("one"), F.col(row).alias("row"))
    run = freeze(prefix_sum(marks.unionByName(asked), [], ["x", "kind", "row"], ["one"], prefix="at_"), "places")
    numbered = run.where("kind = 0").select("at_one", "x").join(blocks.withColumnRenamed("lo", "x"), "x").select(
        F.col("at_one").alias("k"), F.col("x").alias("lo"), "hi", "value")
    here = numbered.select("k", "lo", "hi", "value")
    after = numbered.select((F.col("k") - 1).alias("k"), F.col("lo").alias("lo2"), F.col("value").alias("value2"))
    steps = here.join(after, "k", "full")
    found = run.where("kind = 1").select(F.col("row").alias(row), F.col("x").alias(point), F.col("at_one").alias("k")).join(steps, "k")
    line = F.col("value") + (F.col("value2") - F.col("value")) * (F.col(point) - F.col("hi")) / (F.col("lo2") - F.col("hi"))
    value = (F.when(F.col("value").isNull(), F.col("value2")).when(F.col("value2").isNull() | (F.col(point) <= F.col("hi")), F.col("value"))
             .otherwise(line))
    return rows.join(found.select(row, value.alias(place)), row, "left").select(
        *[named(c) for c in df.columns if c != out], F.col(place).alias(out))

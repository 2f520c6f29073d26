"""Second-order boosting on histograms.

Features are binned once at evenly spaced exact quantiles. A tree grows level by level: one grouped
aggregate gives the sums of gradients and Hessians of every (node, feature, bin), and one row per node
comes back, its best split. Rows with a missing value go to the side where they raise the gain; a
split must gain more than ``gamma``, leaf weights are shrunk by ``reg_lambda``, and each tree sees a hashed
share of the features.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import inline_rows, named
from .encode import even_quantiles
from .ordered import freeze

#: trees between two writes of the rows' margins; an expression of more trees would grow without need
TREES_A_WRITE = 10


@dataclass(frozen=True)
class Settings:
    n_estimators: int = 100
    max_depth: int = 3
    learning_rate: float = 0.1
    reg_lambda: float = 1.0
    gamma: float = 0.0
    min_child_weight: float = 1.0
    colsample_bytree: float = 1.0
    max_bins: int = 256
    seed: int = 1000


@dataclass
class Tree:
    """Splits (feature, threshold, whether missing values go left, gain) and leaf weights by node; the children
    of node k are 2 k + 1 (at most the threshold) and 2 k + 2."""
    splits: dict[int, tuple[int, float, bool, float]] = field(default_factory=dict)
    leaves: dict[int, float] = field(default_factory=dict)

    def weight(self, features: Sequence[Column], node: int = 0) -> Column:
        if node not in self.splits:
            return F.lit(self.leaves[node])
        f, threshold, missing_left, _ = self.splits[node]
        left = F.coalesce(features[f] <= threshold, F.lit(missing_left))
        return F.when(left, self.weight(features, 2 * node + 1)).otherwise(self.weight(features, 2 * node + 2))


def cleaned(c: str) -> Column:
    x = named(c).cast("double")
    return F.when(~F.isnan(x), x)


def edges_of(df: DataFrame, features: Sequence[str], max_bins: int) -> list[np.ndarray]:
    """Per feature the thresholds of its bins: a value's bin is the number of thresholds below it."""
    values = df.select(*[cleaned(c).alias(f"x{i}") for i, c in enumerate(features)])
    found: dict[str, set] = {}
    for r in even_quantiles(values, values.columns, max_bins + 1).collect():  # max_bins + 1 numbers a feature
        found.setdefault(r["column"], set()).add(r["value"])
    return [np.array(sorted(found.get(c, ()))[:-1], float) for c in values.columns]  # the last value has no right side


def binned(df: DataFrame, features: Sequence[str], y: str, edges: list[np.ndarray]) -> DataFrame:
    """y, m (margin 0) and b0, b1, ...: the bin of each feature, -1 where it is missing; frozen."""
    names = [f"b{i}" for i in range(len(features))]

    def run(batches):
        for batch in batches:
            columns = [batch.column(0)]
            for x, e in zip(batch.columns[1:], edges):
                v = x.to_numpy(zero_copy_only=False)
                columns.append(pa.array(np.where(np.isnan(v), -1, np.searchsorted(e, v, "left")).astype(np.int32)))
            yield pa.RecordBatch.from_arrays(columns, names=["y", *names])

    rows = df.where(named(y).isNotNull()).select(named(y).cast("double").alias("y"), *[cleaned(c) for c in features])
    return freeze(rows.mapInArrow(run, "y double, " + ", ".join(f"{n} int" for n in names)).withColumn("m", F.lit(0.0)), "binned")


def split_gains(rows: DataFrame, features: Sequence[int], s: Settings) -> DataFrame:
    """node, feature, bin, missing_left and gain of every allowed split of each node's rows, with the node's sums
    G and H. ``rows``: node, g, h and the bins."""
    long = inline_rows(rows, [{"feature": F.lit(i), "bin": F.col(f"b{i}")} for i in features], ["node", "g", "h"])
    sums = long.groupBy("node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
    own = Window.partitionBy("node", "feature")  # at most max_bins + 1 rows
    upto = own.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = F.col("bin") >= 0

    def of(c: str, w: Window, only: Column) -> Column:
        return F.coalesce(F.sum(F.when(only, F.col(c))).over(w), F.lit(0.0))

    sums = sums.select("node", "feature", "bin", of("g", upto, seen).alias("gl"), of("h", upto, seen).alias("hl"),
                       of("g", own, ~seen).alias("gm"), of("h", own, ~seen).alias("hm"),
                       F.sum("g").over(own).alias("G"), F.sum("h").over(own).alias("H"), F.max("bin").over(own).alias("last"))
    sides = sums.where(seen & (F.col("bin") < F.col("last"))).withColumn("missing_left", F.explode(F.array(F.lit(True), F.lit(False))))
    gl = F.col("gl") + F.when(F.col("missing_left"), F.col("gm")).otherwise(0.0)
    hl = F.col("hl") + F.when(F.col("missing_left"), F.col("hm")).otherwise(0.0)
    gr, hr = F.col("G") - gl, F.col("H") - hl

    def score(g: Column, h: Column) -> Column:
        return F.try_divide(g * g, h + s.reg_lambda)
    gain = 0.5 * (score(gl, hl) + score(gr, hr) - score(F.col("G"), F.col("H"))) - s.gamma
    return sides.where((hl >= s.min_child_weight) & (hr >= s.min_child_weight)).select(
        "node", "feature", "bin", "missing_left", gain.alias("gain"), "G", "H")


def best_of(gains: DataFrame, by: Sequence[str]) -> DataFrame:
    """The split of the largest gain per ``by``; to 9 digits equal ones go to the smallest feature, then bin, then left."""
    order = F.struct(F.round("gain", 9).alias("gain"), (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"), "missing_left")
    best = gains.groupBy(*by).agg(F.max_by(F.struct("feature", "bin", "missing_left", "gain"), order).alias("s"))
    return best.select(*by, *[F.col(f"s.{c}") for c in ("feature", "bin", "missing_left", "gain") if c not in by])


def grow(rows: DataFrame, edges: list[np.ndarray], features: list[int], s: Settings) -> Tree:
    """One tree on ``rows`` (y, m and the bins)."""
    p = 1.0 / (1.0 + F.exp(-F.col("m")))
    rows = rows.withColumns({"g": p - F.col("y"), "h": p * (1.0 - p)})
    tree, node, open_nodes = Tree(), F.lit(0), [0]
    sums: dict[int, tuple[float, float]] = {}
    for depth in range(s.max_depth + 1):
        here = rows.withColumn("node", node).where(F.col("node").isin(open_nodes))
        # one row per node of the level: at most 2^depth
        for r in here.groupBy("node").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect():
            sums[r["node"]] = r["g"], r["h"]
        found = {r["node"]: r for r in best_of(split_gains(here, features, s), ["node"]).collect()} if depth < s.max_depth else {}
        after = []
        for k in open_nodes:
            r = found.get(k)
            if r is None or not r["gain"] > 0:
                g, h = sums.get(k, (0.0, 0.0))
                tree.leaves[k] = -g / (h + s.reg_lambda) * s.learning_rate if h + s.reg_lambda > 0 else 0.0
                continue
            tree.splits[k] = r["feature"], float(edges[r["feature"]][r["bin"]]), bool(r["missing_left"]), float(r["gain"])
            b = F.col(f"b{r['feature']}")
            left = (b <= r["bin"]) & ((b >= 0) | F.lit(bool(r["missing_left"])))
            node = F.when(node == k, F.when(left, 2 * k + 1).otherwise(2 * k + 2)).otherwise(node)
            after += [2 * k + 1, 2 * k + 2]
        if not after:
            break
        open_nodes = after
    return tree


def bin_weight(tree: Tree, edges: list[np.ndarray], node: int = 0) -> Column:
    """The tree's weight from bins."""
    if node not in tree.splits:
        return F.lit(tree.leaves[node])
    f, threshold, missing_left, _ = tree.splits[node]
    b = F.col(f"b{f}")
    left = (b <= int(np.searchsorted(edges[f], threshold))) & ((b >= 0) | F.lit(missing_left))
    return F.when(left, bin_weight(tree, edges, 2 * node + 1)).otherwise(bin_weight(tree, edges, 2 * node + 2))


def fit_trees(df: DataFrame, features: Sequence[str], y: str, s: Settings) -> list[Tree]:
    """Trees for the log-odds of ``y`` = 1. Rows without a label don't count; without rows there are no trees."""
    edges = edges_of(df, features, s.max_bins)
    rows = binned(df, features, y, edges)
    if not rows.head(1):
        return []
    able = [i for i, e in enumerate(edges) if len(e)]
    take = max(1, math.ceil(s.colsample_bytree * len(able)))
    trees: list[Tree] = []
    for t in range(s.n_estimators):
        some = sorted(sorted(able, key=lambda i: hashlib.md5(f"{s.seed}:{t}:{i}".encode()).hexdigest())[:take])
        if not some:
            break
        tree = grow(rows, edges, some, s)
        trees.append(tree)
        rows = rows.withColumn("m", F.col("m") + bin_weight(tree, edges))
        if (t + 1) % TREES_A_WRITE == 0 and t + 1 < s.n_estimators:
            rows = freeze(rows, "margins")
    return trees


def margin(trees: list[Tree], features: Sequence[str]) -> Column:
    columns = [cleaned(c) for c in features]
    return sum((t.weight(columns) for t in trees), F.lit(0.0))

"""Random forests from counts of binned rows.

A tree tells rows apart by their bins and label only, so rows that agree in these form a cell, and a row's Poisson(1)
draw for a tree becomes its cell's Poisson(count) draw: the sum of its rows' draws. Spark counts the cells of
every row in one pass and grows the trees side by side. Bins, splits, feature subsets, leaves and the merging of leaves
that predict the same follow MLlib's ``RandomForestClassifier``; the random draws are other ones than MLlib's,
and don't depend on how the rows are partitioned.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

#: most cells (bins of all features and the label) that are counted, and rows a possible cell from which it pays
MOST_CELLS, ROWS_A_CELL = 1 << 17, 4
#: MLlib takes the thresholds of bins from this many rows, or from max_bins squared if that is more
ROWS_FOR_EDGES = 10_000
#: deepest tree grown here; nodes are numbered as in a full tree
DEEPEST = 12


@dataclass(frozen=True)
class Settings:
    n_estimators: int = 100
    max_depth: int = 5
    min_samples_leaf: int = 1
    max_features: str = "sqrt"
    max_bins: int = 32
    seed: int = 1000

    def taken(self, n: int) -> int:
        """Features tried at a node."""
        return {"all": n, "sqrt": math.ceil(math.sqrt(n)), "log2": max(1, math.ceil(math.log2(n)))}[self.max_features]


@dataclass
class Cells:
    """Counted cells: every feature's bin, the label and the number of rows."""
    edges: list[np.ndarray]
    bins: np.ndarray
    label: np.ndarray
    count: np.ndarray


def thresholds(values: np.ndarray, max_bins: int) -> np.ndarray:
    """Midpoints between neighbouring values: all of them if there are fewer than ``max_bins``, otherwise those nearest to every
    ``max_bins``-th part of the rows."""
    v, c = np.unique(values, return_counts=True)
    middle = (v[:-1] + v[1:]) / 2.0
    if len(middle) < max_bins:
        return middle
    upto, stride = np.cumsum(c).tolist(), len(values) / max_bins
    found, target = [], stride
    for i, m in enumerate(middle.tolist()):
        if abs(upto[i] - target) < abs(upto[i + 1] - target):
            found.append(m)
            target += stride
    return np.array(found[:max_bins - 1])


def count_cells(frame: DataFrame, features: Sequence[str], label: str, row_id: str, s: Settings) -> Cells | None:
    """The cells of all rows of ``frame``; None where counting doesn't pay (few rows a possible cell) or a value isn't
    finite or a label isn't 0 or 1."""
    n, xs = len(features), [F.col(c) for c in features]
    if not n or s.max_depth > DEEPEST or s.max_bins < 2:
        return None
    finite = [x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")) for x in xs]
    odd = ~F.coalesce(F.col(label).isin(0.0, 1.0), F.lit(False))
    for ok in finite:
        odd = odd | ~ok
    known = frame.agg(F.count(F.lit(1)).alias("rows"), F.count_if(odd).alias("odd"), F.max(label).alias("last")).first()
    if known["rows"] < ROWS_FOR_EDGES or known["odd"] or known["last"] != 1.0:
        return None
    wanted = max(s.max_bins * s.max_bins, ROWS_FOR_EDGES)
    spread = F.pmod(F.xxhash64(F.col(row_id), F.lit(s.seed)), F.lit(1 << 30)) / float(1 << 30)
    some = np.array(frame.where(spread < wanted / known["rows"]).select(*xs).collect(), float).reshape(-1, n)  # about ``wanted`` rows
    edges = [thresholds(some[:, f], s.max_bins) for f in range(n)]
    sizes = [len(e) + 1 for e in edges] + [2]
    most = math.prod(sizes)
    if most > MOST_CELLS or known["rows"] < ROWS_A_CELL * most:
        return None

    def run(batches):
        acc = np.zeros(most, np.int64)
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            places = [np.searchsorted(e, x, "left") for e, x in zip(edges, columns)] + [columns[-1].astype(np.int64)]
            acc += np.bincount(np.ravel_multi_index(places, sizes), minlength=most)
        cell = np.flatnonzero(acc)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(acc[cell])], names=["cell", "n"])

    counted = frame.select(*xs, label).mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    found = np.array(sorted(map(tuple, counted.collect())), np.int64)  # at most MOST_CELLS
    *bins, y = np.unravel_index(found[:, 0], sizes)
    return Cells(edges, np.stack(bins).astype(np.int32), y.astype(np.int32), found[:, 1])


@dataclass
class FoldCells:
    """Counted cells of one fold, as ``Cells`` with the fold's own edges: training rows, and the rows of the fold."""
    train: Cells
    test: np.ndarray


def count_folds(frame: DataFrame, features: Sequence[str], label: str, row_id: str, fold: str, k: int, max_bins: int, seed: int = 1000) -> list[FoldCells] | None:
    """The cells of all rows for each of ``k`` folds, binned by thresholds of that fold's training rows, in one pass; None where counting
    doesn't pay or a value or label is odd (as ``count_cells``)."""
    n, xs = len(features), [F.col(c) for c in features]
    if not n or max_bins < 2:
        return None
    odd = ~F.coalesce(F.col(label).isin(0.0, 1.0), F.lit(False))
    for x in xs:
        odd = odd | x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    known = {r[fold]: r for r in frame.groupBy(fold).agg(F.count(F.lit(1)).alias("rows"), F.count_if(odd).alias("odd"), F.max(label).alias("last")).collect()}  # k rows
    others = [[r for g, r in known.items() if g != f] for f in range(k)]
    least = min(sum(r["rows"] for r in part) for part in others)
    if least < ROWS_FOR_EDGES or any(r["odd"] for r in known.values()) or any(max(r["last"] for r in part) != 1.0 for part in others):
        return None
    wanted = max(max_bins * max_bins, ROWS_FOR_EDGES)
    spread = F.pmod(F.xxhash64(F.col(row_id), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    some = np.array(frame.where(spread < wanted / least).select(*xs, fold).collect(), float).reshape(-1, n + 1)  # about ``wanted`` rows a training part
    edges = [[thresholds(some[some[:, n] != f, i], max_bins) for i in range(n)] for f in range(k)]
    sizes = [[len(e) + 1 for e in own] + [2, 2] for own in edges]  # bins, label, training or test
    most = [math.prod(s) for s in sizes]
    if max(most) > 2 * MOST_CELLS or 2 * least < ROWS_A_CELL * max(most):
        return None
    # a row is placed once among the edges of all folds; a table per fold tells its own bin from that place
    every = [np.unique(np.concatenate([own[i] for own in edges])) for i in range(n)]
    tables = [[np.append(np.searchsorted(own[i], every[i], "left"), len(own[i])) * math.prod(s[i + 1:]) for i in range(n)] for own, s in zip(edges, sizes)]

    def run(batches):
        acc = [np.zeros(m, np.int64) for m in most]
        for batch in batches:
            *columns, y, own = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            places = [np.searchsorted(e, x, "left") for e, x in zip(every, columns)]
            ones = 2 * y.astype(np.int64)
            for f in range(k):
                cell = ones + (own == f)
                for table, place in zip(tables[f], places):
                    cell += table[place]
                acc[f] += np.bincount(cell, minlength=most[f])
        for f, a in enumerate(acc):
            cell = np.flatnonzero(a)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cell), f)), pa.array(cell), pa.array(a[cell])], names=["f", "cell", "n"])

    counted = frame.select(*xs, label, F.col(fold).cast("long")).mapInArrow(run, "f long, cell long, n long").groupBy("f", "cell").agg(F.sum("n").alias("n"))
    table = counted.toArrow()  # at most 2 * MOST_CELLS a fold
    f, cell, count = (table.column(c).to_numpy() for c in ("f", "cell", "n"))
    out = []
    for i in range(k):
        both = np.zeros(most[i], np.int64)
        both[cell[f == i]] = count[f == i]
        both = both.reshape(-1, 2)
        at = np.flatnonzero(both.any(1))
        *bins, y = np.unravel_index(at, sizes[i][:-1])
        out.append(FoldCells(Cells(edges[i], np.stack(bins).astype(np.int32), y.astype(np.int32), both[at, 0]), both[at, 1]))
    return out


def _gini(c: np.ndarray) -> np.ndarray:
    total = np.maximum(c.sum(-1, keepdims=True), 1e-300)
    return 1.0 - ((c / total) ** 2).sum(-1)


def grow(cells: Cells, weight: np.ndarray, s: Settings, rng: np.random.Generator) -> dict[int, tuple]:
    """One tree on the cells' weights: node -> (feature, bin, gain, weight of label 0, of label 1), a leaf's feature is -1.
    The children of node k are 2 k + 1 (bins up to the split's) and 2 k + 2."""
    n, take = len(cells.bins), s.taken(len(cells.bins))
    node, nodes, level = np.zeros(len(weight), np.int64), {}, np.array([0])
    own = weight > 0
    bins, label, weight, node = cells.bins[:, own], cells.label[own], weight[own].astype(float), node[own]
    for depth in range(s.max_depth + 1):
        slot = np.searchsorted(level, node)
        total = np.bincount(2 * slot + label, weight, 2 * len(level)).reshape(-1, 2)
        best = np.zeros(len(level))
        feature, cut = np.full(len(level), -1), np.full(len(level), -1)
        if depth < s.max_depth:
            tried = np.argsort(rng.random((len(level), n)), axis=1)[:, :take]
            for f in range(n):
                size = len(cells.edges[f]) + 1
                if size == 1:
                    continue
                left = np.bincount(2 * (slot * size + bins[f]) + label, weight, 2 * size * len(level)).reshape(-1, size, 2).cumsum(1)[:, :-1]
                right = total[:, None] - left
                a, b = left.sum(-1), right.sum(-1)
                gain = _gini(total)[:, None] - (a * _gini(left) + b * _gini(right)) / (a + b)
                gain[(a < s.min_samples_leaf) | (b < s.min_samples_leaf)] = -1.0
                at = gain.argmax(1)
                top = np.where((tried == f).any(1), gain[np.arange(len(level)), at], -1.0)
                feature, cut, best = np.where(top > best, f, feature), np.where(top > best, at, cut), np.maximum(top, best)
        for i, k in enumerate(level.tolist()):
            nodes[k] = (int(feature[i]), int(cut[i]), float(best[i]), float(total[i, 0]), float(total[i, 1]))
        going = feature[slot] >= 0
        bins, label, weight, node, slot = bins[:, going], label[going], weight[going], node[going], slot[going]
        if not len(node):
            break
        node = 2 * node + 1 + (bins[feature[slot], np.arange(len(slot))] > cut[slot])
        split = level[feature >= 0]
        level = np.sort(np.concatenate([2 * split + 1, 2 * split + 2]))
    return merged(nodes)


def merged(nodes: dict[int, tuple]) -> dict[int, tuple]:
    """Two leaves of one parent that predict the same become one, from the bottom up."""
    nodes = dict(nodes)
    for k in sorted(nodes, reverse=True):  # children come before their parents
        if nodes[k][0] >= 0:
            a, b = nodes[2 * k + 1], nodes[2 * k + 2]
            if a[0] < 0 and b[0] < 0 and (a[4] > a[3]) == (b[4] > b[3]):
                nodes[k] = (-1, -1, 0.0, *nodes[k][3:])
                del nodes[2 * k + 1], nodes[2 * k + 2]
    return nodes


NODES = "tree int, node int, feature int, bin int, gain double, zeros double, ones double"


def grow_trees(spark: SparkSession, cells: Cells, s: Settings) -> np.ndarray:
    """Every tree's nodes as rows of ``NODES``, ordered by tree and node; each tree is drawn and grown in a task."""
    def run(batches):
        for batch in batches:
            for t in batch.column(0).to_pylist():
                rng = np.random.default_rng([s.seed, t])
                tree = grow(cells, rng.poisson(cells.count), s, rng)
                rows = [(t, k, *v) for k, v in tree.items()]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["tree", "node", "feature", "bin", "gain", "zeros", "ones"])
    trees = spark.range(0, s.n_estimators, 1, max(1, min(s.n_estimators, spark.sparkContext.defaultParallelism)))
    found = trees.mapInArrow(run, NODES.replace(" int", " long")).collect()  # the forest: at most 2^(max_depth + 1) rows a tree
    return np.array(sorted(map(tuple, found)), float)


def grow_each(spark: SparkSession, folds: Sequence[FoldCells], asked: Sequence[tuple[int, Settings]]) -> list[dict[int, tuple]]:
    """A tree without draws per (fold, settings), from its training rows; each is grown in a task."""
    def run(batches):
        for batch in batches:
            for t in batch.column(0).to_pylist():
                f, s = asked[t]
                tree = grow(folds[f].train, folds[f].train.count, s, np.random.default_rng(s.seed))
                rows = [(t, k, *v) for k, v in tree.items()]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["tree", "node", "feature", "bin", "gain", "zeros", "ones"])
    numbers = spark.range(0, len(asked), 1, max(1, min(len(asked), spark.sparkContext.defaultParallelism)))
    out: list[dict[int, tuple]] = [{} for _ in asked]
    for r in numbers.mapInArrow(run, NODES.replace(" int", " long")).collect():  # at most 2^(max_depth + 1) rows a tree
        out[r["tree"]][r["node"]] = tuple(r)[2:]
    return out


def shares(nodes: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """The forest's score of every possible combination of bins: the mean share of label 1 in the trees' leaves."""
    sizes = [len(e) + 1 for e in edges]
    places = np.stack(np.unravel_index(np.arange(math.prod(sizes)), sizes))
    trees, total = np.unique(nodes[:, 0]), np.zeros(places.shape[1])
    for t in trees:
        own = nodes[nodes[:, 0] == t]
        row = np.zeros(int(own[:, 1].max()) + 1, np.int64)
        row[own[:, 1].astype(np.int64)] = np.arange(len(own))
        feature, cut, number = (own[:, c].astype(np.int64) for c in (2, 3, 1))
        at = np.zeros(places.shape[1], np.int64)  # the root comes first
        while (inner := np.flatnonzero(feature[at] >= 0)).size:
            here = at[inner]
            at[inner] = row[2 * number[here] + 1 + (places[feature[here], inner] > cut[here])]
        total += (own[:, 6] / (own[:, 5] + own[:, 6]))[at]
    return total / len(trees)


def importances(nodes: np.ndarray, n: int) -> list[float]:
    """Gains weighted by their nodes' rows, per tree in shares; their mean in shares."""
    out = np.zeros(n)
    for t in np.unique(nodes[:, 0]):
        own = nodes[(nodes[:, 0] == t) & (nodes[:, 2] >= 0)]
        gains = np.bincount(own[:, 2].astype(np.int64), own[:, 4] * (own[:, 5] + own[:, 6]), n)
        out += gains / (gains.sum() or 1.0)
    return [float(x) for x in out / (out.sum() or 1.0)]


def score(table: np.ndarray, edges: list[np.ndarray], features: Sequence[Column]) -> Column:
    """P(class 1) of a row; a missing value counts as the largest."""
    sizes = [len(e) + 1 for e in edges]

    @pandas_udf("double")
    def of(x: pd.DataFrame) -> pd.Series:
        places = [np.searchsorted(e, x.iloc[:, i].to_numpy(dtype=float, na_value=np.nan), "left") for i, e in enumerate(edges)]
        return pd.Series(table[np.ravel_multi_index(places, sizes)])
    return of(F.struct(*features))

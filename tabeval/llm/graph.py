"""Connected components of a table of links, and helpers for tasks that find links in groups."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import freeze


def components(links: DataFrame, rows: int) -> DataFrame:
    """node and component (its smallest node) of every node in ``links`` (columns a, b; about ``rows``).

    Each round a node takes the smallest label around it, then the label of its label, until nothing
    changes. Rounds are written to the shared folder; links and labels never leave the executors.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = freeze(both, "links", 2 * rows)
    labels = freeze(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("component")), "labels", rows)
    while True:
        around = both.join(labels.withColumnRenamed("node", "b"), "b").select(F.col("a").alias("node"), "component")
        least = around.union(labels).groupBy("node").agg(F.min("component").alias("component"))
        least = freeze(least, "labels", rows)
        above = least.select(F.col("node").alias("component"), F.col("component").alias("top"))
        new = freeze(least.join(above, "component").select("node", F.col("top").alias("component")), "labels", rows)
        old = labels.select("node", F.col("component").alias("was"))
        changed = new.join(old, "node").where("component <> was").limit(1).count()
        labels = new
        if not changed:
            return labels


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the same nodes as a to b do, at most one a node: each to the smallest of its component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, low = at[:len(a)], at[len(a):], np.arange(len(nodes))
    while True:
        least, old = np.minimum(low[x], low[y]), low.copy()
        np.minimum.at(low, x, least)
        np.minimum.at(low, y, least)
        low = low[low]
        if (low == old).all():
            break
    other = np.flatnonzero(low != np.arange(len(nodes)))
    return nodes[other], nodes[low[other]]


class Forest:
    """Union-find over the links that one task has seen; keeps a star of links per tree."""

    def __init__(self):
        self.above: dict[int, int] = {}

    def top(self, x: int) -> int:
        above = self.above
        root = x
        while (up := above.get(root, root)) != root:
            root = up
        while (up := above.get(x, x)) != root:
            above[x] = root
            x = up
        return root

    def link(self, a, b) -> None:
        a, b = spanning(a, b)
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            x, y = self.top(x), self.top(y)
            if x != y:
                self.above[max(x, y)] = min(x, y)
                self.above.setdefault(min(x, y), min(x, y))

    def star(self) -> tuple[np.ndarray, np.ndarray]:
        """Every node that isn't a root, with its root."""
        nodes = [x for x, up in self.above.items() if x != up]
        return np.array(nodes, np.int64), np.array([self.top(x) for x in nodes], np.int64)


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Rows sorted by their first ``keys`` columns, as tables that end where a run of equal keys ends."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, bool)
        for k in range(keys):
            x = batch.column(k).to_numpy(zero_copy_only=False)
            change[1:] |= x[1:] != x[:-1]
        cuts = np.flatnonzero(change)
        if held and all(held[-1].column(k)[-1] == batch.column(k)[0] for k in range(keys)):
            if not len(cuts):
                held.append(batch)
                continue
            first = int(cuts[0])
            yield pa.Table.from_batches([*held, batch.slice(0, first)])
            batch, cuts, held = batch.slice(first), cuts[1:] - first, []
        elif held:
            yield pa.Table.from_batches(held)
            held = []
        if len(cuts):
            yield pa.Table.from_batches([batch.slice(0, int(cuts[-1]))])
            batch = batch.slice(int(cuts[-1]))
        held = [batch]
    if held:
        yield pa.Table.from_batches(held)


def in_block_pairs(rows: DataFrame, group: str, node: str, weight: str, most: int, most_rows: int, count: int) -> DataFrame:
    """Deal each group's rows to tasks that can hold them: a group whose weights or rows exceed the
    bounds is cut in blocks, and every pair of blocks meets in one place. ``count``: of the rows.

    Adds _i and _j (the pair of blocks) and _mine (the row's own block). A row is copied once for each
    block of its group, so copies grow with a group's size, tasks don't.
    """
    sizes = rows.groupBy(group).agg(F.greatest(F.ceil(F.sum(weight) / most), F.ceil(F.count("*") / most_rows)).cast("int").alias("_blocks"))
    cut = freeze(sizes.where("_blocks > 1"), "blocks", count // most_rows)
    dealt = rows.join(cut, group, "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(1)))
    dealt = dealt.withColumn("_mine", F.pmod(F.xxhash64(node), F.col("_blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_other")
    dealt = dealt.select("*", other)
    return (dealt.withColumn("_i", F.least("_mine", "_other")).withColumn("_j", F.greatest("_mine", "_other"))
            .drop("_blocks", "_other"))


def tasks_for(rows: int, per_task: int) -> int:
    """Tasks for so many rows; grows with them, and small steps don't write dozens of tiny files."""
    return max(1, -(-rows // per_task))


def table_of(a: np.ndarray, b: np.ndarray, links: np.ndarray) -> pa.RecordBatch:
    """A star link (a to b) and the weight of links counted at a; b is null in rows that only count."""
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64(), mask=b == NO_NODE), pa.array(links, pa.int64())],
                                      names=["a", "b", "links"])


NO_NODE = np.iinfo(np.int64).min
LINK_SCHEMA = "a long, b long, links long"


def found_in_groups(dealt: DataFrame, keys: list[str], columns: list[str], work: Callable, tasks: int) -> DataFrame:
    """Run ``work(table, forest) -> (nodes, links)`` over each group of rows with equal ``keys``; it adds
    links to the forest and returns link counts. Result: LINK_SCHEMA."""
    ordered = dealt.select(*keys, *columns).repartition(tasks, *keys).sortWithinPartitions(*keys)
    n = len(keys)

    def run(batches):
        forest, counts = Forest(), []
        for table in runs(batches, n):
            change = np.zeros(table.num_rows, bool)
            for k in range(n):
                x = table.column(k).to_numpy()
                change[1:] |= x[1:] != x[:-1]
            edges = [0, *np.flatnonzero(change).tolist(), table.num_rows]
            for begin, end in zip(edges[:-1], edges[1:], strict=True):
                if end - begin > 1:
                    got = work(table.slice(begin, end - begin), forest)
                    if got is not None:
                        counts.append(got)
            if sum(len(x) for x, _ in counts) > 100_000:
                nodes, links = (np.concatenate(x) for x in zip(*counts, strict=True))
                yield table_of(nodes, np.full(len(nodes), NO_NODE), links)
                counts = []
        if counts:
            nodes, links = (np.concatenate(x) for x in zip(*counts, strict=True))
            yield table_of(nodes, np.full(len(nodes), NO_NODE), links)
        nodes, roots = forest.star()
        yield table_of(nodes, roots, np.zeros(len(nodes), np.int64))

    return ordered.mapInArrow(run, LINK_SCHEMA)

"""Exact cosine join of embeddings by the pigeonhole principle over subspaces.

Unit vectors of cosine c lie at squared distance 2 - 2c. After a rotation the dimensions are split into
blocks; if the whole squared distance is within the budget, at least one block's is within that block's
share of it. So every block is joined by range on its own (slabs along the block's first dimension, a
sweep over sorted rows, then the block's distances), and the union of these candidates is checked in full, in
double precision. Evenly spread vectors fall apart little along any one dimension, so more grid dimensions
or smaller blocks would make more copies than they save comparisons.
A pair is counted in the first block that finds it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph
from .common import freeze, small_batches

COSINE = 0.93
BLOCK_DIMS = 16
#: vectors in one block of a slab
CELL_ROWS = 4096
#: copies of vectors that one task compares
COPIES_A_TASK = 100_000
#: pairs checked at once, and rows compared with those after them
PAIRS, SWEPT = 1 << 16, 256
#: slack of candidate tests, over any rounding; the check that follows is exact
SLACK = 1e-4


def rotation(dims: int) -> np.ndarray:
    """The same random orthogonal matrix on every executor."""
    q, r = np.linalg.qr(np.random.default_rng(dims).normal(size=(dims, dims)))
    return q * np.sign(np.diag(r))


def blocks(dims: int) -> list[tuple[int, int]]:
    return [(k, min(k + BLOCK_DIMS, dims)) for k in range(0, dims, BLOCK_DIMS)]


def budget(dims: int, block: tuple[int, int], cosine: float) -> float:
    return (2 - 2 * cosine) * (block[1] - block[0]) / dims


def unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)  # squares can't overflow
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def deal(nodes: DataFrame, cosine: float) -> DataFrame:
    """Two copies of each vector for every block: at home in its slab, a visitor in the one before it."""
    kind = nodes.schema["vector"].dataType.simpleString()

    def run(batches):
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                batch = whole.slice(k, 256)
                lists = batch.column("vector")
                sizes = np.diff(lists.offsets.to_numpy())
                flat = lists.flatten().to_numpy()
                starts = np.cumsum(sizes) - sizes
                for dims in sorted(set(sizes.tolist())):
                    rows = np.flatnonzero(sizes == dims)
                    vectors = flat[starts[rows][:, None] + np.arange(dims)]
                    turned = unit(vectors.astype(np.float64)) @ rotation(dims)
                    parts = []
                    for b, (lo, hi) in enumerate(blocks(dims)):
                        side = np.sqrt(budget(dims, (lo, hi), cosine)) * (1 + 10 * SLACK)
                        slab = np.floor(turned[:, lo] / side).astype(np.int64)
                        parts += [(np.arange(len(rows)), b, slab, True), (np.arange(len(rows)), b, slab - 1, False)]
                    at = np.concatenate([p[0] for p in parts])
                    take = pa.array(rows[at])
                    column = lambda f: np.concatenate([np.broadcast_to(f(p), len(rows)) for p in parts])
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("node").take(take), batch.column("weight").take(take), batch.column("label").take(take),
                         pa.array(np.full(len(at), dims), pa.int32()), pa.array(column(lambda p: p[1]), pa.int32()),
                         pa.array(column(lambda p: p[2])), pa.array(column(lambda p: p[3])),
                         pa.FixedSizeListArray.from_arrays(pa.array(vectors[at].ravel(), lists.type.value_type), dims).cast(lists.type)],
                        names=["node", "weight", "label", "dims", "block", "slab", "home", "vector"])

    dealt = nodes.select("node", "weight", "label", "vector").mapInArrow(
        run, f"node long, weight long, label long, dims int, block int, slab long, home boolean, vector {kind}")
    return dealt.withColumn("cell", F.xxhash64("label", "dims", "block", "slab")).drop("slab")


def make_check(cosine: float):
    def check(table: pa.Table, forest: graph.Forest):
        """All pairs of a slab's vectors with each other and with its visitors, within the block's budget."""
        node, weight, label, dims, block, home, mine = (
            table.column(c).to_numpy() for c in ("node", "weight", "label", "dims", "block", "home", "_mine"))
        cross = table.column("_i")[0].as_py() != table.column("_j")[0].as_py()
        links, any_found = np.zeros(len(node), np.int64), False
        # cells have one label, size and block, unless their hashes collide
        for group in {(a, b, c) for a, b, c in zip(label.tolist(), dims.tolist(), block.tolist(), strict=True)}:
            rows = np.flatnonzero((label == group[0]) & (dims == group[1]) & (block == group[2]))
            lists = table.column("vector").take(pa.array(rows)).combine_chunks()
            vectors = unit(lists.flatten().to_numpy().astype(np.float64).reshape(len(rows), group[1]))
            turn, spans = rotation(group[1]), blocks(group[1])
            lo, hi = spans[group[2]]
            here = vectors @ turn[:, lo:hi]
            # swept in the order of the slabs' dimension: a row meets those after it, as far as the budget reaches;
            # visitors come from the next slab, so they lie after all that are at home
            order = np.argsort(here[:, 0], kind="stable")
            rows, vectors, here = rows[order], vectors[order], here[order]
            most = budget(group[1], (lo, hi), cosine) + SLACK
            length, own, part = (here * here).sum(axis=1), home[rows], mine[rows]
            reach = np.searchsorted(here[:, 0], here[:, 0] + np.sqrt(most), "right")
            for begin in range(0, len(rows), SWEPT):
                end = min(begin + SWEPT, len(rows))
                if not own[begin:end].any():
                    continue
                until = int(reach[begin:end].max())
                near = length[begin:end, None] + length[None, begin:until] - 2 * here[begin:end] @ here[begin:until].T <= most
                near &= np.arange(until - begin)[None, :] > np.arange(end - begin)[:, None]
                near &= own[begin:end, None] | own[None, begin:until]
                if cross:
                    near &= part[begin:end, None] != part[None, begin:until]
                left, right = np.nonzero(near)
                left, right = left + begin, right + begin
                for k in range(0, len(left), PAIRS):
                    a, b = left[k:k + PAIRS], right[k:k + PAIRS]
                    keep = np.einsum("ij,ij->i", vectors[a], vectors[b]) >= cosine
                    a, b = a[keep], b[keep]
                    gap = np.einsum("ij,jk->ik", vectors[a] - vectors[b], turn[:, :hi])
                    first = np.ones(len(a), bool)  # no earlier block finds the pair
                    for other in spans[:group[2]]:
                        first &= (gap[:, other[0]:other[1]] ** 2).sum(axis=1) > budget(group[1], other, cosine) * (1 + 1e-9)
                    first &= (gap[:, lo:hi] ** 2).sum(axis=1) <= budget(group[1], (lo, hi), cosine) * (1 + 1e-9)
                    a, b = rows[a[first]], rows[b[first]]
                    if len(a):
                        any_found = True
                        forest.link(node[a], node[b])
                        links += np.bincount(a, weight[b], len(node)).astype(np.int64) + np.bincount(b, weight[a], len(node)).astype(np.int64)
        return (node[links > 0], links[links > 0]) if any_found else None
    return check


def join(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = COSINE) -> DataFrame:
    """One row per vector: key, n_links, component_id, kept.

    Vectors of equal non-null labels (and equal length) are linked from ``cosine`` on, computed in
    double. Vectors that are null, empty, all zero or hold null or non-finite numbers link with nothing.
    Equal vectors of a label are compared once and linked to each other. component_id is the smallest
    key over links, itself included (null keys don't count); kept where that is the row's own. Repeated
    rows are vectors of their own. An empty table gives an empty result.
    """
    small_batches(vectors.sparkSession)
    v = F.col(f"`{vector}`")
    usable = (F.col(f"`{label}`").isNotNull() & v.isNotNull() & (F.size(v) > 0)
              & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0))
    rows = freeze(vectors.select(
        F.col(f"`{key}`").alias("key"), F.when(F.coalesce(usable, F.lit(False)), F.xxhash64(F.col(f"`{label}`"))).alias("label"),
        v.alias("vector"), F.monotonically_increasing_id().alias("row"))
        .withColumn("vector", F.when(F.col("label").isNotNull(), F.col("vector"))), "vectors")
    alike = rows.where("label is not null").groupBy("label", "vector").agg(
        F.min("row").alias("node"), F.count("*").alias("weight"), F.min("key").alias("least"))
    rows_in = rows.count()
    kinds = freeze(alike, "kinds")
    copies = freeze(deal(kinds, cosine), "dealt")
    dealt_rows = copies.count()
    dealt = graph.in_block_pairs(copies, "cell", "node", F.lit(1), 1 << 60, CELL_ROWS, dealt_rows)
    found = freeze(graph.found_in_groups(dealt, ["cell", "_i", "_j"], ["node", "weight", "label", "dims", "block", "home", "_mine", "vector"],
                                         make_check(cosine), graph.tasks_for(dealt_rows, COPIES_A_TASK)), "links", 2 * dealt_rows)
    top = graph.components(found.where("b is not null").select("a", "b"), rows_in)
    links = found.where("links > 0").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("more"))
    # without the vectors from here on
    placed = (kinds.select("node", "weight", "least").join(top, "node", "left").join(links, "node", "left")
              .withColumn("component", F.coalesce("component", "node")))
    placed = freeze(placed, "placed", rows_in)
    least = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    # few classes hold several rows: the rest are their own class's first row
    alike = (rows.where("label is not null").join(kinds.select(F.col("label"), F.col("vector"), "node"), ["label", "vector"]).select("row", "node"))
    of_row = alike.join(placed.join(least, "component"), "node").select(
        "row", "component_id", (F.col("weight") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"))
    return (rows.select("row", "key").join(of_row, "row", "left")
            .select(F.col("key").alias(key), F.coalesce("n_links", F.lit(0)).alias("n_links"),
                    F.coalesce("component_id", "key").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(False))))

"""Exact k-nearest neighbours without a cross join, and the samplers built on it
(SURVEY 2.9 knn_topk, 2.5 smote / adasyn, 2.8 fit_knn).

Exact kNN by a ball tree and the triangle inequality:

1. a bounded, hash-picked set of reference rows are the pivots of the leaves; some of them are the
   tops, each with the leaves nearest to it. Every reference goes to its nearest top and there to its
   nearest leaf; leaves and tops keep their radius (farthest member);
2. neighbouring leaves of a top form a group, as large as one task can hold; a leaf that is larger is a group
   of several chunks. Every query is first compared with its own group: its k-th distance there bounds
   the true one from above;
3. no member of a ball is nearer to q than d(q, pivot) - radius. Tops, then their leaves, where that does
   not exceed the bound can hold one of the k nearest (or a tie with the k-th). The query is shipped once to
   each group with such a leaf and compared there with the leaves in reach: two rounds, whatever the data.

Queries are dealt in blocks that share a group, so a (block, group) pair is compared for many queries at
once. Within a task, squared distances come from matrix products of small slices; everything
within rounding of the k-th is measured again exactly, so ties at the k-th distance are cut by
(distance, rid) and never arbitrarily.

How many leaves the bound rules out depends on the data: clustered vectors leave few, and the more
references there are, the smaller the bound; vectors spread evenly over many dimensions leave most (exact search
then compares most pairs, in blocks). Tasks stay bounded either way.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import BROADCAST_BYTES, checked, freeze, prefix_sum, table_bytes
from .sample import COPY_CHUNK, hash_int, hash_uniform


def euclid(a: Column, b: Column) -> Column:
    """Euclidean distance of two equal-length double arrays (JVM higher-order functions)."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, v: acc + v))


def manhattan(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda acc, v: acc + v)


#: tops and leaves at most; references in a group's chunk and queries in a block at most, and numbers in either;
#: leaves in a group of full size; queries and numbers in a slice of distances
TOPS, LEAVES, REF_CHUNK, QUERY_BLOCK, NUMBERS, LEAVES_A_GROUP, SLICE, SLICE_NUMBERS = 256, 1 << 16, 1 << 14, 1 << 14, 1 << 21, 16, 256, 1 << 22


def _distances(q, r, metric: str):
    """All distances of two sets of rows, one slice of q; euclidean ones from a matrix product, so
    good only up to rounding."""
    import numpy as np
    if metric == "euclidean":
        d = (q * q).sum(1)[:, None] + (r * r).sum(1)[None, :] - 2.0 * (q @ r.T)
        return np.sqrt(np.maximum(d, 0.0))
    return np.abs(q[:, None, :] - r[None, :, :]).sum(-1)


def _slices(n: int, r, metric: str) -> range:
    step = SLICE if metric == "euclidean" else max(1, SLICE_NUMBERS // max(1, r.size))
    return range(0, n, min(step, SLICE))


class _Balls:
    """Two levels of pivots: tops, and leaves in the order of their tops."""

    def __init__(self, pivots, metric: str):
        import numpy as np
        tops = pivots[:min(TOPS, math.ceil(math.sqrt(len(pivots))))]
        of = np.concatenate([_distances(pivots[k:k + SLICE], tops, metric).argmin(axis=1) for k in range(0, len(pivots), SLICE)])
        self.metric = metric
        self._set(tops, pivots[np.argsort(of, kind="stable")], np.sort(of, kind="stable"))

    def _set(self, tops, leaves, of) -> None:
        import numpy as np
        used = np.unique(of)
        self.tops, self.leaves, self.of = tops[used], leaves, np.searchsorted(used, of)
        self.first = np.searchsorted(self.of, np.arange(len(used) + 1))  # a top's leaves: first[t] to first[t + 1]

    def measure(self, counts: dict):
        """Keep the leaves that have members and return their old numbers; ``counts``: of a leaf, its radius, its members'
        largest distance from their top, and their number."""
        import numpy as np
        held = np.array(sorted(counts))
        radius, far, size = (np.array([counts[c][i] for c in held.tolist()]) for i in range(3))
        kept = self.tops
        self._set(kept, self.leaves[held], self.of[held])
        self.radius, self.size = radius, size.astype(int)
        self.reach = np.maximum.reduceat(far, self.first[:-1])
        return held

    def nearest(self, v):
        """Leaf, distance to it and distance to its top of every row of ``v`` (the first on ties)."""
        import numpy as np
        leaf, near, to_top = np.zeros(len(v), np.int64), np.zeros(len(v)), np.zeros(len(v))
        for k in range(0, len(v), SLICE):
            d = _distances(v[k:k + SLICE], self.tops, self.metric)
            top = d.argmin(axis=1)
            to_top[k:k + SLICE] = d[np.arange(len(d)), top]
            for t in np.unique(top):
                rows = k + np.flatnonzero(top == t)
                a, z = self.first[t], self.first[t + 1]
                for j in range(0, len(rows), SLICE):
                    d2 = _distances(v[rows[j:j + SLICE]], self.leaves[a:z], self.metric)
                    best = d2.argmin(axis=1)
                    leaf[rows[j:j + SLICE]], near[rows[j:j + SLICE]] = best + a, d2[np.arange(len(d2)), best]
        return leaf, near, to_top

    def groups(self, most: int):
        """Group and number of chunks of every leaf: neighbours under one top, up to ``most`` members together."""
        import numpy as np
        group, chunks, at, size = np.zeros(len(self.leaves), np.int64), np.ones(len(self.leaves), np.int64), -1, 0
        for i, n in enumerate(self.size.tolist()):
            if i == 0 or self.of[i] != self.of[i - 1] or size + n > most:
                at, size = at + 1, 0
            group[i], chunks[i], size = at, -(-n // most), size + n
        return group, chunks

    def within(self, v, bound, slack: float):
        """(row, leaf) of every leaf that may hold a member within ``bound`` of the row."""
        import numpy as np
        rows, leaves = [], []
        for k in range(0, len(v), SLICE):
            x, most = v[k:k + SLICE], bound[k:k + SLICE] + slack
            near = _distances(x, self.tops, self.metric) - self.reach[None, :] <= most[:, None]
            for t in np.flatnonzero(near.any(axis=0)):
                i = np.flatnonzero(near[:, t])
                a, z = self.first[t], self.first[t + 1]
                for j in range(a, z, SLICE):
                    d = _distances(x[i], self.leaves[j:min(z, j + SLICE)], self.metric)
                    r, c = np.nonzero(d - self.radius[None, j:min(z, j + SLICE)] <= most[i][:, None])
                    rows.append(i[r] + k)
                    leaves.append(c + j)
        empty = np.zeros(0, np.int64)
        return np.concatenate([empty, *rows]), np.concatenate([empty, *leaves])


def _slack(a, b) -> float:
    """More than any rounding of distances of rows of this size."""
    import numpy as np
    return 1e-6 * (np.abs(a).max(initial=0.0) + np.abs(b).max(initial=0.0) + 1e-300) * np.sqrt(b.shape[1])


def _fits_float(v: Column) -> Column:
    """Whether every number of a vector is a single-precision one (nulls are)."""
    return F.forall(v, lambda x: x.cast("float").cast("double").eqNullSafe(x))


def _place(df: DataFrame, balls: _Balls) -> DataFrame:
    """Add ``leaf``, ``to_leaf`` and ``to_top`` to rows of id and v."""
    kind = df.schema["v"].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(balls)  # at most LEAVES rows

    def run(batches):
        import numpy as np
        import pyarrow as pa
        for batch in batches:
            v = np.array(batch.column(1).to_pylist(), dtype=float).reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, shared.value.nearest(v))], names=["id", "v", "leaf", "to_leaf", "to_top"])

    return df.select("id", "v").mapInArrow(run, f"id long, v {kind}, leaf long, to_leaf double, to_top double")


def _block_topk_fn(k: int, metric: str, exclude_self: bool, shared=None):
    """Top k of one (query block, group of references) pair: every candidate within rounding of the k-th
    distance is measured exactly, then cut by (distance, rid). With ``shared`` balls a leaf is compared with the
    queries that it may matter to."""
    import numpy as np
    import pandas as pd

    def compare(qv, qids, rv, rids, parts) -> None:
        slack = 1e-7 * (np.abs(qv).max() + np.abs(rv).max() + 1e-300) * np.sqrt(qv.shape[1])
        slices = _slices(len(qv), rv, metric)
        for b in slices:
            x, ids = qv[b:b + slices.step], qids[b:b + slices.step]
            d = _distances(x, rv, metric)
            if exclude_self:
                d = np.where(ids[:, None] == rids[None, :], np.inf, d)
            kk = min(k, d.shape[1])
            edge = np.partition(d, kk - 1, axis=1)[:, kk - 1]
            i, j = np.nonzero((d <= edge[:, None] + slack) & np.isfinite(d))
            for s in range(0, len(i), 1 << 16):
                gap = x[i[s:s + (1 << 16)]] - rv[j[s:s + (1 << 16)]]
                d[i[s:s + (1 << 16)], j[s:s + (1 << 16)]] = np.sqrt((gap ** 2).sum(1)) if metric == "euclidean" else np.abs(gap).sum(1)
            exact = d[i, j]
            order = np.lexsort((rids[j], exact, i))
            i, j, exact = i[order], j[order], exact[order]
            first = np.concatenate([[True], i[1:] != i[:-1]]) if len(i) else np.zeros(0, bool)
            rank = np.arange(len(i)) - np.maximum.accumulate(np.where(first, np.arange(len(i)), 0))
            keep = rank < k
            parts.append(pd.DataFrame({"qid": ids[i[keep]], "rid": rids[j[keep]], "distance": exact[keep]}))

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        q, r = pdf[pdf["_side"] == 0], pdf[pdf["_side"] == 1]
        parts: list = []
        if len(q) and len(r):
            qv, rv = (np.stack(x["v"].to_numpy()).astype(float) for x in (q, r))
            qids, rids = q["id"].to_numpy(), r["id"].to_numpy()
            if shared is None:
                compare(qv, qids, rv, rids, parts)
            else:
                balls, leaf, bound = shared.value, r["leaf"].to_numpy().astype(np.int64), q["bound"].to_numpy(dtype=float, na_value=np.inf)
                slack = _slack(qv, rv)
                for c in np.unique(leaf):
                    d = np.concatenate([_distances(qv[j:j + SLICE], balls.leaves[c:c + 1], metric)[:, 0] for j in range(0, len(qv), SLICE)])
                    near, own = d - balls.radius[c] <= bound + slack, leaf == c
                    if near.any():
                        compare(qv[near], qids[near], rv[own], rids[own], parts)
        if not parts:
            return pd.DataFrame({"qid": pd.Series([], dtype="int64"), "rid": pd.Series([], dtype="int64"), "distance": pd.Series([], dtype="float64")})
        found = pd.concat(parts)
        return found.sort_values(["qid", "distance", "rid"], kind="stable").groupby("qid", sort=False).head(k) if len(parts) > 1 else found
    return fn


def knn_topk(queries: DataFrame, refs: DataFrame, k: int, qid: str = "qid", rid: str = "rid", vec: str = "vec",
             exclude_self: bool = False, metric: str = "euclidean") -> DataFrame:
    """Exact k nearest references of every query: (qid, rid, distance, nn_rank), ties by rid.

    ``exclude_self`` drops the pair qid == rid (self-join on one table). ``metric`` is 'euclidean' or
    'manhattan' (the triangle inequality holds for both). Ids must be integers; rows whose vector is
    NULL have no neighbours. Fewer than k references give fewer rows.
    """
    import numpy as np
    if metric not in ("euclidean", "manhattan"):
        raise ValueError(f"unknown metric {metric}")
    q = queries.select(F.col(qid).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("v")).where("v is not null")
    r = refs.select(F.col(rid).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("v")).where("v is not null")
    spark = queries.sparkSession
    size = r.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dims"), F.min(_fits_float(F.col("v"))).alias("single")).first()
    nothing = spark.createDataFrame([], f"{qid} long, {rid} long, distance double, nn_rank int")
    if not size["n"]:
        return nothing
    if size["single"] and q.agg(F.min(_fits_float(F.col("v")))).first()[0] is not False:
        # the same numbers in half the bytes: vectors are most of what is shuffled; tasks compute in double
        q, r = (x.select("id", F.col("v").cast("array<float>")) for x in (q, r))
    kind = r.schema["v"].dataType.simpleString()
    # references picked by a hash of their id are the pivots (a parameter of the speed, not of the result)
    most = max(1, min(REF_CHUNK, NUMBERS // max(1, size["dims"])))
    wanted = max(1, min(LEAVES, NUMBERS // max(1, size["dims"]), size["n"] // max(1, most // LEAVES_A_GROUP)))
    picked = r.orderBy(F.xxhash64("id"), "id").limit(wanted).collect()
    balls = _Balls(np.array([row["v"] for row in picked], dtype=float), metric)
    r = freeze(_place(r, balls), "knn-refs")
    held = balls.measure({row["leaf"]: (row["radius"], row["far"], row["n"]) for row in r.groupBy("leaf").agg(
        F.max("to_leaf").alias("radius"), F.max("to_top").alias("far"), F.count(F.lit(1)).alias("n")).collect()})  # at most LEAVES rows
    group, chunks = balls.groups(most)
    shared = spark.sparkContext.broadcast(balls)
    # at most LEAVES rows: the leaf's number among all, and among those with members
    of_leaf = spark.createDataFrame([(int(o), i, int(g), int(c)) for i, (o, g, c) in enumerate(zip(held, group, chunks))], "old long, leaf long, group long, chunks int")
    rside = freeze(r.withColumnRenamed("leaf", "old").join(F.broadcast(of_leaf), "old").select(
        F.col("group").alias("visit"), F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int").alias("chunk"),
        F.lit(1).alias("_side"), "id", "v", "leaf", F.lit(None).cast("double").alias("bound")), "knn-dealt")
    lasts = spark.createDataFrame([(int(g), int(c) - 1) for g, c in {int(g): int(c) for g, c in zip(group, chunks)}.items()], "visit long, last int")

    # blocks: queries of one group, as many as a task can hold, and no more than keep all cores busy
    q = freeze(_place(q, balls), "knn-queries")
    rows_a_block = max(1, min(QUERY_BLOCK, NUMBERS // max(1, size["dims"]), max(512, -(-q.count() // (2 * spark.sparkContext.defaultParallelism)))))
    q = q.join(F.broadcast(of_leaf.drop("old", "chunks")), "leaf").select(F.col("group").alias("home"), "id", "v")
    blocks = [(row["home"], -(-row["count"] // rows_a_block)) for row in q.groupBy("home").count().collect()]  # at most LEAVES rows
    if not blocks:
        return nothing
    q = q.join(F.broadcast(spark.createDataFrame(blocks, "home long, blocks int")), "home").select(
        "home", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"), "id", "v")
    schema = "qid long, rid long, distance double"

    def compare(asked: DataFrame, fn) -> DataFrame:
        """asked: home (group and block of queries), visited group, id, v and bound of the queries."""
        need = asked.select("home", "block", "visit").distinct()
        qside = asked.join(F.broadcast(lasts), "visit").select("home", "block", "visit", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("chunk"),
                                                     F.lit(0).alias("_side"), "id", "v", F.lit(None).cast("long").alias("leaf"), "bound")
        rows = need.join(rside, "visit").select(*qside.columns)
        return qside.unionByName(rows).groupBy("home", "block", "visit", "chunk").applyInPandas(fn, schema)

    own = q.select("home", "block", F.col("home").alias("visit"), "id", "v", F.lit(None).cast("double").alias("bound"))
    first = freeze(_top_k(compare(own, _block_topk_fn(k, metric, exclude_self)), k), "knn-first")
    bound = first.where(F.col("nn_rank") == k).select(F.col("qid").alias("id"), F.col("distance").alias("bound"))
    asked = q.join(bound, "id", "left").select("home", "block", "id", "v", "bound")
    reached = asked.mapInArrow(_groups_in_reach(shared, group), f"home long, block int, id long, v {kind}, bound double, visit long")
    second = _top_k(first.drop("nn_rank").unionByName(compare(freeze(reached, "knn-reach"), _block_topk_fn(k, metric, exclude_self, shared))), k)
    return second.select(F.col("qid").alias(qid), F.col("rid").alias(rid), "distance", "nn_rank")


def _groups_in_reach(shared, group):
    """Per query, once each, the other groups with a leaf that may hold one of its k nearest."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        balls = shared.value
        for whole in batches:
            for b in range(0, whole.num_rows, SLICE):
                batch = whole.slice(b, SLICE)
                v = np.array(batch.column("v").to_pylist(), dtype=float).reshape(batch.num_rows, -1)
                bound = np.array([np.inf if x is None else x for x in batch.column("bound").to_pylist()])
                i, leaf = balls.within(v, bound, _slack(v, balls.leaves))
                pairs = np.unique(np.stack([i, group[leaf]], axis=1), axis=0)
                pairs = pairs[pairs[:, 1] != batch.column("home").to_numpy()[pairs[:, 0]]]
                take = pa.array(pairs[:, 0])
                yield pa.RecordBatch.from_arrays([batch.column(x).take(take) for x in ("home", "block", "id", "v", "bound")] + [pa.array(pairs[:, 1])],
                                                 names=["home", "block", "id", "v", "bound", "visit"])
    return run


def _top_k(cand: DataFrame, k: int) -> DataFrame:
    """k smallest (distance, rid) per query over the per-chunk winners (each
    chunk contributed at most k rows per query)."""
    wq = Window.partitionBy("qid").orderBy("distance", "rid")
    return cand.withColumn("nn_rank", F.row_number().over(wq)).where(F.col("nn_rank") <= k)


# ------------------------------------------------------------------ kNN model
def knn_classifier(train: DataFrame, test: DataFrame, k: int = 5, weights: str = "uniform", id_col: str = "id",
                   vec: str = "vec", y: str = "y", exclude_self: bool = False, metric: str = "euclidean") -> DataFrame:
    """P(class 1) = (weighted) share of positives among the k nearest training
    rows: (id, score). 'distance' weights are 1/d; a zero distance takes all weight."""
    nn = knn_topk(test.select(F.col(id_col).alias("qid"), vec), train.select(F.col(id_col).alias("rid"), vec), k,
                  exclude_self=exclude_self, metric=metric)
    lab = train.select(F.col(id_col).alias("rid"), F.col(y).cast("double").alias("_y"))
    j = nn.join(lab, "rid")
    if weights not in ("uniform", "distance"):
        raise ValueError(f"unknown weights {weights}")
    if weights == "distance":
        zero = F.max((F.col("distance") == 0).cast("int")).over(Window.partitionBy("qid"))
        wgt = F.when(zero == 1, (F.col("distance") == 0).cast("double")).otherwise(1.0 / F.col("distance"))
    else:
        wgt = F.lit(1.0)
    j = j.withColumn("_w", wgt)
    return j.groupBy("qid").agg((F.sum(F.col("_w") * F.col("_y")) / F.sum("_w")).alias("score")) \
        .withColumnRenamed("qid", id_col)


# ---------------------------------------------------------- SMOTE / ADASYN
def smote(df: DataFrame, id_col: str, vec: str, y: str, minority: int | str, n_new: int, k: int = 5,
          seed: int = 42) -> DataFrame:
    """``n_new`` synthetic minority rows x + u (nb - x): sample j picks its base
    row (rank hash(j) mod m), one of the base's k nearest minority neighbours
    (hash) and u ~ U[0, 1) (hash). Returns (synth_id, base_id, nb_id, u, vec, y)."""
    mino = df.where(F.col(y) == F.lit(minority)).select(F.col(id_col).alias("id"), F.col(vec).cast("array<double>").alias("v"))
    nn = knn_topk(mino.select(F.col("id").alias("qid"), F.col("v").alias("vec")),
                  mino.select(F.col("id").alias("rid"), F.col("v").alias("vec")), k, exclude_self=True)
    ranked = prefix_sum(mino.withColumn("_one", F.lit(1).cast("long")), [], ["id"], ["_one"], prefix="_r",
                        totals_prefix="_n").select("id", "v", F.col("_r_one").alias("brank"), F.col("_n_one").alias("m"))
    return _synthesize(ranked, nn, n_new, k, seed, y, minority)


def _synthesize(ranked: DataFrame, nn: DataFrame, n_new: int, k: int, seed: int, y: str, minority,
                per_base: DataFrame | None = None) -> DataFrame:
    spark = ranked.sparkSession
    m = ranked.select("m").first()[0]
    if per_base is None:
        jobs = spark.range(n_new).select(F.col("id").alias("synth_id")).withColumn(
            "brank", F.pmod(hash_int(F.lit(f"{seed}:base:"), F.col("synth_id")), F.lit(m)) + 1)
        jobs = jobs.join(checked(ranked.select("brank", F.col("id").alias("base_id")), name="bases"), "brank")
    else:
        jobs = per_base
    nk = nn.groupBy("qid").agg(F.count(F.lit(1)).alias("nk"))
    jobs = jobs.join(checked(nk.withColumnRenamed("qid", "base_id"), name="neighbour-counts"), "base_id") \
        .withColumn("nn_rank", F.pmod(hash_int(F.lit(f"{seed}:nb:"), F.col("synth_id")), F.col("nk")) + 1)
    jobs = jobs.join(checked(nn.select(F.col("qid").alias("base_id"), "nn_rank", F.col("rid").alias("nb_id")), name="neighbours"),
                     ["base_id", "nn_rank"])
    # few minority rows serve many samples: broadcast while they are small, else many ids spread the join
    vectors = freeze(ranked.select("id", "v"), "minority")
    side = (lambda df: F.broadcast(df)) if table_bytes(vectors) <= BROADCAST_BYTES else (lambda df: df)
    vb = side(vectors.select(F.col("id").alias("base_id"), F.col("v").alias("vb")))
    vn = side(vectors.select(F.col("id").alias("nb_id"), F.col("v").alias("vn")))
    u = hash_uniform(F.lit(f"{seed}:u:"), F.col("synth_id"))
    out = jobs.join(vb, "base_id").join(vn, "nb_id").withColumn("u", u)
    return out.select("synth_id", "base_id", "nb_id", "u",
                      F.zip_with("vb", "vn", lambda a, b: a + F.col("u") * (b - a)).alias("vec"),
                      F.lit(minority).alias(y))


def adasyn(df: DataFrame, id_col: str, vec: str, y: str, minority: int | str, n_new: int, k: int = 5,
           seed: int = 42) -> DataFrame:
    """ADASYN: each minority row gets a share of the ``n_new`` samples
    proportional to the fraction of majority rows among its k nearest
    neighbours in the whole table; neighbours for interpolation are minority.
    Per-row counts: floor of the share, remainders to the largest fractions,
    all in integer arithmetic (no float-summation-order effects)."""
    allp = df.select(F.col(id_col).alias("id"), F.col(vec).cast("array<double>").alias("v"),
                     (F.col(y) == F.lit(minority)).alias("is_min"))
    mino = allp.where("is_min").select("id", "v")
    nn_all = knn_topk(mino.select(F.col("id").alias("qid"), F.col("v").alias("vec")),
                      allp.select(F.col("id").alias("rid"), F.col("v").alias("vec")), k, exclude_self=True)
    # exact integer shares: m_i = majority rows among the k neighbours,
    # g_i = m_i * n_new / sum(m), floor and remainder in integers
    ratio = nn_all.join(allp.select(F.col("id").alias("rid"), "is_min"), "rid").groupBy("qid").agg(
        F.sum((~F.col("is_min")).cast("long")).alias("m"))
    tot = ratio.agg(F.sum("m").alias("M")).first()["M"] or 0
    if tot == 0:
        return df.sparkSession.createDataFrame([], "synth_id bigint, base_id bigint, nb_id bigint, u double, vec array<double>")
    share = ratio.withColumn("gi", F.expr(f"(m * {int(n_new)}) div {int(tot)}").cast("long")) \
        .withColumn("frac", F.pmod(F.col("m") * F.lit(n_new), F.lit(tot)))
    rem = n_new - int(share.agg(F.sum("gi")).first()[0] or 0)
    # remainders to the largest fractions (ties by id): ranked with the distributed prefix sum
    fr = prefix_sum(share.withColumn("_one", F.lit(1).cast("long")).withColumn("_nf", -F.col("frac")),
                    [], ["_nf", "qid"], ["_one"], prefix="_r")
    share = fr.withColumn("cnt", F.col("gi") + (F.col("_r_one") <= rem).cast("long")).where(F.col("cnt") > 0)
    # per-row job ids: running totals give each base row a contiguous synth_id range
    cum = prefix_sum(share.select("qid", "cnt"), [], ["qid"], ["cnt"], prefix="_c_")
    # a base row's samples are made in chunks that are spread before they are expanded
    part = cum.select(F.col("qid").alias("base_id"), (F.col("_c_cnt") - F.col("cnt")).alias("_from"), F.col("_c_cnt").alias("_to"))
    part = part.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_to") - F.col("_from") - 1) / COPY_CHUNK).cast("long"))))
    begin = F.col("_from") + F.col("_chunk") * COPY_CHUNK
    per_base = part.repartition("base_id", "_chunk").select(
        "base_id", F.explode(F.sequence(begin, F.least(begin + COPY_CHUNK, F.col("_to")) - 1)).alias("synth_id"))
    nn_min = knn_topk(mino.select(F.col("id").alias("qid"), F.col("v").alias("vec")),
                      mino.select(F.col("id").alias("rid"), F.col("v").alias("vec")), k, exclude_self=True)
    ranked = prefix_sum(mino.withColumn("_one", F.lit(1).cast("long")), [], ["id"], ["_one"], prefix="_r",
                        totals_prefix="_n").select("id", "v", F.col("_r_one").alias("brank"), F.col("_n_one").alias("m"))
    return _synthesize(ranked, nn_min, n_new, k, seed, y, minority, per_base=per_base)

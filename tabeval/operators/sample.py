"""Deterministic splits, folds and class rebalancing.

Every random choice is a hash: rows are ordered by ``md5('<seed>:<row_id>')``
(ties by row_id) inside their class, so the result does not depend on
partitioning, task retries or executor loss, and DuckDB reproduces it exactly.
Splits and folds are exact cuts in that order, found from a histogram of the hashes and
applied as an expression, so a class holding most of the rows moves no more than another. ``randomSplit``/``sampleBy`` are avoided:
they are neither stratified nor exact.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import named
from .ordered import checked, class_rank, cuts_by_hash, first_by_hash, hash_key

#: rows generated per chunk when materialising oversampling copies
COPY_CHUNK = 1 << 16


def hash_int(*parts: Column) -> Column:
    """Non-negative 60-bit integer from ``md5(concat(parts))`` (first 15 hex digits)."""
    return F.conv(F.substring(F.md5(F.concat(*[p.cast("string") for p in parts])), 1, 15), 16, 10).cast("long")


def hash_uniform(*parts: Column) -> Column:
    """Uniform [0, 1) double from the same hash (60 bits / 2^60)."""
    return hash_int(*parts).cast("double") / float(1 << 60)


def split_stratified(df: DataFrame, y: str = "y", row_id: str = "row_id", test_size: float = 0.2,
                     seed: int = 42, out: str = "split", within: Sequence[str] = ()) -> DataFrame:
    """Per-class test share: the first round(n_c * test_size) rows of each class
    in hash order are 'test', the rest 'train' (``within``: split each of these
    groups separately, e.g. one split per outcome)."""
    keys = [*within, y]
    take = df.groupBy(*map(named, keys)).agg(F.round(F.count(F.lit(1)) * F.lit(float(test_size))).cast("long").alias("_take"))
    r = first_by_hash(df, keys, row_id, seed, take)
    return r.withColumn(out, F.when(F.col("_first"), F.lit("test")).otherwise(F.lit("train"))).drop("_first")


def _folds(df: DataFrame, group: Sequence[str], row_id: str, k: int, seed: int, out: str) -> DataFrame:
    """Fold f holds the rows of hash rank r in their group of n with floor((r - 1) k / n) = f: k - 1 exact cuts
    per group, so sizes differ by at most one and no row moves. Null groups are a group of their own."""
    sizes = df.groupBy(*[named(g) for g in group]).agg(F.count(F.lit(1)).alias("_n"))
    takes = sizes.withColumn("_cut", F.explode(F.sequence(F.lit(1), F.lit(max(k - 1, 1))))).withColumn(
        "_take", F.ceil(F.col("_cut") * F.col("_n") / F.lit(k)).cast("long"))
    return cuts_by_hash(df, group, row_id, seed, takes if k > 1 else takes.where("false"), out)


def kfold(df: DataFrame, row_id: str = "row_id", k: int = 5, seed: int = 42, out: str = "fold") -> DataFrame:
    """k folds by global hash rank, of sizes that differ by at most one."""
    return _folds(df, [], row_id, k, seed, out)


def kfold_stratified(df: DataFrame, y: str = "y", row_id: str = "row_id", k: int = 5, seed: int = 42,
                     out: str = "fold") -> DataFrame:
    """k folds per class: fold sizes differ by at most one inside every class."""
    return _folds(df, [y], row_id, k, seed, out)


def kfold_repeated(df: DataFrame, y: str = "y", row_id: str = "row_id", k: int = 5, n_repeats: int = 2,
                   seed: int = 42, out: str = "fold", repeat_col: str = "repeat") -> DataFrame:
    """n_repeats x stratified k-fold; repeat r uses seed + r."""
    parts = [_folds(df, [y], row_id, k, seed + r, out).select(*map(named, df.columns), F.lit(r).alias(repeat_col), out)
             for r in range(n_repeats)]
    return reduce(DataFrame.unionByName, parts)


# --------------------------------------------------------------------- targets
OVER_STRATEGIES = ("auto", "minority", "not minority", "not majority", "all")
UNDER_STRATEGIES = ("auto", "majority", "not minority", "not majority", "all")


def class_counts(df: DataFrame, y: str = "y") -> DataFrame:
    return df.groupBy(named(y)).agg(F.count(F.lit(1)).cast("long").alias("count"))


def sampling_targets(df: DataFrame, y: str = "y", kind: str = "under", strategy: str = "auto",
                     ratio: float | None = None) -> DataFrame:
    """Per-class target sizes with the public imbalanced-learn semantics.

    over:  auto = not majority; classes chosen are raised to the majority size;
           ratio r (binary) raises the minority to int(r * n_majority).
    under: auto = not minority; classes chosen are cut to the minority size;
           ratio r (binary) cuts the majority to int(n_minority / r).
    Classes not chosen keep their size. Ties for minority/majority go to the
    smallest label.
    """
    return _targets(class_counts(df, y), y, kind, strategy, ratio)


def _targets(c: DataFrame, y: str, kind: str, strategy: str, ratio: float | None, within: Sequence[str] = ()) -> DataFrame:
    """``sampling_targets`` from counted classes (y, count), of each of the groups ``within``."""
    from pyspark.sql import Window
    w = Window.partitionBy(*within)  # a class table: a handful of rows
    mx = F.max("count").over(w)
    mn = F.min("count").over(w)
    is_max = named(y) == F.min_by(named(y), F.struct(-F.col("count"), named(y))).over(w)
    is_min = named(y) == F.min_by(named(y), F.struct(F.col("count"), named(y))).over(w)
    if kind == "over":
        if ratio is not None or strategy == "ratio":
            chosen, goal = is_min, F.floor(F.lit(float(ratio)) * mx)
        else:
            chosen = {"auto": ~is_max, "not majority": ~is_max, "minority": is_min,
                      "not minority": ~is_min, "all": F.lit(True)}[strategy]
            goal = mx
        target = F.when(chosen, F.greatest(goal, F.col("count"))).otherwise(F.col("count"))
    elif kind == "under":
        if ratio is not None or strategy == "ratio":
            chosen, goal = is_max, F.floor(mn / F.lit(float(ratio)))
        else:
            chosen = {"auto": ~is_min, "not minority": ~is_min, "majority": is_max,
                      "not majority": ~is_max, "all": F.lit(True)}[strategy]
            goal = mn
        target = F.when(chosen, F.least(goal, F.col("count"))).otherwise(F.col("count"))
    else:
        raise ValueError("kind must be 'over' or 'under'")
    return c.select(*within, named(y), "count", target.cast("long").alias("target"))


def undersample(df: DataFrame, y: str = "y", row_id: str = "row_id", strategy: str = "auto",
                ratio: float | None = None, seed: int = 42) -> DataFrame:
    """Keep the first ``target`` rows of each class in hash order."""
    tg = sampling_targets(df, y, "under", strategy, ratio).select(named(y), F.col("target").alias("_take"))
    return first_by_hash(df, [y], row_id, seed, tg).where("_first").drop("_first")


def oversample(df: DataFrame, y: str = "y", row_id: str = "row_id", strategy: str = "auto",
               ratio: float | None = None, seed: int = 42, copy_col: str = "copy") -> DataFrame:
    """Originals plus ``target - count`` copies per class drawn with replacement.

    Copy j of class c takes the row of rank ``hash(seed:c:j) mod count + 1``.
    Copies are generated in chunks of ``COPY_CHUNK`` that are spread over tasks
    before expansion, so no task materialises a whole class of copies.
    """
    tg = sampling_targets(df, y, "over", strategy, ratio).select(named(y).alias("_y"), "count", "target")
    need = tg.where(F.col("target") > F.col("count")).select(
        "_y", "count", (F.col("target") - F.col("count")).alias("extra"))
    chunks = need.withColumn("_chunk", F.explode(F.sequence(
        F.lit(0).cast("long"), F.ceil(F.col("extra") / F.lit(COPY_CHUNK)).cast("long") - 1)))
    chunks = chunks.repartition("_chunk", "_y")
    copies = chunks.withColumn("_j", F.explode(F.sequence(
        F.col("_chunk") * COPY_CHUNK,
        F.least(F.col("_chunk") * COPY_CHUNK + COPY_CHUNK, F.col("extra")) - 1)))
    copies = copies.select("_y", (F.col("_j") + 1).alias("_copy"),
                           (F.pmod(hash_int(F.lit(str(seed)), F.lit(":"), F.col("_y"), F.lit(":"), F.col("_j")),
                                   F.col("count")) + 1).alias("_rank"))
    # only (class, row id) of the classes that get copies is ranked; their rows meet their copies' numbers in one join
    grown = checked(need.select("_y"), name="classes")
    some = df.join(grown, named(y) == F.col("_y"), "left_semi")
    narrow = some.select(named(y).alias("_y"), named(row_id).alias("_rid"))
    ranked = class_rank(narrow, ["_y"], "_rid", seed, rank_col="_rank")
    picked = checked(ranked.join(copies, ["_y", "_rank"]).select("_y", "_rid", "_copy"), name="picked")
    orig = df.withColumn(copy_col, F.lit(0).cast("long"))
    again = some.join(picked, named(y).eqNullSafe(F.col("_y")) & named(row_id).eqNullSafe(F.col("_rid"))).select(
        *[F.col("_copy").alias(c) if c == copy_col else named(c) for c in orig.columns])
    return orig.unionByName(again)


#: hex digits of the hash prefixes that cut the rows of ``oversample_folds``; rows of a piece; draws sorted at once
PIECE_DIGITS, PIECE_ROWS, SORTED_DRAWS = 3, 1 << 16, 1 << 20


def oversample_folds(df: DataFrame, y: str, row_id: str, fold: str, k: int, strategy: str = "auto", ratio: float | None = None,
                     seed: int = 42) -> DataFrame:
    """``df`` without ``row_id`` and with columns ``_copies0 .. _copies<k - 1>``: how many copies of the row ``oversample`` adds to the
    rows outside each fold (0 in the fold itself).

    Only rows of classes that grow are shuffled, once for all folds, in pieces of neighbouring hashes; a draw goes to
    the piece that holds its rank among the rows outside the fold.
    """
    spark, made = df.sparkSession, [f"_copies{f}" for f in range(k)]
    kept = [c for c in df.columns if c != row_id]
    sizes = [tuple(r) for r in df.groupBy(named(fold).cast("int").alias("f"), named(y).alias("y")).agg(F.count(F.lit(1)).alias("n")).collect()]  # folds x classes
    kind = df.schema[y].dataType.simpleString()
    outside = [(f, v, sum(n for g, u, n in sizes if u == v and g != f)) for f in range(k) for v in sorted({u for _, u, _ in sizes})]
    counts = spark.createDataFrame([r for r in outside if r[2]], f"left int, _y {kind}, count long")
    need = {(r["_y"], r["left"]): (r["count"], r["target"] - r["count"]) for r in _targets(counts, "_y", "over", strategy, ratio, ["left"])
            .where(F.col("target") > F.col("count")).collect()}
    grown = sorted({v for v, _ in need})
    plain = [F.lit(0).alias(c) for c in made]
    if not grown:
        return df.select(*map(named, kept), *plain)
    number = F.coalesce(*[F.when(named(y) == F.lit(v), F.lit(i)) for i, v in enumerate(grown)])
    key = hash_key(seed, row_id)
    prefix = F.coalesce(F.conv(F.substring(key, 1, PIECE_DIGITS), 16, 10).cast("int"), F.lit(0))  # rows without a key come first
    some = df.where(named(y).isin(grown)).select("*", number.alias("_class"), prefix.alias("_prefix"), key.alias("_key"))
    table = np.zeros((len(grown), 16 ** PIECE_DIGITS, k), np.int64)
    for c, p, f, n in some.groupBy("_class", "_prefix", fold).agg(F.count(F.lit(1))).collect():  # prefixes x folds x classes
        table[c, p, f] = n
    step = max(1, int(16 ** PIECE_DIGITS * PIECE_ROWS // table.sum((1, 2)).max()))  # prefixes of a piece
    pieces = np.add.reduceat(table, np.arange(0, table.shape[1], step), axis=1)
    before = np.cumsum(pieces.sum(2, keepdims=True) - pieces, axis=1)  # class, piece, fold: rows outside the fold up to the piece's end

    def deal(batches):
        held: dict[int, list] = {}

        def emit():
            rows: list[list] = [[], [], [], []]
            for c, parts in held.items():
                j, h = (np.concatenate(v) for v in zip(*parts))
                for f in range(k):
                    count, extra = need.get((grown[c], f), (0, 0))
                    if extra:
                        rank = np.sort(h[j < extra] % count)
                        edges = np.searchsorted(rank, before[c, :, f])
                        for b, (a, z) in enumerate(zip([0, *edges[:-1].tolist()], edges.tolist())):
                            if a < z:
                                start = before[c, b - 1, f] if b else 0
                                for column, v in zip(rows, (c, b, f, (rank[a:z] - start).astype(np.int32).tobytes())):
                                    column.append(v)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows, (pa.int32(), pa.int32(), pa.int32(), pa.binary()))],
                                              names=["_class", "_piece", "f", "ranks"])
        size = 0
        for batch in batches:
            if batch.num_rows:
                c = batch.column(0)[0].as_py()  # a task's draws are of one class
                held.setdefault(c, []).append((batch.column(1).to_numpy(), batch.column(2).to_numpy()))
                size += batch.num_rows
            if size >= SORTED_DRAWS:
                yield emit()
                size = 0
        if held:
            yield emit()

    draws = None
    for i, v in enumerate(grown):
        most = max(extra for (u, _), (_, extra) in need.items() if u == v)
        j = spark.range(0, most, 1, max(1, min(spark.sparkContext.defaultParallelism, -(-most // SORTED_DRAWS)))).withColumnRenamed("id", "j")
        part = j.select(F.lit(i).alias("c"), "j", hash_int(F.lit(str(seed)), F.lit(":"), F.lit(v).cast(kind), F.lit(":"), F.col("j")).alias("h")) \
            .mapInArrow(deal, "_class int, _piece int, f int, ranks binary")
        draws = part if draws is None else draws.unionByName(part)
    at = [f"c{i}" for i in range(len(kept))]  # by position: any name survives
    rows = some.select(*[named(c).alias(x) for c, x in zip(kept, at)], "_class", F.floor(F.col("_prefix") / step).cast("int").alias("_piece"),
                       F.coalesce(F.unhex("_key"), F.lit(bytes(16))).alias("_key"))
    at_fold = kept.index(fold)

    def copy(left: pa.Table, right: pa.Table) -> pa.Table:
        own = left.column(at_fold).to_numpy()
        key = np.frombuffer(b"".join(left.column("_key").to_pylist()), ">u8").reshape(-1, 2)
        order = np.lexsort((key[:, 1], key[:, 0]))
        key, own = key[order], own[order]
        runs = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(1)])) if len(key) else np.zeros(0, np.int64)
        lengths, drawn = np.diff(np.append(runs, len(key))), right.column("f").to_numpy()
        columns = []
        for f in range(k):
            rank = np.frombuffer(b"".join(right.column("ranks").filter(pa.array(drawn == f)).to_pylist()), np.int32)
            out = np.zeros(len(key), np.int32)
            if len(rank):
                outside = np.flatnonzero(own != f)
                hit = np.zeros(len(key), np.int64)
                hit[outside] = np.bincount(rank, minlength=len(outside))
                out[order] = np.repeat(np.add.reduceat(hit, runs), lengths)  # rows of one id get each other's copies, as in a join
            columns.append(pa.array(out))
        return pa.table([*left.columns[:len(kept)], *columns], names=[*at, *made])

    fields = ", ".join([*(f"{x} {df.schema[c].dataType.simpleString()}" for c, x in zip(kept, at)), *(f"{c} int" for c in made)])
    again = rows.groupBy("_class", "_piece").cogroup(draws.groupBy("_class", "_piece")).applyInArrow(copy, fields) \
        .select(*[F.col(x).alias(c) for x, c in zip(at, kept)], *made)
    rest = df.where(~named(y).isin(grown)).select(*map(named, kept), *plain)
    return rest.unionByName(again)


# ------------------------------------------------------------------ bootstrap
def poisson_cdf(mean: float) -> list[float]:
    """P(X <= k) for k = 0, 1, ... until nothing is left that a 60-bit uniform could tell from 1."""
    from decimal import Decimal, localcontext
    with localcontext() as context:
        context.prec = 60
        term = total = (-Decimal(mean)).exp()
        out, k = [float(total)], 0
        while 1 - total > Decimal(2) ** -61:
            k += 1
            term *= Decimal(mean) / k
            total += term
            out.append(float(total))
    return out


def poisson(u: Column, mean: float = 1.0) -> Column:
    """Poisson draw by inverting its CDF at uniform ``u``: how many CDF values lie at or below it."""
    return F.size(F.filter(F.array(*[F.lit(c) for c in poisson_cdf(mean)]), lambda c: c <= u))


def bootstrap_weights(df: DataFrame, row_id: str, n_boot: int = 1000, seed: int = 42,
                      rep_col: str = "replicate") -> DataFrame:
    """Poisson bootstrap: each row appears in replicate b with weight ~ Poisson(1)
    (hash-seeded, so reproducible). Rows with weight 0 are dropped."""
    rep = df.withColumn(rep_col, F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))))
    w = poisson(hash_uniform(F.lit(str(seed)), F.lit(":"), F.col(rep_col), F.lit(":"), F.col(row_id)))
    return rep.withColumn("weight", w.cast("long")).where(F.col("weight") > 0)

"""Ordered running sums without a single-task window.

``Window.partitionBy(group).orderBy(x)`` sends a whole group to one task; a
global order (no group) sends the whole table there. Both break when one group
holds a third of the rows. ``prefix_sum`` instead:

1. samples (group, order) keys once and takes evenly spaced bounds from them (at most
   one less than there are shuffle partitions);
2. gives each row the number of bounds at or below its key, as an expression: slices
   are a pure function of the row, so nothing has to be range-partitioned or rewritten;
3. sums each (slice, group) — a table of at most ``#slices + #groups`` rows — and turns
   that into what each slice carries in;
4. adds the carried sums as one more row per (slice, group), sorted before the slice's own
   rows, so a window local to the slice starts from them: one exchange of the rows, no join.

Callers pass rows that are unique on (group, order) — e.g. pre-aggregated score
groups — or add a tiebreak column to ``order``.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import free_names, named, quoted
from ..session import ensure_checkpoint_dir


def frozen_path(spark, name: str) -> str:
    """A new folder under the session's shared checkpoint folder."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tabeval-{name}-{uuid.uuid4().hex}"
    if getattr(_recording, "made", None) is not None:
        _recording.made.append(path)
    return path


_recording = threading.local()


@contextmanager
def recorded() -> Iterator[list[str]]:
    """The folders of the tables that this thread freezes inside the block, for ``drop``."""
    made, before = [], getattr(_recording, "made", None)
    _recording.made = made
    try:
        yield made
    finally:
        _recording.made = before
        if before is not None:
            before += made


def drop(spark, paths: list[str]) -> None:
    """Delete frozen tables that nothing will read again."""
    for path in paths:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    paths.clear()


def freeze(df: DataFrame, name: str = "frozen") -> DataFrame:
    """Cut lineage by writing ``df`` as Parquet under the session's shared
    checkpoint folder and reading it back: one job, deterministic contents that
    survive executor loss, column pruning and real size statistics downstream.
    Column names are stored positionally (any name survives the round trip)."""
    spark = df.sparkSession
    path = frozen_path(spark, name)
    names = df.columns
    positional = df.select(*[named(c).alias(f"c{i}") for i, c in enumerate(names)])
    positional.write.mode("overwrite").parquet(path)
    back = spark.read.schema(positional.schema).parquet(path)  # known schema: no footer inference
    return back.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])

#: largest small side joined by broadcast, in bytes of Parquet; beyond it a shuffle-hash join
BROADCAST_BYTES = 16 << 20


def table_bytes(df: DataFrame) -> int:
    """Size of a frozen table, as its files have it."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def checked(small: DataFrame, limit: int | None = None, name: str = "small") -> DataFrame:
    """A data-dependent small side (per-group summaries, offset tables), frozen and measured: marked for
    broadcast up to ``limit`` bytes, for a shuffle-hash join beyond it."""
    small = freeze(small, name)
    return F.broadcast(small) if table_bytes(small) <= (BROADCAST_BYTES if limit is None else limit) else small.hint("shuffle_hash")


def join_checked(big: DataFrame, small: DataFrame, on, how: str = "inner", limit: int | None = None) -> DataFrame:
    """Join a small side whose size is data-dependent. The big side is never broadcast."""
    side = checked(small, limit)
    if isinstance(on, Column):
        return big.join(side, on, how)
    return big.join(side, list(on), how)


#: a table's keys that are so frequent that at most this many can be are broadcast by ``lookup``
HOT_KEYS = 50_000


def lookup(rows: DataFrame, table: DataFrame, on: Sequence[str], count: str) -> DataFrame:
    """Left join of ``rows`` with ``table`` (frozen; one row per ``on`` key, of which ``count`` tells how many of the
    rows have it; keys compare null-safe). The column ``count`` isn't kept.

    A table of up to BROADCAST_BYTES is broadcast. Of a larger one the keys of more than one in HOT_KEYS rows
    are, at most HOT_KEYS of them; the rows of all other keys are shuffled, so no key is hot there.
    """
    on = list(on)
    added = [c for c in table.columns if c not in on and c != count]

    def left(part: DataFrame, side: DataFrame, mark: str | None = None) -> DataFrame:
        cond = F.lit(True)
        for k in on:
            cond = cond & F.col(f"a.{quoted(k)}").eqNullSafe(F.col(f"b.{quoted(k)}"))
        side = side.select(*on, *added, *([F.lit(True).alias(mark)] if mark else []))
        return part.alias("a").join(side.alias("b"), cond, "left").select(
            "a.*", *[F.col(f"b.{quoted(c)}") for c in added], *([F.col(f"b.{mark}")] if mark else []))

    if table_bytes(table) <= BROADCAST_BYTES:
        return left(rows, F.broadcast(table))
    total = table.agg(F.sum(count)).first()[0] or 0
    mark, = free_names([*rows.columns, *table.columns], ["hot"])
    hot = left(rows, F.broadcast(table.where(F.col(count) * HOT_KEYS > total)), mark)
    rest = hot.where(F.col(mark).isNull()).select(*[named(c) for c in rows.columns])
    return hot.where(F.col(mark)).drop(mark).unionByName(left(rest, table.where(F.col(count) * HOT_KEYS <= total)))


def attach(df: DataFrame, small: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Attach a per-group summary (one row per group) to ``df`` on the group
    keys. With no keys the summary is a single aggregate row: it is read once
    and added as typed literals (no join, so no nested-loop plan)."""
    keys = list(keys)
    if keys:
        return join_checked(df, small, keys)
    rows = small.limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"expected a one-row summary, got {len(rows)} rows")
    row = rows[0]
    return df.select("*", *[F.lit(row[f.name]).cast(f.dataType).alias(f.name) for f in small.schema.fields])


def group_totals(df: DataFrame, group: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Per-group totals kept by ``prefix_sum`` (a small table), or an aggregate
    of ``df`` when it did not come from ``prefix_sum``."""
    t = getattr(df, "_tabeval_totals", None)
    names = getattr(df, "_tabeval_totals_map", {})
    if t is not None and all(c in names for c in cols):
        return t.select(*group, *[F.col(names[c]).alias(c) for c in cols])
    return df.groupBy(*group).agg(*[F.max(c).alias(c) for c in cols])


def _order_cols(order: Sequence[str], descending: bool) -> list[Column]:
    return [named(c).desc_nulls_last() if descending else named(c).asc_nulls_first() for c in order]


#: keys sampled per slice
SAMPLED_KEYS = 40


def _sort_key(row) -> tuple:
    """Spark's ascending order of a row's values: null first, NaN last."""
    return tuple((0,) if v is None else (2,) if v != v else (1, v) for v in row)


def range_bounds(rows: DataFrame, key: Sequence[str], slices: int) -> list[tuple]:
    """At most ``slices - 1`` increasing keys that cut ``rows`` into parts of about equal size."""
    if slices <= 1:
        return []
    total, want = rows.count(), slices * SAMPLED_KEYS
    keys = rows.select(*[named(k) for k in key])
    if total > want:
        keys = keys.sample(fraction=want / total, seed=7)
    found = sorted((tuple(r) for r in keys.collect()), key=_sort_key)
    if not found:
        return []
    picked = {_sort_key(v): v for v in (found[i * len(found) // slices] for i in range(1, slices))}
    return [picked[k] for k in sorted(picked)]


def slice_of(rows: DataFrame, key: Sequence[str], bounds: Sequence[tuple]) -> Column:
    """How many of ``bounds`` are at or below the row's key: a binary search as an expression."""
    types = [rows.schema[k].dataType for k in key]
    at = F.struct(*[named(k).alias(f"k{i}") for i, k in enumerate(key)])

    def below(bound: tuple) -> Column:
        return at < F.struct(*[F.lit(v).cast(t).alias(f"k{i}") for i, (v, t) in enumerate(zip(bound, types))])

    def search(lo: int, hi: int) -> Column:  # the answer lies in lo..hi
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(below(bounds[mid]), search(lo, mid)).otherwise(search(mid + 1, hi))

    return search(0, len(bounds))


def prefix_sum(df: DataFrame, group: Sequence[str], order: Sequence[str], sums: Sequence[str],
               descending: bool = False, prefix: str = "cum_", totals_prefix: str | None = None,
               num_partitions: int | None = None, frozen: bool = False) -> DataFrame:
    """Inclusive running sums of ``sums`` within ``group`` in ``order`` order.

    Adds ``{prefix}{c}`` for each summed column and, when ``totals_prefix`` is
    given, the per-group grand totals ``{totals_prefix}{c}``. The rows are read
    three times, so they are frozen first unless they are said to be (``frozen``).
    """
    group, order, sums = list(group), list(order), list(sums)
    rows = df if frozen else freeze(df, "ordered")
    slices = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = range_bounds(rows, group + order, slices)
    at, own, *free = free_names(df.columns, ["slice", "own", *[f"add{i}" for i in range(len(sums))],
                                             *[f"total{i}" for i in range(len(sums))]])
    adds, totals = free[:len(sums)], free[len(sums):]
    sliced = rows.withColumn(at, slice_of(rows, group + order, bounds))

    # at most #slices + #groups rows; without groups they meet in one task
    parts = sliced.groupBy(at, *[named(g) for g in group]).agg(*[F.sum(named(c)).alias(a) for c, a in zip(sums, adds)])
    together = [named(g) for g in group] or [F.pmod(F.hash(at), F.lit(1))]
    whole = Window.partitionBy(*together)
    before = whole.orderBy(F.col(at).desc() if descending else F.col(at)).rowsBetween(Window.unboundedPreceding, -1)
    carried = [F.sum(a).over(before).alias(a) for a in adds]
    if totals_prefix is not None:
        carried += [F.sum(a).over(whole).alias(t) for a, t in zip(adds, totals)]
    carry = parts.select(at, *[named(g) for g in group], *carried).withColumn(own, F.lit(False))
    data = sliced.withColumns({a: named(c) for c, a in zip(sums, adds)}).withColumn(own, F.lit(True))

    local = Window.partitionBy(at, *[named(g) for g in group]).orderBy(own, *_order_cols(order, descending)) \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = [F.sum(a).over(local).alias(f"{prefix}{c}") for c, a in zip(sums, adds)]
    if totals_prefix is not None:
        running += [F.max(t).over(local).alias(f"{totals_prefix}{c}") for c, t in zip(sums, totals)]
    out = data.unionByName(carry, allowMissingColumns=True).select("*", *running).where(F.col(own))
    out = out.select(*[named(c) for c in df.columns], *[named(f"{prefix}{c}") for c in sums],
                     *([named(f"{totals_prefix}{c}") for c in sums] if totals_prefix is not None else []))
    if totals_prefix is not None:
        out._tabeval_totals = rows.groupBy(*[named(g) for g in group]).agg(
            *[F.sum(named(c)).alias(f"{totals_prefix}{c}") for c in sums])
        out._tabeval_totals_map = {f"{totals_prefix}{c}": f"{totals_prefix}{c}" for c in sums}
    return out


def hash_key(seed: int | str, *cols: str) -> Column:
    """Deterministic pseudo-random sort key ``md5('<seed>:<c1>:<c2>...')``.

    Identical in Spark and DuckDB (both emit lowercase hex), independent of
    partitioning and of task retries.
    """
    parts = [F.lit(str(seed))]
    for c in cols:
        parts += [F.lit(":"), named(c).cast("string")]
    return F.md5(F.concat(*parts))


def hash_rank(df: DataFrame, group: Sequence[str], row_id: str, seed: int | str = 42,
              rank_col: str = "rank", size_col: str | None = "group_size") -> DataFrame:
    """1-based rank of each row inside ``group`` by ``md5(seed:row_id)`` then row_id.

    Distributed through ``prefix_sum`` so a class holding most rows is still
    spread over many tasks. ``row_id`` must be unique within a group.
    """
    keyed = df.withColumn("_hkey", hash_key(seed, row_id)).withColumn("_one", F.lit(1).cast("long"))
    ranked = prefix_sum(keyed, group, ["_hkey", row_id], ["_one"], descending=False,
                        prefix="_cum", totals_prefix="_tot" if size_col else None)
    ranked = ranked.withColumnRenamed("_cum_one", rank_col)
    if size_col:
        ranked = ranked.withColumnRenamed("_tot_one", size_col)
    return ranked.drop("_hkey", "_one")


#: hash prefixes that the histogram of ``cuts_by_hash`` counts: 4 hex digits
PREFIX = 4


def cuts_by_hash(df: DataFrame, group: Sequence[str], row_id: str, seed: int | str, takes: DataFrame,
                 out: str = "_part") -> DataFrame:
    """Number, in column ``out``, the cuts that lie before each row in ``md5(seed:row_id)`` order (ties by row_id)
    of its group, without moving the rows.

    ``takes`` has one row per group and cut: the group columns, ``_cut`` (any number) and ``_take``, how many
    rows lie before it. A histogram of hash prefixes (at most 65,536 per group) tells in which prefix
    each cut falls; only those prefixes' keys, one in 65,536 rows per cut, are ranked to find the exact cuts.
    What a row is then compared with is an array of its group's cuts: an expression on the row itself.
    """
    group = list(group)
    key = hash_key(seed, row_id)
    names = [f"_g{i}" for i in range(len(group))]
    narrow = df.select(*[named(g).alias(n) for g, n in zip(group, names)], key.alias("_k"), named(row_id).alias("_id"))
    counts = narrow.groupBy(*names, F.substring("_k", 1, PREFIX).alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*names).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    ahead = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    goal = takes.select(*[named(g).alias(n) for g, n in zip(group, names)], "_cut", "_take")
    same = _null_safe(names)
    # without groups the goals are a few rows by construction: the cuts of one table
    at = ahead.alias("a").join(F.broadcast(goal).alias("b") if not names else checked(goal).alias("b"), same("a", "b")) \
        .where("_before < _take and _take <= _before + _n").select(
            *[F.col(f"a.{n}").alias(n) for n in names], "_p", "_cut", (F.col("_take") - F.col("_before")).alias("_rest"))
    at = freeze(at, "cut-prefixes")
    inside = narrow.withColumn("_p", F.substring("_k", 1, PREFIX)).alias("a").join(
        checked(at.select(*names, "_p").distinct(), name="prefixes").alias("b"), same("a", "b") & (F.col("a._p") == F.col("b._p"))).select(
            *[F.col(f"a.{n}").alias(n) for n in names], "_k", "_id", "a._p")
    ranked = inside.withColumn("_r", F.row_number().over(Window.partitionBy(*names, "_p").orderBy("_k", "_id")))
    hit = ranked.alias("a").join(at.alias("b"), same("a", "b") & (F.col("a._p") == F.col("b._p")) & (F.col("a._r") == F.col("b._rest"))).select(
        *[F.col(f"a.{n}").alias(n) for n in names], F.struct("_k", "_id").alias("_at"))
    # a cut before all rows is a key below all others
    first = goal.where("_take <= 0").select(*names, F.struct(F.lit(None).cast("string").alias("_k"), F.lit(None).cast(df.schema[row_id].dataType).alias("_id")).alias("_at"))
    cuts = hit.unionByName(first).groupBy(*names).agg(F.collect_list("_at").alias("_cuts"))
    own, cut_at = free_names(df.columns, ["k", "cuts"])
    rows = df.withColumn(own, F.struct(key.alias("_k"), named(row_id).alias("_id")))

    def number(known: Column) -> Column:
        return F.size(F.filter(known, lambda c: c < F.col(own)))

    if names:
        small = checked(cuts.select(*names, F.col("_cuts").alias(cut_at)), name="cuts")
        cond = F.lit(True)
        for g, n in zip(group, names):
            cond = cond & F.col(f"d.{quoted(g)}").eqNullSafe(F.col(f"c.{n}"))
        joined = rows.alias("d").join(small.alias("c"), cond, "left")
        part = F.coalesce(number(F.col(cut_at)), F.lit(0))
        return joined.select(*[F.col(f"d.{quoted(c)}") for c in df.columns if c != out], part.alias(out))
    found = cuts.first()
    known = [F.struct(F.lit(c["_k"]).cast("string").alias("_k"), F.lit(c["_id"]).cast(df.schema[row_id].dataType).alias("_id")) for c in (found["_cuts"] if found else [])]
    return rows.select(*[named(c) for c in df.columns if c != out], (number(F.array(*known)) if known else F.lit(0)).alias(out))


def class_rank(df: DataFrame, group: Sequence[str], row_id: str, seed: int | str, rank_col: str = "rank") -> DataFrame:
    """1-based rank of each row inside ``group`` by ``md5(seed:row_id)`` then row_id, as ``hash_rank`` gives, with one
    shuffle of the rows: a histogram of hash prefixes (at most 65,536 per group) tells how many rows lie before a
    prefix, and rows are ranked inside theirs. The columns are the group's, ``row_id`` and the rank."""
    group = list(group)
    names = [f"_g{i}" for i in range(len(group))]
    prefix = F.coalesce(F.substring("_k", 1, PREFIX), F.lit(""))  # rows without a key come first
    narrow = df.select(*[named(g).alias(n) for g, n in zip(group, names)], hash_key(seed, row_id).alias("_k"), named(row_id).alias("_id")) \
        .withColumn("_p", prefix)
    counts = narrow.groupBy(*names, "_p").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*names).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    ahead = checked(counts.select(*names, "_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")), name="prefixes")
    own = F.row_number().over(Window.partitionBy(*names, "_p").orderBy("_k", "_id"))
    ranked = narrow.withColumn("_r", own.cast("long"))
    out = ranked.alias("a").join(ahead.alias("b"), _null_safe(names)("a", "b") & (F.col("a._p") == F.col("b._p")))
    return out.select(*[F.col(f"a.{n}").alias(g) for g, n in zip(group, names)], F.col("a._id").alias(row_id),
                      (F.col("a._r") + F.col("b._before")).alias(rank_col))


def first_by_hash(df: DataFrame, group: Sequence[str], row_id: str, seed: int | str, take: DataFrame,
                  out: str = "_first") -> DataFrame:
    """Mark the first ``_take`` rows of each group in ``md5(seed:row_id)`` order in column ``out``: one cut
    of ``cuts_by_hash``. ``take`` has one row per group: the group columns and ``_take``."""
    marked = cuts_by_hash(df, group, row_id, seed, take.withColumn("_cut", F.lit(0)), out)
    return marked.select(*[named(c) for c in df.columns if c != out], (named(out) == 0).alias(out))


def _null_safe(names: Sequence[str]):
    def same(a: str, b: str) -> Column:
        cond = F.lit(True)
        for n in names:
            cond = cond & F.col(f"{a}.{n}").eqNullSafe(F.col(f"{b}.{n}"))
        return cond
    return same

"""Metrics of scored rows by merging sorted ranges: what ``evaluate`` needs of many rows in few groups.

1. A task sorts its rows of a group, a block at a time, and writes the distinct scores with their label counts.
2. Ranges of a group's scores are cut at bounds taken from evenly spaced scores of its blocks.
3. Label counts per range tell what each range carries in; one row per group and range.
4. A range's pieces are merged in one task, which adds up its part of every metric.

No row moves more than once, and only as part of a sorted piece. Bounds are a parameter of the speed, not of the result.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import named
from .ordered import _null_safe, checked, freeze

#: rows sorted at once in a task; evenly spaced scores kept of a block; rows of one range
SORTED_ROWS, KEPT_SCORES, RANGE_ROWS = 1 << 17, 64, 250_000
CRITERIA = ("mcc", "youden", "f1", "ji")
SUMS = ("_s01", "_q01", "_s10", "_q10", "_rpos", "auprc", "auprc_cilow", "auprc_cihigh")


def groupable(df: DataFrame, group: Sequence[str]) -> bool:
    """Whether the group columns are plain values, which a task can number."""
    return not any(isinstance(df.schema[g].dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType)) for g in group)


def _codes(table: pa.Table, n: int) -> np.ndarray:
    """A number per row: the same for the rows of a group."""
    code, codes = np.zeros(table.num_rows, np.int64), 1
    for i in range(n):
        column = pa.concat_arrays(table.column(i).chunks).dictionary_encode("encode")
        own, size = column.indices.to_numpy(zero_copy_only=False), len(column.dictionary)
        if codes * size >= 1 << 40:
            _, code = np.unique(code, return_inverse=True)
            codes = table.num_rows
        code, codes = code * size + own, codes * size
    return code


def _blocks(n: int):
    """Group columns, label and score of rows -> sorted blocks of distinct scores."""
    def emit(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        code, y, s = _codes(table, n), table.column(n).to_numpy(), table.column(n + 1).to_numpy() + 0.0  # -0.0 is 0.0
        order = np.argsort(s)
        if n and code.min() != code.max():  # the groups one after the other, each by score
            order = order[np.argsort(code[order].astype(np.int16 if code.max() < 1 << 15 else np.int64), kind="stable")]
        code, y, s = code[order], y[order], s[order]
        begins = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (s[1:] != s[:-1])]))
        count = np.diff(np.append(begins, len(s)))
        pos = np.add.reduceat(y, begins)
        neg, s, first = count - pos, s[begins], code[begins]
        starts = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]]))
        ends = np.append(starts[1:], len(s))
        cum = np.concatenate([[0], np.cumsum(count)])
        columns: list[list] = [[], [], [], [], []]
        for a, z in zip(starts.tolist(), ends.tolist()):
            size = int(cum[z] - cum[a])
            kept = min(KEPT_SCORES, size)
            at = a + np.searchsorted(cum[a + 1:z + 1] - cum[a], (2 * np.arange(kept) + 1) * size // (2 * kept), "right")
            for c, v in zip(columns, (size, s[at], s[a:z].tobytes(), pos[a:z].astype(np.int32).tobytes(), neg[a:z].astype(np.int32).tobytes())):
                c.append(v)
        groups = table.select(list(range(n))).take(pa.array(order[begins[starts]]))
        arrays = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.list_(pa.float64()), pa.binary(), pa.binary(), pa.binary()))]
        return pa.RecordBatch.from_arrays([*(pa.concat_arrays(c.chunks) for c in groups.columns), *arrays], names=[*(f"g{i}" for i in range(n)), "rows", "kept", "scores", "pos", "neg"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
            if size >= SORTED_ROWS:
                yield emit(held)
                held, size = [], 0
        if held:
            yield emit(held)
    return run


def _cut(n: int, whole: bool):
    """Blocks with their group's bounds -> a piece per range: its labels, and with ``whole`` its scores."""
    def run(batches):
        for batch in batches:
            source, r, columns = [], [], [[], [], [], [], []]
            bounds = batch.column(n + 3)
            for i in range(batch.num_rows):
                s, pos, neg = (np.frombuffer(batch.column(n + k)[i].as_buffer(), t) for k, t in enumerate((np.float64, np.int32, np.int32)))
                edges = [0, *np.searchsorted(s, np.asarray(bounds[i].values) if bounds[i].is_valid else np.zeros(0)).tolist(), len(s)]
                for k, (a, z) in enumerate(zip(edges, edges[1:])):
                    if a < z:
                        source.append(i)
                        r.append(k)
                        parts = (s[a:z].tobytes(), pos[a:z].tobytes(), neg[a:z].tobytes()) if whole else ()
                        for c, v in zip(columns, (int(pos[a:z].sum(dtype=np.int64)), int(neg[a:z].sum(dtype=np.int64)), *parts)):
                            c.append(v)
            at = pa.array(source, pa.int64())
            types = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())[:5 if whole else 2]
            names = [*(f"g{i}" for i in range(n)), "r", *("p", "q", "scores", "pos", "neg")[:len(types)]]
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(at) for i in range(n)), pa.array(r, pa.int32()),
                                              *(pa.array(c, t) for c, t in zip(columns, types))], names=names)
    return run


def _div(a, b):
    """a / b; NaN, which stands for null, where b is 0."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(b == 0, np.nan, a / b)


def _wilson(k, n, z: float):
    """Both bounds, as ``functions.scalar.wilson_bounds``."""
    a, b, c = 2.0 * k + z * z, z * np.sqrt(z * z + 4.0 * k * (1.0 - _div(k, n))), 2.0 * (n + z * z)
    return _div(a - b, c), _div(a + b, c)


def _rates(tpr, fpr, P: float, N: float, z: float) -> dict[str, np.ndarray]:
    """As ``evaluate._rates``, in the same arithmetic."""
    fnr, tnr = 1.0 - tpr, 1.0 - fpr
    TP = tpr * P
    ppv, npv = _div(TP, TP + fpr * N), _div(tnr * N, tnr * N + fnr * P)
    ppv_low, ppv_high = _wilson(TP, TP + fpr * N, z)
    return {"ppv": ppv, "ppv_low": ppv_low, "ppv_high": ppv_high, "youden": tpr + tnr,
            "mcc": np.sqrt(tpr * tnr * ppv * npv) - np.sqrt((1.0 - ppv) * fnr * fpr * (1.0 - npv)),
            "f1": _div(2.0 * ppv * tpr, ppv + tpr), "ji": _div(TP, TP + fnr * P + fpr * N)}


def _measured(n: int, z: float):
    """The pieces of one range -> its part of the sums, and its best cutoff by every criterion."""
    def run(table: pa.Table) -> pa.Table:
        names = table.column_names
        column = dict(zip(names, table.columns))
        read = {k: np.concatenate([np.frombuffer(v.as_buffer(), t) for v in column[k]]) for k, t in
                (("scores", np.float64), ("pos", np.int32), ("neg", np.int32))}
        order = np.argsort(-read["scores"], kind="stable")
        s = read["scores"][order]
        first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        s = s[first]
        pos, neg = (np.add.reduceat(read[k][order].astype(np.int64), first) for k in ("pos", "neg"))
        above_pos, above_neg, p, q = (column[k][0].as_py() for k in ("above_p", "above_q", "all_p", "all_q"))
        tp, fp, P, N = above_pos + np.cumsum(pos), above_neg + np.cumsum(neg), float(p), float(q)
        out: dict[str, float | int | None] = {}
        with np.errstate(invalid="ignore", over="ignore"):
            tpr, fpr = _div(tp.astype(float), P), _div(fp.astype(float), N)
            prev_tpr, prev_fpr = _div((tp - pos).astype(float), P), _div((fp - neg).astype(float), N)
            now, before = _rates(tpr, fpr, P, N, z), _rates(prev_tpr, prev_fpr, P, N, z)
            real = s != np.inf
            joined = real & (tp - pos + fp - neg > 0)
            dx = tpr - prev_tpr
            v01, v10 = _div(N - fp + neg / 2.0, N), _div(tp - pos / 2.0, P)
            midrank = (P + N) - (tp + fp) + (pos + neg + 1) / 2.0
            terms = (pos * v01, pos * (v01 - 0.5) * (v01 - 0.5), neg * v10, neg * (v10 - 0.5) * (v10 - 0.5), pos * midrank,
                     *(dx * (now[k] + before[k]) / 2.0 for k in ("ppv", "ppv_low", "ppv_high")))
            for name, v in zip(SUMS, terms):
                out[name] = float(np.nansum(np.where(joined if name.startswith("auprc") else real, v, 0.0)))
            for name in CRITERIA:
                c = now[name] if name == "youden" else np.where(np.isnan(now[name]), 0.0, now[name])
                at = int(np.argmax(np.where(np.isnan(c), -np.inf, c)))  # scores descend: the first of equal ones is the highest
                out |= {f"c_{name}": None if np.isnan(c[at]) else float(c[at]), f"t_{name}": float(s[at]), f"tp_{name}": int(tp[at]), f"fp_{name}": int(fp[at])}
        made = [pa.array([v], pa.int64() if k[:2] in ("tp", "fp") else pa.float64()) for k, v in out.items()]
        groups = [table.column(f"g{i}").slice(0, 1) for i in range(n)]
        return pa.table([*groups, *made, pa.array([p], pa.int64()), pa.array([q], pa.int64())], names=[*(f"g{i}" for i in range(n)), *out, "P", "N"])
    return run


def measured(df: DataFrame, group: Sequence[str], y: str, score: str, z: float) -> DataFrame:
    """(group, P, N, the sums, and per criterion c_, t_, tp_ and fp_: its value, threshold and running labels) of rows whose
    label and score aren't null or NaN: one row per group and range of its scores."""
    n = len(group)
    g = [f"g{i}" for i in range(n)]
    rows = df.select(*[named(c).alias(x) for c, x in zip(group, g)], F.col(y).cast("long").alias("y"), F.col(score).cast("double").alias("s"))
    keys = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in rows.schema.fields[:n])
    blocks = freeze(rows.mapInArrow(_blocks(n), keys + "rows long, kept array<double>, scores binary, pos binary, neg binary"), "blocks")

    # bounds of the groups that need any: at most one for every RANGE_ROWS / 2 rows
    sizes = blocks.groupBy(*g).agg(F.sum("rows").alias("rows")).withColumn("ranges", F.ceil(F.col("rows") / RANGE_ROWS).cast("int"))
    large = freeze(sizes.where(F.col("ranges") > 1), "large")
    same = _null_safe(g)
    each = blocks.alias("a").join(checked(large, name="large").alias("b"), same("a", "b")).select(
        *[F.col(f"a.{x}").alias(x) for x in g], "b.ranges", F.explode("a.kept").alias("v"))
    at = Window.partitionBy(*(g or [F.lit(1)])).orderBy("v")
    ranked = each.withColumn("k", F.row_number().over(at)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*(g or [F.lit(1)]))))
    part = F.floor(F.col("k") * F.col("ranges") / F.col("n"))
    bounds = ranked.where(part > F.floor((F.col("k") - 1) * F.col("ranges") / F.col("n"))).where(F.col("k") < F.col("n")) \
        .groupBy(*g).agg(F.sort_array(F.collect_set("v")).alias("bounds"))
    bounded = blocks.alias("a").join(checked(bounds, name="bounds").alias("b"), same("a", "b"), "left").select(
        *[F.col(f"a.{x}").alias(x) for x in g], "a.scores", "a.pos", "a.neg", "b.bounds")

    parts = bounded.mapInArrow(_cut(n, False), keys + "r int, p long, q long").groupBy(*g, "r").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    whole = Window.partitionBy(*(g or [F.lit(1)]))
    above = whole.orderBy(F.col("r").desc()).rowsBetween(Window.unboundedPreceding, -1)
    carry = parts.select(*g, "r", *[F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"above_{c}") for c in "pq"],
                         *[F.sum(c).over(whole).alias(f"all_{c}") for c in "pq"])
    pieces = bounded.mapInArrow(_cut(n, True), keys + "r int, p long, q long, scores binary, pos binary, neg binary")
    carried = pieces.alias("a").join(checked(carry, name="carry").alias("b"), same("a", "b") & (F.col("a.r") == F.col("b.r"))).select(
        *[F.col(f"a.{x}").alias(x) for x in [*g, "r", "scores", "pos", "neg"]], "above_p", "above_q", "all_p", "all_q")
    made = ", ".join([*(f"{c} double" for c in SUMS), *(f"c_{c} double, t_{c} double, tp_{c} long, fp_{c} long" for c in CRITERIA)])
    found = carried.groupBy(*g, "r").applyInArrow(_measured(n, z), f"{keys}{made}, P long, N long")
    return found.select(*[F.col(x).alias(c) for x, c in zip(g, group)], *found.columns[n:])

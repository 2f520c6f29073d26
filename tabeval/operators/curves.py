"""Curve operators: grid interpolation, averaged ROC/PR, calibration, decision
curves, multiclass one-vs-rest, bootstrap AUC (SURVEY 2.10, 2.9 interp_on_grid).

Interpolation follows ``numpy.interp`` exactly: the left vertex is the *last*
curve vertex whose x is <= the grid point, the value is
``slope * (g - x0) + y0`` with ``slope = (y1 - y0) / (x1 - x0)``, and grid points
at or past the last vertex take its y. A curve segment (previous vertex ->
vertex) is derived from the running sums of its score group, so no window over
a curve is needed; each segment emits only the grid points it contains.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import inline_rows, named
from ..functions.stats import t_ppf
from . import evaluate as ev
from .ordered import attach, checked, freeze, prefix_sum, range_bounds, slice_of

_div = F.try_divide


def grid_step(n_points: int) -> float:
    """numpy.linspace(0, 1, n) step: point i is ``i * step``, the last is 1.0."""
    return 1.0 / (n_points - 1)


def _grid_value(i: Column, n_points: int) -> Column:
    return F.when(i == n_points - 1, F.lit(1.0)).otherwise(i.cast("double") * F.lit(grid_step(n_points)))


def segments(sg: DataFrame, group: Sequence[str], kind: str = "roc") -> DataFrame:
    """Curve segments (x0, y0) -> (x1, y1), one per score group, in curve order.

    kind='roc': x = fpr, y = tpr.  kind='pr': x = recall, y = precision, the curve
    starting at (recall 0, precision 1).
    """
    group = list(group)
    P, N = F.col("P").cast("double"), F.col("N").cast("double")
    tp0, fp0 = F.col("tp") - F.col("pos"), F.col("fp") - F.col("neg")
    if kind == "roc":
        x0, x1 = _div(fp0.cast("double"), N), _div(F.col("fp").cast("double"), N)
        y0, y1 = _div(tp0.cast("double"), P), _div(F.col("tp").cast("double"), P)
    elif kind == "pr":
        x0, x1 = _div(tp0.cast("double"), P), _div(F.col("tp").cast("double"), P)
        y0 = F.when(tp0 + fp0 == 0, F.lit(1.0)).otherwise(_div(tp0.cast("double"), (tp0 + fp0).cast("double")))
        y1 = _div(F.col("tp").cast("double"), (F.col("tp") + F.col("fp")).cast("double"))
    else:
        raise ValueError(kind)
    return sg.select(*group, "P", "N", x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))


def interp_on_grid(sg: DataFrame, group: Sequence[str], n_points: int = 100, kind: str = "roc") -> DataFrame:
    """Each curve interpolated at ``linspace(0, 1, n_points)``: (group, grid_index, x, y)."""
    group = list(group)
    seg = segments(sg, group, kind).where(F.col("x1") > F.col("x0"))
    m = float(n_points - 1)
    lo = F.greatest(F.ceil(F.col("x0") * m) - 1, F.lit(0))
    hi = F.least(F.floor(F.col("x1") * m) + 1, F.lit(n_points - 2))
    # cheap prefilter with slack; the exact test runs after expansion
    seg = seg.where(F.ceil(F.col("x0") * m - 1e-9) <= F.floor(F.col("x1") * m + 1e-9))
    pts = seg.withColumn("grid_index", F.explode(F.sequence(lo.cast("int"), hi.cast("int"))))
    g = _grid_value(F.col("grid_index"), n_points)
    pts = pts.withColumn("x", g).where((F.col("x0") <= F.col("x")) & (F.col("x") < F.col("x1")))
    slope = (F.col("y1") - F.col("y0")) / (F.col("x1") - F.col("x0"))
    val = F.when(F.col("x") == F.col("x0"), F.col("y0")).otherwise(slope * (F.col("x") - F.col("x0")) + F.col("y0"))
    inner = pts.select(*group, "grid_index", "x", val.alias("y"))
    # the last grid point (1.0) sits at/after the final vertex: take its y
    P, N = F.col("P").cast("double"), F.col("N").cast("double")
    last_y = F.lit(1.0) if kind == "roc" else _div(P, P + N)
    tail = sg.groupBy(*group).agg(F.first("P").alias("P"), F.first("N").alias("N")) \
        .select(*group, F.lit(n_points - 1).alias("grid_index"), F.lit(1.0).alias("x"), last_y.alias("y"))
    return inner.unionByName(tail)


def averaged_roc(sg: DataFrame, group: Sequence[str], fold: str = "fold", n_points: int = 100,
                 n_curves: int | None = None) -> DataFrame:
    """Mean ROC over folds on a 100-point fpr grid with t-based bands, and the
    mean-curve AUC with its CI (t quantile with df = number of curves)."""
    group = list(group)
    fg = group + [fold]
    curves = interp_on_grid(sg, fg, n_points, "roc") \
        .withColumn("y", F.when(F.col("grid_index") == 0, F.lit(0.0)).otherwise(F.col("y")))
    k = n_curves or _curve_count(sg, group, fold)
    t = t_ppf(0.975, k)
    mean = curves.groupBy(*group, "grid_index").agg(
        F.first("x").alias("fpr"), F.avg("y").alias("_m"), F.stddev_pop("y").alias("_sd"))
    mean = mean.withColumn("mean_tpr", F.when(F.col("grid_index") == n_points - 1, F.lit(1.0)).otherwise(F.col("_m")))
    se = F.col("_sd") / F.sqrt(F.lit(float(k)))
    mean = mean.select(*group, "grid_index", "fpr", "mean_tpr",
                       F.least(F.col("mean_tpr") + t * se, F.lit(1.0)).alias("tpr_high"),
                       F.greatest(F.col("mean_tpr") - t * se, F.lit(0.0)).alias("tpr_low"))
    auc_mean = _trapezoid(mean, group, "grid_index", "fpr", "mean_tpr", "mean_auc")
    fold_auc = ev.auc_table(sg, fg)
    spread = fold_auc.groupBy(*group).agg(F.stddev_pop("auc").alias("std_auc"))
    summ = attach(auc_mean, spread, group)
    se_auc = F.col("std_auc") / F.sqrt(F.lit(float(k)))
    summ = summ.select(*group, "mean_auc", "std_auc",
                       F.greatest(F.col("mean_auc") - t * se_auc, F.lit(0.0)).alias("auc_cilow"),
                       F.least(F.col("mean_auc") + t * se_auc, F.lit(1.0)).alias("auc_cihigh"))
    return attach(mean, summ, group)


def averaged_pr(sg: DataFrame, group: Sequence[str], fold: str = "fold", n_points: int = 100) -> DataFrame:
    """Mean precision over folds on a recall grid, and the mean of the fold PR AUCs."""
    from .rates import pr_auc
    group = list(group)
    fg = group + [fold]
    curves = interp_on_grid(sg, fg, n_points, "pr")
    mean = curves.groupBy(*group, "grid_index").agg(F.first("x").alias("recall"),
                                                     F.avg("y").alias("mean_precision"))
    aucs = pr_auc(sg, fg).groupBy(*group).agg(F.avg("pr_auc").alias("mean_pr_auc"))
    return attach(mean, aucs, group)


def _curve_count(sg: DataFrame, group: Sequence[str], fold: str) -> int:
    # a handful of integers (curves per group); fails loudly if groups disagree
    ks = [r[0] for r in sg.groupBy(*group).agg(F.countDistinct(fold)).distinct().collect()]
    if len(ks) != 1:
        raise ValueError(f"groups have different numbers of curves: {ks}; pass n_curves")
    return int(ks[0])


def _trapezoid(df: DataFrame, group: Sequence[str], order: str, x: str, y: str, out: str) -> DataFrame:
    """Trapezoid area over a small per-group grid table (one window per group)."""
    w = Window.partitionBy(*group).orderBy(order)
    t = df.select(*group, x, y, F.lag(x).over(w).alias("_x0"), F.lag(y).over(w).alias("_y0"))
    return t.groupBy(*group).agg(
        F.sum(F.when(F.col("_x0").isNotNull(), (F.col(x) - F.col("_x0")) * (F.col(y) + F.col("_y0")) / 2.0)
              .otherwise(0.0)).alias(out))


# ----------------------------------------------------------------- calibration
def calibration_curve(df: DataFrame, group: Sequence[str] = (), y: str = "y", prob: str = "prob",
                      n_bins: int = 10) -> DataFrame:
    """Uniform bins on [0, 1]: bin = number of inner edges (i / n_bins) below the
    probability; mean probability and positive share per non-empty bin."""
    group = list(group)
    step = 1.0 / n_bins
    b = sum((F.col(prob) > F.lit(i * step)).cast("int") for i in range(1, n_bins))
    return df.where(F.col(prob).isNotNull() & F.col(y).isNotNull()).groupBy(*group, b.alias("bin")).agg(
        F.avg(F.col(y).cast("double")).alias("prob_true"), F.avg(F.col(prob)).alias("prob_pred"),
        F.count(F.lit(1)).cast("long").alias("count"))


# ---------------------------------------------------------------- net benefit
def _grid_bucket(score: Column, step: float, n: int, strict: bool) -> Column:
    """Largest grid index i (0 <= i < n, grid i*step) with i*step < score
    (``strict``) or <= score; -1 if none. Exact in floating point."""
    c = F.floor(score / F.lit(step)).cast("long")
    cmp = (lambda g: g < score) if strict else (lambda g: g <= score)
    c = F.least(F.greatest(c, F.lit(-1)), F.lit(n - 1))
    c = F.when((c >= 0) & ~cmp(c.cast("double") * F.lit(step)), c - 1).otherwise(c)
    c = F.when((c + 1 <= n - 1) & cmp((c + 1).cast("double") * F.lit(step)), c + 1).otherwise(c)
    return F.when(score.isNull(), F.lit(None)).otherwise(c)


def net_benefit(df: DataFrame, group: Sequence[str] = (), y: str = "y", prob: str = "prob",
                n_thresholds: int = 1000, strict: bool = True) -> DataFrame:
    """Decision curve at t = i/n_thresholds (i = 0..n-1): model, treat-all, treat-none.

    model: TP/n - FP/n * t/(1-t) with a row positive when prob > t (``strict``).
    Rows are counted into a histogram of their highest reachable threshold
    bucket, then suffix-summed over the n-point grid — never n x thresholds.
    """
    group = list(group)
    step = 1.0 / n_thresholds
    base = df.where(F.col(y).isNotNull() & F.col(prob).isNotNull() & ~F.isnan(prob))
    hist = base.groupBy(*group, _grid_bucket(F.col(prob), step, n_thresholds, strict).alias("i")).agg(
        F.sum(F.col(y).cast("long")).alias("pos"), F.sum(1 - F.col(y).cast("long")).alias("neg"))
    tot = hist.groupBy(*group).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    grid = tot.select(*group, F.explode(F.sequence(F.lit(0), F.lit(n_thresholds - 1))).alias("i"),
                      F.lit(0).cast("long").alias("pos"), F.lit(0).cast("long").alias("neg"))
    full = grid.unionByName(hist.where(F.col("i") >= 0)).groupBy(*group, "i").agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    w = Window.partitionBy(*group).orderBy(F.col("i").desc()).rowsBetween(Window.unboundedPreceding, 0)
    run = full.select(*group, "i", F.sum("pos").over(w).alias("TP"), F.sum("neg").over(w).alias("FP"))
    run = attach(run, tot, group)
    t = F.col("i").cast("double") * F.lit(step)
    n = (F.col("P") + F.col("N")).cast("double")
    odds = t / (1.0 - t)
    return run.select(*group, t.alias("threshold"),
                      (F.col("TP") / n - F.col("FP") / n * odds).alias("net_benefit_model"),
                      (F.col("P") / n - F.col("N") / n * odds).alias("net_benefit_all"),
                      F.lit(0.0).alias("net_benefit_none"))


def net_benefit_interp(df: DataFrame, group: Sequence[str] = (), y: str = "y", prob: str = "prob",
                       n_points: int = 20000) -> DataFrame:
    """Fine decision curve: counts of rows with prob >= t on t = j * (1 - 1/n)/(n - 1)."""
    group = list(group)
    step = (1.0 - 1.0 / n_points) / (n_points - 1)
    base = df.where(F.col(y).isNotNull() & F.col(prob).isNotNull() & ~F.isnan(prob))
    hist = base.groupBy(*group, _grid_bucket(F.col(prob), step, n_points, strict=False).alias("i")).agg(
        F.sum(F.col(y).cast("long")).alias("pos"), F.sum(1 - F.col(y).cast("long")).alias("neg"))
    tot = hist.groupBy(*group).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    grid = tot.select(*group, F.explode(F.sequence(F.lit(0), F.lit(n_points - 1))).alias("i"),
                      F.lit(0).cast("long").alias("pos"), F.lit(0).cast("long").alias("neg"))
    full = grid.unionByName(hist.where(F.col("i") >= 0)).groupBy(*group, "i").agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    w = Window.partitionBy(*group).orderBy(F.col("i").desc()).rowsBetween(Window.unboundedPreceding, 0)
    run = full.select(*group, "i", F.sum("pos").over(w).alias("TP"), F.sum("neg").over(w).alias("FP"))
    run = attach(run, tot, group)
    t = F.col("i").cast("double") * F.lit(step)
    n = (F.col("P") + F.col("N")).cast("double")
    return run.select(*group, t.alias("threshold"), (F.col("TP") / n - F.col("FP") / n * (t / (1.0 - t)))
                      .alias("net_benefit"))


# ----------------------------------------------------------------- multiclass
def roc_multiclass(df: DataFrame, group: Sequence[str], label: str, class_scores: dict[str, str]) -> DataFrame:
    """One-vs-rest AUC per class, micro average (pooled) and macro average
    (mean of per-class interpolated tpr on the union of class fprs).

    Returns (group, curve, auc) with curve = class value, 'micro' or 'macro'.
    """
    group = list(group)
    classes = list(class_scores)
    ovr = inline_rows(df, [{"curve": F.lit(c), "y": (named(label) == F.lit(c)).cast("int"), "score": named(s).cast("double")}
                           for c, s in class_scores.items()], group)
    sg = ev.score_groups(ovr, group + ["curve"])
    per_class = ev.auc_table(sg, group + ["curve"])
    micro = ev.auc_table(ev.score_groups(ovr, group), group).withColumn("curve", F.lit("micro"))
    macro = _macro_auc(sg, group, "curve", classes).withColumn("curve", F.lit("macro"))
    cols = group + ["curve", "auc"]
    return per_class.select(*cols).unionByName(micro.select(*cols)).unionByName(macro.select(*cols))


def _macro_auc(sg: DataFrame, group: Sequence[str], cls: str, classes: Sequence[str]) -> DataFrame:
    """Macro-average ROC AUC: interpolate every class curve at the union of all
    class fpr values (as-of by prefix counts, no range join), average, trapezoid."""
    group = list(group)
    cg = group + [cls]
    seg = segments(sg, cg, "roc")
    # curve vertices, including the (0, 0) start, with their fpr/tpr
    verts = seg.select(*cg, F.col("x1").alias("x"), F.col("y1").alias("y")) \
        .unionByName(sg.groupBy(*cg).agg(F.lit(0.0).alias("x"), F.lit(0.0).alias("y")))
    union_x = verts.select(*group, "x").distinct()
    # every class curve is evaluated at every union point (the class list is the caller's)
    pts = union_x.withColumn(cls, F.explode(F.array(*[F.lit(c) for c in classes])))
    # ordinal of each vertex along its curve (x then y ascending, unique per curve)
    v_ord = prefix_sum(verts.withColumn("_one", F.lit(1).cast("long")), cg, ["x", "y"], ["_one"], prefix="_o")
    v_ord = v_ord.select(*cg, "x", "y", F.col("_o_one").alias("ord"))
    # as-of: ordinal of the last vertex with x <= point = count of vertices with x <= point
    marks = v_ord.select(*cg, "x", F.lit(0).alias("_kind"), F.col("ord").cast("double").alias("_tb"),
                         F.lit(1).cast("long").alias("_isv")) \
        .unionByName(pts.select(*cg, "x", F.lit(1).alias("_kind"), F.lit(0.0).alias("_tb"),
                                F.lit(0).cast("long").alias("_isv")))
    run = prefix_sum(marks, cg, ["x", "_kind", "_tb"], ["_isv"], prefix="_c")
    at = run.where(F.col("_kind") == 1).select(*cg, "x", F.col("_c_isv").alias("ord"))
    left = v_ord.select(*cg, F.col("ord"), F.col("x").alias("x0"), F.col("y").alias("y0"))
    right = v_ord.select(*cg, (F.col("ord") - 1).alias("ord"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    j = at.join(left, cg + ["ord"]).join(right, cg + ["ord"], "left")
    slope = (F.col("y1") - F.col("y0")) / (F.col("x1") - F.col("x0"))
    val = F.when(F.col("x1").isNull() | (F.col("x") == F.col("x0")), F.col("y0")) \
        .otherwise(slope * (F.col("x") - F.col("x0")) + F.col("y0"))
    mean = j.select(*group, "x", val.alias("v")).groupBy(*group, "x").agg(F.avg("v").alias("mean_tpr"))
    # trapezoid over the sorted union points: rank them, pair each with its predecessor
    ranked = prefix_sum(mean.withColumn("_one", F.lit(1).cast("long")), group, ["x"], ["_one"], prefix="_r")
    cur = ranked.select(*group, F.col("_r_one").alias("r"), "x", "mean_tpr")
    prev = ranked.select(*group, (F.col("_r_one") + 1).alias("r"), F.col("x").alias("px"),
                         F.col("mean_tpr").alias("py"))
    pairs = cur.join(prev, group + ["r"])
    return pairs.groupBy(*group).agg(
        F.sum((F.col("x") - F.col("px")) * (F.col("mean_tpr") + F.col("py")) / 2.0).alias("auc"))


# ------------------------------------------------------------------ bootstrap
#: rows of a cell whose weights are drawn at once: Poisson(c) is the sum of one Poisson(BLOCK) draw per
#: full BLOCK rows and one Poisson(1) draw per row of the rest, exact for every c
POISSON_BLOCK = 64


class _Draws:
    """The weights of a cell of some rows in every replicate: hash-seeded by the cell's key, the replicate and the draw's number."""

    def __init__(self, n_boot: int, seed: int):
        from .sample import poisson_cdf
        self.n_boot, self.replicates = n_boot, [b"%d:" % r for r in range(n_boot)]
        self.kinds = [(b"%d:b:" % seed, np.array(poisson_cdf(float(POISSON_BLOCK)))), (b"%d:p:" % seed, np.array(poisson_cdf(1.0)))]

    def of(self, key: str, count: int) -> np.ndarray:
        weights = np.zeros(self.n_boot)
        for (tag, cdf), n in zip(self.kinds, divmod(count, POISSON_BLOCK)):
            starts = [hashlib.md5(tag + key.encode() + b":" + r) for r in self.replicates] if n else []
            for i in range(1, n + 1):
                last, digests = b"%d" % i, []
                for start in starts:
                    h = start.copy()
                    h.update(last)
                    digests.append(h.digest())
                # the first 15 hex digits as a share of 2^60, then how many CDF values lie at or below it
                bits = np.frombuffer(b"".join(digests), ">u8")[::2] >> np.uint64(4)
                weights += np.searchsorted(cdf, bits.astype(float) / float(1 << 60), side="right")
        return weights


def _replicate_sums(n_boot: int, seed: int):
    """Per slice of cells (label order within a score doesn't matter), one row: its summed weights and its own part of
    the Mann-Whitney statistic, per replicate. Cells come sorted by slice and score, a block at a time."""
    schema = pa.schema([("_slice", pa.int64()), *((c, pa.list_(pa.float64())) for c in ("pos", "neg", "own"))])

    def row(key, state):
        pos, neg, own, tie_pos, tie_neg, _ = state
        own = own + tie_pos * neg + 0.5 * tie_pos * tie_neg
        return pa.RecordBatch.from_pydict({"_slice": [key], "pos": [pos + tie_pos], "neg": [neg + tie_neg], "own": [own]}, schema=schema)

    def run(batches):
        key, state, draws = None, None, _Draws(n_boot, seed)
        for batch in batches:
            slices, scores, labels = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            keys, counts = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            # runs of cells of one score in one slice: at most the two labels
            for k in range(batch.num_rows):
                if slices[k] != key:
                    if state is not None:
                        yield row(key, state)
                    key, state = slices[k], [np.zeros(n_boot) for _ in range(5)] + [None]
                if scores[k] != state[5]:  # a new, larger score: the last one's cells now lie below
                    pos, neg, own, tie_pos, tie_neg, _ = state
                    own += tie_pos * neg + 0.5 * tie_pos * tie_neg
                    pos += tie_pos
                    neg += tie_neg
                    state[3], state[4], state[5] = np.zeros(n_boot), np.zeros(n_boot), scores[k]
                at = 3 if labels[k] == 1 else 4
                state[at] = state[at] + draws.of(keys[k], counts[k])
        if state is not None:
            yield row(key, state)
    return run


def bootstrap_auc_ci(df: DataFrame, group: Sequence[str], row_id: str, y: str = "y", score: str = "score",
                     n_boot: int = 1000, seed: int = 42) -> DataFrame:
    """Poisson-bootstrap AUC percentiles (2.5, 97.5) per group.

    Rows are first collapsed to (group, score, label) cells; replicate b gives a
    cell of c rows the weight Poisson(c) (the sum of c Poisson(1) row weights),
    so tied scores cost one cell, not c rows, per replicate. Cells are cut into
    slices by (group, score) and shuffled once; a cell's weights of all replicates are drawn in the
    task that reads it, which adds up its slice with a total carried per replicate. A slice gives one row; the
    rows of a group (at most one per shuffle partition) are joined in score order. What is shuffled
    doesn't depend on ``n_boot``. ``row_id`` is accepted for API symmetry; cells replace rows."""
    group = list(group)
    cells = ev.clean_predictions(df, y, score).groupBy(*[named(g) for g in group], named(score).cast("double").alias("score"),
                                                       named(y).cast("int").alias("_y")) \
        .agg(F.count(F.lit(1)).alias("_c"))
    names = [f"_g{i}" for i in range(len(group))]
    cells = freeze(cells.select(*[named(g).alias(n) for g, n in zip(group, names)], "score", "_y", "_c"), "cells")
    slices = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = [*names, "score"]
    cut = cells.withColumn("_range", slice_of(cells, key, range_bounds(cells, key, slices)))
    # a slice is one group's part of a range: numbered by a hash of both
    cut = cut.withColumn("_slice", F.xxhash64("_range", *names))
    where = checked(cut.select("_slice", "_range", *names).distinct(), name="slices")
    # a task per range: cells are small, so by their bytes most of them would be given to one task
    dealt = cut.repartitionByRange(slices, "_range", *names).sortWithinPartitions("_slice", "score")
    text = F.concat_ws(":", *[F.col(n).cast("string") for n in names], F.col("score").cast("string"), F.col("_y").cast("string"))
    # _w: what the cell's weights are drawn from
    sums = dealt.select("_slice", "score", "_y", text.alias("_w"), "_c").mapInArrow(
        _replicate_sums(n_boot, seed), "_slice long, pos array<double>, neg array<double>, own array<double>")
    types = df.select(*[named(g).alias(n) for g, n in zip(group, names)]).schema.simpleString()[len("struct<"):-1]

    def percentiles(rows: pd.DataFrame) -> pd.DataFrame:
        below, won, pos = np.zeros(n_boot), np.zeros(n_boot), np.zeros(n_boot)
        for r in rows.sort_values("_range").itertuples():
            p = np.asarray(r.pos)
            won += np.asarray(r.own) + p * below
            below += np.asarray(r.neg)
            pos += p
        ok = (pos > 0) & (below > 0)
        auc = won[ok] / (pos[ok] * below[ok])
        q = np.percentile(auc, [2.5, 97.5]) if len(auc) else [None, None]
        return pd.DataFrame([[*(rows[n].iloc[0] for n in names), *q, len(auc)]], columns=[*names, "ci_low", "ci_high", "n_boot"])

    found = sums.join(where, "_slice").groupBy(*names).applyInPandas(
        percentiles, ", ".join(filter(None, [types.replace(",", ", "), "ci_low double, ci_high double, n_boot long"])))
    return found.where("n_boot > 0").select(*[F.col(n).alias(g) for n, g in zip(names, group)], "ci_low", "ci_high", "n_boot")


def flip_low_auc_folds(preds: DataFrame, group: Sequence[str], fold: str = "fold", y: str = "y",
                       score: str = "score") -> DataFrame:
    """Parity option (Q8): a fold whose AUC is below 0.5 gets ``1 - score``
    before averaging, as the reference's averaged-ROC routine does."""
    fg = list(group) + [fold]
    aucs = ev.auc_table(ev.score_groups(preds, fg, y, score), fg).select(*fg, (F.col("auc") < 0.5).alias("_flip"))
    j = attach(preds, aucs, fg)
    return j.withColumn(score, F.when(F.col("_flip"), 1.0 - F.col(score)).otherwise(F.col(score))).drop("_flip")

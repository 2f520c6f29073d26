"""Many models over the same rows in a few passes: what a search or a selection of features asks for.

A search fits one learner hundreds of times on parts of one table. Fitted one by one, every model reads the rows
again and again; here a pass reads them once for all models:

* ``fit_logistic``: penalised logistic regressions by Newton's method (proximal where an absolute penalty asks for
  it). A task adds up loss, gradient and curvature of all models over its rows, by matrix products; a few
  numbers per model reach the driver, which takes the step. The penalties are those of ``models.build_classifier``,
  the optimum is the one that MLlib's solver stops near.
* ``Ranks``: the AUC of many scores of many rows, exact. Tasks sort their scores and cut them at bounds taken from a sample
  of the rows; a range of one model's scores is merged in one task, and the ranges are added up.
* ``cut_trees``: a decision tree of depth d is the deeper tree cut at depth d (splits don't depend on what lies below
  them), with cut siblings of one prediction merged as MLlib does. So one fit serves all depths of a search, and
  one pass counts the labels in the leaves of all trees. Where there are many more rows than cells of binned rows, the same pass counts
  the cells of all folds (``forest.count_folds``), and every tree is grown and measured from these.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import forest as fo
from . import models as md
from .concurrency import run_bounded
from .ordered import drop, frozen_path

#: numbers of a block of rows x models; numbers that all tasks of a pass may send together; features of a batch at most
BLOCK_NUMBERS, SENT_NUMBERS, MOST_FEATURES = 1 << 18, 1 << 22, 60
#: passes of Newton's method; a smaller step of standardised coefficients ends it
PASSES, SMALL_STEP = 60, 1e-7
#: rows of one range of scores; rows sampled per range; rows sorted at once in a task; models ranked in one pass
RANGE_ROWS, SAMPLED_ROWS, SORTED_ROWS, RANKED_AT_ONCE = 250_000, 64, 1 << 17, 40


@dataclass(frozen=True)
class Linear:
    """A logistic regression fitted without the rows of one fold."""
    fold: int
    weights: tuple[float, ...]
    intercept: float


def _matrix(batch: pa.RecordBatch, n: int) -> np.ndarray:
    return np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(n)], axis=1) if n else np.zeros((batch.num_rows, 0))


def _frame(rows: DataFrame, n: int) -> DataFrame:
    """Features, label and fold, by position."""
    return rows.select(*md.inputs(n), F.col(md.LABEL).cast("double"), F.col("_fold").cast("long"))


# ---------------------------------------------------------------- logistic
@dataclass
class Summary:
    """Counts of labels by fold, and each feature's mean and deviation over all rows."""
    counts: dict[tuple[int, float], int]
    mean: np.ndarray
    deviation: np.ndarray
    finite: bool

    def training(self, fold: int) -> tuple[int, int]:
        """Rows of the other folds, and how many of them have label 1."""
        return (sum(c for (f, _), c in self.counts.items() if f != fold), sum(c for (f, y), c in self.counts.items() if f != fold and y == 1.0))

    def rows(self) -> int:
        return sum(self.counts.values())


def summary(rows: DataFrame, n: int) -> Summary:
    x = md.inputs(n)
    bad = F.lit(False)
    for c in x:
        bad = bad | F.col(c).isNull() | F.isnan(c) | F.col(c).isin(float("inf"), float("-inf"))
    got = rows.groupBy("_fold", md.LABEL).agg(F.count(F.lit(1)).alias("n"), F.max(bad).alias("bad"), *[F.avg(c).alias(f"m{c}") for c in x],
                                              *[F.var_pop(c).alias(f"v{c}") for c in x]).collect()  # two rows a fold
    total = sum(r["n"] for r in got)
    finite = bool(total) and not any(r["bad"] for r in got)
    mean, spread = np.zeros(n), np.ones(n)
    if finite:
        size = np.array([r["n"] for r in got], float)[:, None]
        m, v = (np.array([[r[f"{k}{c}"] for c in x] for r in got], float).reshape(len(got), n) for k in "mv")
        mean = (size * m).sum(0) / total
        spread = np.sqrt((size * (v + (m - mean) ** 2)).sum(0) / total)
    return Summary({(r["_fold"], r[md.LABEL]): r["n"] for r in got}, mean, np.where(spread > 0, spread, 1.0), finite)


def _sums(n: int, mean: np.ndarray, deviation: np.ndarray, w: np.ndarray, fold: np.ndarray):
    """Per task: loss, gradient and upper half of the curvature of every model over its rows."""
    a, b = np.triu_indices(n + 1)

    def run(batches):
        acc = np.zeros((len(w), 1 + n + 1 + len(a)))
        step = max(64, BLOCK_NUMBERS // max(1, len(w)))
        for batch in batches:
            x, y, f = _matrix(batch, n), batch.column(n).to_numpy(), batch.column(n + 1).to_numpy()
            x = np.concatenate([np.ones((len(x), 1)), (x - mean) / deviation], axis=1)
            for k in range(0, len(x), step):
                u, t, inside = x[k:k + step], y[k:k + step, None], f[k:k + step, None] != fold[None, :]
                m = u @ w.T
                e = np.exp(-np.abs(m))
                p = np.where(m >= 0, 1.0, e) / (1.0 + e)
                acc[:, 0] += ((np.maximum(m, 0.0) + np.log1p(e) - t * m) * inside).sum(0)
                acc[:, 1:n + 2] += ((p - t) * inside).T @ u
                acc[:, n + 2:] += (p * (1.0 - p) * inside).T @ (u[:, a] * u[:, b])
        yield pa.RecordBatch.from_arrays([pa.array([acc.tobytes()], pa.binary())], names=["sums"])
    return run


def _direction(w: np.ndarray, g: np.ndarray, h: np.ndarray, l1: np.ndarray) -> np.ndarray:
    """The step to the least value of each model's quadratic approximation plus its absolute penalty."""
    d = np.zeros_like(w)
    plain = ~(l1 > 0).any(axis=1)
    if plain.any():
        d[plain] = -np.linalg.solve(h[plain], g[plain][:, :, None])[:, :, 0]
    some = np.flatnonzero(~plain)
    if len(some):
        w, g, h, l1, s = w[some], g[some], h[some], l1[some], np.zeros((len(some), w.shape[1]))
        for _ in range(2000):  # one coordinate of all models at a time
            moved = 0.0
            for i in range(w.shape[1]):
                z = w[:, i] + s[:, i] - (g[:, i] + (h[:, i, :] * s).sum(1)) / h[:, i, i]
                new = np.sign(z) * np.maximum(np.abs(z) - l1[:, i] / h[:, i, i], 0.0) - w[:, i]
                moved = max(moved, float(np.abs(new - s[:, i]).max()))
                s[:, i] = new
            if moved < 1e-13:
                break
        d[some] = s
    return d


def _optima(sums_of: Callable[[np.ndarray, np.ndarray], np.ndarray], n: int, size: np.ndarray, ones: np.ndarray, l2: np.ndarray, l1: np.ndarray) -> np.ndarray | None:
    """Newton's method for several models: intercept and weights of each; None if one doesn't come to rest. ``sums_of`` gives loss,
    gradient and upper half of the curvature over the rows, of the models whose numbers it is given."""
    a, b = np.triu_indices(n + 1)
    w = np.zeros((len(size), n + 1))
    w[:, 0] = np.log(ones / (size - ones))
    d, s, best, done = np.zeros_like(w), np.ones(len(size)), np.full(len(size), np.inf), np.zeros(len(size), bool)
    for _ in range(PASSES):
        live = np.flatnonzero(~done)
        if not len(live):
            break
        asked = w[live] + s[live, None] * d[live]
        sums = sums_of(asked, live)
        value = sums[:, 0] / size[live] + (l2[live] * asked ** 2).sum(1) / 2 + (l1[live] * np.abs(asked)).sum(1)
        better = value <= best[live] + 1e-13 * np.abs(value)
        s[live[~better]] /= 2
        at_rest = live[~better & (s[live] * np.abs(d[live]).max(1) < SMALL_STEP)]  # rounding hides the rest of the way
        done[at_rest] = True
        go = live[better]
        if not len(go):
            continue
        w[go], best[go], s[go] = asked[better], value[better], 1.0
        g = sums[better, 1:n + 2] / size[go, None] + l2[go] * w[go]
        h = np.zeros((len(go), n + 1, n + 1))
        h[:, a, b] = h[:, b, a] = sums[better, n + 2:] / size[go, None]
        h[:, range(n + 1), range(n + 1)] += l2[go] + 1e-14
        d[go] = _direction(w[go], g, h, l1[go])
        if not np.isfinite(d[go]).all():
            return None
        small = go[np.abs(d[go]).max(1) < SMALL_STEP]
        w[small] += d[small]
        done[small] = True
    return w if done.all() else None


def fit_logistic(rows: DataFrame, n: int, known: Summary, models: Sequence[tuple[int, float, float]]) -> list[Linear] | None:
    """A model per (fold left out, squared penalty, absolute penalty); None if one doesn't come to rest."""
    frame, a, b = _frame(rows, n), *np.triu_indices(n + 1)
    most = max(1, SENT_NUMBERS // max(1, frame.rdd.getNumPartitions()) // (2 + n + len(a)))
    out: list[Linear] = []
    for at in range(0, len(models), most):
        some = models[at:at + most]
        fold = np.array([m[0] for m in some])
        size, ones = (np.array(v, float) for v in zip(*[known.training(f) for f in fold.tolist()]))
        scale = np.concatenate([[1.0], known.deviation])
        l2, l1 = (np.array([[0.0, *[m[i]] * n] for m in some]) / scale ** k for i, k in ((1, 2), (2, 1)))

        def asked(w: np.ndarray, live: np.ndarray, fold=fold) -> np.ndarray:
            got = frame.mapInArrow(_sums(n, known.mean, known.deviation, w, fold[live]), "sums binary").collect()  # a few numbers per model and task
            return sum(np.frombuffer(r["sums"]).reshape(len(live), -1) for r in got)
        w = _optima(asked, n, size, ones, l2, l1)
        if w is None:
            return None
        for f, v in zip(fold.tolist(), w):
            coefficients = v[1:] / known.deviation
            out.append(Linear(f, tuple(coefficients.tolist()), float(v[0] - coefficients @ known.mean)))
    return out


@dataclass
class Prepared:
    """A fold's preparation as numbers: what fills each feature, and the (centre, scale) that it is then scaled by."""
    fill: list[float | None]
    scaled: list[tuple[float, float]]


def fit_folds(rows: DataFrame, n: int, prepared: Sequence[Prepared], learners: Sequence[tuple[str, dict]]) -> list[list[tuple[list[float], float]]] | None:
    """For every fold the (weights, intercept) of each logistic regression, fitted on the prepared rows of the other folds,
    each counted once and once for every copy.

    ``rows`` (frozen) has features, label, ``_fold`` and ``_copies0 .. _copies<k - 1>``, not prepared: a prepared row is a
    linear function of the row and of marks of its missing values, so one pass gives the sums of all folds. None where the
    regressions aren't plain ones: no penalty, a part of one class, values that are infinite or stay missing."""
    k, x = len(prepared), md.inputs(n)
    if not 0 < n <= MOST_FEATURES:
        return None
    missing = [F.col(c).isNull() | F.isnan(c) for c in x]
    times = [(F.col("_fold") != f).cast("long") + F.col(f"_copies{f}") for f in range(k)]
    known = rows.agg(*[F.count_if(m).alias(f"n{c}") for c, m in zip(x, missing)], *[F.count_if(F.col(c).isin(float("inf"), float("-inf"))).alias(f"i{c}") for c in x],
                     *[f(F.when(~m, F.col(c))).alias(f"{name}{c}") for c, m in zip(x, missing) for name, f in (("m", F.avg), ("v", F.var_pop))],
                     *[F.sum(t).alias(f"size{f}") for f, t in enumerate(times)], *[F.sum(t * F.col(md.LABEL)).alias(f"ones{f}") for f, t in enumerate(times)],
                     F.count_if(~F.coalesce(F.col(md.LABEL).isin(0.0, 1.0), F.lit(False))).alias("odd")).first()
    if known["odd"] or any(known[f"i{c}"] for c in x) or any(known[f"m{c}"] is None for c in x):
        return None
    gaps = [i for i, c in enumerate(x) if known[f"n{c}"]]
    if any(p.fill[i] is None for p in prepared for i in gaps):
        return None
    size, ones = (np.array([float(known[f"{name}{f}"] or 0) for f in range(k)]) for name in ("size", "ones"))
    if not ((0 < ones) & (ones < size)).all():
        return None
    mean = np.array([known[f"m{c}"] for c in x], float)
    deviation = np.array([known[f"v{c}"] ** 0.5 or 1.0 for c in x], float)
    width = 1 + n + len(gaps)
    maps = np.zeros((k, n + 1, width))  # a prepared row from 1, its standardised values (0 where missing) and its marks
    for f, p in enumerate(prepared):
        maps[f, 0, 0] = 1.0
        for i, (centre, scale) in enumerate(p.scaled):
            maps[f, 1 + i, 0], maps[f, 1 + i, 1 + i] = (mean[i] - centre) / scale, deviation[i] / scale
            if i in gaps:
                maps[f, 1 + i, 1 + n + gaps.index(i)] = (p.fill[i] - mean[i]) / scale
    jobs = [(f, *_penalty(alg, params, n, int(size[f]))) for f in range(k) for alg, params in learners]
    if any(reg <= 0 for _, reg, _ in jobs):
        return None
    fold = np.array([j[0] for j in jobs])
    l2, l1 = (np.array([[0.0, *[v] * n] for v in values]) for values in ([reg * (1.0 - share) for _, reg, share in jobs], [reg * share for _, reg, share in jobs]))
    frame = rows.select(*x, F.col(md.LABEL).cast("double"), F.col("_fold").cast("long"), *[f"_copies{f}" for f in range(k)])
    a, b = np.triu_indices(n + 1)
    upper, lower = np.triu_indices(width)

    def sums_of(w: np.ndarray, live: np.ndarray) -> np.ndarray:
        seen = np.einsum("mi,mij->mj", w, maps[fold[live]])
        got = frame.mapInArrow(_counted_sums(n, gaps, mean, deviation, seen, fold[live]), "sums binary").collect()  # a few numbers per model and task
        sums = sum(np.frombuffer(r["sums"]).reshape(len(live), -1) for r in got)
        out = np.zeros((len(live), 2 + n + len(a)))
        out[:, 0] = sums[:, 0]
        for i, (m, row) in enumerate(zip(maps[fold[live]], sums)):
            h = np.zeros((width, width))
            h[upper, lower] = h[lower, upper] = row[1 + width:]
            out[i, 1:n + 2], out[i, n + 2:] = m @ row[1:1 + width], (m @ h @ m.T)[a, b]
        return out
    w = _optima(sums_of, n, size[fold], ones[fold], l2, l1)
    if w is None:
        return None
    found = [(v[1:].tolist(), float(v[0])) for v in w]
    return [found[f * len(learners):(f + 1) * len(learners)] for f in range(k)]


def _penalty(alg: str, params: dict, n: int, rows: int) -> tuple[float, float]:
    """A learner's penalty and the absolute part's share in it."""
    e = md.build_classifier(alg, params, n, rows)
    return e.getRegParam(), e.getElasticNetParam()


def _counted_sums(n: int, gaps: Sequence[int], mean: np.ndarray, deviation: np.ndarray, w: np.ndarray, fold: np.ndarray):
    """Per task: loss, gradient and upper half of the curvature of every model over its rows, as often as they count for its fold."""
    width = 1 + n + len(gaps)
    a, b = np.triu_indices(width)

    def run(batches):
        acc = np.zeros((len(w), 1 + width + len(a)))
        step = max(64, BLOCK_NUMBERS // max(1, len(w)))
        for batch in batches:
            x, y, f = _matrix(batch, n), batch.column(n).to_numpy(), batch.column(n + 1).to_numpy()
            times = np.stack([batch.column(n + 2 + i).to_numpy() for i in fold.tolist()], axis=1) + (f[:, None] != fold[None, :])
            gap = np.isnan(x)
            x = np.concatenate([np.ones((len(x), 1)), np.where(gap, 0.0, (x - mean) / deviation), gap[:, gaps]], axis=1)
            pairs = x[:, a] * x[:, b]
            for k in range(0, len(x), step):
                u, t, often = x[k:k + step], y[k:k + step, None], times[k:k + step]
                m = u @ w.T
                e = np.exp(-np.abs(m))
                p = np.where(m >= 0, 1.0, e) / (1.0 + e)
                acc[:, 0] += ((np.maximum(m, 0.0) + np.log1p(e) - t * m) * often).sum(0)
                acc[:, 1:1 + width] += ((p - t) * often).T @ u
                acc[:, 1 + width:] += (p * (1.0 - p) * often).T @ pairs[k:k + step]
        yield pa.RecordBatch.from_arrays([pa.array([acc.tobytes()], pa.binary())], names=["sums"])
    return run


def logistic(alg: str, params: dict) -> bool:
    """Whether a learner is a logistic regression that runs to its optimum."""
    return md.family(alg) in ("lr", "sgd_elastic", "sgd_l2") and "max_iter" not in params


def logistic_scores(rows: DataFrame, n: int, jobs: Sequence[tuple[int, str, dict]], k: int, scoring: str) -> list[tuple] | None:
    """(job, fold, split, value) of logistic regressions on every fold of ``rows`` (features, label and ``_fold``); None where
    they aren't plain ones: no penalty, a part of one class, missing values."""
    if not 0 < n <= MOST_FEATURES:
        return None
    known = summary(rows, n)
    parts = {f: known.training(f) for f in range(k)}
    if not known.finite or not {y for _, y in known.counts} <= {0.0, 1.0} or any(not 0 < ones < size for size, ones in parts.values()):
        return None
    wanted = []
    for job, alg, params in jobs:
        for f in range(k):
            reg, share = _penalty(alg, params, n, parts[f][0])
            if reg <= 0:
                return None
            wanted.append((job, (f, reg * (1.0 - share), reg * share)))
    fitted = fit_logistic(rows, n, known, [m for _, m in wanted])
    if fitted is None:
        return None
    found = _accuracies(rows, n, fitted) if scoring == "accuracy" else _aucs(rows, n, fitted, known.rows())
    return [(job, m.fold, split, v) for (job, _), m, values in zip(wanted, fitted, found) for split, v in values.items()]


def _margins(fitted: Sequence[Linear]) -> Callable[[np.ndarray], np.ndarray]:
    w, c = np.array([m.weights for m in fitted]).T, np.array([m.intercept for m in fitted])
    return lambda x: x @ w + c


def _accuracies(rows: DataFrame, n: int, fitted: Sequence[Linear]) -> list[dict[str, float]]:
    margins, fold = _margins(fitted), np.array([m.fold for m in fitted])

    def run(batches):
        acc = np.zeros((4, len(fold)), np.int64)  # right and all, of training and test rows
        step = max(64, BLOCK_NUMBERS // max(1, len(fold)))
        for batch in batches:
            x, y, f = _matrix(batch, n), batch.column(n).to_numpy(), batch.column(n + 1).to_numpy()
            for k in range(0, len(x), step):
                right, test = (margins(x[k:k + step]) > 0) == (y[k:k + step, None] == 1), f[k:k + step, None] == fold[None, :]
                acc += np.stack([(right & ~test).sum(0), (~test).sum(0), (right & test).sum(0), test.sum(0)])
        yield pa.RecordBatch.from_arrays([pa.array([acc.tobytes()], pa.binary())], names=["sums"])
    got = _frame(rows, n).mapInArrow(run, "sums binary").collect()  # four numbers per model and task
    a, b, c, d = sum(np.frombuffer(r["sums"], np.int64).reshape(4, -1) for r in got)
    return [{s: int(right[i]) / int(size[i]) for s, right, size in (("train", a, b), ("test", c, d)) if size[i]} for i in range(len(fitted))]


def _aucs(rows: DataFrame, n: int, fitted: Sequence[Linear], total: int) -> list[dict[str, float | None]]:
    frame, out = _frame(rows, n), []
    ranges = max(1, -(-total // RANGE_ROWS))
    sample = np.array([tuple(r) for r in sampled(frame.select(*md.inputs(n)), total, ranges).collect()], float).reshape(-1, n)  # SAMPLED_ROWS a range
    for at in range(0, len(fitted), RANKED_AT_ONCE):
        some = fitted[at:at + RANKED_AT_ONCE]
        margins, fold = _margins(some), [m.fold for m in some]

        def chances(x: np.ndarray, margins=margins) -> np.ndarray:
            with np.errstate(over="ignore"):
                return 1.0 / (1.0 + np.exp(-margins(x)))
        ranks = Ranks(bounds_of(chances(sample), ranges))

        def cut(table: pa.Table, chances=chances, fold=fold) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
            x, y, f = _matrix(table, n), table.column(n).to_numpy(), table.column(n + 1).to_numpy()
            scores, one = np.ascontiguousarray(chances(x).T), y == 1
            for i in range(len(scores)):
                test = f == fold[i]
                for split in (0, 1):
                    of = test if split else ~test
                    yield 2 * i + split, i, scores[i][of & one], scores[i][of & ~one]
        got = ranks.of(frame, cut)
        out += [{s: got[2 * i + k] for k, s in enumerate(("train", "test")) if 2 * i + k in got} for i in range(len(some))]
    return out


# ------------------------------------------------------------------- ranks
def sampled(rows: DataFrame, total: int, ranges: int) -> DataFrame:
    """Some rows to take bounds from: a parameter of the speed, not of the result."""
    if ranges <= 1:
        return rows.limit(0)
    return rows.sample(fraction=min(1.0, ranges * SAMPLED_ROWS / max(1, total)), seed=7)


def bounds_of(scores: np.ndarray, ranges: int) -> list[np.ndarray]:
    """Per column of ``scores``, increasing bounds that cut it into about ``ranges`` equal parts."""
    if not len(scores) or ranges <= 1:
        return [np.zeros(0)] * scores.shape[1]
    return [np.unique(np.sort(c)[np.arange(1, ranges) * len(c) // ranges]) for c in scores.T]


class Ranks:
    """Exact AUCs (Mann-Whitney, ties count half) of many groups of scores."""

    SCHEMA = pa.schema([("g", pa.int32()), ("r", pa.int32()), ("y", pa.int32()), ("scores", pa.binary()), ("counts", pa.binary())])

    def __init__(self, bounds: list[np.ndarray]):
        self.bounds = bounds

    def of(self, rows: DataFrame, cut: Callable[[pa.Table], Iterator[tuple[int, int, np.ndarray, np.ndarray]]]) -> dict[int, float | None]:
        """AUC by group (None where it has one class). ``cut`` gives (group, number of its bounds, scores of label 1, scores of label 0)
        of some rows; groups with no rows aren't in the result."""
        bounds, schema = self.bounds, self.SCHEMA

        def emit(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            columns: list[list] = [[], [], [], [], []]
            for g, i, ones, zeros in cut(pa.Table.from_batches(held)):
                for y, v in ((1, np.sort(ones)), (0, np.sort(zeros))):
                    edges = [0, *np.searchsorted(v, bounds[i]).tolist(), len(v)]
                    for r, (a, b) in enumerate(zip(edges, edges[1:])):
                        if a < b:
                            part, counts = v[a:b], b""
                            begins = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
                            if 2 * len(begins) <= b - a:  # many ties
                                part, counts = part[begins], np.diff(np.append(begins, b - a)).astype(np.int64).tobytes()
                            for c, x in zip(columns, (g, r, y, part.tobytes(), counts)):
                                c.append(x)
                if len(columns[0]) >= 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)
                    columns = [[], [], [], [], []]
            if columns[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)

        def run(batches):
            held, size = [], 0
            for batch in batches:
                if batch.num_rows:
                    held.append(batch)
                    size += batch.num_rows
                if size >= SORTED_ROWS:
                    yield from emit(held)
                    held, size = [], 0
            if held:
                yield from emit(held)

        parts = rows.mapInArrow(run, "g int, r int, y int, scores binary, counts binary").groupBy("g", "r").applyInPandas(
            _merge, "g int, r int, pos long, neg long, won double")
        found: dict[int, list] = {}
        for row in sorted(tuple(r) for r in parts.collect()):  # one row per group and range
            _, _, pos, neg, won = row
            p, q, w = found.get(row[0], (0, 0, 0.0))
            found[row[0]] = (p + pos, q + neg, w + won + pos * float(q))
        return {g: w / (float(p) * float(q)) if p and q else None for g, (p, q, w) in found.items()}


def _merge(pdf):
    """One range of one group: its labels and the pairs that its ones win within it."""
    import pandas as pd
    scores, counts = [], []
    for y, s, c in zip(pdf["y"], pdf["scores"], pdf["counts"]):
        v = np.frombuffer(s)
        n = np.frombuffer(c, np.int64) if len(c) else np.ones(len(v), np.int64)
        scores.append(v)
        counts.append(n if y else -n)
    v, n = np.concatenate(scores), np.concatenate(counts)
    order = np.argsort(v, kind="stable")
    v, n = v[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
    pos, neg = np.add.reduceat(np.maximum(n, 0), first), np.add.reduceat(np.maximum(-n, 0), first)
    won = (pos * (np.cumsum(neg) - neg + neg / 2.0)).sum()
    return pd.DataFrame([[pdf["g"].iloc[0], pdf["r"].iloc[0], int(pos.sum()), int(neg.sum()), float(won)]], columns=["g", "r", "pos", "neg", "won"])


def auc_of_groups(preds: DataFrame, group: Column, sample: DataFrame, total: int, y: str = "y", score: str = "score") -> dict[int, float | None]:
    """AUC by ``group`` (a whole number) of rows whose label and score aren't null or NaN; all groups' bounds are taken
    from the scores of ``sample``; a group has about ``total`` rows."""
    ranges = max(1, -(-total // RANGE_ROWS))
    got = np.array([[r[0]] for r in sampled(sample.select(F.col(score).cast("double")), total, ranges).collect() if r[0] is not None and r[0] == r[0]], float)
    ranks = Ranks(bounds_of(got.reshape(-1, 1), ranges))

    def cut(table: pa.Table) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        g, one, s = table.column(0).to_numpy(), table.column(1).to_numpy() == 1, table.column(2).to_numpy()
        for i in np.unique(g).tolist():
            own = g == i
            yield i, 0, s[own & one], s[own & ~one]
    return ranks.of(preds.select(group.cast("long").alias("g"), F.col(y).cast("long").alias("y"), F.col(score).cast("double").alias("s")), cut)


# ------------------------------------------------------------------- trees
@dataclass
class Tree:
    """A fitted decision tree by node: children (a leaf's are itself), split, label counts, prediction and depth."""
    left: np.ndarray
    right: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    counts: np.ndarray
    prediction: np.ndarray
    depth: np.ndarray

    @classmethod
    def of(cls, spark: SparkSession, model) -> Tree:
        """From what MLlib saves of its model."""
        path = frozen_path(spark, "tree")
        model.write().overwrite().save(path)
        rows = sorted(spark.read.parquet(f"{path}/data").collect(), key=lambda r: r["id"])  # a tree's nodes
        drop(spark, [path])
        n = len(rows)
        own = np.arange(n)
        left, right = (np.array([r[c] if r["leftChild"] >= 0 else i for i, r in enumerate(rows)]) for c in ("leftChild", "rightChild"))
        inner = left != own
        feature = np.array([max(0, r["split"]["featureIndex"]) for r in rows])
        threshold = np.array([r["split"]["leftCategoriesOrThreshold"][0] if i else np.inf for i, r in zip(inner.tolist(), rows)])
        depth = np.zeros(n, np.int64)
        for i in own[inner]:  # parents come before their children
            depth[[left[i], right[i]]] = depth[i] + 1
        return cls(left, right, feature, threshold, np.array([r["impurityStats"] for r in rows], float), np.array([r["prediction"] for r in rows]), depth)

    @classmethod
    def grown(cls, nodes: dict[int, tuple]) -> Tree:
        """From what ``forest.grow`` made; the thresholds are numbers of bins."""
        keys = sorted(nodes)  # parents come before their children
        at = {k: i for i, k in enumerate(keys)}
        v = np.array([nodes[k] for k in keys], float)
        inner = v[:, 0] >= 0
        left, right = (np.array([at[2 * k + side] if i else at[k] for k, i in zip(keys, inner.tolist())]) for side in (1, 2))
        depth = np.array([(k + 1).bit_length() - 1 for k in keys])
        return cls(left, right, np.maximum(v[:, 0], 0).astype(np.int64), np.where(inner, v[:, 1], np.inf), v[:, 3:5], (v[:, 4] > v[:, 3]).astype(float), depth)

    def leaf(self, x: np.ndarray) -> np.ndarray:
        at, row = np.zeros(len(x), np.int64), np.arange(len(x))
        for _ in range(int(self.depth.max())):
            at = np.where(x[row, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return at

    def cut(self, depth: int) -> np.ndarray:
        """For every node the leaf that stands for it in the tree of this depth."""
        n = len(self.left)
        ends = (self.left == np.arange(n)) | (self.depth >= depth)
        for i in range(n - 1, -1, -1):  # children come before their parents
            a, b = self.left[i], self.right[i]
            if not ends[i] and ends[a] and ends[b] and self.prediction[a] == self.prediction[b]:
                ends[i] = True
        stands = np.arange(n)
        for i in range(n):
            if self.left[i] != i:
                for c in (self.left[i], self.right[i]):
                    stands[c] = stands[i] if ends[stands[i]] else c
        return stands


def _counted_trees(rows: DataFrame, n: int, asked: Sequence[tuple], k: int) -> tuple[list[Tree | None], list[np.ndarray | None]]:
    """The trees (and the label counts in their leaves, four a node) that can be grown from counted cells."""
    trees: list[Tree | None] = [None] * len(asked)
    cells: list[np.ndarray | None] = [None] * len(asked)
    for bins in sorted({int(a[1].get("max_bins", 32)) for a in asked}):
        own = [i for i, (_, params, members, _) in enumerate(asked) if int(params.get("max_bins", 32)) == bins and max(d for _, d in members) <= fo.DEEPEST]
        folds = fo.count_folds(rows, md.inputs(n), md.LABEL, md.ID, "_fold", k, bins) if own else None
        if folds is None:
            continue
        settings = [(asked[i][3], fo.Settings(max_depth=max(d for _, d in asked[i][2]), min_samples_leaf=int(asked[i][1].get("min_samples_leaf", 1)),
                                              max_features="all", max_bins=bins)) for i in own]
        for i, nodes in zip(own, fo.grow_each(rows.sparkSession, folds, settings)):
            part, t = folds[asked[i][3]], Tree.grown(nodes)
            at = 4 * t.leaf(part.train.bins.T) + part.train.label
            trees[i] = t
            cells[i] = sum(np.bincount(at + 2 * s, c, 4 * len(t.left)).astype(np.int64) for s, c in enumerate((part.train.count, part.test)))
    return trees, cells


def _fitted_trees(rows: DataFrame, n: int, asked: Sequence[tuple]) -> tuple[list[Tree], list[np.ndarray]]:
    """As ``_counted_trees``, each fitted by MLlib; one pass counts the labels in all leaves."""
    def fit(alg: str, params: dict, members: list, f: int) -> Tree:
        part = rows.where(F.col("_fold") != f).drop("_fold")
        learner = md.learner_class(alg).fit(part, n, alg, {**params, "max_depth": max(d for _, d in members)})
        return Tree.of(rows.sparkSession, learner.model.stages[-1])
    trees: list[Tree] = run_bounded([lambda a=a: fit(*a) for a in asked])
    fold = [a[-1] for a in asked]

    def run(batches):
        acc = [np.zeros(4 * len(t.left), np.int64) for t in trees]
        for batch in batches:
            x, y, f = _matrix(batch, n), batch.column(n).to_numpy(), batch.column(n + 1).to_numpy()
            for i, t in enumerate(trees):
                acc[i] += np.bincount(4 * t.leaf(x) + 2 * (f == fold[i]) + (y == 1), minlength=len(acc[i]))
        for i, c in enumerate(acc):
            cell = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cell), i)), pa.array(cell), pa.array(c[cell])], names=["tree", "cell", "n"])
    counted = _frame(rows, n).mapInArrow(run, "tree long, cell long, n long").groupBy("tree", "cell").agg(F.sum("n").alias("n"))
    cells = [np.zeros(4 * len(t.left), np.int64) for t in trees]
    for r in counted.collect():  # four cells a leaf
        cells[r["tree"]][r["cell"]] = r["n"]
    return trees, cells


def tree_scores(rows: DataFrame, n: int, jobs: Sequence[tuple[int, str, dict]], k: int, scoring: str) -> list[tuple]:
    """(job, fold, split, value) of decision trees on every fold of ``rows`` (features, ``_id``, label and ``_fold``)."""
    groups: dict[tuple, list[tuple[int, int]]] = {}
    for job, alg, params in jobs:
        rest = tuple(sorted((p, v) for p, v in params.items() if p != "max_depth"))
        groups.setdefault((alg, rest), []).append((job, int(params.get("max_depth", 5))))
    asked = [(alg, dict(rest), members, f) for (alg, rest), members in groups.items() for f in range(k)]
    trees, cells = _counted_trees(rows, n, asked, k)
    left = [i for i, t in enumerate(trees) if t is None]
    if left:
        for i, t, c in zip(left, *_fitted_trees(rows, n, [asked[i] for i in left])):
            trees[i], cells[i] = t, c
    out = []
    for (_, _, members, f), t, c in zip(asked, trees, cells):
        by = c.reshape(-1, 2, 2)  # leaf, training or test, label
        chance = t.counts[:, 1] / t.counts.sum(1)
        for job, depth in members:
            stands = t.cut(depth)
            for s, split in enumerate(("train", "test")):
                neg, pos = (np.bincount(stands, by[:, s, y], minlength=len(stands)) for y in (0, 1))
                if not (pos.sum() + neg.sum()):
                    continue
                if scoring == "accuracy":
                    says = t.counts[:, 1] > t.counts[:, 0]
                    value = (pos[says].sum() + neg[~says].sum()) / (pos.sum() + neg.sum())
                else:
                    value = _auc(chance, pos, neg)
                out.append((job, f, split, None if value is None else float(value)))
    return out


def _auc(score: np.ndarray, pos: np.ndarray, neg: np.ndarray) -> float | None:
    values, at = np.unique(score, return_inverse=True)
    p, q = np.bincount(at, pos, minlength=len(values)), np.bincount(at, neg, minlength=len(values))
    return float((p * (np.cumsum(q) - q + q / 2.0)).sum() / (p.sum() * q.sum())) if p.sum() and q.sum() else None

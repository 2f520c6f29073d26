"""Encoders, imputers, scalers: fit on one table, apply to any.

A fit is one aggregate job whose result is a handful of scalars per column
(kept on the driver like an MLlib Model's parameters); apply is a pure column
expression, so train and test get the identical mapping and the apply stays in
whole-stage codegen. Exact quantiles (median, IQR) are bracketed by a rank sketch;
only values inside the brackets are ranked. ``percentile`` would hold every
distinct value of a column in one aggregation buffer.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import free_names, named, unpivot
from ..functions.stats import norm_ppf_vec
from .clean import agg_chunked
from .ordered import freeze, lookup, prefix_sum

# ------------------------------------------------------------- exact quantile
#: the rank sketch is off by at most n / accuracy ranks; so many times the quantiles asked for, at least
SKETCH_ACCURACY, ACCURACY_PER_QUANTILE = 10_000, 50
#: columns sketched in one scan: each task holds a sketch per column
SKETCHED_COLUMNS = 32


def _values(c: str):
    x = named(c).cast("double")
    return F.when(~F.isnan(x), x)


def brackets(df: DataFrame, cols: Sequence[str], probs: Sequence[float], k: int = 0) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Per column with values, disjoint increasing intervals that hold every value whose rank a quantile needs; with ``k``,
    also those that a quantile of the rows outside one of k random folds needs (but for one in a billion).

    A mergeable rank sketch per task (``percentile_approx``: Greenwald-Khanna) brackets each rank from both
    sides by more than its error.
    """
    accuracy = max(SKETCH_ACCURACY, ACCURACY_PER_QUANTILE * len(probs))
    margin, out = 2.0 / accuracy, {}
    if k > 1:  # six standard deviations of the share of values below a point
        least = min(_numbers(df, [F.count(_values(c)) for c in cols]), default=0)
        margin += 3.0 / math.sqrt(max(1, least) * (k - 1))
    for at in range(0, len(cols), SKETCHED_COLUMNS):
        part = cols[at:at + SKETCHED_COLUMNS]
        sizes = df.select(*[F.count(_values(c)).alias(f"n{i}") for i, c in enumerate(part)],
                          *[F.percentile_approx(_values(c), [min(1.0, max(0.0, p + side * margin)) for p in probs for side in (-1, 1)],
                                                accuracy).alias(f"q{i}") for i, c in enumerate(part)]).first()
        for i, c in enumerate(part):
            n = sizes[f"n{i}"]
            if not n:
                continue
            lo, hi = np.array(sizes[f"q{i}"], float).reshape(-1, 2).T
            edge = margin + 2.0 / n  # both ranks around (n - 1) p lie within p +- 1 / n
            lo = np.where(np.array(probs) - edge <= 0, -np.inf, lo)
            hi = np.where(np.array(probs) + edge >= 1, np.inf, hi)
            if n <= accuracy:  # few values: the sketch's steps may be as wide as a rank
                lo, hi = np.array([-np.inf]), np.array([np.inf])
            starts, ends = [], []
            for a, z in sorted(zip(lo, hi)):
                if ends and a <= ends[-1]:
                    ends[-1] = max(ends[-1], z)
                else:
                    starts.append(a)
                    ends.append(z)
            out[c] = np.array(starts), np.array(ends)
    return out


def _value_ranks(df: DataFrame, cols: Sequence[str], inside: dict[str, tuple[np.ndarray, np.ndarray]], fold: str | None = None, k: int = 1) -> DataFrame:
    """(column, value, cnt, cum_cnt, tot_cnt): the count of every distinct value inside a bracket and the ranks it
    holds. Values between brackets are only counted, one number per bracket and task. With ``fold`` a column <fold>_<number> stands for
    the column's values outside that one of ``k`` folds; the rows are read and counted once, by their own fold."""
    cols = [c for c in cols if c in inside]
    bounds = [inside[c] for c in cols]

    def count(batches):
        between = [np.zeros((k, len(s) + 1), np.int64) for s, _ in bounds]
        schema = pa.schema([("column", pa.int32()), ("fold", pa.int32()), ("part", pa.int32()), ("value", pa.float64()), ("cnt", pa.int64())])
        for batch in batches:
            every = batch.column(len(bounds)).to_numpy()
            for i, (starts, ends) in enumerate(bounds):
                x = batch.column(i).to_numpy(zero_copy_only=False)
                own, x = every[~np.isnan(x)], x[~np.isnan(x)]
                at = np.searchsorted(starts, x, "right")
                held = (at > 0) & (x <= ends[np.maximum(at - 1, 0)])
                between[i] += np.bincount(own[~held] * (len(starts) + 1) + at[~held], minlength=between[i].size).reshape(between[i].shape)
                values, place = np.unique(x[held] + 0.0, return_inverse=True)  # -0.0 is 0.0
                cnt = np.bincount(place * k + own[held], minlength=len(values) * k)
                at = np.flatnonzero(cnt)
                value = values[at // k]
                part = 2 * np.searchsorted(starts, value, "right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), i, np.int32)), pa.array((at % k).astype(np.int32)), pa.array(part.astype(np.int32)),
                                                  pa.array(value), pa.array(cnt[at].astype(np.int64))], schema=schema)
        for i, n in enumerate(between):
            own, part = np.nonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), i, np.int32)), pa.array(own.astype(np.int32)), pa.array((2 * part).astype(np.int32)),
                                              pa.nulls(len(part), pa.float64()), pa.array(n[own, part])], schema=schema)

    if not cols:
        return df.sparkSession.createDataFrame([], "column string, value double, cnt long, cum_cnt long, tot_cnt long")
    found = df.select(*[_values(c).alias(f"x{i}") for i, c in enumerate(cols)], (named(fold) if fold else F.lit(0)).cast("long").alias("f")).mapInArrow(
        count, "column int, fold int, part int, value double, cnt long")
    counts = found.groupBy("column", "fold", "part", "value").agg(F.sum("cnt").alias("cnt"))
    names = list(cols)
    if fold:  # a value counts for every fold that its row isn't in
        names = [f"{f}_{i}" for f in range(k) for i in range(len(cols))]
        left = counts.withColumn("left", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).where("left <> fold")
        counts = left.groupBy((F.col("left") * len(cols) + F.col("column")).alias("column"), "part", "value").agg(F.sum("cnt").alias("cnt"))
    else:
        counts = counts.drop("fold")
    ranked = prefix_sum(counts, ["column"], ["part", "value"], ["cnt"], prefix="cum_", totals_prefix="tot_")
    named_column = F.element_at(F.array(*[F.lit(c) for c in names]), F.col("column") + 1)
    return ranked.where("value is not null").select(named_column.alias("column"), "value", "cnt", "cum_cnt", "tot_cnt")


def _exactly(df: DataFrame, cols: Sequence[str], probs: Sequence[float], pick) -> list:
    """The rows of ``pick(ranks)``. A column of which a bracket missed a rank (none should) is ranked whole."""
    inside = brackets(df, cols, probs)
    rows = pick(_value_ranks(df, cols, inside)).collect()  # the quantiles asked for, of each column
    seen = {}
    for r in rows:
        seen[r["column"]] = seen.get(r["column"], 0) + (r["value"] is not None)
    missed = [c for c in inside if seen.get(c, 0) < len(probs)]
    if missed:
        whole = {c: (np.array([-np.inf]), np.array([np.inf])) for c in missed}
        rows = [r for r in rows if r["column"] not in whole] + pick(_value_ranks(df, missed, whole)).collect()
    return rows


def _linear(probs: Sequence[float]):
    """Ranked values -> (column, prob, value) of the linear-interpolation quantiles."""
    def pick(run: DataFrame) -> DataFrame:
        run = run.withColumn("prob", F.explode(F.array(*[F.lit(p) for p in probs])))
        h = (F.col("tot_cnt") - 1).cast("double") * F.col("prob")
        lo = F.floor(h)
        start = F.col("cum_cnt") - F.col("cnt")
        holds = lambda r: (start <= r) & (r < F.col("cum_cnt"))
        hit = run.where(holds(lo) | holds(lo + 1)).select(
            "column", "prob", "value", (h - lo).alias("frac"), (lo + 1 < F.col("tot_cnt")).alias("more"),
            holds(lo).alias("is_lo"), holds(lo + 1).alias("is_hi"))
        agg = hit.groupBy("column", "prob").agg(
            F.max(F.when(F.col("is_lo"), F.col("value"))).alias("v_lo"),
            F.max(F.when(F.col("is_hi"), F.col("value"))).alias("v_hi"),
            F.first("frac").alias("frac"), F.first("more").alias("more"))
        return agg.select("column", "prob", _between(F.col("v_lo"), F.col("v_hi"), F.col("frac"), F.col("more")).alias("value"))
    return pick


def fold_medians(df: DataFrame, cols: Sequence[str], fold: str, k: int) -> list[dict[str, float | None]]:
    """For every fold the exact median of each column outside it, null and NaN ignored (None without values). All folds share one sketch
    and one scan; a median that the brackets missed is found in its own rows."""
    inside = brackets(df, cols, [0.5], k)
    known = [c for c in cols if c in inside]
    got = {r["column"]: r["value"] for r in _linear([0.5])(_value_ranks(df, known, inside, fold, k)).collect()}  # a number per fold and column
    out = []
    for f in range(k):
        own = {c: got.get(f"{f}_{i}") for i, c in enumerate(known)}
        missed = [c for c, v in own.items() if v is None]
        if missed:
            own |= {c: None for c in missed} | {c: v for (c, _), v in _quantile_dict(df.where(named(fold) != f), missed, [0.5]).items()}
        out.append({c: own.get(c) for c in cols})
    return out


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """Linear-interpolation quantiles (numpy/``quantile_cont`` definition) of each
    column, NULL/NaN ignored: (column, prob, value).

    A rank sketch brackets each quantile; a second scan counts what lies below and ranks only the values
    inside the brackets, so a few in ten thousand rows are shuffled, whatever the column holds.
    """
    cols, probs = list(cols), [float(p) for p in probs]

    rows = [(r["column"], r["prob"], r["value"]) for r in _exactly(df, cols, probs, _linear(probs))]
    return df.sparkSession.createDataFrame(rows, "column string, prob double, value double")


def _between(lo, hi, frac, more):
    """``frac`` of the way from one value to the next; the last value has none (NULL where one is missing)."""
    return F.when((frac == 0) | ~more, lo).when(lo == hi, lo).otherwise(lo + (hi - lo) * frac)


def even_quantiles(df: DataFrame, cols: Sequence[str], k: int) -> DataFrame:
    """The k evenly spaced quantiles of each column, exact: (column, i, value), i = 0..k-1.

    One sketch, one scan and one running count for all columns; a value is copied only for the quantiles
    whose ranks it holds, so k rows per column come out, whatever the number of rows.
    """
    cols = list(cols)

    def pick(run: DataFrame) -> DataFrame:
        run = run.withColumn("_start", F.expr("cum_cnt - cnt"))
        # rank of quantile i: (n - 1) * i / (k - 1), in whole numbers; it lies in [lo, lo + 1]
        n1 = "greatest(tot_cnt - 1, 1)"

        def first(rank: str) -> str:  # least i whose rank is at least this
            return f"greatest((({rank}) * {k - 1} + {n1} - 1) div {n1}, 0)"
        run = run.withColumn("_a", F.expr(first("_start - 1"))).withColumn("_b", F.expr(
            f"if(tot_cnt = 1 or cum_cnt = tot_cnt, {k - 1}, least({first('cum_cnt')} - 1, {k - 1}))"))
        hit = run.where("_a <= _b").withColumn("i", F.explode(F.sequence(F.col("_a"), F.col("_b"))))
        lo = F.expr(f"((tot_cnt - 1) * i) div {k - 1}")
        frac = F.expr(f"((tot_cnt - 1) * i) % {k - 1}") / float(k - 1)
        holds = lambda r: (F.col("_start") <= r) & (r < F.col("cum_cnt"))
        agg = hit.groupBy("column", "i").agg(
            F.max(F.when(holds(lo), F.col("value"))).alias("v_lo"), F.max(F.when(holds(lo + 1), F.col("value"))).alias("v_hi"),
            F.max(frac).alias("frac"), F.max(lo + 1 < F.col("tot_cnt")).alias("more"))
        return agg.select("column", F.col("i").cast("int").alias("i"), _between(F.col("v_lo"), F.col("v_hi"), F.col("frac"), F.col("more")).alias("value"))

    rows = [(r["column"], r["i"], r["value"]) for r in _exactly(df, cols, [i / (k - 1) for i in range(k)], pick)]
    return df.sparkSession.createDataFrame(rows, "column string, i int, value double")


def _quantile_dict(df: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> dict[tuple[str, float], float]:
    return {(r["column"], r["prob"]): r["value"] for r in exact_quantiles(df, cols, probs).collect()}


def _finite(c: str):
    x = named(c).cast("double")
    return F.when(F.isnan(x) | x.isin(float("inf"), float("-inf")), F.lit(None).cast("double")).otherwise(x)


# --------------------------------------------------------------------- impute
def most_frequent(df: DataFrame, cols: Sequence[str]) -> dict:
    """Mode of every column (smallest value among ties), all columns in one
    stacked (column, value) count: {column: mode}."""
    def family(c: str) -> str:  # whole numbers stay whole, decimals exact
        kind = df.schema[c].dataType
        return ("bigint" if isinstance(kind, T.IntegralType) else kind.simpleString() if isinstance(kind, T.DecimalType)
                else "double" if isinstance(kind, T.FractionalType) else "string")
    out = {}
    for kind in sorted({family(c) for c in cols}):
        long = unpivot(df, [c for c in cols if family(c) == kind], kind).where(F.col("value").isNotNull())
        vc = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("cnt"))
        for r in vc.groupBy("column").agg(F.min_by("value", F.struct(-F.col("cnt"), F.col("value"))).alias("m")).collect():
            out[r["column"]] = r["m"]
    return {c: out.get(c) for c in cols}


@dataclass
class Imputer:
    strategy: str = "mean"
    fill_value: float | str = 0
    values: dict = field(default_factory=dict)

    def fit(self, df: DataFrame, cols: Sequence[str]) -> "Imputer":
        cols = list(cols)
        if self.strategy == "mean":
            row = _numbers(df, [F.avg(_finite(c)) for c in cols])
            self.values = dict(zip(cols, row, strict=True))
        elif self.strategy == "median":
            q = _quantile_dict(df, cols, [0.5])
            self.values = {c: q.get((c, 0.5)) for c in cols}
        elif self.strategy == "most_frequent":
            self.values = most_frequent(df, cols)
        elif self.strategy == "constant":
            self.values = {c: self.fill_value for c in cols}
        else:
            raise ValueError(f"unknown strategy {self.strategy}")
        return self

    def column(self, df: DataFrame, c: str):
        """Column ``c`` of ``df`` with its missing values filled."""
        x = named(c)
        if self.values.get(c) is None:
            return x
        if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)):
            x = F.when(F.isnan(x), F.lit(None)).otherwise(x)
        return F.coalesce(x, F.lit(self.values[c]))

    def transform(self, df: DataFrame) -> DataFrame:
        return df.select(*[self.column(df, c).alias(c) for c in df.columns])

    @staticmethod
    def fit_folds(strategy: str, df: DataFrame, cols: Sequence[str], fold: str, k: int) -> list["Imputer"]:
        """For every fold the imputer of all other folds' rows; the rows are read as for one."""
        if strategy == "median":
            return [Imputer(strategy, values=v) for v in fold_medians(df, cols, fold, k)]
        whole = Imputer(strategy).fit(*without_folds(df, cols, fold, k, lambda f, c: named(c)))
        return [Imputer(strategy, values={c: whole.values[f"{f}_{i}"] for i, c in enumerate(cols)}) for f in range(k)]


def without_folds(df: DataFrame, cols: Sequence[str], fold: str, k: int, column) -> tuple[DataFrame, list[str]]:
    """Columns ``<fold>_<number>``: ``column(fold, name)`` in the rows of the other folds, null in the fold's own."""
    made = {f"{f}_{i}": F.when(named(fold) != f, column(f, c)) for f in range(k) for i, c in enumerate(cols)}
    return df.select(*[x.alias(n) for n, x in made.items()]), list(made)


# --------------------------------------------------------------------- scaling
SCALERS = ("StandardScaler", "MinMaxScaler", "RobustScaler", "MaxAbsScaler")


@dataclass
class Scaler:
    method: str = "MinMaxScaler"
    params: dict = field(default_factory=dict)

    def fit(self, df: DataFrame, cols: Sequence[str]) -> "Scaler":
        cols = list(cols)
        m = self.method
        if m == "StandardScaler":
            row = _numbers(df, [f(_finite(c)) for c in cols for f in (F.avg, F.stddev_pop)])
            self.params = {c: (m, _nz(s)) for c, m, s in zip(cols, row[::2], row[1::2], strict=True)}
        elif m == "MinMaxScaler":
            row = _numbers(df, [f(_finite(c)) for c in cols for f in (F.min, F.max)])
            self.params = {c: (lo, _nz(None if hi is None else hi - lo)) for c, lo, hi in zip(cols, row[::2], row[1::2], strict=True)}
        elif m == "RobustScaler":
            q = _quantile_dict(df, cols, [0.25, 0.5, 0.75])
            self.params = {c: (q.get((c, 0.5)), _nz(None if q.get((c, 0.75)) is None
                                                     else q[(c, 0.75)] - q[(c, 0.25)])) for c in cols}
        elif m == "MaxAbsScaler":
            row = _numbers(df, [F.max(F.abs(_finite(c))) for c in cols])
            self.params = {c: (0.0, _nz(v)) for c, v in zip(cols, row, strict=True)}
        else:
            raise ValueError(f"unknown scaler {m}")
        return self

    @staticmethod
    def fit_folds(method: str, df: DataFrame, cols: Sequence[str], fold: str, k: int, imputers: Sequence[Imputer | None]) -> list["Scaler"]:
        """For every fold the scaler of all other folds' rows, as its imputer leaves them."""
        whole = Scaler(method).fit(*without_folds(df, cols, fold, k, lambda f, c: imputers[f].column(df, c) if imputers[f] else named(c)))
        return [Scaler(method, params={c: whole.params[f"{f}_{i}"] for i, c in enumerate(cols)}) for f in range(k)]

    def transform(self, df: DataFrame) -> DataFrame:
        out = []
        for c in df.columns:
            if c in self.params and self.params[c][0] is not None:
                center, scale = self.params[c]
                out.append(((named(c).cast("double") - F.lit(float(center))) / F.lit(float(scale))).alias(c))
            else:
                out.append(named(c))
        return df.select(*out)


def _numbers(df: DataFrame, aggs: Sequence) -> list:
    """The values of aggregates, in their order: a fitted model's numbers."""
    row = agg_chunked(df, [a.alias(f"_{i}") for i, a in enumerate(aggs)])
    return [row[f"_{i}"] for i in range(len(aggs))]


def _nz(v):
    """Zero (or missing) spread -> 1, as the scikit-learn scalers do."""
    if v is None:
        return 1.0
    return 1.0 if v == 0 else float(v)


def normalize_rows(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Scale each row of ``cols`` to unit L2 norm; an all-zero row is unchanged."""
    cols = list(cols)
    norm = F.sqrt(sum(F.coalesce(named(c).cast("double"), F.lit(0.0)) ** 2 for c in cols))
    safe = F.when(norm == 0, F.lit(1.0)).otherwise(norm)
    return df.select(*[(named(c).cast("double") / safe).alias(c) if c in set(cols) else named(c) for c in df.columns])


# ------------------------------------------------------------------- one hot
def category_name(column: str, value: str | None) -> str:
    """Name of a category's column. NULL is ``column_nan``; the text "nan" is quoted to differ from it."""
    return f"{column}_nan" if value is None else f"{column}_'{value}'" if value.strip("'") == "nan" else f"{column}_{value}"


@dataclass
class OneHot:
    categories: dict = field(default_factory=dict)

    def fit(self, df: DataFrame, cols: Sequence[str]) -> "OneHot":
        """Sorted distinct values per column (NULL is its own, last, category), without a limit on
        their number. The category list is the model; ``transform`` makes a column of each category,
        ``to_vector`` one sparse vector per row, the form for columns of many categories."""
        cols = list(cols)
        found = unpivot(df, cols, "string").distinct().groupBy("column").agg(
            F.array_sort(F.collect_list("value")).alias("values"), F.max(F.col("value").isNull()).alias("has_null")).collect()
        by = {r["column"]: [*r["values"], *([None] if r["has_null"] else [])] for r in found}  # the model: its categories
        self.categories = {c: by.get(c, []) for c in cols}
        return self

    def names(self) -> list[str]:
        return [category_name(c, v) for c, vs in self.categories.items() for v in vs]

    def transform(self, df: DataFrame, drop_original: bool = True) -> DataFrame:
        enc = []
        for c, vs in self.categories.items():
            x = named(c).cast("string")
            for v in vs:
                hit = x.isNull() if v is None else (x == F.lit(v))
                enc.append(F.coalesce(hit, F.lit(False)).cast("double").alias(category_name(c, v)))
        keep = [named(c) for c in df.columns if not (drop_original and c in self.categories)]
        return df.select(*keep, *enc)

    def to_vector(self, df: DataFrame, out: str = "onehot") -> DataFrame:
        """Add one sparse vector over all categories, in ``names()`` order (unseen values: no entry)."""
        rows = [(c, v, k) for c, vs in self.categories.items() for k, v in enumerate(vs)]
        table = df.sparkSession.createDataFrame(rows, "column string, value string, id long")  # the model's own list
        return CategoryTable(list(self.categories), table.withColumn("cnt", F.lit(1).cast("long"))).to_vector(df, out)


@dataclass
class CategoryTable:
    """One-hot coding of columns of any number of categories: the dictionary is a table (column, value, id,
    cnt), numbered and looked up on the executors; rows get sparse vectors."""
    columns: list
    table: DataFrame

    @classmethod
    def fit(cls, df: DataFrame, cols: Sequence[str]) -> "CategoryTable":
        """Ids from 0 in each column by value, NULL (its own category) last."""
        cols = list(cols)
        counts = unpivot(df, cols, "string").groupBy("column", "value").agg(F.count(F.lit(1)).alias("cnt"))
        ranked = prefix_sum(counts.withColumns({"_null": F.col("value").isNull(), "_one": F.lit(1).cast("long")}),
                            ["column"], ["_null", "value"], ["_one"], prefix="at")
        return cls(cols, freeze(ranked.select("column", "value", (F.col("at_one") - 1).alias("id"), "cnt"), "categories"))

    def sizes(self) -> dict[str, int]:
        found = {r["column"]: r["n"] for r in self.table.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a column
        return {c: found.get(c, 0) for c in self.columns}

    def to_ids(self, df: DataFrame, prefix: str) -> DataFrame:
        """Add ``{prefix}{k}``, the id of the k-th column's value; NULL where it was not seen."""
        out = df
        for k, c in enumerate(self.columns):
            value, = free_names(out.columns, ["value"])
            side = freeze(self.table.where(F.col("column") == c).select(F.col("value").alias(value), F.col("id").alias(f"{prefix}{k}"), "cnt"), "column")
            out = lookup(out.withColumn(value, named(c).cast("string")), side, [value], "cnt").drop(value)
        return out

    def to_vector(self, df: DataFrame, out: str = "onehot") -> DataFrame:
        """Add one sparse vector over all categories, columns one after another (unseen values: no entry)."""
        from pyspark.ml.feature import OneHotEncoder, VectorAssembler
        sizes = self.sizes()
        prefix, part = free_names(df.columns, ["category", "onehot"])
        ids = self.to_ids(df, prefix)
        used = [k for k, c in enumerate(self.columns) if sizes[c]]
        # an id as large as the column is one more, invalid, category: no entry
        ids = ids.select(*[named(c) for c in df.columns if c != out], *[
            F.coalesce(F.col(f"{prefix}{k}"), F.lit(sizes[self.columns[k]])).cast("double").alias(f"{prefix}{k}") for k in used])
        largest = df.sparkSession.createDataFrame([tuple(float(sizes[self.columns[k]] - 1) for k in used)], [f"{prefix}{k}" for k in used])
        encoder = OneHotEncoder(inputCols=[f"{prefix}{k}" for k in used], outputCols=[f"{part}{k}" for k in used],
                                handleInvalid="keep", dropLast=True).fit(largest)
        joined = VectorAssembler(inputCols=[f"{part}{k}" for k in used], outputCol=out).transform(encoder.transform(ids))
        return joined.select(*[named(c) for c in df.columns if c != out], out)


# --------------------------------------------------------- quantile transform
BOUNDS_THRESHOLD = 1e-7


@dataclass
class QuantileNormal:
    """Map each numeric column through its empirical CDF to a standard normal.

    Fit: ``n_quantiles`` evenly spaced exact quantiles per column (running counts, one
    scan). Apply: Arrow pandas UDF doing the two-sided ``np.interp`` onto [0, 1] and the
    inverse normal, clipped like the reference.
    """
    n_quantiles: int = 1000
    quantiles: dict = field(default_factory=dict)

    def fit(self, df: DataFrame, cols: Sequence[str]) -> "QuantileNormal":
        cols = list(cols)
        n = df.count()
        k = max(2, min(self.n_quantiles, n))
        self.references = [i / (k - 1) for i in range(k)]
        clean = df.select(*[_finite(c).alias(c) for c in cols])
        got: dict[str, list] = {}
        for r in even_quantiles(clean, cols, k).orderBy("column", "i").collect():  # the model: k numbers a column
            got.setdefault(r["column"], []).append(float(r["value"]))
        self.quantiles = {c: got.get(c) for c in cols}
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        refs = np.asarray(self.references, dtype=float)
        lo_clip = norm_ppf_vec(np.array([BOUNDS_THRESHOLD - np.spacing(1)]))[0]
        hi_clip = norm_ppf_vec(np.array([1 - (BOUNDS_THRESHOLD - np.spacing(1))]))[0]
        out = []
        for c in df.columns:
            q = self.quantiles.get(c)
            if q is None:
                out.append(named(c))
                continue
            qa = np.asarray(q, dtype=float)

            qt = _qt_udf(qa, refs, lo_clip, hi_clip)
            out.append(qt(named(c).cast("double")).alias(c))
        return df.select(*out)


def _qt_udf(qa: np.ndarray, refs: np.ndarray, lo_clip: float, hi_clip: float):
    """Arrow-batched transform of one column through its fitted quantiles."""
    @F.pandas_udf(T.DoubleType())
    def qt(s: pd.Series) -> pd.Series:
        x = s.to_numpy(dtype=float, na_value=np.nan)
        u = 0.5 * (np.interp(x, qa, refs) - np.interp(-x, -qa[::-1], -refs[::-1]))
        u = np.where(x + BOUNDS_THRESHOLD > qa[-1], 1.0, u)
        u = np.where(x - BOUNDS_THRESHOLD < qa[0], 0.0, u)
        z = norm_ppf_vec(np.clip(u, 0.0, 1.0))
        z = np.clip(z, lo_clip, hi_clip)
        z[np.isnan(x)] = np.nan
        return pd.Series(z)
    return qt

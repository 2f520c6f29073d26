"""Column roles, kinds, column-set and row filters.

Column decisions (which columns to drop) are made by one aggregate over the
data; the pruning itself is a lazy ``select``. Each decision function returns a
small report DataFrame (column -> statistic -> decision) so the same decision
can be applied to the train and the test table.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import aggregate_rows, named, quoted, unpivot
from ..functions.scalar import normalize_missing_tokens

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def is_numeric(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, NUMERIC)


# ---------------------------------------------------------------------- roles
def role_table(spark: SparkSession, rows: Iterable[tuple[str, str, int]]) -> DataFrame:
    """Long role table: (experiment, column, role) with 0 ignore / 1 input / 2 outcome."""
    return spark.createDataFrame(list(rows), "experiment string, column string, role int")


def resolve_roles(roles: DataFrame) -> DataFrame:
    """A column is an input iff every experiment marks it 1, an outcome iff every
    experiment marks it 2: (column, kind) with kind 'input' / 'outcome'."""
    a = roles.groupBy("column").agg(F.min("role").alias("lo"), F.max("role").alias("hi"))
    kind = F.when((F.col("lo") == 1) & (F.col("hi") == 1), F.lit("input")) \
        .when((F.col("lo") == 2) & (F.col("hi") == 2), F.lit("outcome"))
    return a.select("column", kind.alias("kind")).where(F.col("kind").isNotNull())


def role_lists(roles: DataFrame, columns: Sequence[str]) -> tuple[list[str], list[str]]:
    """Inputs and outcomes in dataset column order (role metadata: a few rows)."""
    kinds = {r["column"]: r["kind"] for r in resolve_roles(roles).collect()}
    return ([c for c in columns if kinds.get(c) == "input"], [c for c in columns if kinds.get(c) == "outcome"])


def split_xy(df: DataFrame, inputs: Sequence[str], outcomes: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    return df.select(*map(named, inputs)), df.select(*map(named, outcomes))


# ---------------------------------------------------------------------- kinds
@dataclass
class Kinds:
    categorical: list[str]
    numeric: list[str]


def column_kind_stats(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, dtype, n_unique) where n_unique counts NULL as one value:
    one stacked distinct plus one null-flag aggregate (no per-column Expand)."""
    from .profile import distinct_counts
    cols = list(cols)
    has_null = stacked_aggregate(df, [(c, F.max(named(c).isNull().cast("long"))) for c in cols], "has_null")
    types = df.sparkSession.createDataFrame([(c, df.schema[c].dataType.simpleString()) for c in cols],
                                            "column string, dtype string")
    # all three tables hold one row per column
    out = types.join(F.broadcast(has_null), "column").join(F.broadcast(distinct_counts(df, cols)), "column", "left")
    return out.select("column", "dtype", (F.coalesce("n_unique", F.lit(0).cast("long")) + F.col("has_null"))
                      .alias("n_unique"))


def infer_column_kinds(df: DataFrame, cols: Sequence[str], unique_value_threshold: int = 10) -> DataFrame:
    """Strings are categorical; numeric columns with fewer than the threshold
    distinct values (NULL counted) are categorical; other numerics numeric.
    Booleans and timestamps are neither (reported as 'ignored')."""
    st = column_kind_stats(df, cols)
    numeric_types = ("tinyint", "smallint", "int", "bigint", "float", "double")
    is_num = F.col("dtype").isin(*numeric_types) | F.col("dtype").startswith("decimal")
    kind = F.when(F.col("dtype") == "string", F.lit("categorical")) \
        .when(is_num & (F.col("n_unique") < unique_value_threshold), F.lit("categorical")) \
        .when(is_num, F.lit("numeric")).otherwise(F.lit("ignored"))
    return st.select("column", "dtype", "n_unique", kind.alias("kind"))


def kinds_of(df: DataFrame, cols: Sequence[str], unique_value_threshold: int = 10) -> Kinds:
    rows = {r["column"]: r["kind"] for r in infer_column_kinds(df, cols, unique_value_threshold).collect()}
    return Kinds([c for c in cols if rows[c] == "categorical"], [c for c in cols if rows[c] == "numeric"])


# ------------------------------------------------------------ column removal
def drop_columns(df: DataFrame, drop: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    return df.drop(*[c for c in drop if c not in set(keep)])


def sparse_column_report(df: DataFrame, cols: Sequence[str], min_share: float, keep: Sequence[str] = ()) -> DataFrame:
    """(column, non_null_share, dropped): drop when the non-null share is below
    ``min_share`` (the stated fraction, Q1), unless the column is kept."""
    cols = list(cols)
    n = F.count(F.lit(1))
    rep = stacked_aggregate(df, [(c, F.count(named(c)) / n) for c in cols], "non_null_share")
    return rep.withColumn("dropped", (F.col("non_null_share") < min_share) & ~F.col("column").isin(*keep)
                          if keep else F.col("non_null_share") < min_share)


def low_variance_report(df: DataFrame, cols: Sequence[str], threshold: float, keep: Sequence[str] = ()) -> DataFrame:
    """(column, std_pop, dropped): population std (NULL ignored) below threshold."""
    cols = list(cols)
    rep = stacked_aggregate(df, [(c, F.stddev_pop(named(c).cast("double"))) for c in cols], "std_pop")
    drop = F.col("std_pop") < threshold
    return rep.withColumn("dropped", (drop & ~F.col("column").isin(*keep)) if keep else drop)


def stacked_aggregate(df: DataFrame, entries: Sequence[tuple[str, Column]], out_name: str) -> DataFrame:
    """(column, value) rows of one aggregate expression per column: one lazy plan for any width."""
    return aggregate_rows(df, [({"column": F.lit(c)}, {out_name: e}) for c, e in entries])


#: aggregate expressions per job of a fit (keeps generated code small)
AGG_CHUNK = 200


def agg_chunked(df: DataFrame, exprs: Sequence[Column], chunk: int = AGG_CHUNK) -> dict:
    """Evaluate many named aggregate expressions as a few one-row aggregate
    jobs of at most ``chunk`` expressions (one pass each, map-side partial
    aggregation): {alias: value}. The result is one number per expression."""
    out: dict = {}
    exprs = list(exprs)
    for start in range(0, len(exprs), chunk):
        row = df.agg(*exprs[start:start + chunk]).first()
        out.update(row.asDict())
    return out


#: columns in one block of the matrix of products
GRAM_COLUMNS = 256


def correlation_pairs(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pairwise-complete Pearson correlation for every i < j: (a, b, i, j, r); NULL and NaN are missing.

    One scan for any number of columns: each task sums masked Gram blocks (count, sums, products) of
    its rows, centred at a common origin so that large offsets don't cancel; blocks are then added by
    (i, j). NULL where either side doesn't vary.
    """
    import numpy as np
    cols = list(cols)
    p = len(cols)
    spark = df.sparkSession
    if p < 2:
        return spark.createDataFrame([], "a string, b string, i int, j int, r double")
    x = df.select(*[named(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    # an origin near each column's values: any will do, the mean is best
    middle = agg_chunked(x, [F.avg(_finite_value(F.col(f"c{i}"))).alias(f"c{i}") for i in range(p)])
    origin = np.array([middle[f"c{i}"] if middle[f"c{i}"] is not None else 0.0 for i in range(p)])

    def gram(batches):
        import pandas as pd
        total: dict[tuple[int, int], list] = {}
        for batch in batches:
            v = batch.to_numpy(dtype=float, na_value=np.nan)
            here = ~np.isnan(v)
            v = np.where(here, v - origin, 0.0)
            m = here.astype(float)
            for a in range(0, p, GRAM_COLUMNS):
                for b in range(a, p, GRAM_COLUMNS):
                    va, vb, ma, mb = v[:, a:a + GRAM_COLUMNS], v[:, b:b + GRAM_COLUMNS], m[:, a:a + GRAM_COLUMNS], m[:, b:b + GRAM_COLUMNS]
                    with np.errstate(invalid="ignore", over="ignore"):
                        parts = [ma.T @ mb, va.T @ mb, ma.T @ vb, (va * va).T @ mb, ma.T @ (vb * vb), va.T @ vb]
                    total[a, b] = parts if (a, b) not in total else [t + q for t, q in zip(total[a, b], parts, strict=True)]
        for (a, b), parts in total.items():
            i, j = (k.ravel() for k in np.meshgrid(np.arange(a, a + parts[0].shape[0]), np.arange(b, b + parts[0].shape[1]), indexing="ij"))
            up = i < j
            yield pd.DataFrame({"i": i[up], "j": j[up], **{f: q.ravel()[up] for f, q in zip(("n", "sa", "sb", "qa", "qb", "ab"), parts, strict=True)}})

    sums = x.mapInPandas(gram, "i int, j int, n double, sa double, sb double, qa double, qb double, ab double") \
        .groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "sa", "sb", "qa", "qb", "ab")])
    cov = F.col("ab") - F.try_divide(F.col("sa") * F.col("sb"), F.col("n"))
    va = F.col("qa") - F.try_divide(F.col("sa") * F.col("sa"), F.col("n"))
    vb = F.col("qb") - F.try_divide(F.col("sb") * F.col("sb"), F.col("n"))
    # what rounding leaves of a constant column is no variance
    varies = (va > F.col("qa") * 1e-14) & (vb > F.col("qb") * 1e-14)
    r = F.when(varies, cov / F.sqrt(va * vb))
    r = F.when(r.isNotNull() & ~F.isnan(r), F.greatest(F.least(r, F.lit(1.0)), F.lit(-1.0)))
    names = F.array(*[F.lit(c) for c in cols])
    return sums.select(F.element_at(names, F.col("i") + 1).alias("a"), F.element_at(names, F.col("j") + 1).alias("b"), "i", "j", r.alias("r"))


def _finite_value(x: Column) -> Column:
    return F.when(~F.isnan(x) & ~x.isin(float("inf"), float("-inf")), x)


def correlated_report(df: DataFrame, cols: Sequence[str], threshold: float, keep: Sequence[str] = ()) -> DataFrame:
    """(column, dropped): drop column j when any earlier column i (dropped or not)
    has |corr| >= threshold with it."""
    pairs = correlation_pairs(df, cols)
    hit = pairs.where(F.abs(F.col("r")) >= threshold).select(F.col("b").alias("column")).distinct() \
        .withColumn("hit", F.lit(True))
    allc = df.sparkSession.createDataFrame([(c,) for c in cols], "column string")
    rep = allc.join(hit, "column", "left").select("column", F.coalesce("hit", F.lit(False)).alias("dropped"))
    return rep.withColumn("dropped", F.col("dropped") & ~F.col("column").isin(*keep)) if keep else rep


def apply_report(df: DataFrame, report: DataFrame) -> DataFrame:
    """Drop the columns a report marks (report rows: one per column)."""
    dropped = [r["column"] for r in report.where("dropped").select("column").collect()]
    return df.drop(*dropped)


# --------------------------------------------------------------- row filters
def drop_sparse_rows(df: DataFrame, inputs: Sequence[str], threshold: float = 0.75) -> DataFrame:
    """Keep rows with at least int(threshold * len(inputs)) non-missing inputs
    (NaN counts as missing, as in pandas)."""
    k = int(threshold * len(inputs))
    return df.dropna(thresh=k, subset=[quoted(c) for c in inputs]) if k > 0 else df


def filter_outlier_rows(df: DataFrame, numeric: Sequence[str], limit: float) -> DataFrame:
    """Drop rows where any numeric column exceeds ``limit`` (NULL never does)."""
    cond = None
    for c in numeric:
        over = F.coalesce(named(c) > limit, F.lit(False))
        cond = over if cond is None else (cond | over)
    return df.where(~cond) if cond is not None else df


def outcome_positives(df: DataFrame, outcomes: Sequence[str], min_positives: int = 10) -> DataFrame:
    """(outcome, positives, kept): keep outcomes with >= min_positives ones."""
    outcomes = list(outcomes)
    long = unpivot(df, outcomes, "bigint", "outcome", "y")
    a = long.groupBy("outcome").agg(F.sum(F.when(F.col("y") == 1, 1).otherwise(0)).cast("long").alias("positives"))
    return a.withColumn("kept", F.col("positives") >= min_positives)


# --------------------------------------------------------------- set checks
def column_set_diff(a: DataFrame, b: DataFrame, name_a: str = "train", name_b: str = "test") -> DataFrame:
    """Columns present in one table but not the other: (column, missing_in)."""
    spark = a.sparkSession
    ca = spark.createDataFrame([(c,) for c in a.columns], "column string")
    cb = spark.createDataFrame([(c,) for c in b.columns], "column string")
    return ca.exceptAll(cb).withColumn("missing_in", F.lit(name_b)) \
        .unionByName(cb.exceptAll(ca).withColumn("missing_in", F.lit(name_a)))


def missing_required(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """Required columns absent from ``df``: (column)."""
    spark = df.sparkSession
    req = spark.createDataFrame([(c,) for c in required], "column string")
    have = spark.createDataFrame([(c,) for c in df.columns], "column string")
    return req.join(have, "column", "left_anti")


# ------------------------------------------------------------- outcome coding
def outcome_mapping(df: DataFrame, outcome: str) -> DataFrame:
    """Fit the two-value 0/1 map of an outcome: mode (smallest on ties) for
    missing values, smaller value -> 0, larger -> 1 (Q9: order-free)."""
    vc = df.where(named(outcome).isNotNull()).groupBy(named(outcome).alias("v")).agg(F.count(F.lit(1)).alias("cnt"))
    return vc.agg(F.min("v").alias("zero"), F.max("v").alias("one"), F.count("v").alias("n_values"),
                  F.min_by("v", F.struct(-F.col("cnt"), F.col("v"))).alias("mode"))


def binarize_outcome(df: DataFrame, outcome: str, mapping: dict | None = None, out: str | None = None) -> DataFrame:
    """Apply (or fit then apply) the outcome map; the test set reuses the train map."""
    if mapping is None:
        m = outcome_mapping(df, outcome).first()
        if m["n_values"] != 2:
            raise ValueError(f"outcome {outcome} has {m['n_values']} distinct values, expected 2")
        mapping = {"zero": m["zero"], "one": m["one"], "mode": m["mode"]}
    filled = F.coalesce(named(outcome), F.lit(mapping["mode"]))
    coded = F.when(filled == F.lit(mapping["one"]), F.lit(1)).when(filled == F.lit(mapping["zero"]), F.lit(0))
    return df.withColumn(out or outcome, coded.cast("int"))


def clean_categoricals(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Categoricals as strings with the textual missing markers turned into NULL."""
    return df.select(*[normalize_missing_tokens(named(c).cast("string")).alias(c) if c in set(cols) else named(c)
                       for c in df.columns])


def any_col(conds: Sequence[Column]) -> Column:
    out = None
    for c in conds:
        out = c if out is None else (out | c)
    return out if out is not None else F.lit(False)

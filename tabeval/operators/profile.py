"""Profiling, correlation and array-averaging aggregates.

Wide summaries are one ``agg`` with a few expressions per column followed by a
``stack`` unpivot; ragged per-curve arrays are kept long (curve, position,
value) so "position-wise mean" is a plain group-by, never an array built in
one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import aggregate_rows, inline_rows, named, unpivot
from .clean import correlation_pairs, is_numeric


def distinct_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, n_unique) with NULL excluded, for many columns in ONE shuffle:
    the columns are stacked to (column, value by type family) and made distinct
    together, instead of one Expand copy of the table per column. Whole numbers
    stay whole and decimals exact: nothing passes through DOUBLE but doubles."""
    cols = list(cols)
    rows = []
    for c in cols:
        kind = df.schema[c].dataType
        family = "lv" if isinstance(kind, T.IntegralType) else "dv" if isinstance(kind, T.FractionalType) \
            and not isinstance(kind, T.DecimalType) else "sv"
        rows.append({"column": F.lit(c), **{f: (named(c) if f == family else F.lit(None)).cast(t)
                                            for f, t in (("lv", "bigint"), ("dv", "double"), ("sv", "string"))}})
    long = inline_rows(df, rows).where(F.coalesce("lv", "dv").isNotNull() | F.col("sv").isNotNull())
    return long.distinct().groupBy("column").agg(F.count(F.lit(1)).cast("long").alias("n_unique"))


def profile_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Per column: dtype, missing count and %, distinct (NULL excluded), and for
    numeric columns mean / sample std / min / max (NaN ignored).

    One lazy plan for any width: one-pass moment aggregates and one stacked distinct."""
    cols = list(cols)
    none = F.lit(None).cast("double")
    entries = []
    for c in cols:
        x, num = named(c), is_numeric(df, c)
        missing = x.isNull() | (F.isnan(x) if num else F.lit(False))
        v = F.when(~F.isnan(x.cast("double")), x.cast("double")) if num else None
        stats = {"mean": mean_of(v), "std": F.stddev_samp(v), "min": F.min(v), "max": F.max(v)} if num \
            else {k: F.max(none) for k in ("mean", "std", "min", "max")}
        entries.append(({"column": F.lit(c), "dtype": F.lit(df.schema[c].dataType.simpleString())},
                        {"_n": F.count(F.lit(1)), "missing": F.coalesce(F.sum(missing.cast("long")), F.lit(0).cast("long")), **stats}))
    st = aggregate_rows(df, entries)
    # both sides hold one row per profiled column
    st = st.join(F.broadcast(distinct_counts(df, cols)), "column", "left")
    return st.select("column", "dtype", "missing", F.try_divide(F.col("missing") * 100.0, F.col("_n")).alias("missing_pct"),
                     F.coalesce("n_unique", F.lit(0).cast("long")).alias("n_unique"), "mean", "std", "min", "max")


def experiment_prevalence(df: DataFrame, roles: DataFrame) -> DataFrame:
    """Per experiment x outcome: number of inputs and the share of 1s among the
    non-null outcome values (NULL unless every value is 0 or 1)."""
    outs = [r["column"] for r in roles.where("role = 2").select("column").distinct().collect()
            if r["column"] in df.columns]
    if not outs:
        return df.sparkSession.createDataFrame([], "experiment string, n_inputs bigint, outcome string, prevalence double")
    long = unpivot(df, outs, "double", "outcome", "y").where(F.col("y").isNotNull())
    prev = long.groupBy("outcome").agg(
        F.avg((F.col("y") == 1).cast("double")).alias("share"),
        F.max((~F.col("y").isin(0.0, 1.0)).cast("int")).alias("other"))
    prev = prev.select("outcome", F.when(F.col("other") == 0, F.col("share")).alias("prevalence"))
    n_in = roles.groupBy("experiment").agg(F.sum((F.col("role") == 1).cast("long")).alias("n_inputs"))
    eo = roles.where("role = 2").select("experiment", F.col("column").alias("outcome"))
    return eo.join(n_in, "experiment").join(prev, "outcome", "left") \
        .select("experiment", "n_inputs", "outcome", "prevalence")


def correlation_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Full Pearson matrix in long form (a, b, r), pairwise-complete, one aggregate."""
    cols = list(cols)
    pairs = correlation_pairs(df, cols)
    d = aggregate_rows(df, [({"a": F.lit(c), "b": F.lit(c)}, {"r": self_correlation(named(c).cast("double"))}) for c in cols])
    return pairs.select("a", "b", "r").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "r")) \
        .unionByName(d)


def top_correlated(df: DataFrame, features: Sequence[str], label: str, k: int = 20) -> DataFrame:
    """Features ranked by |corr(feature, label)|, top k (a top-k report)."""
    features = list(features)
    y = named(label).cast("double")
    long = aggregate_rows(df, [({"feature": F.lit(f)}, {"r": correlation(named(f).cast("double"), y)}) for f in features])
    return long.orderBy(F.abs("r").desc_nulls_last(), "feature").limit(k) \
        .select("feature", "r", F.abs("r").alias("abs_r"))


def correlation(x, y):
    """Pearson correlation over the rows where neither side is NULL or NaN."""
    both = x.isNotNull() & y.isNotNull() & ~F.isnan(x) & ~F.isnan(y)
    return F.corr(F.when(both, x), F.when(both, y))


def self_correlation(x):
    """1, or NULL for a column that doesn't vary."""
    return correlation(x, x)


def mean_of(v):
    """Mean of doubles; +-inf values make it +-inf (NULL when both signs occur), as in pandas."""
    pinf = F.max((v == float("inf")).cast("int"))
    ninf = F.max((v == float("-inf")).cast("int"))
    m = F.avg(F.when(~v.isin(float("inf"), float("-inf")), v))
    return F.when((pinf == 1) & (ninf == 1), F.lit(None).cast("double")) \
        .when(pinf == 1, F.lit(float("inf"))).when(ninf == 1, F.lit(float("-inf"))).otherwise(m)


def finite_mean(c: str):
    """Mean over finite values only; NULL when none remain."""
    x = named(c).cast("double")
    return F.avg(F.when(~F.isnan(x) & ~x.isin(float("inf"), float("-inf")), x))


def metric_mean(df: DataFrame, group: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    return df.groupBy(*group).agg(*[finite_mean(m).alias(m) for m in metrics])


def pad_average(long: DataFrame, group: Sequence[str], pos: str = "pos", value: str = "value") -> DataFrame:
    """Position-wise mean of unequal-length curves kept long: missing positions
    simply do not contribute (numpy nanmean over NaN padding)."""
    return long.groupBy(*group, pos).agg(finite_mean(value).alias("mean_value"),
                                         F.count(F.col(value)).alias("n_curves"))


def pad_average_2d(long: DataFrame, group: Sequence[str], value: str = "value") -> DataFrame:
    """One scalar mean over every cell of each ragged 2-D table."""
    return long.groupBy(*group).agg(finite_mean(value).alias("mean_value"))


def truncate_to_smallest(long: DataFrame, key: str, row: str = "i", col: str = "j") -> DataFrame:
    """Cut every 2-D table (rows keyed by ``key``) to the smallest row and column
    count among them."""
    dims = long.groupBy(key).agg((F.max(row) + 1).alias("_r"), (F.max(col) + 1).alias("_c"))
    lim = dims.agg(F.min("_r").alias("_mr"), F.min("_c").alias("_mc"))
    from .ordered import attach
    return attach(long, lim, []).where((F.col(row) < F.col("_mr")) & (F.col(col) < F.col("_mc"))) \
        .drop("_mr", "_mc")

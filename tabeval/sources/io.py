"""Scans and sinks.

Parquet is the default (predicate pushdown, column pruning); CSV with a header
is supported for the reference's upload path. A blank leading header that a
pandas index leaves behind (``Unnamed: 0`` / Spark's ``_c0``) is dropped.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import free_names, named

STRAY_INDEX_COLUMNS = ("Unnamed: 0", "_c0")

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def scan_table(spark: SparkSession, path: str, fmt: str | None = None, schema: T.StructType | str | None = None,
               infer_schema: bool = True) -> DataFrame:
    """Load CSV (header, optional inference) or Parquet and drop a stray index column."""
    fmt = fmt or ("csv" if path.lower().endswith(".csv") else "parquet")
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        df = reader.option("header", True).option("inferSchema", infer_schema and schema is None) \
            .option("nanValue", "NaN").csv(path)
    else:
        df = reader.format(fmt).load(path)
    return drop_stray_index(df)


def drop_stray_index(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in STRAY_INDEX_COLUMNS if c in df.columns])


def sink_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
               partition_by: Sequence[str] = ()) -> None:
    w = df.write.mode(mode).format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w = w.option("header", True)
    w.save(path)


def sink_results(df: DataFrame, path: str, keys: Sequence[str] = ("experiment", "test_set")) -> None:
    """Append a result table, partitioned by its experiment keys."""
    sink_table(df, path, mode="append", partition_by=[k for k in keys if k in df.columns])


def with_row_id(df: DataFrame, cols: Sequence[str] | None = None, name: str = "row_id") -> DataFrame:
    """Stable 64-bit row id from the row content (xxhash64 of the given columns).

    Independent of partitioning and task retries, unlike
    ``monotonically_increasing_id``. Rows that are exact duplicates share an id.
    """
    cols = list(cols or df.columns)
    return df.withColumn(name, F.xxhash64(*[F.col(c) for c in cols]))


def read_positions(spark: SparkSession, path: str, name: str = "position") -> DataFrame:
    """A Parquet table with ``name``, the place of each row from 0: files by name, rows as they stand in them.

    The place in a file comes from its metadata; what lies before a file is a running sum over one row per
    file. No row is moved or sorted.
    """
    from ..operators.ordered import join_checked, prefix_sum
    df = spark.read.parquet(path)
    file, row, n, before = free_names(df.columns, ["file", "row", "n", "before"])
    placed = df.withColumns({file: F.col("_metadata.file_path"), row: F.col("_metadata.row_index")})
    counts = placed.groupBy(file).agg(F.count(F.lit(1)).alias(n))
    offsets = prefix_sum(counts, [], [file], [n], prefix="to").select(file, (F.col(f"to{n}") - F.col(n)).alias(before))
    return join_checked(placed, offsets, [file]).select(*[named(c) for c in df.columns], (F.col(before) + F.col(row)).alias(name))


def concat_columns(spark: SparkSession, left: str, right: str) -> DataFrame:
    """Two Parquet tables of equally many rows side by side, the first row with the first: both are read with
    their positions, which meet in one join. Columns of the same name on both sides, or tables of
    different sizes, are an error."""
    a, b = read_positions(spark, left, "_position"), read_positions(spark, right, "_position")
    both = sorted(set(a.columns) & set(b.columns) - {"_position"})
    if both:
        raise ValueError(f"columns on both sides: {both}")
    sizes = spark.read.parquet(left).count(), spark.read.parquet(right).count()
    if sizes[0] != sizes[1]:
        raise ValueError(f"tables of {sizes[0]} and {sizes[1]} rows can't be put side by side")
    return a.join(b, "_position").drop("_position")


def normalize_nan(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """NaN -> NULL in floating columns (Spark keeps them apart; the reference does not)."""
    floating = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    targets = [c for c in (cols or df.columns) if c in floating]
    return df.select(*[F.when(F.isnan(c), F.lit(None).cast(df.schema[c].dataType)).otherwise(F.col(c)).alias(c)
                       if c in targets else F.col(c) for c in df.columns])

"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import named
from ..operators.ordered import frozen_path as scratch

#: bytes of rows sent to a Python worker at once; long texts would otherwise fill its memory
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: rows of a narrow table in one file, and how many files are still few
FILE_ROWS, FEW_FILES = 200_000, 4


def freeze(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, survives
    lost executors, and fixes sampled ranges and generated row numbers. ``rows``: about how many narrow
    rows there are, if known; few are shuffled once more, to few files, after the work that makes them."""
    spark = df.sparkSession
    path = scratch(spark, name)
    files = None if rows is None else max(1, -(-rows // FILE_ROWS))
    if files is not None and files <= FEW_FILES:
        df = df.repartition(files)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def hold(df: DataFrame) -> DataFrame:
    """Keep a small table that is read twice on the executors' disks. Its lineage stays, so a lost part
    is computed again. Not for loops, whose plans would grow."""
    return df.persist(StorageLevel.DISK_ONLY)


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Bound what one Arrow batch holds, by bytes and by rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def lean(run):
    """``run`` over Arrow batches; freed memory goes back to the system when it ends. A Python worker is used again by later
    stages, and what it once took would stay beside theirs."""
    def run_and_give_back(batches):
        import ctypes
        import gc

        import pyarrow as pa
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library
        if trim is not None:
            trim(0)
    return run_and_give_back


def id_remainder(key: Column, parts: int) -> Column:
    """crc32 of the key's text, modulo ``parts``; a null key counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % parts


def add_by_text(df: DataFrame, text: str, fields: str, make) -> DataFrame:
    """Replace column ``text`` by columns computed from it in Arrow batches.

    ``make()`` runs once per task and returns a function from a list of texts (None for null) to one
    Arrow-convertible list or array per field of ``fields``. Other columns pass through untouched, but one
    that is named like a new field gives way to it.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    small_batches(df.sparkSession)
    added = _parse_datatype_string(fields)
    new_names = {f.name.lower() for f in added.fields}
    df = df.select(*[named(c) for c in df.columns if c == text or c.lower() not in new_names])
    kept = [f for f in df.schema.fields if f.name != text]
    schema = StructType(kept + list(added.fields))
    types = [f.type for f in to_arrow_schema(added)]
    names, at = schema.names, df.columns.index(text)

    def run(batches):
        work = make()
        for batch in batches:
            new = work(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [c for i, c in enumerate(batch.columns) if i != at]
                + [x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(new, types, strict=True)], names=names)

    return df.mapInArrow(lean(run), schema)


def packed(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` as two columns, ``text`` and ``doc`` with all others, so that no name of theirs can clash."""
    others = [named(c) for c in docs.columns if c != text]
    return docs.select(named(text).alias("text"), F.struct(*(others or [F.lit(None).cast("int").alias("none")])).alias("doc"))


def unpacked(rows: DataFrame, columns: list[str], text: str, new: dict[str, Column] | None = None) -> list[Column]:
    """The ``columns`` that were packed, some replaced by ``new`` ones."""
    old = {c: (F.col("text") if c == text else F.col("doc")[c]) for c in columns}
    return [v.alias(c) for c, v in (old | {k: v for k, v in (new or {}).items() if k in old}).items()]


def bounded_sample(df: DataFrame, key: Column, rows: int) -> DataFrame:
    """About ``rows`` rows of ``df`` (never more than 1.5 times that), picked by a hash of ``key``:
    the same rows on every run and partitioning. Only for fitting a model."""
    n = df.count()
    if n <= rows:
        return df
    share = int(rows / n * 1_000_000_000)
    return df.where(F.pmod(F.xxhash64(key), F.lit(1_000_000_000)) < share).limit(rows + rows // 2)

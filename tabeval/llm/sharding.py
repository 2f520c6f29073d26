"""Contiguous shards of near-equal bytes, with built-in functions only.

Rows are put in a global order by range partitioning. Each partition reports one total; the prefix
sums of those totals (one row per partition) are the only thing that crosses partitions. A row then
knows how many bytes lie before it in the whole table, and the table is cut at equal byte targets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import freeze

#: added to the bytes of a text for the row's framing
ROW_OVERHEAD = 16


def cut_by_bytes(rows: DataFrame, size: str, order: Sequence[str], shards: int) -> DataFrame:
    """Add ``shard`` (0 to shards-1) and ``slot`` (gapless from 0 in each shard) to ``rows``.

    A row goes to the shard that holds the midpoint of its bytes, so shards are contiguous in
    ``order`` and each is within one row of the equal share. Rows equal in ``order`` (repeated rows)
    keep the order in which they were read. An empty table gives an empty result. Columns of ``rows``
    are kept; pass narrow rows, as they are range-shuffled and written once.
    """
    pid, tie, before, number, base = "_pid", "_tie", "_before", "_number", "_base"
    dealt = (rows.withColumn(tie, F.monotonically_increasing_id())
             .repartitionByRange(*order, tie).withColumn(pid, F.spark_partition_id()))
    dealt = freeze(dealt, "dealt")  # the sampled ranges are fixed from here on
    # one row per partition: bounded by the number of shuffle partitions
    totals = dealt.groupBy(pid).agg(F.sum(size).alias("_bytes"))
    earlier = Window.orderBy(pid).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(pid, F.coalesce(F.sum("_bytes").over(earlier), F.lit(0)).alias(base))
    total = totals.agg(F.sum("_bytes")).first()[0] or 0
    here = Window.partitionBy(pid).orderBy(*order, tie).rowsBetween(Window.unboundedPreceding, -1)
    placed = (dealt.join(F.broadcast(starts), pid)
              .withColumn(before, F.col(base) + F.coalesce(F.sum(size).over(here), F.lit(0)))
              # midpoint / total * shards, in whole numbers
              .withColumn("shard", F.least(F.lit(shards - 1), F.expr(
                  f"cast((2 * {before} + {size}) * {shards} div {max(2 * total, 1)} as int)"))))
    # slots: shards are contiguous, so the rows of a shard that lie in earlier partitions number
    # as many as the (partition, shard) counts say; at most partitions + shards rows
    counts = placed.groupBy(pid, "shard").agg(F.count("*").alias("_n"))
    in_shard = Window.partitionBy("shard").orderBy(pid).rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(F.col(pid).alias("_p"), F.col("shard").alias("_s"),
                          F.coalesce(F.sum("_n").over(in_shard), F.lit(0)).alias(number))
    local = Window.partitionBy(pid, "shard").orderBy(*order, tie)
    return (placed.join(F.broadcast(first), (F.col(pid) == F.col("_p")) & (F.col("shard") == F.col("_s")))
            .withColumn("slot", F.col(number) + F.row_number().over(local) - 1)
            .drop(pid, tie, before, number, base, "_p", "_s"))


def shard_documents(docs: DataFrame, shards: int = 40, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Byte-balanced shards of a document table: key, size, text_crc32, law, shard, slot, grown_shard.

    size: UTF-8 bytes of the text plus 16; a null text has no bytes, a null key sorts first. Rows are
    ordered by the text's checksum, then key, so equal texts are neighbours and a group of copies of
    any size is cut wherever the byte target falls. The law is always ``bytes``, so grown_shard (the
    place under one more shard, of the law ``key``) is null. Other columns are ignored.
    """
    content = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(F.col(f"`{key}`").alias(key),
                       (F.octet_length(content) + ROW_OVERHEAD).cast("long").alias("size"),
                       F.crc32(content.cast("binary")).alias("text_crc32"))
    return cut_by_bytes(rows, "size", ["text_crc32", key, "size"], shards).select(
        key, "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, placed: DataFrame, path: str, key: str = "doc_id") -> None:
    """Write the documents as one folder per shard. ``docs`` must have unique non-null keys."""
    joined = docs.join(placed.select(key, "shard", "slot"), key)
    (joined.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
     .write.partitionBy("shard").parquet(path))

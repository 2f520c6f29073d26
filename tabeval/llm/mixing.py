"""Mixing sources to target weights by systematic sampling, with built-in functions only.

Every document of a source is expected in the mix equally often: target size over source size. The
documents of a source stand in one order; the prefix sums of their expected copies, moved by one random
offset per source, cross some whole numbers, and a document is emitted once per number crossed. So a
document gets the whole copies below or above its expectation, and any stretch of the order
gets its expected copies to within one. In the order of sizes the words taken differ from
the target by less than the largest document.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import named
from ..operators.ordered import prefix_sum
from .common import freeze

WEIGHTS = (1, 2, 3)
MOST_COPIES = 3
SEED = 7
WORD = r"[^\x20\x09-\x0D]+"
#: expected copies are whole multiples of one over this, so that sums don't hang on their order;
#: a source may hold 2^63 / (3 * 2^24) = 1.8e11 documents
UNIT = 1 << 24


def random_units(*parts: Column) -> Column:
    """A number from 0 to UNIT - 1 (24 bits of a SHA-256) that depends on ``parts`` alone."""
    text = F.concat(F.lit(f"{SEED}:"), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 6), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """``sizes`` (source, source_size; one row each) with ``target``, a double.

    Sources by code point, null last, weigh ``weights`` in turn and share the whole size by weight. A
    target stops at ``most`` times its source's size; what is over goes to the others by weight, until
    none is above. Each round is one aggregate; the rows stay on the executors.
    """
    rows = sizes.select(F.col("source").isNull().alias("unnamed"), "source", "source_size", F.lit(1).cast("long").alias("one"))
    placed = prefix_sum(rows, [], ["unnamed", "source"], ["one"], prefix="place_")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("place_one") - 1, F.lit(len(weights))) + 1).cast("int"))
    placed = freeze(placed.select("source", "source_size", weight.cast("long").alias("weight"),
                                            (F.col("source_size") * most).alias("most")), "weights")
    left, shared, capped = None, None, -1
    while True:
        # a source is over where weight * left / shared > most; whole numbers, so exact
        over = F.lit(False) if left is None else (
            F.col("weight").cast("decimal(19,0)") * F.lit(left).cast("decimal(19,0)")
            > F.col("most").cast("decimal(19,0)") * F.lit(shared).cast("decimal(19,0)"))
        row = placed.agg(F.sum("source_size").alias("total"), F.sum(F.when(over, F.col("most"))).alias("given"),
                         F.sum(F.when(~over, F.col("weight"))).alias("shared"), F.count(F.when(over, 1)).alias("capped")).first()
        if row["capped"] == capped or not row["shared"]:
            break
        left, shared, capped = row["total"] - (row["given"] or 0), row["shared"], row["capped"]
    if left is None:  # no sources
        return placed.select("source", "source_size", F.lit(0.0).alias("target"))
    share = F.col("weight").cast("double") * F.lit(float(left)) / F.lit(float(shared))
    return placed.select("source", "source_size", F.when(over, F.col("most").cast("double")).otherwise(share).alias("target"))


def systematic(rows: DataFrame, group: str, order: Sequence[str], expected: str, offset: str) -> DataFrame:
    """Add ``copies`` to ``rows`` (frozen): how many whole numbers of UNITs the running sum of
    ``expected`` crosses at each row. ``offset`` (0 to UNIT - 1) is the same in all of a group."""
    run = prefix_sum(rows, [group], order, [expected], prefix="to_", frozen=True)
    crossed = F.expr(f"(to_{expected} + {offset}) div {UNIT} - (to_{expected} - {expected} + {offset}) div {UNIT}")
    return run.withColumn("copies", crossed).drop(f"to_{expected}")


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row per document: key, size, source_size, target, copies and taken = copies * size.

    size: runs of characters other than blanks, tabs and line ends; none where the text is null or
    empty, and then nothing is taken. Documents stand by size, then by a hash of their key; rows equal in
    both have equal results in any order. A source of no words has the target 0. An empty table gives no rows.
    """
    size = F.coalesce(F.regexp_count(named(text), F.lit(WORD)).cast("long"), F.lit(0).cast("long"))
    rows = freeze(docs.select(named(key).alias("k"), named(source).alias("source"), size.alias("size")), "sizes")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = freeze(source_targets(sizes), "targets")
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") * UNIT)).otherwise(0)
    per_source = targets.select(F.col("source").alias("s"), "source_size", "target", copies.cast("long").alias("expected"),
                                random_units(F.col("source")).alias("offset"))
    # ``row`` keeps rows of one key apart, so that the place of each is fixed
    dealt = freeze(rows.join(per_source, F.col("source").eqNullSafe(F.col("s"))).withColumns(
        {"h": F.sha2(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("k").cast("string"), F.lit(""))).cast("binary"), 256).substr(1, 16),
         "row": F.monotonically_increasing_id()}).drop("s"), "expected")
    taken = systematic(dealt, "source", ["size", "h", "k", "row"], "expected", "offset")
    return taken.select(F.col("k").alias(key), "size", "source_size", "target", "copies",
                        (F.col("copies") * F.col("size")).alias("taken"))


def write_mix(docs: DataFrame, mixed: DataFrame, path: str, key: str = "doc_id") -> None:
    """Write the rows of ``docs`` as often as ``mixed`` takes them. Keys must be unique and not null."""
    chosen = mixed.where("copies > 0").select(key, "copies")
    copied = docs.join(chosen, key).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    copied.drop("copies").write.parquet(path)

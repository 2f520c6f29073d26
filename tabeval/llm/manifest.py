"""Merkle manifest of a table: one root for all rows, and a proof of each row.

Leaves of a group stand in order; every ``fanout`` consecutive nodes hash to their parent until one
is left, the group's subroot. Subroots hash to the root in the same way. A level is one slot pivot:
conditional aggregates spread the children of a parent into ``fanout`` columns. All of them joined hash
to the parent; those left and right of a child's own slot are its siblings. Going up, each level has a
``fanout``-th of the rows of the one below; going down, siblings are handed to the children.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import named
from ..operators.ordered import prefix_sum
from .common import freeze, id_remainder

FANOUT = 16
#: siblings on one level, joined: what comes before and after the own slot
SIBLINGS = "array<struct<l:string,r:string>>"


def digest(content: Column) -> Column:
    """Lower-case hex SHA-256; text counts as its UTF-8 bytes."""
    return F.sha2(content.cast("binary"), 256)


def field(value: Column) -> Column:
    """``-`` for null, else UTF-8 byte count, a colon and the value as text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(columns: Sequence[Column]) -> Column:
    return digest(F.concat(*[field(c) for c in columns]))


def numbered(leaves: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """``leaves`` (frozen) with ``i``, the place of a row in its group from 0, and ``n``, the group's size."""
    ones = leaves.withColumn("one", F.lit(1).cast("long"))
    placed = prefix_sum(ones, [group], order, ["one"], prefix="place_", totals_prefix="size_", frozen=True)
    return placed.withColumn("i", F.col("place_one") - 1).withColumnRenamed("size_one", "n").drop("one", "place_one")


def slots(prefix: str, fanout: int) -> list[str]:
    return [f"{prefix}{j}" for j in range(fanout)]


def pivot(nodes: DataFrame, carried: Sequence[str], fanout: int) -> DataFrame:
    """One row per parent: g, n, p (its place), per slot the child's ``d`` and a struct of the ``carried``
    columns, and ``digest``. At most ``fanout`` children meet in a group."""
    place = F.col("i") % fanout
    spread = [F.max(F.when(place == j, F.col("d"))).alias(c) for j, c in enumerate(slots("d", fanout))]
    if carried:
        extra = F.struct(*carried)
        spread += [F.max(F.when(place == j, extra)).alias(c) for j, c in enumerate(slots("x", fanout))]
    parents = nodes.groupBy("g", "n", F.expr(f"i div {fanout}").alias("p")).agg(*spread)
    return parents.withColumn("digest", digest(F.concat_ws("", *slots("d", fanout))))


def children(parents: DataFrame, carried: bool, fanout: int) -> DataFrame:
    """The children of pivoted ``parents`` with their proof: the siblings on this level, then the parent's."""
    d = slots("d", fanout)

    def child(j: int) -> Column:
        own = F.struct(F.concat_ws("", *d[:j]).alias("l"), F.concat_ws("", *d[j + 1:]).alias("r"))
        proof = F.concat(F.array(own), F.col("proof")).cast(SIBLINGS).alias("proof")
        extra = [F.col(f"x{j}").alias("x")] if carried else []
        return F.when(F.col(d[j]).isNotNull(), F.struct(
            (F.col("p") * fanout + j).alias("i"), F.col(d[j]).alias("d"), *extra, proof))

    found = parents.select("g", "n", F.explode(F.array(*[child(j) for j in range(fanout)])).alias("c")).where("c is not null")
    return found.select("g", "n", "c.i", "c.d", *(["c.x.*"] if carried else []), "c.proof")


def tree(nodes: DataFrame, carried: Sequence[str] = (), fanout: int = FANOUT) -> tuple[list[DataFrame], DataFrame]:
    """The pivoted levels, lowest first, and the tops: g, n, d of what remains of each group.

    ``nodes``: g (group), n (its size), i (place in it), d (digest) and the ``carried`` columns. Every
    level is written, so the next one reads a ``fanout``-th of the rows.
    """
    spark = nodes.sparkSession
    most = nodes.agg(F.max("n")).first()[0] or 0
    levels, tops, width = [], nodes.where("n = 1").select("g", "n", "d"), 1
    while width < most:
        level = freeze(pivot(nodes.where(f"n > {width}"), carried if not levels else (), fanout), "level")
        levels.append(level)
        width *= fanout
        nodes = level.select("g", "n", F.col("p").alias("i"), F.col("digest").alias("d"))
        tops = tops.unionByName(nodes.where(f"n <= {width}").drop("i"))
    return levels, tops


def with_proofs(levels: list[DataFrame], single: DataFrame, carried: Sequence[str], top_proof: DataFrame | None = None,
                fanout: int = FANOUT) -> DataFrame:
    """g, n, i, d, the carried columns and ``proof`` of every leaf: siblings level by level, up to the root.

    ``single``: the leaves of groups of one. ``top_proof`` (g, proof): what follows above each group.
    """
    def onto(rows: DataFrame, above: DataFrame, keys: Sequence[str]) -> DataFrame:
        same = F.lit(True)
        for k in keys:
            same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
        return rows.alias("a").join(above.alias("b"), same).select("a.*", "b.proof")

    def top(rows: DataFrame) -> DataFrame:
        if top_proof is None:
            return rows.withColumn("proof", F.array().cast(SIBLINGS))
        return onto(rows, top_proof, ["g"])

    above, width = None, fanout ** len(levels)
    for k, level in reversed(list(enumerate(levels))):
        # a parent is the top of its group where the level above has no use for it
        proven = top(level.where(f"n <= {width}"))
        if above is not None:
            proven = proven.unionByName(onto(level.where(f"n > {width}"), above.select("g", F.col("i").alias("p"), "proof"), ["g", "p"]))
        above = children(proven, bool(carried) and k == 0, fanout)
        width //= fanout
    alone = top(single.select("g", "n", "i", "d", *carried))
    return alone if above is None else above.unionByName(alone)


def folded(start: Column, proof: Column) -> Column:
    """The root that ``start`` gives with the siblings of ``proof``."""
    return F.aggregate(proof, start, lambda d, s: digest(F.concat(s["l"], d, s["r"])))


def manifest(docs: DataFrame, columns: Sequence[str], group: str, key: str, changed: dict[str, Column] | None = None,
             fanout: int = FANOUT) -> DataFrame:
    """One row per row of ``docs``: key, leaf, subroot, root, proof_sha256, folded_root, verified.

    A leaf hashes ``columns``; leaves ascend by ``key`` in each ``group`` (null first; rows with equal or
    null keys by their digest; equal rows keep the order in which they were written). Proofs are made
    of the table as it is. ``changed`` replaces columns before the leaf that is checked against them; a
    row verifies if this leaf and its siblings fold to the root. An empty table gives no rows, a single
    row is its own root and has an empty proof. Columns that aren't named are ignored.
    """
    changed = changed or {}
    now = [changed.get(c, named(c)) for c in columns]
    rows = docs.select(named(key).alias("k"), named(group).alias("g"), leaf([named(c) for c in columns]).alias("d"),
                       (leaf(now) if changed else F.lit(None).cast("string")).alias("t"))
    # a changed leaf is kept where it differs; ``row`` keeps equal rows apart
    rows = freeze(rows.withColumn("t", F.when(F.col("t") != F.col("d"), F.col("t"))).withColumn("row", F.monotonically_increasing_id()), "leaves")
    carried = ["k", "t"]
    nodes = freeze(numbered(rows, "g", ["k", "d", "row"]).drop("row"), "nodes")
    levels, tops = tree(nodes, carried, fanout)
    tops = freeze(tops.select("g", "d"), "subroots")
    # the subroots are the leaves of one more tree, of a single group
    upper = freeze(numbered(tops.select(F.lit(0).alias("all"), F.col("g").alias("source"), "d"), "all", ["source"])
                   .withColumnRenamed("all", "g"), "upper")
    upper_levels, root = tree(upper, ["source"], fanout)
    root = root.first()
    proofs = with_proofs(upper_levels, upper.where("n = 1"), ["source"], None, fanout)
    proofs = freeze(proofs.select(F.col("source").alias("g"), F.col("d").alias("subroot"), "proof"), "upper-proofs")
    whole = with_proofs(levels, nodes.where("n = 1"), carried, proofs.select("g", "proof"), fanout)
    whole = whole.alias("a").join(proofs.alias("b"), F.col("a.g").eqNullSafe(F.col("b.g"))).select("a.*", "b.subroot")
    siblings = F.array_join(F.transform("proof", lambda s: F.concat(s["l"], s["r"])), "")
    top = F.lit(root["d"] if root else None).cast("string")
    return whole.select(F.col("k").alias(key), F.col("d").alias("leaf"), "subroot", top.alias("root"), digest(siblings).alias("proof_sha256"),
                        folded(F.coalesce("t", "d"), F.col("proof")).alias("folded_root")).withColumn(
        "verified", F.col("folded_root") == F.col("root"))


#: what a leaf of a document is made of
COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def check_documents(docs: DataFrame) -> DataFrame:
    """The manifest of documents, checked against rows of which about one in five had its text's A-Z
    lower-cased: those whose id's crc32 is divisible by 5 (a null id's isn't counted)."""
    tampered = F.col("doc_id").isNotNull() & (id_remainder(F.col("doc_id"), 5) == 0)
    text = F.when(tampered, F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))
    return manifest(docs, COLUMNS, "source", "doc_id", {"text": text})

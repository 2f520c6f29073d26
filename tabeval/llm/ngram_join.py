"""Jaccard join of documents' word-shingle sets by chosen paths.

A document's set of five-word shingles is split recursively: at each step it follows the shingles j
with h(path, j) < 1 / (LEVEL |x|), so two sets of Jaccard similarity LEVEL or more share about one path
in expectation at every depth, whatever the depth. Buckets of a path that are small are compared by
brute force, larger ones are split further; the whole is repeated REPEATS times, which makes the chance
to miss a pair at the threshold less than 1 - RECALL. Bucket comparisons use 256-bit sketches and only
propose; the proposals' connected components are then checked exactly, all pairs in each, in blocks.

Documents with equal sets are one class and are compared once.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph
from .common import freeze, hold, lean, packed, small_batches, unpacked
from .decontaminate import FOLD

SHINGLE = 5
#: similarity as a fraction, so that the check is exact
LEVEL_TOP, LEVEL_BOTTOM = 4, 5
LEVEL = LEVEL_TOP / LEVEL_BOTTOM
#: a bucket of at most so many sets is compared by brute force; at DEPTH any bucket is
SMALL, DEPTH, RECALL = 128, 3, 0.999
BITS = 256
#: differing sketch bits up to which a pair is proposed: eight deviations above a pair at the threshold;
#: small sets, whose sketches repeat few values, get more
MOST_BITS, MOST_BITS_SMALL, SMALL_SET = 64, 80, 32
#: shingles and sets in one block of the exact check
BLOCK_SHINGLES, BLOCK_SETS = 1 << 20, 1024
#: columns of the dense incidence matrix that are multiplied at once
COLUMNS = 4096
#: what is left to split is broadcast up to this size, joined by a shuffle beyond it
BROADCAST_BYTES, PATH_BYTES = 24 << 20, 24
PIECE_BYTES = 1 << 20
#: rows of buckets and sets of proposals that one task compares
PATHS_A_TASK, SETS_A_TASK = 200_000, 2_000

_R = np.random.default_rng(20240501)
LETTER = _R.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
LETTER[32] = 0
PLACE = _R.integers(1, 2**63, 4096, dtype=np.uint64) | np.uint64(1)
TURN = _R.integers(1, 2**63, SHINGLE, dtype=np.uint64) | np.uint64(1)
PROBE = _R.integers(0, BITS, (BITS, 256)).astype(np.int16)


def repeats() -> int:
    """Runs needed for RECALL, if a pair at the threshold meets one shared path per step on average:
    its chance to share one at depth d is p(d) = 1 - exp(-p(d - 1)), p(0) = 1."""
    p = 1.0
    for _ in range(DEPTH):
        p = 1 - math.exp(-p)
    return math.ceil(math.log(1 - RECALL) / math.log(1 - p))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingle_sets(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' sorted distinct shingle hashes, concatenated, and each text's count. Words are runs of
    ASCII letters and digits and of other characters, lower-cased in ASCII. A text of fewer than SHINGLE words is
    one shingle; a text without words has none."""
    folded = [t.translate(FOLD) if t else b"" for t in texts]
    sizes = np.array([len(t) + 1 for t in folded])
    raw = np.frombuffer(b" ".join([*folded, b""]), np.uint8)
    inside = raw != 32
    edge = np.diff(inside.view(np.int8), prepend=0)
    begins = np.flatnonzero(edge == 1)
    if not len(begins):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    start = np.zeros(len(raw), np.int64)
    start[begins] = begins
    place = np.arange(len(raw)) - np.maximum.accumulate(start)
    word = mix(np.add.reduceat(LETTER[raw] * PLACE[place & 4095], begins))
    doc_of_word = np.searchsorted(np.cumsum(sizes), begins, "right")
    words = np.bincount(doc_of_word, minlength=len(texts))
    padded = np.concatenate([word, np.zeros(SHINGLE - 1, np.uint64)])
    value = np.zeros(len(word), np.uint64)
    last = np.cumsum(words)[doc_of_word]  # where the word's document ends
    at = np.arange(len(word))
    for k in range(SHINGLE):
        value += np.where(at + k < last, padded[k:k + len(word)] * TURN[k], np.uint64(0))
    first = last - words[doc_of_word]
    value = mix(value)[(at + SHINGLE <= last) | (at == first)]
    count = np.where(words > 0, np.maximum(words - SHINGLE + 1, 1), 0)
    out, sizes, k = [], np.zeros(len(texts), np.int64), 0
    for d, n in enumerate(count.tolist()):
        if n:
            s = np.sort(value[k:k + n])
            s = s[np.concatenate([[True], s[1:] != s[:-1]])]
            out.append(s)
            sizes[d] = len(s)
            k += n
    return np.concatenate(out), sizes


def sketch(s: np.ndarray) -> np.ndarray:
    """256 bits, one of the least hash in each of 256 equal ranges; an empty range borrows another's."""
    bins = (s >> np.uint64(56)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], bins[1:] != bins[:-1]]))
    bit = np.full(BITS, -1, np.int8)
    bit[bins[first]] = (mix(s[first]) >> np.uint64(63)).astype(np.int8)
    full = bit.copy()
    empty, k = np.flatnonzero(bit < 0), 0
    while len(empty):
        bit[empty] = full[PROBE[empty, k % PROBE.shape[1]]] if k < PROBE.shape[1] else full[bins[first[0]]]
        empty, k = empty[bit[empty] < 0], k + 1
    return np.packbits(bit.astype(np.uint8)).view(np.int64)


def chosen(sets: np.ndarray, sizes: np.ndarray, paths: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Extend ``paths`` (each of the set ``owner``) by one shingle: the new paths and which path each extends."""
    ends = np.cumsum(sizes)
    out, source = [], []
    limit = np.where(sizes > 0, (2.0**64 / (LEVEL * np.maximum(sizes, 1))), 0)
    limit = np.minimum(limit, np.nextafter(2.0**64, 0)).astype(np.uint64)
    for i, (path, o) in enumerate(zip(paths, owner.tolist(), strict=True)):
        s = sets[ends[o] - sizes[o]:ends[o]]
        h = mix(s ^ path)
        new = h[h <= limit[o]]
        if len(new):
            out.append(mix(new + path))
            source.append(np.full(len(new), i))
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(out), np.concatenate(source)


def pieces(texts: list[bytes | None]):
    """Ranges of texts of about PIECE_BYTES."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        if size > PIECE_BYTES:
            yield begin, i
            begin, size = i, 0
        size += len(t or b"")
    if begin < len(texts):
        yield begin, len(texts)


def text_marks(text: str) -> list:
    """hash and size, which tell texts apart; a null text has the size -1."""
    value = F.col(f"`{text}`")
    return [F.xxhash64(value).alias("hash"), F.coalesce(F.length(value), F.lit(-1)).alias("size")]


def sets_of(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Per document: row (unique), key, hash and size of the text, class (equal for equal sets, null without
    words), n, the sketch in four numbers, the paths of depth 1 and the set. Frozen."""
    spark = docs.sparkSession
    small_batches(spark)
    runs = repeats()
    roots = mix(np.arange(1, runs + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    narrow = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("binary").alias("text"), *text_marks(text))
    kind = narrow.schema["key"].dataType.simpleString()

    def make(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for begin, end in pieces(texts):
                sets, sizes = shingle_sets(texts[begin:end])
                ends = np.cumsum(sizes)
                key_of, which = _first_paths(sets, sizes, roots)
                rows = []
                path_ends = np.searchsorted(which, np.arange(len(sizes)), "right")
                path_at = 0
                for d in range(end - begin):
                    s = sets[ends[d] - sizes[d]:ends[d]]
                    if len(s):
                        # 128 bits of the set: equal keys are equal sets, however many there are
                        sums = [np.add.reduce(mix(s)) + np.uint64(len(s)), np.add.reduce(mix(~s)) ^ np.uint64(len(s))]
                        rows.append((mix(np.array(sums, np.uint64)).tobytes(), len(s), *sketch(s).tolist()))
                    else:
                        rows.append((None, 0, None, None, None, None))
                columns = list(zip(*rows, strict=True))
                offsets = pa.array(np.concatenate([[path_at], path_ends]), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c).slice(begin, end - begin) for c in (0, 2, 3)], pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.int32()),
                     *[pa.array(c, pa.int64()) for c in columns[2:]],
                     pa.ListArray.from_arrays(offsets, pa.array(key_of.view(np.int64))),
                     pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(sets.view(np.int64)))],
                    names=["key", "hash", "size", "class", "n", "s0", "s1", "s2", "s3", "paths", "shingles"])

    made = narrow.mapInArrow(lean(make), f"key {kind}, hash long, size int, class binary, n int, s0 long, s1 long, s2 long, s3 long, paths array<long>, shingles array<long>")
    return freeze(made.withColumn("row", F.monotonically_increasing_id()), "sets")


def _first_paths(sets: np.ndarray, sizes: np.ndarray, roots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The paths of depth 1 of every run, by text."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    limit = np.minimum(2.0**64 / (LEVEL * np.maximum(sizes, 1)), np.nextafter(2.0**64, 0)).astype(np.uint64)[owner]
    found, which = [], []
    for root in roots:
        h = mix(sets ^ root)
        at = np.flatnonzero(h <= limit)
        found.append(mix(h[at] + root))
        which.append(owner[at])
    found, which = np.concatenate(found), np.concatenate(which)
    order = np.argsort(which, kind="stable")
    return found[order], which[order]


def close(a: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether sets i and j may be similar: sizes in proportion and sketches near."""
    n, m = a["n"][i], a["n"][j]
    low, high = np.minimum(n, m), np.maximum(n, m)
    fit = np.flatnonzero(low * LEVEL_BOTTOM >= high * LEVEL_TOP)
    # unsigned: bitwise_count takes the absolute value of signed numbers
    differ = sum(np.bitwise_count((a[s][i[fit]] ^ a[s][j[fit]]).view(np.uint64)).astype(np.int32) for s in ("s0", "s1", "s2", "s3"))
    return fit[differ <= np.where(low[fit] <= SMALL_SET, MOST_BITS_SMALL, MOST_BITS)]


#: proposals are (node, node) rows
BUCKET_SCHEMA = "a long, b long"


def compare_buckets(rows: DataFrame, last: bool, tasks: int) -> DataFrame:
    """Brute force in buckets; ``rows`` has none of more than SMALL sets or, if ``last``, pairs of blocks."""
    fields = ["path", "node", "n", "s0", "s1", "s2", "s3"]
    extra = ["_i", "_j", "_mine"] if last else []
    keys = ["path", *extra[:2]]
    columns = [*keys, *[f for f in fields if f not in keys], *extra[2:]]
    ordered = rows.select(columns).repartition(tasks, *keys).sortWithinPartitions(*keys)

    def run(batches):
        forest = graph.Forest()
        for table in graph.runs(batches, len(keys)):
            a = {c: table.column(c).to_numpy() for c in columns}
            change = np.zeros(table.num_rows, bool)
            change[0] = True
            for k in keys:
                change[1:] |= a[k][1:] != a[k][:-1]
            group = np.cumsum(change) - 1
            size = np.bincount(group)
            i = np.flatnonzero(size[group] > 1)
            step = 1
            while len(i):
                i = i[i + step < len(group)]
                i = i[group[i] == group[np.minimum(i + step, len(group) - 1)]]
                j = i + step
                if last:  # across two blocks only pairs with one in each; in one block all
                    cross = (a["_i"][i] == a["_j"][i]) | (a["_mine"][i] != a["_mine"][j])
                    p, q = i[cross], j[cross]
                else:
                    p, q = i, j
                near = close(a, p, q)
                if len(near):
                    forest.link(a["node"][p[near]], a["node"][q[near]])
                step += 1
        nodes, roots = forest.star()
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots)], names=["a", "b"])

    return ordered.mapInArrow(lean(run), BUCKET_SCHEMA)


def propose(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b: links between sets that may be similar, a star for each group that a task found.

    Buckets are counted before they are grouped, so that one of more than SMALL sets never meets in a task:
    its rows go on to the next depth as they lie, and at DEPTH they are cut in blocks.
    """
    signs = nodes.select("node", "n", "s0", "s1", "s2", "s3")
    rows = nodes.select(F.explode("paths").alias("path"), "node", "n", "s0", "s1", "s2", "s3")
    links, waiting = None, nodes.count() * 2 * repeats()  # a set follows under two paths in each run
    for depth in range(1, DEPTH + 1):
        last = depth == DEPTH
        if last:
            rows = graph.in_block_pairs(freeze(rows.join(signs, "node"), "paths", waiting), "path", "node", "n", 1 << 60, BLOCK_SETS, waiting)
            small = rows
        else:
            large = hold(rows.groupBy("path").agg(F.count("*").alias("_n")).where(F.col("_n") > SMALL).select("path"))
            large = F.broadcast(large) if large.count() * PATH_BYTES <= BROADCAST_BYTES else large
            small = rows.join(large, "path", "left_anti")
            if depth > 1:
                small = small.join(signs, "node")
        fresh = freeze(compare_buckets(small, last, graph.tasks_for(waiting, PATHS_A_TASK)), "buckets", waiting)
        links = fresh if links is None else links.union(fresh)
        if last:
            break
        left = freeze(rows.select("path", "node").join(large, "path", "left_semi"), "split", waiting)
        waiting = left.count()
        if not waiting:
            break
        rows = extend(left, waiting, sets)
        if depth + 1 < DEPTH:
            rows = freeze(rows, "paths")
    return links


def extend(left: DataFrame, waiting: int, sets: DataFrame) -> DataFrame:
    """The paths one shingle longer: path, node."""
    # a node has at most a few paths in each run
    per_node = left.groupBy("node").agg(F.collect_list("path").alias("paths"))
    whole = sets.select(F.col("row").alias("node"), "shingles")
    if waiting * PATH_BYTES <= BROADCAST_BYTES:
        joined = whole.join(F.broadcast(per_node), "node")
    else:
        joined = whole.join(per_node, "node")

    def run(batches):
        for batch in batches:
            node, lists = batch.column("node").to_numpy(), batch.column("shingles")
            shingles = lists.flatten().to_numpy().view(np.uint64)
            sizes = np.diff(lists.offsets.to_numpy())
            paths = batch.column("paths")
            owner = np.repeat(np.arange(len(node)), np.diff(paths.offsets.to_numpy()))
            new, source = chosen(shingles, sizes, paths.flatten().to_numpy().view(np.uint64), owner)
            yield pa.RecordBatch.from_arrays([pa.array(new.view(np.int64)), pa.array(node[owner[source]])], names=["path", "node"])

    return joined.select("node", "shingles", "paths").mapInArrow(lean(run), "path long, node long")


def exact(table: pa.Table, forest: graph.Forest):
    """Check all pairs of a group of sets, or of two blocks of one; counts links by the weight of the other side."""
    node, weight, mine = (table.column(c).to_numpy() for c in ("node", "weight", "_mine"))
    i, j = table.column("_i")[0].as_py(), table.column("_j")[0].as_py()
    lists = table.column("shingles").combine_chunks()
    values, size = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
    owner = np.repeat(np.arange(len(node)), size)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    new = np.concatenate([[True], values[1:] != values[:-1]])
    code = np.cumsum(new) - 1
    shared = np.bincount(code) > 1  # a shingle of one set only is in no intersection
    keep = shared[code]
    code, owner = (np.cumsum(shared) - 1)[code[keep]], owner[keep]
    both = np.zeros((len(node), len(node)), np.float32)
    for begin in range(0, int(shared.sum()), COLUMNS):
        lo, hi = np.searchsorted(code, [begin, begin + COLUMNS])
        matrix = np.zeros((len(node), min(COLUMNS, int(shared.sum()) - begin)), np.float32)
        matrix[owner[lo:hi], code[lo:hi] - begin] = 1
        both += matrix @ matrix.T
    common = both.astype(np.int64)
    linked = common * LEVEL_BOTTOM >= LEVEL_TOP * (size[:, None] + size[None, :] - common)
    np.fill_diagonal(linked, False)
    if i != j:
        linked &= mine[:, None] != mine[None, :]
    a, b = np.nonzero(np.triu(linked))
    if not len(a):
        return None
    forest.link(node[a], node[b])
    return node, linked @ weight


def linked(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """The sets, and per class: class, n_links, and first, the document of the smallest key (ties: the
    smallest hash and size of the text) that can be reached over links, keys that are null last."""
    sets = sets_of(docs, key, text)
    rows_in = sets.count()
    kinds = freeze(sets.where("class is not null").groupBy("class").agg(
        F.min("row").alias("node"), F.count("*").alias("weight"), F.min(F.struct(F.col("key").isNull().alias("none"), "key", "hash", "size")).alias("least")), "classes", rows_in)
    narrow = sets.select(F.col("row").alias("node"), "n", "s0", "s1", "s2", "s3", "paths")
    nodes = freeze(kinds.select("node").join(narrow, "node"), "nodes", 4 * rows_in)
    links = freeze(propose(nodes, sets), "proposals", rows_in)
    proposed = graph.components(links, links.count())
    # equal sets need no check; the rest of each component is compared in full
    members = freeze(proposed.join(kinds.select("node", "weight"), "node"), "members", links.count())
    whole = sets.select(F.col("row").alias("node"), "n", "shingles")
    many = members.count()
    few = many * 2 * PATH_BYTES <= BROADCAST_BYTES
    rows = whole.join(F.broadcast(members) if few else members, "node")
    dealt = graph.in_block_pairs(freeze(rows, "members"), "component", "node", "n", BLOCK_SHINGLES, BLOCK_SETS, many)
    found = freeze(graph.found_in_groups(dealt, ["component", "_i", "_j"], ["node", "weight", "_mine", "shingles"], exact,
                                         graph.tasks_for(many, SETS_A_TASK)), "links", 10 * many)
    top = graph.components(found.where("b is not null").select("a", "b"), many)
    links = found.where("links > 0").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("more"))
    placed = kinds.join(top, "node", "left").join(links, "node", "left").withColumn("component", F.coalesce("component", "node"))
    placed = freeze(placed, "placed", rows_in)
    least = placed.groupBy("component").agg(F.min("least").alias("first"))
    return sets, placed.join(least, "component").select(
        "class", "first", (F.col("weight") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"))


def join(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, class_id, n_links.

    Two documents are linked if the Jaccard similarity of their shingle sets is at least 0.8. n_links
    counts the other documents linked directly, copies included; class_id is the smallest key that can be reached
    over links. A null or empty text, or one without words, has no links and its own key as class_id.
    Null keys don't count as smallest; repeated rows are linked to each other.
    """
    sets, placed = linked(docs, key, text)
    return (sets.select("key", "class").join(placed, "class", "left")
            .select(F.col("key").alias(key), F.when(F.col("class").isNull(), F.col("key")).otherwise(F.col("first.key")).alias("class_id"),
                    F.coalesce("n_links", F.lit(0)).alias("n_links")))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the near copies: of each group that links connect, one document stays, the one with
    the smallest key; of several texts under that key the one with the smallest hash. Null keys come last.
    Repeated rows (equal key and text) become one; documents without words or a key stay."""
    sets, placed = linked(docs, key, text)
    mine = F.struct(F.col("key").isNull().alias("none"), "key", "hash", "size")
    rows = sets.select("key", "hash", "size", "class").join(placed.select("class", "first"), "class", "left")
    marks = [F.col("key").alias("_key"), F.col("hash").alias("_hash"), F.col("size").alias("_size")]
    gone = _bounded(rows.where(F.col("first").isNotNull() & ~mine.eqNullSafe(F.col("first"))).select(marks).distinct())
    again = hold(rows.where("class is not null or key is not null").groupBy(marks).agg(F.count("*").alias("_n"))
                 .where("_n > 1").select("_key", "_hash", "_size"))
    marked = packed(docs, text).withColumn("key", F.col("doc")[key])
    marked = marked.withColumns({f"its_{n}": c for c, n in zip(text_marks("text"), ("hash", "size"), strict=True)})

    def same(other: DataFrame):
        return (F.col("key").eqNullSafe(other["_key"]) & (F.col("its_hash") == other["_hash"]) & (F.col("its_size") == other["_size"]))

    kept = marked.join(gone, same(gone), "left_anti")
    if again.count():
        again = _bounded(again)
        once = kept.join(again, same(again), "left_semi").dropDuplicates(["key", "text"])
        kept = kept.join(again, same(again), "left_anti").union(once)
    return kept.select(*unpacked(kept, docs.columns, text))


def _bounded(keys: DataFrame) -> DataFrame:
    """A table of keys, marked for broadcast if it is small."""
    keys = hold(keys)
    return F.broadcast(keys) if keys.count() * PATH_BYTES <= BROADCAST_BYTES else keys

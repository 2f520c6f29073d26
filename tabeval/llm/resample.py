"""Importance resampling towards a target set, with hashed word n-grams.

The words of a document, joined by one space, are scanned once: ``crc32`` goes on from word to word, so
the checksum of every prefix that ends at a word is known, and one more byte gives the one after its space.
CRCs are linear over GF(2): crc(AB) = shift(crc(A), bytes of B) xor crc(B), where the shift multiplies by a
power of x. So the checksum of any n-gram follows from those of two prefixes, without its bytes.

Counts of buckets over all documents and all target texts give each bucket a gain (the log of the ratio
of its smoothed shares). Documents are drawn by the Gumbel-top-k rule: mean gain plus hashed noise.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import named
from ..operators.ordered import prefix_sum
from .common import add_by_text, freeze, small_batches

BUCKETS, N, MIN_WORDS, PERCENT, SEED = 10_000, 2, 20, 25, 7
#: bytes of a text looked at at once, so that one long text can't fill the memory
PIECE = 1 << 20
#: the polynomial of CRC-32, lowest power first
POLYNOMIAL = 0xEDB88320
#: A-Z to a-z; other ASCII but digits and letters to a space; bytes of longer characters stay
SEPARATED = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def byte_table() -> np.ndarray:
    """The register after one byte, for each lowest byte of a register."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(POLYNOMIAL), t >> 1).astype(np.uint32)
    return t


class Shift:
    """Checksums moved on by zero bytes: x^(8n) times a register, for n by the bits of a length.

    A map is four tables, one per byte of the register; squaring it doubles its length.
    """

    def __init__(self) -> None:
        t, low = byte_table(), np.arange(256, dtype=np.uint32)
        # one zero byte: (r >> 8) ^ t[r & 255]
        self.maps = [np.stack([t, low, low << 8, low << 16]).astype(np.uint32)]

    @staticmethod
    def apply(m: np.ndarray, r: np.ndarray) -> np.ndarray:
        return m[0][r & 255] ^ m[1][(r >> 8) & 255] ^ m[2][(r >> 16) & 255] ^ m[3][r >> 24]

    def by(self, r: np.ndarray, n: np.ndarray) -> np.ndarray:
        """``r`` moved on by ``n`` zero bytes, element by element."""
        r, bit = r.astype(np.uint32), 0
        most = int(n.max()) if len(n) else 0
        while most >> bit:
            if bit == len(self.maps):
                self.maps.append(np.stack([self.apply(self.maps[-1], row) for row in self.maps[-1]]))
            on = (n >> bit) & 1 == 1
            r[on] = self.apply(self.maps[bit], r[on])
            bit += 1
        return r


def pieces(text: str | None, size: int = PIECE) -> Iterator[list[bytes]]:
    """The words of a text, lower-cased, some at a time; no word is cut. A null text has none."""
    data, at = (text or "").encode().translate(SEPARATED), 0
    while at < len(data):
        end = data.find(b" ", at + size)
        end = len(data) if end < 0 else end
        words = data[at:end].split()
        if words:
            yield words
        at = end


def running(words: list[bytes], crc: int, first: bool) -> list[int]:
    """The checksum after each word; ``crc`` is that of all before, and a space parts words."""
    spaced = [b" " + w for w in words]
    if first:
        spaced[0] = words[0]
    return list(accumulate(spaced, lambda c, w: zlib.crc32(w, c), initial=crc))[1:]


class Ngrams:
    """The checksums of all runs of 1 to ``n`` words of many texts."""

    def __init__(self, n: int = N, piece: int = PIECE) -> None:
        self.n, self.piece, self.shift, self.table = n, piece, Shift(), byte_table()

    def blocks(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]]:
        """Text number, place, checksum at the end and bytes of each word, for blocks of words; the first
        words of a block, as many as told, were in the last one too: n, as a run of n words starts where the word before it ends."""
        held, size = [], 0
        tail = [np.zeros(0, np.int64)] * 4
        for number, text in enumerate(texts):
            place, crc = 0, 0
            for words in pieces(text, self.piece):
                ends = running(words, crc, place == 0)
                held.append((np.full(len(words), number), np.arange(place, place + len(words)),
                             np.array(ends, np.int64), np.fromiter(map(len, words), np.int64, len(words))))
                place, crc, size = place + len(words), ends[-1], size + sum(map(len, words))
                if size >= self.piece:
                    block = [np.concatenate([t, *new]) for t, new in zip(tail, zip(*held))]
                    yield *block, len(tail[0])
                    tail, held, size = [x[-self.n:] for x in block], [], 0
        if held:
            yield *[np.concatenate([t, *new]) for t, new in zip(tail, zip(*held))], len(tail[0])

    def of(self, texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Length in words, text numbers and checksums of the n-grams, block by block."""
        for number, place, end, size, old in self.blocks(texts):
            before = np.concatenate([[0], end[:-1]]).astype(np.uint32) ^ np.uint32(0xFFFFFFFF)
            # the prefix up to a word's start: the one before, and a space
            start = (before >> 8) ^ self.table[(before ^ np.uint32(32)) & 255] ^ np.uint32(0xFFFFFFFF)
            start[place == 0] = 0
            total = np.concatenate([[0], np.cumsum(size)])
            for m in range(1, self.n + 1):
                last = np.arange(old, len(place))
                last = last[place[last] >= m - 1]  # the words before it are of the same text
                opened = last - (m - 1)
                yield m, number[last], end[last].astype(np.uint32) ^ self.shift.by(
                    start[opened], total[last + 1] - total[opened] + (m - 1))


def bucket_counts(docs: DataFrame, text: str = "text", n: int = N, buckets: int = BUCKETS) -> list[int]:
    """How many n-grams of all texts fall in each bucket; tasks add up their own before anything moves."""
    small_batches(docs.sparkSession)

    def count(batches):
        found, grams = np.zeros(buckets, np.int64), Ngrams(n)
        for batch in batches:
            for _, _, crc in grams.of(batch.column(0).to_pylist()):
                found += np.bincount(crc % np.uint32(buckets), minlength=buckets)
        at = np.nonzero(found)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(found[at], pa.int64())], names=["bucket", "n"])

    parts = docs.select(named(text).alias("text")).mapInArrow(count, "bucket long, n long")
    out = [0] * buckets
    for row in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most ``buckets`` rows
        out[row["bucket"]] = row["n"]
    return out


def gains(source: list[int], target: list[int]) -> np.ndarray:
    """floor(1000 ln) of the ratio of a bucket's share of the target to its share of the source, with one
    more count in each bucket."""
    s, t, k = float(sum(source)), float(sum(target)), float(len(source))
    return np.array([math.floor(1000 * math.log((b + 1.0) * (s + k) / ((a + 1.0) * (t + k)))) for a, b in zip(source, target)], np.int64)


def weights(docs: DataFrame, text: str, gain: np.ndarray, n: int = N) -> DataFrame:
    """Replace column ``text`` by n_words, n_features and weight, the floored mean of its n-grams' gains
    (0 without any)."""
    buckets = len(gain)

    def make() -> Callable[[list[str | None]], list[np.ndarray]]:
        grams = Ngrams(n)

        def work(texts: list[str | None]) -> list[np.ndarray]:
            words, features, total = (np.zeros(len(texts), np.int64) for _ in range(3))
            for m, number, crc in grams.of(texts):
                found = np.bincount(number, minlength=len(texts))
                features += found
                if m == 1:
                    words += found
                # sums of whole numbers, exact in doubles up to 2^53
                total += np.bincount(number, weights=gain[crc % np.uint32(buckets)], minlength=len(texts)).astype(np.int64)
            return [words, features, np.where(features > 0, total // np.maximum(features, 1), 0)]
        return work

    return add_by_text(docs, text, "n_words long, n_features long, weight long", make)


def noise(key: Column, seed: int = SEED) -> Column:
    """floor(1000 times a Gumbel variable) from the first 8 hex digits of a SHA-256 of the key."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def draw(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT,
         min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """One row per document: key, n_words, n_features, weight, score, and the rank of those drawn.

    Words are runs of letters, digits and characters beyond ASCII, A-Z lower-cased. Null and empty texts
    have no features and the weight 0; without target texts the gains say how rare a bucket is. Of the N
    documents of at least ``min_words`` words, floor(percent N / 100) are drawn, highest score first,
    ties by key (null first), then as the rows were written. An empty table gives no rows.
    """
    gain = gains(bucket_counts(docs, text), bucket_counts(target, text))
    rows = weights(docs.select(named(key).alias("k"), named(text).alias("text")), "text", gain)
    scored = freeze(rows.withColumn("score", F.col("weight") + noise(F.col("k"), seed)).withColumns(
        {"down": -F.col("score"), "one": F.lit(1).cast("long"), "row": F.monotonically_increasing_id()}), "scored")
    able = scored.where(F.col("n_words") >= min_words)
    take = able.count() * percent // 100
    placed = prefix_sum(able, [], ["down", "k", "row"], ["one"], prefix="place_", frozen=True)
    placed = placed.withColumn("rank", F.when(F.col("place_one") <= take, F.col("place_one"))).drop("place_one")
    short = scored.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    return placed.unionByName(short).select(F.col("k").alias(key), "n_words", "n_features", "weight", "score", "rank")

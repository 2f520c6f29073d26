"""Benchmark decontamination with an FM-index per shard of documents.

A task indexes its documents shard by shard. The shard's words, as numbers in the benchmark's
vocabulary, are suffix-sorted; the Burrows-Wheeler transform goes into a wavelet matrix whose ranks
drive a backward search of all benchmark phrases at once. Occurrences are located by walking back to
sampled suffix positions and merged to removal spans.

Words that no phrase has cannot be part of an occurrence, so they are not numbered: they end a run, and
runs shorter than the shortest phrase are left out of the index. This loses nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import freeze, lean, packed, small_batches, unpacked

#: consecutive words of an item that make a phrase
WINDOW = 10
#: bytes of benchmark texts searched at once; a larger benchmark takes a pass for each such block
BLOCK_BYTES = 4 << 20
#: a shard ends after so many bytes of text
SHARD_BYTES = 4 << 20
#: every so many positions a suffix position is kept
SAMPLE = 8
#: A-Z become lower case; other ASCII that is no digit or letter ends a word
FOLD = bytes(b if b > 127 else ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(256))
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words(text: bytes | None) -> list[bytes]:
    return text.translate(FOLD).split() if text else []


@dataclass
class Phrases:
    """A block of the benchmark: its vocabulary (from 1) and distinct windows with the items they are in."""

    vocabulary: dict[bytes, int]
    windows: list[tuple[int, ...]]
    items: list[list[str]]

    @classmethod
    def of(cls, rows: Iterable[tuple[str | None, str | None]]) -> Phrases:
        vocabulary: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str]] = {}
        for item, text in rows:
            ids = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words((text or "").encode("utf-8", "replace"))]
            for i in range(max(1, len(ids) - WINDOW + 1) if ids else 0):
                found.setdefault(tuple(ids[i:i + WINDOW]), set()).update([] if item is None else [item])
        return cls(vocabulary, list(found), [sorted(x) for x in found.values()])


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Of numbers whose zeros are separators (the last is one); separators sort first, by place, so no
    comparison goes beyond one. Prefix doubling."""
    n = len(text)
    zero = text == 0
    rank = np.where(zero, np.cumsum(zero) - 1, text.astype(np.int64) + zero.sum())
    step = 1
    while True:
        ahead = np.zeros(n, np.int64)
        ahead[:n - step if step < n else 0] = rank[step:]
        key = rank * (int(rank.max()) + 2) + ahead
        order = np.argsort(key)
        new = np.zeros(n, np.int64)
        new[order[1:]] = np.cumsum(key[order[1:]] != key[order[:-1]])
        if new[order[-1]] == n - 1 or step >= n:
            return order
        rank, step = new, step * 2


class Index:
    """FM-index of a sequence of numbers (zeros are separators, the last is one)."""

    def __init__(self, text: np.ndarray):
        n = len(text)
        order = suffix_array(text)
        last = text[order - 1]
        self.bits = max(1, int(text.max()).bit_length())
        self.ones, self.zeros = [], []
        sequence = last
        for level in range(self.bits - 1, -1, -1):  # the wavelet matrix, highest bit first
            bit = (sequence >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(int(n - self.ones[-1][-1]))
            sequence = np.concatenate([sequence[bit == 0], sequence[bit == 1]])
        symbols = np.arange(int(text.max()) + 1)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(symbols)))])[:-1]
        self.base = self._descend(symbols, np.zeros(len(symbols), np.int64))
        # runs' first positions are sampled too: no walk crosses a separator
        begins = np.concatenate([[True], text[:-1] == 0])
        self.sampled = (order % SAMPLE == 0) | begins[order]
        self.samples = order[self.sampled]
        self.place = np.cumsum(self.sampled) - 1
        self.size = n

    def _descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            bit = (symbol >> (self.bits - 1 - level)) & 1
            before = ones[at]
            at = np.where(bit == 1, zeros + before, at - before)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs in the transform's first ``at`` places."""
        return self._descend(symbol, at) - self.base[symbol]

    def back(self, row: np.ndarray) -> np.ndarray:
        """The rows of the suffixes that begin one place earlier."""
        symbol, at = np.zeros(len(row), np.int64), row
        for level, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            before = ones[at]
            bit = ones[at + 1] - before
            symbol = symbol * 2 + bit
            at = np.where(bit == 1, zeros + before, at - before)
        return self.first[symbol] + at - self.base[symbol]

    def search(self, phrases: list[tuple[int, ...]]) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of all phrases, by backward search, one word of each at a time."""
        size = np.array([len(p) for p in phrases])
        table = np.zeros((len(phrases), int(size.max())), np.int64)  # phrases from their last word
        for i, p in enumerate(phrases):
            table[i, :len(p)] = p[::-1]
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.size, np.int64)
        high[(table >= len(self.first)).any(axis=1)] = 0
        for k in range(table.shape[1]):
            live = np.flatnonzero((size > k) & (low < high))
            if not len(live):
                break
            symbol = table[live, k]
            low[live] = self.first[symbol] + self.rank(symbol, low[live])
            high[live] = self.first[symbol] + self.rank(symbol, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of the rows' suffixes."""
        rows, out, todo, walked = rows.copy(), np.zeros(len(rows), np.int64), np.arange(len(rows)), 0
        while len(todo):
            here = self.sampled[rows[todo]]
            found = todo[here]
            out[found] = self.samples[self.place[rows[found]]] + walked
            todo = todo[~here]
            rows[todo] = self.back(rows[todo])
            walked += 1
        return out


def long_runs(ids: np.ndarray, least: int) -> np.ndarray:
    """Positions in runs of at least ``least`` non-zero numbers, each run followed by its zero
    (``ids`` ends with one)."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], (ids != 0).view(np.int8), [0]])))
    begin, end = edges[::2], edges[1::2]
    keep = end - begin >= least
    begin, size = begin[keep], (end - begin)[keep] + 1
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())


def search_shard(texts: list[bytes | None], phrases: Phrases) -> tuple[list[int], list[list[tuple[int, int]]], list[list[str]]]:
    """Per text: how many words it has, merged spans (first word, word after the last) and the items."""
    get = phrases.vocabulary.get
    parts = []
    for t in texts:  # one text's words at a time: as Python objects they are many times the text
        w = words(t)
        parts.append(np.fromiter(map(get, w, repeat(0)), np.int32, len(w)))
    sizes = [len(p) for p in parts]
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    items: list[set[str]] = [set() for _ in texts]
    zero = np.zeros(1, np.int32)
    ids = np.concatenate([x for p in parts for x in (p, zero)]) if parts else zero
    starts = np.cumsum([0] + [n + 1 for n in sizes])
    kept = long_runs(ids, min(map(len, phrases.windows), default=1)) if phrases.windows else np.zeros(0, np.int64)
    if len(kept):
        text = ids[kept]
        index = Index(text)
        low, high = index.search(phrases.windows)
        count = np.maximum(high - low, 0)
        which = np.repeat(np.arange(len(count)), count)
        rows = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())
        at = index.locate(rows)
        size = np.array([len(p) for p in phrases.windows])[which]
        cover = np.zeros(len(text) + 1, np.int64)
        np.add.at(cover, at, 1)
        np.add.at(cover, at + size, -1)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], (np.cumsum(cover)[:-1] > 0).view(np.int8), [0]])))
        for begin, end in zip(kept[edges[::2]], kept[edges[1::2] - 1] + 1, strict=True):
            doc = int(np.searchsorted(starts, begin, "right")) - 1
            spans[doc].append((int(begin - starts[doc]), int(end - starts[doc])))
        docs = np.searchsorted(starts, kept[at], "right") - 1
        pairs = np.sort(docs * len(count) + which)
        for pair in pairs[np.concatenate([[True], pairs[1:] != pairs[:-1]])] if len(pairs) else ():
            items[pair // len(count)].update(phrases.items[pair % len(count)])
    return sizes, spans, [sorted(x) for x in items]


def merged(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s in sorted(a + b):
        if out and s[0] < out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], s[1]))
        else:
            out.append(s)
    return out


def cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without its spans of words, from the first letter of each to the last."""
    places = [m.span() for m in WORD.finditer(text.translate(FOLD))]
    out, at = [], 0
    for begin, end in spans:
        out.append(text[at:places[begin][0]])
        at = places[end - 1][1]
    return b"".join([*out, text[at:]])


def scrub(text: bytes, spans: list[tuple[int, int]], phrases: Phrases) -> bytes:
    """Cut the spans, and again where what is left makes a new phrase."""
    known = set(phrases.windows)
    while spans:
        text, spans = cut(text, spans), []
        ids = [phrases.vocabulary.get(w, 0) for w in words(text)]
        for size in {len(p) for p in known}:
            spans = merged(spans, [(i, i + size) for i in range(len(ids) - size + 1) if tuple(ids[i:i + size]) in known])
    return text


def blocks(benchmark: DataFrame) -> list[Phrases]:
    """The benchmark in blocks of about BLOCK_BYTES, each read to the driver on its own."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where(F.col("text").isNotNull())
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // BLOCK_BYTES)
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(max(n, 1)))
    return [Phrases.of(sorted((tuple(r) for r in rows.where(part == k).collect()), key=lambda r: (r[0] is None, r))) for k in range(n)]


SPAN_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def find(docs: DataFrame, benchmark: DataFrame, text: str = "text", clean: bool = False) -> DataFrame:
    """``docs`` with _words (number of words), _spans (merged spans of hit words) and _items (ids of the
    items found, sorted as strings); with ``clean``, the spans are cut out of the text.

    Null and empty texts have no words. An item without an id marks words but isn't listed; one without
    words has no phrase. Repeated rows are treated alike. Without documents or phrases there are no hits.
    """
    spark = docs.sparkSession
    small_batches(spark)
    out = docs.withColumns({"_words": F.lit(0).cast("long"), "_spans": F.array().cast("array<struct<start:int,end:int>>"),
                            "_items": F.array().cast("array<string>")})
    found = blocks(benchmark) or [Phrases({}, [], [])]
    for k, phrases in enumerate(found):
        out = _search(out, phrases, text, clean)
        if k + 1 < len(found):
            out = freeze(out, "decontaminate")
    return out


def _search(docs: DataFrame, phrases: Phrases, text: str, clean: bool) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast((phrases.vocabulary, phrases.windows, phrases.items))  # one block
    at, schema = docs.columns.index(text), docs.schema

    def run(batches):
        block = Phrases(*shared.value)
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.column(at).nbytes
            if size >= SHARD_BYTES:
                yield from shard(held, block)
                held, size = [], 0
        if held:
            yield from shard(held, block)

    def shard(held, block):
        column = pa.chunked_array([b.column(at) for b in held]).cast(pa.binary())
        sizes, spans, items = search_shard(column.to_pylist(), block)
        k = 0
        for batch in held:
            rows = slice(k, k := k + batch.num_rows)
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            old = [[(s["start"], s["end"]) for s in x] for x in columns["_spans"].to_pylist()]
            if clean:
                texts = [scrub(t, s, block) if s else t for t, s in zip(batch.column(at).cast(pa.binary()).to_pylist(), spans[rows], strict=True)]
                columns[text] = pa.array(texts, pa.binary()).cast(batch.schema.field(at).type)
            columns["_words"] = pa.array(sizes[rows], pa.int64())
            columns["_spans"] = pa.array([[{"start": b, "end": e} for b, e in merged(a, s)] for a, s in zip(old, spans[rows], strict=True)], SPAN_TYPE)
            columns["_items"] = pa.array([sorted({*a, *s}) for a, s in zip(columns["_items"].to_pylist(), items[rows], strict=True)], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return docs.mapInArrow(lean(run), schema)


def report(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_words, n_hit, n_items, items_sha256, contaminated: one row per document."""
    found = find(docs.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").alias("text")), benchmark)
    hit = F.aggregate("_spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(key, F.col("_words").alias("n_words"), hit.alias("n_hit"), F.size("_items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("_items", ","), 256).alias("items_sha256"), (F.size("_spans") > 0).alias("contaminated"))


def remove(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the benchmark's passages: spans are cut out of the texts, everything else stays."""
    found = find(packed(docs, text), benchmark, clean=True)
    return found.select(*unpacked(found, docs.columns, text))

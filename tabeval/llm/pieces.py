"""SentencePiece encoding and decoding with a given vocabulary.

An Aho-Corasick automaton over the pieces reads the text once. At each position it reports every piece
that ends there (its output links), and each relaxes the best score of a segmentation up to there: a
single-pass Viterbi for the segmentation of the largest score sum. Characters without a piece of their
own cost less than the worst piece and become UTF-8 byte pieces.

Scores are log-probabilities; those of a model of merges follow from the merges' ranks. Tokenizers aren't trained.

Where no piece holds a word mark after another character, no segmentation crosses the start of a word,
so words are segmented one by one and a task remembers those it has seen.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import add_by_text

MARK = "▁"
#: an unknown character scores this much under the lowest piece
UNKNOWN_PENALTY = 10.0
NEVER = float("-inf")
#: words remembered by a task; longer ones are segmented anew
MEMORY, MEMORY_CHARS = 200_000, 48


@dataclass
class Vocabulary:
    pieces: list[str]
    scores: list[float]
    kinds: str  # per piece: n ordinary, b byte, x control, unknown or unused

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """Read a model file (on the driver). Models that rewrite the text are refused."""
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        if model.normalize("ﬁ  a") != f"{MARK}ﬁ{MARK}{MARK}a":
            raise ValueError("only models that keep the text as it is and mark its start are supported")
        ids = range(model.get_piece_size())
        kinds = "".join("b" if model.is_byte(i) else "x" if model.is_control(i) or model.is_unknown(i) or model.is_unused(i)
                        else "n" for i in ids)
        return cls([model.id_to_piece(i) for i in ids], log_probabilities([model.get_score(i) for i in ids], kinds), kinds)


#: the law that turns merge ranks to probabilities: p(rank) in proportion to 1 / (RANK_OFFSET + rank)
RANK_OFFSET = 100.0


def log_probabilities(scores: list[float], kinds: str) -> list[float]:
    """Scores that a Viterbi may add up. A model of merges has minus the rank of each piece's merge, which is no
    probability: sums of ranks prefer many early pieces to the one that the model itself makes. Nothing is
    trained here, so ranks become probabilities by the Zipf-Mandelbrot law (merges are made in the order of
    frequency). Scores of any other model are log-probabilities already."""
    ranks = [-s for s, k in zip(scores, kinds, strict=True) if k == "n"]
    if not ranks or any(r < 0 or r != int(r) for r in ranks):
        return scores
    total = sum(1 / (RANK_OFFSET + r) for r in ranks)
    return [-math.log((RANK_OFFSET - s) * total) if k == "n" else s for s, k in zip(scores, kinds, strict=True)]


class Codec:
    """Encoder and decoder of one task."""

    def __init__(self, vocabulary: Vocabulary):
        v = self.vocabulary = vocabulary
        ordinary = [i for i, k in enumerate(v.kinds) if k == "n"]
        self.machine = ahocorasick.Automaton()
        for i in ordinary:
            self.machine.add_word(v.pieces[i], (i, len(v.pieces[i]), v.scores[i]))
        self.machine.make_automaton()
        self.bytes = [v.pieces.index(f"<0x{b:02X}>") for b in range(256)]
        self.byte_of = {i: b for b, i in enumerate(self.bytes)}
        self.unknown = min(v.scores[i] for i in ordinary) - UNKNOWN_PENALTY
        self.size = [len(p) for p in v.pieces]
        #: a character without a piece of its own
        own = "".join(re.escape(v.pieces[i]) for i in ordinary if len(v.pieces[i]) == 1)
        self.strange = re.compile(f"[^{own}]" if own else "(?s).")
        self.by_word = all(MARK not in v.pieces[i].lstrip(MARK) for i in ordinary)
        self.chunks = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+" if self.by_word else "(?s).+")
        self.known: dict[str, list[int]] = {}
        self.plain = [p.replace(MARK, " ") for p in v.pieces]

    def segment(self, text: str) -> list[int]:
        """Ids of the best segmentation of ``text`` (ties: the longest last piece)."""
        n = len(text)
        if self.strange.search(text) is not None:
            return self._segment_strange(text)
        best, back, size_of = [0.0] + [NEVER] * n, [0] * (n + 1), self.size
        for end, (i, size, score) in self.machine.iter(text):
            value = best[end + 1 - size] + score
            if value > best[end + 1]:
                best[end + 1], back[end + 1] = value, i
        ids, at = [], n
        while at:
            i = back[at]
            ids.append(i)
            at -= size_of[i]
        return ids[::-1]

    def _segment_strange(self, text: str) -> list[int]:
        """The same with an edge over each character that has no piece of its own."""
        n = len(text)
        best, back = [0.0] + [NEVER] * n, [(-1, 0)] * (n + 1)
        done, single = 0, False  # characters whose edges are all relaxed; whether the next has its own piece
        for end, (i, size, score) in self.machine.iter(text):
            while done < end:
                if not single and best[done] + self.unknown > best[done + 1]:
                    best[done + 1], back[done + 1] = best[done] + self.unknown, (-1, 1)
                done, single = done + 1, False
            value = best[end + 1 - size] + score
            if value > best[end + 1]:
                best[end + 1], back[end + 1] = value, (i, size)
            single |= size == 1
        while done < n:
            if not single and best[done] + self.unknown > best[done + 1]:
                best[done + 1], back[done + 1] = best[done] + self.unknown, (-1, 1)
            done, single = done + 1, False
        ids, at = [], n
        while at:
            i, size = back[at]
            if i >= 0:
                ids.append(i)
            else:
                ids.extend(self.bytes[b] for b in reversed(text[at - 1].encode("utf-8", "replace")))
            at -= size
        return ids[::-1]

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        out: list[int] = []
        known = self.known
        for chunk in self.chunks.findall(MARK + text.replace(" ", MARK)):
            ids = known.get(chunk)
            if ids is None:
                ids = self.segment(chunk)
                if len(chunk) <= MEMORY_CHARS:
                    if len(known) >= MEMORY:
                        known.clear()
                    known[chunk] = ids
            out += ids
        return out

    def decode(self, ids) -> str:
        """The text: bytes join to characters (broken ones become U+FFFD), control pieces vanish."""
        parts, run = [], bytearray()
        plain, kinds, byte_of = self.plain, self.vocabulary.kinds, self.byte_of
        for i in ids:
            if kinds[i] == "n":
                if run:
                    parts.append(run.decode("utf-8", "replace"))
                    run = bytearray()
                parts.append(plain[i])
            elif kinds[i] == "b":
                run.append(byte_of[i])
        parts.append(run.decode("utf-8", "replace"))
        return "".join(parts).removeprefix(" ")


def _shared(df: DataFrame, vocabulary: Vocabulary):
    """The vocabulary's size is fixed by its model file."""
    return df.sparkSession.sparkContext.broadcast((vocabulary.pieces, vocabulary.scores, vocabulary.kinds))


def encode(docs: DataFrame, vocabulary: Vocabulary, text: str = "text") -> DataFrame:
    """Replace ``text`` by ids (array of int), n_ids, and round_trip: whether decoding gives the text
    back (word marks in the text itself come back as spaces and don't count against it).

    Null and empty texts have no ids and round-trip to the empty text. Whole texts are encoded.
    """
    shared = _shared(docs, vocabulary)

    def make():
        codec = Codec(Vocabulary(*shared.value))

        def work(texts):
            ids = [codec.encode(t) for t in texts]
            sizes = np.array([len(x) for x in ids], np.int32)
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
            values = pa.array(np.fromiter((i for x in ids for i in x), np.int32, int(sizes.sum())))
            same = [codec.decode(x) == (t or "").replace(MARK, " ") for x, t in zip(ids, texts, strict=True)]
            return pa.ListArray.from_arrays(offsets, values), pa.array(sizes), same
        return work

    return add_by_text(docs, text, "ids array<int>, n_ids int, round_trip boolean", make)


def decode(tokens: DataFrame, vocabulary: Vocabulary, ids: str = "ids") -> DataFrame:
    """Replace ``ids`` by text. Null ids give the empty text; ids outside the vocabulary raise."""
    shared = _shared(tokens, vocabulary)

    def make():
        codec = Codec(Vocabulary(*shared.value))
        return lambda rows: ([codec.decode(x or ()) for x in rows],)

    return add_by_text(tokens, ids, "text string", make)


def digest(ids: Column) -> Column:
    """Lower-case hex SHA-256 of the comma-joined ids."""
    return F.sha2(F.array_join(ids.cast("array<string>"), ","), 256)

"""Language identification by a blended-spectrum string kernel.

A text is the set of its character n-grams (orders 1 to 3, presence only). Two texts' kernel is the
number of n-grams they share over the geometric mean of their set sizes. A bounded sample of labelled
documents fits one-versus-rest kernel ridge regression in the space of Nyström landmarks. Because the
kernel is an inner product of presence vectors, the landmark sum  f(x) = sum_j k(x, l_j) a_j  is one
matrix product of a batch's presence matrix with  sum_j l_j a_j / |l_j|^(1/2): the landmarks are folded
into that matrix once, on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import add_by_text, bounded_sample

ORDERS = (1, 2, 3)
BUCKETS = 1 << 15
#: bounds of the labelled sample: documents and, of these, landmarks per language
TRAIN_PER_LANG, LANDMARKS_PER_LANG = 400, 60
RIDGE = 1e-2
#: documents and characters whose presence matrix is held at once
GROUP_ROWS, GROUP_CHARS = 128, 1 << 20
UNKNOWN = "und"
#: a lower score means that every language's classifier clearly refuses the text (a margin under -0.2)
ACCEPT = 0.4
_IS_LETTER = None


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    global _IS_LETTER
    if _IS_LETTER is None:
        _IS_LETTER = np.array([chr(c).isalpha() for c in range(0x110000)])
    return _IS_LETTER


def presence(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' presence matrix (rows x BUCKETS, 0 or 1) and whether each has a letter."""
    joined = [t.lower() for t in texts]
    codes = np.frombuffer("".join(joined).encode("utf-32-le", "replace"), np.uint32)
    owner = np.repeat(np.arange(len(texts), dtype=np.int64), [len(t) for t in joined])
    matrix = np.zeros((len(texts), BUCKETS), np.float32)
    flat, has = matrix.ravel(), np.zeros(len(texts), bool)
    table = letters()
    for start in range(0, len(codes), GROUP_CHARS):  # a long text's n-grams are marked piece by piece
        piece = codes[start:start + GROUP_CHARS + max(ORDERS) - 1]
        own = owner[start:start + len(piece)]
        letter = table[piece]
        has[own[letter]] = True
        piece = np.where(letter, piece, np.uint32(32))
        value = np.zeros(len(piece), np.uint32)
        for n in ORDERS:
            value = value[:len(piece) - n + 1] * np.uint32(0x01000193) + piece[n - 1:] + np.uint32(n)
            if not len(value):
                break
            mixed = (value ^ (value >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            bucket = (mixed >> np.uint32(17)).astype(np.int64)
            inside = own[:len(bucket)] == own[n - 1:]
            flat[(own[:len(bucket)] * BUCKETS + bucket)[inside]] = 1
    return matrix, has


@dataclass
class Model:
    classes: list[str]
    weights: np.ndarray  # BUCKETS x classes

    def score(self, matrix: np.ndarray) -> np.ndarray:
        size = np.sqrt(np.maximum(matrix.sum(axis=1, keepdims=True), 1))
        return matrix @ self.weights / size


def fit(texts: list[str], langs: list[str]) -> Model:
    """Nyström kernel ridge, one against the rest. No usable text: a model without classes."""
    classes = sorted(set(langs))
    if not classes:
        return Model([], np.zeros((BUCKETS, 0), np.float32))
    y = np.array([classes.index(x) for x in langs])
    rank = np.zeros(len(y), int)  # position of each text within its language
    for c in range(len(classes)):
        rank[y == c] = np.arange((y == c).sum())
    chosen = rank < LANDMARKS_PER_LANG
    unit = lambda m: m / np.sqrt(np.maximum(m.sum(axis=1, keepdims=True), 1))
    marks = unit(presence([t for t, c in zip(texts, chosen, strict=True) if c])[0])
    cross = np.vstack([unit(presence(texts[i:i + GROUP_ROWS])[0]) @ marks.T for i in range(0, len(texts), GROUP_ROWS)])
    cross = cross.astype(np.float64)
    among = (marks @ marks.T).astype(np.float64)
    target = np.where(y[:, None] == np.arange(len(classes)), 1.0, -1.0)
    weight = 1 / np.bincount(y, minlength=len(classes))[y][:, None]  # each language counts the same
    left = cross.T @ (weight * cross) + RIDGE * among + 1e-8 * np.eye(len(among))
    alpha = np.linalg.solve(left, cross.T @ (weight * target))
    return Model(classes, (marks.T @ alpha).astype(np.float32))


def groups(texts: list[str | None]) -> Iterator[list[int]]:
    """Positions of the texts, in groups of bounded rows and characters (a longer text is alone)."""
    group, size = [], 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if group and (len(group) == GROUP_ROWS or size + n > GROUP_CHARS):
            yield group
            group, size = [], 0
        group.append(i)
        size += n
    if group:
        yield group


def train(docs: DataFrame, usable: Column, text: str = "text", lang: str = "lang", key: str = "doc_id") -> Model:
    """Fit on at most 1.5 x TRAIN_PER_LANG labelled documents of each language."""
    rows = docs.where(usable & F.col(lang).isNotNull() & F.col(text).isNotNull())
    labels = [r[0] for r in rows.select(lang).distinct().collect()]  # one row per language
    texts, langs = [], []
    for label in sorted(labels):
        picked = bounded_sample(rows.where(F.col(lang) == label).select(key, text), F.col(key), TRAIN_PER_LANG)
        for t in sorted(r[0] for r in picked.select(text).collect()):
            if any(c.isalpha() for c in t):
                texts.append(t)
                langs.append(label)
    order = np.random.default_rng(0).permutation(len(texts))
    return fit([texts[i] for i in order], [langs[i] for i in order])


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Replace ``text`` by lang_pred and score.

    lang_pred is the class of the largest margin (ties: first in alphabetic order), ``und`` with score
    0 for null texts, texts without a letter, and models without classes. score: the margin moved from
    [-1, 1] to [0, 1]. Whole texts are used, whatever their length.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.classes, model.weights))  # BUCKETS x classes floats

    def make():
        m = Model(*shared.value)

        def work(texts):
            names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            for group in groups(texts) if m.classes else ():
                matrix, has = presence([texts[i] or "" for i in group])
                margin = m.score(matrix)
                best = margin.argmax(axis=1)
                for row, i in enumerate(group):
                    if has[row]:
                        names[i] = m.classes[best[row]]
                        scores[i] = min(1.0, max(0.0, (float(margin[row, best[row]]) + 1) / 2))
            return names, scores
        return work

    return add_by_text(docs, text, "lang_pred string, score double", make)

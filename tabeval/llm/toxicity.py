"""Toxicity from subword-bag embeddings and a linear softmax, trained jointly in numpy.

A passage (a few consecutive words) is the bag of its words' character n-grams and whole-word units;
the average of their embeddings goes into a two-class linear softmax. Averaging a whole document would
drown one insult among thousands of words, so the bag is a passage and a document scores as its worst
passage. Misspellings share n-grams, and so vectors, with the words seen in training.

Training first gives every passage its document's label, each document weighing the same, then lets
only each document's worst passage learn (multiple-instance learning): clean documents push down what
they score highest, toxic ones push up.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import add_by_text, bounded_sample

WORD = re.compile(r"\w+")
PASSAGE = 2
ORDERS = (3, 4, 5)
BUCKETS, DIM = 1 << 17, 8
#: bounds of the labelled sample
TRAIN_TOXIC, TRAIN_CLEAN = 1200, 2000
BATCH, RATE = 64, 0.1
#: least epochs and least steps of the two phases (a small sample takes more epochs)
SPREAD, WORST = (3, 150), (10, 350)
#: words whose score a task remembers
MEMORY = 300_000
THRESHOLD = 0.3


def units(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The words' subword buckets and which word each belongs to, from ``<word>``."""
    marked = [f"<{w}>" for w in words]
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "replace"), np.uint32)
    lengths = np.array([len(w) for w in marked])
    owner = np.repeat(np.arange(len(words)), lengths)
    place = (np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)).astype(np.uint32)
    buckets, owners = [], []
    for n in ORDERS:
        if len(codes) < n:
            break
        value = np.full(len(codes) - n + 1, n, np.uint32)
        for k in range(n):
            value = value * np.uint32(0x01000193) + codes[k:len(codes) - n + 1 + k]
        inside = owner[:len(value)] == owner[n - 1:]
        buckets.append(value[inside])
        owners.append(owner[:len(value)][inside])
    if len(words):
        with np.errstate(over="ignore"):
            mixed = (codes + np.uint32(77)) * (place * np.uint32(0x9E3779B1) + np.uint32(0x85EBCA77))
            mixed ^= mixed >> np.uint32(13)
            buckets.append(np.add.reduceat(mixed * np.uint32(0xC2B2AE35), np.cumsum(lengths) - lengths))
        owners.append(np.arange(len(words)))
    if not buckets:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    value = np.concatenate(buckets).astype(np.uint32)
    value = (value ^ (value >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return (value >> np.uint32(32 - 17)).astype(np.int64), np.concatenate(owners)


@dataclass
class Model:
    logit: np.ndarray  # per bucket: embedding times the difference of the softmax's two rows
    bias: float


def passages(sums: np.ndarray, counts: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums over windows of PASSAGE words; windows end at the document's last word (starts: each word's
    distance to its document's end)."""
    total, n = sums.copy(), counts.copy()
    for k in range(1, PASSAGE):
        inside = starts[:len(sums) - k] >= k
        total[:len(sums) - k][inside] += sums[k:][inside]
        n[:len(sums) - k][inside] += counts[k:][inside]
    return total, n


def fit(texts: list[str], toxic: list[int], seed: int = 0) -> Model:
    """Train embeddings and softmax together by Adagrad. One class only: a constant score."""
    tokens = [WORD.findall(t.lower()) for t in texts]
    keep = [i for i, t in enumerate(tokens) if t]
    y = np.array([toxic[i] for i in keep], np.float32)
    if len(set(y)) < 2:
        return Model(np.zeros(BUCKETS, np.float32), 4.0 if len(y) and y[0] else -4.0)
    vocabulary: dict[str, int] = {}
    docs = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in tokens[i]]) for i in keep]
    words, parts, sizes = list(vocabulary), [], []
    for k in range(0, len(words), 50_000):  # in pieces: the arrays of all words at once are large
        found, owner = units(words[k:k + 50_000])
        parts.append(found[np.argsort(owner, kind="stable")].astype(np.int32))
        sizes.append(np.bincount(owner, minlength=len(words[k:k + 50_000])))
    bucket, ends = np.concatenate(parts), np.cumsum(np.concatenate(sizes))
    begins = ends - np.concatenate(sizes)
    del parts, sizes, words
    rng = np.random.default_rng(seed)
    e = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    w = rng.normal(0, 0.1, DIM).astype(np.float32)  # difference of the two softmax rows
    b = np.float32(0)
    seen_e, seen_w, seen_b = np.full(BUCKETS, 1e-6, np.float32), np.full(DIM, 1e-6, np.float32), 1e-6
    share = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))  # both classes weigh the same
    per_epoch = -(-len(docs) // BATCH)
    spread, worst = (max(epochs, -(-steps // per_epoch)) for epochs, steps in (SPREAD, WORST))
    for epoch in range(spread + worst):
        turn = rng.permutation(len(docs))
        for k in range(0, len(turn), BATCH):
            ids = turn[k:k + BATCH]
            sizes = np.array([len(docs[i]) for i in ids])
            words, at = np.unique(np.concatenate([docs[i] for i in ids]), return_inverse=True)
            spans = ends[words] - begins[words]
            rows = np.repeat(begins[words] - (np.cumsum(spans) - spans), spans) + np.arange(spans.sum())
            own = np.repeat(np.arange(len(words)), spans)
            buckets = bucket[rows]
            total = np.add.reduceat(e[buckets], np.cumsum(spans) - spans)  # sum of each word's units
            left = np.repeat(np.cumsum(sizes), sizes) - 1 - np.arange(sizes.sum())
            sums, counts = passages(total[at], spans[at].astype(np.float32), left)
            mean = sums / counts[:, None]
            p = 1 / (1 + np.exp(-np.clip(mean @ w + b, -30, 30)))
            label = np.repeat(y[ids], sizes)
            if epoch < spread:
                g = (p - label) * np.repeat(share[ids] / sizes, sizes) / len(ids)
            else:
                first = np.cumsum(sizes) - sizes
                best = np.array([f + int(p[f:f + n].argmax()) for f, n in zip(first, sizes, strict=True)])
                g = np.zeros(len(p), np.float32)
                g[best] = (p[best] - y[ids]) * share[ids] / len(ids)
            used = np.flatnonzero(g)
            grad_w, grad_b = mean[used].T @ g[used], float(g[used].sum())
            per = np.zeros((len(words),), np.float32)  # gradient per unit of each word, along w
            for j in range(PASSAGE):
                there = used[left[used] >= j]
                per += np.bincount(at[there + j], g[there] / counts[there], len(words)).astype(np.float32)
            grad = np.bincount(buckets, np.repeat(per, spans), BUCKETS).astype(np.float32)
            touched = np.flatnonzero(grad)
            step = grad[touched, None] * w  # all units of a word move along w
            seen_e[touched] += (step ** 2).mean(axis=1)
            e[touched] -= RATE * step / np.sqrt(seen_e[touched])[:, None]
            seen_w += grad_w ** 2
            w = (w - RATE * grad_w / np.sqrt(seen_w)).astype(np.float32)
            seen_b += grad_b ** 2
            b = np.float32(b - RATE * grad_b / np.sqrt(seen_b))
    return Model((e @ w).astype(np.float32), float(b))


class Scorer:
    """Scores texts; a word's sum of unit logits is computed once and remembered."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}

    def learn(self, words: list[str]) -> None:
        bucket, owner = units(words)
        sums = np.bincount(owner, self.model.logit[bucket], len(words))
        counts = np.bincount(owner, minlength=len(words))
        if len(self.known) > MEMORY:
            self.known.clear()
        self.known.update(zip(words, zip(sums.tolist(), counts.tolist(), strict=True), strict=True))

    def score(self, texts: list[str | None]) -> np.ndarray:
        """The worst passage's probability; 0 for a text without words."""
        out = np.zeros(len(texts))
        tokens = [WORD.findall(t.lower()) if t else [] for t in texts]
        distinct = {w for t in tokens for w in t}
        fresh = [w for w in distinct if w not in self.known]
        if fresh:
            if len(self.known) + len(fresh) > MEMORY:
                self.known.clear()
                fresh = list(distinct)
            self.learn(fresh)
        for i, t in enumerate(tokens):
            if t:
                pairs = np.array([self.known[w] for w in t])
                left = len(t) - 1 - np.arange(len(t))
                sums, counts = passages(pairs[:, 0], pairs[:, 1], left)
                out[i] = 1 / (1 + np.exp(-np.clip((sums / counts).max() + self.model.bias, -30, 30)))
        return out


def train(labelled: DataFrame, text: str = "text", label: str = "toxic", key: str = "doc_id") -> Model:
    """Fit on a bounded hash sample of the labelled rows, TRAIN_TOXIC and TRAIN_CLEAN at most (x 1.5)."""
    rows = labelled.where(F.col(text).isNotNull())
    picked = [(r[0], side) for side, most in ((1, TRAIN_TOXIC), (0, TRAIN_CLEAN))
              for r in bounded_sample(rows.where(F.col(label) == side).select(key, text), F.col(key), most).select(text).collect()]
    picked.sort()
    return fit([t for t, _ in picked], [s for _, s in picked])


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Replace ``text`` by score (0 to 1). Null and empty texts and texts without words have
    no passage and score 0; whole texts are read, whatever their length."""
    shared = docs.sparkSession.sparkContext.broadcast((model.logit, model.bias))  # BUCKETS floats
    return add_by_text(docs, text, "score double", lambda: lambda texts, s=Scorer(Model(*shared.value)): (s.score(texts),))


def labelled(docs: DataFrame, labels: DataFrame, usable: Column) -> DataFrame:
    """The usable documents that ``labels`` marks 0 or 1, one row per document and mark."""
    marks = labels.where(F.col("toxic").isin(0, 1)).select("doc_id", "toxic").distinct()
    return docs.where(usable).select("doc_id", "text").join(marks, "doc_id")

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
from data import DOCS, docs
from hypothesis import given, settings
from hypothesis import strategies as st

from tabeval.llm import resample
from tabeval.llm.queries import op13_resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, n=2):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return [" ".join(w[i:i + m]) for m in range(1, n + 1) for i in range(len(w) - m + 1)], len(w)


def expected(rows, target):
    s, t = Counter(), Counter()
    for texts, count in (([r[1] for r in rows], s), (target, t)):
        for text in texts:
            count.update(zlib.crc32(f.encode()) % 10_000 for f in features(text)[0])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (big_s + 10_000.0) / ((s[b] + 1.0) * (big_t + 10_000.0)))) for b in range(10_000)]
    out = []
    for key, text in rows:
        found, words = features(text)
        weight = sum(gain[zlib.crc32(f.encode()) % 10_000] for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        out.append([key, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, words])
    able = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for rank, r in enumerate(able[:25 * len(able) // 100], 1):
        r[4] = rank
    return sorted((tuple(r[:5]) for r in out), key=str)


def got(df):
    return sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in df.collect()), key=str)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB9 .é東🙂\x00\n", max_size=60)), max_size=6), st.integers(1, 4), st.integers(1, 9))
def test_checksums_of_ngrams(texts, n, piece):
    found = Counter()
    for _, number, crc in resample.Ngrams(n, piece).of(texts):
        found.update(zip(number.tolist(), crc.tolist()))
    assert found == Counter((i, zlib.crc32(f.encode())) for i, t in enumerate(texts) for f in features(t, n)[0])


def test_shift_of_long_words():
    shift, rng = resample.Shift(), np.random.default_rng(0)
    sizes = np.array([0, 1, 2, 255, 256, 70_000, 3])
    a, b = rng.bytes(50), [rng.bytes(int(n)) for n in sizes]
    moved = shift.by(np.full(len(sizes), zlib.crc32(a), np.uint32), sizes)
    assert [int(m) ^ zlib.crc32(x) for m, x in zip(moved, b)] == [zlib.crc32(a + x) for x in b]


def test_against_a_loop(spark):
    rows = [(k, " ".join(f"w{(k * 31 + j * j) % 97}" for j in range(k % 60))) for k in range(400)] + [(7, "again"), (None, "x " * 30), (None, "x " * 30)]
    target = ["w1 w2 w3 w5", "w8 W13 w1", None, ""]
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    assert got(resample.draw(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), bench)) == expected(rows, target)


def test_awkward_documents_and_empty_tables(spark):
    bench = spark.createDataFrame([("lorem ipsum dolor",)], "text string")
    assert got(resample.draw(docs(spark), bench)) == expected(DOCS, ["lorem ipsum dolor"])
    assert got(resample.draw(docs(spark), bench.where("false"))) == expected(DOCS, [])
    assert resample.draw(docs(spark).where("false"), bench).count() == 0


def test_draws_towards_the_target(spark):
    like = [(k, f"quantum chess opening {k} " * 10) for k in range(100)]
    other = [(100 + k, f"cooking pasta sauce {k} " * 10) for k in range(300)]
    bench = spark.createDataFrame([("quantum chess opening",)] * 50, "text string")
    drawn = [r.doc_id for r in resample.draw(spark.createDataFrame(like + other, "doc_id long, text string"), bench).where("rank is not null").collect()]
    assert len(drawn) == 100 and sum(k < 100 for k in drawn) > 60


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert got(op13_resample(spark, sf)) == expected(rows, target)

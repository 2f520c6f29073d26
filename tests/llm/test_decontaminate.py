import hashlib
import random
import re

import numpy as np
from data import DOCS, docs

from tabeval.llm import decontaminate
from tabeval.llm.queries import op10_decontaminate


def words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows, bench):
    windows = {}
    for item, text in bench:
        w = words(text)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k:k + 10]), set()).add(item)
    out = []
    for key, text in rows:
        w, hit, items = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                found = windows.get(tuple(w[k:k + n]))
                if found is not None:
                    hit.update(range(k, k + n))
                    items |= found
        names = sorted(str(i) for i in items if i is not None)
        out.append((key, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect()), key=str)


def bench(spark, rows):
    return spark.createDataFrame(rows, "item_id string, text string")


def test_index_against_plain_search():
    pick = np.random.default_rng(4)
    text = pick.integers(0, 4, 3000).astype(np.int32)
    text[-1] = 0
    index = decontaminate.Index(text)
    phrases = [tuple(int(x) for x in pick.integers(1, 5, n)) for n in (1, 2, 3, 4, 6) for _ in range(20)]
    low, high = index.search(phrases)
    for p, a, b in zip(phrases, low, high, strict=True):
        want = [k for k in range(len(text)) if tuple(text[k:k + len(p)].tolist()) == p]
        assert sorted(index.locate(np.arange(a, max(a, b))).tolist()) == want


def test_suffixes_are_sorted():
    text = np.array([2, 1, 2, 1, 0, 2, 1, 2, 1, 0, 1, 0], np.int32)
    order = decontaminate.suffix_array(text).tolist()
    rest = {k: text[k:].tolist() for k in order}
    rest = {k: v[:v.index(0)] + [-1] for k, v in rest.items()}
    assert sorted(order) == list(range(len(text))) and [rest[k] for k in order] == sorted(rest.values())


def corpus(seed):
    pick = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(30)]
    items = [(str(k), " ".join(pick.choices(vocabulary, k=pick.choice((3, 9, 10, 14, 25))))) for k in range(30)]
    rows = []
    for k in range(200):
        text = pick.choices([*vocabulary, "zz", "Yy"], k=pick.randint(0, 60))
        if k % 3 == 0:
            text[len(text) // 2:len(text) // 2] = pick.choice(items)[1].upper().split()[:pick.randint(2, 25)]
        rows.append((k, ", ".join(text)))
    return rows, items


def test_against_brute_force_also_in_blocks_and_shards(spark, monkeypatch):
    rows, items = corpus(1)
    want = brute(rows, items)
    assert got(decontaminate.report(docs(spark, rows), bench(spark, items))) == want
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 600)
    assert len(decontaminate.blocks(bench(spark, items))) > 2
    assert got(decontaminate.report(docs(spark, rows), bench(spark, items))) == want


def test_awkward_rows(spark):
    items = [("a", "short"), ("b", None), (None, "café"), ("c", ""), ("d", "..."), ("a", "short"), ("e", "lorem ipsum dolor " * 6)]
    assert got(decontaminate.report(docs(spark), bench(spark, items))) == brute(DOCS, items)
    assert got(decontaminate.report(docs(spark), bench(spark, items).where("false"))) == brute(DOCS, [])
    assert decontaminate.report(docs(spark).where("false"), bench(spark, items)).count() == 0


def test_removal_leaves_no_phrase_and_clean_texts_alone(spark):
    rows, items = corpus(2)
    clean = decontaminate.remove(docs(spark, rows), bench(spark, items))
    assert clean.columns == docs(spark).columns
    left = {r.doc_id: r.text for r in clean.collect()}
    assert not any(r[-1] for r in brute(sorted(left.items()), items))
    hit = {r[0] for r in brute(rows, items) if r[-1]}
    assert hit and all(left[k] == t for k, t in rows if k not in hit)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    assert got(op10_decontaminate(spark, sf)) == brute(rows, items)

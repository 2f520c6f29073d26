import random
import re

from data import DOCS, LONG, docs

from tabeval.llm import ngram_join
from tabeval.llm.queries import op8_ngram_join


def shingles(text):
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    """key, class_id, n_links of all pairs."""
    sets = [shingles(t) for _, t in rows]
    links = [[b for b in range(len(rows)) if b != a and sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
             for a in range(len(rows))]
    out = []
    for a, (key, _) in enumerate(rows):
        seen, todo = {a}, [a]
        while todo:
            for b in links[todo.pop()]:
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        keys = [rows[b][0] for b in seen if rows[b][0] is not None]
        out.append((key, min(keys) if keys else None, len(links[a])))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.class_id, r.n_links) for r in df.collect()), key=str)


def near_copies(seed, groups=6, size=8, words=120, share=""):
    pick = random.Random(seed)
    rows = []
    for g in range(groups):
        base = [f"w{pick.randrange(5000)}" for _ in range(words)]
        for k in range(size):
            copy = list(base)
            for _ in range(pick.choice((0, 1, 2, 3, 4, 6))):
                copy[pick.randrange(words)] = f"v{pick.randrange(5000)}"
            rows.append((len(rows), " ".join(copy) + share))
    return rows


def test_all_links_of_near_copies(spark):
    rows = near_copies(1)
    assert got(ngram_join.join(docs(spark, rows, False))) == brute(rows)


def test_a_passage_that_many_share_and_blocks(spark, monkeypatch):
    """Buckets over the limit are split further; components over the bounds are checked in blocks."""
    monkeypatch.setattr(ngram_join, "SMALL", 4)
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 7)
    passage = " " + " ".join(f"p{k}" for k in range(60))
    rows = near_copies(2, groups=5, size=30, words=100, share=passage)
    assert got(ngram_join.join(docs(spark, rows, False))) == brute(rows)


def test_no_task_gets_a_bucket_over_the_limit(spark, monkeypatch):
    """A template that all documents share: its buckets are never grouped before the last depth."""
    compare, seen = ngram_join.compare_buckets, []

    def watched(rows, last, tasks):
        seen.append((last, rows.groupBy("path").count().agg({"count": "max"}).first()[0] or 0))
        return compare(rows, last, tasks)

    monkeypatch.setattr(ngram_join, "compare_buckets", watched)
    monkeypatch.setattr(ngram_join, "SMALL", 4)
    rows = near_copies(4, groups=1, size=40, words=100)
    assert got(ngram_join.join(docs(spark, rows, False))) == brute(rows)
    assert len(seen) == ngram_join.DEPTH and all(n <= 4 for last, n in seen if not last) and seen[-1][1] > 4


def test_awkward_rows(spark):
    rows = [*DOCS, (20, "aa bb"), (21, "AA, bb!"), (22, "aa bb cc"), (None, "aa bb"), (23, LONG + " and more words at the end")]
    assert got(ngram_join.join(docs(spark, rows))) == brute(rows)


def test_keep_one(spark):
    rows = [*near_copies(3, groups=3, size=4), (500, "one row twice over"), (500, "one row twice over"), (501, None), (501, ""), (None, "w1 w2")]
    kept = ngram_join.keep_one(docs(spark, rows))
    classes = {c for _, c, _ in brute(rows) if c is not None}
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted([*classes, 501])
    assert kept.columns == docs(spark).columns and kept.where("doc_id is null").count() == 1


def test_keep_one_decides_by_row(spark):
    base = " ".join(f"w{k}" for k in range(60))
    rows = [(1, base), (2, base + " x"), (2, "another text under the same id"), (3, "p " + base), (3, "a third text all alone"),
            (None, base + " y"), (None, base), (None, "no id and no copy"), (9, base.replace("w", "v")), (9, base.replace("w", "v") + " z"),
            (None, None), (None, None)]
    kept = sorted(((r.doc_id, r.text) for r in ngram_join.keep_one(docs(spark, rows)).collect()), key=str)
    nine = [r for r in kept if r[0] == 9]
    assert len(nine) == 1 and nine[0] in rows
    assert kept == sorted([rows[0], rows[2], rows[4], rows[7], *nine, *rows[-2:]], key=str)


def test_empty_table(spark):
    assert ngram_join.join(docs(spark).where("false")).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert got(op8_ngram_join(spark, sf)) == brute(rows)

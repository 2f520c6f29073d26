import numpy as np
from data import DOCS, docs

from tabeval.llm import toxicity
from tabeval.llm.queries import op2_toxicity

CLEAN = ("garden river table window morning paper street music bread cloud forest letter answer summer winter bridge "
         "number picture village kitchen").split()
INSULTS = ["idiot", "moron", "stupid"]


def corpus(n, seed):
    pick = np.random.default_rng(seed)
    texts, marks = [], []
    for k in range(n):
        words = list(pick.choice(CLEAN, 60))
        if k % 4 == 0:
            words[int(pick.integers(60))] = INSULTS[k % len(INSULTS)]
        texts.append(" ".join(words))
        marks.append(int(k % 4 == 0))
    return texts, marks


def test_one_word_among_many_is_found_and_misspellings_share_it():
    model = toxicity.fit(*corpus(300, 1))
    texts, marks = corpus(200, 2)
    scorer = toxicity.Scorer(model)
    predicted = scorer.score(texts) >= toxicity.THRESHOLD
    assert (predicted == np.array(marks, bool)).mean() > 0.97
    clean, wrong = scorer.score(["garden river table", "what an idiott you are"])
    assert wrong > clean


def test_scores_do_not_depend_on_memory():
    texts, marks = corpus(60, 3)
    model = toxicity.fit(texts, marks)
    together = toxicity.Scorer(model).score(texts)
    apart = np.concatenate([toxicity.Scorer(model).score([t]) for t in texts])
    assert np.allclose(together, apart)


def test_one_class_gives_a_constant():
    model = toxicity.fit(["some words", "other words"], [0, 0])
    assert (toxicity.Scorer(model).score(["some words", "more"]) < toxicity.THRESHOLD).all()


def test_awkward_rows(spark):
    model = toxicity.fit(*corpus(80, 4))
    rows = toxicity.score(docs(spark).select("doc_id", "text", "label"), model).collect()
    assert len(rows) == len(DOCS) and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in rows if r.doc_id in (3, 4, 5, 6)} == {0.0}
    assert toxicity.score(docs(spark, DOCS, False).where("false"), model).count() == 0


def test_repeated_and_conflicting_labels(spark):
    labels = spark.createDataFrame([(1, 1), (1, 1), (8, None), (9, 5)], "doc_id long, toxic int")
    from pyspark.sql import functions as F
    got = toxicity.labelled(docs(spark), labels, F.lit(True)).collect()
    assert [(r.doc_id, r.toxic) for r in got] == [(1, 1)]


def test_query_learns_only_from_the_rest(spark):
    import zlib
    sf = "/root/testdata/sf0.01"
    rows = op2_toxicity(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(r.predicted == int(r.score >= 0.3) for r in rows)
    marks = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(marks[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in marks]
    # most documents aren't toxic: predicting 0 for all would be right in most, so both kinds of error count
    caught, found = sum(a == b == 1 for a, b in held), sum(b for _, b in held)
    assert sum(a for a, _ in held) > 10 and caught / sum(a for a, _ in held) > 0.9 and caught / found > 0.9

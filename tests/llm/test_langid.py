import zlib

import numpy as np
from data import DOCS, docs
from pyspark.sql import functions as F

from tabeval.llm import langid
from tabeval.llm.queries import op5_langid


def grams(text):
    """The distinct bucketed n-grams, one by one."""
    codes = [ord(c) if c.isalpha() else 32 for c in text.lower()]
    out = set()
    with np.errstate(over="ignore"):
        for at in range(len(codes)):
            value = 0
            for n in langid.ORDERS:
                if at + n > len(codes):
                    break
                value = (value * 0x01000193 + codes[at + n - 1] + n) % 2**32
                mixed = ((value ^ (value >> 15)) * 0x2C1B3C6D) % 2**32
                out.add(mixed >> 17)
    return out


def test_presence_is_the_set_of_ngrams_also_over_pieces():
    texts = ["Ein Satz, mit Wörtern!", "", "x" * (langid.GROUP_CHARS + 5) + "yz", "..."]
    matrix, has = langid.presence(texts)
    assert has.tolist() == [True, False, True, False]
    for row, text in zip(matrix, texts, strict=True):
        assert set(np.flatnonzero(row)) == grams(text if len(text) < 100 else text[:10] + text[-10:])


def test_only_letters_are_letters_beyond_the_first_plane(spark):
    texts = ["🙂🎉", "🂡🂢 🃁", "\U00010300\U00010301", "\U00010140\U00010320", "\U00020000", "a🙂b"]
    assert langid.presence(texts)[1].tolist() == [False, False, True, False, True, True]
    for row, text in zip(langid.presence(texts)[0], texts, strict=True):
        assert set(np.flatnonzero(row)) == grams(text)
    model = langid.fit(["the cat sat there", "der Hund lief weg"], ["en", "de"])
    rows = langid.predict(docs(spark, list(enumerate(texts)), False), model).collect()
    assert {r.doc_id: (r.lang_pred, r.score) for r in rows if r.doc_id in (0, 1, 3)} == dict.fromkeys((0, 1, 3), ("und", 0.0))
    assert all(r.lang_pred != "und" for r in rows if r.doc_id in (2, 4, 5))


def test_folded_landmarks_equal_the_kernel_sum():
    texts = ["the cat sat there", "the dog ran off", "der Hund lief weg", "die Katze sass da"]
    model = langid.fit(texts, ["en", "en", "de", "de"])
    unit = lambda m: m / np.sqrt(np.maximum(m.sum(axis=1, keepdims=True), 1))
    marks, new = unit(langid.presence(texts)[0]), langid.presence(["the hog lay", "der Hase"])[0]
    kernel = unit(new) @ marks.T
    alpha = np.linalg.lstsq(marks.T.astype(float), model.weights.astype(float), rcond=None)[0]
    assert np.allclose(model.score(new), kernel @ alpha, atol=1e-4)
    assert [model.classes[k] for k in model.score(new).argmax(axis=1)] == ["en", "de"]


def test_awkward_rows_and_no_training_rows(spark):
    df = docs(spark).withColumn("lang", F.when(F.col("doc_id") < 3, "en"))
    model = langid.train(df, F.lit(True))
    assert model.classes == ["en"]
    rows = langid.predict(df.select("doc_id", "text"), model).collect()
    assert len(rows) == len(DOCS)
    assert {r.lang_pred for r in rows if r.doc_id in (3, 4, 5, 6)} == {"und"} and all(0 <= r.score <= 1 for r in rows)
    nothing = langid.train(df.where("false"), F.lit(True))
    assert {r.lang_pred for r in langid.predict(df.select("doc_id", "text"), nothing).collect()} == {"und"}
    assert langid.predict(df.where("false").select("doc_id", "text"), model).count() == 0


def test_query_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op5_langid(spark, sf).collect()
    assert len(rows) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r.lang_pred == lang[r.doc_id] for r in rows if r.held_out and lang[r.doc_id]]
    assert np.mean(held) > 0.97

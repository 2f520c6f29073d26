import random

import pytest
from data import DOCS, docs

from tabeval.llm import pieces
from tabeval.llm.queries import PIECES, op1_sentencepiece


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary.load(PIECES)


def best_score(text, scores, unknown):
    """Plain dynamic programme over all substrings."""
    best = [0.0] + [float("-inf")] * len(text)
    for end in range(1, len(text) + 1):
        for begin in range(max(0, end - 16), end):
            score = scores.get(text[begin:end], unknown if end - begin == 1 else None)
            if score is not None:
                best[end] = max(best[end], best[begin] + score)
    return best[-1]


def test_segmentation_is_the_best(vocabulary):
    codec = pieces.Codec(vocabulary)
    scores = {p: s for p, s, k in zip(vocabulary.pieces, vocabulary.scores, vocabulary.kinds) if k == "n"}
    pick = random.Random(3)
    for _ in range(400):
        text = "▁" + "".join(pick.choice("aeinorsthé東🙂▁x") for _ in range(pick.randint(0, 14)))
        ids = codec.segment(text)
        plain = [i for i in ids if vocabulary.kinds[i] == "n"]
        strange = sum(1 for c in text if c not in scores)
        assert sum(vocabulary.scores[i] for i in plain) + strange * codec.unknown == pytest.approx(best_score(text, scores, codec.unknown))


def test_word_by_word_is_the_whole(vocabulary):
    codec = pieces.Codec(vocabulary)
    text = "Two words,  three spaces\nand\ta tab"
    marked = "▁" + text.replace(" ", "▁")
    whole = codec.segment(marked)
    score = lambda ids: sum(vocabulary.scores[i] for i in ids)
    assert codec.by_word and score(codec.encode(text)) == pytest.approx(score(whole))
    assert codec.decode(codec.encode(text)) == text


def test_scores_are_probabilities_that_segment_as_the_model_does(spark, vocabulary):
    import math

    import sentencepiece
    model, codec = sentencepiece.SentencePieceProcessor(model_file=PIECES), pieces.Codec(vocabulary)
    assert math.isclose(sum(math.exp(s) for s, k in zip(vocabulary.scores, vocabulary.kinds) if k == "n"), 1)
    assert [vocabulary.pieces[i] for i in codec.encode("the international organization")] == ["▁the", "▁international", "▁organization"]
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect() if r.text]
    own, ours = [model.encode(t) for t in texts], [codec.encode(t) for t in texts]
    assert sum(map(len, ours)) <= 1.01 * sum(map(len, own))  # ids a text: no more than by merges
    words = [w for t in texts for w in t.split()]
    assert sum(codec.encode(w) == model.encode(w) for w in words) > 0.75 * len(words)
    assert pieces.log_probabilities([-1.5, -2.0, 0.0], "nnx") == [-1.5, -2.0, 0.0]  # log-probabilities stay


def test_awkward_rows_round_trip(spark, vocabulary):
    df = docs(spark)
    coded = pieces.encode(df.select("doc_id", "text"), vocabulary)
    rows = coded.collect()
    assert len(rows) == len(DOCS) and all(r.round_trip for r in rows)
    assert all(r.n_ids == len(r.ids) for r in rows)
    back = pieces.decode(coded.drop("n_ids", "round_trip"), vocabulary)
    want = sorted((i is not None, i or 0, (t or "").replace("▁", " ")) for i, t in DOCS)
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.text) for r in back.collect()) == want


def test_empty_table(spark, vocabulary):
    assert pieces.encode(docs(spark, DOCS, False).where("false"), vocabulary).collect() == []


def test_query_covers_the_table(spark):
    sf = "/root/testdata/sf0.001"
    out = op1_sentencepiece(spark, sf)
    assert out.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert out.where("not round_trip").count() == 0

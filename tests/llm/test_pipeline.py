import corpus_pipeline
from data import DOCS, docs
from test_decontaminate import brute as contaminated
from test_ngram_join import brute as classes
from test_pii import brute as personal

from tabeval.llm.common import freeze

SF = "/root/testdata/sf0.001"


def test_stages_do_their_work_on_what_they_get(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    columns, items = df.columns, [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in df.collect()}
        df = freeze(stage(spark, df, SF), name)
        after = {r.doc_id: r for r in df.collect()}
        assert after and set(after) <= set(before)
        if name != "tokens":
            assert df.columns == columns
        if name == "language":
            assert all(after[k] == before[k] for k in after) and len(after) >= 0.98 * len(before)
        if name == "near_copies":
            assert set(after) == {c for _, c, _ in classes([(k, r.text) for k, r in before.items()])}
        if name == "benchmark_passages":
            hit = {r[0] for r in contaminated([(k, r.text) for k, r in before.items()], items) if r[-1]}
            assert hit and all(after[k].text == before[k].text for k in after if k not in hit)
            assert not any(r[-1] for r in contaminated([(k, r.text) for k, r in after.items()], items))
        if name == "personal_data":
            assert any(personal(r.text) for r in before.values()) and not any(personal(r.text) for r in after.values())
            assert set(after) == set(before)
        if name == "tokens":
            assert set(after) == set(before) and all(r.round_trip and r.n_chars == len(r.text) for r in after.values())


def test_awkward_rows_pass_every_stage(spark):
    from pyspark.sql import functions as F
    df = docs(spark, DOCS, False).select("doc_id", "text", F.lit(None).cast("string").alias("lang"), F.lit("s").alias("source"),
                                         F.length("text").alias("n_chars"))
    for rows in (df, df.where("false")):
        for name, stage in corpus_pipeline.STAGES:
            rows = freeze(stage(spark, rows, SF), name)
        assert rows.where("text is null").count() == 0


def test_columns_of_any_name_pass_every_stage(spark):
    from pyspark.sql import functions as F
    names = ["score", "lang_pred", "_read", "read", "doc", "ids", "n_ids", "_spans", "_words", "_items", "_key", "_cuts", "text_key", "class", "a.b"]
    rows = spark.read.parquet(f"{SF}/documents.parquet").withColumns({c: F.lit("other") for c in names})
    for name, stage in corpus_pipeline.STAGES:
        rows = freeze(stage(spark, rows, SF), name)
        kept = [c for c in names if name != "tokens" or c not in ("ids", "n_ids")]
        assert rows.count() and all(rows.where(F.col(f"`{c}`") != "other").count() == 0 for c in kept)
    assert dict(rows.dtypes)["ids"] == "array<int>"


def test_what_a_stage_made_goes_with_the_next(spark):
    import os
    docs_, left = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs_, SF)
        assert not any(os.path.exists(p.removeprefix("file:")) for p in left)
        docs_, left = freeze(out, name), list(corpus_pipeline._made)

"""A saved pipeline scores a file stream exactly like the batch table."""

from pyspark.sql import functions as F

from tabeval.operators import workflow as wf
from tabeval.plans.q_models import FEATS, orders_features
from tabeval.streaming.score import evaluate_batches, score_stream

SF = "/root/testdata/sf0.001"


def test_stream_scores_equal_batch(spark, tmp_path):
    df = orders_features(spark, SF)
    m = wf.fit(df, FEATS, "y", "row_id", "lr", {}, wf.Options(impute="mean", scaling="StandardScaler"))
    mpath = str(tmp_path / "model")
    m.save(mpath)
    src = str(tmp_path / "src")
    df.write.parquet(src)
    stream = spark.readStream.schema(df.schema).parquet(src)
    scored = score_stream(mpath, stream, ["row_id"])
    seen = []

    def sink(batch, batch_id):
        seen.extend(batch.select("row_id", "score").collect())
    q = evaluate_batches(scored, sink, str(tmp_path / "ckpt"))
    q.awaitTermination(120)
    batch = {r["row_id"]: r["score"] for r in m.score(df, ["row_id"]).collect()}
    assert len(seen) == len(batch)
    assert all(abs(batch[r["row_id"]] - r["score"]) < 1e-12 for r in seen)

import hashlib
import re
from fractions import Fraction

import pytest
from data import DOCS, docs
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabeval.llm import mixing
from tabeval.llm.queries import op12_mixing

SCHEMA = "doc_id long, source string, text string"


def targets(sizes):
    """Rounds of sharing with exact fractions; sizes by source."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in capped]
        rest = total - sum(3 * sizes[s] for s in capped)
        share = {s: Fraction(weight[s] * rest, sum(weight[f] for f in free)) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            return {s: share.get(s, Fraction(3 * sizes[s])) for s in order}
        capped |= over


def expected(rows):
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, _, t in rows]
    sizes = {}
    for (_, s, _), n in zip(rows, size):
        sizes[s] = sizes.get(s, 0) + n
    goal, out = targets(sizes), []
    for s in sizes:
        def order(x):
            key = "" if x[0] is None else str(x[0])
            return x[1], hashlib.sha256(f"7:{key}".encode()).hexdigest()[:16], x[0] is not None, x[0] or 0
        own = sorted(((r[0], n) for r, n in zip(rows, size) if r[1] == s), key=order)
        each = int(float(goal[s]) / sizes[s] * mixing.UNIT) if sizes[s] else 0
        before = int(hashlib.sha256(f"7:{s or ''}".encode()).hexdigest()[:6], 16)
        for key, n in own:
            copies = (before + each) // mixing.UNIT - before // mixing.UNIT
            before += each
            out.append((key, n, sizes[s], round(float(goal[s]), 6), copies * n))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in df.collect()), key=str)


def rows_of(counts):
    return [(k, s, "w " * (1 + k * 7 % 23)) for s, n in counts for k in range(n)]


def test_against_a_loop(spark):
    rows = rows_of([("a", 40), ("b", 3), (None, 20), ("c", 200), ("", 5), ("é", 9)])
    assert got(mixing.mix(spark.createDataFrame(rows, SCHEMA).repartition(4))) == expected(rows)


def test_words_are_near_the_targets_and_no_document_is_taken_over_three_times(spark):
    rows = rows_of([("a", 400), ("b", 300), ("c", 1000), ("hot", 2000)])
    out = mixing.mix(spark.createDataFrame(rows, SCHEMA))
    per = out.withColumn("s", F.col("source_size")).groupBy("s").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max("size").alias("most")).collect()
    assert all(abs(r.taken - r.target) <= r.most + 1 for r in per)
    assert out.where("copies > 3 or copies < 0").count() == 0
    assert abs(sum(r.target for r in per) - sum(r.s for r in per)) < 1e-6


@settings(max_examples=8, deadline=None)
@given(st.dictionaries(st.sampled_from(["a", "b", "c", "d", "e", None]), st.integers(0, 10_000), min_size=1))
def test_targets(spark, sizes):
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, source_size long")
    found = {r.source: r.target for r in mixing.source_targets(df).collect()}
    assert found == pytest.approx({s: float(t) for s, t in targets(sizes).items()} if sum(sizes.values()) else dict.fromkeys(sizes, 0.0))


def test_awkward_documents_and_empty_table(spark):
    rows = [(i, "s" if (i or 0) % 2 else None, t) for i, t in DOCS]
    df = spark.createDataFrame(rows, SCHEMA)
    for c in ("size", "target", "row", "h", "k", "copies", "one"):
        df = df.withColumn(c, F.lit("other"))
    assert got(mixing.mix(df)) == expected(rows)
    assert mixing.mix(docs(spark).withColumn("source", F.lit("s")).where("false")).count() == 0


def test_files(spark, tmp_path):
    rows = rows_of([("a", 30), ("b", 10)])
    df = spark.createDataFrame([(k, s, t) for k, (_, s, t) in enumerate(rows)], SCHEMA)
    out = mixing.mix(df)
    mixing.write_mix(df, out, str(tmp_path / "mix"))
    back = {r.doc_id: r["count"] for r in spark.read.parquet(str(tmp_path / "mix")).groupBy("doc_id").count().collect()}
    assert back == {r.doc_id: r.copies for r in out.collect() if r.copies}


def test_query_and_plan(spark):
    sf = "/root/testdata/sf0.001"
    out = op12_mixing(spark, sf)
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "text").collect()]
    assert got(out) == expected(rows) == got(op12_mixing(spark, sf))
    assert not re.search("Python|Pandas|InArrow", out._jdf.queryExecution().toString())

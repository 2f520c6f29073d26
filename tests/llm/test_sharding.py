import re
import zlib

import pytest
from data import DOCS, docs

from tabeval.llm import sharding
from tabeval.llm.queries import op7_sharding


def expected(rows, shards):
    """The same cut in one loop over the sorted rows."""
    items = sorted((zlib.crc32((t or "").encode()), i is not None, i or 0, len((t or "").encode()) + 16) for i, t in rows)
    total, before, out, count = sum(r[3] for r in items), 0, [], {}
    for crc, known, i, size in items:
        s = min(shards - 1, (2 * before + size) * shards // (2 * total))
        out.append((i if known else None, size, crc, s, count.get(s, 0)))
        count[s] = count.get(s, 0) + 1
        before += size
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in df.collect()), key=str)


@pytest.mark.parametrize("shards", [1, 4, 40])
def test_against_a_loop(spark, shards):
    assert got(sharding.shard_documents(docs(spark), shards)) == expected(DOCS, shards)


def test_a_text_with_a_third_of_the_rows_is_cut(spark):
    rows = [(k, "the same text again and again" if k % 3 == 0 else f"text {k}") for k in range(3000)]
    out = sharding.shard_documents(docs(spark, rows, False), 10)
    assert got(out) == expected(rows, 10)
    sizes = [r["sum(size)"] for r in out.groupBy("shard").sum("size").collect()]
    assert len(sizes) == 10 and max(sizes) - min(sizes) < 100


def test_empty_table(spark):
    assert sharding.shard_documents(docs(spark).where("false")).count() == 0


def test_files(spark, tmp_path):
    rows = [(k, f"text {k}" * k) for k in range(40)]
    df = docs(spark, rows, False)
    sharding.write_shards(df, sharding.shard_documents(df, 5), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.doc_id, r.text) for r in back.collect()) == rows and back.select("shard").distinct().count() == 5


def test_query_and_plan(spark):
    sf = "/root/testdata/sf0.01"
    out = op7_sharding(spark, sf)
    assert got(out) == expected([tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()], 40)
    assert {(r.law, r.grown_shard) for r in out.collect()} == {("bytes", None)}
    assert not re.search("Python|Pandas|InArrow", out._jdf.queryExecution().toString())

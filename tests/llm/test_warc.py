import hashlib
import zlib

from pyspark.sql import functions as F

from tabeval.llm import warc
from tabeval.llm.queries import op6_warc

BIG, OTHER, SMALL = "b" * 1000, "é" * 700, "s" * 999
ROWS = [(1, "http://a/", BIG, "x"), (5, "http://b/", BIG, "x"), (3, None, BIG, "x"), (5, "http://b/", BIG, "x"), (None, "http://n/", BIG, "x"),
        (7, "http://c/", SMALL, "x"), (8, "http://d/", SMALL, "x"), (9, "http://e/\r\nX: 1", None, "x"), (10, "http://f/", "", "x"),
        (11, "http://g/", OTHER, "x"), (12, "http://h/", OTHER, "x"), (13, "http://long/", "l" * 3_000_000 + "\r\n\r\nWARC/1.1\r\n", "x")]


def expected(rows):
    last = {}
    for page, _, body, *_ in rows:
        b = (body or "").encode()
        if len(b) >= 1000 and page is not None:
            last[b] = max(page, last.get(b, page))
    out = []
    for page, _, body, *_ in rows:
        b = (body or "").encode()
        top = last.get(b)
        again = top is not None and page != top
        out.append((page, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", top if again else None))
    return sorted(out, key=str)


def test_records_come_back(spark):
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string, payload string").repartition(3)
    got = warc.archive_and_read(df).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == expected(ROWS)
    assert sorted(str(r.url) for r in got) == sorted(str(u).replace("\r", "%0D").replace("\n", "%0A") for _, u, *_ in ROWS)


def test_large_ids_beside_nulls(spark):
    big = 2**60 + 1
    rows = [(big, "http://a/", BIG), (big + 2, "http://b/", BIG), (None, "http://c/", SMALL), (-big, "http://d/", OTHER)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    index = warc.write_archives(df)
    ends = {(big, big + 2), (big + 2, None), (None, None), (-big, None)}
    assert {(r.page_id, r.refers_to) for r in index.collect()} == ends
    assert {(r.page_id, r.refers_to) for r in warc.read_records(index).collect()} == ends


def test_payloads_are_kept_and_a_selection_can_be_read(spark):
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string, payload string").repartition(2)
    index = warc.write_archives(df)
    some = warc.read_records(index.where(F.col("page_id").isin(7, 11, 13))).collect()
    assert sorted((r.page_id, r.payload) for r in some if r.record_type == "response") == [(7, SMALL), (13, ROWS[-1][2])]
    assert [(r.page_id, r.payload) for r in some if r.record_type == "revisit"] == [(11, None)]


def test_archives_are_concatenated_gzip_members_at_the_index_offsets(spark):
    index = warc.write_archives(spark.createDataFrame(ROWS, "page_id long, url string, html string, x string"))
    for archive in {r.archive for r in index.collect()}:
        data = open(archive, "rb").read()
        places = sorted((r.offset, r.length) for r in index.where(F.col("archive") == archive).collect())
        assert [a for a, _ in places] == [0, *[a + n for a, n in places[:-1]]] and sum(n for _, n in places) == len(data)
        assert all(zlib.decompress(data[a:a + n], 31).startswith(b"WARC/1.1\r\n") for a, n in places)


def test_empty_table(spark):
    assert warc.archive_and_read(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    got = op6_warc(spark, sf).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == expected(rows)

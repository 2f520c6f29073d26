import hashlib
import zlib

from data import DOCS, docs

from tabeval.llm import manifest
from tabeval.llm.queries import op11_manifest
from pyspark.sql import functions as F


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def climb(paths, fanout):
    """paths: [digest, siblings per level] of one run of nodes; the root and each node's levels."""
    nodes = [p[0] for p in paths]
    owner, proofs = list(range(len(nodes))), [[] for _ in nodes]
    while len(nodes) > 1:
        runs = [nodes[k:k + fanout] for k in range(0, len(nodes), fanout)]
        for leaf, at in enumerate(owner):
            run, j = runs[at // fanout], at % fanout
            proofs[leaf].append(("".join(run[:j]), "".join(run[j + 1:])))
        nodes, owner = [h("".join(r)) for r in runs], [at // fanout for at in owner]
    return (nodes[0] if nodes else None), proofs


def expected(rows, fanout=16):
    """rows: (doc_id, source, lang, n_chars, text), by a plain loop."""
    leaves = [(r, h("".join(map(field, r)))) for r in rows]
    groups = {}
    for r, d in leaves:
        groups.setdefault(r[1], []).append((r, d))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    inner = {}
    for s in order:
        groups[s].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        inner[s] = climb([[d] for _, d in groups[s]], fanout)
    root, outer = climb([[inner[s][0]] for s in order], fanout)
    out = []
    for k, s in enumerate(order):
        for (r, d), proof in zip(groups[s], inner[s][1]):
            path, now = proof + outer[k], d
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])
                now = h("".join(map(field, (*r[:4], lower))))
            for left, right in path:
                now = h(left + now + right)
            out.append((r[0], d, inner[s][0], root, h("".join(a + b for a, b in path)), now, now == root))
    return sorted(out, key=str)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def got(df):
    return sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in df.collect()), key=str)


def test_against_a_loop_with_uneven_sources(spark):
    rows = [(k, s, "en", k, f"Text {k} Ü") for s, n in (("a", 1), ("b", 16), ("c", 17), (None, 3), ("", 2), ("hot", 300)) for k in range(n)]
    out = got(manifest.check_documents(spark.createDataFrame(rows, SCHEMA).repartition(5)))
    assert out == expected(rows)
    assert {r[-1] for r in out} == {True, False}


def test_many_sources_make_a_tree_of_their_own(spark):
    rows = [(k, f"s{k % 40}", None, None, "A") for k in range(100)]
    assert got(manifest.check_documents(spark.createDataFrame(rows, SCHEMA))) == expected(rows)


def test_awkward_documents(spark):
    rows = [(i, "s" if t else None, None, None if t is None else len(t), t) for i, t in DOCS]
    extra = docs(spark, [(1, "x")]).drop("doc_id", "text").columns
    df = spark.createDataFrame(rows, SCHEMA)
    for c in (*extra, "d", "g", "proof", "i", "n", "row"):
        df = df.withColumn(c, F.lit("other"))
    assert got(manifest.check_documents(df)) == expected(rows)


def test_any_fanout_and_changed_column(spark):
    rows = [(k, "s", "en", k, f"t{k}") for k in range(30)]
    df = spark.createDataFrame(rows, SCHEMA)
    for fanout in (2, 3, 30):
        out = manifest.manifest(df, manifest.COLUMNS, "source", "doc_id", {"lang": F.when(F.col("doc_id") == 7, "de").otherwise(F.col("lang"))}, fanout)
        assert [r.doc_id for r in out.where("not verified").collect()] == [7]
        plain = {x[0]: x[3] for x in expected(rows, fanout)}
        assert {r.root for r in out.collect()} == set(plain.values())


def test_single_row_and_empty_table(spark):
    one = [(5, "s", "en", 1, "Q")]
    assert got(manifest.check_documents(spark.createDataFrame(one, SCHEMA))) == expected(one)
    assert manifest.check_documents(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    assert got(op11_manifest(spark, sf)) == expected(rows)

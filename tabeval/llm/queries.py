"""One registered query per operator of this subpackage, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    decontaminate,
    embed_join,
    langid,
    manifest,
    mixing,
    ngram_join,
    page_text,
    pieces,
    pii,
    resample,
    sharding,
    toxicity,
    warc,
)
from .common import id_remainder, table


#: the public model whose vocabulary op1 encodes with
PIECES = "/opt/tokenizers/piece_bpe_32k.model"


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.encode(docs, pieces.Vocabulary.load(PIECES))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), id_remainder(F.col("doc_id"), 4) == 2
    model = toxicity.train(toxicity.labelled(docs, table(spark, sf_dir, "labels"), ~held))
    scored = toxicity.score(docs.select("doc_id", held.alias("held_out"), "text"), model)
    return scored.withColumn("predicted", (F.col("score") >= toxicity.THRESHOLD).cast("int"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"), page_text.train())


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), id_remainder(F.col("doc_id"), 5) == 0
    model = langid.train(docs, ~held)
    return langid.predict(docs.select("doc_id", held.alias("held_out"), "text"), model)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_and_read(table(spark, sf_dir, "pages"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), shards=40)


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


def op9_embed_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_join.join(table(spark, sf_dir, "embeddings"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.check_documents(table(spark, sf_dir, "documents"))


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.draw(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("n_words")


#: the contract of op10 said plainly: every run of words of a document against every window of an item
OP10_SQL = r"""
WITH doc AS (
  SELECT doc_id, row_number() OVER () AS r,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
item AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
item_window AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS p
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item WHERE len(w) > 0)),
doc_window AS (
  SELECT r, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS p
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, (SELECT DISTINCT n FROM item_window))),
found AS (SELECT DISTINCT r, i, d.n, item_id FROM doc_window d JOIN item_window b ON d.p = b.p AND d.n = b.n),
hit AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM found) GROUP BY r),
items AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM found GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit USING (r) LEFT JOIN items USING (r)
"""


#: CRC-32 in SQL: a table of 16 (a nibble's register), and the two nibbles of each UTF-8 byte, low one first
CRC_TABLE = """(SELECT list(c ORDER BY i) AS crc_table FROM (
  SELECT i, list_reduce([i] || range(4), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
  FROM range(16) t(i)))"""


def crc_sql(text: str) -> str:
    """SQL for the unsigned CRC-32 of a text, beside CRC_TABLE."""
    digits = f"list_transform(flatten(list_transform(range(1, len(hex(encode({text}))), 2), lambda i: [i + 1, i])), lambda i: CAST(('0x' || hex(encode({text}))[i]) AS BIGINT))"
    return f"xor(4294967295, list_reduce([4294967295] || {digits}, lambda c, x: xor(c >> 4, crc_table[(xor(c, x) & 15) + 1])))"


def op11_sql(levels: int = 9, fanout: int = manifest.FANOUT) -> str:
    """The contract of op11 with one step after another, for at most ``fanout ** levels`` rows a source."""
    def field(c: str) -> str:
        v = f"CAST({c} AS VARCHAR)"
        return f"coalesce(CAST(octet_length(encode({v})) AS VARCHAR) || ':' || {v}, '-')"

    def hashed(text: str) -> str:
        return "sha256(" + " || ".join(field(c) if c != "text" else field(text) for c in manifest.COLUMNS) + ")"

    lower = f"translate(text, '{manifest.UPPER}', '{manifest.LOWER}')"
    steps = [f"""doc AS (SELECT row_number() OVER () AS r, * FROM documents)""",
             f"""leaf AS (SELECT r, doc_id, source, {hashed("text")} AS leaf,
  CASE WHEN doc_id IS NOT NULL AND {crc_sql("CAST(doc_id AS VARCHAR)")} % 5 = 0 THEN {hashed(lower)} ELSE {hashed("text")} END AS now
  FROM doc, {CRC_TABLE})""",
             """p0 AS (SELECT r, doc_id, source, leaf, now, '' AS proof,
  row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, leaf AS d FROM leaf)"""]

    for k in range(1, levels + 1):
        steps += [f"""n{k} AS (SELECT source, i // {fanout} AS p, list(d ORDER BY i) AS ds,
  CASE WHEN sum(count(*)) OVER (PARTITION BY source) > 1 THEN sha256(array_to_string(list(d ORDER BY i), '')) ELSE any_value(d) END AS d,
  sum(count(*)) OVER (PARTITION BY source) > 1 AS up FROM (SELECT DISTINCT source, i, d FROM p{k - 1}) GROUP BY source, i // {fanout})""",
                  f"""p{k} AS (SELECT r, doc_id, b.source, leaf, CASE WHEN up THEN sha256(array_to_string(ds[:i % {fanout}], '') || now || array_to_string(ds[i % {fanout} + 2:], '')) ELSE now END AS now,
  CASE WHEN up THEN proof || array_to_string(ds[:i % {fanout}], '') || array_to_string(ds[i % {fanout} + 2:], '') ELSE proof END AS proof,
  n.p AS i, n.d FROM p{k - 1} b JOIN n{k} n ON b.source IS NOT DISTINCT FROM n.source AND b.i // {fanout} = n.p)"""]
    steps += [f"""subroot AS (SELECT source, d, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i FROM (SELECT DISTINCT source, d FROM p{levels}))""",
              f"""q0 AS (SELECT r, doc_id, leaf, now, proof, b.d AS subroot, s.i, s.d FROM p{levels} b JOIN subroot s ON b.source IS NOT DISTINCT FROM s.source)"""]
    for k in range(1, levels + 1):
        steps += [f"""m{k} AS (SELECT i // {fanout} AS p, list(d ORDER BY i) AS ds,
  CASE WHEN sum(count(*)) OVER () > 1 THEN sha256(array_to_string(list(d ORDER BY i), '')) ELSE any_value(d) END AS d,
  sum(count(*)) OVER () > 1 AS up FROM (SELECT DISTINCT i, d FROM q{k - 1}) GROUP BY i // {fanout})""",
                  f"""q{k} AS (SELECT r, doc_id, leaf, subroot, CASE WHEN up THEN sha256(array_to_string(ds[:i % {fanout}], '') || now || array_to_string(ds[i % {fanout} + 2:], '')) ELSE now END AS now,
  CASE WHEN up THEN proof || array_to_string(ds[:i % {fanout}], '') || array_to_string(ds[i % {fanout} + 2:], '') ELSE proof END AS proof,
  n.p AS i, n.d FROM q{k - 1} b JOIN m{k} n ON b.i // {fanout} = n.p)"""]
    return "WITH " + ",\n".join(steps) + f"""
SELECT doc_id, leaf, subroot, d AS root, sha256(proof) AS proof_sha256, now AS folded_root, now = d AS verified FROM q{levels}"""


#: the contract of op12: rounds of sharing in a recursive query, running sums over whole sources
OP12_SQL = rf"""
WITH RECURSIVE doc AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
weight AS (SELECT source, source_size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w
  FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM doc GROUP BY source)),
rounds AS (
  SELECT 0 AS k, source, source_size, w, false AS over, CAST(sum(source_size) OVER () AS HUGEINT) AS rest, CAST(sum(w) OVER () AS HUGEINT) AS shared FROM weight
  UNION ALL
  SELECT k, source, source_size, w, over, rest, shared FROM (
    SELECT k, source, source_size, w, over, was,
           CAST(sum(source_size) OVER () - coalesce(sum(3 * source_size) FILTER (over) OVER (), 0) AS HUGEINT) AS rest,
           CAST(coalesce(sum(w) FILTER (NOT over) OVER (), 0) AS HUGEINT) AS shared,
           count(*) FILTER (over) OVER () AS now_over, count(*) FILTER (was) OVER () AS were_over
    FROM (SELECT k + 1 AS k, source, source_size, w, w * rest > 3 * source_size * shared AS over, over AS was, rest, shared FROM rounds))
  WHERE now_over > were_over AND shared > 0),
target AS (
  SELECT source, source_size, CASE WHEN w * rest > 3 * source_size * shared THEN CAST(3 * source_size AS DOUBLE)
                                   ELSE CAST(w AS DOUBLE) * CAST(rest AS DOUBLE) / CAST(shared AS DOUBLE) END AS target
  FROM rounds WHERE k = (SELECT max(k) FROM rounds)),
expected AS (
  SELECT source, source_size, target, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size * {mixing.UNIT}) AS BIGINT) ELSE 0 END AS e,
         CAST(('0x' || substr(sha256('{mixing.SEED}:' || coalesce(source, '')), 1, 6)) AS BIGINT) AS u
  FROM target),
run AS (
  SELECT doc_id, size, source_size, target, e, u,
         row_number() OVER (PARTITION BY d.source ORDER BY size, substr(sha256('{mixing.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 16), doc_id NULLS FIRST) AS i
  FROM doc d JOIN expected x ON d.source IS NOT DISTINCT FROM x.source)
SELECT doc_id, size, source_size, target, CAST((i * e + u) // {mixing.UNIT} - ((i - 1) * e + u) // {mixing.UNIT} AS BIGINT) AS copies,
       CAST(size * ((i * e + u) // {mixing.UNIT} - ((i - 1) * e + u) // {mixing.UNIT}) AS BIGINT) AS taken
FROM run
"""

#: the contract of op13, each different n-gram's checksum taken over its own bytes
OP13_SQL = rf"""
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
item AS (
  SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
doc_feature AS (SELECT r, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM doc),
item_feature AS (SELECT unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM item),
bucket AS (
  SELECT f, {crc_sql("f")} % {resample.BUCKETS} AS b
  FROM (SELECT f FROM doc_feature UNION SELECT f FROM item_feature), {CRC_TABLE}),
s AS (SELECT b, count(*) AS n FROM doc_feature JOIN bucket USING (f) GROUP BY b),
t AS (SELECT b, count(*) AS n FROM item_feature JOIN bucket USING (f) GROUP BY b),
gain AS (
  SELECT k AS b, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1) * (coalesce((SELECT sum(n) FROM s), 0) + {resample.BUCKETS}.0::DOUBLE)
       / ((coalesce(s.n, 0) + 1) * (coalesce((SELECT sum(n) FROM t), 0) + {resample.BUCKETS}.0::DOUBLE)))) AS BIGINT) AS g
  FROM range({resample.BUCKETS}) x(k) LEFT JOIN s ON s.b = k LEFT JOIN t ON t.b = k),
mean AS (SELECT r, count(*) AS n_features, CAST(floor(sum(g) / count(*)) AS BIGINT) AS weight
  FROM doc_feature JOIN bucket USING (f) JOIN gain USING (b) GROUP BY r),
scored AS (
  SELECT r, doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST(('0x' || substr(sha256('{resample.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8)) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM doc LEFT JOIN mean USING (r)),
placed AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST) AS place, count(*) OVER () AS able
  FROM scored WHERE n_words >= {resample.MIN_WORDS})
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score, CASE WHEN place <= {resample.PERCENT} * able // 100 THEN place END AS rank
FROM scored LEFT JOIN placed USING (r)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_sentencepiece": op1_sentencepiece, "op3_pii": op3_pii, "op4_html": op4_html, "op2_toxicity": op2_toxicity, "op5_langid": op5_langid, "op6_warc": op6_warc, "op7_sharding": op7_sharding,
            "op8_ngram_join": op8_ngram_join, "op9_embed_join": op9_embed_join,
            "op10_decontaminate": op10_decontaminate, "op11_manifest": op11_manifest, "op12_mixing": op12_mixing,
            "op13_resample": op13_resample}


def oracle_sql() -> dict[str, str]:
    return {"op10_decontaminate": OP10_SQL, "op11_manifest": op11_sql(), "op12_mixing": OP12_SQL, "op13_resample": OP13_SQL}

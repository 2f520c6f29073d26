"""Awkward documents that every operator must survive."""

LONG = "lorem ipsum dolor " * 20_000

DOCS = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank today"),
    (2, "The quick brown fox jumps over the lazy dog near the river bank today"),
    (2, "The quick brown fox jumps over the lazy dog near the river bank today"),  # a repeated row
    (3, None),
    (4, ""),
    (5, "  \n\t "),
    (6, "... !!! ???"),
    (7, LONG),
    (8, "short"),
    (9, "naïve café — 東京 🙂 ﬁn ▁ end"),
    (None, "a text without an id, by a@b.example or 10.0.0.1"),
    (None, None),
    (10, "x" * 50_000),
]

#: extra columns with names that operators use themselves
EXTRA = ("score", "shard", "size", "node", "label", "n_links", "key", "row", "term", "_text", "lang_pred", "ids")


def docs(spark, rows=DOCS, extra=True):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    if extra:
        from pyspark.sql import functions as F
        for c in EXTRA:
            df = df.withColumn(c, F.lit("other"))
    return df


def ids(df, *columns):
    """Rows as sorted tuples, null first."""
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=lambda r: [(v is not None, v) for v in r])

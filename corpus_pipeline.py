"""A corpus pipeline of the operators in ``tabeval.llm``: language, near copies, benchmark passages,
personal data, tokens.

Each stage takes (spark, docs, sf_dir), works on every row its predecessor kept and returns a DataFrame;
between stages the rows are written as Parquet and read again. All stages but the last return the
columns of ``docs``.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabeval.llm import decontaminate, langid, ngram_join, pieces, pii
from tabeval.functions.columns import named
from tabeval.llm.common import freeze, packed, table, unpacked
from tabeval.llm.queries import PIECES
from tabeval.operators.ordered import drop, recorded

#: the stages work on texts; SQL can express neither the language model nor the segmentation
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that no language's classifier accepts: null texts, texts without a letter, and
    texts with a margin under -0.2 for every language. Where lang is null it becomes the language found.
    Without any labelled text only texts without a letter are rejected."""
    model = langid.train(docs, F.lit(True))
    if not model.classes:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = langid.predict(packed(docs, "text").withColumn("read", F.col("text")), model, "read")
    kept = found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= langid.ACCEPT))
    return kept.select(*unpacked(kept, docs.columns, "text", {"lang": F.coalesce(F.col("doc")["lang"], F.col("lang_pred"))}))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest doc_id."""
    return ngram_join.keep_one(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts the benchmark's passages out of the texts; a document of which no word is left goes."""
    cut = decontaminate.remove(docs, table(spark, sf_dir, "benchmark"))
    return cut.where(F.col("text").rlike(r"[\p{L}\p{N}]"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data and generalises or removes the terms that disclose it."""
    return pii.sanitise(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their piece ids; n_chars is that of the final text. Columns of ``docs`` that are
    named like the new ones (ids, n_ids, round_trip) give way to them."""
    new = ["ids", "n_ids", "round_trip"]
    columns = [c for c in docs.columns if c.lower() not in new]
    texts = packed(docs.select(*[named(c) for c in columns]), "text").withColumn("read", F.col("text"))
    found = pieces.encode(texts, pieces.Vocabulary.load(PIECES), "read")
    return found.select(*unpacked(found, columns, "text", {"n_chars": F.length("text").cast("long")}), *new)


#: folders of the tables that the last stage made on its way to its result
_made: list[str] = []


def cleaned(stage):
    """``stage``; what the stage before it left behind goes first, as its result is written by then. A stage's
    ``docs`` must therefore be written tables, as STAGES are run."""
    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop(spark, _made)
        with recorded() as made:
            out = stage(spark, docs, sf_dir)
        _made.extend(made)
        return out
    return run_stage


STAGES = [(stage.__name__, cleaned(stage)) for stage in (language, near_copies, benchmark_passages, personal_data, tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written to the shared folder and read again."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        result = stage(spark, docs, sf_dir)
        with recorded() as path:
            docs = freeze(result, name)
        drop(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)

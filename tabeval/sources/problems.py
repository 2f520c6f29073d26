"""Binary problems and prediction sets derived from the driver's tables.

Each builder has a Spark form (used by the query catalogue) and the SQL text of
the same derivation (used by the DuckDB oracle), kept side by side so the two
stay in step. See FIXTURES.md section B for the mapping.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .io import read_table


def doc_labels(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    labels = read_table(spark, d, "labels")
    return docs.join(labels, "doc_id")


DOC_LABELS_SQL = """doc_labels AS (
  SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


def doc_predictions(spark: SparkSession, d: str) -> DataFrame:
    """Two outcomes (quality, toxic) scored by document length."""
    dl = doc_labels(spark, d)
    return dl.select("doc_id", F.expr(
        "stack(2, 'quality', quality, 'toxic', toxic) as (outcome, y)"),
        F.col("n_chars").cast("double").alias("score"))


DOC_PRED_SQL = DOC_LABELS_SQL + """,
doc_pred AS (
  SELECT doc_id, 'quality' AS outcome, quality AS y, CAST(n_chars AS DOUBLE) AS score FROM doc_labels
  UNION ALL
  SELECT doc_id, 'toxic' AS outcome, toxic AS y, CAST(n_chars AS DOUBLE) AS score FROM doc_labels)"""


def lineitem_predictions(spark: SparkSession, d: str) -> DataFrame:
    """Two 'models' (price, qty) x two outcomes (returned, open) on every lineitem."""
    li = read_table(spark, d, "lineitem").select(
        (F.col("l_returnflag") == "R").cast("int").alias("y_ret"),
        (F.col("l_linestatus") == "O").cast("int").alias("y_open"),
        "l_extendedprice", "l_quantity")
    return li.select(F.expr(
        "stack(4, 'price', 'returned', y_ret, l_extendedprice, 'price', 'open', y_open, l_extendedprice,"
        " 'qty', 'returned', y_ret, l_quantity, 'qty', 'open', y_open, l_quantity)"
        " as (algorithm, outcome, y, score)"))


LINEITEM_PRED_SQL = """li_pred AS (
  SELECT 'price' AS algorithm, 'returned' AS outcome, CAST(l_returnflag = 'R' AS INTEGER) AS y, l_extendedprice AS score FROM lineitem
  UNION ALL SELECT 'price', 'open', CAST(l_linestatus = 'O' AS INTEGER), l_extendedprice FROM lineitem
  UNION ALL SELECT 'qty', 'returned', CAST(l_returnflag = 'R' AS INTEGER), l_quantity FROM lineitem
  UNION ALL SELECT 'qty', 'open', CAST(l_linestatus = 'O' AS INTEGER), l_quantity FROM lineitem)"""


def orders_problem(spark: SparkSession, d: str) -> DataFrame:
    """Unique-key binary problem: y = fulfilled order, score = total price."""
    o = read_table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("row_id"),
                    (F.col("o_orderstatus") == "F").cast("int").alias("y"),
                    F.col("o_totalprice").alias("score"), "o_orderpriority", "o_custkey")


ORDERS_SQL = """ord AS (
  SELECT o_orderkey AS row_id, CAST(o_orderstatus = 'F' AS INTEGER) AS y, o_totalprice AS score,
         o_orderpriority, o_custkey
  FROM orders)"""


def wide_lineitem(spark: SparkSession, d: str) -> DataFrame:
    """Mixed-type table with injected NULL, +inf and a textual missing marker
    (the driver tables have none; the injection is identical in the SQL)."""
    li = read_table(spark, d, "lineitem")
    return li.select(
        F.when(F.col("l_quantity") != 7, F.col("l_quantity")).alias("qty"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_discount").alias("disc"),
        F.when(F.col("l_linenumber") == 3, F.lit(float("inf"))).otherwise(F.col("l_tax")).alias("tax"),
        F.col("l_linenumber").alias("line"),
        F.col("l_linestatus").alias("status"),
        F.when((F.col("l_returnflag") == "N") & (F.col("l_linenumber") == 5), F.lit("None"))
        .otherwise(F.col("l_returnflag")).alias("flag"),
        (F.col("l_returnflag") == "R").cast("int").alias("y_ret"),
        (F.col("l_linestatus") == "O").cast("int").alias("y_open"))


WIDE_SQL = """wide AS (
  SELECT NULLIF(l_quantity, 7) AS qty, l_extendedprice AS price, l_discount AS disc,
    CASE WHEN l_linenumber = 3 THEN CAST('inf' AS DOUBLE) ELSE l_tax END AS tax, l_linenumber AS line,
    l_linestatus AS status, CASE WHEN l_returnflag = 'N' AND l_linenumber = 5 THEN 'None' ELSE l_returnflag END AS flag,
    CAST(l_returnflag = 'R' AS INTEGER) AS y_ret, CAST(l_linestatus = 'O' AS INTEGER) AS y_open
  FROM lineitem)"""

WIDE_INPUTS = ["qty", "price", "disc", "tax", "line", "status", "flag"]
WIDE_OUTCOMES = ["y_ret", "y_open"]

#: experiment plans over the wide table: disc is ignored by e2, so it is not an input
WIDE_ROLES = [("e1", c, 1) for c in WIDE_INPUTS] + [("e1", o, 2) for o in WIDE_OUTCOMES] \
    + [("e2", c, 0 if c == "disc" else 1) for c in WIDE_INPUTS] + [("e2", o, 2) for o in WIDE_OUTCOMES]

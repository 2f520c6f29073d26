"""Registered queries: splits, folds, targets, under/over-sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sample as sp
from ..sources.io import read_table
from ..sources.problems import ORDERS_SQL, orders_problem
from .registry import register

SEED = 42


def _rank_sql(part: str, seed_expr: str = f"'{SEED}:'") -> str:
    by = f"PARTITION BY {part} " if part else ""
    return f"ROW_NUMBER() OVER ({by}ORDER BY md5({seed_expr} || CAST(row_id AS VARCHAR)), row_id)"


def _orders(spark, d):
    return orders_problem(spark, d).select("row_id", "y")


# ------------------------------------------------------------ split_stratified
_SPLIT_SQL = f"""WITH {ORDERS_SQL},
r AS (SELECT row_id, y, {_rank_sql('y')} AS rnk, COUNT(*) OVER (PARTITION BY y) AS n FROM ord)
SELECT row_id, y, CASE WHEN rnk <= round(n * 0.2) THEN 'test' ELSE 'train' END AS split FROM r"""


@register("split_stratified", _SPLIT_SQL)
def q_split(spark, d):
    return sp.split_stratified(_orders(spark, d), "y", "row_id", 0.2, SEED)


_CC_SQL = f"""WITH {ORDERS_SQL},
r AS (SELECT row_id, y, {_rank_sql('y')} AS rnk, COUNT(*) OVER (PARTITION BY y) AS n FROM ord),
s AS (SELECT y, CASE WHEN rnk <= round(n * 0.2) THEN 'test' ELSE 'train' END AS split FROM r)
SELECT split, y, CAST(COUNT(*) AS BIGINT) AS count FROM s GROUP BY split, y"""


@register("class_counts", _CC_SQL)
def q_class_counts(spark, d):
    s = sp.split_stratified(_orders(spark, d), "y", "row_id", 0.2, SEED)
    return s.groupBy("split", "y").agg(F.count(F.lit(1)).cast("long").alias("count"))


# ---------------------------------------------------------------------- folds
_KF_SQL = f"""WITH {ORDERS_SQL}
SELECT row_id, CAST(({_rank_sql('')} - 1) * 5 // COUNT(*) OVER () AS INTEGER) AS fold FROM ord"""


@register("kfold", _KF_SQL)
def q_kfold(spark, d):
    return sp.kfold(_orders(spark, d).select("row_id"), "row_id", 5, SEED)


_SKF_SQL = f"""WITH {ORDERS_SQL}
SELECT row_id, y, CAST(({_rank_sql('y')} - 1) * 5 // COUNT(*) OVER (PARTITION BY y) AS INTEGER) AS fold FROM ord"""


@register("kfold_stratified", _SKF_SQL)
def q_kfold_stratified(spark, d):
    return sp.kfold_stratified(_orders(spark, d), "y", "row_id", 5, SEED)


_RKF_SQL = f"""WITH {ORDERS_SQL},
rep AS (SELECT row_id, y, CAST(r AS INTEGER) AS repeat FROM ord, range(2) t(r))
SELECT row_id, y, repeat,
  CAST((ROW_NUMBER() OVER (PARTITION BY repeat, y ORDER BY md5(CAST({SEED} + repeat AS VARCHAR) || ':' || CAST(row_id AS VARCHAR)), row_id) - 1) * 5 // COUNT(*) OVER (PARTITION BY repeat, y) AS INTEGER) AS fold
FROM rep"""


@register("kfold_repeated", _RKF_SQL)
def q_kfold_repeated(spark, d):
    return sp.kfold_repeated(_orders(spark, d), "y", "row_id", 5, 2, SEED)


# -------------------------------------------------------------------- targets
_STRATS = [("over", s, None) for s in sp.OVER_STRATEGIES] + [("under", s, None) for s in sp.UNDER_STRATEGIES] \
    + [("over", "ratio", 0.8), ("under", "ratio", 0.8)]


def _chosen_sql(kind: str, strategy: str) -> str:
    if strategy == "ratio":
        return "y = ymin" if kind == "over" else "y = ymax"
    return {
        ("over", "auto"): "y <> ymax", ("over", "not majority"): "y <> ymax", ("over", "minority"): "y = ymin",
        ("over", "not minority"): "y <> ymin", ("over", "all"): "TRUE",
        ("under", "auto"): "y <> ymin", ("under", "not minority"): "y <> ymin", ("under", "majority"): "y = ymax",
        ("under", "not majority"): "y <> ymax", ("under", "all"): "TRUE",
    }[(kind, strategy)]


def _goal_sql(kind: str, ratio) -> str:
    if ratio is not None:
        return f"floor({ratio} * mx)" if kind == "over" else f"floor(mn / {ratio})"
    return "mx" if kind == "over" else "mn"


_TG_SQL = """WITH cc AS (SELECT l_returnflag AS y, CAST(COUNT(*) AS BIGINT) AS cnt FROM lineitem GROUP BY l_returnflag),
mm AS (SELECT MAX(cnt) AS mx, MIN(cnt) AS mn, FIRST(y ORDER BY cnt DESC, y) AS ymax, FIRST(y ORDER BY cnt, y) AS ymin FROM cc)
""" + "\nUNION ALL\n".join(
    f"SELECT '{k}' AS kind, '{s}' AS strategy, y, cnt AS count, CAST(CASE WHEN {_chosen_sql(k, s)} THEN "
    f"{'greatest' if k == 'over' else 'least'}({_goal_sql(k, r)}, cnt) ELSE cnt END AS BIGINT) AS target FROM cc, mm"
    for k, s, r in _STRATS)


@register("sampling_targets", _TG_SQL)
def q_targets(spark, d):
    li = read_table(spark, d, "lineitem").select(F.col("l_returnflag").alias("y"))
    out = None
    for k, s, r in _STRATS:
        t = sp.sampling_targets(li, "y", k, s, r).select(F.lit(k).alias("kind"), F.lit(s).alias("strategy"),
                                                          "y", "count", "target")
        out = t if out is None else out.unionByName(t)
    return out


# ------------------------------------------------------------- under / over
_US_SQL = f"""WITH {ORDERS_SQL},
cc AS (SELECT y, COUNT(*) AS cnt FROM ord GROUP BY y),
r AS (SELECT row_id, y, {_rank_sql('y')} AS rnk FROM ord)
SELECT row_id, y FROM r WHERE rnk <= (SELECT MIN(cnt) FROM cc)"""


@register("undersample", _US_SQL)
def q_undersample(spark, d):
    return sp.undersample(_orders(spark, d), "y", "row_id", "auto", None, SEED)


_OS_SQL = f"""WITH {ORDERS_SQL},
cc AS (SELECT y, COUNT(*) AS cnt FROM ord GROUP BY y),
need AS (SELECT y, cnt, (SELECT MAX(cnt) FROM cc) - cnt AS extra FROM cc WHERE cnt < (SELECT MAX(cnt) FROM cc)),
copies AS (SELECT y, cnt, UNNEST(range(extra)) AS j FROM need),
picks AS (SELECT y, j + 1 AS copy,
  (('0x' || substr(md5('{SEED}:' || CAST(y AS VARCHAR) || ':' || CAST(j AS VARCHAR)), 1, 15))::BIGINT % cnt) + 1 AS rnk FROM copies),
r AS (SELECT row_id, y, {_rank_sql('y')} AS rnk FROM ord)
SELECT row_id, y, CAST(0 AS BIGINT) AS copy FROM ord
UNION ALL
SELECT r.row_id, r.y, CAST(p.copy AS BIGINT) FROM picks p JOIN r ON p.y = r.y AND p.rnk = r.rnk"""


@register("oversample", _OS_SQL)
def q_oversample(spark, d):
    return sp.oversample(_orders(spark, d), "y", "row_id", "auto", None, SEED)

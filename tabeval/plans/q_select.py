"""Registered queries: feature selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import select as sl
from ..sources.io import read_table
from .registry import register, rounded

FEATS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


def _li(spark, d):
    li = read_table(spark, d, "lineitem")
    return li.select((F.col("l_returnflag") == "R").cast("int").alias("y"), *FEATS)


_LI_SQL = f"""li AS (SELECT CAST(l_returnflag = 'R' AS INTEGER) AS y, {', '.join(f'CAST({f} AS DOUBLE) AS {f}' for f in FEATS)} FROM lineitem),
m AS (SELECT y, CAST(COUNT(*) AS DOUBLE) AS n, {', '.join(f'SUM({f}) AS s{i}' for i, f in enumerate(FEATS))} FROM li GROUP BY y),
lng AS ({' UNION ALL '.join(f"SELECT y, n, '{f}' AS feature, {i} AS idx, s{i} AS s FROM m" for i, f in enumerate(FEATS))})"""

#: the ANOVA features: also one far from zero and one with missing values
F_FEATS = [*FEATS, "price_far", "qty_missing"]


def _li_f(spark, d):
    return _li(spark, d).withColumn("price_far", F.col("l_extendedprice") + 1e9).withColumn(
        "qty_missing", F.when(F.col("l_quantity") != 7, F.col("l_quantity")))


def _f_sql(feats: list[str]) -> str:
    """F from class means and variances, over each feature's own non-missing values."""
    per = " UNION ALL ".join(
        f"SELECT '{f}' AS feature, {i} AS idx, y, CAST(COUNT({f}) AS DOUBLE) AS n, AVG({f}) AS m, VAR_POP({f}) AS v FROM li GROUP BY y"
        for i, f in enumerate(feats))
    return f"""li AS (SELECT CAST(l_returnflag = 'R' AS INTEGER) AS y, {', '.join(f'CAST({f} AS DOUBLE) AS {f}' for f in FEATS)},
  l_extendedprice + 1e9 AS price_far, NULLIF(l_quantity, 7) AS qty_missing FROM lineitem),
m AS ({per}),
g AS (SELECT feature, SUM(n * m) / SUM(n) AS g, SUM(n) AS nn, COUNT(*) AS c FROM m GROUP BY feature),
fs AS (SELECT m.feature, MAX(idx) AS idx, (SUM(n * (m - g) * (m - g)) / (MAX(c) - 1)) / (SUM(n * v) / (MAX(nn) - MAX(c))) AS score
       FROM m JOIN g ON m.feature = g.feature GROUP BY m.feature)"""


_F_SQL, _F_SQL_PLAIN = _f_sql(F_FEATS), _f_sql(FEATS)

_CHI_SQL = f"""{_LI_SQL},
tt AS (SELECT feature, SUM(n) AS tn, SUM(s) AS ts FROM lng GROUP BY feature),
fs AS (SELECT l.feature, MAX(l.idx) AS idx, SUM((l.s - l.n / tt.tn * tt.ts) * (l.s - l.n / tt.tn * tt.ts) / (l.n / tt.tn * tt.ts)) AS score
       FROM lng l JOIN tt ON l.feature = tt.feature GROUP BY l.feature)"""


def _kbest_sql(base: str, k: int, digits: int = 6) -> str:
    return f"""WITH {base}
SELECT feature, round(score, {digits}) AS score, CAST(ROW_NUMBER() OVER (ORDER BY score DESC NULLS LAST, idx DESC) AS INTEGER) AS rank,
  ROW_NUMBER() OVER (ORDER BY score DESC NULLS LAST, idx DESC) <= {k} AS selected FROM fs"""


@register("select_kbest_f", _kbest_sql(_F_SQL, 3, 4))  # price_far holds 6 digits less
def q_kbest_f(spark, d):
    return rounded(sl.select_k_best(sl.f_scores(_li_f(spark, d), F_FEATS, "y"), F_FEATS, 3), 4)


@register("select_kbest_chi2", _kbest_sql(_CHI_SQL, 3))
def q_kbest_chi2(spark, d):
    return rounded(sl.select_k_best(sl.chi2_scores(_li(spark, d), FEATS, "y"), FEATS, 3))


_PCT = 40.0
_PCT_SQL = f"""WITH {_F_SQL},
th AS (SELECT quantile_cont(score, {(100.0 - _PCT) / 100.0}) AS thr FROM fs),
s AS (SELECT fs.*, th.thr, score > thr AS above, score = thr AS tie FROM fs, th),
s2 AS (SELECT *, SUM(CAST(above AS INTEGER)) OVER () AS n_above,
         SUM(CAST(tie AS INTEGER)) OVER (ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tie_rank FROM s)
SELECT feature, round(score, 4) AS score, above OR (tie AND tie_rank <= {int(len(F_FEATS) * _PCT / 100)} - n_above) AS selected FROM s2"""


@register("select_percentile", _PCT_SQL)
def q_percentile(spark, d):
    return rounded(sl.select_percentile(sl.f_scores(_li_f(spark, d), F_FEATS, "y"), F_FEATS, _PCT), 4)


_VAR_SQL = "WITH li AS (SELECT " + ", ".join(f"CAST({f} AS DOUBLE) AS {f}" for f in FEATS) + " FROM lineitem)\n" + \
    "\nUNION ALL\n".join(f"SELECT '{f}' AS feature, round(VAR_POP({f}), 3) AS variance, VAR_POP({f}) > 0 AS selected FROM li"
                         for f in FEATS)


@register("select_variance", _VAR_SQL)
def q_variance(spark, d):
    # variances reach 1e9: 3 decimals is what a double resolves independently of summation order
    return rounded(sl.select_variance(_li(spark, d), FEATS, 0.0), 3)


def _mrmr_sql(k: int = 3) -> str:
    """Greedy MRMR unrolled for k steps: relevance F, redundancy mean |corr|
    with the features already chosen (floor 0.001), ties to the earlier feature."""
    corr = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, abs(CORR({a}, {b})) AS r FROM li"
                              for i, a in enumerate(FEATS) for b in FEATS[i + 1:])
    steps = [f"s1 AS (SELECT feature, idx, score FROM fs ORDER BY score DESC, idx LIMIT 1)"]
    for n in range(2, k + 1):
        prev = " UNION ALL ".join(f"SELECT feature FROM s{m}" for m in range(1, n))
        steps.append(f"""s{n} AS (SELECT fs.feature, fs.idx, fs.score FROM fs
  WHERE fs.feature NOT IN ({prev})
  ORDER BY fs.score / greatest((SELECT AVG(coalesce(cp.r, 0)) FROM ({prev}) ch
                                LEFT JOIN cpair cp ON cp.a = fs.feature AND cp.b = ch.feature), 0.001) DESC, fs.idx LIMIT 1)""")
    out = " UNION ALL ".join(f"SELECT feature, {n} AS rank, score FROM s{n}" for n in range(1, k + 1))
    return f"""WITH {_F_SQL_PLAIN},
cp0 AS ({corr}),
cpair AS (SELECT a, b, r FROM cp0 UNION ALL SELECT b, a, r FROM cp0),
{', '.join(steps)}
SELECT feature, CAST(rank AS INTEGER) AS rank, round(score, 6) AS f_score FROM ({out})"""


@register("select_mrmr", _mrmr_sql(3))
def q_mrmr(spark, d):
    return rounded(sl.select_mrmr(_li(spark, d), FEATS, "y", 3))

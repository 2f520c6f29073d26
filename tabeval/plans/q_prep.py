"""Registered queries: scans/sinks, roles, cleaning, encoding, profiling."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import scalar as fs
from ..operators import clean as cl
from ..operators import encode as en
from ..operators import evaluate as ev
from ..operators import profile as pf
from ..operators import rates as rt
from ..operators.ordered import prefix_sum
from ..session import ensure_checkpoint_dir
from ..sources import io
from ..sources.problems import (DOC_LABELS_SQL, WIDE_INPUTS, WIDE_OUTCOMES, WIDE_ROLES, WIDE_SQL, doc_labels,
                                wide_lineitem)
from .q_curves import CV_CUT, CV_SQL, cv_predictions
from .registry import register, rounded
from .sqlgen import score_groups_sql


def _scratch(spark, name: str) -> str:
    """A fresh folder under the session's shared checkpoint directory."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/tabeval-{name}-{uuid.uuid4().hex}"


# ------------------------------------------------------------------ 2.1 I/O
@register("scan_table", "SELECT * FROM orders")
def q_scan(spark, d):
    return io.scan_table(spark, io.table_path(d, "orders"))


@register("sink_table", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def q_sink(spark, d):
    path = _scratch(spark, "sink")
    src = io.read_table(spark, d, "orders").drop("o_orderdate")
    io.sink_table(src, path, "csv")
    schema = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderpriority string"
    return io.scan_table(spark, path, "csv", schema=schema)


_SINK_RES_SQL = """SELECT CAST(o_orderstatus = 'F' AS INTEGER) AS y, CAST(COUNT(*) AS BIGINT) AS count,
  'orders' AS experiment, 'whole' AS test_set FROM orders GROUP BY 1"""


@register("sink_results", _SINK_RES_SQL)
def q_sink_results(spark, d):
    path = _scratch(spark, "results")
    o = io.read_table(spark, d, "orders")
    res = o.groupBy((F.col("o_orderstatus") == "F").cast("int").alias("y")).agg(
        F.count(F.lit(1)).cast("long").alias("count")) \
        .withColumn("experiment", F.lit("orders")).withColumn("test_set", F.lit("whole"))
    io.sink_results(res, path)
    return spark.read.parquet(path).select("y", "count", "experiment", "test_set")


# ------------------------------------------------------------------ roles
_ROLES_VALUES = ", ".join(f"('{e}', '{c}', {r})" for e, c, r in WIDE_ROLES)
_ROLE_SQL = f"""WITH {WIDE_SQL}
SELECT qty, price, tax, line, status, flag, y_ret, y_open FROM wide"""


@register("role_project", _ROLE_SQL)
def q_role_project(spark, d):
    """Resolve the experiment roles (a column is an input only if every plan
    marks it 1, an outcome only if every plan marks it 2) and project the
    table onto inputs then outcomes."""
    wide = wide_lineitem(spark, d)
    ins, outs = cl.role_lists(cl.role_table(spark, WIDE_ROLES), wide.columns)
    return rounded(wide.select(*ins, *outs))


_INPUTS = [c for c in WIDE_INPUTS if c != "disc"]  # e2 ignores disc

_TOKENS_IN = "('nan', 'NaN', 'None', 'NONE', '<NA>', 'null', '')"
#: the wide table after categorical token cleaning (flag 'None' -> NULL)
WIDE_TOK_SQL = f"""{WIDE_SQL.replace('wide AS', 'wide0 AS')},
wide AS (SELECT qty, price, disc, tax, line, status,
  CASE WHEN flag IN {_TOKENS_IN} THEN NULL ELSE flag END AS flag, y_ret, y_open FROM wide0)"""


@register("split_xy", f"WITH {WIDE_SQL} SELECT {', '.join(_INPUTS)} FROM wide")
def q_split_xy(spark, d):
    wide = wide_lineitem(spark, d)
    ins, outs = cl.role_lists(cl.role_table(spark, WIDE_ROLES), wide.columns)
    x, _ = cl.split_xy(wide, ins, outs)
    return rounded(x)


_DTYPES = {"qty": "double", "price": "double", "disc": "double", "tax": "double", "line": "int",
           "status": "string", "flag": "string"}


def _kind_sql(c: str) -> str:
    nu = f"CAST(COUNT(DISTINCT {c}) + MAX(CAST({c} IS NULL AS INTEGER)) AS BIGINT)"
    dt = _DTYPES[c]
    kind = "'categorical'" if dt == "string" else f"CASE WHEN {nu} < 10 THEN 'categorical' ELSE 'numeric' END"
    return f"SELECT '{c}' AS \"column\", '{dt}' AS dtype, {nu} AS n_unique, {kind} AS kind FROM wide"


#: ids above 2^53, which a double can't tell apart
_BIG = "1152921504606846976 + CAST(round(price * 100) AS BIGINT)"
_DTYPES["big"] = "bigint"
_KINDS_SQL = f"WITH {WIDE_SQL.replace('wide AS', 'wide0 AS')},\nwide AS (SELECT *, {_BIG} AS big FROM wide0)\n" + \
    "\nUNION ALL\n".join(_kind_sql(c) for c in [*WIDE_INPUTS, "big"])


@register("infer_column_kinds", _KINDS_SQL)
def q_kinds(spark, d):
    return cl.infer_column_kinds(wide_lineitem(spark, d).withColumn("big", F.expr(_BIG)), [*WIDE_INPUTS, "big"], 10)


# ------------------------------------------------------------- column removal
@register("drop_columns", f"WITH {WIDE_SQL} SELECT qty, price, tax, line, status, flag, y_ret, y_open FROM wide")
def q_drop_columns(spark, d):
    return rounded(cl.drop_columns(wide_lineitem(spark, d), ["disc", "y_ret"], keep=["y_ret"]))


_SPARSE_SQL = f"WITH {WIDE_TOK_SQL}\n" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", round(CAST(COUNT({c}) AS DOUBLE) / COUNT(*), 6) AS non_null_share, "
    f"CAST(COUNT({c}) AS DOUBLE) / COUNT(*) < 0.99 {'AND FALSE' if c == 'price' else ''} AS dropped FROM wide"
    for c in WIDE_INPUTS)


@register("drop_sparse_columns", _SPARSE_SQL)
def q_drop_sparse_columns(spark, d):
    wide = cl.clean_categoricals(wide_lineitem(spark, d), ["status", "flag"])
    return rounded(cl.sparse_column_report(wide, WIDE_INPUTS, 0.99, keep=["price"]))


_NUM = ["qty", "price", "disc"]
_LV_SQL = f"WITH {WIDE_SQL}\n" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", round(STDDEV_POP({c}), 6) AS std_pop, STDDEV_POP({c}) < 0.2 AS dropped FROM wide"
    for c in _NUM)


@register("drop_low_variance", _LV_SQL)
def q_drop_low_variance(spark, d):
    return rounded(cl.low_variance_report(wide_lineitem(spark, d), _NUM, 0.2))


_CORR_COLS = ["qty", "price", "disc", "tax"]
_CLEAN_TAX = "CASE WHEN isinf(tax) THEN NULL ELSE tax END"
_WIDE_CLEAN_SQL = f"""{WIDE_SQL.replace('wide AS', 'wide0 AS')},
wide AS (SELECT qty, price, disc, {_CLEAN_TAX} AS tax, line, status, flag, y_ret, y_open FROM wide0)"""


def _wide_clean(spark, d):
    w = wide_lineitem(spark, d)
    return w.withColumn("tax", fs.replace_inf("tax", "null"))


def _pairs_sql() -> str:
    parts = []
    for i, a in enumerate(_CORR_COLS):
        for b in _CORR_COLS[i + 1:]:
            parts.append(f"SELECT '{a}' AS a, '{b}' AS b, CORR({a}, {b}) AS r FROM wide")
    return "\nUNION ALL\n".join(parts)


_DROPCORR_SQL = f"""WITH {_WIDE_CLEAN_SQL},
pairs AS ({_pairs_sql()}),
cols(c) AS (VALUES {', '.join(f"('{c}')" for c in _CORR_COLS)})
SELECT c AS "column", EXISTS (SELECT 1 FROM pairs WHERE pairs.b = cols.c AND abs(r) >= 0.5) AS dropped FROM cols"""


@register("drop_correlated", _DROPCORR_SQL)
def q_drop_correlated(spark, d):
    return cl.correlated_report(_wide_clean(spark, d), _CORR_COLS, 0.5)


_ROWS_SQL = f"""WITH {WIDE_TOK_SQL}
SELECT * FROM wide WHERE ({' + '.join(f'CAST({c} IS NOT NULL AS INTEGER)' for c in WIDE_INPUTS)}) >= 7"""


@register("drop_sparse_rows", _ROWS_SQL)
def q_drop_sparse_rows(spark, d):
    wide = cl.clean_categoricals(wide_lineitem(spark, d), ["status", "flag"])
    return rounded(cl.drop_sparse_rows(wide, WIDE_INPUTS, 1.0))


_OUT_SQL = f"""WITH {WIDE_SQL}
SELECT * FROM wide WHERE NOT (coalesce(qty > 50000, FALSE) OR coalesce(price > 50000, FALSE)
  OR coalesce(disc > 50000, FALSE) OR coalesce(tax > 50000, FALSE))"""


@register("filter_outlier_rows", _OUT_SQL)
def q_filter_outliers(spark, d):
    return rounded(cl.filter_outlier_rows(wide_lineitem(spark, d), ["qty", "price", "disc", "tax"], 50000.0))


_DOC_OUT = ["quality", "toxic", "rare"]
_MINPOS_SQL = f"""WITH {DOC_LABELS_SQL},
dl AS (SELECT quality, toxic, CAST(doc_id % 97 = 0 AS INTEGER) AS rare FROM doc_labels)
""" + "\nUNION ALL\n".join(
    f"SELECT '{o}' AS outcome, CAST(SUM(CASE WHEN {o} = 1 THEN 1 ELSE 0 END) AS BIGINT) AS positives, "
    f"SUM(CASE WHEN {o} = 1 THEN 1 ELSE 0 END) >= 10 AS kept FROM dl" for o in _DOC_OUT)


def _doc_outcomes(spark, d):
    return doc_labels(spark, d).withColumn("rare", (F.col("doc_id") % 97 == 0).cast("int"))


@register("filter_min_positives", _MINPOS_SQL)
def q_min_positives(spark, d):
    return cl.outcome_positives(_doc_outcomes(spark, d), _DOC_OUT, 10)


@register("excluded_outcomes", f"SELECT outcome, positives FROM ({_MINPOS_SQL}) t WHERE NOT kept")
def q_excluded(spark, d):
    return cl.outcome_positives(_doc_outcomes(spark, d), _DOC_OUT, 10).where(~F.col("kept")).drop("kept")


# The set checks run after data-driven column removal, as in the reference's
# preparation pages: the training table loses the columns its report drops,
# the test table keeps them.
def _sparse_dropped_sql(select: str) -> str:
    return f"""WITH {WIDE_TOK_SQL},
rep AS ({' UNION ALL '.join(f"SELECT '{c}' AS col, CAST(COUNT({c}) AS DOUBLE) / COUNT(*) < 0.99 AS dropped FROM wide" for c in WIDE_INPUTS)})
{select}"""


def _train_after_sparse_drop(spark, d):
    wide = cl.clean_categoricals(wide_lineitem(spark, d), ["status", "flag"])
    return wide, cl.apply_report(wide, cl.sparse_column_report(wide, WIDE_INPUTS, 0.99))


@register("check_same_features",
          _sparse_dropped_sql("""SELECT col AS "column", 'train' AS missing_in FROM rep WHERE dropped"""))
def q_same_features(spark, d):
    test, train = _train_after_sparse_drop(spark, d)
    return cl.column_set_diff(train, test)


@register("check_required_columns", _sparse_dropped_sql("""SELECT col AS "column" FROM rep WHERE dropped"""))
def q_required(spark, d):
    _, train = _train_after_sparse_drop(spark, d)
    return cl.missing_required(train, WIDE_INPUTS)


@register("set_diff_columns", f"""WITH {WIDE_SQL},
rep AS ({' UNION ALL '.join(f"SELECT '{c}' AS col, STDDEV_POP({c}) < 0.2 AS dropped FROM wide" for c in _NUM)})
SELECT col AS "column" FROM rep WHERE dropped""")
def q_set_diff(spark, d):
    before = wide_lineitem(spark, d)
    after = cl.apply_report(before, cl.low_variance_report(before, _NUM, 0.2))
    a = spark.createDataFrame([(c,) for c in before.columns], "column string")
    b = spark.createDataFrame([(c,) for c in after.columns], "column string")
    return a.exceptAll(b)


# ------------------------------------------------------------- 2.3 scalars
@register("normalize_missing_tokens", f"""WITH {WIDE_SQL}
SELECT CASE WHEN flag IN ('nan', 'NaN', 'None', 'NONE', '<NA>', 'null', '') THEN NULL ELSE flag END AS flag,
  CAST(COUNT(*) AS BIGINT) AS count FROM wide GROUP BY 1""")
def q_tokens(spark, d):
    w = wide_lineitem(spark, d)
    return w.groupBy(fs.normalize_missing_tokens("flag").alias("flag")).agg(F.count(F.lit(1)).cast("long").alias("count"))


@register("replace_inf", f"""WITH {WIDE_SQL}
SELECT line, CASE WHEN isinf(tax) THEN NULL ELSE tax END AS tax_null, CASE WHEN isinf(tax) THEN 0.0 ELSE tax END AS tax_zero FROM wide""")
def q_replace_inf(spark, d):
    w = wide_lineitem(spark, d)
    return rounded(w.select("line", fs.replace_inf("tax", "null").alias("tax_null"),
                            fs.replace_inf("tax", "zero").alias("tax_zero")))


@register("log_large_values", f"""WITH {WIDE_SQL}
SELECT price, round(CASE WHEN price > 50000 THEN ln(price) ELSE price END, 6) AS price_log FROM wide""")
def q_log_large(spark, d):
    w = wide_lineitem(spark, d)
    return rounded(w.select("price", fs.log_large_values("price", 50000.0).alias("price_log")))


@register("coerce_numeric", """SELECT txt, TRY_CAST(txt AS DOUBLE) AS value FROM (
  SELECT CASE WHEN l_linenumber IN (2, 4, 6) THEN CAST(l_quantity AS VARCHAR) ELSE l_returnflag END AS txt FROM lineitem)""")
def q_coerce(spark, d):
    li = io.read_table(spark, d, "lineitem")
    txt = F.when(F.col("l_linenumber").isin(2, 4, 6), F.col("l_quantity").cast("string")).otherwise(F.col("l_returnflag"))
    return rounded(li.select(txt.alias("txt")).select("txt", fs.coerce_numeric(F.col("txt")).alias("value")))


_BINS = [["1-URGENT", "2-HIGH"], ["3-MEDIUM"], ["4-NOT SPECIFIED", "5-LOW"]]


@register("apply_coding", """SELECT o_orderpriority, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1
  WHEN o_orderpriority IN ('3-MEDIUM') THEN 2 WHEN o_orderpriority IN ('4-NOT SPECIFIED', '5-LOW') THEN 3 END AS code,
  CAST(COUNT(*) AS BIGINT) AS count FROM orders GROUP BY 1, 2""")
def q_coding(spark, d):
    o = io.read_table(spark, d, "orders")
    return o.groupBy("o_orderpriority", fs.apply_coding("o_orderpriority", _BINS, [1, 2, 3]).alias("code")) \
        .agg(F.count(F.lit(1)).cast("long").alias("count"))


_BIN_SQL = """WITH s AS (SELECT CASE WHEN l_linenumber = 4 THEN NULL ELSE l_linestatus END AS status FROM lineitem),
m AS (SELECT MIN(status) AS zero, MAX(status) AS one,
        (SELECT status FROM s WHERE status IS NOT NULL GROUP BY status ORDER BY COUNT(*) DESC, status LIMIT 1) AS mode FROM s)
SELECT status, CAST(CASE WHEN coalesce(status, mode) = one THEN 1 ELSE 0 END AS INTEGER) AS y, CAST(COUNT(*) AS BIGINT) AS count
FROM s, m GROUP BY 1, 2"""


@register("binarize_outcome", _BIN_SQL)
def q_binarize(spark, d):
    li = io.read_table(spark, d, "lineitem")
    s = li.select(F.when(F.col("l_linenumber") == 4, F.lit(None)).otherwise(F.col("l_linestatus")).alias("status"))
    b = cl.binarize_outcome(s, "status", out="y")
    return b.groupBy("status", "y").agg(F.count(F.lit(1)).cast("long").alias("count"))


# ------------------------------------------------------------- 2.4 encoders
_CATS = {"disc": [f"{i / 100:g}" if i else "0.0" for i in range(11)], "line": [str(i) for i in range(1, 8)], "status": ["F", "O"], "flag": ["A", "N", "R", None]}


def _onehot_sql() -> str:
    cols = []
    for c, vs in _CATS.items():
        for v in vs:
            if v is None:
                cols.append(f"CAST({c} IS NULL AS DOUBLE) AS {c}_nan")
            else:
                cols.append(f"CAST(coalesce(CAST({c} AS VARCHAR) = '{v}', FALSE) AS DOUBLE) AS \"{c}_{v}\"")
    return f"""WITH {WIDE_TOK_SQL}
SELECT price, {', '.join(cols)} FROM wide"""


@register("one_hot", _onehot_sql())
def q_one_hot(spark, d):
    w = cl.clean_categoricals(wide_lineitem(spark, d), ["status", "flag"]).select("price", "disc", "line", "status", "flag")
    enc = en.OneHot().fit(w, ["disc", "line", "status", "flag"])
    return rounded(enc.transform(w))


_IMPUTE_SQL = f"""WITH {WIDE_SQL},
st AS (SELECT AVG(qty) AS m, quantile_cont(qty, 0.5) AS med,
  (SELECT qty FROM wide WHERE qty IS NOT NULL GROUP BY qty ORDER BY COUNT(*) DESC, qty LIMIT 1) AS mode FROM wide)
SELECT qty, round(coalesce(qty, m), 6) AS qty_mean, round(coalesce(qty, med), 6) AS qty_median,
  round(coalesce(qty, mode), 6) AS qty_most_frequent, coalesce(qty, 0.0) AS qty_constant FROM wide, st"""


@register("impute", _IMPUTE_SQL)
def q_impute(spark, d):
    w = wide_lineitem(spark, d).select("qty")
    outs = [F.col("qty")]
    for s in ("mean", "median", "most_frequent", "constant"):
        imp = en.Imputer(strategy=s, fill_value=0.0).fit(w, ["qty"])
        outs.append(F.coalesce(F.col("qty"), F.lit(imp.values["qty"])).alias(f"qty_{s}"))
    return rounded(w.select(*outs))


_SC = ["qty", "price", "disc"]


def _scale_sql(kind: str) -> str:
    if kind == "standard":
        st = ", ".join(f"AVG({c}) AS c_{c}, CASE WHEN STDDEV_POP({c}) = 0 THEN 1 ELSE STDDEV_POP({c}) END AS s_{c}" for c in _SC)
    elif kind == "minmax":
        st = ", ".join(f"MIN({c}) AS c_{c}, CASE WHEN MAX({c}) = MIN({c}) THEN 1 ELSE MAX({c}) - MIN({c}) END AS s_{c}" for c in _SC)
    elif kind == "robust":
        st = ", ".join(f"quantile_cont({c}, 0.5) AS c_{c}, CASE WHEN quantile_cont({c}, 0.75) = quantile_cont({c}, 0.25) THEN 1 "
                       f"ELSE quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) END AS s_{c}" for c in _SC)
    else:
        st = ", ".join(f"0.0 AS c_{c}, CASE WHEN MAX(abs({c})) = 0 THEN 1 ELSE MAX(abs({c})) END AS s_{c}" for c in _SC)
    return f"""WITH {WIDE_SQL}, st AS (SELECT {st} FROM wide)
SELECT {', '.join(f'round(({c} - c_{c}) / s_{c}, 6) AS {c}' for c in _SC)} FROM wide, st"""


def _scale_q(method: str):
    def q(spark, d):
        w = wide_lineitem(spark, d).select(*_SC)
        return rounded(en.Scaler(method).fit(w, _SC).transform(w))
    return q


for _k, _m in (("standard", "StandardScaler"), ("minmax", "MinMaxScaler"), ("robust", "RobustScaler"),
               ("maxabs", "MaxAbsScaler")):
    register(f"scale_{_k}", _scale_sql(_k))(_scale_q(_m))


_NORM_SQL = f"""WITH {WIDE_SQL},
n AS (SELECT qty, price, disc, sqrt(coalesce(qty, 0) * coalesce(qty, 0) + price * price + disc * disc) AS nrm FROM wide)
SELECT {', '.join(f'round({c} / CASE WHEN nrm = 0 THEN 1 ELSE nrm END, 6) AS {c}' for c in _SC)} FROM n"""


@register("normalize_rows", _NORM_SQL)
def q_normalize(spark, d):
    w = wide_lineitem(spark, d).select(*_SC)
    return rounded(en.normalize_rows(w, _SC))


def _quantile_sql(k: int = 1000) -> str:
    """The uniform stage from the exact quantiles: a value equal to quantiles lo..hi maps to their
    middle, one between two quantiles to the straight line between them."""
    ctes, cols, joins = [], [], []
    probs = "[" + ", ".join(repr(i / (k - 1)) for i in range(k)) + "]"
    for c in _SC:
        ctes.append(f"""q_{c} AS (SELECT v, MIN(i) AS lo, MAX(i) AS hi FROM (SELECT UNNEST(range({k})) AS i, UNNEST(quantile_cont({c}, {probs})) AS v FROM wide) GROUP BY v),
n_{c} AS (SELECT *, LEAD(v) OVER (ORDER BY v) AS nv FROM q_{c}),
u_{c} AS (SELECT x, CASE WHEN x - 1e-7 < (SELECT MIN(v) FROM q_{c}) THEN 0.0 WHEN x + 1e-7 > (SELECT MAX(v) FROM q_{c}) THEN 1.0
  WHEN x = v THEN (lo + hi) / 2.0 / {k - 1} ELSE (hi + (x - v) / (nv - v)) / {k - 1}.0 END AS u
  FROM (SELECT DISTINCT {c} AS x FROM wide WHERE {c} IS NOT NULL) xs ASOF JOIN n_{c} ON x >= v)""")
        cols.append(f"wide.{c}, round(u_{c}.u, 6) AS {c}_u")
        joins.append(f"LEFT JOIN u_{c} ON u_{c}.x = wide.{c}")
    return f"WITH {WIDE_SQL},\n" + ",\n".join(ctes) + f"\nSELECT {', '.join(cols)} FROM wide {' '.join(joins)}"


@register("quantile_transform", _quantile_sql())
def q_quantile(spark, d):
    """The transform's normal values, shown as their probabilities (the normal CDF undoes its last step)."""
    from ..functions.normal import normal_cdf
    w = wide_lineitem(spark, d).select(*_SC)
    z = en.QuantileNormal().fit(w, _SC).transform(w.select(*[F.col(c).alias(f"{c}_raw") for c in _SC], *_SC))
    return rounded(z.select(*[x for c in _SC for x in (F.col(f"{c}_raw").alias(c), normal_cdf(F.col(c)).alias(f"{c}_u"))]))


# ------------------------------------------------------------- 2.6 profiling
def _nn(x: str) -> str:
    return f"CASE WHEN isnan({x}) THEN NULL ELSE {x} END"


def _profile_sql() -> str:
    parts = []
    for c in WIDE_INPUTS:
        dt = _DTYPES[c]
        miss = f"SUM(CASE WHEN {c} IS NULL {'OR isnan(' + c + ')' if dt == 'double' else ''} THEN 1 ELSE 0 END)"
        if dt == "string":
            stats = "CAST(NULL AS DOUBLE) AS mean, CAST(NULL AS DOUBLE) AS std, CAST(NULL AS DOUBLE) AS min, CAST(NULL AS DOUBLE) AS max"
        else:
            x = f"CAST({c} AS DOUBLE)"
            mean = (f"CASE WHEN MAX(CAST({x} = 'inf' AS INTEGER)) = 1 THEN CAST('inf' AS DOUBLE) "
                    f"ELSE AVG(CASE WHEN isinf({x}) THEN NULL ELSE {x} END) END")
            # rounded twice: a mean of short decimals can lie on a half step, where the order of summation decides
            stats = (f"round(round({_nn(mean)}, 9), 6) AS mean, round({_nn(f'STDDEV_SAMP({x})')}, 6) AS std, "
                     f"round(MIN({x}), 6) AS min, round(MAX({x}), 6) AS max")
        parts.append(f"SELECT '{c}' AS \"column\", '{dt}' AS dtype, CAST({miss} AS BIGINT) AS missing, "
                     f"round({miss} * 100.0 / COUNT(*), 6) AS missing_pct, CAST(COUNT(DISTINCT {c}) AS BIGINT) AS n_unique, "
                     f"{stats} FROM wide")
    return f"WITH {WIDE_SQL}\n" + "\nUNION ALL\n".join(parts)


@register("profile_columns", _profile_sql())
def q_profile(spark, d):
    p = pf.profile_columns(wide_lineitem(spark, d), WIDE_INPUTS)
    # as in the SQL: nine digits first, so that a half step at six doesn't hang on the order of summation
    return rounded(p.select([
        F.when(F.abs("mean") < 1e300, F.round(F.col("mean") * 1e9, 0) / 1e9).otherwise(F.col("mean")).alias("mean") if c == "mean" else F.col(c)
        for c in p.columns]))


_PREV_SQL = f"""WITH {WIDE_SQL},
roles(experiment, col, role) AS (VALUES {_ROLES_VALUES}),
n_in AS (SELECT experiment, CAST(SUM(CASE WHEN role = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_inputs FROM roles GROUP BY experiment),
prev AS ({' UNION ALL '.join(f"SELECT '{o}' AS outcome, AVG(CASE WHEN {o} = 1 THEN 1.0 ELSE 0.0 END) AS prevalence FROM wide WHERE {o} IS NOT NULL" for o in WIDE_OUTCOMES)})
SELECT r.experiment, n.n_inputs, r.col AS outcome, round(p.prevalence, 6) AS prevalence
FROM roles r JOIN n_in n ON r.experiment = n.experiment JOIN prev p ON p.outcome = r.col WHERE r.role = 2"""


@register("experiment_prevalence", _PREV_SQL)
def q_prevalence(spark, d):
    return rounded(pf.experiment_prevalence(wide_lineitem(spark, d), cl.role_table(spark, WIDE_ROLES)))


_CM_COLS = ["qty", "price", "disc", "tax", "y_ret"]


def _corr_matrix_sql() -> str:
    parts = []
    for a in _CM_COLS:
        for b in _CM_COLS:
            parts.append(f"SELECT '{a}' AS a, '{b}' AS b, round(CORR(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), 6) AS r FROM wide")
    return f"WITH {_WIDE_CLEAN_SQL}\n" + "\nUNION ALL\n".join(parts)


@register("correlation_matrix", _corr_matrix_sql())
def q_corr_matrix(spark, d):
    return rounded(pf.correlation_matrix(_wide_clean(spark, d), _CM_COLS))


_TOPC_SQL = f"""WITH {_WIDE_CLEAN_SQL},
c AS ({' UNION ALL '.join(f"SELECT '{f}' AS feature, CORR({f}, CAST(y_ret AS DOUBLE)) AS r FROM wide" for f in _CORR_COLS)})
SELECT feature, round(r, 6) AS r, round(abs(r), 6) AS abs_r FROM c ORDER BY abs(r) DESC, feature LIMIT 20"""


@register("top_correlated", _TOPC_SQL)
def q_top_corr(spark, d):
    return rounded(pf.top_correlated(_wide_clean(spark, d), _CORR_COLS, "y_ret", 20))


# per-fold rates on the orders cross-validation table
_RATE_COLS = ["tpr", "fpr", "tnr", "fnr", "ppv", "npv", "f1", "dor"]


def _fold_rates(spark, d):
    lab = cv_predictions(spark, d).withColumn("pred", (F.col("score") >= CV_CUT).cast("int"))
    return rt.classification_rates(rt.confusion_counts(lab, ["fold"]))


_FOLD_RATES_SQL = f"""{CV_SQL},
cm AS (SELECT fold,
  CAST(SUM(CASE WHEN y = 1 AND score >= {CV_CUT} THEN 1 ELSE 0 END) AS DOUBLE) AS TP,
  CAST(SUM(CASE WHEN y = 0 AND score >= {CV_CUT} THEN 1 ELSE 0 END) AS DOUBLE) AS FP,
  CAST(SUM(CASE WHEN y = 1 AND score < {CV_CUT} THEN 1 ELSE 0 END) AS DOUBLE) AS FN,
  CAST(SUM(CASE WHEN y = 0 AND score < {CV_CUT} THEN 1 ELSE 0 END) AS DOUBLE) AS TN FROM ordf GROUP BY fold),
r0 AS (SELECT fold, TP / (TP + FN) AS tpr, FP / (FP + TN) AS fpr, TN / (TN + FP) AS tnr, FN / (FN + TP) AS fnr,
         TP + FN AS P, TN + FP AS N FROM cm),
r AS (SELECT *, (tpr * P) / (tpr * P + fpr * N) AS ppv, (tnr * N) / (tnr * N + fnr * P) AS npv,
        (tpr * tnr) / NULLIF(fpr * fnr, 0) AS dor FROM r0),
rates AS (SELECT *, 2 * ppv * tpr / (ppv + tpr) AS f1 FROM r)"""

_MM_SQL = f"WITH {_FOLD_RATES_SQL}\nSELECT " + ", ".join(
    f"round(AVG(CASE WHEN isfinite({m}) THEN {m} END), 6) AS {m}" for m in _RATE_COLS) + " FROM rates"


@register("metric_mean", _MM_SQL)
def q_metric_mean(spark, d):
    return rounded(pf.metric_mean(_fold_rates(spark, d), [], _RATE_COLS))


_CVA_SQL = f"""WITH {CV_SQL},
ev AS (SELECT CAST(k AS INTEGER) AS k, CASE WHEN fold = k THEN 'test' ELSE 'train' END AS split, y, score,
         CAST(score >= {CV_CUT} AS INTEGER) AS pred FROM ordf, range({5}) t(k)),
{score_groups_sql('ev', ['k', 'split'])},
a AS (SELECT k, split, SUM(pos * (CAST(N AS DOUBLE) - fp + neg / 2.0) / N) / MAX(P) AS auc FROM sg GROUP BY k, split),
c AS (SELECT k, split, AVG(CASE WHEN pred = y THEN 1.0 ELSE 0.0 END) AS accuracy,
        SUM(CASE WHEN pred = 1 AND y = 1 THEN 1.0 ELSE 0.0 END) / SUM(CASE WHEN y = 1 THEN 1.0 ELSE 0.0 END) AS tpr,
        SUM(CASE WHEN pred = 0 AND y = 0 THEN 1.0 ELSE 0.0 END) / SUM(CASE WHEN y = 0 THEN 1.0 ELSE 0.0 END) AS tnr
      FROM ev GROUP BY k, split)
SELECT a.split, round(AVG(auc), 6) AS auc, round(AVG(accuracy), 6) AS accuracy, round(AVG(tpr), 6) AS tpr,
  round(AVG(tnr), 6) AS tnr, CAST(COUNT(*) AS BIGINT) AS n_folds
FROM a JOIN c ON a.k = c.k AND a.split = c.split GROUP BY a.split"""


@register("cv_metric_average", _CVA_SQL)
def q_cv_avg(spark, d):
    from ..operators.results import cv_metric_average, fold_split_metrics
    m = fold_split_metrics(cv_predictions(spark, d), "fold", 5, CV_CUT)
    return rounded(cv_metric_average(m, ["split"], ["auc", "accuracy", "tpr", "tnr"]))


def _fold_pr_long(spark, d):
    sg = ev.score_groups(cv_predictions(spark, d), ["fold"]).withColumn("_one", F.lit(1).cast("long"))
    r = prefix_sum(sg, ["fold"], ["score"], ["_one"], descending=True, prefix="o")
    return r.select("fold", F.col("o_one").alias("pos"),
                    (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("value"),
                    (F.col("fp") / F.col("N")).alias("fpr"), (F.col("tp") / F.col("P")).alias("tpr"))


_PADAVG_SQL = f"""WITH {CV_SQL},
{score_groups_sql('ordf', ['fold'])},
l AS (SELECT fold, ROW_NUMBER() OVER (PARTITION BY fold ORDER BY score DESC) AS pos, CAST(tp AS DOUBLE) / (tp + fp) AS value FROM sg)
SELECT pos, round(AVG(value), 6) AS mean_value, CAST(COUNT(value) AS BIGINT) AS n_curves FROM l GROUP BY pos"""


@register("pad_average", _PADAVG_SQL)
def q_pad_average(spark, d):
    return rounded(pf.pad_average(_fold_pr_long(spark, d), [], "pos", "value"))


_PAD2D_SQL = f"""WITH {CV_SQL},
cm AS (SELECT fold, CAST(y AS INTEGER) AS i, CAST(score >= {CV_CUT} AS INTEGER) AS j, CAST(COUNT(*) AS DOUBLE) AS value
       FROM ordf GROUP BY 1, 2, 3)
SELECT fold, round(AVG(value), 6) AS mean_value FROM cm GROUP BY fold"""


@register("pad_average_2d", _PAD2D_SQL)
def q_pad_average_2d(spark, d):
    lab = cv_predictions(spark, d)
    cells = lab.groupBy("fold", F.col("y").alias("i"), (F.col("score") >= CV_CUT).cast("int").alias("j")) \
        .agg(F.count(F.lit(1)).cast("double").alias("value"))
    return rounded(pf.pad_average_2d(cells, ["fold"]))


_TRUNC_SQL = f"""WITH {CV_SQL},
{score_groups_sql('ordf', ['fold'])},
v AS (SELECT fold, ROW_NUMBER() OVER (PARTITION BY fold ORDER BY score DESC) - 1 AS i,
        CAST(fp AS DOUBLE) / N AS fpr, CAST(tp AS DOUBLE) / P AS tpr FROM sg),
l AS (SELECT fold, i, 0 AS j, fpr AS value FROM v UNION ALL SELECT fold, i, 1, tpr FROM v),
lim AS (SELECT MIN(r) AS mr FROM (SELECT fold, MAX(i) + 1 AS r FROM l GROUP BY fold))
SELECT fold, CAST(i AS BIGINT) AS i, CAST(j AS INTEGER) AS j, round(value, 6) AS value FROM l, lim WHERE i < mr"""


@register("truncate_to_smallest", _TRUNC_SQL)
def q_truncate(spark, d):
    v = _fold_pr_long(spark, d).select("fold", (F.col("pos") - 1).alias("i"), "fpr", "tpr")
    long = v.select("fold", "i", F.lit(0).alias("j"), F.col("fpr").alias("value")) \
        .unionByName(v.select("fold", "i", F.lit(1).alias("j"), F.col("tpr").alias("value")))
    return rounded(pf.truncate_to_smallest(long, "fold", "i", "j"))

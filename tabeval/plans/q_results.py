"""Registered queries: result tables, comparison and the registry."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import registry as rg
from ..operators import results as rs
from ..operators import sample as sp
from ..session import ensure_checkpoint_dir
from ..sources.io import read_table
from .registry import register, rounded
from .sqlgen import evaluate_sql


# --------------------------------------------------------------- predictions
def orders_eval(spark, d, seed: int = 42):
    """Two 'models' (price, customer key) x two outcomes (fulfilled, urgent) on
    orders, with one stratified 80/20 split per outcome."""
    o = read_table(spark, d, "orders")
    base = o.select(F.col("o_orderkey").alias("row_id"),
                    (F.col("o_orderstatus") == "F").cast("int").alias("y_f"),
                    (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("y_u"),
                    F.col("o_totalprice").alias("s_price"), F.col("o_custkey").cast("double").alias("s_cust"))
    long = base.select("row_id", "s_price", "s_cust",
                       F.expr("stack(2, 'fulfilled', y_f, 'urgent', y_u) as (outcome, y)"))
    split = sp.split_stratified(long, "y", "row_id", 0.2, seed, within=["outcome"])
    return split.select("row_id", "outcome", "y", "split",
                        F.expr("stack(2, 'price', s_price, 'cust', s_cust) as (algorithm, score)"))


def orders_eval_sql(seed: int = 42, suffix: str = "") -> str:
    return f"""base{suffix} AS (SELECT o_orderkey AS row_id, CAST(o_orderstatus = 'F' AS INTEGER) AS y_f,
    CAST(o_orderpriority = '1-URGENT' AS INTEGER) AS y_u, o_totalprice AS s_price, CAST(o_custkey AS DOUBLE) AS s_cust FROM orders),
long{suffix} AS (SELECT row_id, s_price, s_cust, 'fulfilled' AS outcome, y_f AS y FROM base{suffix}
         UNION ALL SELECT row_id, s_price, s_cust, 'urgent', y_u FROM base{suffix}),
sp{suffix} AS (SELECT *, CASE WHEN ROW_NUMBER() OVER (PARTITION BY outcome, y ORDER BY md5('{seed}:' || CAST(row_id AS VARCHAR)), row_id)
         <= round(COUNT(*) OVER (PARTITION BY outcome, y) * 0.2) THEN 'test' ELSE 'train' END AS split FROM long{suffix}),
preds{suffix} AS (SELECT row_id, outcome, y, split, 'price' AS algorithm, s_price AS score FROM sp{suffix}
          UNION ALL SELECT row_id, outcome, y, split, 'cust', s_cust FROM sp{suffix})"""


_G = ["outcome", "algorithm", "split"]


def _results_select(res: str = "res") -> str:
    f1 = "2 * t.prec * t.rec / NULLIF(t.prec + t.rec, 0)"
    return f"""SELECT t.outcome AS "Outcome", t.algorithm AS "Algorithm",
  round(t.auc, 6) AS "AUROC Score", round(t.auc_cilow, 6) AS "AUROC CI Lower", round(t.auc_cihigh, 6) AS "AUROC CI Upper",
  round(CAST(t.TP + t.TN AS DOUBLE) / (t.P + t.N), 6) AS "Accuracy", round(t.prec, 6) AS "Precision", round(t.rec, 6) AS "Recall",
  round({f1}, 6) AS "F1 Score", round(t.tpr, 6) AS "TPR", round(t.tnr, 6) AS "TNR", round(t.fpr, 6) AS "FPR", round(t.fnr, 6) AS "FNR",
  round(t.ppv, 6) AS "PPV", round(t.npv, 6) AS "NPV", t.TP AS "TP", t.FP AS "FP", t.TN AS "TN", t.FN AS "FN",
  round(t.cutoff, 6) AS "Cutoff value", t.P AS "P", t.N AS "N",
  round(tr.auc, 6) AS "AUROC Score (Train)", round(tr.auc_cilow, 6) AS "AUROC CI Lower (Train)",
  round(tr.auc_cihigh, 6) AS "AUROC CI Upper (Train)", tr.P AS "P (Train)", tr.N AS "N (Train)",
  tr.TP AS "TP (Train)", tr.FP AS "FP (Train)", tr.TN AS "TN (Train)", tr.FN AS "FN (Train)",
  round((tr.auc - t.auc) / NULLIF(tr.auc, 0) * 100, 6) AS "Train vs. Test AUROC change%"
FROM {res} t LEFT JOIN {res} tr ON t.outcome = tr.outcome AND t.algorithm = tr.algorithm AND tr.split = 'train'
WHERE t.split = 'test'"""


_RESULTS_SQL = f"""WITH {orders_eval_sql()},
{evaluate_sql('preds', _G)},
rt AS ({_results_select()})
SELECT * FROM rt"""


def _results(spark, d, seed: int = 42):
    return rs.results_table(orders_eval(spark, d, seed))


@register("results_table", _RESULTS_SQL)
def q_results_table(spark, d):
    return rounded(_results(spark, d))


@register("train_test_metric_join", f"""WITH {orders_eval_sql()},
{evaluate_sql('preds', _G)},
rt AS ({_results_select()})
SELECT "Outcome", "Algorithm", "AUROC Score", "AUROC Score (Train)", "P", "P (Train)" FROM rt""")
def q_train_test_join(spark, d):
    return rounded(_results(spark, d).select("Outcome", "Algorithm", "AUROC Score", "AUROC Score (Train)", "P",
                                             "P (Train)"))


@register("leaderboard", f"""WITH {orders_eval_sql()},
{evaluate_sql('preds', _G)},
rt AS ({_results_select()})
SELECT "Outcome", "Algorithm", "AUROC Score",
  CAST(ROW_NUMBER() OVER (PARTITION BY "Outcome" ORDER BY "AUROC Score" DESC NULLS LAST, "Algorithm") AS INTEGER) AS rank,
  ROW_NUMBER() OVER (PARTITION BY "Outcome" ORDER BY "AUROC Score" DESC NULLS LAST, "Algorithm") = 1 AS is_best FROM rt""")
def q_leaderboard(spark, d):
    lb = rs.leaderboard(_results(spark, d))
    return rounded(lb.select("Outcome", "Algorithm", "AUROC Score", "rank", "is_best"))


# ------------------------------------------------------------- comparison
_CMP_COLS = ["Exp_Name", "Test Set", "Outcome", "Algorithm", "AUROC Score", "Upper_CI_Gap", "Lower_CI_Gap",
             "Upper_CI_Gap (Train)", "Lower_CI_Gap (Train)"]


def _tag_sql(exp: str, ts: str) -> str:
    return f"""SELECT '{exp}' AS "Exp_Name", '{ts}' AS "Test Set", t.outcome AS "Outcome", t.algorithm AS "Algorithm",
  round(t.auc, 6) AS "AUROC Score", round(t.auc_cihigh - t.auc, 6) AS "Upper_CI_Gap", round(t.auc - t.auc_cilow, 6) AS "Lower_CI_Gap",
  round(tr.auc_cihigh - tr.auc, 6) AS "Upper_CI_Gap (Train)", round(tr.auc - tr.auc_cilow, 6) AS "Lower_CI_Gap (Train)"
FROM res t LEFT JOIN res tr ON t.experiment = tr.experiment AND t.outcome = tr.outcome AND t.algorithm = tr.algorithm AND tr.split = 'train'
WHERE t.split = 'test' AND t.experiment = '{exp}'"""


#: two experiments: the same models on two different splits
_SEEDS = {"exp1": 42, "exp2": 7}


def _compare_base_sql() -> str:
    parts = ",\n".join(orders_eval_sql(seed, f"_{exp}") for exp, seed in _SEEDS.items())
    both = " UNION ALL ".join(f"SELECT '{exp}' AS experiment, * FROM preds_{exp}" for exp in _SEEDS)
    return f"""{parts},
both_preds AS ({both}),
{evaluate_sql('both_preds', ['experiment', *_G])},
total AS ({' UNION ALL '.join(_tag_sql(exp, 'holdout') for exp in _SEEDS)})"""


def _total(spark, d):
    t1, t2 = (rs.tag_results(_results(spark, d, seed), exp, "holdout") for exp, seed in _SEEDS.items())
    total = rs.compare_results(None, t1)
    total = rs.compare_results(total, t2)
    return rs.compare_results(total, t1)  # already present: not added twice


@register("compare_results", f"WITH {_compare_base_sql()} SELECT * FROM total")
def q_compare(spark, d):
    return rounded(_total(spark, d).select(*_CMP_COLS))


@register("remove_result", f"""WITH {_compare_base_sql()} SELECT * FROM total WHERE NOT ("Exp_Name" = 'exp1' AND "Test Set" = 'holdout')""")
def q_remove(spark, d):
    return rounded(rs.remove_result(_total(spark, d), "exp1", "holdout").select(*_CMP_COLS))


@register("filter_results", f"""WITH {orders_eval_sql()},
{evaluate_sql('preds', _G)},
rt AS ({_results_select()}),
total AS (SELECT 'exp1' AS "Exp_Name", 'holdout' AS "Test Set", * FROM rt)
SELECT "Exp_Name", "Test Set", "Outcome", "Algorithm", 'AUROC Score' AS metric, "AUROC Score" AS value FROM total WHERE "Algorithm" = 'price'
UNION ALL
SELECT "Exp_Name", "Test Set", "Outcome", "Algorithm", 'Accuracy', "Accuracy" FROM total WHERE "Algorithm" = 'price'""")
def q_filter_results(spark, d):
    total = rs.tag_results(_results(spark, d), "exp1", "holdout")
    return rounded(rs.filter_results(total, algorithms=["price"], metrics=["AUROC Score", "Accuracy"]))


# ----------------------------------------------------------------- 2.9 joins
@register("join_features_label", """SELECT o.o_orderkey AS row_id, o.o_totalprice, o.o_orderpriority, l.y
FROM orders o JOIN (SELECT o_orderkey AS row_id, CAST(o_orderstatus = 'F' AS INTEGER) AS y FROM orders) l ON o.o_orderkey = l.row_id""")
def q_join_features_label(spark, d):
    o = read_table(spark, d, "orders")
    x = o.select(F.col("o_orderkey").alias("row_id"), "o_totalprice", "o_orderpriority")
    y = o.select(F.col("o_orderkey").alias("row_id"), (F.col("o_orderstatus") == "F").cast("int").alias("y"))
    return rounded(x.join(y, "row_id"))


@register("concat_columns", """SELECT o_orderkey AS row_id, o_orderkey AS label_id, o_totalprice, CAST(o_orderstatus = 'F' AS INTEGER) AS y FROM orders""")
def q_concat_columns(spark, d):
    """Features and labels without a common id, written in one order but in files of other sizes, side by side."""
    from ..sources.io import concat_columns
    base = ensure_checkpoint_dir(spark).rstrip("/")
    left, right = (f"{base}/tabeval-{side}-{uuid.uuid4().hex}" for side in ("features", "outcomes"))
    o = read_table(spark, d, "orders")
    for path, n, part in ((left, 7, o.select(F.col("o_orderkey").alias("row_id"), "o_totalprice")),
                          (right, 3, o.select(F.col("o_orderkey").alias("label_id"), (F.col("o_orderstatus") == "F").cast("int").alias("y")))):
        part.repartitionByRange(n, part.columns[0]).sortWithinPartitions(part.columns[0]).write.parquet(path)
    return rounded(concat_columns(spark, left, right).select("row_id", "label_id", "o_totalprice", "y"))


# ----------------------------------------------------------------- registry
def _models(spark, d):
    o = read_table(spark, d, "orders")
    g = o.groupBy("o_orderpriority").agg(F.max("o_orderdate").alias("last"), F.count(F.lit(1)).cast("long").alias("n"))
    native = ~F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    return g.select(
        F.concat(F.lit("exp-"), F.lower(F.substring("o_orderpriority", 3, 100))).alias("exp_name"),
        F.when(native, F.lit("Native")).otherwise(F.lit("AutoML")).alias("type"),
        F.when(native, F.array(F.lit("rf"), F.lit("lr"))).otherwise(F.array(F.lit("auto"))).alias("algorithms"),
        F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", F.lit(None).cast("timestamp"))
        .otherwise(F.col("last")).alias("time_created"), "n")


MODELS_SQL = """models AS (SELECT 'exp-' || lower(substr(o_orderpriority, 3)) AS exp_name,
  CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'AutoML' ELSE 'Native' END AS type,
  CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN ['auto'] ELSE ['rf', 'lr'] END AS algorithms,
  CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN NULL ELSE MAX(o_orderdate) END AS time_created,
  CAST(COUNT(*) AS BIGINT) AS n FROM orders GROUP BY o_orderpriority)"""


def _results_reg(spark, d):
    o = read_table(spark, d, "orders")
    return o.groupBy("o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).cast("long").alias("n_rows")).select(
        F.concat(F.lit("exp-"), F.lower(F.substring("o_orderpriority", 3, 100))).alias("exp_name"),
        F.concat(F.lit("status-"), F.col("o_orderstatus")).alias("test_set"), "n_rows")


RESREG_SQL = """resreg AS (SELECT 'exp-' || lower(substr(o_orderpriority, 3)) AS exp_name, 'status-' || o_orderstatus AS test_set,
  CAST(COUNT(*) AS BIGINT) AS n_rows FROM orders GROUP BY o_orderpriority, o_orderstatus)"""


def _datasets(spark, d):
    o = read_table(spark, d, "orders")
    return o.groupBy("o_orderstatus").agg(F.count(F.lit(1)).cast("long").alias("n_rows")).select(
        F.concat(F.lit("orders-"), F.col("o_orderstatus")).alias("data_name"), F.lit("Train").alias("type"),
        F.when(F.col("o_orderstatus") == "F", F.array(F.lit("exp-urgent")))
        .otherwise(F.array().cast("array<string>")).alias("exps_used"), "n_rows")


DATASETS_SQL = """datasets AS (SELECT 'orders-' || o_orderstatus AS data_name, 'Train' AS type,
  CASE WHEN o_orderstatus = 'F' THEN ['exp-urgent'] ELSE CAST([] AS VARCHAR[]) END AS exps_used,
  CAST(COUNT(*) AS BIGINT) AS n_rows FROM orders GROUP BY o_orderstatus)"""


@register("registry_lookup", f"""WITH {MODELS_SQL}, {RESREG_SQL}
SELECT r.exp_name, r.test_set, r.n_rows, m.type FROM resreg r JOIN models m ON r.exp_name = m.exp_name WHERE m.type = 'Native'""")
def q_registry_lookup(spark, d):
    m = _models(spark, d).where(F.col("type") == "Native").select("exp_name", "type")
    # the models registry has one row per experiment: bounded, broadcast
    return _results_reg(spark, d).join(F.broadcast(m), "exp_name").select("exp_name", "test_set", "n_rows", "type")


def _sort_sql(how: str) -> str:
    order = {"alphabetical": "exp_name ASC NULLS LAST", "newest": "time_created DESC NULLS LAST, exp_name",
             "oldest": "time_created ASC NULLS LAST, exp_name"}[how]
    return f"SELECT '{how}' AS how, exp_name, CAST(ROW_NUMBER() OVER (ORDER BY {order}) AS INTEGER) AS position FROM models"


@register("sort_registry", f"WITH {MODELS_SQL}\n" + "\nUNION ALL\n".join(_sort_sql(h) for h in ("alphabetical", "newest", "oldest")))
def q_sort_registry(spark, d):
    m = _models(spark, d)
    out = None
    for how in ("alphabetical", "newest", "oldest"):
        # ids made after the sort rise in the operator's order: their ranks are its positions
        ordered = rg.sort_registry(m, how).select("exp_name", F.monotonically_increasing_id().alias("_at"))
        # registry tables hold one row per experiment; a single ordered window is bounded
        t = ordered.select(F.lit(how).alias("how"), "exp_name", F.row_number().over(Window.orderBy("_at")).alias("position"))
        out = t if out is None else out.unionByName(t)
    return out


@register("set_union_names", f"WITH {MODELS_SQL}, {RESREG_SQL} SELECT exp_name FROM models UNION SELECT exp_name FROM resreg")
def q_set_union(spark, d):
    return rg.set_union_names(_models(spark, d), _results_reg(spark, d))


@register("list_experiments", f"""WITH {MODELS_SQL}, {RESREG_SQL},
rc AS (SELECT exp_name, CAST(COUNT(*) AS BIGINT) AS n_results FROM resreg GROUP BY exp_name)
SELECT m.exp_name, m.type, m.time_created, coalesce(rc.n_results, 0) AS n_results, CAST(len(m.algorithms) AS BIGINT) AS n_algorithms
FROM models m LEFT JOIN rc ON m.exp_name = rc.exp_name WHERE contains(m.exp_name, 'e') AND m.type = 'Native'""")
def q_list_experiments(spark, d):
    return rg.list_experiments(_models(spark, d), _results_reg(spark, d), "e", "Native")


@register("register_dataset", f"""WITH {DATASETS_SQL},
new AS (SELECT 'orders-F' AS data_name, 'Test' AS type, CAST([] AS VARCHAR[]) AS exps_used, CAST(1 AS BIGINT) AS n_rows
        UNION ALL SELECT 'orders-new', 'Train', CAST([] AS VARCHAR[]), CAST(2 AS BIGINT))
SELECT * FROM datasets WHERE data_name NOT IN (SELECT data_name FROM new) UNION ALL SELECT * FROM new""")
def q_register_dataset(spark, d):
    ds = _datasets(spark, d)
    new = spark.createDataFrame([("orders-F", "Test", [], 1), ("orders-new", "Train", [], 2)],
                                "data_name string, type string, exps_used array<string>, n_rows bigint")
    return rg.upsert(ds, new, ["data_name"])


@register("append_experiment_used", f"""WITH {DATASETS_SQL}
SELECT data_name, type, CASE WHEN data_name = 'orders-F' THEN
  (CASE WHEN list_contains(exps_used, 'exp-low') THEN exps_used ELSE list_append(exps_used, 'exp-low') END) ELSE exps_used END AS exps_used,
  n_rows FROM datasets""")
def q_append_used(spark, d):
    return rg.append_experiment_used(_datasets(spark, d), "orders-F", "exp-low")


@register("register_model", f"""WITH {MODELS_SQL}
SELECT exp_name, type, n FROM models UNION ALL SELECT 'exp-new', 'Native', CAST(0 AS BIGINT)""")
def q_register_model(spark, d):
    m = _models(spark, d).select("exp_name", "type", "n")
    new = spark.createDataFrame([("exp-new", "Native", 0), ("exp-low", "Native", 0)], "exp_name string, type string, n bigint")
    return rg.insert_new(m, new, ["exp_name"])  # exp-low exists: not inserted


@register("register_result", f"""WITH {RESREG_SQL}
SELECT * FROM resreg UNION ALL SELECT 'exp-low', 'status-X', CAST(0 AS BIGINT)""")
def q_register_result(spark, d):
    r = _results_reg(spark, d)
    new = spark.createDataFrame([("exp-low", "status-X", 0), ("exp-low", "status-F", 0)],
                                "exp_name string, test_set string, n_rows bigint")
    return rg.insert_new(r, new, ["exp_name", "test_set"])


@register("delete_item", f"""WITH {MODELS_SQL}, {RESREG_SQL}
SELECT 'result' AS kind, exp_name, test_set FROM resreg WHERE exp_name <> 'exp-low' AND NOT (exp_name = 'exp-high' AND test_set = 'status-F')
UNION ALL SELECT 'model', exp_name, NULL FROM models WHERE exp_name <> 'exp-low'""")
def q_delete(spark, d):
    models, results = rg.delete_experiment(_models(spark, d), _results_reg(spark, d), "exp-low")
    results = rg.delete_result(results, "exp-high", "status-F")
    return results.select(F.lit("result").alias("kind"), "exp_name", "test_set") \
        .unionByName(models.select(F.lit("model").alias("kind"), "exp_name", F.lit(None).cast("string").alias("test_set")))


@register("rename_item", f"""WITH {MODELS_SQL}, {RESREG_SQL}, {DATASETS_SQL}
SELECT 'result' AS kind, CASE WHEN exp_name = 'exp-high' THEN 'exp-top' ELSE exp_name END AS name FROM resreg
UNION ALL SELECT 'model', CASE WHEN exp_name = 'exp-high' THEN 'exp-top' ELSE exp_name END FROM models
UNION ALL SELECT 'dataset', CASE WHEN data_name = 'orders-O' THEN 'orders-open' ELSE data_name END FROM datasets""")
def q_rename(spark, d):
    models, results = rg.rename_experiment(_models(spark, d), _results_reg(spark, d), "exp-high", "exp-top")
    ds = rg.rename_dataset(_datasets(spark, d), "orders-O", "orders-open")
    return results.select(F.lit("result").alias("kind"), F.col("exp_name").alias("name")) \
        .unionByName(models.select(F.lit("model").alias("kind"), F.col("exp_name").alias("name"))) \
        .unionByName(ds.select(F.lit("dataset").alias("kind"), F.col("data_name").alias("name")))

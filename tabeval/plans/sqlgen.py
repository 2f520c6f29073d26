"""SQL-text builders for the DuckDB oracle (standard SQL, window functions).

The oracle recomputes each registered query from the raw tables with plain
window functions over whole groups — the simple single-node formulation the
Spark plans deliberately avoid — so the two are independent implementations.
"""

from __future__ import annotations

from ..functions.stats import Z_975

Z = "%.17e" % Z_975


def gsel(group: list[str]) -> str:
    return "".join(f"{g}, " for g in group)


def gpart(group: list[str]) -> str:
    return f"PARTITION BY {', '.join(group)}" if group else ""


def gby(group: list[str], *extra: str) -> str:
    cols = list(group) + list(extra)
    return f"GROUP BY {', '.join(cols)}" if cols else ""


def div(a: str, b: str) -> str:
    return f"(({a}) / NULLIF(({b}), 0))"


def score_groups_sql(src: str, group: list[str], name: str = "sg") -> str:
    """CTEs ``{name}0`` (per distinct score) and ``{name}`` (running tp/fp, totals)."""
    g = gsel(group)
    part = gpart(group)
    return f"""{name}0 AS (
  SELECT {g}CAST(score AS DOUBLE) AS score, CAST(SUM(y) AS BIGINT) AS pos, CAST(SUM(1 - y) AS BIGINT) AS neg
  FROM {src} WHERE y IS NOT NULL AND score IS NOT NULL AND NOT isnan(CAST(score AS DOUBLE))
  {gby(group, 'CAST(score AS DOUBLE)')}),
{name} AS (
  SELECT {g}score, pos, neg,
    CAST(SUM(pos) OVER ({part} ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS tp,
    CAST(SUM(neg) OVER ({part} ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS fp,
    CAST(SUM(pos) OVER ({part}) AS BIGINT) AS P,
    CAST(SUM(neg) OVER ({part}) AS BIGINT) AS N
  FROM {name}0)"""


def roc_sql(group: list[str], sg: str = "sg", name: str = "roc") -> str:
    g = gsel(group)
    return f"""{name} AS (
  SELECT {g}threshold, tp, fp, P, N, pos, neg,
    {div('CAST(tp AS DOUBLE)', 'P')} AS tpr, {div('CAST(fp AS DOUBLE)', 'N')} AS fpr
  FROM (
    SELECT {g}CAST('inf' AS DOUBLE) AS threshold, CAST(0 AS BIGINT) AS tp, CAST(0 AS BIGINT) AS fp, P, N,
           CAST(0 AS BIGINT) AS pos, CAST(0 AS BIGINT) AS neg
    FROM {sg} {gby(group, 'P', 'N')}
    UNION ALL
    SELECT {g}score, tp, fp, P, N, pos, neg FROM {sg}))"""


def wilson_sql(r: str, n: str) -> tuple[str, str]:
    a = f"(2*({r}) + {Z}*{Z})"
    b = f"({Z}*sqrt({Z}*{Z} + 4*({r})*(1 - {div(r, n)})))"
    c = f"(2*(({n}) + {Z}*{Z}))"
    return (f"(CASE WHEN ({n}) <> 0 THEN {div(f'{a} - {b}', c)} END)",
            f"(CASE WHEN ({n}) <> 0 THEN {div(f'{a} + {b}', c)} END)")


def rates_sql(tpr: str = "tpr", fpr: str = "fpr", P: str = "CAST(P AS DOUBLE)", N: str = "CAST(N AS DOUBLE)") -> dict[str, str]:
    fnr = f"(1 - {tpr})"
    tnr = f"(1 - {fpr})"
    TP = f"({tpr}*{P})"
    ppv = div(TP, f"{TP} + {fpr}*{N}")
    npv = div(f"{tnr}*{N}", f"{tnr}*{N} + {fnr}*{P}")
    f1 = div(f"2*{ppv}*{tpr}", f"{ppv} + {tpr}")
    dor = div(f"{tpr}*{tnr}", f"{fpr}*{fnr}")
    n_ppv = f"({TP} + {fpr}*{N})"
    tl, th = wilson_sql(TP, P)
    pl, ph = wilson_sql(TP, n_ppv)
    return {
        "tpr": tpr, "tnr": tnr, "fpr": fpr, "fnr": fnr, "ppv": ppv, "npv": npv, "f1": f1, "dor": dor,
        "tpr_low": tl, "tpr_high": th, "ppv_low": pl, "ppv_high": ph,
        "youden": f"({tpr} + {tnr})",
        "mcc": f"(sqrt({tpr}*{tnr}*{ppv}*{npv}) - sqrt((1 - {ppv})*{fnr}*{fpr}*(1 - {npv})))",
        "ji": div(TP, f"{TP} + {fnr}*{P} + {fpr}*{N}"),
    }


def r6(expr: str, alias: str) -> str:
    return f"round({expr}, 6) AS {alias}"


def evaluate_sql(src: str, group: list[str]) -> str:
    """CTEs ending in ``res``: per group AUC, DeLong CI, Youden cutoff and the
    rates/counts at it (the plain-SQL twin of ``operators.evaluate.evaluate``)."""
    g = gsel(group)
    r = rates_sql()
    using = ", ".join(group)
    firsts = ", ".join(f"FIRST({k} ORDER BY youden DESC, threshold DESC) AS {k}"
                       for k in ("tpr", "tnr", "fpr", "fnr", "ppv", "npv", "f1", "dor", "tp", "fp"))
    return f"""{score_groups_sql(src, group)},
{roc_sql(group)},
c AS (SELECT {g}threshold, tp, fp, P, N, {', '.join(f'{r[k]} AS {k}' for k in ('tpr', 'tnr', 'fpr', 'fnr', 'ppv', 'npv', 'f1', 'dor', 'youden'))} FROM roc),
best AS (SELECT {g}MAX(P) AS P, MAX(N) AS N, FIRST(threshold ORDER BY youden DESC, threshold DESC) AS cutoff, {firsts}
         FROM c {gby(group)}),
comp AS (SELECT {g}pos, neg, (CAST(N AS DOUBLE) - fp + neg / 2.0) / N AS v01, (tp - pos / 2.0) / P AS v10,
           CAST(P AS DOUBLE) AS Pd, CAST(N AS DOUBLE) AS Nd FROM sg),
dl0 AS (SELECT {g}SUM(pos * v01) / MAX(Pd) AS auc,
          (SUM(pos * v01 * v01) - MAX(Pd) * POWER(SUM(pos * v01) / MAX(Pd), 2)) / (MAX(Pd) - 1) / MAX(Pd)
          + (SUM(neg * v10 * v10) - MAX(Nd) * POWER(SUM(neg * v10) / MAX(Nd), 2)) / (MAX(Nd) - 1) / MAX(Nd) AS var
        FROM comp {gby(group)}),
dl AS (SELECT {g}auc, greatest(var, 0) AS var FROM dl0),
res AS (SELECT {g}dl.auc, CASE WHEN dl.var > 0 THEN dl.auc - {Z} * sqrt(dl.var) END AS auc_cilow,
          CASE WHEN dl.var > 0 THEN least(dl.auc + {Z} * sqrt(dl.var), 1.0) END AS auc_cihigh,
          best.cutoff, best.tpr, best.tnr, best.fpr, best.fnr, best.ppv, best.npv, best.P, best.N,
          best.tp AS TP, best.fp AS FP, best.N - best.fp AS TN, best.P - best.tp AS FN,
          CAST(best.tp AS DOUBLE) / NULLIF(best.tp + best.fp, 0) AS prec, CAST(best.tp AS DOUBLE) / NULLIF(best.P, 0) AS rec
        FROM best JOIN dl USING ({using}))"""

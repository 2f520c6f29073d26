"""Column expressions (JVM-side, codegen-friendly)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import named
from .stats import Z_975

# Textual tokens the reference treats as missing in categorical columns.
MISSING_TOKENS = ["nan", "NaN", "None", "NONE", "<NA>", "null", ""]


def _c(x) -> Column:
    return named(x) if isinstance(x, str) else x


def wilson_bounds(r, n, z: float = Z_975) -> tuple[Column, Column]:
    """Wilson score interval ((A-B)/C, (A+B)/C) for r successes of n; NULL when n = 0."""
    r, n = _c(r).cast("double"), _c(n).cast("double")
    a = 2.0 * r + z * z
    b = z * F.sqrt(z * z + 4.0 * r * (1.0 - F.try_divide(r, n)))
    c = 2.0 * (n + z * z)
    valid = n != 0
    return F.when(valid, F.try_divide(a - b, c)), F.when(valid, F.try_divide(a + b, c))


def wilson_low(r, n, z: float = Z_975) -> Column:
    return wilson_bounds(r, n, z)[0]


def wilson_high(r, n, z: float = Z_975) -> Column:
    return wilson_bounds(r, n, z)[1]


def normalize_missing_tokens(c, tokens: Sequence[str] = MISSING_TOKENS) -> Column:
    """Textual missing markers -> NULL (categorical columns)."""
    col = _c(c)
    return F.when(col.isin(*tokens), F.lit(None).cast("string")).otherwise(col)


def nan_to_null(c) -> Column:
    col = _c(c)
    return F.when(F.isnan(col), F.lit(None).cast("double")).otherwise(col)


def replace_inf(c, mode: str = "null") -> Column:
    """+-inf -> NULL (``mode='null'``) or 0 (``mode='zero'``)."""
    col = _c(c).cast("double")
    repl = F.lit(None).cast("double") if mode == "null" else F.lit(0.0)
    return F.when(col.isin(float("inf"), float("-inf")), repl).otherwise(col)


def log_large_values(c, limit: float) -> Column:
    """x > limit -> ln(x); other values (and NULL) unchanged."""
    col = _c(c).cast("double")
    return F.when(col > limit, F.log(col)).otherwise(col)


def coerce_numeric(c) -> Column:
    """Anything not parseable as a number -> NULL."""
    return _c(c).try_cast("double")


def apply_coding(c, bins: Sequence[Sequence], codes: Sequence) -> Column:
    """Code of the first bin (a list of values) that contains the value; else NULL."""
    col = _c(c)
    out = None
    for b, code in zip(bins, codes):
        cond = col.isin(*list(b))
        out = F.when(cond, F.lit(code)) if out is None else out.when(cond, F.lit(code))
    return out if out is not None else F.lit(None)


def predict_at_cutoff(score, cutoff) -> Column:
    """1 when score >= cutoff (the live test path), else 0."""
    return (_c(score) >= (cutoff if isinstance(cutoff, Column) else F.lit(cutoff))).cast("int")


def dummy_predict(value: int) -> Column:
    """Constant baseline predictor (all 0 / all 1)."""
    return F.lit(int(value)).cast("int")

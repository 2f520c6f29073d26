"""Columns by name, whatever the name holds (dots, quotes, spaces), and wide-to-long reshaping
built from Columns, so that no name is ever put into SQL text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: aggregate expressions in one stage of generated code; wider tables take several scans of one plan
EXPRESSIONS = 200


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def named(name: str) -> Column:
    return F.col(quoted(name))


def free_names(taken: Sequence[str], wanted: Sequence[str]) -> list[str]:
    """Names like ``wanted`` that no column of ``taken`` has, in any case."""
    used, out = {c.lower() for c in taken}, []
    for name in wanted:
        name = f"_{name}"
        while name.lower() in used:
            name = f"_{name}"
        used.add(name.lower())
        out.append(name)
    return out


def inline_rows(df: DataFrame, rows: Sequence[dict[str, Column]], keep: Sequence[str] = ()) -> DataFrame:
    """For each row of ``df``, one row per entry of ``rows`` (all with the same fields), plus ``keep``."""
    entries = [F.struct(*[v.alias(k) for k, v in row.items()]) for row in rows]
    return df.select(*[named(k) for k in keep], F.inline(F.array(*entries)))


def unpivot(df: DataFrame, cols: Sequence[str], dtype: str, name: str = "column", value: str = "value",
            keep: Sequence[str] = ()) -> DataFrame:
    """One row per row of ``df`` and column: ``keep``, the column's name, its value cast to ``dtype``."""
    return inline_rows(df, [{name: F.lit(c), value: named(c).cast(dtype)} for c in cols], keep)


def aggregate_rows(df: DataFrame, entries: Sequence[tuple[dict[str, Column], dict[str, Column]]],
                   group: Sequence[Column] = ()) -> DataFrame:
    """One row per entry (and group): its literal fields and its aggregates.

    A lazy plan of any width: aggregates go EXPRESSIONS at a time into one scan, scans are unioned.
    """
    entries, out, k = list(entries), None, 0
    while k < len(entries):
        part, size = [], 0
        while k < len(entries) and (not part or size + len(entries[k][1]) <= EXPRESSIONS):
            part.append(entries[k])
            size += len(entries[k][1])
            k += 1
        aggs = [v.alias(f"_{i}_{f}") for i, (_, values) in enumerate(part) for f, v in values.items()]
        row = (df.groupBy(*group) if group else df).agg(*aggs)
        keys = row.columns[:len(group)]
        rows = inline_rows(row, [{**fixed, **{f: F.col(f"_{i}_{f}") for f in values}} for i, (fixed, values) in enumerate(part)], keys)
        out = rows if out is None else out.unionByName(rows)
    return out

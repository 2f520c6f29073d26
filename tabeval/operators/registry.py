"""Experiment registry as tables: models, results, datasets.

Every change is a DataFrame rewrite (anti-join + union, conditional update)
returning the new table; writing it back is the caller's ``sink_table`` to a
lakehouse/Parquet path. No database server.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class DuplicateEntry(ValueError):
    pass


def upsert(table: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Insert rows, replacing existing rows with the same keys (register_dataset)."""
    keys = list(keys)
    return table.join(rows.select(*keys).distinct(), keys, "left_anti").unionByName(rows)


def insert_new(table: DataFrame, rows: DataFrame, keys: Sequence[str], strict: bool = False) -> DataFrame:
    """Insert rows whose keys are absent; with ``strict`` a duplicate raises
    (register_model / register_result refuse duplicates)."""
    keys = list(keys)
    if strict:
        dup = rows.join(table.select(*keys), keys, "left_semi").limit(1).count()
        if dup:
            raise DuplicateEntry(f"an entry with the same {keys} exists")
    return table.unionByName(rows.join(table.select(*keys).distinct(), keys, "left_anti"))


def append_experiment_used(datasets: DataFrame, data_name: str, exp_name: str) -> DataFrame:
    """Add an experiment to a dataset's ``exps_used`` array if absent."""
    hit = F.col("data_name") == data_name
    return datasets.withColumn("exps_used", F.when(hit, F.array_union(
        F.coalesce(F.col("exps_used"), F.array().cast("array<string>")), F.array(F.lit(exp_name))))
        .otherwise(F.col("exps_used")))


def list_experiments(models: DataFrame, results: DataFrame, search: str = "", kind: str | None = None) -> DataFrame:
    """Substring search and type filter over models, with result and algorithm counts."""
    m = models.where(F.col("exp_name").contains(search))
    if kind:
        m = m.where(F.col("type") == kind)
    rc = results.groupBy("exp_name").agg(F.count(F.lit(1)).cast("long").alias("n_results"))
    return m.join(rc, "exp_name", "left").select(
        "exp_name", "type", "time_created", F.coalesce("n_results", F.lit(0).cast("long")).alias("n_results"),
        F.size("algorithms").cast("long").alias("n_algorithms"))


def sort_registry(df: DataFrame, how: str = "alphabetical", name: str = "exp_name",
                  time: str = "time_created") -> DataFrame:
    """alphabetical / newest / oldest; a missing time sorts last either way."""
    if how == "alphabetical":
        return df.orderBy(F.col(name).asc_nulls_last())
    if how == "newest":
        return df.orderBy(F.col(time).desc_nulls_last(), F.col(name))
    if how == "oldest":
        return df.orderBy(F.col(time).asc_nulls_last(), F.col(name))
    raise ValueError(how)


def delete_experiment(models: DataFrame, results: DataFrame, exp_name: str) -> tuple[DataFrame, DataFrame]:
    return models.where(F.col("exp_name") != exp_name), results.where(F.col("exp_name") != exp_name)


def delete_result(results: DataFrame, exp_name: str, test_set: str) -> DataFrame:
    return results.where(~((F.col("exp_name") == exp_name) & (F.col("test_set") == test_set)))


def delete_dataset(datasets: DataFrame, data_name: str) -> DataFrame:
    return datasets.where(F.col("data_name") != data_name)


def rename_experiment(models: DataFrame, results: DataFrame, old: str, new: str) -> tuple[DataFrame, DataFrame]:
    """Rename across models and results; refused if the new name is taken."""
    if models.where(F.col("exp_name") == new).limit(1).count():
        raise DuplicateEntry(f"experiment {new} exists")
    ren = F.when(F.col("exp_name") == old, F.lit(new)).otherwise(F.col("exp_name"))
    return models.withColumn("exp_name", ren), results.withColumn("exp_name", ren)


def rename_dataset(datasets: DataFrame, old: str, new: str) -> DataFrame:
    """Rename a dataset (both its Train and Test rows); refused if taken."""
    if datasets.where(F.col("data_name") == new).limit(1).count():
        raise DuplicateEntry(f"dataset {new} exists")
    return datasets.withColumn("data_name", F.when(F.col("data_name") == old, F.lit(new)).otherwise(F.col("data_name")))


def set_union_names(*tables: DataFrame, name: str = "exp_name") -> DataFrame:
    out = None
    for t in tables:
        s = t.select(name)
        out = s if out is None else out.union(s)
    return out.distinct()

"""Keyed upserts and snapshot differences over tables that have no MERGE."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """Rows of new, and those of old that new has no key for."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new.select(*old.columns))


def replace_groups(old: DataFrame, new: DataFrame, group: str) -> DataFrame:
    """Groups that new holds are taken from it as a whole."""
    return upsert(old, new, group)


def snapshot_diff(old: DataFrame, new: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """keys, change (added, removed or changed) and the fields that differ; equal rows are left out."""
    a = old.select(*keys, F.struct(*fields).alias("old"))
    b = new.select(*keys, F.struct(*fields).alias("new"))
    both = a.join(b, keys, "full_outer")
    differ = F.filter(F.array(*[F.when(~F.col(f"old.{f}").eqNullSafe(F.col(f"new.{f}")), F.lit(f)) for f in fields]), lambda x: x.isNotNull())
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.size(differ) > 0, "changed")
    return both.select(*keys, change.alias("change"), F.when(change == "changed", differ).otherwise(F.array().cast("array<string>")).alias("fields")).filter(F.col("change").isNotNull())


def missing_counts(df: DataFrame, fields: list[str]) -> DataFrame:
    """One row: rows, rows with any missing value, and missing values of each field. One pass, no shuffle of rows."""
    missing = {f: F.col(f).isNull() | (F.trim(F.col(f).cast("string")) == "") for f in fields}
    some = reduce(lambda a, b: a | b, missing.values())
    return df.agg(F.count("*").alias("n_rows"), F.count_if(some).alias("rows_missing_any"), *[F.count_if(m).alias(f"missing_{f}") for f, m in missing.items()])

"""Inventories, snapshots, caches and keyed patches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def changes(before: DataFrame, after: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, state: added, removed, changed or same between two snapshots."""
    a = before.select(*keys, F.col(value).alias("_a"), F.lit(True).alias("_in_a"))
    b = after.select(*keys, F.col(value).alias("_b"), F.lit(True).alias("_in_b"))
    state = F.when(F.col("_in_a").isNull(), "added").when(F.col("_in_b").isNull(), "removed").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed").otherwise("same")
    return a.join(b, keys, "full_outer").select(*keys, state.alias("state"))


def cache_misses(wanted: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """What a content-addressed cache does not hold under the same identity."""
    return wanted.join(cache.select(*keys).distinct(), keys, "left_anti")


def patch(rows: DataFrame, edits: DataFrame, keys: list[str], column: str) -> tuple[DataFrame, DataFrame]:
    """(patched rows, conflicts): edits (keys, before, after) apply where `before` is what the row holds."""
    both = rows.join(edits.select(*keys, F.col("before").alias("_before"), F.col("after").alias("_after"), F.lit(True).alias("_edit")), keys, "left")
    fits = F.col("_edit").isNotNull() & F.col(column).eqNullSafe(F.col("_before"))
    done = both.withColumn(column, F.when(fits, F.col("_after")).otherwise(F.col(column))).drop("_before", "_after", "_edit")
    return done.select(*rows.columns), both.filter(F.col("_edit").isNotNull() & ~F.col(column).eqNullSafe(F.col("_before"))).select(*keys, column, "_before")


def exactly_one(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that do not name exactly one row."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n != 1")

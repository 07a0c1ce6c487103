"""Page routing over ordered parser attempts, and salvage status."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def route(attempts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, decision, profile, attempts_used, flags from attempts (keys, attempt, profile, passed, flags).

    ACCEPT: the first attempt passed; FALLBACK: a later one did; REVIEW_REQUIRED: none.
    """
    ok = F.when(F.col("passed"), F.col("attempt"))
    rows = attempts.groupBy(*keys).agg(
        F.min(ok).alias("taken"), F.min("attempt").alias("first"), F.max("attempt").alias("last"), F.min_by("profile", ok).alias("good"), F.max_by("flags", "attempt").alias("last_flags"), F.min_by("flags", ok).alias("good_flags")
    )
    decision = F.when(F.col("taken").isNull(), "REVIEW_REQUIRED").when(F.col("taken") == F.col("first"), "ACCEPT").otherwise("FALLBACK")
    return rows.select(*keys, decision.alias("decision"), F.when(F.col("taken").isNotNull(), F.col("good")).alias("profile"), (F.coalesce("taken", "last") - F.col("first") + 1).alias("attempts_used"), F.when(F.col("taken").isNull(), F.col("last_flags")).otherwise(F.col("good_flags")).alias("flags"))


def salvage_status(items: DataFrame, keys: list[str]) -> DataFrame:
    """keys, restored, to_review, review_needed, reasons from items (keys, status, reason, error, triggered)."""
    rows = items.groupBy(*keys).agg(
        F.count_if(F.col("status") == "AUTO_RESTORED").alias("restored"), F.count_if(F.col("status") == "REVIEW").alias("to_review"), F.bool_or(F.col("error").isNotNull()).alias("failed"), F.bool_or("triggered").alias("triggered"),
        F.array_sort(F.collect_set("reason")).alias("reasons"),
    )
    empty = F.col("triggered") & (F.col("restored") + F.col("to_review") == 0)
    return rows.withColumn("review_needed", (F.col("to_review") > 0) | F.col("failed") | empty | (F.size("reasons") > 0)).drop("failed", "triggered")


def merge_reasons(rows: DataFrame, columns: list[str], name: str = "reasons") -> DataFrame:
    """The distinct reasons of several array columns, in order of appearance."""
    parts = [F.coalesce(F.col(c), F.array().cast("array<string>")) for c in columns]
    return rows.withColumn(name, F.array_distinct(F.concat(*parts)))


def addendum(items: DataFrame, keys: list[str]) -> DataFrame:
    """A status-labelled Markdown list of recovered items (keys, place, status, text)."""
    line = F.format_string("- [%s] %s", "status", "text")
    rows = items.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))).alias("x"))
    return rows.select(*keys, F.array_join(F.transform("x", lambda r: r["line"]), "\n").alias("markdown"))

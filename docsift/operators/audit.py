"""Audit of stored candidate pools: rebuilt by corpus ordinals and held against recomputed ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCORE_TOLERANCE = 1e-6


def rebuilt(stored: DataFrame, corpus: DataFrame) -> DataFrame:
    """stored (qid, rank, corpus_index, score) with the corpus's columns (ordinal, position, ...) of each entry; null where no chunk has that ordinal."""
    return stored.join(corpus, F.col("corpus_index") == F.col("ordinal"), "left").drop("ordinal")


def altered(stored: DataFrame, corpus: DataFrame, pool: DataFrame) -> DataFrame:
    """One row a rank (qid, rank) that did not reproduce, with its state and both positions.

    pool (qid, rank, position, score) is recomputed. State: missing or unexpected rank, unknown_ordinal,
    other_chunk, other_score. A rank that a question stores twice is repeated_rank.
    """
    held = rebuilt(stored, corpus).select("qid", "rank", "corpus_index", F.col("position").alias("stored_position"), F.col("score").alias("stored_score"))
    held = held.groupBy("qid", "rank").agg(F.count("*").alias("times"), F.min(F.struct("corpus_index", "stored_position", "stored_score")).alias("s")).select("qid", "rank", "times", "s.*")
    both = held.join(pool.select("qid", "rank", "position", "score"), ["qid", "rank"], "full_outer")
    state = (
        F.when(F.col("times").isNull(), "missing").when(F.col("position").isNull(), "unexpected").when(F.col("times") > 1, "repeated_rank").when(F.col("stored_position").isNull(), "unknown_ordinal")
        .when(F.col("stored_position") != F.col("position"), "other_chunk").when(~F.coalesce(F.abs(F.col("stored_score") - F.col("score")) <= SCORE_TOLERANCE, F.lit(False)), "other_score")
    )
    return both.select("qid", "rank", state.alias("state"), "stored_position", "position").filter("state IS NOT NULL")


def scope_counts(stored: DataFrame, corpus: DataFrame, expected: DataFrame, first: int = 3) -> DataFrame:
    """qid, in_scope: how many of a question's first ranks lie in its expected source (expected: qid, source); questions without a pool give 0."""
    rows = rebuilt(stored.filter(F.col("rank") <= first), corpus).select("qid", F.col("source").alias("own_source"))
    return expected.join(rows, "qid", "left").groupBy("qid").agg(F.count_if(F.col("own_source") == F.col("source")).alias("in_scope"))

"""Corpus pipeline: toxicity, near duplicates, pseudonyms, mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and returns a
DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.llm import mixing, neardup, packing, pii, toxicity
from docsift.llm._shared import stored, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the classifier flags at the language's cutoff; documents without an id stay."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.filter_clean(docs, model).select(*COLUMNS)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal values by pseudonyms under the session's key (a public one without it); n_chars follows the new text.

    Null texts stay null, rows without an id and repeated rows are treated like any other.
    """
    return pii.pseudonymise(docs.select(*COLUMNS), demo=True).withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component of five-word-shingle similarity 0.8 and more.

    Rows without an id, and texts of one id that are not similar, all stay; so do texts without words. Of equal
    rows one stays.
    """
    return neardup.unique(docs.select(*COLUMNS), size=5)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document at its fitted rate, at most once, so the scarce domains set the total.

    Null and empty texts have no tokens and go by their rate like others; repeated rows are drawn one by one.
    """
    return mixing.mix(docs.select(*COLUMNS), table(spark, sf_dir, "labels"), max_rate=1.0)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences; null texts are empty, repeated rows are documents of their own."""
    return packing.pack(docs)


STAGES = [("toxicity", toxicity_stage), ("neardup", neardup_stage), ("pii", pii_stage), ("mixing", mixing_stage), ("packing", packing_stage)]
#: The stages train models and draw components, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

"""Incremental chunk ingestion: new documents are chunked as they arrive. An extra beside the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.functions.text import strip
from docsift.operators.chunking import MAX_CHARS, window_starts

DOCUMENT_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def chunk_stream(spark: SparkSession, folder: str, schema: str = DOCUMENT_SCHEMA) -> DataFrame:
    """doc_id, section_no, start, text of every window, as an unbounded table; row-wise, so no state is kept."""
    docs = spark.readStream.schema(schema).parquet(folder)
    parts = docs.select("doc_id", F.posexplode(F.split("text", r"\n(?=#{1,6} )|\n(?U:\s)*\n")).alias("section_no", "section")).withColumn("section", strip("section")).filter("section != ''")
    parts = parts.select("doc_id", "section_no", "section", F.explode(window_starts(F.length("section"))).alias("start"))
    return parts.select("doc_id", "section_no", "start", strip(F.substring(F.col("section"), F.col("start") + 1, F.lit(MAX_CHARS))).alias("text")).filter("text != ''")


def ingest(spark: SparkSession, folder: str, table: str, checkpoint: str) -> None:
    """Appends the chunks of files that came since the last call, exactly once."""
    query = chunk_stream(spark, folder).writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()

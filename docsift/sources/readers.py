"""Sources: Markdown folders, page extraction through a seam, parser packages, question sets and reviews."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docsift.operators import blocks as B
from docsift.operators import inventory

QA_SCHEMA = "question string, expected_source string, source string, expected_page int, expected_keywords array<string>, category string, type string, review_required boolean, answer string"
PACKAGE_NAMES = ("structured.json", "middle.json", "content_list.json")


def markdown(spark: SparkSession, folder: str) -> DataFrame:
    """source, text: every top-level *.md file is one document, named by its file; none is an error."""
    rows = spark.read.option("pathGlobFilter", "*.md").text(folder, wholetext=True)
    rows = rows.select(F.col("_metadata.file_name").alias("source"), F.col("value").alias("text"))
    if rows.isEmpty():
        raise FileNotFoundError(f"no Markdown file in {folder}")
    return rows


def pages(spark: SparkSession, path: str, extract: Callable[[bytes], Iterator[str]], glob: str = "*.pdf") -> DataFrame:
    """source, page (from 1), text of binary files, read by `extract` on the executors.

    The extractor is a seam: no page library is part of this package.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select(F.col("_metadata.file_name").alias("source"), "content")

    def run(batches):
        for pdf in batches:
            rows = [(s, i, t) for s, c in zip(pdf["source"], pdf["content"]) for i, t in enumerate(extract(bytes(c)), 1)]
            yield pd.DataFrame(rows, columns=["source", "page", "text"])

    return files.mapInPandas(run, "source string, page int, text string")


def cached_pages(spark: SparkSession, path: str, cache: str, extract: Callable[[bytes], Iterator[str]], identity: str, glob: str = "*.pdf") -> DataFrame:
    """pages() behind a content-addressed cache table: only files whose (hash, identity) is new are extracted."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select(F.col("_metadata.file_name").alias("source"), F.sha2("content", 256).alias("key"), "content").withColumn("identity", F.lit(identity))
    try:
        held = spark.read.parquet(cache)
    except Exception as e:  # no cache yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        held = spark.createDataFrame([], "key string, identity string, page int, text string")
    todo = inventory.cache_misses(files, held, ["key", "identity"]).dropDuplicates(["key"])

    def run(batches):
        for pdf in batches:
            rows = [(k, d, i, t) for k, d, c in zip(pdf["key"], pdf["identity"], pdf["content"]) for i, t in enumerate(extract(bytes(c)), 1)]
            yield pd.DataFrame(rows, columns=["key", "identity", "page", "text"])

    todo.select("key", "identity", "content").mapInPandas(run, "key string, identity string, page int, text string").write.mode("append").parquet(cache)
    return files.select("source", "key", "identity").join(spark.read.parquet(cache), ["key", "identity"]).select("source", "page", "text")


def parser_json(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of parser JSON files: source, page, place, type, block_index, bbox, texts. Broken JSON is an error."""
    rows = spark.read.option("pathGlobFilter", "*.json").text(path, wholetext=True)
    return B.read_blocks(rows.select(F.col("_metadata.file_name").alias("source"), "value"))


def parser_packages(spark: SparkSession, path: str) -> DataFrame:
    """source, member, value of ZIP packages: the preferred JSON member, also inside one nested archive."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select(F.col("_metadata.file_name").alias("source"), "content")

    def member(content: bytes, nested: bool = True) -> tuple[str, str]:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            names = z.namelist()
            for wanted in PACKAGE_NAMES:
                found = [n for n in names if n == wanted or n.endswith(f"/{wanted}")]
                if len(found) > 1:
                    raise ValueError(f"more than one {wanted}")
                if found:
                    return found[0], z.read(found[0]).decode()
            inner = [n for n in names if n.endswith(".zip")]
            if nested and len(inner) == 1:
                return member(z.read(inner[0]), False)
        raise ValueError("no parser output in the package")

    def run(batches):
        for pdf in batches:
            rows = [(s, *member(bytes(c))) for s, c in zip(pdf["source"], pdf["content"])]
            yield pd.DataFrame(rows, columns=["source", "member", "value"])

    return files.mapInPandas(run, "source string, member string, value string")


def questions(spark: SparkSession, path: str) -> DataFrame:
    """qid, question, expected_source, expected_page, keywords, category, review_required of any of the three JSON forms."""
    rows = spark.read.schema(QA_SCHEMA).option("multiLine", True).option("mode", "FAILFAST").json(path)
    order = F.row_number().over(Window.orderBy(F.monotonically_increasing_id()))  # a question file is small
    return rows.select(
        order.alias("qid"), "question", F.coalesce("expected_source", "source").alias("expected_source"), "expected_page", F.coalesce("expected_keywords", F.array().cast("array<string>")).alias("keywords"),
        F.coalesce("category", "type", F.lit("text")).alias("category"), F.coalesce("review_required", F.lit(False)).alias("review_required"),
    )


def reviews(spark: SparkSession, path: str) -> DataFrame:
    """Review sheets: CSV with a header, all columns as text."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def referenced(files: DataFrame, qa: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files to read, sources that are missing): those the questions name; all, if a question names none."""
    wanted = qa.select("expected_source").distinct()
    unscoped = wanted.filter("expected_source is null").limit(1)
    named = files.join(wanted, files["source"] == wanted["expected_source"], "left_semi")
    chosen = files if not unscoped.isEmpty() else named
    missing = wanted.filter("expected_source is not null").join(files.select(F.col("source").alias("have")), F.col("expected_source") == F.col("have"), "left_anti")
    return chosen, missing


def corpus(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Union of aliased Markdown folders: alias, source, text. Aliases are letters, digits, - and _, 64 at most."""
    import re

    out = None
    for alias, path in paths.items():
        if not re.fullmatch(r"[A-Za-z0-9_-]{1,64}", alias):
            raise ValueError(f"unsafe alias {alias!r}")
        part = markdown(spark, path).select(F.lit(alias).alias("alias"), "source", "text")
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no document given")
    return out


def parse_aliases(values: list[str], most: int = 4) -> dict[str, str]:
    """ALIAS=PATH arguments; aliases are unique."""
    found = dict(v.split("=", 1) for v in values if "=" in v)
    if not 1 <= len(values) <= most or len(found) != len(values):
        raise ValueError(f"give 1 to {most} unique ALIAS=PATH values")
    return found


def replay(requests: DataFrame, saved: DataFrame) -> DataFrame:
    """Saved observations of (query, scopes); a request that was never saved has a null result."""
    return requests.join(saved, ["query", "scopes"], "left")

"""Sinks: exclusive results, redacted event logs, review sheets, audits and manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SECRET = r"(?i)(authorization|api[_-]?key|token|secret)([\"']?\s*[:=]\s*[\"']?)(?:bearer\s+)?[A-Za-z0-9._~+/-]{6,}=*"


def result(df: DataFrame, path: str) -> None:
    """JSON that never overwrites: an existing path is an error."""
    df.write.mode("errorifexists").json(path)


def guarded(df: DataFrame, path: str, root: str) -> None:
    """JSON below an allowed output root only."""
    import posixpath

    if not posixpath.normpath(path).startswith(posixpath.normpath(root) + "/"):
        raise ValueError(f"{path} is outside {root}")
    df.write.mode("overwrite").json(path)


def redact(c: str) -> Column:
    return F.regexp_replace(F.col(c), SECRET, "$1$2[redacted]")


def events(df: DataFrame, path: str) -> None:
    """Appends events as JSON lines, secrets in text columns replaced first."""
    text = {f.name for f in df.schema.fields if f.dataType.simpleString() == "string"}
    df.select(*[redact(c).alias(c) if c in text else F.col(c) for c in df.columns]).write.mode("append").json(path)


def review_sheet(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("header", True).option("escape", '"').csv(path)


def audits(attempts: DataFrame, path: str) -> None:
    """page_quality, route_log and review_required of routed pages, partitioned by page."""
    attempts.write.mode("overwrite").partitionBy("page").json(f"{path}/page_quality")
    attempts.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("attempt", "profile", "passed"))).alias("route")).write.mode("overwrite").json(f"{path}/route_log")
    attempts.groupBy("page").agg(F.bool_or("passed").alias("ok")).filter("not ok").select("page").write.mode("overwrite").json(f"{path}/review_required")


def manifest(df: DataFrame, value: str, path: str) -> str:
    """Freezes the fingerprint of a column; a manifest that exists is an error."""
    rows = df.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(value)), "\n"), 256).alias("fingerprint"), F.count("*").alias("n"))
    rows.write.mode("errorifexists").json(path)
    return rows.first()["fingerprint"]


def report(df: DataFrame, title: str, path: str) -> str:
    """A Markdown table of a small result (at most 1,000 rows), written as one text file."""
    rows = df.limit(1_001).collect()
    if len(rows) > 1_000:
        raise ValueError("a report holds at most 1000 rows")
    cell = lambda x: "" if x is None else str(x).replace("|", "\\|").replace("\n", " ")
    lines = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns), *["| " + " | ".join(cell(x) for x in r) + " |" for r in rows]]
    text = "\n".join(lines) + "\n"
    df.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("errorifexists").text(path)
    return text

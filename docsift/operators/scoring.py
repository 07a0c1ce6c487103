"""Scopes and eligibility, overlap profiles, sections and patterns, coverage counts and candidate groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsift.functions import text as T

# Fixed values.
MILEAGE = r"(?i)(?<![A-Za-z0-9])(?:D1|D)?K\d{2,3}\+\d{3,4}(?!\d)"
LOCATION = r"[一-鿿A-Za-z0-9·（）()]{1,32}?(?:大桥|隧道|中继站|基站|车站|站|桥)"
LENGTH = r"(?i)(?<![A-Za-z0-9])[-–—−]?\s*\d+(?:\.\d+)?\s*m\b"
COVERAGE_TOKEN = r"[㐀-鿿]|[\p{L}\p{N}_]+(?:[.+/\-−–—][\p{L}\p{N}_]+)*|[+\-−–—]|[<>≤≥=×*%‰°℃μµ¢ΦφØΩ²³]"
EMPTY_SECTIONS = ("", "-", "none", "n/a", "not applicable", "无", "未提供")
SETTLED = ("ok", "no_evidence")

_FULL_WIDTH = "".join(map(chr, range(0xFF01, 0xFF5F)))
_ASCII = "".join(map(chr, range(0x21, 0x7F)))


def resolve_scopes(asked: Column, known: Column) -> Column:
    """The scopes asked for in corpus order; all for null; null where one is unknown, repeated, or none is named."""
    wrong = (F.size(asked) == 0) | (F.size(F.array_distinct(asked)) < F.size(asked)) | (F.size(F.array_except(asked, known)) > 0)
    return F.when(asked.isNull(), known).when(~F.coalesce(wrong, F.lit(True)), F.filter(known, lambda s: F.array_contains(asked, s)))


def eligible_searches(scopes: DataFrame, searches: DataFrame) -> DataFrame:
    """(task_id, scope, query) of scopes without a settled search of the same query; searches: task_id, scope, query, status."""
    done = searches.filter(F.col("status").isin(*SETTLED)).select("task_id", "scope", "query")
    return scopes.join(done, ["task_id", "scope", "query"], "left_anti")


def eligible_lookups(observed: DataFrame, looked_up: DataFrame) -> DataFrame:
    """(task_id, evidence_id, scope) observed and not looked up; where a task has scopes with candidates and no lookup, only theirs."""
    seen = observed.select("task_id", "evidence_id", "scope").distinct().join(looked_up.select("task_id", "evidence_id", F.lit(True).alias("done")).distinct(), ["task_id", "evidence_id"], "left")
    by_scope = seen.groupBy("task_id", "scope").agg(F.count("done").alias("n"))
    open_scopes = by_scope.filter("n = 0").select("task_id", "scope", F.lit(True).alias("open"))
    open_tasks = open_scopes.select("task_id", F.lit(True).alias("any_open")).distinct()
    rows = seen.filter("done is null").join(open_scopes, ["task_id", "scope"], "left").join(open_tasks, "task_id", "left")
    return rows.filter("any_open is null or open").select("task_id", "evidence_id", "scope")


def overlap(query: Column, text: Column) -> Column:
    """struct of the share of query tokens (distinct) that the text holds, and of shared identifiers, numbers and CJK tokens; from token arrays."""
    shared = F.array_intersect(query, text)
    n = F.size(F.array_distinct(query))

    def count(test) -> Column:
        return F.size(F.filter(shared, test))

    return F.struct(
        F.when(n > 0, F.size(shared) / n).otherwise(0.0).alias("query_token_coverage"), count(lambda t: t.rlike("[-_/]") | (t.rlike("[a-z]") & t.rlike("[0-9]"))).alias("shared_identifier_tokens"),
        count(lambda t: t.rlike("[0-9]")).alias("shared_numeric_tokens"), count(lambda t: t.rlike(r"[㐀-鿿]")).alias("shared_cjk_tokens"),
    )


def section(output: Column | str, heading: str) -> Column:
    """The lines below a heading line up to the next second-level one, stripped, empty ones left out."""
    lines = F.transform(F.split(T.col(output), r"\r\n|[\n\r]"), lambda x: T.strip(x))
    at = F.array_position(F.transform(lines, lambda x: F.lower(x)), heading.lower())
    below = F.slice(lines, at.cast("int") + 1, F.size(lines))
    stop = F.array_position(F.transform(below, lambda x: F.startswith(F.concat(x, F.lit(" ")), F.lit("## ")) & (F.length(x) > 2)), True)
    body = F.when(stop > 0, F.slice(below, 1, F.greatest(stop.cast("int") - 1, F.lit(0)))).otherwise(below)
    return F.when(at > 0, F.array_join(F.filter(body, lambda x: x != ""), "\n")).otherwise("")


def meaningful(content: Column) -> Column:
    return ~F.lower(T.strip(content)).isin(*EMPTY_SECTIONS)


def coverage_tokens(text: Column | str) -> Column:
    """Letters, numbers with their inner signs, signs and units; full-width ASCII is folded, nothing else."""
    return F.regexp_extract_all(F.translate(T.col(text), _FULL_WIDTH, _ASCII), F.lit(COVERAGE_TOKEN), F.lit(0))


def metadata_coverage(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row of counts: which documents (block_type, bbox, image_index, caption, block_geometry) and chunks (bbox) carry their metadata."""
    kind = F.col("block_type")
    visual, image, group = kind.isin("image", "chart", "table"), kind == "image", kind == "text_group"
    own = documents.agg(
        F.count_if(visual).alias("visual_documents"), F.count_if(visual & F.col("bbox").isNotNull()).alias("visual_documents_with_bbox"), F.count_if(image).alias("image_documents"),
        F.count_if(image & F.col("image_index").isNotNull()).alias("image_documents_with_index"), F.count_if(image & (F.coalesce("caption", F.lit("")) != "")).alias("image_documents_with_caption"),
        F.count_if(group & (F.coalesce(F.size("block_geometry"), F.lit(0)) > 0)).alias("text_group_documents_with_block_geometry"),
    )
    return own.crossJoin(chunks.agg(F.count_if(F.col("bbox").isNotNull()).alias("chunks_with_bbox")))  # one row each


def finite_metrics(rows: DataFrame, allowed: list[str], keep: list[str]) -> DataFrame:
    """keep and the allowed metrics that rows have; a number that is not finite becomes null."""
    kinds = dict(rows.dtypes)
    bad = lambda c: F.isnan(c) | (F.abs(c) == float("inf"))
    return rows.select(*keep, *[F.when(bad(F.col(c)), None).otherwise(F.col(c)).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in allowed if c in kinds])


def mechanism_passed() -> Column:
    """A target expanded over boundary rows with rows restored, and ranked better than before."""
    return (F.col("status") == "EXPANDED") & (F.col("context_type") == "table_boundary_rows") & (F.size("row_indices") > 0) & (F.col("parent_rank") < F.col("baseline_rank"))


def candidate_groups(tasks: DataFrame, oracle: DataFrame, reviews: DataFrame) -> DataFrame:
    """(task_id, candidate_group): what the reviewed candidates of a task can be held against.

    oracle (task_id, scope, expected_available, expected_ids), reviews (task_id, evidence_id, scope, label).
    Without oracle rows PREFLIGHT_CONTROL; with an unknown availability, or ids that some scopes state and a
    required one lacks, UNASSESSED; CANDIDATE_AVAILABLE where every required scope has a relevant candidate,
    of its expected ids if ids are stated; else RETRIEVAL_BOUND.
    """
    good = reviews.filter("label = 'RELEVANT'").groupBy("task_id", "scope").agg(F.collect_set("evidence_id").alias("ids"))
    stated = oracle.groupBy("task_id").agg(F.bool_or(F.col("expected_ids").isNotNull()).alias("by_id"))
    rows = oracle.join(stated, "task_id").join(good, ["task_id", "scope"], "left")
    required = F.coalesce(F.col("expected_available"), F.lit(False))
    vague = F.col("expected_available").isNull() | (F.col("by_id") & required & (F.coalesce(F.size("expected_ids"), F.lit(0)) <= 0))
    met = F.when(F.col("by_id"), F.arrays_overlap("ids", "expected_ids")).otherwise(F.col("ids").isNotNull())
    told = rows.groupBy("task_id").agg(F.bool_or(vague).alias("vague"), F.bool_and(~required | F.coalesce(met, F.lit(False))).alias("met"))
    group = F.when(F.col("met").isNull(), "PREFLIGHT_CONTROL").when(F.col("vague"), "UNASSESSED").when(F.col("met"), "CANDIDATE_AVAILABLE").otherwise("RETRIEVAL_BOUND")
    return tasks.select("task_id").join(told, "task_id", "left").select("task_id", group.alias("candidate_group"))


def selected(selection: DataFrame, observed: DataFrame, looked_up: DataFrame) -> DataFrame:
    """selection (task_id, place, scope, evidence_id) with text and violation: unobserved, not_looked_up, wrong_scope or duplicate.

    looked_up: task_id, evidence_id, source, text. A row without violation is rendered by its text.
    """
    from pyspark.sql.window import Window

    seen = observed.select("task_id", "evidence_id", F.lit(True).alias("seen")).distinct()
    found = looked_up.groupBy("task_id", "evidence_id").agg(F.min(F.struct("source", "text")).alias("found"))
    nth = F.row_number().over(Window.partitionBy("task_id", "evidence_id").orderBy("place"))
    rows = selection.withColumn("nth", nth).join(seen, ["task_id", "evidence_id"], "left").join(found, ["task_id", "evidence_id"], "left")
    violation = F.when(F.col("nth") > 1, "duplicate").when(F.col("seen").isNull(), "unobserved").when(F.col("found").isNull(), "not_looked_up").when(F.col("found.source") != F.col("scope"), "wrong_scope")
    return rows.select("task_id", "place", "scope", "evidence_id", F.when(violation.isNull(), F.col("found.text")).alias("text"), violation.alias("violation"))

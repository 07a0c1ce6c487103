"""Scoring of retrieval results with three-valued hits, evidence ranks, diagnosis and arm comparisons.

Tables: qa (qid, question, expected_source, expected_page, keywords, category, review_required) and
results (arm, qid, rank, source, page, text). A missing label gives a null hit, and nulls are in no
denominator.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsift.functions import text as T

TOP_K = 3
LAYERS = ("PARSING", "REPRESENTATION", "CHUNKING", "RETRIEVAL", "RANKING", "INSUFFICIENT_DATA", "GT_UNCERTAIN")
HITS = ("top1_source_hit", "top3_source_hit", "top1_page_hit", "top3_page_hit", "keyword_hit", "normalized_keyword_hit")


def in_scope(source: Column, page: Column) -> Column:
    """Expected source and page agree where they are given."""
    return (F.col("expected_source").isNull() | (F.col("expected_source") == source)) & (F.col("expected_page").isNull() | (F.col("expected_page") == page))


def eligible() -> Column:
    """Whether a question takes part in retrieval scoring at all."""
    return F.col("expected_source").isNotNull() | F.col("expected_page").isNotNull() | (F.size("keywords") > 0)


def validate_qa(qa: DataFrame, categories: list[str] | None = None) -> DataFrame:
    """qa with violations: the rules that a row breaks, instead of an exception."""
    rules = [
        ("question_missing", F.coalesce(T.strip("question"), F.lit("")) == ""),
        ("page_without_source", F.col("expected_page").isNotNull() & F.col("expected_source").isNull()),
        ("page_not_positive", F.coalesce(F.col("expected_page") < 1, F.lit(False))),
        ("empty_keyword", F.exists("keywords", lambda k: F.coalesce(T.strip(k), F.lit("")) == "")),
    ]
    if categories:
        rules.append(("unknown_category", F.col("category").isNotNull() & ~F.col("category").isin(*categories)))
    return qa.withColumn("violations", F.filter(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules]), lambda x: x.isNotNull()))


def cases(results: DataFrame, qa: DataFrame, arms: list[str], top_k: int = TOP_K) -> DataFrame:
    """One row for each arm and question: HITS, evidence_rank and the in-scope flag of the first result.

    Results of a question are few (a candidate pool), so they are gathered once by question and arm;
    questions without any result stay.
    """
    item = F.struct("rank", "source", "page", "text", "normal")
    pools = results.withColumn("normal", T.evidence_normal("text")).groupBy("arm", "qid").agg(F.array_sort(F.collect_list(item)).alias("pool"))
    all_arms = qa.withColumn("arm", F.explode(F.array(*[F.lit(a) for a in arms])))
    rows = all_arms.join(pools, ["arm", "qid"], "left").withColumn("pool", F.coalesce("pool", F.array().cast(pools.schema["pool"].dataType)))

    def scoped(r: Column) -> Column:
        return in_scope(r["source"], r["page"])

    top = F.filter("pool", lambda r: r["rank"] <= top_k)
    first = F.filter("pool", lambda r: r["rank"] == 1)
    own_texts = F.transform(F.filter(top, scoped), lambda r: r["text"])
    source = lambda rs: F.exists(rs, lambda r: r["source"] == F.col("expected_source"))
    page = lambda rs: F.exists(rs, lambda r: (r["page"] == F.col("expected_page")) & (F.col("expected_source").isNull() | (r["source"] == F.col("expected_source"))))
    has_source, has_page, has_words = F.col("expected_source").isNotNull(), F.col("expected_page").isNotNull(), F.size("keywords") > 0
    whole = T.casefold(F.array_join(own_texts, "\n"))
    normal = F.transform(F.filter(top, scoped), lambda r: r["normal"])
    kw = T.evidence_normals("keywords")
    scoped_pool = F.filter("pool", scoped)
    ranks = F.transform(kw, lambda k: F.array_min(F.transform(F.filter(scoped_pool, lambda r: F.contains(r["normal"], k)), lambda r: r["rank"])))
    return rows.select(
        "arm", "qid", "category", "review_required", "expected_source", "expected_page", "keywords", "question",
        F.when(has_source, F.coalesce(source(first), F.lit(False))).alias("top1_source_hit"), F.when(has_source, F.coalesce(source(top), F.lit(False))).alias("top3_source_hit"),
        F.when(has_page, F.coalesce(page(first), F.lit(False))).alias("top1_page_hit"), F.when(has_page, F.coalesce(page(top), F.lit(False))).alias("top3_page_hit"),
        F.when(has_words, F.forall("keywords", lambda k: F.contains(whole, T.casefold(k)))).alias("keyword_hit"), F.when(has_words, T.contains_all(normal, kw)).alias("normalized_keyword_hit"),
        # the first rank whose prefix holds every keyword: the latest of the keywords' first ranks
        F.when(has_words & F.forall(ranks, lambda r: r.isNotNull()), F.array_max(ranks)).alias("evidence_rank"),
        F.array_min(F.transform(F.filter("pool", lambda r: r["page"] == F.col("expected_page")), lambda r: r["rank"])).alias("page_rank"),
        F.array_min(F.transform(scoped_pool, lambda r: r["rank"])).alias("scope_rank"), F.exists(first, scoped).alias("first_in_scope"), F.size("pool").alias("pool_size"),
    )


def failed() -> Column:
    """Any scored hit is false; null hits are no failures."""
    out = F.lit(False)
    for h in ("top1_source_hit", "top3_source_hit", "top1_page_hit", "top3_page_hit", "normalized_keyword_hit"):
        out = out | F.coalesce(~F.col(h), F.lit(False))
    return out


def ranked_evidence() -> Column:
    """Evidence rank; without keywords the page's rank, without a page the scope's rank."""
    return F.when(F.size("keywords") > 0, F.col("evidence_rank")).when(F.col("expected_page").isNotNull(), F.col("page_rank")).otherwise(F.col("scope_rank"))


def summary(rows: DataFrame, by: list[str]) -> DataFrame:
    """Hits and totals of each metric, nulls excluded."""
    aggs = [F.count("*").alias("total"), F.count_if(F.col("review_required")).alias("review_required_total")]
    for h in HITS:
        aggs += [F.count_if(F.col(h)).alias(f"{h}s"), F.count(h).alias(f"{h}_total")]
    return rows.groupBy(*by).agg(*aggs)


def evidence_in(texts: DataFrame, qa: DataFrame, name: str) -> DataFrame:
    """qid, <name>_in_scope, <name>_evidence: whether texts (source, page, text) of a question's scope exist and hold its keywords.

    Questions, and so their scopes and keywords, are few and stated: the distinct ones are broadcast, and every text
    stays where it is, reporting the keywords it holds; those are made distinct before the shuffle.
    """
    q = qa.select("qid", "expected_source", "expected_page", T.evidence_normals("keywords").alias("kw"))
    t = texts.select("source", "page", T.evidence_normal("text").alias("normal"))
    scope = ["expected_source", "expected_page"]

    def met(rows: DataFrame, asked: DataFrame, holds: Column) -> DataFrame:
        """The distinct rows of `asked` that some row of their scope meets."""
        page = (F.col("expected_page").isNull() | (F.col("expected_page") == F.col("page"))) & holds
        own = rows.join(F.broadcast(asked.filter("expected_source is not null")), (F.col("source") == F.col("expected_source")) & page)
        every = rows.join(F.broadcast(asked.filter("expected_source is null")), page)
        return own.select(*asked.columns).distinct().unionByName(every.select(*asked.columns).distinct())

    same = lambda a, b, columns: reduce(lambda x, y: x & y, [a[c].eqNullSafe(b[c]) for c in columns])
    words = q.select("qid", *scope, F.posexplode("kw").alias("i", "word"))
    found = met(t, words.select(*scope, "word").distinct(), F.contains("normal", "word"))
    held = words.join(found, same(words, found, [*scope, "word"]), "left_semi").groupBy("qid").agg(F.count("i").alias("n_held"))
    there = met(texts.select("source", "page").distinct(), q.select(*scope).distinct(), F.lit(True)).withColumn("there", F.lit(True))
    out = q.join(there, same(q, there, scope), "left").select("qid", "kw", F.coalesce("there", F.lit(False)).alias("there")).join(held, "qid", "left")
    return out.select("qid", F.col("there").alias(f"{name}_in_scope"), F.coalesce(F.col("there") & (F.coalesce("n_held", F.lit(0)) == F.size("kw")), F.lit(False)).alias(f"{name}_evidence"))


def diagnose(rows: DataFrame, documents: DataFrame, chunks: DataFrame, qa: DataFrame, top_k: int = TOP_K) -> DataFrame:
    """rows of cases() with error_layer (null where nothing failed): the first layer that lost the evidence."""
    rows = rows.join(evidence_in(documents, qa, "doc"), "qid").join(evidence_in(chunks, qa, "chunk"), "qid")
    words = F.size("keywords") > 0
    in_pool = F.when(words, F.col("evidence_rank").isNotNull()).otherwise(F.col("scope_rank").isNotNull())
    in_top = F.when(words, F.col("evidence_rank") <= top_k).otherwise(F.col("scope_rank") <= top_k)
    layer = (
        F.when(F.col("review_required"), "GT_UNCERTAIN").when(~failed(), F.lit(None).cast("string"))
        .when(~F.col("doc_in_scope") | (words & ~F.col("doc_evidence")), "PARSING").when(words & (~F.col("chunk_in_scope") | ~F.col("chunk_evidence")), "CHUNKING")
        .when(in_pool & F.col("scope_rank").isNotNull() & ~F.col("first_in_scope"), "RANKING").when(in_pool & ~F.coalesce(in_top, F.lit(False)), "RANKING").otherwise("RETRIEVAL")
    )
    return rows.withColumn("error_layer", layer)


def layer_counts(rows: DataFrame, by: list[str]) -> DataFrame:
    """A column for each layer, absent ones 0."""
    return rows.groupBy(*by).agg(*[F.count_if(F.col("error_layer") == x).alias(x.lower()) for x in LAYERS])


def paired(rows: DataFrame, before: str, after: str, columns: list[str]) -> DataFrame:
    """Questions of two arms side by side: qid, before_<c>, after_<c>."""
    a = rows.filter(F.col("arm") == before).select("qid", *[F.col(c).alias(f"before_{c}") for c in columns])
    b = rows.filter(F.col("arm") == after).select("qid", *[F.col(c).alias(f"after_{c}") for c in columns])
    return a.join(b, "qid", "full_outer")


def transitions(rows: DataFrame, before: str, after: str, hit: str) -> DataFrame:
    """gained and regressed question ids between two arms."""
    pair = paired(rows, before, after, [hit])
    a, b = F.coalesce(f"before_{hit}", F.lit(False)), F.coalesce(f"after_{hit}", F.lit(False))
    kind = pair.select("qid", F.when(~a & b, "gained").when(a & ~b, "regressed").alias("kind")).filter("kind is not null")
    return kind.groupBy("kind").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("qid")), ",").alias("question_ids"))


def complementarity(rows: DataFrame, a: str, b: str, hit: str) -> DataFrame:
    """The 2 x 2 table of two arms' hits, empty cells included."""
    spark = rows.sparkSession
    pair = paired(rows, a, b, [hit]).select("qid", F.col(f"before_{hit}").alias("first"), F.col(f"after_{hit}").alias("second"))
    cells = spark.createDataFrame([(x, y) for x in (True, False) for y in (True, False)], "first boolean, second boolean")
    found = pair.groupBy("first", "second").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("qid")), ",").alias("question_ids"))
    return F.broadcast(cells).join(found, ["first", "second"], "left").select("first", "second", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("question_ids", F.lit("")).alias("question_ids"))


def feature_groups(rows: DataFrame, hit: str) -> DataFrame:
    """Overlapping groups by query feature: size and hits of each arm."""
    flags = F.array(*[F.when(flag, F.lit(name)) for name, flag in T.query_features("question").items()])
    groups = rows.select("arm", F.explode(F.filter(flags, lambda x: x.isNotNull())).alias("feature"), hit)
    return groups.groupBy("feature", "arm").agg(F.count("*").alias("n"), F.count_if(F.col(hit)).alias("hits"))


def rescue_class(available: Column, first_rank: Column, second_rank: Column, k: int = 20) -> Column:
    """How a question that dense retrieval missed is found again."""
    return F.when(~available, "PARSING_OR_GT_ISSUE").when(second_rank <= k, "RESCUED_BY_HYBRID").when(first_rank <= k, "RESCUED_BY_BM25").otherwise("STILL_RETRIEVAL_FAILURE")


def fingerprint(rows: DataFrame, value: str) -> DataFrame:
    """One hash over the sorted values of a column."""
    return rows.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(value)), "\n"), 256).alias("fingerprint"))


def confusion(rows: DataFrame, expected: str, predicted: str, classes: list, columns: list) -> DataFrame:
    """Counts of predicted values (pivot over fixed columns) for each expected class, zeros included."""
    spark = rows.sparkSession
    kind = rows.schema[expected].dataType.simpleString()
    base = spark.createDataFrame([(c,) for c in classes], f"{expected} {kind}")
    found = rows.groupBy(expected).agg(*[F.count_if(F.col(predicted) == c).alias(f"predicted_{c}".lower()) for c in columns])
    out = F.broadcast(base).join(found, expected, "left")
    return out.select(expected, *[F.coalesce(f"predicted_{c}".lower(), F.lit(0)).alias(f"predicted_{c}".lower()) for c in columns])


def usage(events: DataFrame, by: list[str]) -> DataFrame:
    """Requests, token sums, cost known so far and cost only where every event is priced, latency."""
    ok = lambda c: F.when(F.col(c) >= 0, F.col(c))
    return events.groupBy(*by).agg(
        F.count("*").alias("requests"), F.coalesce(F.sum(ok("tokens")), F.lit(0)).alias("tokens"), F.round(F.sum(ok("cost")), 6).alias("known_cost"),
        F.when(F.count(ok("cost")) == F.count("*"), F.round(F.sum("cost"), 6)).alias("complete_cost"), F.round(F.avg(ok("latency")), 3).alias("mean_latency"), F.round(F.max(ok("latency")), 3).alias("max_latency"),
    )

"""Queries over retrieval evaluation: benchmark passages as questions, two arms of results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.operators import evaluate as E
from docsift.operators import retrieval
from docsift.storage import stored

from . import common as C
from .retrieval import HYBRID_SQL, hybrid

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected source and page of a passage are those of the first document that holds it."""
    b, d = C.table(spark, sf_dir, "benchmark"), C.table(spark, sf_dir, "documents").select("doc_id", "source", F.col("text").alias("body"))
    found = d.join(F.broadcast(b), F.contains("body", "text")).groupBy("item_id").agg(F.min("doc_id").alias("doc_id"))
    rows = b.join(found, "item_id", "left").join(d.drop("body"), "doc_id", "left")
    rows = rows.select(
        F.col("item_id").alias("qid"), F.col("text").alias("question"), F.col("source").alias("expected_source"), F.expr("CASE WHEN item_id % 5 <> 0 THEN doc_id % 10 END").alias("expected_page"),
        F.expr("CASE WHEN item_id % 9 = 0 THEN CAST(array() AS array<string>) ELSE slice(split(text, ' '), 1, 2) END").alias("keywords"),
        F.expr("element_at(array('text', 'table', 'chart'), CAST(item_id % 3 AS INT) + 1)").alias("category"), F.expr("item_id % 13 = 0").alias("review_required"),
    )
    return stored(rows, "questions")  # a row a passage; each use would search all documents again


def arms(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Results of both arms, and all chunks."""
    pool, own = hybrid(spark, sf_dir)
    pool = pool.select("qid", "position", F.explode(F.array(F.struct(F.lit("bm25").alias("arm"), F.col("bm25_rank").alias("rank")), F.struct(F.lit("hybrid").alias("arm"), F.col("rank")))).alias("a"))
    res = pool.select("a.arm", "qid", "a.rank", "position").join(own, "position")
    return res.select("arm", "qid", "rank", "source", (F.col("doc_id") % 10).alias("page"), "text"), C.chunks(spark, sf_dir)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.cases(arms(spark, sf_dir)[0], qa(spark, sf_dir), ["bm25", "hybrid"])


F_ = C.FOLD
N_ = C.NORMAL
CASES_SQL = rf"""{HYBRID_SQL},
truth AS (SELECT item_id, min(doc_id) AS doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY item_id),
qa AS (SELECT b.item_id AS qid, b.text AS question, d.source AS expected_source, CASE WHEN b.item_id % 5 <> 0 THEN d.doc_id % 10 END AS expected_page,
  CASE WHEN b.item_id % 9 = 0 THEN []::VARCHAR[] ELSE string_split(b.text, ' ')[1:2] END AS kw, ['text', 'table', 'chart'][b.item_id % 3 + 1] AS category, b.item_id % 13 = 0 AS review_required
  FROM benchmark b LEFT JOIN truth USING (item_id) LEFT JOIN documents d ON d.doc_id = truth.doc_id),
res AS (SELECT arm, qid, rank, source, doc_id % 10 AS page, text FROM (SELECT 'bm25' AS arm, qid, bm25_rank AS rank, position FROM hyb UNION ALL SELECT 'hybrid', qid, rank, position FROM hyb) JOIN chunks USING (position)),
j AS (SELECT a.arm, qa.*, r.rank, r.source, r.page, r.text, (expected_source IS NULL OR expected_source = r.source) AND (expected_page IS NULL OR expected_page = r.page) AS ok
  FROM qa CROSS JOIN (VALUES ('bm25'), ('hybrid')) a(arm) LEFT JOIN res r ON r.arm = a.arm AND r.qid = qa.qid),
k AS (SELECT arm, qid, unnest(CASE WHEN len(kw) = 0 THEN [NULL] ELSE kw END) AS w, rank, text, ok FROM j),
kr AS (SELECT arm, qid, w, min(rank) FILTER (WHERE ok AND contains({N_.format('text')}, {N_.format('w')})) AS first_rank FROM k WHERE w IS NOT NULL GROUP BY ALL),
er AS (SELECT arm, qid, CASE WHEN count(*) = count(first_rank) THEN max(first_rank) END AS evidence_rank, coalesce(bool_and(first_rank <= 3), false) AND count(*) = count(first_rank) AS norm_hit FROM kr GROUP BY ALL),
cat AS (SELECT arm, qid, coalesce(string_agg({F_.format('text')}, chr(10) ORDER BY rank) FILTER (WHERE ok AND rank <= 3), '') AS whole FROM j GROUP BY ALL),
sk AS (SELECT arm, qid, bool_and(contains(whole, {F_.format('w')})) AS strict_hit FROM (SELECT DISTINCT arm, qid, w FROM k WHERE w IS NOT NULL) JOIN cat USING (arm, qid) GROUP BY ALL),
cases AS (SELECT arm, qid, any_value(question) AS question, any_value(category) AS category, any_value(review_required) AS review_required, any_value(expected_source) AS expected_source, any_value(expected_page) AS expected_page, any_value(len(kw)) AS n_kw,
  CASE WHEN any_value(expected_source) IS NOT NULL THEN coalesce(bool_or(rank = 1 AND source = expected_source), false) END AS top1_source_hit,
  CASE WHEN any_value(expected_source) IS NOT NULL THEN coalesce(bool_or(rank <= 3 AND source = expected_source), false) END AS top3_source_hit,
  CASE WHEN any_value(expected_page) IS NOT NULL THEN coalesce(bool_or(rank = 1 AND page = expected_page AND (expected_source IS NULL OR source = expected_source)), false) END AS top1_page_hit,
  CASE WHEN any_value(expected_page) IS NOT NULL THEN coalesce(bool_or(rank <= 3 AND page = expected_page AND (expected_source IS NULL OR source = expected_source)), false) END AS top3_page_hit,
  min(rank) FILTER (WHERE page = expected_page) AS page_rank, min(rank) FILTER (WHERE ok) AS scope_rank, coalesce(bool_or(ok AND rank = 1), false) AS first_in_scope FROM j GROUP BY arm, qid),
cs AS (SELECT cases.*, CASE WHEN n_kw > 0 THEN coalesce(strict_hit, false) END AS keyword_hit, CASE WHEN n_kw > 0 THEN coalesce(norm_hit, false) END AS normalized_keyword_hit, evidence_rank
  FROM cases LEFT JOIN er USING (arm, qid) LEFT JOIN sk USING (arm, qid))"""
HIT_COLUMNS = ", ".join(E.HITS)


@query(f"WITH {CASES_SQL} SELECT arm, qid, {HIT_COLUMNS} FROM cs")
def evl_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("arm", "qid", *E.HITS)


@query(f"WITH {CASES_SQL} SELECT arm, qid, evidence_rank, page_rank, scope_rank, CASE WHEN n_kw > 0 THEN evidence_rank WHEN expected_page IS NOT NULL THEN page_rank ELSE scope_rank END AS fallback_rank FROM cs")
def evl_evidence_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("arm", "qid", "evidence_rank", "page_rank", "scope_rank", E.ranked_evidence().alias("fallback_rank"))


SUMS = ", ".join(f"count(*) FILTER (WHERE {h}) AS {h}s, count({h}) AS {h}_total" for h in E.HITS)


@query(f"WITH {CASES_SQL} SELECT arm, count(*) AS total, count(*) FILTER (WHERE review_required) AS review_required_total, {SUMS} FROM cs GROUP BY arm")
def evl_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.summary(scored(spark, sf_dir), ["arm"])


@query(f"WITH {CASES_SQL} SELECT arm, category, count(*) AS total, count(*) FILTER (WHERE review_required) AS review_required_total, {SUMS} FROM cs GROUP BY arm, category")
def evl_summary_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.summary(scored(spark, sf_dir), ["arm", "category"])


@query(f"WITH {CASES_SQL} SELECT arm, count(*) AS total, count(*) FILTER (WHERE review_required) AS review_required_total, {SUMS} FROM cs WHERE qid <> 17 GROUP BY arm")
def evl_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same metrics without one uncertain question: the slice is the feature."""
    return E.summary(scored(spark, sf_dir).filter("qid != 17"), ["arm"])


FAILED = " OR ".join(f"{h} IS FALSE" for h in ("top1_source_hit", "top3_source_hit", "top1_page_hit", "top3_page_hit", "normalized_keyword_hit"))
DIAG_SQL = f"""{CASES_SQL},
dk AS (SELECT qa.qid, any_value(len(kw)) AS n, count(d.doc_id) > 0 AS in_scope FROM qa LEFT JOIN documents d ON (expected_source IS NULL OR expected_source = d.source) AND (expected_page IS NULL OR expected_page = d.doc_id % 10) GROUP BY qa.qid),
qk AS (SELECT qid, expected_source, expected_page, unnest(kw) AS w FROM qa),
de AS (SELECT qid, bool_and(found) AS evidence FROM (SELECT qid, w, coalesce(bool_or(contains({N_.format('text')}, {N_.format('w')})), false) AS found FROM qk LEFT JOIN documents d ON (expected_source IS NULL OR expected_source = d.source) AND (expected_page IS NULL OR expected_page = d.doc_id % 10) GROUP BY ALL) GROUP BY qid),
ck AS (SELECT qa.qid, count(c.position) > 0 AS in_scope FROM qa LEFT JOIN chunks c ON (expected_source IS NULL OR expected_source = c.source) AND (expected_page IS NULL OR expected_page = c.doc_id % 10) GROUP BY qa.qid),
ce AS (SELECT qid, bool_and(found) AS evidence FROM (SELECT qid, w, coalesce(bool_or(contains({N_.format('text')}, {N_.format('w')})), false) AS found FROM qk LEFT JOIN chunks c ON (expected_source IS NULL OR expected_source = c.source) AND (expected_page IS NULL OR expected_page = c.doc_id % 10) GROUP BY ALL) GROUP BY qid),
diag AS (SELECT cs.*, CASE WHEN review_required THEN 'GT_UNCERTAIN' WHEN NOT coalesce({FAILED}, false) THEN NULL
  WHEN NOT dk.in_scope OR (n_kw > 0 AND NOT coalesce(de.evidence, false)) THEN 'PARSING' WHEN n_kw > 0 AND (NOT ck.in_scope OR NOT coalesce(ce.evidence, false)) THEN 'CHUNKING'
  WHEN CASE WHEN n_kw > 0 THEN evidence_rank IS NOT NULL ELSE scope_rank IS NOT NULL END AND scope_rank IS NOT NULL AND NOT first_in_scope THEN 'RANKING'
  WHEN CASE WHEN n_kw > 0 THEN evidence_rank IS NOT NULL ELSE scope_rank IS NOT NULL END AND NOT coalesce(CASE WHEN n_kw > 0 THEN evidence_rank <= 3 ELSE scope_rank <= 3 END, false) THEN 'RANKING' ELSE 'RETRIEVAL' END AS error_layer
  FROM cs JOIN dk USING (qid) LEFT JOIN de USING (qid) JOIN ck USING (qid) LEFT JOIN ce USING (qid))"""


def diagnosed(spark: SparkSession, sf_dir: str) -> DataFrame:
    res, rows = arms(spark, sf_dir)
    q = qa(spark, sf_dir)
    docs = C.table(spark, sf_dir, "documents").select("source", (F.col("doc_id") % 10).alias("page"), "text")
    return E.diagnose(E.cases(res, q, ["bm25", "hybrid"]), docs, rows.select("source", (F.col("doc_id") % 10).alias("page"), "text"), q)


@query(f"WITH {DIAG_SQL} SELECT arm, qid, error_layer FROM diag")
def evl_diagnosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnosed(spark, sf_dir).select("arm", "qid", "error_layer")


@query(f"WITH {DIAG_SQL} SELECT arm, {', '.join(f'''count(*) FILTER (WHERE error_layer = '{x}') AS {x.lower()}''' for x in E.LAYERS)} FROM diag GROUP BY arm")
def evl_layer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.layer_counts(diagnosed(spark, sf_dir), ["arm"])


@query(f"""WITH {DIAG_SQL}, p AS (SELECT a.qid, a.error_layer AS before_layer, b.error_layer AS after_layer FROM diag a JOIN diag b ON a.qid = b.qid AND a.arm = 'bm25' AND b.arm = 'hybrid')
SELECT qid, CASE WHEN before_layer IS NULL OR before_layer = 'GT_UNCERTAIN' THEN NULL WHEN after_layer IS NULL THEN 'FIXED' WHEN after_layer = 'RANKING' THEN 'STILL_RANKING' ELSE after_layer END AS failure_class FROM p""")
def evl_failure_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of each failure of the first arm in the second one."""
    pair = E.paired(diagnosed(spark, sf_dir), "bm25", "hybrid", ["error_layer"])
    before, after = F.col("before_error_layer"), F.col("after_error_layer")
    kind = F.when(before.isNull() | (before == "GT_UNCERTAIN"), F.lit(None).cast("string")).when(after.isNull(), "FIXED").when(after == "RANKING", "STILL_RANKING").otherwise(after)
    return pair.select("qid", kind.alias("failure_class"))


PAIR_SQL = f"{CASES_SQL}, p AS (SELECT a.qid, a.normalized_keyword_hit AS x, b.normalized_keyword_hit AS y, a.evidence_rank AS rx, b.evidence_rank AS ry FROM cs a JOIN cs b ON a.qid = b.qid AND a.arm = 'bm25' AND b.arm = 'hybrid')"


@query(f"WITH {PAIR_SQL} SELECT kind, count(*) AS n, string_agg(qid::VARCHAR, ',' ORDER BY qid) AS question_ids FROM (SELECT qid, CASE WHEN NOT coalesce(x, false) AND coalesce(y, false) THEN 'gained' WHEN coalesce(x, false) AND NOT coalesce(y, false) THEN 'regressed' END AS kind FROM p) WHERE kind IS NOT NULL GROUP BY kind")
def evl_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.transitions(scored(spark, sf_dir), "bm25", "hybrid", "normalized_keyword_hit")


@query(f"""WITH {PAIR_SQL}, c AS (SELECT * FROM (VALUES (true), (false)) a(first), (VALUES (true), (false)) b(second))
SELECT first, second, count(qid) AS n, coalesce(string_agg(qid::VARCHAR, ',' ORDER BY qid), '') AS question_ids FROM c LEFT JOIN p ON x = first AND y = second GROUP BY first, second""")
def evl_complementarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.complementarity(scored(spark, sf_dir), "bm25", "hybrid", "normalized_keyword_hit")


@query(rf"""WITH {CASES_SQL}, t AS (SELECT arm, question, normalized_keyword_hit AS h, {C.TOKENS.format('question')} AS tk FROM cs),
f AS (SELECT arm, h, unnest(list_filter([CASE WHEN len(list_filter(tk, lambda x: regexp_matches(x, '[-_/]') OR (regexp_matches(x, '[a-z]') AND regexp_matches(x, '[0-9]')))) > 0 THEN 'identifier' END,
 CASE WHEN len(list_filter(tk, lambda x: regexp_matches(x, '[0-9]'))) > 0 THEN 'numeric' END, CASE WHEN len(list_filter(tk, lambda x: regexp_matches(x, '[a-z]'))) > 0 THEN 'latin' END, CASE WHEN regexp_matches(question, '\b[A-Z]{{2,}}\b') THEN 'acronym_like' END], lambda x: x IS NOT NULL)) AS feature FROM t)
SELECT feature, arm, count(*) AS n, count(*) FILTER (WHERE h) AS hits FROM f GROUP BY ALL""")
def evl_feature_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.feature_groups(scored(spark, sf_dir), "normalized_keyword_hit")


@query(f"""WITH {DIAG_SQL} SELECT arm, count(*) FILTER (WHERE n_kw > 0) AS total, count(*) FILTER (WHERE n_kw > 0 AND evidence_rank <= 20) AS hits,
count(*) FILTER (WHERE n_kw > 0 AND ce.evidence) AS available, count(*) FILTER (WHERE n_kw > 0 AND ce.evidence AND evidence_rank <= 20) AS available_hits FROM cs LEFT JOIN ce USING (qid) GROUP BY arm""")
def evl_recall_at20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall over all scored questions, and over those whose evidence the chunks hold."""
    d = diagnosed(spark, sf_dir).filter(F.size("keywords") > 0)
    hit = F.col("evidence_rank") <= 20
    return d.groupBy("arm").agg(F.count("*").alias("total"), F.count_if(hit).alias("hits"), F.count_if("chunk_evidence").alias("available"), F.count_if(F.col("chunk_evidence") & hit).alias("available_hits"))


@query(f"""WITH {PAIR_SQL.replace(CASES_SQL, DIAG_SQL)} SELECT qid, CASE WHEN NOT coalesce(ce.evidence, false) THEN 'PARSING_OR_GT_ISSUE' WHEN ry <= 5 THEN 'RESCUED_BY_HYBRID' WHEN rx <= 5 THEN 'RESCUED_BY_BM25' ELSE 'STILL_RETRIEVAL_FAILURE' END AS rescue FROM p JOIN qa USING (qid) LEFT JOIN ce USING (qid) WHERE len(kw) > 0""")
def evl_rescue(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = diagnosed(spark, sf_dir).filter(F.size("keywords") > 0)
    pair = E.paired(d, "bm25", "hybrid", ["evidence_rank", "chunk_evidence"])
    return pair.select("qid", E.rescue_class(F.col("before_chunk_evidence"), F.col("before_evidence_rank"), F.col("after_evidence_rank"), 5).alias("rescue"))


@query("SELECT source, lang, count(*) AS n FROM documents GROUP BY source, lang")
def evl_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))


@query("SELECT source, sha256(string_agg(h, chr(10) ORDER BY h)) AS fingerprint FROM (SELECT source, sha256(text) AS h FROM documents) GROUP BY source")
def evl_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.table(spark, sf_dir, "documents").select("source", F.sha2("text", 256).alias("h"))
    return rows.groupBy("source").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), "\n"), 256).alias("fingerprint"))


@query("""WITH p AS (SELECT toxic, CASE WHEN length(text) < 300 THEN 'SHORT' WHEN length(text) % 11 = 0 THEN 'INVALID' WHEN length(text) % 7 = 0 THEN 'UNCERTAIN' ELSE 'LONG' END AS predicted FROM labels JOIN documents USING (doc_id)),
c AS (SELECT unnest([0, 1, 2]) AS toxic)
SELECT c.toxic, count(*) FILTER (WHERE predicted = 'SHORT') AS predicted_short, count(*) FILTER (WHERE predicted = 'LONG') AS predicted_long, count(*) FILTER (WHERE predicted = 'UNCERTAIN') AS predicted_uncertain, count(*) FILTER (WHERE predicted = 'INVALID') AS predicted_invalid FROM c LEFT JOIN p ON p.toxic = c.toxic GROUP BY c.toxic""")
def evl_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected classes against a deterministic stand-in prediction, a class without rows included."""
    n = F.length("text")
    predicted = F.when(n < 300, "SHORT").when(n % 11 == 0, "INVALID").when(n % 7 == 0, "UNCERTAIN").otherwise("LONG")
    rows = C.table(spark, sf_dir, "labels").join(C.table(spark, sf_dir, "documents"), "doc_id").select("toxic", predicted.alias("predicted"))
    return E.confusion(rows, "toxic", "predicted", [0, 1, 2], ["SHORT", "LONG", "UNCERTAIN", "INVALID"])


EVENTS_SQL = "e AS (SELECT event_type, event_id, ts, value, CASE WHEN event_id % 10 <> 0 THEN value / 100 END AS cost, CASE WHEN event_id % 7 <> 0 THEN value END AS latency, CAST(json_extract_string(props, '$.k') AS BIGINT) AS tokens FROM events)"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.table(spark, sf_dir, "events")
    return rows.select("event_type", "event_id", "ts", "value", "user_id", F.when(F.col("event_id") % 10 != 0, F.col("value") / 100).alias("cost"), F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("latency"), F.get_json_object("props", "$.k").cast("bigint").alias("tokens"))


@query(f"""WITH {EVENTS_SQL} SELECT event_type, count(*) AS requests, coalesce(sum(CASE WHEN tokens >= 0 THEN tokens END), 0)::BIGINT AS tokens, round(sum(CASE WHEN cost >= 0 THEN cost END), 6) AS known_cost,
CASE WHEN count(CASE WHEN cost >= 0 THEN cost END) = count(*) THEN round(sum(cost), 6) END AS complete_cost, round(avg(CASE WHEN latency >= 0 THEN latency END), 3) AS mean_latency, round(max(CASE WHEN latency >= 0 THEN latency END), 3) AS max_latency FROM e GROUP BY event_type""")
def use_api_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.usage(events(spark, sf_dir), ["event_type"])


@query("SELECT event_type, count(*) AS n, round(sum(value), 3) AS total, round(avg(value), 6) AS mean, round(min(value), 6) AS least, round(max(value), 6) AS most FROM events GROUP BY event_type")
def evl_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return C.table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum(v), 3).alias("total"), F.round(F.avg(v), 6).alias("mean"), F.round(F.min(v), 6).alias("least"), F.round(F.max(v), 6).alias("most"))

"""Queries over action traces and judgements, on conversations, events and benchmark questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.operators import agent as A
from docsift.operators import retrieval

from . import common as C
from .evaluate import EVENTS_SQL, events

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


ACTIONS_SQL = "acts AS (SELECT conv_id AS task_id, turn AS step, CASE WHEN role = 'user' THEN 'SEARCH' ELSE 'LOOKUP' END AS action, left(md5(text), 1) AS input, text FROM conversations)"


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.table(spark, sf_dir, "conversations")
    return rows.select(F.col("conv_id").alias("task_id"), F.col("turn").alias("step"), F.when(F.col("role") == "user", "SEARCH").otherwise("LOOKUP").alias("action"), F.substring(F.md5(F.col("text").cast("binary")), 1, 1).alias("input"), "text")


@query(f"WITH {ACTIONS_SQL} SELECT task_id, step, nth, nth > 1 AS repeated FROM (SELECT *, row_number() OVER (PARTITION BY task_id, action, input ORDER BY step) AS nth FROM acts)")
def agt_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.repeats(actions(spark, sf_dir)).select("task_id", "step", "nth", "repeated")


BUDGET_SQL = f"""{ACTIONS_SQL}, b AS (SELECT task_id, step, 12 - count(*) OVER w AS steps_left, 4 - count(*) FILTER (WHERE action = 'SEARCH') OVER w AS searches_left, 6 - count(*) FILTER (WHERE action = 'LOOKUP') OVER w AS lookups_left FROM acts WINDOW w AS (PARTITION BY task_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


@query(f"WITH {BUDGET_SQL} SELECT *, steps_left < 0 OR searches_left < 0 OR lookups_left < 0 AS violated FROM b")
def agt_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.budget(actions(spark, sf_dir)).select("task_id", "step", "steps_left", "searches_left", "lookups_left", "violated")


@query(rf"""WITH {ACTIONS_SQL}, o AS (SELECT task_id, step, unnest(string_split_regex(lower(text), '[^a-z]+')) AS id FROM acts), f AS (SELECT task_id, id, min(step) AS step FROM o GROUP BY ALL), n AS (SELECT task_id, step, count(*) AS new_ids FROM f GROUP BY ALL)
SELECT task_id, step, coalesce(new_ids, 0) AS new_ids FROM (SELECT DISTINCT task_id, step FROM o) LEFT JOIN n USING (task_id, step)""")
def agt_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = actions(spark, sf_dir).select("task_id", "step", F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("id"))
    return A.progress(seen)


@query(f"WITH {ACTIONS_SQL} SELECT task_id, min_by(input, step) AS first_input, max_by(input, step) AS last_input, count(*) AS steps, max_by(input, step) FILTER (WHERE action = 'SEARCH') AS last_search FROM acts GROUP BY task_id")
def agt_first_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.first_last(actions(spark, sf_dir))


@query(f"""WITH {BUDGET_SQL}, r AS (SELECT task_id, count(*) FILTER (WHERE nth > 1 AND action = 'SEARCH') AS repeated_search, count(*) FILTER (WHERE nth > 1 AND action = 'LOOKUP') AS repeated_lookup, count(DISTINCT input) FILTER (WHERE action = 'LOOKUP') AS distinct_lookups, count(*) AS steps FROM (SELECT *, row_number() OVER (PARTITION BY task_id, action, input ORDER BY step) AS nth FROM acts) GROUP BY task_id),
v AS (SELECT task_id, bool_or(steps_left < 0 OR searches_left < 0 OR lookups_left < 0) AS budget_violation FROM b GROUP BY task_id)
SELECT * FROM r JOIN v USING (task_id)""")
def agt_task_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.budget(A.repeats(actions(spark, sf_dir)))
    again = lambda kind: F.count_if(F.col("repeated") & (F.col("action") == kind))
    return rows.groupBy("task_id").agg(again("SEARCH").alias("repeated_search"), again("LOOKUP").alias("repeated_lookup"), F.countDistinct(F.when(F.col("action") == "LOOKUP", F.col("input"))).alias("distinct_lookups"), F.count("*").alias("steps"), F.bool_or("violated").alias("budget_violation"))


@query(f"""WITH {C.bm25_sql(3, 'source')}, sc AS (SELECT item_id AS qid, s.source AS scope FROM benchmark CROSS JOIN (SELECT DISTINCT source FROM documents) s),
best AS (SELECT qid, source AS scope, min_by(position, rank) FILTER (WHERE position % 3 <> 0) AS evidence_id FROM bm25 GROUP BY ALL)
SELECT sc.qid, sc.scope, evidence_id, CASE WHEN best.qid IS NULL THEN 'no_evidence_found' WHEN evidence_id IS NULL THEN 'insufficient_scope' ELSE 'evidence_found' END AS status FROM sc LEFT JOIN best ON best.qid = sc.qid AND best.scope = sc.scope""")
def agt_policy_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every question against every source; lookups of every third chunk fail."""
    found = retrieval.bm25(retrieval.build(C.chunks(spark, sf_dir), scope="source"), C.questions(spark, sf_dir), 3)
    found = found.select("qid", F.col("source").alias("scope"), "rank", F.col("position").alias("evidence_id"))
    names = C.table(spark, sf_dir, "documents").agg(F.collect_set("source").alias("names"))  # one row
    scopes = C.questions(spark, sf_dir).select("qid").crossJoin(F.broadcast(names)).select("qid", F.explode("names").alias("scope"))
    return A.outcomes(scopes, found, found.filter("evidence_id % 3 != 0").select("qid", "evidence_id").distinct())


@query(f"""WITH {C.bm25_sql(1, 'source')}, f AS (SELECT qid, text FROM bm25 JOIN chunks USING (position))
SELECT qid, count(*) AS n_found, CASE WHEN count(*) < 2 THEN 'incomplete' WHEN count(DISTINCT text) = 1 THEN 'same_text' ELSE 'different_text' END AS comparison FROM f GROUP BY qid""")
def agt_finish(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = retrieval.bm25(retrieval.build(C.chunks(spark, sf_dir), scope="source"), C.questions(spark, sf_dir), 1)
    found = found.join(C.chunks_of(spark, sf_dir, found).select("position", "text"), "position")
    return A.finish(found.withColumn("status", F.lit("evidence_found")))


@query("""SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'evidence_found' WHEN 1 THEN 'no_evidence_found' ELSE 'insufficient_scope' END AS status FROM customer""")
def agt_legacy_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = F.expr("CASE c_custkey % 3 WHEN 0 THEN 'supported' WHEN 1 THEN 'no_candidates' ELSE 'insufficient_evidence' END")
    return C.table(spark, sf_dir, "customer").select("c_custkey", A.canonical_status(old).alias("status"))


RAW = """CASE c_custkey % 12 WHEN 0 THEN '{"action":"SEARCH","query":"q","scopes":["S1"]}' WHEN 1 THEN '{"action":"SEARCH","query":"q","scopes":[]}' WHEN 2 THEN '{"action":"LOOKUP","evidence_id":"ev_' || c_custkey || '"}' WHEN 3 THEN '{"action":"LOOKUP"}'
WHEN 4 THEN '{"action":"CLARIFY","question":" "}' WHEN 5 THEN '{"action":"FINISH","outcomes":[{"scope":"a","status":"evidence_found","evidence_ids":["e"]},{"scope":"b","status":"no_evidence_found"}]}' WHEN 6 THEN '{"action":"FINISH","outcomes":[{"scope":"a","status":"no_evidence_found"},{"scope":"a","status":"no_evidence_found"}]}'
WHEN 7 THEN '{"action":"FINISH","outcomes":[{"scope":"a","status":"evidence_found","evidence_ids":["e","e"]}]}' WHEN 8 THEN '{"action":' WHEN 9 THEN '{"action":"FINISH","outcomes":[{"scope":"a","status":"maybe"}]}'
WHEN 10 THEN '{"action":"FINISH","outcomes":[{"scope":"a","status":"no_evidence_found","note":"x"}]}' ELSE '{"action":"FINISH","outcomes":[{"scope":"a","status":"evidence_found","evidence_ids":["e1","e2","e3","e4"]}]}' END"""


@query(f"""WITH r AS (SELECT c_custkey, CASE WHEN json_valid(raw) THEN raw::JSON END AS v FROM (SELECT c_custkey, {RAW} AS raw FROM customer)),
f AS (SELECT *, v ->> '$.action' AS action, list_sort(json_keys(v)) AS k, (v -> '$.scopes')::VARCHAR[] AS scopes, (v -> '$.outcomes')::JSON[] AS outcomes FROM r),
o AS (SELECT c_custkey, bool_and(coalesce(length(trim(x ->> '$.scope')) BETWEEN 1 AND 64 AND CASE x ->> '$.status' WHEN 'evidence_found' THEN list_sort(json_keys(x)) = ['evidence_ids', 'scope', 'status'] AND len(ids) BETWEEN 1 AND 3 AND len(list_distinct(ids)) = len(ids)
 WHEN 'insufficient_scope' THEN list_sort(json_keys(x)) = ['scope', 'status'] WHEN 'no_evidence_found' THEN list_sort(json_keys(x)) = ['scope', 'status'] ELSE false END, false)) AS good, count(DISTINCT x ->> '$.scope') < count(*) AS twice, count(*) AS n
 FROM (SELECT c_custkey, x, (x -> '$.evidence_ids')::VARCHAR[] AS ids FROM (SELECT c_custkey, unnest(outcomes) AS x FROM f)) GROUP BY c_custkey)
SELECT c_custkey, CASE WHEN v IS NULL THEN 'invalid_json' WHEN NOT coalesce(k = CASE action WHEN 'SEARCH' THEN ['action', 'query', 'scopes'] WHEN 'LOOKUP' THEN ['action', 'evidence_id'] WHEN 'CLARIFY' THEN ['action', 'question'] WHEN 'FINISH' THEN ['action', 'outcomes'] END, false) THEN 'unexpected_fields'
 WHEN action = 'SEARCH' AND NOT (length(trim(v ->> '$.query')) BETWEEN 1 AND 4000 AND len(scopes) = 1) THEN 'invalid_search' WHEN action = 'LOOKUP' AND length(trim(v ->> '$.evidence_id')) NOT BETWEEN 1 AND 100 THEN 'invalid_lookup' WHEN action = 'CLARIFY' AND length(trim(v ->> '$.question')) NOT BETWEEN 1 AND 500 THEN 'invalid_clarify'
 WHEN action = 'FINISH' AND NOT coalesce(good AND n <= 4, false) THEN 'invalid_outcomes' WHEN action = 'FINISH' AND twice THEN 'duplicate_scope' ELSE '' END AS violation FROM f LEFT JOIN o USING (c_custkey)""")
def agt_action_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.validate_actions(C.table(spark, sf_dir, "customer").select("c_custkey", F.expr(RAW).alias("raw")))
    return rows.select("c_custkey", F.coalesce("violation", F.lit("")).alias("violation"))


LABELS = "['aligned', 'different', 'not_applicable', 'uncertain']"
VERDICTS = "['EQUIVALENT', 'DIFFERENT', 'NOT_COMPARABLE']"
BASES = "['comparable_fact', 'different_object_or_field', 'incompatible_scope_or_installation_scenario', 'uncertain']"
#: A document's judgement: the digits of a number made of its id and its length.
JUDGED_SQL = f"""k AS (SELECT doc_id, doc_id * 7919 + length(text) AS n FROM documents),
j AS (SELECT doc_id, ({VERDICTS})[n % 3 + 1] AS verdict, ({BASES})[n // 3 % 4 + 1] AS basis, ({LABELS})[n // 12 % 4 + 1] AS o, ({LABELS})[n // 48 % 4 + 1] AS a, ({LABELS})[n // 192 % 4 + 1] AS u, ({LABELS})[n // 768 % 4 + 1] AS c FROM k WHERE n IS NOT NULL)"""


def judgements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A judgement of every document with a text: verdict, basis and labels from its id and length."""
    rows = C.table(spark, sf_dir, "documents").selectExpr("doc_id", "doc_id * 7919 + length(text) AS n").filter("n IS NOT NULL")
    pick = lambda values, by: F.expr(f"array({values[1:-1]})[cast(n div {by} % {len(values.split(', '))} AS int)]")
    return rows.select("doc_id", pick(VERDICTS, 1).alias("verdict"), pick(BASES, 3).alias("basis"), *[pick(LABELS, 12 * 4**i).alias(d) for i, d in enumerate(A.DIMENSIONS)])


@query(f"""WITH {JUDGED_SQL} SELECT doc_id, verdict, basis, o AS object_or_field, a AS "value", u AS unit, c AS condition_or_applicability,
CASE verdict WHEN 'EQUIVALENT' THEN o = 'aligned' AND a = 'aligned' AND u = 'aligned' AND c IN ('aligned', 'not_applicable') WHEN 'DIFFERENT' THEN o = 'aligned' AND 'different' IN (a, u, c) ELSE o = 'different' OR c = 'different' END AS consistent_v1,
CASE WHEN basis = 'uncertain' THEN verdict = 'NOT_COMPARABLE' AND 'uncertain' IN (o, a, u, c) WHEN 'uncertain' IN (o, a, u, c) THEN false WHEN verdict = 'EQUIVALENT' THEN basis = 'comparable_fact' AND o = 'aligned' AND a = 'aligned' AND u IN ('aligned', 'not_applicable') AND c IN ('aligned', 'not_applicable')
 WHEN verdict = 'DIFFERENT' THEN basis = 'comparable_fact' AND o = 'aligned' AND 'different' IN (a, u, c) WHEN basis = 'different_object_or_field' THEN o = 'different' WHEN basis = 'incompatible_scope_or_installation_scenario' THEN o = 'aligned' AND c = 'different' ELSE false END AS consistent_v2 FROM j""")
def sem_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judgements(spark, sf_dir).select("doc_id", "verdict", "basis", *A.DIMENSIONS, A.consistent_v1().alias("consistent_v1"), A.consistent_v2().alias("consistent_v2"))


DECIMALS = """CASE c_custkey % 8 WHEN 0 THEN c_custkey || '.50' WHEN 1 THEN c_custkey || '' WHEN 2 THEN '-0' WHEN 3 THEN '-' || c_custkey WHEN 4 THEN c_custkey || ' mm' WHEN 5 THEN c_custkey || '.000000000000000001' WHEN 6 THEN '0' || c_custkey ELSE '+' || c_custkey END""", """CASE c_custkey % 8 WHEN 0 THEN c_custkey || '.5' WHEN 1 THEN c_custkey || '1' WHEN 2 THEN '0' WHEN 3 THEN '-' || c_custkey || '.0' WHEN 4 THEN c_custkey || ' mm' WHEN 5 THEN c_custkey || '.000000000000000002' WHEN 6 THEN '0' || c_custkey ELSE '+' || c_custkey END"""
PLAIN_SQL = r"'^-?(0|[1-9][0-9]*)(\.[0-9]+)?$'"


@query(f"""WITH v AS (SELECT c_custkey, {DECIMALS[0]} AS a, {DECIMALS[1]} AS b FROM customer)
SELECT c_custkey, CASE WHEN regexp_matches(a, {PLAIN_SQL}) AND regexp_matches(b, {PLAIN_SQL}) THEN try_cast(a AS DECIMAL(38, 20)) = try_cast(b AS DECIMAL(38, 20)) AND starts_with(a, '-') = starts_with(b, '-') ELSE false END AS equal FROM v""")
def mth_decimal_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal values in two notations, other values in the first and the last digits, signed zeros, and texts that are no plain decimals."""
    return C.table(spark, sf_dir, "customer").select("c_custkey", A.decimal_equal(*[F.expr(x) for x in DECIMALS]).alias("equal"))


@query(f"""WITH {EVENTS_SQL} SELECT event_type, round(sum(CASE WHEN tokens >= 0 THEN (CASE WHEN event_id % 3 = 0 THEN (tokens // 2) * 0.04 + (tokens - tokens // 2) * 2.0 ELSE tokens * 2.0 END + 10 * 8.0) / 1000000 END), 6) AS cost FROM e GROUP BY event_type""")
def use_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    cached = F.when(F.col("event_id") % 3 == 0, F.floor(F.col("tokens") / 2))
    return events(spark, sf_dir).groupBy("event_type").agg(F.round(F.sum(A.cost(F.col("tokens"), cached, F.lit(10))), 6).alias("cost"))


@query("""WITH RECURSIVE c AS (SELECT c_nationkey AS arm, c_custkey AS id, round(abs(c_acctbal)) AS e, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS n FROM customer),
f AS (SELECT arm, id, e, n, CASE WHEN e <= 20000 THEN e ELSE 0 END AS total, e <= 20000 AS accepted FROM c WHERE n = 1 UNION ALL SELECT c.arm, c.id, c.e, c.n, CASE WHEN f.total + c.e <= 20000 THEN f.total + c.e ELSE f.total END, f.total + c.e <= 20000 FROM f JOIN c ON c.arm = f.arm AND c.n = f.n + 1)
SELECT arm, id, accepted FROM f""")
def use_reserve(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("arm"), F.col("c_custkey").alias("id"), F.round(F.abs("c_acctbal")).alias("estimate"))
    return A.reserve(rows, "arm", "id", "estimate", 20_000.0).select("arm", "id", "accepted")


@query("""SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'added' WHEN b.doc_id IS NULL THEN 'removed' WHEN a.h <> b.h THEN 'changed' ELSE 'same' END AS state
FROM (SELECT doc_id, md5(text) AS h FROM documents) a FULL OUTER JOIN (SELECT CASE WHEN doc_id < 50 THEN -doc_id - 1 ELSE doc_id END AS doc_id, md5(CASE WHEN doc_id % 3 = 0 THEN upper(text) ELSE text END) AS h FROM documents) b ON a.doc_id = b.doc_id""")
def sup_inventory_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' inventory against one in which some are renamed and some are changed."""
    from docsift.operators import inventory

    d = C.table(spark, sf_dir, "documents")
    after = d.select(F.when(F.col("doc_id") < 50, -F.col("doc_id") - 1).otherwise(F.col("doc_id")).alias("doc_id"), F.md5(F.when(F.col("doc_id") % 3 == 0, F.upper("text")).otherwise(F.col("text"))).alias("h"))
    return inventory.changes(d.select("doc_id", F.md5("text").alias("h")), after, ["doc_id"], "h")

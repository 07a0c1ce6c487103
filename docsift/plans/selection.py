"""Queries that score runs: conversations as tasks with expected evidence, turns as saved references, documents as verdict tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docsift import storage
from docsift.operators import audit, chunking, evidence, layout, retrieval
from docsift.operators import selection as S
from docsift.operators.agent import DIMENSIONS

from . import common as C
from .contract import STATE_SQL, state

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


AVAILABLE = "CASE (task_id + place) % 7 WHEN 0 THEN NULL WHEN 1 THEN false ELSE true END"
LABEL = "CASE n % 3 WHEN 0 THEN 'RELEVANT' WHEN 1 THEN 'PARTIAL' ELSE 'IRRELEVANT' END"
RUNS_SQL = f"""{STATE_SQL},
res AS (SELECT DISTINCT task_id, scope, evidence_id, doc_id AS n FROM results),
runs AS (SELECT arm, task_id, (task_id + len(arm)) % 6 <> 0 AS accepted FROM states, (SELECT unnest(['a', 'bb']) AS arm)),
ids AS (SELECT task_id, scope, list(evidence_id) FILTER (WHERE n % 2 = 0) AS evens FROM res GROUP BY ALL),
oracle AS (SELECT s.task_id, s.scope, {AVAILABLE} AS expected_available, CASE WHEN s.task_id % 4 = 3 AND place = 1 AND s.task_id % 3 = 0 THEN [] WHEN s.task_id % 4 <> 0 AND {AVAILABLE} THEN list_concat(coalesce(evens, []), ['ev-none']) END AS expected_ids
  FROM scopes s LEFT JOIN ids USING (task_id, scope) WHERE s.task_id % 10 <> 9),
reviews AS (SELECT task_id, evidence_id, CASE WHEN n % 9 = 0 THEN 'other' ELSE scope END AS scope, {LABEL} AS label FROM res),
observed AS (SELECT task_id, evidence_id FROM res WHERE n % 5 <> 4),
first2 AS (SELECT task_id, scope, list(evidence_id ORDER BY n)[1:2] AS ids FROM res GROUP BY ALL),
held AS (SELECT task_id, source AS scope, list(evidence_id ORDER BY place)[1:3] AS ids FROM lookups GROUP BY ALL),
outcomes AS (SELECT 'a' AS arm, task_id, scope, CASE WHEN ids IS NULL THEN 'no_evidence_found' ELSE 'evidence_found' END AS status, ids AS evidence_ids FROM scopes LEFT JOIN first2 USING (task_id, scope)
 UNION ALL SELECT 'bb', s.task_id, s.scope, CASE WHEN h.ids IS NOT NULL THEN 'evidence_found' WHEN f.ids IS NOT NULL THEN 'insufficient_scope' ELSE 'no_evidence_found' END, h.ids FROM scopes s LEFT JOIN held h USING (task_id, scope) LEFT JOIN first2 f USING (task_id, scope))"""
SCORES_SQL = f"""{RUNS_SQL},
wanted AS (SELECT * FROM oracle WHERE expected_available),
hits AS (SELECT DISTINCT w.task_id, w.scope, r.evidence_id FROM wanted w JOIN reviews r ON r.task_id = w.task_id AND r.scope = w.scope AND label = 'RELEVANT' WHERE expected_ids IS NULL OR (list_contains(expected_ids, r.evidence_id) AND (w.task_id, r.evidence_id) IN (SELECT (task_id, evidence_id) FROM observed))),
grp AS (SELECT task_id, bool_or(expected_ids IS NOT NULL) AS explicit, bool_or(expected_available IS NULL) AS unknown, bool_or(coalesce(expected_available, false) AND coalesce(len(expected_ids), 0) = 0) AS unlisted, bool_or(coalesce(expected_available, false) AND (task_id, scope) NOT IN (SELECT (task_id, scope) FROM hits)) AS unmet FROM oracle GROUP BY task_id),
groups AS (SELECT task_id, coalesce(explicit, false) AS explicit, CASE WHEN unknown IS NULL THEN 'PREFLIGHT_CONTROL' WHEN unknown OR (explicit AND unlisted) THEN 'UNASSESSED' WHEN unmet THEN 'RETRIEVAL_BOUND' ELSE 'CANDIDATE_AVAILABLE' END AS candidate_group FROM states LEFT JOIN grp USING (task_id)),
cited AS (SELECT arm, task_id, scope, unnest(evidence_ids) AS evidence_id FROM outcomes WHERE status = 'evidence_found'),
refs AS (SELECT c.*, coalesce(label, 'UNCERTAIN') AS label, CASE WHEN expected_ids IS NOT NULL THEN list_contains(expected_ids, c.evidence_id) END AS expected_match, explicit,
  (c.task_id, c.scope, c.evidence_id) IN (SELECT (task_id, scope, evidence_id) FROM hits) AS hit FROM cited c LEFT JOIN reviews r ON r.task_id = c.task_id AND r.evidence_id = c.evidence_id LEFT JOIN oracle o ON o.task_id = c.task_id AND o.scope = c.scope JOIN groups g ON g.task_id = c.task_id),
ref2 AS (SELECT *, label = 'RELEVANT' AND coalesce(expected_match, NOT explicit) AS correct FROM refs),
per AS (SELECT arm, task_id, scope, bool_or(hit) AS hit, bool_or(correct) AS right_, bool_or(label = 'RELEVANT') AS rel FROM ref2 GROUP BY ALL),
tot AS (SELECT arm, task_id, count(*) AS selected, count(*) FILTER (WHERE label = 'RELEVANT') AS relevant, count(*) FILTER (WHERE correct) AS correct, bool_and(correct) AS all_right FROM ref2 GROUP BY ALL),
sc AS (SELECT r.arm, o.task_id, o.scope, expected_available AS e, x.status, coalesce(len(evidence_ids), 0) AS n_ids, coalesce(hit, false) AS hit, coalesce(right_, false) AS right_, coalesce(rel, false) AS rel, (o.task_id, o.scope) IN (SELECT (task_id, scope) FROM res) AS some_
  FROM oracle o JOIN runs r USING (task_id) LEFT JOIN outcomes x ON x.arm = r.arm AND x.task_id = o.task_id AND x.scope = o.scope LEFT JOIN per p ON p.arm = r.arm AND p.task_id = o.task_id AND p.scope = o.scope),
tk AS (SELECT arm, task_id, count(*) FILTER (WHERE e) AS wanted, count(*) FILTER (WHERE e AND hit) AS met, count(*) FILTER (WHERE e AND status = 'evidence_found' AND rel) AS supported, count(*) FILTER (WHERE NOT e) AS empty_assessed,
  count(*) FILTER (WHERE NOT e AND n_ids = 0 AND status = CASE WHEN some_ THEN 'insufficient_scope' ELSE 'no_evidence_found' END) AS empty_passed, list_sort(list(scope) FILTER (WHERE e AND NOT right_)) AS omitted FROM sc GROUP BY ALL),
z AS (SELECT r.arm, r.task_id, accepted, candidate_group, explicit, coalesce(wanted, 0) AS wanted, coalesce(met, 0) AS met, coalesce(supported, 0) AS supported, coalesce(empty_assessed, 0) AS empty_assessed, coalesce(empty_passed, 0) AS empty_passed, coalesce(selected, 0) AS selected, coalesce(relevant, 0) AS relevant,
  coalesce(correct, 0) AS correct, coalesce(all_right, true) AS all_right, coalesce(array_to_string(omitted, ','), '') AS omitted FROM runs r JOIN groups USING (task_id) LEFT JOIN tk ON tk.arm = r.arm AND tk.task_id = r.task_id LEFT JOIN tot ON tot.arm = r.arm AND tot.task_id = r.task_id),
scores AS (SELECT arm, task_id, accepted, candidate_group, explicit, CASE WHEN candidate_group = 'CANDIDATE_AVAILABLE' THEN wanted > 0 AND met = wanted END AS id_success,
  CASE WHEN candidate_group = 'CANDIDATE_AVAILABLE' THEN accepted AND wanted > 0 AND met = wanted AND all_right AND supported = wanted AND empty_passed = empty_assessed END AS full_success, selected, relevant, correct, empty_passed, empty_assessed, omitted FROM z)"""


def _selected(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    states, scopes, _, results, lookups = state(spark, sf_dir)
    res = results.select("task_id", "scope", "evidence_id").distinct().withColumn("n", F.expr("cast(substring(evidence_id, 3) AS bigint)"))
    runs = states.selectExpr("explode(array('a', 'bb')) AS arm", "task_id").withColumn("accepted", F.expr("(task_id + length(arm)) % 6 <> 0"))
    evens = res.groupBy("task_id", "scope").agg(F.collect_list(F.when(F.col("n") % 2 == 0, F.col("evidence_id"))).alias("evens"))
    ids = f"CASE WHEN task_id % 4 = 3 AND place = 1 AND task_id % 3 = 0 THEN cast(array() AS array<string>) WHEN task_id % 4 <> 0 AND {AVAILABLE} THEN concat(coalesce(evens, cast(array() AS array<string>)), array('ev-none')) END AS expected_ids"
    oracle = scopes.filter("task_id % 10 <> 9").join(evens, ["task_id", "scope"], "left").selectExpr("task_id", "scope", f"{AVAILABLE} AS expected_available", ids)
    reviews = res.selectExpr("task_id", "evidence_id", "CASE WHEN n % 9 = 0 THEN 'other' ELSE scope END AS scope", f"{LABEL} AS label")
    listed = lambda rows, order, most: rows.groupBy("task_id", "scope").agg(F.slice(F.sort_array(F.collect_list(F.struct(order, "evidence_id"))), 1, most).alias("x")).select("task_id", "scope", F.transform("x", lambda r: r["evidence_id"]).alias("ids"))
    first = listed(res, "n", 2)
    held = listed(lookups.select("task_id", F.col("source").alias("scope"), "place", "evidence_id"), "place", 3)
    a = scopes.join(first, ["task_id", "scope"], "left").selectExpr("'a' AS arm", "task_id", "scope", "CASE WHEN ids IS NULL THEN 'no_evidence_found' ELSE 'evidence_found' END AS status", "ids AS evidence_ids")
    b = scopes.join(held.withColumnRenamed("ids", "own"), ["task_id", "scope"], "left").join(first, ["task_id", "scope"], "left")
    b = b.selectExpr("'bb' AS arm", "task_id", "scope", "CASE WHEN own IS NOT NULL THEN 'evidence_found' WHEN ids IS NOT NULL THEN 'insufficient_scope' ELSE 'no_evidence_found' END AS status", "own AS evidence_ids")
    return {"runs": runs, "outcomes": a.unionByName(b), "oracle": oracle, "reviews": reviews, "observed": res.filter("n % 5 <> 4").select("task_id", "evidence_id"), "candidates": res.select("task_id", "scope")}


@query(f"WITH {SCORES_SQL} SELECT * FROM scores")
def evl_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selected evidence of two arms against the expectations, one row a task and arm."""
    return S.task_scores(**_selected(spark, sf_dir)).withColumn("omitted", F.array_join("omitted", ","))


@query(f"""WITH {SCORES_SQL}, r AS (SELECT arm, candidate_group, count(*) AS tasks, count(id_success) AS assessed, count(*) FILTER (WHERE id_success) AS id_passed, count(*) FILTER (WHERE full_success) AS full_passed, sum(selected)::BIGINT AS selected, sum(correct)::BIGINT AS correct, sum(empty_passed)::BIGINT AS empty_passed,
 sum(empty_assessed)::BIGINT AS empty_assessed, sum(CASE WHEN omitted = '' THEN 0 ELSE len(string_split(omitted, ',')) END)::BIGINT AS omitted FROM scores GROUP BY ALL)
SELECT *, round(id_passed / nullif(assessed, 0), 6) AS id_rate, round(full_passed / nullif(assessed, 0), 6) AS full_rate, round(correct / nullif(selected, 0), 6) AS "precision", round(empty_passed / nullif(empty_assessed, 0), 6) AS empty_rate FROM r""")
def evl_selection_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.selection_rates(S.task_scores(**_selected(spark, sf_dir)), ["arm", "candidate_group"])
    return out.withColumns({c: F.round(c, 6) for c in ("id_rate", "full_rate", "precision", "empty_rate")})


@query(f"WITH {SCORES_SQL} SELECT arm, task_id, scope, evidence_id, label, expected_match, correct FROM ref2")
def evl_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _selected(spark, sf_dir)
    groups = S.task_groups(t["runs"].select("task_id").distinct(), t["oracle"], S.expected_hits(t["oracle"], t["reviews"], t["observed"]))
    return S.references(t["outcomes"], t["oracle"], t["reviews"], groups)


BOUND = "CASE n % 10 WHEN 0 THEN 'other' ELSE scope END"


@query(f"""WITH {RUNS_SQL}, b AS (SELECT task_id, CASE WHEN n % 11 = 0 THEN evidence_id || 'x' ELSE evidence_id END AS evidence_id, {BOUND} AS scope FROM res WHERE n % 13 <> 0)
SELECT coalesce(r.task_id, b.task_id) AS task_id, coalesce(r.evidence_id, b.evidence_id) AS evidence_id, CASE WHEN b.task_id IS NULL THEN 'missing' WHEN r.task_id IS NULL THEN 'unexpected' ELSE 'different' END AS state FROM res r FULL OUTER JOIN b ON r.task_id = b.task_id AND r.evidence_id = b.evidence_id
WHERE b.task_id IS NULL OR r.task_id IS NULL OR r.scope <> b.scope""")
def sup_unbound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews that do not cover the frozen candidates, or cover others, or name another scope."""
    res = state(spark, sf_dir)[3].select("task_id", "scope", "evidence_id").distinct().withColumn("n", F.expr("cast(substring(evidence_id, 3) AS bigint)"))
    bound = res.filter("n % 13 <> 0").selectExpr("task_id", "CASE WHEN n % 11 = 0 THEN evidence_id || 'x' ELSE evidence_id END AS evidence_id", f"{BOUND} AS scope")
    return S.unbound(res, bound, ["task_id", "evidence_id"], "scope")


#: Kept lists: some swap neighbours, some lose their end, some alter a text or an id, some repeat an id.
KEPT = {
    "place": "CASE WHEN task_id % 6 = 1 THEN place + 1 - 2 * (place % 2) ELSE place END", "evidence_id": "CASE WHEN task_id % 6 = 4 AND place = 1 THEN 'bad ' || evidence_id ELSE evidence_id END", "source": "CASE WHEN task_id % 9 = 5 THEN 'other' ELSE scope END",
    "page": "turn + CASE WHEN task_id % 7 = 0 THEN 0 ELSE 1 END", "block_index": "turn", "chunk_id": "CASE WHEN task_id % 8 = 7 THEN NULL ELSE 0 END", "excerpt": "CASE WHEN task_id % 6 = 3 AND place = 0 THEN replace(text, 'e', 'E') ELSE text END",
    "span_length": "length(text)", "excerpt_sha256": "{}",
}
KEEP = "task_id % 6 <> 2 OR place + 1 < n"
REFERENCES_SQL = f"""turns AS (SELECT conv_id AS task_id, role AS scope, turn, text, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) - 1 AS place, count(*) OVER (PARTITION BY conv_id, role) AS n, 'ev_' || sha256(text) AS evidence_id FROM conversations),
kept AS (SELECT task_id, scope, {', '.join(f'{v} AS {k}' for k, v in KEPT.items()).format('sha256(text)')} FROM turns WHERE {KEEP}),
pl AS (SELECT task_id, scope, place, w.evidence_id AS wanted, k.* EXCLUDE (task_id, scope, place) FROM (SELECT task_id, scope, place, evidence_id FROM turns) w FULL OUTER JOIN kept k USING (task_id, scope, place)),
nth AS (SELECT *, row_number() OVER (PARTITION BY task_id, scope, evidence_id ORDER BY place) AS seen FROM pl),
bad AS (SELECT task_id, scope, list_filter([CASE WHEN evidence_id IS NULL THEN 'missing_reference' END, CASE WHEN wanted IS NULL THEN 'unexpected_reference' END, CASE WHEN wanted <> evidence_id THEN 'other_id' END, CASE WHEN evidence_id IS NOT NULL AND seen > 1 THEN 'repeated_id' END, CASE WHEN NOT regexp_full_match(evidence_id, 'ev_[0-9a-f]{{64}}') THEN 'invalid_id' END,
  CASE WHEN source <> scope THEN 'other_source' END, CASE WHEN evidence_id IS NOT NULL AND NOT coalesce(page >= 1 AND chunk_id >= 0, false) THEN 'invalid_provenance' END, CASE WHEN length(trim(excerpt)) = 0 OR length(excerpt) > 1200 THEN 'invalid_span' END, CASE WHEN sha256(excerpt) <> excerpt_sha256 THEN 'other_hash' END], lambda x: x IS NOT NULL) AS r FROM nth),
lists AS (SELECT task_id, scope, coalesce(a, []) AS a, coalesce(b, []) AS b FROM (SELECT task_id, scope, list(evidence_id ORDER BY place) AS a FROM turns GROUP BY ALL) FULL OUTER JOIN (SELECT task_id, scope, list(evidence_id ORDER BY place) AS b FROM kept GROUP BY ALL) USING (task_id, scope)),
div AS (SELECT task_id, scope, len(a) AS n_expected, len(b) AS n_saved, (SELECT min(i) FROM range(greatest(len(a), len(b))) t(i) WHERE a[i + 1] IS DISTINCT FROM b[i + 1]) AS first_divergence FROM lists)"""


@query(f"""WITH {REFERENCES_SQL} SELECT task_id, scope, n_expected, n_saved, first_divergence, first_divergence IS NULL AS chains_equal, rules FROM div JOIN (SELECT task_id, scope, array_to_string(list_sort(list_distinct(flatten(list(r)))), ',') AS rules FROM bad GROUP BY ALL) USING (task_id, scope)""")
def joi_saved_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of a conversation's roles as accepted lists, and lists that were kept of them."""
    turns, kept = _kept(spark, sf_dir)
    out = S.saved_references(turns.select("task_id", "scope", "place", "evidence_id"), kept)
    return out.withColumn("rules", F.array_join("rules", ","))


def _kept(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    turns = C.table(spark, sf_dir, "conversations").selectExpr("conv_id AS task_id", "role AS scope", "turn", "text", "'ev_' || sha2(cast(text AS binary), 256) AS evidence_id")
    by = Window.partitionBy("task_id", "scope")
    turns = turns.withColumn("place", F.row_number().over(by.orderBy("turn")) - 1).withColumn("n", F.count("*").over(by))
    return turns, turns.filter(KEEP).selectExpr("task_id", "scope", *[f"{v.format('sha2(cast(text AS binary), 256)')} AS {k}" for k, v in KEPT.items()])


#: What is quoted of a document, from its fifth character on: as it stands, with wider blanks, in capitals, or cut within a word.
QUOTE = "CASE doc_id % 4 WHEN 0 THEN substr(text, 5, 40) WHEN 1 THEN replace(substr(text, 5, 40), ' ', '  ') WHEN 2 THEN upper(substr(text, 5, 40)) ELSE substr(text, 6, 37) END"
QUOTE_NORMAL_SQL = r"regexp_replace(replace(replace(replace({0}, '×', 'x'), '<=', '≤'), '>=', '≥'), '[\s{{}}$]', '', 'g')"
HELD_SQL = r"({1} <> '' AND regexp_matches({0}, CASE WHEN regexp_matches({1}, '^[0-9]') THEN '(^|[^0-9.x×])' ELSE '' END || regexp_escape({1}) || CASE WHEN regexp_matches({1}, '[0-9]$') THEN '([^0-9.]|$)' WHEN regexp_matches({1}, '[A-Za-z.]$') THEN '([^A-Za-z0-9.]|$)' ELSE '' END))"


@query(f"""WITH q AS (SELECT doc_id, text, {QUOTE} AS quote FROM documents), n AS (SELECT *, {QUOTE_NORMAL_SQL.format('quote')} AS nq, {QUOTE_NORMAL_SQL.format('text')} AS nt FROM q)
SELECT doc_id, CASE WHEN {HELD_SQL.format('text', 'quote')} THEN 'EXACT' WHEN {HELD_SQL.format('nt', 'nq')} THEN 'NORMALIZED_EQUIVALENT' ELSE 'NOT_FAITHFUL' END AS fidelity FROM n""")
def str_quote_fidelity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quote of every document against its whole text."""
    return S.quote_fidelity(C.table(spark, sf_dir, "documents").selectExpr("doc_id", "text", f"{QUOTE} AS quote")).select("doc_id", "fidelity")


LABEL4 = "['aligned', 'different', 'not_applicable', 'uncertain']"
VERDICT = "['EQUIVALENT', 'DIFFERENT', 'NOT_COMPARABLE']"


def _item(values: str, index: str, sql: bool) -> str:
    return f"({values})[({index}) + 1]" if sql else f"array({values[1:-1]})[cast({index} AS int)]"


def _verdict_columns(sql: bool) -> tuple[list[str], list[str]]:
    """Columns of the tasks and of the runs of an arm k, from a document's id."""
    div = "//" if sql else "div"
    expected = [f"{_item(VERDICT, 'doc_id % 3', sql)} AS expected_verdict", *[f"{_item(LABEL4, f'(doc_id {div} {4 ** i}) % 4', sql)} AS expected_{d}" for i, d in enumerate(DIMENSIONS)]]
    status = "CASE (doc_id + k) % 11 WHEN 0 THEN 'api_error' WHEN 1 THEN 'invalid_output' WHEN 2 THEN 'semantic_uncertain' ELSE 'ok' END"
    runs = [
        f"{status} AS status", f"{status} IN ('ok', 'semantic_uncertain') AND (doc_id + k) % 17 <> 3 AS accepted", "CASE WHEN (doc_id + k) % 17 = 3 THEN 'CONSISTENCY_ERROR' ELSE CASE doc_id % 4 WHEN 0 THEN 'INVALID_JSON' WHEN 1 THEN 'EMPTY_RESPONSE' WHEN 2 THEN 'strange' END END AS failure_type",
        f"{_item(VERDICT, '(doc_id + CASE WHEN (doc_id + k) % 4 = 0 THEN 1 ELSE 0 END) % 3', sql)} AS verdict", "CASE WHEN doc_id % 19 = 0 THEN 'uncertain' ELSE 'comparable_fact' END AS basis",
        *[f"{_item(LABEL4, f'(doc_id {div} {4 ** i} + CASE WHEN (doc_id + k) % {5 + i} = 0 THEN 2 ELSE 0 END) % 4', sql)} AS {d}" for i, d in enumerate(DIMENSIONS)],
    ]
    return expected, runs


JUDGED_SQL = f"""tasks AS (SELECT doc_id AS task_id, doc_id % 5 <> 0 AS include, {', '.join(_verdict_columns(True)[0])} FROM documents), arms AS (SELECT * FROM (VALUES ('json_object', 0), ('json_schema', 3)) AS t(arm, k)),
vr AS (SELECT arm, doc_id AS task_id, {', '.join(_verdict_columns(True)[1])} FROM documents, arms WHERE (doc_id + k) % 13 <> 0),
j0 AS (SELECT a.arm, t.*, coalesce(status, 'not_run_after_stop') AS status, coalesce(accepted, false) AS accepted, failure_type, verdict, basis, {', '.join(f'"{d}"' for d in DIMENSIONS)} FROM tasks t CROSS JOIN arms a LEFT JOIN vr ON vr.arm = a.arm AND vr.task_id = t.task_id WHERE include),
j AS (SELECT *, CASE WHEN accepted THEN CASE WHEN status = 'semantic_uncertain' OR basis = 'uncertain' THEN 'UNCERTAIN' ELSE verdict END END AS predicted, CASE WHEN NOT accepted AND status NOT IN ('api_error', 'not_run_after_stop') THEN CASE WHEN failure_type IN ({', '.join(f"'{x}'" for x in S.FAILURES)}) THEN failure_type ELSE 'OTHER' END END AS failure FROM j0)"""


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected, made = _verdict_columns(False)
    docs = C.table(spark, sf_dir, "documents").select("doc_id")
    tasks = docs.selectExpr("doc_id AS task_id", "doc_id % 5 <> 0 AS include", *expected)
    arms = docs.withColumn("a", F.explode(F.array(F.struct(F.lit("json_object").alias("arm"), F.lit(0).alias("k")), F.struct(F.lit("json_schema").alias("arm"), F.lit(3).alias("k"))))).select("doc_id", "a.*")
    return S.judged(tasks, arms.filter("(doc_id + k) % 13 <> 0").selectExpr("arm", "doc_id AS task_id", *made))


DIMENSION_SQL = ", ".join(f'count(*) FILTER (WHERE accepted AND "{d}" = "expected_{d}") / nullif(count(*) FILTER (WHERE accepted), 0) AS "{d}_accuracy"' for d in DIMENSIONS)
ARM_SQL = f"""count(*) AS attempted, count(*) FILTER (WHERE accepted) AS accepted, count(*) FILTER (WHERE predicted = expected_verdict) AS passed, count(*) FILTER (WHERE failure = 'CONSISTENCY_ERROR') AS inconsistent,
 count(*) FILTER (WHERE accepted AND expected_object_or_field = 'different' AND expected_value <> 'not_applicable' AND "value" = 'not_applicable') + count(*) FILTER (WHERE accepted AND expected_object_or_field = 'different' AND expected_unit <> 'not_applicable' AND unit = 'not_applicable') AS na_violations,
 count(*) FILTER (WHERE accepted AND expected_object_or_field = 'different' AND expected_value <> 'not_applicable') + count(*) FILTER (WHERE accepted AND expected_object_or_field = 'different' AND expected_unit <> 'not_applicable') AS na_assessed, count(*) FILTER (WHERE status = 'api_error') AS api_errors,
 count(*) FILTER (WHERE status = 'not_run_after_stop') AS not_run, count(*) FILTER (WHERE accepted) / count(*) AS acceptance, count(*) FILTER (WHERE predicted = expected_verdict) / count(*) AS strict_accuracy, count(*) FILTER (WHERE predicted = expected_verdict) / nullif(count(*) FILTER (WHERE accepted), 0) AS accepted_accuracy,
 count(*) FILTER (WHERE accepted) / nullif(count(*) FILTER (WHERE accepted) + count(*) FILTER (WHERE failure = 'CONSISTENCY_ERROR'), 0) AS consistency, {DIMENSION_SQL}"""


@query(f"WITH {JUDGED_SQL} SELECT arm, expected_verdict, {ARM_SQL} FROM j GROUP BY GROUPING SETS ((arm), (arm, expected_verdict))")
def evl_arm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two arms' verdicts on all documents as tasks, by arm and by arm and class (null: all classes)."""
    rows = _judged(spark, sf_dir)
    return S.arm_scores(rows, ["arm", "expected_verdict"]).unionByName(S.arm_scores(rows, ["arm"]).withColumn("expected_verdict", F.lit(None).cast("string")))


@query(f"WITH {JUDGED_SQL} SELECT arm, failure, count(j.failure) AS n FROM arms CROSS JOIN (SELECT unnest([{', '.join(repr(x) for x in S.FAILURES)}]) AS failure) LEFT JOIN j USING (arm, failure) GROUP BY ALL")
def evl_arm_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.failures(_judged(spark, sf_dir))


@query(f"WITH {JUDGED_SQL} SELECT arm, expected_verdict, predicted, count(*) AS n FROM j WHERE accepted GROUP BY ALL")
def evl_arm_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir).filter("accepted").groupBy("arm", "expected_verdict", "predicted").agg(F.count("*").alias("n"))


# -- stored pools --------------------------------------------------------------------------------

#: A stored pool: ranks swapped, an ordinal moved, a rank left out or beyond the corpus, a score changed.
STORED = {
    "rank": "CASE WHEN qid % 3 = 0 AND rank IN (2, 3) THEN 5 - rank ELSE rank END", "corpus_index": "CASE WHEN qid % 5 = 1 AND rank = 4 THEN ordinal + 1 WHEN qid % 11 = 4 AND rank = 1 THEN ordinal + 1000000000 ELSE ordinal END",
    "score": "CASE WHEN qid % 4 = 3 AND rank = 1 THEN score + 0.5 ELSE score END",
}
POOL_SQL = f"""{C.bm25_sql(10)}, corpus AS (SELECT position, source, row_number() OVER (ORDER BY position) - 1 AS ordinal FROM chunks),
stored AS (SELECT qid, {', '.join(f'{v} AS {k}' for k, v in STORED.items())} FROM bm25 JOIN corpus USING (position) WHERE NOT (qid % 7 = 2 AND rank = 5))"""


def _pools(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """stored, corpus, pool."""
    chunks = C.chunks(spark, sf_dir)
    pool = retrieval.bm25(retrieval.build(chunks), C.questions(spark, sf_dir), 10)
    corpus = storage.stored(chunks.select("position", "source"), "positions")  # numbered in several passes
    corpus = storage.stored(chunking.ordinals(corpus, ["position"]), "ordinals")  # the stored pool and its audit read it
    stored = pool.join(corpus, "position").filter("NOT (qid % 7 = 2 AND rank = 5)").selectExpr("qid", *[f"{v} AS {k}" for k, v in STORED.items()])
    return stored, corpus, pool


@query(f"""WITH {POOL_SQL}, h AS (SELECT qid, rank, s.score, position FROM stored s LEFT JOIN corpus ON corpus_index = ordinal)
SELECT coalesce(h.qid, b.qid) AS qid, coalesce(h.rank, b.rank) AS rank, CASE WHEN h.qid IS NULL THEN 'missing' WHEN h.position IS NULL THEN 'unknown_ordinal' WHEN h.position <> b.position THEN 'other_chunk' ELSE 'other_score' END AS state, h.position AS stored_position, b.position
FROM h FULL OUTER JOIN bm25 b ON h.qid = b.qid AND h.rank = b.rank WHERE h.qid IS NULL OR h.position IS NULL OR h.position <> b.position OR abs(h.score - b.score) > 1e-6""")
def sup_ranking_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks of a stored pool that do not reproduce."""
    return audit.altered(*_pools(spark, sf_dir))


@query(f"""WITH {POOL_SQL} SELECT item_id AS qid, count(*) FILTER (WHERE c.source = 'src' || (item_id % 20)) AS in_scope FROM benchmark LEFT JOIN stored s ON s.qid = item_id AND s.rank <= 3 LEFT JOIN corpus c ON corpus_index = ordinal GROUP BY ALL""")
def sup_ranking_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In-scope entries among the first three of each question's stored pool."""
    stored, corpus, _ = _pools(spark, sf_dir)
    return audit.scope_counts(stored, corpus, C.questions(spark, sf_dir).select("qid", F.expr("'src' || (qid % 20)").alias("source")))


# -- a semantic run ------------------------------------------------------------------------------


def _semantic_columns(sql: bool) -> tuple[list[str], list[str]]:
    """Columns of the truth and of the results, from a document's id."""
    div = "//" if sql else "div"
    pick = lambda values, by: _item(values, by, sql)
    truth = [
        f"{pick(chr(91) + repr('semantic') + ', ' + repr('semantic') + ', ' + repr('unsupported_side') + ', ' + repr('retrieval_bound') + ', ' + repr('gt_uncertain') + chr(93), 'doc_id % 5')} AS route",
        "CASE doc_id % 7 WHEN 0 THEN 'uncertain' WHEN 1 THEN 'provisional' ELSE 'confirmed' END AS confidence", f"CASE WHEN doc_id % 11 <> 0 THEN {pick(VERDICT, 'doc_id % 3')} END AS expected_verdict",
        *[f"CASE WHEN doc_id % {13 + i} <> 0 THEN {pick(LABEL4, f'(doc_id {div} {4 ** i}) % 4')} END AS expected_{d}" for i, d in enumerate(DIMENSIONS)],
    ]
    low = "doc_id % 5 < 2"  # the semantic route
    odd = "doc_id % 17 = 3"
    status = f"CASE WHEN {odd} THEN 'invalid_output' WHEN {low} THEN CASE WHEN (doc_id {div} 16 + CASE WHEN doc_id % 4 = 0 THEN 2 ELSE 0 END) % 4 = 1 THEN 'unit_conversion_required' ELSE 'compared' END ELSE 'preflight_insufficient_evidence' END"
    said = f"CASE WHEN {low} AND doc_id % 19 <> 5 THEN {pick(VERDICT, '(doc_id + CASE WHEN doc_id % 6 = 0 THEN 1 ELSE 0 END) % 3')} END"
    results = [
        f"{status} AS status", f"{low} AND doc_id % 23 <> 6 OR doc_id % 29 = 2 AS eligible", f"CASE WHEN {low} THEN 'bilateral_supported' ELSE 'unresolved_scope' END AS reason", f"CASE WHEN {low} THEN {said} ELSE 'INSUFFICIENT_EVIDENCE' END AS verdict",
        f"CASE WHEN {low} AND doc_id % 19 <> 5 THEN doc_id % 31 <> 1 END AS valid", f"{said} AS semantic_verdict", f"CASE WHEN {status} = 'compared' THEN {said} WHEN doc_id % 37 = 0 THEN 'DIFFERENT' END AS formal_verdict",
        *[f"CASE WHEN {low} THEN {pick(LABEL4, f'(doc_id {div} {4 ** i} + CASE WHEN doc_id % 4 = 0 THEN 2 ELSE 0 END) % 4')} END AS {d}" for i, d in enumerate(DIMENSIONS)],
    ]
    return truth, results


SEMANTIC_SQL = f"""tr AS (SELECT doc_id AS task_id, {', '.join(_semantic_columns(True)[0])} FROM documents), rs AS (SELECT doc_id AS task_id, {', '.join(_semantic_columns(True)[1])} FROM documents WHERE doc_id % 41 <> 7),
b AS (SELECT tr.*, coalesce(status, '') AS status, coalesce(eligible, false) AS eligible, verdict, valid, semantic_verdict, formal_verdict, {', '.join(f'"{d}"' for d in DIMENSIONS)}, coalesce(unit = 'different', false) AS ud FROM tr LEFT JOIN rs USING (task_id)),
v AS (SELECT *, confidence = 'uncertain' OR route = 'gt_uncertain' AS uncertain, CASE WHEN status = 'invalid_output' THEN true WHEN route = 'semantic' AND (NOT eligible OR status = 'preflight_insufficient_evidence') THEN true
 WHEN route <> 'semantic' AND (eligible OR status <> 'preflight_insufficient_evidence' OR verdict IS DISTINCT FROM 'INSUFFICIENT_EVIDENCE' OR valid IS NOT NULL OR formal_verdict IS NOT NULL) THEN true WHEN valid = false THEN true
 WHEN status = 'compared' THEN valid IS NULL OR ud OR formal_verdict IS DISTINCT FROM semantic_verdict WHEN status = 'unit_conversion_required' THEN valid IS NULL OR NOT ud OR formal_verdict IS NOT NULL ELSE valid IS NOT NULL OR formal_verdict IS NOT NULL END AS invalid FROM b),
s AS (SELECT *, NOT invalid AND NOT uncertain AND valid IS NOT NULL AS scored FROM v),
p AS (SELECT *, CASE WHEN scored AND expected_verdict IS NOT NULL AND formal_verdict IS NOT NULL THEN formal_verdict = expected_verdict END AS verdict_passed, {', '.join(f'CASE WHEN scored AND "expected_{d}" IS NOT NULL THEN coalesce("{d}" = "expected_{d}", false) END AS "{d}_passed"' for d in DIMENSIONS)} FROM s)"""


def _semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth, results = _semantic_columns(False)
    docs = C.table(spark, sf_dir, "documents").select("doc_id")
    return S.semantic_rows(docs.selectExpr("doc_id AS task_id", *truth), docs.filter("doc_id % 41 <> 7").selectExpr("doc_id AS task_id", *results))


SEMANTIC_AGG = f"""count(*) AS tasks, count(*) FILTER (WHERE route = 'semantic' AND eligible) AS eligible_pairs, count(*) FILTER (WHERE NOT eligible) AS preflight, count(*) FILTER (WHERE invalid) AS invalid, count(verdict_passed) AS verdicts, count(*) FILTER (WHERE verdict_passed) AS verdicts_passed,
count(*) FILTER (WHERE route = 'unsupported_side') AS sides, count(*) FILTER (WHERE route = 'unsupported_side' AND status = 'preflight_insufficient_evidence' AND NOT eligible AND verdict = 'INSUFFICIENT_EVIDENCE') AS sides_passed,
{', '.join(f'count(*) FILTER (WHERE "{d}_passed") / nullif(count("{d}_passed"), 0) AS "{d}_accuracy"' for d in DIMENSIONS)}, count(*) FILTER (WHERE verdict_passed) / nullif(count(verdict_passed), 0) AS accuracy"""


@query(f"WITH {SEMANTIC_SQL} SELECT confidence, {SEMANTIC_AGG} FROM p GROUP BY GROUPING SETS ((), (confidence))")
def evl_semantic_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A semantic run on all documents as tasks, by confidence of the truth and in all (null)."""
    rows = _semantic(spark, sf_dir)
    return S.semantic_scores(rows, ["confidence"]).unionByName(S.semantic_scores(rows, []).withColumn("confidence", F.lit(None).cast("string")))


@query(f"""WITH {SEMANTIC_SQL}, e AS (SELECT unnest(list_filter([CASE WHEN route = 'retrieval_bound' AND NOT eligible THEN 'EVIDENCE_UPSTREAM_FAILURE' END, {', '.join(f'CASE WHEN "{d}_passed" = false THEN {e!r} END' for d, e in zip(DIMENSIONS, S.DIMENSION_ERRORS))},
CASE WHEN verdict_passed IS NOT NULL AND formal_verdict = 'NOT_COMPARABLE' AND expected_verdict <> 'NOT_COMPARABLE' THEN 'NOT_COMPARABLE_FALSE_POSITIVE' END, CASE WHEN verdict_passed IS NOT NULL AND formal_verdict <> 'NOT_COMPARABLE' AND expected_verdict = 'NOT_COMPARABLE' THEN 'NOT_COMPARABLE_FALSE_NEGATIVE' END,
CASE WHEN invalid THEN 'INVALID_OUTPUT' END, CASE WHEN uncertain THEN 'GT_UNCERTAIN' END], lambda x: x IS NOT NULL)) AS error FROM p)
SELECT k.error, count(e.error) AS n FROM (SELECT unnest([{', '.join(repr(x) for x in S.ERRORS)}]) AS error) k LEFT JOIN e USING (error) GROUP BY ALL""")
def evl_semantic_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.semantic_errors(_semantic(spark, sf_dir))


# -- routes and citations ------------------------------------------------------------------------

ROUTE = "CASE task_id % 4 WHEN 0 THEN 'semantic' WHEN 1 THEN 'retrieval_bound' WHEN 2 THEN 'unsupported_side' ELSE 'unresolved_scope' END"
ROUTES_SQL = f"""{REFERENCES_SQL}, tasks AS (SELECT conv_id AS task_id, CASE conv_id % 9 WHEN 4 THEN ['user'] WHEN 5 THEN [] ELSE ['assistant', 'user'] END AS scopes, CASE WHEN conv_id % 8 = 3 THEN 'clarify' ELSE 'finished' END AS status FROM conversations GROUP BY conv_id),
pre AS (SELECT t.*, len(scopes) = 2 AND (SELECT count(DISTINCT k.scope) FROM kept k WHERE k.task_id = t.task_id AND k.scope IN ('assistant', 'user')) = 2 AS eligible FROM tasks t)"""


def _routes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """tasks, kept references, turns."""
    turns, kept = _kept(spark, sf_dir)
    tasks = C.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("task_id")).distinct()
    none = F.array().cast("array<string>")
    scopes = F.when(F.col("task_id") % 9 == 4, F.array(F.lit("user"))).when(F.col("task_id") % 9 == 5, none).otherwise(F.array(F.lit("assistant"), F.lit("user")))
    return tasks.withColumn("scopes", scopes).withColumn("status", F.expr("CASE WHEN task_id % 8 = 3 THEN 'clarify' ELSE 'finished' END")), kept, turns


@query(f"""WITH {ROUTES_SQL} SELECT task_id, eligible, CASE WHEN eligible THEN 'NOT_EVALUATED' ELSE 'INSUFFICIENT_EVIDENCE' END AS verdict, CASE WHEN eligible THEN 'bilateral_supported' WHEN len(scopes) = 0 OR status = 'clarify' THEN 'unresolved_scope' ELSE 'not_bilateral_supported' END AS reason FROM pre""")
def dia_pair_preflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which conversations have kept references of both sides."""
    tasks, kept, _ = _routes(spark, sf_dir)
    return S.pair_preflight(tasks, kept, ("assistant", "user"))


@query(f"""WITH {ROUTES_SQL}, r AS (SELECT *, {ROUTE} AS route FROM pre) SELECT task_id, route, rule FROM (SELECT *, CASE WHEN (route = 'semantic') <> eligible THEN 'other_cohort' WHEN route = 'retrieval_bound' AND task_id % 3 <> 0 THEN 'not_retrieval_bound' WHEN route = 'unsupported_side' AND task_id % 5 <> 0 THEN 'no_unsupported_side'
 WHEN route = 'unresolved_scope' AND status <> 'clarify' THEN 'not_unresolved' END AS rule FROM r) WHERE rule IS NOT NULL""")
def sup_route_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected routes that the kept run does not bear out."""
    tasks, kept, _ = _routes(spark, sf_dir)
    groups = tasks.select("task_id", F.expr("CASE WHEN task_id % 3 = 0 THEN 'RETRIEVAL_BOUND' ELSE 'CANDIDATE_AVAILABLE' END").alias("candidate_group"))
    oracle = tasks.select("task_id", F.lit("user").alias("scope"), F.expr("CASE WHEN task_id % 5 = 0 THEN false WHEN task_id % 5 = 1 THEN true END").alias("expected_available"))
    return S.route_breaks(tasks.select("task_id", F.expr(ROUTE).alias("route")), S.pair_preflight(tasks, kept, ("assistant", "user")), groups, oracle, tasks)


@query(f"""WITH {REFERENCES_SQL}, reg AS (SELECT DISTINCT evidence_id, min(scope) AS source, min(turn + 1) AS page, min(turn) AS block_index, 0 AS chunk_id, min(text) AS excerpt FROM turns GROUP BY evidence_id)
SELECT task_id, count(*) AS assessed, count(*) FILTER (WHERE k.source = r.source AND k.page = r.page AND k.block_index = r.block_index AND k.chunk_id = r.chunk_id AND k.excerpt = r.excerpt) AS authentic, count(*) FILTER (WHERE k.source = r.source AND k.page = r.page AND k.block_index = r.block_index AND k.chunk_id = r.chunk_id) AS provenance,
 count(*) FILTER (WHERE r.evidence_id IS NOT NULL AND length(k.excerpt) <= 1200) AS bounded FROM kept k LEFT JOIN reg r USING (evidence_id) GROUP BY task_id""")
def sup_citation_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept citations against the turns that they cite."""
    _, kept, turns = _routes(spark, sf_dir)
    registry = turns.groupBy("evidence_id").agg(F.min("scope").alias("source"), (F.min("turn") + 1).alias("page"), F.min("turn").alias("block_index"), F.lit(0).alias("chunk_id"), F.min("text").alias("excerpt"))
    return S.citation_snapshot(kept, registry)


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'FAIL' WHEN o_orderstatus = 'F' THEN 'PASS' ELSE 'UNCERTAIN' END AS status FROM orders""")
def lay_structure_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as tables: some mismatch, the finished ones have a complete truth."""
    return C.table(spark, sf_dir, "orders").select("o_orderkey", layout.structure_status(F.when(F.col("o_orderkey") % 7 == 0, True), F.when(F.col("o_orderstatus") == "F", True)).alias("status"))


EXCERPT = "CASE doc_id % 4 WHEN 0 THEN replace(substr(text, 3, 200), ' ', '  ') WHEN 1 THEN upper(substr(text, 3, 200)) WHEN 2 THEN substr(text, 3, 200) ELSE substr(text, length(text) - 60, 61) END"


@query(rf"""SELECT d.doc_id, regexp_replace(trim(regexp_replace(e, '\s+', ' ', 'g')), '^$', '') <> '' AND contains(trim(regexp_replace(p.text, '\s+', ' ', 'g')), trim(regexp_replace(e, '\s+', ' ', 'g'))) AS on_page FROM (SELECT doc_id, coalesce({EXCERPT}, '') AS e FROM documents) d JOIN documents p USING (doc_id)""")
def sup_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Excerpts of every document with other blanks, other case or from its end, against its whole text."""
    docs = C.table(spark, sf_dir, "documents")
    return evidence.on_page(docs.selectExpr("doc_id", f"{EXCERPT} AS excerpt"), docs.select("doc_id", "text"), ["doc_id"]).select("doc_id", "on_page")


CITED_AS = "CASE doc_id % 5 WHEN 1 THEN 'src99' ELSE scope END"
CITED_TEXT = "CASE WHEN doc_id % 6 = 0 THEN substr(text, 2, 60) ELSE substr(text, 1, 60) END"


@query(f"""WITH {STATE_SQL}, res AS (SELECT DISTINCT task_id, scope, evidence_id, doc_id FROM results), c AS (SELECT task_id, {CITED_AS} AS scope, evidence_id, doc_id, {CITED_TEXT} AS excerpt FROM res JOIN documents USING (doc_id)),
x AS (SELECT c.*, (SELECT list(source) FROM lookups l WHERE l.task_id = c.task_id AND l.evidence_id = c.evidence_id) AS src, (task_id, c.scope, evidence_id) IN (SELECT (task_id, scope, evidence_id) FROM res) AS seen, d.text FROM c JOIN documents d USING (doc_id))
SELECT task_id, scope, evidence_id, array_to_string(list_filter([CASE WHEN NOT seen THEN 'not_observed' END, CASE WHEN src IS NULL THEN 'not_looked_up' END, CASE WHEN NOT list_contains(src, scope) THEN 'other_scope' END, CASE WHEN doc_id % 8 = 7 THEN 'not_rendered' END,
 CASE WHEN doc_id % 8 <> 7 AND sha256(coalesce(excerpt, '')) <> sha256(coalesce(substr(text, 1, 60), '')) THEN 'other_excerpt' END], lambda r: r IS NOT NULL), ',') AS broken FROM x""")
def sup_revalidated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations of all candidates: some under another scope, some never looked up, some with another excerpt or none rendered."""
    _, _, _, results, lookups = state(spark, sf_dir)
    docs = C.table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("ev"), F.col("doc_id").cast("string")).alias("evidence_id"), "text")
    seen = results.select("task_id", "scope", "evidence_id").distinct()
    cited = seen.join(docs, "evidence_id").selectExpr("task_id", f"{CITED_AS} AS scope", "evidence_id", f"{CITED_TEXT} AS excerpt")
    out = S.revalidated(cited, seen, lookups, docs.filter("doc_id % 8 <> 7").selectExpr("evidence_id", "substr(text, 1, 60) AS excerpt"))
    return out.select("task_id", "scope", "evidence_id", F.array_join("broken", ",").alias("broken"))

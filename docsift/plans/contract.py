"""Queries that hold actions to their contracts: conversations are tasks, documents of two sources are their candidates.

A task searches one of its scopes at each of the user's turns and finds up to three documents of that source
that share its remainder; part of them are looked up, some under another source's name. Each turn proposes an
action, right or wrong in a way that its number decides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docsift.operators import contract as K

from . import common as C

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


PARTS = 13
SCOPE = "'src' || ((conv_id + {0} * (1 + conv_id % 7)) % 20)"
STATUS = "CASE (conv_id + turn) % 5 WHEN 0 THEN 'no_evidence' WHEN 1 THEN 'timeout' ELSE 'ok' END"
#: A word that a document certainly holds, if any: the quote of a finding.
WORD = "regexp_extract(text, '([a-z]{{4,}})'{0})"
STATE_SQL = f"""conv AS (SELECT conv_id, min_by(md5(text), turn) AS query, count(*) FILTER (WHERE role = 'user') AS asked FROM conversations GROUP BY conv_id),
states AS (SELECT conv_id AS task_id, query, 4 - asked AS search_left, 6 - asked AS lookup_left, CASE WHEN conv_id % 3 = 0 THEN 'which one?' END AS clarification FROM conv),
scopes AS (SELECT conv_id AS task_id, place, {SCOPE.format('place')} AS scope FROM conv, (SELECT unnest([0, 1]) AS place)),
searches AS (SELECT conv_id AS task_id, turn AS step, {SCOPE.format('(turn // 2 % 2)')} AS scope, query, {STATUS} AS status FROM conversations JOIN conv USING (conv_id) WHERE role = 'user'),
pool AS (SELECT * FROM (SELECT doc_id, source, text, row_number() OVER (PARTITION BY source, doc_id % {PARTS} ORDER BY doc_id) - 1 AS place FROM documents WHERE source IS NOT NULL) WHERE place < 3),
results AS (SELECT task_id, step, place, scope, 'ev' || doc_id AS evidence_id, doc_id FROM searches JOIN pool ON pool.source = scope AND doc_id % {PARTS} = task_id % {PARTS} WHERE status = 'ok'),
lookups AS (SELECT task_id, doc_id AS place, 'ev' || doc_id AS evidence_id, CASE WHEN doc_id % 11 = 0 THEN 'other' ELSE source END AS source, text FROM (SELECT DISTINCT task_id, doc_id FROM results) JOIN pool USING (doc_id) WHERE (doc_id + task_id) % 3 <> 0)"""
COVERAGE_SQL = f"""{STATE_SQL},
cov AS (SELECT s.task_id, place, s.scope, CASE WHEN EXISTS (SELECT 1 FROM lookups l WHERE l.task_id = s.task_id AND l.source = s.scope) THEN 'LOOKED_UP_EVIDENCE' WHEN EXISTS (SELECT 1 FROM results r WHERE r.task_id = s.task_id AND r.scope = s.scope) THEN 'CANDIDATES_OBSERVED'
  WHEN EXISTS (SELECT 1 FROM searches q WHERE q.task_id = s.task_id AND q.scope = s.scope AND q.status = 'no_evidence') THEN 'NO_EVIDENCE' ELSE 'UNSEARCHED' END AS coverage FROM scopes s)"""
ELIGIBLE_SQL = f"""{COVERAGE_SQL},
may_search AS (SELECT s.* FROM scopes s JOIN states USING (task_id) WHERE NOT EXISTS (SELECT 1 FROM searches q WHERE q.task_id = s.task_id AND q.scope = s.scope AND q.status IN ('ok', 'no_evidence'))),
obs AS (SELECT task_id, scope, evidence_id, min([step, place]) AS nr, bool_or(evidence_id IN (SELECT evidence_id FROM lookups l WHERE l.task_id = r.task_id)) AS done FROM results r GROUP BY ALL),
open_scopes AS (SELECT task_id, scope FROM obs GROUP BY ALL HAVING NOT bool_or(done)),
may_look AS (SELECT task_id, evidence_id, min(nr) AS nr FROM obs WHERE NOT done AND (task_id NOT IN (SELECT task_id FROM open_scopes) OR (task_id, scope) IN (SELECT (task_id, scope) FROM open_scopes)) GROUP BY ALL),
looked AS (SELECT DISTINCT task_id, source AS scope, place, evidence_id FROM lookups WHERE (task_id, source, evidence_id) IN (SELECT (task_id, scope, evidence_id) FROM results)),
ready AS (SELECT task_id, bool_and(coverage IN ('LOOKED_UP_EVIDENCE', 'NO_EVIDENCE')) AS ready, count(*) AS n FROM cov GROUP BY task_id)"""


def state(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """states, scopes, searches, results, lookups."""
    turns = C.table(spark, sf_dir, "conversations")
    conv = turns.groupBy("conv_id").agg(F.min_by(F.md5(F.col("text").cast("binary")), "turn").alias("query"), F.count_if(F.col("role") == "user").alias("asked"))
    states = conv.selectExpr("conv_id AS task_id", "query", "4 - asked AS search_left", "6 - asked AS lookup_left", "CASE WHEN conv_id % 3 = 0 THEN 'which one?' END AS clarification")
    scopes = conv.selectExpr("conv_id", "explode(array(0, 1)) AS place").selectExpr("conv_id AS task_id", "place", f"{SCOPE.format('place')} AS scope")
    searches = turns.filter("role = 'user'").join(conv, "conv_id").selectExpr("conv_id AS task_id", "turn AS step", f"{SCOPE.format('(turn div 2 % 2)')} AS scope", "query", f"{STATUS} AS status")
    docs = C.table(spark, sf_dir, "documents").filter("source IS NOT NULL").withColumn("place", F.row_number().over(Window.partitionBy("source", F.col("doc_id") % PARTS).orderBy("doc_id")) - 1).filter("place < 3")
    pool = docs.select("doc_id", F.col("source").alias("scope"), "text", "place", (F.col("doc_id") % PARTS).alias("part"))
    found = searches.filter("status = 'ok'").withColumn("part", F.col("task_id") % PARTS).join(pool, ["scope", "part"])
    results = found.selectExpr("task_id", "step", "place", "scope", "'ev' || doc_id AS evidence_id")
    lookups = found.filter("(doc_id + task_id) % 3 <> 0").dropDuplicates(["task_id", "doc_id"]).selectExpr("task_id", "doc_id AS place", "'ev' || doc_id AS evidence_id", "CASE WHEN doc_id % 11 = 0 THEN 'other' ELSE scope END AS source", "text")
    return states, scopes, searches, results, lookups


@query(f"WITH {COVERAGE_SQL} SELECT task_id, place, scope, coverage, coverage IN ('UNSEARCHED', 'CANDIDATES_OBSERVED') AS remaining FROM cov")
def agt_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, scopes, searches, results, lookups = state(spark, sf_dir)
    return K.coverage(scopes, searches, results, lookups)


def _json(kind: str, properties: str, required: str) -> str:
    return f"""'{{"type":"object","properties":{{"action":{{"const":"{kind}"}},' || {properties} || '}},"required":["action",{required}],"additionalProperties":false}}'"""


SCHEMA_SQL = f"""{ELIGIBLE_SQL},
a AS (SELECT s.*, ready, n, (SELECT to_json(list(scope ORDER BY place)) FROM may_search m WHERE m.task_id = s.task_id) AS open_scopes, (SELECT to_json(list(evidence_id ORDER BY nr)) FROM may_look m WHERE m.task_id = s.task_id) AS open_ids,
  (SELECT to_json(list(evidence_id ORDER BY place)) FROM lookups m WHERE m.task_id = s.task_id) AS held, (SELECT to_json(list(scope ORDER BY place)) FROM scopes m WHERE m.task_id = s.task_id) AS all_scopes FROM states s JOIN ready USING (task_id)),
per AS (SELECT c.task_id, c.place, c.scope, (SELECT to_json(list(evidence_id ORDER BY l.place)) FROM looked l WHERE l.task_id = c.task_id AND l.scope = c.scope) AS ids, EXISTS (SELECT 1 FROM results r WHERE r.task_id = c.task_id AND r.scope = c.scope) AS found FROM scopes c),
v AS (SELECT task_id, string_agg(concat_ws(',', CASE WHEN ids IS NOT NULL THEN head || '"evidence_found"}},"evidence_ids":{{"type":"array","items":{{"type":"string","minLength":1,"maxLength":100,"enum":' || ids || '}},"minItems":1,"maxItems":3}}}},"required":["scope","status","evidence_ids"],"additionalProperties":false}}' END,
   CASE WHEN NOT found THEN head || '"no_evidence_found"' || tail END, CASE WHEN found AND ids IS NOT NULL THEN head || '"insufficient_scope"' || tail END), ',' ORDER BY place) FILTER (WHERE ids IS NOT NULL OR NOT found) AS outcomes
 FROM (SELECT *, '{{"type":"object","properties":{{"scope":{{"const":"' || scope || '"}},"status":{{"const":' AS head, '}}}},"required":["scope","status"],"additionalProperties":false}}' AS tail FROM per) GROUP BY task_id),
p AS (SELECT task_id, CASE WHEN search_left > 0 AND open_scopes IS NOT NULL THEN {_json('SEARCH', '''\'"query":{"const":"\' || query || \'"},"scopes":{"type":"array","items":{"type":"string","enum":\' || open_scopes || \'},"minItems":1,"maxItems":1}\'''', '"query","scopes"')} END AS search,
 CASE WHEN lookup_left > 0 AND open_ids IS NOT NULL THEN {_json('LOOKUP', '''\'"evidence_id":{"type":"string","enum":\' || open_ids || \'}\'''', '"evidence_id"')} END AS look,
 {_json('CLARIFY', '''\'"question":{"type":"string"}\'''', '"question"')} AS clarify, ready, n, held, all_scopes, clarification, coalesce(outcomes, '') AS outcomes FROM a LEFT JOIN v USING (task_id))"""


@query(f"""WITH {SCHEMA_SQL} SELECT task_id, '{{"oneOf":[' || concat_ws(',', search, look, clarify, CASE WHEN ready THEN '{{"type":"object","properties":{{"action":{{"const":"FINISH"}},"outcomes":{{"type":"array","items":{{"oneOf":[' || outcomes || ']}},"minItems":' || n || ',"maxItems":' || n || '}}}},"required":["action","outcomes"],"additionalProperties":false}}' END) || ']}}' AS schema FROM p""")
def agt_schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The actions that each task's state allows, as a JSON schema; evidence by reference."""
    return K.schemas(*state(spark, sf_dir))


FINDING_SQL = """'{"type":"object","properties":{"action":{"const":"FINISH"},"findings":{"type":"array","items":{"type":"object","properties":{"scope":{"type":"string"' || coalesce(',"enum":' || CASE WHEN held IS NOT NULL THEN all_scopes END, '') || '},"evidence_id":{"type":"string"' || coalesce(',"enum":' || held, '')
 || '},"quote":{"type":"string"}},"required":["scope","evidence_id","quote"],"additionalProperties":false},"maxItems":' || CASE WHEN held IS NULL THEN 0 ELSE 6 END || '}},"required":["action","findings"],"additionalProperties":false}'"""


@query(f"WITH {SCHEMA_SQL} SELECT task_id, '{{\"oneOf\":[' || concat_ws(',', search, look, CASE WHEN clarification IS NOT NULL THEN clarify END, CASE WHEN ready THEN {FINDING_SQL} END) || ']}}' AS schema FROM p")
def agt_schemas_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with copied quotes."""
    return K.schemas(*state(spark, sf_dir), contract="copied_quote")


#: What each turn proposes: kind, scopes and an id, all taken from the turn's own numbers.
TURNS = ["conv_id * 100 + turn AS action_id", "conv_id AS task_id", "turn", "(conv_id * 3 + turn) % 8 AS kind", "query", f"{SCOPE.format('0')} AS s0", f"{SCOPE.format('1')} AS s1", f"CASE WHEN turn = 5 THEN 'src99' ELSE {SCOPE.format('(turn % 2)')} END AS sx"]
RAW = """CASE kind WHEN 0 THEN '{"action":"SEARCH","query":"' || query || '","scopes":["' || sx || '"]}' WHEN 1 THEN '{"action":"SEARCH","query":"other","scopes":["' || s1 || '"]}' WHEN 2 THEN '{"action":"LOOKUP","evidence_id":"' || ev || '"}'
WHEN 3 THEN '{"action":"CLARIFY","question":"which?"}' WHEN 4 THEN '{"action":"FINISH","findings":[{"scope":"' || s0 || '","evidence_id":"' || ev || '","quote":"' || word || '"},{"scope":"' || sx || '","evidence_id":"' || ev || '","quote":"no such words here"}]}'
WHEN 5 THEN '{"action":"FINISH","outcomes":[{"scope":"' || s0 || '","status":"no_evidence_found"},{"scope":"' || sx || '1","status":"insufficient_scope"}]}' WHEN 6 THEN '{"action":"FINISH","outcomes":[{"scope":"' || s0 || '","status":"evidence_found","evidence_ids":["' || ev || '","ev0"]},{"scope":"' || s1 || '","status":"evidence_found","evidence_ids":["' || ev || '"]}]}'
ELSE '{"action":"FINISH","outcomes":[{"scope":"' || s0 || '","status":"insufficient_scope"}]}' END"""
ACTION_SQL = f"""{ELIGIBLE_SQL}, turns AS (SELECT {', '.join(TURNS)} FROM conversations JOIN conv USING (conv_id)),
act AS (SELECT t.*, 'ev' || coalesce(doc_id, -1) AS ev, coalesce({WORD.format('')}, '') AS word, CASE WHEN kind < 2 THEN 'SEARCH' WHEN kind = 2 THEN 'LOOKUP' WHEN kind = 3 THEN 'CLARIFY' ELSE 'FINISH' END AS action
  FROM turns t LEFT JOIN pool p ON p.source = s0 AND p.doc_id % {PARTS} = task_id % {PARTS} AND p.place = turn % 3),
srch AS (SELECT *, kind = 0 AND (task_id, scope) IN (SELECT (task_id, scope) FROM scopes) AS right_ FROM (SELECT *, CASE kind WHEN 0 THEN sx ELSE s1 END AS scope FROM act WHERE kind < 2)),
obs_ids AS (SELECT DISTINCT task_id, evidence_id AS ev, true AS seen FROM results), held AS (SELECT task_id, evidence_id AS ev, source, text FROM lookups),
common AS (SELECT action_id, task_id, action, CASE WHEN right_ THEN 'repeated_search' ELSE 'search_differs_from_task' END AS rule, scope AS detail FROM srch WHERE NOT right_ OR (task_id, scope) NOT IN (SELECT (task_id, scope) FROM may_search)
 UNION ALL SELECT action_id, task_id, action, CASE WHEN seen IS NULL THEN 'unobserved_evidence' WHEN source IS NOT NULL THEN 'repeated_lookup' ELSE 'uncovered_scope_first' END, ev
   FROM act LEFT JOIN obs_ids USING (task_id, ev) LEFT JOIN held USING (task_id, ev) WHERE kind = 2 AND (seen IS NULL OR source IS NOT NULL OR (task_id, ev) NOT IN (SELECT (task_id, evidence_id) FROM may_look))
 UNION ALL SELECT action_id, a.task_id, action, 'scope_not_covered', c.scope FROM fin a JOIN cov c ON c.task_id = a.task_id WHERE coverage IN ('UNSEARCHED', 'CANDIDATES_OBSERVED'))"""


def proposed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """action_id, task_id, raw."""
    turns = C.table(spark, sf_dir, "conversations")
    conv = turns.groupBy("conv_id").agg(F.min_by(F.md5(F.col("text").cast("binary")), "turn").alias("query"))
    rows = turns.join(conv, "conv_id").selectExpr(*TURNS)
    docs = C.table(spark, sf_dir, "documents").filter("source IS NOT NULL").withColumn("place", F.row_number().over(Window.partitionBy("source", F.col("doc_id") % PARTS).orderBy("doc_id")) - 1).filter("place < 3")
    pool = docs.select("doc_id", F.col("source").alias("s0"), (F.col("doc_id") % PARTS).alias("part"), "place", F.expr(WORD.format(", 1")).alias("word"))
    rows = rows.withColumn("part", F.col("task_id") % PARTS).withColumn("place", F.col("turn") % 3).join(pool, ["s0", "part", "place"], "left")
    rows = rows.withColumn("word", F.coalesce("word", F.lit(""))).withColumn("ev", F.expr("'ev' || coalesce(doc_id, -1)"))
    return rows.selectExpr("action_id", "task_id", f"{RAW} AS raw")


@query(f"""WITH {ACTION_SQL.replace("common AS (", "fin AS (SELECT * FROM act WHERE kind IN (5, 7) OR (kind = 6 AND ev <> 'ev0')), common AS (", 1)},
outc AS (SELECT action_id, task_id, action, 0 AS nr, s0 AS scope, CASE kind WHEN 5 THEN 'no_evidence_found' WHEN 6 THEN 'evidence_found' ELSE 'insufficient_scope' END AS status, CASE kind WHEN 6 THEN [ev, 'ev0'] ELSE [] END AS ids FROM fin
 UNION ALL SELECT action_id, task_id, action, 1, CASE kind WHEN 5 THEN sx || '1' ELSE s1 END, CASE kind WHEN 5 THEN 'insufficient_scope' ELSE 'evidence_found' END, CASE kind WHEN 6 THEN [ev] ELSE [] END FROM fin WHERE kind < 7),
ids AS (SELECT *, min(nr) OVER (PARTITION BY action_id, ev) AS first_at FROM (SELECT action_id, task_id, action, nr, scope, unnest(ids) AS ev FROM outc)),
idr AS (SELECT i.*, held.source, (i.task_id, i.scope, i.ev) IN (SELECT (task_id, scope, evidence_id) FROM results) AS candidate FROM ids i LEFT JOIN held USING (task_id, ev))
SELECT * FROM common UNION ALL SELECT action_id, task_id, action, CASE kind WHEN 4 THEN 'unexpected_fields' ELSE 'invalid_outcomes' END, NULL FROM act WHERE kind = 4 OR (kind = 6 AND ev = 'ev0')
UNION ALL SELECT f.action_id, f.task_id, action, 'scope_missing', s.scope FROM fin f JOIN scopes s ON s.task_id = f.task_id WHERE (f.action_id, s.scope) NOT IN (SELECT (action_id, scope) FROM outc)
UNION ALL SELECT action_id, task_id, action, 'unknown_scope', scope FROM outc WHERE (task_id, scope) NOT IN (SELECT (task_id, scope) FROM scopes)
UNION ALL SELECT action_id, task_id, action, 'contradicts_candidates', scope FROM outc WHERE status = 'no_evidence_found' AND (task_id, scope) IN (SELECT (task_id, scope) FROM results)
UNION ALL SELECT action_id, task_id, action, 'needs_looked_up_candidate', scope FROM outc WHERE status = 'insufficient_scope' AND (task_id, scope) NOT IN (SELECT (task_id, scope) FROM looked)
UNION ALL SELECT action_id, task_id, action, 'not_a_candidate', ev FROM idr WHERE NOT candidate UNION ALL SELECT action_id, task_id, action, 'not_looked_up', ev FROM idr WHERE source IS NULL
UNION ALL SELECT action_id, task_id, action, 'other_source', ev FROM idr WHERE source <> scope UNION ALL SELECT action_id, task_id, action, 'repeated_evidence', ev FROM idr WHERE nr > first_at""")
def agt_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule that a proposed action breaks; evidence by reference."""
    return K.violations(proposed(spark, sf_dir), *state(spark, sf_dir))


@query(f"""WITH {ACTION_SQL.replace("common AS (", "fin AS (SELECT * FROM act WHERE kind = 4 AND word <> ''), common AS (", 1)},
each AS (SELECT action_id, task_id, action, 0 AS nr, s0 AS scope, ev, word AS quote FROM fin UNION ALL SELECT action_id, task_id, action, 1, sx, ev, 'no such words here' FROM fin),
idr AS (SELECT e.*, source, text FROM each e LEFT JOIN held USING (task_id, ev))
SELECT * FROM common UNION ALL SELECT action_id, task_id, action, CASE WHEN kind > 4 THEN 'unexpected_fields' ELSE 'invalid_findings' END, NULL FROM act WHERE kind > 4 OR (kind = 4 AND word = '')
UNION ALL SELECT action_id, a.task_id, action, 'no_missing_constraint', NULL FROM act a JOIN states s ON s.task_id = a.task_id WHERE kind = 3 AND clarification IS NULL
UNION ALL SELECT action_id, task_id, action, 'not_looked_up', ev FROM idr WHERE source IS NULL UNION ALL SELECT action_id, task_id, action, 'unknown_scope', ev FROM idr WHERE (task_id, scope) NOT IN (SELECT (task_id, scope) FROM scopes)
UNION ALL SELECT action_id, task_id, action, 'other_source', ev FROM idr WHERE source <> scope UNION ALL SELECT action_id, task_id, action, 'quote_not_in_text', ev FROM idr WHERE source IS NOT NULL AND NOT contains(text, quote)
UNION ALL SELECT action_id, task_id, action, 'repeated_evidence', ev FROM idr WHERE nr = 1""")
def agt_violations_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with copied quotes."""
    return K.violations(proposed(spark, sf_dir), *state(spark, sf_dir), contract="copied_quote")

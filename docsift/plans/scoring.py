"""Queries over scopes, arms, eligibility, sections, patterns, coverage counts and candidate groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.functions import text as T
from docsift.operators import evidence as V
from docsift.operators import retrieval
from docsift.operators import scoring as S

from . import common as C
from .evidence import PLACE_SQL, children, parents

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return keep


ASKED = "CASE item_id % 5 WHEN 0 THEN NULL WHEN 1 THEN {0}(known{1}, known{2}) WHEN 2 THEN {0}(known{1}, known{1}) WHEN 3 THEN {0}('?', known{1}) ELSE {3} END"
SCOPES_SQL = f"""k AS (SELECT list(DISTINCT source ORDER BY source) AS known FROM documents), r AS (SELECT item_id, text, known, {ASKED.format('list_value', '[1]', '[2]', '[]::VARCHAR[]')} AS asked FROM benchmark, k),
s AS (SELECT item_id, text, CASE WHEN asked IS NULL THEN known WHEN len(asked) = 0 OR len(list_distinct(asked)) < len(asked) OR len(list_filter(asked, lambda x: NOT list_contains(known, x))) > 0 THEN NULL ELSE list_filter(known, lambda x: list_contains(asked, x)) END AS scopes FROM r)"""


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark passage with scopes: none named, two in reverse order, a repeated one, an unknown one, an empty list."""
    known = C.table(spark, sf_dir, "documents").agg(F.array_sort(F.collect_set("source")).alias("known"))  # one row
    return C.table(spark, sf_dir, "benchmark").crossJoin(F.broadcast(known)).withColumn("asked", F.expr(ASKED.format("array", "[0]", "[1]", "cast(array() as array<string>)")))


@query(f"WITH {SCOPES_SQL} SELECT item_id, array_to_string(scopes, ',') AS scopes FROM s")
def flt_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asked(spark, sf_dir).select("item_id", F.array_join(S.resolve_scopes(F.col("asked"), F.col("known")), ",").alias("scopes"))


EMBED_SQL = "list_transform(range(16), lambda k: len(list_filter({0}, lambda x: x = k))::DOUBLE)"
DIGITS_SQL = f"list_transform({C.TOKENS}, lambda t: strpos('0123456789abcdef', substr(md5(t), 4, 1)) - 1)"
DENSE_CHUNKS_SQL = f"""cd AS (SELECT position, {DIGITS_SQL.format('text')} AS d FROM chunks), cv AS (SELECT position, {EMBED_SQL.format('d')} AS v FROM cd),
qd AS (SELECT item_id AS qid, {DIGITS_SQL.format('text')} AS d FROM benchmark), qv AS (SELECT qid, {EMBED_SQL.format('d')} AS v FROM qd),
cs AS (SELECT qid, position, CASE WHEN list_sum(cv.v) = 0 OR list_sum(qv.v) = 0 THEN 0 ELSE round(list_cosine_similarity(cv.v, qv.v), 6) END AS score FROM qv, cv),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, position) AS rank FROM cs) WHERE rank <= 20)"""
HYBRID_SQL = f"""{C.bm25_sql(20)}, {DENSE_CHUNKS_SQL},
fused AS (SELECT qid, position, n.rank AS dense_rank, b.rank AS bm25_rank, round(coalesce(1 / (60.0 + n.rank), 0) + coalesce(1 / (60.0 + b.rank), 0), 9) AS score FROM near n FULL OUTER JOIN bm25 b USING (qid, position)),
hybrid AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, CASE WHEN dense_rank IS NULL THEN 1 ELSE 0 END, coalesce(dense_rank, bm25_rank)) AS rank FROM fused) WHERE rank <= 20)"""


@query(f"WITH {HYBRID_SQL} SELECT qid, rank, position, score, dense_rank, bm25_rank FROM hybrid")
def ret_dense_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """20 dense and 20 BM25 candidates fused to 20, the embedding being a hash of the tokens."""
    return retrieval.hybrid(C.chunks(spark, sf_dir), C.questions(spark, sf_dir)).select("qid", "rank", "position", "score", "dense_rank", "bm25_rank")


AGAIN_SQL = "SELECT '{0}_rerank' AS arm, qid, row_number() OVER (PARTITION BY qid ORDER BY length(text) DESC, p.rank) AS rank, position FROM {1} p JOIN chunks USING (position)"


@query(f"""WITH {HYBRID_SQL}, a AS (SELECT 'dense' AS arm, qid, rank, position FROM near UNION ALL SELECT 'bm25', qid, rank, position FROM bm25 UNION ALL SELECT 'hybrid', qid, rank, position FROM hybrid
UNION ALL {AGAIN_SQL.format('dense', 'near')} UNION ALL {AGAIN_SQL.format('hybrid', 'hybrid')}) SELECT * FROM a WHERE rank <= 3""")
def evl_five_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.arms(C.chunks(spark, sf_dir), C.questions(spark, sf_dir), lambda query, text: F.length(text))


@query(f"""WITH {SCOPES_SQL}, f AS (SELECT item_id AS qid, CASE WHEN scopes IS NULL THEN 'invalid_scope' END AS bad FROM s), {HYBRID_SQL.replace('qid, position, n.rank', 'qid, position, n.rank')}
SELECT f.qid, coalesce(bad, CASE WHEN h.qid IS NULL THEN 'no_evidence' ELSE 'ok' END) AS status, CASE WHEN bad IS NULL AND f.qid % 5 = 0 THEN h.found END AS found
FROM f LEFT JOIN (SELECT qid, string_agg(position, ',' ORDER BY rank) AS found FROM hybrid WHERE rank <= 3 GROUP BY qid) h USING (qid)""")
def ret_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scoped search with its status; the positions are shown for the questions over all scopes."""
    rows = asked(spark, sf_dir).select(F.col("item_id").alias("qid"), F.col("text").alias("query"), F.col("asked").alias("scopes"))
    known = [r["source"] for r in C.table(spark, sf_dir, "documents").select("source").distinct().orderBy("source").collect()]
    out = retrieval.search(C.chunks(spark, sf_dir), rows, known)
    found = F.array_join(F.transform("results", lambda r: r["position"].cast("string")), ",")
    return out.select("qid", "status", F.when((F.col("status") == "ok") & (F.col("qid") % 5 == 0), found).alias("found"))


@query(f"""WITH {PLACE_SQL.replace(C.CHUNKS_SQL, C.bm25_sql(5))}, e AS (SELECT position, child, '[Parent neighborhood]' || chr(10) || substr(parent, greatest(0, pos - 120) + 1, pos + length(child) + 120 - greatest(0, pos - 120)) || chr(10) || chr(10) || '[Retrieved child]' || chr(10) || child AS ex, pos, uniq FROM pl),
x AS (SELECT position, child, CASE WHEN length(child) + 8 <= 768 AND pos >= 0 AND uniq AND length(ex) + 8 <= 768 THEN ex ELSE child END AS ex FROM e)
SELECT qid, rank, position, input_rank, md5(child) AS digest FROM (SELECT b.qid, b.position, b.rank AS input_rank, child, row_number() OVER (PARTITION BY b.qid ORDER BY length(ex) DESC, b.rank) AS rank FROM bm25 b JOIN x USING (position)) WHERE rank <= 3""")
def ret_rerank_expanded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pool's chunks ranked by their expanded texts, returned as they are."""
    pool = retrieval.bm25(retrieval.build(C.chunks(spark, sf_dir)), C.questions(spark, sf_dir), 5)
    kids = children(spark, sf_dir).withColumn("page", F.lit(1)).join(pool.select("position").distinct(), "position")
    rows = V.attach_parents(kids, parents(spark, sf_dir).withColumn("page", F.lit(1))).withColumn("query", F.lit("query"))
    wide = V.expand(rows, lambda q, t: F.length(q) + F.length(t) + 3).select("position", "text", "expanded")
    out = retrieval.rerank_expanded(pool.join(wide, "position").withColumn("query", F.lit("")), lambda q, t: F.length(t), 3)
    return out.select("qid", "rank", "position", "input_rank", F.md5("text").alias("digest"))


@query(f"""WITH {C.bm25_sql(3)}, t AS (SELECT qid, rank, list_distinct({C.TOKENS.format('q.text')}) AS a, list_distinct({C.TOKENS.format('c.text')}) AS b FROM bm25 JOIN chunks c USING (position) JOIN benchmark q ON q.item_id = qid), o AS (SELECT *, list_intersect(a, b) AS s FROM t)
SELECT qid, rank, round(CASE WHEN len(a) > 0 THEN len(s) / len(a) ELSE 0 END, 9) AS coverage, len(list_filter(s, lambda x: regexp_matches(x, '[-_/]') OR (regexp_matches(x, '[a-z]') AND regexp_matches(x, '[0-9]')))) AS identifiers, len(list_filter(s, lambda x: regexp_matches(x, '[0-9]'))) AS numbers FROM o""")
def ret_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    ask = C.questions(spark, sf_dir)
    pool = retrieval.bm25(retrieval.build(C.chunks(spark, sf_dir)), ask, 3)
    pool = pool.join(C.chunks_of(spark, sf_dir, pool).select("position", "text"), "position").join(ask, "qid")
    pool = pool.select("qid", "rank", T.tokens("query").alias("a"), T.tokens("text").alias("b")).select("qid", "rank", S.overlap(F.col("a"), F.col("b")).alias("o"))
    return pool.select("qid", "rank", F.round("o.query_token_coverage", 9).alias("coverage"), F.col("o.shared_identifier_tokens").alias("identifiers"), F.col("o.shared_numeric_tokens").alias("numbers"))


SEARCHED_SQL = """sc AS (SELECT DISTINCT conv_id AS task_id, 'S' || i AS scope FROM conversations, range(3) t(i)),
se AS (SELECT conv_id AS task_id, 'S' || turn % 3 AS scope, CASE turn % 4 WHEN 0 THEN 'timeout' WHEN 1 THEN 'no_evidence' ELSE 'ok' END AS status FROM conversations WHERE role = 'user'),
ob AS (SELECT DISTINCT conv_id AS task_id, 'e' || turn AS evidence_id, 'S' || turn % 3 AS scope FROM conversations), lu AS (SELECT DISTINCT conv_id AS task_id, 'e' || turn AS evidence_id FROM conversations WHERE turn % 5 = 1)"""


@query(f"WITH {SEARCHED_SQL} SELECT * FROM sc WHERE NOT EXISTS (SELECT 1 FROM se WHERE se.task_id = sc.task_id AND se.scope = sc.scope AND status IN ('ok', 'no_evidence'))")
def agt_eligible_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = C.table(spark, sf_dir, "conversations").withColumn("task_id", F.col("conv_id")).withColumn("query", F.lit("q"))
    scopes = turns.select("task_id", "query").distinct().withColumn("scope", F.explode(F.array(*[F.lit(f"S{i}") for i in range(3)])))
    searches = turns.filter("role = 'user'").select("task_id", "query", F.expr("'S' || turn % 3").alias("scope"), F.expr("CASE turn % 4 WHEN 0 THEN 'timeout' WHEN 1 THEN 'no_evidence' ELSE 'ok' END").alias("status"))
    return S.eligible_searches(scopes, searches).select("task_id", "scope")


@query(f"""WITH {SEARCHED_SQL}, l AS (SELECT ob.*, EXISTS (SELECT 1 FROM lu WHERE lu.task_id = ob.task_id AND lu.evidence_id = ob.evidence_id) AS done FROM ob),
op AS (SELECT task_id, scope FROM l GROUP BY task_id, scope HAVING NOT bool_or(done))
SELECT task_id, evidence_id, scope FROM l WHERE NOT done AND (task_id NOT IN (SELECT task_id FROM op) OR EXISTS (SELECT 1 FROM op WHERE op.task_id = l.task_id AND op.scope = l.scope))""")
def agt_eligible_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = C.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("task_id"), F.expr("'e' || turn").alias("evidence_id"), F.expr("'S' || turn % 3").alias("scope"), "turn")
    return S.eligible_lookups(turns, turns.filter("turn % 5 = 1"))


@query("""WITH o AS (SELECT c_nationkey AS task_id, c_mktsegment AS scope, CASE WHEN c_nationkey % 5 = 1 AND c_mktsegment = 'BUILDING' THEN NULL ELSE c_mktsegment <> 'MACHINERY' END AS available, CASE WHEN c_nationkey % 3 = 0 THEN [min(c_custkey)] END AS ids FROM customer WHERE c_nationkey % 7 <> 0 GROUP BY c_nationkey, c_mktsegment),
r AS (SELECT c_nationkey AS task_id, c_mktsegment AS scope, c_custkey AS id FROM customer WHERE c_custkey % 3 <> 1),
m AS (SELECT o.*, bool_or(ids IS NOT NULL) OVER (PARTITION BY task_id) AS by_id, (SELECT count(*) FROM r WHERE r.task_id = o.task_id AND r.scope = o.scope AND (o.ids IS NULL OR list_contains(o.ids, r.id))) > 0 AS met FROM o),
g AS (SELECT task_id, bool_or(available IS NULL) AS vague, bool_and(NOT coalesce(available, false) OR met) AS met FROM m GROUP BY task_id)
SELECT t.task_id, CASE WHEN g.task_id IS NULL THEN 'PREFLIGHT_CONTROL' WHEN vague THEN 'UNASSESSED' WHEN g.met THEN 'CANDIDATE_AVAILABLE' ELSE 'RETRIEVAL_BOUND' END AS candidate_group FROM (SELECT DISTINCT c_nationkey AS task_id FROM customer) t LEFT JOIN g USING (task_id)""")
def dia_candidate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("task_id"), F.col("c_mktsegment").alias("scope"), F.col("c_custkey").alias("evidence_id"))
    oracle = rows.filter("task_id % 7 != 0").groupBy("task_id", "scope").agg(F.min("evidence_id").alias("first"))
    oracle = oracle.select("task_id", "scope", F.expr("CASE WHEN task_id % 5 = 1 AND scope = 'BUILDING' THEN NULL ELSE scope != 'MACHINERY' END").alias("expected_available"), F.expr("CASE WHEN task_id % 3 = 0 THEN array(first) END").alias("expected_ids"))
    reviews = rows.withColumn("label", F.when(F.col("evidence_id") % 3 != 1, "RELEVANT").otherwise("PARTIAL"))
    return S.candidate_groups(rows.select("task_id").distinct(), oracle, reviews)


@query("""WITH s AS (SELECT c_nationkey AS task_id, c_custkey AS place, CASE WHEN c_custkey % 11 = 0 THEN c_custkey - 1 ELSE c_custkey END AS evidence_id, CASE c_custkey % 4 WHEN 0 THEN 'x' ELSE c_mktsegment END AS scope FROM customer),
f AS (SELECT s.*, row_number() OVER (PARTITION BY s.task_id, s.evidence_id ORDER BY place) AS nth, c.c_mktsegment AS source, c.c_name AS text, c.c_custkey % 6 <> 5 AS seen, c.c_custkey % 6 <> 4 AS looked FROM s LEFT JOIN customer c ON c.c_custkey = s.evidence_id AND c.c_nationkey = s.task_id),
v AS (SELECT *, CASE WHEN nth > 1 THEN 'duplicate' WHEN NOT coalesce(seen, false) THEN 'unobserved' WHEN NOT coalesce(looked, false) THEN 'not_looked_up' WHEN source <> scope THEN 'wrong_scope' END AS violation FROM f)
SELECT place, violation, CASE WHEN violation IS NULL THEN text END AS text FROM v""")
def sup_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("task_id"), F.col("c_custkey").alias("evidence_id"), F.col("c_mktsegment").alias("source"), F.col("c_name").alias("text"))
    chosen = rows.select("task_id", F.col("evidence_id").alias("place"), F.expr("CASE WHEN evidence_id % 11 = 0 THEN evidence_id - 1 ELSE evidence_id END").alias("evidence_id"), F.expr("CASE evidence_id % 4 WHEN 0 THEN 'x' ELSE source END").alias("scope"))
    return S.selected(chosen, rows.filter("evidence_id % 6 != 5"), rows.filter("evidence_id % 6 != 4")).select("place", "violation", "text")


OUTPUT = "'intro' || chr(10) || ' ## Fields ' || chr(10) || CASE c_custkey % 3 WHEN 0 THEN 'N/A' WHEN 1 THEN c_name || chr(10) || chr(10) || '  more' ELSE '' END || chr(10) || CASE c_custkey % 2 WHEN 0 THEN '## Notes' || chr(10) || 'text' ELSE 'tail' END"


@query(f"""WITH o AS (SELECT c_custkey, list_transform(string_split({OUTPUT}, chr(10)), lambda x: trim(x)) AS l FROM customer), b AS (SELECT c_custkey, list_slice(l, list_position(l, '## Fields') + 1, len(l)) AS l FROM o),
c AS (SELECT c_custkey, array_to_string(list_filter(list_slice(l, 1, coalesce(nullif(list_position(l, '## Notes'), 0) - 1, len(l))), lambda x: x <> ''), chr(10)) AS content FROM b)
SELECT c_custkey, content, lower(content) NOT IN ('', '-', 'none', 'n/a') AS meaningful FROM c""")
def str_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.table(spark, sf_dir, "customer").select("c_custkey", F.expr(OUTPUT.replace("chr(10)", "char(10)")).alias("o"))
    rows = rows.select("c_custkey", S.section("o", "## fields").alias("content"))
    return rows.withColumn("meaningful", S.meaningful(F.col("content")))


CALLOUT = "'位于K' || (10 + p_partkey % 90) || '+' || (100 + p_partkey % 900) || ' 东桥, Ａ' || p_size || '.5 - ' || p_size || ' m and xK11+222 dK123+4567 ≤ 3' || CASE p_partkey % 2 WHEN 0 THEN '12345' ELSE '' END"


@query(f"""SELECT p_partkey, 'K' || (10 + p_partkey % 90) || '+' || (100 + p_partkey % 900) || ',dK123+4567' AS mileages, 'A' || p_size || '.5' || '|-|' || p_size || '|m|and|xK11+222|dK123+4567|≤|3' || CASE p_partkey % 2 WHEN 0 THEN '12345' ELSE '' END AS tokens, 1 AS n_lengths FROM part""")
def str_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.table(spark, sf_dir, "part").select("p_partkey", F.expr(CALLOUT).alias("t"))
    tokens = S.coverage_tokens("t")
    tail = F.slice(tokens, F.array_position(tokens, F.regexp_extract(F.translate("t", "Ａ", "A"), r"A[0-9]+[.]5", 0)).cast("int"), F.size(tokens))
    return rows.select("p_partkey", F.array_join(F.regexp_extract_all("t", F.lit(S.MILEAGE), F.lit(0)), ",").alias("mileages"), F.array_join(tail, "|").alias("tokens"), F.size(F.regexp_extract_all("t", F.lit(S.LENGTH), F.lit(0))).alias("n_lengths"))


KINDS = "CASE doc_id % 5 WHEN 0 THEN 'table' WHEN 1 THEN 'chart' WHEN 2 THEN 'image' WHEN 3 THEN 'text_group' ELSE 'text' END"


@query(f"""WITH d AS (SELECT doc_id, {KINDS} AS k, doc_id % 7 <> 0 AS bbox FROM documents)
SELECT count(*) FILTER (WHERE k IN ('image', 'chart', 'table')) AS visual_documents, count(*) FILTER (WHERE k IN ('image', 'chart', 'table') AND bbox) AS visual_documents_with_bbox, count(*) FILTER (WHERE k = 'image') AS image_documents, count(*) FILTER (WHERE k = 'image' AND doc_id % 3 = 0) AS image_documents_with_index,
count(*) FILTER (WHERE k = 'image' AND doc_id % 4 > 1) AS image_documents_with_caption, count(*) FILTER (WHERE k = 'text_group' AND doc_id % 2 = 0) AS text_group_documents_with_block_geometry, count(*) FILTER (WHERE bbox) AS chunks_with_bbox FROM d""")
def evl_metadata_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = C.table(spark, sf_dir, "documents")
    box = F.when(F.col("doc_id") % 7 != 0, F.array(F.lit(0.0)))
    docs = d.select(F.expr(KINDS).alias("block_type"), box.alias("bbox"), F.expr("CASE WHEN doc_id % 3 = 0 THEN 1 END").alias("image_index"), F.expr("CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'c' END").alias("caption"), F.expr("CASE WHEN doc_id % 2 = 0 THEN array(1) ELSE array() END").alias("block_geometry"))
    return S.metadata_coverage(docs, d.select(box.alias("bbox")))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 4 IN (0, 1) THEN NULL ELSE c_acctbal END AS field_recall, c_nationkey AS width FROM customer""")
def sup_finite_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.table(spark, sf_dir, "customer").select("c_custkey", F.expr("CASE c_custkey % 4 WHEN 0 THEN double('NaN') WHEN 1 THEN double('-Infinity') ELSE c_acctbal END").alias("field_recall"), F.col("c_nationkey").alias("width"), F.lit("x").alias("secret"))
    return S.finite_metrics(rows, ["field_recall", "width", "height"], ["c_custkey"])


@query("""WITH r AS (SELECT p_partkey, p_size % 3 <> 0 AS expanded, p_partkey % 4 <> 0 AS boundary, p_size % 5 AS n_rows, p_partkey % 7 AS before, p_size % 7 AS after FROM part)
SELECT p_partkey, expanded AND boundary AND n_rows > 0 AND after < before AS passed FROM r""")
def sup_mechanism(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.table(spark, sf_dir, "part").select(
        "p_partkey", F.expr("CASE WHEN p_size % 3 != 0 THEN 'EXPANDED' ELSE 'CHILD_NOT_FOUND' END").alias("status"), F.expr("CASE WHEN p_partkey % 4 != 0 THEN 'table_boundary_rows' ELSE 'table_prefix' END").alias("context_type"),
        F.expr("CASE WHEN p_size % 5 = 0 THEN cast(array() as array<int>) ELSE sequence(1, p_size % 5) END").alias("row_indices"), F.expr("p_partkey % 7").alias("baseline_rank"), F.expr("p_size % 7").alias("parent_rank"),
    )
    return rows.select("p_partkey", S.mechanism_passed().alias("passed"))

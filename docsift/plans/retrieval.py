"""Queries over chunking, retrieval and citations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docsift.functions import text as T
from docsift.operators import chunking, retrieval

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


@query(f"WITH {C.SECTIONS_SQL} SELECT doc_id, section_no, length(section) AS n_chars, md5(section) AS digest FROM sections")
def chk_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chunking.sections(C.table(spark, sf_dir, "documents"), ["doc_id"])
    return found.select("doc_id", "section_no", F.length("section").alias("n_chars"), F.md5("section").alias("digest"))


@query(f"WITH {C.CHUNKS_SQL} SELECT doc_id, source, chunk_id, position, text FROM chunks")
def chk_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.chunks(spark, sf_dir)


@query(f"WITH {C.CHUNKS_SQL} SELECT position, row_number() OVER (ORDER BY position) - 1 AS ordinal FROM chunks")
def chk_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.ordinals(C.chunks(spark, sf_dir).select("position"), ["position"])


MARKED = "CASE WHEN doc_id % 7 = 0 THEN '# Topic ' || doc_id || chr(10) || text ELSE text END"


@query(rf"""WITH {C.CHUNKS_SQL.replace('regexp_replace(text,', f'regexp_replace({MARKED},')},
h AS (SELECT source, position, nullif(regexp_extract(text, '^#{{1,6}}\s+([^\n]+?)\s*#*\s*(\n|$)', 1), '') AS own FROM chunks)
SELECT source, position, coalesce(last_value(own IGNORE NULLS) OVER (PARTITION BY source ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '未标注') AS section FROM h""")
def chk_heading_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some documents get a heading first; each chunk then carries the last heading of its source."""
    docs = C.table(spark, sf_dir, "documents").withColumn("text", F.expr(MARKED.replace("chr(10)", "'\\n'")))
    rows = chunking.chunk(docs, "doc_id", ["source"])
    return chunking.carry_heading(rows).select("source", "position", "section")


@query(f"WITH t AS (SELECT doc_id, {C.TOKENS.format('text')} AS t FROM documents) SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_distinct, md5(array_to_string(t, ' ')) AS digest FROM t")
def ret_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = C.table(spark, sf_dir, "documents").select("doc_id", T.tokens("text").alias("t"))
    return found.select("doc_id", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_distinct"), F.md5(F.array_join("t", " ")).alias("digest"))


@query(f"WITH {C.bm25_sql(20)} SELECT term, df, round(idf, 6) AS idf FROM terms")
def ret_term_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.build(C.chunks(spark, sf_dir)).terms.select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {C.bm25_sql(20)} SELECT n, round(avg_len, 6) AS avg_len FROM stats")
def ret_corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.build(C.chunks(spark, sf_dir)).stats.select("n", F.round("avg_len", 6).alias("avg_len"))


@query(f"WITH {C.bm25_sql(20)} SELECT qid, rank, position, score FROM bm25")
def ret_bm25_top20(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = retrieval.build(C.chunks(spark, sf_dir))
    return retrieval.bm25(index, C.questions(spark, sf_dir), 20).select("qid", "rank", "position", "score")


@query(f"WITH {C.bm25_sql(3, 'source')} SELECT qid, source, rank, position, score FROM bm25")
def ret_bm25_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and ranks within each source."""
    index = retrieval.build(C.chunks(spark, sf_dir), scope="source")
    return retrieval.bm25(index, C.questions(spark, sf_dir), 3).select("qid", "source", "rank", "position", "score")


@query(f"WITH {C.DENSE_SQL.format(k=20)} SELECT qid, rank, position, score FROM dense")
def ret_dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.dense(C.vectors(spark, sf_dir), C.vector_queries(spark, sf_dir), 20).select("qid", "rank", "position", "score")


@query("""WITH q AS (SELECT label, list_aggregate([1], 'sum') AS one, embedding::DOUBLE[] AS e FROM embeddings),
n AS (SELECT label, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS l2, list_sum(list_transform(e, lambda x: abs(x))) AS l1 FROM q)
SELECT label, count(*) AS n, round(avg(l2), 6) AS mean_l2, round(avg(l1), 6) AS mean_l1 FROM n GROUP BY label""")
def mth_vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = C.vectors(spark, sf_dir).select("label", retrieval.norm(F.col("embedding")).alias("l2"), F.aggregate("embedding", F.lit(0.0), lambda s, x: s + F.abs(x.cast("double"))).alias("l1"))
    return v.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg("l2"), 6).alias("mean_l2"), F.round(F.avg("l1"), 6).alias("mean_l1"))


#: The second list of the fusion over vectors: neighbours by the mean absolute difference of ids.
NEAR_IDS = "SELECT qid, position, rank FROM (SELECT qid, position, row_number() OVER (PARTITION BY qid ORDER BY abs(position - qid), position) AS rank FROM vs WHERE abs(position - qid) <= 12) WHERE rank <= 20"
RRF_SQL = f"""{C.DENSE_SQL.format(k=20)}, near AS ({NEAR_IDS}),
fused AS (SELECT qid, position, d.rank AS dense_rank, n.rank AS near_rank, round(coalesce(1 / (60.0 + d.rank), 0) + coalesce(1 / (60.0 + n.rank), 0), 9) AS score
  FROM dense d FULL OUTER JOIN near n USING (qid, position)),
rrf AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, CASE WHEN dense_rank IS NULL THEN 1 ELSE 0 END, coalesce(dense_rank, near_rank)) AS rank FROM fused) WHERE rank <= 20)"""


def _lists(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    q, v = C.vector_queries(spark, sf_dir), C.vectors(spark, sf_dir)
    spots = q.select("qid", F.explode(F.sequence(F.col("qid") - 12, F.col("qid") + 12)).alias("position"))
    near = spots.join(v.select("position"), "position").withColumn("gap", F.abs(F.col("position") - F.col("qid")))
    near = near.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("gap", "position"))).filter("rank <= 20")
    return {"dense": retrieval.dense(v, q, 20), "near": near.select("qid", "position", "rank", (-F.col("gap")).cast("double").alias("score"))}


@query(f"WITH {RRF_SQL} SELECT qid, rank, position, score, dense_rank, near_rank FROM rrf")
def ret_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.rrf(_lists(spark, sf_dir)).select("qid", "rank", "position", "score", "dense_rank", "near_rank")


HYBRID_SQL = f"""{C.bm25_sql(20)},
short AS (SELECT qid, position, row_number() OVER (PARTITION BY qid ORDER BY length(text), position) AS rank FROM bm25 JOIN chunks USING (position)),
hyb AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rrf DESC, bm25_rank) AS rank FROM (
  SELECT b.qid, b.position, b.rank AS bm25_rank, s.rank AS short_rank, round(1 / (60.0 + b.rank) + 1 / (60.0 + s.rank), 9) AS rrf FROM bm25 b JOIN short s USING (qid, position)))"""


def hybrid(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """BM25's pool fused with the same pool ordered by length, and the chunks of the pool's documents."""
    pool = retrieval.bm25(retrieval.build(C.chunks(spark, sf_dir)), C.questions(spark, sf_dir), 20)
    rows = C.chunks_of(spark, sf_dir, pool)
    sized = pool.join(rows.select("position", F.length("text").alias("size")), "position")
    short = sized.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("size", "position")))
    return retrieval.rrf({"bm25": pool, "short": short.select("qid", "position", "rank", "score")}), rows


@query(f"WITH {HYBRID_SQL} SELECT qid, rank, position, bm25_rank, short_rank, rrf AS score FROM hyb")
def ret_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hybrid(spark, sf_dir)[0].select("qid", "rank", "position", "bm25_rank", "short_rank", "score")


RERANK_SQL = f"""{HYBRID_SQL},
rer AS (SELECT * FROM (SELECT h.qid, h.position, h.rank AS input_rank, length(c.text)::DOUBLE AS reranker_score, c.text, c.source, c.chunk_id, c.doc_id,
  row_number() OVER (PARTITION BY h.qid ORDER BY length(c.text) DESC, h.rank) AS rank FROM hyb h JOIN chunks c USING (position)) WHERE rank <= 3)"""


def reranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool, rows = hybrid(spark, sf_dir)
    pool = pool.join(rows, "position").join(C.questions(spark, sf_dir), "qid")
    return retrieval.rerank(pool, lambda query, text: F.length(text), 3)


@query(f"WITH {RERANK_SQL} SELECT qid, rank, position, input_rank, reranker_score, input_rank - rank AS rank_change FROM rer")
def ret_rerank_len(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reranker seam with a deterministic scorer, and how far each row moved."""
    return reranked(spark, sf_dir).select("qid", "rank", "position", "input_rank", "reranker_score", (F.col("input_rank") - F.col("rank")).alias("rank_change"))


@query(f"""WITH {RERANK_SQL} SELECT qid, string_agg('[来源: ' || source || ']' || chr(10) || '[章节: 未标注]' || chr(10) || chr(10) || '内容:' || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context FROM rer GROUP BY qid""")
def prj_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docsift.operators import evidence

    return evidence.context(reranked(spark, sf_dir).withColumn("page", F.lit(None).cast("int")), ["qid"])


@query(f"""WITH {RERANK_SQL}, u AS (SELECT DISTINCT ON (qid, source, chunk_id, doc_id) qid, source, doc_id, chunk_id, rank FROM rer ORDER BY qid, source, chunk_id, doc_id, rank)
SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY rank) AS number, source, '未标注' AS section, doc_id AS block_index, chunk_id FROM u""")
def ret_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docsift.operators import evidence

    rows = reranked(spark, sf_dir).select("qid", "rank", "source", F.lit(None).cast("int").alias("page"), F.lit("document").alias("block_type"), F.col("doc_id").alias("block_index"), "chunk_id", chunking.section_of(F.col("text")).alias("section"))
    return evidence.citations(rows, ["qid"]).select("qid", "number", "source", "section", "block_index", "chunk_id")

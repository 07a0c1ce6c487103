"""Tables of one folder in the shapes that the operators take, and the matching SQL fragments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.operators import chunking


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of all documents: doc_id, source, chunk_id, position, text."""
    return chunking.chunk(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), "doc_id", ["source"])


def chunks_of(spark: SparkSession, sf_dir: str, pool: DataFrame) -> DataFrame:
    """The chunks of those documents only that a pool (position) holds; a document's chunks follow from it alone."""
    n = chunking.PER_DOCUMENT
    held = pool.select(F.expr(f"(position - pmod(position, {n}L)) div {n}L").alias("doc_id")).distinct()
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text").join(F.broadcast(held), "doc_id", "left_semi")
    return chunking.chunk(docs, "doc_id", ["source"])


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark passage as a query: qid, query."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("position"), "embedding", "label")


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set: every vector whose id is divisible by 20."""
    return vectors(spark, sf_dir).filter(F.col("position") % 20 == 0).select(F.col("position").alias("qid"), "embedding", "label")


TRIM = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
FOLD = "replace(lower({0}), 'ß', 'ss')"
TOKENS = "regexp_extract_all(translate(" + FOLD + ", '‐‑‒–—−', '------'), '[a-z0-9]+(?:[-_/.][a-z0-9]+)*')"
NORMAL = r"regexp_replace(" + FOLD + r", '\s+', '', 'g')"

SECTIONS_SQL = rf"""
parts AS (SELECT doc_id, source, string_split_regex(regexp_replace(text, '\n(#{{1,6}} )', chr(1) || '\1', 'g'), chr(1) || '|\n\s*\n') AS p FROM documents),
secs AS (SELECT doc_id, source, i - 1 AS section_no, {TRIM.format('p[i]')} AS section FROM parts, unnest(range(1, len(p) + 1)) AS t(i)),
sections AS (SELECT * FROM secs WHERE section <> '')"""
CHUNKS_SQL = SECTIONS_SQL + rf""",
wins AS (SELECT doc_id, source, section_no, section, unnest(CASE WHEN length(section) <= 500 THEN [0]
  ELSE range(0, (ceil((length(section) - 500) / 420.0) * 420 + 1)::BIGINT, 420) END) AS pos FROM sections),
cut AS (SELECT doc_id, source, section_no, pos, {TRIM.format('substr(section, pos + 1, 500)')} AS text FROM wins),
chunks AS (SELECT doc_id, source, chunk_id, doc_id * 1000000 + chunk_id AS position, text FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY section_no, pos) - 1 AS chunk_id FROM cut WHERE text <> ''))"""
BM25_SQL = CHUNKS_SQL + f""",
toks AS (SELECT @scope@position, {TOKENS.format('text')} AS t FROM chunks),
lens AS (SELECT @scope@position, len(t) AS len FROM toks),
stats AS (SELECT @scope@count(*) AS n, avg(len) AS avg_len FROM lens @scope_group@),
post AS (SELECT @scope@position, term, count(*) AS tf FROM (SELECT @scope@position, unnest(t) AS term FROM toks) GROUP BY ALL),
dfs AS (SELECT @scope@term, count(*) AS df FROM post GROUP BY ALL),
terms AS (SELECT @scope@term, df, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf, avg_len FROM dfs @stats_join@),
qterms AS (SELECT DISTINCT item_id AS qid, unnest({TOKENS.format('text')}) AS term FROM benchmark),
scored AS (SELECT qid, @scope@position, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))), 6) AS score
  FROM qterms JOIN terms USING (term) JOIN post USING (@scope@term) JOIN lens USING (@scope@position) GROUP BY ALL),
bm25 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid @scope_part@ ORDER BY score DESC, position) AS rank FROM scored) WHERE rank <= @k@)"""


def bm25_sql(k: int, scope: str = "") -> str:
    values = {
        "k": str(k), "scope": f"{scope}, " if scope else "", "scope_group": f"GROUP BY {scope}" if scope else "", "scope_part": f", {scope}" if scope else "",
        "stats_join": f"JOIN stats USING ({scope})" if scope else "CROSS JOIN stats",
    }
    sql = BM25_SQL
    for name, value in values.items():
        sql = sql.replace(f"@{name}@", value)
    return sql


DENSE_SQL = """
vq AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS q, label AS q_label FROM embeddings WHERE vec_id % 20 = 0),
vs AS (SELECT qid, q_label, vec_id AS position, label, round(list_cosine_similarity(embedding::DOUBLE[], q), 6) AS score FROM vq, embeddings),
dense AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, position) AS rank FROM vs) WHERE rank <= {k})"""

"""Queries over nested content: every document's text inside JSON of several shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.operators import nested

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


#: JSON around a text (t: the text as a JSON string, d: its id).
SHAPES = """CASE d % 6 WHEN 0 THEN '{"type":"p","content":[{"text":' || t || ',"note":"n"},{"a":{"image_path":"p' || d || '"},"b":["x",""]}],"rest":"hidden"}' WHEN 1 THEN '{"z":[[[' || t || ']]],"image_source":{"no":1},"k":{"deep":{"image_path":"q","image_source":"s' || d || '"}}}'
WHEN 2 THEN t WHEN 3 THEN '{' || raw WHEN 4 THEN '{"text":{"text":"inner"},"content":{"list":[1,null,true,' || t || ']},"image_path":"top"}' ELSE repeat('[', 12) || '{"text":' || t || ',"other":[{"image_source":"i"}]}' || repeat(']', 12) END"""


@query(f"""WITH RECURSIVE r AS (SELECT doc_id, {SHAPES} AS content FROM (SELECT doc_id, doc_id AS d, text AS raw, to_json(text)::VARCHAR AS t FROM documents WHERE text IS NOT NULL)),
j AS (SELECT doc_id, content, json_valid(content) AS ok FROM r),
n AS (SELECT doc_id, x.* FROM j, json_tree(CASE WHEN ok THEN content ELSE 'null' END) AS x),
o AS (SELECT p.doc_id, p.id, coalesce(bool_or(c.key = 'text' AND c.type = 'VARCHAR'), false) AS has_text, coalesce(bool_or(c.key = 'content'), false) AS has_content FROM n p LEFT JOIN n c ON c.doc_id = p.doc_id AND c.parent = p.id WHERE p.type = 'OBJECT' GROUP BY ALL),
w AS (SELECT doc_id, id, type, atom FROM n WHERE parent IS NULL UNION ALL SELECT n.doc_id, n.id, n.type, n.atom FROM w JOIN n ON n.doc_id = w.doc_id AND n.parent = w.id LEFT JOIN o ON o.doc_id = w.doc_id AND o.id = w.id
  WHERE o.id IS NULL OR CASE WHEN has_text THEN n.key = 'text' AND n.type = 'VARCHAR' WHEN has_content THEN n.key = 'content' ELSE true END),
t AS (SELECT doc_id, string_agg(atom ->> '$', chr(10) ORDER BY id) FILTER (WHERE type = 'VARCHAR' AND atom ->> '$' <> '') AS text FROM w GROUP BY doc_id),
f AS (SELECT doc_id, min_by(atom ->> '$', [parent, CASE key WHEN 'image_source' THEN 0 ELSE 1 END]) AS reference FROM n WHERE key IN ('image_source', 'image_path') AND type = 'VARCHAR' GROUP BY doc_id)
SELECT doc_id, md5(CASE WHEN ok THEN coalesce(t.text, '') ELSE content END) AS text_md5, CASE WHEN ok THEN reference END AS reference FROM j LEFT JOIN t USING (doc_id) LEFT JOIN f USING (doc_id)""")
def prj_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The readable text and the image reference of nested content."""
    docs = C.table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", F.col("doc_id").alias("d"), F.col("text").alias("raw"), F.to_json(F.array("text")).alias("j"))
    docs = docs.withColumn("t", F.expr("substring(j, 2, length(j) - 2)"))
    out = nested.content(docs.select("doc_id", F.expr(SHAPES).alias("content")), ["doc_id"])
    return out.select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), "reference")

"""Queries of the text matchers: term groups of the benchmark's items on documents, critical tokens of documents in altered copies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docsift.operators import matching as M

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


ITEM_WORDS = "[a-z]{4,}"
TERMS_SQL = f"""items AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS n, count(*) OVER () AS n_items, regexp_extract_all(text, '{ITEM_WORDS}') AS w FROM benchmark),
terms AS (SELECT item_id, 'field' AS kind, 0 AS group_no, upper(w[1]) AS term FROM items UNION ALL SELECT item_id, 'field', 0, w[2] FROM items UNION ALL SELECT item_id, 'field', 1, w[3] FROM items WHERE n % 2 = 0
 UNION ALL SELECT item_id, 'unit', 0, t FROM items, (SELECT unnest(['mm', 'e', 'kg', 'a']) AS t) WHERE n % 3 <> 0 UNION ALL SELECT item_id, 'condition', 0, (n % 13)::VARCHAR FROM items WHERE n % 4 <> 0 UNION ALL SELECT item_id, 'condition', 0, (n % 90 + 10)::VARCHAR FROM items WHERE n % 4 <> 0)"""


def terms(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """items (item_id, n, n_items) and terms (item_id, kind, group_no, term)."""
    rows = C.table(spark, sf_dir, "benchmark")
    n = rows.count()
    items = rows.select("item_id", (F.row_number().over(Window.orderBy("item_id")) - 1).alias("n"), F.lit(n).alias("n_items"), F.regexp_extract_all("text", F.lit(ITEM_WORDS), F.lit(0)).alias("w"))  # the stated questions
    term = lambda kind, group, value: F.struct(F.lit(kind).alias("kind"), F.lit(group).alias("group_no"), value.alias("term"))
    units = F.when(F.col("n") % 3 != 0, F.array(*[term("unit", 0, F.lit(t)) for t in ("mm", "e", "kg", "a")])).otherwise(F.array())
    digits = F.when(F.col("n") % 4 != 0, F.array(term("condition", 0, (F.col("n") % 13).cast("string")), term("condition", 0, (F.col("n") % 90 + 10).cast("string")))).otherwise(F.array())
    more = F.when(F.col("n") % 2 == 0, F.array(term("field", 1, F.get("w", 2)))).otherwise(F.array())
    each = items.select("item_id", F.explode(F.concat(F.array(term("field", 0, F.upper(F.get("w", 0))), term("field", 0, F.get("w", 1))), more, units, digits)).alias("t"))
    return items.select("item_id", "n", "n_items"), each.select("item_id", "t.*").filter("term IS NOT NULL")


#: A term in a text without blanks; a character on either side stands for the boundary.
HOLDS_SQL = """CASE WHEN regexp_matches(term, '^[0-9]+$') THEN regexp_matches(t, '(^|[^0-9.])' || term || '([^0-9.]|$)') WHEN kind = 'unit' THEN regexp_matches(t, '(^|[^a-z])' || term || '([^a-z0-9]|$)') ELSE contains(t, lower(term)) END"""


@query(rf"""WITH {TERMS_SQL}, d AS (SELECT doc_id, source, item_id, regexp_replace(replace(replace(lower(text), '×', 'x'), '²', '2'), '[\s{{}}^_\\]', '', 'g') AS t FROM documents JOIN items ON doc_id % n_items = n),
g AS (SELECT doc_id, kind, group_no, bool_or({HOLDS_SQL}) AS ok FROM d JOIN terms USING (item_id) WHERE term IS NOT NULL GROUP BY ALL), k AS (SELECT doc_id, kind, bool_and(ok) AS ok FROM g GROUP BY ALL),
a AS (SELECT doc_id, item_id, source, bool_or(ok) FILTER (WHERE kind = 'field') AS f, bool_or(ok) FILTER (WHERE kind = 'unit') AS u, bool_or(ok) FILTER (WHERE kind = 'condition') AS c FROM d LEFT JOIN k USING (doc_id) GROUP BY ALL)
SELECT doc_id, item_id, CASE WHEN told THEN f END AS field_alignment, CASE WHEN told THEN u END AS unit_alignment, CASE WHEN told THEN c END AS condition_alignment, CASE WHEN told THEN scoped END AS scope_alignment,
 CASE WHEN NOT told THEN 'UNCERTAIN' WHEN NOT available OR NOT scoped OR f = false THEN 'IRRELEVANT' WHEN f IS NULL THEN 'UNCERTAIN' WHEN u = false OR c = false THEN 'PARTIAL' ELSE 'RELEVANT' END AS label
FROM (SELECT *, doc_id % 10 <> 0 AND doc_id % 6 <> 0 AS told, doc_id % 6 <> 1 AS available, coalesce(source <> 'src3', false) AND doc_id % 4 <= 2 AS scoped FROM a)""")
def str_group_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a finding for one item: its groups of terms, its page and source, and the label."""
    items, rows = terms(spark, sf_dir)
    groups = items.join(M.term_groups(rows), "item_id", "left")
    docs = C.table(spark, sf_dir, "documents")
    found = docs.join(groups, F.col("doc_id") % F.col("n_items") == F.col("n")).select(
        "doc_id", "item_id", F.col("text").alias("quote"), F.col("source").alias("evidence_source"), (F.col("doc_id") % 4).alias("evidence_page"), F.when(F.col("source") == "src3", "other").otherwise(F.col("source")).alias("scope"),
        (F.col("doc_id") % 10 != 0).alias("reviewed"), F.expr("CASE doc_id % 6 WHEN 0 THEN NULL WHEN 1 THEN false ELSE true END").alias("expected_available"), F.array(*[F.lit(i).cast("bigint") for i in range(3)]).alias("pages"),
        "field_groups", "unit_groups", "condition_groups",
    )
    return M.review(found).select("doc_id", "item_id", "field_alignment", "unit_alignment", "condition_alignment", "scope_alignment", "label")


#: Expected fields: words with a digit, without characters that the scanners would split; the output loses some of their characters.
FIELD = "[+-]?[A-Za-z0-9.%]*[0-9][A-Za-z0-9.%-]*"
SEEN = "CASE doc_id % 4 WHEN 1 THEN translate(text, '38', '88') WHEN 2 THEN replace(text, '-', '') WHEN 3 THEN replace(text, '.', '') ELSE text END"
UNITS_SQL = "[" + ", ".join(f"'{u}'" for u in M.folded_units()) + "]"
TOKENS_SQL = rf"""fields AS (SELECT doc_id, i, f[i] AS field FROM (SELECT doc_id, regexp_extract_all(text, '{FIELD}') AS f FROM documents), unnest(range(1, len(f) + 1)) AS t(i)),
tok AS (SELECT doc_id, i, j, field, t[j] AS found, lower(t[j]) AS norm FROM (SELECT *, regexp_extract_all(field, '[A-Za-z0-9]+(?:[._/-][A-Za-z0-9]+)*') AS t FROM fields), unnest(range(1, len(t) + 1)) AS u(j)),
un AS (SELECT *, list_filter({UNITS_SQL}, lambda u: ends_with(norm, u) AND length(norm) > length(u))[1] AS unit FROM tok),
pre AS (SELECT *, left(norm, length(norm) - length(unit)) AS prefix FROM un),
told AS (SELECT *, CASE WHEN list_contains({UNITS_SQL}, norm) THEN 'unit' WHEN regexp_matches(prefix, '^(?:[0-9]+(?:[.,][0-9]+)?|\.[0-9]+)$') THEN 'literal' WHEN regexp_matches(prefix, '^[0-9]+(?:x[0-9]+)+$') THEN 'several' WHEN regexp_matches(found, '[A-Za-z]') AND regexp_matches(found, '[0-9]') THEN 'code' END AS what FROM pre),
crit AS (SELECT doc_id, 'unit' AS kind, norm AS token FROM told WHERE what = 'unit' UNION SELECT doc_id, 'unit', unit FROM told WHERE what IN ('literal', 'several') UNION SELECT doc_id, 'number', CASE WHEN j = 1 AND field[1] IN ('+', '-') THEN field[1] ELSE '' END || prefix FROM told WHERE what = 'literal'
 UNION SELECT doc_id, 'number', unnest(regexp_extract_all(prefix, '[0-9]+')) FROM told WHERE what = 'several' UNION SELECT doc_id, 'code', norm FROM told WHERE what = 'code'
 UNION SELECT doc_id, 'number', n FROM (SELECT doc_id, i, regexp_extract(field, '^([+-]?(?:[0-9]+(?:[.,][0-9]+)?|\.[0-9]+))(?:[^0-9.]|$)', 1) AS n FROM fields) WHERE n <> '' AND (doc_id, i) NOT IN (SELECT (doc_id, i) FROM told WHERE j = 1 AND what = 'code')
 UNION SELECT doc_id, 'number', unnest(regexp_extract_all(field, '%([0-9]+(?:\.[0-9]+)?)(?:[^0-9.]|$)', 1)) FROM fields UNION SELECT doc_id, 'unit', '%' FROM fields WHERE contains(field, '%')),
seen AS (SELECT doc_id, source, {C.NORMAL.format(SEEN)} AS t FROM documents),
fc AS (SELECT doc_id, count(*) AS expected_fields, count(*) FILTER (WHERE contains(t, lower(field))) AS matched_fields FROM fields JOIN seen USING (doc_id) GROUP BY doc_id),
tc AS (SELECT doc_id, count(*) AS expected_tokens, count(*) FILTER (WHERE regexp_matches(t, '(^|[^' || c || '])' || regexp_replace(token, '([.+])', '\\\1', 'g') || '([^' || c || ']|$)')) AS matched_tokens
  FROM (SELECT *, CASE kind WHEN 'number' THEN '0-9.' WHEN 'code' THEN 'a-z0-9' ELSE 'a-z' END AS c FROM crit) JOIN seen USING (doc_id) GROUP BY doc_id),
cases AS (SELECT doc_id, source, coalesce(expected_fields, 0) AS expected_fields, coalesce(matched_fields, 0) AS matched_fields, coalesce(expected_tokens, 0) AS expected_tokens, coalesce(matched_tokens, 0) AS matched_tokens FROM documents LEFT JOIN fc USING (doc_id) LEFT JOIN tc USING (doc_id))"""


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    fields = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(FIELD), F.lit(0))).alias("field"))
    return M.analyse(docs.select("doc_id", "source", F.expr(SEEN).alias("output")), fields, ["doc_id"])


@query(f"""WITH {TOKENS_SQL} SELECT *, expected_fields > 0 AND expected_fields = matched_fields AS normalized_hit, expected_fields > 0 AND expected_fields = matched_fields AND expected_tokens = matched_tokens AS strict_hit FROM cases""")
def str_critical_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected and found fields and critical tokens of every document."""
    return cases(spark, sf_dir)


@query(f"""WITH {TOKENS_SQL} SELECT source, count(*) AS cases, count(*) FILTER (WHERE expected_fields > 0 AND expected_fields = matched_fields AND expected_tokens = matched_tokens) AS strict_hits, count(*) FILTER (WHERE expected_fields > 0 AND expected_fields = matched_fields) AS full_hits,
 sum(matched_fields)::BIGINT AS matched_fields, sum(expected_fields)::BIGINT AS expected_fields, sum(matched_tokens)::BIGINT AS matched_tokens, sum(expected_tokens)::BIGINT AS expected_tokens, round(coalesce(sum(matched_fields) / nullif(sum(expected_fields), 0), 0), 6) AS field_recall,
 round(sum(matched_tokens) / nullif(sum(expected_tokens), 0), 6) AS token_recall, (sum(expected_tokens) - sum(matched_tokens))::BIGINT AS token_errors FROM cases GROUP BY source""")
def evl_token_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Micro-averaged recall by source."""
    return M.recall(cases(spark, sf_dir), ["source"]).withColumns({c: F.round(c, 6) for c in ("field_recall", "token_recall")})

"""Queries over text-layer quality, gates and page geometry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.functions import text as T
from docsift.operators import layout as L
from docsift.operators import quality as Q

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


WORDS = "regexp_extract_all(lower({0}), '[a-z0-9]+')"
CHARS = "regexp_extract_all(lower({0}), '[a-z0-9]')"
#: A parser's view of a document: the whole text, but some letters and all numbers are lost.
OUTPUT = "regexp_replace(translate(text, CASE doc_id % 5 WHEN 0 THEN 'abcdefgh' WHEN 1 THEN 'xyz' WHEN 2 THEN 'aeiou' WHEN 3 THEN '' ELSE 'aeiourstln' END, ''), '[0-9]+', ''{0})"


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("native"), F.expr(OUTPUT.format("")).alias("output"))


PAGES_SQL = f"pages AS (SELECT doc_id, text AS native, {OUTPUT.format(chr(44) + chr(32) + chr(39) + 'g' + chr(39))} AS output FROM documents)"


@query(rf"""WITH t AS (SELECT doc_id, {WORDS.format('text')} AS w FROM documents),
l AS (SELECT doc_id, line, count(*) AS c FROM (SELECT doc_id, {C.TRIM.format('lower(x)')} AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM documents)) WHERE line <> '' GROUP BY ALL),
r AS (SELECT doc_id, sum(c)::BIGINT AS n_lines, sum(c - 1) / sum(c) AS rep FROM l GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, round(CASE WHEN len(w) > 0 THEN (len(w) - len(list_distinct(w))) / len(w)::DOUBLE ELSE 0 END, 6) AS duplicate_ratio, n_lines, round(coalesce(rep, 0), 6) AS repeated_line_ratio FROM t LEFT JOIN r USING (doc_id)""")
def qlt_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    words = docs.select("doc_id", T.word_tokens("text").alias("w")).select("doc_id", F.size("w").alias("n_words"), F.round(Q.duplicate_ratio(F.col("w")), 6).alias("duplicate_ratio"))
    repeated = Q.repeated_lines(docs, ["doc_id"], "text")
    return words.join(repeated, "doc_id", "left").select("doc_id", "n_words", "duplicate_ratio", "n_lines", F.round(F.coalesce("repeated_line_ratio", F.lit(0.0)), 6).alias("repeated_line_ratio"))


COVERAGE_SQL = f"""{PAGES_SQL},
tok AS (SELECT doc_id, {CHARS.format('native')} AS n, {CHARS.format('output')} AS o FROM pages),
nc AS (SELECT doc_id, t, count(*) AS n FROM (SELECT doc_id, unnest(n) AS t FROM tok) GROUP BY ALL),
oc AS (SELECT doc_id, t, count(*) AS o FROM (SELECT doc_id, unnest(o) AS t FROM tok) GROUP BY ALL),
m AS (SELECT doc_id, sum(least(n, coalesce(o, 0)))::BIGINT AS matched FROM nc LEFT JOIN oc USING (doc_id, t) GROUP BY doc_id),
cov AS (SELECT doc_id, coalesce(matched, 0) AS matched, len(n) AS n_native, len(o) AS n_output,
  CASE WHEN len(n) > 0 THEN coalesce(matched, 0) / len(n)::DOUBLE WHEN len(o) = 0 THEN 1.0 ELSE 0.0 END AS token_coverage FROM tok LEFT JOIN m USING (doc_id))"""


@query(f"WITH {COVERAGE_SQL} SELECT doc_id, matched, n_native, n_output, round(token_coverage, 6) AS token_coverage FROM cov")
def qlt_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = Q.coverage(pages(spark, sf_dir), ["doc_id"], T.char_tokens("native"), T.char_tokens("output"))
    return out.withColumn("token_coverage", F.round("token_coverage", 6))


METRICS_SQL = rf"""{COVERAGE_SQL},
lines AS (SELECT doc_id, sum(c - 1) / sum(c) AS rep FROM (SELECT doc_id, line, count(*) AS c FROM (SELECT doc_id, {C.TRIM.format('lower(x)')} AS line FROM (SELECT doc_id, unnest(string_split(output, chr(10))) AS x FROM pages)) WHERE line <> '' GROUP BY ALL) GROUP BY doc_id),
met AS (SELECT doc_id, length(regexp_replace(native, '\s+', '', 'g')) AS nch, length(regexp_replace(output, '\s+', '', 'g')) AS och,
  len(regexp_extract_all(native, '[0-9]+(?:[.,][0-9]+)?')) AS nnum, len(regexp_extract_all(output, '[0-9]+(?:[.,][0-9]+)?')) AS onum, token_coverage AS tc,
  CASE WHEN len({WORDS.format('output')}) > 0 THEN (len({WORDS.format('output')}) - len(list_distinct({WORDS.format('output')}))) / len({WORDS.format('output')})::DOUBLE ELSE 0 END AS dup, coalesce(rep, 0) AS rep
  FROM pages JOIN cov USING (doc_id) LEFT JOIN lines USING (doc_id)),
fl AS (SELECT doc_id, nch, och, nnum, onum, tc, dup, rep, och / nullif(nch, 0)::DOUBLE AS cr, onum / nullif(nnum, 0)::DOUBLE AS nr FROM met)"""
FLAG_LIST = """[CASE WHEN nch > 0 AND och <= 1 THEN 'near_empty' END, CASE WHEN nch > 0 AND (cr IS NULL OR cr < 0.5 OR tc < 0.5) THEN 'text_coverage_drop' END,
 CASE WHEN nnum > 0 AND (nr IS NULL OR nr < 0.5) THEN 'numeric_coverage_drop' END, CASE WHEN cr > 3.0 THEN 'abnormal_expansion' END, CASE WHEN dup > 0.4 OR rep > 0.4 THEN 'suspicious_repetition' END]"""


@query(f"""WITH {METRICS_SQL} SELECT doc_id, round(cr, 6) AS char_ratio, round(nr, 6) AS numeric_ratio, round(tc, 6) AS token_coverage, round(dup, 6) AS duplicate_token_ratio, round(rep, 6) AS repeated_line_ratio,
array_to_string(list_filter({FLAG_LIST}, lambda x: x IS NOT NULL), ',') AS flags, len(list_filter({FLAG_LIST}, lambda x: x IS NOT NULL)) = 0 AS passed FROM fl""")
def qlt_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = Q.assess(pages(spark, sf_dir), ["doc_id"], order=False)
    return out.select("doc_id", *[F.round(c, 6).alias(c) for c in ("char_ratio", "numeric_ratio", "token_coverage", "duplicate_token_ratio", "repeated_line_ratio")], F.array_join("flags", ",").alias("flags"), "passed")


@query()
def qlt_order_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matching blocks of each benchmark passage and itself without one letter, upper-cased; no SQL form."""
    rows = C.table(spark, sf_dir, "benchmark").select("item_id", T.char_tokens("text").alias("a"), T.char_tokens(F.expr("upper(replace(text, 'e', ''))")).alias("b"))
    return rows.select("item_id", F.round(Q.order_similarity("a", "b"), 6).alias("similarity"))


RESIDUAL_SQL = f"""{PAGES_SQL},
nt AS (SELECT doc_id, i, w[i] AS token FROM (SELECT doc_id, {WORDS.format('native')} AS w FROM pages), unnest(range(1, len(w) + 1)) AS t(i)),
nn AS (SELECT *, row_number() OVER (PARTITION BY doc_id, token ORDER BY i) AS nth FROM nt),
ot AS (SELECT doc_id, token, count(*) AS have FROM (SELECT doc_id, unnest({WORDS.format('output')}) AS token FROM pages) GROUP BY ALL),
res AS (SELECT doc_id, i, token FROM nn LEFT JOIN ot USING (doc_id, token) WHERE nth > coalesce(have, 0)),
agg AS (SELECT doc_id, count(*) AS tokens, sum(length(token))::BIGINT AS chars, md5(string_agg(token, ' ' ORDER BY i)) AS digest FROM res GROUP BY doc_id)"""


def _residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pages(spark, sf_dir)
    native = rows.select("doc_id", F.posexplode(T.word_tokens("native")).alias("i", "token"))
    output = rows.select("doc_id", F.explode(T.word_tokens("output")).alias("token"))
    left = Q.residual(native, output, ["doc_id"], "i")
    return left.groupBy("doc_id").agg(F.count("*").alias("tokens"), F.sum(F.length("token")).alias("chars"), F.array_sort(F.collect_list(F.struct("i", "token"))).alias("t")).select("doc_id", "tokens", "chars", F.md5(F.array_join(F.transform("t", lambda x: x["token"]), " ")).alias("digest"))


@query(f"WITH {RESIDUAL_SQL} SELECT * FROM agg")
def qlt_multiset_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _residual(spark, sf_dir)


@query(f"""WITH {RESIDUAL_SQL}, den AS (SELECT doc_id, count(*) AS n FROM nt GROUP BY doc_id)
SELECT doc_id, tokens, chars, n, round(tokens / n::DOUBLE, 6) AS ratio, tokens >= 30 AND chars >= 80 AND tokens / n::DOUBLE >= 0.35 AS is_significant, n >= 25 AND tokens >= 20 AND chars >= 60 AND tokens / n::DOUBLE >= 0.5 AS image_significant FROM agg JOIN den USING (doc_id)""")
def qlt_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = _residual(spark, sf_dir).join(pages(spark, sf_dir).select("doc_id", F.size(T.word_tokens("native")).alias("n")), "doc_id")
    t, c, n = F.col("tokens"), F.col("chars"), F.col("n")
    return left.select("doc_id", "tokens", "chars", "n", F.round(t / n, 6).alias("ratio"), Q.significant(t, c, n).alias("is_significant"), Q.significant(t, c, n, "image").alias("image_significant"))


BLOCK_TYPE = "CASE doc_id % 5 WHEN 0 THEN 'table' WHEN 1 THEN 'chart' WHEN 2 THEN 'image' WHEN 3 THEN 'list' ELSE 'text' END"
GATE_SQL = rf"""g AS (SELECT doc_id, source, {BLOCK_TYPE} AS block_type, length({C.TRIM.format('text')}) AS text_chars, doc_id % 7 <> 0 AS ok FROM documents),
gate AS (SELECT *, CASE WHEN block_type = 'text' THEN 'unsupported_block_type' WHEN NOT ok THEN 'invalid_bbox' WHEN text_chars < 128 THEN 'short_structured_text' ELSE 'structured_text_not_short' END AS reason FROM g)"""


def _gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh box is not ordered, so it is not valid."""
    docs = C.table(spark, sf_dir, "documents").withColumn("block_type", F.expr(BLOCK_TYPE))
    bbox = F.array(F.lit(0.1), F.lit(0.1), F.when(F.col("doc_id") % 7 == 0, 0.05).otherwise(0.9), F.lit(0.8))
    return docs.select("doc_id", "source", "block_type", Q.gate(F.col("block_type"), F.col("text"), bbox).alias("g")).select("doc_id", "source", "block_type", "g.*")


@query(f"WITH {GATE_SQL} SELECT doc_id, block_type, reason, reason = 'short_structured_text' AS trigger, text_chars FROM gate")
def qlt_vision_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gated(spark, sf_dir).select("doc_id", "block_type", "reason", "trigger", "text_chars")


@query(f"""WITH {GATE_SQL} SELECT block_type, source, count(*) AS blocks, count(*) FILTER (WHERE block_type <> 'text') AS eligible, count(*) FILTER (WHERE reason = 'short_structured_text') AS triggered FROM gate GROUP BY GROUPING SETS ((block_type), (source), ())""")
def evl_gate_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _gated(spark, sf_dir)
    sets = g.groupingSets([[F.col("block_type")], [F.col("source")], []], F.col("block_type"), F.col("source"))
    return sets.agg(F.count("*").alias("blocks"), F.count_if(F.col("block_type") != "text").alias("eligible"), F.count_if(F.col("trigger")).alias("triggered"))


# -- geometry: order lines as blocks of a page, orders as their page ---------------------------------

BLOCKS = "l_quantity * 10 AS x0, l_discount * 1000 + l_linenumber * 40 AS y0, l_quantity * 10 + 30 AS x1, l_discount * 1000 + l_linenumber * 40 + 12 AS y1"
BLOCKS_SQL = f"b AS (SELECT l_orderkey AS page, l_linenumber AS block, {BLOCKS} FROM (SELECT l_orderkey, l_linenumber, min(l_quantity) AS l_quantity, min(l_discount) AS l_discount FROM lineitem GROUP BY ALL))"
GAP = "greatest({a}x0 - {b}x1, {b}x0 - {a}x1, 0)"
DIST = "sqrt(pow(greatest(a.x0 - b.x1, b.x0 - a.x1, 0), 2) + pow(greatest(a.y0 - b.y1, b.y0 - a.y1, 0), 2))"


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").alias("l_quantity"), F.min("l_discount").alias("l_discount"))
    rows = rows.selectExpr("l_orderkey AS page", "l_linenumber AS block", *[x.strip() for x in BLOCKS.split(",")])
    return rows.select("page", "block", L.box("x0", "y0", "x1", "y1").alias("box"))


@query(f"""WITH {BLOCKS_SQL}, img AS (SELECT o_orderkey AS page, (o_orderkey % 200)::DOUBLE AS x0, 0.0 AS y0, (o_orderkey % 200 + 150)::DOUBLE AS x1, 120.0 AS y1 FROM orders)
SELECT b.page, b.block, count(img.page) > 0 AS in_image FROM b LEFT JOIN img ON b.page = img.page AND (b.x0 + b.x1) / 2 BETWEEN img.x0 AND img.x1 AND (b.y0 + b.y1) / 2 BETWEEN img.y0 AND img.y1 GROUP BY ALL""")
def lay_point_in_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 200
    images = C.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page"), L.box(k, F.lit(0), k + 150, F.lit(120)).alias("box"))
    return L.inside(blocks(spark, sf_dir), images).select("page", "block", "in_image")


@query(f"""WITH {BLOCKS_SQL} SELECT page, block, near_block, round(d, 6) AS distance FROM (SELECT a.page, a.block, b.block AS near_block, {DIST} AS d,
row_number() OVER (PARTITION BY a.page, a.block ORDER BY round({DIST}, 9), b.y0, b.x0, b.block) AS n FROM b a JOIN b ON a.page = b.page AND a.block <> b.block WHERE {DIST} <= 32) WHERE n = 1""")
def lay_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = blocks(spark, sf_dir)
    return L.nearest(b, b, distinct=True).select("page", "block", "near_block", F.round("distance", 6).alias("distance"))


ROWS_SQL = f"""{BLOCKS_SQL}, c AS (SELECT page AS table_id, block, x0 + 5 AS x0, y1 + 2 AS y0, x1 - 5 AS x1, y1 + 6 AS y1 FROM b),
r AS (SELECT page AS table_id, block AS row, x0, block * 100.0 AS y0, x1, block * 100.0 + 90 AS y1 FROM b),
cc AS (SELECT table_id, block, x0, block * 100.0 + 92 AS y0, x1, block * 100.0 + 97 AS y1 FROM c),
p AS (SELECT table_id, row, x0 AS ux0, y1 AS uy1, x1 AS ux1, lead(row) OVER w AS nxt, lead(x0) OVER w AS lx0, lead(y0) OVER w AS ly0, lead(x1) OVER w AS lx1 FROM r WINDOW w AS (PARTITION BY table_id ORDER BY row))"""


@query(f"""WITH {ROWS_SQL} SELECT table_id, block, row, round(y0 - uy1, 6) AS upper_gap, round(ly0 - y1, 6) AS lower_gap, round(hg, 6) AS horizontal_gap FROM (SELECT *, least(greatest(x0 - ux1, ux0 - x1, 0), greatest(x0 - lx1, lx0 - x1, 0)) AS hg,
row_number() OVER (PARTITION BY table_id, block ORDER BY row) AS n FROM cc JOIN p USING (table_id) WHERE nxt = row + 1 AND uy1 <= y0 AND y0 <= y1 AND y1 <= ly0 AND y0 - uy1 <= 10 AND ly0 - y1 <= 10 AND least(greatest(x0 - ux1, ux0 - x1, 0), greatest(x0 - lx1, lx0 - x1, 0)) <= 12) WHERE n = 1""")
def lay_adjacent_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = blocks(spark, sf_dir)
    y = F.col("block") * 100.0
    rows = b.select(F.col("page").alias("table_id"), F.col("block").alias("row"), L.box(F.col("box.x0"), y, F.col("box.x1"), y + 90).alias("box"))
    cand = b.select(F.col("page").alias("table_id"), "block", L.box(F.col("box.x0") + 5, y + 92, F.col("box.x1") - 5, y + 97).alias("box"))
    return L.between_rows(cand, rows).select("table_id", "block", "row", *[F.round(c, 6).alias(c) for c in ("upper_gap", "lower_gap", "horizontal_gap")])


@query(f"WITH {BLOCKS_SQL} SELECT page, round(min(x0), 6) AS x0, round(min(y0), 6) AS y0, round(max(x1), 6) AS x1, round(max(y1), 6) AS y1, round(greatest(max(x1) - min(x0), 0) * greatest(max(y1) - min(y0), 0) / (600.0 * 800.0), 6) AS area_ratio FROM b GROUP BY page")
def lay_union_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = L.union(blocks(spark, sf_dir), ["page"])
    return u.select("page", *[F.round(f"box.{c}", 6).alias(c) for c in ("x0", "y0", "x1", "y1")], F.round(L.area_ratio(F.col("box"), F.lit(600.0), F.lit(800.0)), 6).alias("area_ratio"))


@query("""WITH RECURSIVE p AS (SELECT p_partkey, p_size * 60.0 AS w, p_retailprice * 2.0 AS h FROM part),
it AS (SELECT p_partkey, w, h, 0.0::DOUBLE AS lo, 300.0::DOUBLE AS hi, 0 AS n FROM p UNION ALL
 SELECT p_partkey, w, h, CASE WHEN ok THEN mid ELSE lo END, CASE WHEN ok THEN hi ELSE mid END, n + 1 FROM (SELECT *, (lo + hi) / 2 AS mid, ceil(w * ((lo + hi) / 2) / 72.0) * ceil(h * ((lo + hi) / 2) / 72.0) <= 5e7 AND ceil(w * ((lo + hi) / 2) / 72.0) <= 30000 AND ceil(h * ((lo + hi) / 2) / 72.0) <= 30000 AS ok FROM it WHERE n < 50)),
f AS (SELECT *, ceil(w * 300 / 72.0) * ceil(h * 300 / 72.0) <= 5e7 AND ceil(w * 300 / 72.0) <= 30000 AND ceil(h * 300 / 72.0) <= 30000 AS all_ok FROM it WHERE n = 50)
SELECT p_partkey, CASE WHEN CASE WHEN all_ok THEN 300 ELSE lo END >= 72 THEN round(CASE WHEN all_ok THEN 300 ELSE lo END, 4) END AS dpi FROM f""")
def mth_safe_dpi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.table(spark, sf_dir, "part").select("p_partkey", F.round(L.safe_dpi(F.col("p_size") * 60.0, F.col("p_retailprice") * 2.0), 4).alias("dpi"))


@query("""WITH b AS (SELECT c_nationkey AS page, c_custkey AS band, c_mktsegment AS cell, (c_custkey % 97)::DOUBLE AS x FROM customer)
SELECT a.page, a.band AS first, b.band AS second, a.cell FROM b a JOIN b ON a.page = b.page AND a.cell = b.cell AND a.band < b.band AND abs(a.x - b.x) <= 20""")
def lay_repeated_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("page"), F.col("c_custkey").alias("band"), F.array("c_mktsegment").alias("cells"), F.array((F.col("c_custkey") % 97).cast("double")).alias("xs"))
    return L.repeated_headers(rows).select("page", "first", "second", F.get("cells", 0).alias("cell"))


@query()
def lay_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy bands over a moving reference; no SQL form."""
    return L.bands(blocks(spark, sf_dir), 20.0).select("page", "block", "band", "place")

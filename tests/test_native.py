"""Native page text against plain Python: offsets, joins of spans, occurrences and their evidence."""

import random
import re

import pytest
from pyspark.sql import functions as F

from docsift.operators import native as N
from docsift.storage import spread

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"


@pytest.fixture(scope="module")
def words(spark):
    rows = [(1, 0, 0, i, t, (i * 10.0, 0.0, i * 10.0 + 5, 8.0)) for i, t in enumerate(["Flow", "is", "12.5", "m/s", "and", "12.5", "ｍ３", "(≤", "4%)", "end"])]
    rows += [(1, 0, 1, 1, "second", (3.0, 9.0, 8.0, 12.0)), (1, 0, 1, 0, "中文字", (0.0, 9.5, 2.0, 11.0)), (2, 7, 3, 0, "only", (1.0, 1.0, 2.0, 2.0))]
    return spark.createDataFrame(rows, f"page bigint, block_no int, line_no int, word_no int, text string, box {BOX}")


def test_lines_of_words(words):
    spans = N.word_spans(words)
    lines = {r["block_id"]: r for r in N.page_blocks(spans).collect()}
    assert lines["p1-b0-l0"]["text"] == "Flow is 12.5 m/s and 12.5 ｍ３ (≤ 4%) end" and lines["p1-b0-l1"]["text"] == "中文字 second"
    assert tuple(lines["p1-b0-l1"]["box"]) == (0.0, 9.0, 8.0, 12.0) and lines["p2-b7-l3"]["n_words"] == 1
    for r in spans.collect():
        assert lines[r["block_id"]]["text"][r["char_start"] : r["char_end"]] == r["text"]


def test_occurrences_and_evidence(spark, words):
    spans = N.word_spans(words)
    blocks = N.page_blocks(spans)
    found = N.occurrences(blocks, spans)
    rows = sorted((r for r in found.collect() if r["block_id"] == "p1-b0-l0"), key=lambda r: r["nth"])
    line = "Flow is 12.5 m/s and 12.5 m3 (≤ 4%) end"
    assert [(r["token"], r["char_start"]) for r in rows] == [(m.group(), m.start()) for m in re.finditer(r"\w+(?:[.+/\-]\w+)*|[≤%]", line)]
    assert [r["word_no"] for r in rows] == [0, 1, 2, 3, 4, 5, 6, 7, 8, 8, 9] and all(r["reliable"] for r in rows)
    assert len({r["evidence_id"] for r in found.collect()}) == found.count()
    asked = spark.createDataFrame([(1, "p1-b0-l0", 0, 8, 16), (1, "p1-b0-l0", 1, 9, 16), (1, "p1-b0-l0", 2, 0, len(line)), (1, "none", 3, 0, 4)], "page bigint, block_id string, span_id int, char_start int, char_end int")
    ids = {r["span_id"]: r["evidence_ids"] for r in N.evidence_in_spans(found, asked).collect()}
    own = [r["evidence_id"] for r in rows]
    assert ids == {0: own[2:4], 1: own[3:4], 2: own, 3: []}
    shared = found.union(found.filter("nth = 2 AND block_id = 'p1-b0-l0'"))  # an identity that two occurrences share proves nothing
    assert {r["span_id"]: r["evidence_ids"] for r in N.evidence_in_spans(shared, asked).collect()}[0] == own[3:4]


def test_an_occurrence_across_words_is_not_reliable(spark):
    blocks = spark.createDataFrame([(1, "b", "a-b", (0.0, 0.0, 9.0, 9.0))], f"page bigint, block_id string, text string, box {BOX}")
    spans = spark.createDataFrame([(1, "b", 0, "a", (0.0, 0.0, 1.0, 1.0), 0, 1), (1, "b", 1, "-b", (1.0, 0.0, 2.0, 1.0), 1, 3)], f"page bigint, block_id string, word_no int, text string, box {BOX}, char_start int, char_end int")
    [r] = N.occurrences(blocks, spans).collect()
    assert (r["token"], r["word_no"], r["reliable"], tuple(r["box"])) == ("a-b", None, False, (0.0, 0.0, 9.0, 9.0))
    twice = spans.filter("word_no = 0").selectExpr("page", "block_id", "word_no", "'a-b' AS text", "box", "0 AS char_start", "3 AS char_end")
    assert [r["reliable"] for r in N.occurrences(blocks, twice).collect()] == [True] and [r["reliable"] for r in N.occurrences(blocks, twice.union(twice)).collect()] == [False]


@pytest.mark.parametrize("width", [1, 7, 64, 100_000])
def test_joins_of_spans(spark, width):
    r = random.Random(width)

    def spans(n, long):
        rows = []
        for i in range(n):
            a = r.randrange(200)
            rows.append((r.randrange(3), i, a, a + r.randrange(long)))
        return rows

    inner, outer = spans(150, 12), spans(120, 90)
    kind = "key int, n int, char_start int, char_end int"
    a, b = spark.createDataFrame(inner, kind), spark.createDataFrame(outer, kind)
    got = sorted((x["n"], x["outer_n"]) for x in N.within(a, b, ["key"], width).collect())
    assert got == sorted((i[1], o[1]) for i in inner for o in outer if i[0] == o[0] and o[2] <= i[2] and i[3] <= o[3])
    got = sorted((x["n"], x["outer_n"]) for x in N.overlapping(a, b, ["key"], width).collect())
    assert got == sorted((i[1], o[1]) for i in inner for o in outer if i[0] == o[0] and max(i[2], o[2]) < min(i[3], o[3]))
    plan = N.within(a, b, ["key"], width)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_tokens_of_lines_need_no_join(spark):
    """line_tokens() and line_blocks() equal the joins over the words of any line, and shuffle no words."""
    texts = ["a-b, c3 ", "ＡＢ　c　d 漢字x", "", "3.5% ≤7\x01z é́", "one", "... --"]
    rows = spark.createDataFrame([(p, 0, n, [w for w in t.split(" ") if w]) for p in (1, 2) for n, t in enumerate(texts)], "page long, block_no int, line_no int, texts array<string>")
    rows = rows.unionByName(rows.filter("page = 2 and line_no = 0").selectExpr("page", "block_no", "line_no", "array('again', 'x') texts"))
    lines = N.line_words(spread(rows, "page"), lambda no, text, line: F.struct((no * 40.0).alias("x0"), (line * 12.0).alias("y0"), (no * 40.0 + F.length(text) * 6).alias("x1"), (line * 12.0 + 10).alias("y1")))
    spans = N.word_spans(lines.select("page", "block_no", "line_no", F.inline("words")))
    blocks = N.page_blocks(spans)
    key = ["page", "block_id"]
    assert sorted(N.line_blocks(lines).collect(), key=str) == sorted(blocks.select(N.line_blocks(lines).columns).collect(), key=str)
    got = N.line_tokens(lines)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert sorted(got.collect(), key=str) == sorted(N.occurrences(blocks, spans).select(got.columns).collect(), key=str) != []
    proved = N.evidence_in_spans(got, blocks.select(*key, F.lit(0).alias("span_id"), F.lit(0).alias("char_start"), F.length("text").alias("char_end")))
    assert "hashpartitioning(evidence_id" not in proved._jdf.queryExecution().executedPlan().toString()


def test_parts_of_texts_follow_the_input(spark):
    """Parts were joined to 64 times the shuffle's least number, or four MB, whose words were sorted on disk."""
    plan = spread(spark.range(1 << 24), "id")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(id#\d+L?, (\d+)\)", plan).group(1) == str((8 << 24) // (1 << 19))


def test_references_without_a_semicolon_stay_as_the_sql_has_them(spark, tmp_path):
    import duckdb

    from docsift import registry

    pages = [(1, "<title>cut&amp</title><p>a &amp; b &lt;i&gt; &quot;&#39; &copy;&middot; &amp;lt; R&D &eacute; &#233; &ampx; &copy</p>"), (2, "<p>&</p>&<b>x;</b>"), (3, "plain")]
    spark.createDataFrame(pages, "page_id bigint, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = {r[0]: r[1] for r in con.execute(registry.ORACLES["htm_text"]).fetchall()}
    assert {r["page_id"]: r["text"] for r in registry.QUERIES["htm_text"](spark, str(tmp_path)).collect()} == want

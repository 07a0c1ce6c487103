import io
import json
import zipfile

import pytest

from docsift.sources import readers, sinks
from docsift.streaming import ingest


def test_markdown_folder(spark, tmp_path):
    (tmp_path / "b.md").write_text("# B\n\ntext")
    (tmp_path / "a.md").write_text("one\ntwo")
    (tmp_path / "c.txt").write_text("no")
    rows = readers.markdown(spark, str(tmp_path)).orderBy("source").collect()
    assert [(r["source"], r["text"]) for r in rows] == [("a.md", "one\ntwo"), ("b.md", "# B\n\ntext")]
    empty = tmp_path / "empty"
    empty.mkdir()
    with pytest.raises(FileNotFoundError):
        readers.markdown(spark, str(empty))


def test_page_extraction_is_cached_by_content(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.pdf").write_bytes(b"p1\fp2")
    (tmp_path / "in/copy.pdf").write_bytes(b"p1\fp2")
    extract = lambda raw: raw.decode().split("\f")
    for _ in range(2):
        rows = readers.cached_pages(spark, str(tmp_path / "in"), str(tmp_path / "cache"), extract, "v1").orderBy("source", "page").collect()
        assert [(r["source"], r["page"], r["text"]) for r in rows] == [("a.pdf", 1, "p1"), ("a.pdf", 2, "p2"), ("copy.pdf", 1, "p1"), ("copy.pdf", 2, "p2")]
    assert spark.read.parquet(str(tmp_path / "cache")).count() == 2


def test_parser_json_and_packages(spark, tmp_path):
    value = {"pages": [{"page_idx": 0, "blocks": [{"type": "text", "content": json.dumps([{"content": " hi "}, {"type": "table_body", "content": "no"}])}]}]}
    (tmp_path / "m.json").write_text(json.dumps(value))
    row = readers.parser_json(spark, str(tmp_path)).first()
    assert (row["page"], row["type"], row["block_index"], row["texts"]) == (1, "text", 0, ["hi"])
    inner, outer = io.BytesIO(), io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("out/middle.json", "{}")
    with zipfile.ZipFile(outer, "w") as z:
        z.writestr("nested.zip", inner.getvalue())
    (tmp_path / "p.zip").write_bytes(outer.getvalue())
    assert readers.parser_packages(spark, str(tmp_path)).first()["member"] == "out/middle.json"


def test_questions_and_missing_sources(spark, tmp_path):
    (tmp_path / "qa.json").write_text(json.dumps([{"question": "a", "expected_source": "x.pdf", "expected_keywords": ["k"]}, {"question": "b", "source": "y.pdf", "type": "table"}]))
    qa = readers.questions(spark, str(tmp_path / "qa.json"))
    assert [(r["qid"], r["expected_source"], r["keywords"], r["category"]) for r in qa.orderBy("qid").collect()] == [(1, "x.pdf", ["k"], "text"), (2, "y.pdf", [], "table")]
    chosen, missing = readers.referenced(spark.createDataFrame([("x.pdf",), ("z.pdf",)], "source string"), qa)
    assert [r["source"] for r in chosen.collect()] == ["x.pdf"] and [r["expected_source"] for r in missing.collect()] == ["y.pdf"]


def test_aliases():
    assert readers.parse_aliases(["S1=/a", "S2=/b"]) == {"S1": "/a", "S2": "/b"}
    with pytest.raises(ValueError):
        readers.parse_aliases(["S1=/a", "S1=/b"])


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 'Authorization: Bearer abcdefghijk "api_key": "zzzzzzzz"')], "i int, t string")
    sinks.events(df, str(tmp_path / "log"))
    sinks.events(df, str(tmp_path / "log"))
    rows = spark.read.json(str(tmp_path / "log")).collect()
    assert len(rows) == 2 and "abcdefghijk" not in rows[0]["t"] and "zzzzzzzz" not in rows[0]["t"]
    sinks.result(df, str(tmp_path / "r"))
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.result(df, str(tmp_path / "r"))
    with pytest.raises(ValueError):
        sinks.guarded(df, "/elsewhere/x", str(tmp_path))
    sinks.review_sheet(df, str(tmp_path / "csv"))
    assert readers.reviews(spark, str(tmp_path / "csv")).first()["t"] == df.first()["t"]
    assert "| 1 |" in sinks.report(df, "T", str(tmp_path / "md"))


def test_incremental_chunks(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs.filter("doc_id < 50").write.parquet(str(tmp_path / "in"))
    ingest.ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"))
    docs.filter("doc_id >= 50").write.mode("append").parquet(str(tmp_path / "in"))
    ingest.ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"))
    from docsift.operators import chunking

    assert spark.read.parquet(str(tmp_path / "out")).count() == chunking.chunk(docs.select("doc_id", "text")).count()

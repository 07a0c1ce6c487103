import math

import pytest
from pyspark.sql import functions as F

from docsift.functions import text as T
from docsift.operators import chunking, retrieval


def chunks(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "position bigint, text string")


def queries(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "qid bigint, query string")


def found(df):
    return [(r["position"], r["score"]) for r in df.orderBy("qid", "rank").collect()]


def test_bm25_analytic_value_and_repeated_query_terms(spark):
    index = retrieval.build(chunks(spark, ["a a b", "b"]))
    want = math.log(2) * (2 * 2.2) / (2 + 1.2 * (0.25 + 0.75 * 3 / 2))
    assert found(retrieval.bm25(index, queries(spark, "a"))) == [(0, round(want, 6))]
    assert found(retrieval.bm25(index, queries(spark, "a a"))) == [(0, round(want, 6))]


def test_identifiers_stay_whole_and_unknown_words_find_nothing(spark):
    index = retrieval.build(chunks(spark, ["P-1010", "P-101"]))
    assert [p for p, _ in found(retrieval.bm25(index, queries(spark, "P-101")))] == [1]
    assert found(retrieval.bm25(index, queries(spark, "nothing", "?!"))) == []
    assert found(retrieval.bm25(retrieval.build(chunks(spark, ["x"]).filter("false")), queries(spark, "x"))) == []


def test_ties_keep_corpus_order(spark):
    index = retrieval.build(chunks(spark, ["z", "same text", "same text"]))
    assert [p for p, _ in found(retrieval.bm25(index, queries(spark, "same")))] == [1, 2]


def test_tokens_with_cjk_and_dashes(spark):
    row = spark.createDataFrame([("型号 AB–12/3 x.y Straße",)], "t string").select(T.tokens("t").alias("a"), T.token_list(T.casefold_nfkc("t")).alias("b")).first()
    assert row["a"] == ["型", "号", "型号", "ab-12/3", "x.y", "strasse"]
    assert row["b"] == row["a"]


def test_both_tokenisers_agree_on_the_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert docs.filter(T.tokens("text") != T.token_list(T.casefold_nfkc("text"))).count() == 0


def test_rrf_values_duplicates_and_dense_first_ties(spark):
    rows = lambda items: spark.createDataFrame([(0, i + 1, p, 1.0) for i, p in enumerate(items)], "qid bigint, rank int, position bigint, score double")
    out = retrieval.rrf({"dense": rows([5]), "bm25": rows([5, 6])}).orderBy("rank").collect()
    assert [(r["position"], r["score"]) for r in out] == [(5, round(2 / 61, 9)), (6, round(1 / 62, 9))]
    out = retrieval.rrf({"dense": rows([7, 7, 8]), "bm25": rows([9])}).orderBy("rank").collect()
    assert [(r["position"], r["dense_rank"], r["bm25_rank"]) for r in out] == [(7, 1, None), (9, None, 1), (8, 2, None)]


def test_dense_is_exact_and_zero_vectors_score_zero(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [-1.0, 0.0])], "position bigint, embedding array<float>")
    q = spark.createDataFrame([(0, [2.0, 0.0]), (1, [0.0, 0.0])], "qid bigint, embedding array<float>")
    out = retrieval.dense(v, q, 4, block=1).orderBy("qid", "rank").collect()
    assert [(r["qid"], r["position"], r["score"]) for r in out][:4] == [(0, 0, 1.0), (0, 1, 1.0), (0, 2, 0.0), (0, 3, -1.0)]
    assert {r["score"] for r in out if r["qid"] == 1} == {0.0}
    row = v.crossJoin(q).filter("position = 3 and qid = 0").select(retrieval.cosine(v["embedding"], q["embedding"]).alias("c")).first()
    assert row["c"] == -1.0


def test_rerank_orders_by_score_then_input(spark):
    rows = spark.createDataFrame([(0, 1, "q", "bb"), (0, 2, "q", "aa"), (0, 3, "q", "ccc")], "qid bigint, rank int, query string, text string")
    out = retrieval.rerank(rows, lambda q, t: F.length(t), 2).orderBy("rank").collect()
    assert [r["text"] for r in out] == ["ccc", "bb"]


@pytest.mark.parametrize("n", [499, 500, 501, 920, 921, 1340, 1341, 5000])
def test_windows_equal_the_stated_loop(spark, n):
    starts, at = [], 0
    while True:
        starts.append(at)
        if min(at + 500, n) == n:
            break
        at = min(at + 500, n) - 80
    got = spark.range(1).select(chunking.window_starts(F.lit(n)).alias("s")).first()["s"]
    assert got == (starts if n > 500 else [0])


def test_chunks_restart_per_document_and_overlap_is_checked(spark):
    docs = spark.createDataFrame([(1, "# A\nx\n\n \n\ny\n## B\n" + "w" * 600), (2, "  "), (3, None), (4, "z")], "doc_id bigint, text string")
    rows = [(r["doc_id"], r["chunk_id"], r["text"][:4]) for r in chunking.chunk(docs).orderBy("position").collect()]
    assert rows == [(1, 0, "# A\n"), (1, 1, "y"), (1, 2, "## B"), (1, 3, "w" * 4), (4, 0, "z")]
    with pytest.raises(ValueError):
        chunking.chunk(docs, overlap=500)


def test_repartitioning_changes_nothing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    one = chunking.chunk(docs.select("doc_id", "text")).select(F.sum(F.xxhash64("position", "text").cast("decimal(38,0)"))).first()[0]
    assert chunking.chunk(docs.repartition(7).select("doc_id", "text")).select(F.sum(F.xxhash64("position", "text").cast("decimal(38,0)"))).first()[0] == one


def test_scoped_search_and_its_status(spark):
    rows = spark.createDataFrame([(0, "a", "red pump"), (1, "b", "red valve"), (2, "a", "blue pump")], "position bigint, source string, text string")
    ask = spark.createDataFrame([(1, "red", ["a"]), (2, "red", None), (3, "red", ["a", "a"]), (4, " ", ["a"]), (5, "red", ["z"]), (6, "x" * 4001, None)], "qid bigint, query string, scopes array<string>")
    out = {r["qid"]: r for r in retrieval.search(rows, ask, ["a", "b", "c"], score=lambda q, t: -F.length(t)).collect()}
    assert [out[i]["status"] for i in range(1, 7)] == ["ok", "ok", "invalid_scope", "error", "invalid_scope", "error"]
    assert {x["position"] for x in out[1]["results"]} == {0, 2} and [x["position"] for x in out[2]["results"]] == [0, 1, 2]
    none = retrieval.search(rows, spark.createDataFrame([(1, "red", ["c"])], "qid bigint, query string, scopes array<string>"), ["a", "b", "c"]).first()
    assert (none["status"], none["results"]) == ("no_evidence", [])


@pytest.mark.parametrize("kind", ["bm25", "hybrid", "search", "arms"])
def test_chunks_are_cut_and_told_apart_once(spark, kind):
    """Each row's text is asked for once, whatever the number of arms, scopes and passes over its tokens."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def text(t):
        seen.add(1)
        return t

    rows = spark.createDataFrame([(i, f"s{i % 2}", f"word{i % 5} same") for i in range(40)], "position bigint, source string, text string")
    rows, ask = rows.withColumn("text", text.asNondeterministic()("text")), queries(spark, "word1 same", "word3")
    if kind == "bm25":
        out = retrieval.bm25(retrieval.build(rows), ask)
    elif kind == "hybrid":
        out = retrieval.hybrid(rows, ask)
    elif kind == "search":
        out = retrieval.search(rows, ask.withColumn("scopes", F.expr("CASE qid WHEN 0 THEN array('s0') END")), ["s0", "s1"])
    else:
        out = retrieval.arms(rows, ask, lambda q, t: F.length(t))
    assert out.count() and seen.value == 40

import pytest
from pyspark.sql import functions as F

from docsift.operators import agent, chunking, evaluate, evidence, fields, inventory, layout, quality, retrieval, routing

ID = "source string, page int, block_type string, block_index bigint"


def test_expand_statuses_and_table_boundaries(spark):
    table = "h1 | h2\na | b\nlong row one | x\nlong row two | y"
    parents = spark.createDataFrame(
        [("s", 1, "table", 1, table), ("s", 1, "text", 2, "x" * 300 + "CHILD" + "y" * 300), ("s", 1, "text", 3, "dup dup"), ("s", 1, "text", 4, "p"), ("s", 1, "text", 4, "q")], f"{ID}, text string"
    )
    kids = spark.createDataFrame(
        [("s", 1, "table", 1, 0, "row one | x\nlong row"), ("s", 1, "text", 2, 1, "CHILD"), ("s", 1, "text", 3, 2, "dup"), ("s", 1, "text", 4, 3, "p"), ("s", 1, "text", 9, 4, "z"), ("s", None, "text", 2, 5, "CHILD"), ("s", 1, "text", 2, 6, "absent"), ("s", 1, "text", 2, 7, "k" * 900)],
        f"{ID}, chunk_id int, text string",
    )
    rows = evidence.attach_parents(kids, parents).withColumn("query", F.lit("q"))
    out = {r["chunk_id"]: r for r in evidence.expand(rows, lambda q, t: F.length(q) + F.length(t) + 3).collect()}
    assert [out[i]["status"] for i in range(8)] == ["EXPANDED", "EXPANDED", "AMBIGUOUS_CHILD", "AMBIGUOUS_PARENT", "MISSING_PARENT", "INCOMPLETE_IDENTITY", "CHILD_NOT_FOUND", "CHILD_OVER_BUDGET"]
    assert out[0]["row_indices"] == [2, 3] and out[0]["context_type"] == "table_boundary_rows"
    assert out[0]["expanded"] == "[Table leading context]\nh1 | h2\na | b\nlong row one | x\n\n[Complete boundary rows]\nlong row one | x\nlong row two | y\n\n[Retrieved child]\nrow one | x\nlong row"
    assert out[1]["expanded"].startswith("[Parent neighborhood]\n" + "x" * 120 + "CHILD" + "y" * 120 + "\n\n")
    small = evidence.expand(rows.filter("chunk_id = 1"), lambda q, t: F.length(q) + F.length(t) + 3, 100).first()
    assert small["status"] == "CONTEXT_BUDGET_EXCEEDED" and small["expanded"] == "CHILD"


def test_lookup_window_and_overlapping_child(spark):
    rows = spark.createDataFrame([("a" * 1500 + "B" + "c" * 1500, "B"), ("aaa", "aa"), ("short B", "B")], "parent_text string, text string")
    out = evidence.lookup(rows).collect()
    assert (out[0]["offset"], len(out[0]["looked_up"]), out[0]["context_kind"], out[0]["truncated"]) == (1001, 2000, "parent_neighborhood", True)
    assert (out[1]["offset"], out[1]["context_kind"]) == (None, "child_only")
    assert (out[2]["offset"], out[2]["context_kind"], out[2]["truncated"]) == (0, "original_block", False)


def test_references(spark):
    rows = spark.createDataFrame([("One. Two. Three child here. Four.", "child", "text", None), ("h\nr1\nr2", "r2", "table", [0]), ("x x", "x", "text", None)], "parent_text string, text string, block_type string, table_header_rows array<int>")
    out = [r["span"] for r in evidence.references(rows).collect()]
    assert [s["kind"] for s in out] == ["text_context", "table_rows_with_header", "child_only_ambiguous"]
    assert out[0]["excerpt"] == " Two. Three child here." and out[1]["excerpt"] == "h\nr2"
    assert [(r["start"], r["stop"]) for r in out[1]["ranges"]] == [(0, 2), (5, 7)]


def test_reference_bounds(spark):
    far, lines = "x" * 300, "\n".join(f"row {i} " + "c" * 40 for i in range(60))
    rows = spark.createDataFrame(
        [(far + "CHILD" + far, "CHILD", "text", None), ("一。二！ 三 child 四？\n五", "child", "text", None), (lines, lines[100:1300], "table", None), (lines, "row 5 ", "table", [0, 1]), (lines, "row 7 ", "table", None), (None, "a", "text", None), ("p", "q" * 1300, "text", None), ("absent", "", "table", None)],
        "parent_text string, text string, block_type string, table_header_rows array<int>",
    )
    out = [r["span"] for r in evidence.references(rows).collect()]
    assert [s and s["kind"] for s in out] == ["text_context", "text_context", "child_only_row_too_long", "table_rows_with_header", "table_rows", None, "child_over_bound", "child_only_ambiguous"]
    assert out[0]["excerpt"] == "x" * 200 + "CHILD" + "x" * 200 and out[1]["excerpt"] == "二！ 三 child 四？\n" and out[6]["excerpt"] is None
    assert out[3]["excerpt"].splitlines() == [lines.splitlines()[i] for i in (0, 1, 5)] and out[4]["excerpt"] == lines.splitlines()[7] + "\n"


def test_null_hits_are_no_misses_and_evidence_does_not_join_chunks(spark):
    qa = spark.createDataFrame([(1, "q", "s", None, ["red car"], "text", False), (2, "q", None, None, [], "text", False)], "qid bigint, question string, expected_source string, expected_page int, keywords array<string>, category string, review_required boolean")
    res = spark.createDataFrame([("a", 1, 1, "s", 1, "a red"), ("a", 1, 2, "s", 1, "car"), ("a", 1, 3, "t", 1, "red  CAR")], "arm string, qid bigint, rank int, source string, page int, text string")
    rows = {r["qid"]: r for r in evaluate.cases(res, qa, ["a"]).collect()}
    assert rows[1]["normalized_keyword_hit"] is False and rows[1]["top1_source_hit"] is True and rows[1]["top1_page_hit"] is None
    assert all(rows[2][h] is None for h in evaluate.HITS)
    s = evaluate.summary(evaluate.cases(res, qa, ["a"]), ["arm"]).first()
    assert (s["top1_source_hits"], s["top1_source_hit_total"], s["total"]) == (1, 1, 2)


def test_diagnosis_layers(spark):
    qa = spark.createDataFrame(
        [(1, "q", "s", None, ["gone"], "t", False), (2, "q", "s", None, ["cut in two"], "t", False), (3, "q", "s", None, ["deep"], "t", False), (4, "q", "s", None, ["never"], "t", False), (5, "q", "x", None, ["a"], "t", True)],
        "qid bigint, question string, expected_source string, expected_page int, keywords array<string>, category string, review_required boolean",
    )
    docs = spark.createDataFrame([("s", 1, "cut in two deep never")], "source string, page int, text string")
    chunks = spark.createDataFrame([("s", 1, "cut in"), ("s", 1, "two deep"), ("s", 1, "never")], "source string, page int, text string")
    res = spark.createDataFrame([("a", 3, i, "t", 1, "no") for i in range(1, 5)] + [("a", 3, 5, "s", 1, "two deep")] + [("a", q, 1, "t", 1, "no") for q in (1, 2, 4)], "arm string, qid bigint, rank int, source string, page int, text string")
    rows = evaluate.diagnose(evaluate.cases(res, qa, ["a"]), docs, chunks, qa).collect()
    assert {r["qid"]: r["error_layer"] for r in rows} == {1: "PARSING", 2: "CHUNKING", 3: "RANKING", 4: "RETRIEVAL", 5: "GT_UNCERTAIN"}


def test_flags_and_multiset_residual(spark):
    pages = spark.createDataFrame([(1, "abc 12", ""), (2, "abcdef 1.5", "abcdef 1.5"), (3, "", "x"), (4, "aab", "aabaabaabaab")], "id int, native string, output string")
    out = {r["id"]: r["flags"] for r in quality.assess(pages, ["id"]).collect()}
    assert out[1] == ["near_empty", "text_coverage_drop", "numeric_coverage_drop"] and out[2] == [] and out[3] == [] and "abnormal_expansion" in out[4]
    n = spark.createDataFrame([(1, "a", 0), (1, "b", 1), (1, "a", 2)], "k int, token string, i int")
    o = spark.createDataFrame([(1, "a")], "k int, token string")
    assert [(r["token"], r["i"]) for r in quality.residual(n, o, ["k"], "i").orderBy("i").collect()] == [("b", 1), ("a", 2)]


def test_bands_against_a_plain_loop(spark):
    import random

    random.seed(3)
    boxes = [(p, b, random.uniform(0, 100), (y := random.uniform(0, 200)), 100.0, y + random.uniform(2, 30)) for p in range(4) for b in range(25)]
    df = spark.createDataFrame(boxes, "page int, block int, x0 double, y0 double, x1 double, y1 double").select("page", "block", layout.box("x0", "y0", "x1", "y1").alias("box"))
    got = {(r["page"], r["block"]): r["band"] for r in layout.bands(df, 8.0).collect()}
    for p in range(4):
        band, low, high = -1, 0, 0
        for _, b, x0, y0, x1, y1 in sorted((x for x in boxes if x[0] == p), key=lambda x: ((x[3] + x[5]) / 2, x[2])):
            if band < 0 or (y0 + y1) / 2 - (low + high) / 2 > 8.0:
                band, low, high = band + 1, y0, y1
            else:
                low, high = min(low, y0), max(high, y1)
            assert got[p, b] == band


def test_actions_duplicate_keys_and_nan(spark):
    raw = ['{"action":"LOOKUP","evidence_id":"a","evidence_id":"b"}', '{"action":"LOOKUP","evidence_id":NaN}', '{"action":"LOOKUP","evidence_id":"a"}', "[]", None]
    out = [r["violation"] for r in agent.validate_actions(spark.createDataFrame([(i, x) for i, x in enumerate(raw)], "i int, raw string")).orderBy("i").collect()]
    assert out == ["invalid_json", "invalid_json", None, "unexpected_fields", "invalid_json"]


def test_fields_routing_patch_and_cache(spark):
    rows = spark.createDataFrame([("A0", "AO", True), ("A0", "AO", False), ("l1", "11", True), ("x", None, True)], "a string, b string, u boolean")
    out = [r["c"]["comparison"] for r in rows.select(fields.check(F.col("a"), F.col("b"), F.lit("identifier"), F.lit(True), F.col("u")).alias("c")).collect()]
    assert out == ["unique_native_o_zero_candidate", "confusable_without_deterministic_resolution", "confusable_without_deterministic_resolution", "native_text_missing"]
    att = spark.createDataFrame([(1, 1, "fast", True, ["x"]), (2, 1, "fast", False, ["y"]), (2, 2, "ocr", True, []), (3, 1, "fast", False, ["z"])], "page int, attempt int, profile string, passed boolean, flags array<string>")
    assert [(r["decision"], r["profile"], r["attempts_used"]) for r in routing.route(att, ["page"]).orderBy("page").collect()] == [("ACCEPT", "fast", 1), ("FALLBACK", "ocr", 2), ("REVIEW_REQUIRED", None, 1)]
    base = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    edits = spark.createDataFrame([(1, "a", "A"), (2, "zzz", "B")], "k int, before string, after string")
    done, conflicts = inventory.patch(base, edits, ["k"], "v")
    assert sorted(map(tuple, done.collect())) == [(1, "A"), (2, "b")] and conflicts.first()["k"] == 2


def test_compatibility_characters_keywords_and_large_ids(spark):
    from docsift.functions import text as T
    from docsift.operators import chunking

    rows = spark.createDataFrame([("Ｐ１０１ ﬁne ﬃ",), ("Straße P‑1",), ("İ Σς ſ",), (None,), ("",)], "t string").select(T.tokens("t").alias("t")).collect()
    assert [r["t"] for r in rows[:2]] == [["p101", "fine", "ffi"], ["strasse", "p-1"]] and rows[3]["t"] is None and rows[4]["t"] == []
    data = "see DATA:image/png;base64,AAAA== and base64,QUJD\r\n\r\n\r\nend\u200b\x07 x \t y"
    assert spark.createDataFrame([(data,)], "t string").select(T.readable("t")).first()[0] == "see and\n\n\nend x y"
    words = [f"k{i:02}x" for i in range(70)]
    qa = spark.createDataFrame([(1, None, None, words), (2, "s", None, [*words, "absent"]), (3, None, None, [])], "qid bigint, expected_source string, expected_page int, keywords array<string>")
    texts = spark.createDataFrame([("s", 1, " ".join(words[:40])), ("s", 2, " ".join(words[40:]))], "source string, page int, text string")
    assert {r["qid"]: (r["d_in_scope"], r["d_evidence"]) for r in evaluate.evidence_in(texts, qa, "d").collect()} == {1: (True, True), 2: (True, False), 3: (True, True)}
    docs = spark.createDataFrame([(9 * 10**18, "one text"), (7, "two texts")], "doc_id bigint, text string")
    at = {r["doc_id"]: r["position"] for r in chunking.chunk(docs.filter("doc_id = 7")).collect()}
    assert at == {7: 7_000_000}
    with pytest.raises(Exception, match="numbered=True"):
        chunking.chunk(docs).collect()
    many = spark.createDataFrame([(-(9 * 10**18), "# a\n\nb\n\nc"), (9 * 10**18, "one text"), (7, "two\n\ntexts")], "doc_id bigint, text string")
    assert [(r["position"], r["doc_id"], r["chunk_id"]) for r in chunking.chunk(many, numbered=True).orderBy("position").collect()] == [(0, -(9 * 10**18), 0), (1, -(9 * 10**18), 1), (2, -(9 * 10**18), 2), (3, 7, 0), (4, 7, 1), (5, 9 * 10**18, 0)]


def test_rows_without_an_embedding_take_no_part(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0, 1.0])], "position bigint, embedding array<float>")
    asked = spark.createDataFrame([(7, [1.0, 0.0]), (8, None)], "qid bigint, embedding array<float>")
    assert [(r["qid"], r["position"], r["score"]) for r in retrieval.dense(rows, asked, 5).orderBy("qid", "rank").collect()] == [(7, 1, 1.0), (7, 4, 0.707107), (7, 3, 0.0)]


def test_a_reference_is_never_longer_than_the_bound(spark):
    parent = "x" * 300 + "w " * 575 + "y" * 300
    rows = spark.createDataFrame([("text", "w " * 574 + "w", parent), ("text", "w" * 100, "a" * 300 + "w" * 100 + "b" * 300), ("text", "z" * 1201, "z" * 1201)], "block_type string, text string, parent_text string")
    out = evidence.references(rows).collect()
    assert [r["span"]["kind"] for r in out] == ["context_over_bound", "text_context", "child_over_bound"]
    assert all(r["span"]["excerpt"] is None or len(r["span"]["excerpt"]) <= evidence.REFERENCE_CHARS for r in out)


def test_ordinals_agree_wherever_they_are_computed(spark):
    rows = spark.range(20_000).selectExpr("(id * 7919) % 20011 - 5000 AS a", "CASE WHEN id % 50 = 0 THEN NULL ELSE concat('x', id % 7) END AS b", "id")
    one = chunking.ordinals(rows, ["b", "a"], parts=9)
    again = chunking.ordinals(rows.select("a", "b"), ["b", "a"], parts=9).withColumnRenamed("ordinal", "o")
    want = sorted((tuple(r) for r in rows.select("b", "a").collect()), key=lambda r: (r[0] is not None, r[0] or "", r[1]))
    assert [(r["b"], r["a"]) for r in one.orderBy("ordinal").collect()] == want and one.selectExpr("min(ordinal)", "max(ordinal)", "count(DISTINCT ordinal)").first()[:] == (0, 19_999, 20_000)
    assert one.join(again, ["a"]).filter("ordinal <> o").count() == 0
    assert chunking.ordinals(rows.limit(0), ["a"]).count() == 0 and chunking.ordinals(rows.limit(1), ["a"], parts=5).first()["ordinal"] == 0


def _told(parent, child):
    """The sentences around a child by a plain loop over the whole parent."""
    import re

    start = parent.find(child)
    end, marks = start + len(child), [m.span() for m in re.finditer(r"[。！？!?；;][\s\x1c-\x1f\x85]*|\n+|\.(?=[\s\x1c-\x1f\x85])", parent)]
    low, high = max(0, start - 200), min(len(parent), end + 200)
    ahead = [to for _, to in marks if to <= start]
    stop = next((to for at, to in marks if end <= at < high), high)
    return (ahead[-2] if len(ahead) > 1 and ahead[-2] >= low else low, stop)


def test_references_do_not_read_a_long_parent_for_each_child(spark):
    import random
    import time

    rng, rows = random.Random(5), []
    for i in range(120):
        bits = lambda n: "".join(rng.choice(["a", "é", ".", ". ", "? ", "\n", " ", "；", "! \n\n", " " * 90, "　", "word" * 9]) for _ in range(n))
        rows.append((i, bits(rng.choice([0, 3, 40])) + f"<{i}>" + bits(rng.choice([0, 2, 40])), f"<{i}>"))
    rows.append((900, "x?" + " " * 250 + "<900>" + "y" * 199 + "?" + " \n" * 100 + "z.", "<900>"))
    rows.append((901, "q. x." + " " * 199 + "<901>" + "y" * 199 + ". z", "<901>"))
    frame = spark.createDataFrame(rows, "i int, parent_text string, text string").withColumn("block_type", F.lit("text"))
    told = {r["i"]: r["span"]["ranges"][0] for r in evidence.references(frame).filter("span.ranges is not null").collect()}
    assert len(told) > 100 and all(tuple(told[i]) == _told(p, c) for i, p, c in rows if i in told)
    # 200 children of one parent of 440,000 characters: each cut to the whole parent's sentences took far longer
    parent = ". ".join(f"<{i}>" + " Some words here." * 129 for i in range(200))
    kids, whole = spark.range(200).selectExpr("concat('<', id, '>') AS text"), spark.createDataFrame([(parent, "text")], "parent_text string, block_type string")
    began = time.time()
    found = [r["context_chars"] for r in evidence.references(kids.crossJoin(F.broadcast(whole))).select("context_chars").collect()]
    assert len(found) == 200 and all(0 < n <= 400 for n in found)
    assert time.time() - began < 15

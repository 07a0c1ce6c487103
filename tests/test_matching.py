"""Term groups and critical tokens on literals."""

import pytest
from pyspark.sql import functions as F

from docsift.operators import matching as M


@pytest.mark.parametrize(
    "text, groups, units, want",
    [
        ("pressure 12 MPa", [["12"], ["pressure", "force"]], False, True), ("pressure 112 MPa", [["12"]], False, False), ("12.5", [["12"]], False, False), ("no. 12", [["12"]], False, False),
        ("no 12.", [["12"]], False, False), ("3 × 4", [["3x4"]], False, True), (r"3 \times 4", [["3x4"]], False, True), ("13x4", [["3x4"]], False, False), ("m²", [["m2"]], True, True),
        ("5 m", [["m"]], True, True), ("5 mm", [["m"]], True, False), ("5 m2", [["m"]], True, False), ("5 mm", [["m"]], False, True), ("ＡＢＣ １２", [["abc"], ["12"]], False, True),
        ("a_b {c}", [["abc"]], False, True), ("x", [["y"], ["x"]], False, False), ("x", [["y", "x"]], False, True), ("x", [], False, None), ("x", None, False, None), ("c++ (v)", [["c++(v)"]], False, True),
    ],
)
def test_aligned(spark, text, groups, units, want):
    df = spark.createDataFrame([(text, groups)], "t string, g array<array<string>>").withColumn("n", M.alignment_normal("t"))
    assert df.select(M.aligned(F.col("n"), F.transform("g", lambda g: F.transform(g, lambda t: F.replace(t, F.lit(" "), F.lit("")))), units).alias("x")).first()["x"] is want


def test_review(spark):
    terms = spark.createDataFrame([(1, "field", 0, "Flow"), (1, "field", 0, "rate"), (1, "unit", 0, "mm"), (1, "condition", 0, "12"), (2, "unit", 0, "kg")], "item_id int, kind string, group_no int, term string")
    rows = [
        (1, "flow 12 mm", "a", 3, "a", True, True, "RELEVANT"), (1, "flow 12 cm", "a", 3, "a", True, True, "PARTIAL"), (1, "rate 112 mm", "a", 3, "a", True, True, "PARTIAL"), (1, "speed 12 mm", "a", 3, "a", True, True, "IRRELEVANT"),
        (1, "flow 12 mm", "b", 3, "a", True, True, "IRRELEVANT"), (1, "flow 12 mm", "a", 4, "a", True, True, "IRRELEVANT"), (1, "flow 12 mm", None, None, "a", True, True, "IRRELEVANT"), (1, "flow 12 mm", "a", 3, "a", True, False, "IRRELEVANT"),
        (1, "flow 12 mm", "a", 3, "a", False, True, "UNCERTAIN"), (1, "flow 12 mm", "a", 3, "a", True, None, "UNCERTAIN"), (1, "flow 12 mm", "a", 3, "a", None, True, "UNCERTAIN"), (2, "5 kg", "a", 3, "a", True, True, "UNCERTAIN"),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "n int, item_id int, quote string, evidence_source string, evidence_page int, scope string, reviewed boolean, expected_available boolean, want string")
    out = M.review(df.join(M.term_groups(terms), "item_id").withColumn("pages", F.array(F.lit(3))))
    assert [r["label"] for r in out.orderBy("n").collect()] == [r[-1] for r in rows]


def analysed(spark, output, fields):
    cases = spark.createDataFrame([(1, output)], "case int, output string")
    return M.analyse(cases, spark.createDataFrame([(1, f) for f in fields], "case int, field string"), ["case"]).first()


@pytest.mark.parametrize(
    "output, fields, counts, hits",
    [
        ("A01; value 0.82 MPa", ["A01", "0.82 MPa"], (2, 2, 3, 3), (True, True)), ("A01; value 0.32 MPa", ["A01", "0.82 MPa"], (2, 1, 3, 2), (False, False)), ("166", ["66"], (1, 1, 1, 0), (True, False)),
        ("2L45x4", ["2L45x4"], (1, 1, 1, 1), (True, True)), ("2L45x6", ["2L45x4"], (1, 0, 1, 0), (False, False)), ("0.82MPa", ["0.82 MPa"], (1, 1, 2, 2), (True, True)), ("-0.82MPa", ["-0.82 MPa"], (1, 1, 2, 2), (True, True)),
        ("0.82MPa", ["-0.82 MPa"], (1, 0, 2, 1), (False, False)), ("-5kg", ["-5kg"], (1, 1, 2, 2), (True, True)), ("10x20mm", ["10x20mm"], (1, 1, 3, 3), (True, True)), ("20 ℃", ["20℃", "20 °C"], (2, 2, 2, 2), (True, True)),
        ("", [" ", "x"], (1, 0, 0, 0), (False, False)), (None, [], (0, 0, 0, 0), (False, False)),
    ],
)
def test_critical_tokens(spark, output, fields, counts, hits):
    r = analysed(spark, output, fields or ["  "])
    assert (r["expected_fields"], r["matched_fields"], r["expected_tokens"], r["matched_tokens"]) == counts and (r["normalized_hit"], r["strict_hit"]) == hits


def test_numbers_next_to_others(spark):
    """A number is seen in its context, also right behind another one."""
    rows = spark.createDataFrame([(1, "5-3 7 -2, v1.2 (4)")], "k int, field string")
    assert {(r["kind"], r["token"]) for r in M.critical_tokens(rows, ["k"]).collect()} == {("number", "5"), ("number", "7"), ("number", "-2"), ("number", "4"), ("code", "v1.2")}


def test_recall(spark):
    rows = spark.createDataFrame([("a", 2, 1, 4, 3, False, False), ("a", 0, 0, 0, 0, False, False), ("b", 0, 0, 0, 0, False, False)], "arm string, expected_fields long, matched_fields long, expected_tokens long, matched_tokens long, normalized_hit boolean, strict_hit boolean")
    out = {r["arm"]: r for r in M.recall(rows, ["arm"]).collect()}
    assert (out["a"]["field_recall"], out["a"]["token_recall"], out["a"]["cases"], out["a"]["token_errors"]) == (0.5, 0.75, 2, 1) and out["b"]["token_recall"] is None and out["b"]["field_recall"] == 0.0

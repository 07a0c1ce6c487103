"""Scores of selected evidence, saved references, frozen inputs and verdicts on literals."""

import hashlib

import pytest

from docsift.operators import audit
from docsift.operators import selection as S


@pytest.mark.parametrize(
    "quote, text, want",
    [
        ("flow 12 m", "the flow 12 m is", "EXACT"), ("12", "112", "NOT_FAITHFUL"), ("12", "12.5", "NOT_FAITHFUL"), ("12", "x12", "NOT_FAITHFUL"), ("12", "3×12", "NOT_FAITHFUL"), ("12", "112 and 12", "EXACT"), ("ab", "abc", "NOT_FAITHFUL"),
        ("ab", "xab", "EXACT"), ("ab", "ab.", "NOT_FAITHFUL"), ("ab.", "ab. c", "EXACT"), ("a b", "a  b", "NORMALIZED_EQUIVALENT"), ("A b", "a b", "NOT_FAITHFUL"), (r"p \leq 5", "p≤5", "NORMALIZED_EQUIVALENT"), ("p <= 5", "p ≤ 5", "NORMALIZED_EQUIVALENT"),
        (r"\leqx", "≤x", "NOT_FAITHFUL"), ("5 m^2", "5 m2", "NORMALIZED_EQUIVALENT"), ("5 m^{3}", "5m3", "NORMALIZED_EQUIVALENT"), ("10⁻³", "10^-3", "NOT_FAITHFUL"), ("10³", "10^3", "NORMALIZED_EQUIVALENT"), ("3*4", "3 × 4", "NORMALIZED_EQUIVALENT"),
        (r"\mathrm{kg} 5", "kg5", "NORMALIZED_EQUIVALENT"), ("(a+b)*", "x (a+b)* y", "EXACT"), ("a\n", "a\nb", "EXACT"), ("", "x", "NOT_FAITHFUL"), (None, "x", "NOT_FAITHFUL"), ("x", None, "NOT_FAITHFUL"),
    ],
)
def test_quote_fidelity(spark, quote, text, want):
    rows = spark.createDataFrame([(quote, text, 1)], "quote string, text string, _t int")
    out = S.quote_fidelity(rows).first()
    assert out["fidelity"] == want and out["_t"] == 1


ORACLE = "task_id int, scope string, expected_available boolean, expected_ids array<string>"


def scored(spark, oracle, reviews, observed, outcomes, candidates=(), tasks=(1,), accepted=True):
    make = spark.createDataFrame
    rows = S.task_scores(
        make([("a", t, accepted) for t in tasks], "arm string, task_id int, accepted boolean"), make([("a", 1, *o) for o in outcomes], "arm string, task_id int, scope string, status string, evidence_ids array<string>"), make(oracle, ORACLE),
        make(reviews, "task_id int, evidence_id string, scope string, label string"), make([(1, x) for x in observed], "task_id int, evidence_id string"), make([(1, s) for s in candidates], "task_id int, scope string"),
    )
    return rows.first()


R = [(1, "e1", "s", "RELEVANT"), (1, "e2", "s", "IRRELEVANT"), (1, "e3", "t", "RELEVANT")]
FOUND = "evidence_found"


def test_selection_by_expected_ids(spark):
    oracle = [(1, "s", True, ["e1"])]
    r = scored(spark, oracle, R, ["e1", "e2"], [("s", FOUND, ["e1"])])
    assert (r["candidate_group"], r["explicit"], r["id_success"], r["full_success"], r["correct"], r["omitted"]) == ("CANDIDATE_AVAILABLE", True, True, True, 1, [])
    r = scored(spark, oracle, R, ["e1", "e2"], [("s", FOUND, ["e1", "e2"])])
    assert r["id_success"] and not r["full_success"] and r["selected"] == 2
    assert scored(spark, oracle, R, ["e1"], [("s", FOUND, ["e1"])], accepted=False)["full_success"] is False
    r = scored(spark, oracle, R, ["e1"], [("s", "no_evidence_found", None)])
    assert r["id_success"] is False and r["omitted"] == ["s"] and r["selected"] == 0
    r = scored(spark, oracle, R, ["e2"], [("s", FOUND, ["e1"])])  # never observed
    assert r["candidate_group"] == "RETRIEVAL_BOUND" and r["id_success"] is None and r["full_success"] is None


def test_unknown_expectations_stay_out(spark):
    assert scored(spark, [(1, "s", None, None)], R, ["e1"], [("s", FOUND, ["e1"])])["candidate_group"] == "UNASSESSED"
    assert scored(spark, [(1, "s", True, []), (1, "t", True, ["e3"])], R, ["e1", "e3"], [])["candidate_group"] == "UNASSESSED"
    r = scored(spark, [(2, "s", True, None)], R, ["e1"], [])
    assert r["candidate_group"] == "PREFLIGHT_CONTROL" and r["omitted"] == []
    rows = spark.createDataFrame([("a", True, True, 1, 1, 0, 0, []), ("a", None, None, 2, 0, 0, 0, ["s"])], "arm string, id_success boolean, full_success boolean, selected long, correct long, empty_passed long, empty_assessed long, omitted array<string>")
    r = S.selection_rates(rows, ["arm"]).first()
    assert (r["tasks"], r["assessed"], r["id_rate"], r["precision"], r["empty_rate"], r["omitted"]) == (2, 1, 1.0, 1 / 3, None, 1)


def test_scopes_that_expect_nothing(spark):
    oracle = [(1, "s", False, None), (1, "t", True, None)]
    for status, ids, some, passed in (("no_evidence_found", None, [], 1), ("insufficient_scope", None, ["s"], 1), ("no_evidence_found", None, ["s"], 0), (FOUND, ["e2"], ["s"], 0)):
        r = scored(spark, oracle, R, ["e3"], [("s", status, ids), ("t", FOUND, ["e3"])], some)
        assert (r["empty_passed"], r["empty_assessed"], r["id_success"], r["full_success"]) == (passed, 1, True, passed == 1)


def ref(place, i, text="x", **more):
    ident = f"ev_{i:064x}"
    row = {"task_id": 1, "scope": "s", "place": place, "evidence_id": ident, "source": "s", "page": 1, "block_index": 0, "chunk_id": 0, "excerpt": text, "span_length": len(text), "excerpt_sha256": hashlib.sha256(text.encode()).hexdigest()} | more
    return tuple(row.values())


@pytest.mark.parametrize(
    "saved, divergence, rules",
    [
        ([ref(0, 1), ref(1, 2)], None, []), ([ref(0, 2), ref(1, 1)], 0, ["other_id"]), ([ref(0, 1)], 1, ["missing_reference"]), ([ref(0, 1), ref(1, 2), ref(2, 3)], 2, ["unexpected_reference"]), ([], 0, ["missing_reference"]),
        ([ref(0, 1), ref(1, 1)], 1, ["other_id", "repeated_id"]), ([ref(0, 1, excerpt="y"), ref(1, 2)], None, ["other_hash"]), ([ref(0, 1, "z" * 1201), ref(1, 2)], None, ["invalid_span"]), ([ref(0, 1, source="t"), ref(1, 2, page=0)], None, ["invalid_provenance", "other_source"]),
        ([ref(0, 1, " "), ref(1, 2, chunk_id=None)], None, ["invalid_provenance", "invalid_span"]), ([ref(0, 1, span_length=5), ref(1, 2, evidence_id="ev_12")], 1, ["invalid_id", "invalid_span", "other_id"]),
    ],
)
def test_saved_references(spark, saved, divergence, rules):
    kind = "task_id int, scope string, place int, evidence_id string, source string, page int, block_index int, chunk_id int, excerpt string, span_length int, excerpt_sha256 string"
    expected = spark.createDataFrame([(1, "s", 0, f"ev_{1:064x}"), (1, "s", 1, f"ev_{2:064x}")], "task_id int, scope string, place int, evidence_id string")
    r = S.saved_references(expected, spark.createDataFrame(saved, kind)).first()
    assert (r["first_divergence"], r["rules"], r["n_expected"], r["n_saved"], r["chains_equal"]) == (divergence, rules, 2, len(saved), divergence is None)


def test_unbound(spark):
    kind = "task int, id string, value string"
    a = spark.createDataFrame([(1, "a", "x"), (1, "b", "x"), (1, "c", None), (2, "a", None)], kind)
    b = spark.createDataFrame([(1, "a", "x"), (1, "b", "y"), (1, "d", "x"), (1, "c", None)], kind)
    assert sorted((r["task"], r["id"], r["state"]) for r in S.unbound(a, b, ["task", "id"], "value").collect()) == [(1, "b", "different"), (1, "d", "unexpected"), (2, "a", "missing")]


def test_altered_ranks(spark):
    corpus = spark.createDataFrame([(10, 0, "a"), (20, 1, "b"), (30, 2, "a")], "position long, ordinal long, source string")
    pool = spark.createDataFrame([(1, 1, 10, 0.9), (1, 2, 20, 0.8), (1, 3, 30, 0.7), (2, 1, 10, 0.9)], "qid int, rank int, position long, score double")
    stored = spark.createDataFrame([(1, 1, 0, 0.9), (1, 2, 2, 0.8), (1, 3, 9, 0.7), (1, 4, 1, 0.1), (3, 1, 0, None), (3, 1, 0, None)], "qid int, rank int, corpus_index long, score double")
    got = {(r["qid"], r["rank"]): r["state"] for r in audit.altered(stored, corpus, pool).collect()}
    assert got == {(1, 2): "other_chunk", (1, 3): "unknown_ordinal", (1, 4): "unexpected", (2, 1): "missing", (3, 1): "unexpected"}
    assert audit.altered(spark.createDataFrame([(2, 1, 0, 0.5)], stored.schema), corpus, pool.filter("qid = 2")).first()["state"] == "other_score"
    twice = spark.createDataFrame([(2, 1, 0, 0.9), (2, 1, 1, 0.9)], stored.schema)
    assert audit.altered(twice, corpus, pool.filter("qid = 2")).first()["state"] == "repeated_rank"
    asked = spark.createDataFrame([(1, "a"), (5, "a")], "qid int, source string")
    assert {r["qid"]: r["in_scope"] for r in audit.scope_counts(stored, corpus, asked).collect()} == {1: 2, 5: 0}


def test_pair_preflight_and_routes(spark):
    tasks = spark.createDataFrame([(1, ["A", "B"], "finished"), (2, ["A", "B"], "finished"), (3, ["B", "A"], "finished"), (4, [], "finished"), (5, ["A"], "clarify"), (6, None, None)], "task_id int, scopes array<string>, status string")
    held = spark.createDataFrame([(1, "A"), (1, "B"), (1, "B"), (2, "A"), (3, "A"), (3, "B")], "task_id int, scope string")
    pre = S.pair_preflight(tasks, held)
    assert {r["task_id"]: r["reason"] for r in pre.collect()} == {1: "bilateral_supported", 2: "not_bilateral_supported", 3: "not_bilateral_supported", 4: "unresolved_scope", 5: "unresolved_scope", 6: "unresolved_scope"}
    truth = spark.createDataFrame([(1, "semantic"), (2, "semantic"), (3, "retrieval_bound"), (4, "unsupported_side"), (5, "unresolved_scope"), (6, "unresolved_scope")], "task_id int, route string")
    groups = spark.createDataFrame([(3, "CANDIDATE_AVAILABLE")], "task_id int, candidate_group string")
    oracle = spark.createDataFrame([(4, "A", None), (4, "B", True)], "task_id int, scope string, expected_available boolean")
    rules = {r["task_id"]: r["rule"] for r in S.route_breaks(truth, pre, groups, oracle, tasks).collect()}
    assert rules == {2: "other_cohort", 3: "not_retrieval_bound", 4: "no_unsupported_side", 6: "not_unresolved"}


DIMS = "object_or_field string, value string, unit string, condition_or_applicability string"


@pytest.mark.parametrize(
    "route, confidence, result, errors, passed",
    [
        ("semantic", "sure", ("compared", True, "DIFFERENT", "DIFFERENT", True, "DIFFERENT", "aligned"), [], True), ("semantic", "sure", ("compared", True, "DIFFERENT", "EQUIVALENT", True, "DIFFERENT", "aligned"), ["INVALID_OUTPUT"], None),
        ("semantic", "sure", ("compared", True, "x", "NOT_COMPARABLE", True, "NOT_COMPARABLE", "uncertain"), ["UNIT_COMPARISON_ERROR", "NOT_COMPARABLE_FALSE_POSITIVE"], False), ("semantic", "sure", ("compared", True, "x", "x", False, "x", "aligned"), ["INVALID_OUTPUT"], None),
        ("semantic", "sure", ("unit_conversion_required", True, None, None, True, "DIFFERENT", "different"), ["UNIT_COMPARISON_ERROR"], None), ("semantic", "sure", ("unit_conversion_required", True, None, None, True, "DIFFERENT", "aligned"), ["INVALID_OUTPUT"], None),
        ("semantic", "uncertain", ("compared", True, "DIFFERENT", "DIFFERENT", True, "DIFFERENT", "aligned"), ["GT_UNCERTAIN"], None), ("semantic", "sure", ("preflight_insufficient_evidence", False, "INSUFFICIENT_EVIDENCE", None, None, None, None), ["INVALID_OUTPUT"], None),
        ("retrieval_bound", "sure", ("preflight_insufficient_evidence", False, "INSUFFICIENT_EVIDENCE", None, None, None, None), ["EVIDENCE_UPSTREAM_FAILURE"], None), ("unsupported_side", None, ("preflight_insufficient_evidence", True, "INSUFFICIENT_EVIDENCE", None, None, None, None), ["INVALID_OUTPUT"], None),
        ("semantic", "sure", None, ["INVALID_OUTPUT"], None),
    ],
)
def test_semantic_rows(spark, route, confidence, result, errors, passed):
    truth = spark.createDataFrame([(1, route, confidence, "DIFFERENT", "aligned", None, "aligned", None)], "task_id int, route string, confidence string, expected_verdict string, " + ", ".join(f"expected_{d}" for d in DIMS.split(", ")))
    rows = [] if result is None else [(1, *result[:2], "r", *result[2:6], "aligned" if result[4] is not None else None, None, result[6], None)]
    results = spark.createDataFrame(rows, f"task_id int, status string, eligible boolean, reason string, verdict string, formal_verdict string, valid boolean, semantic_verdict string, {DIMS}")
    r = S.semantic_rows(truth, results).first()
    assert (r["errors"], r["verdict_passed"]) == (errors, passed)

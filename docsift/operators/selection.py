"""Scores of runs against what was expected of them: selected evidence, saved references, frozen inputs, verdicts.

Unknown expectations are null and stay out of every denominator.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docsift.functions import text as T

from .agent import DIMENSIONS
from .matching import _quoted

FOUND, NONE, SHORT = "evidence_found", "no_evidence_found", "insufficient_scope"
MAX_EXCERPT = 1200

# -- selected evidence ---------------------------------------------------------------------------


def _any(condition: Column) -> Column:
    return F.coalesce(F.bool_or(condition), F.lit(False))


def expected_hits(oracle: DataFrame, reviews: DataFrame, observed: DataFrame) -> DataFrame:
    """task_id, scope, evidence_id: the ids that would satisfy a scope that expects evidence.

    oracle (task_id, scope, expected_available, expected_ids), reviews (task_id, evidence_id, scope, label),
    observed (task_id, evidence_id). Where ids are expected, a hit is expected, observed and reviewed as relevant
    in its scope; elsewhere any id reviewed as relevant in the scope is one.
    """
    wanted = oracle.filter("expected_available").select("task_id", "scope", "expected_ids")
    relevant = reviews.filter("label = 'RELEVANT'").select("task_id", "scope", "evidence_id").distinct()
    rows = wanted.join(relevant, ["task_id", "scope"]).join(observed.select("task_id", "evidence_id").distinct().withColumn("_seen", F.lit(True)), ["task_id", "evidence_id"], "left")
    return rows.filter(F.col("expected_ids").isNull() | (F.array_contains("expected_ids", F.col("evidence_id")) & F.col("_seen"))).select("task_id", "scope", "evidence_id")


def task_groups(tasks: DataFrame, oracle: DataFrame, hits: DataFrame) -> DataFrame:
    """task_id, explicit, candidate_group: PREFLIGHT_CONTROL without scopes, UNASSESSED where an expectation is unknown, RETRIEVAL_BOUND where a scope has no hit, CANDIDATE_AVAILABLE."""
    flags = oracle.join(hits.select("task_id", "scope", F.lit(True).alias("hit")).distinct(), ["task_id", "scope"], "left").groupBy("task_id").agg(
        _any(F.col("expected_available").isNull()).alias("unknown"), _any(F.col("expected_ids").isNotNull()).alias("explicit"),
        _any(F.col("expected_available") & (F.coalesce(F.size("expected_ids"), F.lit(0)) <= 0)).alias("unlisted"), _any(F.col("expected_available") & F.col("hit").isNull()).alias("unmet"),
    )
    group = (
        F.when(F.col("unknown").isNull(), "PREFLIGHT_CONTROL").when(F.col("unknown") | (F.col("explicit") & F.col("unlisted")), "UNASSESSED").when(F.col("unmet"), "RETRIEVAL_BOUND").otherwise("CANDIDATE_AVAILABLE")
    )
    return tasks.select("task_id").join(flags, "task_id", "left").select("task_id", F.coalesce("explicit", F.lit(False)).alias("explicit"), group.alias("candidate_group"))


def references(outcomes: DataFrame, oracle: DataFrame, reviews: DataFrame, groups: DataFrame) -> DataFrame:
    """One row a cited id: arm, task_id, scope, evidence_id, label, expected_match, correct, and the alignments of the review, if it has some."""
    more = [c for c in reviews.columns if c.endswith("_alignment")]
    rows = outcomes.filter(F.col("status") == FOUND).select("arm", "task_id", "scope", F.explode("evidence_ids").alias("evidence_id"))
    rows = rows.join(reviews.select("task_id", "evidence_id", "label", *more), ["task_id", "evidence_id"], "left").join(oracle.select("task_id", "scope", "expected_ids"), ["task_id", "scope"], "left")
    rows = rows.join(groups.select("task_id", "explicit"), "task_id", "left").withColumn("label", F.coalesce("label", F.lit("UNCERTAIN")))
    match = F.when(F.col("expected_ids").isNotNull(), F.array_contains("expected_ids", F.col("evidence_id")))
    right = F.when(F.col("explicit"), F.coalesce(match, F.lit(False))).otherwise(F.coalesce(match, F.lit(True)))
    return rows.select("arm", "task_id", "scope", "evidence_id", "label", match.alias("expected_match"), ((F.col("label") == "RELEVANT") & right).alias("correct"), *more)


def task_scores(runs: DataFrame, outcomes: DataFrame, oracle: DataFrame, reviews: DataFrame, observed: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row a task and arm of runs (arm, task_id, accepted).

    outcomes (arm, task_id, scope, status, evidence_ids), candidates (task_id, scope: those with search results).
    id_success and full_success are null unless candidates are available; a scope that expects nothing is right
    with the status its candidates ask for and without ids.
    """
    hits = expected_hits(oracle, reviews, observed)
    groups = task_groups(runs.select("task_id").distinct(), oracle, hits)
    refs = references(outcomes, oracle, reviews, groups)
    per_ref = refs.join(hits.withColumn("hit", F.lit(True)), ["task_id", "scope", "evidence_id"], "left").groupBy("arm", "task_id", "scope").agg(
        _any(F.col("hit")).alias("hit"), _any(F.col("correct")).alias("right"), F.bool_and("correct").alias("all_right"), _any(F.col("label") == "RELEVANT").alias("relevant"),
        F.count("*").alias("n"), F.count_if(F.col("label") == "RELEVANT").alias("n_relevant"), F.count_if("correct").alias("n_correct"),
    )
    asked = runs.select("arm", "task_id").join(oracle.select("task_id", "scope", "expected_available"), "task_id")
    given = outcomes.select("arm", "task_id", "scope", "status", F.greatest(F.size("evidence_ids"), F.lit(0)).alias("n_ids"))
    rows = asked.join(given, ["arm", "task_id", "scope"], "left").join(per_ref, ["arm", "task_id", "scope"], "left").join(candidates.select("task_id", "scope", F.lit(True).alias("some")).distinct(), ["task_id", "scope"], "left")
    wanted, empty = F.col("expected_available"), F.col("expected_available") == F.lit(False)
    kept = F.coalesce((F.col("status") == F.when(F.col("some"), SHORT).otherwise(NONE)) & (F.coalesce("n_ids", F.lit(0)) == 0), F.lit(False))
    per_task = rows.groupBy("arm", "task_id").agg(
        F.count_if(wanted).alias("wanted"), F.count_if(wanted & F.coalesce("hit", F.lit(False))).alias("met"), F.count_if(wanted & (F.col("status") == FOUND) & F.coalesce("relevant", F.lit(False))).alias("supported"),
        F.count_if(empty).alias("empty_assessed"), F.count_if(empty & kept).alias("empty_passed"), F.sort_array(F.collect_set(F.when(wanted & ~F.coalesce("right", F.lit(False)), F.col("scope")))).alias("omitted"),
    )
    cited = per_ref.groupBy("arm", "task_id").agg(F.sum("n").alias("selected"), F.sum("n_relevant").alias("relevant"), F.sum("n_correct").alias("correct"), F.bool_and("all_right").alias("all_right"))
    out = runs.join(groups, "task_id").join(per_task, ["arm", "task_id"], "left").join(cited, ["arm", "task_id"], "left")
    zero = ["wanted", "met", "supported", "empty_assessed", "empty_passed", "selected", "relevant", "correct"]
    out = out.fillna(0, zero).withColumn("omitted", F.coalesce("omitted", F.array().cast("array<string>")))
    available = F.col("candidate_group") == "CANDIDATE_AVAILABLE"
    success = (F.col("wanted") > 0) & (F.col("met") == F.col("wanted"))
    full = F.col("accepted") & success & F.coalesce("all_right", F.lit(True)) & (F.col("supported") == F.col("wanted")) & (F.col("empty_passed") == F.col("empty_assessed"))
    return out.select("arm", "task_id", "accepted", "candidate_group", "explicit", F.when(available, success).alias("id_success"), F.when(available, full).alias("full_success"), "selected", "relevant", "correct", "empty_passed", "empty_assessed", "omitted")


def selection_rates(scores: DataFrame, by: list[str]) -> DataFrame:
    """Rollup of task_scores(): a rate's denominator holds only what was assessed."""
    out = scores.groupBy(*by).agg(
        F.count("*").alias("tasks"), F.count("id_success").alias("assessed"), F.count_if("id_success").alias("id_passed"), F.count_if("full_success").alias("full_passed"), F.sum("selected").alias("selected"),
        F.sum("correct").alias("correct"), F.sum("empty_passed").alias("empty_passed"), F.sum("empty_assessed").alias("empty_assessed"), F.sum(F.size("omitted")).alias("omitted"),
    )
    rate = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b))
    return out.withColumns({"id_rate": rate("id_passed", "assessed"), "full_rate": rate("full_passed", "assessed"), "precision": rate("correct", "selected"), "empty_rate": rate("empty_passed", "empty_assessed")})


#: Digits and signs set high; formula commands and their signs (fixed values).
HIGH = "⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻"
COMMANDS = ((r"\geqslant", "≥"), (r"\leqslant", "≤"), (r"\geq", "≥"), (r"\leq", "≤"), (r"\ge", "≥"), (r"\le", "≤"), (r"\times", "x"))


def quote_normal(text: Column | str) -> Column:
    """A quote without formatting: case, numbers, comparisons and unknown commands stay."""
    out = F.regexp_replace(T.col(text), f"(?<=[0-9])([{HIGH}]+)", "^$1")
    out = T.compatible(out)  # high digits and signs become plain ones
    for command, sign in COMMANDS:
        out = F.regexp_replace(out, rf"\{command}(?![A-Za-z])", sign)
    out = F.regexp_replace(out, r"\\(?:mathrm|text|mathbf|operatorname)\{([^{}]*)\}", "$1")
    for old, new in (("×", "x"), (r"\,", ""), (r"\;", ""), (r"\!", ""), ("<=", "≤"), (">=", "≥")):
        out = F.replace(out, F.lit(old), F.lit(new))
    out = F.regexp_replace(out, r"(?<![A-Za-z])(mm|cm|km|m)\^(?:\{([23])\}|([23]))(?![0-9])", "$1$2$3")
    out = F.regexp_replace(out, rf"(?U)(?:{T.WHITE}|[{{}}$])", "")
    return F.regexp_replace(out, r"(?<=[0-9m])\*(?=[0-9])", "x")


def _quoted_in(text: Column, quote: Column) -> Column:
    left = F.when(quote.rlike("^[0-9]"), F.lit("(?<![0-9.x×])")).otherwise(F.lit(""))
    right = F.when(quote.rlike(r"[0-9]\z"), F.lit("(?![0-9.])")).when(quote.rlike(r"[A-Za-z.]\z"), F.lit("(?![A-Za-z0-9.])")).otherwise(F.lit(""))
    return F.coalesce((quote != "") & F.regexp_like(text, F.concat(left, _quoted(quote), right)), F.lit(False))


def quote_fidelity(rows: DataFrame, quote: str = "quote", text: str = "text", name: str = "fidelity") -> DataFrame:
    """rows with EXACT, NORMALIZED_EQUIVALENT or NOT_FAITHFUL: whether the text holds the quote with nothing continuing its numbers and words."""
    names = rows.columns
    q, t = (next(f"{c}{i}" for i in range(len(names) + 1) if f"{c}{i}" not in names) for c in ("normal_quote", "normal_text"))
    rows = rows.withColumn(q, quote_normal(quote)).withColumn(t, quote_normal(text))
    told = F.when(_quoted_in(F.col(text), F.col(quote)), "EXACT").when(_quoted_in(F.col(t), F.col(q)), "NORMALIZED_EQUIVALENT").otherwise("NOT_FAITHFUL")
    return rows.select(*[f"`{c}`" for c in names], told.alias(name))


# -- saved references ----------------------------------------------------------------------------


def _chain(rows: DataFrame, keys: list[str], digest: Column, name: str) -> DataFrame:
    """keys, {name}: the digests of a list after each of its places, each bound to all before it; a list is bounded by its contract."""
    items = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("place", digest.alias("d")))).alias("x"))
    step = lambda held, x: F.array_append(held, F.sha2(F.concat(F.element_at(held, -1), x["d"]).cast("binary"), 256))
    return items.select(*keys, F.aggregate("x", F.array().cast("array<string>"), lambda held, x: F.when(F.size(held) == 0, F.array(F.sha2(x["d"].cast("binary"), 256))).otherwise(step(held, x))).alias(name))


def saved_references(expected: DataFrame, saved: DataFrame) -> DataFrame:
    """One row a list (task_id, scope): n_expected, n_saved, chains_equal, first_divergence (place, null if none) and rules broken.

    expected (task_id, scope, place, evidence_id): what was accepted, in order. saved (task_id, scope, place,
    evidence_id, source, page, block_index, chunk_id, excerpt, span_length, excerpt_sha256): what was kept. Lists
    are joined place by place; two chains of ids agree exactly up to the first place that differs.
    """
    keys = ["task_id", "scope"]
    ident = F.sha2(F.coalesce(F.col("evidence_id"), F.lit("")).cast("binary"), 256)
    chains = _chain(expected, keys, ident, "chain_a").join(_chain(saved, keys, ident, "chain_b"), keys, "full_outer")
    none = F.array().cast("array<string>")
    chains = chains.withColumns({c: F.coalesce(c, none) for c in ("chain_a", "chain_b")})
    same = F.zip_with("chain_a", "chain_b", lambda a, b: F.coalesce(a == b, F.lit(False)))
    differs = F.array_position(same, False)  # 0 where all places agree
    chains = chains.select(*keys, F.size("chain_a").alias("n_expected"), F.size("chain_b").alias("n_saved"), F.when(differs > 0, differs - 1).cast("int").alias("first_divergence"))
    place = expected.select(*keys, "place", F.col("evidence_id").alias("wanted")).join(saved, [*keys, "place"], "full_outer")
    again = F.row_number().over(Window.partitionBy(*keys, "evidence_id").orderBy("place")) > 1
    excerpt = F.col("excerpt")
    there = F.col("evidence_id").isNotNull()
    rules = {
        "missing_reference": ~there & F.col("wanted").isNotNull(), "unexpected_reference": there & F.col("wanted").isNull(), "other_id": there & (F.col("wanted") != F.col("evidence_id")), "repeated_id": there & again,
        "invalid_id": there & ~F.col("evidence_id").rlike(r"^ev_[0-9a-f]{64}\z"), "other_source": there & ~F.col("source").eqNullSafe(F.col("scope")),
        "invalid_provenance": there & ~F.coalesce((F.col("page") >= 1) & (F.col("block_index") >= 0) & (F.col("chunk_id") >= 0), F.lit(False)),
        "invalid_span": there & ~F.coalesce((F.length(T.strip(excerpt)) > 0) & (F.length(excerpt) <= MAX_EXCERPT) & (F.col("span_length") == F.length(excerpt)), F.lit(False)),
        "other_hash": there & ~F.coalesce(F.sha2(excerpt.cast("binary"), 256) == F.col("excerpt_sha256"), F.lit(False)),
    }
    broken = F.filter(F.array(*[F.when(F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]), lambda x: x.isNotNull())
    rows = place.withColumn("_broken", broken).groupBy(*keys).agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("_broken")))).alias("rules"))
    return chains.join(rows, keys).withColumn("chains_equal", F.col("first_divergence").isNull())


def unbound(frozen: DataFrame, bound: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One row a break between frozen inputs and what a run says it is bound to: keys and state (missing, unexpected or different)."""
    a, b = frozen.select(*keys, F.struct(value).alias("_a")), bound.select(*keys, F.struct(value).alias("_b"))
    rows = a.join(b, keys, "full_outer")
    state = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "unexpected").when(F.col("_a") != F.col("_b"), "different")
    return rows.select(*keys, state.alias("state")).filter("state IS NOT NULL")


# -- verdicts of two arms ------------------------------------------------------------------------

VERDICTS = ("EQUIVALENT", "DIFFERENT", "NOT_COMPARABLE")
#: Kinds of invalid output (fixed values); any other is OTHER.
FAILURES = ("INVALID_JSON", "MISSING_FIELD", "EXTRA_FIELD", "INVALID_ENUM", "WRONG_TYPE", "NESTED_SCHEMA_ERROR", "CONSISTENCY_ERROR", "EMPTY_RESPONSE", "TRUNCATED", "OTHER")


def judged(tasks: DataFrame, runs: DataFrame) -> DataFrame:
    """One row an arm and headline task, with what became of it.

    tasks: task_id, include, expected_verdict, expected_<dimension>; runs: arm, task_id, status, failure_type,
    accepted (its output holds the contract), verdict, basis and the dimensions. A task without a run was not run.
    """
    arms = runs.groupBy().agg(F.sort_array(F.collect_set("arm")).alias("arms"))  # a handful
    head = tasks.filter("include").crossJoin(F.broadcast(arms)).withColumn("arm", F.explode("arms")).drop("arms")
    rows = head.join(runs, ["arm", "task_id"], "left").withColumn("accepted", F.coalesce("accepted", F.lit(False))).withColumn("status", F.coalesce("status", F.lit("not_run_after_stop")))
    unsure = (F.col("status") == "semantic_uncertain") | F.coalesce(F.col("basis") == "uncertain", F.lit(False))
    failed = ~F.col("accepted") & ~F.col("status").isin("api_error", "not_run_after_stop")
    kind = F.when(failed, F.when(F.col("failure_type").isin(*FAILURES), F.col("failure_type")).otherwise("OTHER"))
    rows = rows.withColumn("predicted", F.when(F.col("accepted"), F.when(unsure, "UNCERTAIN").otherwise(F.col("verdict")))).withColumn("failure", kind)
    return rows.withColumn("passed", F.coalesce(F.col("predicted") == F.col("expected_verdict"), F.lit(False)))


def arm_scores(judged: DataFrame, by: list[str]) -> DataFrame:
    """Acceptance, strict and accepted-only accuracy, dimension accuracy, consistency, and misuse of not_applicable, by arm (and class)."""
    ok = F.col("accepted")
    known = lambda d: ok & (F.col("expected_object_or_field") == "different") & (F.col(f"expected_{d}") != "not_applicable")
    misuse = [F.count_if(known(d) & (F.col(d) == "not_applicable")) for d in ("value", "unit")]
    out = judged.groupBy(*by).agg(
        F.count("*").alias("attempted"), F.count_if(ok).alias("accepted"), F.count_if("passed").alias("passed"), *[F.count_if(ok & (F.col(d) == F.col(f"expected_{d}"))).alias(f"{d}_passed") for d in DIMENSIONS],
        F.count_if(F.col("failure") == "CONSISTENCY_ERROR").alias("inconsistent"), (misuse[0] + misuse[1]).alias("na_violations"), (F.count_if(known("value")) + F.count_if(known("unit"))).alias("na_assessed"),
        F.count_if(F.col("status") == "api_error").alias("api_errors"), F.count_if(F.col("status") == "not_run_after_stop").alias("not_run"),
    )
    rate = lambda a, b: F.try_divide(F.col(a).cast("double"), b)
    n = F.col("accepted")
    return out.withColumns({"acceptance": rate("accepted", F.col("attempted")), "strict_accuracy": rate("passed", F.col("attempted")), "accepted_accuracy": rate("passed", n), "consistency": rate("accepted", n + F.col("inconsistent"))} | {f"{d}_accuracy": rate(f"{d}_passed", n) for d in DIMENSIONS}).drop(*[f"{d}_passed" for d in DIMENSIONS])


def failures(judged: DataFrame) -> DataFrame:
    """arm, failure, n: every kind of every arm, also those that did not occur."""
    kinds = judged.select("arm").distinct().withColumn("failure", F.explode(F.array(*map(F.lit, FAILURES))))
    found = judged.filter("failure IS NOT NULL").groupBy("arm", "failure").agg(F.count("*").alias("n"))
    return kinds.join(found, ["arm", "failure"], "left").fillna(0, ["n"])


# -- one semantic run against its truth ----------------------------------------------------------

PREFLIGHT, UNKNOWN = "preflight_insufficient_evidence", "INSUFFICIENT_EVIDENCE"
#: Kinds of errors of a semantic run (fixed values), the dimensions' ones in the order of DIMENSIONS.
DIMENSION_ERRORS = ("SEMANTIC_FIELD_MISALIGNMENT", "VALUE_COMPARISON_ERROR", "UNIT_COMPARISON_ERROR", "CONDITION_OMISSION")
ERRORS = ("EVIDENCE_UPSTREAM_FAILURE", *DIMENSION_ERRORS, "NOT_COMPARABLE_FALSE_POSITIVE", "NOT_COMPARABLE_FALSE_NEGATIVE", "INVALID_OUTPUT", "GT_UNCERTAIN")


def semantic_rows(truth: DataFrame, results: DataFrame) -> DataFrame:
    """One row a task of truth with invalid, uncertain, scored, verdict_passed (null where not assessed), <dimension>_passed (likewise) and errors.

    truth: task_id, route, confidence, expected_verdict, expected_<dimension>. results: task_id, status, eligible,
    reason, verdict, formal_verdict, valid (of the semantic output; null without one), semantic_verdict and the
    dimensions. An output is invalid where its route, its status and what it holds contradict each other; truths
    that are uncertain are counted, but never scored.
    """
    rows = truth.join(results, "task_id", "left").withColumn("eligible", F.coalesce("eligible", F.lit(False)))
    there, status, formal = F.col("valid").isNotNull(), F.coalesce("status", F.lit("")), F.col("formal_verdict")
    off = F.when(F.col("route") == "semantic", ~F.col("eligible") | (status == PREFLIGHT)).otherwise(
        F.col("eligible") | (status != PREFLIGHT) | ~F.col("verdict").eqNullSafe(F.lit(UNKNOWN)) | there | formal.isNotNull()
    )
    unit = F.coalesce(F.col("unit") == "different", F.lit(False))
    held = (
        F.when(status == "compared", ~there | unit | ~formal.eqNullSafe(F.col("semantic_verdict"))).when(status == "unit_conversion_required", ~there | ~unit | formal.isNotNull()).otherwise(there | formal.isNotNull())
    )
    invalid = (status == "invalid_output") | F.coalesce(off, F.lit(True)) | (there & ~F.col("valid")) | held
    uncertain = F.coalesce(F.col("confidence") == "uncertain", F.lit(False)) | F.coalesce(F.col("route") == "gt_uncertain", F.lit(False))
    rows = rows.withColumn("invalid", F.coalesce(invalid, F.lit(True))).withColumn("uncertain", uncertain)
    rows = rows.withColumn("scored", ~F.col("invalid") & ~F.col("uncertain") & there)
    passed = {f"{d}_passed": F.when(F.col("scored") & F.col(f"expected_{d}").isNotNull(), F.coalesce(F.col(d) == F.col(f"expected_{d}"), F.lit(False))) for d in DIMENSIONS}
    rows = rows.withColumns(passed | {"verdict_passed": F.when(F.col("scored") & F.col("expected_verdict").isNotNull() & formal.isNotNull(), formal == F.col("expected_verdict"))})
    definite = ("EQUIVALENT", "DIFFERENT")
    told = {
        "EVIDENCE_UPSTREAM_FAILURE": (F.col("route") == "retrieval_bound") & ~F.col("eligible"), **{e: ~F.col(f"{d}_passed") for d, e in zip(DIMENSIONS, DIMENSION_ERRORS)},
        "NOT_COMPARABLE_FALSE_POSITIVE": F.col("verdict_passed").isNotNull() & (formal == "NOT_COMPARABLE") & F.col("expected_verdict").isin(*definite),
        "NOT_COMPARABLE_FALSE_NEGATIVE": F.col("verdict_passed").isNotNull() & (F.col("expected_verdict") == "NOT_COMPARABLE") & formal.isin(*definite), "INVALID_OUTPUT": F.col("invalid"), "GT_UNCERTAIN": F.col("uncertain"),
    }
    return rows.withColumn("errors", F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(e)) for e, c in told.items()]), lambda x: x.isNotNull()))


def semantic_scores(rows: DataFrame, by: list[str]) -> DataFrame:
    """Verdict and dimension accuracy, eligible pairs, invalid outputs and the routing of unsupported sides, by any columns."""
    side = F.col("route") == "unsupported_side"
    kept = side & (F.col("status") == PREFLIGHT) & ~F.col("eligible") & (F.col("verdict") == UNKNOWN)
    out = rows.groupBy(*by).agg(
        F.count("*").alias("tasks"), F.count_if((F.col("route") == "semantic") & F.col("eligible")).alias("eligible_pairs"), F.count_if(~F.col("eligible")).alias("preflight"), F.count_if("invalid").alias("invalid"),
        F.count("verdict_passed").alias("verdicts"), F.count_if("verdict_passed").alias("verdicts_passed"), F.count_if(side).alias("sides"), F.count_if(kept).alias("sides_passed"),
        *[F.try_divide(F.count_if(f"{d}_passed").cast("double"), F.count(f"{d}_passed")).alias(f"{d}_accuracy") for d in DIMENSIONS],
    )
    return out.withColumn("accuracy", F.try_divide(F.col("verdicts_passed").cast("double"), F.col("verdicts")))


def semantic_errors(rows: DataFrame) -> DataFrame:
    """error, n: every kind of error, also those that did not occur."""
    found = rows.select(F.explode("errors").alias("error")).groupBy("error").agg(F.count("*").alias("n"))
    kinds = rows.sparkSession.createDataFrame([(e,) for e in ERRORS], "error string")
    return kinds.join(found, "error", "left").fillna(0, ["n"])


# -- routes --------------------------------------------------------------------------------------


def pair_preflight(tasks: DataFrame, references: DataFrame, sides: tuple[str, str] = ("A", "B")) -> DataFrame:
    """task_id, eligible, verdict, reason: only tasks about exactly both sides, each with accepted references, reach a model.

    tasks: task_id, scopes (array, in order), status; references: task_id, scope, one row each.
    """
    held = references.select("task_id", "scope").distinct().groupBy("task_id").agg(F.collect_set("scope").alias("held"))
    rows = tasks.join(held, "task_id", "left")
    both = F.array(*map(F.lit, sides))
    eligible = F.coalesce((F.col("scopes") == both) & (F.size(F.array_except(both, "held")) == 0), F.lit(False))
    unresolved = (F.coalesce(F.size("scopes"), F.lit(0)) <= 0) | F.coalesce(F.col("status") == "clarify", F.lit(False))
    reason = F.when(eligible, "bilateral_supported").when(unresolved, "unresolved_scope").otherwise("not_bilateral_supported")
    return rows.select("task_id", eligible.alias("eligible"), F.when(eligible, "NOT_EVALUATED").otherwise(UNKNOWN).alias("verdict"), reason.alias("reason"))


def route_breaks(truth: DataFrame, preflight: DataFrame, groups: DataFrame, oracle: DataFrame, states: DataFrame) -> DataFrame:
    """One row an expected route (task_id, route) that the saved run does not bear out: task_id, route, rule.

    preflight of pair_preflight(), groups (task_id, candidate_group), oracle (task_id, scope, expected_available),
    states (task_id, status).
    """
    empty = oracle.filter(F.col("expected_available") == F.lit(False)).select("task_id", F.lit(True).alias("empty_side")).distinct()
    rows = truth.join(preflight.select("task_id", "eligible"), "task_id", "left").join(groups.select("task_id", "candidate_group"), "task_id", "left").join(empty, "task_id", "left").join(states.select("task_id", "status"), "task_id", "left")
    route = F.col("route")
    rule = (
        F.when((route == "semantic") != F.coalesce("eligible", F.lit(False)), "other_cohort").when((route == "retrieval_bound") & ~F.col("candidate_group").eqNullSafe(F.lit("RETRIEVAL_BOUND")), "not_retrieval_bound")
        .when((route == "unsupported_side") & F.col("empty_side").isNull(), "no_unsupported_side").when((route == "unresolved_scope") & ~F.col("status").eqNullSafe(F.lit("clarify")), "not_unresolved")
    )
    return rows.select("task_id", "route", rule.alias("rule")).filter("rule IS NOT NULL")


def citation_snapshot(saved: DataFrame, registry: DataFrame) -> DataFrame:
    """task_id, assessed, authentic, provenance, bounded: how many saved citations equal the registry's, name its place, and keep the bound.

    saved as in saved_references(); registry: evidence_id, source, page, block_index, chunk_id, excerpt.
    """
    own = ["source", "page", "block_index", "chunk_id", "excerpt"]
    rows = saved.join(registry.select("evidence_id", *[F.col(c).alias(f"own_{c}") for c in own], F.lit(True).alias("known")), "evidence_id", "left")
    same = lambda names: F.coalesce(F.col("known"), F.lit(False)) & F.forall(F.array(*[F.col(c).eqNullSafe(F.col(f"own_{c}")) for c in names]), lambda x: x)
    bound = F.coalesce(F.col("known") & (F.length("excerpt") <= MAX_EXCERPT) & (F.col("span_length") == F.length("excerpt")), F.lit(False))
    return rows.groupBy("task_id").agg(F.count("*").alias("assessed"), F.count_if(same(own)).alias("authentic"), F.count_if(same(own[:4])).alias("provenance"), F.count_if(bound).alias("bounded"))


def revalidated(cited: DataFrame, observed: DataFrame, lookups: DataFrame, rendered: DataFrame) -> DataFrame:
    """cited (task_id, scope, evidence_id, excerpt) with broken: the rules that a citation of a report breaks, in order.

    It must have been observed in its scope (observed: task_id, scope, evidence_id) and looked up there (lookups:
    task_id, evidence_id, source), and its excerpt must hash like the reference rendered anew (rendered:
    evidence_id, excerpt). Within a task and scope an id is cited once.
    """
    rows = cited.withColumn("_row", F.monotonically_increasing_id())
    again = F.row_number().over(Window.partitionBy("task_id", "scope", "evidence_id").orderBy("_row")) > 1
    seen = observed.select("task_id", "scope", "evidence_id").distinct().withColumn("_seen", F.lit(True))
    held = lookups.groupBy("task_id", "evidence_id").agg(F.collect_set("source").alias("_sources"))
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    anew = rendered.select("evidence_id", digest("excerpt").alias("_digest")).dropDuplicates(["evidence_id"])
    rows = rows.withColumn("_again", again).join(seen, ["task_id", "scope", "evidence_id"], "left").join(held, ["task_id", "evidence_id"], "left").join(anew, "evidence_id", "left")
    rules = {
        "not_observed": F.col("_seen").isNull(), "not_looked_up": F.col("_sources").isNull(), "other_scope": F.col("_sources").isNotNull() & ~F.array_contains("_sources", F.col("scope")),
        "not_rendered": F.col("_digest").isNull(), "other_excerpt": F.col("_digest").isNotNull() & ~F.coalesce(digest("excerpt") == F.col("_digest"), F.lit(False)), "repeated": F.col("_again"),
    }
    broken = F.filter(F.array(*[F.when(F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]), lambda x: x.isNotNull())
    return rows.withColumn("broken", broken).select(*[f"`{c}`" for c in cited.columns], "broken")

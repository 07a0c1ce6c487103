"""Action traces and judgements: validation, eligibility, progress, budgets, outcomes and consistency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MAX_STEPS, MAX_SEARCH, MAX_LOOKUP = 12, 4, 6
#: Statuses of older traces and the ones used here.
LEGACY = {"supported": "evidence_found", "no_candidates": "no_evidence_found", "insufficient_evidence": "insufficient_scope"}
DIMENSIONS = ("object_or_field", "value", "unit", "condition_or_applicability")
#: Prices for a million tokens: cached input, other input, output (fixed values).
PRICES = (0.04, 2.0, 8.0)


def canonical_status(status: Column) -> Column:
    out = status
    for old, new in LEGACY.items():
        out = F.when(status == old, new).otherwise(out)
    return out


def _bounded(v: Column, most: int) -> Column:
    return v.isNotNull() & (F.length(F.trim(v)) > 0) & (F.length(v) <= most)


def validate_actions(rows: DataFrame, raw: str = "raw", contract: str = "evidence_reference") -> DataFrame:
    """rows with action and violation (null where the action is valid). Duplicate keys and NaN make no JSON.

    The contract says how an action ends: with outcomes for scopes, or (`copied_quote`) with quoted findings.
    """
    ending = "findings" if contract == "copied_quote" else "outcomes"
    v = F.try_parse_json(F.when(F.length(raw) <= 32_000, F.col(raw)))
    rows = rows.withColumn("_v", v)
    text = lambda path: F.try_variant_get("_v", path, "string")
    keys = F.array_sort(F.map_keys(F.try_variant_get("_v", "$", "map<string,variant>")))
    action = text("$.action")
    expect = {"SEARCH": ["action", "query", "scopes"], "LOOKUP": ["action", "evidence_id"], "CLARIFY": ["action", "question"], "FINISH": ["action", ending]}
    right = F.lit(False)
    for name, names in expect.items():
        right = right | ((action == name) & (keys == F.array(*[F.lit(n) for n in names])))
    scopes = F.try_variant_get("_v", "$.scopes", "array<string>")
    outcomes = F.try_variant_get("_v", "$.outcomes", "array<struct<scope:string,status:string,evidence_ids:array<string>>>")
    ids = lambda o: o["evidence_ids"]
    good = F.forall(
        outcomes,
        lambda o: _bounded(o["scope"], 64) & F.when(o["status"] == "evidence_found", ids(o).isNotNull() & F.size(ids(o)).between(1, 3) & (F.size(F.array_distinct(ids(o))) == F.size(ids(o))) & F.forall(ids(o), lambda e: _bounded(e, 100)))
        .when(o["status"].isin("insufficient_scope", "no_evidence_found"), ids(o).isNull()).otherwise(False),
    )
    # an outcome names its scope and status, and ids where evidence is found: nothing else
    fields = F.transform(F.try_variant_get("_v", "$.outcomes", "array<map<string,variant>>"), lambda o: F.array_sort(F.map_keys(o)))
    told = F.forall(F.arrays_zip(outcomes.alias("o"), fields.alias("f")), lambda x: F.when(x["o"]["status"] == "evidence_found", x["f"] == F.array(*[F.lit(n) for n in ("evidence_ids", "scope", "status")])).otherwise(x["f"] == F.array(F.lit("scope"), F.lit("status"))))
    good = good & told
    names = F.transform(outcomes, lambda o: o["scope"])
    quoted = F.try_variant_get("_v", "$.findings", "array<map<string,string>>")
    quotes = F.forall(quoted, lambda f: F.coalesce((F.array_sort(F.map_keys(f)) == F.array(F.lit("evidence_id"), F.lit("quote"), F.lit("scope"))) & _bounded(f["scope"], 64) & _bounded(f["evidence_id"], 100) & _bounded(f["quote"], 1000), F.lit(False)))
    violation = (
        F.when(F.col("_v").isNull(), "invalid_json").when(~F.coalesce(right, F.lit(False)), "unexpected_fields")
        .when((action == "SEARCH") & ~F.coalesce(_bounded(text("$.query"), 4000) & (F.size(scopes) == 1) & _bounded(F.get(scopes, 0), 64), F.lit(False)), "invalid_search")
        .when((action == "LOOKUP") & ~_bounded(text("$.evidence_id"), 100), "invalid_lookup").when((action == "CLARIFY") & ~_bounded(text("$.question"), 500), "invalid_clarify")
    )
    if contract == "copied_quote":
        violation = violation.when((action == "FINISH") & ~F.coalesce((F.size(quoted) <= 6) & quotes, F.lit(False)), "invalid_findings")
    else:
        violation = violation.when((action == "FINISH") & ~F.coalesce(F.size(outcomes).between(1, 4) & good, F.lit(False)), "invalid_outcomes").when((action == "FINISH") & (F.size(F.array_distinct(names)) < F.size(names)), "duplicate_scope")
    return rows.select(*[c for c in rows.columns if c != "_v"], action.alias("action"), violation.alias("violation"))


def repeats(actions: DataFrame, task: str = "task_id") -> DataFrame:
    """actions with nth: the number of this successful action so far; repeated from 2 on."""
    w = Window.partitionBy(task, "action", "input").orderBy("step")
    return actions.withColumn("nth", F.row_number().over(w)).withColumn("repeated", F.col("nth") > 1)


def budget(actions: DataFrame, task: str = "task_id") -> DataFrame:
    """Steps, searches and lookups left after each action, and whether any cap is exceeded."""
    w = Window.partitionBy(task).orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    left = lambda kind, cap: cap - F.sum(F.when(F.col("action") == kind, 1).otherwise(0)).over(w)
    out = actions.withColumn("steps_left", MAX_STEPS - F.count("*").over(w)).withColumn("searches_left", left("SEARCH", MAX_SEARCH)).withColumn("lookups_left", left("LOOKUP", MAX_LOOKUP))
    return out.withColumn("violated", (F.col("steps_left") < 0) | (F.col("searches_left") < 0) | (F.col("lookups_left") < 0))


def progress(observed: DataFrame, task: str = "task_id") -> DataFrame:
    """task, step, new_ids: how many ids (task, step, id) a step shows for the first time."""
    first = observed.groupBy(task, "id").agg(F.min("step").alias("step"))
    steps = observed.select(task, "step").distinct()
    return steps.join(first.groupBy(task, "step").agg(F.count("*").alias("new_ids")), [task, "step"], "left").withColumn("new_ids", F.coalesce("new_ids", F.lit(0)))


def first_last(actions: DataFrame, task: str = "task_id") -> DataFrame:
    return actions.groupBy(task).agg(F.min_by("input", "step").alias("first_input"), F.max_by("input", "step").alias("last_input"), F.count("*").alias("steps"), F.max_by(F.when(F.col("action") == "SEARCH", F.col("input")), F.when(F.col("action") == "SEARCH", F.col("step"))).alias("last_search"))


def outcomes(scopes: DataFrame, candidates: DataFrame, looked_up: DataFrame | None = None) -> DataFrame:
    """The deterministic policy in closed form: every scope is searched, its first candidate looked up.

    scopes (qid, scope), candidates (qid, scope, rank, evidence_id); looked_up (qid, evidence_id)
    limits which lookups succeeded. status: evidence_found, no_evidence_found or insufficient_scope.
    """
    found = candidates
    if looked_up is not None:
        found = candidates.join(looked_up.withColumn("_ok", F.lit(True)), ["qid", "evidence_id"], "left")
    ok = F.col("_ok") if looked_up is not None else F.lit(True)
    best = found.groupBy("qid", "scope").agg(F.min_by(F.when(ok, F.col("evidence_id")), F.when(ok, F.col("rank"))).alias("evidence_id"))
    out = scopes.join(best.withColumn("_any", F.lit(True)), ["qid", "scope"], "left")
    return out.select("qid", "scope", "evidence_id", F.when(F.col("_any").isNull(), "no_evidence_found").when(F.col("evidence_id").isNull(), "insufficient_scope").otherwise("evidence_found").alias("status"))


def finish(found: DataFrame, required: int | None = None) -> DataFrame:
    """qid, n_found, comparison: same_text or different_text of the quotes found, incomplete under two."""
    rows = found.filter("status = 'evidence_found'").groupBy("qid").agg(F.count("*").alias("n_found"), F.size(F.collect_set("text")).alias("n_texts"))
    return rows.select("qid", "n_found", F.when(F.col("n_found") < (required or 2), "incomplete").when(F.col("n_texts") == 1, "same_text").otherwise("different_text").alias("comparison"))


def consistent_v1() -> Column:
    """Whether a verdict agrees with its four dimension labels."""
    o, v, u, c = (F.col(d) for d in DIMENSIONS)
    return (
        F.when(F.col("verdict") == "EQUIVALENT", (o == "aligned") & (v == "aligned") & (u == "aligned") & c.isin("aligned", "not_applicable"))
        .when(F.col("verdict") == "DIFFERENT", (o == "aligned") & ((v == "different") | (u == "different") | (c == "different")))
        .when(F.col("verdict") == "NOT_COMPARABLE", (o == "different") | (c == "different"))
    )


def consistent_v2() -> Column:
    """As consistent_v1, with the basis of comparability and uncertainty."""
    o, v, u, c = (F.col(d) for d in DIMENSIONS)
    unsure = (o == "uncertain") | (v == "uncertain") | (u == "uncertain") | (c == "uncertain")
    verdict, basis = F.col("verdict"), F.col("basis")
    return (
        F.when(basis == "uncertain", (verdict == "NOT_COMPARABLE") & unsure).when(unsure, False)
        .when(verdict == "EQUIVALENT", (basis == "comparable_fact") & (o == "aligned") & (v == "aligned") & u.isin("aligned", "not_applicable") & c.isin("aligned", "not_applicable"))
        .when(verdict == "DIFFERENT", (basis == "comparable_fact") & (o == "aligned") & ((v == "different") | (u == "different") | (c == "different")))
        .when(basis == "different_object_or_field", o == "different").when(basis == "incompatible_scope_or_installation_scenario", (o == "aligned") & (c == "different")).otherwise(False)
    )


def decimal_equal(a: Column, b: Column) -> Column:
    """Plain signed decimals of equal value and equal sign, a zero's sign included; other text is never equal.

    Compared as texts without the trailing zeros of the fraction, so any number of digits counts.
    """
    plain = r"^-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?$"
    shortest = lambda x: F.when(F.contains(x, F.lit(".")), F.regexp_replace(x, r"\.?0*$", "")).otherwise(x)
    return F.coalesce(a.rlike(plain) & b.rlike(plain) & (shortest(a) == shortest(b)), F.lit(False))


def cost(prompt: Column, cached: Column, completion: Column, prices: tuple = PRICES) -> Column:
    """Settled cost: cached input apart where the parts add up, all input at the full price otherwise."""
    hit, miss, out = prices
    ok = cached.isNotNull() & (cached >= 0) & (cached <= prompt)
    return F.when((prompt >= 0) & (completion >= 0), (F.when(ok, cached * hit + (prompt - cached) * miss).otherwise(prompt * miss) + completion * out) / 1_000_000)


def reserve(events: DataFrame, arm: str, order: str, estimate: str, limit: float) -> DataFrame:
    """events with accepted: reservations in order, each taken only if the total stays within the limit.

    A refused reservation does not count, so the total is folded over an arm's (bounded) list.
    """
    rows = events.groupBy(arm).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(estimate).alias("e")))).alias("items"))

    def take(s: Column, x: Column) -> Column:
        ok = s["sum"] + x["e"] <= limit
        return F.struct(F.when(ok, s["sum"] + x["e"]).otherwise(s["sum"]).alias("sum"), F.array_append(s["out"], ok).alias("out"))

    start = F.struct(F.lit(0.0).alias("sum"), F.array().cast("array<boolean>").alias("out"))
    rows = rows.select(arm, F.explode(F.arrays_zip("items", F.aggregate("items", start, take, lambda s: s["out"]).alias("accepted"))).alias("r"))
    return rows.select(arm, F.col("r.items.o").alias(order), F.col("r.items.e").alias(estimate), F.col("r.accepted").alias("accepted"))

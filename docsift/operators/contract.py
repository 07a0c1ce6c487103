"""Actions against the state of their task: coverage, the actions a state allows as a schema, and every broken rule.

Tables, all with task_id: states (query, search_left, lookup_left, clarification), scopes (place, scope),
searches (step, scope, query, status), results (step, place, scope, evidence_id; of searches with status ok),
lookups (place, evidence_id, source, text). Two contracts: `evidence_reference` ends with an outcome for each
scope, `copied_quote` with findings that quote looked-up texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import agent, scoring

SEARCH_ARGUMENTS, LOOKUP_ARGUMENTS, MAX_FINDINGS, MAX_OUTCOMES, MAX_IDS = ("action", "query", "scopes"), ("action", "evidence_id"), 6, 4, 3
#: Coverage that needs no further search or lookup.
COVERED = ("LOOKED_UP_EVIDENCE", "NO_EVIDENCE", "INVALID_SCOPE")


def _distinct(rows: DataFrame, flag: str, *columns) -> DataFrame:
    return rows.select(*columns).distinct().withColumn(flag, F.lit(True))


def coverage(scopes: DataFrame, searches: DataFrame, results: DataFrame, lookups: DataFrame, valid: DataFrame | None = None) -> DataFrame:
    """task_id, place, scope, coverage, remaining: how far each requested scope is; valid: the known scopes, if any are unknown."""
    keys = ["task_id", "scope"]
    rows = scopes.join(_distinct(lookups, "looked", "task_id", F.col("source").alias("scope")), keys, "left")
    rows = rows.join(_distinct(results, "hits", *keys), keys, "left").join(_distinct(searches.filter("status = 'no_evidence'"), "empty", *keys), keys, "left")
    known = F.lit(True)
    if valid is not None:
        rows = rows.join(_distinct(valid, "known", "scope"), "scope", "left")
        known = F.coalesce("known", F.lit(False))
    told = F.when(~known, "INVALID_SCOPE").when(F.col("looked"), "LOOKED_UP_EVIDENCE").when(F.col("hits"), "CANDIDATES_OBSERVED").when(F.col("empty"), "NO_EVIDENCE").otherwise("UNSEARCHED")
    return rows.select("task_id", "place", "scope", told.alias("coverage"), (~told.isin(*COVERED)).alias("remaining"))


def _object(**properties: Column) -> Column:
    names = list(properties)
    return F.struct(F.lit("object").alias("type"), F.struct(*[v.alias(k) for k, v in properties.items()]).alias("properties"), F.array(*map(F.lit, names)).alias("required"), F.lit(False).alias("additionalProperties"))


def _const(value: Column | str) -> Column:
    return F.struct((F.lit(value) if isinstance(value, str) else value).alias("const"))


def _string(**more: Column) -> Column:
    return F.struct(F.lit("string").alias("type"), *[v.alias(k) for k, v in more.items()])


def _array(items: Column, least: int | None, most: int | Column) -> Column:
    bounds = ([F.lit(least).alias("minItems")] if least is not None else []) + [(F.lit(most) if isinstance(most, int) else most).alias("maxItems")]
    return F.struct(F.lit("array").alias("type"), items.alias("items"), *bounds)


def _joined(parts: Column) -> Column:
    return F.concat(F.lit('{"oneOf":['), F.array_join(F.filter(parts, lambda x: x.isNotNull()), ","), F.lit("]}"))


def _listed(rows: DataFrame, order: list[str], value: str, name: str, keys: tuple = ("task_id",)) -> DataFrame:
    """keys, name: the values in order; a task's lists are bounded by its budgets."""
    out = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*order, value))).alias("x"))
    return out.select(*keys, F.transform("x", lambda r: r[value]).alias(name))


def _eligible(states: DataFrame, scopes: DataFrame, searches: DataFrame, results: DataFrame, lookups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Scopes that may be searched (task_id, place, scope) and ids that may be looked up (task_id, step, place, evidence_id)."""
    asked = scopes.join(states.select("task_id", "query"), "task_id")
    first = results.groupBy("task_id", "evidence_id").agg(F.min(F.struct("step", "place")).alias("at"))
    ids = scoring.eligible_lookups(results, lookups).select("task_id", "evidence_id").distinct().join(first, ["task_id", "evidence_id"])
    return scoring.eligible_searches(asked, searches).select("task_id", "place", "scope"), ids.select("task_id", "at.step", "at.place", "evidence_id")


def _looked(results: DataFrame, lookups: DataFrame) -> DataFrame:
    """Lookups of a scope's own candidates: task_id, scope, place, evidence_id."""
    candidates = results.select("task_id", "scope", "evidence_id").distinct()
    return lookups.select("task_id", F.col("source").alias("scope"), "place", "evidence_id").join(candidates, ["task_id", "scope", "evidence_id"], "left_semi")


def schemas(states: DataFrame, scopes: DataFrame, searches: DataFrame, results: DataFrame, lookups: DataFrame, contract: str = "evidence_reference") -> DataFrame:
    """task_id, schema: the JSON schema of the actions that each state allows."""
    _check(contract)
    may_search, may_look = _eligible(states, scopes, searches, results, lookups)
    rows = states.join(_listed(may_search, ["place"], "scope", "open_scopes"), "task_id", "left").join(_listed(may_look, ["step", "place"], "evidence_id", "open_ids"), "task_id", "left")
    ready = coverage(scopes, searches, results, lookups).groupBy("task_id").agg((~F.bool_or("remaining")).alias("ready"), F.count("*").cast("int").alias("n_scopes"))
    rows = rows.join(ready, "task_id", "left")
    action = lambda kind, **more: F.to_json(_object(action=_const(kind), **more))
    search = F.when((F.col("search_left") > 0) & (F.size("open_scopes") > 0), action("SEARCH", query=_const(F.col("query")), scopes=_array(_string(enum=F.col("open_scopes")), 1, 1)))
    look = F.when((F.col("lookup_left") > 0) & (F.size("open_ids") > 0), action("LOOKUP", evidence_id=_string(enum=F.col("open_ids"))))
    clarify = action("CLARIFY", question=_string())
    if contract == "copied_quote":
        clarify = F.when(F.coalesce(F.trim("clarification"), F.lit("")) != "", clarify)
        rows = rows.join(_listed(lookups, ["place"], "evidence_id", "held"), "task_id", "left").join(_listed(scopes, ["place"], "scope", "all_scopes"), "task_id", "left")
        finding = lambda a, b: _object(scope=a, evidence_id=b, quote=_string())
        some = action("FINISH", findings=_array(finding(_string(enum=F.col("all_scopes")), _string(enum=F.col("held"))), None, MAX_FINDINGS))
        finish = F.when(F.size("held") > 0, some).otherwise(action("FINISH", findings=_array(finding(_string(), _string()), None, 0)))
    else:
        looked = _listed(_looked(results, lookups), ["place"], "evidence_id", "looked", ("task_id", "scope"))
        each = scopes.join(_distinct(results, "candidates", "task_id", "scope"), ["task_id", "scope"], "left").join(looked, ["task_id", "scope"], "left")
        outcome = lambda status, **more: F.to_json(_object(scope=_const(F.col("scope")), status=_const(status), **more))
        ids = _array(_string(minLength=F.lit(1), maxLength=F.lit(100), enum=F.col("looked")), 1, MAX_IDS)
        any_looked = F.size("looked") > 0
        variants = F.array(
            F.when(any_looked, outcome("evidence_found", evidence_ids=ids)), F.when(F.col("candidates").isNull(), outcome("no_evidence_found")),
            F.when(F.col("candidates") & any_looked, outcome("insufficient_scope")),
        )
        each = each.select("task_id", "place", F.filter(variants, lambda x: x.isNotNull()).alias("variants"))
        rows = rows.join(_listed(each, ["place"], "variants", "outcomes"), "task_id", "left")
        end = F.concat(
            F.lit('{"type":"object","properties":{"action":{"const":"FINISH"},"outcomes":{"type":"array","items":'), _joined(F.flatten("outcomes")), F.lit(',"minItems":'), F.col("n_scopes").cast("string"),
            F.lit(',"maxItems":'), F.col("n_scopes").cast("string"), F.lit('}},"required":["action","outcomes"],"additionalProperties":false}'),
        )
        finish = end
    return rows.select("task_id", _joined(F.array(search, look, clarify, F.when(F.col("ready"), finish))).alias("schema"))


def _check(contract: str) -> None:
    if contract not in ("copied_quote", "evidence_reference"):
        raise ValueError(f"unknown contract {contract!r}")


def violations(
    actions: DataFrame, states: DataFrame, scopes: DataFrame, searches: DataFrame, results: DataFrame, lookups: DataFrame, active: DataFrame | None = None, contract: str = "evidence_reference"
) -> DataFrame:
    """One row a broken rule: action_id, task_id, action, rule, detail (the scope or id it is about).

    actions: action_id (unique), task_id, raw. active: the evidence ids of the running session, where known.
    An action that breaks a rule of form is held to no other.
    """
    _check(contract)
    shaped = agent.validate_actions(actions.select("action_id", "task_id", "raw"), contract=contract)
    v = F.try_parse_json("raw")
    get = lambda path, kind="string": F.try_variant_get(v, path, kind)
    good = shaped.filter("violation is null").select(
        "action_id", "task_id", "action", get("$.query").alias("query"), get("$.scopes[0]").alias("scope"), get("$.evidence_id").alias("evidence_id"),
        get("$.outcomes", "array<struct<scope:string,status:string,evidence_ids:array<string>>>").alias("outcomes"), get("$.findings", "array<struct<scope:string,evidence_id:string,quote:string>>").alias("findings"),
    )
    head = ["action_id", "task_id", "action"]
    told = [shaped.filter("violation is not null").select(*head, F.col("violation").alias("rule"), F.lit(None).cast("string").alias("detail"))]

    def broken(rows: DataFrame, detail: str | None, **rules: Column) -> None:
        """Keeps the rules that hold for a row as broken."""
        names = F.array(*[F.when(F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()])
        found = rows.withColumn("rule", F.explode(F.filter(names, lambda x: x.isNotNull())))
        told.append(found.select(*head, "rule", (F.col(detail) if detail else F.lit(None)).cast("string").alias("detail")))

    may_search, may_look = _eligible(states, scopes, searches, results, lookups)
    known = _distinct(scopes, "resolved", "task_id", "scope")
    candidates = _distinct(results, "candidate", "task_id", "scope", "evidence_id")
    held = lookups.select("task_id", "evidence_id", "source", "text")

    search = good.filter("action = 'SEARCH'").drop("evidence_id").join(states.select("task_id", F.col("query").alias("own_query")), "task_id", "left").join(known, ["task_id", "scope"], "left")
    search = search.join(_distinct(may_search, "may", "task_id", "scope"), ["task_id", "scope"], "left")
    right = F.col("resolved").isNotNull() & F.col("query").eqNullSafe(F.col("own_query"))
    broken(search, "scope", search_differs_from_task=~right, repeated_search=right & F.col("may").isNull())

    look = good.filter("action = 'LOOKUP'").drop("scope").join(_distinct(results, "observed", "task_id", "evidence_id"), ["task_id", "evidence_id"], "left")
    look = look.join(_distinct(held, "done", "task_id", "evidence_id"), ["task_id", "evidence_id"], "left").join(_distinct(may_look, "may", "task_id", "evidence_id"), ["task_id", "evidence_id"], "left")
    seen = F.col("observed").isNotNull()
    broken(look, "evidence_id", unobserved_evidence=~seen, repeated_lookup=seen & F.col("done"), uncovered_scope_first=seen & F.col("done").isNull() & F.col("may").isNull())

    if contract == "copied_quote":
        clarify = good.filter("action = 'CLARIFY'").join(states.select("task_id", "clarification"), "task_id", "left")
        broken(clarify, None, no_missing_constraint=F.coalesce(F.trim("clarification"), F.lit("")) == "")

    finish = good.filter("action = 'FINISH'")
    open_ = coverage(scopes, searches, results, lookups).filter("remaining").select("task_id", F.col("scope").alias("open_scope"))
    some = _distinct(scopes, "any_scope", "task_id")
    broken(finish.join(open_, "task_id"), "open_scope", scope_not_covered=F.lit(True))
    broken(finish.join(some, "task_id", "left"), None, no_scopes=F.col("any_scope").isNull())
    if contract == "copied_quote":
        each = finish.select(*head, F.posexplode("findings").alias("at", "f")).select(*head, "at", "f.*").join(known, ["task_id", "scope"], "left").join(held, ["task_id", "evidence_id"], "left")
        first = finish.select("action_id", F.posexplode("findings").alias("at", "f")).groupBy("action_id", F.col("f.evidence_id").alias("evidence_id")).agg(F.min("at").alias("first_at"))
        each = each.join(first, ["action_id", "evidence_id"])
        there = F.col("source").isNotNull()
        broken(
            each, "evidence_id", not_looked_up=~there, unknown_scope=F.col("resolved").isNull(), other_source=there & (F.col("scope") != F.col("source")),
            quote_not_in_text=there & ~F.contains("text", "quote"), repeated_evidence=F.col("at") > F.col("first_at"),
        )
    else:
        outcomes = finish.select(*head, F.posexplode("outcomes").alias("at", "o")).select(*head, "at", "o.*")
        scope_of = outcomes.select("action_id", "scope").distinct()
        missing = finish.select(*head).join(scopes.select("task_id", "scope"), "task_id").join(scope_of, ["action_id", "scope"], "left_anti")
        broken(missing, "scope", scope_missing=F.lit(True))
        looked = _distinct(_looked(results, lookups), "looked", "task_id", "scope")
        outcomes = outcomes.join(known, ["task_id", "scope"], "left").join(_distinct(results, "candidates", "task_id", "scope"), ["task_id", "scope"], "left").join(looked, ["task_id", "scope"], "left")
        any_ = F.col("candidates").isNotNull()
        broken(
            outcomes, "scope", unknown_scope=F.col("resolved").isNull(), contradicts_candidates=(F.col("status") == "no_evidence_found") & any_,
            needs_looked_up_candidate=(F.col("status") == "insufficient_scope") & F.col("looked").isNull(),
        )
        ids = outcomes.filter("status = 'evidence_found'").select(*head, "at", "scope", F.explode("evidence_ids").alias("evidence_id"))
        first = ids.groupBy("action_id", "evidence_id").agg(F.min("at").alias("first_at"))
        ids = ids.join(first, ["action_id", "evidence_id"]).join(candidates, ["task_id", "scope", "evidence_id"], "left").join(held, ["task_id", "evidence_id"], "left")
        live = F.lit(True)
        if active is not None:
            ids = ids.join(_distinct(active, "live", "evidence_id"), "evidence_id", "left")
            live = F.coalesce("live", F.lit(False))
        broken(
            ids, "evidence_id", not_a_candidate=F.col("candidate").isNull(), not_looked_up=F.col("source").isNull(), other_source=F.col("source") != F.col("scope"), not_active=~live, repeated_evidence=F.col("at") > F.col("first_at"),
        )
    out = told[0]
    for rows in told[1:]:
        out = out.unionByName(rows)
    return out


def verdicts(actions: DataFrame, violations: DataFrame) -> DataFrame:
    """actions with accepted and n_violations."""
    n = violations.groupBy("action_id").agg(F.count("*").alias("n_violations"))
    out = actions.join(n, "action_id", "left").withColumn("n_violations", F.coalesce("n_violations", F.lit(0)))
    return out.withColumn("accepted", F.col("n_violations") == 0)

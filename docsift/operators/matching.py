"""Text matchers of the evaluations: term groups with boundaries, and critical tokens with their recall."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsift.functions import text as T

from . import native

# -- term groups ---------------------------------------------------------------------------------


def alignment_normal(text: Column | str) -> Column:
    """Compatibility form in lower case, commands and times signs of formulas resolved, without blanks, braces, carets and underscores."""
    out = F.lower(T.compatible(text))
    out = F.replace(F.replace(F.replace(out, F.lit(r"\times"), F.lit("x")), F.lit("×"), F.lit("x")), F.lit("²"), F.lit("2"))
    return F.regexp_replace(F.regexp_replace(out, r"\\[a-z]+", ""), rf"(?U)(?:{T.WHITE}|[{{}}^_\\])", "")


def _quoted(term: Column) -> Column:
    return F.regexp_replace(term, r"([\\.\[\]{}()*+?^$|/&#~<>-])", r"\\$1")


def term_in(text: Column, term: Column, units: bool = False) -> Column:
    """Whether a normalised text holds a normalised term: numbers (also multiplied ones) not within a longer number, units not within a longer word."""
    number = term.rlike(r"^\d+(?:\.\d+)?(?:x\d+(?:\.\d+)?)?$")
    held = F.when(number, F.regexp_like(text, F.concat(F.lit(r"(?<![\d.])"), _quoted(term), F.lit(r"(?![\d.])"))))
    if units:
        held = held.when(term.rlike(r"^[a-z]+\d*$"), F.regexp_like(text, F.concat(F.lit("(?<![a-z])"), _quoted(term), F.lit(r"(?![a-z\d])"))))
    return held.otherwise(F.contains(text, term))


def term_groups(terms: DataFrame, item: str = "item_id") -> DataFrame:
    """item, and for each kind (field, unit, condition) its groups as arrays of normalised terms.

    terms: item, kind, group_no, term; one row a term. An item's groups are few; a kind without rows is null.
    """
    rows = terms.withColumn("term", alignment_normal("term")).groupBy(item, "kind", "group_no").agg(F.sort_array(F.collect_set("term")).alias("terms"))
    rows = rows.groupBy(item, "kind").agg(F.sort_array(F.collect_list(F.struct("group_no", "terms"))).alias("g")).select(item, "kind", F.transform("g", lambda x: x["terms"]).alias("groups"))
    return rows.groupBy(item).agg(*[F.first(F.when(F.col("kind") == kind, F.col("groups")), True).alias(f"{kind}_groups") for kind in ("field", "unit", "condition")])


def aligned(text: Column, groups: Column, units: bool = False) -> Column:
    """Every group has a term in the normalised text; null without groups."""
    return F.when(F.size(groups) > 0, F.forall(groups, lambda g: F.exists(g, lambda t: term_in(text, t, units))))


def review(findings: DataFrame, quote: str = "quote") -> DataFrame:
    """findings with field_alignment, unit_alignment, condition_alignment, scope_alignment and label.

    findings: quote, evidence_source, evidence_page (null without evidence), scope, reviewed, expected_available,
    pages and the columns of term_groups(). Without a review, or where it says nothing about availability, the
    label is UNCERTAIN and the alignments are null.
    """
    rows = findings.withColumn("_text", alignment_normal(quote))
    told = F.coalesce(F.col("reviewed"), F.lit(False)) & F.col("expected_available").isNotNull()
    rows = rows.withColumns({
        "field_alignment": F.when(told, aligned(F.col("_text"), F.col("field_groups"))), "unit_alignment": F.when(told, aligned(F.col("_text"), F.col("unit_groups"), True)),
        "condition_alignment": F.when(told, aligned(F.col("_text"), F.col("condition_groups"))),
        "scope_alignment": F.when(told, F.coalesce(F.col("evidence_source") == F.col("scope"), F.lit(False)) & F.coalesce(F.array_contains("pages", F.col("evidence_page")), F.lit(False))),
    })
    label = (
        F.when(~told, "UNCERTAIN").when(~F.col("expected_available") | ~F.col("scope_alignment") | F.coalesce(~F.col("field_alignment"), F.lit(False)), "IRRELEVANT").when(F.col("field_alignment").isNull(), "UNCERTAIN")
        .when(F.coalesce(~F.col("unit_alignment"), F.lit(False)) | F.coalesce(~F.col("condition_alignment"), F.lit(False)), "PARTIAL").otherwise("RELEVANT")
    )
    return rows.withColumn("label", label).drop("_text")


# -- critical tokens -----------------------------------------------------------------------------

#: Units that count as critical (fixed values), their folded forms from the longest, and the patterns of the scanner.
UNITS = (
    "MPa", "kPa", "Pa", "bar", "psi", "µm", "μm", "um", "mm²", "m²", "mm", "cm", "km", "m³", "kg", "mg", "g", "t", "MW", "kW", "W", "kV", "mV",
    "V", "kA", "mA", "A", "Hz", "rpm", "mL", "L", "N·m", "Nm", "°C", "℃", "°F", "%", "dB", "DN", "PN", "SN", "IP",
)
TOKEN = r"(?<![A-Za-z0-9])[A-Za-z0-9]+(?:[._/-][A-Za-z0-9]+)*(?![A-Za-z0-9])"
NUMBER = r"(?<![A-Za-z0-9._-])[+-]?(?:\d+(?:[.,]\d+)?|\.\d+)(?![0-9.])"
SYMBOL = r"(?iu)%|℃|°[CF]|µm|μm|m²|mm²|m³"
LITERAL, MULTIPLIED = r"^[+-]?(?:\d+(?:[.,]\d+)?|\.\d+)$", r"^(?i)\d+(?:x\d+)+$"


def folded_units() -> list[str]:
    import unicodedata

    return sorted({unicodedata.normalize("NFKC", u).casefold() for u in UNITS}, key=lambda u: (-len(u), u))


def critical_tokens(fields: DataFrame, keys: list[str], text: str = "field") -> DataFrame:
    """keys, kind (code, number or unit), token: the critical tokens of all fields of a key, each once in its normal form.

    A token that is a unit, or a number with a unit attached, gives these; another one of letters and digits
    is a code; numbers outside codes keep their sign.
    """
    rows = fields.select(*keys, T.compatible(text).alias("text"))
    rows = rows.withColumn("_field", F.monotonically_increasing_id())
    own = [*keys, "_field"]
    text_of = rows.select("_field", "text")
    units = F.array(*map(F.lit, folded_units()))
    found = native.matches(rows, TOKEN, own).join(text_of, "_field").withColumn("norm", F.lower("found"))
    suffix = F.get(F.filter(units, lambda u: F.endswith(F.col("norm"), u) & (F.length("norm") > F.length(u))), 0)
    found = found.withColumn("unit", suffix).withColumn("prefix", F.expr("left(norm, length(norm) - length(unit))"))
    before, further = F.expr("substring(text, char_start, 1)"), F.expr("substring(text, char_start - 1, 1)")
    signed = (F.col("char_start") > 0) & before.isin("+", "-") & ((F.col("char_start") == 1) | ~further.rlike(r"^[\p{L}\p{N}]$"))
    whole = F.array_contains(units, F.col("norm"))
    pair = lambda kind, token: F.struct(F.lit(kind).alias("kind"), token.alias("token"))
    literal, several = F.coalesce(F.col("prefix").rlike(LITERAL), F.lit(False)), F.coalesce(F.col("prefix").rlike(MULTIPLIED), F.lit(False))
    numbers = F.transform(F.regexp_extract_all("prefix", F.lit(r"\d+"), F.lit(0)), lambda n: pair("number", n))
    code = F.col("found").rlike("[A-Za-z]") & F.col("found").rlike(r"\d")
    told = (
        F.when(whole, F.array(pair("unit", F.col("norm")))).when(literal, F.array(pair("number", F.concat(F.when(signed, before).otherwise(""), F.col("prefix"))), pair("unit", F.col("unit"))))
        .when(several, F.concat(numbers, F.array(pair("unit", F.col("unit"))))).when(code, F.array(pair("code", F.col("norm"))))
    )
    found = found.withColumn("told", told)
    codes = found.filter(~whole & ~literal & ~several & code).select(*own, "char_start", "char_end")
    number = native.matches(rows, NUMBER, own)
    inside = native.overlapping(number, codes, own).select(*own, "nth").distinct()
    number = number.join(inside, [*own, "nth"], "left_anti").select(*keys, F.lit("number").alias("kind"), F.col("found").alias("token"))
    symbol = native.matches(rows, SYMBOL, own).select(*keys, F.lit("unit").alias("kind"), T.evidence_normal("found").alias("token"))
    out = found.select(*keys, F.explode("told").alias("t")).select(*keys, "t.kind", "t.token").unionByName(number).unionByName(symbol)
    return out.distinct()


def present(text: Column, kind: Column, token: Column) -> Column:
    """Whether a normalised text holds a critical token that nothing of its kind continues."""
    edge = lambda c: F.concat(F.lit(f"(?<![{c}])"), _quoted(token), F.lit(f"(?![{c}])"))
    return F.regexp_like(text, F.when(kind == "number", edge("0-9.")).when(kind == "code", edge("a-z0-9")).otherwise(edge("a-z")))


def analyse(cases: DataFrame, fields: DataFrame, keys: list[str], output: str = "output") -> DataFrame:
    """Counts of each case: expected and matched fields and critical tokens, normalized_hit, strict_hit. cases: keys, output; fields: keys, field."""
    fields = fields.filter(F.length(T.strip("field")) > 0)
    texts = cases.select(*keys, T.evidence_normal(F.coalesce(F.col(output), F.lit(""))).alias("_text"))
    f = fields.select(*keys, T.evidence_normal("field").alias("norm")).join(texts, keys)
    f = f.groupBy(*keys).agg(F.count("*").alias("expected_fields"), F.count_if(F.contains("_text", "norm")).alias("matched_fields"))
    t = critical_tokens(fields, keys).join(texts, keys)
    t = t.groupBy(*keys).agg(F.count("*").alias("expected_tokens"), F.count_if(present(F.col("_text"), F.col("kind"), F.col("token"))).alias("matched_tokens"))
    rows = cases.drop(output).join(f, keys, "left").join(t, keys, "left").fillna(0, ["expected_fields", "matched_fields", "expected_tokens", "matched_tokens"])
    hit = (F.col("expected_fields") > 0) & (F.col("expected_fields") == F.col("matched_fields"))
    return rows.withColumn("normalized_hit", hit).withColumn("strict_hit", hit & (F.col("expected_tokens") == F.col("matched_tokens")))


def recall(cases: DataFrame, by: list[str]) -> DataFrame:
    """Micro-averaged recall of fields and critical tokens over the cases of a group; null where nothing is expected."""
    sums = cases.groupBy(*by).agg(
        F.count("*").alias("cases"), F.count_if("strict_hit").alias("strict_hits"), F.count_if("normalized_hit").alias("full_hits"),
        *[F.sum(c).alias(c) for c in ("matched_fields", "expected_fields", "matched_tokens", "expected_tokens")],
    )
    return sums.withColumn("field_recall", F.coalesce(F.try_divide("matched_fields", "expected_fields"), F.lit(0.0))).withColumn("token_recall", F.try_divide("matched_tokens", "expected_tokens")).withColumn("token_errors", F.col("expected_tokens") - F.col("matched_tokens"))

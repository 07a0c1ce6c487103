"""Critical fields: parser value against native text, with confusable characters and safe resolution."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docsift.functions import text as T

# Fixed values.
#: Pairs of characters that recognition confuses.
CONFUSABLE = ("O0", "I1", "l1", "B8", "S5")
#: Full-width punctuation and what it is read as.
PUNCTUATION = {"（": "(", "）": ")", "［": "[", "］": "]", "｛": "{", "｝": "}", "，": ",", "、": ",", "；": ";", "：": ":"}
LIST_SEPARATORS = "[；、;,，]"
#: A diameter: its sign, a number, a unit.
DIAMETER = r"(?i)^\s*\$?\s*(?:¢|φ|Φ|Ø|\\phi)\s*([0-9]+(?:\.[0-9]+)?)\s*(mm|cm|m)\s*\$?\s*$"


def normal(value: Column, field_type: Column) -> Column:
    """Full-width delimiters folded; list separators unified and lone slashes dropped where the type says so; no white space."""
    out = F.translate(F.coalesce(value, F.lit("")), "".join(PUNCTUATION), "".join(PUNCTUATION.values()))
    out = F.when(field_type == "port_config", F.regexp_replace(out, LIST_SEPARATORS, ";")).otherwise(out)
    out = F.when(field_type.isin("model", "port_config"), F.regexp_replace(out, r"(?U)\s+/\s+", " ")).otherwise(out)
    return F.regexp_replace(out, r"(?U)\s+", "")


def check(parser: Column, native: Column, field_type: Column, reliable: Column, unique: Column) -> Column:
    """struct(comparison, passed, review_required, resolved_value, n_differences)."""
    a, b = normal(parser, field_type), normal(native, field_type)
    n = F.greatest(F.length(a), F.length(b))
    pairs = F.filter(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.struct(F.substring(a, i, F.lit(1)).alias("p"), F.substring(b, i, F.lit(1)).alias("q"))), lambda x: x["p"] != x["q"])
    known = F.array(*[F.lit(x) for p in CONFUSABLE for x in (p, p[::-1])])
    confusable = (F.size(pairs) > 0) & F.forall(pairs, lambda x: F.array_contains(known, F.concat(x["p"], x["q"])))
    zero_to_o = F.forall(pairs, lambda x: (x["p"] == "0") & (x["q"] == "O"))
    number = lambda v: F.concat(F.regexp_extract(v, DIAMETER, 1), F.lit(" "), F.lower(F.regexp_extract(v, DIAMETER, 2)))
    diameter = (field_type == "model") & parser.rlike(DIAMETER) & native.rlike(DIAMETER) & (number(parser) == number(native))
    resolve = confusable & reliable & unique & field_type.isin("model", "identifier") & zero_to_o
    comparison = (
        F.when(b == "", "native_text_missing").when(a == b, "normalized_equal").when(F.coalesce(diameter, F.lit(False)), "contextual_diameter_symbol_equivalence")
        .when(F.coalesce(resolve, F.lit(False)), "unique_native_o_zero_candidate").when(confusable, "confusable_without_deterministic_resolution").otherwise("critical_difference")
    )
    passed = comparison.isin("normalized_equal", "contextual_diameter_symbol_equivalence", "unique_native_o_zero_candidate")
    value = F.when(comparison == "unique_native_o_zero_candidate", native).when(passed, parser)
    return F.struct(comparison.alias("comparison"), passed.alias("passed"), (~passed).alias("review_required"), value.alias("resolved_value"), F.when(b != "", F.size(pairs)).alias("n_differences"))

"""Text functions as Column expressions; general Unicode forms as pandas UDFs."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

DASHES = "‐‑‒–—−"
TOKEN = r"[a-z0-9]+(?:[-_/.][a-z0-9]+)*|[\u3400-\u9fff]+"
WHITE = r"[\s\x1c-\x1f\x85]"
#: All characters of the Unicode white space property, and the four separators of ASCII.
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Leading and trailing Unicode white space removed, as text editors see it."""
    return F.btrim(col(c), F.lit(BLANKS))


def casefold(c: Column | str) -> Column:
    """Case folding for texts in normal form: lower case with the sharp s resolved."""
    return F.replace(F.lower(col(c)), F.lit("ß"), F.lit("ss"))


@F.pandas_udf(S.StringType())
def casefold_nfkc(texts: pd.Series) -> pd.Series:
    """Compatibility normal form and full case folding of any text."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).casefold())


@F.pandas_udf(S.StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """Compatibility normal form of any text."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


#: A character that the compatibility form or full case folding may change, beyond what casefold() does.
SPECIAL = r"[^\x00-\x7f\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0134-\u013e\u0141-\u0148\u014a-\u017e\u0410-\u044f\u3001\u3002\u3400-\u4dbf\u4e00-\u9fff‐‒–—−“”‘’]"


def special(c: Column | str) -> Column:
    """Whether a text holds a SPECIAL character; ASCII is taken away first, which is the cheaper test."""
    return F.coalesce(F.regexp_replace(col(c), r"[\x00-\x7f]+", "").rlike(SPECIAL), F.lit(False))


def compatible(c: Column | str) -> Column:
    """Compatibility normal form. Only texts with a special character go to Python."""
    c = col(c)
    return F.coalesce(nfkc(F.when(special(c), c)), c)


def folded(c: Column | str) -> Column:
    """Compatibility normal form, case folded. Only texts with a special character go to Python."""
    c = col(c)
    return F.coalesce(casefold_nfkc(F.when(special(c), c)), casefold(c))


def fold_column(rows: DataFrame, text: str) -> DataFrame:
    """rows with the text folded in place, in one pass over them: Python is handed nulls but for texts with a special character."""
    return rows.withColumn(text, folded(text))


def evidence_normal(c: Column | str, general: bool = True) -> Column:
    """Folded and without white space, so layout cannot hide a match. general=False: for texts in normal form, as inside lambdas."""
    return F.regexp_replace(folded(c) if general else casefold(c), rf"(?U){WHITE}+", "")


def evidence_normals(texts: Column | str) -> Column:
    """evidence_normal() of each of an array of texts, in one pass."""
    texts = col(texts)
    return F.when(F.size(texts) > 0, F.split(evidence_normal(F.array_join(texts, "\x01", "")), "\x01")).otherwise(F.when(texts.isNotNull(), F.array().cast("array<string>")))


def tokens(c: Column | str) -> Column:
    """Identifiers kept whole; runs of CJK characters give single characters and adjacent pairs."""
    return token_list(folded(c))


def token_list(folded: Column) -> Column:
    """The tokens of a folded text; one without a CJK character, which is asked of the whole text, has none to cut up."""
    found = F.regexp_extract_all(F.translate(folded, DASHES, "-" * len(DASHES)), F.lit(TOKEN), F.lit(0))

    def spread(t: Column) -> Column:
        n = F.length(t)
        single = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(t, i, F.lit(1)))
        pair = F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring(t, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
        return F.when(t.rlike(r"^[\u3400-\u9fff]"), F.concat(single, pair)).otherwise(F.array(t))

    return F.when(folded.rlike(r"[\u3400-\u9fff]"), F.flatten(F.transform(found, spread))).otherwise(found)


def readable(c: Column | str) -> Column:
    """Inline payloads become a blank and characters that do not print are dropped; line ends and blanks are normalised."""
    out = F.regexp_replace(col(c), r"(?i)data:image/[^\s<>\"']+|base64,[A-Za-z0-9+/=_-]+", " ")
    out = F.regexp_replace(out, r"[\p{Cc}\p{Cf}\p{Cs}\p{Co}\p{Cn}\p{Zl}\p{Zp}\p{Zs}&&[^\n\r\t ]]", "")
    out = F.regexp_replace(out, r"\r\n?", "\n")
    return strip(F.regexp_replace(F.regexp_replace(out, r"[\t ]+", " "), r" *\n *", "\n"))


def char_tokens(c: Column | str) -> Column:
    """Single letters, digits and CJK characters, folded."""
    return F.regexp_extract_all(F.lower(col(c)), F.lit(r"[a-z0-9]|[\u4e00-\u9fff]"), F.lit(0))


def word_tokens(c: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(col(c)), F.lit(r"[a-z0-9]+|[\u4e00-\u9fff]"), F.lit(0))


def number_count(c: Column | str) -> Column:
    return F.regexp_count(col(c), F.lit(r"[0-9]+(?:[.,][0-9]+)?"))


def solid_length(c: Column | str) -> Column:
    """Characters that are not white space."""
    return F.length(F.regexp_replace(col(c), rf"(?U){WHITE}+", ""))


def contains_all(texts: Column, keywords: Column) -> Column:
    """Every keyword inside some single text; true for no keywords. Both sides normalised already."""
    return F.forall(keywords, lambda k: F.exists(texts, lambda t: F.contains(t, k)))


def query_features(query: Column | str) -> dict[str, Column]:
    """Overlapping feature flags of a query."""
    found = tokens(query)
    return {
        "identifier": F.exists(found, lambda t: t.rlike("[-_/]") | (t.rlike("[a-z]") & t.rlike("[0-9]"))),
        "numeric": F.exists(found, lambda t: t.rlike("[0-9]")),
        "latin": F.exists(found, lambda t: t.rlike("[a-z]")),
        "acronym_like": col(query).rlike(r"\b[A-Z]{2,}\b"),
        "cjk": F.exists(found, lambda t: t.rlike(r"[\u3400-\u9fff]")),
    }


def after_think(c: Column | str) -> Column:
    """What follows the last closing think tag."""
    return strip(F.substring_index(col(c), "</think>", -1))


def escape_markdown(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"([\\`*_{}\[\]<>#|])", r"\\$1")


def blockquote(c: Column | str) -> Column:
    return F.concat(F.lit("> "), F.regexp_replace(col(c), "\n", "\n> "))


def redact_paths(c: Column | str) -> Column:
    """Local file paths replaced by a mark."""
    return F.regexp_replace(col(c), r"(?:[A-Za-z]:\\|/(?:home|root|Users|tmp)/)[^\s\"']+", "[path]")


def char_diff(a: Column | str, b: Column | str) -> Column:
    """0-based positions at which two strings differ; the shorter one is padded."""
    a, b = col(a), col(b)
    n = F.greatest(F.length(a), F.length(b))
    where = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(F.substring(a, i + 1, F.lit(1)) != F.substring(b, i + 1, F.lit(1)), i))
    return F.when(n > 0, F.filter(where, lambda i: i.isNotNull())).otherwise(F.array().cast("array<int>"))


def bounded_contains(text: Column | str, literal: Column | str) -> Column:
    """The literal occurs with no letter, digit or decimal point continuing it on either side."""
    quoted = F.regexp_replace(col(literal), r"([\\.\[\]{}()*+?^$|])", r"\\$1")
    return F.regexp_like(col(text), F.concat(F.lit(r"(?<![\w.])"), quoted, F.lit(r"(?![\w]|\.\d)")))

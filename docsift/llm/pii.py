"""Format-preserving Feistel pseudonyms for validated numbers, dates, addresses and secrets.

Each value found is checked (card numbers by their check digit, addresses by their octets, dates by
the calendar), then permuted within its own format by a keyed balanced Feistel network with cycle
walking: equal values get equal pseudonyms in every document, different values different ones, and
the format (digit count, separators, check digit, calendar) stays. The key is a parameter, or the session's
spark.docsift.pseudonym.key.

    kind    found                                          kept as it is
    email   local@domain, local of 64 characters at most   @, dots, the top-level domain
    ip      four octets 0 to 255                           dots; every octet stays an octet
    card    12 to 19 digits, grouped or not, valid Luhn    separators, length, validity
    phone   +country (area) number, 7 to 15 digits         country code, punctuation
    ssn     ddd-dd-dddd                                    dashes
    date    yyyy-mm-dd, dd.mm.yyyy, mm/dd/yyyy, valid      order, separators, validity (1900-2099)
    secret  hex of 32 and more; quoted keys and tokens     length, case, quotes

A number that fails its check digit is no card and stays as it is.

Edge cases: null texts stay null; empty texts stay empty; a value that fails its check is left to
the next kind or alone; documents without a value come back unchanged; repeated rows give equal rows; an
empty table gives an empty one; all other columns are kept, whatever their names, but for those of the counts.
"""

from __future__ import annotations

import datetime
import hashlib
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEY_CONF = "spark.docsift.pseudonym.key"
DEMO_KEY = b"docsift-demo-key"  # for tables without real values; set KEY_CONF or the parameter for others
KINDS = ("email", "ip", "card", "phone", "ssn", "date", "secret")
ROUNDS = 8
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|\d{1,2})"
_DATE = r"(?<![\w.])(?P<date>\d{4}-\d{2}-\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4})(?!(?![Tt]\d)\w)"
_PHONE = r"(?<!\w)(?P<phone>\+\d{1,3}[ .-]?(?:\(\d{2,4}\)|\d{2,4})(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}-\d{4}|\d{3}-\d{3}-\d{4})(?!\d)"
_CARD = r"(?<![\w.])(?P<card>\d(?:[ -]?\d){11,18})(?!\w)"
_SECRET = r"(?<!\w)(?P<secret>(?:[0-9a-f]{32,}|[0-9A-F]{32,}|(?:sk|pk|ghp|gho|xox[abp]|AKIA|AIza)[-_]?[A-Za-z0-9_-]{12,}))(?!\w)"
PATTERN = re.compile(
    r"(?<![A-Za-z0-9_])(?P<email>[A-Za-z0-9_][\w.%+-]{0,63}@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,})"
    rf"|(?<![\d.])(?P<ip>{_OCTET}(?:\.{_OCTET}){{3}})(?![\d]|\.\d)"
    r"|(?<![\w-])(?P<ssn>\d{3}-\d{2}-\d{4})(?![\w-])"
    rf"|{_DATE}|{_PHONE}|{_CARD}|{_SECRET}"
    r"|(?P<quoted>(?i:token|secret|password|passwd|api_?key)\s*[=:]\s*[\"'])(?P<value>[^\"'\s]{6,})"
)

#: What may still match where a value fails its check: the later kinds at the same place.
_LATER = {"date": [re.compile(x) for x in (_PHONE, _CARD, _SECRET)], "card": [re.compile(_SECRET)]}
_LONGEST_CARDS = [re.compile(rf"\d(?:[ -]?\d){{{n - 1}}}(?!\w)") for n in range(18, 11, -1)]


def _round(key: bytes, context: str, i: int, half: int, size: int) -> int:
    """Keyed round value (a sponge over the key first), 64 bits wider than the side."""
    told = len(key).to_bytes(4, "big") + key + f"{context}|{i}|{half:x}".encode()
    return int.from_bytes(hashlib.shake_256(told).digest(size.bit_length() // 8 + 9), "big") % size


def permute(value: int, size: int, key: bytes, context: str, inverse: bool = False) -> int:
    """A keyed permutation of 0 .. size - 1: a Feistel network over two halves, walked until in range."""
    if size < 2:
        return value
    side = math.isqrt(size - 1) + 1
    while True:
        left, right = divmod(value, side)
        for i in range(ROUNDS):
            if inverse:
                k = ROUNDS - 1 - i
                left, right = (right - _round(key, context, k, left, side)) % side, left
            else:
                left, right = right, (left + _round(key, context, i, right, side)) % side
        value = left * side + right
        if value < size:
            return value


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(text: str, key: bytes, context: str, keep: int = 0) -> str:
    """All digits of the text but the first `keep` permuted together, the rest unchanged."""
    own = [c for c in text if c.isdigit()][keep:]
    new = iter(str(permute(int("".join(own)), 10 ** len(own), key, f"{context}{len(own)}")).zfill(len(own)))
    seen, out = 0, []
    for c in text:
        if c.isdigit():
            seen += 1
            out.append(next(new) if seen > keep else c)
        else:
            out.append(c)
    return "".join(out)


def _letters(text: str, key: bytes, context: str) -> str:
    """Lower-case letters, capitals and digits permuted within their own alphabets, all at once."""
    sizes = [26 if c.isascii() and c.isalpha() else 10 if c.isascii() and c.isdigit() else 1 for c in text]
    size, value = 1, 0
    for c, n in zip(text, sizes):
        size *= n
        value = value * n + (0 if n == 1 else ord(c.lower()) - 97 if n == 26 else ord(c) - 48)
    shape = "".join("-" if n == 1 else "9" if n == 10 else "A" if c.isupper() else "a" for c, n in zip(text, sizes))
    value, out = permute(value, size, key, f"{context}{shape}"), []
    for c, n in zip(reversed(text), reversed(sizes)):
        value, d = divmod(value, n)
        out.append(c if n == 1 else chr(d + 48) if n == 10 else chr(d + (65 if c.isupper() else 97)))
    return "".join(reversed(out))


def _hex(text: str, key: bytes) -> str:
    new = f"{permute(int(text, 16), 16 ** len(text), key, f'hex{len(text)}'):0{len(text)}x}"
    return new.upper() if text.upper() == text else new


def _date(text: str, key: bytes) -> str | None:
    order = ("%Y-%m-%d",) if text[4] == "-" else ("%d.%m.%Y",) if "." in text else ("%m/%d/%Y", "%d/%m/%Y")
    first, last = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()
    for form in order:
        try:
            day = datetime.datetime.strptime(text, form).date().toordinal()
        except ValueError:
            continue
        if first <= day <= last:
            return datetime.date.fromordinal(first + permute(day - first, last - first + 1, key, "date")).strftime(form)
    return None


@lru_cache(maxsize=20_000)
def pseudonym(kind: str, text: str, key: bytes) -> tuple[str, str] | None:
    """(kind, pseudonym) of a value that passes its check; None: leave it."""
    if kind == "email":
        local, domain = text.rsplit("@", 1)
        name, top = domain.rsplit(".", 1)
        return "email", f"{_letters(local, key, 'local')}@{_letters(name, key, 'domain')}.{top}"
    if kind == "ip":
        n = 0
        for part in text.split("."):
            n = n << 8 | int(part)
        n = permute(n, 1 << 32, key, "ip")
        return "ip", ".".join(str(n >> s & 255) for s in (24, 16, 8, 0))
    if kind == "card":
        digits = re.sub(r"\D", "", text)
        if not luhn(digits):
            return None
        body = str(permute(int(digits[:-1]), 10 ** (len(digits) - 1), key, f"card{len(digits)}")).zfill(len(digits) - 1)
        check = next(c for c in "0123456789" if luhn(body + c))
        new = iter(body + check)
        return "card", "".join(next(new) if c.isdigit() else c for c in text)
    if kind == "phone":
        m = re.match(r"\+(\d{1,3})", text)
        keep = len(m.group(1)) if m and not text[m.end() : m.end() + 1].isdigit() else 0
        return "phone", _digits(text, key, "phone", keep)
    if kind == "ssn":
        return "ssn", _digits(text, key, "ssn")
    if kind == "date":
        new = _date(text, key)
        return None if new is None else ("date", new)
    if re.fullmatch(r"[0-9a-f]{2,}|[0-9A-F]{2,}", text):
        return "secret", _hex(text, key)
    return "secret", _letters(text, key, "secret")


def replace(text: str, key: bytes, counts: list[int]) -> str:
    """The text with every value replaced; counts grows by KINDS."""

    def tries(m: re.Match) -> Iterator[tuple[str, int, int]]:
        """(kind, start, end) of the match, then of shorter card numbers and of the later kinds from its start."""
        kind = m.lastgroup
        yield "secret" if kind == "value" else kind, *m.span(kind)
        for later in (m, *filter(None, (p.match(text, m.start()) for p in _LATER.get(kind, ())))):
            if later is not m:
                yield later.lastgroup, *later.span()
            if later.lastgroup == "card":
                yield from (("card", *x.span()) for x in (p.match(text, m.start()) for p in _LONGEST_CARDS) if x and x.end() < later.end())

    out, done, at = [], 0, 0
    while m := PATTERN.search(text, at):
        at = m.start() + 1  # a number that is no value may still hold one
        for kind, start, end in tries(m):
            found = pseudonym(kind, text[start:end], key)
            if found is not None:
                counts[KINDS.index(found[0])] += 1
                out += [text[done:start], found[1]]
                done = at = end
                break
    return "".join([*out, text[done:]])


#: Found in every text that PATTERN finds something in.
_MAYBE = re.compile(r"[\d@]|(?i:token|secret|passw|api_?key)|[a-f]{32}|[A-F]{32}|(?:sk|pk|gh[po]|xox[abp]|AKIA|AIza)[-_]?[A-Za-z0-9_-]{12}")


def key_of(spark: SparkSession, demo: bool = False) -> bytes:
    found = spark.conf.get(KEY_CONF, None)
    if not found and not demo:
        raise ValueError(f"set {KEY_CONF} or give a key: whoever knows the key can undo the pseudonyms (demo=True takes a public one)")
    return found.encode() if found else DEMO_KEY


def pseudonymise(docs: DataFrame, text: str = "text", key: bytes | None = None, demo: bool = False) -> DataFrame:
    """docs with the text replaced and a count for each kind: n_<kind>, n_values.

    The key is the one given, else that of the session; demo: a public key where there is neither. Columns of
    the counts' names that docs may already have are replaced.
    """
    key = key_of(docs.sparkSession, demo) if key is None else key
    names = [f"n_{k}" for k in KINDS]
    schema = [f for f in docs.schema.fields if f.name not in (*names, "n_values")]
    position = [f.name for f in schema].index(text)
    docs = docs.select(*[F.col(f"`{f.name}`") for f in schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, found = [], []
            for t in batch.column(position).to_pylist():
                counts = [0] * len(KINDS)
                out.append(replace(t, key, counts) if t and _MAYBE.search(t) else t)
                found.append(counts)
            cols = [batch.column(i) if i != position else pa.array(out, pa.string()) for i in range(batch.num_columns)]
            cols += [pa.array([c[i] for c in found], pa.int64()) for i in range(len(KINDS))] + [pa.array([sum(c) for c in found], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, [*batch.schema.names, *names, "n_values"])

    return docs.mapInArrow(run, T.StructType([*schema, *[T.StructField(n, T.LongType()) for n in (*names, "n_values")]]))

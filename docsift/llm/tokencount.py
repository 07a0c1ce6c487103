"""Token counts by the whole-token shortcut.

Offline, the driver proves which vocabulary strings encode alone as exactly one token (proved()). In the
tasks a text is cut into pre-tokens; those of the proved set count as one token each, directly; only the
rest are merged, by the tokenizer itself, each distinct one once while a worker's table holds it. A
pre-token is encoded independently of its neighbours, so the sum is the count of the whole text.

The cut is made by a pattern over the lower-cased text. It holds for texts whose characters the tokenizer's
own normaliser and pre-tokeniser treat alike; that is tried for every character a worker meets. Texts with
another character (marks that may compose, a capital sigma) or with one of the vocabulary's special strings
are counted by the tokenizer as a whole.

Edge cases: a null or empty text has 0 bytes and 0 tokens; repeated rows are counted each; a null id is
kept; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vocabularies

VOCABULARY, LIMIT = "word_bpe_49k.json", 2048
HELD, HELD_CHARS = 500_000, 64  # pre-tokens a worker remembers, and the longest of them
#: The vocabulary's pre-tokenising pattern (fixed value).
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


def _composes(c: str) -> bool:
    """Whether a normal form may join c to the character before, or is not known here."""
    return unicodedata.category(c) in ("Mn", "Mc", "Me", "Cn") or "ᄀ" <= c <= "ᇿ" or "ꥠ" <= c <= "ꥼ" or "ힰ" <= c <= "ퟻ"


def proved(path: str) -> frozenset[str]:
    """The vocabulary strings that are one pre-token and encode alone as one token."""
    tool, back, found = vocabularies.tool(path), vocabularies.byte_alphabet(), set()
    suffix = tool.model.end_of_word_suffix or ""
    for entry in tool.get_vocab(with_added_tokens=False):
        if not entry.endswith(suffix) or len(entry) == len(suffix):
            continue
        own = entry[: len(entry) - len(suffix)]
        if not all(c in back for c in own):
            continue
        try:
            text = bytes(back[c] for c in own).decode("utf-8")
        except UnicodeDecodeError:
            continue
        if PATTERN.findall(text) == [text] and not any(map(_composes, text)) and len(tool.encode(text, add_special_tokens=False).ids) == 1:
            found.add(text)
    return frozenset(found)


class Counter:
    """Counts whole texts; `whole` are the proved strings."""

    def __init__(self, path: str, whole: frozenset[str]) -> None:
        self.tool, self.whole, self.held = vocabularies.tool(path), whole, {}
        self.special = [x.content for x in self.tool.get_added_tokens_decoder().values()]
        shown = {b: c for c, b in vocabularies.byte_alphabet().items()}
        self.agreed = vocabularies.Agreed(
            lambda probe: not any(map(_composes, probe))
            and [w for w, _ in self.tool.pre_tokenizer.pre_tokenize_str(self.tool.normalizer.normalize_str(probe))] == ["".join(shown[b] for b in w.encode()) for w in PATTERN.findall(probe.lower())]
        )

    def merged(self, word: str) -> int:
        n = self.held.get(word)
        if n is None:
            n = len(self.tool.encode(word, add_special_tokens=False).ids)
            if len(word) <= HELD_CHARS:
                if len(self.held) >= HELD:
                    self.held.clear()
                self.held[word] = n
        return n

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        if any(s in text for s in self.special) or not self.agreed(text):
            return len(self.tool.encode(text, add_special_tokens=False).ids)
        words, whole = PATTERN.findall(text.lower()), self.whole
        rest = [w for w in words if w not in whole]
        return len(words) - len(rest) + sum(map(self.merged, rest))


@lru_cache(maxsize=2)
def counter(path: str, whole: frozenset[str]) -> Counter:
    return Counter(path, whole)


def count(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than `limit` tokens)."""
    path = path or vocabularies.place(VOCABULARY)
    whole = docs.sparkSession.sparkContext.broadcast(proved(path))  # at most the vocabulary, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = counter(path, whole.value)
        for batch in batches:
            n = pa.array([tokens(t.as_py()) for t in batch.column(2)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), n], ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"), "text")
    return rows.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_tokens bigint").withColumn("over_limit", F.col("n_tokens") > limit)

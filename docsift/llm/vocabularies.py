"""Tokenizer files for the operators: byte forms of ids, and characters on which two tools agree."""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from functools import lru_cache

#: The pre-tokenising pattern of byte-level files (fixed value).
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def place(name: str) -> str:
    """The path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_alphabet() -> dict[str, int]:
    """The byte behind each character of byte-level vocabularies: printable ones stand for themselves, the rest follow from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}


@lru_cache(maxsize=4)
def tool(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    import tokenizers

    return tokenizers.Tokenizer.from_file(path)


@lru_cache(maxsize=4)
def byte_level(path: str) -> tuple[list[bytes], object] | None:
    """(bytes of each id, tiktoken over the same merges) of a plain byte-level file; None where it asks for more."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    model, split, added = file["model"], file.get("pre_tokenizer") or {}, {x["content"] for x in file.get("added_tokens") or []}
    plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    plain = plain and not file.get("normalizer") and split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
    if not plain:
        return None
    back = byte_alphabet()
    ranks = {bytes(back[c] for c in token): i for token, i in model["vocab"].items() if token not in added and all(c in back for c in token)}
    spelled = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, i in ranks.items():
        spelled[i] = token
    return spelled, tiktoken.Encoding("file", pat_str=BYTE_PATTERN, mergeable_ranks=ranks, special_tokens={})


class Agreed:
    """Tells texts all of whose characters two tools treat alike.

    How a pattern splits a text depends on each character's class only, so every character is tried once a
    worker, between neighbours of each class; a text with a character that fails goes to the reference tool.
    """

    def __init__(self, same: Callable[[str], bool]) -> None:
        self.same, self.good, self.bad = same, set(), set()

    def __call__(self, text: str) -> bool:
        held = set(text)
        for c in held - self.good - self.bad:
            (self.good if self.same(f"a{c}a {c} 1{c}1 !{c}! {c}{c}  {c} '{c} 's{c} a{c}") else self.bad).add(c)
        return not self.bad or self.bad.isdisjoint(held)

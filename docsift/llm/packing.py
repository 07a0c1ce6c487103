"""Mixture-controlled packing: deficit round-robin over source queues into fixed token windows.

Documents are tokenised once and dealt by a hash of their row to parts of about PART_TOKENS tokens. The ids
are those of tokenizers; for a plain byte-level file they are computed by tiktoken from the same file, at a
quarter of the CPU time. Both split a text by the classes of its characters, so each worker has both encode
every character it meets, among neighbours of each class; texts with a character on which they differ go to
tokenizers. In a part every source has a queue; for each window of WINDOW_TOKENS tokens a source's quantum is its
target share plus the deficit it carries, and exactly that many tokens are taken from its queue, so
documents may be cut at window and sequence ends. A part starts with the deficits that all earlier
parts leave behind (prefix sums over the parts), so the proportions hold across parts, too. An
exhausted queue leaves its quantum to the others. Windows are cut into sequences of SEQUENCE tokens;
only a part's last sequence is not full.

Edge cases: a null text counts as empty and becomes the end token alone; a null source is a source of
its own; without target weights the corpus's own proportions are the target; a source without weight
has target 0 and is served when the others are exhausted; repeated rows are separate documents, also
when their id is null, and go to different parts; a text may hold the vocabulary's added tokens, which
get their ids; an empty table gives no pieces. Other columns are ignored.
"""

from __future__ import annotations

import json
import math
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _shared, vocabularies

SEQUENCE, WINDOW_TOKENS, PART_TOKENS, END_ID = 1024, 64 * 1024, 2_000_000, 0
BATCH_BYTES = 1_000_000  # characters encoded at once
VOCABULARY = "byte_bpe_50k.json"
#: The pre-tokenising pattern of byte-level files.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def encoder(path: str):
    """(tokenizers, tiktoken) of a tokenizer file; tiktoken is None where the file asks for more than byte-level BPE."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    import tiktoken
    import tokenizers

    tool = tokenizers.Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    model, split, added = file["model"], file.get("pre_tokenizer") or {}, file.get("added_tokens") or []
    names = [x["content"] for x in added]
    plain = (
        model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")) and not file.get("normalizer")
        and split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
        and not any(x.get(k) for x in added for k in ("lstrip", "rstrip", "single_word")) and not any(a != b and a.startswith(b) for a in names for b in names)
    )
    fast = None
    if plain:
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
        back = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        ranks = {bytes(back[c] for c in token): i for token, i in model["vocab"].items() if token not in names and all(c in back for c in token)}
        fast = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={x.content: i for i, x in tool.get_added_tokens_decoder().items()})
    return tool, fast


class Encoder:
    """The ids that tokenizers gives for whole texts."""

    def __init__(self, path: str) -> None:
        self.tool, self.fast = encoder(path)
        self.agreed = vocabularies.Agreed(lambda probe: self.fast.encode(probe, allowed_special="all") == self.tool.encode(probe, add_special_tokens=False).ids)

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        ids = [self.fast.encode(t, allowed_special="all") if self.fast is not None and self.agreed(t) else None for t in texts]
        rest = [k for k, x in enumerate(ids) if x is None]
        for k, x in zip(rest, self.tool.encode_batch_fast([texts[k] for k in rest], add_special_tokens=False)):
            ids[k] = x.ids
        return [np.asarray(x, "<u4") for x in ids]


def tokenise(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, source, row (a number of its own), n_tokens (with the end token), ids (little-endian, without it).

    A document's ids are held in 16 bits each where all of them fit, else in 32.
    """
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, row = Encoder(path), TaskContext.get().partitionId() << 33
        for batch in batches:
            at = 0
            texts = [t or "" for t in batch.column(2).to_pylist()]
            while at < len(texts):
                end, held = at, 0
                while end < len(texts) and (end == at or held + len(texts[end]) <= BATCH_BYTES):
                    held += len(texts[end])
                    end += 1
                own, ids = batch.slice(at, end - at), encode(texts[at:end])
                yield pa.RecordBatch.from_arrays(
                    [own.column(0), own.column(1), pa.array(np.arange(row, row + len(ids))), pa.array([len(x) + 1 for x in ids], pa.int64()), pa.array([(x if x.max(initial=0) > 0xFFFF else x.astype("<u2")).tobytes() for x in ids], pa.binary())],
                    ["doc_id", "source", "row", "n_tokens", "ids"],
                )
                row, at = row + len(ids), end

    return docs.select("doc_id", "source", "text").mapInArrow(run, "doc_id bigint, source string, row bigint, n_tokens bigint, ids binary")


def quanta(tokens: np.ndarray, share: np.ndarray, carried: np.ndarray, window: int) -> Iterator[np.ndarray]:
    """Tokens to take from each queue for each window, until all queues are empty."""
    left, deficit = tokens.astype(np.int64).copy(), carried.astype(np.float64).copy()

    def split(open_: np.ndarray) -> np.ndarray:
        own = np.where(open_, share, 0.0)
        return own / own.sum() if own.sum() else open_ / open_.sum()

    while left.sum():
        size = min(window, int(left.sum()))
        deficit = np.where(left > 0, deficit, 0.0) + split(left > 0) * size
        take = np.minimum(np.floor(np.maximum(deficit, 0)).astype(np.int64), left)
        if take.sum() > size:  # carried deficits may ask for more than a window holds
            take = np.floor(take * (size / take.sum())).astype(np.int64)
        short = size - int(take.sum())
        while short:  # what exhausted queues and fractions leave goes to the others by their shares
            room = left - take
            more = np.minimum(np.floor(split(room > 0) * short).astype(np.int64), room)
            if not more.any():  # the last tokens, one each, to those who are owed most
                owed = np.argsort(-np.where(room > 0, deficit - take, -np.inf), kind="stable")
                more[owed[: min(short, int((room > 0).sum()))]] = 1
            take += more
            short -= int(more.sum())
        deficit -= take
        left -= take
        yield take


def plan_part(lengths: list[np.ndarray], share: np.ndarray, carried: np.ndarray, window: int = WINDOW_TOKENS, sequence: int = SEQUENCE) -> Iterator[tuple[int, int, int, int, int]]:
    """(queue, document in queue, start in document, length, position in the part's stream) of each piece."""
    bounds = [np.concatenate([[0], np.cumsum(x)]) for x in lengths]
    done, at = np.zeros(len(lengths), np.int64), 0
    for take in quanta(np.array([b[-1] for b in bounds]), share, carried, window):
        for q in np.flatnonzero(take):
            a, end = int(done[q]), int(done[q] + take[q])
            d = int(np.searchsorted(bounds[q], a, side="right")) - 1
            while a < end:
                n = min(int(bounds[q][d + 1]) - a, end - a, sequence - at % sequence)
                yield int(q), d, a - int(bounds[q][d]), n, at
                a, at = a + n, at + n
                d += a == bounds[q][d + 1]
            done[q] = end


def pack(docs: DataFrame, weights: dict | None = None, path: str | None = None, window: int = WINDOW_TOKENS, sequence: int = SEQUENCE, part_tokens: int = PART_TOKENS) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source."""
    spark = docs.sparkSession
    path = path or vocabulary_path()
    tokens = _shared.stored(tokenise(docs, path), "pack-tokens")
    total = tokens.agg(F.sum("n_tokens")).first()[0] or 0
    parts = max(1, math.ceil(total / part_tokens))
    # by the row, not the id: rows that repeat an id, or have none, are dealt apart
    tokens = tokens.withColumn("part", F.pmod(F.xxhash64("doc_id", "row"), F.lit(parts)).cast("int"))
    sums = _shared.stored(tokens.groupBy("part", "source").agg(F.sum("n_tokens").alias("tokens")), "pack-sums")
    by_source = sums.groupBy("source").agg(F.sum("tokens").alias("target"))
    if weights is not None:
        given = spark.createDataFrame([(k, float(v)) for k, v in weights.items()], "w_source string, target double")
        by_source = by_source.select("source").join(F.broadcast(given), F.col("source").eqNullSafe(F.col("w_source")), "left").select("source", F.coalesce("target", F.lit(0.0)).alias("target"))
    whole = by_source.agg(F.sum("target")).first()[0] or None
    shares = by_source.select(F.col("source").alias("s_source"), (F.col("target") / F.lit(whole).cast("double")).alias("share"))
    totals = sums.groupBy("part").agg(F.sum("tokens").alias("part_tokens")).withColumn("sequences", F.ceil(F.col("part_tokens") / sequence))
    totals = _shared.running(_shared.running(totals, "part", "part_tokens", "before"), "part", "sequences", "first_sequence")
    totals = totals.select(F.col("part").alias("t_part"), "before", "first_sequence")
    start = (
        _shared.running(sums, "part", "tokens", "served", ["source"]).join(totals, F.col("part") == F.col("t_part"))
        .join(shares, F.col("source").eqNullSafe(F.col("s_source")))
        .select("part", "source", F.coalesce("share", F.lit(0.0)).alias("share"), (F.coalesce("share", F.lit(0.0)) * F.col("before") - F.col("served")).alias("carried"), "first_sequence")
    )

    def run(docs: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        start = start.assign(none=start["source"].isna(), name=start["source"].fillna("")).sort_values(["none", "name"])
        queue = {(none, name): q for q, (none, name) in enumerate(zip(start["none"], start["name"]))}
        docs = docs.assign(queue=[queue[none, name] for none, name in zip(docs["source"].isna(), docs["source"].fillna(""))])
        docs = docs.sort_values(["queue", "doc_id", "n_tokens", "ids"], kind="stable")
        cuts = np.searchsorted(docs["queue"].to_numpy(), np.arange(len(start) + 1))
        share = start["share"].to_numpy(float)
        share = share / share.sum() if share.sum() else np.full(len(share), 1 / len(share))
        first, out = int(start["first_sequence"].iloc[0]), []
        lengths, ids = docs["n_tokens"].to_numpy(np.int64), docs["ids"].tolist()
        doc_ids, names = [None if pd.isna(x) else int(x) for x in docs["doc_id"]], [None if none else name for none, name in queue]
        for q, d, at, n, position in plan_part([lengths[a:b] for a, b in zip(cuts, cuts[1:])], share, start["carried"].to_numpy(float), window, sequence):
            k = cuts[q] + d
            whole = int(lengths[k])
            width = 4 if len(ids[k]) == 4 * (whole - 1) else 2
            own = np.frombuffer(ids[k][width * at : width * min(at + n, whole - 1)], f"<u{width}").astype("<u4").tobytes() + END_ID.to_bytes(4, "little") * (at + n == whole)
            out.append((doc_ids[k], at, n, zlib.crc32(own), whole, first + position // sequence, position % sequence, names[q]))
        out = list(zip(*out)) if out else [[]] * 8
        kinds = ["Int64", "int64", "int64", "int64", "int64", "int64", "int64", object]
        return pd.DataFrame({c: pd.Series(v, dtype=k) for c, v, k in zip(("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source"), out, kinds)})

    return tokens.groupBy("part").cogroup(start.groupBy("part")).applyInPandas(
        run, "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, source string"
    )

"""Substring deduplication with prefix-partitioned suffix trees.

A suffix matters only if its first `window` words also begin a suffix of another document. Three
steps find and group these suffixes:

1. Anchors. Of the word k-grams in a window the one with the smallest hash is its anchor, so equal
   windows have equal anchors. Only anchors (about a fifth of all positions) are shuffled; an anchor
   that stands in one document only rules out all its windows, without loss.
2. Suffixes. The windows around shared anchors become suffix keys: 128 bits whose leading bits hash
   the first word, then the first two, four, eight and all thirteen words, so that sorted keys are the
   leaves of a suffix tree cut at the window's depth, its nodes read at these depths.
3. Prefixes of variable length. Shared anchors are counted in buckets of fixed number. A suffix is dealt by
   its first four words, by eight where the bucket of its anchor holds more than GROUP_ROWS anchors, and by
   all thirteen where it holds eight times as many; equal windows have equal anchors, so they meet. A
   partition is read in key order in groups of about GROUP_ROWS leaves, cut where neighbours share the
   shortest prefix.
4. In each group's subtree the internal nodes are the runs of leaves that share a prefix. Those at full
   depth are the repeated windows; all their leaves but those of the smallest document are marked, and
   marks that overlap are one maximal repeat (passages() returns these spans).

Equal documents are one class before all this: the windows of every copy but the first are repeats.
Hot repeats are combined before the shuffle: within a batch, only the rows of the smallest document
of a node (or, for anchors, one row) go to its partition; the others are decided on the spot.

Edge cases: null texts have no words; documents shorter than a window lose nothing; a repeat within
one document alone is kept; rows that repeat an id are one document for the comparison, their texts
are searched and cut each on its own, and each row is returned; null ids are never removed from and remove nothing; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _shared, _text

WINDOW, GRAM, GROUP_ROWS = 13, 6, 200_000
#: (words, bits) of the nested prefix hashes in the first half of a key
LEVELS = ((1, 10), (2, 10), (4, 12), (8, 12), (13, 20))
PREFIX_BITS = (32, 20)  # bits of a key behind the first four and the first eight words
ANCHOR_BUCKETS, TEXT_BITS = 1 << 12, (1 << 31) - 1
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def _minima(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the smallest value (the first of equals) of each run of `width` values."""
    best, at, span = values.copy(), np.arange(len(values)), 1
    while span < width:
        hop = min(span, width - span)
        n = len(best) - hop
        if n <= 0:
            return np.zeros(0, np.int64)
        right = best[hop:] < best[:n]
        best, at, span = np.where(right, best[hop:], best[:n]), np.where(right, at[hop:], at[:n]), span + hop
    return at


def anchors(data: np.ndarray, offsets: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Word hashes, first words, window starts, anchor position and anchor hash of each window."""
    begin, end, first = _text.words(data, offsets)
    hashes = _text.span_hash(data, begin, end, _text.BYTE_CODES[0])
    starts = _text.window_starts(first, window)
    if not len(starts):
        return hashes, first, starts, starts, np.zeros(0, np.uint64)
    grams = _text.window_hash(hashes, np.arange(len(hashes) - gram + 1), gram)
    at = _minima(grams, window - gram + 1)[starts]
    return hashes, first, starts, at, grams[at]


def suffix_keys(hashes: np.ndarray, starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The nested prefix key and an independent hash of each window."""
    key = np.zeros(len(starts), np.uint64)
    for words, bits in LEVELS:
        own = _text.window_hash(hashes, starts, min(words, window))
        key = key << np.uint64(bits) | own >> np.uint64(64 - bits)
    return key, _text.window_hash(_text.mix(hashes), starts, window, 1)


def base(docs: DataFrame) -> DataFrame:
    """doc_id, text_key (a hash of the text), n_words, all_sha256 (of all words joined by single spaces)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, sha = [], []
            for t in batch.column(1).to_pylist():
                words = t.encode().split() if t else []
                n.append(len(words))
                sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "text_key", "n_words", "all_sha256"])

    return docs.select("doc_id", "text", "text_key").mapInArrow(run, "doc_id bigint, text_key bigint, n_words bigint, all_sha256 string")


def shared_anchors(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(doc_id, position, value) of the anchors that stand in two documents or more."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for a, b, data, off in _text.slices(batch.column(1)):
                _, first, _, at, value = anchors(data, off, window, gram)
                at, once = np.unique(at, return_index=True)
                value = value[once]
                owner = np.searchsorted(first, at, side="right") - 1
                doc, position = ids[a:b][owner], at - first[owner]
                # an anchor that two documents of this slice hold is shared: one row tells the others
                order = np.lexsort((doc, value))
                v, d = value[order], doc[order]
                new = np.append(True, v[1:] != v[:-1])
                group = np.cumsum(new) - 1
                lo = np.flatnonzero(new)
                hi = np.append(lo[1:], len(v)) - 1
                known = (d[lo] != d[hi])[group] if len(v) else np.zeros(0, bool)
                tells = known & new
                route = np.where(known & ~tells, _text.mix(order.astype(np.uint64) + v), v).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(route), pa.array(v.astype(np.int64)), pa.array(d), pa.array(position[order].astype(np.int32)), pa.array(known), pa.array(tells)], ["route", "value", "doc_id", "position", "known", "tells"])

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come in order of (value, doc_id); a value's first document waits until a second one shows."""
        value = first_doc = None
        waiting: list[pa.RecordBatch] = []
        shared = False
        for batch in batches:
            if not batch.num_rows:
                continue
            v, d, known, tells = batch.column(1).to_numpy(), batch.column(2).to_numpy(), batch.column(4).to_numpy(zero_copy_only=False), batch.column(5).to_numpy(zero_copy_only=False)
            decided = known.copy()
            open_rows = ~known | tells
            at = np.flatnonzero(open_rows)
            if len(at):
                vo, do = v[at], d[at]
                new = np.append(True, vo[1:] != vo[:-1])
                group = np.cumsum(new) - 1
                lo = np.flatnonzero(new)
                hi = np.append(lo[1:], len(vo)) - 1
                many = (do[lo] != do[hi]) | np.logical_or.reduceat(known[at], lo)
                if value is not None and vo[0] == value:
                    many[0] |= shared or do[hi[0]] != first_doc or do[lo[0]] != first_doc
                    if many[0]:
                        yield from waiting
                        waiting = []
                    origin = first_doc
                else:
                    waiting = []
                    origin = do[lo[0]]
                decided[at] = many[group]
                end = len(lo) - 1
                if end:
                    waiting, origin = [], do[lo[end]]
                value, first_doc, shared = vo[-1], origin, bool(many[end])
                if not shared:
                    waiting.append(pa.RecordBatch.from_arrays([batch.column(2), batch.column(3), batch.column(1)], ["doc_id", "position", "value"]).take(pa.array(at[group == end])))
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(3), batch.column(1)], ["doc_id", "position", "value"]).filter(pa.array(decided))

    rows = docs.select("doc_id", "text").mapInArrow(emit, "route bigint, value bigint, doc_id bigint, position int, known boolean, tells boolean")
    return rows.repartition("route").sortWithinPartitions("value", "doc_id").mapInArrow(decide, "doc_id bigint, position int, value bigint")


def subtree(key: np.ndarray, tail: np.ndarray) -> np.ndarray:
    """How many LEVELS each suffix of a sorted group shares with the one before."""
    depth = np.zeros(len(key), np.int8)
    if len(key) > 1:
        differ = key[1:] ^ key[:-1]
        bits = 64
        for k, (_, own) in enumerate(LEVELS, 1):
            bits -= own
            depth[1:][(differ >> np.uint64(bits)) == 0] = k
        depth[1:][(depth[1:] == len(LEVELS)) & (tail[1:] != tail[:-1])] = len(LEVELS) - 1
    return depth


def internal_nodes(depth: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last leaf of the subtree's internal nodes at a level: runs of two leaves and more that share it."""
    inside = np.append(depth >= level, False)
    inside[0] = False
    first = np.flatnonzero(~inside[:-1] & inside[1:])
    return first, np.flatnonzero(inside[:-1] & ~inside[1:])


def behind_first(key: np.ndarray, tail: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The smallest document of each leaf's deepest node, the leaf's own if it is in none at full depth.

    Leaves are sorted by document within a node, so a node's first leaf belongs to its smallest document.
    """
    first, last = internal_nodes(subtree(key, tail), len(LEVELS)) if len(key) else (np.zeros(0, np.int64),) * 2
    least, size = doc.copy(), last - first + 1
    at = np.repeat(first, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    least[at] = np.repeat(doc[first], size)
    return least


def crowded_anchors(spots: DataFrame, group_rows: int) -> np.ndarray:
    """How much longer than four words the prefix of each bucket of anchors is: 0, 1 (eight words) or 2 (all)."""
    bucket = F.col("value").bitwiseAND(F.lit(ANCHOR_BUCKETS - 1))
    out = np.zeros(ANCHOR_BUCKETS, np.int8)
    for r in spots.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n")).filter(F.col("n") > group_rows).collect():  # ANCHOR_BUCKETS rows at most
        out[r["bucket"]] = 1 + (r["n"] > 8 * group_rows)
    return out


def repeats(docs: DataFrame, spots: DataFrame, window: int, gram: int, group_rows: int) -> DataFrame:
    """(doc_id, start) of the windows that also start in a smaller document.

    start holds 31 bits of the text's hash above the position, which tells texts of one id apart.
    """
    longer = crowded_anchors(spots, group_rows)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists, texts = batch.column(0).to_numpy(), batch.column(2), batch.column(3).to_numpy()
            for a, b, data, off in _text.slices(batch.column(1)):
                hashes, first, starts, at, value = anchors(data, off, window, gram)
                own = lists.slice(a, b - a)
                n_spots = own.value_lengths().to_numpy(zero_copy_only=False)
                spot = own.flatten().to_numpy() + np.repeat(first[:-1], n_spots)
                spot = spot[spot < np.repeat(first[1:], n_spots)]  # rows that repeat an id may be shorter
                chosen = np.zeros(len(hashes) + 1, bool)
                chosen[spot] = True
                kept = chosen[at]
                starts, value = starts[kept], value[kept]
                key, tail = suffix_keys(hashes, starts, window)
                owner = np.searchsorted(first, starts, side="right") - 1
                doc, start = ids[a:b][owner], starts - first[owner] + ((texts[a:b][owner] & TEXT_BITS) << 32)
                order = np.lexsort((doc, tail, key))
                key, tail, doc, start = key[order], tail[order], doc[order], start[order]
                more = longer[(value[order] & np.uint64(ANCHOR_BUCKETS - 1)).astype(np.int64)]
                # leaves behind the slice's smallest document are repeats already; they go anywhere
                known = doc > behind_first(key, tail, doc)
                cell = np.select([known, more == 0, more == 1], [_text.mix(tail + np.arange(len(tail), dtype=np.uint64)), *[_text.mix(key >> np.uint64(bits)) for bits in PREFIX_BITS]], _text.mix(key ^ tail)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(key.astype(np.int64)), pa.array(tail.astype(np.int64)), pa.array(doc), pa.array(start), pa.array(known)], ["cell", "key", "tail", "doc_id", "start", "known"])

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None

        def solve(table: pa.Table) -> Iterator[pa.RecordBatch]:
            nonlocal last
            key, tail, doc, start = (table.column(i).to_numpy() for i in (1, 2, 3, 4))
            key, tail = key.astype(np.uint64), tail.astype(np.uint64)
            least = behind_first(key, tail, doc)
            if last and len(key) and last[:2] == (key[0], tail[0]):  # a node that an earlier group began
                least[(key == key[0]) & (tail == tail[0])] = last[2]
            out = doc > least
            last = (key[-1], tail[-1], least[-1])
            yield pa.RecordBatch.from_arrays([pa.array(doc[out]), pa.array(start[out])], ["doc_id", "start"])

        for batch in batches:
            known = batch.column(5)
            yield pa.RecordBatch.from_arrays([batch.column(3), batch.column(4)], ["doc_id", "start"]).filter(known)
            batch = batch.filter(pc.invert(known))
            if batch.num_rows:
                held.append(batch)
            if sum(x.num_rows for x in held) >= group_rows:
                table = pa.Table.from_batches(held)
                depth = subtree(table.column(1).to_numpy().astype(np.uint64), table.column(2).to_numpy().astype(np.uint64))
                half = len(depth) // 2
                cut = half + int(np.argmin(depth[half:]))  # where neighbours share the shortest prefix
                yield from solve(table.slice(0, cut))
                held = table.slice(cut).to_batches()
        if held:
            yield from solve(pa.Table.from_batches(held))

    spots = spots.groupBy(F.col("doc_id").alias("spot_doc")).agg(F.collect_set("position").alias("spots"))
    docs = _shared.maybe_named(docs, spots.select(F.col("spot_doc").alias("id")))
    rows = docs.join(spots, F.col("doc_id") == F.col("spot_doc")).select("doc_id", "text", "spots", "text_key")
    suffixes = rows.mapInArrow(emit, "cell bigint, key bigint, tail bigint, doc_id bigint, start bigint, known boolean")
    return suffixes.repartition("cell").sortWithinPartitions("key", "tail", "doc_id").mapInArrow(trees, "doc_id bigint, start bigint")


def searched(docs: DataFrame, window: int, gram: int, group_rows: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """docs (doc_id, text, text_key), their facts, the copies (copy_doc, copy_text) and the marks (mark_doc, mark_text, starts)."""
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    facts = _shared.stored(base(docs), "substring-base")
    heads = facts.filter("doc_id is not null").groupBy("all_sha256").agg(F.min("doc_id").alias("head"), F.max("doc_id").alias("last"))
    copies = facts.join(heads.filter("head < last"), "all_sha256").filter("doc_id > head").select(F.col("doc_id").alias("copy_doc"), F.col("text_key").alias("copy_text")).distinct()
    copies = _shared.stored(copies, "substring-copies")
    first = _shared.unnamed(docs.filter("doc_id is not null"), copies.select(F.col("copy_doc").alias("id"), F.col("copy_text").alias("text_key")), also="text_key")
    spots = _shared.stored(shared_anchors(first, window, gram), "substring-spots")
    found = _shared.stored(repeats(first, spots, window, gram, group_rows).distinct(), "substring-repeats")
    marks = found.groupBy(F.col("doc_id").alias("mark_doc"), F.shiftright("start", 32).alias("mark_text")).agg(F.collect_list(F.col("start").bitwiseAND(F.lit((1 << 32) - 1))).alias("starts"))
    return docs, facts, copies, marks


def passages(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(doc_id, start, n_words): the maximal runs of words that repeat passages of smaller documents; copies as a whole."""
    docs, facts, copies, marks = searched(docs, window, gram, group_rows)
    starts = F.array_sort("starts")
    runs = F.aggregate(
        starts, F.expr("cast(array() as array<struct<a: bigint, b: bigint>>)"),
        lambda told, x: F.when((F.size(told) > 0) & (F.element_at(told, -1).getField("b") >= x), F.concat(F.slice(told, 1, F.greatest(F.size(told) - 1, F.lit(0))), F.array(F.struct(F.element_at(told, -1).getField("a").alias("a"), (x + window).alias("b")))))
        .otherwise(F.concat(told, F.array(F.struct(x.alias("a"), (x + window).alias("b"))))),
    )
    spans = marks.select(F.col("mark_doc").alias("doc_id"), F.explode(runs).alias("run")).select("doc_id", F.col("run.a").alias("start"), (F.col("run.b") - F.col("run.a")).alias("n_words"))
    whole = facts.filter(F.col("n_words") >= window).join(copies, (F.col("doc_id") == F.col("copy_doc")) & (F.col("text_key") == F.col("copy_text")), "left_semi")
    return spans.unionByName(whole.select("doc_id", F.lit(0).cast("bigint").alias("start"), "n_words"))


def remove(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, group_rows: int = GROUP_ROWS, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept_text: the kept words joined by one space)."""
    docs, facts, copies, marks = searched(docs, window, gram, group_rows)
    marks = _shared.stored(marks, "substring-marks")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, gone, sha, kept_text = [], [], [], []
            for t, starts in zip(batch.column(1).to_pylist(), batch.column(2)):
                words = t.encode().split() if t else []
                at = starts.values.to_numpy()
                drop = _text.covered(len(words), at[at + window <= len(words)], window)
                kept = b" ".join([w for w, x in zip(words, drop.tolist()) if not x])
                n.append(len(words)), gone.append(int(drop.sum())), sha.append(hashlib.sha256(kept).hexdigest()), kept_text.append(kept.decode() if with_text else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string()), pa.array(kept_text, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    def own(key: str):
        return (F.col("doc_id") == F.col("mark_doc")) & (F.col(key).bitwiseAND(F.lit(TEXT_BITS)) == F.col("mark_text"))

    near = _shared.maybe_named(docs, marks.select(F.col("mark_doc").alias("id")))
    touched = near.join(marks, own("text_key")).select("doc_id", "text", "starts").mapInArrow(cut, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept_text string")
    rest = facts.join(marks.select("mark_doc", "mark_text"), own("text_key"), "left_anti").join(
        copies, (F.col("doc_id") == F.col("copy_doc")) & (F.col("text_key") == F.col("copy_text")), "left"
    )
    whole = F.col("copy_doc").isNotNull() & (F.col("n_words") >= window)
    rest = rest.select("doc_id", "text_key", "n_words", F.when(whole, F.col("n_words")).otherwise(0).alias("n_removed"), F.when(whole, F.lit(EMPTY_SHA)).otherwise(F.col("all_sha256")).alias("kept_sha256"))
    if with_text:
        plain = docs.select(F.col("doc_id").alias("text_doc"), F.col("text_key").alias("plain_key"), F.array_join(F.filter(F.split("text", "[ \\t-\\r]+"), lambda w: w != ""), " ").alias("plain")).dropDuplicates(["text_doc", "plain_key"])
        rest = rest.join(plain, F.col("doc_id").eqNullSafe(F.col("text_doc")) & (F.col("text_key") == F.col("plain_key")), "left")
        return touched.unionByName(rest.select("doc_id", "n_words", "n_removed", "kept_sha256", F.when(F.col("n_removed") > 0, "").otherwise(F.coalesce("plain", F.lit(""))).alias("kept_text")))
    return touched.drop("kept_text").unionByName(rest.drop("text_key"))

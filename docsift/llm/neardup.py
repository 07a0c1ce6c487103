"""Near duplicates by a chosen-path set similarity join over word shingles.

1. sketch(): one pass over whole texts gives each document's number of distinct shingles, a digest of
   its shingle set and, from MINS minwise values, the nodes it reaches in each of TREES independent
   trees and a byte sketch. At a node a document branches on the minwise value at a position that the
   path so far selects, so two documents stay together with a probability equal to their similarity.
2. Documents with equal sets become one class; only its smallest id takes part in the join.
3. Nodes that hold more than NODE_ROWS documents branch further, on one or two positions (1 / threshold
   on average), up to MAX_DEPTH levels; what is still larger then is left to step 5.
4. Small nodes are compared exhaustively, inside one streaming task each, on the byte sketches, and the
   candidates confirmed on the full sets of both texts. A node where many pairs look similar (a crowd)
   gives only a star around its medoid and each member's best partner; once these are confirmed, the
   crowd's members meet with their full sets, and each member outside the largest component is compared
   with all others through the node's postings, so only links that unite are given out.
5. Branching further may part a pair, so the documents of all nodes that were too large at first are
   joined once more, exactly: two sets of the similarity share an element of their prefixes (the rarest
   elements, 1 - threshold of them and one). Postings that hold several components are compared like
   crowds. A crowd or posting of more than NODE_ROWS documents or NODE_BYTES of full sets is compared in
   blocks: each document outside the largest component meets all others, some of them a block.
6. Components: every round replaces an edge's smaller end by its own smallest neighbour (a join, so a hub
   is split by the skew handling of joins) and then ties all smaller neighbours of a document to the
   smallest one. Links found later are added to the stars, and nothing is run where there are none.

Recall: a pair of similarity s meets in a tree with probability s ** DEPTH; with the defaults and
s = 0.8 at least one of 12 trees unites it with probability 0.9998, and the sketch (128 bytes, cut 3.5
standard deviations below the threshold) lets it pass with probability 0.9997. This does not depend on how
far nodes branch: a pair that met in a node too large to compare is found by step 5 whatever became of
the node's children.

Edge cases: null texts and texts without words have an empty set and are linked with nothing; a text
with fewer words than a shingle has the whole sequence as its one shingle; repeated rows, equal texts and
the texts of one id share a component, with all the links of each of these texts; a null id takes no part
and has a null component; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import _shared, _text

PERCENT, MINS, TREES, DEPTH, NODE_ROWS, MAX_DEPTH = 80, 128, 12, 3, 2_000, 8
NODE_BYTES = 64 << 20  # of full sets that a task holds of one node
FREQUENCY_BITS = 18
_MULTIPLIERS = (_text.seeded(101, MINS) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_OFFSETS = (_text.seeded(103, MINS) >> np.uint64(32)).astype(np.uint32)


def shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles (A-Z folded) in text order, and each document's first."""
    begin, end, first = _text.words(data, offsets)
    hashes = _text.span_hash(data, begin, end, _text.FOLDED_CODES[0])
    count = np.diff(first)
    n = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    bounds = np.concatenate([[0], np.cumsum(n)])
    out = np.empty(bounds[-1], np.uint64)
    whole = np.repeat(count >= size, n)
    out[whole] = _text.window_hash(hashes, _text.window_starts(first, size), size)
    for short in range(1, size):
        own = np.flatnonzero(count == short)
        out[bounds[own]] = _text.window_hash(hashes, first[own], short)
    return out, bounds


def minwise(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(documents, MINS) minimum values; documents without shingles get the largest value."""
    out = np.full((len(bounds) - 1, MINS), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        low = (hashes >> np.uint64(32)).astype(np.uint32)
        for k in range(MINS):
            out[full, k] = np.minimum.reduceat(low * _MULTIPLIERS[k] + _OFFSETS[k], bounds[:-1][full])
    return out


def step(nodes: np.ndarray, mins: np.ndarray, branch: int = 0) -> np.ndarray:
    """The child nodes that documents reach: the node selects a position, the minwise value there the child."""
    chosen = _text.mix(nodes + np.uint64(0x51ED270B * (branch + 1)))
    value = mins[np.arange(len(mins)), (chosen % np.uint64(MINS)).astype(np.int64)]
    return _text.mix(chosen ^ (value.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))


def roots(mins: np.ndarray, trees: int, depth: int) -> np.ndarray:
    """(documents, trees) nodes at the first depth."""
    out = np.empty((len(mins), trees), np.uint64)
    for t in range(trees):
        node = np.full(len(mins), t + 1, np.uint64)
        for _ in range(depth):
            node = step(node, mins)
        out[:, t] = node
    return out


def sketch(docs: DataFrame, size: int, trees: int = TREES, depth: int = DEPTH) -> DataFrame:
    """doc_id, text_key (tells texts of one id apart), n_shingles, digest (null without shingles), nodes, mins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, off in _text.slices(batch.column(2)):
                hashes, bounds = shingles(data, off, size)
                mins = minwise(hashes, bounds)
                nodes = roots(mins, trees, depth).astype(np.int64)
                count, digest = np.zeros(b - a, np.int64), []
                for i in range(b - a):
                    own = np.unique(hashes[bounds[i] : bounds[i + 1]])
                    count[i] = len(own)
                    digest.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(count), pa.array(digest, pa.binary()), pa.array([x.tobytes() for x in nodes], pa.binary()), pa.array([x.tobytes() for x in mins], pa.binary())],
                    ["doc_id", "text_key", "n_shingles", "digest", "nodes", "mins"],
                )

    return docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text").mapInArrow(run, "doc_id bigint, text_key bigint, n_shingles bigint, digest binary, nodes binary, mins binary")


def _bytes_column(column: pa.Array, dtype, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(-1, width)


def byte_sketch(mins: np.ndarray) -> np.ndarray:
    return ((mins * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8)


def _paths(reps: DataFrame, trees: int) -> DataFrame:
    """(node, rid) of each class and tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                nodes = _bytes_column(batch.column(1), np.int64, trees)
                yield pa.RecordBatch.from_arrays([pa.array(nodes.ravel()), pa.array(np.repeat(batch.column(0).to_numpy(), trees))], ["node", "rid"])

    return reps.select("rid", "nodes").mapInArrow(run, "node bigint, rid bigint")


def _deeper(rows: DataFrame, percent: int) -> DataFrame:
    """(node, rid) one level below; a node branches on a second position with chance 1 / threshold - 1."""
    limit = np.uint64(int((100 / percent - 1) * 2**32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                node = batch.column(0).to_numpy().astype(np.uint64)
                rid, mins = batch.column(1).to_numpy(), _bytes_column(batch.column(2), np.uint32, MINS)
                twice = (_text.mix(node + np.uint64(77)) >> np.uint64(32)) < limit
                new = np.concatenate([step(node, mins), step(node[twice], mins[twice], 1)])
                yield pa.RecordBatch.from_arrays([pa.array(new.astype(np.int64)), pa.array(np.concatenate([rid, rid[twice]]))], ["node", "rid"])

    return rows.select("node", "rid", "mins").mapInArrow(run, "node bigint, rid bigint")


def leaves(reps: DataFrame, trees: int, percent: int, node_rows: int, max_depth: int) -> tuple[DataFrame, DataFrame | None]:
    """(node, rid): the shared nodes of at most node_rows documents; (rid): the documents of larger first nodes, if any."""
    rows, found, hot = _paths(reps, trees), None, None
    for level in range(max_depth):
        rows = _shared.stored(rows, f"neardup-nodes-{level}")
        counts = rows.groupBy("node").agg(F.count("*").alias("n")).filter("n > 1")
        shared = _shared.stored(rows.join(counts, "node"), f"neardup-shared-{level}")
        _shared.forget(rows)
        small = shared.filter(F.col("n") <= node_rows).select("node", "rid")
        found = small if found is None else found.unionByName(small)
        big = shared.filter(F.col("n") > node_rows)
        if big.isEmpty():
            break
        hot = big.select("rid").distinct() if hot is None else hot
        if level == max_depth - 1:
            break  # what is still larger is left to the join of the hot documents
        rows = _deeper(big.select("node", "rid").join(reps.select("rid", "mins"), "rid"), percent)
    return found, hot


def node_pairs(sketches: np.ndarray, least: int, label: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, bool]:
    """Positions (a, b) of candidate pairs of different labels in one node; whether it is a crowd, so that more are left."""
    n = len(sketches)
    kinds, label = np.unique(np.arange(n) if label is None else label, return_inverse=True)
    ask = np.flatnonzero(label != np.bincount(label).argmax())
    asked = np.zeros(n, bool)
    asked[ask] = True
    a, b, held, crowd = [], [], 0, False
    partner, best = np.zeros(len(ask), np.int64), np.zeros(len(ask), np.int16)
    block = max(1, 2_000_000 // (n * MINS))
    for at in range(0, len(ask), block):
        own = ask[at : at + block]
        agree = (sketches[own, None, :] == sketches[None, :, :]).sum(2, dtype=np.int16)
        agree[label[own][:, None] == label[None, :]] = -1
        partner[at : at + block] = agree.argmax(1)
        best[at : at + block] = agree[np.arange(len(own)), partner[at : at + block]]
        if not crowd:
            x, y = np.nonzero(agree >= least)
            once = (y > own[x]) | ~asked[y]
            a.append(own[x[once]]), b.append(y[once])
            held += int(once.sum())
            crowd = held > 3 * n
    if not crowd:
        return np.concatenate([*a, np.zeros(0, np.int64)]), np.concatenate([*b, np.zeros(0, np.int64)]), False
    # star around the medoid (most agreement with the most frequent value of each position), best partner of each
    modal = np.array([np.bincount(c).argmax() for c in sketches.T])
    hub = int((sketches == modal).sum(1).argmax())
    star = np.flatnonzero(((sketches == sketches[hub]).sum(1) >= least) & (label != label[hub]))
    paired = best >= least
    return np.concatenate([np.full(len(star), hub), ask[paired]]), np.concatenate([star, partner[paired]]), True


def by_node(rows: DataFrame, solve, schema: str) -> DataFrame:
    """solve(table) over runs of whole nodes: rows (node first) are sorted by node and streamed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            held = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch])
            node = held.column(0).to_numpy()
            last = int(np.searchsorted(node, node[-1]))
            if last:
                yield from solve(held.slice(0, last))
                held = held.slice(last)
        if held is not None and held.num_rows:
            yield from solve(held)

    return rows.repartition("node").sortWithinPartitions("node", "rid").mapInArrow(run, schema)


def _spans(node: np.ndarray) -> list[tuple[int, int]]:
    cut = np.flatnonzero(np.diff(node)) + 1
    return [(int(a), int(b)) for a, b in zip([0, *cut], [*cut, len(node)]) if b - a > 1]


def candidates(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b, crowd): candidate pairs of the nodes in rows (node, rid, label, mins); crowd is the node if it holds more."""
    p = percent / 100
    least = int(np.floor(MINS * (p - 3.5 * (p * (1 - p) / MINS) ** 0.5)))

    def solve(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        node, rid, label = (rows.column(i).to_numpy() for i in range(3))
        mins = byte_sketch(_bytes_column(rows.column(3), np.uint32, MINS))
        left, right, crowd = [], [], []
        for at, end in _spans(node):
            a, b, more = node_pairs(mins[at:end], least, label[at:end])
            left.append(rid[at + a]), right.append(rid[at + b]), crowd.append(pa.array([int(node[at]) if more else None] * len(a), pa.int64()))
        if left:
            a, b = np.concatenate(left), np.concatenate(right)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.concat_arrays(crowd)], ["a", "b", "crowd"])

    return by_node(rows.select("node", "rid", "label", "mins"), solve, "a bigint, b bigint, crowd bigint").filter("a < b")


def crowd_links(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b): links between different labels in each node of rows (node, rid, label, set), one for each union."""

    def unite(rid: np.ndarray, label: np.ndarray, sets: list[np.ndarray]) -> Iterator[tuple[int, int]]:
        size = np.array([len(x) for x in sets])
        kinds, label = np.unique(label, return_inverse=True)
        if len(kinds) < 2:
            return
        parent = list(range(len(kinds)))

        def root(k: int) -> int:
            while parent[k] != k:
                parent[k] = parent[parent[k]]
                k = parent[k]
            return k

        flat = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), size)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        largest = np.bincount(label).argmax()
        for x in np.flatnonzero(label != largest):
            a, b = np.searchsorted(flat, sets[x], "left"), np.searchsorted(flat, sets[x], "right")
            n = b - a
            spots = np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            both = np.bincount(owner[spots], minlength=len(sets))
            for y in np.flatnonzero((100 * both >= percent * (size + size[x] - both)) & (label != label[x])):
                i, j = root(label[x]), root(label[y])
                if i != j:
                    parent[max(i, j)] = min(i, j)
                    yield int(rid[x]), int(rid[y])

    def solve(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        node, rid = rows.column(0).to_numpy(), rows.column(1).to_numpy()
        rows = rows.filter(pa.array(np.append(True, (node[1:] != node[:-1]) | (rid[1:] != rid[:-1]))))  # a document of both sides of a block
        node, rid, label = (rows.column(i).to_numpy() for i in range(3))
        for at, end in _spans(node):
            sets = [np.frombuffer(x, np.uint64) for x in rows.column(3).slice(at, end - at).to_pylist()]
            found = list(unite(rid[at:end], label[at:end], sets))
            if found:
                a, b = map(np.array, zip(*found))
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return by_node(rows.select("node", "rid", "label", "set"), solve, "a bigint, b bigint")


def full_sets(docs: DataFrame, size: int) -> DataFrame:
    """(rid, n_shingles, set): the distinct shingle hashes of each document, sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, off in _text.slices(batch.column(1)):
                hashes, bounds = shingles(data, off, size)
                sets = [np.unique(hashes[bounds[i] : bounds[i + 1]]) for i in range(b - a)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([len(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], ["rid", "n_shingles", "set"])

    return docs.select("doc_id", "text").mapInArrow(run, "rid bigint, n_shingles bigint, set binary")


def frequencies(sets: DataFrame) -> np.ndarray:
    """How many elements of the sets fall into each of 2 ** FREQUENCY_BITS buckets of their hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << FREQUENCY_BITS, np.int64)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                np.add.at(total, (np.frombuffer(x, np.uint64) >> np.uint64(64 - FREQUENCY_BITS)).astype(np.int64), 1)
        own = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(total[own])], ["bucket", "n"])

    out = np.zeros(1 << FREQUENCY_BITS, np.int64)
    told = sets.select("set").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out[told.column(0).to_numpy()] = told.column(1).to_numpy()
    return out


def prefix(elements: np.ndarray, often: np.ndarray, percent: int) -> np.ndarray:
    """The elements, rare buckets first, of which two sets of the similarity share at least one."""
    bucket = (elements >> np.uint64(64 - FREQUENCY_BITS)).astype(np.int64)
    return elements[np.lexsort((elements, often[bucket]))[: len(elements) - -(-percent * len(elements) // 100) + 1]]


def postings(sets: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """(node, rid, label, n_shingles): the prefixes of sets (rid, n_shingles, set)."""
    often = frequencies(sets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own = [prefix(np.frombuffer(x, np.uint64), often, percent) for x in batch.column(3).to_pylist()]
                at = np.repeat(np.arange(len(own)), [len(x) for x in own])
                node = _text.mix(np.concatenate(own)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(node), *[pa.array(batch.column(i).to_numpy()[at]) for i in range(3)]], ["node", "rid", "label", "n_shingles"])

    known = sets.join(labels, "rid", "left").select("rid", F.coalesce("label", "rid").alias("label"), "n_shingles", "set")
    return known.mapInArrow(run, "node bigint, rid bigint, label bigint, n_shingles bigint")


def mixed(rows: DataFrame) -> DataFrame:
    """The rows (node, label, ...) of the nodes that hold several labels, with the number of documents n."""
    several = rows.groupBy("node").agg(F.count("*").alias("n"), F.min("label").alias("x"), F.max("label").alias("y")).filter("x < y").select("node", "n")
    return rows.join(several, "node")


def blocks(rows: DataFrame, node_rows: int, node_bytes: int = NODE_BYTES) -> DataFrame:
    """(node, rid, label): rows (node, rid, label, n_shingles) with larger nodes cut to blocks.

    A block holds about half of node_rows documents outside the node's most frequent label, and as many of
    all; each of the former meets each of the latter in one block. Halves are counted in documents and in
    bytes of their sets, whichever is more.
    """
    size = rows.groupBy("node", "label").agg(F.count("*").alias("k"), F.sum("n_shingles").alias("s"))
    size = size.groupBy("node").agg(F.max_by("label", F.struct("k", "label")).alias("most"), F.sum("k").alias("n"), F.max("k").alias("k"), F.sum("s").alias("s"), F.max_by("s", F.struct("k", "label")).alias("most_s"))
    size = size.filter((F.col("n") > node_rows) | (8 * F.col("s") > node_bytes))

    def pieces(n, s):
        return F.greatest(F.ceil(n / max(1, node_rows // 2)), F.ceil(8 * s / max(1, node_bytes // 2)), F.lit(1))

    parts = size.select("node", "most", pieces(F.col("n"), F.col("s")).alias("wide"), pieces(F.col("n") - F.col("k"), F.col("s") - F.col("most_s")).alias("long"))
    rows = rows.join(parts, "node", "left")
    small = rows.filter("wide is null").select("node", "rid", "label")
    big = rows.filter("wide is not null")
    other = big.filter("label != most").withColumn("i", F.pmod(F.xxhash64("rid", "node"), "long")).withColumn("j", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("wide") - 1)))
    every = big.withColumn("j", F.pmod(F.xxhash64("node", "rid"), "wide")).withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("long") - 1)))
    cut = other.select("node", "i", "j", "rid", "label").unionByName(every.select("node", "i", "j", "rid", "label"))
    return small.unionByName(cut.select(F.xxhash64("node", "i", "j").alias("node"), "rid", "label"))


def texts_of(docs: DataFrame, ids: DataFrame, reps: DataFrame) -> DataFrame:
    """(rid, text) of the classes named in ids (rid, distinct), one row each."""
    named = _shared.stored(reps.select("rid", F.col("doc_id").alias("id"), "text_key").join(ids.hint("merge"), "rid", "left_semi"), "neardup-named")
    texts = _shared.maybe_named(docs.select("doc_id", "text"), named.select("id").distinct())
    texts = texts.join(named.hint("merge"), (F.col("doc_id") == F.col("id")) & (F.xxhash64("text") == F.col("text_key")))
    return texts.select("rid", "text").dropDuplicates(["rid"])


def word_set(text: str, size: int) -> frozenset:
    """The exact set of shingles."""
    words = text.encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(zip(*[words[i:] for i in range(size)])) if len(words) >= size else frozenset([tuple(words)])


def confirm(pairs: DataFrame, docs: DataFrame, reps: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs whose full sets reach the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = lru_cache(maxsize=64)(lambda text: word_set(text, size))
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = held(x), held(y)
                both = len(x & y)
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    texts = _shared.stored(texts_of(docs, pairs.select(F.explode(F.array("a", "b")).alias("rid")).distinct(), reps), "neardup-texts")
    both = (
        pairs.select("a", "b").join(texts.select(F.col("rid").alias("a"), F.col("text").alias("text_a")), "a")
        .join(texts.select(F.col("rid").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")
    )
    return both.mapInArrow(run, "a bigint, b bigint")


def contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges (u, v) of each batch as stars around the smallest document of what it connects."""
    for batch in batches:
        if batch.num_rows:
            ids, at = np.unique(np.concatenate([batch.column(0).to_numpy(), batch.column(1).to_numpy()]), return_inverse=True)
            parent = list(range(len(ids)))
            n = batch.num_rows
            for x, y in zip(at[:n].tolist(), at[n:].tolist()):
                while parent[x] != x:
                    parent[x] = x = parent[parent[x]]
                while parent[y] != y:
                    parent[y] = y = parent[parent[y]]
                parent[max(x, y)] = min(x, y)
            root = np.array(parent)
            while (root[root] != root).any():
                root = root[root]
            own = root != np.arange(len(ids))
            yield pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array(ids[root[own]])], ["u", "v"])


def small_star(edges: DataFrame) -> DataFrame:
    """(u, v, parent) of edges (u, v), u > v: u, and every smaller neighbour of u, tied to the smallest one; parent marks one row for each u."""
    by_u = Window.partitionBy("u").orderBy("v")
    rows = edges.select("u", "v", F.first("v").over(by_u).alias("m"), (F.row_number().over(by_u) == 1).alias("parent")).filter("parent or v > m")
    return rows.select(F.when(F.col("parent"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"), "parent")


def components(links: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(rid, label): the smallest id that each linked id reaches; known: labels of links that come besides."""
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").mapInArrow(contracted, "u bigint, v bigint")
    if known is not None:
        edges = edges.unionByName(known.select(F.col("rid").alias("u"), F.col("label").alias("v")))
    told = before = None
    while True:
        now = _shared.stored(small_star(edges), "neardup-edges")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v", "parent").cast("decimal(38,0)"))).first()
        if before is not None:
            _shared.forget(before)
        if state == told:  # all stars: another round would change nothing
            return now.select(F.col("u").alias("rid"), F.col("v").alias("label"))
        told, before = state, now
        parents = now.filter("parent").select(F.col("u").alias("w"), F.col("v").alias("m"))
        edges = now.join(parents, F.col("v") == F.col("w"), "left").select("u", F.coalesce("m", "v").alias("v")).unionByName(parents.select(F.col("w").alias("u"), F.col("m").alias("v")))


def _classes(docs: DataFrame, size: int, percent: int, trees: int, depth: int, node_rows: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """sketches; classes (digest, rid, doc_id and text_key of one member, ...); labels (rid, label) by similar texts.

    A class of equal sets is called by its smallest id. Where an id has several texts, its further classes get
    numbers above all ids, so that no two classes share a name.
    """
    drawn = _shared.stored(sketch(docs, size, trees, depth), "neardup-sketch")
    named = drawn.filter("digest is not null and doc_id is not null")
    least = F.min(F.struct("doc_id", "text_key", "nodes", "mins", "n_shingles")).alias("least")
    reps = _shared.stored(named.groupBy("digest").agg(least).select("digest", F.col("least.doc_id").alias("rid"), "least.*"), "neardup-classes")
    several = reps.groupBy("rid").agg(F.count("*").alias("n")).filter("n > 1").select("rid")
    if not several.isEmpty():
        further = reps.select("rid", "digest").join(several, "rid").withColumn("n", F.row_number().over(Window.partitionBy("rid").orderBy("digest"))).filter("n > 1")
        above = reps.agg(F.max("rid")).first()[0] + 1
        further = _shared.stored(further.select(F.col("digest").alias("d"), (F.lit(above) + F.monotonically_increasing_id()).alias("other")), "neardup-further")
        columns = [c for c in reps.columns if c != "rid"]
        reps = _shared.stored(reps.join(further, F.col("digest") == F.col("d"), "left").select(F.coalesce("other", "rid").alias("rid"), *columns), "neardup-classes")
    nodes, hot = leaves(reps, trees, percent, node_rows, MAX_DEPTH)
    return drawn, reps, link(_shared.stored(nodes, "neardup-leaves"), hot, reps, docs, size, percent, node_rows)


def _same_id(drawn: DataFrame, reps: DataFrame) -> DataFrame:
    """(a, b): classes that share a document, because its id has several texts."""
    named = drawn.filter("digest is not null and doc_id is not null").select("doc_id", "digest")
    several = named.groupBy("doc_id").agg(F.min("digest").alias("x"), F.max("digest").alias("y")).filter("x < y").select("doc_id")
    rows = named.join(several, "doc_id", "left_semi").distinct().join(reps.select("digest", "rid"), "digest")
    return rows.select(F.col("rid").alias("a"), F.min("rid").over(Window.partitionBy("doc_id")).alias("b")).filter("a > b")


def classes(docs: DataFrame, size: int, percent: int = PERCENT, trees: int = TREES, depth: int = DEPTH, node_rows: int = NODE_ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs. The texts of one id are one document and lie in one component."""
    drawn, reps, labels = _classes(docs.select("doc_id", "text"), size, percent, trees, depth, node_rows)
    same = _shared.stored(_same_id(drawn, reps), "neardup-same")
    if not same.isEmpty():
        labels = components(same, labels)
    by_digest = reps.select("digest", "rid").join(labels, "rid", "left").select(F.col("digest").alias("d"), F.coalesce("label", "rid").alias("label"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "doc_id"))
    columns = ["doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept")]
    with_set = drawn.filter("digest is not null").select("doc_id", "n_shingles", "digest").join(by_digest, F.col("digest") == F.col("d"), "left").select(*columns)
    # rows without a shingle need no join
    return with_set.unionByName(drawn.filter("digest is null").select("doc_id", "n_shingles", F.lit(None).cast("bigint").alias("label")).select(*columns))


def link(rows: DataFrame, hot: DataFrame | None, reps: DataFrame, docs: DataFrame, size: int, percent: int, node_rows: int) -> DataFrame:
    """(rid, label) by the links in each node of rows (node, rid), and of the documents hot (rid) with each other."""
    labels = reps.select("rid", F.col("rid").alias("label")).limit(0)
    sketches = reps.select("rid", "mins")

    def confirmed(pairs: DataFrame) -> None:
        nonlocal labels
        if not pairs.isEmpty():
            add(confirm(pairs.select("a", "b").distinct(), docs, reps, size, percent))

    def add(links: DataFrame) -> None:
        nonlocal labels
        links = _shared.stored(links, "neardup-links")
        if not links.isEmpty():
            labels = components(links, labels)

    def compare_sets(rows: DataFrame, sets: DataFrame | None) -> None:
        rows = _shared.stored(blocks(_shared.stored(rows.select("node", "rid", "label", "n_shingles"), "neardup-mixed"), node_rows), "neardup-blocks")
        if not rows.isEmpty():
            if sets is None:
                sets = full_sets(texts_of(docs, rows.select("rid").distinct(), reps).withColumnRenamed("rid", "doc_id"), size)
            add(crowd_links(rows.join(sets.select("rid", "set"), "rid"), percent))

    pairs = _shared.stored(candidates(rows.withColumn("label", F.col("rid")).join(sketches, "rid"), percent), "neardup-pairs")
    confirmed(pairs)
    crowds = pairs.select(F.col("crowd").alias("node")).filter("node is not null").distinct()
    if not crowds.isEmpty():
        known = reps.select("rid", "n_shingles").join(labels, "rid", "left").select("rid", "n_shingles", F.coalesce("label", "rid").alias("label"))
        compare_sets(mixed(rows.join(crowds, "node", "left_semi").join(known, "rid")), None)
    if hot is not None:
        sets = _shared.stored(full_sets(texts_of(docs, hot, reps).withColumnRenamed("rid", "doc_id"), size), "neardup-hot")
        rows = _shared.stored(mixed(_shared.stored(postings(sets, labels, percent), "neardup-postings")), "neardup-mixed")
        pairs = _shared.stored(candidates(rows.filter(F.col("n") <= node_rows).join(sketches, "rid"), percent), "neardup-pairs")
        confirmed(pairs)
        crowds = pairs.select(F.col("crowd").alias("node")).filter("node is not null").distinct()
        compare_sets(rows.filter(F.col("n") > node_rows).drop("n").unionByName(rows.join(crowds, "node", "left_semi").drop("n")), sets)
    return labels


def unique(docs: DataFrame, size: int = 5, percent: int = PERCENT) -> DataFrame:
    """One row of docs, all columns, of each component of similar texts; rows without an id all stay.

    Of rows with equal id and text one stays; texts of one id that are not similar all stay. Rows without words
    and with an id are no duplicates of other ids and stay, too.
    """
    drawn, reps, labels = _classes(docs.select("doc_id", "text"), size, percent, TREES, DEPTH, NODE_ROWS)
    first = reps.join(labels, "rid", "left").filter(F.coalesce("label", "rid") == F.col("rid")).select("doc_id", "text_key")
    wordless = drawn.filter("digest is null and doc_id is not null").select("doc_id", "text_key").distinct()
    kept_id, kept_key, key = (_shared.fresh(c, docs.columns) for c in ("kept_id", "kept_key", "text_key"))
    marked = first.unionByName(wordless).select(F.col("doc_id").alias(kept_id), F.col("text_key").alias(kept_key))
    kept = docs.withColumn(key, F.xxhash64("text")).join(marked, (F.col("doc_id") == F.col(kept_id)) & (F.col(key) == F.col(kept_key)), "left_semi")
    return kept.dropDuplicates(["doc_id", key]).drop(key).unionByName(docs.filter("doc_id is null"))

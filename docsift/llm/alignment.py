"""Cross-tokenizer alignment as relational steps.

Texts are cut at single spaces and line ends between words, where a token of either tokenizer ends whatever stands
around, and every distinct piece of a block of documents is tokenised and aligned once: pieces are written into pages, which
are texts like any other, and a document keeps the numbers of its pieces. Its links are those of its pieces.

Tokens of a page are exploded with their positions; windowed cumulative lengths give each token's
end byte; both token lists meet in a full equi-join on page and end: a merge of their sorted union in which
equal ends are neighbours, so that tokens are shuffled once, as arrays of 16-bit ids (32 where a vocabulary is
larger) before they are exploded; their lengths are looked up in the vocabulary.
Between two consecutive ends lies a stretch that exactly one token of either side covers, so every link is one
joined row: the nearest end at or after it on the other side names the partner, a running match instead of a
join of all tokens of a group, and no group is too long for it. Ends of both sides are cuts; running cut counts
number the groups. Blocks then meet the links of their pages: pieces' groups, spelled, and links go to documents.

An id pair's count is the number of documents that hold it linked. Each document keeps its distinct pairs with
their multiplicities; pairs counted so often that at most HOT_PAIRS can be (the pair rows divided by HOT_PAIRS)
are broadcast, the others joined by shuffle, where no pair has more rows than that.

Edge cases: texts that are null or empty, or whose joined token bytes differ from a space and the text, have no
tokens: zeros and an empty digest; repeated rows are documents of their own, also when their id is null; special
tokens' strings are plain text; other columns are ignored; an empty table gives no rows. A text without spaces is
one piece; vocabularies in which a piece may span a space leave every text whole.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import _shared, vocabularies

BYTE_FILE, PIECE_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
HOT_PAIRS, PART_BYTES, MAX_PARTS, BATCH_CHARS = 250_000, 500_000, 100_000, 1_000_000
ID_BITS = 20  # of an id in a packed pair
PAGE_CHARS, BLOCK_CHARS, BLOCK_PIECE_CHARS = 4_000, 32_000_000, 6_000_000  # a page's pieces; a block's texts, and its distinct pieces
CUT, CUT_LINES = re.compile(r"(?<=\S) (?=\S)"), re.compile(r"(?<=\S)(?: (?=\S)|(?=\n\S))")


@lru_cache(maxsize=2)
def pieces(path: str):
    """(sentencepiece processor, bytes of each piece, their lengths)."""
    import sentencepiece

    tool = sentencepiece.SentencePieceProcessor(model_file=path)
    spelled = [bytes([int(tool.id_to_piece(i)[3:5], 16)]) if tool.is_byte(i) else tool.id_to_piece(i).replace("▁", " ").encode() for i in range(tool.get_piece_size())]
    return tool, spelled, np.array([len(x) for x in spelled], np.int32)


class Pair:
    """Token ids of both sides of a text."""

    def __init__(self, byte_path: str, piece_path: str) -> None:
        spelled, self.fast = vocabularies.byte_level(byte_path)
        self.byte_lens = np.array([len(x) for x in spelled], np.int32)
        self.pieces, self.piece_of, self.piece_lens = pieces(piece_path)
        self.slow = vocabularies.tool(byte_path)
        self.slow.encode_special_tokens = True
        self.agreed = vocabularies.Agreed(lambda probe: self.fast.encode_ordinary(probe) == self.slow.encode(probe, add_special_tokens=False).ids)

    def byte_ids(self, text: str) -> np.ndarray:
        return self.fast.encode_to_numpy(text, disallowed_special=()) if self.agreed(text) else np.array(self.slow.encode(text, add_special_tokens=False).ids)

    def __call__(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        none = np.zeros(0, np.int32)
        held = self.pieces.encode([t or "" for t in texts], num_threads=1)
        for text, b in zip(texts, held):
            want = f" {text}".encode() if text else b""
            if not text or b"".join(map(self.piece_of.__getitem__, b)) != want:
                yield none, none
                continue
            a = self.byte_ids(f" {text}")
            # byte-level tokens spell the text in order, so only their length is open
            yield (a, np.array(b, np.int32)) if self.byte_lens[a].sum() == len(want) else (none, none)


@lru_cache(maxsize=2)
def pair(byte_path: str, piece_path: str) -> Pair:
    return Pair(byte_path, piece_path)


@lru_cache(maxsize=2)
def cuts(piece_path: str) -> re.Pattern | None:
    """Where a piece always begins, merges on either side being independent of the other: at single spaces between words, and line ends.

    The pattern of the byte side splits there anyhow: no part of it runs on from a word into white space, nor looks back.
    """
    from sentencepiece import sentencepiece_model_pb2

    tool, model = pieces(piece_path)[0], sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(tool.serialized_model_proto())
    how, ids = model.normalizer_spec, range(tool.get_piece_size())
    plain = not how.precompiled_charsmap and how.add_dummy_prefix and how.escape_whitespaces and not how.remove_extra_whitespaces
    plain = plain and model.trainer_spec.model_type == model.trainer_spec.BPE and not model.trainer_spec.treat_whitespace_as_suffix
    known = {1, 2, 3, 6}  # kinds of pieces: normal, unknown, control, byte
    if not plain or sum(map(tool.is_byte, ids)) != 256 or any(x.type not in known or re.search("[^▁]▁", x.piece) for x in model.pieces):
        return None
    return CUT if any("\n" in x.piece for x in model.pieces) else CUT_LINES


class Numbers(dict):
    """Numbers of a block's pieces. -1 stands for what split(" ") makes beside white space that is not a cut."""

    def __init__(self, cut: re.Pattern | None) -> None:
        self.cut, self.edges, self.new, self.chars, self.paged = cut, {}, [], 0, 0
        self.lines = cut is CUT_LINES

    def _number(self, of: dict[str, int], piece: str, written: str) -> int:
        n = of[piece] = len(self) + len(self.edges)
        self.new.append(written)
        self.chars += len(written)
        return n

    def __missing__(self, piece: str) -> int:
        if self.lines and piece[:1] == "\n" and len(piece) > 1 and not piece[1].isspace() and not piece[-1].isspace():
            return self._number(self, piece, piece)  # it has no space before it
        return -1 if not piece or piece[0].isspace() or piece[-1].isspace() else self._number(self, piece, f" {piece}")

    def _edge(self, written: str) -> int:
        n = self.edges.get(written)
        return self._number(self.edges, written, written) if n is None else n

    def of(self, text: str | None) -> list[int]:
        if not text:
            return []
        found = [-1]
        if self.cut:
            found = list(map(self.__getitem__, (text.replace("\n", " \n") if self.lines else text).split(" ")))
        if -1 in found:  # a text's first and last pieces keep the white space at its ends
            each = self.cut.split(text) if self.cut else [text]
            found = [self._edge(x if k and x[0] == "\n" else f" {x}") if k == 0 and x[0].isspace() or x[-1].isspace() else self[x] for k, x in enumerate(each)]
        return found


def _page(encode: Pair, held: list[str]) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Ids of both sides of the pieces one after another, and the bytes of each piece (0: it has no tokens)."""

    def ids(written: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        # both tools put a space before a text; before a line end it is a token of its own
        return [(a, b) if x[0] == " " else (a[1:], b[1:]) for x, (a, b) in zip(written, encode([x.removeprefix(" ") for x in written]))]

    if not any(x[-1].isspace() or x[0] == " " and x[1].isspace() for x in held):
        a, b = ids(["".join(held)])[0]
        if len(a):
            return a, b, [len(x.encode()) for x in held]
    both = ids(held)
    return np.concatenate([a for a, _ in both]), np.concatenate([b for _, b in both]), [len(x.encode()) if len(a) else 0 for x, (a, _) in zip(held, both)]


def tokenise(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """Pages of the distinct pieces of each block of documents, and what the documents hold of them.

    Of a page: block, row (a number of its own; pieces are numbered in the order of rows), bytes (of each piece, the space
    before it included; 0 where it has no tokens), n_a, ids (those of the first side come first; 16 bits each where both vocabularies fit).
    Of documents: block, row (of the first of them), doc_ids, sizes (how many pieces each has), held (their numbers, compressed).
    """
    n = max(len(vocabularies.byte_level(byte_path)[0]), len(pieces(piece_path)[1]))
    kind, name = (np.int16, "smallint") if n <= 1 << 16 else (np.int32, "int")
    schema = f"block bigint, row bigint, bytes array<int>, n_a int, ids array<{name}>, doc_ids array<bigint>, sizes array<int>, held binary"
    types = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.int32(), pa.list_(pa.from_numpy_dtype(kind)), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()]
    rows = lambda made: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), types)], [x.split()[0] for x in schema.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, cut, row = pair(byte_path, piece_path), cuts(piece_path), TaskContext.get().partitionId() << 33
        block, numbers, read, page = row, Numbers(cut), 0, row

        def pages(last: bool) -> Iterator[tuple]:
            """The new pieces, in pages; those of a page that is not full wait for more, but for the last."""
            nonlocal page
            at = 0
            while numbers.chars - numbers.paged >= PAGE_CHARS or last and at < len(numbers.new):
                end, held = at, 0
                while end < len(numbers.new) and held < PAGE_CHARS:
                    held += len(numbers.new[end])
                    end += 1
                a, b, sizes = _page(encode, numbers.new[at:end])
                yield block, page, sizes, len(a), np.concatenate([a, b]).astype(kind), None, None, None  # the upper half of 16 bits turns negative
                numbers.paged, page, at = numbers.paged + held, page + 1, end
            del numbers.new[:at]

        for batch in batches:
            ids, texts, at = batch.column(0).to_pylist(), batch.column(1).to_pylist(), 0
            while at < len(texts):
                end, sizes, held, chars = at, [], [], 0
                while end < len(texts) and (end == at or chars + len(texts[end] or "") <= BATCH_CHARS):
                    own = numbers.of(texts[end])
                    sizes.append(len(own))
                    held += own
                    chars += len(texts[end] or "")
                    end += 1
                made = [(block, row, None, None, None, ids[at:end], sizes, pa.compress(np.array(held, np.int32), codec="zstd", asbytes=True))]
                row, at, read = row + len(sizes), end, read + chars
                full = read >= BLOCK_CHARS or numbers.chars >= BLOCK_PIECE_CHARS
                yield rows(made + list(pages(full)))
                if full:
                    block, numbers, read = row, Numbers(cut), 0
        if numbers.new:
            yield rows(list(pages(True)))

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _lengths(lens: np.ndarray, id_: Column) -> Column:
    """The byte length of an id: a constant array of the vocabulary's size."""
    return F.get(F.split(F.lit(",".join(map(str, lens.tolist()))), ",").cast("array<int>"), id_)


def links(tokens: DataFrame, parts: int, byte_path: str, piece_path: str) -> DataFrame:
    """One row a link: row, block, group (1 for the last of the page), end, a, b, a_ends, b_ends (whether a token of the side ends there).

    A page without tokens has one row whose end is null.
    """
    byte_lens, piece_lens = pair(byte_path, piece_path).byte_lens, pieces(piece_path)[2]
    each = tokens.filter("n_a IS NOT NULL").repartition(parts, "row").sortWithinPartitions("row").select("row", "block", "n_a", F.posexplode_outer("ids").alias("pos", "id"))
    each = each.withColumn("id", F.col("id").cast("int").bitwiseAND(F.lit(0xFFFF)) if dict(tokens.dtypes)["ids"] == "array<smallint>" else F.col("id"))
    each = each.select("row", "block", (F.col("pos") >= F.col("n_a")).cast("int").alias("side"), "pos", "id")
    lengths = Window.partitionBy("row", "side").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    each = each.withColumn("end", F.sum(F.when(F.col("side") == 0, _lengths(byte_lens, F.col("id"))).otherwise(_lengths(piece_lens, F.col("id")))).over(lengths))
    ends = Window.partitionBy("row").orderBy(F.desc("end"), "side")  # both sides' lists merged: equal ends are neighbours
    later = ends.rowsBetween(Window.unboundedPreceding, 0)
    own = lambda side: F.last(F.when(F.col("side") == side, F.col("id")), True).over(later)
    met = each.select("row", "block", "end", "side", own(0).alias("a"), own(1).alias("b"), F.lag("end").over(ends).alias("before"), F.lead("end").over(ends).alias("after"))
    met = met.filter("after IS NULL OR after <> end")  # one row an end: its last, which has seen both sides
    both = F.coalesce(F.col("before") == F.col("end"), F.lit(False))
    rows = met.select("row", "block", "end", "a", "b", (both | (F.col("side") == 0)).alias("a_ends"), (both | (F.col("side") == 1)).alias("b_ends"))
    cuts = Window.partitionBy("row").orderBy(F.desc("end")).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("group", F.sum(F.when(F.col("a_ends") & F.col("b_ends"), 1).otherwise(0)).over(cuts))


@lru_cache(maxsize=1)
def _marked() -> tuple[int, list[str], np.ndarray]:
    """Number of ids spelled, the ids after a comma, a bar and a semicolon, and their lengths."""
    n = 1 << 16
    marked = [f"{mark}{i}" for mark in ",|;" for i in range(n)]
    return n, marked, np.array([len(x) for x in marked], np.int8)


def spell(a: np.ndarray, b: np.ndarray, a_ends: np.ndarray, b_ends: np.ndarray, piece: np.ndarray, n: int) -> list[bytes]:
    """`;a1,a2|b1;a3|b2,b3` of each of n pieces: the ids of each of its groups in order."""
    if not len(a):
        return [b""] * n
    group = np.cumsum(a_ends & b_ends) - (a_ends & b_ends)
    ids = np.concatenate([a[a_ends], b[b_ends]])
    place = np.concatenate([group[a_ends] * 2, group[b_ends] * 2 + 1])  # stable: within a group and side by end
    order = np.argsort(place, kind="stable")
    starts = np.searchsorted(np.concatenate([piece[a_ends], piece[b_ends]])[order], np.arange(n + 1))
    ids, place = ids[order], place[order]
    before = np.concatenate([[2], np.where(place[1:] == place[:-1], 0, np.where(place[1:] & 1, 1, 2))])
    known, marked, lens = _marked()
    if ids.max() < known:
        at = before * known + ids
        each, lens = map(marked.__getitem__, at.tolist()), lens[at]
    else:
        each = [f"{',|;'[m]}{i}" for m, i in zip(before.tolist(), ids.tolist())]
        lens = np.array([len(x) for x in each])
    all_, starts = "".join(each).encode(), np.concatenate([[0], np.cumsum(lens, dtype=np.int64)])[starts].tolist()
    return [all_[x:y] for x, y in zip(starts, starts[1:])]


FIELDS = "row bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs array<bigint>, times array<int>"


@dataclass
class Pieces:
    """Of a block's pieces: their groups, spelled; counts (whether it has no tokens; ends of either side, of both, links); all links, and each piece's first."""

    spelled: list[bytes]
    counts: np.ndarray
    pairs: np.ndarray
    first: np.ndarray


def _pieces(pages: pa.Table, links: pa.Table) -> Pieces:
    """From pages (row, bytes) and the links of those with tokens (row, place, pair), page by page."""
    pages, links = pages.sort_by("row"), links.sort_by("row")
    found, k, spelled, counts, pairs = links["row"].to_pylist(), 0, [], [], []
    places, held = links["place"].combine_chunks(), links["pair"].combine_chunks()
    for row, sizes in zip(pages["row"].to_pylist(), pages["bytes"].combine_chunks() if len(pages) else []):
        sizes = sizes.values.to_numpy()
        while found[k] < row:
            k += 1
        place, pair = (x[k].values.to_numpy() for x in (places, held))
        order = slice(None, None, -1) if (place[1:] < place[:-1]).all() else np.argsort(place)
        place, pair = place[order], pair[order]
        piece, a_ends, b_ends, n = np.searchsorted(np.cumsum(sizes), place >> 2), (place & 2) > 0, (place & 1) > 0, len(sizes)
        spelled += spell(pair >> ID_BITS, pair & ((1 << ID_BITS) - 1), a_ends, b_ends, piece, n)
        counts.append(np.stack([sizes == 0, *[np.bincount(piece[x], minlength=n) for x in (a_ends, b_ends, a_ends & b_ends)], np.bincount(piece, minlength=n)]).astype(np.int32))
        pairs.append(pair)
    counts = np.concatenate([np.zeros((5, 0), np.int32), *counts], axis=1)
    return Pieces(spelled, counts, np.concatenate([np.zeros(0, np.int64), *pairs]), np.cumsum(counts[4], dtype=np.int64) - counts[4])


def _assemble(rows: pa.Table, links: pa.Table) -> pa.Table:
    """The documents of a block from its pieces' links."""
    of = _pieces(rows.filter(rows["n_a"].is_valid()).select(["row", "bytes"]), links)
    rows, made = rows.filter(rows["n_a"].is_null()), []
    for row, ids, sizes, held in zip(*[rows[c].to_pylist() for c in ("row", "doc_ids", "sizes", "held")]):
        held, ends = np.frombuffer(pa.decompress(held, sum(sizes) * 4, codec="zstd"), np.int32), np.cumsum([0, *sizes])
        sums = np.diff(np.concatenate([np.zeros((5, 1), np.int64), np.cumsum(of.counts[:, held], axis=1, dtype=np.int64)], axis=1)[:, ends])
        sums[1:, sums[0] > 0] = 0  # a piece without tokens: nor has the document any
        digests, pairs, times = [], [], []
        for k in range(len(ids)):
            mine = held[ends[k] : ends[k + 1]] if sums[4, k] else held[:0]
            digests.append(hashlib.sha256(memoryview(b"".join(map(of.spelled.__getitem__, mine.tolist())))[1:]).hexdigest() if len(mine) else "")
            m = of.counts[4][mine]
            p, t = np.unique(of.pairs[np.arange(m.sum()) + np.repeat(of.first[mine] - np.cumsum(m) + m, m)], return_counts=True)
            pairs.append(p)
            times.append(t)
        at = pa.array(np.cumsum([0, *map(len, pairs)]), pa.int32())
        lists = [pa.ListArray.from_arrays(at, pa.array(np.concatenate(x), t)) for x, t in ((pairs, pa.int64()), (times, pa.int32()))]
        made.append(pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + len(ids))), pa.array(ids, pa.int64()), *map(pa.array, sums[1:]), pa.array(digests), *lists], [x.split()[0] for x in FIELDS.split(", ")]))
    return pa.Table.from_batches(made)


def documents(tokens: DataFrame, links: DataFrame) -> DataFrame:
    """One row a document: row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs (a and b in one number) with times.

    Blocks are bounded, and so is what one of them has of pages and links.
    """
    place = F.col("end") * 4 + F.col("a_ends").cast("int") * 2 + F.col("b_ends").cast("int")
    pair = F.shiftleft(F.col("a").cast("bigint"), ID_BITS).bitwiseOR(F.col("b").cast("bigint"))
    pages = links.groupBy("row").agg(F.first("block").alias("block"), F.collect_list(place).alias("place"), F.collect_list(pair).alias("pair"))
    return tokens.drop("ids").groupBy("block").cogroup(pages.groupBy("block")).applyInArrow(_assemble, FIELDS)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, held (documents that hold it linked), best (its count is the highest of its a; ties included)."""
    counts = _shared.stored(aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("held")), "align-counts")
    top = counts.groupBy(F.shiftright("pair", ID_BITS).alias("a")).agg(F.max("held").alias("top"))  # a row for each id of a vocabulary
    return counts.join(top, F.shiftright("pair", ID_BITS) == F.col("a")).select("pair", "held", (F.col("held") == F.col("top")).alias("best"))


@contextmanager
def _sorted_groups(spark: SparkSession) -> Iterator[None]:
    """Links leave their windows in the order of pages; so pages are gathered one after another, neither hashed nor sorted again."""
    name = "spark.sql.execution.replaceHashWithSortAgg"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


def align(docs: DataFrame, byte_path: str | None = None, piece_path: str | None = None, hot_pairs: int = HOT_PAIRS, part_bytes: int = PART_BYTES) -> DataFrame:
    """One row a document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    byte_path, piece_path = byte_path or vocabularies.place(BYTE_FILE), piece_path or vocabularies.place(PIECE_FILE)
    tokens = _shared.stored(tokenise(docs, byte_path, piece_path), "align-tokens")
    size = tokens.agg(F.sum(F.aggregate("bytes", F.lit(0).cast("bigint"), lambda x, y: x + y))).first()[0] or 0
    parts = min(max(1, math.ceil(size / part_bytes)), MAX_PARTS)
    with _sorted_groups(docs.sparkSession):
        aligned = _shared.stored(documents(tokens, links(tokens, parts, byte_path, piece_path)), "align-documents")
    _shared.forget(tokens)
    counts = _shared.stored(pair_counts(aligned), "align-pairs")
    often = math.ceil((aligned.agg(F.sum(F.size("pairs"))).first()[0] or 0) / hot_pairs)
    each = aligned.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("own"), F.col("x.times").alias("times"))
    hot = each.join(F.broadcast(counts.filter(F.col("held") >= often)), F.col("own") == F.col("pair"), "left")  # at most hot_pairs of them hold
    rest = hot.filter("pair is null").select("row", "own", "times").join(counts.filter(F.col("held") < often), F.col("own") == F.col("pair"))
    cols = ["row", "times", "held", "best"]
    sums = hot.filter("pair is not null").select(*cols).unionByName(rest.select(*cols)).groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("held") * F.col("times")).alias("count_sum"))
    out = aligned.select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256").join(sums, "row", "left")
    zero = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("n_best", "count_sum")]
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", *zero, "groups_sha256")

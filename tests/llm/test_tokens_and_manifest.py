"""Merkle manifest, cross-tokenizer alignment and token counts against plain versions, on odd rows and on a whole table."""

import collections
import hashlib
import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docsift.llm import alignment, merkle, queries, tokencount, vocabularies

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, row bigint, hash string, pos int, n int, steps string, tokens int, pair int, n_tokens string"
WORDS, BYTES, PIECES = (vocabularies.place(x) for x in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))
TRICKY = [
    None, "", " ", "\n\n  \t", "it's IT'S 'S 's", "a  b   c ", "ΟΔΟΣ ὈΔΟΣ", "é Å İstanbul ẞ", "<|endoftext|> x <|startoftext|>", "</w> ▁x", "漢字かな交じり文 한국어 한", "\x00\x01 \x85   x​", "🙂👩‍👩‍👧 ½ ² ٣",
    "नमस्ते दुनिया", "don't!!!... (x) [y]", "1234 56.7 1,000", "﻿bom", "\U000e0001  ͸", "x" * 30_000, "ab " * 5_000, "Straße ﬁ ŉ ǅ", "\r\nline sep",
]


def odd_rows():
    r = random.Random(3)
    texts = TRICKY + [" ".join(f"Word{r.randrange(40)}" for _ in range(r.randrange(1, 60))) for _ in range(300)]
    rows = [(i, t, ["en", None][i % 2], ["a", "a", "a", "b", None, "é"][i % 6] if i != 7 else "lone", None if i % 5 == 0 else len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[5], rows[30], (rows[30][0], "Other TEXT", "en", rows[30][3], 3), (None, "No Id", None, "a", None), (None, "No Id", None, "a", None), (None, None, None, None, None)]
    return [(*x, 1, "h", 2, 3, "s", 4, 5, "t") for x in rows]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def plain_manifest(rows):
    def enc(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def leaf(r, text):
        return sha("".join(map(enc, (r["doc_id"], r["source"], r["lang"], r["n_chars"], text))))

    def low(t):
        return None if t is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)

    def tree(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([sha("".join(out[-1][i : i + 16])) for i in range(0, len(out[-1]), 16)])
        return out

    by = collections.defaultdict(list)
    for r in rows:
        by[r["source"]].append(r)
    names = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    for x in names:
        by[x].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"])))
    trees = {x: tree([leaf(r, r["text"]) for r in by[x]]) for x in names}
    top = tree([trees[x][-1][0] for x in names])
    out = []
    for place, x in enumerate(names):
        for i, r in enumerate(by[x]):
            altered = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0
            held, proof = leaf(r, low(r["text"]) if altered else r["text"]), ""
            for levels, at in ((trees[x], i), (top, place)):
                for level in levels[:-1]:
                    run, k = level[at // 16 * 16 :][:16], at % 16
                    proof += "".join(run[:k] + run[k + 1 :])
                    held = sha("".join([*run[:k], held, *run[k + 1 :]]))
                    at //= 16
            out.append((r["doc_id"], trees[x][0][i], trees[x][-1][0], top[-1][0], sha(proof), held, held == top[-1][0]))
    return sorted(out, key=str)


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def manifest_of(df):
    return sorted((tuple(r) for r in merkle.verify(df).select(*COLUMNS).collect()), key=str)


def test_manifest(spark, odd, monkeypatch):
    rows = odd.collect()
    want = plain_manifest(rows)
    assert manifest_of(odd) == want and any(not w[-1] for w in want) and any(w[-1] for w in want)
    monkeypatch.setattr(merkle, "PART_ROWS", 7)  # ranks over many parts
    assert manifest_of(odd.repartition(5)) == want
    for few in (odd.limit(0), odd.filter("doc_id = 7"), odd.filter("doc_id in (7, 8)")):
        assert manifest_of(few) == plain_manifest(few.collect())


def test_manifest_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    found = con.execute(queries.ORACLES["op11_merkle_manifest"]).fetchall()
    assert sorted(found) == sorted(tuple(r) for r in queries.op11_merkle_manifest(spark, SF).select(*COLUMNS).collect())


def test_one_altered_field_breaks_the_fold(spark):
    docs = spark.createDataFrame([(i, f"t{i}", "en", "a", 2) for i in range(20)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    rows = {r["doc_id"]: r for r in merkle.verify(docs).collect()}
    changed = {i for i in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    assert changed and all(r["verified"] for r in rows.values())  # lower case already
    upper = merkle.verify(docs.withColumn("text", F.upper("text"))).collect()
    assert {r["doc_id"] for r in upper if not r["verified"]} == changed


def spelled():
    tool = vocabularies.tool(BYTES)
    tool.encode_special_tokens = True
    return tool, vocabularies.byte_level(BYTES)[0], *alignment.pieces(PIECES)[:2]


def plain_alignment(rows):
    tool, a_bytes, sp, b_bytes = spelled()
    docs, counts = [], collections.Counter()
    for doc_id, text in rows:
        a = tool.encode(f" {text}", add_special_tokens=False).ids if text else []
        b = sp.encode(text) if text else []
        if not text or not b"".join(a_bytes[i] for i in a) == b"".join(b_bytes[i] for i in b) == f" {text}".encode():
            docs.append((doc_id, [], [], 0, [], ""))
            continue
        a_end, b_end = np.cumsum([len(a_bytes[i]) for i in a]).tolist(), np.cumsum([len(b_bytes[i]) for i in b]).tolist()
        groups, links, i, j = [], [], 0, 0
        for cut in sorted(set(a_end) & set(b_end)):
            x, y = i, j
            i, j = a_end.index(cut, i) + 1, b_end.index(cut, j) + 1
            groups.append((x, i, y, j))
            links += [(a[p], b[q]) for p in range(x, i) for q in range(y, j) if a_end[p] - len(a_bytes[a[p]]) < b_end[q] and b_end[q] - len(b_bytes[b[q]]) < a_end[p]]
        counts.update(set(links))
        docs.append((doc_id, a, b, len(groups), links, ";".join(",".join(map(str, a[x:i])) + "|" + ",".join(map(str, b[y:j])) for x, i, y, j in groups)))
    best = collections.Counter()
    for (a, _), k in counts.items():
        best[a] = max(best[a], k)
    return sorted(((d, len(a), len(b), g, len(x), sum(counts[p] == best[p[0]] for p in x), sum(counts[p] for p in x), sha(s) if s else "") for d, a, b, g, x, s in docs), key=str)


ALIGNED = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def alignment_of(df, **more):
    return sorted((tuple(r) for r in alignment.align(df, **more).select(*ALIGNED).collect()), key=str)


def test_alignment(spark, odd):
    small = odd.filter("length(text) < 20000 or text is null")  # the plain version is quadratic in a group
    want = plain_alignment([(r["doc_id"], r["text"]) for r in small.collect()])
    assert alignment_of(small) == want and sum(w[1] == 0 for w in want) >= 4
    assert alignment_of(small, hot_pairs=1, part_bytes=500) == want  # hardly a pair broadcast, many parts
    assert alignment_of(small, hot_pairs=10**9) == want  # all of them
    assert alignment_of(odd.limit(0)) == []
    long = {r["doc_id"]: r for r in alignment.align(odd).collect()}[TRICKY.index("x" * 30_000)]
    assert long["n_links"] == long["n_a"] + long["n_b"] - long["n_groups"] > 0


def test_alignment_of_a_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = plain_alignment([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert sorted((tuple(r) for r in queries.op12_token_alignment(spark, SF).select(*ALIGNED).collect()), key=str) == want


def test_links_are_relational(spark, odd):
    plan = alignment.links(alignment.tokenise(odd, BYTES, PIECES), 3, BYTES, PIECES)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan and "Generate posexplode" in plan and "Join" not in plan


def test_repeated_pieces_are_tokenised_once(spark):
    words = [f"word{k}ing" for k in range(50)]
    rows = [(i, " ".join(random.Random(i).choices(words, k=200))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    tokens = alignment.tokenise(docs, BYTES, PIECES)
    exploded = alignment.links(tokens, 2, BYTES, PIECES).count()
    assert 50 <= exploded <= 50 * 20  # not those of 40,000 words
    assert alignment_of(docs) == plain_alignment(rows)


EDGES = ["a", "Bee's", "c.", " ", "  ", "\n", "\n\n", "\r\n", "\t", "\u00a0", "\u2028", "\x85", "\x1c", "▁", "漢字", "🙂", "<|endoftext|>", "<s>", "'s", "12", "é"]


def test_alignment_beside_white_space(spark):
    r = random.Random(12)
    rows = [(i, "".join(r.choices(EDGES, weights=[6] * 3 + [12] + [1] * 17, k=r.randrange(1, 14)))) for i in range(1500)]
    rows += [(len(rows) + i, x + y + z) for i, (x, y, z) in enumerate((x, y, z) for x in EDGES for y in EDGES for z in ("", "a"))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert alignment_of(docs, part_bytes=2_000) == plain_alignment(rows)


class Step:
    """Stands for a table: gives the function of its mapInArrow."""

    def select(self, *names):
        return self

    def mapInArrow(self, run, schema):
        return run


@pytest.mark.parametrize("limits", [{}, {"BLOCK_CHARS": 1, "BATCH_CHARS": 10}, {"BLOCK_PIECE_CHARS": 300, "BATCH_CHARS": 100, "PAGE_CHARS": 1}, {"PAGE_CHARS": 70, "BATCH_CHARS": 1}])
def test_pieces_give_the_texts_back(monkeypatch, limits):
    monkeypatch.setattr(alignment, "TaskContext", type("Task", (), {"get": classmethod(lambda c: c), "partitionId": classmethod(lambda c: 3)}))
    for name, x in limits.items():
        monkeypatch.setattr(alignment, name, x)
    r, spelled_as = random.Random(5), spelled()[1]
    texts = [None, "", *["".join(r.choices([x for x in EDGES if x != "▁"] + [" "] * 20, k=r.randrange(1, 30))) for _ in range(200)]]
    run, batch = alignment.tokenise(Step(), BYTES, PIECES), pa.RecordBatch.from_arrays([pa.array(range(202)), pa.array(texts)], ["doc_id", "text"])
    rows = [x for made in run([batch]) for x in made.to_pylist()]
    blocks, found, pages = collections.defaultdict(list), {}, [x for x in rows if x["n_a"] is not None]
    assert len({x["row"] for x in pages}) == len(pages) and [x["row"] for x in pages] == sorted(x["row"] for x in pages)
    for x in pages:
        text, at = b"".join(spelled_as[i & 0xFFFF] for i in x["ids"][: x["n_a"]]), 0
        for n in x["bytes"]:
            blocks[x["block"]].append(text[at : at + n].decode())
            at += n
        assert at == len(text)
    for x in rows:
        held = np.frombuffer(pa.decompress(x["held"], sum(x["sizes"]) * 4, codec="zstd"), np.int32).tolist() if x["n_a"] is None else []
        for k, (i, n) in enumerate(zip(x["doc_ids"] or [], x["sizes"] or [])):
            found[i] = (x["row"] + k, "".join(blocks[x["block"]][p] for p in held[:n]).removeprefix(" "))
            held = held[n:]
    assert [found[i][1] for i in range(202)] == [t or "" for t in texts] and len({x for x, _ in found.values()}) == 202
    assert len(blocks) > 1 or "BLOCK_CHARS" not in limits and "BLOCK_PIECE_CHARS" not in limits


def library_count(text):
    return len(vocabularies.tool(WORDS).encode(text or "", add_special_tokens=False).ids)


def test_counts(spark, odd):
    got = sorted((tuple(r) for r in tokencount.count(odd, limit=20).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()), key=str)
    assert got == sorted(((r["doc_id"], len((r["text"] or "").encode()), library_count(r["text"]), library_count(r["text"]) > 20) for r in odd.collect()), key=str)
    assert tokencount.count(odd.limit(0)).count() == 0


def test_counts_of_a_table(spark):
    rows = {r["doc_id"]: r for r in queries.op13_token_counts(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        assert rows[r["doc_id"]]["n_tokens"] == library_count(r["text"])


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_count_of_any_text(text):
    assert tokencount.counter(WORDS, whole())(text) == library_count(text)


_WHOLE = []


def whole():
    if not _WHOLE:
        _WHOLE.append(tokencount.proved(WORDS))
    return _WHOLE[0]


def test_proved_strings_are_one_token():
    assert len(whole()) > 30_000 and all(library_count(w) == 1 for w in random.Random(1).sample(sorted(whole()), 2_000))


def test_held_merges_are_bounded(monkeypatch):
    monkeypatch.setattr(tokencount, "HELD", 3)
    own = tokencount.Counter(WORDS, whole())
    assert [own(f"qzx{i}vkj") for i in range(9)] == [library_count(f"qzx{i}vkj") for i in range(9)] and len(own.held) <= 3


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_byte_ids_of_any_text(text):
    tool = spelled()[0]
    assert alignment.pair(BYTES, PIECES).byte_ids(text).tolist() == tool.encode(text, add_special_tokens=False).ids

"""Lexical, dense, fused and reranked retrieval for whole batches of queries.

Term statistics, scores and ranks are plain joins and aggregates; a scope column, where given, is
part of every grouping key, so statistics are local to a scope. Ties fall to the smaller position.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docsift.functions.text import fold_column, token_list, tokens
from docsift.storage import spread, stored

K1, B, RRF_K, SCORE_DIGITS, QUERY_BLOCK = 1.2, 0.75, 60, 6, 512


@dataclass
class Index:
    """tokens (position, _tokens), postings (term, position, tf, len), terms (term, df, idf), stats (n, avg_len), all by scope."""

    tokens: DataFrame
    postings: DataFrame
    terms: DataFrame
    stats: DataFrame
    scope: list[str]


def idf() -> Column:
    return F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))


def with_tokens(rows: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """keep and _tokens of each row, in one pass over them."""
    found = fold_column(rows.select(*keep, F.col(text).alias("_text")), "_text")
    return found.select(*keep, token_list(F.col("_text")).alias("_tokens"))


def build(chunks: DataFrame, scope: str | None = None, position: str = "position", text: str = "text") -> Index:
    """The index of chunks, whose _tokens are taken where they are there already."""
    by = [scope] if scope else []
    own = chunks.select(*by, F.col(position).alias("position"), F.col("_tokens" if "_tokens" in chunks.columns else text))
    if "_tokens" in chunks.columns:
        told, found = own, spread(own, "position")
    else:
        told = with_tokens(own, *by, "position", text=text)
        # dealt by position once: term counts of a chunk then need no further shuffle
        found = fold_column(own.withColumnRenamed(text, "_text"), "_text")
        found = spread(found, "position").select(*by, "position", token_list(F.col("_text")).alias("_tokens"))
    lengths = found.select(*by, "position", F.size("_tokens").alias("len"))
    stats = lengths.groupBy(*by).agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"))
    postings = (
        found.select(*by, "position", F.size("_tokens").alias("len"), F.explode("_tokens").alias("term"))
        .groupBy(*by, "position", "len", "term").agg(F.count("*").alias("tf"))
    )
    df = postings.groupBy(*by, "term").agg(F.count("*").alias("df"))
    whole = df.join(stats, by) if by else df.crossJoin(F.broadcast(stats))  # one row without scopes
    terms = whole.select(*by, "term", "df", idf().alias("idf"), "avg_len")
    return Index(told, postings, terms, stats, by)


def query_terms(queries: DataFrame, query: str = "query") -> DataFrame:
    """qid, term: the distinct terms of each query."""
    return queries.select("qid", F.explode(F.array_distinct(tokens(query))).alias("term"))


def top(ranked: DataFrame, k: int, by: list[str], score: str = "score", tie: str = "position") -> DataFrame:
    """rank from 1 by falling score, at most k rows for each key."""
    window = Window.partitionBy(*by).orderBy(F.desc(score), F.asc(tie))
    return ranked.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k)


def asked_postings(index: Index, queries: DataFrame) -> DataFrame:
    """(scope,) position, len, term, tf of the terms that queries ask, stored; `first` marks one row of each chunk, whose term is null if it is not asked."""
    asked = query_terms(queries).select("term").distinct().withColumn("asked", F.lit(True))
    rows = index.tokens.select(*index.scope, "position", F.size("_tokens").alias("len"), F.posexplode_outer("_tokens").alias("at", "term"))
    first = F.coalesce(F.col("at"), F.lit(0)) == 0
    rows = rows.join(F.broadcast(asked), "term", "left").filter(F.col("asked") | first)
    counts = rows.groupBy(*index.scope, "position", "len", F.when(F.col("asked"), F.col("term")).alias("term")).agg(F.count("*").alias("tf"), F.max(first).alias("first"))
    return stored(counts, "asked-postings")


def bm25(index: Index, queries: DataFrame, k: int = 3, k1: float = K1, b: float = B, block: int = QUERY_BLOCK) -> DataFrame:
    """qid, (scope,) rank, position, score. Positions without a query term are never returned.

    The tokens are read once: those of asked terms (their distinct terms are broadcast) are counted where they
    are and stored with the lengths of all chunks, from which the statistics follow. The stated queries are dealt
    into blocks; a block's postings are dealt by position, each partition scores its positions as matrix products
    and passes on its best k of every query (and scope): k rows a query and partition are shuffled, not all matches.
    """
    import numpy as np
    import pyarrow as pa

    if k1 <= 0 or not 0 <= b <= 1:
        raise ValueError("k1 must be positive and b between 0 and 1")
    spark, scope = index.tokens.sparkSession, index.scope
    kept = asked_postings(index, queries)
    stats = kept.filter("first").groupBy(*scope).agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"))
    norm = k1 * (1 - b + b * F.col("len") / F.col("avg_len"))
    weight = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + norm)

    def one_pass(asked: list[tuple[int, list[str]]]) -> DataFrame:
        terms = sorted({t for _, own in asked for t in own})
        number = {t: i for i, t in enumerate(terms)}
        holds = np.zeros((len(terms), len(asked)), np.uint8)
        for j, (_, own) in enumerate(asked):
            holds[[number[t] for t in own], j] = 1
        held = spark.sparkContext.broadcast((np.array([q for q, _ in asked], np.int64), holds))  # `block` queries at most
        vocabulary = spark.createDataFrame(list(number.items()), "term string, no int")
        own = kept.join(F.broadcast(vocabulary), "term")
        counts = own.groupBy(*scope, "term").agg(F.count("*").alias("df"))
        whole = counts.join(stats, scope) if scope else counts.crossJoin(F.broadcast(stats))
        wanted = whole.filter("avg_len > 0").select(*scope, "term", idf().alias("idf"), "avg_len").join(F.broadcast(vocabulary), "term")
        hits = kept.join(F.broadcast(wanted), [*scope, "term"])  # scopes of chunks are few, and terms those of a block
        hits = hits.select((F.col(scope[0]) if scope else F.lit(None).cast("string")).alias("scope"), "position", "no", weight.alias("weight"))

        def run(batches):
            qids, holds = held.value
            holds, best, rest = holds.astype(np.float64), {}, None

            def score(rows: pa.Table) -> None:
                position, at = np.unique(rows.column(1).to_numpy(), return_index=True)
                where = np.repeat(np.arange(len(position)), np.diff(np.append(at, rows.num_rows)))
                weights = np.zeros((len(position), len(holds)))
                weights[where, rows.column(2).to_numpy()] = rows.column(3).to_numpy()
                raw = (weights @ holds).T
                found = np.where(raw > 0, np.round(raw, SCORE_DIGITS), -1.0)
                key = rows.column(0)[0].as_py()
                s, p = best.get(key, (np.zeros((len(qids), 0)), np.zeros((len(qids), 0), np.int64)))
                s = np.concatenate([s, found], axis=1)
                p = np.concatenate([p, np.broadcast_to(position, found.shape)], axis=1)
                order = np.lexsort((p, -s), axis=1)[:, :k]
                best[key] = np.take_along_axis(s, order, 1), np.take_along_axis(p, order, 1)

            def runs(rows: pa.Table):
                """Rows of one scope each; positions stay whole."""
                if not scope:
                    return [rows]
                names = rows.column(0).to_pylist()
                cut = [0, *[i for i in range(1, len(names)) if names[i] != names[i - 1]], len(names)]
                return [rows.slice(x, y - x) for x, y in zip(cut, cut[1:])]

            for batch in batches:
                if not batch.num_rows:
                    continue
                rest = pa.Table.from_batches([batch] if rest is None else [*rest.to_batches(), batch])
                position = rest.column(1).to_numpy()
                last = int(np.flatnonzero(position != position[-1])[-1]) + 1 if (position != position[-1]).any() else 0
                for own in runs(rest.slice(0, last)) if last else []:
                    score(own)
                rest = rest.slice(last)
            if rest is not None:
                score(rest)
            for key, (s, p) in best.items():
                q, i = np.nonzero(s >= 0)
                yield pa.RecordBatch.from_arrays([pa.array(qids[q]), pa.array([key] * len(q), pa.string()), pa.array(p[q, i]), pa.array(s[q, i])], ["qid", "scope", "position", "score"])

        out = hits.repartition("position").sortWithinPartitions("scope", "position").mapInArrow(run, "qid bigint, scope string, position bigint, score double")
        return out.withColumnRenamed("scope", scope[0]) if scope else out.drop("scope")

    out, asked = None, []

    def flush() -> None:
        nonlocal out, asked
        part = one_pass(asked)
        out, asked = part if out is None else out.unionByName(part), []

    for r in queries.select("qid", F.array_distinct(tokens("query")).alias("terms")).orderBy("qid").toLocalIterator():
        if r["terms"]:
            asked.append((r["qid"], r["terms"]))
        if len(asked) == block:
            flush()
    if asked or out is None:
        flush()
    return stored(top(out, k, ["qid", *scope]), "bm25-pool")  # k rows a query and scope, read by whatever follows


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 if either has no length."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, v: s + v)
    return F.when((norm(a) == 0) | (norm(b) == 0), F.lit(0.0)).otherwise(dot / (norm(a) * norm(b)))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double") * v))


def dense(vectors: DataFrame, queries: DataFrame, k: int = 20, block: int = 512, column: str = "embedding") -> DataFrame:
    """qid, rank, position, score: exact nearest neighbours by cosine.

    The stated queries are dealt into blocks of `block`; vectors (position, embedding) stream past
    each block once as matrix products, and a partition passes on its own best k of every query only,
    so what is shuffled is k rows a query and partition, not all pairs.
    """
    import numpy as np
    import pyarrow as pa

    spark = vectors.sparkSession
    vectors, queries = (rows.filter(F.col(column).isNotNull()) for rows in (vectors, queries))
    width = vectors.select(F.size(column)).first()
    if width is None:
        return spark.createDataFrame([], "qid bigint, position bigint, score double, rank int")
    out, at = None, queries.select("qid", column).orderBy("qid")
    rows = [(r["qid"], r[column]) for r in at.toLocalIterator()]
    for start in range(0, len(rows), block):
        ids = np.array([r[0] for r in rows[start : start + block]], np.int64)
        q = np.array([r[1] for r in rows[start : start + block]], np.float64)
        size = np.linalg.norm(q, axis=1)
        q = np.divide(q, size[:, None], out=np.zeros_like(q), where=size[:, None] > 0)
        held = spark.sparkContext.broadcast((ids, q))  # `block` vectors at most

        def run(batches, held=held):
            ids, q = held.value
            best_s, best_p = np.zeros((len(ids), 0)), np.zeros((len(ids), 0), np.int64)
            for batch in batches:
                if not batch.num_rows:
                    continue
                v = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
                length = np.linalg.norm(v, axis=1)
                v = np.divide(v, length[:, None], out=np.zeros_like(v), where=length[:, None] > 0)
                s = np.concatenate([best_s, np.round(q @ v.T, SCORE_DIGITS)], axis=1)
                p = np.concatenate([best_p, np.broadcast_to(batch.column(0).to_numpy(), (len(ids), batch.num_rows))], axis=1)
                order = np.lexsort((p, -s), axis=1)[:, :k]
                best_s, best_p = np.take_along_axis(s, order, 1), np.take_along_axis(p, order, 1)
            n = best_s.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, n)), pa.array(best_p.ravel()), pa.array(best_s.ravel())], ["qid", "position", "score"])

        part = vectors.select("position", column).mapInArrow(run, "qid bigint, position bigint, score double")
        out = part if out is None else out.unionByName(part)
    return stored(top(out, k, ["qid"]), "dense-pool")


def rrf(lists: dict[str, DataFrame], top_k: int = 20, k: float = RRF_K, key: str = "position") -> DataFrame:
    """Reciprocal-rank fusion of ranked lists (qid, rank, key, score), earlier lists first in ties.

    An entry that a list repeats counts once, at its first rank, and takes no rank from the others.
    One union and one aggregate; columns <list>_rank and <list>_score are null where a list lacks it.
    """
    if k < 0:
        raise ValueError("k must not be negative")
    # Spark 4.1 takes a union of lists that are dealt by question as dealt by question, too, though their
    # partitions differ; later windows then see parts of a question. Its own setting turns that off.
    next(iter(lists.values())).sparkSession.conf.set("spark.sql.unionOutputPartitioning", "false")
    parts = []
    for number, (name, rows) in enumerate(lists.items()):
        first = rows.groupBy("qid", key).agg(F.min(F.struct("rank", "score")).alias("first"))
        place = F.row_number().over(Window.partitionBy("qid").orderBy("first.rank"))
        parts.append(first.select("qid", key, F.lit(name).alias("list"), F.lit(number).alias("number"), place.alias("rank"), F.col("first.score").alias("score")))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    own = [F.max(F.when(F.col("list") == name, F.col(c))).alias(f"{name}_{c}") for name in lists for c in ("rank", "score")]
    fused = whole.groupBy("qid", key).agg(F.round(F.sum(1 / (F.lit(float(k)) + F.col("rank"))), 9).alias("score"), F.min(F.struct("number", "rank")).alias("found"), *own)
    window = Window.partitionBy("qid").orderBy(F.desc("score"), "found")
    return fused.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= top_k).drop("found")


HASH_DIMENSIONS = "0123456789abcdef"


def hashed_embedding(rows: DataFrame, key: str, text: str) -> DataFrame:
    """A deterministic stand-in for an embedding model: counts of tokens by a hexadecimal digit of their hash."""
    rows = rows.select(key, "_tokens") if "_tokens" in rows.columns else with_tokens(rows, key, text=text)
    rows = rows.select(key, F.array_join(F.transform("_tokens", lambda t: F.substring(F.md5(t), 4, 1)), "").alias("_digits"))
    counts = [(F.length("_digits") - F.length(F.replace("_digits", F.lit(digit), F.lit("")))).cast("double") for digit in HASH_DIMENSIONS]
    return rows.select(key, F.array(*counts).alias("embedding"))


def encode(rows: DataFrame, model: Callable | None = None, key: str = "position", text: str = "text") -> DataFrame:
    """key and embedding of each row: model maps the text's Column to an array, such as an iterator pandas UDF that loads its model once a worker."""
    return hashed_embedding(rows, key, text) if model is None else rows.select(key, model(F.col(text)).alias("embedding"))


def hybrid(chunks: DataFrame, queries: DataFrame, model: Callable | None = None, k: int = 20, vectors: DataFrame | None = None, index: Index | None = None) -> DataFrame:
    """qid, rank, position, score and the arms' ranks and scores: k dense and k BM25 candidates of each query, fused to k.

    vectors and index may be given where they are stored already.
    """
    if model is None and vectors is None and index is None and "_tokens" not in chunks.columns:
        chunks = stored(with_tokens(chunks, "position"), "tokens")  # both arms read them
    near = dense(vectors if vectors is not None else encode(chunks, model), encode(queries, model, "qid", "query"), k)
    return rrf({"dense": near, "bm25": bm25(index or build(chunks), queries, k)}, k)


def search(chunks: DataFrame, queries: DataFrame, known: list[str], retriever: str = "hybrid", score: Callable[[Column, Column], Column] | None = None, top_k: int = 3, model: Callable | None = None) -> DataFrame:
    """qid, status and results (rank, position, score) of queries (qid, query, scopes) over chunks of their scopes only.

    status: invalid_scope, error (an empty query or one over 4,000 characters), no_evidence or ok. Queries are
    grouped by their resolved scopes, of which a corpus has few; each group has the statistics of its own scopes.
    """
    from docsift.functions.text import strip
    from docsift.operators.scoring import resolve_scopes

    if retriever not in ("dense", "hybrid") or not 1 <= top_k <= 3:
        raise ValueError("retriever is dense or hybrid, top_k 1 to 3")
    names = F.array(*[F.lit(x) for x in known])
    asked = queries.select("qid", "query", resolve_scopes(F.col("scopes"), names).alias("scopes"))
    bad = F.coalesce(strip("query"), F.lit("")) == ""
    asked = asked.withColumn("status", F.when(F.col("scopes").isNull(), "invalid_scope").when(bad | (F.length("query") > 4000), "error"))
    fine, found = asked.filter("status is null"), None
    if "_tokens" not in chunks.columns:  # cut and told apart once, not for each set of scopes and arm
        texts = ["text"] if model is not None or score is not None else []
        chunks = stored(with_tokens(chunks, "position", "source", *texts), "tokens")
    for row in fine.select("scopes").distinct().collect():  # sets of known sources, at most one a query
        own = chunks.filter(F.col("source").isin(*row["scopes"]))
        ask = fine.filter(F.array_join("scopes", "\x01") == "\x01".join(row["scopes"])).select("qid", "query")
        pool = hybrid(own, ask, model) if retriever == "hybrid" else dense(encode(own, model), encode(ask, model, "qid", "query"), 20 if score else top_k)
        if score is not None:
            pool = rerank(pool.join(own.select("position", "text"), "position").join(ask, "qid"), score, top_k).drop("score").withColumnRenamed("reranker_score", "score")
        pool = pool.filter(F.col("rank") <= top_k).select("qid", F.struct("rank", "position", "score").alias("r"))
        found = pool if found is None else found.unionByName(pool)
    if found is None:
        return asked.select("qid", "status", F.array().cast("array<struct<rank:int,position:bigint,score:double>>").alias("results"))
    lists = found.groupBy("qid").agg(F.array_sort(F.collect_list("r")).alias("results"))  # top_k rows a query
    out = asked.join(lists, "qid", "left")
    return out.select("qid", F.coalesce("status", F.when(F.col("results").isNull(), "no_evidence").otherwise("ok")).alias("status"), F.coalesce("results", F.array().cast(lists.schema["results"].dataType)).alias("results"))


def rerank_expanded(candidates: DataFrame, score: Callable[[Column, Column], Column], k: int = 3) -> DataFrame:
    """Candidates with `expanded` ranked by the score of the expanded text; the rows returned hold the child's own text."""
    return rerank(candidates, score, k, text="expanded").drop("expanded")


def arms(chunks: DataFrame, queries: DataFrame, score: Callable[[Column, Column], Column], k: int = 3, model: Callable | None = None) -> DataFrame:
    """arm, qid, rank, position: dense, bm25, hybrid and the first and last reranked, over pools that are made once."""
    chunks = stored(with_tokens(chunks, "position", "text"), "tokens")  # both pools and the rerankers read them
    near, words = dense(encode(chunks, model), encode(queries, model, "qid", "query"), 20), bm25(build(chunks), queries, 20)
    pools = {"dense": near, "bm25": words, "hybrid": rrf({"dense": near, "bm25": words}, 20)}
    out = None
    for name, pool in pools.items():
        plain = pool.filter(F.col("rank") <= k).select(F.lit(name).alias("arm"), "qid", "rank", "position")
        out = plain if out is None else out.unionByName(plain)
        if name != "bm25":
            again = rerank(pool.select("qid", "rank", "position").join(chunks.select("position", "text"), "position").join(queries, "qid"), score, k)
            out = out.unionByName(again.select(F.lit(f"{name}_rerank").alias("arm"), "qid", "rank", "position"))
    return out


def rerank(candidates: DataFrame, score: Callable[[Column, Column], Column], k: int = 3, query: str = "query", text: str = "text") -> DataFrame:
    """Scores the supplied candidates only and keeps k; ties keep the order they came in.

    `score` maps (query, text) to a Column: an expression, or a pandas UDF around a model.
    """
    scored = candidates.withColumnRenamed("rank", "input_rank").withColumn("reranker_score", score(F.col(query), F.col(text)).cast("double"))
    window = Window.partitionBy("qid").orderBy(F.desc("reranker_score"), "input_rank")
    return scored.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k)

"""The registered queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import alignment, gif, grades, merkle, mixing, neardup, packing, pii, rules, sharding, substrings, tokencount, toxicity
from ._shared import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif.digests(gif.store(table(spark, sf_dir, "documents"))).withColumnRenamed("media_id", "doc_id")


def op3_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grades.select(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_risk_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.apply(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), demo=True)  # made values; the session's key goes first


def op6_best_fit_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), cut_oversized=True)  # the law is sizes near equal


def op7_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents"), size=2)


def op8_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove(table(spark, sf_dir, "documents"))


def op10_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.weigh(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verify(table(spark, sf_dir, "documents"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count(table(spark, sf_dir, "documents"))


def _merkle_sql(levels: int = 6) -> str:
    """Trees of up to 16 ** levels leaves; every level is a table of its own, a finished tree's node is carried on."""
    enc = " || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars", "@text@"))
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    crc = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)), lambda h, b: list_reduce(list_prepend(xor(h, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, z: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"
    steps = []

    def tree(name: str, by: str) -> None:
        for k in range(1, levels + 1):
            last = f"{name}{k - 1}"
            key = f"{by}, " if by else ""
            group = f"{key}pos // 16, n"
            steps.append(f"""{name}{k} AS (SELECT {key}pos // 16 AS pos, (n + 15) // 16 AS n, CASE WHEN n = 1 THEN max(h) ELSE sha256(string_agg(h, '' ORDER BY pos)) END AS h, n = 1 AS done,
  CASE WHEN n = 1 THEN [] ELSE list(h ORDER BY pos) END AS kids FROM {last} GROUP BY {group})""")

    steps.append(f"""leaves AS (SELECT *, sha256({enc.replace('@text@', 'text')}) AS h, CASE WHEN coalesce({crc} % 5 = 0, false) THEN sha256({enc.replace('@text@', low)}) END AS altered FROM documents)""")
    steps.append("s0 AS (SELECT source, doc_id, h, altered, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, h) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM leaves)")
    tree("s", "source")
    steps.append(f"t0 AS (SELECT source, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM s{levels})")
    tree("t", "")
    steps.append("f0 AS (SELECT doc_id, h AS leaf, source, pos, coalesce(altered, h) AS cur, '' AS proof FROM s0)")
    for k in range(1, levels + 1):
        steps.append(_fold_sql(f"f{k}", f"f{k - 1}", f"s{k}", "doc_id, leaf, f.source", "f.source IS NOT DISTINCT FROM s.source AND f.pos // 16 = s.pos"))
    steps.append(f"g0 AS (SELECT doc_id, leaf, t0.h AS subroot, t0.pos, cur, proof FROM f{levels} f JOIN t0 ON f.source IS NOT DISTINCT FROM t0.source)")
    for k in range(1, levels + 1):
        steps.append(_fold_sql(f"g{k}", f"g{k - 1}", f"t{k}", "doc_id, leaf, subroot", "f.pos // 16 = s.pos"))
    return "WITH " + ",\n".join(steps) + f"""
SELECT doc_id, leaf, subroot, t.h AS root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = t.h AS verified FROM g{levels} CROSS JOIN t{levels} t"""


def _fold_sql(name: str, last: str, level: str, keep: str, on: str) -> str:
    return f"""{name} AS (SELECT {keep}, s.pos, CASE WHEN s.done THEN cur ELSE sha256(array_to_string(list_concat(kids[1:f.pos % 16], [cur], kids[f.pos % 16 + 2:]), '')) END AS cur,
  CASE WHEN s.done THEN proof ELSE proof || array_to_string(list_concat(kids[1:f.pos % 16], kids[f.pos % 16 + 2:]), '') END AS proof FROM {last} f JOIN {level} s ON {on})"""


QUERIES = {
    f.__name__: f
    for f in (op1_toxicity, op2_gif, op3_ordinal_quality, op4_risk_rules, op5_pseudonyms, op6_best_fit_shards, op7_chosen_path, op8_mixture_packing, op9_suffix_dedup, op10_soft_mixing, op11_merkle_manifest, op12_token_alignment, op13_token_counts)
}
ORACLES: dict[str, str] = {"op11_merkle_manifest": _merkle_sql()}

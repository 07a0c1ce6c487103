"""Merkle manifest of a table with parent-preimage paths.

Leaves are hashes of the rows. Within a tree (a source) they ascend by id, and every FAN consecutive nodes of
a level become one parent, whose preimage (the children's hashes in one string) is stored; the subroots are
the leaves of one more tree over the sources. A leaf's path is read from above: each parent joins its own
parent's path and passes preimage and slot on, so only the lowest join has a row for each leaf. Siblings are a
preimage without the leaf's own 64 characters; folding splices the replacement into that slot and hashes,
level by level.

A rank within a source comes from one range partitioning of the narrow leaves and prefix sums over its parts,
so a source of any size is spread over many tasks, and a group never holds more than FAN rows.

Edge cases: a null field is `-`; a null source is a source of its own, first in order; null ids come first and
are never tampered; rows of one source and id are ordered by their leaves, and equal rows are leaves of their
own; a source of one row is its own subroot, one source its own root; without siblings a proof is the hash of
the empty string; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import _shared

FAN, DIGEST, PART_ROWS = 16, 64, 500_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _sha(value: Column) -> Column:
    return F.sha2(value.cast("binary"), 256)


def leaf(text: Column | None = None) -> Column:
    """The hash of a row's fields, each `-` or its bytes' number, a colon and the value."""
    held = [(F.col(c) if c != "text" or text is None else text).cast("string") for c in FIELDS]
    return _sha(F.concat(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in held]))


def tampered(doc_id: Column) -> Column:
    """Rows whose text the check alters: 5 divides the crc32 of the decimal id; never where it is null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def ranked(rows: DataFrame, tree: list[str], order: list[str], name: str) -> DataFrame:
    """rows with pos (gapless from 0 within its tree, by `order`) and n (rows of the tree); stored."""
    parts = max(1, math.ceil(rows.count() / PART_ROWS))
    placed = rows.repartitionByRange(parts, *tree, *order).sortWithinPartitions(*tree, *order).withColumn("row", F.monotonically_increasing_id())
    mask = F.lit((1 << 33) - 1)
    placed = _shared.stored(placed.withColumn("part", F.shiftright("row", 33)).withColumn("row", F.col("row").bitwiseAND(mask)), f"{name}-placed")
    runs = placed.groupBy("part", *tree).agg(F.min("row").alias("first"), F.count("*").alias("held"))
    by = Window.partitionBy(*tree) if tree else Window.partitionBy(F.lit(0))  # a row for each part, not for each leaf
    runs = runs.withColumn("before", F.coalesce(F.sum("held").over(by.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("n", F.sum("held").over(by))
    runs = runs.select(F.col("part").alias("r_part"), *[F.col(c).alias(f"r_{c}") for c in tree], (F.col("before") - F.col("first")).alias("shift"), "n")
    on = F.col("part") == F.col("r_part")
    for c in tree:
        on = on & F.col(c).eqNullSafe(F.col(f"r_{c}"))
    out = placed.join(runs, on).select(*rows.columns, (F.col("row") + F.col("shift")).alias("pos"), "n")
    return _shared.stored(out, name)


def levels(leaves: DataFrame, tree: list[str], name: str) -> list[DataFrame]:
    """Level by level, the parents of leaves (tree, pos, n, hash): tree, pos, n (nodes of the tree's level), preimage, hash; each stored."""
    found, at = [], leaves.select(*tree, "pos", "n", "hash")
    most = leaves.agg(F.max("n")).first()[0] or 0
    while most > 1:
        node = F.floor(F.col("pos") / FAN).cast("bigint")
        members = F.sort_array(F.collect_list(F.struct("pos", "hash")))  # FAN at most
        at = (
            at.filter("n > 1").withColumn("node", node).groupBy(*tree, "node", "n").agg(members.alias("m"))
            .select(*tree, F.col("node").alias("pos"), F.ceil(F.col("n") / FAN).cast("bigint").alias("n"), F.array_join(F.transform("m", lambda x: x["hash"]), "").alias("preimage"))
            .withColumn("hash", _sha(F.col("preimage")))
        )
        at = _shared.stored(at, f"{name}-level")
        found.append(at)
        most = math.ceil(most / FAN)
    return found


def paths(levels: list[DataFrame], leaves: DataFrame, tree: list[str], tops: DataFrame | None) -> DataFrame:
    """leaves with steps (preimage and slot of every ancestor, lowest first) and what `tops` (tree, above, more columns) gives for their tree.

    The steps of a tree's top node are `above`: those of the tree's own place in the tree of trees.
    """
    carried = [c for c in tops.columns if c not in (*tree, "above")] if tops is not None else []
    up = None
    for rows in [*reversed(levels), leaves]:
        own = rows.columns
        top = rows.filter("n = 1")
        if tops is None:
            top = top.withColumn("steps", F.array().cast("array<struct<preimage:string,slot:int>>"))
        else:
            t = tops.select(*[F.col(c).alias(f"t_{c}") for c in tree], F.col("above").alias("steps"), *carried)
            on = [F.col(c).eqNullSafe(F.col(f"t_{c}")) for c in tree]
            top = top.join(t, on).drop(*[f"t_{c}" for c in tree])
        out = top
        if up is not None:
            p = up.select(*[F.col(c).alias(f"p_{c}") for c in tree], F.col("pos").alias("p_pos"), F.col("preimage").alias("p_preimage"), F.col("steps").alias("p_steps"), *carried)
            on = [F.col(c).eqNullSafe(F.col(f"p_{c}")) for c in tree] + [F.floor(F.col("pos") / FAN).cast("bigint") == F.col("p_pos")]
            step = F.struct(F.col("p_preimage").alias("preimage"), (F.col("pos") % FAN).cast("int").alias("slot"))
            below = rows.filter("n > 1").join(p, on).withColumn("steps", F.concat(F.array(step), "p_steps"))
            out = out.unionByName(below.select(*own, "steps", *carried))
        up = out
    return up


def siblings(step: Column) -> Column:
    """A step's preimage without the own slot."""
    at = step["slot"] * DIGEST
    return F.concat(F.substring(step["preimage"], F.lit(1), at), F.substring(step["preimage"], at + DIGEST + 1, F.lit(FAN * DIGEST)))


def spliced(step: Column, digest: Column) -> Column:
    """A step's preimage with the own slot replaced."""
    at = step["slot"] * DIGEST
    return F.concat(F.substring(step["preimage"], F.lit(1), at), digest, F.substring(step["preimage"], at + DIGEST + 1, F.lit(FAN * DIGEST)))


def manifest(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, leaf, subroot, root, steps, and altered (the leaf of the altered text, null where nothing is altered)."""
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = docs.select(*FIELDS)
    rows = rows.select("source", "doc_id", leaf().alias("hash"), F.when(tampered(F.col("doc_id")), leaf(lower)).alias("altered"))
    rows = _shared.stored(rows, "merkle-leaves")
    leaves = ranked(rows, ["source"], ["doc_id", "hash"], "merkle-ranked")
    own = levels(leaves, ["source"], "merkle")
    tops = leaves.filter("n = 1").select("source", "hash")
    for rows in own:
        tops = tops.unionByName(rows.filter("n = 1").select("source", "hash"))
    tops = ranked(tops, [], ["source"], "merkle-subroots")
    over = levels(tops, [], "merkle-top")
    last = (over[-1] if over else tops).filter("n = 1").select("hash").first()
    placed = paths(over, tops, [], None).select("source", F.col("steps").alias("above"), F.col("hash").alias("subroot"))
    placed = _shared.stored(placed, "merkle-tops")
    out = paths(own, leaves, ["source"], placed)
    return out.select("doc_id", F.col("hash").alias("leaf"), "subroot", F.lit(last[0] if last else None).cast("string").alias("root"), "steps", "altered")


def verify(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    rows = manifest(docs)
    proof = _sha(F.array_join(F.transform("steps", siblings), ""))
    folded = F.aggregate("steps", F.coalesce("altered", "leaf"), lambda held, step: _sha(spliced(step, held)))
    rows = rows.withColumn("proof_sha256", proof).withColumn("folded_root", folded)
    return rows.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))

"""Best-fit-decreasing bin packing of indivisible groups into shards of one fixed capacity.

best_fit_decreasing() is the algorithm: items by falling size, each into the open bin whose remaining
capacity is the tightest that still holds it, found in a balanced (AVL) tree; a new bin opens only
when none fits, or, with all bins given, the item goes to the emptiest one.

assign() runs it over any number of groups. Groups that are large in bytes or rows are few (their
number is bounded by 2 * shards * UNITS) and are packed together on the driver. The others are dealt
by hash to cells of about CELL_GROUPS groups; every cell packs its own into the shards' remaining
capacities, scaled to the cell's bytes, so cells run in parallel with bounded memory. A group larger
than a whole shard cannot stay in one while the sizes are near equal, which the law `bytes` asks for: it
alone is split into pieces, by a hash of the row number, and each piece is an item. All other groups stay
whole.

Edge cases: a null text has no bytes and counts as equal to an empty one; null ids form one id value;
equal sizes are ordered by key, so the result does not depend on the partitioning; an empty table
gives an empty result; repeated rows are separate rows of one group. Other columns are ignored.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import _shared

SHARDS, OVERHEAD, UNITS, CELL_GROUPS, SLOT_ROWS = 40, 16, 64, 20_000, 5_000


class CapacityTree:
    """Balanced search tree of (remaining capacity, bin)."""

    def __init__(self) -> None:
        self.root = None  # node: [key, left, right, height]

    @staticmethod
    def _height(node) -> int:
        return node[3] if node else 0

    def _fix(self, node):
        h = self._height
        if h(node[1]) - h(node[2]) > 1:
            if h(node[1][1]) < h(node[1][2]):
                node[1] = self._rotate(node[1], 2, 1)
            return self._rotate(node, 1, 2)
        if h(node[2]) - h(node[1]) > 1:
            if h(node[2][2]) < h(node[2][1]):
                node[2] = self._rotate(node[2], 1, 2)
            return self._rotate(node, 2, 1)
        node[3] = 1 + max(h(node[1]), h(node[2]))
        return node

    def _rotate(self, node, side: int, other: int):
        up = node[side]
        node[side], up[other] = up[other], node
        for x in (node, up):
            x[3] = 1 + max(self._height(x[1]), self._height(x[2]))
        return up

    def add(self, key) -> None:
        self.root = self._add(self.root, key)

    def _add(self, node, key):
        if node is None:
            return [key, None, None, 1]
        side = 1 if key < node[0] else 2
        node[side] = self._add(node[side], key)
        return self._fix(node)

    def remove(self, key) -> None:
        self.root = self._remove(self.root, key)

    def _remove(self, node, key):
        if key == node[0]:
            if not node[1] or not node[2]:
                return node[1] or node[2]
            least = node[2]
            while least[1]:
                least = least[1]
            node[0] = least[0]
            node[2] = self._remove(node[2], least[0])
        else:
            side = 1 if key < node[0] else 2
            node[side] = self._remove(node[side], key)
        return self._fix(node)

    def tightest(self, size: float):
        """The smallest key whose capacity is at least size."""
        node, found = self.root, None
        while node:
            if node[0][0] >= size:
                found, node = node[0], node[1]
            else:
                node = node[2]
        return found

    def emptiest(self):
        node = self.root
        while node[2]:
            node = node[2]
        return node[0]


def best_fit_decreasing(sizes: list[float], capacity: float, bins: list[float] | None = None) -> tuple[list[int], list[float]]:
    """The bin of each item, and what each bin has left. `bins`: given remaining capacities; no new bins then."""
    tree, left = CapacityTree(), list(bins or [])
    for b, c in enumerate(left):
        tree.add((c, b))
    into = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        found = tree.tightest(sizes[i])
        if found is None and bins is None:
            left.append(max(capacity, sizes[i]))
            found = (left[-1], len(left) - 1)
        else:
            found = found or tree.emptiest()
            tree.remove(found)
        b = found[1]
        left[b] -= sizes[i]
        tree.add((left[b], b))
        into[i] = b
    return into, left


def fill_level(sizes: list[float], total: float, shards: int) -> float:
    """The capacity at which all shards fill equally, once items larger than it have shards of their own."""
    level = total / shards
    for size in sorted(sizes, reverse=True):
        if size <= level or shards == 1:
            break
        total, shards = total - size, shards - 1
        level = total / shards
    return level


def _piece(pieces: Column) -> Column:
    return F.pmod(F.xxhash64("row", F.lit(17)), pieces).cast("int")


def assign(rows: DataFrame, shards: int = SHARDS, cut_oversized: bool = False) -> DataFrame:
    """rows (doc_id, size, text_crc32, key, row), read several times, with the shard of each.

    Groups are indivisible; cut_oversized lets those larger than an even shard be cut by row.
    """
    spark = rows.sparkSession
    whole = rows.agg(F.count("*").alias("n"), F.sum("size").alias("size")).first()
    if not whole["n"]:
        return rows.withColumn("shard", F.lit(None).cast("int"))
    unit, many = whole["size"] / (shards * UNITS), whole["n"] / (shards * UNITS)
    capacity = whole["size"] / shards
    groups = _shared.stored(rows.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("size")), "shard-groups")
    is_large = (F.col("size") > unit) | (F.col("n") > many)
    # at most 2 * shards * UNITS groups can be that large, so they fit the driver and a broadcast
    large = [(r["key"], r["size"]) for r in groups.filter(is_large).collect()]
    parts = [(key, math.ceil(size / unit) if cut_oversized and size > capacity else 1) for key, size in large]
    whole_keys = {key: size for (key, size), (_, n) in zip(large, parts) if n == 1}
    heads = spark.createDataFrame(parts, "key binary, pieces int")
    cut = [
        (bytes(r["key"]), r["piece"], r["size"])
        for r in rows.join(F.broadcast(heads.filter("pieces > 1")), "key").withColumn("piece", _piece(F.col("pieces"))).groupBy("key", "piece").agg(F.sum("size").alias("size")).collect()
    ] if any(n > 1 for _, n in parts) else []  # as many pieces as units at most
    items = sorted([(bytes(k), 0, s) for k, s in whole_keys.items()] + cut, key=lambda x: (-x[2], x[0], x[1]))
    level = fill_level([s for _, _, s in items], whole["size"], shards)
    into, left = best_fit_decreasing([s for _, _, s in items], level, [level] * shards)
    placed = spark.createDataFrame([(k, p, b) for (k, p, _), b in zip(items, into)], "key binary, piece int, shard int")

    small = groups.filter(~is_large)
    n_small = small.agg(F.count("*").alias("n"), F.sum("size").alias("size")).first()
    room = [max(0.0, x) for x in left]
    total_room, small_size = sum(room) or 1.0, n_small["size"] or 0
    room = [x / total_room for x in room]
    cells = max(1, math.ceil(n_small["n"] / CELL_GROUPS))

    def pack(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["size", "key"], ascending=[False, True], kind="stable")
        sizes = own["size"].tolist()
        # every cell starts its bins in another order, so ties and remainders do not favour one shard
        turn = int(own["cell"].iloc[0]) % shards if len(own) else 0
        order = [(b + turn) % shards for b in range(shards)]
        into, _ = best_fit_decreasing(sizes, 0.0, [room[b] * sum(sizes) for b in order])
        return pd.DataFrame({"key": own["key"], "shard": [order[b] for b in into]})

    light = small.withColumn("cell", F.pmod(F.xxhash64("key"), F.lit(cells)).cast("int")).groupBy("cell").applyInPandas(pack, "key binary, shard int")
    columns = ["doc_id", "size", "text_crc32", "key", "row"]
    out_large = (
        rows.join(F.broadcast(heads), "key")
        .withColumn("piece", F.when(F.col("pieces") > 1, _piece(F.col("pieces"))).otherwise(0))
        .join(F.broadcast(placed), ["key", "piece"]).select(*columns, "shard")
    )
    out_small = rows.join(F.broadcast(heads.select("key")), "key", "left_anti").join(light, "key").select(*columns, "shard")
    return out_large.unionByName(out_small) if large else out_small


def slots(rows: DataFrame, n_rows: int, shards: int = SHARDS) -> DataFrame:
    """A gapless slot from 0 within each shard, counted in blocks so that no shard is one task."""
    blocks = max(1, math.ceil(n_rows / (shards * SLOT_ROWS)))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int"))
    before = rows.groupBy("shard", "block").count()
    before = before.select("shard", "block", (F.sum("count").over(Window.partitionBy("shard").orderBy("block")) - F.col("count")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("shard", "block").orderBy("doc_id", "key", "row"))
    return rows.withColumn("rank", rank).join(before, ["shard", "block"]).withColumn("slot", F.col("before") + F.col("rank") - 1).drop("block", "before", "rank")


def shard(docs: DataFrame, shards: int = SHARDS, cut_oversized: bool = False) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null under this law).

    With cut_oversized shards are near equal whatever the groups; without it equal texts always share a shard,
    and a group above an even shard makes its shard that much larger.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.octet_length(text) + OVERHEAD).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.md5(text)).alias("key"), F.monotonically_increasing_id().alias("row"))
    rows = _shared.stored(rows, "shard-rows")  # the row numbers are settled here
    placed = _shared.stored(assign(rows, shards, cut_oversized), "shard-placed")
    return slots(placed, rows.count(), shards).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )

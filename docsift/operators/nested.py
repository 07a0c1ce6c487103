"""First matches in nested JSON of any depth, by windows over its tokens: no recursion and no Python.

The text is cut into tokens (escaped characters masked, so a quote ends a string); running sums of brackets
give depths, counts of closed containers tell containers of a depth apart, and neighbours give the keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TOKENS = r'"[^"]*"|[\[\]{}:,]|\s+|[^\s\[\]{}:,"]+'
REFERENCE_KEYS = ("image_source", "image_path")


def _string(token: Column) -> Column:
    return F.get(F.from_json(F.concat(F.lit("["), token, F.lit("]")), "array<string>"), 0)


def children(rows: DataFrame, keys: list[str], raw: str) -> DataFrame:
    """Every token of valid JSON with: piece (its place), token, open, close, level (depth of its container), container, key (of a value in an object), is_value, first (the container's first place)."""
    plain = rows.select(*keys, F.col(raw).alias("raw"), F.regexp_replace(raw, r"(?s)\\.", "\x02\x02").alias("mask"))
    each = plain.select(*keys, "raw", F.posexplode(F.regexp_extract_all("mask", F.lit(TOKENS), F.lit(0))).alias("piece", "seen"))
    by = Window.partitionBy(*keys).orderBy("piece")
    each = each.withColumn("at", F.sum(F.length("seen")).over(by.rowsBetween(Window.unboundedPreceding, 0)) - F.length("seen"))
    each = each.withColumn("token", F.when(F.startswith(F.col("seen"), F.lit('"')), F.substring(F.col("raw"), F.col("at") + 1, F.length("seen"))).otherwise(F.col("seen"))).drop("raw", "at", "seen")
    each = each.withColumn("open", F.col("token").isin("{", "[")).withColumn("close", F.col("token").isin("}", "]"))
    each = each.filter(~F.col("token").rlike(r"^\s+$") | F.startswith(F.col("token"), F.lit('"')))
    depth = F.sum(F.when(F.col("open"), 1).when(F.col("close"), -1).otherwise(0)).over(by.rowsBetween(Window.unboundedPreceding, 0))
    each = each.withColumn("depth", depth + F.col("close").cast("int")).withColumn("level", F.col("depth") - F.col("open").cast("int"))  # depth: of the container that a bracket opens or closes
    closed = F.sum(F.col("close").cast("int")).over(Window.partitionBy(*keys, "level").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1))
    each = each.withColumn("container", F.coalesce(closed, F.lit(0)))
    inside = Window.partitionBy(*keys, "level", "container").orderBy("piece")
    back, name, ahead = F.lag("token", 1).over(inside), F.lag("token", 2).over(inside), F.lead("token", 1).over(inside)
    each = each.withColumns({"name": F.when(back == ":", name), "is_key": F.coalesce(ahead == ":", F.lit(False)), "first": F.min("piece").over(Window.partitionBy(*keys, "level", "container"))})
    value = ~F.col("is_key") & ~F.col("close") & ~F.col("token").isin(":", ",")
    return each.withColumn("is_value", value).withColumn("key", F.when(value, _string(F.col("name")))).drop("name", "is_key")


def content(rows: DataFrame, keys: list[str], raw: str = "content") -> DataFrame:
    """keys (which name a row), text and reference of each row's JSON.

    text: in an object its own text if that is a string, else what its content gives, else what all its values
    give; lists and values are joined by line ends, empty ones left out. reference: the first image_source, else
    image_path, of the outermost first object that has one as a string. What is no JSON (also an object that
    repeats a key) is a text of its own; null gives nulls.
    """
    valid = F.try_parse_json(raw).isNotNull()
    each = children(rows.filter(valid), keys, raw)
    text = F.startswith(F.col("token"), F.lit('"'))
    inside = Window.partitionBy(*keys, "level", "container")
    has = lambda key, more=F.lit(True): F.coalesce(F.bool_or(F.col("is_value") & (F.col("key") == key) & more).over(inside), F.lit(False))
    each = each.withColumns({"is_text": text, "own_text": has("text", text), "own_content": has("content")})
    kept = F.when(F.col("key").isNull(), True).when(F.col("own_text"), (F.col("key") == "text") & text).when(F.col("own_content"), F.col("key") == "content").otherwise(True)
    each = each.withColumn("kept", kept)
    # an opened container that is left out covers all up to its end: the n-th opening of a depth meets the n-th closing
    each = each.withColumn("nth", F.row_number().over(Window.partitionBy(*keys, "depth", "open", "close").orderBy("piece")))
    pair = Window.partitionBy(*keys, "depth", "nth", F.col("open") | F.col("close"))
    out = F.coalesce(F.bool_or(F.col("open") & ~F.col("kept")).over(pair), F.lit(False))
    step = F.when(out & F.col("open"), 1).when(out & F.col("close"), -1).otherwise(0)
    each = each.withColumn("step", step)
    each = each.withColumn("covered", F.sum("step").over(Window.partitionBy(*keys).orderBy("piece").rowsBetween(Window.unboundedPreceding, 0)))
    each = each.withColumn("value", F.when(F.col("is_value") & text, _string(F.col("token"))))
    leaf = F.col("value").isNotNull() & (F.col("value") != "") & F.col("kept") & (F.col("covered") == 0)
    named = F.col("value").isNotNull() & F.col("key").isin(*REFERENCE_KEYS)
    found = each.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.when(leaf, F.struct("piece", "value")))).alias("texts"),
        F.min(F.when(named, F.struct(F.col("first"), (F.col("key") != REFERENCE_KEYS[0]).alias("second"), F.col("piece"), F.col("value")))).alias("r"),
    )
    found = found.select(*keys, F.array_join(F.transform("texts", lambda x: x["value"]), "\n").alias("text"), F.col("r.value").alias("reference"))
    rest = rows.filter(~F.coalesce(valid, F.lit(False))).select(*keys, F.col(raw).alias("text"), F.lit(None).cast("string").alias("reference"))
    return found.unionByName(rest)

"""Splitting documents into sections and sliding windows.

A chunk is identified by its document and a number within it; `position` orders all chunks and is
computed from these two, so no global sort or single task is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docsift.functions.text import strip

MAX_CHARS, OVERLAP, PER_DOCUMENT = 500, 80, 1_000_000
HEADING = r"(?m)^\s*#{1,6}\s+(.+?)\s*#*\s*$"
NO_SECTION = "未标注"


def sections(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, section_no, section: split before headings and at blank lines, stripped, not empty."""
    parts = F.split(F.col(text), r"\n(?=#{1,6} )|\n(?U:\s)*\n")
    out = docs.select(*keys, F.posexplode(parts).alias("section_no", "section"))
    return out.withColumn("section", strip("section")).filter("section != ''")


def window_starts(length: Column, max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> Column:
    """Offsets of the windows; the last one is the first that reaches the end."""
    if overlap >= max_chars or max_chars <= 0 or overlap < 0:
        raise ValueError("overlap must be smaller than max_chars")
    step = max_chars - overlap
    last = (F.ceil((length - max_chars) / F.lit(float(step))) * step).cast("int")
    return F.when(length <= max_chars, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), last, F.lit(step)))


def chunk(docs: DataFrame, doc: str = "doc_id", keys: list[str] | None = None, text: str = "text", max_chars: int = MAX_CHARS, overlap: int = OVERLAP, numbered: bool = False) -> DataFrame:
    """One row a chunk: doc, keys, chunk_id (from 0 within the document), position, text.

    Positions follow the reading order: the document's id times PER_DOCUMENT and the chunk's. Ids of 9e12 and
    more, or more than PER_DOCUMENT chunks, do not fit and raise an error; numbered=True gives gapless numbers
    in the same order instead, for ids of any size and kind.
    """
    keys = [doc, *(k for k in keys or [] if k != doc)]
    # dealt by document first: the numbering below then needs no shuffle of its own
    found = sections(docs.select(*keys, text).repartition(doc), keys, text)
    found = found.select(*keys, "section_no", "section", F.explode(window_starts(F.length("section"), max_chars, overlap)).alias("at"))
    found = found.withColumn("text", strip(F.substring(F.col("section"), F.col("at") + 1, F.lit(max_chars)))).filter("text != ''")
    number = F.row_number().over(Window.partitionBy(doc).orderBy("section_no", "at")) - 1
    found = found.withColumn("chunk_id", number)
    if numbered:
        return ordinals(found.select(*keys, "chunk_id", "text"), [doc, "chunk_id"], "position").select(*keys, "chunk_id", F.col("position").cast("bigint").alias("position"), "text")
    fits = (F.abs(F.col(doc).cast("decimal(20,0)")) < 9_000_000_000_000) & (F.col("chunk_id") < PER_DOCUMENT)
    position = F.when(fits, F.when(fits, F.col(doc)).otherwise(0) * PER_DOCUMENT + F.col("chunk_id")).when(F.col(doc).isNotNull(), F.raise_error(F.lit("ids do not fit a position: chunk with numbered=True")))
    return found.select(*keys, "chunk_id", position.cast("bigint").alias("position"), "text")


#: keys of each part that are looked at to set its bounds
BOUND_SAMPLE = 20


def ordinals(chunks: DataFrame, order: list[str], name: str = "ordinal", parts: int | None = None) -> DataFrame:
    """Gapless global numbers from 0 in two steps: parts are counted, then numbered in parallel; nulls come first.

    The parts' bounds are taken once, from a bounded sample of the keys by their hash, so a row's part follows
    from its key alone, wherever it is computed. Rows that agree in `order` are numbered in any order.
    """
    n = parts or int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kinds = dict(chunks.dtypes)
    held = chunks.select(*order, F.xxhash64(*order).alias("_hash")).orderBy("_hash").limit(BOUND_SAMPLE * n).orderBy(*order).select(*order).collect()
    bounds = sorted({len(held) * i // n for i in range(1, n)}) if held else []
    struct = lambda values: F.struct(*[F.lit(v).cast(kinds[c]).alias(c) for c, v in zip(order, values)])
    listed = F.array(*[struct(held[i]) for i in bounds]) if bounds else None
    part = F.size(F.filter(listed, lambda b: b <= F.struct(*order))) if bounds else F.lit(0)
    ranged = chunks.withColumn("_part", part)
    sizes = ranged.groupBy("_part").count()
    before = sizes.select(F.col("_part").alias("_at"), (F.sum("count").over(Window.orderBy("_part")) - F.col("count")).alias("_before"))  # a row for each part
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return ranged.withColumn("_own", own).join(F.broadcast(before), F.col("_part") == F.col("_at")).withColumn(name, F.col("_before") + F.col("_own")).drop("_part", "_before", "_own", "_at")


def carry_heading(chunks: DataFrame, source: str = "source", order: str = "position") -> DataFrame:
    """section: the last heading seen so far in the source, this chunk's included."""
    lines = F.regexp_extract_all(F.col("text"), F.lit(HEADING), F.lit(1))
    own = F.when(F.size(lines) > 0, F.element_at(lines, -1))
    window = Window.partitionBy(source).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return chunks.withColumn("section", F.coalesce(F.last(own, ignorenulls=True).over(window), F.lit(NO_SECTION)))


def section_of(text: Column, metadata: Column | None = None, carried: Column | None = None) -> Column:
    """The section in the metadata, else the carried one, else the first heading in the text."""
    own = F.regexp_extract(text, HEADING, 1)
    empty = F.lit(None).cast("string")
    return F.coalesce(F.nullif(metadata, F.lit("")) if metadata is not None else empty, F.nullif(carried, F.lit("")) if carried is not None else empty, F.nullif(own, F.lit("")), F.lit(NO_SECTION))

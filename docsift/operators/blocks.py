"""Parser output to documents: pages of typed blocks, flat or merged into text groups."""

from __future__ import annotations

import json
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S
from pyspark.sql.window import Window

from docsift.functions import text as T

#: Types whose content is running text (fixed values).
TEXT_TYPES = ("text", "paragraph_title", "doc_title", "list", "header", "footer", "page_number", "ref_text", "aside_text")
VISUAL_TYPES = ("table", "chart", "image")
BODY_TYPES = ("table_body", "chart_body", "image_body")
MIDDLE_SCHEMA = "pages array<struct<page_idx int, blocks array<struct<type string, index int, bbox array<double>, sub_type string, continues_prev boolean, content string>>>>"


def content_strings(value, skip: tuple = BODY_TYPES) -> list[str]:
    """The readable strings of nested content, in order; typed visual bodies are left out."""
    found, todo = [], [value]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            if x.strip():
                found.append(x.strip())
        elif isinstance(x, dict):
            if x.get("type") not in skip:
                todo.append(x.get("content"))
        elif isinstance(x, list):
            todo.extend(reversed(x))
    return found


@F.pandas_udf(S.ArrayType(S.StringType()))
def content_of(raw: pd.Series) -> pd.Series:
    """content_strings of content given as JSON; what is no JSON counts as a plain string."""

    def one(x):
        if x is None:
            return []
        try:
            return content_strings(json.loads(x))
        except ValueError:
            return content_strings(x)

    return raw.map(one)


class _Markup(HTMLParser):
    """Text of a fragment, or the rows of its tables."""

    def __init__(self, breaks: dict[str, str]) -> None:
        super().__init__(convert_charrefs=True)
        self.breaks, self.text, self.rows, self.hidden = breaks, [], [], 0
        self.open_row = self.open_cell = False

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style")
        if tag == "tr":
            self.open_row, self.open_cell = True, False
            self.rows.append([])
        elif tag in ("td", "th"):
            if not self.open_row:
                self.rows.append([])
            self.open_row = self.open_cell = True
            self.rows[-1].append([])
        elif tag == "br" and self.open_cell:
            self.rows[-1][-1].append(" ")
        mark = self.breaks.get(tag) or (self.breaks.get("*cel") if tag.endswith("cel") else None)
        if mark:
            self.text.append(mark)

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style") and self.hidden > 0
        if tag in ("td", "th", "tr"):
            self.open_cell = False
            self.open_row = self.open_row and tag != "tr"

    def handle_data(self, data):
        if not self.hidden:
            self.text.append(data)
            if self.open_cell:
                self.rows[-1][-1].append(data)


def _parsed(markup: str | None, **breaks: str) -> _Markup:
    parser = _Markup({k.replace("any_", "*"): v for k, v in breaks.items()})
    parser.feed(markup or "")
    parser.close()
    return parser


def _squeeze(text: str) -> str:
    return "\n".join(line for line in (" ".join(x.split()) for x in text.split("\n")) if line)


@F.pandas_udf(S.StringType())
def markup_text(markup: pd.Series) -> pd.Series:
    """Readable text without tags, scripts and styles; blank lines dropped, blanks squeezed."""
    return markup.map(lambda x: None if x is None else _squeeze("".join(_parsed(x).text)))


@F.pandas_udf(S.ArrayType(S.ArrayType(S.StringType())))
def table_rows(markup: pd.Series) -> pd.Series:
    """Cells of each table row; rows without text dropped. Unclosed rows and cells end where the next begins."""

    def one(x):
        rows = [[" ".join("".join(c).split()) for c in row] for row in _parsed(x).rows]
        return [row for row in rows if any(row)]

    return markup.map(one)


@F.pandas_udf(S.StringType())
def chart_lines(markup: pd.Series) -> pd.Series:
    """Chart cells joined by bars, a line for each row of the chart."""

    def one(x):
        text = "".join(_parsed(x, nl="\n", br="\n", tr="\n", any_cel=" | ").text)
        lines = [" | ".join(" ".join(c.split()) for c in line.split("|") if c.strip()) for line in text.split("\n")]
        return "\n".join(line for line in lines if line)

    return markup.map(one)


def table_text(markup: Column | str) -> Column:
    """Rows as lines of cells joined by bars; markup without a table as its plain text."""
    rows = table_rows(T.col(markup))
    return F.when(F.size(rows) > 0, F.array_join(F.transform(rows, lambda r: F.array_join(r, " | ")), "\n")).otherwise(markup_text(T.col(markup)))


def read_blocks(files: DataFrame, column: str = "value", source: str = "source") -> DataFrame:
    """source, page (from 1), place, type, block_index, bbox, texts of every block of parser JSON."""
    pages = files.select(source, F.from_json(column, MIDDLE_SCHEMA, {"mode": "FAILFAST"}).alias("m")).select(source, F.explode("m.pages").alias("p"))
    blocks = pages.select(source, (F.col("p.page_idx") + 1).alias("page"), F.posexplode("p.blocks").alias("place", "b"))
    return blocks.select(source, "page", "place", F.col("b.type").alias("type"), F.coalesce("b.index", "place").alias("block_index"), F.col("b.bbox").alias("bbox"), content_of("b.content").alias("texts"))


def flat(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """One document a page: all texts in order, the distinct block types in order of appearance."""
    item = F.struct("place", "type", "texts")
    rows = blocks.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("items"))
    return rows.select(*keys, F.array_join(F.flatten(F.transform("items", lambda x: x["texts"])), "\n").alias("text"), F.array_distinct(F.filter(F.transform("items", lambda x: x["type"]), lambda t: t.isNotNull())).alias("block_types"))


def grouped(blocks: DataFrame, keys: list[str], text_types: tuple = TEXT_TYPES) -> DataFrame:
    """Consecutive text blocks merge into a text_group; other blocks stand alone and end a group.

    Islands are numbered by a running count of the other blocks; text blocks without text neither
    join nor break a group. blocks: keys, place, type, block_index, text.
    """
    is_text = F.coalesce(F.col("type").isin(*text_types), F.lit(False))
    order = Window.partitionBy(*keys).orderBy("place")
    rows = blocks.withColumn("text", F.coalesce(T.strip("text"), F.lit(""))).withColumn("is_text", is_text)
    breaks = F.sum(F.when(~F.col("is_text"), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("island", breaks).filter("text != ''")
    item = F.struct("place", "block_index", "type", "text")
    out = rows.groupBy(*keys, "island", "is_text").agg(F.array_sort(F.collect_list(item)).alias("items"))
    return out.select(
        *keys, F.get("items", 0)["place"].alias("place"), F.when(F.col("is_text"), "text_group").otherwise(F.coalesce(F.get("items", 0)["type"], F.lit("unknown"))).alias("block_type"), F.get("items", 0)["block_index"].alias("block_index"),
        F.array_distinct(F.transform("items", lambda x: x["type"])).alias("block_types"), F.array_join(F.transform("items", lambda x: x["text"]), "\n").alias("text"),
    )


def label_children(children: Column) -> Column:
    """Labelled lines of an image's typed children (array of structs type, text), first occurrences only."""
    label = lambda t: (
        F.when(t.isin("image_body", "ocr_text", "image_text", "extracted_text"), "OCR text").when(t == "image_caption", "Caption").when(t == "image_footnote", "Footnote").when(t.isin("text", "ref_text"), "Related text")
    )
    lines = F.transform(F.filter(children, lambda c: label(c["type"]).isNotNull() & (F.coalesce(T.strip(c["text"]), F.lit("")) != "")), lambda c: F.concat(label(c["type"]), F.lit(": "), T.strip(c["text"])))
    return F.array_join(F.array_distinct(lines), "\n")


def anonymise(rows: DataFrame, source: str = "source", order: str | None = None) -> DataFrame:
    """rows with alias Snnn for each source, numbered by first appearance (or by name)."""
    names = rows.groupBy(source).agg((F.min(order) if order else F.min(source)).alias("_first"))
    names = names.select(F.col(source).alias("_source"), F.format_string("S%03d", F.dense_rank().over(Window.orderBy("_first", source))).alias("alias"))  # one row a source
    return rows.join(names, F.col(source).eqNullSafe(F.col("_source"))).drop("_source")

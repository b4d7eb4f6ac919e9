"""Pages of extracted blocks: JSON out of free text, stable block ids, normalised nested texts, page types and zones."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions.text import spaced, stripped

BLOCK = (
    "struct<id: string, type: string, text: string, table: struct<headers: array<string>, cells: array<struct<row: int, col: int, text: string>>>, annotation: struct<transcription: string>>"
)
CONTENT = f"struct<blocks: array<{BLOCK}>, reading_order: array<string>>"


def json_text(text: Column) -> Column:
    """The JSON in a free text: what a fenced block holds, else from the first brace or bracket that is closed to the last one that closes it; null if there is none."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*\n?(.*?)\n?```", 1)
    has_fence = text.rlike(r"(?s)```(?:json)?\s*\n?.*?\n?```")
    bare = F.regexp_extract(text, r"(?s)(\{.*\}|\[.*\])", 1)
    return F.when(has_fence, stripped(fenced)).when(text.rlike(r"(?s)(\{.*\}|\[.*\])"), stripped(bare))


def _single(json: Column) -> Column:
    """Whether a text is one JSON value from its beginning to its end: its brackets close at the last character and not before."""
    plain = F.regexp_replace(json, r'"(\\.|[^"\\])*"', "")
    marks = F.split(F.regexp_replace(plain, r"[^\[\]{}]", ""), "")
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("closed"))

    def fold(s: Column, c: Column) -> Column:
        depth = s["depth"] + F.when(c.isin("{", "["), 1).when(c.isin("}", "]"), -1).otherwise(0)
        return F.struct(depth.alias("depth"), (s["closed"] + F.when((depth == 0) & (c != ""), 1).otherwise(0)).alias("closed"))

    end = F.aggregate(marks, start, fold)
    scalar = json.rlike(r'(?s)^(-?\d+(\.\d+)?([eE][+-]?\d+)?|true|false|"(\\.|[^"\\])*")$')
    return scalar | (json.rlike(r"(?s)^[\[{].*[\]}]$") & (end["depth"] == 0) & (end["closed"] == 1))


def parsed(text: Column, schema: str) -> tuple[Column, Column]:
    """(value, flagged): the JSON of a free text in a schema; null and flagged where there is none, it is malformed, null, or more than one value."""
    found = json_text(text)
    good = F.coalesce(F.try_parse_json(found).isNotNull() & _single(found), F.lit(False))
    return F.when(good, F.from_json(found, schema)), ~good


@F.pandas_udf(ArrayType(ArrayType(StringType())))
def _nfkc_lists(lists: pd.Series) -> pd.Series:
    """Compatibility composition of all texts of a page; there is no built-in for it."""
    form = lambda t: None if t is None else unicodedata.normalize("NFKC", t)
    return lists.map(lambda page: None if page is None else [[form(t) for t in own] for own in page])


def normalised(pages: DataFrame, role: str = "role", page: str = "page", content: str = "content") -> DataFrame:
    """Pages with new block ids, normalised texts and the reading order in the new ids; content is of type CONTENT.

    An id is the role, the page in three digits and the block's place in four. Of blocks that
    share an old id the last gives the new one that the reading order gets; ids that no block
    has stay. Block texts, cells, headers and transcriptions are normalised (NFKC, white
    space); null texts, lists and contents stay null.
    """
    blocks = F.coalesce(F.col(content)["blocks"], F.array().cast(f"array<{BLOCK}>"))
    none = F.array().cast("array<string>")
    texts = lambda b: F.transform(b["table"]["cells"], lambda c: c["text"])
    packed = F.transform(blocks, lambda b: F.concat(F.array(b["text"], b["annotation"]["transcription"]), F.coalesce(b["table"]["headers"], none), F.coalesce(texts(b), none)))
    x = pages.withColumn("_blocks", blocks).withColumn("_texts", _nfkc_lists(packed))
    x = x.withColumn("_texts", F.transform("_texts", lambda own: F.transform(own, spaced)))

    def new_id(i: Column) -> Column:
        return F.concat(F.col(role), F.lit("_"), F.format_string("%03d", F.col(page).cast("int")), F.lit("_blk_"), F.format_string("%04d", (i + 1).cast("int")))

    def block(b: Column, i: Column) -> Column:
        own, n = F.get("_texts", i), F.coalesce(F.size(b["table"]["headers"]), F.lit(0))
        n = F.greatest(n, F.lit(0))
        cells = F.transform(b["table"]["cells"], lambda c, j: F.struct(c["row"].alias("row"), c["col"].alias("col"), F.get(own, n + j + 2).alias("text")))
        headers = F.when(b["table"]["headers"].isNotNull(), F.slice(own, F.lit(3), n))
        table = F.when(b["table"].isNotNull(), F.struct(headers.alias("headers"), cells.alias("cells")))
        note = F.when(b["annotation"].isNotNull(), F.struct(F.get(own, F.lit(1)).alias("transcription")))
        return F.struct(new_id(i).alias("id"), b["type"].alias("type"), F.get(own, F.lit(0)).alias("text"), table.alias("table"), note.alias("annotation"))

    def renamed(old: Column) -> Column:
        ids = F.transform("_blocks", lambda b: F.coalesce(b["id"], F.lit("")))
        back = F.array_position(F.reverse(ids), old)
        return F.when(back > 0, new_id(F.size("_blocks") - back)).otherwise(old)

    order = F.transform(F.col(content)["reading_order"], renamed)
    value = F.when(F.col(content).isNotNull(), F.struct(F.transform("_blocks", block).alias("blocks"), order.alias("reading_order")))
    return x.withColumn(content, value).drop("_blocks", "_texts")


# Rules of a page's type in order, with their confidence.
def page_type(length: Column, images: Column, texts: Column) -> Column:
    """struct(type, confidence) of a page by its text's length and the shares that images and texts cover."""
    kind = lambda t, c: F.struct(F.lit(t).alias("type"), F.lit(c).alias("confidence"))
    return (
        F.when(length < 10, kind("scanned", 0.95))
        .when((images > 0.7) & (texts < 0.1), kind("scanned", 0.90))
        .when((texts > 0.3) & (images < 0.2), kind("born_digital", 0.95))
        .when((images > 0.5) & (length > 50), kind("mixed", 0.75))
        .when(length > 50, kind("born_digital", 0.85))
        .otherwise(kind("scanned", 0.70))
    )


def block_role(size: Column, bold: Column, y: Column, height: Column) -> Column:
    """header and footer by place, then headings by font (15 points, or 12 and bold), else text."""
    return F.when(y < 0.08, "header").when(y + height > 0.95, "footer").when(size >= 15, "heading_1").when((size >= 12) & bold, "heading_2").otherwise("text")

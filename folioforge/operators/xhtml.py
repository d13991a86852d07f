"""Paragraphs of XHTML items, and filters for boilerplate."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ElementTree
from collections.abc import Callable
from functools import reduce
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions.binding import in_slices
from folioforge.functions.text import resolve_entities, strip_doctype, trim

# Phrases of metadata lines, and patterns of boilerplate lines.
METADATA = [
    "Project Gutenberg", "eBook #", "Release date :", "Most recently updated :", "Language :", "Title :", "Author :", "Translator :",
    "Editor :", "Credits :", "*** START OF", "*** END OF", "START OF THE PROJECT", "END OF THE PROJECT", "PROJECT GUTENBERG LICENSE",
    "Updated editions will replace", "Section 1.", "Section 2.", "Section 3.", "THE FULL PROJECT GUTENBERG LICENSE",
]
BOILERPLATE = [
    r"^\s*Other information and formats\s*:\s*www\.gutenberg\.org/ebooks/\d+",
    r"^\s*This eBook was prepared by\b",
    r"^\s*Contributor\s*:\s*",
    r"^\s*Author of introduction,?\s*etc\.\s*:\s*",
    r"^\s*\*\*\*\s*(END|START) OF (THE|THIS)?\s*PROJECT GUTENBERG EBOOK\b",
    r"^\s*The Project Gutenberg (License|eBook)\b",
]

PARSED = "struct<paragraphs:array<string>,ok:boolean>"
_PARSED = pa.struct([("paragraphs", pa.list_(pa.string())), ("ok", pa.bool_())])


class _Lenient(HTMLParser):
    """Text of p elements of any HTML; a p ends where the next one or a block starts."""

    BLOCKS = {"p", "div", "ul", "ol", "table", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "body", "html", "li", "blockquote", "pre"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.done, self.open, self.skip = [], None, 0

    def _end(self):
        if self.open is not None:
            self.done.append(self.open)
        self.open = None

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.skip += 1
        elif tag in self.BLOCKS:
            self._end()
            if tag == "p":
                self.open = []

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        elif tag in self.BLOCKS:
            self._end()

    def handle_data(self, data):
        if self.open is not None and not self.skip:
            self.open.append(data)


def _joined(parts: list[str]) -> str:
    return " ".join(" ".join(parts).split())


def _strict(xml: str) -> dict:
    try:
        root = ElementTree.fromstring(xml)
    except ElementTree.ParseError:
        return {"paragraphs": [], "ok": False}
    found = [_joined(list(e.itertext())) for e in root.iter() if isinstance(e.tag, str) and e.tag.rpartition("}")[2].lower() == "p"]
    return {"paragraphs": [p for p in found if p], "ok": True}


def _lenient(html: str) -> dict:
    parser = _Lenient()
    parser.feed(re.sub(r"<\?xml[^>]*>", "", html))
    parser.close()
    parser._end()
    return {"paragraphs": [p for p in map(_joined, parser.done) if p], "ok": True}


def paragraphs(html: Column, strict: bool = True) -> Column:
    """The non-blank p elements of an item, text nodes joined by spaces, and whether it parsed:
    strict reads well-formed XML only, else an item gives no paragraphs and ok is false."""

    @F.arrow_udf(PARSED)
    def parsed(items: pa.Array) -> pa.Array:
        read = _strict if strict else _lenient
        return in_slices(lambda x: {"paragraphs": [], "ok": False} if x is None else read(x), _PARSED, items)

    return parsed(strip_doctype(resolve_entities(html)) if strict else html)


def is_metadata_line(text: Column) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(x) for x in METADATA])


def is_boilerplate(text: Column) -> Column:
    """Whether a line that isn't blank matches one of the boilerplate patterns, in any case."""
    bare = trim(text)
    return (bare != "") & reduce(lambda a, b: a | b, [bare.rlike(f"(?i){p}") for p in BOILERPLATE])


def without_boilerplate_items(rows: DataFrame, item: str, hit: Column) -> DataFrame:
    """Rows of items of which at most half the rows are hits."""
    counts = rows.groupBy(item).agg(F.count_if(hit).alias("hits"), F.count(F.lit(1)).alias("n"))
    return rows.join(counts.where("2 * hits > n").select(item), item, "left_anti")


def kept_items(items: DataFrame, lines: str, hit: Callable[[Column], Column]) -> DataFrame:
    """Items, a row each with an array of lines, of which at most half the lines are hits: the same filter
    without a shuffle."""
    return items.where(2 * F.size(F.filter(lines, hit)) <= F.size(lines))


def item_hits(rows: DataFrame, item: str, hit: Column) -> DataFrame:
    """rows with the hits and the number of rows of their item."""
    every = Window.partitionBy(item)
    return rows.withColumn("hits", F.sum(hit.cast("int")).over(every)).withColumn("n", F.count(F.lit(1)).over(every))

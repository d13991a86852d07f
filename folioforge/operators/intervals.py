"""Joins of places and ranges of texts by bins, without Python and without a row of all that a text has.

A span is put into every bin of some width that it touches, a place into its own, and both meet on text and bin. The
width is four mean lengths of the spans, so that they come to at most a quarter more rows (and one) than there are
spans, and a long or much selected text is many bins, on many tasks. Empty spans hold nothing. Null keys and places
meet nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.session import cut


def bin_width(spans: DataFrame, start: str = "start", end: str = "end") -> int:
    mean = spans.agg(F.avg(F.col(end) - F.col(start))).first()[0]
    return max(1, int(4 * (mean or 1)))


def holding(points: DataFrame, spans: DataFrame, key: str, at: str = "at", start: str = "start", end: str = "end", width: int | None = None) -> DataFrame:
    """points (key, at, ...) with the columns of each span (key, start, end, ...) of the same key in which start <= at < end;
    of a point in no span those are null. Spans' other columns have names of their own."""
    width = width or bin_width(spans, start, end)
    bins = F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width))
    binned = spans.where(F.col(end) > F.col(start)).withColumn("__ff_bin", F.explode(bins)).withColumnRenamed(key, "__ff_key")
    placed = points.withColumn("__ff_place", F.floor(F.col(at) / width))
    meets = (placed[key] == binned["__ff_key"]) & (placed["__ff_place"] == binned["__ff_bin"]) & (placed[at] >= binned[start]) & (placed[at] < binned[end])
    return placed.join(binned, meets, "left").drop("__ff_key", "__ff_bin", "__ff_place")


def _continues(data: Column, at: Column) -> Column:
    """Whether the byte at a place continues a character."""
    return F.coalesce(F.hex(F.substring(data, at + 1, F.lit(1))).between("80", "BF"), F.lit(False))


def snapped(selections: DataFrame, sentences: DataFrame, texts: DataFrame, key: str, id_col: str) -> DataFrame:
    """selections (id_col, key, start, end: bytes) with `span`, the bytes from the start of the sentence that holds the
    first selected byte to the end of that which holds the last; the selection itself, cut to whole characters, if either is in
    none; null if nothing is selected or there is no text. sentences: key, start, end; texts: key, text. id_col is unique."""
    sized = texts.where(F.col("text").isNotNull()).select(key, F.octet_length("text").alias("__ff_size"))
    asked = selections.select(id_col, key, "start", "end").join(sized, key)
    cut_off = asked.select(id_col, key, F.least("start", "__ff_size").alias("a"), F.least("end", "__ff_size").alias("b")).where("b > a")
    ends = cut(cut_off.select(id_col, key, "a", "b", F.inline(F.array(F.struct(F.lit(0).alias("side"), F.col("a").alias("at")), F.struct(F.lit(1).alias("side"), (F.col("b") - 1).alias("at"))))))
    found = holding(ends, sentences.select(key, F.col("start").alias("s"), F.col("end").alias("e")), key, "at", "s", "e")
    of = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c)))  # noqa: E731  sentences are apart, so there is one
    both = cut(found.groupBy(id_col, key, "a", "b").agg(of(0, "s").alias("first"), of(1, "e").alias("last")))
    whole = F.coalesce(F.col("first") < F.col("last"), F.lit(False))
    data, a, b = F.col("text").cast("binary"), F.col("a"), F.col("b")
    start = F.when(~_continues(data, a), a).when(~_continues(data, a + 1), a + 1).when(~_continues(data, a + 2), a + 2).otherwise(a + 3)
    end = F.when(~_continues(data, b), b).when(~_continues(data, b - 1), b - 1).when(~_continues(data, b - 2), b - 2).otherwise(b - 3)
    # texts are looked into only for selections outside sentences
    outside = both.where(~whole).join(texts.select(key, "text"), key).select(id_col, start.alias("start"), end.alias("end"))
    spans = both.where(whole).select(id_col, F.col("first").alias("start"), F.col("last").alias("end")).unionByName(outside.where(F.col("end") > F.col("start")))
    spans = spans.select(id_col, F.struct(F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")).alias("span"))
    return selections.join(spans, id_col, "left")

"""Exact dedup by a tree merge of sorted digest runs.

Every input partition makes one run: its distinct digests in order, each with the
best row seen (most code points in the original text, then smallest id) and a count.
A run lies in segments, one for each range of digests (by leading digits, so many that
a segment of the last run has some `segment` digests): sorted arrays, of bounded size however
large a run is. In each round neighbouring runs, `fan_in` at a time, send their
segments to one task for each range, which merges these sorted arrays (sort_array merges the
ascending stretches that it finds), keeps the best candidate of each digest and adds up the
counts. After ceil(log_fan_in(runs)) rounds one run is left. A digest arrives at most
fan_in times a segment however often its text occurs. A digest is verified at each
level: SHA-256 is merged together with the normalised length and an independent 64-bit
hash, and rows differing in any of the three are never merged.

Texts are equal when identical after deletion of [\\x20\\x09-\\x0D]; null counts as
empty. Rows repeating id and text are the same document and share one verdict. A
null id sorts after every other. Extra columns stay. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.functions.binding import let
from folioforge.llm.columns import SPACE, keep_rows
from folioforge.session import cut

KEY = ["sha", "norm_chars", "norm_hash"]


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = let(
        F.regexp_replace(text, SPACE, ""),
        lambda t: F.struct(
            F.unhex(F.sha2(t.cast("binary"), 256)).alias("sha"), F.length(t).cast("long").alias("norm_chars"), F.xxhash64(t).alias("norm_hash")
        ),
    )
    slim = docs.select(F.col(id_col).alias("doc_id"), F.length(text).cast("long").alias("chars"), key.alias("key"), F.spark_partition_id().alias("run"))
    return slim.select("doc_id", "chars", "key.*", "run")


def _same(a: Column, b: Column) -> Column:
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in KEY])


def _merged(segments: Column, fan_in: int) -> Column:
    """The segment that up to fan_in segments of one range merge into."""

    def kept(every: Column) -> Column:
        # equal digests are neighbours, the best one first, and at most fan_in, one from each segment
        def one(x: Column, i: Column) -> Column:
            more = [F.when(_same(F.get(every, i + k), x), F.get(every, i + k)["n"]).otherwise(F.lit(0)) for k in range(1, fan_in)]
            first = (i == 0) | ~_same(F.get(every, i - 1), x)
            return F.when(first, x.withField("n", reduce(lambda a, b: a + b, more, x["n"])))

        return F.filter(F.transform(every, one), lambda x: x.isNotNull())

    return let(F.sort_array(F.flatten(segments)), kept)


def tree_merge(digested: DataFrame, runs: int, fan_in: int = 8, rows: int = 0, segment: int = 1024, rounds_a_cut: int = 3) -> DataFrame:
    """KEY, keep_id and group_size of every distinct text; rows: how many rows there are."""
    if fan_in < 2:
        raise ValueError("fan_in must be 2 or more")
    digits = max(0, min(12, math.ceil(math.log(max(rows, 1) / segment, 16))))
    best = F.struct((-F.col("chars")).alias("less"), F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"))
    distinct = digested.groupBy("run", *KEY).agg(F.min(best).alias("best"), F.count(F.lit(1)).alias("n"))
    digest = F.struct(*KEY, "best", "n")
    level = distinct.groupBy("run", F.substring(F.hex("sha"), 1, digits).alias("range")).agg(F.sort_array(F.collect_list(digest)).alias("digests"))
    done = 0
    while runs > 1:
        level = level.groupBy(F.expr(f"run div {fan_in}").alias("run"), "range").agg(F.collect_list("digests").alias("segments"))
        level = level.select("run", "range", _merged(F.col("segments"), fan_in).alias("digests"))
        runs, done = -(-runs // fan_in), done + 1
        if done % rounds_a_cut == 0:
            level = cut(level)
    return level.select(F.explode("digests").alias("d")).select(*[f"d.{k}" for k in KEY], F.col("d.best.doc_id").alias("keep_id"), F.col("d.n").alias("group_size"))


def exact_dedup(docs: DataFrame, fan_in: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row of docs."""
    # the digests are small (no text) and read twice
    digested = cut(digests(docs, id_col, text_col))
    last, rows = digested.agg(F.max("run"), F.count(F.lit(1))).first()
    best = tree_merge(digested, (last or 0) + 1, fan_in, rows)
    # both sides are exchanged on the digest; a hot digest is split by AQE's skew join
    return digested.join(best, KEY).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row for each text. Of rows that repeat id and text any one stays; rows
    without an id are never dropped, for nothing tells them apart."""
    verdict = exact_dedup(docs, id_col=id_col, text_col=text_col)
    dropped = verdict.where(~F.col("kept") & F.col("doc_id").isNotNull()).select("doc_id", "text_sha256")
    again = cut(verdict.where(F.col("doc_id").isNotNull()).groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if again.isEmpty():
        return keep_rows(docs, dropped.select("doc_id"), id_col, "left_anti")
    # some ids come more than once: their rows, few, are told apart by text
    once = keep_rows(keep_rows(docs, again, id_col, "left_anti"), dropped.select("doc_id"), id_col, "left_anti")
    more = keep_rows(docs, again, id_col).withColumn("__ff_text", F.sha2(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), SPACE, "").cast("binary"), 256))
    gone = dropped.select(F.col("doc_id").alias("__ff_id"), F.col("text_sha256").alias("__ff_gone"))
    more = more.join(gone, (more[id_col] == gone["__ff_id"]) & (more["__ff_text"] == gone["__ff_gone"]), "left_anti")
    return once.unionByName(more.dropDuplicates([id_col, "__ff_text"]).select(*docs.columns))

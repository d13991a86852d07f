"""Mixing sources to target weights.

A row's size is its word count. Sources in code point order, null last, have the
weights 5, 2, 1, repeating, and share `share` (1.5) of all sizes; no target is above
`most` (2) times its source's size, and what a cap frees is shared among the others
by weight until none is above (water filling, in closed form over prefix sums of the
sources ordered by cap/weight).

Within a source rows are ordered by a hash-random key. The order is never built by
one task: the leading bits of the key cut a source into ranges of some `range_rows`
rows; each range is sorted on its own, and the word counts before it come from
prefix sums in two levels (ranges within a block of 1,024 ranges, blocks within the
source). A source's target, rounded to a word, is spent on whole epochs and, for the
rest, on the rows of the order until the budget is used up; the row at the cut gives
only its leading words. So each source's taken words equal its rounded target.

Null texts and empty texts have size 0 and are taken 0 times. Rows of one id have the
same key and are ordered by size. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioforge.llm.columns import words
from folioforge.session import broadcast_if_small, cut

WEIGHTS = (5, 2, 1)


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row a source: source, sid, rows, source_size and target."""
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("sid") % len(weights) + 1).cast("int"))
    every = Window.orderBy("ratio", "sid")
    capped = (
        totals.withColumn("sid", place)
        .withColumn("weight", weight)
        .withColumn("cap", most * F.col("source_size").cast("double"))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("all", F.sum("source_size").over(Window.partitionBy()) * F.lit(share))
        .withColumn("spent", F.coalesce(F.sum("cap").over(every.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(every.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("level", (F.col("all") - F.col("spent")) / F.col("open"))
        # the first source, in order of ratio, that its cap doesn't hold back sets the level for all after it
        .withColumn("first_open", F.min(F.when(F.col("ratio") > F.col("level"), F.struct("ratio", "sid", "level"))).over(Window.partitionBy()))
    )
    held = F.col("first_open").isNull() | (F.struct("ratio", "sid") < F.struct("first_open.ratio", "first_open.sid"))
    target = F.when(held, F.col("cap")).otherwise(F.col("first_open.level") * F.col("weight"))
    return capped.select("source", "sid", "rows", "source_size", target.alias("target"))


def mix(docs: DataFrame, seed: int = 7, range_rows: int = 512, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **targets) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, epochs, cut and hash (of the text) of every row of docs;
    taken = epochs * size + cut. Order is by hash of id and text, so rows that share an id lie apart."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    sized = cut(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.size(words(F.col(text_col))).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"), F.xxhash64(text).alias("hash")))
    sources = cut(source_targets(sized, **targets))
    bits = F.greatest(F.lit(1), F.least(F.lit(40), F.ceil(F.log2(F.col("rows") / F.lit(float(range_rows)))).cast("int")))
    sources = sources.withColumn("bits", bits).withColumnRenamed("source", "__ff_source")
    rows = (
        sized.join(broadcast_if_small(sources, sources.count()), F.col("source").eqNullSafe(F.col("__ff_source")))
        .drop("__ff_source", "rows")
        .withColumn("key", F.xxhash64("doc_id", "crc", F.lit(seed)))
        .withColumn("range", F.expr("shiftrightunsigned(key, 64 - bits)"))
    )
    ranges = rows.groupBy("sid", "range").agg(F.sum("size").alias("words")).withColumn("block", F.shiftright("range", 10))
    blocks = ranges.groupBy("sid", "block").agg(F.sum("words").alias("words"))
    earlier = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    before = lambda col, window: F.coalesce(F.sum(col).over(window), F.lit(0))
    blocks = blocks.select("sid", "block", before("words", earlier("sid").orderBy("block")).alias("before_block"))
    ranges = ranges.join(blocks, ["sid", "block"]).select(
        "sid", "range", (F.col("before_block") + before("words", earlier("sid", "block").orderBy("range"))).alias("before_range")
    )
    placed = rows.join(ranges, ["sid", "range"]).withColumn(
        "before", F.col("before_range") + before("size", earlier("sid", "range").orderBy("key", "doc_id", "size"))
    )
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(F.lit(0).cast("long"))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("budget") - F.col("epochs") * F.col("source_size") - F.col("before")))
    out = placed.withColumn("budget", budget).withColumn("epochs", epochs).withColumn("cut", part)
    taken = F.col("epochs") * F.col("size") + F.col("cut")
    return out.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), "epochs", "cut", "hash")


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", chars_col: str = "n_chars", **how) -> DataFrame:
    """The mix itself, in the columns of docs: a row for each time a document is taken,
    the one at its source's cut with its leading words only (and n_chars to match).
    Rows that share id, source and text follow one another in the mix: of such rows as many are taken as are due. They are
    numbered only where the cut falls among them, which is once a source at most."""
    group = ["doc_id", "source", "hash"]
    taken = mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, **how).groupBy(*group, "size").agg(F.count(F.lit(1)).alias("rows"), F.max("epochs").cast("int").alias("epochs"), F.sum("cut").alias("cut"))
    due = taken.where((F.col("size") > 0) & ((F.col("epochs") > 0) | (F.col("cut") > 0))).select(F.struct(*group, "size", "rows", "epochs", F.expr("cut div size").alias("whole"), (F.col("cut") % F.col("size")).cast("int").alias("rest")).alias("__ff_mix"))
    hashed = docs.withColumn("__ff_hash", F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    m = lambda name: F.col(f"__ff_mix.{name}")
    joined = hashed.join(due, hashed[id_col].eqNullSafe(m("doc_id")) & hashed[source_col].eqNullSafe(m("source")) & (hashed["__ff_hash"] == m("hash")))
    alike = (m("whole") == m("rows")) | (m("whole") == 0) & (m("rest") == 0)
    same = Window.partitionBy(m("doc_id"), m("source"), m("hash")).orderBy("__ff_hash")
    placed = joined.where(alike).withColumn("__ff_nth", F.lit(0)).unionByName(joined.where(~alike).withColumn("__ff_nth", F.row_number().over(same) - 1))
    once_more = (F.col("__ff_nth") < m("whole")).cast("int")
    rest = F.when(F.col("__ff_nth") == m("whole"), m("rest")).otherwise(F.lit(0))
    copies = F.concat(F.array_repeat(F.lit(-1), m("epochs") + once_more), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<int>")))
    each = placed.withColumn("__ff_words", F.explode(copies))
    led = F.regexp_extract_all(F.col(text_col), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    text = F.when(F.col("__ff_words") < 0, F.col(text_col)).otherwise(F.array_join(F.slice(led, 1, F.greatest(F.col("__ff_words"), F.lit(1))), ""))
    out = each.withColumn(text_col, text)
    if chars_col in docs.columns:
        kind = docs.schema[chars_col].dataType
        out = out.withColumn(chars_col, F.when(F.col("__ff_words") < 0, F.col(chars_col)).otherwise(F.length(text_col)).cast(kind))
    return out.select(*[out[c] for c in docs.columns])

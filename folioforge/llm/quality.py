"""Quality rules with adaptive thresholds.

Base counts and rules are per row (see base_counts). Beyond them, each metric of
METRICS gets its thresholds from the data: every (language, source) has a mergeable
quantile sketch of the metric over its rows that pass the base rules, a histogram over
logarithmic buckets (relative error ALPHA) that is built with map-side aggregation and
merged by adding counts, so that it depends on no order and reruns agree. To each
source's sketch that of its language is merged, scaled to the weight of PRIOR rows, and
to each language's that of everything likewise; so thresholds move from the language's
to the source's own as its rows grow, at no point by a switch. A row fails if a metric
lies beyond Q3 + reach * spread or, where the metric has a lower fence, below
Q1 - reach * spread; the spread is Q3 - Q1, or the metric's floor where the quartiles
all but coincide. Thresholds (one row a group) are joined back to the rows' counts; no text
is shuffled.

Nulls in language or source are groups of their own. Null and empty texts count 0
words and fail the base rules. Rows repeating an id are judged one by one. An empty
table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions.binding import let
from folioforge.llm.columns import words
from folioforge.session import broadcast_if_small, cut

ALPHA = 0.01
GAMMA = (1 + ALPHA) / (1 - ALPHA)
#: Rows that a sketch merged from above counts as, in units of rows and shares of a sketch.
PRIOR, ROW, WHOLE = 100, 10**7, 10**9
#: Metric: counts it divides, the floor of its spread, whether it has a lower fence too.
METRICS = {
    "symbols_a_word": ("n_symbols", "n_words", 0.01, False),
    "upper_a_char": ("n_upper", "word_chars", 0.002, False),
    "marks_a_char": ("n_marks", "word_chars", 0.003, False),
    "dup_lines_a_line": ("n_dup_lines", "n_lines", 0.06, False),
    "repeats_a_word": ("n_repeat_words", "n_words", 0.05, False),
    "chars_a_word": ("word_chars", "n_words", 0.1, True),
}
REACH = 6.0


def repeat_words(v: Column) -> Column:
    """How many of the words v lie in a 3-word window that v has twice or more."""
    window = lambda w, i: F.xxhash64(w, F.get(v, i + 1), F.get(v, i + 2))
    hashes = F.transform(F.slice(v, 1, F.greatest(F.size(v) - 2, F.lit(0))), window)

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1), p + 3) - p))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    def twice(s: Column) -> Column:
        same = lambda e, k: F.get(s, k)["h"] == e["h"]
        marked = F.transform(s, lambda e, k: F.when(same(e, k - 1) | same(e, k + 1), e["i"]))
        return let(F.array_sort(F.filter(marked, lambda i: i.isNotNull())), covered)

    def counted(h: Column) -> Column:
        keyed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(keyed, twice))

    return let(hashes, counted)


def base_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Counts of every row; windows are compared by 64-bit hashes within one text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    hits = lambda pattern: F.regexp_count(text, F.lit(pattern)).cast("long")
    of_words = let(
        words(F.col(text_col)),
        lambda v: F.struct(
            F.size(v).cast("long").alias("n_words"), F.length(F.array_join(v, "")).cast("long").alias("word_chars"), repeat_words(v).cast("long").alias("n_repeat_words")
        ),
    )
    of_lines = let(
        F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
        lambda v: F.struct(F.size(v).cast("long").alias("n_lines"), (F.size(v) - F.size(F.array_distinct(v))).cast("long").alias("n_dup_lines")),
    )
    out = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(lang_col).alias("lang"),
        F.col(source_col).alias("source"),
        of_words.alias("w"),
        of_lines.alias("l"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        hits(r"\p{Lu}").alias("n_upper"),
        hits(r"[\p{P}\p{S}]").alias("n_marks"),
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.select("doc_id", "lang", "source", "w.*", "l.*", "n_symbols", "n_upper", "n_marks").withColumn("base_failed", failed)


def _ratio(name: str) -> Column:
    over, under, _, _ = METRICS[name]
    return F.coalesce(F.try_divide(F.col(over).cast("double"), F.col(under).cast("double")), F.lit(0.0))


def sketches(counts: DataFrame) -> DataFrame:
    """lang, source, metric, bucket and n of the rows that pass the base rules."""
    values = F.array(*[F.struct(F.lit(m).alias("metric"), _ratio(m).alias("x")) for m in METRICS])
    each = counts.where(~F.col("base_failed")).select("lang", "source", F.explode(values).alias("m"))
    bucket = F.when(F.col("m.x") > 0, F.ceil(F.log(F.col("m.x")) / F.log(F.lit(GAMMA))).cast("int"))
    return each.groupBy("lang", "source", F.col("m.metric").alias("metric"), bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def _shares(sketch: DataFrame, group: list[str]) -> DataFrame:
    """Each bucket's share of its sketch, in parts of WHOLE, rounded down (whole numbers: no order matters)."""
    summed = sketch.withColumn("every", F.sum("n").over(Window.partitionBy(*group, "metric")))
    return summed.select(*group, "metric", "bucket", F.expr(f"cast(n as decimal(20,0)) * {WHOLE} div every").alias("share"))


def _blended(sketch: DataFrame, group: list[str], above: DataFrame, by: list[str]) -> DataFrame:
    """sketch (group, metric, bucket, n) with the shares of the sketch above merged to each group's."""
    groups = sketch.select(*group).distinct()
    up = above.select(*[F.col(c).alias(f"up_{c}") for c in by], "metric", "bucket", "share")
    up = broadcast_if_small(up, up.count())
    prior = groups.join(up, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"up_{c}")) for c in by], F.lit(True)))
    both = sketch.select(*group, "metric", "bucket", (F.col("n") * ROW).alias("n")).unionByName(
        prior.select(*group, "metric", "bucket", (F.col("share") * (PRIOR * ROW // WHOLE)).cast("long").alias("n"))
    )
    return both.groupBy(*group, "metric", "bucket").agg(F.sum("n").alias("n"))


def thresholds(sketch: DataFrame, reach: float = REACH) -> DataFrame:
    """lang, source and limits: metric -> (low, high)."""
    fine = cut(sketch)
    lang = fine.groupBy("lang", "metric", "bucket").agg(F.sum("n").alias("n"))
    every = cut(_shares(fine.groupBy("metric", "bucket").agg(F.sum("n").alias("n")), []))
    of_lang = cut(_shares(_blended(lang, ["lang"], every, []), ["lang"]))
    group = ["lang", "source", "metric"]
    of_source = Window.partitionBy(*group)
    sums = _blended(fine, ["lang", "source"], of_lang, ["lang"])
    sums = sums.withColumn("upto", F.sum("n").over(of_source.orderBy(F.col("bucket").asc_nulls_first()))).withColumn("all", F.sum("n").over(of_source))
    value = F.coalesce(2 * F.pow(F.lit(GAMMA), F.col("bucket")) / F.lit(GAMMA + 1), F.lit(0.0))
    at = lambda quarters: F.min(F.when(4 * F.col("upto") >= quarters * F.col("all"), value))
    quartiles = sums.groupBy(*group).agg(at(1).alias("q1"), at(3).alias("q3"))
    floor = F.create_map(*[x for m, (_, _, least, _) in METRICS.items() for x in (F.lit(m), F.lit(least))])[F.col("metric")]
    both = F.col("metric").isin([m for m, (_, _, _, low) in METRICS.items() if low])
    spread = reach * F.greatest(F.col("q3") - F.col("q1"), floor)
    limits = F.struct(F.when(both, F.col("q1") - spread).otherwise(F.lit(-1.0)).alias("low"), (F.col("q3") + spread).alias("high"))
    return quartiles.groupBy("lang", "source").agg(F.map_from_entries(F.collect_list(F.struct("metric", limits.alias("limit")))).alias("limits"))


def judge(docs: DataFrame, reach: float = REACH, **columns: str) -> DataFrame:
    """The base counts of every row, base_failed, kept and failed (the metrics that it fails; none are
    looked at where no row of a language and source passes the base rules)."""
    counts = cut(base_counts(docs, **columns))
    found = cut(thresholds(sketches(counts), reach).select(F.col("lang").alias("of_lang"), F.col("source").alias("of_source"), "limits"))
    joined = counts.join(broadcast_if_small(found, found.count()), F.col("lang").eqNullSafe(F.col("of_lang")) & F.col("source").eqNullSafe(F.col("of_source")), "left")
    checks = [F.when((_ratio(m) < F.col("limits")[m]["low"]) | (_ratio(m) > F.col("limits")[m]["high"]), F.lit(m)) for m in METRICS]
    out = joined.withColumn("failed", F.array_compact(F.array(*checks)))
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0)).drop("limits", "of_lang", "of_source")

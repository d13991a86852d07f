"""Themes of books: checking labelled records, assembling them, and rolling them up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions.text import first_page

# The taxonomy and the reasons a book may be dropped for.
TAXONOMY = {
    "mind-and-self": "Who am I really?",
    "how-to-live": "How should I live?",
    "suffering-and-loss": "Suffering and loss",
    "love-and-friendship": "Love and friendship",
    "power-and-justice": "Power and justice",
    "knowledge": "What can we know?",
    "reality": "What is real?",
    "meaning": "Why are we here?",
    "religion": "God, faith, doubt",
    "other": "Other",
}
DROP_REASONS = ["duplicate", "history-of-philosophy", "biography", "intro-textbook"]


def taxonomy(spark: SparkSession) -> DataFrame:
    """slug, label and ord; `other` comes last, at 99."""
    return spark.createDataFrame([(s, t, 99 if s == "other" else i) for i, (s, t) in enumerate(TAXONOMY.items(), 1)], "slug string, label string, ord int")


def prepare(books: DataFrame) -> DataFrame:
    """What a labeller is given of each book: title, translator names, classes, first page."""
    names = F.transform("translators", lambda t: t["name"])
    return books.select("book_id", "title", names.alias("translators"), "locc", first_page(F.col("canonical_text")).alias("first_page"))


def checked(records: DataFrame, slugs: list[str] | None = None) -> DataFrame:
    """records with keep true by default; any unknown slug of a kept book or unlisted reason of a
    dropped one fails the query."""
    keep = F.coalesce("keep", F.lit(True))
    known = F.array(*map(F.lit, slugs or list(TAXONOMY)))
    strange = keep & (F.size(F.array_except("themes", known)) > 0)
    unlisted = ~keep & ~F.coalesce(F.col("drop_reason").isin(DROP_REASONS), F.lit(False))
    said = lambda what: F.raise_error(F.concat(F.lit(f"{what} in the record of book "), F.col("book_id").cast("string"))).cast("boolean")
    return records.withColumn("keep", F.when(strange, said("unknown theme")).when(unlisted, said("unlisted reason")).otherwise(keep))


def assignments(records: DataFrame) -> DataFrame:
    return records.where("keep").select("book_id", "themes").orderBy("book_id")


def dropped(records: DataFrame) -> DataFrame:
    return records.where("not keep").select("book_id", F.col("drop_reason").alias("reason")).orderBy("book_id")


def totals(records: DataFrame) -> DataFrame:
    """books_classified, books_in_other and books_dropped."""
    return records.agg(
        F.count_if("keep").alias("books_classified"),
        F.count_if(F.col("keep") & F.array_contains("themes", "other")).alias("books_in_other"),
        F.count_if(~F.col("keep")).alias("books_dropped"),
    )


def counts(assigned: DataFrame, declared: DataFrame) -> DataFrame:
    """slug and books of every declared theme, 0 included, and of undeclared ones in use."""
    used = assigned.select(F.explode("themes").alias("slug")).groupBy("slug").agg(F.count(F.lit(1)).alias("books"))
    return declared.join(used, "slug", "full").select("slug", "label", "ord", F.coalesce("books", F.lit(0)).alias("books"))


def shown(counted: DataFrame) -> DataFrame:
    """Themes with books, and `other` always, in order."""
    return counted.where("books > 0 or slug = 'other'").orderBy("ord", "slug")


def books_in(assigned: DataFrame, slug: str) -> DataFrame:
    return assigned.where(F.array_contains("themes", slug)).select("book_id")


def theme_books(assigned: DataFrame, manifest: DataFrame, gone: DataFrame, slug: str) -> DataFrame:
    """Manifest rows of a theme's books that aren't dropped, by first translator and title."""
    ids = books_in(assigned, slug).join(gone.select("book_id"), "book_id", "left_anti")
    return manifest.join(ids, "book_id").orderBy(F.coalesce(F.get("translators", F.lit(0))["name"], F.lit("")), "title", "book_id")


def prewarm(manifest: DataFrame, n: int) -> DataFrame:
    """The first n books by first translator and title."""
    return manifest.orderBy(F.coalesce(F.get("translators", F.lit(0))["name"], F.lit("")), "title", "book_id").limit(n)


def with_added(ids: str, new: str) -> Column:
    return F.array_sort(F.array_union(F.col(ids), F.array(F.col(new))))


def with_removed(ids: str, old: str) -> Column:
    return F.array_sort(F.array_remove(F.col(ids), F.col(old)))

"""Catalogue rows to works that are free to use."""

from __future__ import annotations

import xml.etree.ElementTree as ElementTree
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from folioforge.functions.text import trim
from folioforge.schema import AGENT

# Kept classes, cutoff year, least number of works, year and role patterns.
CLASSES = ["B", "BC", "BD", "BH", "BJ"]
CUTOFF = 1975
LEAST_KEPT = 100
YEARS = r"(-?\d{1,4})\??(?U:\s)*(?:BCE|CE)?(?U:\s)*-(?U:\s)*(-?\d{1,4})?\??(?U:\s)*(?:BCE|CE)?"
ROLE = r"\[(Translator|Editor|Illustrator|Author|Compiler|Contributor|Commentator)\]"
OTHER_ROLES = ["Compiler", "Contributor", "Commentator"]
AGENTS = ArrayType(AGENT)


def semi_list(raw: Column) -> Column:
    """The non-blank parts between semicolons, trimmed."""
    return F.filter(F.transform(F.split(F.coalesce(raw, F.lit("")), ";"), trim), lambda x: x != "")


def agent(entry: Column) -> Column:
    """Name, years (BCE negative), role and source of one entry. A role is in square brackets,
    Author if there is none; years are a range whose first year must be given; the name is
    what comes before it. BCE counts for the birth if it stands before the first hyphen of the
    entry and for the death if after it."""
    tag = F.regexp_extract(entry, ROLE, 1)
    role = F.when(tag.isin(OTHER_ROLES), "Other").when(tag == "", "Author").otherwise(tag)
    bare = F.regexp_replace(entry, f"(?s)^(.*?){ROLE}", "$1")
    cut = F.instr(bare, "-")
    before, after = F.when(cut > 0, F.substring(bare, F.lit(1), cut - 1)).otherwise(bare), F.when(cut > 0, F.substring(bare, cut + 1, F.length(bare))).otherwise(F.lit(""))

    def year(group: int, side: Column) -> Column:
        y = F.nullif(F.regexp_extract(bare, YEARS, group), F.lit("")).cast("int")
        return F.when(side.contains("BCE"), -F.abs(y)).otherwise(y)

    lead = F.when(bare.rlike(YEARS), F.regexp_extract(bare, f"(?s)^(.*?){YEARS}", 1)).otherwise(bare)
    return F.struct(
        F.regexp_replace(lead, r"(?U)[,\s]+$", "").alias("name"), year(1, before).alias("birth_year"), year(2, after).alias("death_year"), role.alias("role"), F.lit("CatalogCsv").alias("source")
    ).cast(AGENT)


def agents(raw: Column) -> Column:
    return F.transform(semi_list(raw), agent)


def of_role(people: Column, role: str) -> Column:
    return F.filter(people, lambda a: a["role"] == role)


def is_kept_class(locc: Column) -> Column:
    return F.arrays_overlap(locc, F.array(*map(F.lit, CLASSES)))


@F.pandas_udf(AGENTS)
def rdf_translators(texts: pd.Series) -> pd.Series:
    """Agents below any trl element, whatever the namespace, that have a name; null if the
    document doesn't parse."""
    local = lambda e: e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""

    def number(text: str | None) -> int | None:
        try:
            return int((text or "").strip())
        except ValueError:
            return None

    def read(xml: str | None) -> list[dict] | None:
        try:
            root = ElementTree.fromstring(xml or "")
        except ElementTree.ParseError:
            return None
        out = []
        for block in (e for e in root.iter() if local(e) == "trl"):
            for person in (e for e in block.iter() if local(e) == "agent"):
                said = {local(c): c.text for c in person}
                if name := (said.get("name") or "").strip():
                    out.append({"name": name, "birth_year": number(said.get("birthdate")), "death_year": number(said.get("deathdate")), "role": "Translator", "source": "Rdf"})
        return out

    return texts.map(read)


def first_failure(rows: DataFrame) -> DataFrame:
    """rows (type, language, locc) with the first test that each fails, null if none."""
    failed = F.when(~F.coalesce(F.col("type") == "Text", F.lit(False)), "type").when(~F.coalesce(F.col("language") == "en", F.lit(False)), "language").when(~F.coalesce(is_kept_class(F.col("locc")), F.lit(False)), "class")
    return rows.withColumn("failed", failed)


def parsed(catalogue: DataFrame) -> DataFrame:
    """Catalogue rows with their lists taken apart."""
    return catalogue.select(
        "book_id", "type", trim(F.col("title")).alias("title"), trim(F.col("language")).alias("language"), semi_list(F.col("locc")).alias("locc"),
        semi_list(F.col("subjects")).alias("subjects"), semi_list(F.col("bookshelves")).alias("bookshelves"), F.col("authors").alias("authors_raw"),
    )


def passed(tested: DataFrame) -> DataFrame:
    """Rows of first_failure that fail no test, as candidates."""
    return tested.where("failed is null").drop("failed", "type").withColumn("csv_translators", of_role(agents(F.col("authors_raw")), "Translator"))


def candidates(catalogue: DataFrame) -> DataFrame:
    """Catalogue rows that pass all tests, as candidates."""
    return passed(first_failure(parsed(catalogue)))


def rejections(rows: DataFrame) -> DataFrame:
    """How many rows fail each test first; `kept` for the rest."""
    return first_failure(rows).groupBy(F.coalesce("failed", F.lit("kept")).alias("outcome")).agg(F.count(F.lit(1)).alias("rows"))


def with_translators(found: DataFrame, rdf: DataFrame) -> DataFrame:
    """book_id, translators (the catalogue's if it has any, else those of the RDF record),
    is_original_language and rdf_has_translator. rdf: book_id, translators (null: unreadable)."""
    none = F.array().cast(AGENTS)
    joined = found.join(rdf.select("book_id", F.col("translators").alias("rdf")), "book_id", "left")
    own = F.coalesce("csv_translators", none)
    chosen = F.when(F.size(own) > 0, own).otherwise(F.coalesce("rdf", none))
    original = (F.size(chosen) == 0) & ~F.coalesce(F.col("authors_raw").contains("[Translator]"), F.lit(False))
    return joined.select("book_id", chosen.alias("translators"), original.alias("is_original_language"), (F.size(F.coalesce("rdf", none)) > 0).alias("rdf_has_translator"))


def last_death(people: Column, role: str) -> Column:
    """The latest known year of death; null if none is known."""
    return F.array_max(F.transform(of_role(people, role), lambda a: a["death_year"]))


def decisions(translators: DataFrame, found: DataFrame, cutoff: int = CUTOFF) -> DataFrame:
    """Each work with its decision: kept, too-recent, no-data or missing-candidate, and reason.
    Unknown years are passed over; a work of which no year is known is not kept."""
    known = found.select("book_id", "title", "locc", "authors_raw", F.lit(True).alias("there"))
    joined = translators.join(known, "book_id", "left")
    year = F.when(F.col("is_original_language"), last_death(agents(F.col("authors_raw")), "Author")).otherwise(last_death(F.col("translators"), "Translator"))
    decision = F.when(F.col("there").isNull(), "missing-candidate").when(year.isNull(), "no-data").when(year <= cutoff, "kept").otherwise("too-recent")
    reason = F.when(F.col("is_original_language"), "OriginalLanguagePublicDomain").otherwise("TranslatorPublicDomain")
    out = joined.withColumn("decision", decision).withColumn("reason", F.when(F.col("decision") == "kept", reason))
    return out.select("book_id", "title", "locc", "translators", "decision", "reason")


def above_floor(kept: int, least: int = LEAST_KEPT) -> None:
    """Fails if fewer than `least` works are kept."""
    if kept < least:
        raise ValueError(f"only {kept} works are kept; {least} is the least")


def enough_kept(decided: DataFrame, least: int = LEAST_KEPT) -> DataFrame:
    """decided, once at least `least` works are kept; fails otherwise."""
    above_floor(decided.where("decision = 'kept'").count(), least)
    return decided

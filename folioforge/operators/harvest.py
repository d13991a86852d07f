"""Term candidates: observations gathered into clusters.

An observation is canonical, substrate, gloss, book_id, chunk_id and support. A cluster
is a lower-cased canonical with a substrate; it takes canonical and gloss from its best
supported observation (ties: smallest book, then chunk).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.operators.judge import is_faithful, score_supports
from folioforge.session import broadcast_if_small, cut

PER_CHUNK = 5
TERMS = "struct<terms:array<string>>"
GLOSS = "struct<substrate:string,gloss:string>"


def parsed_terms(answer: Column) -> Column:
    """The non-blank terms of a JSON answer; none if it doesn't parse."""
    terms = F.coalesce(F.from_json(answer, TERMS)["terms"], F.array().cast("array<string>"))
    return F.filter(terms, lambda t: F.coalesce(F.regexp_replace(t, r"(?U)^\s+|\s+$", "") != "", F.lit(False)))


def candidates(chunks: DataFrame, identify: Callable[[Column], Column]) -> DataFrame:
    """book_id, chunk_id, text and term, at most PER_CHUNK a chunk, from a model's JSON answers."""
    return chunks.select("book_id", "chunk_id", "text", F.explode(F.slice(parsed_terms(identify(F.col("text"))), 1, PER_CHUNK)).alias("canonical"))


def glossed(found: DataFrame, gloss: Callable[[Column, Column], Column]) -> DataFrame:
    """Candidates with substrate and gloss; those whose answer lacks either are dropped."""
    answer = F.from_json(gloss(F.col("text"), F.col("canonical")), GLOSS)
    return found.withColumn("a", answer).select("book_id", "chunk_id", "text", "canonical", "a.substrate", "a.gloss").dropna(subset=["substrate", "gloss"])


def gated(scored: DataFrame) -> DataFrame:
    """Observations whose gloss is faithful (support, contradiction_max)."""
    return scored.where(is_faithful())


def cluster(observations: DataFrame, seed: DataFrame) -> DataFrame:
    """key, canonical, substrate, gloss, size, support_mean and seed_match of each cluster. seed:
    term, matched in lower case."""
    grouped = observations.groupBy(F.lower("canonical").alias("key"), "substrate").agg(
        F.count(F.lit(1)).alias("size"),
        F.round(F.avg("support"), 6).alias("support_mean"),
        F.min(F.struct((-F.col("support")).alias("low"), "book_id", "chunk_id", "canonical", "gloss")).alias("top"),
    )
    known = seed.select(F.lower("term").alias("key")).distinct()
    marked = grouped.join(broadcast_if_small(known.withColumn("seed_match", F.lit(True)), known.count()), "key", "left")
    return marked.select("key", "top.canonical", "substrate", "top.gloss", "size", "support_mean", F.coalesce("seed_match", F.lit(False)).alias("seed_match"))


def citations(observations: DataFrame) -> DataFrame:
    """A row for each observation of a cluster (key, substrate): a cluster may have any number. Their
    order is support from high to low, then book and chunk."""
    return observations.select(F.lower("canonical").alias("key"), "substrate", "book_id", "chunk_id", "support")


def harvested(chunks: DataFrame, identify: Callable[[Column], Column], gloss: Callable[[Column, Column], Column], score: Callable[[Column, Column], Column], seed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunks to clusters and their citations: terms by a model's answers, glosses, the gate by the
    sentences of gloss and chunk, clusters. chunks (book_id, chunk_id, text) are read twice: their texts are shuffled
    once, to the glosses that they are judged by, and aren't kept beside every term."""
    # terms of a chunk that have the same gloss are judged once
    key = F.substring(F.unhex(F.sha2(F.concat_ws("\x00", "text", "gloss").cast("binary"), 256)), 1, 16)
    found = cut(glossed(candidates(chunks, identify), gloss).withColumn("judged", key).drop("text"))
    alike = found.groupBy("judged").agg(F.min(F.struct("book_id", "chunk_id", "gloss")).alias("x")).select("judged", "x.*")
    # by number of tasks: sentences meet in the square of their number, so that a task's bytes don't tell its work
    dealt = lambda rows: rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "book_id", "chunk_id")
    of = dealt(chunks.select("book_id", "chunk_id", "text")).join(dealt(alike), ["book_id", "chunk_id"]).where(F.col("judged") == key)
    scored = score_supports(of, "judged", "text", "gloss", score, True)
    kept = gated(found.join(scored, "judged")).select("book_id", "chunk_id", "canonical", "substrate", "gloss", "support")
    return cluster(kept, seed), citations(kept)


def ordered(clusters: DataFrame) -> DataFrame:
    return clusters.orderBy(F.desc("size"), "canonical", "substrate")

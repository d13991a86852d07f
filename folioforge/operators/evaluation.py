"""Ranking quality: rank metrics of each query, and their summary."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.functions.text import one_line, trim
from folioforge.functions.vectors import embed, hashed
from folioforge.operators import search
from folioforge.session import cut
from folioforge.sources.readers import write_jsonl


def marked(hits: DataFrame, expected: DataFrame) -> DataFrame:
    """hits with whether they are expected. expected: query_id, book_id, a row for each pair."""
    wanted = expected.select("query_id", "book_id").distinct().withColumn("relevant", F.lit(True))
    return hits.join(wanted, ["query_id", "book_id"], "left").withColumn("relevant", F.coalesce("relevant", F.lit(False)))


def expecting(queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of queries with expected_ids: the queries with whether they expect anything, and the expected pairs."""
    return queries.withColumn("expects", F.size("expected_ids") > 0), queries.select("query_id", F.explode("expected_ids").alias("book_id"))


def per_query(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """query_id, expected_rank, expected_best and reciprocal_rank; the first two are null and the
    last 0 where nothing expected is found or expected. hits: query_id, score, rank, relevant."""
    found = hits.where("relevant").groupBy("query_id").agg(F.min("rank").alias("expected_rank"), F.max("score").alias("expected_best"))
    rr = F.coalesce(1.0 / F.col("expected_rank"), F.lit(0.0))
    return queries.select("query_id").join(found, "query_id", "left").withColumn("reciprocal_rank", rr)


def summary(queries: DataFrame, measured: DataFrame, hits: DataFrame) -> DataFrame:
    """One row: recall, mrr and hits at 1, 5 and 10 over phrase queries that expect something
    (their number counts as 1 at least), and the best score of any adversarial query, 0 at
    least. queries: query_id, kind, expects."""
    kinds = queries.select("query_id", "kind", "expects")
    of = measured.join(kinds, "query_id").where("kind = 'phrase'")
    share = lambda c: F.sum(F.when(F.col("expects") & c, 1.0).otherwise(0.0)) / F.greatest(F.sum(F.col("expects").cast("int")), F.lit(1))
    within = lambda n: F.coalesce(F.col("expected_rank") <= n, F.lit(False))
    best = hits.join(kinds.where("kind = 'adversarial'"), "query_id").agg(F.greatest(F.coalesce(F.max("score"), F.lit(0.0)), F.lit(0.0)).alias("adversarial_max"))
    mrr = F.sum(F.when(F.col("expects"), F.col("reciprocal_rank")).otherwise(0.0)) / F.greatest(F.sum(F.col("expects").cast("int")), F.lit(1))
    one = of.agg(
        F.count(F.lit(1)).alias("queries"),
        F.coalesce(F.sum(F.col("expects").cast("int")), F.lit(0)).alias("with_expected"),
        F.coalesce(share(F.col("expected_rank").isNotNull()), F.lit(0.0)).alias("recall"),
        F.coalesce(mrr, F.lit(0.0)).alias("mrr"),
        *[F.coalesce(share(within(n)), F.lit(0.0)).alias(f"hits_at_{n}") for n in (1, 5, 10)],
    )
    return one.crossJoin(best)  # one row by one row


def span(hits: DataFrame) -> DataFrame:
    """How far each query's best and worst scores lie apart."""
    return hits.groupBy("query_id").agg((F.max("score") - F.min("score")).alias("span"))


def records(hits: DataFrame, limit: int = 10) -> DataFrame:
    """The first hits of each query as they are reported."""
    return hits.where(F.col("rank") <= limit).withColumn("excerpt", one_line(F.col("excerpt")))


def report(measured: DataFrame) -> DataFrame:
    """Queries by rank, those without one last."""
    return measured.orderBy(F.col("expected_rank").asc_nulls_last(), "query_id")


def run(queries: DataFrame, chunks: DataFrame, vectors: DataFrame, model: Callable = hashed, n: int = 50, **how) -> tuple[DataFrame, DataFrame, DataFrame]:
    """An evaluation: hits, the measures of each query, and their summary. queries: query_id, kind (phrase,
    topical or adversarial), query, expected_ids. A blank query isn't searched for and has no hits.
    model: what gives texts their vectors; how: the ways of a search."""
    asked = queries.where(trim(F.col("query")) != "")
    found = search.search(asked.select("query_id", "query"), chunks, vectors, asked.select("query_id", embed(F.col("query"), model).alias("embedding")), n=n, **how)
    kinds, expected = expecting(queries)
    hits = cut(marked(found, expected))
    measured = per_query(kinds, hits)
    return hits, measured, summary(kinds, measured, hits)


def write_results(hits: DataFrame, measured: DataFrame, summed: DataFrame, path: str) -> None:
    """The results as JSON lines: the summary, the queries by rank, and their first hits."""
    for name, rows in (("summary", summed), ("queries", report(measured)), ("hits", records(hits).orderBy("query_id", "rank"))):
        write_jsonl(rows, f"{path}/{name}")

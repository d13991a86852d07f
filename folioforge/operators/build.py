"""The build as one plan: catalogue, rights, books, paragraphs, chunks, vectors, shards, manifest.

Each stage counts as it writes: observed metrics are read when a stage's write is done and lie beside its
output, so no stage is computed once more to be counted. The floor under the kept books is checked on them, after the
decisions are written.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from folioforge.functions import text as T
from folioforge.functions.vectors import embed
from folioforge.operators import catalogue, chunking, publish, xhtml
from folioforge.session import cut
from folioforge.sources import readers

#: Steps that a run may leave out: those before shards are as of the last run then, or shards aren't written.
PREPARE, SHARDS = "prepare", "shards"


@dataclass
class Inputs:
    """Places of a build's inputs: catalogue CSV, RDF files, EPUB files; traditions (book_id, tradition)."""

    catalogue: str
    rdf: str
    epub: str
    traditions: DataFrame
    separator: str = "\n\n"
    skip: set[str] = field(default_factory=set)


class Counters:
    """Metrics of stages, observed while their rows pass."""

    def __init__(self):
        self.seen: dict[str, Observation] = {}

    def on(self, frame: DataFrame, stage: str, /, **metrics: Column) -> DataFrame:
        """frame, whose metrics are known once an action has run over it."""
        self.seen[stage] = Observation()
        return frame.observe(self.seen[stage], *(F.coalesce(m, F.lit(0)).cast("long").alias(name) for name, m in metrics.items()))

    def of(self, stage: str) -> dict[str, int]:
        return self.seen[stage].get

    def write(self, spark: SparkSession, out: str, *stages: str) -> None:
        """Writes the metrics of stages that have run, in place of those of an earlier run."""
        for stage in stages:
            rows = [(stage, name, value) for name, value in self.of(stage).items()]
            spark.createDataFrame(rows, "stage string, metric string, value long").coalesce(1).write.mode("overwrite").json(f"{out}/counters/{stage}")


def counters(spark: SparkSession, out: str) -> DataFrame:
    """stage, metric and value of a build's stages."""
    return spark.read.schema("stage string, metric string, value long").json(f"{out}/counters/*")


def rows_where(condition: Column) -> Column:
    return F.count_if(condition)


def every() -> Column:
    return F.count(F.lit(1))


def decided(spark: SparkSession, inputs: Inputs, counted: Counters | None = None) -> DataFrame:
    """Every candidate of the catalogue with its decision."""
    counted = counted or Counters()
    parsed = catalogue.parsed(readers.read_catalogue(spark, inputs.catalogue))
    failed = lambda test: rows_where(F.col("failed") == test)
    tested = counted.on(catalogue.first_failure(parsed), "catalogue", rows=every(), type=failed("type"), language=failed("language"), **{"class": failed("class")}, kept=rows_where(F.col("failed").isNull()))
    found = cut(catalogue.passed(tested))
    known = counted.on(catalogue.with_translators(found, readers.read_rdf(spark, inputs.rdf)), "translators", works=every(), from_rdf=rows_where(F.col("rdf_has_translator")), original=rows_where(F.col("is_original_language")))
    of = lambda decision: rows_where(F.col("decision") == decision)
    return counted.on(catalogue.decisions(known, found), "filter", kept=of("kept"), too_recent=of("too-recent"), no_data=of("no-data"), missing_candidate=of("missing-candidate"))


def canonical_texts(spark: SparkSession, inputs: Inputs, books: DataFrame, counted: Counters | None = None) -> DataFrame:
    """book_id, canonical_text and parse_warnings of the books (book_id): the paragraphs of their items in
    order, without metadata lines, and without items most of whose paragraphs are boilerplate."""
    counted = counted or Counters()
    items = readers.read_epub(spark, inputs.epub, books=books)
    parsed = items.select("book_id", "item", xhtml.paragraphs(F.col("html")).alias("p"), "ok")
    parsed = parsed.select("book_id", "item", F.filter("p.paragraphs", lambda x: ~xhtml.is_metadata_line(x)).alias("paragraphs"), (F.col("ok") & F.col("p.ok")).alias("ok"))
    parsed = counted.on(parsed, "items", items=every(), unreadable=rows_where(~F.col("ok")), paragraphs=F.sum(F.size("paragraphs")))
    ok = F.when(F.size(F.filter("paragraphs", xhtml.is_boilerplate)) * 2 <= F.size("paragraphs"), F.filter("paragraphs", lambda x: ~xhtml.is_boilerplate(x))).otherwise(F.array().cast("array<string>"))
    # a book is one row from here on, as it is one file before
    whole = parsed.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("item", ok.alias("paragraphs")))).alias("items"), F.count_if(~F.col("ok")).alias("parse_warnings"))
    raw = F.array_join(F.flatten(F.transform("items", lambda x: x["paragraphs"])), inputs.separator)
    texts = whole.select("book_id", T.canonicalise(raw).alias("canonical_text"), "parse_warnings")
    return counted.on(texts, "texts", books=every(), empty=rows_where(F.col("canonical_text") == ""), with_warnings=rows_where(F.col("parse_warnings") > 0))


def build(spark: SparkSession, inputs: Inputs, out: str, least_kept: int = catalogue.LEAST_KEPT, build_id: str = "local", embed_model_id: str = "hashed-64") -> DataFrame:
    """Writes decisions, texts, chunks with vectors, shards and the manifest under out (a URI); returns the
    manifest's rows. Every step's table is written, so that a run may go on from the last one."""
    counted = Counters()
    if PREPARE not in inputs.skip:
        decided(spark, inputs, counted).write.mode("overwrite").parquet(f"{out}/decisions")
        counted.write(spark, out, "catalogue", "translators", "filter")
        catalogue.above_floor(counted.of("filter")["kept"], least_kept)
        kept = spark.read.parquet(f"{out}/decisions").where("decision = 'kept'")
        canonical_texts(spark, inputs, kept, counted).write.mode("overwrite").parquet(f"{out}/texts")
        counted.write(spark, out, "items", "texts")
        texts = spark.read.parquet(f"{out}/texts")
        chunks = texts.select("book_id", F.posexplode(chunking.chunks(F.col("canonical_text"), separator=inputs.separator)).alias("chunk_ord", "c")).select("book_id", F.col("chunk_ord").cast("long").alias("chunk_ord"), "c.*")
        chunks = counted.on(chunks, "chunks", chunks=every(), tokens=F.sum("token_count"), bytes=F.sum(F.octet_length("text")))
        vectors = counted.on(chunks.withColumn("embedding", embed(F.col("text"))), "vectors", vectors=rows_where(F.col("embedding").isNotNull()), numbers=F.sum(F.size("embedding")))
        vectors.write.mode("overwrite").parquet(f"{out}/chunks")
        counted.write(spark, out, "chunks", "vectors")
    decisions, chunks = spark.read.parquet(f"{out}/decisions"), spark.read.parquet(f"{out}/chunks")
    kept = decisions.where("decision = 'kept'")
    if SHARDS not in inputs.skip:
        publish.write_shards(counted.on(publish.filtered_only(chunks, kept), "shards", rows=every(), bytes=F.sum(F.octet_length("text"))), f"{out}/shards")
        counted.write(spark, out, "shards")
    summaries = publish.shard_summary(chunks, F.col("book_id"), F.col("text"), "chunk_ord")
    rows = counted.on(publish.manifest(summaries, kept, inputs.traditions), "manifest", books=every(), chunks=F.sum("chunks"), bytes=F.sum("bytes"))
    publish.write_manifest(rows, f"{out}/manifest", build_id, embed_model_id, "")
    counted.write(spark, out, "manifest")
    return publish.read_manifest(spark, f"{out}/manifest")[1]


def verified(spark: SparkSession, out: str) -> DataFrame:
    """The books of a build whose shards, read back, aren't as the manifest declares."""
    declared = publish.read_manifest(spark, f"{out}/manifest")[1]
    found = publish.shard_summary(publish.read_shards(spark, f"{out}/shards"), F.col("book_id"), F.col("text"), "chunk_ord")
    return publish.mismatches(declared, found)


def book_view(spark: SparkSession, out: str, book_id: int) -> DataFrame:
    """A book as a reader sees it: title, translators, text, and the places of its chunks."""
    of = lambda frame: frame.where(F.col("book_id") == book_id)
    shard = of(publish.read_shards(spark, f"{out}/shards")).groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("chunk_id", "byte_start", "byte_end"))).alias("chunks"))
    book = of(spark.read.parquet(f"{out}/decisions")).select("book_id", "title", F.transform("translators", lambda t: t["name"]).alias("translators"))
    return book.join(of(spark.read.parquet(f"{out}/texts")).select("book_id", "canonical_text"), "book_id").join(shard, "book_id")

"""Publishing: shards by book, their summaries, the manifest, and checks of both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions.text import byte_slice, content_hash
from folioforge.sources import shards

SHARD_VERSION, MANIFEST_VERSION = shards.FORMAT, 1


def filtered_only(chunks: DataFrame, filtered: DataFrame) -> DataFrame:
    """chunks with their book's title; a book that isn't in filtered fails the query."""
    known = filtered.select("book_id", "title", F.lit(True).alias("there"))
    missing = F.raise_error(F.concat(F.lit("no filtered row for book "), F.col("book_id").cast("string"))).cast("string")
    return chunks.join(known, "book_id", "left").withColumn("title", F.when(F.col("there"), F.col("title")).otherwise(missing)).drop("there")


def with_embeddings(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """chunks with their vectors, by book and place; one without the other fails the query."""
    a, b = chunks.withColumn("in_chunks", F.lit(True)), vectors.withColumn("in_vectors", F.lit(True))
    joined = a.join(b, ["book_id", "chunk_ord"], "full")
    uneven = F.raise_error(F.concat(F.lit("chunks and vectors differ in book "), F.col("book_id").cast("string"))).cast("boolean")
    return joined.where(F.when(F.col("in_chunks") & F.col("in_vectors"), F.lit(True)).otherwise(uneven)).drop("in_chunks", "in_vectors")


def slice_matches(chunks: DataFrame, texts: DataFrame) -> DataFrame:
    """chunks with whether their text is the canonical text between their offsets."""
    joined = chunks.join(texts.select("book_id", "canonical_text"), "book_id")
    return joined.withColumn("same", byte_slice(F.col("canonical_text"), F.col("byte_start"), F.col("byte_end")) == F.col("text")).drop("canonical_text")


BLOCK, LEVELS = 4096, 3


def shard_summary(rows: DataFrame, book: Column, payload: Column, order: str) -> DataFrame:
    """book_id, sha256, bytes and chunks of each book. order: a whole number that places a row in its
    book. The hash is built in levels: that of a row's payload, of the hashes of each BLOCK
    places, of each BLOCK such blocks, and so on, so that no array grows with the book."""
    hashed = rows.select(
        book.alias("book_id"), F.col(order).cast("long").alias("place"), content_hash(payload).alias("sha256"), F.octet_length(payload).cast("long").alias("bytes"), F.lit(1).cast("long").alias("chunks")
    )
    for level in range(LEVELS + 1):
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "sha256"))), lambda x: x["sha256"]), "")
        block = [F.floor(F.col("place") / BLOCK).alias("block")] if level < LEVELS else []
        hashed = hashed.groupBy("book_id", *block).agg(content_hash(joined).alias("sha256"), F.sum("bytes").alias("bytes"), F.sum("chunks").alias("chunks"))
        hashed = hashed.withColumnRenamed("block", "place")
    return hashed.select("book_id", "sha256", "bytes", "chunks")


def shard_totals(summaries: DataFrame) -> DataFrame:
    return summaries.agg(F.sum("bytes").alias("bytes"), F.sum("chunks").alias("chunks"), F.count(F.lit(1)).alias("shards"), F.round(F.sum("bytes") / 1e6, 1).alias("megabytes"))


def manifest(summaries: DataFrame, filtered: DataFrame, traditions: DataFrame) -> DataFrame:
    """A row a book, with defaults where filtered or traditions lack it."""
    return (
        summaries.join(filtered.select("book_id", "title", "translators", "locc"), "book_id", "left")
        .join(traditions.select("book_id", "tradition"), "book_id", "left")
        .withColumn("title", F.coalesce("title", F.lit("")))
        .withColumn("locc", F.coalesce("locc", F.array().cast("array<string>")))
        .withColumn("tradition", F.coalesce("tradition", F.lit("uncategorised")))
    )


def write_shards(chunks: DataFrame, path: str) -> None:
    """A shard for each book and each PART_ROWS of its chunks, packed; the store's next version names these alone."""
    order = F.col("chunk_ord") if "chunk_ord" in chunks.columns else F.regexp_extract("chunk_id", r"(\d*)$", 1).try_cast("long")
    shards.write(chunks, path, F.coalesce(order, F.lit(0)), pack="true")


def version_gate(rows: DataFrame, wanted: int = SHARD_VERSION, column: str = "format_version") -> DataFrame:
    """rows without the version column; any other version fails the query."""
    wrong = F.raise_error(F.concat(F.lit("unsupported format version "), F.coalesce(F.col(column).cast("string"), F.lit("null")))).cast("boolean")
    return rows.where(F.when(F.coalesce(F.col(column) == wanted, F.lit(False)), F.lit(True)).otherwise(wrong)).drop(column)


def read_shards(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """The rows of all shards; one that isn't as its index says, or is of another version, fails the query."""
    return shards.read(spark, path, **options)


def write_manifest(rows: DataFrame, path: str, build_id: str, embed_model_id: str, generated: str) -> None:
    """The books' rows, and then the header, whose presence says that all is there."""
    rows.write.mode("overwrite").json(f"{path}/books")
    header = rows.agg(F.count(F.lit(1)).alias("books")).select(
        F.lit(MANIFEST_VERSION).alias("version"), F.lit(build_id).alias("build_id"), F.lit(embed_model_id).alias("embed_model_id"), F.lit(generated).alias("generated"), "books"
    )
    header.coalesce(1).write.mode("overwrite").json(f"{path}/header")


def read_manifest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    header = spark.read.json(f"{path}/header")
    return version_gate(header, MANIFEST_VERSION, "version"), spark.read.json(f"{path}/books")


def mismatches(declared: DataFrame, found: DataFrame) -> DataFrame:
    """book_id and outcome (missing, differs) of declared shards that aren't as declared; hashes
    are compared in any case. declared, found: book_id, sha256."""
    joined = declared.select("book_id", F.lower("sha256").alias("a")).join(found.select("book_id", F.lower("sha256").alias("b")), "book_id", "left")
    return joined.where(F.col("b").isNull() | (F.col("a") != F.col("b"))).select("book_id", F.when(F.col("b").isNull(), "missing").otherwise("differs").alias("outcome"))


def pending(units: DataFrame, done: DataFrame, key: str, force: bool = False) -> DataFrame:
    """Units that have no output yet; all of them if forced."""
    return units if force else units.join(done.select(key).distinct(), key, "left_anti")


def head(rows: DataFrame, n: int | None, *order: str) -> DataFrame:
    """The first n rows in the order given; all without n."""
    return rows if n is None else rows.orderBy(*order).limit(n)


def name_order(key: str) -> Column:
    """Order of numbered files by name: 10 comes before 2."""
    return F.col(key).cast("string").asc()

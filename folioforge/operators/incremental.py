"""Building a store of shards as books change.

Books arrive as files in a folder: book_id, text and `at`, by which the last word on a book counts; a null text takes the
book away. A run reads the files that no run before it has read (a file stream with availableNow, whose checkpoint lies
beside the store). Of each batch the last row of a book is held against the digest under which the store has the
book; only what differs is cut into chunks and written, as packed shards of a run that isn't published yet. The next manifest names
these and, in an index of its own, the shards of all other books as they lie. Then it takes the old one's place at once:
readers see either version whole, and the old one stays readable until `Store.vacuum`.

A manifest says which batch made it, so that a batch which runs again after a failure makes nothing anew. Texts that give no
chunks are not in the store.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions.text import canonicalise, content_hash
from folioforge.operators import chunking
from folioforge.session import cut
from folioforge.sources import shards

Chunker = Callable[[DataFrame], DataFrame]


def canonical_chunks(books: DataFrame) -> DataFrame:
    """book_id, chunk_ord and the chunks of the canonical texts of books (book_id, text), with content, their digests, if
    books have it."""
    told = [c for c in ("content",) if c in books.columns]
    cut_up = F.posexplode(chunking.chunks(canonicalise(F.col("text")))).alias("chunk_ord", "c")
    return books.select("book_id", *told, cut_up).select("book_id", F.col("chunk_ord").cast("long").alias("chunk_ord"), "c.*", *told)


def changed_books(changes: DataFrame, have: DataFrame) -> DataFrame:
    """key, book_id, text and content (its digest) of the books of changes (book_id, text, at) that aren't in have (key, content)
    as they are, or that are to go (null text)."""
    # grouped by the key of the join, so that texts are shuffled once
    named = changes.where("book_id is not null").withColumn("key", F.col("book_id").cast("string"))
    last = named.groupBy("key").agg(F.max(F.struct("at", "text", "book_id")).alias("last"))
    keyed = last.select("key", "last.book_id", "last.text", content_hash(F.col("last.text")).alias("content"))
    known = have.select(F.col("key").alias("known"), F.col("content").alias("before")).distinct()
    return keyed.join(known, keyed["key"] == known["known"], "left").where("known is not null and (text is null or content <> before) or known is null and text is not null").select("key", "book_id", "text", "content")


def apply(changes: DataFrame, path: str, chunked: Chunker = canonical_chunks, batch: int | None = None) -> int:
    """Brings the store at path (a URI) up to changes (book_id, text, at); returns its version."""
    spark, store = changes.sparkSession, shards.Store(path)
    version = store.current()
    before = store.manifest() if version else {"indexes": [], "runs": []}
    if batch is not None and before.get("batch", -1) >= batch:
        return version
    have = shards.index(spark, path)
    changed = cut(changed_books(changes, have))
    if changed.isEmpty():
        return version
    run = uuid.uuid4().hex
    rows = chunked(changed.where("text is not null").select("book_id", "text", "content"))
    if "content" not in rows.columns:
        rows = rows.join(changed.select(F.col("book_id").alias("__ff_book"), "content"), F.col("book_id") == F.col("__ff_book")).drop("__ff_book")
    shards.write(rows, path, F.col("chunk_ord"), mode="append", publish="false", run=run, content="content", built=str(version + 1), pack="true")
    told = json.loads(store.read(f"runs/{run}.json"))
    if version:
        carried = have.join(changed.select("key"), "key", "left_anti")
        carried.write.parquet(f"{path}/data/{run}-carried")
        lies = spark.read.schema(shards.INDEX_DDL).parquet(f"{path}/data/{run}-carried")
        files = lies.groupBy(F.substring_index(F.input_file_name(), "/", -1).alias("name")).agg(F.count(F.lit(1)).alias("n")).collect()  # a row a file
        runs = lies.select(F.substring_index("file", "/", 1).alias("run")).distinct().collect()  # a row a run
        told["indexes"] += [[f"{run}-carried/{r['name']}", r["n"]] for r in files]
        told["runs"] += [f"{run}-carried", *(r["run"] for r in runs)]
    return store.publish(told | {"batch": before.get("batch", -1) if batch is None else batch})


def run(spark: SparkSession, incoming: str, path: str, schema: str = "book_id long, text string, at long", chunked: Chunker = canonical_chunks) -> int:
    """Applies all Parquet files under incoming that earlier runs haven't read; returns the store's version."""
    stream = spark.readStream.schema(schema).parquet(incoming)
    query = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{path}/stream").foreachBatch(lambda rows, batch: apply(rows, path, chunked, batch) and None).start()
    query.awaitTermination()
    return shards.Store(path).current()


def manifest(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A row a book: key, content, built (the version that wrote its shards), parts, chunks, bytes and sha256 (of its
    shards' digests in order)."""
    part = F.struct("part", "sha256")
    summed = shards.index(spark, path, version).groupBy("key").agg(F.max("content").alias("content"), F.max("built").alias("built"), F.count(F.lit(1)).alias("parts"), F.sum("rows").alias("chunks"), F.sum("bytes").alias("bytes"), F.array_sort(F.collect_list(part)).alias("p"))
    return summed.withColumn("sha256", content_hash(F.array_join(F.transform("p", lambda x: x["sha256"]), ""))).drop("p")

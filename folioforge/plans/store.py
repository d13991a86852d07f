"""Queries over the store of shards: what readers find, and what a second run builds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.operators import incremental
from folioforge.plans import segments
from folioforge.plans.registry import query
from folioforge.plans.text import canonical_sql, docs
from folioforge.session import cut, remove_path, scratch, table
from folioforge.sources import shards

_NUMBER = "CAST(substr(source, 4) AS INT)"
#: Books whose copies or shards are damaged, and what readers make of them.
PLANTED = {1: ("refreshed", 1), 2: ("broken", 2), 3: ("missing", 1), 4: ("fetched", 1)}


@query(
    f"""SELECT {_NUMBER} AS book_id, doc_id // {shards.PART_ROWS} AS part, {'CASE ' + _NUMBER + ' ' + ' '.join(f"WHEN {b} THEN '{o}'" for b, (o, _) in PLANTED.items()) + " ELSE 'cached' END"} AS outcome,
    {'CASE ' + _NUMBER + ' ' + ' '.join(f'WHEN {b} THEN {t}' for b, (_, t) in PLANTED.items()) + ' ELSE 0 END'} AS tries, count(*) AS rows FROM documents WHERE source IS NOT NULL AND doc_id IS NOT NULL GROUP BY ALL"""
)
def shard_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of each source published as shards, fetched once, and read again after one book's copies were
    changed, another's shards were damaged, a third's deleted, and a fourth's copies lost."""
    path, copies = scratch(spark, "published"), scratch(spark, "copies")
    rows = docs(spark, sf_dir).dropna(subset=["source", "doc_id"]).select(F.substring("source", 4, 9).cast("int").alias("book_id"), "doc_id", "text")
    shards.write(rows, path, F.col("doc_id"))
    shards.read(spark, path, cache=copies, rows="outcomes").write.format("noop").mode("overwrite").save()
    store, cache = shards.Store(path), shards.Store(copies)
    for r in shards.index(spark, path).where(F.col("key").isin([str(b) for b in PLANTED])).collect():  # the shards of four books
        copy, shard = f"{r['key']}-{r['part']}.shard", f"data/{r['file']}"
        if r["key"] == "1":
            cache.put(copy, b"stale")
        else:
            cache.delete(copy)
        if r["key"] == "2":
            store.put(shard, store.read(shard)[:-1] + b"!")
        if r["key"] == "3":
            store.delete(shard)
    found = cut(shards.read(spark, path, cache=copies, rows="outcomes"))
    for place in (path, copies):
        remove_path(spark, place)
    return found.select(F.col("key").cast("int").alias("book_id"), F.col("part").cast("long").alias("part"), "outcome", "tries", "rows")


_TOXIC = "doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)"
_FINAL = f"(SELECT doc_id, text || CASE WHEN {_TOXIC} THEN chr(10) || chr(10) || 'Revised.' ELSE '' END AS raw, CASE WHEN {_TOXIC} THEN 2 ELSE 1 END AS built FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL AND NOT (coalesce(lang, '') = 'fr' AND {_TOXIC}))"


@query(
    f"""WITH RECURSIVE {segments.chunks(f"(SELECT doc_id, {canonical_sql('raw')} AS text FROM {_FINAL})", feeds=2)}
    SELECT doc_id AS book_id, max(built) AS built, max(sha256(raw)) AS content, count(*) AS chunks, true AS as_if_built_whole FROM ck JOIN {_FINAL} USING (doc_id) GROUP BY doc_id"""
)
def incremental_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store of all documents, each a book, and a second run in which the toxic ones have changed, but the French
    of these are taken away; held against a store of the same books built at once."""
    place = scratch(spark, "incremental")
    first = docs(spark, sf_dir).dropna(subset=["doc_id", "text"]).select(F.col("doc_id").alias("book_id"), "text", F.lit(1).cast("long").alias("at"), "lang")
    first.drop("lang").write.parquet(f"{place}/incoming/1")
    incremental.run(spark, f"{place}/incoming/*", f"{place}/store")
    toxic = first.join(table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("book_id")).distinct(), "book_id", "left_semi")
    revised = F.when(F.coalesce(F.col("lang") == "fr", F.lit(False)), F.lit(None).cast("string")).otherwise(F.concat("text", F.lit("\n\nRevised.")))
    toxic.select("book_id", revised.alias("text"), F.lit(2).cast("long").alias("at")).write.parquet(f"{place}/incoming/2")
    incremental.run(spark, f"{place}/incoming/*", f"{place}/store")
    built = cut(incremental.manifest(spark, f"{place}/store"))
    remove_path(spark, f"{place}/store")  # the two stores needn't lie there at once
    incremental.apply(spark.read.parquet(f"{place}/incoming/1", f"{place}/incoming/2"), f"{place}/whole")
    whole = incremental.manifest(spark, f"{place}/whole").select("key", F.col("sha256").alias("whole"))
    joined = built.join(whole, "key", "full")
    found = cut(joined.select(F.col("key").cast("long").alias("book_id"), "built", "content", "chunks", F.coalesce(F.col("sha256") == F.col("whole"), F.lit(False)).alias("as_if_built_whole")))
    remove_path(spark, place)
    return found

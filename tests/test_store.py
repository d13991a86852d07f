"""The store of shards, and builds that go on from it."""

import io

import pyarrow as pa
import pyarrow.parquet
import pytest
from pyspark.sql import functions as F

from folioforge.operators import incremental
from folioforge.session import scratch
from folioforge.sources import shards


def chunks(spark, n=40, books=5):
    return spark.range(n).select((F.col("id") % books).alias("book_id"), F.floor(F.col("id") / books).alias("chunk_ord"), F.concat(F.lit("text "), "id").alias("text"))


def rows_of(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


def test_rows_come_back(spark):
    path, rows = scratch(spark, "store"), chunks(spark).unionByName(spark.createDataFrame([(None, 0, "no book"), (7, 0, None)], "book_id long, chunk_ord long, text string"))
    shards.write(rows, path, F.col("chunk_ord"))
    assert rows_of(shards.read(spark, path)) == rows_of(rows)
    assert shards.read(spark, path).schema.fieldNames() == ["book_id", "chunk_ord", "text"]
    shards.write(rows.limit(0), path, F.col("chunk_ord"))
    assert shards.read(spark, path).count() == 0 and shards.Store(path).current() == 2


def test_a_large_book_is_several_shards(spark):
    path = scratch(spark, "store")
    spark.dataSource.register(shards.ShardSource)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so little data would be put together
    try:
        shards.laid_out(chunks(spark, 1000, 1), F.col("chunk_ord"), part_rows=100).write.format(shards.NAME).options(path=path, part="shard_part").mode("append").save()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    index = shards.index(spark, path).orderBy("part").collect()
    assert [(r["key"], r["part"], r["rows"]) for r in index] == [("0", k, 100) for k in range(10)]
    assert len({r["file"].split("/")[1] for r in index}) > 1  # written by more than one task


def test_append_and_older_versions(spark):
    path = scratch(spark, "store")
    shards.write(chunks(spark), path, F.col("chunk_ord"))
    more = chunks(spark).withColumn("book_id", F.col("book_id") + 100)
    shards.write(more, path, F.col("chunk_ord"), mode="append")
    assert shards.read(spark, path).count() == 80 and shards.read(spark, path, version="1").count() == 40
    shards.write(more, path, F.col("chunk_ord"))
    store = shards.Store(path)
    assert rows_of(shards.read(spark, path)) == rows_of(more) and shards.read(spark, path, version="2").count() == 80
    store.vacuum(keep=1)
    assert rows_of(shards.read(spark, path)) == rows_of(more) and len(store.names("data")) == 1 and store.names("manifests") == ["3.json"]


def test_a_failed_write_leaves_nothing(spark):
    path = scratch(spark, "store")
    shards.write(chunks(spark), path, F.col("chunk_ord"))
    bad = chunks(spark).withColumn("text", F.when(F.col("book_id") == 3, F.raise_error(F.lit("no"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="no"):
        shards.write(bad, path, F.col("chunk_ord"))
    assert shards.Store(path).current() == 1 and len(shards.Store(path).names("data")) == 1
    assert rows_of(shards.read(spark, path)) == rows_of(chunks(spark))


def test_what_failed_attempts_left_goes_with_the_commit(spark):
    path = scratch(spark, "store")
    store = shards.Store(path)
    store.put("data/run7/late/0.shard", b"half")
    shards.write(chunks(spark), path, F.col("chunk_ord"), run="run7")
    assert "late" not in store.names("data/run7") and shards.read(spark, path).count() == 40


def test_outcomes(spark):
    path, copies = scratch(spark, "store"), scratch(spark, "copies")
    shards.write(chunks(spark), path, F.col("chunk_ord"))
    outcomes = lambda: {r["key"]: (r["outcome"], r["tries"]) for r in shards.read(spark, path, cache=copies, rows="outcomes").collect()}
    assert set(outcomes().values()) == {("fetched", 1)} and set(outcomes().values()) == {("cached", 0)}
    store, cache, file = shards.Store(path), shards.Store(copies), {r["key"]: f"data/{r['file']}" for r in shards.index(spark, path).collect()}
    cache.put("0-0.shard", b"stale")
    cache.put("1-0.shard", b"stale too")
    store.put(file["1"], b"broken")
    cache.delete("2-0.shard")
    store.delete(file["2"])
    store.delete(file["3"])  # a good copy is enough
    assert outcomes() == {"0": ("refreshed", 1), "1": ("broken", 2), "2": ("missing", 1), "3": ("cached", 0), "4": ("cached", 0)}
    assert outcomes()["0"] == ("cached", 0) and "1-0.shard" not in cache.names("")
    with pytest.raises(Exception, match="shard"):
        shards.read(spark, path, cache=copies).collect()
    assert shards.read(spark, path, cache=copies, failures="skip").select("book_id").distinct().count() == 3


def test_other_versions_are_refused(spark):
    path = scratch(spark, "store")
    shards.write(chunks(spark), path, F.col("chunk_ord"))
    store = shards.Store(path)
    sink = io.BytesIO()
    pyarrow.parquet.write_table(pa.table({"book_id": [0]}).replace_schema_metadata({"format_version": "9"}), sink)
    import hashlib

    row = {"key": "0", "part": 0, "file": "x", "sha256": hashlib.sha256(sink.getvalue()).hexdigest().upper()}
    store.put("data/x", sink.getvalue())
    assert shards.fetched(store, None, row) == (None, "version", 1)
    store.put("manifests/1.json", b'{"format": 9}')
    with pytest.raises(Exception, match="unsupported format version"):
        shards.read(spark, path).collect()


def test_filters_on_the_key_choose_shards(spark):
    path = scratch(spark, "store")
    shards.write(chunks(spark), path, F.col("chunk_ord"))
    for r in shards.index(spark, path).collect():
        if r["key"] not in "13":
            shards.Store(path).delete(f"data/{r['file']}")  # reading one of these fails
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        assert shards.read(spark, path).where("book_id = 3").count() == 8 and shards.read(spark, path).where("book_id in (1, 3)").count() == 16
        with pytest.raises(Exception, match="missing"):
            shards.read(spark, path).where("book_id > 0").count()
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "false")


BOOK = "book_id long, text string, at long"


def plain(books):
    return books.select("book_id", F.posexplode(F.split("text", "\n")).alias("chunk_ord", "text")).withColumn("chunk_ord", F.col("chunk_ord").cast("long"))


def test_a_second_run_builds_what_changed(spark):
    place = scratch(spark, "incremental")
    books = [(i, f"first {i}\nsecond\nthird", 1) for i in range(300)]
    spark.createDataFrame(books, BOOK).write.parquet(f"{place}/in/1")
    assert incremental.run(spark, f"{place}/in/*", f"{place}/store", chunked=plain) == 1
    changed = [(5, "other", 2), (5, "the last word\nholds", 3), (7, books[7][1], 2), (11, None, 2), (999, "new", 2), (1000, None, 2)]
    spark.createDataFrame(changed, BOOK).write.parquet(f"{place}/in/2")
    assert incremental.run(spark, f"{place}/in/*", f"{place}/store", chunked=plain) == 2
    got = {r["key"]: r for r in incremental.manifest(spark, f"{place}/store").collect()}
    assert {k for k, r in got.items() if r["built"] == 2} == {"5", "999"} and "11" not in got and "1000" not in got and len(got) == 300
    incremental.apply(spark.createDataFrame(books + changed, BOOK), f"{place}/whole", plain)
    whole = {r["key"]: r for r in incremental.manifest(spark, f"{place}/whole").collect()}
    assert {k: (r["sha256"], r["content"], r["chunks"]) for k, r in got.items()} == {k: (r["sha256"], r["content"], r["chunks"]) for k, r in whole.items()}
    assert len(incremental.manifest(spark, f"{place}/store", 1).collect()) == 300 and shards.read(spark, f"{place}/store", version="1").where("book_id = 11").count() == 3
    assert incremental.run(spark, f"{place}/in/*", f"{place}/store", chunked=plain) == 2  # nothing new
    shards.Store(f"{place}/store").vacuum()
    assert shards.read(spark, f"{place}/store").count() == sum(r["chunks"] for r in got.values())


def test_a_batch_that_comes_twice_is_applied_once(spark):
    path = scratch(spark, "incremental")
    first, second = (spark.createDataFrame([(1, f"text {k}", k)], BOOK) for k in (1, 2))
    assert [incremental.apply(x, path, plain, batch) for x, batch in ((first, 0), (second, 1), (first, 0), (second, 1))] == [1, 2, 2, 2]
    assert incremental.apply(second, path, plain) == 2  # as it is there


def test_books_without_chunks_and_an_empty_batch(spark):
    path = scratch(spark, "incremental")
    assert incremental.apply(spark.createDataFrame([], BOOK), path) == 0
    assert incremental.apply(spark.createDataFrame([(1, " \n ", 1), (2, "A text.", 1)], BOOK), path) == 1
    assert [r["key"] for r in incremental.manifest(spark, path).collect()] == ["2"]


def test_packed_shards(spark):
    path, copies = scratch(spark, "store"), scratch(spark, "copies")
    rows = chunks(spark, 400, 100).withColumn("when", F.timestamp_seconds("chunk_ord")).withColumn("v", F.array(F.col("chunk_ord").cast("float")))
    shards.write(rows, path, F.col("chunk_ord"), pack="true")
    assert rows_of(shards.read(spark, path)) == rows_of(rows)
    store, index = shards.Store(path), shards.index(spark, path).orderBy("file", "place").collect()
    assert len(index) == 100 and len({r["file"] for r in index}) <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    bad, good = index[0], index[1]
    data = bytearray(store.read(f"data/{bad['file']}"))
    assert bad["place"] == 0 and good["place"] == bad["bytes"]
    data[5] ^= 1
    store.put(f"data/{bad['file']}", bytes(data))
    found = {r["key"]: (r["outcome"], r["tries"]) for r in shards.read(spark, path, cache=copies, rows="outcomes").collect()}
    assert found.pop(bad["key"]) == ("broken", 2) and set(found.values()) == {("fetched", 1)}
    store.delete(f"data/{bad['file']}")
    there = {r["key"] for r in index if r["file"] != bad["file"]}
    assert {str(r["book_id"]) for r in shards.read(spark, path, failures="skip").select("book_id").distinct().collect()} == there


def test_many_short_books_take_few_files_and_little_disk(spark):
    path = scratch(spark, "incremental")
    books = spark.range(500).select(F.col("id").alias("book_id"), F.concat(F.lit("A short text, number "), "id").alias("text"), F.lit(1).cast("long").alias("at"))
    assert incremental.apply(books, path) == 1
    index = shards.index(spark, path).collect()
    assert len(index) == 500 and len({r["file"] for r in index}) <= spark.sparkContext.defaultParallelism * 2
    assert sum(r["bytes"] for r in index) < 500 * 3000
    assert shards.read(spark, path).count() == 500

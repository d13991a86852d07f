"""A file a book: what reads many of them takes few tasks."""

import os

from pyspark.sql import functions as F

from folioforge import session
from folioforge.session import remove_path, scratch
from folioforge.sources import readers, shards, writers


def test_many_files_in_few_tasks(spark):
    path, key = scratch(spark, "rdf"), "spark.sql.files.maxPartitionBytes"
    writers.write_files(spark.range(200).select(F.format_string("pg%d.rdf", "id").alias("name"), F.lit("<a/>").alias("content")), path)
    before = spark.conf.get(key)
    spark.conf.set(key, "4m")  # as much as Spark reckons for opening a file
    try:
        found = readers.read_rdf(spark, path)
        assert found.rdd.getNumPartitions() <= max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
        assert sorted(r["book_id"] for r in found.collect()) == list(range(200))
    finally:
        spark.conf.set(key, before)
        remove_path(spark, path)


def test_an_index_file_is_read_a_few_times(spark, tmp_path):
    store = shards.Store(f"file://{tmp_path}")
    store.publish({"indexes": [["run/a/index", 5000], ["run/b/index", 0]], "schema": {}, "key": "book_id"})
    parts = [p.value for p in shards.ShardReader({"path": f"file://{tmp_path}"}, None).partitions()]
    assert [(a, b) for _, a, b in parts] == [(k, min(5000, k + 1024)) for k in range(0, 5000, 1024)]


def test_remove_path(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "b" / "x").write_text("1")
    (tmp_path / "y").write_text("1")
    for name in ("a", "y", "missing"):
        remove_path(spark, f"file://{tmp_path}/{name}")
    remove_path(spark, f"file:{tmp_path}/z")
    assert list(tmp_path.iterdir()) == []


def test_many_files_are_deleted_by_tasks(spark, tmp_path, monkeypatch):
    for k in range(40):
        (tmp_path / "books" / f"{k % 3}").mkdir(parents=True, exist_ok=True)
        (tmp_path / "books" / f"{k % 3}" / f"{k}.shard").write_text("x")
    left, of = [], session.shutil.rmtree
    monkeypatch.setattr(session, "MANY", 10, raising=False)
    monkeypatch.setattr(session.shutil, "rmtree", lambda path, **how: left.append(sum(len(names) for _, _, names in os.walk(path))) or of(path, **how))
    remove_path(spark, f"file://{tmp_path}/books")
    assert left == [0] and list(tmp_path.iterdir()) == []


def test_only_the_books_asked_for_are_opened(spark):
    path = scratch(spark, "epub")
    books = spark.range(60).select(F.format_string("pg%d.epub", "id").alias("name"), writers.epub(F.array(F.concat(F.lit("<p>"), F.col("id").cast("string"), F.lit("</p>")), F.lit("<p/>"))).alias("content"))
    writers.write_files(books.unionByName(spark.createDataFrame([("pg60.epub", b"damaged"), ("other.epub", b"damaged")], "name string, content binary")), path)
    every = {(r["book_id"], r["item"]): (r["html"], r["ok"]) for r in readers.read_epub(spark, path).collect()}
    assert len(every) == 122 and every[(59, 0)] == ("<p>59</p>", True) and every[(60, 0)] == every[(None, 0)] == (None, False)
    asked = spark.createDataFrame([(7,), (60,), (99,)], "book_id int")
    some = {(r["book_id"], r["item"]): (r["html"], r["ok"]) for r in readers.read_epub(spark, path, books=asked).collect()}
    assert some == {k: every[k] for k in [(7, 0), (7, 1), (60, 0)]}
    remove_path(spark, path)


def test_files_in_folders_are_listed_by_tasks(spark, monkeypatch):
    path, scan = scratch(spark, "rdf"), spark.read
    files = spark.range(300).select(F.format_string("pg%d.rdf", "id").alias("name"), F.lit("<a/>").alias("content"))
    writers.write_files(files.unionByName(spark.createDataFrame([("pg 300 ä%.rdf", "<a/>"), ("_no.rdf", "<"), (".no.rdf", "<")], "name string, content string")), path, 16)
    place = path.removeprefix("file://")
    assert len(os.listdir(place)) == 16 and not any(e.is_file() for e in os.scandir(place))
    listed = []
    of = type(scan).load
    monkeypatch.setattr(type(scan), "load", lambda self, *a, **k: listed.append(a) or of(self, *a, **k))
    monkeypatch.setattr(type(scan), "text", lambda self, *a, **k: listed.append(a))
    found = readers.read_rdf(spark, path).collect()
    assert len(found) == 301 and {r["book_id"] for r in found} >= set(range(300)) and all(r["translators"] == [] for r in found)
    assert readers.files_under(spark, f"{path}/").count() == 301 and not listed  # the driver lists none
    assert readers.files_under(spark, f"{path}/*/pg1*.rdf").count() == 111 and listed
    remove_path(spark, path)

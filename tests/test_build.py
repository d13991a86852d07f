import json

import pytest
from pyspark.sql import functions as F

from folioforge.functions.sentences import snap, snap_near
from folioforge.operators import build, grounding, harvest, judge, publish
from folioforge.plans import build as plans
from folioforge.sources import readers, writers


def test_a_fetched_manifest_takes_the_old_ones_place(tmp_path):
    source, target = f"file://{tmp_path}/source.json", f"file://{tmp_path}/target.json"
    writers.publish_file(json.dumps({"version": 1}).encode(), source)
    assert writers.fetch_manifest(source, target) == ({"version": 1}, True)
    (tmp_path / "source.json").write_text('{"version": 2}')
    with pytest.raises(ValueError, match="differs"):
        writers.fetch_manifest(source, target)
    (tmp_path / "source.json").unlink()
    assert writers.fetch_manifest(source, target) == ({"version": 1}, False)
    assert not list(tmp_path.glob("*.partial"))


def test_a_stale_copy_is_fetched_again(tmp_path):
    source, cached = f"file://{tmp_path}/shard", f"file://{tmp_path}/copy"
    digest = writers.publish_file(b"right", source)
    assert writers.read_checked(cached, source, digest.upper()) == b"right" == (tmp_path / "copy").read_bytes()
    (tmp_path / "copy").write_bytes(b"stale")
    assert writers.read_checked(cached, source, digest) == b"right" == (tmp_path / "copy").read_bytes()
    (tmp_path / "shard").write_bytes(b"gone")
    assert writers.read_checked(cached, source, digest) == b"right"
    (tmp_path / "copy").unlink()
    with pytest.raises(ValueError, match="differs"):
        writers.read_checked(cached, source, digest)


SF = "/root/testdata/sf0.001"


def test_a_build_goes_on_from_its_last_step(spark, tmp_path):
    out = f"file://{tmp_path}"
    inputs = plans._inputs(spark, SF, out)
    with pytest.raises(ValueError, match="is the least"):
        build.build(spark, inputs, out, least_kept=1000)
    first = build.build(spark, inputs, out, least_kept=1).collect()
    assert first and build.verified(spark, out).count() == 0
    inputs.skip = {build.PREPARE, build.SHARDS}
    inputs.epub = inputs.rdf = inputs.catalogue = "file:///nowhere"
    assert sorted(build.build(spark, inputs, out, least_kept=1).collect()) == sorted(first)
    book = first[0].book_id
    view = build.book_view(spark, out, book).first()
    assert view.title.startswith("Title ") and len(view.chunks) == first[0].chunks
    data = view.canonical_text.encode()
    texts = [r.text for r in publish.read_shards(spark, f"{out}/shards").where(F.col("book_id") == book).orderBy("chunk_id").collect()]
    assert [data[c.byte_start : c.byte_end].decode() for c in view.chunks] == texts
    chunks = spark.read.parquet(f"{out}/chunks").withColumn("text", F.when(F.col("book_id") == book, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    publish.write_shards(chunks, f"{out}/shards")
    assert [tuple(r) for r in build.verified(spark, out).collect()] == [(book, "differs")]


def test_damaged_books_and_lexicon_files_are_told(spark, tmp_path):
    (tmp_path / "pg7.epub").write_bytes(b"no archive")
    (tmp_path / "pg8.epub").write_bytes(writers._packed(["<p/>"]))
    got = readers.read_epub(spark, f"{tmp_path}/*.epub").collect()
    assert sorted((r.book_id, r.item, r.ok) for r in got) == [(7, 0, False), (8, 0, True)]
    (tmp_path / "bad.yaml").write_text("source: {a\n  - b")
    assert readers.read_lexicon(spark, str(tmp_path)).count() == 0
    assert [r.file for r in readers.refused_lexicon_files(spark, str(tmp_path)).collect()] == ["bad.yaml"]
    with pytest.raises(Exception, match="bad.yaml"):
        readers.read_lexicon(spark, str(tmp_path), strict=True).count()


def test_null_fields_of_records_stay(spark, tmp_path):
    rows = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    readers.write_jsonl(rows, f"{tmp_path}/r")
    lines = [x for f in (tmp_path / "r").glob("*.json") for x in f.read_text().splitlines()]
    assert sorted(lines) == ['{"a":1,"b":null}', '{"a":2,"b":"x"}']


def test_packed_vectors_come_back(spark, tmp_path):
    rows = spark.createDataFrame([(b, i, [float(i), 0.5, -2.0]) for b in (1, 2) for i in (10, 2, 7)], "book_id int, chunk_ord long, embedding array<float>")
    said = readers.write_packed_vectors(rows, f"file://{tmp_path}").collect()
    assert sorted((r.book_id, r.vectors, r.bytes) for r in said) == [("1", 3, 18), ("2", 3, 18)]
    got = readers.read_packed_vectors(spark, f"{tmp_path}/2.f16", 3).orderBy("chunk_ord").collect()
    assert [r.embedding for r in got] == [[2.0, 0.5, -2.0], [7.0, 0.5, -2.0], [10.0, 0.5, -2.0]]


TEXT = "One two. Three 𝄞 four! Five six?  "


@pytest.mark.parametrize(
    "start, end, span",
    [(0, 0, (0, 9)), (0, 9, (0, 9)), (3, 10, (0, 24)), (17, 17, (9, 24)), (16, 18, (9, 24)), (9, 24, (9, 24)), (30, 99, (24, 35)), (99, 99, (24, 35)), (-5, 1, (0, 9)), (12, 2, (9, 24))],
)
def test_selections_snap_to_near_segments(start, end, span):
    assert snap_near(TEXT, start, end) == span


def test_an_empty_text_and_bytes(spark):
    assert snap_near("", 3, 5) == (0, 0)
    assert snap(TEXT, 3, 3) is None  # the other snap takes bytes and no empty selection


def test_harvest_gates_and_clusters(spark):
    chunks = spark.createDataFrame([(1, "c1", "Virtue is knowledge. Men err."), (2, "c2", "Virtue is knowledge.")], "book_id int, chunk_id string, text string")
    identify = lambda text: F.lit('{"terms": ["Virtue", "", "error"]}')
    gloss = lambda text, term: F.when(term == "Virtue", '{"substrate": "arete", "gloss": "virtue is knowledge"}').otherwise('{"substrate": "x", "gloss": "something else entirely"}')
    clusters, cited = harvest.harvested(chunks, identify, gloss, judge.overlap, spark.createDataFrame([("virtue",)], "term string"))
    assert [(r.key, r.substrate, r["size"], r.support_mean, r.seed_match) for r in clusters.collect()] == [("virtue", "arete", 2, 1.0, True)]
    assert sorted((r.book_id, r.chunk_id) for r in cited.collect()) == [(1, "c1"), (2, "c2")]


def test_the_whole_lexicon_guards_the_glossary(spark):
    terms = spark.createDataFrame([("e1", 0, "power", "eph", "g"), ("e2", 1, "power", "later", "g"), ("e3", 2, "ability", "eph", "h")], "entry_id string, ord int, english string, substrate string, gloss string")
    passages = spark.createDataFrame([("p", "text", "simple")], "passage_id string, text string, tier string")
    model = lambda prompt: F.concat(F.lit("PARAPHRASE: ok\nGLOSSARY:\n- a (`eph`): one\n- b (`later`): two\n- c: "), F.when(prompt.contains("`later`"), "first entry lost").otherwise("three"))
    got = grounding.grounded_globally(passages, terms, model).first()
    assert (got.paraphrase, [(e.term, e.gloss) for e in got.glossary]) == ("ok", [("power", "one"), ("c", "three")])


def test_the_floor_is_checked_when_decisions_are_written(spark, tmp_path):
    out = f"file://{tmp_path}"
    with pytest.raises(ValueError, match="is the least"):
        build.build(spark, plans._inputs(spark, SF, out), out, least_kept=1000)
    decisions = spark.read.parquet(f"{out}/decisions")
    told = {(r.stage, r.metric): r.value for r in build.counters(spark, out).collect()}
    assert told["filter", "kept"] == decisions.where("decision = 'kept'").count() > 0
    assert sum(v for (stage, _), v in told.items() if stage == "filter") == decisions.count() == told["catalogue", "kept"] == told["translators", "works"]
    assert ("texts", "books") not in told and not (tmp_path / "texts").exists()


def test_a_run_that_leaves_steps_out_keeps_their_counters(spark, tmp_path):
    out = f"file://{tmp_path}"
    inputs = plans._inputs(spark, SF, out)
    build.build(spark, inputs, out, least_kept=1)
    first = sorted(map(tuple, build.counters(spark, out).collect()))
    assert {r[0] for r in first} == {"catalogue", "translators", "filter", "items", "texts", "chunks", "vectors", "shards", "manifest"}
    inputs.skip = {build.PREPARE, build.SHARDS}
    build.build(spark, inputs, out, least_kept=1)
    assert sorted(map(tuple, build.counters(spark, out).collect())) == first

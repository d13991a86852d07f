import io
import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioforge.operators import catalogue, grounding, harvest, judge, publish, themes, xhtml
from folioforge.plans import corpus
from folioforge.sources import readers


def agents(spark, raw):
    found = spark.createDataFrame([(raw,)], "r string").select(catalogue.agents(F.col("r")).alias("a")).first().a
    return [tuple(a)[:4] for a in found]


def test_agents(spark):
    got = agents(spark, "Plato, 428? BCE-348? BCE; Jowett, Benjamin, 1817-1893 [Translator]")
    assert got == [("Plato", -428, -348, "Author"), ("Jowett, Benjamin", 1817, 1893, "Translator")]
    assert agents(spark, "") == agents(spark, None) == agents(spark, " ; ") == []
    assert agents(spark, "X [Compiler]; Y, 1800- [Editor]") == [("X", None, None, "Other"), ("Y", 1800, None, "Editor")]
    assert agents(spark, "Mill, -1879") == [("Mill, -1879", None, None, "Author")]


def test_classes(spark):
    frame = spark.createDataFrame([(c,) for c in ("B", "BJ", "BD", "BL", "BS", "PR")], "c string")
    assert [r[0] for r in frame.where(catalogue.is_kept_class(F.array("c"))).collect()] == ["B", "BJ", "BD"]


def test_rdf(spark):
    xml = corpus.RDF.format(1893)
    got = spark.createDataFrame([(xml,), ("<r/>",), ("<broken",), (None,)], "x string").select(catalogue.rdf_translators("x").alias("a")).collect()
    assert [tuple(a) for a in got[0].a] == [("Cross, D.", None, 1893, "Translator", "Rdf")]
    assert got[1].a == [] and got[2].a is None and got[3].a is None


def test_rights(spark):
    person = lambda role, death: {"name": "x", "birth_year": None, "death_year": death, "role": role, "source": "s"}
    found = spark.createDataFrame([(i, "t", ["B"], raw) for i, raw in ((1, "A, 1900-1975"), (2, "A, 1900-1976"), (3, "A"), (4, ""), (5, ""), (6, ""))], "book_id int, title string, locc array<string>, authors_raw string")
    rows = [(1, [], True), (2, [], True), (3, [], True), (4, [person("Translator", 1900), person("Translator", None)], False), (5, [person("Translator", 1990), person("Translator", 1900)], False), (6, [person("Translator", None)], False), (7, [], True)]
    frame = spark.createDataFrame(rows, "book_id int, translators array<struct<name:string,birth_year:int,death_year:int,role:string,source:string>>, is_original_language boolean")
    got = {r.book_id: r.decision for r in catalogue.decisions(frame, found).collect()}
    assert got == {1: "kept", 2: "too-recent", 3: "no-data", 4: "kept", 5: "too-recent", 6: "no-data", 7: "missing-candidate"}
    with pytest.raises(ValueError, match="2 works"):
        catalogue.enough_kept(catalogue.decisions(frame, found))


def test_catalogue_csv(spark, tmp_path):
    (tmp_path / "c.csv").write_text('Text#,Type,Issued,Title,Language,Authors,Subjects,LoCC,Bookshelves\n1,Text,x,"A ""b""\nc",en,"Plato, 1-2",s,B,\n')
    got = readers.read_catalogue(spark, str(tmp_path / "c.csv")).first()
    assert (got.book_id, got.title, got.locc) == (1, 'A "b"\nc', "B")
    (tmp_path / "d.csv").write_text("Text#,Type\n1,Text\n")
    with pytest.raises(ValueError, match="lacks Title"):
        readers.read_catalogue(spark, str(tmp_path / "d.csv"))


XHTML = "<!DOCTYPE html><html xmlns='http://www.w3.org/1999/xhtml'><body><p>One&nbsp;two</p><P>  </P><div><p>Some <em>emphasis</em>. End</p></div><p>x &amp; y</p></body></html>"


def test_paragraphs(spark):
    frame = spark.createDataFrame([(XHTML,), ("<p>open<br>",), (None,)], "h string")
    strict = [r.r for r in frame.select(xhtml.paragraphs(F.col("h")).alias("r")).collect()]
    assert strict[0].paragraphs == ["One two", "Some emphasis . End", "x & y"] and strict[0].ok
    assert [(r.paragraphs, r.ok) for r in strict[1:]] == [([], False)] * 2
    loose = [r.r.paragraphs for r in frame.select(xhtml.paragraphs(F.col("h"), strict=False).alias("r")).collect()]
    assert loose[1] == ["open"] and loose[0][-1] == "x & y"


def test_boilerplate(spark):
    lines = ["*** END OF THE PROJECT GUTENBERG EBOOK X", " contributor : A", "This eBook was prepared by B", "The Project Gutenberg License", "plain", "", "He is a contributor: yes", "Title : X"]
    got = spark.createDataFrame([(x,) for x in lines], "t string").select(xhtml.is_boilerplate(F.col("t")).alias("b"), xhtml.is_metadata_line(F.col("t")).alias("m")).collect()
    assert [r.b for r in got] == [True, True, True, True, False, False, False, False]
    assert [r.m for r in got] == [True, False, False, True, False, False, False, True]
    rows = spark.createDataFrame([(1, True), (1, False), (2, True), (2, True), (2, False)], "item int, hit boolean")
    assert {r.item for r in xhtml.without_boilerplate_items(rows, "item", F.col("hit")).collect()} == {1}


def test_epub(spark, tmp_path):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("META-INF/container.xml", "<c xmlns='u'><rootfile full-path='O/p.opf'/></c>")
        z.writestr("O/p.opf", "<p xmlns='u'><manifest><item id='a' href='a.xhtml'/><item id='b' href='b%20c.xhtml'/><item id='x' href='gone.xhtml'/></manifest><spine><itemref idref='b'/><itemref idref='x'/><itemref idref='a'/></spine></p>")
        z.writestr("O/a.xhtml", "<p>A</p>")
        z.writestr("O/b c.xhtml", "<p>B</p>")
    (tmp_path / "pg12.epub").write_bytes(data.getvalue())
    items = readers.read_epub(spark, str(tmp_path))
    assert [(r.book_id, r.item, r.html, r.ok) for r in items.orderBy("item").collect()] == [(12, 0, "<p>B</p>", True), (12, 1, None, False), (12, 2, "<p>A</p>", True)]
    assert readers.parse_warnings(items).first().parse_warnings == 1


def test_rdf_files(spark, tmp_path):
    (tmp_path / "pg7.rdf").write_text(corpus.RDF.format(1900))
    (tmp_path / "pg8.rdf").write_text("<broken")
    got = readers.read_rdf(spark, str(tmp_path)).orderBy("book_id").collect()
    assert [(r.book_id, r.translators and r.translators[0].death_year) for r in got] == [(7, 1900), (8, None)]
    (tmp_path / "w.txt").write_text("a\nb\n")
    assert readers.read_whole(spark, str(tmp_path / "w.txt")).first().text == "a\nb\n"


def test_jsonl_and_vectors(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"book_id": 1, "themes": ["a"]}\n\n{"book_id": 2}\n')
    got = readers.read_jsonl(spark, str(tmp_path / "r.jsonl"), "book_id int, themes array<string>").orderBy("book_id").collect()
    assert [(r.book_id, r.themes) for r in got] == [(1, ["a"]), (2, None)]
    (tmp_path / "bad.jsonl").write_text("{broken\n")
    with pytest.raises(Exception):  # noqa: B017
        readers.read_jsonl(spark, str(tmp_path / "bad.jsonl"), "book_id int").collect()
    (tmp_path / "v").mkdir()
    (tmp_path / "v/1.bin").write_bytes(np.arange(6, dtype="<f2").tobytes())
    (tmp_path / "v/2.bin").write_bytes(b"")
    vectors = readers.read_packed_vectors(spark, str(tmp_path / "v"), 3).orderBy("chunk_ord").collect()
    assert [(r.chunk_ord, r.embedding) for r in vectors] == [(0, [0, 1, 2]), (1, [3, 4, 5])]


LEXICON = """
# a comment
source:
  title: "Handbook"
  author: "Epictetus"
  tradition: "Stoic"
  language: Greek

passages:
  - id: "e-1"
    fingerprint: "Of things some: are"
    themes: ["a", "b, c"]
    terms:
      "in our power":
        substrate: "eph' hēmin"
        gloss: "up to us"
      plain:
        substrate: 'x'
        gloss: "y"
        citation: "z"
  - id: e-2
    fingerprint: "Second"
    themes: []
    text: |
      Some lines: with
      more of them.
    terms:
      t: 
        substrate: s
        gloss: g
"""


def test_lexicon_files(spark, tmp_path):
    (tmp_path / "a.yaml").write_text(LEXICON)
    (tmp_path / "b.yml").write_text("source: [\n  nonsense")
    (tmp_path / "c.txt").write_text(LEXICON)
    got = readers.read_lexicon(spark, str(tmp_path)).orderBy("entry_ord").collect()
    assert [(r.file, r.entry_id, r.fingerprint, r.themes, r.author) for r in got] == [("a.yaml", "e-1", "Of things some: are", ["a", "b, c"], "Epictetus"), ("a.yaml", "e-2", "Second", [], "Epictetus")]
    assert [tuple(t) for t in got[0].terms] == [("in our power", "eph' hēmin", "up to us", None), ("plain", "x", "y", "z")]


def test_themes_and_queries_files(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({"version": 1, "themes": [{"slug": "a", "label": "A", "order": 1}], "assignments": [{"book_id": 1, "themes": ["a"]}], "dropped": [{"book_id": 2, "reason": "biography"}]}))
    t, a, d = readers.read_themes(spark, str(tmp_path / "t.json"))
    assert (t.first().ord, a.first().themes, d.first().reason) == (1, ["a"], "biography")
    (tmp_path / "q.json").write_text(json.dumps({"version": 1, "phrase": [{"query": "x", "expected_ids": [5]}], "topical": [{"query": "y"}], "adversarial": [{"query": ""}]}))
    got = readers.read_eval_queries(spark, str(tmp_path / "q.json")).orderBy("query_id").collect()
    assert [(r.kind, r.query, r.expected_ids) for r in got] == [("phrase", "x", [5]), ("topical", "y", []), ("adversarial", "", [])]
    assert readers.phrases(spark).count() == 5


def test_shards_and_manifest(spark, tmp_path):
    chunks = spark.createDataFrame([(1, "c0", "a"), (1, "c1", "b"), (2, "c0", "c")], "book_id int, chunk_id string, text string")
    publish.write_shards(chunks, str(tmp_path / "s"))
    assert sorted(map(tuple, publish.read_shards(spark, str(tmp_path / "s")).select("book_id", "chunk_id", "text").collect())) == [(1, "c0", "a"), (1, "c1", "b"), (2, "c0", "c")]
    for version in (1, 99, None):
        with pytest.raises(Exception, match="unsupported format version"):
            publish.version_gate(chunks.withColumn("format_version", F.lit(version).cast("int"))).collect()
    publish.write_manifest(chunks, str(tmp_path / "m"), "b1", "e", "2024-01-01T00:00:00Z")
    header, books = publish.read_manifest(spark, str(tmp_path / "m"))
    assert (header.first().books, header.first().build_id, books.count()) == (3, "b1", 3)
    with pytest.raises(Exception, match="no filtered row for book 2"):
        publish.filtered_only(chunks, spark.createDataFrame([(1, "t")], "book_id int, title string")).collect()
    vectors = spark.createDataFrame([(1, 0, [1.0])], "book_id int, chunk_ord int, embedding array<float>")
    with pytest.raises(Exception, match="differ in book 1"):
        publish.with_embeddings(spark.createDataFrame([(1, 0), (1, 1)], "book_id int, chunk_ord int"), vectors).collect()
    assert [r.chunk_id for r in publish.head(chunks, 2, "book_id", "chunk_id").collect()] == ["c0", "c1"]
    assert [r.n for r in spark.createDataFrame([(2,), (10,)], "n int").orderBy(publish.name_order("n")).collect()] == [10, 2]
    same = publish.slice_matches(spark.createDataFrame([(1, "é", 1, 3), (1, "x", 0, 1)], "book_id int, text string, byte_start int, byte_end int"), spark.createDataFrame([(1, "aé")], "book_id int, canonical_text string"))
    assert [r.same for r in same.orderBy("byte_start").collect()] == [False, True]


def test_theme_checks(spark):
    schema = "book_id int, themes array<string>, keep boolean, drop_reason string"
    good = themes.checked(spark.createDataFrame([(2, ["other"], None, None), (1, ["reality", "other"], True, None), (3, [], False, "biography")], schema))
    assert [r.book_id for r in themes.assignments(good).collect()] == [1, 2]
    assert tuple(themes.totals(good).first()) == (2, 2, 1)
    counts = {r.slug: r.books for r in themes.counts(themes.assignments(good), themes.taxonomy(spark)).collect()}
    assert counts["other"] == 2 and counts["meaning"] == 0 and len(counts) == 10
    assert [r.slug for r in themes.shown(themes.counts(themes.assignments(good), themes.taxonomy(spark))).collect()] == ["reality", "other"]
    assert themes.taxonomy(spark).where("slug = 'other'").first().ord == 99
    for bad, said in ((["nonsense"], "unknown theme"), ([], "unlisted reason")):
        with pytest.raises(Exception, match=said):
            themes.checked(spark.createDataFrame([(1, bad, bool(bad), None)], schema)).collect()


def test_clusters(spark):
    obs = [("In our power", "eph", "first", 5, "c1", 0.9), ("in our power", "eph", "second", 3, "c2", 0.89), ("Function", "ergon", "g", 7, "c9", 0.7)]
    frame = spark.createDataFrame(obs, "canonical string, substrate string, gloss string, book_id int, chunk_id string, support double")
    got = harvest.ordered(harvest.cluster(frame, spark.createDataFrame([("IN OUR POWER",)], "term string"))).collect()
    assert [(r.canonical, r.gloss, r["size"], r.support_mean, r.seed_match) for r in got] == [("In our power", "first", 2, 0.895, True), ("Function", "g", 1, 0.7, False)]
    cited = harvest.citations(frame).orderBy(F.desc("support")).collect()
    assert [(r.key, r.substrate, r.chunk_id) for r in cited] == [("in our power", "eph", "c1"), ("in our power", "eph", "c2"), ("function", "ergon", "c9")]


def test_routes(spark):
    schema = "passage_id int, mode string, entry_id string, terms_json string"
    rows = [(0, "auto", "e", None), (1, "auto", None, '{"terms": ["a"]}'), (2, "auto", None, '{"terms": []}'), (3, "jit", "e", '{"terms": ["a"]}'), (4, "no-substrate", "e", '{"terms": ["a"]}'), (5, "jit", None, "broken")]
    got = {r.passage_id: r.resolution for r in grounding.routed(spark.createDataFrame(rows, schema)).collect()}
    assert got == {0: "curated", 1: "jit", 2: "no-substrate", 3: "jit", 4: "no-substrate", 5: "no-substrate"}
    with pytest.raises(Exception, match="no curated substrate"):
        grounding.routed(spark.createDataFrame([(0, "curated", None, None)], schema)).collect()


def test_curated_answers_are_guarded(spark):
    passages = spark.createDataFrame([(0, "text", "A", "simple", "e", [], "curated"), (1, "text", None, "scholarly", None, ["x"], "jit")], "passage_id int, text string, author string, tier string, entry_id string, terms array<string>, resolution string")
    terms = spark.createDataFrame([("e", "function", "ergon", "g")], "entry_id string, english string, substrate string, gloss string")
    model = lambda p: F.concat(F.lit("PARAPHRASE: ok\nGLOSSARY:\n- a (`ergon`): one\n- b (`invented`): two\nlen "), F.length(p))
    got = {r.passage_id: [tuple(e) for e in r.glossary] for r in grounding.grounded(passages, terms, model).collect()}
    assert got == {0: [("function", "one", "ergon")], 1: [("a", "one", "ergon"), ("b", "two", "invented")]}


def test_paraphrase_scores(spark):
    rows = [(0, "The cat sat. The dog ran.", "The dog ran. The cat sat."), (1, "The cat sat.", "The cat never sat."), (2, "", "x."), (3, "A b c.", "Completely different words here.")]
    got = {r.id: r for r in judge.score_paraphrases(spark.createDataFrame(rows, "id int, s string, p string"), "id", "s", "p").collect()}
    assert got[0].faithful and got[0].support == 1.0 and got[0].introductions == []
    assert not got[1].faithful and got[1].contradiction_max > 0.1
    assert (got[2].support, got[2].contradiction_max, got[2].introductions, got[2].faithful) == (0.0, 0.0, [], False)
    assert got[3].introductions == ["Completely different words here."]


def test_terms(spark):
    got = spark.createDataFrame([('{"terms": ["a", " ", "b"]}',), ("no",), ('{"terms": null}',), (None,)], "a string").select(harvest.parsed_terms(F.col("a")).alias("t")).collect()
    assert [r.t for r in got] == [["a", "b"], [], [], []]

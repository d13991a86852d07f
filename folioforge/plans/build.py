"""Queries that go through files: the sources and sinks, the whole build, and the harvest path.

Each writes files made from the tables into the shared folder and reads them with the library's
readers; the SQL works on the tables alone. A document is a book here."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioforge.functions import text as T
from folioforge.functions.sentences import snap_selection_near
from folioforge.operators import build, catalogue, grounding, harvest, judge, xhtml
from folioforge.plans import segments
from folioforge.plans.corpus import levels
from folioforge.plans.grounding import TERMS, _bare, _judged
from folioforge.plans.registry import query
from folioforge.plans.text import _LINE_PS, WORD, canonical_sql, docs
from folioforge.session import cut, remove_path, scratch, table
from folioforge.sources import readers, writers

def _read(rows: DataFrame, path: str) -> DataFrame:
    """rows, which come from the files under path, computed; then the files go."""
    out = cut(rows)
    remove_path(rows.sparkSession, path)
    return out


_NUMBER = "CAST(substr(source, 4) AS INT)"
_GIVEN = "documents WHERE text IS NOT NULL AND lang IS NOT NULL AND source IS NOT NULL"


def _books(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).dropna(subset=["text", "lang", "source"]).withColumn("number", F.substring("source", 4, 9).cast("int"))


def _catalogue(books: DataFrame) -> DataFrame:
    return books.select(
        F.col("doc_id").alias("Text#"), F.lit("Text").alias("Type"), F.lit("2000-01-01").alias("Issued"), F.concat(F.lit("Title "), "doc_id", F.lit('\n"'), "source", F.lit('"')).alias("Title"),
        F.col("lang").alias("Language"), F.concat(F.lit("Writer, "), "source", F.lit(", 1800-"), (1940 + 5 * F.col("number")).cast("string")).alias("Authors"), F.lit("").alias("Subjects"),
        F.when(F.col("number") % 2 == 0, "B; PS").otherwise("PS ;BJ").alias("LoCC"), F.concat(F.col("lang"), F.lit("; ;x")).alias("Bookshelves"),
    )


_CATALOGUE = f"""SELECT doc_id AS book_id, 'Text' AS type, 'Title ' || doc_id || chr(10) || '"' || source || '"' AS title, lang AS language, 'Writer, ' || source || ', 1800-' || (1940 + 5 * {_NUMBER}) AS authors,
    CASE WHEN {_NUMBER} % 2 = 0 THEN 'B; PS' ELSE 'PS ;BJ' END AS locc, lang || '; ;x' AS bookshelves FROM {_GIVEN}"""


def _write_catalogue(books: DataFrame, path: str) -> None:
    _catalogue(books).write.option("header", True).option("escape", '"').option("quoteAll", True).csv(path)


@query(_CATALOGUE)
def catalogue_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "catalogue")
    _write_catalogue(_books(spark, sf_dir), path)
    found = readers.read_catalogue(spark, path)
    return _read(found.select(F.col("book_id").cast("long").alias("book_id"), "type", "title", "language", "authors", "locc", "bookshelves"), path)


_RDF = "<rdf xmlns:m='urn:marc'><m:trl><m:agent><m:name> {} </m:name><m:birthdate>{}</m:birthdate><m:deathdate>1999</m:deathdate></m:agent></m:trl>{}"


def _rdf(books: DataFrame, labels: DataFrame) -> DataFrame:
    """A record for each toxic book, with a translator; those of French ones are cut short."""
    toxic = books.join(labels.where("toxic = 1").select("doc_id").distinct(), "doc_id", "left_semi")
    head, middle, tail = _RDF.split("{}")[0], _RDF.split("{}")[1:3], F.when(F.col("lang") == "fr", "").otherwise("</rdf>")
    content = F.concat(F.lit(head), "source", F.lit(middle[0]), (1900 + F.col("number")).cast("string"), F.lit(middle[1]), tail)
    return toxic.select(F.format_string("pg%d.rdf", "doc_id").alias("name"), content.alias("content"))


_TOXIC = f"(SELECT DISTINCT d.* FROM {_GIVEN.replace('documents', 'documents d')} AND doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1))"


@query(f"SELECT doc_id AS book_id, lang <> 'fr' AS readable, CASE WHEN lang <> 'fr' THEN source END AS name, CASE WHEN lang <> 'fr' THEN 1900 + {_NUMBER} END AS birth_year, CASE WHEN lang <> 'fr' THEN 1999 END AS death_year FROM {_TOXIC}")
def rdf_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "rdf")
    writers.write_files(_rdf(_books(spark, sf_dir), table(spark, sf_dir, "labels")), path, writers.FOLDERS)
    found = readers.read_rdf(spark, path).withColumn("t", F.get("translators", F.lit(0)))
    return _read(found.select(F.col("book_id").cast("long").alias("book_id"), F.col("translators").isNotNull().alias("readable"), "t.name", "t.birth_year", "t.death_year"), path)


def _item(lines: Column) -> Column:
    escaped = reduce(lambda x, e: F.replace(x, F.lit(e[0]), F.lit(e[1])), (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")), F.array_join(lines, "\n"))
    return F.concat(F.lit('<!DOCTYPE html><html xmlns="http://www.w3.org/1999/xhtml"><body><p>'), F.replace(escaped, F.lit("\n"), F.lit("</p><p>")), F.lit("</p></body></html>"))


def _epubs(books: DataFrame) -> DataFrame:
    lines = F.split("text", "\n")
    items = F.array(_item(F.slice(lines, 1, 1)), _item(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))))
    return books.select(F.format_string("pg%d.epub", "doc_id").alias("name"), writers.epub(items).alias("content"))


_ITEM = "'<!DOCTYPE html><html xmlns=\"http://www.w3.org/1999/xhtml\"><body><p>' || replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(10), '</p><p>') || '</p></body></html>'"


_REST = "CASE WHEN contains(text, chr(10)) THEN substr(text, position(chr(10) IN text) + 1) ELSE '' END"


@query(
    f"""SELECT doc_id AS book_id, unnest([0, 1]) AS item, unnest([sha256({_ITEM.format('split_part(text, chr(10), 1)')}), sha256({_ITEM.format(_REST)})]) AS html_sha256
    FROM {_GIVEN}"""
)
def epub_spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "epub")
    writers.write_files(_epubs(_books(spark, sf_dir)), path, writers.FOLDERS)
    items = readers.read_epub(spark, path).select(F.col("book_id").cast("long").alias("book_id"), F.col("item").cast("long").alias("item"), T.content_hash(F.col("html")).alias("html_sha256"))
    return _read(items, path)


@query("SELECT doc_id, sha256(text) AS text_sha256, lang, source, n_chars FROM documents")
def jsonl_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "jsonl")
    readers.write_jsonl(docs(spark, sf_dir).select("doc_id", "text", "lang", "source", "n_chars"), path)
    found = readers.read_jsonl(spark, path, "doc_id long, text string, lang string, source string, n_chars long")
    return _read(found.select("doc_id", T.content_hash(F.col("text")).alias("text_sha256"), "lang", "source", "n_chars"), path)


_BAD_FILE = "source: [\n  what\n"


@query(
    f"""SELECT 'b' || item_id || '.yaml' AS file, 'p' || item_id AS entry_id, left(text, 40) AS fingerprint, 'A ''quoted'' name' AS author, 'term: ' || item_id AS english, 'ousia' AS substrate, split_part(text, ' ', 1) || ' "x"' AS gloss FROM benchmark
    UNION ALL SELECT 'refused.yml', NULL, NULL, NULL, NULL, NULL, NULL"""
)
def lexicon_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of one passage each, and one that isn't understood."""
    path, b = scratch(spark, "lexicon"), table(spark, sf_dir, "benchmark")
    quoted = lambda x: F.regexp_extract(F.to_json(F.struct(x.alias("x"))), r'(?s)^\{"x":(.*)\}$', 1)
    gloss = F.concat(F.substring_index("text", " ", 1), F.lit(' "x"'))
    content = F.concat(
        F.lit("# made from a table\nsource:\n  author: 'A ''quoted'' name'\n  title: T\n  language: grc\npassages:\n  - id: p"), "item_id", F.lit("\n    fingerprint: "), quoted(F.substring("text", 1, 40)),
        F.lit("\n    themes: [a, \"b c\"]\n    terms:\n      "), quoted(F.concat(F.lit("term: "), "item_id")), F.lit(":\n        substrate: ousia\n        gloss: "), quoted(gloss), F.lit("\n"),
    )
    files = b.select(F.format_string("b%d.yaml", "item_id").alias("name"), content.alias("content"))
    writers.write_files(files.unionByName(spark.createDataFrame([("refused.yml", _BAD_FILE), ("README.md", "no lexicon")], "name string, content string")), path)
    found = readers.read_lexicon(spark, path).select("file", "entry_id", "fingerprint", "author", F.explode("terms").alias("t")).select("file", "entry_id", "fingerprint", "author", "t.english", "t.substrate", "t.gloss")
    none = F.lit(None).cast("string")
    refused = readers.refused_lexicon_files(spark, path).select("file", *[none.alias(c) for c in ("entry_id", "fingerprint", "author", "english", "substrate", "gloss")])
    return _read(found.unionByName(refused), path)


@query("SELECT item_id AS query_id, CASE item_id % 3 WHEN 0 THEN 'phrase' WHEN 1 THEN 'topical' ELSE 'adversarial' END AS kind, left(text, 30) AS query, item_id % 3 = 0 AS expects FROM benchmark")
def eval_query_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file of queries of three kinds, from the benchmark's items, a bounded table."""
    path, b = scratch(spark, "queries"), table(spark, sf_dir, "benchmark")
    of = lambda k: F.array_sort(F.collect_list(F.when(F.col("item_id") % 3 == k, F.struct(F.col("item_id").cast("string").alias("notes"), F.substring("text", 1, 30).alias("query"), *([F.array(F.col("item_id").cast("int")).alias("expected_ids")] if not k else [])))))
    one = b.agg(of(0).alias("phrase"), of(1).alias("topical"), of(2).alias("adversarial")).withColumn("version", F.lit(1))
    one.coalesce(1).write.json(path)
    found = readers.read_eval_queries(spark, path)
    items = b.select(F.col("item_id").alias("item"), F.substring("text", 1, 30).alias("q"), F.element_at(F.array(*map(F.lit, ("phrase", "topical", "adversarial"))), (F.col("item_id") % 3 + 1).cast("int")).alias("k"))
    joined = found.join(items, (found["query"] == items["q"]) & (found["kind"] == items["k"]))
    return _read(joined.select(F.col("item").alias("query_id"), "kind", "query", (F.size("expected_ids") > 0).alias("expects")).distinct(), path)


@query("SELECT item_id AS book_id, ['reality', 'meaning'] AS themes, CASE WHEN item_id % 2 = 0 THEN 'duplicate' END AS reason FROM benchmark")
def themes_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, b = scratch(spark, "themes"), table(spark, sf_dir, "benchmark").withColumn("book_id", F.col("item_id").cast("int"))
    themes = F.array(F.struct(F.lit("reality").alias("slug"), F.lit("What is real?").alias("label"), F.lit(7).alias("order")))
    one = b.agg(F.collect_list(F.struct("book_id", F.array(F.lit("reality"), F.lit("meaning")).alias("themes"))).alias("assignments"), F.collect_list(F.when(F.col("item_id") % 2 == 0, F.struct("book_id", F.lit("duplicate").alias("reason")))).alias("dropped"))
    one.withColumn("themes", themes).coalesce(1).write.json(path)
    _, assigned, dropped = readers.read_themes(spark, path)
    return _read(assigned.join(dropped, "book_id", "left").select(F.col("book_id").cast("long").alias("book_id"), "themes", "reason"), path)


#: A number rounded to 11 significant bits, to even, as half precision keeps it.
_STEP = "pow(2::DOUBLE, 10 - greatest(floor(log2(abs(x::DOUBLE))), -14))"
_HALF = f"CASE WHEN x = 0 THEN 0::DOUBLE ELSE round_even(x::DOUBLE * {_STEP}, 0) / {_STEP} END"


@query(f"SELECT label AS book, vec_id, list_transform(embedding, lambda x: {_HALF}) AS v FROM embeddings")
def packed_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of each label written as one file of half-precision numbers and read back."""
    path, e = scratch(spark, "vectors"), table(spark, sf_dir, "embeddings")
    readers.write_packed_vectors(e.select(F.col("label").alias("book_id"), F.col("vec_id").alias("chunk_ord"), "embedding"), path)
    size = len(e.select("embedding").first()[0])
    found = readers.read_packed_vectors(spark, f"{path}/*.f16", size).withColumn("book", F.regexp_extract("name", r"([^/]+)\.f16$", 1))
    order = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    ids = e.select(F.col("label").cast("string").alias("of"), "label", "vec_id").withColumn("place", order.cast("long"))
    joined = found.join(ids, (found["book"] == ids["of"]) & (found["chunk_ord"] == ids["place"]))
    return _read(joined.select(F.col("label").alias("book"), "vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v")), path)


def _inputs(spark: SparkSession, sf_dir: str, path: str) -> build.Inputs:
    books = _books(spark, sf_dir)
    _write_catalogue(books, f"{path}/catalogue")
    writers.write_files(_rdf(books, table(spark, sf_dir, "labels")), f"{path}/rdf", writers.FOLDERS)
    writers.write_files(_epubs(books), f"{path}/epub", writers.FOLDERS)
    traditions = books.where("lang = 'en' and number % 3 = 0").select(F.col("doc_id").cast("int").alias("book_id"), F.lit("stoic").alias("tradition"))
    return build.Inputs(f"{path}/catalogue", f"{path}/rdf", f"{path}/epub", traditions)


_YEAR = f"CASE WHEN doc_id IN (SELECT doc_id FROM {_TOXIC}) THEN 1999 ELSE 1940 + 5 * {_NUMBER} END"


@query(f"SELECT doc_id AS book_id, CASE WHEN {_YEAR} <= {catalogue.CUTOFF} THEN 'kept' ELSE 'too-recent' END AS decision, CASE WHEN {_YEAR} <= {catalogue.CUTOFF} THEN 'OriginalLanguagePublicDomain' END AS reason FROM {_GIVEN} AND lang = 'en'")
def build_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "build")
    found = build.decided(spark, _inputs(spark, sf_dir, path))
    return _read(found.select(F.col("book_id").cast("long").alias("book_id"), "decision", "reason"), path)


_META = " OR ".join(f"contains(x, '{x}')" for x in xhtml.METADATA)
_BOOK_TEXT = f"(SELECT doc_id, {canonical_sql('raw')} AS text FROM (SELECT doc_id, array_to_string(list_filter({_LINE_PS}, lambda x: NOT ({_META})), chr(10) || chr(10)) AS raw FROM {_GIVEN} AND lang = 'en' AND {_YEAR} <= {catalogue.CUTOFF}))"
_SUMMED = levels("SELECT doc_id AS book_id, CAST(substr(chunk_id, 2) AS INT) AS place, sha256(text) AS h, octet_length(encode(text)) AS bytes, 1 AS chunks FROM ck")


@query(
    f"""WITH RECURSIVE {segments.chunks(_BOOK_TEXT, feeds=2)}, su AS ({_SUMMED})
    SELECT book_id, sha256, bytes, chunks, 'Title ' || doc_id || chr(10) || '"' || source || '"' AS title, CASE WHEN {_NUMBER} % 2 = 0 THEN ['B', 'PS'] ELSE ['PS', 'BJ'] END AS locc,
    CASE WHEN {_NUMBER} % 3 = 0 THEN 'stoic' ELSE 'uncategorised' END AS tradition, 'as declared' AS shard FROM su JOIN documents ON doc_id = book_id"""
)
def build_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole build from files to the manifest, with what reading the shards back says of each."""
    out = scratch(spark, "build")
    rows = build.build(spark, _inputs(spark, sf_dir, out), out, least_kept=1)
    again = build.verified(spark, out)
    joined = rows.join(again, "book_id", "left").withColumn("shard", F.coalesce("outcome", F.lit("as declared")))
    return _read(joined.select(F.col("book_id").cast("long").alias("book_id"), "sha256", "bytes", "chunks", "title", "locc", "tradition", "shard"), out)


_KEPT = f"(SELECT * FROM {_GIVEN} AND lang = 'en' AND {_YEAR} <= {catalogue.CUTOFF})"
_TOXIC_EN = f"(SELECT count(*) FROM {_TOXIC} WHERE lang = 'en')"


@query(
    f"""WITH RECURSIVE {segments.chunks(_BOOK_TEXT, feeds=2)}, g AS (SELECT count(*) AS n, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'en' AND {_YEAR} <= {catalogue.CUTOFF}) AS kept FROM {_GIVEN}),
    c AS (SELECT count(*) AS n, coalesce(sum(octet_length(encode(text))), 0) AS bytes, coalesce(sum(len({segments.words('text')})), 0) AS tokens, count(DISTINCT doc_id) AS books FROM ck),
    t AS (SELECT count(*) AS n, count(*) FILTER (text = '') AS empty FROM {_BOOK_TEXT}),
    i AS (SELECT coalesce(sum(len(list_filter({_LINE_PS}, lambda x: NOT ({_META})))), 0) AS n FROM {_KEPT})
    SELECT stage, metric, CAST(value AS BIGINT) AS value FROM g, c, t, i, LATERAL (VALUES ('catalogue', 'rows', g.n), ('catalogue', 'type', 0), ('catalogue', 'language', g.n - en), ('catalogue', 'class', 0), ('catalogue', 'kept', en),
      ('translators', 'works', en), ('translators', 'from_rdf', {_TOXIC_EN}), ('translators', 'original', en - {_TOXIC_EN}),
      ('filter', 'kept', kept), ('filter', 'too_recent', en - kept), ('filter', 'no_data', 0), ('filter', 'missing_candidate', 0),
      ('items', 'items', 2 * kept), ('items', 'unreadable', 0), ('items', 'paragraphs', i.n), ('texts', 'books', t.n), ('texts', 'empty', t.empty), ('texts', 'with_warnings', 0),
      ('chunks', 'chunks', c.n), ('chunks', 'tokens', c.tokens), ('chunks', 'bytes', c.bytes), ('vectors', 'vectors', c.n), ('vectors', 'numbers', 64 * c.n), ('shards', 'rows', c.n), ('shards', 'bytes', c.bytes),
      ('manifest', 'books', c.books), ('manifest', 'chunks', c.n), ('manifest', 'bytes', c.bytes)) AS m(stage, metric, value)"""
)
def build_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every stage of the whole build counted as it wrote."""
    out = scratch(spark, "build")
    build.build(spark, _inputs(spark, sf_dir, out), out, least_kept=0)
    return _read(build.counters(spark, out), out)


def _answers() -> tuple:
    """Stand-ins for a model: the terms and the gloss of a text are words and lines of its own."""
    first = F.get(T.search_words(F.col("text")), F.lit(0))
    identify = lambda text: F.to_json(F.struct(F.array(F.lit(" "), first, F.concat(F.lit("The "), first)).alias("terms")))
    gloss = lambda text, term: F.to_json(F.struct(F.col("book_id").alias("substrate"), F.concat(T.first_line(text), F.when(F.length(text) % 2 == 0, F.lit(" Zzz qqq xxx.")).otherwise(F.lit(""))).alias("gloss")))
    return identify, gloss


_HARVEST = f"(SELECT doc_id, source, regexp_extract_all(lower(text), '{WORD}')[1] AS w, split_part(text, chr(10), 1) || CASE WHEN length(text) % 2 = 0 THEN ' Zzz qqq xxx.' ELSE '' END AS gloss, text FROM documents WHERE text IS NOT NULL AND source IS NOT NULL)"


@query(
    f"""WITH {_judged(f"(SELECT CAST(doc_id AS VARCHAR) AS pair_id, text AS source, gloss AS paraphrase FROM {_HARVEST} WHERE w IS NOT NULL)")},
    ob AS (SELECT lower(term) AS key, term AS canonical, source AS substrate, gloss, doc_id, support FROM (SELECT *, unnest([w, 'The ' || w]) AS term FROM {_HARVEST} WHERE w IS NOT NULL) JOIN jd ON pair_id = CAST(doc_id AS VARCHAR) WHERE faithful)
    SELECT key, arg_min(canonical, {{'a': -support, 'b': doc_id}}) AS canonical, substrate, arg_min(gloss, {{'a': -support, 'b': doc_id}}) AS gloss, count(*) AS size, round(avg(support), 6) AS support_mean, key IN ('the', 'la') AS seed_match FROM ob GROUP BY key, substrate"""
)
def harvest_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents to clusters of terms: identify, gloss, judge, gate, cluster; written and read as JSON lines."""
    identify, gloss = _answers()
    chunks = docs(spark, sf_dir).where("text is not null and source is not null").select(F.col("source").alias("book_id"), F.format_string("%012d", "doc_id").alias("chunk_id"), "text")
    clusters, _ = harvest.harvested(chunks, identify, gloss, judge.overlap, spark.createDataFrame([("The",), ("la",)], "term string"))
    path = scratch(spark, "harvest")
    readers.write_jsonl(clusters, path)
    return _read(readers.read_jsonl(spark, path, clusters.schema.simpleString().removeprefix("struct<").removesuffix(">")), path)


@query("SELECT conv_id || '/' || turn AS passage_id, 'curated' AS resolution, 1 AS entries, 'function' AS term, trim(regexp_replace(split_part(text, chr(10), 1), '[:`()]', ' ', 'g'), ' ') || '.' AS gloss, sha256(" + _bare("text") + ") AS paraphrase_sha256 FROM conversations WHERE text IS NOT NULL")
def ground_globally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn with the whole lexicon's terms; the model names one that the lexicon has and one that it lacks."""
    turns = table(spark, sf_dir, "conversations").where("text is not null").select(F.format_string("%d/%d", "conv_id", "turn").alias("passage_id"), "text", F.lit("simple").alias("tier"))
    terms = spark.createDataFrame(TERMS, "entry_id string, ord int, english string, substrate string, gloss string")
    passage = lambda prompt: F.regexp_extract(prompt, '(?s)"""\n(.*)\n"""', 1)
    line = lambda prompt: F.trim(F.regexp_replace(T.first_line(passage(prompt)), "[:`()]", " "))
    other = lambda prompt: F.when(prompt.contains("`none`"), "ergon").otherwise("none")
    echo = lambda prompt: F.concat(F.lit("PARAPHRASE: "), passage(prompt), F.lit("\nGLOSSARY:\n- it (`ergon`): "), line(prompt), F.lit(".\n- other (`"), other(prompt), F.lit("`): no"))
    found = grounding.grounded_globally(turns, terms, echo)
    entry = F.get("glossary", F.lit(0))
    return found.select("passage_id", "resolution", F.size("glossary").alias("entries"), entry["term"].alias("term"), entry["gloss"].alias("gloss"), F.sha2(F.col("paraphrase").cast("binary"), 256).alias("paraphrase_sha256"))


@query(
    f"""WITH d AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE text IS NOT NULL),
    g AS (SELECT doc_id, k, coalesce(sum(length(seg)) OVER w, 0) AS a, coalesce(sum(length(seg)) OVER w, 0) + length(seg) AS b FROM (SELECT doc_id, unnest(segs) AS seg, unnest(range(len(segs))) AS k FROM (SELECT doc_id, list_filter(string_split({segments.marked('text')}, chr(1)), lambda x: x <> '') AS segs FROM d))
          WINDOW w AS (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    s AS (SELECT *, least(40, n) AS lo, greatest(least(40, n), least(60, n)) AS hi FROM d), t AS (SELECT *, CASE WHEN hi > lo THEN hi - 1 ELSE hi END AS anchor FROM s)
    SELECT t.doc_id, CAST(coalesce(max(a) FILTER (a <= lo AND lo < b), max(a), 0) AS BIGINT) AS start, CAST(coalesce(max(b) FILTER (a <= anchor AND anchor < b), max(b), 0) AS BIGINT) AS "end" FROM t LEFT JOIN g USING (doc_id) GROUP BY t.doc_id"""
)
def snap_near_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segments around units 40 to 60; the documents have no characters of two units."""
    d = docs(spark, sf_dir).where("text is not null").select("doc_id", snap_selection_near("text", F.lit(40), F.lit(60)).alias("span"))
    return d.select("doc_id", "span.start", "span.end")

"""Queries over the catalogue, publishing, themes and harvest operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions import text as T
from folioforge.operators import catalogue, harvest, publish, themes
from folioforge.plans.registry import query
from folioforge.plans.text import WORD, docs
from folioforge.session import table

CATALOGUE = [
    (1, "Text", "Enchiridion", "en", "Epictetus, 56?-136?; Long, George, 1800-1879 [Translator]", "Ethics; Stoics", "B; BJ", "Philosophy"),
    (2, "Text", "Republic", "en", "Plato, 428? BCE-348? BCE; Jowett, Benjamin, 1817-1893 [Translator]", "Politics", "B", ""),
    (3, "Sound", "Republic", "en", "Plato", "", "B", ""),
    (4, "Text", "Kritik", "de", "Kant, Immanuel, 1724-1804", "", "B", ""),
    (5, "Text", "Sermons", "en", "Someone, 1900-1980", "", "BX", ""),
    (6, "Text", "Of Late", "en", "Writer, Recent, 1901-1990", "", "BD", "a; ;b"),
    (7, "Text", "Essays", "en", "Hume, David, 1711-1776", "", "BH;BC", ""),
    (8, "Text", "Undated", "en", "Anonymous", "", "BC", ""),
    (9, "Text", "Two hands", "en", "Old, A., -600-500; Known, B., 1850-1920 [Translator]; Young, C. [Translator]", "", "BD", ""),
    (10, "Text", "Notes", "en", "X [Compiler]; Y, 1800- [Editor]", "", "BJ", ""),
]
_COLUMNS = "book_id int, type string, title string, language string, authors string, subjects string, locc string, bookshelves string"
_V = "(VALUES " + ", ".join("(" + ", ".join(str(x) if isinstance(x, int) else f"'{x}'" for x in r) + ")" for r in CATALOGUE) + f") AS c({', '.join(x.split()[0] for x in _COLUMNS.split(', '))})"
RDF = "<r xmlns:m='urn:m'><m:trl><m:agent><m:name>Cross, D.</m:name><m:deathdate>{}</m:deathdate></m:agent></m:trl></r>"


def _catalogue(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CATALOGUE, _COLUMNS)


def _semi(c: str) -> str:
    return f"list_filter(list_transform(string_split({c}, ';'), lambda x: trim(x)), lambda x: x <> '')"


_YEARS = r"(-?\d{1,4})\??\s*(?:BCE|CE)?\s*-\s*(-?\d{1,4})?\??\s*(?:BCE|CE)?"
_AGENTS = rf"""
    e AS (SELECT book_id, pos, entries[pos] AS entry FROM (SELECT book_id, entries, unnest(range(1, len(entries) + 1)) AS pos FROM (SELECT book_id, {_semi('authors')} AS entries FROM {_V}))),
    b AS (SELECT *, regexp_extract(entry, '{catalogue.ROLE}', 1) AS tag, regexp_replace(entry, '{catalogue.ROLE}', '') AS bare FROM e),
    s AS (SELECT *, CASE WHEN contains(bare, '-') THEN split_part(bare, '-', 1) ELSE bare END AS a, CASE WHEN contains(bare, '-') THEN substr(bare, position('-' IN bare) + 1) ELSE '' END AS z,
          try_cast(regexp_extract(bare, '{_YEARS}', 1) AS INT) AS byr, try_cast(regexp_extract(bare, '{_YEARS}', 2) AS INT) AS dyr FROM b),
    ag AS (SELECT book_id, pos - 1 AS pos, regexp_replace(CASE WHEN regexp_matches(bare, '{_YEARS}') THEN regexp_extract(bare, '(?s)^(.*?){_YEARS}', 1) ELSE bare END, '[,\s]+$', '') AS name,
          CASE WHEN contains(a, 'BCE') THEN -abs(byr) ELSE byr END AS birth_year, CASE WHEN contains(z, 'BCE') THEN -abs(dyr) ELSE dyr END AS death_year,
          CASE WHEN tag IN ('Compiler', 'Contributor', 'Commentator') THEN 'Other' WHEN tag = '' THEN 'Author' ELSE tag END AS role FROM s)"""


@query(f"WITH {_AGENTS} SELECT * FROM ag")
def parse_agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _catalogue(spark).select("book_id", F.posexplode(catalogue.agents(F.col("authors"))).alias("pos", "a"))
    return found.select("book_id", F.col("pos").cast("long").alias("pos"), "a.name", "a.birth_year", "a.death_year", "a.role")


_CLASSES = "(" + ", ".join(f"'{c}'" for c in catalogue.CLASSES) + ")"
_FAILED = f"CASE WHEN type <> 'Text' THEN 'type' WHEN language <> 'en' THEN 'language' WHEN len(list_filter({_semi('locc')}, lambda x: x IN {_CLASSES})) = 0 THEN 'class' END"


@query(f"SELECT coalesce({_FAILED}, 'kept') AS outcome, count(*) AS rows FROM {_V} GROUP BY 1")
def catalogue_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.rejections(_catalogue(spark).withColumn("locc", catalogue.semi_list(F.col("locc"))))


@query(f"SELECT book_id, title, {_semi('locc')} AS locc, {_semi('subjects')} AS subjects, {_semi('bookshelves')} AS bookshelves FROM {_V} WHERE {_FAILED} IS NULL")
def catalogue_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.candidates(_catalogue(spark)).select("book_id", "title", "locc", "subjects", "bookshelves")


def _decided(spark: SparkSession) -> DataFrame:
    found = catalogue.candidates(_catalogue(spark))
    rdf = spark.createDataFrame([(6, RDF.format(1970)), (8, RDF.format("?")), (7, "<broken"), (2, RDF.format(1999))], "book_id int, xml string").select("book_id", catalogue.rdf_translators("xml").alias("translators"))
    known = catalogue.with_translators(found, rdf)
    stray = spark.createDataFrame([(99, [], True, False)], known.schema)
    return catalogue.decisions(known.unionByName(stray), found)


_DECIDED = f"""(WITH {_AGENTS}, f AS (SELECT book_id, authors FROM {_V} WHERE {_FAILED} IS NULL),
    r AS (SELECT * FROM (VALUES (6, 1970), (8, NULL), (2, 1999)) AS r(book_id, death)),
    o AS (SELECT book_id, count(*) FILTER (role = 'Translator') AS n, max(death_year) FILTER (role = 'Translator') AS of_translator, max(death_year) FILTER (role = 'Author') AS of_author FROM ag GROUP BY book_id),
    x AS (SELECT f.book_id, coalesce(n, 0) = 0 AND r.book_id IS NULL AND NOT contains(authors, '[Translator]') AS original, CASE WHEN coalesce(n, 0) > 0 THEN of_translator ELSE r.death END AS of_translator, of_author
          FROM f LEFT JOIN o USING (book_id) LEFT JOIN r USING (book_id)),
    y AS (SELECT book_id, original, CASE WHEN original THEN of_author ELSE of_translator END AS year FROM x),
    z AS (SELECT book_id, original, CASE WHEN year IS NULL THEN 'no-data' WHEN year <= {catalogue.CUTOFF} THEN 'kept' ELSE 'too-recent' END AS decision FROM y)
    SELECT book_id, decision, CASE WHEN decision = 'kept' THEN CASE WHEN original THEN 'OriginalLanguagePublicDomain' ELSE 'TranslatorPublicDomain' END END AS reason FROM z
    UNION ALL SELECT 99, 'missing-candidate', NULL) AS d"""


@query(f"SELECT * FROM {_DECIDED}")
def rights_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decided(spark).select("book_id", "decision", "reason")


@query(f"SELECT decision, count(*) AS works FROM {_DECIDED} GROUP BY decision")
def filter_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decided(spark).groupBy("decision").agg(F.count(F.lit(1)).alias("works"))


@query("SELECT CASE WHEN o_orderstatus <> 'O' THEN 'status' WHEN o_totalprice <= 1000 THEN 'price' WHEN c_mktsegment IS NULL OR c_mktsegment NOT IN ('BUILDING', 'MACHINERY') THEN 'segment' ELSE 'kept' END AS outcome, count(*) AS orders FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def filter_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first failing test of a chain, over orders."""
    joined = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
    failed = F.when(F.col("o_orderstatus") != "O", "status").when(F.col("o_totalprice") <= 1000, "price").when(~F.coalesce(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), F.lit(False)), "segment").otherwise("kept")
    return joined.groupBy(failed.alias("outcome")).agg(F.count(F.lit(1)).alias("orders"))


def levels(rows: str) -> str:
    """book_id, sha256, bytes and chunks of rows (book_id, place, h, bytes, chunks), hashed in levels."""
    for _ in range(publish.LEVELS):
        rows = f"SELECT book_id, place // {publish.BLOCK} AS place, sha256(string_agg(h, '' ORDER BY place, h)) AS h, sum(bytes) AS bytes, sum(chunks) AS chunks FROM ({rows}) GROUP BY book_id, place // {publish.BLOCK}"
    return f"SELECT book_id, sha256(string_agg(h, '' ORDER BY place, h)) AS sha256, sum(bytes)::BIGINT AS bytes, sum(chunks)::BIGINT AS chunks FROM ({rows}) GROUP BY book_id"


_HASHES = levels("SELECT source AS book_id, doc_id AS place, sha256(text) AS h, octet_length(encode(text)) AS bytes, 1 AS chunks FROM documents")


def _summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return publish.shard_summary(docs(spark, sf_dir), F.col("source"), F.col("text"), "doc_id")


@query(_HASHES)
def shard_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summaries(spark, sf_dir)


@query(f"SELECT sum(bytes)::BIGINT AS bytes, sum(chunks)::BIGINT AS chunks, count(*) AS shards, round(sum(bytes) / 1e6::DOUBLE, 1) AS megabytes FROM ({_HASHES})")
def shard_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return publish.shard_totals(_summaries(spark, sf_dir))


_TITLES = "(SELECT source AS book_id, min(lang) AS title, list_sort(list(DISTINCT lang)) AS locc FROM documents WHERE source <> 'src3' GROUP BY source)"


@query(f"SELECT h.book_id, sha256, bytes, chunks, coalesce(title, '') AS title, coalesce(locc, []) AS locc, CASE WHEN h.book_id = 'src1' THEN 'stoic' ELSE 'uncategorised' END AS tradition FROM ({_HASHES}) h LEFT JOIN {_TITLES} USING (book_id)")
def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    books = docs(spark, sf_dir).where("source <> 'src3'").groupBy(F.col("source").alias("book_id")).agg(F.min("lang").alias("title"), F.array_sort(F.collect_set("lang")).alias("locc"))
    traditions = spark.createDataFrame([("src1", "stoic")], "book_id string, tradition string")
    filtered = books.withColumn("translators", F.array().cast(catalogue.AGENTS))
    return publish.manifest(_summaries(spark, sf_dir), filtered, traditions).drop("translators")


@query("SELECT source AS book_id, CASE WHEN source = 'src2' THEN 'missing' ELSE 'differs' END AS outcome FROM documents WHERE source IN ('src2', 'src5') GROUP BY source")
def verify_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    declared = _summaries(spark, sf_dir)
    found = declared.where("book_id <> 'src2'").withColumn("sha256", F.when(F.col("book_id") == "src5", F.lit("00")).otherwise(F.upper("sha256")))
    return publish.mismatches(declared, found)


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def pending_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return publish.pending(docs(spark, sf_dir).select("doc_id"), table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT d.doc_id, e.vec_id IS NOT NULL AS embedded FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id WHERE d.doc_id IN (SELECT vec_id FROM embeddings)")
def with_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.lit(0).alias("book_id"), F.col("vec_id").alias("chunk_ord"), "embedding")
    d = docs(spark, sf_dir).join(e, F.col("doc_id") == F.col("chunk_ord"), "left_semi").select(F.lit(0).alias("book_id"), F.col("doc_id").alias("chunk_ord"))
    paired = e.join(d.select("chunk_ord"), "chunk_ord", "left_semi").select("book_id", "chunk_ord", "embedding")  # the tables hold other ids too
    return publish.with_embeddings(d, paired).select(F.col("chunk_ord").alias("doc_id"), F.col("embedding").isNotNull().alias("embedded"))


_RECORDS = """(SELECT doc_id AS book_id, CASE WHEN doc_id % 3 = 0 THEN ['knowledge', 'other'] WHEN doc_id % 3 = 1 THEN ['reality'] ELSE ['meaning', 'knowledge'] END AS themes,
    CASE WHEN toxic = 1 THEN false END AS keep, CASE WHEN toxic = 1 THEN CASE WHEN quality = 1 THEN 'duplicate' ELSE 'biography' END END AS drop_reason FROM documents LEFT JOIN labels USING (doc_id))"""


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = docs(spark, sf_dir).select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    of = lambda *slugs: F.array(*map(F.lit, slugs))
    mod = F.col("doc_id") % 3
    return themes.checked(
        joined.select(
            F.col("doc_id").alias("book_id"),
            F.when(mod == 0, of("knowledge", "other")).when(mod == 1, of("reality")).otherwise(of("meaning", "knowledge")).alias("themes"),
            F.when(F.col("toxic") == 1, F.lit(False)).alias("keep"),
            F.when(F.col("toxic") == 1, F.when(F.col("quality") == 1, "duplicate").otherwise("biography")).alias("drop_reason"),
        )
    )


@query(f"SELECT count(*) FILTER (coalesce(keep, true)) AS books_classified, count(*) FILTER (coalesce(keep, true) AND list_contains(themes, 'other')) AS books_in_other, count(*) FILTER (NOT coalesce(keep, true)) AS books_dropped FROM {_RECORDS}")
def theme_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return themes.totals(_records(spark, sf_dir))


@query(f"SELECT book_id, drop_reason AS reason FROM {_RECORDS} WHERE NOT coalesce(keep, true)")
def theme_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return themes.dropped(_records(spark, sf_dir))


_TAXONOMY = "(VALUES " + ", ".join(f"('{s}', '{t}', {99 if s == 'other' else i})" for i, (s, t) in enumerate(themes.TAXONOMY.items(), 1)) + ") AS t(slug, label, ord)"
_COUNTS = f"SELECT slug, label, ord, coalesce(n, 0) AS books FROM {_TAXONOMY} FULL JOIN (SELECT unnest(themes) AS slug, count(*) AS n FROM {_RECORDS} WHERE coalesce(keep, true) GROUP BY 1) USING (slug)"


@query(_COUNTS)
def theme_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return themes.counts(themes.assignments(_records(spark, sf_dir)), themes.taxonomy(spark))


@query(f"SELECT * FROM ({_COUNTS}) WHERE books > 0 OR slug = 'other'")
def themes_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return themes.shown(theme_counts(spark, sf_dir))


@query(f"SELECT book_id FROM {_RECORDS} WHERE coalesce(keep, true) AND list_contains(themes, 'knowledge')")
def books_in_theme(spark: SparkSession, sf_dir: str) -> DataFrame:
    return themes.books_in(themes.assignments(_records(spark, sf_dir)), "knowledge")


def _books(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("lang") != "en", F.array(F.struct(F.col("source").alias("name"))))
    return docs(spark, sf_dir).select(F.col("doc_id").alias("book_id"), F.substring("text", 1, 20).alias("title"), name.alias("translators"))


_TR = "CASE WHEN lang <> 'en' THEN source ELSE '' END"


@query(f"SELECT doc_id AS book_id, left(text, 20) AS title FROM documents ORDER BY {_TR}, left(text, 20), doc_id LIMIT 25")
def prewarm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return themes.prewarm(_books(spark, sf_dir), 25).select("book_id", "title")


@query(f"SELECT doc_id AS book_id, left(text, 20) AS title FROM documents WHERE doc_id IN (SELECT book_id FROM {_RECORDS} WHERE coalesce(keep, true) AND list_contains(themes, 'other')) AND doc_id NOT IN (SELECT item_id FROM benchmark)")
def theme_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("book_id"))
    return themes.theme_books(themes.assignments(_records(spark, sf_dir)), _books(spark, sf_dir), gone, "other").select("book_id", "title")


_OBS = f"""(SELECT doc_id AS book_id, CASE WHEN doc_id % 2 = 0 THEN 'OF ' ELSE 'of ' END || w[1] AS canonical, lang AS substrate, 'gloss ' || doc_id AS gloss, 'c' || doc_id AS chunk_id, (doc_id % 97) / 97.0::DOUBLE AS support
    FROM (SELECT doc_id, lang, regexp_extract_all(lower(text), '{WORD}') AS w FROM documents) WHERE len(w) > 0)"""


def _observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.get(T.search_words(F.col("text")), F.lit(0))
    canonical = F.concat(F.when(F.col("doc_id") % 2 == 0, "OF ").otherwise("of "), w)
    found = docs(spark, sf_dir).select(
        F.col("doc_id").alias("book_id"), canonical.alias("canonical"), F.col("lang").alias("substrate"), F.concat(F.lit("gloss "), F.col("doc_id")).alias("gloss"),
        F.concat(F.lit("c"), F.col("doc_id")).alias("chunk_id"), ((F.col("doc_id") % 97) / 97.0).alias("support"),
    )
    return found.where("canonical is not null")


@query(
    f"""SELECT arg_min(canonical, {{'a': -support, 'b': book_id}}) AS canonical, substrate, arg_min(gloss, {{'a': -support, 'b': book_id}}) AS gloss, count(*) AS size, round(avg(support), 6) AS support_mean,
    lower(canonical) AS key, lower(any_value(canonical)) IN ('of the', 'of de') AS seed_match FROM {_OBS} GROUP BY lower(canonical), substrate"""
)
def cluster_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    seed = spark.createDataFrame([("Of The",), ("of de",), ("of de",)], "term string")
    return harvest.ordered(harvest.cluster(_observations(spark, sf_dir), seed))


@query(f"SELECT lower(canonical) AS key, substrate, book_id, chunk_id, support FROM {_OBS}")
def cluster_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return harvest.citations(_observations(spark, sf_dir))


@query("SELECT doc_id, lang || ' term' AS canonical, source AS substrate FROM documents WHERE doc_id % 3 <> 2 AND doc_id % 5 <> 0")
def harvest_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON answers made from other columns stand in for a model's: some blank, some broken, some
    without a substrate."""
    identify = lambda text: F.when(F.col("chunk_id") % 3 == 2, F.lit("no json")).otherwise(F.concat(F.lit('{"terms": [" ", "'), F.col("lang"), F.lit(' term"]}')))
    gloss = lambda text, term: F.when(F.col("chunk_id") % 5 == 0, F.lit('{"substrate": null, "gloss": "g"}')).otherwise(F.concat(F.lit('{"substrate": "'), F.col("book_id"), F.lit('", "gloss": "g"}')))
    chunks = docs(spark, sf_dir).select(F.col("source").alias("book_id"), F.col("doc_id").alias("chunk_id"), "text", "lang")
    terms = harvest.parsed_terms(identify(F.col("text")))
    found = chunks.select("book_id", "chunk_id", "text", F.explode(F.slice(terms, 1, harvest.PER_CHUNK)).alias("canonical"))
    return harvest.glossed(found, gloss).select(F.col("chunk_id").alias("doc_id"), "canonical", "substrate")

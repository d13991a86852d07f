"""Queries over the text functions, the chunker and the XHTML stage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions import text as T
from folioforge.functions.sentences import sentence_spans, snap_selection, split_sentences
from folioforge.operators import chunking, intervals, xhtml
from folioforge.plans import segments
from folioforge.plans.registry import query
from folioforge.session import cut, texts

#: In SQL: Unicode white space and word characters, and the word pattern.
WS = r"[\x09-\x0D\x85\p{Z}]"
WC = r"[\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}]"
WORD = T.WORD.replace("'", "''")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir, "documents")


def canonical_sql(raw: str) -> str:
    joined = rf"regexp_replace(replace({raw}, chr(13) || chr(10), chr(10)), '({WC})-\n{WS}*({WC})', '\1\2', 'g')"
    bare = rf"array_to_string(list_transform(string_split({joined}, chr(10) || chr(10)), lambda p: regexp_replace(p, '^{WS}*(?:[IVXLCDM]+|\p{{Nd}}+|§{WS}*\p{{Nd}}+)\.{WS}+', '')), chr(10) || chr(10))"
    return rf"regexp_replace(regexp_replace(regexp_replace({bare}, '[ \t]{{2,}}', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^{WS}+|{WS}+$', '', 'g')"


WORDS = f"list_filter(regexp_split_to_array(text, '{WS}+'), lambda w: w <> '')"
SEARCH = f"regexp_extract_all(lower(text), '{WORD}')"


@query(f"SELECT doc_id, sha256({canonical_sql('text')}) AS canonical_sha256, length({canonical_sql('text')}) AS canonical_chars FROM documents")
def canonicalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = docs(spark, sf_dir).select("doc_id", T.canonicalise(F.col("text")).alias("c"))
    return c.select("doc_id", T.content_hash(F.col("c")).alias("canonical_sha256"), F.length("c").cast("long").alias("canonical_chars"))


@query(f"SELECT doc_id, len({WORDS}) AS tokens FROM documents")
def approx_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", T.approx_tokens(F.col("text")).cast("long").alias("tokens"))


@query(
    f"""SELECT doc_id, len(w) AS words, greatest(len(w) - 1, 0) AS pairs,
    sha256(array_to_string(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || '_' || w[i + 1])), ' ')) AS tokens_sha256
    FROM (SELECT doc_id, {SEARCH} AS w FROM documents)"""
)
def search_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    n = F.size(T.search_words(text)).cast("long")
    return docs(spark, sf_dir).select(
        "doc_id", n.alias("words"), F.greatest(n - 1, F.lit(0)).alias("pairs"), F.sha2(F.array_join(T.search_tokens(text), " ").cast("binary"), 256).alias("tokens_sha256")
    )


@query(f"SELECT doc_id, sha256(array_to_string({SEARCH}, ' ')) AS form_sha256 FROM documents")
def phrase_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", T.content_hash(T.phrase_form(F.col("text"))).alias("form_sha256"))


@query(f"SELECT doc_id, sha256(array_to_string(list_filter(regexp_split_to_array(lower(text), '{WS}+'), lambda w: w <> ''), ' ')) AS form_sha256 FROM documents")
def folded_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", T.content_hash(T.folded(F.col("text"))).alias("form_sha256"))


@query("SELECT doc_id, octet_length(encode(text)) AS bytes, length(text) AS chars FROM documents")
def utf8_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", T.utf8_length(F.col("text")).cast("long").alias("bytes"), F.length("text").cast("long").alias("chars"))


@query(
    r"""WITH l AS (SELECT doc_id, text, list_transform(range(0, 201), lambda k: octet_length(encode(left(text, k)))) AS sizes FROM documents),
    c AS (SELECT doc_id, text, left(text, len(list_filter(sizes, lambda s: s < 200))) AS cut FROM l)
    SELECT doc_id, CASE WHEN octet_length(encode(text)) <= 200 THEN text WHEN contains(cut, ' ') THEN regexp_extract(cut, '(?s)^(.*) ', 1) || '…' ELSE cut || '…' END AS excerpt FROM c"""
)
def excerpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", T.excerpt(F.col("text")).alias("excerpt"))


@query(
    rf"""SELECT doc_id, split_part(text, chr(10), 1) AS first_line, replace(left(text, 200), chr(10), ' ') AS one_line,
    CASE WHEN length(text) <= 80 THEN text ELSE regexp_replace(left(text, 80), '{WS}+$', '') || '…' END AS snippet, left(text, 1500) AS first_page FROM documents"""
)
def text_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return docs(spark, sf_dir).select("doc_id", T.first_line(t).alias("first_line"), T.one_line(t).alias("one_line"), T.snippet(t, 80).alias("snippet"), T.first_page(t).alias("first_page"))


@query("SELECT doc_id, sha256(text) AS sha256 FROM documents")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", T.content_hash(F.col("text")).alias("sha256"))


_STRIPPED = "CASE WHEN a > 0 AND position('>' IN substr(html, a)) > 0 THEN left(html, a - 1) || substr(html, a + position('>' IN substr(html, a))) ELSE html END"
_RESOLVED = reduce(lambda x, e: f"replace({x}, '&{e[0]};', '{e[1]}')", T.ENTITIES.items(), _STRIPPED)


@query(f"SELECT page_id, sha256({_RESOLVED}) AS html_sha256 FROM (SELECT page_id, html, position('<!DOCTYPE' IN html) AS a FROM pages)")
def doctype_and_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = T.resolve_entities(T.strip_doctype(F.col("html")))
    return texts(spark, sf_dir, "pages").select("page_id", T.content_hash(html).alias("html_sha256"))


@query(
    rf"""WITH p AS (SELECT doc_id, pos - 1 AS pos, parts[pos] AS part, parts FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents))),
    o AS (SELECT doc_id, pos, part, coalesce(sum(octet_length(encode(part)) + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM p),
    t AS (SELECT *, regexp_replace(part, '^{WS}+|{WS}+$', '', 'g') AS paragraph, octet_length(encode(part)) - octet_length(encode(regexp_replace(part, '^{WS}+', ''))) AS lead FROM o)
    SELECT doc_id, pos, paragraph, CAST(off + lead AS BIGINT) AS byte_start, CAST(off + lead + octet_length(encode(paragraph)) AS BIGINT) AS byte_end FROM t WHERE paragraph <> ''"""
)
def paragraph_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' paragraphs are apart by one line feed."""
    return chunking.paragraph_offsets(docs(spark, sf_dir), "doc_id", F.col("text"), "\n").withColumn("pos", F.col("pos").cast("long"))


def chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    canonical = docs(spark, sf_dir).select("doc_id", T.canonicalise(F.col("text")).alias("canonical_text"))
    return canonical.withColumn("c", F.explode(chunking.chunks(F.col("canonical_text"), separator="\n")))


_CHUNKS = "WITH RECURSIVE " + segments.chunks(f"(SELECT doc_id, {canonical_sql('text')} AS text FROM documents WHERE text IS NOT NULL)")


@query(f"{_CHUNKS} SELECT *, len({segments.words('text')}) AS token_count FROM ck")
def chunk_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunked(spark, sf_dir).select("doc_id", "c.*")


@query(f"{_CHUNKS} SELECT doc_id, count(*) AS chunks, sum(byte_end - byte_start)::BIGINT AS bytes, true AS same FROM ck GROUP BY doc_id")
def chunk_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether all chunks of a document are the canonical text between their offsets."""
    c = chunked(spark, sf_dir)
    same = T.byte_slice(F.col("canonical_text"), F.col("c.byte_start"), F.col("c.byte_end")) == F.col("c.text")
    return c.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.octet_length("c.text")).alias("bytes"), F.bool_and(same).alias("same"))


_OF_SOURCES = segments.chunks(f"(SELECT coalesce(source, '') AS doc_id, string_agg(coalesce({canonical_sql('text')}, ''), chr(10) ORDER BY doc_id) AS text FROM documents GROUP BY 1)")


@query(f"WITH RECURSIVE {_OF_SOURCES} SELECT doc_id AS source, chunk_id, paragraph_id, section_id, text, byte_start, byte_end, len({segments.words('text')}) AS token_count FROM ck")
def chunk_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks of one text a source, which is all its documents by doc_id; no task holds a source."""
    canonical = docs(spark, sf_dir).select(F.coalesce("source", F.lit("")).alias("source"), "doc_id", T.canonicalise(F.col("text")).alias("text"))
    return chunking.chunks_of_blocks(canonical, "source", "doc_id", "text", separator="\n")


@query(f'SELECT d.doc_id, count(sentence) AS sentences, max(length(sentence)) AS longest, max("end") AS last_end FROM documents d LEFT JOIN {segments.sentences("documents")} s USING (doc_id) GROUP BY d.doc_id')
def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir).select("doc_id", split_sentences("text").alias("s"), sentence_spans("text").alias("spans"))
    count = F.coalesce(F.size("s"), F.lit(0)).cast("long")
    return d.select("doc_id", count.alias("sentences"), F.array_max(F.transform("s", F.length)).cast("long").alias("longest"), F.try_element_at(F.col("spans.end"), F.lit(-1)).alias("last_end"))


_PREFIXES = "list_transform(range(0, 62), lambda k: octet_length(encode(left(text, k))))"


@query(
    f"""WITH d AS (SELECT doc_id, least(40, octet_length(encode(text))) AS a, least(60, octet_length(encode(text))) AS b, {_PREFIXES} AS sizes FROM documents),
    s AS (SELECT doc_id, min(start) FILTER (start <= a AND a < "end") AS first, max("end") FILTER (start < b AND b <= "end") AS last
          FROM d LEFT JOIN {segments.sentences('documents')} s USING (doc_id) GROUP BY doc_id),
    c AS (SELECT *, list_min(list_filter(sizes, lambda x: x >= a)) AS from_, list_max(list_filter(sizes, lambda x: x <= b)) AS to_, coalesce(first < last, false) AS snapped FROM d JOIN s USING (doc_id))
    SELECT doc_id, CAST(CASE WHEN b <= a THEN NULL WHEN snapped THEN first WHEN to_ > from_ THEN from_ END AS BIGINT) AS start,
    CAST(CASE WHEN b <= a THEN NULL WHEN snapped THEN last WHEN to_ > from_ THEN to_ END AS BIGINT) AS "end" FROM c"""
)
def snap_to_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir).select("doc_id", snap_selection("text", F.lit(40), F.lit(60)).alias("span"))
    return d.select("doc_id", "span.start", "span.end")


def _byte(at: str) -> str:
    return f"substr(hx, CAST(2 * ({at}) + 1 AS BIGINT), 2) BETWEEN '80' AND 'BF'"


@query(
    f"""WITH d AS (SELECT doc_id, octet_length(encode(text)) AS size, hex(encode(text)) AS hx FROM documents WHERE text IS NOT NULL),
    q AS (SELECT doc_id, unnest(range(0, size + 1, 100)) AS start, size FROM d), p AS (SELECT doc_id, start, least(start, size) AS a, least(start + 37, size) AS b FROM q),
    sn AS (SELECT * FROM {segments.sentences('documents')}),
    f AS (SELECT p.doc_id, p.start, max(s.start) AS first FROM p LEFT JOIN sn s ON s.doc_id = p.doc_id AND s.start <= a AND a < s."end" GROUP BY ALL),
    l AS (SELECT p.doc_id, p.start, max(s."end") AS last FROM p LEFT JOIN sn s ON s.doc_id = p.doc_id AND s.start < b AND b <= s."end" GROUP BY ALL),
    c AS (SELECT p.*, first, last, coalesce(first < last, false) AS whole, CASE WHEN NOT {_byte('a')} THEN a WHEN NOT {_byte('a + 1')} THEN a + 1 WHEN NOT {_byte('a + 2')} THEN a + 2 ELSE a + 3 END AS from_,
          CASE WHEN NOT {_byte('b')} THEN b WHEN NOT {_byte('b - 1')} THEN b - 1 WHEN NOT {_byte('b - 2')} THEN b - 2 ELSE b - 3 END AS to_
          FROM p JOIN f USING (doc_id, start) JOIN l USING (doc_id, start) JOIN d USING (doc_id))
    SELECT doc_id, start AS selected, CAST(CASE WHEN b <= a THEN NULL WHEN whole THEN first WHEN to_ > from_ THEN from_ END AS BIGINT) AS start,
    CAST(CASE WHEN b <= a THEN NULL WHEN whole THEN last WHEN to_ > from_ THEN to_ END AS BIGINT) AS "end" FROM c"""
)
def snap_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A selection of 37 bytes at every 100th of each document, snapped to sentences all at once."""
    d = docs(spark, sf_dir).where("text is not null").select("doc_id", "text")
    places = d.select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.octet_length("text").cast("long"), F.lit(100).cast("long"))).alias("selected"))
    selections = places.select(F.struct("doc_id", "selected").alias("sel"), "doc_id", F.col("selected").alias("start"), (F.col("selected") + 37).alias("end"))
    spans = cut(d.select("doc_id", F.inline(sentence_spans("text"))))
    found = intervals.snapped(selections, spans, d, "doc_id", "sel")
    return found.select("doc_id", "sel.selected", "span.start", "span.end")


@query(f'{_CHUNKS} SELECT pb.doc_id, CAST(pb.start AS BIGINT) AS "at", coalesce(max(chunk_id), \'\') AS chunk_id FROM pb LEFT JOIN ck ON ck.doc_id = pb.doc_id AND pb.start >= byte_start AND pb.start < byte_end GROUP BY ALL')
def paragraph_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunk that holds each paragraph's first byte."""
    canonical = docs(spark, sf_dir).select("doc_id", T.canonicalise(F.col("text")).alias("text"))
    spans = chunk_text(spark, sf_dir).select("doc_id", "byte_start", "byte_end", "chunk_id")
    points = chunking.paragraph_offsets(canonical, "doc_id", F.col("text"), "\n").select("doc_id", F.col("byte_start").alias("at"))
    return chunking.containing_chunk(spans, points, "doc_id")


def _paragraphs(spark: SparkSession, sf_dir: str, strict: bool) -> DataFrame:
    return texts(spark, sf_dir, "pages").select("page_id", xhtml.paragraphs(F.col("html"), strict).alias("r"))


_BLOCKS = "(?:" + "|".join(sorted(xhtml._Lenient.BLOCKS - {"p"}, key=len, reverse=True)) + ")"
_MARKED = reduce(
    lambda x, y: f"regexp_replace({x}, '{y[0]}', {y[1]}, 'g')",
    [("(?s)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>", "''"), ("<p(?:[ /][^>]*)?>", "chr(1)"), (f"</?{_BLOCKS}(?:[ /][^>]*)?>|</p>", "chr(2)"), ("<[^>]*>", "' '")],
    "html",
)
_TEXT = "replace(replace(replace(replace(p, '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')"
_PS = rf"list_filter(list_transform(regexp_extract_all({_MARKED}, '\x01([^\x01\x02]*)', 1), lambda p: trim(regexp_replace({_TEXT}, '{WS}+', ' ', 'g'))), lambda p: p <> '')"


@query(f"SELECT page_id, unnest(range(len(ps))) AS pos, unnest(ps) AS paragraph FROM (SELECT page_id, {_PS} AS ps FROM pages)")
def extract_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _paragraphs(spark, sf_dir, strict=False)
    return p.select("page_id", F.posexplode("r.paragraphs").alias("pos", "paragraph")).withColumn("pos", F.col("pos").cast("long"))


_LINE_PS = rf"list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '{WS}+', ' ', 'g'))), lambda x: x <> '')"


@query(f"SELECT page_id, CAST(0 AS BIGINT) AS paragraphs, false AS ok, NULL AS text_sha256 FROM pages UNION ALL SELECT doc_id, len(ps), true, sha256(array_to_string(ps, chr(10))) FROM (SELECT doc_id, {_LINE_PS} AS ps FROM documents WHERE text IS NOT NULL)")
def extract_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No page is well-formed XML, so each is a warning; documents, a paragraph a line, are written as such."""
    escaped = reduce(lambda x, e: F.replace(x, F.lit(e[0]), F.lit(e[1])), (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")), F.col("text"))
    body = F.concat(F.lit('<?xml version="1.0"?>\n<!DOCTYPE html>\n<html xmlns="http://www.w3.org/1999/xhtml"><body><p>'), F.replace(escaped, F.lit("\n"), F.lit("</p><div><P>&nbsp;</P></div><p>")), F.lit("</p></body></html>"))
    good = docs(spark, sf_dir).where("text is not null").select(F.col("doc_id").alias("page_id"), xhtml.paragraphs(body).alias("r"))
    both = _paragraphs(spark, sf_dir, strict=True).unionByName(good)
    return both.select("page_id", F.size("r.paragraphs").cast("long").alias("paragraphs"), "r.ok", F.when(F.col("r.ok"), T.content_hash(F.array_join("r.paragraphs", "\n"))).alias("text_sha256"))


_META = " OR ".join(f"contains(line, '{x}')" for x in xhtml.METADATA)
_LINES = "(SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)"


@query(f"SELECT doc_id, count(*) AS lines, count(*) FILTER ({_META}) AS metadata FROM {_LINES} GROUP BY doc_id")
def metadata_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = docs(spark, sf_dir).select("doc_id", F.split("text", "\n").alias("lines")).where("lines is not null")
    return lines.select("doc_id", F.size("lines").cast("long").alias("lines"), F.size(F.filter("lines", xhtml.is_metadata_line)).cast("long").alias("metadata"))


@query(
    f"""SELECT doc_id, line FROM (SELECT *, sum(CASE WHEN regexp_matches(line, '(?i)license|rights') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id) AS hits, count(*) OVER (PARTITION BY doc_id) AS n FROM {_LINES})
    WHERE 2 * hits <= n"""
)
def boilerplate_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The item filter, with license lines as hits, within each document's row."""
    lines = docs(spark, sf_dir).select("doc_id", F.split("text", "\n").alias("lines"))
    return xhtml.kept_items(lines, "lines", lambda line: line.rlike("(?i)license|rights")).select("doc_id", F.explode("lines").alias("line"))

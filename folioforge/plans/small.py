"""Queries over small functions that others only use in passing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioforge.functions import text as T
from folioforge.functions.vectors import mean_pool, softmax3, unit
from folioforge.operators import grounding, publish, search, xhtml
from folioforge.plans.registry import query
from folioforge.plans.text import WS, docs
from folioforge.session import table

_E = [f"exp(embedding[{i}]::DOUBLE * 9 - greatest(embedding[1], embedding[2], embedding[3])::DOUBLE * 9)" for i in (1, 2, 3)]


@query(f"SELECT vec_id, {', '.join(f'round({e} / ({' + '.join(_E)}), 6) AS {n}' for e, n in zip(_E, ('entail', 'neutral', 'contradict')))} FROM embeddings")
def softmax_of_three(spark: SparkSession, sf_dir: str) -> DataFrame:
    logit = lambda i: F.get("embedding", F.lit(i)).cast("double") * 9
    s = table(spark, sf_dir, "embeddings").select("vec_id", softmax3(logit(0), logit(1), logit(2)).alias("s"))
    return s.select("vec_id", *[F.round(f"s.{n}", 6).alias(n) for n in ("entail", "neutral", "contradict")])


@query("SELECT vec_id, round(embedding[1]::DOUBLE / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 3) AS first FROM embeddings")
def unit_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first number of each vector, made three times as long before, once its norm is one."""
    scaled = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x * 3).alias("e"))
    return scaled.select("vec_id", F.round(F.get(unit(F.col("e")), F.lit(0)).cast("double"), 3).alias("first"))


@query("SELECT strftime(ts, '%Y-%m') AS month, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY ALL")
def times_as_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(T.month(F.col("ts")).alias("month"), T.day(F.col("ts")).alias("day")).agg(F.count(F.lit(1)).alias("n"))


_TEMPLATE = "For {who}: {what} and {who} again; {left} stays."


@query("SELECT doc_id, sha256(replace(replace('" + _TEMPLATE + "', '{who}', source), '{what}', text)) AS sha256 FROM documents")
def rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", T.content_hash(T.render(_TEMPLATE, who=F.col("source"), what=F.col("text"))).alias("sha256"))


_LINE = "CASE lang WHEN 'fr' THEN ' contributor : ' || line WHEN 'de' THEN 'THIS eBook was prepared by ' || line ELSE line END"
_BOILERPLATE = " OR ".join("regexp_matches(l, '(?i)" + p.replace("'", "''") + "')" for p in xhtml.BOILERPLATE)


@query(f"SELECT doc_id, count(*) FILTER (l <> '' AND ({_BOILERPLATE})) AS hits, count(*) AS lines FROM (SELECT doc_id, regexp_replace({_LINE}, '^{WS}+|{WS}+$', '', 'g') AS l FROM (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS line FROM documents)) GROUP BY doc_id")
def reader_boilerplate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that a reader leaves out; documents in two languages get such lines."""
    made = lambda x: F.when(F.col("lang") == "fr", F.concat(F.lit(" contributor : "), x)).when(F.col("lang") == "de", F.concat(F.lit("THIS eBook was prepared by "), x)).otherwise(x)
    lines = docs(spark, sf_dir).where("text is not null").select("doc_id", F.transform(F.split("text", "\n"), made).alias("lines"))
    return lines.select("doc_id", F.size(F.filter("lines", xhtml.is_boilerplate)).cast("long").alias("hits"), F.size("lines").cast("long").alias("lines"))


@query("SELECT item_id AS query_id, item_id AS book_id, coalesce(split_part(d.text, chr(10), 1), 'pg' || item_id) AS title FROM benchmark LEFT JOIN documents d ON doc_id = item_id + 190")
def titles_of_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles looked up by id, with a filler where a book isn't there."""
    hits = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("item_id").alias("book_id"))
    books = docs(spark, sf_dir).select((F.col("doc_id") - 190).alias("book_id"), F.col("text").alias("title"))
    return search.titled(hits, books, "pg{id}")


#: Of each vector as 8 tokens of 8 numbers, those whose place and id tell are masked in.
_POOL = "list_transform(range(8), lambda j: list_sum(list_transform(range(8), lambda t: CASE WHEN (t + vec_id) % 3 = 0 OR t = 0 THEN embedding[8 * t + j + 1]::DOUBLE ELSE 0 END)))"


@query(f"SELECT vec_id, round(m[1] / sqrt(list_inner_product(m, m)), 4) AS first, round(m[8] / sqrt(list_inner_product(m, m)), 4) AS last FROM (SELECT vec_id, {_POOL} AS m FROM embeddings)")
def pooled_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector as 8 token vectors, pooled over those of a mask."""
    mask = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda t: F.when(((t + F.col("vec_id")) % 3 == 0) | (t == 0), 1).otherwise(0))
    pooled = table(spark, sf_dir, "embeddings").select("vec_id", mean_pool("embedding", mask).alias("v"))
    return pooled.select("vec_id", *[F.round(F.get("v", F.lit(k)).cast("double"), 4).alias(n) for k, n in ((0, "first"), (7, "last"))])


_TIERS = ["simple", "standard", "scholarly"]


@query("SELECT conv_id, turn, length(CASE turn % 3 " + " ".join(f"WHEN {k} THEN '{grounding.AUDIENCE[t].replace(chr(39), chr(39) * 2)}'" for k, t in enumerate(_TIERS)) + " END) AS chars FROM conversations")
def tier_audiences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For whom each turn would be rewritten, its tier being told by its number."""
    tier = F.element_at(F.array(*map(F.lit, _TIERS)), (F.col("turn") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length(grounding.audience(tier)).cast("long").alias("chars"))


@query("SELECT doc_id, CAST(row_number() OVER (ORDER BY CAST(doc_id AS VARCHAR)) AS INT) AS place FROM documents WHERE doc_id IS NOT NULL QUALIFY place <= 25")
def first_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 25 documents in the order of their files' names, as a run with a limit takes them."""
    named = docs(spark, sf_dir).where("doc_id is not null").select("doc_id", F.col("doc_id").cast("string").alias("name"))
    first = publish.head(named, 25, "name")
    return first.select("doc_id", F.row_number().over(Window.orderBy(publish.name_order("doc_id"))).alias("place"))  # of 25 rows

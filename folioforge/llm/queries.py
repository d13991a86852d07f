"""The queries opN_<name>, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from folioforge.llm import divergence, exact_dedup, language_id, mixing, packing, pii, quality, sentencepiece_nbest, sharding, simhash, spelling, sql, token_files, warc
from folioforge.session import table, texts


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(texts(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(texts(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(texts(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    replaced = pii.replace_entities(texts(spark, sf_dir, "documents"))
    return replaced.select("doc_id", "text", "n_entities")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_nbest.encode_documents(texts(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    # rows are dealt anew there, so they needn't be here
    return token_files.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(texts(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(texts(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(texts(spark, sf_dir, "pages"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(texts(spark, sf_dir, "documents")).drop("row_number")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(texts(spark, sf_dir, "documents"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(texts(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(texts(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
  FROM documents
), w AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id NULLS LAST) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d
)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM w
"""

_RATIOS = ", ".join(f"('{m}', coalesce(CAST({over} AS DOUBLE) / nullif({under}, 0), 0))" for m, (over, under, _, _) in quality.METRICS.items())
_FLOORS = ", ".join(f"('{m}', {floor}, {low})" for m, (_, _, floor, low) in quality.METRICS.items())
OP3_SQL = (
    r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t FROM documents
), c AS (
  SELECT r, doc_id, lang, source, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
         len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(regexp_extract_all(t, '\p{Lu}')) AS n_upper,
         len(regexp_extract_all(t, '[\p{P}\p{S}]')) AS n_marks
  FROM d
), win AS (
  SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 1, 1))) AS i FROM c)
), rep AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM win) WHERE n > 1
), cover AS (
  SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY r
), f AS (
  SELECT c.r, doc_id, lang, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, n_symbols, n_upper, n_marks,
         len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM c LEFT JOIN cover USING (r)
), b AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f
), x AS (
  SELECT r, lang, source, base_failed, m.metric, m.x FROM b, LATERAL (VALUES """
    + _RATIOS
    + f""") AS m(metric, x)
), g AS (
  SELECT lang, source, metric, CASE WHEN x > 0 THEN CAST(ceil(ln(x) / ln({quality.GAMMA!r})) AS INT) END AS bucket FROM x WHERE NOT base_failed
), s AS (
  SELECT lang, source, metric, bucket, count(*) AS n FROM g GROUP BY ALL
), sa AS (
  SELECT metric, bucket, sum(n) * {quality.WHOLE} // sum(sum(n)) OVER (PARTITION BY metric) AS share FROM s GROUP BY metric, bucket
), bl AS (
  SELECT lang, metric, bucket, sum(n) AS n FROM (
    SELECT lang, metric, bucket, n * {quality.ROW} AS n FROM s
    UNION ALL SELECT lang, metric, bucket, share * {quality.PRIOR * quality.ROW // quality.WHOLE} FROM sa, (SELECT DISTINCT lang FROM s)
  ) GROUP BY ALL
), sl AS (
  SELECT lang, metric, bucket, n * {quality.WHOLE} // sum(n) OVER (PARTITION BY lang, metric) AS share FROM bl
), bs AS (
  SELECT lang, source, metric, bucket, sum(n) AS n FROM (
    SELECT lang, source, metric, bucket, n * {quality.ROW} AS n FROM s
    UNION ALL SELECT k.lang, k.source, metric, bucket, share * {quality.PRIOR * quality.ROW // quality.WHOLE}
    FROM sl JOIN (SELECT DISTINCT lang, source FROM s) k ON sl.lang IS NOT DISTINCT FROM k.lang
  ) GROUP BY ALL
), u AS (
  SELECT *, sum(n) OVER (PARTITION BY lang, source, metric ORDER BY bucket NULLS FIRST) AS upto, sum(n) OVER (PARTITION BY lang, source, metric) AS every,
         coalesce(2 * pow({quality.GAMMA!r}, bucket) / {quality.GAMMA + 1!r}, 0) AS v FROM bs
), q AS (
  SELECT lang, source, metric, min(v) FILTER (4 * upto >= every) AS q1, min(v) FILTER (4 * upto >= 3 * every) AS q3 FROM u GROUP BY ALL
), h AS (
  SELECT lang, source, q.metric, q3 + {quality.REACH} * greatest(q3 - q1, floor) AS high, CASE WHEN low THEN q1 - {quality.REACH} * greatest(q3 - q1, floor) ELSE -1 END AS low
  FROM q JOIN (VALUES {_FLOORS}) AS k(metric, floor, low) USING (metric)
), j AS (
  SELECT x.r, bool_or(x.x < h.low OR x.x > h.high) AS beyond
  FROM x LEFT JOIN h ON h.metric = x.metric AND h.lang IS NOT DISTINCT FROM x.lang AND h.source IS NOT DISTINCT FROM x.source
  GROUP BY x.r
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(beyond, false) AS kept
FROM b JOIN j USING (r)
"""
)

OP9_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), w AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS original FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND original <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND original <> page_id THEN original END AS refers_to
FROM w
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = [op1_mixing, op2_exact_dedup, op3_quality, op4_pii, op5_sentencepiece, op6_token_files, op7_simhash, op8_language_id, op9_warc, op10_sharding]
    named += [op11_spelling, op12_packing, op13_divergence]
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    found = {"op1_mixing": sql.mixing_sql(), "op2_exact_dedup": OP2_SQL, "op3_quality": OP3_SQL, "op9_warc": OP9_SQL, "op10_sharding": sql.sharding_sql()}
    return found | {"op11_spelling": sql.SPELLING, "op13_divergence": sql.DIVERGENCE}

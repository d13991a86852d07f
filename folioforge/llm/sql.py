"""SQL for the operators that order or place rows by hashes: 64-bit arithmetic step by step."""

from __future__ import annotations

from folioforge.llm import mixing, sharding

_WRAP = 1 << 64

# The primes of XXH64.
P1, P2, P3, P4, P5 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5


def mul(x: str, y: int | str) -> str:
    return f"CAST((CAST({x} AS UHUGEINT) * CAST({y} AS UHUGEINT)) % {_WRAP} AS UBIGINT)"


def add(x: str, y: int | str) -> str:
    return f"CAST((CAST({x} AS UHUGEINT) + CAST({y} AS UHUGEINT)) % {_WRAP} AS UBIGINT)"


def shifted(x: str, bits: int) -> str:
    """x xor x shifted to the right."""
    return f"xor({x}, {x} >> {bits})"


def rotated(x: str, bits: int) -> str:
    return f"CAST((CAST({x} AS UHUGEINT) * {1 << bits}) % {_WRAP} AS UBIGINT) | ({x} >> {64 - bits})"


def steps(source: str, *each: str) -> str:
    """source with its column h replaced by one expression after the other."""
    for expression in each:
        source = f"(SELECT * REPLACE ({expression} AS h) FROM {source})"
    return source


_FINISH = (shifted("h", 33), mul("h", P2), shifted("h", 29), mul("h", P3), shifted("h", 32))


def _long(source: str, column: str) -> str:
    """source with h hashed on by a long column; null leaves it as it is."""
    kept = lambda x: f"CASE WHEN {column} IS NULL THEN h ELSE {x} END"
    value = f"CAST((CAST({column} AS HUGEINT) + {_WRAP}) % {_WRAP} AS UBIGINT)"
    out = f"(SELECT *, {mul(value, P2)} AS __v FROM {source})"
    out = f"(SELECT * REPLACE ({rotated('__v', 31)} AS __v) FROM {out})"
    out = steps(out, kept(f"xor({add('h', P5 + 8)}, {mul('__v', P1)})"), kept(rotated("h", 27)), kept(add(mul("h", P1), P4)), *map(kept, _FINISH))
    return f"(SELECT * EXCLUDE (__v) FROM {out})"


def _keys(source: str, seed: int, *columns: str) -> str:
    """source with h: the hash of long columns, then of the seed."""
    out = f"(SELECT *, CAST(42 AS UBIGINT) AS h FROM {source})"
    for column in columns:
        out = _long(out, column)
    return steps(out, f"xor({add('h', P5 + 4)}, CAST({seed * P1 % _WRAP} AS UBIGINT))", rotated("h", 23), add(mul("h", P2), P3), *_FINISH)


_CRC = """list_reduce(list_concat([4294967295::UBIGINT], list_transform(range(octet_length(b)), lambda i: ('0x' || substr(hex(b), 2 * i + 1, 2))::UBIGINT)),
         lambda c, x: xor(c >> 8, crc[CAST(xor(c, x) & 255 AS INT) + 1]))"""
_TABLE = "list_transform(range(256), lambda n: list_reduce(list_concat([n::UBIGINT], [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END))"


def mixing_sql(seed: int = 7, share: float = 1.5, most: float = 2.0) -> str:
    weights = "[" + ", ".join(f"{float(w)}::DOUBLE" for w in mixing.WEIGHTS) + "]"
    return rf"""
WITH d AS (
  SELECT doc_id, source, size, CAST(xor({_CRC}, 4294967295) AS BIGINT) AS crc
  FROM (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, encode(coalesce(text, '')) AS b FROM documents), (SELECT {_TABLE} AS crc)
), s AS (
  SELECT *, {most}::DOUBLE * source_size AS cap, {most}::DOUBLE * source_size / weight AS ratio FROM (
    SELECT *, {weights}[sid % {len(mixing.WEIGHTS)} + 1] AS weight FROM (
      SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS sid FROM d GROUP BY source
    )
  )
), w AS (
  SELECT *, ({share}::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY ratio, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY ratio, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s
), t AS (
  SELECT w.*, CASE WHEN o.ratio IS NULL OR (w.ratio, w.sid) < (o.ratio, o.sid) THEN cap ELSE o.level * w.weight END AS target
  FROM w LEFT JOIN (SELECT ratio, sid, level FROM w WHERE ratio > level ORDER BY ratio, sid LIMIT 1) o ON true
), k AS (
  SELECT k.doc_id, size, source_size, target, CAST(round(target) AS BIGINT) AS budget,
         coalesce(sum(size) OVER (PARTITION BY sid ORDER BY h, k.doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM {_keys("d", seed, "doc_id", "crc")} k JOIN t ON k.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       CASE WHEN source_size > 0 THEN budget // source_size * size + greatest(0, least(size, budget % source_size - before)) ELSE 0 END AS taken
FROM k
"""


def sharding_sql(shards: int = 24, seed: int = 20240229) -> str:
    def once(source: str) -> str:
        """The Feistel rounds over column x of source."""
        out = f"(SELECT *, x >> half AS l, x & mask AS r, x AS h FROM {source})"
        for key in sharding.round_keys(seed):
            mixed = steps(f"(SELECT * REPLACE (r AS h) FROM {out})", add("h", key), shifted("h", 30), mul("h", sharding._M1), shifted("h", 27), mul("h", sharding._M2), shifted("h", 31))
            out = f"(SELECT * REPLACE (r AS l, xor(l, h & mask) AS r) FROM {mixed})"
        return f"(SELECT * EXCLUDE (l, r, h) REPLACE ((r << half) | l AS x) FROM {out})"

    return f"""
WITH RECURSIVE d AS (
  SELECT doc_id, octet_length(b) + 8 AS size, xor({_CRC}, 4294967295) AS text_crc32
  FROM (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents), (SELECT {_TABLE} AS crc)
), n AS (
  SELECT greatest(1, (CAST(floor(log2(greatest(n - 1, 1))) AS INT) + 2) // 2) AS half, n FROM (SELECT count(*) AS n FROM documents)
), p AS (
  SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS rn FROM d
), walk AS (
  SELECT * FROM {once("(SELECT rn, CAST(rn AS UBIGINT) AS x, half, CAST((1 << half) - 1 AS UBIGINT) AS mask, n FROM p, n)")}
  UNION ALL SELECT * FROM {once("(SELECT * FROM walk WHERE x >= n)")}
)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(x % {shards} AS INT) AS shard, CAST(x // {shards} AS BIGINT) AS slot, CAST(NULL AS INT) AS grown_shard
FROM p JOIN walk USING (rn) WHERE x < n
"""


#: Every near pair by a join of words without one letter each, forms by rank, chains by recursion.
SPELLING = rf"""
WITH RECURSIVE d AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')) AS run FROM documents
), o AS (
  SELECT id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS times FROM d GROUP BY ALL
), c AS (
  SELECT w, times, xor({_CRC}, 4294967295) AS h FROM (SELECT w, times, encode(id || ':' || w) AS b FROM o WHERE length(w) >= 5), (SELECT {_TABLE} AS crc)
), v AS (
  SELECT word, CAST(sum(times) AS BIGINT) AS n
  FROM (SELECT CASE WHEN h % 97 = 0 THEN w[1:CAST(h % length(w) AS INT)] || w[CAST(h % length(w) AS INT) + 2:] ELSE w END AS word, times FROM c)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(times) >= 3
), g AS (
  SELECT word, n, i, word[1:i] AS before, word[i + 2:] AS after FROM (SELECT word, n, unnest(range(length(word))) AS i FROM v)
), p AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM g a JOIN g b ON a.before = b.before AND a.after = b.after AND a.word <> b.word
  UNION SELECT g.word, v.word, v.n FROM g JOIN v ON v.word = g.before || g.after
  UNION SELECT v.word, g.word, g.n FROM g JOIN v ON v.word = g.before || g.after
), r AS (
  SELECT word, other, other_n, row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) AS at, count(*) OVER (PARTITION BY word) AS n_near FROM p
), f AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * v.n THEN other END AS form, CASE WHEN other_n >= 2 * v.n THEN other_n END AS form_n
  FROM v LEFT JOIN r ON r.word = v.word AND r.at = 1
), walk AS (
  SELECT word, word AS root FROM f
  UNION ALL SELECT walk.word, f.form FROM walk JOIN f ON f.word = walk.root WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, walk.root, f.n, f.n_near, f.form_n
FROM f JOIN walk ON walk.word = f.word JOIN f e ON e.word = walk.root WHERE e.form IS NULL
"""

#: Every count of every kept term in every group, zeros too, and all pairs of groups.
DIVERGENCE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents
), t AS (
  SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), k AS (
  SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT r) >= 30
), g AS (
  SELECT DISTINCT lang, source FROM d
), n AS (
  SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY ALL
), c AS (
  SELECT g.lang, g.source, k.term, coalesce(n.n, 0) AS n FROM g JOIN k USING (lang) LEFT JOIN n USING (lang, source, term)
), p AS (
  SELECT *, CAST(1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source) + 5 * count(*) OVER (PARTITION BY lang, source)) AS BIGINT) AS p FROM c
), q AS (
  SELECT lang, term, CAST(1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang) + 5 * count(*) OVER (PARTITION BY lang)) AS BIGINT) AS p
  FROM (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL)
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(sum(abs(x.p - y.p)), 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  GROUP BY ALL
), terms AS (
  SELECT p.lang, p.source, 'term' AS part, p.term AS item, p.p - q.p AS value FROM p JOIN q USING (lang, term) WHERE p.n > 0 AND p.p > q.p
)
SELECT lang, source, part, item, value, CAST(rank AS INT) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
) WHERE part = 'pair' OR rank <= 50
"""

"""SQL for sentences and chunks, written from their rules and not from the functions that they check."""

from __future__ import annotations

# Classes of characters of the sentence rules, as far as SQL needs them, and white space.
SEP, TERM_A, TERM_S = r"[\n\r\x85\x{2028}\x{2029}]", r"[.\x{2024}\x{FE52}\x{FF0E}]", r"[!?\x{061F}\x{3002}\x{FF01}\x{FF1F}]"
CLOSE, SPACE = r"""[\p{Ps}\p{Pe}\p{Pi}\p{Pf}"']""", r"[ \t\x0B\x0C\x{A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]"
GOES_ON = r"[,:.!?\-\x{2013}\x{2014}]"
WS = r"[\x09-\x0D\x1C-\x1F\x85\p{Z}]"


def _sub(text: str, pattern: str, by: str) -> str:
    return f"regexp_replace({text}, '{pattern.replace(chr(39), chr(39) * 2)}', {by}, 'g')"


def marked(text: str) -> str:
    """text with chr(1) at the end of each segment: first wherever one may end, chr(2) after a full
    stop and chr(3) after a mark that always ends one; then not where what follows goes on."""
    out = _sub(text, rf"(\r\n|{SEP})", "'\\1' || chr(1)")
    for term, mark in ((TERM_A, 2), (TERM_S, 3)):
        out = _sub(out, f"({term}{CLOSE}*{SPACE}*)", f"'\\1' || chr({mark})")
    out = _sub(out, rf"[\x02\x03]({SEP})", r"'\1'")
    out = _sub(out, rf"[\x02\x03]({GOES_ON})", r"'\1'")
    out = _sub(out, rf"({TERM_A})\x02(\p{{Nd}})", r"'\1\2'")
    for _ in range(2):  # initials in a row share letters
        out = _sub(out, rf"([\p{{Lu}}\p{{Ll}}]{TERM_A})\x02(\p{{Lu}})", r"'\1\2'")
    out = _sub(out, r"\x02([^\p{L}\n\r\x85\x{2028}\x{2029}.!?\x02\x03]*\p{Ll})", r"'\1'")
    return _sub(out, r"[\x02\x03]", "chr(1)")


def words(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '{WS}+'), lambda w: w <> '')"


def bare(text: str) -> str:
    return f"regexp_replace({text}, '^{WS}+|{WS}+$', '', 'g')"


def sentences(source: str, key: str = "doc_id", text: str = "text") -> str:
    """key, k, sentence, start and end (bytes) of the sentences of the rows of source."""
    return f"""(
      SELECT {key}, k, sentence, CAST(place + lead AS BIGINT) AS start, CAST(place + lead + octet_length(encode(sentence)) AS BIGINT) AS "end" FROM (
        SELECT *, {bare('seg')} AS sentence, octet_length(encode(seg)) - octet_length(encode(regexp_replace(seg, '^{WS}+', ''))) AS lead,
               coalesce(sum(octet_length(encode(seg))) OVER (PARTITION BY {key} ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place
        FROM (SELECT {key}, unnest(segs) AS seg, unnest(range(len(segs))) AS k FROM (SELECT {key}, string_split({marked(text)}, chr(1)) AS segs FROM {source}))
      ) WHERE regexp_matches(seg, '[\\p{{L}}\\p{{N}}]'))"""


def chunks(source: str, least: int = 50, most: int = 512, feeds: int = 1) -> str:
    """Common table expressions, recursive ones among them, up to ck: the chunks of the rows of source
    (doc_id, text), whose paragraphs are apart by so many line feeds."""
    return f"""
    src AS (SELECT doc_id, text FROM {source}),
    pa AS (SELECT doc_id, part, coalesce(sum(octet_length(encode(part)) + {feeds}) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place, i
           FROM (SELECT doc_id, unnest(parts) AS part, unnest(range(len(parts))) AS i FROM (SELECT doc_id, string_split(text, repeat(chr(10), {feeds})) AS parts FROM src))),
    pb AS (SELECT doc_id, place + octet_length(encode(part)) - octet_length(encode(regexp_replace(part, '^{WS}+', ''))) AS start, octet_length(encode({bare('part')})) AS size,
                  len({words('part')}) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS k FROM pa WHERE {bare('part')} <> ''),
    -- one paragraph after the other: open is where what waits began, at this one if nothing did, and had its words
    fold AS (SELECT doc_id, k, start AS open, n AS had, start + size AS stop FROM pb WHERE k = 0
             UNION ALL SELECT pb.doc_id, pb.k, CASE WHEN had < {least} THEN open ELSE pb.start END, CASE WHEN had < {least} THEN had + n ELSE n END, pb.start + pb.size
             FROM fold JOIN pb ON pb.doc_id = fold.doc_id AND pb.k = fold.k + 1),
    ends AS (SELECT *, max(k) OVER (PARTITION BY doc_id) = k AS last FROM fold),
    se AS (SELECT doc_id, start, "end", len({words('sentence')}) AS n FROM {sentences('src')}),
    inside AS (SELECT e.doc_id, e.k, s.start, s."end", s.n, row_number() OVER (PARTITION BY e.doc_id, e.k ORDER BY s.start) AS i
               FROM ends e JOIN se s ON s.doc_id = e.doc_id AND s.start >= e.open AND s."end" <= e.stop WHERE e.had > {most}),
    pack AS (SELECT doc_id, k, i, start AS first, "end" AS upto, n AS total, 0 AS run FROM inside WHERE i = 1
             UNION ALL SELECT s.doc_id, s.k, s.i, CASE WHEN total + s.n <= {most} OR total = 0 THEN first ELSE s.start END, s."end",
                              CASE WHEN total + s.n <= {most} OR total = 0 THEN total + s.n ELSE s.n END, CASE WHEN total + s.n <= {most} OR total = 0 THEN run ELSE run + 1 END
             FROM pack JOIN inside s ON s.doc_id = pack.doc_id AND s.k = pack.k AND s.i = pack.i + 1),
    cut AS (SELECT doc_id, k, open AS a, stop AS b, false AS rest FROM ends WHERE had BETWEEN {least} AND {most}
            UNION ALL SELECT doc_id, k, min(first), max(upto), false FROM pack GROUP BY doc_id, k, run
            UNION ALL SELECT doc_id, k, open, stop, false FROM ends e WHERE had > {most} AND NOT EXISTS (SELECT 1 FROM inside s WHERE s.doc_id = e.doc_id AND s.k = e.k)
            UNION ALL SELECT doc_id, k, open, stop, true FROM ends WHERE last AND had < {least}),
    cn AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY a) - 1 AS c FROM cut),
    ck AS (SELECT doc_id, 'c' || lpad(CAST(c AS VARCHAR), 6, '0') AS chunk_id, 'p' || lpad(CAST(CASE WHEN rest THEN c ELSE k END AS VARCHAR), 6, '0') AS paragraph_id, CAST(NULL AS VARCHAR) AS section_id,
                  decode(encode(text)[CAST(a + 1 AS INT):CAST(b AS INT)]) AS text, CAST(a AS BIGINT) AS byte_start, CAST(b AS BIGINT) AS byte_end FROM cn JOIN src USING (doc_id))"""

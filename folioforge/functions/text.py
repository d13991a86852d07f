"""Text functions as Column expressions: everything here stays in the JVM.

Offsets are UTF-8 byte offsets. Regular expressions carry (?U) where white space and
word characters are meant in the Unicode sense.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of the canonical form, the word pattern, entity names.
HYPHEN_BREAK = r"(?U)(\w)-\n\s*(\w)"
MARKER = r"(?U)^\s*(?:[IVXLCDM]+|\d+|§\s*\d+)\.\s+"
WORD = r"[\p{L}\p{N}\p{M}]+(?:['’.][\p{L}\p{N}\p{M}]+)*"
ENTITIES = {
    "nbsp": " ", "mdash": "—", "ndash": "–", "hellip": "…", "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”",
    "copy": "©", "trade": "™", "reg": "®", "times": "×", "divide": "÷", "deg": "°", "para": "¶", "sect": "§", "middot": "·",
    "laquo": "«", "raquo": "»", "iexcl": "¡", "iquest": "¿", "pound": "£", "euro": "€", "yen": "¥", "Agrave": "À",
    "aacute": "á", "Aacute": "Á", "eacute": "é", "Eacute": "É", "iacute": "í", "oacute": "ó", "uacute": "ú", "ntilde": "ñ",
    "Ntilde": "Ñ", "ouml": "ö", "uuml": "ü", "auml": "ä", "szlig": "ß", "aring": "å", "oslash": "ø", "aelig": "æ", "ccedil": "ç",
}


def trim(text: Column) -> Column:
    """text without Unicode white space at its ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def canonicalise(raw: Column) -> Column:
    """Line ends unified, hyphenated line breaks joined, a marker at the start of each paragraph
    dropped once, runs of blanks and of line feeds shortened, ends trimmed."""
    joined = F.regexp_replace(F.replace(raw, F.lit("\r\n"), F.lit("\n")), HYPHEN_BREAK, "$1$2")
    bare = F.array_join(F.transform(F.split(joined, "\n\n"), lambda p: F.regexp_replace(p, MARKER, "")), "\n\n")
    return trim(F.regexp_replace(F.regexp_replace(bare, "[ \t]{2,}", " "), "\n{3,}", "\n\n"))


def space_words(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def approx_tokens(text: Column) -> Column:
    """Number of words between Unicode white space."""
    return F.size(space_words(text))


def utf8_length(text: Column) -> Column:
    return F.octet_length(text)


def byte_slice(text: Column, start: Column, end: Column) -> Column:
    """The text between two byte offsets."""
    return F.substring(text.cast("binary"), start + 1, end - start).cast("string")


def search_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def search_tokens(text: Column) -> Column:
    """Lower-case words, then adjacent pairs of them joined by an underscore; repeats stay."""

    def pairs(w: Column) -> Column:
        n = F.greatest(F.size(w) - 1, F.lit(0))
        return F.concat(w, F.zip_with(F.slice(w, 1, n), F.slice(w, 2, n), lambda a, b: F.concat(a, F.lit("_"), b)))

    return F.transform(F.array(search_words(text)), pairs)[0]


def phrase_form(text: Column) -> Column:
    """Words in lower case, one space between them."""
    return F.array_join(search_words(text), " ")


def folded(text: Column) -> Column:
    """Lower case with single spaces; punctuation stays."""
    return F.array_join(space_words(F.lower(text)), " ")


def excerpt(text: Column, most: int = 200) -> Column:
    """text if it has at most `most` bytes; else its start up to the last space before the
    character boundary at or after that many bytes, or up to the boundary, and an ellipsis."""
    data = text.cast("binary")
    byte = lambda k: F.conv(F.hex(F.substring(data, most + k, 1)), 16, 10).cast("int")
    # bytes 0x80 to 0xBF continue a character
    inside = lambda k: F.coalesce((byte(k) >= 128) & (byte(k) < 192), F.lit(False))
    more = F.when(~inside(1), 0).when(~inside(2), 1).when(~inside(3), 2).otherwise(3)
    cut = F.substring(data, F.lit(1), F.lit(most) + more).cast("string")
    lead = F.regexp_extract(cut, r"(?s)^(.*) ", 1)
    return F.when(F.octet_length(text) <= most, text).otherwise(F.concat(F.when(cut.contains(" "), lead).otherwise(cut), F.lit("…")))


def first_line(text: Column) -> Column:
    return F.coalesce(F.substring_index(text, "\n", 1), F.lit(""))


def one_line(text: Column, most: int = 200) -> Column:
    """The first `most` characters with line feeds as spaces."""
    return F.translate(F.substring(text, 1, most), "\n", " ")


def snippet(text: Column, most: int) -> Column:
    """At most `most` characters; a cut text loses trailing white space and gets an ellipsis."""
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.regexp_replace(F.substring(text, 1, most), r"(?U)\s+$", ""), F.lit("…")))


def first_page(text: Column) -> Column:
    return F.substring(text, 1, 1500)


def resolve_entities(xml: Column) -> Column:
    """Named entities as characters; amp, lt, gt and unknown names stay for the parser."""
    return reduce(lambda x, e: F.replace(x, F.lit(f"&{e[0]};"), F.lit(e[1])), ENTITIES.items(), xml)


def strip_doctype(xml: Column) -> Column:
    return F.regexp_replace(xml, r"(?s)^(.*?)<!DOCTYPE[^>]*>", "$1")


def content_hash(data: Column) -> Column:
    """Lower-case SHA-256 in hex."""
    return F.sha2(data.cast("binary"), 256)


def render(template: str, **values: Column) -> Column:
    """A template with {name} replaced, one name after the other, in the order given."""
    return reduce(lambda t, kv: F.replace(t, F.lit("{" + kv[0] + "}"), kv[1]), values.items(), F.lit(template))


def month(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM")


def day(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd")


def rfc3339(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ssXXX")

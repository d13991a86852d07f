"""Sentences by the rules SB3 to SB11 of Unicode Annex 29, as byte spans.

A sentence ends after a full stop, question mark or the like with its closing marks and
spaces, unless what follows continues it: a lower-case word after a full stop, a digit
or capital glued to it, or a continuing mark. Paragraph separators end one always.
Segments without a letter or digit are no sentences; offsets are true byte offsets.
"""

from __future__ import annotations

import pyarrow as pa
import regex
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from folioforge.functions.binding import in_slices
from folioforge.schema import SPAN, STRINGS

_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])

_EXT = r"[\p{Sentence_Break=Extend}\p{Sentence_Break=Format}]*"


def _c(*names: str) -> str:
    return "[" + "".join(rf"\p{{Sentence_Break={n}}}" for n in names) + "]"


_SEP = r"(?:\r\n|" + _c("Sep", "CR", "LF") + ")"
_CLOSE, _SP = rf"(?:{_c('Close')}{_EXT})*", rf"(?:{_c('Sp')}{_EXT})*"
_STOP = regex.compile(
    rf"""(?:
      (?P<aterm>{_c('ATerm')}){_EXT}(?P<aclose>{_CLOSE})(?P<asp>{_SP})(?P<asep>{_SEP}?)
    | {_c('STerm')}{_EXT}{_CLOSE}(?P<ssp>{_SP})(?P<ssep>{_SEP}?)
    | (?P<sep>{_SEP})
    )""",
    regex.VERBOSE,
)
_LOWER_NEXT = regex.compile(rf"[^\p{{Sentence_Break=OLetter}}\p{{Sentence_Break=Upper}}\p{{Sentence_Break=Lower}}\p{{Sentence_Break=Sep}}\p{{Sentence_Break=CR}}\p{{Sentence_Break=LF}}\p{{Sentence_Break=STerm}}\p{{Sentence_Break=ATerm}}]*{_c('Lower')}")
_GOES_ON = regex.compile(_c("SContinue", "STerm", "ATerm"))
_DIGIT, _UPPER, _WORDY = regex.compile(_c("Numeric")), regex.compile(_c("Upper")), regex.compile(rf"{_c('Upper', 'Lower')}{_EXT}$")
_ALNUM = regex.compile(r"[\p{Alphabetic}\p{N}]")


def segments(text: str) -> list[tuple[int, int]]:
    """All segments of text as character spans; they cover it."""
    out, start, at = [], 0, 0
    while m := _STOP.search(text, at):
        end = at = m.end()
        if m["sep"] is None:
            glued = not (m["asp"] if m["aterm"] else m["ssp"])
            done = bool(m["asep"] if m["aterm"] else m["ssep"])
            if m["aterm"] and not done:
                bare = not m["aclose"] and glued
                if bare and _DIGIT.match(text, end):
                    continue
                if bare and _UPPER.match(text, end) and _WORDY.search(text, max(0, m.start() - 8), m.start()):
                    continue
                if _LOWER_NEXT.match(text, end):
                    continue
            if not done and _GOES_ON.match(text, end):
                continue
        out.append((start, end))
        start = end
    if start < len(text):
        out.append((start, len(text)))
    return out


def sentences(text: str) -> list[tuple[int, int]]:
    """Trimmed sentences as character spans."""
    out = []
    for a, b in segments(text):
        part = text[a:b]
        if _ALNUM.search(part):
            lead = len(part) - len(part.lstrip())
            out.append((a + lead, a + len(part.rstrip())))
    return out


def byte_spans(text: str) -> list[tuple[int, int]]:
    """Trimmed sentences as byte spans."""
    out, chars, size = [], 0, 0
    for a, b in sentences(text):
        size += len(text[chars:a].encode())
        start = size
        size += len(text[a:b].encode())
        chars = b
        out.append((start, size))
    return out


def snap(text: str, start: int, end: int) -> tuple[int, int] | None:
    """The byte span of the sentences that a selected byte range touches; the range itself, cut
    to whole characters, if it touches none; None if it is empty."""
    data = text.encode()
    start, end = min(start, len(data)), min(end, len(data))
    if end <= start:
        return None
    spans = byte_spans(text)
    first = next((s for s, e in spans if s <= start < e), None)
    last = next((e for s, e in reversed(spans) if s < end <= e), None)
    if first is not None and last is not None and first < last:
        return first, last
    while start < len(data) and data[start] & 0xC0 == 0x80:
        start += 1
    while 0 < end < len(data) and data[end] & 0xC0 == 0x80:
        end -= 1
    return (start, end) if end > start else None


def snap_near(text: str, start: int, end: int) -> tuple[int, int]:
    """The span, in UTF-16 units, of the segments that a selection in UTF-16 units touches: those that hold
    its first unit and its last, or are nearest to them. An empty selection takes one segment."""
    units = [0]
    for c in text:
        units.append(units[-1] + (2 if ord(c) > 0xFFFF else 1))
    if not text:
        return 0, 0
    spans = [(units[a], units[b]) for a, b in segments(text)]
    start = min(max(start, 0), units[-1])
    end = min(max(end, start), units[-1])

    def holding(at: int) -> tuple[int, int]:
        far = lambda s: 0 if s[0] <= at < s[1] else s[0] - at if at < s[0] else at - s[1] + 0.5  # noqa: E731  the segment that holds a unit comes before one that ends there
        return min(spans, key=far)

    first, last = holding(start), holding(end - 1 if end > start else end)
    return first[0], max(first[0], last[1])


def _span(span: tuple[int, int] | None) -> dict | None:
    """The fields of no span are null, not the row."""
    return {"start": span and span[0], "end": span and span[1]}


@F.arrow_udf(SPAN)
def snap_selection_near(texts: pa.Array, starts: pa.Array, ends: pa.Array) -> pa.Array:
    return in_slices(lambda t, a, b: _span(None if t is None else snap_near(t, int(a), int(b))), _SPAN, texts, starts, ends)


@F.arrow_udf(STRINGS)
def split_sentences(texts: pa.Array) -> pa.Array:
    return in_slices(lambda t: None if t is None else [t[a:b] for a, b in sentences(t)], pa.list_(pa.string()), texts)


@F.arrow_udf(ArrayType(SPAN))
def sentence_spans(texts: pa.Array) -> pa.Array:
    return in_slices(lambda t: None if t is None else [{"start": a, "end": b} for a, b in byte_spans(t)], pa.list_(_SPAN), texts)


@F.arrow_udf(SPAN)
def snap_selection(texts: pa.Array, starts: pa.Array, ends: pa.Array) -> pa.Array:
    return in_slices(lambda t, a, b: _span(None if t is None else snap(t, int(a), int(b))), _SPAN, texts, starts, ends)

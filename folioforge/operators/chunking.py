"""Offset-preserving chunks of canonical texts.

Paragraphs under `least` words wait and are joined with the next one; what has `least`
to `most` words becomes a chunk; what has more is packed sentence by sentence. What
still waits at the end becomes a chunk however short. A chunk's text is the canonical
text between its byte offsets. The fold depends on order within one document alone, so
with `chunks` each document is one call of an Arrow-batched UDF and nothing is shuffled.

A text that no row or task should hold lies in blocks, and `chunks_of_blocks` splits the
same fold over them. Between paragraphs its only state is the number of words that wait,
0 to `least` - 1, so what a block does is a table of as many rows: the words that wait after it
and the units that it closes. Tables compose; once each block knows what waits before it,
blocks are cut up apart from each other. Only what lies across their borders is moved.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions.binding import in_slices, let
from folioforge.functions.sentences import byte_spans
from folioforge.functions.text import trim
from folioforge.operators.folds import before_each, sums_before
from folioforge.operators.intervals import holding
from folioforge.session import broadcast_if_small, cut

LEAST, MOST = 50, 512
CHUNK = "array<struct<chunk_id:string,paragraph_id:string,section_id:string,text:string,byte_start:long,byte_end:long,token_count:int>>"


_NAMES, _SPAN = [(c, pa.string()) for c in ("chunk_id", "paragraph_id", "section_id")], [("text", pa.string()), ("byte_start", pa.int64()), ("byte_end", pa.int64()), ("token_count", pa.int32())]
_CHUNK = pa.list_(pa.struct(_NAMES + _SPAN))
_DONE = pa.list_(pa.struct([("paragraph", pa.int64()), *_SPAN]))
_PIECE = pa.struct([("done", _DONE), ("open", pa.list_(pa.struct([("unit", pa.int64()), ("closes", pa.bool_()), ("paragraph", pa.int64()), ("text", pa.string()), ("byte_start", pa.int64())])))])

# White space as Python's str.split has it, beside what (?U)\s holds
_BLANK = r"(?U)[\s\x1C-\x1F]+"
_PIECES = "struct<done:array<struct<paragraph:long,text:string,byte_start:long,byte_end:long,token_count:int>>,open:array<struct<unit:long,closes:boolean,paragraph:long,text:string,byte_start:long>>>"


@dataclass
class _Open:
    start: int
    end: int
    text: str


def _paragraphs(text: str, separator: str) -> list[_Open]:
    out, at, wide = [], 0, len(separator.encode())
    for part in text.split(separator):
        bare = part.strip()
        lead = at + len(part[: len(part) - len(part.lstrip())].encode())
        if bare:
            out.append(_Open(lead, lead + len(bare.encode()), bare))
        at += len(part.encode()) + wide
    return out


def _count(text: str) -> int:
    return len(text.split())


def _packed(text: str, most: int) -> list[tuple[int, int, int]]:
    """Byte spans and word counts of runs of sentences with at most `most` words, or of one."""
    data, runs = text.encode(), []
    for start, end in byte_spans(text):
        n = _count(data[start:end].decode())
        if runs and (runs[-1][2] + n <= most or not runs[-1][2]):
            runs[-1] = (runs[-1][0], end, runs[-1][2] + n)
        else:
            runs.append((start, end, n))
    return runs or [(0, len(data), _count(text))]


def chunk(text: str, least: int = LEAST, most: int = MOST, separator: str = "\n\n") -> list[dict]:
    """The chunks of one canonical text."""
    data, out = text.encode(), []

    def emit(paragraph: int, start: int, end: int) -> None:
        own = data[start:end].decode()
        out.append({"chunk_id": f"c{len(out):06d}", "paragraph_id": f"p{paragraph:06d}", "section_id": None, "text": own, "byte_start": start, "byte_end": end, "token_count": _count(own)})

    waiting: _Open | None = None
    for k, p in enumerate(_paragraphs(text, separator)):
        if waiting:
            p = _Open(waiting.start, p.end, data[waiting.start : p.end].decode())
            waiting = None
        n = _count(p.text)
        if n < least:
            waiting = p
        elif n <= most:
            emit(k, p.start, p.end)
        else:
            for a, b, _ in _packed(p.text, most):
                emit(k, p.start + a, p.start + b)
    if waiting:
        emit(len(out), waiting.start, waiting.end)
    return out


def chunks(text: Column, least: int = LEAST, most: int = MOST, separator: str = "\n\n") -> Column:
    """The chunks of each text, as an array of structs."""

    @F.arrow_udf(CHUNK)
    def chunked(texts: pa.Array) -> pa.Array:
        return in_slices(lambda t: [] if t is None else chunk(t, least, most, separator), _CHUNK, texts)

    return chunked(text)


def _table(counts: Column, least: int) -> Column:
    """to and closes: for each number of words that may wait before paragraphs of these counts, the
    words that wait after them and the units that they close. From the first paragraph of
    `least` words on it makes no difference what waited."""

    def run(some: Column, waits: Column) -> Column:
        def step(a: Column, n: Column) -> Column:
            more = a["waits"] + n
            return F.when(more < least, F.struct(more.alias("waits"), a["closes"].alias("closes"))).otherwise(F.struct(F.lit(0).alias("waits"), (a["closes"] + 1).alias("closes")))

        return F.aggregate(some, F.struct(waits.alias("waits"), F.lit(0).cast("long").alias("closes")), step)

    states = F.sequence(F.lit(0), F.lit(least - 1))

    def both(x: Column, each: Column, rest: Column) -> Column:
        to = F.when(x["at"] > 0, F.transform(states, lambda _: rest["waits"])).otherwise(F.transform(each, lambda e: e["waits"]))
        return F.struct(to.alias("to"), F.transform(each, lambda e: e["closes"] + rest["closes"]).alias("closes"))

    def split(at: Column) -> Column:
        head = F.slice(counts, F.lit(1), F.when(at > 0, at).otherwise(F.size(counts)))
        tail = F.when(at > 0, F.slice(counts, at + 1, F.size(counts))).otherwise(F.slice(counts, 1, 0))
        return F.struct(at.alias("at"), head.alias("head"), tail.alias("tail"))

    at = F.array_position(F.transform(counts, lambda n: n >= least), True).cast("int")
    return let(let(at, split), lambda x: let(F.transform(states, lambda s: run(x["head"], s)), lambda each: let(run(x["tail"], F.lit(0)), lambda rest: both(x, each, rest))))


def _pieces(text: str, waits: int, unit: int, paragraph: int, at: int, least: int, most: int, separator: str) -> dict:
    """The units that lie within a block, cut up, and its parts of those that lie across its borders."""
    data, done, crossing = text.encode(), [], []
    began, from_before = (0, True) if waits else (None, False)  # where what waits begins
    for p in _paragraphs(text, separator):
        began = p.start if began is None else began
        n = _count(p.text)
        waits += n
        if waits >= least:
            if from_before:
                crossing.append({"unit": unit, "closes": True, "paragraph": paragraph, "text": data[: p.end].decode(), "byte_start": at})
            else:
                done += _cut_up(data[began : p.end].decode(), at + began, paragraph, most)
            began, from_before, waits, unit = None, False, 0, unit + 1
        paragraph += 1
    if began is not None:
        crossing.append({"unit": unit, "closes": False, "paragraph": None, "text": data[began:].decode(), "byte_start": at + began})
    return {"done": done, "open": crossing}


def _cut_up(text: str, at: int, paragraph: int, most: int) -> list[dict]:
    """The chunks of one unit, which begins at byte `at`."""
    data, n = text.encode(), _count(text)
    spans = [(0, len(data), n)] if n <= most else _packed(text, most)
    return [{"paragraph": paragraph, "text": own, "byte_start": at + a, "byte_end": at + b, "token_count": _count(own)} for a, b, _ in spans for own in [data[a:b].decode()]]


def chunks_of_blocks(blocks: DataFrame, key: str, order: str, text: str, least: int = LEAST, most: int = MOST, separator: str = "\n\n", fan: int = 256) -> DataFrame:
    """key and the fields of CHUNK for each chunk of each key's text, which is its blocks in order with the
    separator between two: those that `chunks` gives for the whole text, wherever it is cut into blocks.

    blocks has key, order (unique within a key, neither null) and text; further columns are left out. A
    block that is null counts as empty, as does one of white space; keys of such blocks alone
    have no chunks, nor has an empty frame. One paragraph, and one chunk, must fit a task; a text need not.
    """
    given = blocks.select(F.col(key).alias("k"), F.col(order).alias("o"), F.coalesce(text, F.lit("")).alias("t"))
    words = F.transform(F.split("t", _quoted(separator)), lambda p: F.size(F.filter(F.split(p, _BLANK), lambda w: w != "")))
    measures = let(words, lambda n: F.struct(_table(n, least).alias("table"), F.size(F.filter(n, lambda x: x > 0)).cast("long").alias("paragraphs")))
    size = (F.octet_length("t") + len(separator.encode())).cast("long")
    values = given.select("k", "o", measures.alias("m"), size.alias("size")).select("k", "o", F.struct("m.table", "m.paragraphs", "size").alias("v"))

    def apply(state: Column, v: Column) -> Column:
        here = lambda name: F.get(v["table"][name], state["waits"])
        return F.struct(here("to").alias("waits"), (state["unit"] + here("closes")).alias("unit"), (state["paragraph"] + v["paragraphs"]).alias("paragraph"), (state["at"] + v["size"]).alias("at"))

    def compose(a: Column, b: Column) -> Column:
        to = F.transform(a["table"]["to"], lambda s: F.get(b["table"]["to"], s))
        closes = F.zip_with(a["table"]["to"], a["table"]["closes"], lambda s, c: c + F.get(b["table"]["closes"], s))
        return F.struct(F.struct(to.alias("to"), closes.alias("closes")).alias("table"), (a["paragraphs"] + b["paragraphs"]).alias("paragraphs"), (a["size"] + b["size"]).alias("size"))

    zero = F.lit(0).cast("long")
    start = F.struct(F.lit(0).alias("waits"), zero.alias("unit"), zero.alias("paragraph"), zero.alias("at"))
    states = cut(before_each(values, "k", "o", F.col("v"), start, apply, compose, fan))
    rows = states.count()

    @F.arrow_udf(_PIECES)
    def pieces(texts: pa.Array, waits: pa.Array, units: pa.Array, paragraphs: pa.Array, places: pa.Array) -> pa.Array:
        return in_slices(lambda *row: _pieces(*row, least, most, separator), _PIECE, texts, waits, units, paragraphs, places, rows=16)

    @F.arrow_udf("array<struct<paragraph:long,text:string,byte_start:long,byte_end:long,token_count:int>>")
    def cut_up(texts: pa.Array, places: pa.Array, paragraphs: pa.Array, closed: pa.Array) -> pa.Array:
        # what waits at the end is one chunk
        return in_slices(lambda t, a, p, c: _cut_up(t.rstrip(), a, int(p), most if c else max(least, most)), _DONE, texts, places, paragraphs, closed, rows=16)

    known = given.join(broadcast_if_small(states, rows), ["k", "o"])
    held = cut(known.select("k", "o", pieces("t", "before.waits", "before.unit", "before.paragraph", "before.at").alias("p")))
    # a unit has a row in each block that it touches, of which fewer than `least` hold words
    across = held.select("k", "o", F.inline("p.open")).groupBy("k", "unit")
    across = across.agg(F.array_sort(F.collect_list(F.struct("o", "text", "byte_start"))).alias("run"), F.max("paragraph").alias("paragraph"), F.bool_or("closes").alias("closes"))
    joined = across.select("k", F.element_at("run", -1)["o"].alias("o"), "closes", F.array_join(F.transform("run", lambda x: x["text"]), separator).alias("t"), F.col("run")[0]["byte_start"].alias("at"), F.coalesce("paragraph", zero).alias("paragraph"))
    joined = cut(joined.select("k", "o", "closes", cut_up("t", "at", "paragraph", "closes").alias("done")))
    closed = joined.where("closes").select("k", "o", F.size("done").alias("first"))  # a block ends one unit of its forerunners at most
    sizes = cut(held.select("k", "o", F.size("p.done").alias("own")).join(closed, ["k", "o"], "left").select("k", "o", "own", F.coalesce("first", F.lit(0)).alias("first")))
    before = sums_before(sizes, "k", "o", F.col("own") + F.col("first"), fan)
    numbers = cut(sizes.join(before, ["k", "o"]))
    number = lambda frame: frame.join(broadcast_if_small(numbers, rows), ["k", "o"])
    within = number(held.select("k", "o", F.posexplode("p.done").alias("i", "c"))).select("k", (F.col("before") + F.col("first") + F.col("i")).alias("n"), F.col("c.paragraph").alias("paragraph"), "c")
    bound = number(joined.select("k", "o", "closes", F.posexplode("done").alias("i", "c")))
    nth = F.col("before") + F.when(F.col("closes"), F.col("i")).otherwise(F.col("first") + F.col("own") + F.col("i"))
    bound = bound.select("k", nth.alias("n"), F.when(F.col("closes"), F.col("c.paragraph")).otherwise(nth).alias("paragraph"), "c")
    # six digits at least
    name = lambda letter, n: F.concat(F.lit(letter), F.when(F.col(n) < 1_000_000, F.lpad(F.col(n).cast("string"), 6, "0")).otherwise(F.col(n).cast("string")))
    out = within.unionByName(bound)
    return out.select(F.col("k").alias(key), name("c", "n").alias("chunk_id"), name("p", "paragraph").alias("paragraph_id"), F.lit(None).cast("string").alias("section_id"), "c.text", "c.byte_start", "c.byte_end", "c.token_count")


def _quoted(separator: str) -> str:
    return "".join(f"\\x{{{ord(c):x}}}" for c in separator)


def paragraph_offsets(docs: DataFrame, id_col: str, text: Column, separator: str = "\n\n") -> DataFrame:
    """pos, paragraph, byte_start and byte_end of each non-blank paragraph, without Python."""
    split = docs.select(id_col, F.posexplode(F.split(text, separator)).alias("pos", "part"))
    wide = len(separator.encode())
    before = Window.partitionBy(id_col).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    placed = split.withColumn("at", F.coalesce(F.sum(F.octet_length("part") + wide).over(before), F.lit(0)))
    bare = trim(F.col("part"))
    lead = F.octet_length("part") - F.octet_length(F.regexp_replace("part", r"(?U)^\s+", ""))
    out = placed.withColumn("paragraph", bare).withColumn("byte_start", F.col("at") + lead)
    return out.where(F.col("paragraph") != "").select(id_col, "pos", "paragraph", "byte_start", (F.col("byte_start") + F.octet_length("paragraph")).alias("byte_end"))


def containing_chunk(chunked: DataFrame, points: DataFrame, key: str) -> DataFrame:
    """points (key, at) with the chunk whose span holds the offset, "" if none."""
    found = holding(points.select(key, "at"), chunked.select(key, "byte_start", "byte_end", "chunk_id"), key, "at", "byte_start", "byte_end")
    return found.select(key, "at", F.coalesce("chunk_id", F.lit("")).alias("chunk_id"))

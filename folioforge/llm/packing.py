"""Packing of documents into token sequences of a fixed length, by bounded-space best fit.

A document is its text's ids and an end id. A longer one is cut into pieces of the whole length,
and its last piece may be shorter; every other document is one piece. Pieces are dealt
by hash over as many tasks as their number of tokens asks for. There they come in waves of `WAVE` pieces by hash, the long
ones of a wave first, so that the short ones fill what these leave. A task places one piece after the other: into
the open sequence that it leaves the least room in, or into a new one if it fits in none. Open
sequences are filed by their free space, and a bit set tells which spaces there are, so that the
least sufficient one is the lowest set bit from the piece's length on. A full sequence is closed at
once; when a new one would be one too many, the fullest is closed. So a task holds at
most `open_bins` sequences' places, whatever it reads, and the sequences that a task leaves partly
filled for want of pieces are few beside those that its share of the tokens fills.

Only ids, lengths and places are dealt, not texts or tokens, unless `with_ids` asks for the pieces' ids.
The order within a task is by hash and then by all of a piece's columns, so that a task
that is run again places the same pieces alike. Null texts are empty: such a document has its end id only.
Null ids are ids like any other; rows that repeat an id are documents of their own. Texts of any
length are encoded whole. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.token_files import _encoder
from folioforge.session import cut

LENGTH, END_ID, OPEN, WAVE = 2048, 0, 2048, 2048

#: Tokens that a task places: 131,072 sequences' worth, so that open ones at its end hardly count.
TOKENS = 1 << 28


class OpenBins:
    """At most `most` open bins of `length`, filed by free space."""

    def __init__(self, length: int = LENGTH, most: int = OPEN):
        self.length, self.most, self.opened, self.count = length, most, 0, 0
        self.spaces, self.by_space = 0, [[] for _ in range(length + 1)]  # a bit for each list that isn't empty

    def _file(self, number: int, free: int) -> None:
        self.by_space[free].append(number)
        self.spaces |= 1 << free
        self.count += 1

    def _take(self, free: int) -> int:
        number = self.by_space[free].pop()
        if not self.by_space[free]:
            self.spaces &= ~(1 << free)
        self.count -= 1
        return number

    def place(self, size: int) -> tuple[int, int]:
        """The number of the bin that a piece goes to, and its offset there."""
        fits = self.spaces >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            number = self._take(free)
        else:
            if self.count >= self.most:
                self._take((self.spaces & -self.spaces).bit_length() - 1)  # the fullest is closed
            number, free = self.opened, self.length
            self.opened += 1
        if free > size:
            self._file(number, free - size)
        return number, self.length - free


def pieces(docs: DataFrame, tokenizer_file: str, length: int = LENGTH, end: int = END_ID, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece, and with with_ids its ids (binary,
    little-endian, 32 bits each)."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer_file)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                rows = batch.slice(at, 2000)
                of, nth, starts, sizes, sums, data = [], [], [], [], [], []
                for k, ids in enumerate(encoder.encode(rows.column(1).to_pylist(), end)):
                    ids = np.frombuffer(ids, encoder.dtype).astype("<u4")
                    for n, start in enumerate(range(0, len(ids), length)):
                        raw = ids[start : start + length].tobytes()
                        of.append(k)
                        nth.append(n)
                        starts.append(start)
                        sizes.append(len(raw) // 4)
                        sums.append(zlib.crc32(raw))
                        if with_ids:
                            data.append(raw)
                columns = [rows.column(0).take(pa.array(of, pa.int64())), pa.array(nth, pa.int32()), *(pa.array(x, pa.int64()) for x in (starts, sizes, sums))]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns, names = [*columns, pa.array(data, pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select(id_col, text_col).mapInArrow(cut_up, schema)


def place(cut_up: DataFrame, length: int = LENGTH, open_bins: int = OPEN, tokens: int = TOKENS, wave: int = WAVE) -> DataFrame:
    """The pieces with sequence_id and offset."""
    cut_up = cut(cut_up)  # encoded once; the sum and the packing read this
    total = cut_up.agg(F.sum("length")).first()[0] or 0
    order = ["__ff_hash", "doc_id", "piece", "ids_crc32"]
    hashed = cut_up.withColumn("__ff_hash", F.xxhash64("doc_id", "piece", "ids_crc32"))
    dealt = hashed.repartition(max(1, -(-total // tokens)), "__ff_hash").sortWithinPartitions(*order).drop("__ff_hash")
    at = dealt.columns.index("length")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, part = OpenBins(length, open_bins), TaskContext.get().partitionId()
        for batch in batches:
            sizes, places = batch.column(at).to_numpy(), np.empty((batch.num_rows, 2), np.int64)
            for k in range(0, len(sizes), wave):
                order = k + np.argsort(-sizes[k : k + wave], kind="stable")
                places[order] = [bins.place(n) for n in sizes[order].tolist()]
            columns = [pa.array((part << 40) + places[:, 0]), pa.array(places[:, 1])]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema.fields)
    return dealt.mapInArrow(packed, f"{fields}, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer_file: str, length: int = LENGTH, end: int = END_ID, open_bins: int = OPEN, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Every piece of docs with its place: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return place(pieces(docs, tokenizer_file, length, end, id_col, text_col, with_ids), length, open_bins)


def sequences(placed: DataFrame) -> DataFrame:
    """sequence_id, n_tokens, ids (binary, little-endian, 32 bits each) and members (offset, length,
    doc_id, piece) of every sequence of pieces placed with their ids; a row holds at most one
    sequence's length."""
    member = F.struct("offset", "length", "doc_id", "piece", "ids")
    grouped = placed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.sort_array(F.collect_list(member)).alias("m"))
    joined = F.aggregate("m", F.lit(b"").cast("binary"), lambda all_, x: F.concat(all_, x["ids"]))
    return grouped.select("sequence_id", "n_tokens", joined.alias("ids"), F.transform("m", lambda x: x.dropFields("ids")).alias("members"))

"""Token ids in Arrow files of equal-length sequences.

A file is in the Arrow IPC file format: record batches of `batch` rows (the last may
have fewer), with the columns `ids` (fixed_size_list<uint16 or uint32>[length]) and
`mask` (fixed_size_list<bool>[length]; false on padding, which only the last row
has). Sequence k of a file is row k % batch of batch k // batch and lies, memory-mapped,
at a computable place: reading it copies nothing. Beside it lies an index in the same
format: doc_id, start (the place of the document's first id among the file's ids) and
n_tokens (end id included). Files hold consecutive ranges of ascending doc_id.

Texts are encoded by the given tokenizers file, without special tokens; strings of
special tokens within a text are ordinary text. If the file's own normaliser and
pre-tokeniser are those of NORMALIZER and SPLITTER (they drop white space, never join
across it, lower-case, and split a comma or full stop from a letter before it), a text's
ids are its white-space-separated words' ids in a row, and words seen before come from a
bounded memo; a test holds this against encoding whole texts. With any other file whole
texts are encoded.

A task writes files under names of its own attempt and returns these names; the names that Spark
took as the task's result are the files that count, and are listed in the manifest beside
them. So a task that is run again, after a lost executor or beside a slow one, leaves no
mixture of files; what other attempts wrote is removed. There are as many files as the
texts' bytes ask for. Rows are dealt by id, size, hash of the text and place, so that
many rows of one id are dealt over tasks like any others. Ids may be of any type that
orders. Null texts are empty: such a document has its end id only. Null ids come first. Rows
that repeat an id follow one another by size, then by hash. An empty table gives no rows.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from folioforge.session import cut, remove_path, scratch

END_ID = 1
LENGTH = 2048
BATCH = 64


#: Text bytes of a file at most, and at least where there are cores to use.
FILE_BYTES, LEAST_BYTES = 256 << 20, 8 << 20

# The parts of a tokenizers file with which words may be encoded one by one.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLITTER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def _ends_in_letter(word: bytes) -> bool:
    last = word.decode("utf-8", "surrogatepass")[-1]
    return last.isalpha() and ord(last) < 0x250  # letters in any version of Unicode


class TextEncoder:
    """Encodes whole texts."""

    def __init__(self, file: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.tokenizer.encode_special_tokens = True
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def encode(self, texts: list[str | None], end: int = END_ID) -> Iterator[bytes]:
        """Each text's ids and the end id, as bytes of self.dtype."""
        stop = np.array([end], self.dtype).tobytes()
        for text in texts:
            yield np.array(self._ids(text or ""), self.dtype).tobytes() + stop


class WordEncoder(TextEncoder):
    """Encodes texts word by word with a memo of at most 2 * `most` words."""

    BREAK = "¤"  # its ids mark the ends of words that are encoded together

    def __init__(self, file: str, most: int = 500_000):
        super().__init__(file)
        self.most, self.young, self.old = most, {}, {}
        self.mark = np.array(self._ids(self.BREAK), self.dtype)

    @staticmethod
    def fits(file: str) -> bool:
        """Whether the file's words can be encoded one by one."""
        with open(file, encoding="utf-8") as f:
            told = json.load(f)
        return told.get("normalizer") == NORMALIZER and told.get("pre_tokenizer") == SPLITTER and all(x.get("special") for x in told.get("added_tokens", []))

    def _together(self, words: list[str]) -> Iterator[bytes]:
        """The ids of each word."""
        for at in range(0, len(words), 1000):
            some = words[at : at + 1000]
            flat = np.array(self._ids(f" {self.BREAK} ".join(some)), self.dtype)
            n = len(self.mark)
            hits = np.flatnonzero(np.logical_and.reduce([flat[k : len(flat) - n + 1 + k] == self.mark[k] for k in range(n)])) if len(flat) >= n else np.empty(0, np.int64)
            if len(hits) != len(some) - 1:
                yield from (np.array(self._ids(w), self.dtype).tobytes() for w in some)
                continue
            data, size = flat.tobytes(), self.dtype.itemsize
            starts, ends = [0, *((hits + n) * size).tolist()], [*(hits * size).tolist(), len(data)]
            yield from (data[a:b] for a, b in zip(starts, ends))

    def _new(self, words: list[bytes]) -> None:
        """Puts the ids of words into the memo."""
        cores, tails = {}, {}
        for w in words:
            if w[-1:] in (b",", b".") and len(w) > 1 and (w[-2:-1].isalpha() or w[-2] > 127 and _ends_in_letter(w[:-1])):
                tails[w] = (w[:-1], w[-1:])
            else:
                cores[w] = w.decode("utf-8", "surrogatepass")
        for part in {p for pair in tails.values() for p in pair} - self.young.keys() - cores.keys():
            if (ids := self.old.get(part)) is not None:
                self.young[part] = ids
            else:
                cores[part] = part.decode("utf-8", "surrogatepass")
        plain = [w for w, text in cores.items() if self.BREAK not in text]
        self.young.update(zip(plain, self._together([cores[w] for w in plain])))
        for w, text in cores.items():
            if self.BREAK in text:
                self.young[w] = np.array(self._ids(text), self.dtype).tobytes()
        for w, (core, tail) in tails.items():
            self.young[w] = self.young[core] + self.young[tail]

    def encode(self, texts: list[str | None], end: int = END_ID) -> Iterator[bytes]:
        stop = np.array([end], self.dtype).tobytes()
        split = [(t or "").encode("utf-8", "surrogatepass").lower().split() for t in texts]
        if len(self.young) > self.most:
            self.old, self.young = self.young, {}
        flat = list(chain.from_iterable(split))
        found = list(map(self.young.get, flat))
        gaps = [i for i, ids in enumerate(found) if ids is None]
        if gaps:
            missing = []
            for w in dict.fromkeys(map(flat.__getitem__, gaps)):
                if (ids := self.old.get(w)) is not None:
                    self.young[w] = ids
                else:
                    missing.append(w)
            self._new(missing)
            for i in gaps:
                found[i] = self.young[flat[i]]
        at = 0
        for words in split:
            yield b"".join(found[at : at + len(words)]) + stop
            at += len(words)


_encoders: dict[str, TextEncoder] = {}


def _encoder(file: str) -> TextEncoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    if file not in _encoders:
        _encoders[file] = WordEncoder(file) if WordEncoder.fits(file) else TextEncoder(file)
    return _encoders[file]


class SequenceWriter:
    """Packs ids into rows of equal length and writes them batch by batch."""

    def __init__(self, sink, dtype: np.dtype, length: int = LENGTH, batch: int = BATCH):
        self.length, self.batch, self.dtype, self.held, self.total = length, batch, dtype, bytearray(), 0
        self.schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(dtype), length)), ("mask", pa.list_(pa.bool_(), length))])
        self.writer = pa.ipc.new_file(sink, self.schema)

    def add(self, ids: bytes) -> None:
        self.held += ids
        self.total += len(ids) // self.dtype.itemsize
        step = self.length * self.batch * self.dtype.itemsize
        while len(self.held) >= step:
            self._write(np.frombuffer(bytes(self.held[:step]), self.dtype), self.length * self.batch)
            del self.held[:step]

    def _write(self, flat: np.ndarray, real: int) -> None:
        mask = np.arange(len(flat)) < real
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (flat, mask)]
        self.writer.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))

    def close(self) -> None:
        rest = np.frombuffer(bytes(self.held), self.dtype)
        if len(rest):
            padded = np.zeros(-(-len(rest) // self.length) * self.length, self.dtype)
            padded[: len(rest)] = rest
            self._write(padded, len(rest))
        self.writer.close()


class Sequences:
    """Random access to the sequences of a file; views of the mapped file, no copies."""

    def __init__(self, uri: str):
        fs, path = pyarrow.fs.FileSystem.from_uri(uri)
        source = pa.memory_map(path) if isinstance(fs, pyarrow.fs.LocalFileSystem) else fs.open_input_file(path)
        self.reader = pa.ipc.open_file(source)
        self.length = self.reader.schema.field("ids").type.list_size
        self.batch = self.reader.get_batch(0).num_rows if self.reader.num_record_batches else 1

    def flat(self, k: int) -> np.ndarray:
        """The ids of batch k in a row."""
        return self.reader.get_batch(k).column(0).flatten().to_numpy(zero_copy_only=True)

    def __getitem__(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        rows = self.reader.get_batch(k // self.batch)
        at = k % self.batch
        ids = rows.column(0).flatten().to_numpy(zero_copy_only=True)[at * self.length : (at + 1) * self.length]
        return ids, rows.column(1)[at].values.to_numpy(zero_copy_only=False)

    def __len__(self) -> int:
        n = self.reader.num_record_batches
        return 0 if not n else (n - 1) * self.batch + self.reader.get_batch(n - 1).num_rows

    def slices(self, spans: Iterator[tuple[int, int]]) -> Iterator[list[np.ndarray]]:
        """For ascending (start, count): views that hold those ids in order."""
        step, at, flat = self.length * self.batch, -1, np.empty(0)
        for start, count in spans:
            parts = []
            while count:
                if start // step != at:
                    at = start // step
                    flat = self.flat(at)
                part = flat[start % step : start % step + count]
                parts.append(part)
                start, count = start + len(part), count - len(part)
            yield parts


def _files(docs: DataFrame, text_col: str) -> int:
    """How many files the texts' bytes ask for."""
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    cores = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return max(1, -(-total // FILE_BYTES), min(cores, total // LEAST_BYTES))


def write_tokens(docs: DataFrame, path: str, tokenizer_file: str, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", end: int = END_ID) -> DataFrame:
    """Writes docs as token files under path (a URI). Returns the manifest: file (a number), ids and
    index (the files' names) and tokens, a row a file in order."""
    id_type = to_arrow_type(docs.schema[id_col].dataType)
    schema = pa.schema([("doc_id", id_type), ("start", pa.int64()), ("n_tokens", pa.int64())])

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer_file)
        part, own = TaskContext.get().partitionId(), uuid.uuid4().hex
        fs, folder = pyarrow.fs.FileSystem.from_uri(path)
        fs.create_dir(folder, recursive=True)
        names = (f"ids-{part:06d}-{own}.arrow", f"index-{part:06d}-{own}.arrow")
        start = 0
        with fs.open_output_stream(f"{folder}/{names[0]}") as ids_out, fs.open_output_stream(f"{folder}/{names[1]}") as index_out:
            writer, index = SequenceWriter(ids_out, encoder.dtype, length), pa.ipc.new_file(index_out, schema)
            for batch in batches:
                for at in range(0, batch.num_rows, 2000):
                    rows = batch.slice(at, 2000)
                    counts = []
                    for ids in encoder.encode(rows.column(1).to_pylist(), end):
                        writer.add(ids)
                        counts.append(len(ids) // encoder.dtype.itemsize)
                    starts = start + np.cumsum([0, *counts[:-1]])
                    index.write_batch(pa.RecordBatch.from_arrays([rows.column(0).cast(id_type), pa.array(starts, pa.int64()), pa.array(counts, pa.int64())], schema=schema))
                    start += sum(counts)
            writer.close()
            index.close()
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([names[0]]), pa.array([names[1]]), pa.array([start], pa.int64())], names=["file", "ids", "index", "tokens"])

    order = [F.col(id_col), F.octet_length(text_col).alias("__ff_size"), F.xxhash64(text_col).alias("__ff_hash"), F.spark_partition_id().alias("__ff_place")]
    keys = [id_col, "__ff_size", "__ff_hash", "__ff_place"]
    ordered = docs.select(text_col, *order).repartitionByRange(_files(docs, text_col), *keys).sortWithinPartitions(*keys)
    files = cut(ordered.select(id_col, text_col).mapInArrow(written, "file int, ids string, index string, tokens long"))
    files.write.mode("overwrite").json(f"{path}/manifest")
    fs, folder = pyarrow.fs.FileSystem.from_uri(path)
    counted = {x for r in files.select("ids", "index").toLocalIterator() for x in r}  # two names a file
    for info in fs.get_file_info(pyarrow.fs.FileSelector(folder)):
        if info.base_name.endswith(".arrow") and info.base_name not in counted:
            fs.delete_file(info.path)
    return files


def read_tokens(spark: SparkSession, path: str, id_type: str = "long") -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, read back from the files that the
    manifest under path names."""
    files = spark.read.schema("file int, ids string, index string, tokens long").json(f"{path}/manifest")
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    based = files.select("file", "ids", "index", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))  # a row a file

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = pyarrow.fs.FileSystem.from_uri(path)
        for batch in batches:
            for ids, index_name, base in zip(*(batch.column(i).to_pylist() for i in range(3))):
                sequences = Sequences(f"{path}/{ids}")
                with pa.ipc.open_file(fs.open_input_file(f"{folder}/{index_name}")) as index:
                    for k in range(index.num_record_batches):
                        rows = index.get_batch(k)
                        spans = zip(rows.column(1).to_pylist(), rows.column(2).to_pylist())
                        sums = []
                        for views in sequences.slices(spans):
                            crc = 0
                            for view in views:
                                crc = zlib.crc32(view.astype("<u4").tobytes(), crc)
                            sums.append(crc)
                        starts = pa.array(np.asarray(rows.column(1)) + base, pa.int64())
                        yield pa.RecordBatch.from_arrays([rows.column(0), starts, rows.column(2), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    spread = based.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "file").select("ids", "index", "base")
    return spread.mapInArrow(read, f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer_file: str, length: int = LENGTH) -> DataFrame:
    """Writes docs as token files in the shared folder, reads them back, and removes them."""
    spark = docs.sparkSession
    path = scratch(spark, "tokens")
    try:
        write_tokens(docs, path, tokenizer_file, length)
        return cut(read_tokens(spark, path, docs.schema["doc_id"].dataType.simpleString()))
    finally:
        remove_path(spark, path)

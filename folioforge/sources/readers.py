"""Sources and sinks of the corpus: catalogue, RDF, EPUB, XHTML, JSONL, lexicon, phrases,
themes, evaluation queries, packed vectors."""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zipfile
import zlib
import xml.etree.ElementTree as ElementTree
from collections.abc import Iterator
from functools import reduce
from urllib.parse import quote, unquote

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from folioforge.operators.catalogue import rdf_translators
from folioforge.session import cut, of_files, tasks_of_files

CATALOGUE = {"Text#": "book_id", "Type": "type", "Title": "title", "Language": "language", "Authors": "authors", "Subjects": "subjects", "LoCC": "locc", "Bookshelves": "bookshelves"}


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """A catalogue CSV, columns found by name; a missing column or a bad id fails."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("mode", "FAILFAST").csv(path)
    if missing := [c for c in CATALOGUE if c not in raw.columns]:
        raise ValueError(f"the catalogue lacks {', '.join(missing)}")
    return raw.select(*[F.col(f"`{c}`").cast("int").alias(n) if n == "book_id" else F.col(c).alias(n) for c, n in CATALOGUE.items()])


#: Rows and characters that leave a task at once.
ROWS, CHARS = 256, 1 << 20


def _uri(path: str) -> str:
    return re.sub(r"^file:/+", "file:///", path).replace("s3a://", "s3://", 1)


def _entries(uri: str) -> Iterator[tuple[str, bool]]:
    """URI of each file and folder in a folder, and whether it is a folder; those that Spark's readers pass over are left out."""
    fs, place = pyarrow.fs.FileSystem.from_uri(uri)
    if isinstance(fs, pyarrow.fs.LocalFileSystem):
        with os.scandir(place) as found:
            every = ((e.name, e.is_dir()) for e in found)
            yield from ((f"{uri}/{quote(name)}", folder) for name, folder in every if name[0] not in "._")
    else:
        every = ((i.base_name, i.type == pyarrow.fs.FileType.Directory) for i in fs.get_file_info(pyarrow.fs.FileSelector(place)))
        yield from ((f"{uri}/{quote(name)}", folder) for name, folder in every if name[0] not in "._")


def _listed_by_tasks(path: str) -> bool:
    """Whether path is a folder that tasks can list: no pattern, no file, and in a file system that Arrow opens."""
    if re.search(r"[*?\[\]{}]", path):
        return False
    try:
        fs, place = pyarrow.fs.FileSystem.from_uri(_uri(path))
        return fs.get_file_info(place).type == pyarrow.fs.FileType.Directory
    except (pa.ArrowException, OSError, ValueError):
        return False


def files_under(spark: SparkSession, path: str) -> DataFrame:
    """path of every file in a folder and the folders below it. Tasks list them, a folder each, so that the driver holds none of
    the files; it does for other places (a pattern, or a file system that Arrow doesn't open), which Spark lists."""
    if not _listed_by_tasks(path):
        return of_files(spark.read.format("binaryFile").load(path).select("path"))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), (pa.string(), pa.bool_()))], names=["path", "folder"])
        rows = []
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                for entry in _entries(folder):
                    rows.append(entry)
                    if len(rows) == 10_000:
                        yield of(rows)
                        rows = []
        if rows:
            yield of(rows)

    found, folders, tasks = [], spark.createDataFrame([(_uri(path).rstrip("/"),)], "path string"), tasks_of_files(spark)
    while True:
        level = cut(folders.mapInArrow(listed, "path string, folder boolean"))
        found.append(level.where("not folder").select("path"))
        if not (n := level.where("folder").count()):
            return reduce(DataFrame.unionAll, found).repartition(tasks)
        folders = level.where("folder").select("path").repartition(min(n, tasks))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """name (a URI) and value (the text) of the files under path, a row a file."""
    if not _listed_by_tasks(path):
        return of_files(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("name"), "value"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], names=["name", "value"])
        rows, chars = [], 0
        for batch in batches:
            for file in batch.column(0).to_pylist():
                with _opened(file) as source:
                    rows.append((file, source.read().decode("utf-8", "replace")))
                chars += len(rows[-1][1])
                if len(rows) >= ROWS or chars >= CHARS:
                    yield of(rows)
                    rows, chars = [], 0
        if rows:
            yield of(rows)

    return files_under(spark, path).mapInArrow(read, "name string, value string")


def read_rdf(spark: SparkSession, path: str) -> DataFrame:
    """book_id (from the file name) and translators (null if unreadable), a row a file."""
    files = read_texts(spark, path)
    return files.select(F.regexp_extract("name", r"pg(\d+)\.rdf", 1).try_cast("int").alias("book_id"), rdf_translators("value").alias("translators"))


_DAMAGED = (KeyError, StopIteration, RuntimeError, ValueError, zipfile.BadZipFile, ElementTree.ParseError, struct.error, zlib.error, OSError)


def spine(book: zipfile.ZipFile) -> Iterator[str | None]:
    """The entries of an EPUB's spine in order; null for an item that the package doesn't list. Of the archive only its
    directory, the container and the package file are read."""
    local = lambda e: e.tag.rpartition("}")[2]
    container = ElementTree.fromstring(book.read("META-INF/container.xml"))
    root = next(e.get("full-path") for e in container.iter() if local(e) == "rootfile")
    package = ElementTree.fromstring(book.read(root))
    folder = root.rpartition("/")[0]
    hrefs = {e.get("id"): e.get("href") for e in package.iter() if local(e) == "item"}
    for ref in (e.get("idref") for e in package.iter() if local(e) == "itemref"):
        name = unquote(hrefs.get(ref) or "")
        yield (f"{folder}/{name}" if folder else name) if name else None


def entry(source, offset: int, packed: int, method: int, crc: int) -> bytes:
    """The bytes of an archive's entry, by its place; its own header tells where they begin."""
    source.seek(offset)
    head = source.read(30)
    signature, names = struct.unpack("<4s22xHH", head)[0], struct.unpack("<HH", head[26:30])
    if signature != b"PK\x03\x04" or method not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
        raise zipfile.BadZipFile("no entry here, or one packed otherwise")
    source.seek(offset + 30 + sum(names))
    data = source.read(packed)
    data = zlib.decompress(data, -15) if method == zipfile.ZIP_DEFLATED else data
    if zlib.crc32(data) != crc:
        raise zipfile.BadZipFile("the entry differs from its checksum")
    return data


def _opened(path: str):
    fs, place = pyarrow.fs.FileSystem.from_uri(_uri(path))
    return fs.open_input_file(place)


#: Packed bytes that a task reads, about.
TASK_BYTES = 32 << 20


def read_epub(spark: SparkSession, path: str, task_bytes: int = TASK_BYTES, books: DataFrame | None = None) -> DataFrame:
    """book_id, item, html and ok of every spine item of the EPUBs at path, in spine order; an archive
    that can't be read gives one row that isn't ok, and so does an item that can't. With books (book_id) only the
    archives of these are opened.

    Archives of any size: their directories are read by range, and then items, which are dealt over tasks by their
    packed sizes whatever archive they are in. No archive is held whole, only an item."""
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
    names = ["path", "book_id", "item", "place", "packed", "method", "crc"]

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = []
            for file in batch.column(0).to_pylist():
                number = re.search(r"(\d+)\.epub", file)
                book_id, rows = int(number[1]) if number else None, []
                try:
                    with _opened(file) as source, zipfile.ZipFile(source) as book:
                        there = {i.filename: i for i in book.infolist()}
                        for k, name in enumerate(spine(book)):
                            i = there.get(name)
                            rows.append((file, book_id, k, i and i.header_offset, i and i.compress_size, i and i.compress_type, i and i.CRC))
                except _DAMAGED:
                    rows = [(file, book_id, 0, None, None, None, None)]  # a damaged archive, or one without a container or package file
                every += rows
                if len(every) >= ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*every), kinds)], names=names)
                    every = []
            if every:
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*every), kinds)], names=names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, source, rows, chars = None, None, [], 0
        of = lambda: pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), (pa.int32(), pa.int32(), pa.string(), pa.bool_()))], names=["book_id", "item", "html", "ok"])
        for batch in batches:
            for file, book_id, item, place, packed, method, crc in zip(*(c.to_pylist() for c in batch.columns)):
                html = None
                if place is not None:
                    try:
                        if file != held:
                            held, source = file, _opened(file)
                        html = entry(source, place, packed, method, crc).decode("utf-8")
                    except _DAMAGED:
                        pass
                rows.append((book_id, item, html, html is not None))
                chars += len(html or "")
                if len(rows) >= ROWS or chars >= CHARS:
                    yield of()
                    rows, chars = [], 0
        if rows:
            yield of()

    files = files_under(spark, path)
    if books is not None:
        number = F.regexp_extract("path", r"(\d+)\.epub", 1).try_cast("int")
        wanted = files.withColumn("of", number).join(books.select(F.col("book_id").alias("of")), "of", "left_semi")
        files = wanted.select("path").repartition(tasks_of_files(spark))
    found = cut(files.mapInArrow(listed, "path string, book_id int, item int, place long, packed long, method int, crc long"))
    total = found.agg(F.sum("packed")).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // task_bytes))
    dealt = found.repartition(tasks, "path", F.floor(F.col("place") / task_bytes)).sortWithinPartitions("path", "place")
    return dealt.mapInArrow(read, "book_id int, item int, html string, ok boolean")


def parse_warnings(items: DataFrame) -> DataFrame:
    return items.groupBy("book_id").agg(F.count_if(~F.col("ok")).alias("parse_warnings"))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One record a line; blank lines are passed over, any other that doesn't parse fails."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.from_json("value", StructType.fromDDL(schema), {"mode": "FAILFAST"}).alias("r")).select("r.*")


def write_jsonl(rows: DataFrame, path: str) -> None:
    """One record a line, null fields included, so that what is read is what was written."""
    rows.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def read_whole(spark: SparkSession, path: str) -> DataFrame:
    """The text of each file at path."""
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("text"))


def _scalar(text: str):
    text = text.strip()
    if text[:1] in "\"'" and text[-1:] == text[:1] and len(text) > 1:
        return json.loads(text) if text[0] == '"' else text[1:-1].replace("''", "'")
    if text.startswith("["):
        return [_scalar(x) for x in re.findall(r'"(?:[^"\\]|\\.)*"|\'[^\']*\'|[^,\[\]\s][^,\[\]]*', text[1:-1])]
    return None if text in ("", "~", "null") else text


def lexicon_file(text: str) -> dict:
    """A lexicon file: the subset of YAML of nested maps, lists of maps, and scalars."""
    lines = [(len(x) - len(x.lstrip()), x.strip()) for x in text.splitlines() if x.strip() and not x.lstrip().startswith("#")]

    def block(at: int, indent: int):
        if lines[at][1].startswith("- "):
            out = []
            while at < len(lines) and lines[at][0] == indent and lines[at][1].startswith("- "):
                lines[at] = (indent + 2, lines[at][1][2:].strip())
                value, at = block(at, indent + 2)
                out.append(value)
            return out, at
        found: dict = {}
        while at < len(lines) and lines[at][0] == indent and not lines[at][1].startswith("- "):
            m = re.match(r'("(?:[^"\\]|\\.)*"|\'[^\']*\'|[^:]+):(?:\s+(.*))?$', lines[at][1])
            if not m:
                raise ValueError(f"not understood: {lines[at][1]!r}")
            key, rest, at = _scalar(m[1]), m[2], at + 1
            if rest and re.fullmatch(r"[|>][+-]?", rest):  # a text over several lines
                part = []
                while at < len(lines) and lines[at][0] > indent:
                    part.append(lines[at][1])
                    at += 1
                found[key] = ("\n" if rest[0] == "|" else " ").join(part) + ("" if rest.endswith("-") else "\n")
            elif rest:
                found[key] = _scalar(rest)
            elif at < len(lines) and (lines[at][0] > indent or lines[at][1].startswith("- ") and lines[at][0] == indent):
                found[key], at = block(at, lines[at][0])
            else:
                found[key] = None
        return found, at

    value, at = block(0, lines[0][0]) if lines else ({}, 0)
    if at < len(lines):
        raise ValueError(f"not understood: {lines[at][1]!r}")
    return value


LEXICON = "file string, entry_ord int, entry_id string, fingerprint string, themes array<string>, author string, title string, tradition string, language string, terms array<struct<english:string,substrate:string,gloss:string,citation:string>>"


def _passages(name: str, text: str) -> list[list]:
    parsed = lexicon_file(text)
    source, rows = parsed["source"], []
    for k, p in enumerate(parsed["passages"] or []):
        terms = [{"english": e, "substrate": t["substrate"], "gloss": t["gloss"], "citation": t.get("citation")} for e, t in (p.get("terms") or {}).items()]
        rows.append([name, k, p["id"], p["fingerprint"], p.get("themes") or [], source.get("author"), source.get("title"), source.get("tradition"), source.get("language"), terms])
    return rows


def _lexicon_files(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.y*ml")
    return files.select(F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1).alias("name"), "value")


def read_lexicon(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """A row for each passage of the YAML files under path, with its terms; files of other kinds
    are not read. One that isn't understood fails if strict, else gives no rows and is in
    refused_lexicon_files."""

    def passages(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for name, text in zip(frame["name"], frame["value"]):
                try:
                    rows += _passages(name, text)
                except (ValueError, KeyError, TypeError, AttributeError) as e:
                    if strict:
                        raise ValueError(f"{name}: {e}") from e
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in LEXICON.split(", ")])

    return _lexicon_files(spark, path).mapInPandas(passages, LEXICON)


def refused_lexicon_files(spark: SparkSession, path: str) -> DataFrame:
    """file and reason of the files under path that aren't understood."""

    def refused(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for name, text in zip(frame["name"], frame["value"]):
                try:
                    _passages(name, text)
                except (ValueError, KeyError, TypeError, AttributeError) as e:
                    rows.append([name, f"{type(e).__name__}: {e}"])
            yield pd.DataFrame(rows, columns=["file", "reason"])

    return _lexicon_files(spark, path).mapInPandas(refused, "file string, reason string")


# The curated phrases and their books, in order.
PHRASES = [
    ("the unexamined life is not worth living", [1656]),
    ("i think therefore i am", [59, 25830]),
    ("cogito ergo sum", [59, 25830]),
    ("the only thing i know is that i know nothing", [1656]),
    ("appearances are not realities", [1497, 1572, 1750]),
]


def phrases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(p, ids, k) for k, (p, ids) in enumerate(PHRASES)], "phrase string, book_ids array<int>, ord int")


def read_themes(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """themes (slug, label, ord), assignments (book_id, themes) and dropped (book_id, reason)."""
    schema = "themes array<struct<slug:string,label:string,order:int>>, assignments array<struct<book_id:int,themes:array<string>>>, dropped array<struct<book_id:int,reason:string>>"
    one = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    rows = lambda c: one.select(F.explode(c).alias("r")).select("r.*")
    return rows("themes").withColumnRenamed("order", "ord"), rows("assignments"), rows("dropped")


QUERIES = "struct<query:string,expected_ids:array<int>,notes:string>"


def read_eval_queries(spark: SparkSession, path: str) -> DataFrame:
    """query_id, kind (phrase, topical, adversarial), query and expected_ids."""
    schema = f"version int, phrase array<{QUERIES}>, topical array<{QUERIES}>, adversarial array<{QUERIES}>"
    one = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    parts = [one.select(F.lit(k).alias("k"), F.lit(kind).alias("kind"), F.posexplode(kind).alias("pos", "q")) for k, kind in enumerate(("phrase", "topical", "adversarial"))]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    none = F.array().cast("array<int>")
    return every.select((F.col("k") * 100_000 + F.col("pos")).cast("long").alias("query_id"), "kind", "q.query", F.coalesce("q.expected_ids", none).alias("expected_ids"))


def read_packed_vectors(spark: SparkSession, path: str, size: int = 384) -> DataFrame:
    """name, chunk_ord and embedding of files of half-precision vectors without a header."""

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                flat = np.frombuffer(content.as_py(), "<f2")
                if len(flat) % size:
                    raise ValueError(f"{name} holds no whole number of vectors")
                n = len(flat) // size
                lists = pa.FixedSizeListArray.from_arrays(pa.array(flat.astype(np.float32)), size).cast(pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), pa.array(np.arange(n)), lists], names=["name", "chunk_ord", "embedding"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(unpacked, "name string, chunk_ord long, embedding array<float>")


def write_packed_vectors(rows: DataFrame, path: str) -> DataFrame:
    """Writes the vectors of rows (book_id, chunk_ord, embedding) as one file a book of half-precision
    numbers in order of chunk_ord, without a header, under path (a URI). Returns book_id, file, vectors
    and bytes. A file appears under its name when it is whole; books are dealt over tasks, and a
    task holds no more than a batch of one."""

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = pyarrow.fs.FileSystem.from_uri(path)
        fs.create_dir(folder, recursive=True)
        book, sink, count, size, out = None, None, 0, 0, []
        own = uuid.uuid4().hex

        def close() -> None:
            if sink is not None:
                sink.close()
                fs.move(f"{folder}/.{own}-{book}", f"{folder}/{book}.f16")
                out.append((book, f"{book}.f16", count, size))

        for batch in batches:
            for name, vector in zip(batch.column(0).to_pylist(), batch.column(1)):
                if name != book:
                    close()
                    book, count, size = name, 0, 0
                    sink = fs.open_output_stream(f"{folder}/.{own}-{book}")
                packed = np.asarray(vector.values, "<f2").tobytes()
                sink.write(packed)
                count, size = count + 1, size + len(packed)
        close()
        yield pa.RecordBatch.from_pylist([dict(zip(("book_id", "file", "vectors", "bytes"), x)) for x in out], pa.schema([("book_id", pa.string()), ("file", pa.string()), ("vectors", pa.int64()), ("bytes", pa.int64())]))

    ordered = rows.select(F.col("book_id").cast("string").alias("book_id"), "chunk_ord", "embedding").repartition("book_id").sortWithinPartitions("book_id", "chunk_ord")
    return cut(ordered.select("book_id", "embedding").mapInArrow(written, "book_id string, file string, vectors long, bytes long"))

"""Sinks of whole files, and fetching of published files."""

from __future__ import annotations

import hashlib
import io
import json
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from folioforge.session import cut


#: Folders for files of which there is one a book.
FOLDERS = 256


def write_files(rows: DataFrame, path: str, folders: int = 1) -> DataFrame:
    """Writes each row (name, content: string or binary) as a file of that name under path (a URI), or, with more than one of
    folders, in the one below it that a hash of the name gives; names are distinct. A file appears under its name when it is
    whole, so a task may run again. Returns name and bytes."""

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = pyarrow.fs.FileSystem.from_uri(path)
        fs.create_dir(folder, recursive=True)
        there = set()
        for batch in batches:
            names, sizes = batch.column(0).to_pylist(), []
            for name, content in zip(names, batch.column(1).to_pylist()):
                of = f"{folder}/{zlib.crc32(name.encode()) % folders:04x}" if folders > 1 else folder
                if folders > 1 and of not in there:
                    fs.create_dir(of, recursive=True)
                    there.add(of)
                own = f"{folder}/.{uuid.uuid4().hex}"
                with fs.open_output_stream(own, compression=None) as sink:
                    sink.write(content)
                fs.move(own, f"{of}/{name}")
                sizes.append(len(content))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64())], names=["name", "bytes"])

    return cut(rows.select("name", F.col("content").cast("binary").alias("content")).mapInArrow(written, "name string, bytes long"))


def _packed(items: list[str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        put = lambda name, text: book.writestr(zipfile.ZipInfo(name), text)  # noqa: E731  without times: the same bytes each time
        put("META-INF/container.xml", '<container><rootfiles><rootfile full-path="book/content.opf"/></rootfiles></container>')
        manifest = "".join(f'<item id="i{k}" href="item%20{k}.xhtml"/>' for k in range(len(items)))
        put("book/content.opf", f"<package><manifest>{manifest}</manifest><spine>{''.join(f'<itemref idref=\"i{k}\"/>' for k in range(len(items)))}</spine></package>")
        for k, item in enumerate(items):
            put(f"book/item {k}.xhtml", item)
    return out.getvalue()


@F.pandas_udf(BinaryType())
def epub(books: pd.Series) -> pd.Series:
    """The bytes of books whose spines have these XHTML items (arrays of texts)."""
    return books.map(lambda items: _packed(list(items)))


def _digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def publish_file(source: bytes, uri: str) -> str:
    """Writes a published file and, beside it, its digest, which is returned."""
    fs, path = pyarrow.fs.FileSystem.from_uri(uri)
    for name, data in ((path, source), (f"{path}.sha256", _digest(source).encode())):
        with fs.open_output_stream(name, compression=None) as sink:
            sink.write(data)
    return _digest(source)


def _read(uri: str) -> bytes:
    fs, path = pyarrow.fs.FileSystem.from_uri(uri)
    with fs.open_input_stream(path, compression=None) as source:
        return source.read()


def fetch_manifest(source: str, target: str) -> tuple[dict, bool]:
    """The manifest at source (a URI, with its digest beside it), and whether it was fetched. It goes to a
    temporary file, is checked, and then takes the place of target. Where the source can't be
    reached, target is read as it is; a manifest that differs from its digest fails and changes nothing."""
    fs, path = pyarrow.fs.FileSystem.from_uri(target)
    try:
        data, said = _read(source), _read(f"{source}.sha256").decode().strip().lower()
    except OSError:
        return json.loads(_read(target)), False
    if _digest(data) != said:
        raise ValueError("the manifest differs from its digest")
    with fs.open_output_stream(f"{path}.partial", compression=None) as sink:
        sink.write(data)
    fs.move(f"{path}.partial", path)
    return json.loads(data), True


def read_checked(cached: str, source: str, sha256: str, most: int = 2) -> bytes:
    """The bytes of a published file: the cached copy if it has the digest, else those at source, which then
    become the cached copy; a stale copy is deleted, and a fetch with a wrong digest is tried once more."""
    fs, path = pyarrow.fs.FileSystem.from_uri(cached)
    if fs.get_file_info(path).type == pyarrow.fs.FileType.File:
        data = _read(cached)
        if _digest(data) == sha256.lower():
            return data
        fs.delete_file(path)
    for _ in range(most):
        data = _read(source)
        if _digest(data) == sha256.lower():
            with fs.open_output_stream(f"{path}.partial", compression=None) as sink:
                sink.write(data)
            fs.move(f"{path}.partial", path)
            return data
    raise ValueError(f"{source} differs from its digest")

"""WARC archives with revisit resolution.

Writing: the headers of all pages (id, address, payload size, SHA-1; no payload) are
shuffled by payload digest, with map-side aggregation, so that a payload that a third
of all pages share is one row a task. Of equal payloads of at least `least` bytes the
page with the largest id is the response; the others become revisit records that
refer to it. Headers are made by the JVM; each task packs records, payloads of
responses with them, one gzip member a record, into archives of some `file_bytes`
bytes (or one record, if that is larger), each with a warcinfo record first. Archives have names of
the task's attempt, and the index, which Spark takes as the tasks' result, says which count:
file, offset and length of each record. What other attempts wrote is removed. Payloads are
shuffled only where the verdicts on pages are too many to be sent to all tasks.

Reading: archives are read as streams, a record at a time, and parsed by Content-Length;
revisits are joined to the responses that they refer to. read_record reads one by its offset.

Ids of pages may be of any type that has a text. Null html is an empty payload; payloads under
`least` bytes are always responses. A null address is written as urn:page:ID. Rows that
repeat an id and its html are each written, with the same fate and a record id of
their own; a null id is written without one. Null ids never are the original unless
all ids of a payload are null. An empty table gives no archive.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.session import broadcast_if_small, cut, remove_path, scratch

END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id: Column, digest: Column, place: Column | None = None) -> Column:
    """A URN that depends on the page and its payload alone, and on the place if one is given."""
    parts = [F.lit("page"), page_id.cast("string"), digest] + ([] if place is None else [place.cast("string")])
    h = F.sha2(F.concat_ws("/", *parts), 256)
    return F.concat(F.lit("urn:uuid:"), F.regexp_replace(F.substring(h, 1, 32), "(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5"))


def resolve_revisits(heads: DataFrame, least: int = 1000) -> DataFrame:
    """What there is to say of heads (page_id, url, payload_bytes, payload_digest, place): a row for
    each page and payload that revisits another's (refers_to and refers_url: the original's id
    and address) or that comes more than once (first: the least place)."""
    pages = heads.groupBy("page_id", "payload_digest", "payload_bytes").agg(F.max("url").alias("url"), F.min("place").alias("first"), F.count(F.lit(1)).alias("copies"))
    originals = (
        pages.where(F.col("payload_bytes") >= least)
        .groupBy("payload_digest", "payload_bytes")
        .agg(F.max(F.struct("page_id", "url")).alias("original"), F.count(F.lit(1)).alias("pages"))
        .where((F.col("pages") > 1) & F.col("original.page_id").isNotNull())
    )
    joined = pages.join(originals.drop("pages"), ["payload_digest", "payload_bytes"], "left")
    other = F.col("original").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original.page_id"))
    joined = joined.withColumn("refers_to", F.when(other, F.col("original.page_id"))).withColumn("refers_url", F.when(other, F.col("original.url")))
    return joined.where(other | (F.col("copies") > 1)).select("page_id", "payload_digest", "refers_to", "refers_url", F.when(F.col("copies") > 1, F.col("first")).alias("first"))


def _records(pages: DataFrame, least: int, date: str) -> DataFrame:
    """head and payload of the record of each row of pages, record_id and record_type."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    full = pages.select(
        "page_id", "url", payload.alias("html"), F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha1(payload.cast("binary")).alias("payload_digest"), F.monotonically_increasing_id().alias("place")
    )
    said = cut(resolve_revisits(cut(full.drop("html")), least))
    said = said.select(F.col("page_id").alias("__ff_id"), F.col("payload_digest").alias("__ff_digest"), "refers_to", "refers_url", "first")
    rows = full.join(broadcast_if_small(said, said.count()), full["page_id"].eqNullSafe(said["__ff_id"]) & (full["payload_digest"] == said["__ff_digest"]), "left")
    again = F.col("refers_to").isNotNull()
    uri = lambda url, page: F.regexp_replace(F.coalesce(url, F.concat(F.lit("urn:page:"), page.cast("string")), F.lit("urn:page:")), r"[\x00-\x20]", "%20")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit(END))
    length = F.octet_length(http) + F.when(again, F.lit(0)).otherwise(F.col("payload_bytes"))
    own = F.when(F.col("first") != F.col("place"), record_id(F.col("page_id"), F.col("payload_digest"), F.col("place"))).otherwise(record_id(F.col("page_id"), F.col("payload_digest")))
    line = lambda name, value: F.concat(F.lit(f"\r\n{name}: "), value)
    optional = lambda name, value: F.coalesce(line(name, value), F.lit(""))
    refers = F.concat(
        line("WARC-Profile", F.lit(PROFILE)),
        line("WARC-Refers-To", F.concat(F.lit("<"), record_id(F.col("refers_to"), F.col("payload_digest")), F.lit(">"))),
        line("WARC-Refers-To-Target-URI", uri(F.col("refers_url"), F.col("refers_to"))),
        line("WARC-Refers-To-Date", F.lit(date)),
    )
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "),
        F.col("record_type"),
        line("WARC-Record-ID", F.concat(F.lit("<"), F.col("record_id"), F.lit(">"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", uri(F.col("url"), F.col("page_id"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        optional("X-Page-Id", F.col("page_id").cast("string")),
        F.when(again, refers).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", length.cast("string")),
        F.lit(END),
        http,
    )
    rows = rows.withColumn("record_type", F.when(again, "revisit").otherwise("response")).withColumn("record_id", own)
    return rows.select(head.cast("binary").alias("head"), F.when(~again, F.col("html").cast("binary")).alias("payload"), "record_id", "record_type")


class _Archive:
    """A file of gzip members, one a record."""

    def __init__(self, fs: pyarrow.fs.FileSystem, folder: str, name: str, date: str):
        self.name, self.sink, self.at = name, fs.open_output_stream(f"{folder}/{name}", compression=None), 0
        info = b"software: folioforge\r\nformat: WARC File Format 1.1\r\n"
        own = uuid.uuid5(uuid.NAMESPACE_URL, name)
        self.add(f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{own}>\r\nWARC-Date: {date}\r\nWARC-Filename: {name}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}{END}".encode(), info)

    def add(self, *parts: bytes) -> tuple[int, int]:
        """Offset and length of the member that is added."""
        packer, start = zlib.compressobj(wbits=31), self.at
        for part in (*parts, END.encode()):
            self.at += self.sink.write(packer.compress(part))
        self.at += self.sink.write(packer.flush())
        return start, self.at - start


INDEX = "file string, offset long, length long, record_id string, record_type string"


def write_warc(pages: DataFrame, path: str, least: int = 1000, date: str = "2024-01-01T00:00:00Z", file_bytes: int = 256 << 20) -> DataFrame:
    """Writes a record for each row of pages (page_id, url, html) into archives under path (a URI).
    Returns INDEX of the records, which is also kept beside the archives."""

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = pyarrow.fs.FileSystem.from_uri(path)
        fs.create_dir(folder, recursive=True)
        part, own, files, archive = TaskContext.get().partitionId(), uuid.uuid4().hex, 0, None
        for batch in batches:
            heads, payloads = batch.column(0), batch.column(1)
            places = []
            for i in range(batch.num_rows):
                if archive is None or archive.at >= file_bytes:
                    if archive:
                        archive.sink.close()
                    archive, files = _Archive(fs, folder, f"part-{part:06d}-{files:04d}-{own}.warc.gz", date), files + 1
                payload = payloads[i].as_buffer()
                places.append((archive.name, *archive.add(heads[i].as_buffer(), *([payload] if payload else []))))
            name, start, size = zip(*places) if places else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(name, pa.string()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), batch.column(2), batch.column(3)], names=[x.split()[0] for x in INDEX.split(", ")])
        if archive:
            archive.sink.close()

    index = cut(_records(pages, least, date).mapInArrow(written, INDEX))
    index.write.mode("overwrite").parquet(f"{path}/index")
    fs, folder = pyarrow.fs.FileSystem.from_uri(path)
    counted = {r["file"] for r in index.select("file").distinct().collect()}  # names of archives
    for info in fs.get_file_info(pyarrow.fs.FileSelector(folder)):
        if info.base_name.endswith(".warc.gz") and info.base_name not in counted:
            fs.delete_file(info.path)
    return index


def _plain(content: Iterable[bytes]) -> Iterator[bytes]:
    """What the pieces of a WARC file hold; of any number of gzip members, or not packed at all."""
    member, packed = None, None
    for piece in content:
        if packed is None and piece:
            packed = piece[:2] == b"\x1f\x8b"
        if not packed:
            yield piece
            continue
        while piece:
            member = member or zlib.decompressobj(31)
            while piece and not member.eof:  # a little packed may be much
                out = member.decompress(piece, 1 << 22)
                piece = member.unconsumed_tail
                if out:
                    yield out
            if member.eof:
                piece, member = member.unused_data, None
    if member:
        raise ValueError("a gzip member of the archive ends too early")


def parse_records(content: bytes | Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """The headers (names in lower case) and the block of each record of a WARC file, whole or in pieces."""
    have, chunks = bytearray(), _plain([content] if isinstance(content, bytes) else content)

    def fill() -> bool:
        got = next(chunks, None)
        if got:
            have.extend(got)
        return got is not None

    while True:
        while have[:2] == b"\r\n" or (len(have) < 2 and fill()):
            if have[:2] == b"\r\n":
                del have[:2]
        if not have:
            return
        seen = 0
        while (end := have.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
            seen = len(have)
            if not fill():
                raise ValueError("a record's headers end too early")
        lines = bytes(have[:end]).decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        stop = end + 4 + int(head["content-length"])
        while len(have) < stop:
            if not fill():
                raise ValueError("a record's block ends too early")
        yield head, bytes(have[end + 4 : stop])
        del have[:stop]


def read_record(uri: str, offset: int) -> tuple[dict[str, str], bytes]:
    """The headers and the block of the record whose member starts at an offset of an archive."""
    fs, path = pyarrow.fs.FileSystem.from_uri(uri)
    with fs.open_input_file(path) as source:
        source.seek(offset)
        return next(parse_records(iter(lambda: source.read(1 << 16), b"")))


_PARSED = "page_id string, record_id string, record_type string, refers_id string, url string, payload_bytes long, payload_digest string, whole boolean, html string"
_SCHEMA = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}[t]) for n, t in (x.split() for x in _PARSED.split(", "))])


def _read(content: Iterable[bytes], payloads: bool, at_once: int = 500, bytes_at_once: int = 1 << 24) -> Iterator[pa.RecordBatch]:
    out: list[dict] = []
    held = 0
    for head, block in parse_records(content):
        if head["warc-type"] not in ("response", "revisit"):
            continue
        http, _, payload = block.partition(b"\r\n\r\n")
        said = next((int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), len(payload))
        digest = head.get("warc-payload-digest", "").removeprefix("sha1:")
        full = head["warc-type"] == "response"
        out.append(
            {
                "page_id": head.get("x-page-id"),
                "record_id": head["warc-record-id"].strip("<>"),
                "record_type": head["warc-type"],
                "refers_id": head["warc-refers-to"].strip("<>") if "warc-refers-to" in head else None,
                "url": head.get("warc-target-uri"),
                "payload_bytes": said,
                "payload_digest": digest,
                "whole": not full or (len(payload) == said and hashlib.sha1(payload).hexdigest() == digest),
                "html": payload.decode("utf-8", "replace") if payloads and full else None,
            }
        )
        held += len(payload) if payloads else 0
        if len(out) >= at_once or held >= bytes_at_once:
            yield pa.RecordBatch.from_pylist(out, _SCHEMA)
            out, held = [], 0
    if out:
        yield pa.RecordBatch.from_pylist(out, _SCHEMA)


def read_warc(spark: SparkSession, path: str, payloads: bool = False, id_type: str = "long") -> DataFrame:
    """A row for each response and revisit of the archives (*.warc.gz, *.warc) under path; whole: its
    payload has the size and the digest that its headers name. html only if asked for, and only of
    responses. The files of the table are only listed by Spark, not read."""

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                fs, own = pyarrow.fs.FileSystem.from_uri(name if "://" in name else name.replace(":/", ":///", 1))
                with fs.open_input_stream(own, compression=None) as source:
                    yield from _read(iter(lambda: source.read(1 << 20), b""), payloads)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{warc,warc.gz}").load(path).select("path")
    found = files.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "path").mapInArrow(parsed, _PARSED)
    return found.withColumn("page_id", F.col("page_id").cast(id_type))


def resolved(records: DataFrame) -> DataFrame:
    """The records with refers_to, the page id of the response that a revisit refers to."""
    responses = records.where(F.col("record_type") == "response").select(F.col("record_id").alias("refers_id"), F.col("page_id").alias("refers_to"))
    checked = F.when(F.col("whole"), F.col("record_type")).otherwise(F.raise_error(F.lit("a payload differs from its headers")).cast("string"))
    out = records.where(F.col("record_type") != "response").join(responses, "refers_id", "left").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    none = F.lit(None).cast(records.schema["page_id"].dataType)
    plain = records.where(F.col("record_type") == "response").select("page_id", "payload_bytes", "payload_digest", checked.alias("record_type"), none.alias("refers_to"))
    return plain.unionByName(out)


def round_trip(pages: DataFrame, least: int = 1000) -> DataFrame:
    """Writes pages into archives in the shared folder, reads them back, and removes them."""
    spark = pages.sparkSession
    path = scratch(spark, "warc")
    try:
        write_warc(pages, path, least)
        return cut(resolved(cut(read_warc(spark, path, id_type=pages.schema["page_id"].dataType.simpleString()).drop("html"))))
    finally:
        remove_path(spark, path)

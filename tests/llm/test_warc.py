import gzip
import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from folioforge.llm import warc

BIG = "<p>" + "x é 日本 " * 200 + "</p>\r\n\r\nWARC/1.1\r\n"
ROWS = [
    (1, "http://a/1", BIG), (2, "http://a/2", BIG), (3, None, BIG), (4, "http://b/ x\r\ny", "small"), (5, "http://b", "small"),
    (6, "http://c", None), (7, "http://c", ""), (8, "http://d", BIG + "!"), (2, "http://a/2", BIG), (None, "http://n", "z" * 1000),
    (None, None, "y" * 999),
]


def brute(rows):
    out, largest = [], {}
    for i, _, h in rows:
        if i is not None:
            largest[h or ""] = max(largest.get(h or "", i), i)
    for i, _, h in rows:
        data = (h or "").encode()
        again = len(data) >= 1000 and (h or "") in largest and i != largest[h or ""]
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", largest[h] if again else None))
    return sorted(out, key=repr)


@pytest.fixture
def pages(spark):
    return spark.createDataFrame(ROWS, "page_id long, url string, html string")


def test_round_trip(pages):
    got = warc.round_trip(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got), key=repr) == brute(ROWS)


def test_clashing_columns_and_empty(spark, pages):
    more = pages.select("*", *[F.lit(1).alias(c) for c in ("refers_to", "payload_digest", "value", "original", "content")])
    assert sorted(map(tuple, warc.round_trip(more).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr) == brute(ROWS)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_payloads_come_back(spark, pages, tmp_path):
    warc.write_warc(pages, f"file://{tmp_path}/w", file_bytes=300)
    got = warc.read_warc(spark, f"file://{tmp_path}/w", payloads=True).collect()
    assert all(r.whole for r in got)
    assert sorted(r.html for r in got if r.record_type == "response") == sorted(["", "", "small", "small", BIG, BIG + "!", "z" * 1000, "y" * 999])
    assert {r.url for r in got if r.page_id == 3} == {"urn:page:3"}


def test_one_member_a_record_at_its_offset(spark, pages, tmp_path):
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "part-000000-0000-dead.warc.gz").write_bytes(b"what a lost attempt wrote")
    index = warc.write_warc(pages.repartition(2), f"file://{tmp_path}/w", file_bytes=600).collect()
    assert len(index) == len(ROWS) == len({r.record_id for r in index})
    names = {r.file for r in index}
    assert len(names) > 2 and names == {x.name for x in (tmp_path / "w").glob("*.warc.gz")}
    assert sorted(tuple(r) for r in index) == sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/w/index").collect())
    for r in index:
        head, block = warc.read_record(f"file://{tmp_path}/w/{r.file}", r.offset)
        assert (head["warc-record-id"], head["warc-type"]) == (f"<{r.record_id}>", r.record_type)
        member = (tmp_path / "w" / r.file).read_bytes()[r.offset : r.offset + r.length]
        assert next(warc.parse_records(gzip.decompress(member)))[1] == block
    for name in names:
        first = next(warc.parse_records((tmp_path / "w" / name).read_bytes()))
        assert (first[0]["warc-type"], first[0]["warc-filename"]) == ("warcinfo", name)


def test_revisits_refer_to_records_that_are_there(spark, pages, tmp_path):
    warc.write_warc(pages, f"file://{tmp_path}/w")
    got = warc.read_warc(spark, f"file://{tmp_path}/w").collect()
    assert len({r.record_id for r in got}) == len(got)
    assert {r.refers_id for r in got if r.record_type == "revisit"} <= {r.record_id for r in got if r.record_type == "response"}


def test_large_payloads(spark, tmp_path):
    """One of 100 MB, and many of 1 MB: more than a batch or a file may hold."""
    rows = spark.range(150).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.concat(F.repeat(F.lit("0123456789abcdef"), F.when(F.col("id") == 7, 6_500_000).otherwise(65_536)), F.col("id").cast("string")).alias("html"))
    index = warc.write_warc(rows.coalesce(2), f"file://{tmp_path}/w", file_bytes=100_000)
    assert index.count() == 150 and index.select("file").distinct().count() > 3
    got = warc.read_warc(spark, f"file://{tmp_path}/w").collect()
    assert len(got) == 150 and all(r.whole for r in got)
    assert {r.page_id: r.payload_bytes for r in got}[7] == 104_000_001


def test_ids_of_other_types(spark):
    rows = spark.createDataFrame([("b", None, "z" * 1000), ("a", None, "z" * 1000)], "page_id string, url string, html string")
    assert {(r.page_id, r.record_type, r.refers_to) for r in warc.round_trip(rows).collect()} == {("b", "response", None), ("a", "revisit", "b")}


RECORD = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x>\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n"


@pytest.mark.parametrize("packing", ["plain", "one", "members"])
def test_other_archives_parse(packing):
    blocks = [b"HTTP/1.1 200 OK\r\n\r\n" + b"q" * n for n in (0, 5, 3_000_000)]
    records = [RECORD % (len(b), b) for b in blocks]
    data = {"plain": b"".join(records), "one": gzip.compress(b"".join(records)), "members": b"".join(map(gzip.compress, records))}[packing]
    assert [b for _, b in warc.parse_records(data)] == blocks


def test_broken_archives_are_refused():
    good = gzip.compress(RECORD % (3, b"abc"))
    with pytest.raises((ValueError, zlib.error)):
        list(warc.parse_records(good[:-12]))
    with pytest.raises(ValueError, match="not a WARC"):
        list(warc.parse_records(b"junk\r\n\r\n"))
    with pytest.raises(ValueError, match="too early"):
        list(warc.parse_records((RECORD % (3, b"abc"))[:-6]))

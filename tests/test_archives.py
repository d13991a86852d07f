"""Archives read by range."""

import os
import zipfile

from folioforge.sources import readers, writers


def rows_of(frame):
    return sorted((r.book_id, r.item, r.html, r.ok) for r in frame.collect())


def test_an_archive_over_two_gb_and_a_damaged_item(spark, tmp_path):
    items = [f"<p>item {k} {'x' * 500}</p>" for k in range(6)]
    data = writers._packed(items)
    large = tmp_path / "pg1.epub"
    with large.open("wb") as f:
        f.seek(2_300_000_000)  # a hole before the archive, which its readers pass over
        f.write(data)
    assert os.path.getsize(large) > 1 << 31
    with zipfile.ZipFile(tmp_path / "pg2.epub", "w", zipfile.ZIP_STORED) as book:
        with zipfile.ZipFile(large) as source:
            for i in source.infolist():
                book.writestr(i.filename, source.read(i.filename))
    stored = (tmp_path / "pg2.epub").read_bytes()
    (tmp_path / "pg2.epub").write_bytes(stored.replace(b"item 3 ", b"ITEM 3 ", 1))
    (tmp_path / "pg3.epub").write_bytes(data[: len(data) // 2])
    (tmp_path / "notes.epub").write_bytes(writers._packed([]))
    got = rows_of(readers.read_epub(spark, f"file://{tmp_path}/*.epub"))
    assert [r for r in got if r[0] == 1] == [(1, k, x, True) for k, x in enumerate(items)]
    assert [r for r in got if r[0] == 2] == [(2, k, x if k != 3 else None, k != 3) for k, x in enumerate(items)]
    assert [r for r in got if r[0] not in (1, 2)] == [(3, 0, None, False)]


def test_items_of_an_archive_are_dealt_over_tasks(spark, tmp_path):
    items = [os.urandom(20_000).hex() for _ in range(40)]
    (tmp_path / "pg9.epub").write_bytes(writers._packed(items))
    frame = readers.read_epub(spark, str(tmp_path), task_bytes=50_000)
    assert [r[2] for r in rows_of(frame)] == items
    parts = frame.selectExpr("spark_partition_id() as p").distinct().count()
    assert parts > 5


def test_items_that_the_package_or_the_archive_lacks(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "pg4.epub", "w") as book:
        book.writestr("META-INF/container.xml", '<c><rootfile full-path="p.opf"/></c>')
        book.writestr("p.opf", '<p><item id="a" href="a.xhtml"/><item id="b" href="none.xhtml"/><itemref idref="b"/><itemref idref="a"/><itemref idref="c"/></p>')
        book.writestr("a.xhtml", "<p>é</p>")
        book.writestr("bad.xhtml", b"\xff")
    assert rows_of(readers.read_epub(spark, str(tmp_path))) == [(4, 0, None, False), (4, 1, "<p>é</p>", True), (4, 2, None, False)]


def test_no_archives(spark, tmp_path):
    (tmp_path / "x").mkdir()
    assert rows_of(readers.read_epub(spark, f"file://{tmp_path}/x")) == []

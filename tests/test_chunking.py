import random

import pytest
from pyspark.sql import functions as F

from folioforge.operators import chunking, folds


def tokens(*counts):
    return "\n\n".join(" ".join("w" for _ in range(n)) for n in counts)


def test_short_paragraphs_are_joined():
    got = chunking.chunk("a b\n\nc\n\nd e", 5, 100)
    assert [(c["chunk_id"], c["paragraph_id"], c["text"], c["token_count"]) for c in got] == [("c000000", "p000002", "a b\n\nc\n\nd e", 5)]


def test_whole_paragraphs_stay():
    assert [c["text"] for c in chunking.chunk("a b c\n\nd e f", 3, 100)] == ["a b c", "d e f"]


def test_long_paragraphs_are_packed_by_sentence():
    text = "One two three four. Five six seven eight. Nine ten eleven twelve. End."
    got = chunking.chunk(text, 3, 10)
    assert [c["text"] for c in got] == ["One two three four. Five six seven eight.", "Nine ten eleven twelve. End."]
    assert all(c["text"].endswith(".") for c in got)
    assert [c["token_count"] for c in chunking.chunk("w " * 40, 3, 10)] == [40]


def test_the_rest_becomes_a_chunk():
    got = chunking.chunk(tokens(60, 3), 50, 512)
    assert [(c["paragraph_id"], c["token_count"]) for c in got] == [("p000000", 60), ("p000001", 3)]
    assert chunking.chunk("", 5, 10) == chunking.chunk(" \n\n ", 5, 10) == []


@pytest.mark.parametrize("seed", range(6))
def test_offsets_cover_the_text(seed):
    rng = random.Random(seed)
    text = "\n\n".join("“" + ". ".join(" ".join(rng.choice(["é", "word", "’tis", "日本"]) for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(1, 12))) + ".” " * rng.randrange(2) for _ in range(20))
    data, at = text.encode(), 0
    for c in chunking.chunk(text, 8, 20):
        assert data[c["byte_start"] : c["byte_end"]].decode() == c["text"]
        assert not data[at : c["byte_start"]].decode().strip()
        at = c["byte_end"]
    assert not data[at:].decode().strip()


def test_frames(spark):
    frame = spark.createDataFrame([(1, "  a b \n\n\n\n é c"), (2, ""), (3, None)], "id int, text string")
    got = chunking.paragraph_offsets(frame, "id", F.col("text")).collect()
    assert [(r.id, r.paragraph, r.byte_start, r.byte_end) for r in got] == [(1, "a b", 2, 5), (1, "é c", 11, 15)]
    spans = frame.select("id", F.explode(chunking.chunks(F.col("text"), 1, 10)).alias("c")).select("id", "c.*")
    points = spark.createDataFrame([(1, 0), (1, 2), (1, 4), (1, 5), (1, 11), (2, 0)], "id int, at long")
    found = chunking.containing_chunk(spans, points, "id").orderBy("id", "at").collect()
    assert [r.chunk_id for r in found] == ["", "c000000", "c000000", "", "c000001", ""]


FIELDS = ["chunk_id", "paragraph_id", "section_id", "text", "byte_start", "byte_end", "token_count"]


def dealt(text, separator, rng, longest):
    """text as blocks of some paragraphs each."""
    parts, out = text.split(separator), []
    while parts:
        n = rng.randrange(1, longest + 1)
        out.append(separator.join(parts[:n]))
        parts = parts[n:]
    return out


def prose(rng, paragraphs, words):
    sentence = lambda: " ".join(rng.choice(["é", "word", "’tis", "日本", "e.g."]) for _ in range(rng.randrange(1, 9))) + rng.choice([". ", "! ", ".” ", " "])
    part = lambda: rng.choice(["", "  ", "\n", "\x1f"]) if rng.random() < 0.3 else rng.choice(["", " "]) + "".join(sentence() for _ in range(rng.randrange(1, words)))
    return "\n\n".join(part() for _ in range(paragraphs))


def test_blocks_give_the_chunks_of_the_whole_text(spark):
    rng, rows, want = random.Random(3), [], []
    for key in range(60):
        # 1 in 5 has no break but those between single words, so that no block resets what waits
        text = "\n\n".join("w" for _ in range(rng.randrange(200))) if key % 5 == 0 else prose(rng, rng.randrange(1, 60), rng.choice([2, 5, 30]))
        want += [(key, *(c[f] for f in FIELDS)) for c in chunking.chunk(text, 9, 21)]
        rows += [(key, 10 * k, block, "clash") for k, block in enumerate(dealt(text, "\n\n", rng, rng.choice([1, 3, 1000])))]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "book int, at int, text string, unit string")
    for fan in (2, 256):
        got = chunking.chunks_of_blocks(frame, "book", "at", "text", 9, 21, fan=fan)
        assert got.columns == ["book", *FIELDS]
        assert sorted(map(tuple, got.collect()), key=lambda r: (r[0], r[1])) == want


def test_one_huge_text_lies_over_all_tasks(spark):
    """A text of 20 MB in blocks: no task gets more than a part of it, and its chunks join to the whole."""
    sentence = "Some words of a sentence that goes on for a while and then ends. "
    blocks = spark.range(400).select(F.lit("one").alias("k"), F.col("id").alias("o"), F.expr(f"array_join(transform(sequence(1, 20), i -> repeat('{sentence}', 1 + cast((id * 7 + i * 3) % 77 as int))), '\n\n')").alias("t"))
    got = chunking.chunks_of_blocks(blocks.repartition(8), "k", "o", "t")
    one = got.agg(F.count("*").alias("n"), F.sum("token_count").alias("words"), F.countDistinct("chunk_id").alias("ids"), F.max("chunk_id").alias("last"), F.max("byte_end").alias("end")).first()
    size = blocks.agg(F.sum(F.octet_length("t")).alias("bytes"), F.sum(F.size(F.expr("filter(split(t, '\\\\s+'), w -> w != '')"))).alias("words")).first()
    assert one.words == size.words and one.n == one.ids and one.last == f"c{one.n - 1:06d}"
    assert one.end == size.bytes + 2 * 399 - 1  # the last blank is trimmed


def test_blocks_without_words(spark):
    frame = spark.createDataFrame([(1, 0, None), (1, 1, " "), (2, 0, ""), (3, 0, None), (3, 1, "a b"), (3, 2, " \n "), (3, 3, None)], "k int, o int, t string")
    got = chunking.chunks_of_blocks(frame, "k", "o", "t", 5, 9).collect()
    assert [(r.k, r.chunk_id, r.paragraph_id, r.text, r.byte_start, r.byte_end) for r in got] == [(3, "c000000", "p000000", "a b", 2, 5)]
    assert chunking.chunks_of_blocks(frame.where("k > 9"), "k", "o", "t").collect() == []


def test_what_waits_at_the_end_is_one_chunk_where_least_is_above_most(spark):
    text = "One two. Three four. Five six."
    frame = spark.createDataFrame([(1, 0, text), (1, 1, "Seven.")], "k int, o int, t string")
    got = [r.text for r in chunking.chunks_of_blocks(frame, "k", "o", "t", 20, 3).collect()]
    assert got == [c["text"] for c in chunking.chunk(text + "\n\nSeven.", 20, 3)] == [text + "\n\nSeven."]


@pytest.mark.parametrize("fan", [1, 2, 7, 256])
def test_folds_in_levels(spark, fan):
    rng = random.Random(fan)
    rows = [(k, o, rng.randrange(-9, 10)) for k, n in enumerate([1, 0, 300, 5]) for o in rng.sample(range(1000), n)]
    got = folds.sums_before(spark.createDataFrame(rows, "k int, o int, x int"), "k", "o", F.col("x"), fan).collect()
    want, sums = {}, {}
    for k, o, x in sorted(rows):
        want[k, o] = sums.get(k, 0)
        sums[k] = want[k, o] + x
    assert {(r.k, r.o): r.before for r in got} == want and len(got) == len(rows)

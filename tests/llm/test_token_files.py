import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tests.llm.conftest import HARD, make, words
from tokenizers import Tokenizer

from folioforge.llm import token_files as T

FILE = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(FILE)
    t.encode_special_tokens = True
    return t


ODD = ["", "Hello, World. it's", "ÉCOLE, École. İstanbul ΣΑΣ", "a,b ... ,. !, 5, 5.", "<|endoftext|> <|ENDOFTEXT|> x<|startoftext|>y", "é, é.  x y", "日本, 𝄞.", "don't, DON'T. 's 'S", "A\x0bB\x0cC\rD\u0085E", words(300, 1)]


def test_words_encode_like_whole_texts(tokenizer):
    encoder = T.WordEncoder(FILE, most=5)
    for _ in range(3):
        for text in ODD:
            want = [*tokenizer.encode(text, add_special_tokens=False).ids, 1]
            assert np.frombuffer(next(encoder.encode([text])), encoder.dtype).tolist() == want, text


def brute(rows, tokenizer):
    """Null ids first; rows of one id by size, then by Spark's hash of the text; null texts are empty."""
    signed = lambda t: 42 if t is None else xxhash.xxh64_intdigest(t.encode(), 42) - (xxhash.xxh64_intdigest(t.encode(), 42) >> 63 << 64)
    out, at = [], 0
    for i, t, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, -1 if r[1] is None else len(r[1].encode()), signed(r[1]))):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        out.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return sorted(out, key=repr)


def rows_of(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


def test_round_trip(spark, tokenizer):
    rows = [(i * 37 % 101, words(i * 3, i) + " Über, alles.", "en", "a") for i in range(101)]
    assert rows_of(T.round_trip(make(spark, rows).repartition(3), FILE, length=16)) == brute(rows, tokenizer)


@pytest.mark.parametrize("name", ["hard", "clashing"])
def test_hard_rows(name, request, tokenizer):
    assert rows_of(T.round_trip(request.getfixturevalue(name), FILE)) == brute(HARD, tokenizer)


def test_any_other_file_encodes_whole_texts(spark):
    file = public_tokenizers.path("byte_bpe_50k.json")
    assert T.WordEncoder.fits(FILE) and not T.WordEncoder.fits(file)
    whole = Tokenizer.from_file(file)
    whole.encode_special_tokens = True
    rows = [(i, t, "en", "a") for i, t in enumerate(ODD)]
    assert rows_of(T.round_trip(make(spark, rows), file)) == brute(rows, whole)


def test_a_third_of_all_rows_may_share_an_id(spark, tokenizer, monkeypatch):
    monkeypatch.setattr(T, "LEAST_BYTES", 100)
    rows = [(None if i % 3 else i, words(5 + i % 7, i % 11), "en", "a") for i in range(300)] + [(None, "same text", "en", "a")] * 200
    frame = make(spark, rows).repartition(6)
    assert rows_of(T.round_trip(frame, FILE, length=16)) == brute(rows, tokenizer)
    assert T._files(frame, "text") == 4


def test_ids_of_other_types(spark, tokenizer):
    frame = spark.createDataFrame([("b", "two words"), ("a", "one"), (None, None)], "doc_id string, text string")
    got = T.round_trip(frame, FILE)
    assert got.schema["doc_id"].dataType.simpleString() == "string"
    assert [(r.doc_id, r.start) for r in got.orderBy("start").collect()] == [(None, 0), ("a", 1), ("b", 3)]


def test_what_other_attempts_wrote_does_not_count(spark, tmp_path, tokenizer):
    rows = [(i, words(9, i), "en", "a") for i in range(20)]
    path = f"file://{tmp_path}/t"
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "ids-000000-dead.arrow").write_bytes(b"half a file")
    files = T.write_tokens(make(spark, rows), path, FILE).collect()
    assert {x.name for x in (tmp_path / "t").iterdir()} == {"manifest"} | {x for r in files for x in (r["ids"], r["index"])}
    assert rows_of(T.read_tokens(spark, path)) == brute(rows, tokenizer)


def test_empty(empty):
    assert T.round_trip(empty, FILE).count() == 0


def test_random_access_copies_nothing(spark, tmp_path, tokenizer):
    rows = [(i, words(40, i), "en", "a") for i in range(60)]
    path = f"file://{tmp_path}/t"
    files = T.write_tokens(make(spark, rows), path, FILE, length=8).collect()
    flat = [np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 1]) for _, t, *_ in rows]
    seen = []
    for r in sorted(files):
        s = T.Sequences(f"{path}/{r.ids}")
        got = [s[k] for k in range(len(s))]
        assert all(len(ids) == len(mask) == 8 for ids, mask in got)
        assert not any(ids.flags.owndata for ids, _ in got)
        assert all(mask.all() for _, mask in got[:-1])
        own = [ids[mask] for ids, mask in got]
        assert sum(map(len, own)) == r.tokens
        seen += own
    assert np.array_equal(np.concatenate(seen), np.concatenate(flat))

"""Packing against the tokens of whole texts."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tests.llm.conftest import HARD, make, words
from tokenizers import Tokenizer

from folioforge.llm import packing

FILE = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def ids_of():
    t = Tokenizer.from_file(FILE)
    t.encode_special_tokens = True
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 0]


def wanted(rows, ids_of, length):
    out = []
    for i, text, *_ in rows:
        ids = np.array(ids_of(text), "<u4")
        for k, at in enumerate(range(0, len(ids), length)):
            out.append((i, k, at, len(ids[at : at + length]), zlib.crc32(ids[at : at + length].tobytes())))
    return sorted(out, key=repr)


def check_places(rows, length):
    """No gap, no overlap, nothing beyond the end."""
    of = defaultdict(list)
    for r in rows:
        of[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in of.values():
        end = 0
        for offset, size in sorted(places):
            assert offset == end
            end += size
        assert end <= length
    return len(of)


@pytest.mark.parametrize("name", ["hard", "clashing"])
def test_hard_rows(name, request, ids_of):
    rows = packing.pack(request.getfixturevalue(name), FILE, length=64).collect()
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows), key=repr) == wanted(HARD, ids_of, 64)
    check_places(rows, 64)


def test_empty(empty):
    assert packing.pack(empty, FILE).collect() == []


def test_few_sequences_and_repeatable(spark):
    rng = random.Random(5)
    docs = make(spark, [(i, words(rng.randint(1, 150), i), "en", "a") for i in range(1500)])
    first, again = (sorted(map(tuple, packing.pack(docs.repartition(n), FILE, length=512).collect())) for n in (3, 3))
    assert first == again
    rows = packing.pack(docs, FILE, length=512).collect()
    assert check_places(rows, 512) <= 1.03 * -(-sum(r["length"] for r in rows) // 512) + 1


def test_tasks_share_the_pieces(spark):
    """More tokens than a task places: more tasks, each with sequences of its own."""
    docs = make(spark, [(i % 3, words(40, i), "en", "a") for i in range(900)])  # a third of the rows has one id
    rows = packing.place(packing.pieces(docs, FILE, 128), 128, tokens=5_000).collect()
    parts = defaultdict(int)
    for r in rows:
        parts[r["sequence_id"] >> 40] += 1
    assert len(parts) > 5 and max(parts.values()) < 3 * len(rows) / len(parts)
    check_places(rows, 128)


def brute_place(sizes, length, most):
    """Every open bin is looked at."""
    free, out, opened = {}, [], 0
    for n in sizes:
        fits = [f for f in free.values() if f >= n]
        if fits:
            tightest = min(fits)
        elif len(free) >= most:
            fullest = min(free.values())
            del free[next(k for k, f in free.items() if f == fullest)]
        if not fits:
            free[opened], tightest = length, length
            opened += 1
        number = next(k for k, f in free.items() if f == tightest)
        free[number] -= n
        out.append(tightest)
        if not free[number]:
            del free[number]
    return out, opened


@pytest.mark.parametrize("most", [1, 3, 50])
def test_best_fit(most):
    """The spaces that pieces go into are those of a search over all open bins."""
    rng = random.Random(most)
    sizes = [rng.randint(1, 100) for _ in range(2000)]
    bins = packing.OpenBins(100, most)
    spaces = []
    for n in sizes:
        _, offset = bins.place(n)
        spaces.append(100 - offset)
        assert bins.count <= most
        assert bins.count == sum(map(len, bins.by_space)) and all(bool(x) == bool(bins.spaces >> k & 1) for k, x in enumerate(bins.by_space))
    assert (spaces, bins.opened) == brute_place(sizes, 100, most)


def test_sequences_hold_the_documents(spark, hard, ids_of):
    placed = packing.pack(hard, FILE, length=128, with_ids=True)
    found = []
    for r in packing.sequences(placed).collect():
        ids = np.frombuffer(r["ids"], "<u4")
        assert len(ids) == r["n_tokens"] <= 128
        found += [(m["doc_id"], m["piece"], m["length"], zlib.crc32(ids[m["offset"] : m["offset"] + m["length"]].tobytes())) for m in r["members"]]
    assert sorted(found, key=repr) == sorted(((i, k, n, c) for i, k, _, n, c in wanted(HARD, ids_of, 128)), key=repr)

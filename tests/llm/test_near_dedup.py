import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm.conftest import make, words

import corpus_pipeline
from folioforge.llm import near_dedup, simhash


def grams(text):
    w = (text or "").lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}


def brute(rows):
    """The id of each row's component, by all pairs."""
    sets, label = [grams(t) for _, t, *_ in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and label[i] != label[j]:
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    return {rows[i][0]: rows[c][0] for i, c in enumerate(label)}


def planted():
    """Groups of texts with one to nine changed words, a passage that all hold, and short texts."""
    rng, rows, common = random.Random(11), [], words(12, 99)
    for g in range(8):
        base = words(120, 50 + g, 5000).split()
        for k in range(9):
            own = list(base)
            for at in rng.sample(range(len(own)), k):
                own[at] = f"new{rng.randrange(10**6)}"
            rows.append((100 * g + k, " ".join(own) + " " + common, "en", "a"))
    rows += [(1000 + i, common if i % 2 else f"{common} x{i}", "en", "a") for i in range(12)]
    return rows + [(2000 + i, t, "en", "a") for i, t in enumerate(["one two", "One  two", "one", "two", ""])]


def test_all_similar_pairs_are_linked(spark):
    rows = planted()
    want = brute(rows)
    got = {r.doc_id: r.component_id for r in near_dedup.near_copies(make(spark, rows)).collect()}
    assert got == want
    assert len(set(want.values())) < len(rows)


def test_the_stage_drops_copies_beyond_three_bits(spark):
    rows = planted()
    docs, prints = make(spark, rows), {i: simhash.fingerprint(t) for i, t, *_ in rows}
    want = brute(rows)
    assert any((prints[i] ^ prints[c]).bit_count() > 3 for i, c in want.items())
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()} == set(want.values())


@pytest.mark.parametrize("large", [256, 8])
def test_candidates_of_parts_are_complete(large):
    rng = np.random.default_rng(3)
    group, size, part = rng.integers(0, 4, 60), rng.integers(8, 14, 60), rng.integers(0, 5, 60)
    node = np.arange(60)
    got = {p for a, b in near_dedup.candidates(group, size, node, np.zeros((60, 4), np.uint64), part, large) for p in zip(a.tolist(), b.tolist())}
    fits = lambda i, j: group[i] == group[j] and part[i] != part[j] and 5 * min(size[i], size[j]) >= 4 * max(size[i], size[j])
    assert got == {(i, j) for i in range(60) for j in range(i + 1, 60) if fits(i, j)}


@pytest.mark.parametrize("large", [256, 8])
def test_candidates_within_reach_are_complete(large):
    rng = np.random.default_rng(4)
    group, size, part = rng.integers(0, 4, 200), rng.integers(20, 40, 200), rng.integers(0, 5, 200)
    size[group == 3] = 30
    far, node = near_dedup.reach(size, np.where(group == 3, 5, rng.integers(0, 9, 200))), np.arange(200)
    order = np.argsort(group, kind="stable")
    useful = np.empty(200, bool)
    useful[order] = near_dedup.of_use(group[order], size[order], far[order], 8)
    assert not useful.all()
    keep = np.flatnonzero(useful)
    got = {p for a, b in near_dedup.candidates(group[keep], size[keep], node[keep], np.zeros((len(keep), 4), np.uint64), part[keep], large, far[keep]) for p in zip(a.tolist(), b.tolist())}
    fits = lambda i, j: group[i] == group[j] and part[i] != part[j] and 5 * min(size[i], size[j]) >= 4 * max(size[i], size[j]) and size[i] <= far[j] and size[j] <= far[i]
    want = {(i, j) for i in range(200) for j in range(i + 1, 200) if fits(i, j)}
    assert got == want and len(want) > 100


def test_reach_never_cuts_a_link():
    """Sets that are just linked: each is within the other's reach where their first shared element lies."""
    rng, seen = np.random.default_rng(6), 0
    for _ in range(2000):
        n = int(rng.integers(1, 120))
        base = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        gone, new = rng.integers(0, len(base) // 5 + 1), rng.integers(0, len(base) // 5 + 2)
        other = np.unique(np.concatenate((base[gone:], rng.integers(0, 1 << 63, new).astype(np.uint64))))
        if near_dedup.similar(base, other):
            a, b = (near_dedup.prefix(x, base[:0], np.empty(0, np.int64)).tolist() for x in (base, other))
            first = next(x for x in a if x in set(b))
            places = np.array([a.index(first), b.index(first)])
            far = near_dedup.reach(np.array([len(base), len(other)]), places)
            assert len(other) <= far[0] and len(base) <= far[1]
            seen += 1
    assert seen > 500


def pages(n, own, key):
    """Texts of one template of 105 words with so many words of their own in one place."""
    shape = words(105 - own, key, 5000).split()
    return [(i, " ".join([*shape[:40], *(f"own{i}x{k}" for k in range(own)), *shape[40:]]), "en", "a") for i in range(n)]


@pytest.mark.parametrize("own", [13, 18])
def test_pages_of_a_template_make_hardly_any_pairs(spark, monkeypatch, own):
    """Every page shares elements of its prefix with every other, and is no copy of it."""
    counts, candidate_pairs = [], near_dedup._candidate_pairs

    def counted(members, parted):
        out = candidate_pairs(members, parted)
        counts.append(out.count())
        return out

    monkeypatch.setattr(near_dedup, "_candidate_pairs", counted)
    n = 600
    rows = pages(n, own, 77)
    near = [(n + k, t.replace(f"own{k}x0 ", "other "), "en", "a") for k, (_, t, *_) in enumerate(rows[:9])]
    got = {r.doc_id: r.component_id for r in near_dedup.near_copies(make(spark, rows + near)).collect()}
    assert got == {i: i for i in range(n)} | {n + k: k for k in range(9)}
    assert max(counts) <= 60, counts


def test_parities_never_refuse_a_link():
    rng = np.random.default_rng(5)
    for n in (1, 2, 9, 40, 300, 3000):
        base = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        other = np.unique(np.concatenate((base[n // 9 :], rng.integers(0, 1 << 63, n // 12).astype(np.uint64))))
        bits = np.frombuffer(near_dedup.parities(base) + near_dedup.parities(other), np.uint64).reshape(2, -1)
        assert near_dedup.similar(base, other)
        assert near_dedup.verdict(near_dedup.wide_parities(base), len(base), near_dedup.wide_parities(other), len(other))
        size = np.array([len(base), len(other)])
        assert [len(a) for a, _ in near_dedup.candidates(np.zeros(2, int), size, np.arange(2), bits, None)] == [1]


def test_verdicts_agree_with_the_sets():
    rng, seen = np.random.default_rng(8), set()
    for k in range(3000):
        n = int(rng.integers(1, 1500))
        base = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        gone, new = rng.integers(0, len(base) // 4 + 1, 2)
        other = np.unique(np.concatenate((base[gone:], rng.integers(0, 1 << 63, new + 1).astype(np.uint64))))
        said = near_dedup.verdict(near_dedup.wide_parities(base), len(base), near_dedup.wide_parities(other), len(other))
        assert said in (-1, int(near_dedup.similar(base, other)))
        seen.add(said)
    assert seen == {-1, 0, 1}


def test_shingles_of_batches_and_of_single_texts():
    texts = [words(n, n) for n in (0, 1, 4, 5, 6, 300, 70_000, 140_000, 3)] + [None, "A b\tC d e", "a B c D E"]
    sets = list(near_dedup.shingle_sets(texts))
    assert [len(x) for x in sets] == [len(grams(t)) for t in texts]
    for t, x in zip(texts, sets):
        assert np.array_equal(next(near_dedup.shingle_sets([t])), x)
    assert np.array_equal(sets[-1], sets[-2]) and sets[0].tolist() == sets[9].tolist()


def test_empty_and_clashes(empty, clashing):
    assert near_dedup.drop_similar(empty).count() == 0
    out = near_dedup.drop_similar(clashing)
    assert out.columns == clashing.columns
    assert out.where(F.col("doc_id").isNull()).count() == 2

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tests.llm.conftest import HARD, make, words

from folioforge.llm import simhash
from folioforge.llm.components import connected_components


def brute_print(text):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    ones = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g, 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(grams))


def brute_components(prints):
    label = list(range(len(prints)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 3:
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_fingerprints(hard):
    got = simhash.near_duplicates(hard).collect()
    want = sorted((str(i), f"{brute_print(t):016x}") for i, t, *_ in HARD)
    assert sorted((str(r.doc_id), r.fingerprint) for r in got) == want


def test_fingerprint_in_pieces():
    text = words(5000, 3)
    assert simhash.fingerprint(text, at_once=100) == simhash.fingerprint(text) == brute_print(text)


def test_near_copies_form_components(spark):
    rng, rows = random.Random(5), []
    for g in range(6):
        base = words(600, g, 10_000).split()
        for k in range(8):
            own = list(base)
            own[rng.randrange(len(own))] = f"changed{k % 4}"
            rows.append((100 * g + k, " ".join(own), "en", "a"))
    prints = [brute_print(t) for _, t, *_ in rows]
    want = {rows[i][0]: rows[c][0] for i, c in enumerate(brute_components(prints))}
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(make(spark, rows)).collect()}
    assert got == want
    assert len(set(got.values())) < len(rows) / 2
    stay = {r.doc_id for r in simhash.drop_near_copies(make(spark, rows)).collect()}
    assert stay == set(want.values())


def planted(n, seed):
    rng = random.Random(seed)
    base = [rng.getrandbits(64) for _ in range(n)]
    near = [x ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(5))) for x in base]
    low = [(base[0] & ~0xFFFF) | rng.getrandbits(12) for _ in range(n)]
    return sorted(set(base + [x % (1 << 64) for x in near] + low))


@pytest.mark.parametrize("depth", [1, 16, 28, 37])
def test_trie_join_finds_all_pairs_of_a_root(depth):
    values, seen = np.array(planted(120, depth), np.uint64), {}
    got = {(min(a, b), max(a, b)) for i, j in simhash.trie_join(values, depth, at_once=50, seen=seen) for a, b in zip(i.tolist(), j.tolist())}
    assert seen["down"] > 0 and seen["pruned"] > 0
    want = {
        (a, b)
        for a in range(len(values))
        for b in range(a + 1, len(values))
        if int(values[a]) >> (64 - depth) == int(values[b]) >> (64 - depth) and bin(int(values[a]) ^ int(values[b])).count("1") <= 3
    }
    assert got == want


@pytest.mark.parametrize("most", [50_000, 3])
def test_links_lose_nothing_at_any_level(spark, most):
    values = planted(150, 7)
    frame = spark.createDataFrame([(int(np.uint64(v).view(np.int64)),) for v in values], "fp long")
    edges = simhash.links(frame, most_in_trie=most)
    found = {r.node: r.component for r in connected_components(edges).collect()}
    label = brute_components(values)
    signed = [int(np.uint64(v).view(np.int64)) for v in values]
    groups, got = {}, {}
    for v, c in zip(signed, label):
        groups.setdefault(c, set()).add(v)
        got.setdefault(found.get(v, v), set()).add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, got.values()))


def test_node_pairs_go_down_on_the_whole_table(spark):
    """Every link comes out of the descent, which does take place on these data."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    prints = [r.fp for r in simhash.fingerprints(docs).select("fp").distinct().collect()]
    fps, linked, seen = np.array(prints, np.int64).view(np.uint64), set(), {}
    for block in range(4):
        values = np.sort(simhash.arrange(fps, [block]))
        order = np.argsort(simhash.arrange(fps, [block]))
        for i, j in simhash.trie_join(values, 16, seen=seen):
            linked |= {tuple(sorted(x)) for x in zip(fps[order[i]].tolist(), fps[order[j]].tolist())}
    assert seen["down"] > 1_000 and seen["pruned"] > 0 and seen["single"] > 1_000
    want = set()
    for k in range(len(fps)):
        near = np.flatnonzero(np.bitwise_count(fps[k + 1 :] ^ fps[k]) <= simhash.BUDGET)
        want |= {tuple(sorted((int(fps[k]), int(fps[k + 1 + m])))) for m in near}
    assert linked == want


@pytest.mark.parametrize("rows", [1, 7])
def test_tasks_read_root_after_root(spark, rows, monkeypatch):
    values = [int(np.uint64(v).view(np.int64)) for v in planted(100, 9)]
    frame = spark.createDataFrame([(v,) for v in values], "fp long")
    whole = {tuple(r) for r in connected_components(simhash.links(frame)).collect()}
    monkeypatch.setattr(simhash, "ROWS", rows)
    assert {tuple(r) for r in connected_components(simhash.links(frame)).collect()} == whole


def test_arrange_moves_blocks_to_the_front():
    fp = np.array([0x0123456789ABCDEF], np.uint64)
    assert f"{int(simhash.arrange(fp, [1])[0]):016x}" == "4567012389abcdef"
    assert f"{int(simhash.arrange(fp, [3, 0])[0]):016x}" == "cdef0123456789ab"
    assert f"{int(simhash.arrange(fp, [3, 1])[0]):016x}" == "cdef345" + "012" + "6789ab"


def test_components_of_a_chain_and_a_star(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(7, 7)], "a long, b long")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + k: 100 for k in range(30)}


def test_empty_and_clashes(empty, clashing):
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.drop_near_copies(empty).count() == 0
    out = simhash.drop_near_copies(clashing)
    assert out.columns == clashing.columns
    assert out.where(F.col("doc_id").isNull()).count() == 2

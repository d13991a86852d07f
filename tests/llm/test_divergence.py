"""The audit against counts of every term in every group."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from tests.llm.conftest import HARD, make

from folioforge.llm import divergence


def brute(rows, least, top=50):
    docs = [(lang or "", source or "", re.findall(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").encode().lower())) for _, text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        seen = Counter(t for d in mine for t in set(d[2]))
        kept = sorted(t for t, n in seen.items() if n >= least)
        counts = defaultdict(Counter)
        for _, s, terms in mine:
            counts[s].update(t for t in terms if seen[t] >= least)
            counts[None].update(t for t in terms if seen[t] >= least)
        p = {s: {t: 1 + 10**9 * (counts[s][t] + 5) // (sum(counts[s].values()) + 5 * len(kept)) for t in kept} for s in counts}
        for s in counts.keys() - {None}:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in counts.keys() - {None, s}]
            terms = [(p[s][t] - p[None][t], t) for t in kept if counts[s][t] and p[s][t] > p[None][t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                for rank, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1]))[:most], 1):
                    out.append((lang, s, part, item.decode(), value, rank))
    return sorted(out)


def rows_of(frame):
    return sorted(map(tuple, frame.collect()))


def mixed(seed, n=400):
    rng = random.Random(seed)
    pool = ["the", "They", "thé", "théâtre", "Über", "über", "日本", "日本語", "a", "ab", "abc", "abd", "don", "t", "𝄞x"]
    out = []
    for i in range(n):
        source = rng.choice(["s1", "s1", "s1", "s2", "s3", None, "sü"])
        own = pool[len(source or "") :: 2] if rng.random() < 0.5 else pool
        out.append((i, rng.choice([" ", "1", "-", "'"]).join(rng.choice(own) for _ in range(rng.randrange(40))), rng.choice(["en", "de", None, ""]), source))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_all_groups(spark, seed):
    rows = mixed(seed)
    assert rows_of(divergence.audit(make(spark, rows).repartition(5))) == brute(rows, 30)
    assert rows_of(divergence.audit(make(spark, rows).repartition(5), least=2, top=3)) == brute(rows, 2, 3)


@pytest.mark.parametrize("least", [1, 30])
@pytest.mark.parametrize("name", ["hard", "clashing"])
def test_hard_rows(name, least, request):
    assert rows_of(divergence.audit(request.getfixturevalue(name), least=least)) == brute(HARD, least)


def test_empty(empty):
    assert rows_of(divergence.audit(empty)) == []


def test_small_blocks_and_tries_change_nothing(spark, monkeypatch):
    """Tries are emptied over and over, blocks hold few terms, sources are compared some at a time."""
    rows = mixed(3)
    monkeypatch.setattr(divergence, "CELLS", 8)
    monkeypatch.setattr(divergence, "BLOCK", 7)
    assert rows_of(divergence.audit(make(spark, rows).repartition(2), least=3)) == brute(rows, 3)
    flat = lambda x: sorted((r["lang"], r["term"], r["docs"], sorted(zip(r["sources"], r["counts"]))) for r in x.collect() if r["term"])
    small = divergence.term_counts(make(spark, rows).repartition(2), least=3, staged=10, ranges=9)
    assert flat(small) == flat(divergence.term_counts(make(spark, rows), least=3, ranges=1))


def test_a_very_long_text_and_a_hot_source(spark):
    rows = [(1, "word other " * 100_000, "en", "a")] + [(i, "word " + "xy"[i % 2] * (i % 5 + 1), "en", "hot" if i % 3 else "a") for i in range(300)]
    assert rows_of(divergence.audit(make(spark, rows))) == brute(rows, 30)


def test_tries_merge_and_pack():
    rng = random.Random(4)
    tries, want, docs = [], Counter(), Counter()
    for _ in range(3):
        by, seen = {b"s": Counter(), b"t": Counter()}, Counter()
        for _ in range(500):
            term, source = bytes(rng.choices(b"ab\xc3", k=rng.randrange(9))), rng.choice([b"s", b"t"])
            by[source][term] += 2
            want[term, source] += 2
            seen[term] += 1
        docs.update(seen)
        trie = divergence.Trie.counted(seen, by)
        half = len(trie.terms) // 2
        tries += [divergence.Trie.unpack(*trie.pack(a, b)) for a, b in ((0, half), (half, len(trie.terms)))]
    whole = divergence.Trie.merged(tries)
    assert whole.terms == sorted(docs) and whole.docs.tolist() == [docs[t] for t in whole.terms]
    assert {(whole.terms[k], whole.names[s]): n for k, s, n in zip(whole.leaf, whole.source, whole.n)} == dict(want) and len(whole.n) == len(want)


def test_shares_are_exact():
    rng = random.Random(6)
    for total in (0, 7, 10**6, 9 * 10**15 - 500):
        counts = [rng.randrange(total + 1) for _ in range(50)]
        got = divergence.shares(np.array(counts), total, 100)
        assert got.tolist() == [1 + 10**9 * (c + 5) // (total + 500) for c in counts]

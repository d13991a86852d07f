"""Containment of many patterns against looking for each."""

import random

import pytest
from pyspark.sql import functions as F

from folioforge.operators import containment, grounding, search


def frames(spark, texts, patterns):
    return spark.createDataFrame(texts, "key long, text string"), spark.createDataFrame(patterns, "number long, pattern string")


def random_case(seed):
    rng = random.Random(seed)
    texts = [(i, "".join(rng.choices("ab é", k=rng.randrange(60)))) for i in range(200)] + [(200, None), (201, ""), (0, "abab"), (None, "aaaa")]
    patterns = [(k, "".join(rng.choices("ab é", k=rng.randrange(1, 6)))) for k in range(60)] + [(3, "ab"), (70, None)]
    return texts, patterns


def brute(texts, patterns):
    least = {}
    for n, p in patterns:
        if p is not None:
            least[p] = min(n, least.get(p, n))
    return sorted(((k, n, p) for k, t in texts if t is not None for p, n in least.items() if p in t), key=repr)


@pytest.mark.parametrize("chars", [20, 2_000_000])
def test_all_and_first(spark, chars):
    texts, patterns = random_case(1)
    t, p = frames(spark, texts, patterns)
    want = brute(texts, patterns)
    assert sorted(map(tuple, containment.matches(t, p, chars=chars).collect()), key=repr) == want
    keyed = t.where("key > 0")
    least = {k: min((n, p) for k2, n, p in want if k2 == k) for k in {w[0] for w in want} if k}
    first = containment.matches(keyed, p, first=True, chars=chars).groupBy("key").agg(F.min(F.struct("number", "pattern")).alias("m")).collect()
    assert {r["key"]: tuple(r["m"]) for r in first} == least


def test_an_empty_pattern_and_no_pattern(spark):
    t, p = frames(spark, [(1, "x"), (2, ""), (3, None)], [(5, ""), (6, "x")])
    assert sorted(map(tuple, containment.matches(t, p).collect())) == [(1, 5, ""), (1, 6, "x"), (2, 5, "")]
    assert containment.matches(t, p.limit(0)).collect() == [] and containment.matches(t.limit(0), p).collect() == []


def test_many_fingerprints_without_a_nested_loop(spark):
    """200,000 fingerprints; each passage holds some, and the first by order is kept."""
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    prints = [f"{word()} {word()} {word()}" for _ in range(200_000)]
    passages = [(i, f"X{i}  {prints[rng.randrange(200_000)].upper()}\n{prints[rng.randrange(200_000)]} end") for i in range(500)]
    lexicon = spark.createDataFrame([(f"e{k}", k, x) for k, x in enumerate(prints)], "entry_id string, ord int, fingerprint string")
    found = grounding.lexicon_match(spark.createDataFrame(passages, "passage_id long, text string"), lexicon)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    place = {}
    for k, x in enumerate(prints):
        place.setdefault(x, k)
    for r in found.collect():
        words = r["text"].lower().split()
        held = [place[" ".join(words[a : a + 3])] for a in range(len(words) - 2) if " ".join(words[a : a + 3]) in place]
        assert r["entry_id"] == f"e{min(held)}"


PHRASES = [("The Rights", [1], 3), ("all the rights reserved", [2], 1), ("reserved", [3], 2), ("...", [4], 0), ("a b c", [5], 7)]
ASKED = ["all rights", "the rights", "THE RIGHTS of", "reserved!", "rights reserved", "reserve", "", None, "b", "b c", "a c", "x all the rights reserved y", "a b c d"]


@pytest.mark.parametrize("mode", ["strict", "compat"])
def test_guard_as_by_each_phrase(spark, mode):
    form = lambda x: " ".join("".join(c if c.isalnum() else " " for c in x.lower()).split())
    want = {}
    for k, q in enumerate(ASKED):
        if q is None:
            continue
        q = form(q)
        hits = []
        for phrase, books, ord_ in PHRASES:
            p = form(phrase)
            if mode == "compat" and (p in q or q in p) or mode == "strict" and q and (f" {p} " in f" {q} " or f" {q} " in f" {p} "):
                hits.append((ord_, books))
        if hits:
            want[k] = min(hits)[1]
    queries = spark.createDataFrame(list(enumerate(ASKED)), "query_id long, query string")
    got = search.guard(queries, spark.createDataFrame(PHRASES, "phrase string, book_ids array<int>, ord int"), mode)
    assert {r["query_id"]: r["book_ids"] for r in got.collect()} == want

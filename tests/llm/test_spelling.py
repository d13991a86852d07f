"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest
from tests.llm.conftest import HARD, make

from folioforge.llm import spelling


def occurrences(rows):
    for i, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{low}".encode())
            if h % 97 == 0:
                low = low[: h % len(low)] + low[h % len(low) + 1 :]
            yield low


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(rows):
    n = {w: c for w, c in Counter(occurrences(rows)).items() if len(w) >= 5 and c >= 3}
    around = {w: [v for v in n if near(w, v)] for w in n}
    best = {w: min(a, key=lambda v: (-n[v], v)) for w, a in around.items() if a}
    form = {w: v for w, v in best.items() if n[v] >= 2 * n[w]}
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(around[w]), n[form[w]] if w in form else None))
    return sorted(out, key=repr)


def rows_of(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


def misspelt(seed, docs=120):
    """Texts over few stems with letters changed, added and dropped."""
    rng = random.Random(seed)
    stems = ["language", "colour", "aaaaa", "aaaaaa", "Écoles", "straße", "banana"]
    out = []
    for i in range(docs):
        words = []
        for _ in range(60):
            w = rng.choice(stems)
            if rng.random() < 0.5:
                k = rng.randrange(len(w))
                w = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("aeou") + w[k:], w[:k] + rng.choice("aeoÿ") + w[k + 1 :]])
            words.append(rng.choice([w, w.upper(), w.capitalize()]))
        out.append((i, "-".join(words), "en", "a"))
    return [*out, (docs, "wordone " * 40 + "wordonx " * 16 + "worconx " * 6, "en", "a")]  # a chain


@pytest.mark.parametrize("seed", [1, 2])
def test_all_pairs(spark, seed):
    rows = misspelt(seed)
    want = brute(rows)
    assert any(r[1] and r[2] != r[1] for r in want)  # chains of forms
    assert rows_of(spelling.spelling_variants(make(spark, rows).repartition(3))) == want


@pytest.mark.parametrize("name", ["hard", "clashing"])
def test_hard_rows(name, request):
    assert rows_of(spelling.spelling_variants(request.getfixturevalue(name))) == brute(HARD)


def test_empty(empty):
    assert rows_of(spelling.spelling_variants(empty)) == []


def test_ties_repeats_and_null_ids(spark):
    rows = [(None, "cellar Cellar CELLAR collar collar collar callar callar callar dollar", "en", "a"), (1, "dollar", "en", "a"), (1, "dollar", "en", "a")]
    assert rows_of(spelling.spelling_variants(make(spark, rows))) == brute(rows)


def test_long_words(spark):
    """Beyond LONG letters groups go by digests; a word may be near one on the other side of that length."""
    base = "abcdefgh" * 8  # as long as LONG
    other = base[:30] + "z" + base[31:]
    longer, more = base + "b", base + "c"
    rows = [(i, " ".join([base] * 8 + [other] * 3 + [longer] * 2 + [more]), "en", "a") for i in range(3)]
    want = brute(rows)
    assert len(want) == 4 and sum(r[4] for r in want) == 8
    assert rows_of(spelling.spelling_variants(make(spark, rows))) == want


def test_a_long_text_of_one_run(spark):
    rows = [(1, "y" * 200_000, "en", "a"), (2, "hello " * 100_000, "en", "a")]
    assert rows_of(spelling.spelling_variants(make(spark, rows))) == brute(rows)


def test_a_common_word_is_counted_before_it_moves(spark):
    """A third of all occurrences in one word: counts come together, occurrences don't."""
    words = spelling.vocabulary(make(spark, [(i, "common " * 500, "en", "a") for i in range(50)]))
    assert words.collect()[0]["n"] > 24_000
    plan = words._jdf.queryExecution().executedPlan().toString()
    exchange = plan.index("Exchange")
    assert "HashAggregate" in plan[:exchange] and plan[exchange:].index("HashAggregate") < plan[exchange:].index("Generate")

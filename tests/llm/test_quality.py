import random
import re

import pytest
from tests.llm.conftest import HARD, make

from folioforge.llm import quality as Q


def brute(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    seen = {}
    for g in grams:
        seen[g] = seen.get(g, 0) + 1
    covered = {p for i, g in enumerate(grams) if seen[g] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), failed


def counts(r):
    return r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed


@pytest.mark.parametrize("name", ["hard", "clashing"])
def test_base_counts(name, request):
    got = Q.judge(request.getfixturevalue(name)).collect()
    assert sorted((str(r.doc_id), *counts(r)) for r in got) == sorted((str(i), *brute(t)) for i, t, *_ in HARD)
    assert not any(r.kept and r.base_failed for r in got)


def test_repeats_and_lines(spark):
    texts = ["a b c a b c", "a b c d a b c", "a a a a", "x\nx\n\n \nx\ny", "a b", "a b c x a b c y a b c"]
    rng = random.Random(3)
    texts += [" ".join(rng.choice("ab") for _ in range(rng.randrange(30))) for _ in range(60)]
    got = {r.doc_id: counts(r) for r in Q.base_counts(make(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}


def rows_of(n, rng, source, lang="en"):
    return [(k, " ".join(f"{rng.choice('abcdefgh')}word{rng.randrange(5000)}" for _ in range(80)), lang, source) for k in range(n)]


def test_outliers_fail_and_the_rest_stays(spark):
    rng, rows = random.Random(6), []
    for s in ("a", "b", None):
        for k, t, lang, _ in rows_of(150, rng, s):
            junk = k % 10 == 0
            rows.append((len(rows), " ".join(x + "***" for x in t.split()) if junk else t, lang, s))
    got = {r.doc_id: r for r in Q.judge(make(spark, rows)).collect()}
    for i, t, *_ in rows:
        assert got[i].kept == ("***" not in t)
        assert ("symbols_a_word" in got[i].failed) == ("***" in t)


def test_small_groups_lean_on_their_language(spark):
    rng = random.Random(8)
    rows = [(i, t, "en", "big") for i, (_, t, _, _) in enumerate(rows_of(200, rng, "big"))]
    rows += [(1000 + i, t.replace(" ", " ### "), "en", "tiny") for i, (_, t, _, _) in enumerate(rows_of(5, rng, "tiny"))]
    got = {r.doc_id: r.kept for r in Q.judge(make(spark, rows)).collect()}
    assert all(got[i] for i in range(200))
    assert not any(got[1000 + i] for i in range(5))


def test_sketch_quantiles_are_within_alpha(spark):
    rng = random.Random(1)
    xs = sorted(rng.lognormvariate(0, 1) for _ in range(2000))
    frame = spark.createDataFrame([("en", "a", 1000, int(1000 * x), 0, 0, 1000, 0, 0, False) for x in xs], "lang string, source string, n_words long, word_chars long, n_upper long, n_marks long, n_lines long, n_dup_lines long, n_symbols long, base_failed boolean").selectExpr("*", "0L as n_repeat_words")
    found = Q.thresholds(Q.sketches(frame), 0.0).first().limits["chars_a_word"]
    assert found["low"] == pytest.approx(xs[499], rel=0.02)
    assert found["high"] == pytest.approx(xs[1499], rel=0.02)


def test_thresholds_move_from_the_language_to_the_source(spark):
    """Rows of a source with more marks fail while they are few, and set their own limit when many."""
    rng, kept = random.Random(4), {}
    for n in (2, 100, 3000):
        sizes = [("plain", 3000, lambda: rng.randrange(30, 40)), ("marked", n, lambda: rng.randrange(150, 200))]
        rows = [("en", s, 400, 2000, marks()) for s, k, marks in sizes for _ in range(k)]
        frame = spark.createDataFrame(rows, "lang string, source string, n_words long, word_chars long, n_marks long")
        frame = frame.selectExpr("*", "0L n_upper", "1L n_lines", "0L n_dup_lines", "0L n_symbols", "0L n_repeat_words", "false base_failed")
        high = {r.source: r.limits["marks_a_char"]["high"] for r in Q.thresholds(Q.sketches(frame)).collect()}
        kept[n] = high["marked"]
        assert high["plain"] < 0.05
    assert kept[2] < 0.05 < 0.1 < kept[100] and kept[3000] > 0.1


def test_empty(empty):
    assert Q.judge(empty).count() == 0

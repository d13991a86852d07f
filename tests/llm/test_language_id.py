import math
import random
import zlib

import numpy as np
import pytest
from tests.llm.conftest import HARD, make

from folioforge.llm import language_id as L

SAMPLES = {
    "a": [bytes(random.Random(k).choice(b"abcd ") for _ in range(60)) for k in range(4)],
    "b": [bytes(random.Random(9 + k).choice(b"bcde ") for _ in range(50)) for k in range(3)],
}


def brute(text, lang, order=3):
    counts = {}
    for x in SAMPLES[lang]:
        for i in range(len(x)):
            for k in range(min(order, i) + 1):
                own = counts.setdefault(x[i - k : i], {})
                own[x[i]] = own.get(x[i], 0) + 1
    total = 0.0
    for i in range(len(text)):
        for k in range(min(order, i), -1, -1):
            if own := counts.get(text[i - k : i]):
                n, q = sum(own.values()), len(own)
                if text[i] in own:
                    total -= math.log2(own[text[i]] / (n + q))
                    break
                total -= math.log2(q / (n + q))
        else:
            total += 8
    return total


@pytest.mark.parametrize("at_once", [5, 7, 1 << 18])
def test_code_lengths_equal_brute_force(at_once):
    rng = random.Random(4)
    texts = [b"abc", b"z", b"", b"xxxxx", b"abcdzzab bcd", *(bytes(rng.choice(b"abcdez ") for _ in range(rng.randrange(200))) for _ in range(20))]
    for together in (1, 4):
        got = L.fit(SAMPLES, together=together).code_lengths(texts, at_once)
        for t, row in zip(texts, got):
            assert row.tolist() == pytest.approx([brute(t, "a"), brute(t, "b")], abs=1e-3)


def test_spreads_are_those_of_other_texts():
    held = {"a": [b"abcd abcd dcba " * 9, b"dcba abca" * 20, b"ddd aaa bcd" * 15]}
    model = L.fit(SAMPLES, held=held)
    bits = [brute(t, "a") for t in held["a"]]
    sizes = [len(t) for t in held["a"]]
    least, mean, most = sorted(b / n for b, n in zip(bits, sizes))
    apart = sorted((mean - least, most - mean))
    deviation = (apart[0] + 0.8 * (apart[1] - apart[0])) / 1.645  # the ninth tenth of nought and these two
    windows = [t[i : i + 64] for t in held["a"] for i in range(0, len(t) - 63, 64)]
    each = [brute(w, "a") / 64 for w in windows]
    variance = 64 * (np.quantile(np.abs(each - np.median(each)), 0.9) / 1.645) ** 2
    assert model.spread[0].tolist() == pytest.approx([mean, max(deviation, 0.1 * mean) + 1, variance], rel=1e-3)
    assert model.spread[1].tolist() == [0.0, math.inf, 0.0]


UNLEARNED = [
    "Litwo! Ojczyzno moja! ty jesteś jak zdrowie. Ile cię trzeba cenić, ten tylko się dowie, kto cię stracił.",
    "吾輩は猫である。名前はまだ無い。どこで生れたかとんと見当がつかぬ。",
    "Все счастливые семьи похожи друг на друга, каждая несчастливая семья несчастлива по-своему.",
]


def test_text_of_no_learned_language_scores_under_a_half(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(*"doc_id text lang source n_chars".split())
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("fit", "fit")
    model = L.fit_on(docs.repartition(40))
    spark.sparkContext.setJobGroup("", "")
    assert len(jobs.getJobIdsForGroup("fit")) <= 6  # AQE runs a job for each exchange; not one for each partition
    lang, score = model.predict([t * k for t in UNLEARNED for k in (1, 20)])
    assert (score < 0.5).all(), score
    planted = make(spark, [(10**7 + i, t, None, "a") for i, t in enumerate(UNLEARNED)] + [(10**7 + 9, None, "en", "a"), (10**7 + 10, "12 34", "en", "a")])
    kept = {r.doc_id for r in L.keep_identified(docs.unionByName(planted)).select("doc_id").collect()}
    letters = {r.doc_id for r in docs.collect() if any(c.isalpha() for c in r.text or "")}
    assert kept <= letters and len(letters - kept) <= len(letters) / 200, letters - kept


def test_long_texts_are_fitted_on_by_windows(spark):
    rows = [(i, ("lorem ipsum dolor sit amet " if i % 2 else "quick brown foxes jump over ") * 800, "la" if i % 2 else "en", "a") for i in range(40)]
    model = L.fit_on(make(spark, rows), most_bytes=500)
    assert model.langs == ["en", "la"] and model.predict([rows[0][1], rows[1][1]])[0] == ["en", "la"]


def test_many_languages_are_all_learned(spark, monkeypatch):
    rows = [(i, f"word{i % 300}x " * 20, f"l{i % 300:03d}", "a") for i in range(1500)]
    docs = make(spark, rows)
    model = L.fit_on(docs, docs_per_lang=3, order=2)
    trained = {lang for i, _, lang, _ in rows if zlib.crc32(str(i).encode()) % 5}
    assert model.langs == sorted(trained) and len(trained) > 290
    texts = [rows[i][1] for i in range(0, 300, 60)]
    assert model.predict(texts)[0] == [rows[i][2] for i in range(0, 300, 60)]
    monkeypatch.setattr(L, "KEPT", 1000)  # laid out once instead of for each batch
    assert model.predict(texts)[0] == [rows[i][2] for i in range(0, 300, 60)]


@pytest.mark.parametrize("same", range(1, 9))
def test_rows_that_share_an_id(spark, same, monkeypatch):
    """Half of the rows are in a language whose rows all have one id; texts differ or are all the same."""
    seen = {}
    monkeypatch.setattr(L, "fit", lambda samples, order=3, held=None: seen.update({k: [*samples.get(k, []), *(held or {}).get(k, [])] for k in {*samples, *(held or {})}}))
    trained = zlib.crc32(str(same).encode()) % 5 != 0
    rows = [(same, f"aaa text {i}", "aa", "s") for i in range(1500)] + [(i + 100, f"bbb text {i}", "bb", "s") for i in range(1500)] + [(same, "once and again", "cc", "s")] * 50
    L.fit_on(make(spark, rows), docs_per_lang=100)
    assert {k: len(v) for k, v in seen.items()} == ({"aa": 100, "bb": 100, "cc": 1} if trained else {"bb": 100})


def test_held_out_accuracy_and_folds(spark):
    rng, rows = random.Random(2), []
    kinds = {"en": "the of and to in is that it was for".split(), "de": "der die und in den von zu das mit sich".split(), "fr": "le de un être et à il avoir ne je".split()}
    for i in range(300):
        lang = rng.choice(sorted(kinds))
        rows.append((i, " ".join(rng.choice(kinds[lang]) for _ in range(30)), lang if i % 7 else None, "s"))
    truth = {i: (t, lang) for i, t, lang, _ in rows}
    got = L.identify(make(spark, rows)).collect()
    assert len(got) == 300
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1
    own = [r for r in got if r.held_out and truth[r.doc_id][1]]
    assert sum(r.lang_pred == truth[r.doc_id][1] for r in own) / len(own) > 0.98


def test_learns_from_training_folds_only(spark):
    rows = [(i, "aaa bbb" if zlib.crc32(str(i).encode()) % 5 else "zzz yyy", "one" if zlib.crc32(str(i).encode()) % 5 else "held", "s") for i in range(60)]
    assert L.fit_on(make(spark, rows)).langs == ["one"]


@pytest.mark.parametrize("name", ["hard", "clashing"])
def test_hard_rows(name, request):
    frame = request.getfixturevalue(name)
    got = L.identify(frame).collect()
    assert len(got) == len(HARD)
    und = sorted(str(i) for i, t, *_ in HARD if not any(c.isalpha() for c in t or ""))
    assert sorted(str(r.doc_id) for r in got if r.lang_pred == "und") == und
    assert {r.score for r in got if r.lang_pred == "und"} == {0.0}
    kept = L.keep_identified(frame)
    assert kept.columns == frame.columns
    assert kept.count() <= len(HARD) - len(und)


def test_nothing_to_learn_from(spark, empty):
    assert L.identify(empty).count() == 0
    got = L.identify(make(spark, [(1, "text", None, "a")])).collect()
    assert [(r.lang_pred, r.score) for r in got] == [("und", 0.0)]

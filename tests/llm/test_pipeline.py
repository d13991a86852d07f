import random

from tests.llm.conftest import make, words

import __spark_entry__
import corpus_pipeline
from folioforge.llm import simhash


def test_stages_over_a_small_corpus(spark, tmp_path):
    rng, rows = random.Random(3), []
    for i in range(60):
        rows.append((i, words(80, i, 5000), "en" if i % 2 else "fr", f"s{i % 4}"))
    rows += [(100 + i, rows[i][1] + " \n", *rows[i][2:]) for i in range(10)]
    rows += [(200, "123 456", "en", "s0"), (201, None, "en", "s1"), (202, "", None, None)]
    docs = make(spark, rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert name == corpus_pipeline.STAGES[-1][0] or out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = {r.doc_id for r in docs.select("doc_id").collect()}
    assert kept["language_id"] == {i for i, t, *_ in rows if any(c.isalpha() for c in t or "")}
    assert kept["exact_dedup"] == set(range(10, 60)) | {100 + i for i in range(10)}
    assert kept["near_dedup"] == kept["exact_dedup"]
    assert kept["sentencepiece"] == kept["mixing"] <= kept["near_dedup"]
    assert all(r.round_trip for r in docs.collect())
    whole = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "n_tokens", "score").collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, docs.select("doc_id", "n_tokens", "score").collect()))


def test_every_stage_does_its_work(spark, tmp_path):
    """Planted: text of no learned language, exact copies, near copies beyond three bits, a hot source."""
    rng, kinds, rows = random.Random(5), {"en": "the of and to in is that it was for on with as at by".split(), "de": "der die und in den von zu das mit sich des auf".split()}, []
    stems = [f"{a}{b}{c}" for a in "bdfgklmnprst" for b in "aeiou" for c in "lmnrst"]
    prose = lambda lang, n: " ".join(rng.choice(kinds[lang]) if rng.random() < 0.5 else rng.choice(stems) + kinds[lang][rng.randrange(6)] for _ in range(n))
    for i in range(200):
        lang = ("en", "de")[i % 2]
        rows.append((i, prose(lang, 150), lang, "hot" if i % 3 else f"s{i % 5}"))
    alien = [300 + k for k in range(3)]
    rows += [(i, "もう一度だけ会いたいと思った。" * 9 if i % 2 else "Щука плывёт под мостом у реки. " * 9, None, "hot") for i in alien]
    rows += [(400 + i, "  " + rows[i][1].replace(" ", "\n", 3), *rows[i][2:]) for i in range(10)]
    near = []
    for k in range(6):
        words_ = rows[20 + k][1].split()
        for at in (10, 60):
            words_[at] = f"changed{k}"
        near.append((500 + k, " ".join(words_), *rows[20 + k][2:]))
    rows += near
    assert any((simhash.fingerprint(t) ^ simhash.fingerprint(rows[20 + k][1])).bit_count() > 3 for k, (_, t, *_) in enumerate(near))
    docs, seen = make(spark, rows, clashes=True), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert name == "sentencepiece" or docs.columns == columns
        seen[name] = {r.doc_id for r in docs.select("doc_id").collect()}
    clean = {i for i, *_ in rows} - set(alien)
    assert seen["language_id"] == clean
    assert seen["exact_dedup"] == clean - set(range(10))  # the copies have more characters
    assert seen["near_dedup"] == seen["exact_dedup"] - {500 + k for k in range(6)}
    assert seen["sentencepiece"] == seen["mixing"] <= seen["near_dedup"]
    words_of = {i: len((t or "").split()) for i, t, *_ in rows}
    taken = spark.read.parquet(f"{tmp_path}/mixing").collect()
    total = sum(words_of[i] for i in seen["near_dedup"])
    assert abs(sum(len(r.text.split()) for r in taken) - 1.5 * total) <= 6


def test_an_empty_table(spark, tmp_path):
    make(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_names_are_registered():
    names = __spark_entry__.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{k}" for k in range(1, 11)}
    assert "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use themselves.
CLASHES = "size long, kept boolean, key string, run int, fp long, pos int, entity string, level int, bucket int, n_words long, score double, budget double, epochs int, html string, kind string, node long, hash long, id long, mention string, surrogate string, all int, new string, hit int, range string, place long, limits string, share double, of_lang string, failed string, hits int, n_entities string, wide string, bits int, part long"


def make(spark, rows, clashes=False):
    """Documents from (doc_id, text, lang, source); with clashes, extra columns of nulls."""
    rows = [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows]
    if not clashes:
        return spark.createDataFrame(rows, SCHEMA)
    extra = len(CLASHES.split(", "))
    return spark.createDataFrame([r + (None,) * extra for r in rows], f"{SCHEMA}, {CLASHES}")


def words(n, seed, pool=200):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(pool)}" for _ in range(n))


HARD = [
    (1, "the quick brown fox jumps", "en", "a"),
    (2, "the quick brown\tfox  jumps\n", "en", "a"),
    (2, "the quick brown\tfox  jumps\n", "en", "a"),
    (3, None, "en", "a"),
    (4, "", "fr", None),
    (5, " \t\n", None, "b"),
    (6, "Ünïcödé text ▁ with 日本 𝄞 and   space", "fr", None),
    (None, "a row without an id", "en", "b"),
    (None, None, None, None),
    (7, "one", "en", "c"),
    (8, words(30_000, 8, 50_000), "en", "c"),
    (9, words(400, 9), "fr", "b"),
    (10, "1234 !!! 5678", "en", "b"),
]


@pytest.fixture(scope="session")
def hard(spark):
    return make(spark, HARD)


@pytest.fixture(scope="session")
def clashing(spark):
    return make(spark, HARD, clashes=True)


@pytest.fixture(scope="session")
def empty(spark):
    return make(spark, [])

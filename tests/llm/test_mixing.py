import random
import re

import pytest
from tests.llm.conftest import HARD, make, words

from folioforge.llm import mixing


def filled(sizes, share=1.5, most=2.0):
    """Water filling step by step: what a cap frees is dealt out again by weight."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}
    total, target, open_ = share * sum(sizes.values()), {}, set(order)
    while open_:
        rest = total - sum(target.values())
        all_weight = sum(weight[s] for s in open_)
        over = {s for s in open_ if rest * weight[s] / all_weight > most * sizes[s]}
        if not over:
            return target | {s: rest * weight[s] / all_weight for s in open_}
        target |= {s: most * sizes[s] for s in over}
        open_ -= over
    return target


def count(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def check(rows, got):
    sizes = {}
    for _, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + count(t)
    target, taken = filled(sizes), {}
    assert len(got) == len(rows)
    for r in got:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(target[r.source])
        assert 0 <= r.taken <= 2 * r["size"]
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s, n in taken.items():
        assert abs(n - target[s]) <= 0.5001
    assert sorted((str(i), count(t)) for i, t, *_ in rows) == sorted((str(r.doc_id), r["size"]) for r in got)


def test_budgets(spark):
    rng = random.Random(1)
    rows = [(i, words(rng.randrange(1, 60), i), "en", rng.choice(["hot"] * 6 + ["b", "c", "d", "Ä", None])) for i in range(3000)]
    frame = make(spark, rows)
    got = mixing.mix(frame, range_rows=16).collect()
    check(rows, got)
    again = mixing.mix(frame.repartition(11), range_rows=16).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))


def test_running_sums_follow_the_keys(spark):
    rows = [(i, words(3, i), "en", "a") for i in range(500)] + [(1000 + i, words(1, i), "en", "b") for i in range(40)]
    got = mixing.mix(make(spark, rows), range_rows=8).collect()
    own = [r for r in got if r.source == "a"]
    assert sum(0 < r["cut"] < r["size"] for r in own) <= 1
    check(rows, got)


@pytest.mark.parametrize("name", ["hard", "clashing"])
def test_hard_rows(name, request):
    check(HARD, mixing.mix(request.getfixturevalue(name)).collect())


def test_documents_of_the_mix(spark):
    rows = [(i, words(20, i), "en", "a" if i % 3 else "b") for i in range(90)]
    frame = make(spark, rows)
    taken = {r.doc_id: r.taken for r in mixing.mix(frame).collect()}
    out = mixing.mix_documents(frame)
    assert out.columns == frame.columns
    got, text = {}, {i: t for i, t, *_ in rows}
    for r in out.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + count(r.text)
        assert text[r.doc_id].startswith(r.text)
        assert r.n_chars == len(r.text)
    assert got == {i: n for i, n in taken.items() if n}


def test_empty(empty, clashing):
    assert mixing.mix(empty).count() == 0
    assert mixing.mix_documents(empty).count() == 0
    assert mixing.mix_documents(clashing).columns == clashing.columns


@pytest.mark.parametrize("ids", ["null", "one", "copies"])
def test_documents_of_one_id_meet_the_target(spark, ids):
    """Two thirds of the rows share an id, or are copies of each other."""
    same = None if ids == "null" else 7
    rows = [(same, words(5, 0 if ids == "copies" else i), "en", "a") for i in range(10)] + [(100 + i, words(4, i), "en", "a") for i in range(5)]
    sizes = {"a": sum(count(t) for _, t, *_ in rows)}
    frame = make(spark, rows)
    out = mixing.mix_documents(frame).collect()
    assert sum(count(r.text) for r in out) == round(filled(sizes)["a"]) == 105
    times = {}
    for r in out:
        full = [t for i, t, *_ in rows if i == r.doc_id and t.startswith(r.text)]
        times[r.doc_id, full[0]] = times.get((r.doc_id, full[0]), 0) + count(r.text)
    for (i, t), n in times.items():
        assert n <= 2 * count(t) * sum(x[0] == i and x[1] == t for x in rows)


def test_rows_of_one_id_lie_apart(spark):
    """A third of all rows without an id: their ranges are as small as any."""
    rows = [(None if i % 3 == 0 else i, words(3, i), "en", "a") for i in range(3000)]
    frame = make(spark, rows)
    keys = frame.select(mixing.F.xxhash64("doc_id", mixing.F.crc32(mixing.F.col("text").cast("binary")), mixing.F.lit(7)).alias("key"), "doc_id")
    ranges = keys.withColumn("range", mixing.F.expr("shiftrightunsigned(key, 60)")).groupBy("range").count().collect()
    assert len(ranges) == 16 and max(r["count"] for r in ranges) < 300
    check(rows, mixing.mix(frame, range_rows=64).collect())

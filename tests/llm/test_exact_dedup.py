import hashlib
import re

from tests.llm.conftest import HARD, make

from folioforge.llm.exact_dedup import digests, drop_exact_copies, exact_dedup, tree_merge


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", "", t or "")


def brute(rows):
    best, size = {}, {}
    for i, t, *_ in rows:
        k = norm(t)
        size[k] = size.get(k, 0) + 1
        own = (-len(t or ""), i is None, i or 0)
        if k not in best or own < best[k][0]:
            best[k] = (own, i)
    return sorted(
        ((i, best[norm(t)][1], size[norm(t)], i == best[norm(t)][1], hashlib.sha256(norm(t).encode()).hexdigest()) for i, t, *_ in rows), key=repr
    )


def test_equals_brute_force(hard):
    assert sorted(map(tuple, exact_dedup(hard).collect()), key=repr) == brute(HARD)


def test_clashing_columns_and_fan_in(clashing):
    assert sorted(map(tuple, exact_dedup(clashing, fan_in=2).collect()), key=repr) == brute(HARD)


def test_empty(empty):
    assert exact_dedup(empty).count() == 0
    assert drop_exact_copies(empty).count() == 0


def test_hot_group_over_many_runs(spark):
    rows = [(i, "same  text" if i % 3 else f"own {i}", "en", "a") for i in range(300)]
    got = exact_dedup(make(spark, rows).repartition(17), fan_in=3)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


def test_every_level_keeps_the_smallest(spark):
    rows = [(i, "x", "en", "a") for i in range(50, 0, -1)]
    runs = digests(make(spark, rows).repartition(9))
    assert [r.keep_id for r in tree_merge(runs, 9, 2).collect()] == [1]


def test_segments_split_runs_and_count_all(spark):
    """Every text in several runs, many ranges, rounds with cuts between them."""
    rows = [(i, f"text {i % 700}" + " " * (i // 700), "en", "a") for i in range(2800)]
    runs = digests(make(spark, rows).repartition(30))
    got = tree_merge(runs, 30, fan_in=2, rows=2800, segment=20, rounds_a_cut=2).collect()
    assert sorted((r.keep_id, r.group_size) for r in got) == [(2100 + i, 4) for i in range(700)]


def test_digests_that_differ_in_one_part_stay_apart(spark):
    rows = [(0, 1, b"a", 1, 1, 5), (1, 2, b"a", 1, 1, 5), (1, 3, b"a", 2, 1, 5), (2, 4, b"a", 1, 2, 5), (2, 5, b"b", 1, 1, 9)]
    runs = spark.createDataFrame(rows, "run int, doc_id long, sha binary, norm_chars long, norm_hash long, chars long")
    assert sorted((r.keep_id, r.group_size) for r in tree_merge(runs, 3, 2).collect()) == [(1, 2), (3, 1), (4, 1), (5, 1)]


def test_stage_keeps_one_row_of_each_text(spark, clashing):
    out = drop_exact_copies(clashing)
    assert out.columns == clashing.columns
    rows = out.collect()
    kept = [norm(r.text) for r in rows if r.doc_id is not None]
    assert len(kept) == len(set(kept))
    assert {norm(t) for _, t, *_ in HARD} == {norm(r.text) for r in rows}
    assert sorted(r.doc_id for r in rows if r.doc_id is not None) == [2, 5, 6, 7, 8, 9, 10]
    assert sum(r.doc_id is None for r in rows) == 2

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tests.llm.conftest import HARD, make

from folioforge.llm import sharding


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 5000), st.integers(0, 1 << 40))
def test_permutation_and_inverse(n, seed):
    rows = np.arange(n)
    out = sharding.permute(rows, n, seed)
    assert np.array_equal(np.sort(out), rows)
    assert np.array_equal(sharding.unpermute(out, n, seed), rows)


def test_shards_of_a_table(spark):
    rows = [(i * 7 % 501, f"text {i}", "en", "a") for i in range(501)]
    got = sharding.shard(make(spark, rows).repartition(5)).collect()
    per = {}
    for r in got:
        per.setdefault(r.shard, []).append(r.slot)
    assert set(per) == set(range(24))
    assert all(sorted(v) == list(range(len(v))) for v in per.values())
    assert max(map(len, per.values())) - min(map(len, per.values())) <= 1
    number = {r.doc_id: r.row_number for r in got}
    assert number == {i: i for i in range(501)}
    place = sharding.permute(np.arange(501), 501, 20240229)
    assert all((r.shard, r.slot) == (place[r.row_number] % 24, place[r.row_number] // 24) for r in got)
    again = sharding.shard(make(spark, rows[::-1]).repartition(3)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


@pytest.mark.parametrize("name", ["hard", "clashing"])
def test_hard_rows(name, request):
    got = sharding.shard(request.getfixturevalue(name), shards=3).collect()
    want = sorted((str(i), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in HARD)
    assert sorted((str(r.doc_id), r["size"], r.text_crc32) for r in got) == want
    assert sorted((r.shard, r.slot) for r in got) == sorted((p % 3, p // 3) for p in range(len(HARD)))
    assert {(r.law, r.grown_shard) for r in got} == {("rows", None)}


def test_empty(empty):
    assert sharding.shard(empty).count() == 0

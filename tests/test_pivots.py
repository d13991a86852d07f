"""The index round pivots against all rows."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from folioforge.operators import pivots
from folioforge.session import scratch

SCHEMA = "vec_id long, embedding array<float>"


def frame(spark, rows):
    return spark.createDataFrame([(int(i), None if v is None else [float(x) for x in v]) for i, v in rows], SCHEMA)


def clustered(n, groups=40, dims=16, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dims))
    return [(i, centres[rng.integers(groups)] * rng.uniform(0.1, 9) + rng.normal(size=dims) * 0.02) for i in range(n)]


def brute(rows, asked, keep):
    there = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if v is not None]
    out = []
    for q, v in asked:
        v = np.array(v, np.float32).astype(float)
        scores = [(round(float(x @ v) / max(float(np.sqrt(x @ x) * np.sqrt(v @ v)), 1e-12), 6), i) for i, x in there]
        for rank, (score, i) in enumerate(sorted(scores, key=lambda s: (-s[0], s[1]))[:keep], 1):
            out.append((q, i, rank, score))
    return sorted(out)


def found(index, asked, keep):
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    rows = index.search(asked.withColumnRenamed("vec_id", "query_id"), keep).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= keep)
    return sorted((r["query_id"], r["vec_id"], r["rank"], r["score"] + 0.0) for r in rows.collect())


def same(got, want):
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], atol=2e-6)


@pytest.mark.parametrize("keep", [1, 10, 500])
def test_exact(spark, keep):
    rows = clustered(3000)
    rows += [(3000, rows[0][1]), (3001, rows[0][1] * 2)]  # the same direction
    asked = [(i, v) for i, v in rows if i % 50 == 0]
    index = pivots.build(frame(spark, rows), scratch(spark, "pivots"), block=64)
    got = found(index, frame(spark, asked), keep)
    want = brute(rows, asked, keep)
    assert len(got) == len(want) and np.allclose([g[3] for g in got], [w[3] for w in want], atol=2e-6)
    assert len({g[:2] for g in got} - {w[:2] for w in want}) <= 2  # rounding at the sixth place


def test_most_rows_are_skipped(spark):
    rows = clustered(20_000)
    index = pivots.build(frame(spark, rows), scratch(spark, "pivots"), block=64)
    same(found(index, frame(spark, rows[:3]), 10), brute(rows, rows[:3], 10))
    assert index.rows_read.value < 0.25 * len(rows)


def test_rows_without_direction_null_rows_and_ties(spark):
    rows = [(i, [1.0, i % 3, 0.0]) for i in range(30)] + [(40, [0.0, 0.0, 0.0]), (41, None), (42, [1e-9, 0.0, 0.0]), (43, [-1.0, 0.0, 0.0])]
    asked = [(0, [1.0, 0.0, 0.0]), (1, [0.0, 0.0, 0.0]), (2, [0.0, 0.0, 5.0])]
    for cells in (1, 3, 50):
        index = pivots.build(frame(spark, rows), scratch(spark, "pivots"), cells=cells, block=4)
        for keep in (2, 100):
            same(found(index, frame(spark, asked), keep), brute(rows, asked, keep))


def test_queries_in_blocks(spark, monkeypatch):
    rows = clustered(400)
    monkeypatch.setattr(pivots, "HELD", 30)
    index = pivots.build(frame(spark, rows), scratch(spark, "pivots"))
    same(found(index, frame(spark, rows[:25]), 5), brute(rows, rows[:25], 5))


def test_empty(spark):
    index = pivots.build(frame(spark, []), scratch(spark, "pivots"))
    assert found(index, frame(spark, [(1, [1.0, 2.0])]), 3) == []
    index = pivots.build(frame(spark, clustered(10)), scratch(spark, "pivots"))
    assert found(index, frame(spark, []), 3) == []

"""Joins by bins against a look at every span."""

import random

import pytest
from pyspark.sql import functions as F

from folioforge.functions.sentences import byte_spans, snap
from folioforge.operators import intervals


def rows_of(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


@pytest.mark.parametrize("width", [None, 1, 7, 10_000])
def test_overlapping_spans(spark, width):
    rng = random.Random(3)
    spans = [(rng.choice("abb"), s := rng.randrange(200), s + rng.choice([0, 1, 5, 90]), k) for k in range(80)] + [(None, 0, 100, 99)]
    points = [(rng.choice("abbc"), rng.randrange(300)) for _ in range(150)] + [(None, 5), ("a", None)]
    p, s = spark.createDataFrame(points, "key string, at long"), spark.createDataFrame(spans, "key string, start long, end long, span int")
    want = []
    for key, at in points:
        hit = [x for x in spans if key is not None and at is not None and x[0] == key and x[1] <= at < x[2]]
        want += [(key, at, *x[1:]) for x in hit] or [(key, at, None, None, None)]
    assert rows_of(intervals.holding(p, s, "key", width=width).select("key", "at", "start", "end", "span")) == sorted(want, key=repr)


def test_no_spans_and_no_points(spark):
    p, s = spark.createDataFrame([("a", 1)], "key string, at long"), spark.createDataFrame([], "key string, start long, end long")
    assert rows_of(intervals.holding(p, s, "key")) == [("a", 1, None, None)]
    assert rows_of(intervals.holding(p.limit(0), s, "key")) == []


TEXTS = [(1, "Ätsch one here. Second sentence here! —— ?? Third 𝄞 one. "), (2, "!!——!!"), (3, ""), (4, "é" * 30), (5, None), (6, "One. Two. Three. Four. " * 300)]


def test_selections_as_row_by_row(spark):
    """Every selection of the short texts, and a third of all of them in one long text."""
    picks, rng = [], random.Random(1)
    for key, text in TEXTS[:4]:
        n = len(text.encode())
        picks += [(key, a, b) for a in range(n + 2) for b in range(a - 1, n + 3, 2)]
    n = len(TEXTS[5][1])
    picks += [(6, a := rng.randrange(n), a + rng.randrange(200)) for _ in range(len(picks) // 2)] + [(5, 0, 9), (77, 0, 9)]
    ids = [(k, *p) for k, p in enumerate(picks)]
    sentences = [(key, s, e) for key, text in TEXTS if text for s, e in byte_spans(text)]
    frame = intervals.snapped(
        spark.createDataFrame(ids, "sel long, key long, start long, end long"), spark.createDataFrame(sentences, "key long, start long, end long"), spark.createDataFrame(TEXTS, "key long, text string"), "key", "sel"
    )
    texts = dict(TEXTS)
    want = [(k, snap(texts[key], a, b) if texts.get(key) is not None else None) for k, key, a, b in ids]
    assert sorted((r["sel"], r["span"] and tuple(r["span"])) for r in frame.select("sel", "span").collect()) == want


def test_a_hot_text_is_many_bins(spark):
    spans = spark.range(20_000).select(F.lit("hot").alias("key"), (F.col("id") * 10).alias("start"), (F.col("id") * 10 + 9).alias("end"))
    width = intervals.bin_width(spans)
    assert width == 36  # and a bin holds few spans, whatever the text's length
    points = spark.range(200_000).select(F.lit("hot").alias("key"), F.col("id").alias("at"))
    found = intervals.holding(points, spans, "key")
    assert found.count() == 200_000 and found.where("start is null").count() == 20_000
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan

"""Folds over the ordered rows of a key, in levels, for any step that composes.

What a row does is a value; two values compose to that of both rows. So runs of rows
are composed where they lie, then runs of runs, and what holds before each row is
handed down again: no key is folded by one task, and what moves are values alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.session import cut

Step = Callable[[Column, Column], Column]


def _runs(frame: DataFrame, *by: str) -> DataFrame:
    """by and run: the (o, v) of each group in order."""
    return frame.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("o", "v"))).alias("run"))


def _composed(compose: Step) -> Column:
    rest = F.slice("run", F.lit(2), F.size("run"))
    return F.aggregate(rest, F.col("run")[0]["v"], lambda a, x: compose(a, x["v"]))


def _handed_down(runs: DataFrame, apply: Step, *by: str) -> DataFrame:
    """by, o and before of the rows of runs, each of which starts at `before`."""
    none = F.filter(F.transform("run", lambda x: F.struct(x["o"].alias("o"), F.col("before").alias("before"))), lambda _: F.lit(False))
    step = lambda a, x: F.struct(apply(a["at"], x["v"]).alias("at"), F.concat(a["seen"], F.array(F.struct(x["o"].alias("o"), a["at"].alias("before")))).alias("seen"))
    return runs.select(*by, F.inline(F.aggregate("run", F.struct(F.col("before").alias("at"), none.alias("seen")), step)["seen"]))


def before_each(frame: DataFrame, key: str, order: str, value: Column, start: Column, apply: Step, compose: Step, fan: int = 256) -> DataFrame:
    """key, order and before: start with the values of all earlier rows of the key applied to it.

    apply(state, value) gives a state, compose(value, value) a value, and applying a composed
    value is applying both. order is unique within a key and neither is null. Rows lie in ranges of key and
    order, in runs of `fan` within a range; a key takes a row for as many of its ranges as there
    are partitions, at most. An empty frame gives an empty one.
    """
    # ranges are drawn from a sample: values are computed before, once, and the ranges kept as drawn
    values = cut(frame.select(F.col(key).alias("k"), F.col(order).alias("o"), value.alias("v")))
    laid = cut(values.repartitionByRange("k", "o").withColumn("r", F.spark_partition_id()))
    nth = F.row_number().over(Window.partitionBy("k", "r").orderBy("o")) - 1
    low = _runs(laid.withColumn("g", F.floor(nth / fan)), "k", "r", "g")
    middle = _runs(low.select("k", "r", F.col("g").alias("o"), _composed(compose).alias("v")), "k", "r")
    top = _runs(middle.select("k", F.col("r").alias("o"), _composed(compose).alias("v")), "k")
    ranges = _handed_down(top.withColumn("before", start), apply, "k").withColumnRenamed("o", "r")
    groups = _handed_down(middle.join(ranges, ["k", "r"]), apply, "k", "r").withColumnRenamed("o", "g")
    rows = _handed_down(low.join(groups, ["k", "r", "g"]), apply, "k")
    return rows.select(F.col("k").alias(key), F.col("o").alias(order), "before")


def sums_before(frame: DataFrame, key: str, order: str, value: Column, fan: int = 256) -> DataFrame:
    """before: the sum of value (long, not null) over the earlier rows of the key."""
    add: Step = lambda a, b: a + b
    return before_each(frame, key, order, value.cast("long"), F.lit(0).cast("long"), add, add, fan)

from pyspark.sql import functions as F

from folioforge.streaming import events


def streamed(spark, query, name):
    run = query.writeStream.format("memory").queryName(name).outputMode("complete").start()
    run.processAllAvailable()
    run.stop()
    return sorted(map(tuple, spark.table(name).collect()))


def test_streams_equal_batches(spark, tmp_path):
    batch = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    batch.repartition(3).write.parquet(f"{tmp_path}/e")
    stream = lambda: events.read_events(spark, f"{tmp_path}/e", 1)
    assert streamed(spark, events.tumbling(stream()), "tumbling") == sorted(map(tuple, events.tumbling(batch).collect()))
    assert streamed(spark, events.sessions(stream()), "sessions") == sorted(map(tuple, events.sessions(batch).collect()))


def test_duplicates_are_dropped(spark, tmp_path):
    batch = spark.read.parquet("/root/testdata/sf0.001/events.parquet").limit(100)
    batch.unionByName(batch).coalesce(1).write.parquet(f"{tmp_path}/d")
    run = events.deduplicated(events.read_events(spark, f"{tmp_path}/d")).writeStream.format("memory").queryName("once").outputMode("append").start()
    run.processAllAvailable()
    run.stop()
    assert spark.table("once").count() == 100


def test_ema(spark):
    got = spark.createDataFrame([([10.0, 20.0],), ([],)], "v array<double>").select(events.ema(F.col("v")).alias("e")).collect()
    assert [r.e for r in got] == [13.0, None]

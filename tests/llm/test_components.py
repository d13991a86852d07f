from pyspark.sql import functions as F

from folioforge.llm import components


def test_few_edges_write_few_files(spark, monkeypatch):
    """Every task before a shuffle writes files of its own, whatever it has."""
    conf = {"spark.sql.shuffle.partitions": "97", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    parts, cut = [], components.cut

    def seen(df):
        parts.append(df.rdd.getNumPartitions())
        return cut(df)

    monkeypatch.setattr(components, "cut", seen)
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        edges = spark.range(300).select((F.col("id") + 1).alias("a"), F.col("id").alias("b")).where("a % 7 <> 0")
        found = {r.node: r.component for r in components.connected_components(edges).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert found == {n: n - n % 7 for n in range(301) if n != 300 or n % 7}
    assert len(parts) > 2 and max(parts[1:]) == 1


def test_many_edges_keep_their_tasks(spark):
    rows = 10 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    frame = spark.range(0, rows, 1, 4)
    assert components.few(frame, rows, 10).rdd.getNumPartitions() == 4 and components.few(frame, 10, 10).rdd.getNumPartitions() == 1

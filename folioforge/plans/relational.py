"""Queries over joins, sets, sorts and windows of plain tables; those marked as extensions
have no counterpart among the ported operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioforge.operators import themes
from folioforge.plans.registry import query
from folioforge.session import table
from folioforge.streaming import events


@query(
    """SELECT 'both' AS part, count(*) AS n FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels)
    UNION ALL SELECT 'documents only', count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)
    UNION ALL SELECT 'either', count(*) FROM (SELECT doc_id FROM documents UNION SELECT doc_id FROM labels)
    UNION ALL SELECT 'languages', count(DISTINCT lang) FROM documents"""
)
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, x = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id")
    ids = d.select("doc_id")
    parts = {"both": ids.intersect(x), "documents only": ids.subtract(x), "either": ids.union(x).distinct(), "languages": d.select("lang").distinct()}
    counted = [p.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n") for name, p in parts.items()]
    return counted[0].unionByName(counted[1]).unionByName(counted[2]).unionByName(counted[3])


@query("SELECT c_custkey, list_sort(list_distinct([1, 2] || [CAST(c_custkey % 4 AS INT)])) AS added, list_sort(list_filter([1, 2, 3], lambda x: x <> c_custkey % 4)) AS removed FROM customer")
def favourites(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", F.array(F.lit(1), F.lit(2)).alias("two"), F.array(F.lit(1), F.lit(2), F.lit(3)).alias("three"), (F.col("c_custkey") % 4).cast("int").alias("id"))
    return c.select("c_custkey", themes.with_added("two", "id").alias("added"), themes.with_removed("three", "id").alias("removed"))


@query("SELECT doc_id, quality, row_number() OVER (ORDER BY quality NULLS LAST, doc_id) AS place FROM documents LEFT JOIN labels USING (doc_id) ORDER BY place LIMIT 50")
def nulls_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    first = joined.orderBy(F.col("quality").asc_nulls_last(), "doc_id").limit(50)
    return first.select("doc_id", "quality", F.row_number().over(Window.orderBy(F.col("quality").asc_nulls_last(), "doc_id")).alias("place"))


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def dropped_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    toxic = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", "source").join(toxic, "doc_id", "left_anti")


@query("SELECT source, arg_min(doc_id, doc_id) AS first_doc, count(*) AS docs, count(*) FILTER (lang = 'en') AS english FROM documents GROUP BY source")
def first_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("docs"), F.count_if(F.col("lang") == "en").alias("english"))


@query(
    """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL"""
)
def ext_pricing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension."""
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    rows = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(price), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("n"))


@query("SELECT r_name, n_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)")
def ext_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension."""
    joined = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.rollup("r_name", "n_name").agg(F.count(F.lit(1)).alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def ext_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: the batch result of the streaming aggregate."""
    return events.tumbling(table(spark, sf_dir, "events"))


@query(
    """SELECT user_id, min(ts) AS session_start, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM
    (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s"""
)
def ext_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: the batch result of the streaming aggregate."""
    return events.sessions(table(spark, sf_dir, "events"))


@query("SELECT user_id, round(list_reduce(list(coalesce(value, 0) ORDER BY ts, event_id), lambda a, x: a * 0.7::DOUBLE + x * (1 - 0.7::DOUBLE)), 6) AS ema, count(*) AS n FROM events GROUP BY user_id")
def ema_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.ema_by_user(table(spark, sf_dir, "events"))

"""Extension: windows over event streams, the same for batches and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.registry import query
from ..session import table


def tumbling(events: DataFrame, width: str, late: str = "1 hour", time_col: str = "at") -> DataFrame:
    """start, event_type, n, total for windows of such a width; on a stream, rows later than late are left out."""
    grouped = events.withWatermark(time_col, late).groupBy(F.window(time_col, width), "event_type")
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, late: str = "1 hour", time_col: str = "at") -> DataFrame:
    """start, user_id, n of runs of a user's events no further apart than gap."""
    grouped = events.withWatermark(time_col, late).groupBy(F.session_window(time_col, gap), "user_id")
    return grouped.agg(F.count(F.lit(1)).alias("n")).select(F.col("session_window.start").alias("start"), "user_id", "n")


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """The Parquet files of a folder as a stream, with at as the time."""
    kind = spark.read.parquet(path).schema
    return spark.readStream.schema(kind).parquet(path).withColumn("at", F.col("ts").cast("timestamp"))


@query("ext_tumbling_window", "SELECT time_bucket(INTERVAL '1 day', ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def ext_tumbling_window(spark: SparkSession, d: str) -> DataFrame:
    out = tumbling(table(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp")), "1 day")
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("ext_rank_window", "SELECT c_custkey, rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC) AS r FROM customer QUALIFY r <= 3")
def ext_rank_window(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").selectExpr("c_custkey", "cast(rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC) AS bigint) AS r").where("r <= 3")


@query("ext_rollup", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def ext_rollup(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("ext_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def ext_cube(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))

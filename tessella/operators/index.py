"""Index operators: range-sorted copies whose row groups Parquet's minima and maxima prune."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from .registry import query


def point_lookup(df: DataFrame, key: str, value: Any) -> DataFrame:
    """All rows with the key, duplicates too; no row if it is missing."""
    return df.where(F.col(key) == value)


def range_scan(df: DataFrame, key: str, low: Any, high: Any) -> DataFrame:
    """Rows from low to high, both included, in the order of the key."""
    return df.where(F.col(key).between(low, high)).orderBy(key)


def first_at_least(df: DataFrame, key: str, value: Any) -> DataFrame:
    return df.where(F.col(key) >= value).agg(F.min(key).alias(key))


def last_at_most(df: DataFrame, key: str, value: Any) -> DataFrame:
    return df.where(F.col(key) <= value).agg(F.max(key).alias(key))


def ordered_scan(df: DataFrame, key: str) -> DataFrame:
    return df.orderBy(key)


def bulk_insert(df: DataFrame, new: DataFrame) -> DataFrame:
    return df.unionByName(new)


def bulk_delete(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """Rows whose key is in no row of keys."""
    return df.join(keys.select(F.col(key).alias("_k")), F.col(key) == F.col("_k"), "left_anti")


@query("index_point_lookup", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey = 77")
def index_point_lookup(spark: SparkSession, d: str) -> DataFrame:
    return point_lookup(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", 77)


@query("index_duplicates", "SELECT l_orderkey, l_partkey FROM lineitem WHERE l_partkey = 42")
def index_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return point_lookup(table(spark, d, "lineitem").select("l_orderkey", "l_partkey"), "l_partkey", 42)


@query("index_range_scan", "SELECT o_orderkey FROM orders WHERE o_orderkey BETWEEN 30 AND 50 ORDER BY o_orderkey")
def index_range_scan(spark: SparkSession, d: str) -> DataFrame:
    return range_scan(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 30, 50)


@query("index_first_ge", "SELECT min(o_totalprice) AS o_totalprice FROM orders WHERE o_totalprice >= 250000")
def index_first_ge(spark: SparkSession, d: str) -> DataFrame:
    return first_at_least(table(spark, d, "orders"), "o_totalprice", 250000)


@query("index_last_le", "SELECT max(o_totalprice) AS o_totalprice FROM orders WHERE o_totalprice <= 250000")
def index_last_le(spark: SparkSession, d: str) -> DataFrame:
    return last_at_most(table(spark, d, "orders"), "o_totalprice", 250000)


@query("index_ordered_scan", "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey")
def index_ordered_scan(spark: SparkSession, d: str) -> DataFrame:
    return ordered_scan(table(spark, d, "customer").select("c_custkey", "c_name"), "c_custkey")


@query("index_bulk_delete", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 40)")
def index_bulk_delete(spark: SparkSession, d: str) -> DataFrame:
    keys = table(spark, d, "lineitem").where("l_quantity > 40").select(F.col("l_orderkey").alias("o_orderkey"))
    return bulk_delete(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", keys)

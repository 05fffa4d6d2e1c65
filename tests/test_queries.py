"""Every registered query against DuckDB on the smallest tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

import __spark_entry__
from tessella.operators import registry, statistics
from tessella.operators.index import range_scan
from tessella.operators.relational import full_join
from tessella.session import TABLES
from tessella.streaming.windows import event_stream, sessions, tumbling

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(rows):
    return sorted(tuple("~" if x is None or (isinstance(x, float) and math.isnan(x)) else f"{x:.6g}" if isinstance(x, float) else str(x) for x in r) for r in rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = [tuple(r) for r in df.select(*[f"`{n}`" for n in names]).collect()]
    if name not in registry.SQL:
        assert got
        return
    want = duck.sql(registry.SQL[name])
    assert sorted(want.columns) == names
    assert plain(got) == plain(want.select(*[duckdb.ColumnExpression(n) for n in names]).fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 5
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_index_contract(spark):
    keys = spark.range(100).selectExpr("id AS k", "id AS rid")
    assert [r.k for r in range_scan(keys, "k", 30, 50).collect()] == list(range(30, 51))


def test_histogram_of_few_rows_and_selectivity(spark):
    df = spark.range(7).selectExpr("id AS v", "id AS t")
    h = statistics.equal_depth_histogram(df, "v", ["t"], 3)
    assert [(r.bucket, r.lo, r.hi, r.n) for r in h.orderBy("bucket").collect()] == [(0, 0, 1, 2), (1, 2, 3, 2), (2, 4, 5, 2), (3, 6, 6, 1)]
    assert statistics.histogram_percentile(h, 0.5).first()[0] == 3 and statistics.histogram_percentile(h, 2).first()[0] is None
    assert statistics.spearman(df.where("v < 0"), "v", "t", ["t"]).first()[0] == 0.0
    assert statistics.selectivity("=", 4) == 0.25 and round(statistics.join_selectivity(10, 20, 0.5), 6) == 0.075


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables")
@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_ranks_of_many_rows(spark, duck, adaptive):
    """Several splits, and columns of the order that nothing else needs."""
    path = "/root/testdata/sf0.1/lineitem.parquet"
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2m")
    try:
        lines = spark.read.parquet(path)
        tie = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
        found = statistics.ranks(lines, ["l_quantity", *tie], "r").agg({"r": "max", "*": "count"}).first()
        assert set(found) == {600_000}
        assert statistics.ranks(lines, ["l_quantity", *tie], "r").select("r").distinct().count() == 600_000
        got = statistics.spearman(lines, "l_extendedprice", "l_quantity", tie).first()[0]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    order = ", ".join(tie)
    want = duck.sql(f"SELECT corr(x, y) FROM (SELECT row_number() OVER (ORDER BY l_extendedprice, {order}) x, row_number() OVER (ORDER BY l_quantity, {order}) y FROM '{path}')").fetchall()[0][0]
    assert abs(got - want) < 1e-9


def test_stream_equals_batch(spark, tmp_path):
    spark.read.parquet(f"{SF}/events.parquet").write.parquet(str(tmp_path / "in"))
    q = tumbling(event_stream(spark, str(tmp_path / "in")), "1 day").writeStream.outputMode("complete").format("memory").queryName("tumbled").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("tumbled").count() == registry.QUERIES["ext_tumbling_window"](spark, SF).count()
    batch = spark.read.parquet(f"{SF}/events.parquet").selectExpr("*", "cast(ts AS timestamp) AS at")
    assert sessions(batch, "1 hour").groupBy().sum("n").first()[0] == batch.count()


def test_full_join_of_rows_that_share_a_key(spark, tmp_path):
    """No task makes all pairs of a key; rows without a partner, and null keys, stay once."""
    from pyspark.sql import functions as F

    spark.range(3002).selectExpr("id AS s_suppkey", "cast(if(id < 3000, 9, id - 3000) AS int) AS s_nationkey").write.parquet(str(tmp_path / "supplier.parquet"))
    spark.range(5003).selectExpr("id AS c_custkey", "cast(if(id < 5000, 9, id - 4980) AS int) AS c_nationkey").write.parquet(str(tmp_path / "customer.parquet"))
    tasks = registry.QUERIES["join_full"](spark, str(tmp_path)).groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"), F.count("s_suppkey").alias("s"), F.count("c_custkey").alias("c"), F.sum("s_suppkey").alias("x"), F.sum("c_custkey").alias("y")).collect()
    pairs = 3000 * 5000
    assert sum(r.n for r in tasks) == pairs + 5 and sum(r.s for r in tasks) == pairs + 2 and sum(r.c for r in tasks) == pairs + 3
    assert sum(r.x or 0 for r in tasks) == 5000 * sum(range(3000)) + 6001 and sum(r.y or 0 for r in tasks) == 3000 * sum(range(5000)) + 15003
    assert max(r.n for r in tasks) < 0.7 * pairs


@pytest.mark.parametrize("block", [1, 3, 100])
def test_full_join_in_blocks(spark, block):
    a = [(i, k) for i, k in enumerate([1] * 7 + [2, 2, 3, None, None, 5])]
    b = [(str(i), k) for i, k in enumerate([1] * 5 + [2] * 4 + [4, None] + [5] * 2)]
    left, right = spark.createDataFrame(a + a[:2], "a long, k int"), spark.createDataFrame(b, "b string, l int")
    want = left.join(right, left.k == right.l, "full")
    got = full_join(left, right, "k", "l", block)
    assert got.columns == want.columns and plain(got.collect()) == plain(want.collect())
    none = right.where("false")
    assert plain(full_join(left, none, "k", "l", block).collect()) == plain(left.join(none, left.k == none.l, "full").collect())


def test_format_bytes_of_large_numbers(spark, tmp_path):
    """The query has units up to MB, the function up to TB; null is null."""
    from tessella.functions.scalar import format_bytes

    keys = [(k,) for k in (None, 0, 3, 4, 4080, 4081, 4_177_983, 4_177_984, 9_000_000, 4_278_255_361, -5)]
    spark.createDataFrame(keys, "o_orderkey long").write.parquet(str(tmp_path / "orders.parquet"))
    got = [tuple(r) for r in registry.QUERIES["fn_format_bytes"](spark, str(tmp_path)).collect()]
    own = duckdb.connect()
    own.sql(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    assert plain(got) == plain(own.sql(registry.SQL["fn_format_bytes"]).fetchall())
    sizes = spark.createDataFrame([(1023,), (1024,), (2**30,), (3 * 2**39,), (2**51,), (None,)], "n long")
    assert [r[0] for r in sizes.select(format_bytes(sizes.n)).collect()] == ["1023.00 B", "1.00 KB", "1.00 GB", "1.50 TB", "2048.00 TB", None]


@pytest.mark.parametrize("rows", [0, 1, 500, 1_000_000, 1_000_001])
def test_sample_of_few_and_many_rows(spark, tmp_path, rows):
    spark.range(rows).selectExpr("id AS l_orderkey").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = [tuple(r) for r in registry.QUERIES["stats_sample"](spark, str(tmp_path)).collect()]
    own = duckdb.connect()
    own.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    assert got == own.sql(registry.SQL["stats_sample"]).fetchall()

"""Queries that show a table's state after statements; each works on an engine of its own in a scratch folder."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..engine import Engine
from ..session import shared_dir, table
from ..sources.files import read_csv, write_csv
from .registry import query


def scratch(spark: SparkSession) -> str:
    """A new folder that all executors share; it is removed when Python ends."""
    path = f"{shared_dir(spark).rstrip('/')}/engine-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_clear)
    _made.append((spark, path))
    return path


_made: list[tuple[SparkSession, str]] = []


def _clear() -> None:
    for spark, path in _made:
        try:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the JVM has ended, and with it a local session's folder
            return


def engine(spark: SparkSession, d: str, **tables: str) -> Engine:
    """An engine with tables: name = columns of the table of that name."""
    e = Engine(spark, scratch(spark))
    for name, columns in tables.items():
        e.create_from(name, table(spark, d, name).selectExpr(*[c.strip() for c in columns.split(",")]))
    return e


_NATION = "n_nationkey, n_name, n_regionkey"
_SUPPLIER = "s_suppkey, s_nationkey, s_acctbal"


@query("csv_roundtrip", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def csv_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    path = f"{scratch(spark)}/nation.csv"
    nation = table(spark, d, "nation")
    write_csv(nation, path)
    return read_csv(spark, path, nation.schema)


@query("dml_insert_values", "SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL VALUES (100, 'ATLANTIS', 4), (101, 'EL DORADO', 1)")
def dml_insert_values(spark: SparkSession, d: str) -> DataFrame:
    e = engine(spark, d, nation=_NATION)
    e.sql("INSERT INTO nation VALUES (100, 'ATLANTIS', 4), (101, 'EL DORADO', 1)")
    return e.table("nation")


@query("dml_insert_columns", "SELECT 1 AS id, 'ana' AS name, 7 AS level UNION ALL SELECT 2, NULL, 7 UNION ALL SELECT 3, 'eva', 9")
def dml_insert_columns(spark: SparkSession, d: str) -> DataFrame:
    e = engine(spark, d)
    e.sql("CREATE TABLE t (id INT AUTO_INCREMENT PRIMARY KEY, name VARCHAR(20), level INT DEFAULT 7)")
    e.sql("INSERT INTO t (name) VALUES ('ana'); INSERT INTO t (name) VALUES (NULL); INSERT INTO t (level, name) VALUES (9, 'eva')")
    return e.table("t")


@query("dml_insert_select", "SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier UNION ALL SELECT s_suppkey + 100000, s_nationkey, s_acctbal FROM supplier WHERE s_acctbal > 5000")
def dml_insert_select(spark: SparkSession, d: str) -> DataFrame:
    e = engine(spark, d, supplier=_SUPPLIER)
    e.sql("INSERT INTO supplier SELECT s_suppkey + 100000, s_nationkey, s_acctbal FROM supplier WHERE s_acctbal > 5000")
    return e.table("supplier")


@query("dml_update", "SELECT s_suppkey, s_nationkey, CASE WHEN s_nationkey = 3 THEN round(s_acctbal * 2, 2) ELSE s_acctbal END AS s_acctbal FROM supplier")
def dml_update(spark: SparkSession, d: str) -> DataFrame:
    e = engine(spark, d, supplier=_SUPPLIER)
    e.sql("UPDATE supplier SET s_acctbal = round(s_acctbal * 2, 2) WHERE s_nationkey = 3")
    return e.table("supplier")


@query("dml_update_multi", "SELECT CASE WHEN n_regionkey > 2 THEN n_regionkey ELSE n_nationkey END AS n_nationkey, n_name, CASE WHEN n_regionkey > 2 THEN n_nationkey ELSE n_regionkey END AS n_regionkey FROM nation")
def dml_update_multi(spark: SparkSession, d: str) -> DataFrame:
    """Both expressions read the old row, so that the values change places."""
    e = engine(spark, d, nation=_NATION)
    e.sql("UPDATE nation SET n_nationkey = n_regionkey, n_regionkey = n_nationkey WHERE n_regionkey > 2")
    return e.table("nation")


@query("dml_delete", "SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier WHERE NOT (s_acctbal < 1000 AND s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1))")
def dml_delete(spark: SparkSession, d: str) -> DataFrame:
    e = engine(spark, d, supplier=_SUPPLIER, nation=_NATION)
    e.sql("DELETE FROM supplier WHERE s_acctbal < 1000 AND s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
    return e.table("supplier")


@query("dml_delete_all", "SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE false")
def dml_delete_all(spark: SparkSession, d: str) -> DataFrame:
    e = engine(spark, d, nation=_NATION)
    e.sql("DELETE FROM nation")
    return e.table("nation")


@query("txn_commit", "SELECT n_nationkey, upper(n_name) AS n_name, n_regionkey FROM nation WHERE n_regionkey <> 4 UNION ALL VALUES (50, 'NEW', 0)")
def txn_commit(spark: SparkSession, d: str) -> DataFrame:
    e = engine(spark, d, nation=_NATION)
    e.sql("BEGIN; DELETE FROM nation WHERE n_regionkey = 4; INSERT INTO nation VALUES (50, 'new', 0); UPDATE nation SET n_name = upper(n_name); COMMIT")
    return Engine(spark, e.store.root).table("nation")


@query("txn_rollback", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def txn_rollback(spark: SparkSession, d: str) -> DataFrame:
    e = engine(spark, d, nation=_NATION)
    e.sql("BEGIN TRANSACTION; DELETE FROM nation; ROLLBACK")
    return e.table("nation")


@query("txn_savepoint", "SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey <> 0")
def txn_savepoint(spark: SparkSession, d: str) -> DataFrame:
    e = engine(spark, d, nation=_NATION)
    e.sql("BEGIN; DELETE FROM nation WHERE n_regionkey = 0; SAVEPOINT one; DELETE FROM nation; ROLLBACK TO SAVEPOINT one; COMMIT")
    return e.table("nation")


@query("view_query", "SELECT n_name FROM nation WHERE n_regionkey = 2")
def view_query(spark: SparkSession, d: str) -> DataFrame:
    e = engine(spark, d, nation=_NATION)
    e.sql("CREATE VIEW asia AS SELECT * FROM nation WHERE n_regionkey = 2; CREATE VIEW names (n_name) AS SELECT n_name FROM asia")
    return e.sql("SELECT n_name FROM names")


@query("matview_refresh", "SELECT n_regionkey, count(*) - 1 AS n FROM nation GROUP BY n_regionkey")
def matview_refresh(spark: SparkSession, d: str) -> DataFrame:
    e = engine(spark, d, nation=_NATION)
    e.sql("CREATE MATERIALIZED VIEW sizes AS SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey")
    e.sql("DELETE FROM nation WHERE n_nationkey IN (SELECT min(n_nationkey) FROM nation GROUP BY n_regionkey)")
    e.sql("REFRESH MATERIALIZED VIEW sizes")
    return e.sql("SELECT * FROM sizes")


@query("temp_table", "SELECT c_custkey FROM customer WHERE c_acctbal > 9000")
def temp_table(spark: SparkSession, d: str) -> DataFrame:
    e = engine(spark, d)
    e.temp_table("rich", table(e.spark, d, "customer").where("c_acctbal > 9000"))
    return e.sql("SELECT c_custkey FROM rich")


@query("prepared_query", "SELECT n_name FROM nation WHERE n_regionkey = 3 AND n_nationkey > 6")
def prepared_query(spark: SparkSession, d: str) -> DataFrame:
    e = engine(spark, d, nation=_NATION)
    e.prepare("p", "SELECT n_name FROM nation WHERE n_regionkey = :region AND n_nationkey > :least")
    return e.execute_prepared("p", region=3, least=6)


@query("sequence_nextval", "SELECT * FROM (VALUES (1, 5), (2, 7), (3, 9), (4, 4), (5, 6)) AS t(k, v)")
def sequence_nextval(spark: SparkSession, d: str) -> DataFrame:
    e = engine(spark, d)
    e.sql("CREATE SEQUENCE s START WITH 5 INCREMENT BY 2 MINVALUE 4 MAXVALUE 10 CYCLE")
    return e.spark.createDataFrame([(k, e.next_value("s")) for k in range(1, 6)], "k int, v int")


@query("create_index_lookup", "SELECT s_suppkey, s_acctbal FROM supplier WHERE s_nationkey = 7")
def create_index_lookup(spark: SparkSession, d: str) -> DataFrame:
    e = engine(spark, d, supplier=_SUPPLIER)
    e.sql("CREATE INDEX by_nation ON supplier (s_nationkey)")
    return e.indexed("by_nation").where(F.col("s_nationkey") == 7).select("s_suppkey", "s_acctbal")

"""Scans, projections, predicates, subqueries, joins, aggregates, sorting and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import int_div
from ..plans.dialect import run_query
from ..session import register_views, table
from .registry import query

# Scans


@query("scan_table", "SELECT r_regionkey, r_name FROM region")
def scan_table(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "region").select("r_regionkey", "r_name")


@query("scan_values", "SELECT * FROM (VALUES (1, 'oak', 2.5), (2, 'élan', 0.5), (3, NULL, -4.0)) AS t(code, label, weight)")
def scan_values(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql("SELECT * FROM VALUES (1, 'oak', 2.5), (2, 'élan', 0.5), (3, NULL, -4.0) AS t(code, label, weight)")


@query("derived_table", "SELECT o_orderstatus, n FROM (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus) t WHERE n > 100")
def derived_table(spark: SparkSession, d: str) -> DataFrame:
    inner = table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n")).alias("t")
    return inner.where("t.n > 100").select("o_orderstatus", "n")


@query("implicit_cross_join", "SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey")
def implicit_cross_join(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").crossJoin(table(spark, d, "region")).where("n_regionkey = r_regionkey").select("n_name", "r_name")


@query("table_alias", "SELECT a.n_name AS name FROM nation AS a WHERE a.n_regionkey = 1")
def table_alias(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").alias("a").where("a.n_regionkey = 1").select(F.col("a.n_name").alias("name"))


@query("option_scan", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def option_scan(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("row_count", "SELECT count(*) AS n FROM lineitem")
def row_count(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").agg(F.count(F.lit(1)).alias("n"))


# Projection and expressions


@query("project_star", "SELECT * FROM region")
def project_star(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "region").select("*")


@query("project_columns", "SELECT o_orderkey, o_totalprice FROM orders")
def project_columns(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice")


@query("project_qualified", "SELECT nation.n_nationkey, nation.n_name FROM nation")
def project_qualified(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").alias("nation").select("nation.n_nationkey", "nation.n_name")


@query("project_alias_expr", "SELECT l_orderkey, round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem")
def project_alias_expr(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4).alias("net"))


@query("distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def distinct(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderstatus", "o_orderpriority").distinct()


@query("arith_ops", "SELECT l_linenumber + 1 AS a, l_linenumber - 1 AS b, l_linenumber * 3 AS c, l_extendedprice / l_quantity AS q FROM lineitem")
def arith_ops(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("l_linenumber")
    return table(spark, d, "lineitem").select((n + 1).alias("a"), (n - 1).alias("b"), (n * 3).alias("c"), F.try_divide("l_extendedprice", "l_quantity").alias("q"))


@query("int_div_mod", "SELECT l_orderkey, CAST(l_orderkey // nullif(l_linenumber, 0) AS BIGINT) AS q, l_orderkey % nullif(l_linenumber, 0) AS r FROM lineitem")
def int_div_mod(spark: SparkSession, d: str) -> DataFrame:
    k, n = F.col("l_orderkey"), F.col("l_linenumber").cast("long")
    return table(spark, d, "lineitem").select("l_orderkey", int_div(k, n).alias("q"), F.try_mod(k, n).alias("r"))


@query("div_by_zero_null", "SELECT l_orderkey, CAST(l_linenumber // nullif(l_linenumber - l_linenumber, 0) AS BIGINT) AS q, l_linenumber % nullif(l_linenumber - l_linenumber, 0) AS r, round(l_quantity / nullif(l_discount, 0), 4) AS f FROM lineitem")
def div_by_zero_null(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("l_linenumber")
    return table(spark, d, "lineitem").select("l_orderkey", int_div(n, n - n).alias("q"), F.try_mod(n, n - n).alias("r"), F.round(F.try_divide("l_quantity", "l_discount"), 4).alias("f"))


@query("unary_minus", "SELECT c_custkey, -c_acctbal AS neg, +c_acctbal AS pos FROM customer")
def unary_minus(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", (-F.col("c_acctbal")).alias("neg"), F.col("c_acctbal").alias("pos"))


@query("concat_op", "SELECT n_name || '-' || CAST(n_regionkey AS VARCHAR) AS tag, n_name || nullif(n_name, n_name) AS nothing FROM nation")
def concat_op(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").selectExpr("n_name || '-' || cast(n_regionkey AS string) AS tag", "n_name || nullif(n_name, n_name) AS nothing")


@query("case_when", "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS class FROM part")
def case_when(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size")
    return table(spark, d, "part").select("p_partkey", F.when(size < 10, "small").when(size < 30, "medium").otherwise("large").alias("class"))


@query("literals", "SELECT r_regionkey, 7 AS i, CAST(2.5 AS DOUBLE) AS f, 'text' AS s, TRUE AS b, CAST(NULL AS INTEGER) AS nothing FROM region")
def literals(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "region").select("r_regionkey", F.lit(7).alias("i"), F.lit(2.5).alias("f"), F.lit("text").alias("s"), F.lit(True).alias("b"), F.lit(None).cast("int").alias("nothing"))


@query("precedence", "SELECT n_nationkey, n_nationkey + 2 * 3 - 4 AS a, (n_nationkey + 2) * 3 AS b, NOT n_nationkey = 3 OR n_nationkey > 5 AND n_regionkey = 1 AS c FROM nation")
def precedence(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").selectExpr("n_nationkey", "n_nationkey + 2 * 3 - 4 AS a", "(n_nationkey + 2) * 3 AS b", "NOT n_nationkey = 3 OR n_nationkey > 5 AND n_regionkey = 1 AS c")


# Predicates; all of them reach the Parquet scan, but for the last two


def _lineitem(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem")


_LINE = ("l_orderkey", "l_linenumber", "l_quantity")
_PICK = "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE "


@query("filter_eq", _PICK + "l_linenumber = 3 AND l_returnflag = 'R'")
def filter_eq(spark: SparkSession, d: str) -> DataFrame:
    return _lineitem(spark, d).where((F.col("l_linenumber") == 3) & (F.col("l_returnflag") == "R")).select(*_LINE)


@query("filter_ne", _PICK + "l_linenumber <> 3")
def filter_ne(spark: SparkSession, d: str) -> DataFrame:
    return _lineitem(spark, d).where(F.col("l_linenumber") != 3).select(*_LINE)


@query("filter_range", _PICK + "l_quantity >= 10 AND l_quantity < 20 AND l_shipdate > TIMESTAMP '1998-01-01' AND l_linenumber <= 4")
def filter_range(spark: SparkSession, d: str) -> DataFrame:
    return _lineitem(spark, d).where("l_quantity >= 10 AND l_quantity < 20 AND l_shipdate > timestamp_ntz '1998-01-01 00:00:00' AND l_linenumber <= 4").select(*_LINE)


@query("filter_and_or_not", _PICK + "(l_linenumber = 1 OR l_quantity > 45) AND NOT l_returnflag = 'A'")
def filter_and_or_not(spark: SparkSession, d: str) -> DataFrame:
    return _lineitem(spark, d).where(((F.col("l_linenumber") == 1) | (F.col("l_quantity") > 45)) & ~(F.col("l_returnflag") == "A")).select(*_LINE)


@query("filter_null_safe_eq", "SELECT o_orderkey FROM orders WHERE nullif(o_orderstatus, 'P') IS NOT DISTINCT FROM NULL")
def filter_null_safe_eq(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").where(F.nullif("o_orderstatus", F.lit("P")).eqNullSafe(F.lit(None))).select("o_orderkey")


@query("like", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%a%' AND p_brand LIKE 'Brand#_'")
def like(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").where(F.col("p_name").like("%a%") & F.col("p_brand").like("Brand#_")).select("p_partkey", "p_name")


@query("not_like", "SELECT p_partkey FROM part WHERE p_type NOT LIKE 'S%'")
def not_like(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").where(~F.col("p_type").like("S%")).select("p_partkey")


@query("in_list", "SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW')")
def in_list(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").where(F.col("o_orderpriority").isin("1-URGENT", "5-LOW")).select("o_orderkey")


@query("not_in_list", "SELECT o_orderkey FROM orders WHERE o_orderstatus NOT IN ('F', 'O')")
def not_in_list(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").where(~F.col("o_orderstatus").isin("F", "O")).select("o_orderkey")


@query("between", _PICK + "l_quantity BETWEEN 5 AND 10")
def between(spark: SparkSession, d: str) -> DataFrame:
    return _lineitem(spark, d).where(F.col("l_quantity").between(5, 10)).select(*_LINE)


@query("not_between", _PICK + "l_quantity NOT BETWEEN 5 AND 45")
def not_between(spark: SparkSession, d: str) -> DataFrame:
    return _lineitem(spark, d).where(~F.col("l_quantity").between(5, 45)).select(*_LINE)


def _orders_with_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select("l_orderkey").distinct()
    return table(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")


@query("is_null", "SELECT o_orderkey FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem) l ON o_orderkey = l_orderkey WHERE l_orderkey IS NULL")
def is_null(spark: SparkSession, d: str) -> DataFrame:
    return _orders_with_lines(spark, d).where(F.col("l_orderkey").isNull()).select("o_orderkey")


@query("is_not_null", "SELECT o_orderkey FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem) l ON o_orderkey = l_orderkey WHERE l_orderkey IS NOT NULL")
def is_not_null(spark: SparkSession, d: str) -> DataFrame:
    return _orders_with_lines(spark, d).where(F.col("l_orderkey").isNotNull()).select("o_orderkey")


# Subqueries


@query("in_subquery", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def in_subquery(spark: SparkSession, d: str) -> DataFrame:
    big = table(spark, d, "orders").where("o_totalprice > 400000")
    return table(spark, d, "customer").join(big, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


_NOT_IN = "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)"


def not_in(df: DataFrame, x: Column, values: DataFrame, v: str) -> DataFrame:
    """Rows whose x is NOT IN the column v of values: all if there is no value, none if one is null, else those with an x that is no value.

    An anti join on the equality, which can be a shuffled one, and one aggregate. Spark's own plan broadcasts all values.
    """
    told = values.agg(F.count(F.lit(1)).alias("_every"), F.count(v).alias("_known"))
    left = df.join(values.select(F.col(v).alias("_v")), x == F.col("_v"), "left_anti")
    return left.crossJoin(F.broadcast(told)).where((F.col("_every") == 0) | ((F.col("_every") == F.col("_known")) & x.isNotNull())).drop("_every", "_known")


@query("not_in_subquery", _NOT_IN)
def not_in_subquery(spark: SparkSession, d: str) -> DataFrame:
    return not_in(table(spark, d, "customer").select("c_custkey"), F.col("c_custkey"), table(spark, d, "orders").where("o_totalprice > 200000"), "o_custkey")


@query("not_in_subquery_null", "SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT nullif(r_regionkey, 0) FROM region)")
def not_in_subquery_null(spark: SparkSession, d: str) -> DataFrame:
    register_views(spark, d, ("nation", "region"))
    return run_query(spark, "SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT nullif(r_regionkey, 0) FROM region)")


@query("not_in_subquery_text", "SELECT c_custkey FROM customer WHERE c_custkey + 1 NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000) AND c_acctbal > 0")
def not_in_subquery_text(spark: SparkSession, d: str) -> DataFrame:
    register_views(spark, d, ("customer", "orders"))
    return run_query(spark, "SELECT c_custkey FROM customer WHERE c_custkey + 1 NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000) AND c_acctbal > 0")


@query("exists", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P')")
def exists(spark: SparkSession, d: str) -> DataFrame:
    pending = table(spark, d, "orders").where("o_orderstatus = 'P'")
    return table(spark, d, "customer").join(pending, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("not_exists", "SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)")
def not_exists(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey")


@query("any_subquery", "SELECT p_partkey FROM part WHERE p_partkey = ANY (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)")
def any_subquery(spark: SparkSession, d: str) -> DataFrame:
    register_views(spark, d, ("part", "lineitem"))
    return run_query(spark, "SELECT p_partkey FROM part WHERE p_partkey = ANY (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)")


@query("any_subquery_compare", "SELECT p_partkey FROM part WHERE p_retailprice > ANY (SELECT c_acctbal FROM customer WHERE c_acctbal > 1500)")
def any_subquery_compare(spark: SparkSession, d: str) -> DataFrame:
    register_views(spark, d, ("part", "customer"))
    return run_query(spark, "SELECT p_partkey FROM part WHERE p_retailprice > SOME (SELECT c_acctbal FROM customer WHERE c_acctbal > 1500)")


@query("any_subquery_expression", "SELECT p_partkey FROM part WHERE p_size * 2 + 1 < ANY (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)")
def any_subquery_expression(spark: SparkSession, d: str) -> DataFrame:
    register_views(spark, d, ("part", "nation"))
    return run_query(spark, "SELECT p_partkey FROM part WHERE p_size * 2 + 1 < ANY (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)")


@query("scalar_subquery", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)")
def scalar_subquery(spark: SparkSession, d: str) -> DataFrame:
    register_views(spark, d, ("orders",))
    return spark.sql("SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)")


_CORRELATED = "SELECT o.o_orderkey FROM orders o WHERE o.o_totalprice = (SELECT max(p.o_totalprice) FROM orders p WHERE p.o_custkey = o.o_custkey)"


@query("correlated_scalar", _CORRELATED)
def correlated_scalar(spark: SparkSession, d: str) -> DataFrame:
    """The subquery's maximum as a window: one shuffle, where a join with the aggregate takes two."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    most = F.max("o_totalprice").over(Window.partitionBy("o_custkey"))
    return orders.withColumn("_most", most).where("o_totalprice = _most AND o_custkey IS NOT NULL").select("o_orderkey")


# Joins


def _customer_orders(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, d, "customer").select("c_custkey", "c_name"), table(spark, d, "orders").where("o_totalprice > 300000").select("o_orderkey", "o_custkey")


def _join_sql(kind: str) -> str:
    return f"SELECT c_custkey, c_name, o_orderkey FROM (SELECT c_custkey, c_name FROM customer) c {kind} JOIN (SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice > 300000) o ON c_custkey = o_custkey"


def _joined(spark: SparkSession, d: str, how: str, hint: str | None = None) -> DataFrame:
    c, o = _customer_orders(spark, d)
    return c.join(o.hint(hint) if hint else o, F.col("c_custkey") == F.col("o_custkey"), how).select("c_custkey", "c_name", "o_orderkey")


@query("join_inner", _join_sql("INNER"))
def join_inner(spark: SparkSession, d: str) -> DataFrame:
    return _joined(spark, d, "inner")


@query("join_left", _join_sql("LEFT"))
def join_left(spark: SparkSession, d: str) -> DataFrame:
    return _joined(spark, d, "left")


@query("join_right", "SELECT o_orderkey, l_partkey FROM (SELECT l_orderkey, l_partkey FROM lineitem WHERE l_quantity > 48) l RIGHT JOIN orders ON o_orderkey = l_orderkey")
def join_right(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").where("l_quantity > 48").select("l_orderkey", "l_partkey")
    return lines.join(table(spark, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey"), "right").select("o_orderkey", "l_partkey")


#: Rows of either side, about, that meet in one block of full_join().
BLOCK = 2048


def full_join(left: DataFrame, right: DataFrame, x: str, y: str, block: int = BLOCK) -> DataFrame:
    """All columns of a full join where x = y, for keys that are few but that many rows share, as nations.

    Spark makes all pairs of a key in one task and can't split it for a full join. Here the rows that a key has on both
    sides are dealt to blocks by hash, each block of one side meets each of the other side's in an inner join, and the rest
    is added with nulls. Only the keys' counts are broadcast.
    """
    n = left.groupBy(F.col(x).alias("_key")).agg(F.ceil(F.count(F.lit(1)) / block).alias("_m")).join(right.groupBy(F.col(y).alias("_key")).agg(F.ceil(F.count(F.lit(1)) / block).alias("_n")), "_key")
    n = F.broadcast(n)

    def dealt(df: DataFrame, key: str, own: str, own_blocks: str, other: str, other_blocks: str) -> DataFrame:
        among = F.pmod(F.xxhash64(*df.columns), own_blocks)
        met = df.join(n, F.col(key) == F.col("_key")).select(*df.columns, "_key", among.alias(own), F.explode(F.sequence(F.lit(1).cast("long"), other_blocks)).alias(other))
        return met.withColumn(other, F.col(other) - 1).repartition(parts, "_key", "_a", "_b")  # by a number, else adaptive execution takes few tasks for few bytes

    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = dealt(left, x, "_a", "_m", "_b", "_n").join(dealt(right, y, "_b", "_n", "_a", "_m").hint("merge"), ["_key", "_a", "_b"]).select(*left.columns, *right.columns)
    alone = [df.join(n, F.col(key) == F.col("_key"), "left_anti") for df, key in ((left, x), (right, y))]
    return both.unionByName(alone[0], allowMissingColumns=True).unionByName(alone[1], allowMissingColumns=True)


@query("join_full", "SELECT s_suppkey, c_custkey FROM (SELECT s_suppkey, s_nationkey FROM supplier WHERE s_nationkey < 12) s FULL JOIN (SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey > 8) c ON s_nationkey = c_nationkey")
def join_full(spark: SparkSession, d: str) -> DataFrame:
    s, c = table(spark, d, "supplier").where("s_nationkey < 12"), table(spark, d, "customer").where("c_nationkey > 8")
    return full_join(s.select("s_suppkey", "s_nationkey"), c.select("c_custkey", "c_nationkey"), "s_nationkey", "c_nationkey").select("s_suppkey", "c_custkey")


@query("join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation")
def join_cross(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "region").crossJoin(table(spark, d, "nation")).select("r_name", "n_name")


@query("join_natural", "SELECT k, n_name, r_name FROM (SELECT n_regionkey AS k, n_name FROM nation) a NATURAL JOIN (SELECT r_regionkey AS k, r_name FROM region) b")
def join_natural(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "nation").selectExpr("n_regionkey AS k", "n_name")
    b = table(spark, d, "region").selectExpr("r_regionkey AS k", "r_name")
    return a.join(b, [c for c in a.columns if c in b.columns]).select("k", "n_name", "r_name")


@query("join_using", "SELECT k, c_custkey, s_suppkey FROM (SELECT c_nationkey AS k, c_custkey FROM customer WHERE c_acctbal > 9000) a JOIN (SELECT s_nationkey AS k, s_suppkey FROM supplier) b USING (k)")
def join_using(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "customer").where("c_acctbal > 9000").selectExpr("c_nationkey AS k", "c_custkey")
    return a.join(table(spark, d, "supplier").selectExpr("s_nationkey AS k", "s_suppkey"), ["k"]).select("k", "c_custkey", "s_suppkey")


@query("join_theta", "SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation a JOIN nation b ON a.n_regionkey < b.n_regionkey AND a.n_nationkey > b.n_nationkey")
def join_theta(spark: SparkSession, d: str) -> DataFrame:
    a, b = table(spark, d, "nation").alias("a"), table(spark, d, "nation").alias("b")
    both = a.join(b, (F.col("a.n_regionkey") < F.col("b.n_regionkey")) & (F.col("a.n_nationkey") > F.col("b.n_nationkey")))
    return both.select(F.col("a.n_nationkey").alias("x"), F.col("b.n_nationkey").alias("y"))


@query("join_self", "SELECT a.s_suppkey AS x, b.s_suppkey AS y FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey")
def join_self(spark: SparkSession, d: str) -> DataFrame:
    a, b = table(spark, d, "supplier").alias("a"), table(spark, d, "supplier").alias("b")
    both = a.join(b, (F.col("a.s_nationkey") == F.col("b.s_nationkey")) & (F.col("a.s_suppkey") < F.col("b.s_suppkey")))
    return both.select(F.col("a.s_suppkey").alias("x"), F.col("b.s_suppkey").alias("y"))


@query(
    "join_multiway",
    "SELECT r_name, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
)
def join_multiway(spark: SparkSession, d: str) -> DataFrame:
    joined = (
        table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    return joined.groupBy("r_name").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"))


@query("join_subquery", "SELECT c_custkey, n FROM customer JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) t ON c_custkey = o_custkey")
def join_subquery(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return table(spark, d, "customer").join(t, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "n")


@query("join_semi", "SELECT p_partkey FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 49)")
def join_semi(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").join(table(spark, d, "lineitem").where("l_quantity > 49"), F.col("l_partkey") == F.col("p_partkey"), "left_semi").select("p_partkey")


@query("join_anti", "SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 49)")
def join_anti(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").join(table(spark, d, "lineitem").where("l_quantity > 49"), F.col("l_partkey") == F.col("p_partkey"), "left_anti").select("p_partkey")


@query("join_hint_nested_loop", "SELECT r_name, n_name FROM nation JOIN region ON n_regionkey >= r_regionkey")
def join_hint_nested_loop(spark: SparkSession, d: str) -> DataFrame:
    """The broadcast side is the five-row region table, not one that grows."""
    return table(spark, d, "nation").join(table(spark, d, "region").hint("broadcast"), F.col("n_regionkey") >= F.col("r_regionkey")).select("r_name", "n_name")


@query("join_hint_hash", _join_sql("INNER"))
def join_hint_hash(spark: SparkSession, d: str) -> DataFrame:
    return _joined(spark, d, "inner", "shuffle_hash")


@query("join_hint_merge", _join_sql("INNER"))
def join_hint_merge(spark: SparkSession, d: str) -> DataFrame:
    return _joined(spark, d, "inner", "merge")


# Aggregates


@query("agg_global", "SELECT count(*) AS n, round(sum(l_quantity), 2) AS s, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem")
def agg_global(spark: SparkSession, d: str) -> DataFrame:
    return _lineitem(spark, d).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("s"), F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi"))


@query("agg_empty_input", "SELECT count(*) AS n, sum(l_quantity) AS s, avg(l_quantity) AS a, min(l_quantity) AS lo FROM lineitem WHERE false")
def agg_empty_input(spark: SparkSession, d: str) -> DataFrame:
    return _lineitem(spark, d).where(F.lit(False)).agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("s"), F.avg("l_quantity").alias("a"), F.min("l_quantity").alias("lo"))


@query("agg_group_by", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS s FROM lineitem GROUP BY l_returnflag, l_linestatus")
def agg_group_by(spark: SparkSession, d: str) -> DataFrame:
    return _lineitem(spark, d).groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("s"))


@query("agg_group_by_expr", "SELECT CAST(year(l_shipdate) AS INTEGER) AS y, l_quantity > 25 AS big, count(*) AS n FROM lineitem GROUP BY 1, 2")
def agg_group_by_expr(spark: SparkSession, d: str) -> DataFrame:
    return _lineitem(spark, d).groupBy(F.year("l_shipdate").alias("y"), (F.col("l_quantity") > 25).alias("big")).agg(F.count(F.lit(1)).alias("n"))


@query("agg_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12")
def agg_having(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).where("n > 12")


@query("agg_count", "SELECT count(*) AS every, count(nullif(o_orderstatus, 'F')) AS known FROM orders")
def agg_count(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").agg(F.count(F.lit(1)).alias("every"), F.count(F.nullif("o_orderstatus", F.lit("F"))).alias("known"))


@query("agg_count_distinct", "SELECT o_orderstatus, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY o_orderstatus")
def agg_count_distinct(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count_distinct("o_custkey").alias("customers"))


@query("agg_sum", "SELECT l_returnflag, CAST(sum(l_linenumber) AS BIGINT) AS whole, round(sum(l_extendedprice), 2) AS money FROM lineitem GROUP BY l_returnflag")
def agg_sum(spark: SparkSession, d: str) -> DataFrame:
    return _lineitem(spark, d).groupBy("l_returnflag").agg(F.sum("l_linenumber").alias("whole"), F.round(F.sum("l_extendedprice"), 2).alias("money"))


@query("agg_avg", "SELECT c_mktsegment, round(avg(c_acctbal), 4) AS mean FROM customer GROUP BY c_mktsegment")
def agg_avg(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").groupBy("c_mktsegment").agg(F.round(F.avg("c_acctbal"), 4).alias("mean"))


@query("agg_min_max", "SELECT p_brand, min(p_name) AS first_name, max(p_name) AS last_name, min(p_size) AS lo, max(p_retailprice) AS hi FROM part GROUP BY p_brand")
def agg_min_max(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").groupBy("p_brand").agg(F.min("p_name").alias("first_name"), F.max("p_name").alias("last_name"), F.min("p_size").alias("lo"), F.max("p_retailprice").alias("hi"))


@query("agg_group_concat", "SELECT r_name, string_agg(n_name, ',' ORDER BY n_name) AS nations FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def agg_group_concat(spark: SparkSession, d: str) -> DataFrame:
    both = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return both.groupBy("r_name").agg(F.expr("listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name)").alias("nations"))


@query("agg_group_concat_distinct", "SELECT p_brand, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS types FROM part GROUP BY p_brand")
def agg_group_concat_distinct(spark: SparkSession, d: str) -> DataFrame:
    register_views(spark, d, ("part",))
    return run_query(spark, "SELECT p_brand, GROUP_CONCAT(DISTINCT p_type) AS types FROM part GROUP BY p_brand")


@query("agg_stddev", "SELECT l_returnflag, round(stddev(l_quantity), 4) AS s FROM lineitem GROUP BY l_returnflag")
def agg_stddev(spark: SparkSession, d: str) -> DataFrame:
    return _lineitem(spark, d).groupBy("l_returnflag").agg(F.round(F.stddev("l_quantity"), 4).alias("s"))


@query("agg_variance", "SELECT l_returnflag, round(variance(l_quantity), 4) AS v FROM lineitem GROUP BY l_returnflag")
def agg_variance(spark: SparkSession, d: str) -> DataFrame:
    return _lineitem(spark, d).groupBy("l_returnflag").agg(F.round(F.variance("l_quantity"), 4).alias("v"))


# Sorting and limits


@query("order_multi_key", "SELECT c_nationkey, c_acctbal, c_custkey FROM customer ORDER BY c_nationkey, c_acctbal DESC, c_custkey")
def order_multi_key(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_nationkey", "c_acctbal", "c_custkey").orderBy("c_nationkey", F.desc("c_acctbal"), "c_custkey")


@query("order_by_expr", "SELECT p_partkey, p_size FROM part ORDER BY p_size % 7, p_partkey LIMIT 40")
def order_by_expr(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").orderBy(F.col("p_size") % 7, "p_partkey").limit(40).select("p_partkey", "p_size")


@query("order_by_nulls", "SELECT o_orderkey, nullif(o_orderstatus, 'F') AS s FROM orders ORDER BY s NULLS LAST, o_orderkey LIMIT 50")
def order_by_nulls(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", F.nullif("o_orderstatus", F.lit("F")).alias("s")).orderBy(F.asc_nulls_last("s"), "o_orderkey").limit(50)


@query("limit", "SELECT n_nationkey, n_name FROM nation ORDER BY n_nationkey LIMIT 7")
def limit(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select("n_nationkey", "n_name").orderBy("n_nationkey").limit(7)


@query("limit_offset", "SELECT n_nationkey FROM nation ORDER BY n_nationkey LIMIT 7 OFFSET 5")
def limit_offset(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select("n_nationkey").orderBy("n_nationkey").offset(5).limit(7)


@query("limit_mysql_style", "SELECT n_nationkey FROM nation ORDER BY n_nationkey LIMIT 4 OFFSET 6")
def limit_mysql_style(spark: SparkSession, d: str) -> DataFrame:
    from ..plans.dialect import rewrite

    register_views(spark, d, ("nation",))
    return spark.sql(rewrite("SELECT n_nationkey FROM nation ORDER BY n_nationkey LIMIT 6, 4;"))


@query("limit_zero", "SELECT n_nationkey FROM nation LIMIT 0")
def limit_zero(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select("n_nationkey").limit(0)


@query("top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def top_k(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)


# Set operations


def _two(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")), table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"))


def _set_sql(op: str) -> str:
    return f"SELECT c_nationkey AS k FROM customer {op} SELECT s_nationkey AS k FROM supplier"


@query("union", _set_sql("UNION"))
def union(spark: SparkSession, d: str) -> DataFrame:
    a, b = _two(spark, d)
    return a.union(b).distinct()


@query("union_all", _set_sql("UNION ALL"))
def union_all(spark: SparkSession, d: str) -> DataFrame:
    a, b = _two(spark, d)
    return a.union(b)


@query("intersect", _set_sql("INTERSECT"))
def intersect(spark: SparkSession, d: str) -> DataFrame:
    a, b = _two(spark, d)
    return a.intersect(b)


@query("intersect_all", _set_sql("INTERSECT ALL"))
def intersect_all(spark: SparkSession, d: str) -> DataFrame:
    a, b = _two(spark, d)
    return a.intersectAll(b)


@query("except", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey AS k FROM supplier WHERE s_acctbal > 5000")
def except_(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"))
    return a.subtract(table(spark, d, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("k")))


@query("except_all", _set_sql("EXCEPT ALL"))
def except_all(spark: SparkSession, d: str) -> DataFrame:
    a, b = _two(spark, d)
    return a.exceptAll(b)


_CHAIN = "SELECT r_regionkey AS k FROM region UNION SELECT n_nationkey FROM nation WHERE n_nationkey > 20 INTERSECT SELECT n_nationkey FROM nation WHERE n_regionkey < 3 EXCEPT SELECT r_regionkey FROM region WHERE r_regionkey = 2"


@query("set_op_chain", _CHAIN)
def set_op_chain(spark: SparkSession, d: str) -> DataFrame:
    register_views(spark, d, ("nation", "region"))
    return spark.sql(_CHAIN)


_FLAGSHIP = """SELECT c.c_mktsegment AS segment, count(*) AS n_lines, round(sum(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
WHERE o.o_orderstatus <> 'P' AND l.l_quantity BETWEEN 5 AND 40
GROUP BY c.c_mktsegment HAVING count(*) > 10
ORDER BY revenue DESC, segment LIMIT 5"""


@query("segment_revenue", _FLAGSHIP)
def segment_revenue(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").where(F.col("l_quantity").between(5, 40))
    orders = table(spark, d, "orders").where("o_orderstatus <> 'P'")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    revenue = F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2)
    grouped = joined.groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count(F.lit(1)).alias("n_lines"), revenue.alias("revenue"))
    return grouped.where("n_lines > 10").orderBy(F.desc("revenue"), "segment").limit(5)

"""Column statistics, histograms, percentiles, rank correlation and selectivity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpointed, table
from .registry import query


def column_statistics(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column, row_count, distinct_count, null_count, min, max (text), avg_length.

    Each column is grouped by its values once, and the rest is reckoned from the groups; one aggregate for all columns
    would write each row once for each column.
    """
    names = columns or [f.name for f in df.schema if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))]
    out: DataFrame | None = None
    for n in names:
        c = F.col(f"`{n}`")
        values = df.groupBy(c.alias("v")).agg(F.count(F.lit(1)).alias("n"))
        length = F.sum(F.length("v") * F.col("n")) / F.sum(F.when(F.col("v").isNotNull(), F.col("n"))) if isinstance(df.schema[n].dataType, T.StringType) else F.lit(None).cast("double")
        one = values.agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"), F.count("v").alias("distinct_count"), F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0)).alias("null_count"),
            F.min("v").cast("string").alias("min"), F.max("v").cast("string").alias("max"), length.alias("avg_length"),
        ).select(F.lit(n).alias("column"), "*")
        out = one if out is None else out.unionByName(one)
    return out if out is not None else df.sparkSession.createDataFrame([], "column string, row_count long, distinct_count long, null_count long, min string, max string, avg_length double")


def ranks(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """df with out, its rows' numbers from 1 in the given order, which must be total.

    Ranges of the order are numbered side by side; only the ranges' sizes meet in one task. The ranges are written to
    the shared folder, since each plan over them would else draw bounds of its own and number other ranges than it counts.
    """
    ranged = checkpointed(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)  # the rest of the number counts a partition's rows from 0
    sizes = ranged.groupBy(part.alias("_range")).agg(F.count(F.lit(1)).alias("_rows"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_rows").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_rows")
    own = F.col("_id") - F.shiftleft(part, 33) + 1
    return ranged.withColumn("_range", part).join(F.broadcast(before), "_range").withColumn(out, (own + F.col("_before")).cast("long")).drop("_range", "_id", "_before")


def equal_depth_histogram(df: DataFrame, column: str, tie: list[str], buckets: int = 100) -> DataFrame:
    """bucket (from 0), lo, hi, n, distinct_share: consecutive runs of max(1, rows // buckets) values; the last may be short.

    So there may be more buckets than asked for. Nulls are left out; tie makes the order total.
    """
    known = df.where(F.col(column).isNotNull()).select(column, *tie)
    size = max(1, known.count() // buckets)
    placed = ranks(known, [column, *tie], "_rank").withColumn("bucket", F.floor((F.col("_rank") - 1) / size))
    return placed.groupBy("bucket").agg(F.min(column).alias("lo"), F.max(column).alias("hi"), F.count(F.lit(1)).alias("n"), (F.count_distinct(column) / F.count(F.lit(1))).alias("distinct_share"))


def histogram_percentile(histogram: DataFrame, p: float) -> DataFrame:
    """percentile: the upper bound of the first bucket by which floor(p * rows) rows are reached; null if p is not from 0 to 1."""
    if not 0 <= p <= 1:
        return histogram.agg(F.max(F.when(F.lit(False), F.col("hi"))).alias("percentile"))
    total = histogram.agg(F.sum("n").alias("_total"))
    running = F.sum("n").over(Window.orderBy("bucket"))  # a histogram's buckets are few, whatever the table
    reached = histogram.withColumn("_sum", running).crossJoin(F.broadcast(total)).where(F.col("_sum") >= F.floor(F.lit(p) * F.col("_total")))
    return reached.agg(F.min_by("hi", "bucket").alias("percentile"))


def spearman(df: DataFrame, x: str, y: str, tie: list[str]) -> DataFrame:
    """correlation: Pearson's over rank numbers, ties ordered by tie; 0 for no rows or no variance."""
    known = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(x, y, *tie)
    both = ranks(ranks(known, [x, *tie], "_rx"), [y, *tie], "_ry")
    r = F.corr(F.col("_rx").cast("double"), F.col("_ry").cast("double"))
    return both.agg(F.coalesce(F.when(~F.isnan(r), r), F.lit(0.0)).alias("correlation"))


def selectivity(operator: str, distinct: int | None, histogram: bool = False) -> float:
    """Share of rows that a comparison with a value is thought to keep."""
    if operator in ("=", "=="):
        return 1 / distinct if distinct else 0.1
    if operator in ("<", "<="):
        return 0.1 if histogram else 0.3
    return 0.3 if operator in (">", ">=") else 0.5


def join_selectivity(left: int | None, right: int | None, correlation: float = 0.0) -> float:
    """1 / the larger number of distinct keys, times 1 + correlation; 0.1 if unknown."""
    if left is None or right is None:
        return 0.1
    if left == 0 or right == 0:
        return 0.0
    return 1 / max(left, right) * (1 + correlation)


def sample(df: DataFrame, rows: int, seed: int = 42) -> DataFrame:
    """About so many rows, drawn with a fixed seed."""
    n = df.count()
    return df if n <= rows else df.sample(min(1.0, rows / n), seed)


@query(
    "stats_column",
    """SELECT c AS "column", row_count, distinct_count, null_count, lo AS min, hi AS max, avg_length FROM (
  SELECT 'p_brand' AS c, count(*) AS row_count, count(DISTINCT p_brand) AS distinct_count, count(*) - count(p_brand) AS null_count, min(p_brand) AS lo, max(p_brand) AS hi, avg(length(p_brand)) AS avg_length FROM part
  UNION ALL SELECT 'p_size', count(*), count(DISTINCT p_size), count(*) - count(p_size), CAST(min(p_size) AS VARCHAR), CAST(max(p_size) AS VARCHAR), NULL FROM part)""",
)
def stats_column(spark: SparkSession, d: str) -> DataFrame:
    return column_statistics(table(spark, d, "part"), ["p_brand", "p_size"])


@query(
    "stats_histogram",
    """WITH r AS (SELECT o_totalprice AS v, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS k, greatest(1, (SELECT count(*) FROM orders) // 100) AS size FROM orders)
SELECT k // size AS bucket, min(v) AS lo, max(v) AS hi, count(*) AS n, count(DISTINCT v) / count(*) AS distinct_share FROM r GROUP BY 1""",
)
def stats_histogram(spark: SparkSession, d: str) -> DataFrame:
    return equal_depth_histogram(table(spark, d, "orders"), "o_totalprice", ["o_orderkey"], 100)


@query(
    "stats_percentile",
    """WITH r AS (SELECT o_totalprice AS v, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS k, greatest(1, (SELECT count(*) FROM orders) // 100) AS size FROM orders),
h AS (SELECT k // size AS bucket, max(v) AS hi, count(*) AS n FROM r GROUP BY 1), s AS (SELECT bucket, hi, sum(n) OVER (ORDER BY bucket) AS reached, (SELECT sum(n) FROM h) AS total FROM h)
SELECT arg_min(hi, bucket) AS percentile FROM s WHERE reached >= floor(0.9 * total)""",
)
def stats_percentile(spark: SparkSession, d: str) -> DataFrame:
    return histogram_percentile(equal_depth_histogram(table(spark, d, "orders"), "o_totalprice", ["o_orderkey"], 100), 0.9)


@query(
    "stats_spearman",
    """SELECT round(corr(x, y), 6) AS correlation FROM (SELECT CAST(row_number() OVER (ORDER BY p_size, p_partkey) AS DOUBLE) AS x, CAST(row_number() OVER (ORDER BY p_retailprice, p_partkey) AS DOUBLE) AS y FROM part)""",
)
def stats_spearman(spark: SparkSession, d: str) -> DataFrame:
    return spearman(table(spark, d, "part"), "p_size", "p_retailprice", ["p_partkey"]).select(F.round("correlation", 6).alias("correlation"))


@query("stats_join_selectivity", "SELECT round(1.0::DOUBLE / greatest((SELECT count(DISTINCT o_custkey) FROM orders), (SELECT count(DISTINCT c_custkey) FROM customer)), 9) AS s")
def stats_join_selectivity(spark: SparkSession, d: str) -> DataFrame:
    left = table(spark, d, "orders").agg(F.count_distinct("o_custkey").alias("l"))
    right = table(spark, d, "customer").agg(F.count_distinct("c_custkey").alias("r"))
    return left.crossJoin(right).select(F.round(F.lit(1.0) / F.greatest("l", "r"), 9).alias("s"))

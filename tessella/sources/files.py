"""CSV import and export, and other file formats that Spark reads itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, header: bool = True, delimiter: str = ",") -> DataFrame:
    """CSV with a given schema: nothing is inferred. Rows that don't fit raise."""
    return spark.read.schema(schema).option("header", header).option("sep", delimiter).option("mode", "FAILFAST").option("multiLine", False).csv(path)


def write_csv(df: DataFrame, path: str, header: bool = True, delimiter: str = ",", mode: str = "error") -> None:
    df.write.mode(mode).option("header", header).option("sep", delimiter).csv(path)


def read_files(spark: SparkSession, path: str, kind: str = "parquet", schema: T.StructType | str | None = None, **options: str) -> DataFrame:
    reader = spark.read.format(kind).options(**options)
    return (reader.schema(schema) if schema else reader).load(path)

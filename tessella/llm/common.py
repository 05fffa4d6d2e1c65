"""What the training-data operators share: shared folders, blob files, ASCII-only text rules."""

from __future__ import annotations

import atexit
import string
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII white space, as the contracts spell it: [\x20\x09-\x0D].
SPACES = " \t\n\x0b\x0c\r"

#: Maps A-Z to a-z and white space to a space; every other byte stays.
LOWER_SPACE = bytes(
    0x20 if b == 0x20 or 0x09 <= b <= 0x0D else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)
)

#: Ends a blob written by write_blobs(): an empty Zstandard skippable frame, so that archives stay valid.
BLOB_END = b"P*M\x18\x00\x00\x00\x00"

_made: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(c: Column) -> Column:
    """A-Z lower-cased, all else as it is; null stays null."""
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else, as in tests, one of our own."""
    sc = spark.sparkContext
    set_to = sc._jsc.sc().getCheckpointDir()
    if set_to.isDefined():
        return set_to.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="tessella-")
    sc.setCheckpointDir(named)
    return sc._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def new_path(spark: SparkSession, kind: str) -> str:
    """A path in the shared folder that nothing else uses; removed when Python ends, if not before."""
    path = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_clear)
    _made.append((spark, path))
    return path


def remove_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _clear() -> None:
    for spark, path in _made:
        try:
            remove_path(spark, path)
        except Exception:  # the JVM has ended, and with it a local session's folder
            return


def stored(df: DataFrame, kind: str, *folders: str) -> tuple[DataFrame, str]:
    """df written as Parquet in the shared folder (in a folder for each value of these columns) and read again, and where it is."""
    spark = df.sparkSession
    path = new_path(spark, kind)
    df.write.partitionBy(*folders).option("compression", "zstd").option("parquet.enable.dictionary", "false").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def write_blobs(df: DataFrame, column: str, path: str, per_file: int = 1) -> None:
    """Writes each row's binary column as a file, by Spark's own committer, so that a task run again leaves one copy.

    Spark's text writer puts a value's bytes as they are; BLOB_END follows each.
    """
    (
        df.select(F.col(column).cast("string").alias("value"))
        .write.option("lineSep", BLOB_END.decode("latin-1"))
        .option("maxRecordsPerFile", per_file)
        .text(path)
    )


def read_blobs(spark: SparkSession, path: str) -> DataFrame:
    """The files of write_blobs(): path, length, content."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).where("length > 0")


def running_before(df: DataFrame, key: str, value: str, out: str, width: int = 4096) -> DataFrame:
    """df (key: distinct whole numbers from 0) with out: the sum of value over all smaller keys.

    Sums of width keys at a time are added up in one task, the keys of each such run in another.
    """
    run = F.floor(F.col(key) / width)
    runs = df.groupBy(run.alias("_run")).agg(F.sum(value).alias("_sum"))
    before = runs.withColumn("_prior", F.sum("_sum").over(Window.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)))
    own = F.sum(value).over(Window.partitionBy("_run").orderBy(key).rowsBetween(Window.unboundedPreceding, -1))
    return (
        df.withColumn("_run", run).withColumn("_own", own).join(before.drop("_sum"), "_run")
        .withColumn(out, F.coalesce("_own", F.lit(0)) + F.coalesce("_prior", F.lit(0)))
        .drop("_run", "_own", "_prior")
    )


def n_partitions(df: DataFrame, rows: int, rows_each: int) -> int:
    """Partitions for so many rows, at least the session's number for shuffles."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // rows_each))

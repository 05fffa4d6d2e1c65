"""URL filters: a sort-merge range join of page keys with nested rule intervals."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_ascii, table

#: Ends a host in a key; it sorts before every label, so that a host comes before its subdomains.
HOST_END = "\x00"

#: Keys that are looked at to place the cuts between parts; they bear on balance alone, not on results.
CUT_SAMPLE = 20_000

#: Pages for each part.
PART_ROWS = 200_000


def host_of(url: Column) -> Column:
    """After the first '://' up to '/', '?', '#' or the end, A-Z lower-cased; empty without '://' or for null."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    """Labels from the last to the first, each followed by a dot: all subdomains of a host share its key as a prefix."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


@dataclass
class _Host:
    """A host's interval, and its rules by path."""

    prefix: str
    paths: dict[str, tuple[str, str]]
    lengths: list[int]  # that paths have, the longest first

    def add(self, path: str, rule: str, verdict: str) -> None:
        self.paths[path] = rule, verdict
        if len(path) not in self.lengths:
            insort(self.lengths, len(path), key=lambda n: -n)

    def fit(self, path: str) -> tuple[str, str] | None:
        """The rule of the longest path that path starts with."""
        for n in self.lengths:
            if n <= len(path) and (found := self.paths.get(path[:n])):
                return found
        return None


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by part and key, rules first; keeps the stack of the hosts whose interval the sweep is in."""
    part, stack = None, []
    for batch in batches:
        kept, rules, verdicts = [], [], []
        columns = (batch.column(c).to_pylist() for c in ("_part", "_key", "_kind", "_path", "_rule", "_verdict"))
        for i, (p, key, kind, path, rule, verdict) in enumerate(zip(*columns, strict=True)):
            if p != part:
                part, stack = p, []
            while stack and not key.startswith(stack[-1].prefix):
                stack.pop()
            if kind == 0:
                if not stack or stack[-1].prefix != key:
                    stack.append(_Host(key, {}, []))
                stack[-1].add(path, rule, verdict)
                continue
            best, longest = (None, None), (-1, -1)
            for host in stack:
                if (found := host.fit(path)) and (size := (len(found[0]), len(host.prefix))) > longest:
                    best, longest = found, size
            kept.append(i)
            rules.append(best[0])
            verdicts.append(best[1])
        out = batch.select(["_row", "_path", "_host"]).take(pa.array(kept, pa.int32()))
        yield pa.RecordBatch.from_arrays(
            [*out.columns, pa.array(rules, pa.string()), pa.array(verdicts, pa.string())], ["_row", "_path", "_host", "_rule", "_verdict"]
        )


def match_urls(pages: DataFrame, rules: DataFrame, row_col: str, url_col: str = "url", default: str = "allow") -> DataFrame:
    """For each page: row_col, host, path, rule, verdict.

    rules: host, path, verdict. A rule fits its host and all subdomains if the url's path starts with the rule's; the
    longest (host and path together, then the host alone) wins, and equal rules (hosts in any case) are one, the verdict that sorts last (block
    before allow); rules with a null host or path fit nothing. Without
    a fitting rule: rule null and the default verdict. A null url, or one without '://', has an empty host and path
    and fits only a rule for the empty host. Repeated pages each give a row; null ids are kept.

    A rule's host becomes an interval of reversed-host keys, and intervals are nested or apart. Keys are cut into parts
    of like size, a rule goes to every part that its interval meets, and each part is swept in key order. The page's
    whole key, with path and id, decides its part, so that one very common host is spread over many.
    """
    spark = pages.sparkSession
    keyed = pages.select(F.col(row_col).alias("_row"), host_of(F.col(url_col)).alias("_host"), path_of(F.col(url_col)).alias("_path"))
    keyed = keyed.withColumn("_key", host_key(F.col("_host")))
    whole = F.concat("_key", F.lit(HOST_END), F.col("_path"), F.lit(HOST_END), F.lpad(F.coalesce(F.col("_row").cast("string"), F.lit("")), 20, "0"))
    total = keyed.count()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PART_ROWS))
    share = min(1.0, CUT_SAMPLE / max(total, 1))
    sample = sorted(r[0] for r in keyed.where(F.pmod(F.xxhash64(whole), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select(whole).limit(4 * CUT_SAMPLE).toLocalIterator())
    cuts = sorted({sample[len(sample) * k // parts] for k in range(1, parts)}) if sample else []

    @F.pandas_udf("int")
    def part_of(key: pd.Series) -> pd.Series:
        return key.map(lambda k: bisect_right(cuts, k)).astype("int32")

    @F.pandas_udf("array<int>")
    def parts_of(prefix: pd.Series) -> pd.Series:
        return prefix.map(lambda k: list(range(bisect_right(cuts, k), bisect_left(cuts, after(k)) + 1)))

    def after(prefix: str) -> str:
        """The least key that sorts after all that start with prefix."""
        while prefix and prefix[-1] == "\U0010ffff":
            prefix = prefix[:-1]
        last = ord(prefix[-1]) + 1 if prefix else 0
        return prefix[:-1] + chr(0xE000 if last == 0xD800 else last) if prefix else "\U0010ffff" * 64

    text = F.lit(None).cast("string")
    once = rules.where("host IS NOT NULL AND path IS NOT NULL").groupBy(lower_ascii(F.col("host")).alias("_low"), "path").agg(F.max(F.struct("verdict", "host")).alias("_one")).select(host_key(F.col("_low")).alias("_key"), "_one.host", "path", "_one.verdict")
    begins = once.withColumn("_part", F.explode(parts_of("_key"))).select(
        "_part", "_key", F.lit(0).alias("_kind"), F.col("path").alias("_path"), F.lit(None).cast(keyed.schema["_row"].dataType).alias("_row"), text.alias("_host"), F.concat("host", "path").alias("_rule"), F.col("verdict").alias("_verdict")
    )
    points = keyed.select(part_of(whole).alias("_part"), "_key", F.lit(1).alias("_kind"), "_path", "_row", "_host", text.alias("_rule"), text.alias("_verdict"))
    dealt = begins.unionByName(points).repartitionById(parts, "_part").sortWithinPartitions("_part", "_key", "_kind")
    row_type = keyed.schema["_row"].dataType.simpleString()
    swept = dealt.mapInArrow(_sweep, f"_row {row_type}, _path string, _host string, _rule string, _verdict string")
    return swept.select(
        F.col("_row").alias(row_col), F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule").alias("rule"), F.coalesce("_verdict", F.lit(default)).alias("verdict")
    )


def rules_frame(spark: SparkSession, rules: Iterable[tuple[str, str, str]]) -> DataFrame:
    """(host, path, verdict) of a list that the caller writes out."""
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


#: Fixed by the query's contract.
OP1_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules_frame(spark, OP1_RULES), "page_id")


OP1_SQL = r"""
WITH rules(rhost, rpath, says) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
cut AS (
  SELECT page_id,
         CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
split AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut),
best AS (
  SELECT s.page_id, arg_max(r.rhost || r.rpath, length(r.rhost || r.rpath)) AS rule,
         arg_max(r.says, length(r.rhost || r.rpath)) AS says
  FROM split s JOIN rules r
    ON (s.host = r.rhost OR ends_with(s.host, '.' || r.rhost)) AND starts_with(s.path, r.rpath)
  GROUP BY s.page_id)
SELECT s.page_id, s.host, s.path, b.rule, coalesce(b.says, 'allow') AS verdict
FROM split s LEFT JOIN best b ON s.page_id = b.page_id
"""

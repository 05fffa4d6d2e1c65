"""Connected components of links, by alternating large-star and small-star steps on DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

#: Links that one task takes (16 bytes each).
ONE_TASK = 500_000


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index that each of n can reach over links a-b."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while not np.array_equal(jumped := new[new], new):
            new = jumped
        label = new
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label


def _stars(links: DataFrame, large: bool) -> DataFrame:
    """Each node's larger (or all its smaller) neighbours move to its least neighbour or itself.

    The least neighbour is a partial aggregate; a node of very many links is never gathered in one task, and the join
    back is one that Spark can split.
    """
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.where("v > u" if large else "v <= u").join(least, "u")
    if large:
        moved = joined.select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.where("m < u").select(F.col("u").alias("a"), F.col("m").alias("b")))
    return moved.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _in_one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [(batch.column("a").to_numpy(), batch.column("b").to_numpy()) for batch in batches]
    if held:
        ends = np.concatenate([np.concatenate(x) for x in zip(*held, strict=True)])
        nodes, at = np.unique(ends, return_inverse=True)
        label = nodes[local_components(len(nodes), *np.split(at, 2))]
        moved = label != nodes
        yield pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(label[moved])], ["node", "component"])


def components(links: DataFrame, max_rounds: int = 60, one_task: int = ONE_TASK) -> DataFrame:
    """links: a, b (whole numbers, either order). Returns node and component, the least node of its component.

    Nodes without links, and the least nodes themselves, are not in the result. Each round is checkpointed in the shared folder; rounds end when
    nothing changes, which takes about the logarithm of the longest chain. Null ends, loops and repeats are left out.
    Up to one_task links are joined in one task of an executor instead, which gives the same.
    """
    now = checkpointed(links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    if now.count() <= one_task:
        return checkpointed(now.repartition(1).mapInArrow(_in_one_task, "node long, component long"))
    seen = None
    for _ in range(max_rounds):
        now = checkpointed(_stars(_stars(now, large=True), large=False))
        sums = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if sums == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        seen = sums
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")

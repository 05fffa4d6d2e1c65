"""Approximate nearest neighbours by collision counting over query-centred windows of sorted projections."""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, table

#: Projections, and the standard deviations above the mean number of misses that the threshold allows.
PROJECTIONS = 128
SLACK = 1.5

#: A window's half-width, in radii: a vector at the radius misses 4.6 % of the windows, one at 1.25 times it 11 %. Of
#: the widths, about two tell such vectors best apart.
HALF_WIDTH = 2.0

#: Rows of a block that give a query its first radius, the distance of the nearest, and the growth of radii.
SAMPLE = 512
START = 0.97
GROWTH = 1.05

#: Vectors that are indexed at a time, and queries that are broadcast at a time.
BLOCK_ROWS = 16_384
QUERY_ROWS = 32_768

SEED = 20


class Block:
    """Sorted projections of some vectors, and a search that counts collisions.

    Vectors x are scaled by the largest norm and get one more component, so that they lie on the unit sphere; a
    query's largest inner products are then its least distances. Projection j keeps (value, row) sorted by value. The
    window of radius R around the query's value holds the rows within HALF_WIDTH * R; growing R is virtual rehashing:
    only the window's two ends move. What is counted are the rows outside, the array's two ends, which are fewer: a
    row collides wherever it is not among them. Rows that collide in enough projections are verified on the original
    vectors; scored counts them.
    """

    def __init__(self, ids: np.ndarray, x: np.ndarray, scale: float, directions: np.ndarray):
        self.ids, self.x, self.scored = ids, x, 0
        unit = x / scale
        rest = np.sqrt(np.maximum(0.0, 1.0 - np.einsum("ij,ij->i", unit, unit)))
        values = np.column_stack([unit, rest]) @ directions
        self.order = np.argsort(values, axis=0, kind="stable").T.copy()
        self.values = np.take_along_axis(values, self.order.T, axis=0).T.copy()
        m = directions.shape[1]
        p = 2 * NormalDist().cdf(HALF_WIDTH) - 1
        self.most = math.floor(m * (1 - p) + SLACK * math.sqrt(m * p * (1 - p)))
        self.sample = np.random.default_rng(SEED).permutation(len(ids))[:SAMPLE]

    def first_radii(self, q_ids: np.ndarray, q: np.ndarray, scale: float, k: int, found: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """The distance of the nearest row of the sample, or that of the k-th best found before, if it is less."""
        norms = np.linalg.norm(q, axis=1)
        scores = q @ self.x[self.sample].T
        scores[q_ids[:, None] == self.ids[self.sample]] = -np.inf
        radii = np.array([_distance(s, n, scale) if math.isfinite(s) else 1.0 for s, n in zip(scores.max(axis=1).tolist(), norms.tolist(), strict=True)])
        known = [_distance(x[k - 1], n, scale) if len(i) >= k else np.inf for (i, x), n in zip(found, norms.tolist(), strict=True)]
        return np.maximum(np.minimum(radii * START, known), 1e-9)

    def search(self, q_ids: np.ndarray, q: np.ndarray, projected: np.ndarray, scale: float, k: int, found: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """Puts this block's rows into found, the k best (ids, scores) of each query q; projected: their unit vectors' values.

        All queries widen their windows in rounds; a query is done when its k-th best is no further than its radius.
        """
        n, norms = len(self.ids), np.linalg.norm(q, axis=1)
        left = np.arange(len(q_ids))
        radius = self.first_radii(q_ids, q, scale, k, found) if n > k else np.full(len(q_ids), 5.0)
        misses: dict[int, np.ndarray] = {}
        checked = {}
        low = high = np.zeros((len(q_ids), len(self.values)), np.int64)
        begun = False
        while len(left):
            reach = HALF_WIDTH * radius[left]
            new_low, new_high = (np.empty((len(q_ids), len(self.values)), np.int64) for _ in range(2))
            for m, values in enumerate(self.values):
                new_low[left, m] = np.searchsorted(values, projected[left, m] - reach)
                new_high[left, m] = np.searchsorted(values, projected[left, m] + reach, "right")
            going = []
            for j in left.tolist():
                if not begun:
                    pieces = [x for o, a, b in zip(self.order, new_low[j].tolist(), new_high[j].tolist(), strict=True) for x in (o[:a], o[b:])]
                    miss, seen = np.bincount(np.concatenate(pieces), minlength=n), self.ids == q_ids[j]
                else:  # what the windows have taken in since
                    ends = zip(self.order, new_low[j].tolist(), low[j].tolist(), high[j].tolist(), new_high[j].tolist(), strict=True)
                    pieces = [x for o, a, b, c, d in ends for x in (o[a:b], o[c:d])]
                    miss, seen = misses[j] - np.bincount(np.concatenate(pieces), minlength=n), checked[j]
                rows = np.flatnonzero((miss <= self.most) & ~seen) if radius[j] <= 4 else np.flatnonzero(~seen)  # by 4, windows hold all rows
                if len(rows):
                    seen[rows] = True
                    self.scored += len(rows)
                    ids, scores = found[j]
                    found[j] = best_of(np.concatenate([ids, self.ids[rows]]), np.concatenate([scores, self.x[rows] @ q[j]]), k)
                wanted = _distance(found[j][1][k - 1], norms[j], scale) if len(found[j][0]) >= k else np.inf
                if wanted > radius[j] and radius[j] <= 4:
                    misses[j], checked[j] = miss, seen
                    going.append(j)
                    radius[j] = min(radius[j] * GROWTH, wanted)
                elif begun:
                    misses.pop(j), checked.pop(j)
            low, high, begun = new_low, new_high, True
            left = np.array(going, np.int64)


def _distance(score: float, norm: float, scale: float) -> float:
    """Between the unit vectors of a query and of a row with this inner product."""
    return math.sqrt(max(0.0, 2.0 - 2.0 * score / (norm * scale)))


def best_of(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Largest scores first, ties to smaller ids."""
    if len(ids) > 4 * k:  # keep what is no worse than the k-th
        keep = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
        ids, scores = ids[keep], scores[keep]
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def usable(vector: Column) -> Column:
    """Not null, without null or non-finite components, and not all zero."""
    x = vector.cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(x, lambda v: v != 0)


_FOUND = "array<struct<score:double,vec_id:bigint>>"


def _merge(found: Column, k: int) -> Column:
    """The k best of collected lists, the same row once."""
    every = F.array_distinct(F.flatten(F.collect_list(found)))

    def order(a: Column, b: Column) -> Column:
        return (
            F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1)
            .when(a["vec_id"] < b["vec_id"], -1).when(a["vec_id"] > b["vec_id"], 1).otherwise(0)
        )

    return F.slice(F.array_sort(every, order), 1, k)


def _rows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    column = batch.column("x")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return batch.column("i").to_numpy(zero_copy_only=False), flat.reshape(len(column), -1)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", projections: int = PROJECTIONS, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each query, the k rows of vectors with the largest inner product that are found.

    Rows with a query's own id are no candidates of it, and query rows that share an id are one query, whose list is the
    best of theirs. Vectors (and queries) that are null or zero, that hold null or non-finite
    components, or whose length isn't the most common one, take no part, nor do null ids. Fewer than k candidates are
    all returned; ties go to smaller ids; the same row repeated counts once, rows that share an id else count each.

    All rows are indexed, in blocks where they lie; each block is searched for all queries, which are broadcast in
    blocks of query_rows. A task keeps the k best for each query, so that a query's lists are as many as tasks, and
    they are merged in two steps.
    """
    spark = vectors.sparkSession
    good = vectors.where(usable(F.col(vector_col)) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("i"), F.col(vector_col).cast("array<double>").alias("x"))
    kinds = good.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v)).alias("m"))
    common = kinds.orderBy(F.desc("n"), "d").limit(1).collect()
    out = "query_id long, rank int, vec_id long, score double"
    if not common:
        return spark.createDataFrame([], out)
    dims, scale = common[0].d, math.sqrt(common[0].m) * (1 + 1e-9)
    good = good.where(F.size("x") == dims)
    asked = queries.where(usable(F.col(vector_col)) & F.col(id_col).isNotNull() & (F.size(vector_col) == dims)).select(F.col(id_col).cast("long").alias("i"), F.col(vector_col).cast("array<double>").alias("x"))
    directions = np.random.default_rng(SEED).standard_normal((dims + 1, projections))
    n_blocks = max(1, -(-asked.count() * 10 // (query_rows * 9)))
    parts = []
    for b in range(n_blocks):
        held = asked.where(F.pmod(F.xxhash64("i", F.lit("query")), F.lit(n_blocks)) == b).toArrow().combine_chunks()
        if not held.num_rows:
            continue
        q_ids, q = _rows(held.to_batches()[0])
        sent = spark.sparkContext.broadcast((q_ids, q))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            q_ids, q = sent.value
            unit = q / np.linalg.norm(q, axis=1, keepdims=True)
            projected = unit @ directions[:-1]
            best = [(np.empty(0, np.int64), np.empty(0))] * len(q_ids)
            ids, rows, size = [], [], 0

            def search() -> None:
                block = Block(np.concatenate(ids), np.concatenate(rows), scale, directions)
                for a in range(0, len(q_ids), 512):
                    some, part = slice(a, a + 512), best[a : a + 512]
                    block.search(q_ids[some], q[some], projected[some], scale, k, part)
                    best[some] = part

            for batch in batches:
                for a in range(0, batch.num_rows, block_rows):
                    i, x = _rows(batch.slice(a, block_rows))
                    if size and size + len(i) > block_rows:
                        search()
                        ids, rows, size = [], [], 0
                    ids.append(i)
                    rows.append(x)
                    size += len(i)
            if size:
                search()
                found = [[{"score": s, "vec_id": v} for v, s in zip(i.tolist(), x.tolist(), strict=True)] for i, x in best]
                yield pa.RecordBatch.from_arrays([pa.array(q_ids), pa.array(found, pa.list_(pa.struct([("score", pa.float64()), ("vec_id", pa.int64())])))], ["query_id", "found"])

        part = good.mapInArrow(run, f"query_id long, found {_FOUND}").withColumn("some", F.pmod(F.spark_partition_id(), F.lit(32)))
        part = part.groupBy("query_id", "some").agg(_merge(F.col("found"), k).alias("found"))
        part = part.groupBy("query_id").agg(_merge(F.col("found"), k).alias("found"))
        if n_blocks > 1:
            part = checkpointed(part)
            sent.unpersist()
        parts.append(part)
    if not parts:
        return spark.createDataFrame([], out)
    every = parts[0]
    for part in parts[1:]:
        every = every.union(part)
    ranked = every.select("query_id", F.posexplode("found").alias("rank", "f"))
    return ranked.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("f.vec_id").alias("vec_id"), F.col("f.score").alias("score"))


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"), k=20)

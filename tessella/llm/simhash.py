"""SimHash near-duplicates: a generalised pigeonhole search for fingerprints that differ in few bits."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER_SPACE, checkpointed, n_partitions, table
from .components import components, local_components

BITS = 64
SEED = 42

#: Parts that the bits can be grouped into; what costs least by the histograms is taken, so that parts widen with the table.
PART_OPTIONS = (4, 3, 2)

#: Parts of a lane of near_dup.
PARTS = 4

#: Bits of a part's value that its histogram is kept by; of wider parts, counts are estimated.
HISTOGRAM_BITS = 16

#: Comparisons that take as long as a row that is dealt out.
ROW_COST = 64

#: Fingerprints that share a part's value beyond this (and beyond one in HOT_VALUES of all, so that there are no more such
#: values of a part) are linked by midpoints instead, whose groups are never large.
HOT = 20_000
HOT_VALUES = 1 << 19


def shingle_hashes(text: bytes | None, words: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of so many words, repeats included; of the whole sequence if it is shorter."""
    found = text.translate(LOWER_SPACE).split() if text else []
    if not found:
        return np.empty(0, np.uint64)
    whole = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    k = min(words, len(found)) - 1
    digest = xxhash.xxh64_digest
    return np.frombuffer(b"".join([digest(whole[a:b], SEED) for a, b in zip(starts, ends[k:].tolist(), strict=False)]), ">u8")


def fingerprint(hashes: np.ndarray) -> int:
    """Bits set in over half the hashes, as a signed 64-bit number; zero without hashes."""
    if not len(hashes):
        return 0
    votes = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(hashes)).view(">i8")[0])


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (long) of every row, and no other column, whatever docs has; null and empty texts have fp 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(shingle_hashes(t.as_py(), words)) for t in batch.column("t")]
            yield pa.RecordBatch.from_arrays([batch.column("i"), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("binary").alias("t")).mapInArrow(run, "doc_id long, fp long")


def group_bits(together: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Bits in parts of like size: each part takes the bit most correlated with those it has, starting from the most correlated pair left.

    together: how many of n fingerprints have both bits (on the diagonal: the bit).
    """
    p = np.diag(together) / max(n, 1)
    cov = together / max(n, 1) - np.outer(p, p)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(cov / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    left, groups = list(range(len(p))), []
    for g in range(parts):
        size = len(left) // (parts - g)
        sub = corr[np.ix_(left, left)]
        own = [left[int(sub.max(axis=1).argmax())]]
        left.remove(own[0])
        while len(own) < size:
            best = max(left, key=lambda b: (corr[b, own].sum(), -b))
            own.append(best)
            left.remove(best)
        groups.append(sorted(own))
    return groups


def part_value(fps: np.ndarray, bits: list[int]) -> np.ndarray:
    """The bits of a part, closed up, for unsigned fingerprints."""
    out = np.zeros(len(fps), np.int64)
    for k, b in enumerate(bits):
        out |= ((fps >> np.uint64(b)) & np.uint64(1)).astype(np.int64) << k
    return out


def within(counts: np.ndarray, width: int, most: int) -> np.ndarray:
    """[r, v]: fingerprints whose part differs from v in at most r bits."""
    at = np.zeros((most + 1, len(counts)), np.int64)
    at[0] = counts
    for b in range(width):
        halves = at.reshape(most + 1, -1, 2, 1 << b)
        flipped = halves[:-1, :, ::-1].copy()
        halves[1:] += flipped
    return np.cumsum(at, axis=0)


@dataclass
class Plan:
    """How to find fingerprints within so many bits of each other."""

    distance: int
    parts: list[list[int]]
    counts: list[np.ndarray]  # by part: fingerprints by the low bits of its value, as many as the histogram has
    cost: list[np.ndarray]  # by part: [threshold + 1, low bits], probes and candidates

    @classmethod
    def of(cls, distance: int, parts: list[list[int]], counts: list[np.ndarray], row_cost: float = 1.0) -> Plan:
        cost = []
        for bits, c in zip(parts, counts, strict=True):
            low = len(c).bit_length() - 1
            more = len(bits) - low  # bits that the histogram lacks are taken to be even
            near = within(c, low, distance)
            if more:
                exact = np.diff(near, axis=0, prepend=0)
                share = np.cumsum([math.comb(more, r) / 2.0**more for r in range(distance + 1)])
                near = np.stack([sum(exact[i] * share[r - i] for i in range(r + 1)) for r in range(distance + 1)])
            probes = np.cumsum([math.comb(len(bits), r) for r in range(distance + 1)]) * row_cost
            cost.append(np.vstack([np.zeros(len(c)), near + probes[:, None]]).astype(np.float32))
        return cls(distance, parts, counts, cost)

    def held(self, part: int, values: np.ndarray) -> np.ndarray:
        """Fingerprints counted with these values' low bits: none only if no fingerprint has the value."""
        return self.counts[part][values & (len(self.counts[part]) - 1)]

    def estimate(self) -> float:
        """Mean cost of a fingerprint, by thresholds that are best on average, and of its own places."""
        n = max(1, int(self.counts[0].sum()))
        best = [0.0] + [math.inf] * (self.distance + 1)
        for c, cost in zip(self.counts, self.cost, strict=True):
            mean = (cost.astype(np.float64) * c).sum(axis=1) / n
            best = [min(best[b - t] + mean[t] for t in range(b + 1)) for b in range(self.distance + 2)]
        return best[-1] + ROW_COST * len(self.parts)

    def thresholds(self, values: list[np.ndarray]) -> np.ndarray:
        """[part, fingerprint]: thresholds from -1 (no probe) that cost least, by dynamic programming.

        Thresholds plus one add up to distance + 1: of two fingerprints that differ in distance bits at most, one part
        at least then differs in no more bits than the part's threshold.
        """
        n, budget = len(values[0]), self.distance + 1
        best = np.full((budget + 1, n), np.inf, np.float32)
        best[0] = 0
        choice = np.zeros((len(values), budget + 1, n), np.int8)
        for p, v in enumerate(values):
            cost = self.cost[p][:, v & (len(self.counts[p]) - 1)]
            new = np.full_like(best, np.inf)
            for b in range(budget + 1):
                for t in range(min(b, self.distance + 1) + 1):
                    c = best[b - t] + cost[t]
                    better = c < new[b]
                    new[b][better] = c[better]
                    choice[p, b][better] = t
            best = new
        out = np.empty((len(values), n), np.int8)
        left, at = np.full(n, budget), np.arange(n)
        for p in range(len(values) - 1, -1, -1):
            t = choice[p, left, at]
            out[p] = t - 1
            left = left - t
        return out


def masks(width: int, most: int) -> list[list[int]]:
    """[r]: numbers of width bits with r bits set."""
    return [[sum(1 << b for b in c) for c in combinations(range(width), r)] for r in range(most + 1)]


def _unsigned(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).view(np.uint64)


def make_plan(distinct: DataFrame, distance: int, options: tuple[int, ...] = PART_OPTIONS, histogram_bits: int = HISTOGRAM_BITS) -> Plan:
    """The cheapest plan, from bit correlations and part histograms of all distinct fingerprints (column fp); all are of fixed size."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS, BITS), np.int64)
        for batch in batches:
            x = ((_unsigned(batch.column("fp"))[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)).astype(np.float32)
            total += (x.T @ x).astype(np.int64)
        i, j = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total[i, j])], ["i", "j", "n"])

    n = distinct.count()
    together = np.zeros((BITS, BITS), np.int64)
    for r in distinct.select("fp").mapInArrow(pairs, "i long, j long, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect():
        together[r.i, r.j] = r.n
    groupings = [group_bits(together, n, parts) for parts in options]
    every = [g for groups in groupings for g in groups]
    sizes = [1 << min(len(g), histogram_bits) for g in every]

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros(size, np.int64) for size in sizes]
        for batch in batches:
            fps = _unsigned(batch.column("fp"))
            for c, g in zip(counts, every, strict=True):
                c += np.bincount(part_value(fps, g) & (len(c) - 1), minlength=len(c))
        for p, c in enumerate(counts):
            v = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), p, np.int64)), pa.array(v), pa.array(c[v])], ["p", "v", "n"])

    counts = [np.zeros(size, np.int64) for size in sizes]
    summed = distinct.select("fp").mapInArrow(values, "p long, v long, n long").groupBy("p", "v").agg(F.sum("n").alias("n")).toArrow()
    p, v, c = (summed.column(x).to_numpy() for x in ("p", "v", "n"))
    for k in range(len(every)):
        counts[k][v[p == k]] = c[p == k]
    plans, at = [], 0
    for groups in groupings:
        plans.append(Plan.of(distance, groups, counts[at : at + len(groups)], ROW_COST))
        at += len(groups)
    return min(plans, key=Plan.estimate)


def crowded_values(distinct: DataFrame, plan: Plan, hot: int) -> list[np.ndarray]:
    """By part: the values, ascending, that more than hot fingerprints have. Only those that the histograms allow are counted."""
    if all((c <= hot).all() for c in plan.counts):
        return [np.empty(0, np.int64) for _ in plan.parts]
    shared = distinct.sparkSession.sparkContext.broadcast(plan)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        for batch in batches:
            fps = _unsigned(batch.column("fp"))
            for p, g in enumerate(plan.parts):
                v = part_value(fps, g)
                v, n = np.unique(v[plan.held(p, v) > hot], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), p, np.int64)), pa.array(v), pa.array(n)], ["p", "v", "n"])

    found = distinct.select("fp").mapInArrow(run, "p long, v long, n long").groupBy("p", "v").agg(F.sum("n").alias("n")).where(F.col("n") > hot).toArrow()
    p, v = (found.column(x).to_numpy() for x in ("p", "v"))
    return [np.sort(v[p == k]) for k in range(len(plan.parts))]


def _keys(distinct: DataFrame, plan: Plan, crowded: list[np.ndarray]) -> DataFrame:
    """kind (a part, or -1 for midpoints), key, fp, rep, probes: each fingerprint's own place in every part, and its probes."""
    shared = distinct.sparkSession.sparkContext.broadcast((plan, crowded))
    single = np.uint64(1) << np.arange(BITS, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, crowded = shared.value
        flips: dict[tuple[int, int], list[int]] = {}

        def full(part: int, values: np.ndarray) -> np.ndarray:
            known = crowded[part]
            return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values if len(known) else np.zeros(len(values), bool)

        def rows(kind: int, key: np.ndarray, fp: np.ndarray, rep: np.ndarray, probes: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(key), kind, np.int32)), pa.array(key.astype(np.int64)), pa.array(fp.view(np.int64)), pa.array(rep), pa.array(probes)], ["kind", "key", "fp", "rep", "probes"]
            )

        for batch in batches:
            fp, rep = _unsigned(batch.column("fp")), batch.column("rep").to_numpy(zero_copy_only=False)
            values = [part_value(fp, g) for g in plan.parts]
            t = plan.thresholds(values)
            wide = np.zeros(len(fp), bool)
            for p, v in enumerate(values):
                hot = full(p, v)
                wide |= hot
                own = ~hot
                yield rows(p, v[own], fp[own], rep[own], t[p][own] >= 0)
                for r in range(1, plan.distance + 1):
                    some = np.flatnonzero(t[p] >= r)
                    if not len(some):
                        continue
                    width = len(plan.parts[p])
                    if (width, r) not in flips:
                        flips[width, r] = masks(width, r)[r]
                    for m in flips[width, r]:
                        probe = v[some] ^ m
                        hot = full(p, probe)
                        wide[some[hot]] = True
                        go = some[~hot & (plan.held(p, probe) > 0)]
                        if len(go):
                            yield rows(p, v[go] ^ m, fp[go], rep[go], np.ones(len(go), bool))
            if wide.any():
                f, d = fp[wide], rep[wide]
                keys = np.concatenate([f[:, None], f[:, None] ^ single], axis=1)
                yield rows(-1, keys.ravel().view(np.int64), np.repeat(f, BITS + 1), np.repeat(d, BITS + 1), np.ones(keys.size, bool))

    return distinct.mapInArrow(run, "kind int, key long, fp long, rep long, probes boolean")


def _linked(group: np.ndarray, fp: np.ndarray, rep: np.ndarray, probes: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between rows of the same group (rows are sorted by it), as stars: at most one for each row."""
    a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    at, d = np.arange(len(group) - 1), 1
    while len(at):
        at = at[group[at] == group[at + d]]
        near = (np.bitwise_count(fp[at] ^ fp[at + d]) <= distance) & (probes[at] | probes[at + d]) & (rep[at] != rep[at + d])
        a.append(at[near])
        b.append(at[near] + d)
        d += 1
        at = at[at + d < len(group)]
    label = local_components(len(group), np.concatenate(a), np.concatenate(b))
    moved = np.flatnonzero(label != np.arange(len(group)))
    return rep[moved], rep[label[moved]]


def link_keys(keys: DataFrame, distance: int, n: int) -> DataFrame:
    """a, b: rep of fingerprints that share a key and differ in at most distance bits, one of them probing there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None

        def links(kind, key, fp, rep, probes) -> pa.RecordBatch:
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (kind[1:] != kind[:-1])
            a, b = _linked(np.cumsum(new), fp.view(np.uint64), rep, probes, distance)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            now = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("kind", "key", "fp", "rep", "probes")]
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now, strict=True)]
            kind, key = now[:2]
            if not len(key):
                continue
            last = np.flatnonzero((kind == kind[-1]) & (key == key[-1]))[0]
            held = [x[last:] for x in now]
            if last:
                yield links(*[x[:last] for x in now])
        if held is not None:
            yield links(*held)

    return keys.repartition(n, "kind", "key").sortWithinPartitions("kind", "key").mapInArrow(run, "a long, b long")


def link_fingerprints(distinct: DataFrame, distance: int = 2, options: tuple[int, ...] = PART_OPTIONS, hot: int = HOT, histogram_bits: int = HISTOGRAM_BITS) -> DataFrame:
    """distinct: fp and rep (a number for it). Returns a, b: enough links to connect all fp within distance bits.

    Correlated bits share a part; the number of parts, and each fingerprint's thresholds by part, come from the
    histograms of all fingerprints; a pair is met in a part that one of them probes, and verified on all bits. A value of a
    part that more than hot fingerprints have is not paired: fingerprints that have or probe it are grouped by the points
    within one bit of them, which any two within two bits share, and which hold 65 fingerprints at most. Distances over 2
    have no such points: a ValueError tells of them.
    """
    if distance > 2:
        raise ValueError("values of a part that are too frequent to be paired need a distance of 2 or less")
    plan = make_plan(distinct, distance, options, histogram_bits)
    n = int(plan.counts[0].sum())
    crowded = crowded_values(distinct, plan, max(hot, n // HOT_VALUES))
    return link_keys(_keys(distinct, plan, crowded), distance, n_partitions(distinct, n * (len(plan.parts) + 1), 1_000_000))


def with_components(prints: DataFrame, distance: int = 2, options: tuple[int, ...] = PART_OPTIONS, hot: int = HOT, histogram_bits: int = HISTOGRAM_BITS) -> DataFrame:
    """prints (doc_id, fp) with component_id: the smallest doc_id that links reach, its own included.

    Equal fingerprints are linked, those of empty texts among them, and stand for one another before any search. Rows
    with a null id take no part and have no component. Rows that share an id are one document.
    """
    distinct = checkpointed(prints.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("rep")))
    links = link_fingerprints(distinct, distance, options, hot, histogram_bits)
    several = prints.groupBy("doc_id").agg(F.min("fp").alias("_lo"), F.max("fp").alias("_hi")).where("_lo <> _hi").select("doc_id")
    same_id = prints.join(several, "doc_id", "left_semi").join(distinct, "fp").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    found = components(links.union(same_id)).select(F.col("node").alias("rep"), F.col("component"))
    of_fp = distinct.join(found, "rep", "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return prints.join(of_fp, "fp", "left").select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = checkpointed(fingerprints(table(spark, sf_dir, "documents"), words=3))
    out = with_components(prints, distance=2)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

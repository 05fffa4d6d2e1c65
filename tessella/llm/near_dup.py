"""Near-duplicate removal: SimHash lanes searched by the generalised pigeonhole of simhash, pairs verified on their shingle sets."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, n_partitions, stored
from .components import components, local_components
from .simhash import BITS, PARTS, Plan, group_bits, masks, part_value, shingle_hashes, within

WORDS = 5

#: 64-bit fingerprints of each document, from independent mixes of its shingles' hashes.
LANES = 10

#: Lanes whose bits go with a document into every group, where they are compared.
COMPARED = 8

#: Bits of a lane within which the search is sure to meet two documents; with PARTS parts, further ones are met by chance in some lane.
LANE_DISTANCE = 3

#: Jaccard index of shingle sets that links.
SIMILARITY = 0.8

#: Rows of a part's value, beyond which they are compared block by block; blocks have about this size.
HOT = 4_000

#: Rows of a group, beyond which each row that probes is compared with all others at once.
WIDE = 256

#: Ids that are broadcast, so that the texts they choose stay where they are; more ids are joined by a shuffle.
BROADCAST_IDS = 500_000

_MIX = np.array([0xFFFFFFFFFFFFFFFF & (0x9E3779B97F4A7C15 * (2 * k + 1)) for k in range(LANES)], np.uint64)


def most_bits(similarity: float, lanes: int = COMPARED, slack: float = 3.0) -> int:
    """Bits of the compared lanes in which sets of this Jaccard index differ, and so many standard deviations more."""
    cosine = 2 * similarity / (1 + similarity)
    p, n = float(np.arccos(cosine) / np.pi), lanes * BITS
    return round(n * p + slack * (n * p * (1 - p)) ** 0.5)


def lanes_of(hashes: np.ndarray) -> bytes:
    """The lanes of a set of shingle hashes: for each, the bits that over half of the mixed hashes have; zero without any."""
    if not len(hashes):
        return bytes(8 * LANES)
    h = hashes.astype(np.uint64)
    mixed = h[:, None] * _MIX
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    votes = np.unpackbits(mixed.view(np.uint8), axis=1).sum(axis=0, dtype=np.uint32)
    return np.packbits(votes * 2 > len(h)).tobytes()


def shingle_set(text: bytes | None, words: int) -> np.ndarray:
    """Distinct shingle hashes, sorted."""
    return np.unique(shingle_hashes(text, words).astype(np.uint64))


def lane_fingerprints(docs: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (lanes) and key (128-bit hash) of the shingle set: null and empty texts have no shingles, and zeros."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, keys = [], []
            for t in batch.column("t"):
                hashes = shingle_set(t.as_py(), words)
                fps.append(lanes_of(hashes))
                keys.append(xxhash.xxh3_128_digest(hashes.tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column("i"), pa.array(fps, pa.binary()), pa.array(keys, pa.binary())], ["doc_id", "fp", "key"])

    return docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("binary").alias("t")).mapInArrow(run, "doc_id long, fp binary, key binary")


def _matrix(column: pa.Array) -> np.ndarray:
    """[document, lane] of a column of lanes."""
    return np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(len(column), -1) if len(column) else np.empty((0, LANES), np.uint64)


#: Of a lane: distance, parts, and fingerprints by value of each part; Plan.of() makes a plan of it where one is needed.
Lane = tuple[int, list[list[int]], list[np.ndarray]]


class Sent:
    """Lanes, as they go to workers: a worker makes the plans once, not in each task."""

    def __init__(self, lanes: list[Lane]):
        self.lanes, self._plans = lanes, None

    def plans(self) -> list[Plan]:
        if self._plans is None:
            self._plans = [Plan.of(*x) for x in self.lanes]
        return self._plans


def _summed(rows: DataFrame, size: int) -> dict[int, np.ndarray]:
    """By kind: the sums of counts that tasks give for some places (kind, some, at and n as lists of 32-bit numbers)."""

    def merge(rows: pa.Table) -> pa.Table:
        at, n = (np.concatenate([np.frombuffer(x.as_py(), "<u4") for x in rows.column(c)]) for c in ("at", "n"))
        total = np.bincount(at, weights=n, minlength=size)
        at = np.flatnonzero(total)
        first = rows.slice(0, 1)
        return pa.table({"kind": first.column("kind"), "some": first.column("some"), "at": pa.array([at.astype("<u4").tobytes()], pa.binary()), "n": pa.array([total[at].astype("<u4").tobytes()], pa.binary())})

    kinds = rows.groupBy("kind", "some").applyInArrow(merge, _COUNTS).groupBy("kind").applyInArrow(merge, _COUNTS).toArrow()
    out = {}
    for kind, at, n in zip(*(kinds.column(c) for c in ("kind", "at", "n")), strict=True):
        own = out[kind.as_py()] = np.zeros(size, np.uint32)
        own[np.frombuffer(at.as_py(), "<u4")] = np.frombuffer(n.as_py(), "<u4")
    return out


_COUNTS = "kind int, some int, at binary, n binary"


def _count_rows(counts: np.ndarray, part: int) -> Iterator[pa.RecordBatch]:
    """A row for each kind that has counts, one of 64 groups of tasks."""
    for kind, c in enumerate(counts):
        if len(at := np.flatnonzero(c)):
            yield pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([part % 64], pa.int32()), pa.array([at.astype("<u4").tobytes()], pa.binary()), pa.array([c[at].astype("<u4").tobytes()], pa.binary())], ["kind", "some", "at", "n"])


def lane_plans(distinct: DataFrame, distance: int = LANE_DISTANCE, parts: int = PARTS) -> list[Lane]:
    """What a plan for each lane takes, from bit correlations and part histograms of all distinct fingerprints; all of fixed size."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, part = np.zeros((LANES, BITS, BITS), np.int64), 0
        for batch in batches:
            part = batch.column("part")[0].as_py() if batch.num_rows else part
            m = _matrix(batch.column("fp"))
            for k in range(LANES):
                x = ((m[:, k, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)).astype(np.float32)
                total[k] += (x.T @ x).astype(np.int64)
        yield from _count_rows(np.triu(total).reshape(LANES, -1), part)

    n = distinct.count()
    numbered = distinct.select("fp", F.spark_partition_id().alias("part"))
    together = _summed(numbered.mapInArrow(pairs, _COUNTS), BITS * BITS)
    halves = [together.get(k, np.zeros(BITS * BITS, np.uint32)).reshape(BITS, BITS).astype(np.int64) for k in range(LANES)]
    groups = [group_bits(t + np.triu(t, 1).T, n, parts) for t in halves]
    width = 1 << (BITS // parts)

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, part = np.zeros((LANES * parts, width), np.uint32), 0
        for batch in batches:
            part = batch.column("part")[0].as_py() if batch.num_rows else part
            m = _matrix(batch.column("fp"))
            for k in range(LANES):
                for p, g in enumerate(groups[k]):
                    counts[k * parts + p] += np.bincount(part_value(m[:, k], g), minlength=width).astype(np.uint32)
        yield from _count_rows(counts, part)

    counts = _summed(numbered.mapInArrow(values, _COUNTS), width)
    return [(distance, groups[k], [counts.get(k * parts + p, np.zeros(width, np.uint32)) for p in range(parts)]) for k in range(LANES)]


def _scatter(rep: np.ndarray) -> np.ndarray:
    x = rep.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ x >> np.uint64(31)) * np.uint64(0x94D049BB133111EB) >> np.uint64(11)


def _places(plans: list[Plan], m: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """kind (lane and part), keys, rows of m and whether they probe there, own places before a part's probes: each row's place in every part of every lane, and its probes."""
    every = np.arange(len(m))
    for k, plan in enumerate(plans):
        v = [part_value(m[:, k], g) for g in plan.parts]
        t = plan.thresholds(v)
        for p, bits in enumerate(plan.parts):
            kind = k * len(plan.parts) + p
            yield kind, v[p], every, t[p] >= 0
            for r in range(1, plan.distance + 1):
                some = np.flatnonzero(t[p] >= r)
                for mask in masks(len(bits), r)[r] if len(some) else ():
                    go = some[plan.counts[p][v[p][some] ^ mask] > 0]
                    if len(go):
                        yield kind, v[p][go] ^ mask, go, np.ones(len(go), bool)


def _met(plans: list[Plan], m: np.ndarray) -> np.ndarray:
    """Of each row, two bits for each kind of the compared lanes: how many bits away it is met there, and one more; 3 for more."""
    out = np.zeros(len(m), np.uint64)
    for k, plan in enumerate(plans[:COMPARED]):
        for p, t in enumerate(plan.thresholds([part_value(m[:, k], g) for g in plan.parts])):
            out |= np.minimum(t + 1, 3).astype(np.uint64) << np.uint64(2 * (k * len(plan.parts) + p))
    return out.view(np.int64)


def lane_crowds(distinct: DataFrame, lanes: list[Lane], sent: Broadcast[Sent], hot: int = HOT) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By kind: the keys (ascending) that have more than hot rows, all their rows, and those of them that probe."""
    counts = [c for _, _, counts in lanes for c in counts]
    reach = [(len(g), d) for d, parts, _ in lanes for g in parts]
    maybe = [np.packbits(within(c, bits, d)[d] > hot) for c, (bits, d) in zip(counts, reach, strict=True)]  # own rows and probes can be no more
    if not any(m.any() for m in maybe):
        return {}

    def run(batches: Iterator[pa.RecordBatch], what: int) -> Iterator[pa.RecordBatch]:
        plans, allowed, part = sent.value.plans(), [np.unpackbits(m).astype(bool) for m in maybe], 0
        found = np.zeros((len(allowed), len(allowed[0])), np.uint32)
        for batch in batches:
            part, last = batch.column("part")[0].as_py() if batch.num_rows else part, -1
            for kind, key, _, probes in _places(plans, _matrix(batch.column("fp"))):
                some = key[probes] if what else key if kind == last else key[:0]  # all that probe, or what comes after the own places
                np.add.at(found[kind], some[allowed[kind][some]], 1)
                last = kind
        yield from _count_rows(found, part)

    rows = distinct.select("fp", F.spark_partition_id().alias("part"))
    foreign, probing = (_summed(rows.mapInArrow(lambda batches, what=what: run(batches, what), _COUNTS), len(counts[0])) for what in (0, 1))
    out = {}
    for kind, c in enumerate(counts):
        total = c + foreign.get(kind, np.uint32(0))
        at = np.flatnonzero((total > hot) & np.unpackbits(maybe[kind]).astype(bool))
        if len(at):
            out[kind] = at, total[at].astype(np.int64), probing.get(kind, np.zeros(len(c), np.uint32))[at].astype(np.int64)
    return out


def lane_keys(distinct: DataFrame, lanes: list[Lane], hot: int = HOT, sent: Broadcast[Sent] | None = None, crowds: dict | None = None) -> DataFrame:
    """kind (lane and part), key, sub, rep, label, fp (compared lanes), met (see _met()), own, probes: each document's place in every part of every lane, and its probes.

    sub is 0, but for values that more than hot rows have (lane_crowds(), found here if not given). There the rows form
    blocks by a hash of the id, and those that probe form blocks of their own, and sub is a block of rows with a block
    of probing ones: every pair of which one probes meets in one such cell at least. Values without a probe have no rows.
    """
    sc = distinct.sparkSession.sparkContext
    sent = sc.broadcast(Sent(lanes)) if sent is None else sent
    shared = sc.broadcast(lane_crowds(distinct, lanes, sent, hot) if crowds is None else crowds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plans, crowds = sent.value.plans(), shared.value

        def dealt(kind: int, key: np.ndarray, at: np.ndarray, spot: np.ndarray, probes: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
            if kind not in crowds:
                yield key, np.zeros(len(key), np.int64), at, probes
                return
            keys, rows, probing = crowds[kind]
            place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            full = keys[place] == key
            yield key[~full], np.zeros(int((~full).sum()), np.int64), at[~full], probes[~full]
            key, at, probes, place = key[full], at[full], probes[full], place[full]
            high, wide = -(-rows[place] // hot), -(-probing[place] // hot)
            i, j = (spot[at] % high.astype(np.uint64)).astype(np.int64), ((spot[at] >> np.uint64(27)) % np.maximum(wide, 1).astype(np.uint64)).astype(np.int64)
            step = max(1, (1 << 16) // int((high + wide).max(initial=1)))
            for a in range(0, len(key), step):
                some = np.arange(a, min(a + step, len(key)))
                for times, among in ((wide, some), (high, some[probes[some]])):
                    x = np.repeat(among, times[among])
                    nth = np.arange(len(x)) - np.repeat(np.cumsum(times[among]) - times[among], times[among])
                    if times is wide:  # as a row: with every block of probing ones
                        yield key[x], i[x] * wide[x] + nth, at[x], probes[x] & (nth == j[x])
                    else:  # as one that probes: with every other block of rows
                        x, nth = x[nth != i[x]], nth[nth != i[x]]
                        yield key[x], nth * wide[x] + j[x], at[x], np.ones(len(x), bool)

        for batch in batches:
            lanes, label, rep = _matrix(batch.column("fp")), batch.column("label"), batch.column("rep").to_numpy(zero_copy_only=False)
            fp = pa.array([x.tobytes() for x in lanes[:, :COMPARED]], pa.binary())
            spot, met = _scatter(rep), pa.array(_met(plans, lanes))
            last = -1
            for kind, *place in _places(plans, lanes):
                own, last = kind != last, kind
                for key, sub, at, probes in dealt(kind, place[0], place[1], spot, place[2]):
                    if len(key):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int32)), pa.array(key), pa.array(sub), pa.array(rep[at]), label.take(pa.array(at)), fp.take(pa.array(at)), met.take(pa.array(at)), pa.array(np.full(len(key), own)), pa.array(probes)], ["kind", "key", "sub", "rep", "label", "fp", "met", "own", "probes"])

    return distinct.mapInArrow(run, "kind int, key long, sub long, rep long, label long, fp binary, met long, own boolean, probes boolean")


def _nearest_first(n: int, i: np.ndarray, j: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of pairs that connect n rows as all pairs i-j do, the nearest ones (ties: the first), and the rows' labels then.

    Each label takes its nearest pair to another one, labels merge, and so on.
    """
    label, taken, open_ = np.arange(n), [], np.arange(len(i))
    while len(open_ := open_[label[i[open_]] != label[j[open_]]]):
        rank = d[open_].astype(np.int64) << 32 | np.arange(len(open_))
        best = np.full(n, np.iinfo(np.int64).max)
        np.minimum.at(best, label[i[open_]], rank)
        np.minimum.at(best, label[j[open_]], rank)
        one = open_[np.unique(best[best < np.iinfo(np.int64).max] & 0xFFFFFFFF)]
        taken.append(one)
        label = local_components(n, label[i[one]], label[j[one]])[label]
    return np.concatenate([np.empty(0, np.int64), *taken]), label


@dataclass
class _Rows:
    """Rows of places, sorted by place: kind, compared lanes, met, who is in its own place, and who probes."""

    kind: np.ndarray
    fp: np.ndarray
    met: np.ndarray
    own: np.ndarray
    probes: np.ndarray
    masks: np.ndarray
    bits: int

    def part(self, some: slice) -> _Rows:
        return _Rows(self.kind[some], self.fp[some], self.met[some], self.own[some], self.probes[some], self.masks, self.bits)

    def paired(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether one probes where the other's own place is, or both have theirs and one of them probes."""
        return (self.own[i] | self.own[j]) & (self.probes[i] | self.probes[j])

    def first_met(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which pairs have met in no earlier kind: a pair counts where it meets first, so that it is not named again and again."""
        earlier = np.zeros(len(i), bool)
        x, kind = self.fp[i] ^ self.fp[j], self.kind[i]
        for k, masks in enumerate(self.masks):
            for p, mask in enumerate(masks):
                at, two = k * len(masks) + p, np.uint64(2 * (k * len(masks) + p))
                reach = np.maximum(self.met[i] >> two & np.uint64(3), self.met[j] >> two & np.uint64(3))
                earlier |= (kind > at) & (np.bitwise_count(x[:, k] & mask) < reach)
        return ~earlier


class _Group:
    """Rows of one place, and a label for those known to be connected."""

    def __init__(self, rows: _Rows, label: np.ndarray):
        self.rows, self.fp, self.bits = rows, rows.fp, rows.bits
        self.label = np.unique(label, return_inverse=True)[1]
        self.step = max(1, (1 << 18) // len(self.fp))

    def near(self, some: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs of differing labels, one of them probing, that differ in few bits and meet here first: both, and bits.

        Half of the lanes, which are in more than bits already for most pairs, decide which pairs are looked at in full.
        """
        d = np.zeros((len(some), len(others)), np.uint16)
        for lane in range(COMPARED // 2):
            d += np.bitwise_count(self.fp[some, lane][:, None] ^ self.fp[others, lane])
        i, j = np.nonzero(d <= self.bits)
        i, j = some[i], others[j]
        apart = (self.label[i] != self.label[j]) & self.rows.paired(i, j)
        i, j = i[apart], j[apart]
        full = np.bitwise_count(self.fp[i] ^ self.fp[j]).sum(axis=1, dtype=np.int32)
        near = np.flatnonzero(full <= self.bits)
        near = near[self.rows.first_met(i[near], j[near])]
        return i[near], j[near], full[near]

    def forest(self) -> tuple[np.ndarray, np.ndarray]:
        """Near pairs that connect all that near pairs connect, no more than rows: a few rows at a time take the nearest
        pairs that they have with rows of other labels."""
        a, b, every = [], [], np.arange(len(self.fp))
        for at in range(0, len(every), self.step):
            common = np.bincount(self.label).argmax()
            rest = np.flatnonzero(self.label != common)
            some = every[at : at + self.step]
            inside = self.label[some] == common
            found = [self.near(rows, others) for rows, others in ((some[inside], rest), (some[~inside], every)) if len(rows) and len(others)]
            if found:
                i, j, d = (np.concatenate(x) for x in zip(*found, strict=True))
                one, label = _nearest_first(int(self.label.max()) + 1, self.label[i], self.label[j], d)
                a.append(i[one])
                b.append(j[one])
                self.label = np.unique(label[self.label], return_inverse=True)[1]
        return np.concatenate([np.empty(0, np.int64), *a]), np.concatenate([np.empty(0, np.int64), *b])

    def all_apart(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All near pairs of differing labels; rows of the commonest label leave it to the others to name theirs."""
        every = np.arange(len(self.fp))
        rare = every[self.label != np.bincount(self.label).argmax()]
        for at in range(0, len(rare), self.step):
            i, j, _ = self.near(rare[at : at + self.step], every)
            yield i, j


def _near(group: np.ndarray, rows: _Rows, rep: np.ndarray, label: np.ndarray, forest: bool) -> tuple[np.ndarray, np.ndarray]:
    """Candidates among rows of the same group (rows are sorted by it): documents a < b.

    forest: enough of them to connect all that candidates connect, the nearest first; else all of different labels.
    """
    starts = np.flatnonzero(np.diff(group, prepend=-1))
    sizes = np.diff(starts, append=len(group))
    a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    alone = sizes > (WIDE if forest else 1)
    for s, n in zip(starts[alone].tolist(), sizes[alone].tolist(), strict=True):
        some = slice(s, s + n)
        if (label[some] == label[s]).all():
            continue
        g = _Group(rows.part(some), label[some])
        for i, j in [g.forest()] if forest else g.all_apart():
            a.append(s + i)
            b.append(s + j)
    if forest:  # all other groups at once: each row with the first of its group, then with the second, and so on
        first = np.repeat(starts, sizes)
        at, d, found = np.flatnonzero(np.repeat((sizes <= WIDE) & (sizes > 1), sizes)), 0, []
        while len(at := at[at > first[at] + d]):
            pivot = first[at] + d
            open_ = (label[at] != label[pivot]) & rows.paired(at, pivot)
            i, p = at[open_], pivot[open_]
            apart = np.bitwise_count(rows.fp[i] ^ rows.fp[p]).sum(axis=1, dtype=np.int32)
            near = np.flatnonzero(apart <= rows.bits)
            near = near[rows.first_met(i[near], p[near])]
            found.append((p[near], i[near], apart[near]))
            d += 1
        if found:
            p, i, apart = (np.concatenate(x) for x in zip(*found, strict=True))
            one, _ = _nearest_first(len(group), p, i, apart)
            a.append(p[one])
            b.append(i[one])
    a, b = rep[np.concatenate(a)], rep[np.concatenate(b)]
    apart = a != b
    return np.minimum(a, b)[apart], np.maximum(a, b)[apart]


def lane_candidates(keys: DataFrame, lanes: list[Lane], bits: int, n: int, forest: bool = True) -> DataFrame:
    """a < b: documents that share a key, one of them probing there, and differ in at most bits of the compared lanes.

    A pair counts in the first kind that it meets in, and in no other. A null label is the document itself.

    forest: so many of them that all which candidates connect is connected, the nearest first. Else all of different labels.
    """

    masks = np.array([[sum(1 << b for b in g) for g in parts] for _, parts, _ in lanes[:COMPARED]], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None

        def pairs(kind, key, sub, rep, label, met, own, probes, fp) -> pa.RecordBatch:
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (kind[1:] != kind[:-1]) | (sub[1:] != sub[:-1])
            a, b = _near(np.cumsum(new), _Rows(kind, fp, met.view(np.uint64), own, probes, masks, bits), rep, label, forest)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            label = "rep" if batch.column("label").null_count else "label"
            now = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("kind", "key", "sub", "rep", label, "met", "own", "probes")] + [_matrix(batch.column("fp"))]
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now, strict=True)]
            same = np.logical_and.reduce([x == x[-1] for x in now[:3]])
            last = int(np.flatnonzero(same)[0])
            held = [x[last:] for x in now]
            if last:
                yield pairs(*[x[:last] for x in now])
        if held is not None:
            yield pairs(*held)

    dealt = keys.repartition(n, "kind", "key", "sub").sortWithinPartitions("kind", "key", "sub", "rep")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def shingle_sets(docs: DataFrame, ids: DataFrame, words: int, id_col: str, text_col: str, repeats: bool, broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """doc_id, shingles (their hashes): of the documents that ids (doc_id) names; repeats: some rows are alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("t"), strict=True):
                hashes = shingle_set(t.as_py(), words).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(hashes)], pa.int32()), pa.array(hashes))], ["doc_id", "shingles"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("t"))
    found = texts.join(F.broadcast(ids) if ids.count() <= broadcast_ids else ids, "doc_id", "left_semi").mapInArrow(run, "doc_id long, shingles array<long>")
    return found.groupBy("doc_id", F.xxhash64("shingles").alias("v")).agg(F.first("shingles").alias("shingles")).drop("v") if repeats else found


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """a, b, alike: whether the Jaccard index of their sets is similarity or more."""
    both = pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("_sb")), "b").join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("_sa")), "a")
    common = F.size(F.array_intersect("_sa", "_sb"))
    return both.select("a", "b", (common >= similarity * (F.size("_sa") + F.size("_sb") - common) - 1e-9).alias("alike"))


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT, broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """doc_id, component_id of every row with an id: the smallest id of those that links reach.

    Texts are linked if the Jaccard index of their sets of shingles (hashed to 64 bits) of so many words is similarity
    or more; texts without a word are alike. Fingerprints choose the pairs that are looked at: texts that are linked
    are met with a chance that falls from one for copies of a few changes to about 0.93 at the similarity itself.

    A first search names the nearest candidates that connect what all would, so that a group of copies costs little
    more than its size. Where some of them prove not alike and leave their groups apart, a second names all that are
    left. Rows that share an id are one document. Other columns are left out, whatever their names.
    """
    known = docs.where(F.col(id_col).isNotNull())
    prints = checkpointed(lane_fingerprints(known, words, id_col, text_col))
    nodes = checkpointed(prints.groupBy("key", "fp").agg(F.min("doc_id").alias("rep")))
    n = nodes.count()
    plans = lane_plans(nodes)
    sent = docs.sparkSession.sparkContext.broadcast(Sent(plans))
    crowds = lane_crowds(nodes, plans, sent, hot)
    bits = most_bits(similarity)
    of_id = prints.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n"), F.min("key").alias("_lo"), F.max("key").alias("_hi")).where("_n > 1")
    several = checkpointed(of_id.select("doc_id", (F.col("_lo") != F.col("_hi")).alias("_differ")))
    same_id = prints.join(several.where("_differ"), "doc_id", "left_semi").join(nodes, "key").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))

    def search(some: DataFrame, rows: int, **how) -> DataFrame:
        more = sum(int((total * -(-probing // hot) + probing * -(-total // hot)).sum()) for _, total, probing in crowds.values())
        return lane_candidates(lane_keys(some, plans, hot, sent, crowds), plans, bits, n_partitions(nodes, rows * LANES * PARTS + more * rows // max(n, 1), 500_000), **how)

    pairs = checkpointed(search(nodes.withColumn("label", F.lit(None).cast("long")), n))
    ids = checkpointed(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct())
    sets, _ = stored(shingle_sets(known, ids, words, id_col, text_col, several.limit(1).count() > 0, broadcast_ids), "near-duplicates")
    checked = checkpointed(verified(pairs, sets, similarity))
    found = components(checked.where("alike").select("a", "b").union(same_id))
    label = nodes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("rep", "fp", F.coalesce("component", "rep").alias("label"))
    of = checked.where("NOT alike").join(found.select(F.col("node").alias("a"), F.col("component").alias("_a")), "a", "left").join(found.select(F.col("node").alias("b"), F.col("component").alias("_b")), "b", "left")
    ends = of.select(F.coalesce("_a", "a").alias("_a"), F.coalesce("_b", "b").alias("_b")).where("_a <> _b")
    active = checkpointed(label.join(ends.select(F.col("_a").alias("label")).union(ends.select("_b")).distinct(), "label", "left_semi").select("rep", "fp", "label"))
    if rows := active.count():
        more = checkpointed(verified(search(active, rows, forest=False).join(checked, ["a", "b"], "left_anti"), sets, similarity).where("alike"))
        if more.limit(1).count():
            found = components(checked.where("alike").select("a", "b").union(more.select("a", "b")).union(same_id))
    sent.destroy()  # all that used it is in the shared folder
    of_key = nodes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("key", F.coalesce("component", "rep").alias("component_id"))
    return prints.join(of_key, "key").select("doc_id", "component_id")


def drop_near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, with one document of each group of near_duplicates(): that of the smallest id. All columns stay.

    Rows with a null id stay. Of rows that share an id, one stays.
    """
    groups = checkpointed(near_duplicates(docs, similarity, words, id_col, text_col))
    gone = groups.where("doc_id <> component_id").select("doc_id").distinct()
    kept = docs.alias("docs").join(gone.alias("gone"), F.col(f"docs.`{id_col}`") == F.col("gone.doc_id"), "left_anti")
    if groups.groupBy("doc_id").count().where("count > 1").limit(1).count():
        kept = kept.where(F.col(id_col).isNull()).union(kept.where(F.col(id_col).isNotNull()).dropDuplicates([id_col]))
    return kept

"""Language-model scoring with bigram counts in a log-frequency Bloom filter."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER_SPACE, new_path, remove_path, stored, table
from .language_id import fold

#: Tokens of a chunk: what is encoded, counted and scored at a time.
CHUNK_TOKENS = 2_000_000

#: Words and pairs of chunks, with repeats between chunks, that are merged at a time.
MERGE_WORDS = 4_000_000
MERGE_PAIRS = 3_000_000

#: Filter: bits for each entry and hash functions (0.05 % false positives), and bytes that are broadcast at a time.
ENTRY_BITS = 16
HASHES = 11
SEGMENT_BYTES = 64 << 20

#: Folders, at most, that buckets of pairs are kept in; a segment reads its own folders alone.
PAIR_FOLDERS = 4_096

#: Weight of a pair's relative frequency against the word's own.
WEIGHT = 0.25

#: Stands for the end of a text, and before its first word.
END = np.uint64(0x5EED0FE4D0000001)

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(32)
_LOW = np.uint64(0xFFFFFFFF)


def pair_hashes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    x = first * _A + second
    x = (x ^ x >> _C) * _B
    return x ^ x >> _C


def bucket_of(hashes: np.ndarray, n: int) -> np.ndarray:
    return ((hashes >> np.uint64(33)) % np.uint64(n)).astype(np.int64)


class LogFilter:
    """A Bloom filter of (hash, level) for the levels from 1 to a count's own, which is 1 + log2 of it, rounded down."""

    def __init__(self, size: int, bits: np.ndarray):
        self.size, self.bits = size, bits

    @staticmethod
    def levels(counts: np.ndarray) -> np.ndarray:
        return np.frexp(counts.astype(np.float64))[1].astype(np.int64)  # 1, 2, 2, 3, 3, 3, 3, 4 ...

    @staticmethod
    def _seeds(hashes: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        y = (hashes + np.uint64(level * int(_A) & (1 << 64) - 1)) * _B
        y ^= y >> _C
        y *= _A
        return y & _LOW, y >> _C | np.uint64(1)

    @staticmethod
    def _place(a: np.ndarray, b: np.ndarray, k: int, size: int) -> np.ndarray:
        return ((a + np.uint64(k) * b & _LOW) * np.uint64(size) >> _C).astype(np.int64)

    @classmethod
    def of(cls, hashes: np.ndarray, counts: np.ndarray, entry_bits: int = ENTRY_BITS) -> LogFilter:
        levels = cls.levels(counts)
        size = max(64, int(levels.sum()) * entry_bits)
        on = np.zeros(size, np.uint8)
        for level in range(1, int(levels.max(initial=0)) + 1):
            a, b = cls._seeds(hashes[levels >= level], level)
            for k in range(HASHES):
                on[cls._place(a, b, k, size)] = 1
        return cls(size, np.packbits(on, bitorder="little"))

    def probe(self, hashes: np.ndarray) -> np.ndarray:
        """Levels, by probing one after another until one is absent: never too low, seldom too high."""
        out, left, level = np.zeros(len(hashes), np.int64), np.arange(len(hashes)), 0
        while len(left):
            level += 1
            a, b = self._seeds(hashes[left], level)
            for k in range(HASHES):
                at = self._place(a, b, k, self.size)
                hit = (self.bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
                if not hit.all():
                    left, a, b = left[hit], a[hit], b[hit]
            out[left] = level
        return out


def counts_of_levels(levels: np.ndarray) -> np.ndarray:
    """The least of the counts that share a level, so that a word's successors have no more than its own count; 0 for level 0."""
    return np.where(levels > 0, 2.0 ** (levels - 1), 0.0)


def _squeeze(tokens: np.ndarray) -> bytes:
    """Compressed 32-bit numbers, byte planes apart."""
    return zstandard.ZstdCompressor(level=1).compress(tokens.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def _squeeze_hashes(hashes: np.ndarray) -> bytes:
    """Compressed ascending 64-bit numbers: their differences, byte planes apart."""
    return zstandard.ZstdCompressor(level=1).compress(np.diff(hashes, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes())


def _expand_hashes(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    return np.cumsum(np.ascontiguousarray(planes.reshape(8, -1).T).view("<u8").ravel(), dtype=np.uint64)


def _expand(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


_CHUNK = "chunk long, doc_ids array<long>, train array<boolean>, lens array<int>, tokens binary, hashes binary, n_words long, n_train long"


def encode_chunks(docs: DataFrame, train: Column, id_col: str, text_col: str, chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """Documents in chunks: each text's words and one end, numbered within the chunk, and the 64-bit hash of each word.

    Words are told apart by XXH64: among n distinct words, two are taken for one with a chance of about n * n / 2 ** 65.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("binary").alias("t"), F.coalesce(train, F.lit(False)).alias("r"), F.spark_partition_id().cast("long").alias("p"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, part = 0, 0
        vocabulary: defaultdict = defaultdict()
        ids: list = []
        train: list = []
        lens: list[int] = []
        tokens: list[np.ndarray] = []
        size = 0

        def start() -> None:
            nonlocal vocabulary, ids, train, lens, tokens, size
            vocabulary = defaultdict()
            vocabulary.default_factory = vocabulary.__len__
            vocabulary[None]  # the end is number 0
            ids, train, lens, tokens, size = [], [], [], [], 0

        def chunk() -> pa.RecordBatch:
            words = iter(vocabulary)
            next(words)
            hashes = np.concatenate([[END], np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(vocabulary) - 1)]).astype("<u8")
            n_train = sum(n for n, r in zip(lens, train, strict=True) if r)
            columns = [
                pa.array([part << 32 | number], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([train], pa.list_(pa.bool_())), pa.array([lens], pa.list_(pa.int32())),
                pa.array([_squeeze(np.concatenate(tokens))], pa.binary()), pa.array([hashes.tobytes()], pa.binary()), pa.array([len(hashes)], pa.int64()), pa.array([n_train], pa.int64()),
            ]
            return pa.RecordBatch.from_arrays(columns, ["chunk", "doc_ids", "train", "lens", "tokens", "hashes", "n_words", "n_train"])

        start()
        for batch in batches:
            part = batch.column("p")[0].as_py() if batch.num_rows else part
            for i, t, r in zip(batch.column("i").to_pylist(), batch.column("t"), batch.column("r").to_pylist(), strict=True):
                text = t.as_py()
                found = text.translate(LOWER_SPACE).split() if text else []
                numbers = np.fromiter(map(vocabulary.__getitem__, found), np.uint32, len(found))
                tokens += (numbers, np.zeros(1, np.uint32))
                ids.append(i)
                train.append(r)
                lens.append(len(found) + 1)
                size += len(found) + 1
                if size >= chunk_tokens:
                    yield chunk()
                    number += 1
                    start()
        if ids:
            yield chunk()

    return rows.mapInArrow(run, _CHUNK)


def _by_bucket(hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Order by bucket and hash, and where each bucket starts."""
    bucket = bucket_of(hashes, n)
    order = np.lexsort((hashes, bucket))
    return order, np.searchsorted(bucket[order], np.arange(n + 1))


def _chunk_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """chunk, tokens, hashes, lens, train (of each document)."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield (
                batch.column("chunk")[k].as_py(), _expand(batch.column("tokens")[k].as_py()), np.frombuffer(batch.column("hashes")[k].as_py(), "<u8"),
                batch.column("lens")[k].values.to_numpy(), np.array(batch.column("train")[k].as_py(), bool),
            )


def word_counts(chunks: DataFrame, n_buckets: int) -> DataFrame:
    """For each chunk and bucket: the training counts of the chunk's words there, over all chunks; and the bucket's tokens and distinct words."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, tokens, hashes, lens, train in _chunk_rows(batches):
            counts = np.bincount(tokens[np.repeat(train, lens)], minlength=len(hashes))
            order, starts = _by_bucket(hashes, n_buckets)
            h, c = hashes[order], counts[order].astype("<u4")
            rows = [(b, h[x:y].tobytes(), c[x:y].tobytes()) for b, (x, y) in enumerate(zip(starts[:-1], starts[1:], strict=True)) if y > x]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), chunk)), *(pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.binary(), pa.binary()), strict=True))], ["chunk", "bucket", "h", "c"])

    def merge(rows: pa.Table) -> pa.Table:
        hs = [np.frombuffer(x.as_py(), "<u8") for x in rows.column("h")]
        cs = [np.frombuffer(x.as_py(), "<u4") for x in rows.column("c")]
        distinct, at = np.unique(np.concatenate(hs), return_inverse=True)
        total = np.bincount(at, weights=np.concatenate(cs), minlength=len(distinct)).astype("<u8")
        ends = np.cumsum([len(h) for h in hs])
        counts = [total[at[e - len(h) : e]].tobytes() for h, e in zip(hs, ends.tolist(), strict=True)]
        n, v = int(total.sum()), int((total > 0).sum())
        return pa.table({"chunk": rows.column("chunk"), "bucket": rows.column("bucket"), "counts": pa.array(counts, pa.binary()), "n": pa.array([n] * len(hs), pa.int64()), "v": pa.array([v] * len(hs), pa.int64())})

    return chunks.mapInArrow(own, "chunk long, bucket long, h binary, c binary").groupBy("bucket").applyInArrow(merge, "chunk long, bucket long, counts binary, n long, v long")


def _pairs(tokens: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of a token and the one before it (an end before a text's first): both numbers, and each token's pair."""
    before = np.concatenate([[0], tokens[:-1]])
    keys, at = np.unique(before * len(hashes) + tokens, return_inverse=True)
    return keys // len(hashes), keys % len(hashes), at, before


_PAIRS = "folder long, bucket long, chunk long, h binary, size long, bits binary"


def pair_buckets(chunks: DataFrame, n_buckets: int, entry_bits: int = ENTRY_BITS) -> DataFrame:
    """For each bucket of pairs, its filter (chunk null): size (bits) and bits, from the counts of pairs in training texts
    over all chunks; and for each chunk, h, its own pairs there, ascending. folder: to which of PAIR_FOLDERS the bucket goes.
    """
    width = -(-n_buckets // PAIR_FOLDERS)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, tokens, hashes, lens, train in _chunk_rows(batches):
            first, second, at, _ = _pairs(tokens, hashes)
            counts = np.bincount(at[np.repeat(train, lens)], minlength=len(first))
            pairs = pair_hashes(hashes[first], hashes[second])
            order, starts = _by_bucket(pairs, n_buckets)
            h, c = pairs[order], counts[order]
            rows = [(b, chunk, _squeeze_hashes(h[x:y]), _squeeze(c[x:y])) for b, (x, y) in enumerate(zip(starts[:-1], starts[1:], strict=True)) if y > x]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["bucket", "chunk", "h", "c"])

    def merge(rows: pa.Table) -> pa.Table:
        h = np.concatenate([_expand_hashes(x.as_py()) for x in rows.column("h")])
        c = np.concatenate([_expand(x.as_py()) for x in rows.column("c")])
        h, c = h[c > 0], c[c > 0]
        distinct, at = np.unique(h, return_inverse=True)
        f = LogFilter.of(distinct, np.bincount(at, weights=c, minlength=len(distinct)), entry_bits)
        n, bucket = rows.num_rows, rows.column("bucket")[0].as_py()
        return pa.table({
            "folder": pa.array([bucket // width] * (n + 1), pa.int64()), "bucket": pa.array([bucket] * (n + 1), pa.int64()), "chunk": pa.array([None, *rows.column("chunk").to_pylist()], pa.int64()),
            "h": pa.chunked_array([pa.array([None], pa.binary()), *rows.column("h").chunks]), "size": pa.array([f.size, *[None] * n], pa.int64()), "bits": pa.array([f.bits.tobytes(), *[None] * n], pa.binary()),
        })

    return chunks.mapInArrow(own, "bucket long, chunk long, h binary, c binary").groupBy("bucket").applyInArrow(merge, _PAIRS)


def probed(pairs: DataFrame, sent: Broadcast[dict[int, LogFilter]]) -> DataFrame:
    """chunk, bucket, levels (a byte for each of the chunk's pairs there): of pairs whose buckets' filters are sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, chunk, h in zip(batch.column("bucket").to_pylist(), batch.column("chunk").to_pylist(), batch.column("h"), strict=True):
                levels = sent.value[b].probe(_expand_hashes(h.as_py())).astype(np.uint8).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([b], pa.int64()), pa.array([levels], pa.binary())], ["chunk", "bucket", "levels"])

    return pairs.select("bucket", "chunk", "h").mapInArrow(run, "chunk long, bucket long, levels binary")


def segments(filters: DataFrame, most: int) -> list[list[int]]:
    """Buckets whose filters go out together, at most so many bytes (or a single bucket)."""
    out: list[list[int]] = []
    size = most + 1
    for bucket, bits in sorted(map(tuple, filters.select("bucket", "size").collect())):
        if size + bits // 8 > most:
            out.append([])
            size = 0
        out[-1].append(bucket)
        size += bits // 8
    return out


_SCORED = "doc_id long, train boolean, n_tokens long, n_known long, base_score double, score double"


def score_documents(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", weight: float = WEIGHT, segment_bytes: int = SEGMENT_BYTES, chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """doc_id, train, n_tokens, n_known, train_tokens, base_score, score: a row for each row of docs.

    Tokens are the words of the text, A-Z lower-cased, and one end; a null text has the end alone. base_score is the
    log10 probability of independent words, (c + 0.5) / (N + 0.5 * (V + 1)), from the exact counts of all training
    texts. score mixes it, token by token, with weight * count(pair) / count(word before), where the pair's count comes
    from the filter and is no larger than either word's; after a word that no training text has, the base alone holds.
    Without training texts N and V are 0. Repeated rows each count and are each scored; null ids are kept.

    A word's successors have shares that add up to one at most, but for the filter's false positives (one probe of an
    absent pair in 2,000), so that what score adds up are probabilities.

    Nothing here is as large as the vocabulary on any machine: counts of words reach each chunk by a shuffle of merged
    buckets. The filter, which grows with the distinct pairs, is broadcast in segments of segment_bytes, one at a time;
    each is probed for the pairs that chunks have in its buckets, kept in folders of their own, so that all segments
    together read each pair once.
    """
    spark = docs.sparkSession
    chunks, _ = stored(encode_chunks(docs, train, id_col, text_col, chunk_tokens), "lm-chunks")
    sizes = chunks.agg(F.sum("n_words"), F.sum("n_train"), F.sum(F.aggregate("lens", F.lit(0).cast("long"), lambda a, n: a + n))).first()
    n_words, n_train, n_tokens = (x or 0 for x in sizes)
    counts, _ = stored(word_counts(chunks, word_buckets := max(1, -(-n_words // MERGE_WORDS))), "lm-counts")
    totals = counts.groupBy("bucket").agg(F.max("n").alias("n"), F.max("v").alias("v")).agg(F.sum("n"), F.sum("v")).first()
    n, v = totals[0] or 0, totals[1] or 0
    pairs, pairs_path = stored(pair_buckets(chunks, n_buckets := max(1, -(-n_tokens // MERGE_PAIRS))), "lm-pairs", "folder")
    width = -(-n_buckets // PAIR_FOLDERS)
    levels_path = new_path(spark, "lm-levels")
    for buckets in segments(pairs.where("chunk IS NULL"), segment_bytes):
        here = pairs.where(F.col("folder").between(buckets[0] // width, buckets[-1] // width) & F.col("bucket").between(buckets[0], buckets[-1]))
        sent = spark.sparkContext.broadcast({r.bucket: LogFilter(r.size, np.frombuffer(bytes(r.bits), np.uint8)) for r in here.where("chunk IS NULL").toLocalIterator()})
        probed(here.where("chunk IS NOT NULL"), sent).write.mode("append").parquet(levels_path)
        sent.destroy()
    remove_path(spark, pairs_path)
    floor = math.log10(n + 0.5 * (v + 1))

    def run(chunk: pa.Table, parts: pa.Table) -> pa.Table:
        (_, tokens, hashes, lens, train), = _chunk_rows(chunk.to_batches())
        parts = parts.sort_by("bucket")

        def joined(column: str, dtype: str) -> np.ndarray:  # of all buckets, in their order
            return np.frombuffer(b"".join(x.as_py() for x in parts.column(column).drop_null()), dtype)

        count = np.empty(len(hashes), np.float64)
        count[_by_bucket(hashes, word_buckets)[0]] = joined("counts", "<u8")
        base = np.log10(count + 0.5) - floor
        first, second, at, _ = _pairs(tokens, hashes)
        estimate = np.empty(len(first))
        estimate[_by_bucket(pair_hashes(hashes[first], hashes[second]), n_buckets)[0]] = counts_of_levels(joined("levels", "u1").astype(np.int64))
        c1, c2 = count[first], count[second]
        share = np.minimum(estimate, np.minimum(c1, c2)) / np.maximum(c1, 1)
        value = np.where(c1 > 0, np.log10((1 - weight) * 10 ** base[second] + weight * share), base[second])
        starts = np.cumsum(lens) - lens
        return pa.table({
            "doc_id": chunk.column("doc_ids").chunk(0)[0].values, "train": pa.array(train), "n_tokens": pa.array(lens.astype(np.int64)), "n_known": pa.array(np.add.reduceat((count[tokens] > 0).astype(np.int64), starts)),
            "base_score": pa.array(np.add.reduceat(base[tokens], starts)), "score": pa.array(np.add.reduceat(value[at], starts)),
        })

    words = counts.select(F.col("chunk").alias("of"), "bucket", "counts", F.lit(None).cast("binary").alias("levels"))
    if n_tokens:
        read = spark.read.schema("chunk long, bucket long, levels binary").parquet(levels_path)
        words = words.union(read.select("chunk", "bucket", F.lit(None).cast("binary"), "levels"))
    out = chunks.groupBy("chunk").cogroup(words.groupBy("of")).applyInArrow(run, _SCORED)
    return out.select("doc_id", "train", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score_documents(docs, fold("doc_id", 5) != 1)
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")

"""Token ids in binary shards: patched frame-of-reference blocks with an index of block starts."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BLOB_END, checkpointed, new_path, read_blobs, remove_path, running_before, table, write_blobs
from .tokens import encoder

MAGIC = b"TPF1"

#: Ids in a block.
BLOCK = 4096

#: Share of a block's ids that fit its width; the rest are exceptions.
PERCENTILE = 0.95

#: Ids after which a shard is closed; a document is never cut.
SHARD_IDS = 1 << 21

#: Mean bytes of text for each range of ids that is one task.
RANGE_BYTES = 24 << 20

_HEAD = struct.Struct("<4sIqQQ")  # magic, range, number in it, documents, ids
_BLOCK = struct.Struct("<IIBI")  # minimum, ids, width, exceptions


def pack_block(ids: np.ndarray) -> bytes:
    """ids (unsigned 32-bit, one at least) less their minimum, in the bits that PERCENTILE of them need.

    An exception keeps its low bits in place; its position and high bits follow as two lists.
    """
    base = int(ids.min())
    rest = ids - np.uint32(base)
    width = int(np.partition(rest, k := min(len(rest) - 1, int(PERCENTILE * len(rest))))[k]).bit_length()
    high = rest >> np.uint32(width) if width < 32 else np.zeros_like(rest)
    at = np.flatnonzero(high).astype("<u2")
    bits = np.unpackbits(rest.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :width]
    return b"".join(
        [_BLOCK.pack(base, len(ids), width, len(at)), np.packbits(bits, bitorder="little").tobytes(), at.tobytes(), high[at].astype("<u4").tobytes()]
    )


def unpack_block(raw: memoryview) -> np.ndarray:
    base, n, width, extra = _BLOCK.unpack_from(raw)
    if width > 32 or n > BLOCK or extra > n:
        raise ValueError("a block's header is damaged")
    begin, size = _BLOCK.size, (n * width + 7) // 8
    if len(raw) != begin + size + extra * 6:
        raise ValueError("a block's length differs from its header")
    bits = np.zeros((n, 32), np.uint8)
    bits[:, :width] = np.unpackbits(np.frombuffer(raw, np.uint8, size, begin), bitorder="little")[: n * width].reshape(n, width)
    out = np.packbits(bits, axis=1, bitorder="little").view("<u4").ravel()
    at = np.frombuffer(raw, "<u2", extra, begin + size)
    high = np.frombuffer(raw, "<u4", extra, begin + size + 2 * extra)
    out[at] |= high << np.uint32(width)
    return out + np.uint32(base)


def pack_shard(part: int, number: int, doc_ids: list[int | None], sizes: list[int], ids: np.ndarray) -> bytes:
    """A shard file: head, documents (id, whether it is null, tokens), block starts, blocks."""
    blocks = [pack_block(ids[a : a + BLOCK]) for a in range(0, len(ids), BLOCK)]
    starts = np.cumsum([0, *map(len, blocks)]).astype("<u8")
    return b"".join(
        [
            _HEAD.pack(MAGIC, part, number, len(doc_ids), len(ids)),
            np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
            np.array([d is None for d in doc_ids], np.uint8).tobytes(),
            np.array(sizes, "<u4").tobytes(),
            starts.tobytes(),
            *blocks,
        ]
    )


class Shard:
    """Reads a shard; ids(a, b) unpacks only the blocks that hold those positions."""

    def __init__(self, raw: bytes):
        if len(raw) < _HEAD.size or raw[:4] != MAGIC:
            raise ValueError("not a token shard")
        _, self.part, self.number, docs, self.n_ids = _HEAD.unpack_from(raw)
        at = _HEAD.size
        ids = np.frombuffer(raw, "<i8", docs, at).tolist()
        null = np.frombuffer(raw, np.uint8, docs, at + 8 * docs).tolist()
        self.doc_ids = [None if z else i for i, z in zip(ids, null, strict=True)]
        self.sizes = np.frombuffer(raw, "<u4", docs, at + 9 * docs).astype(np.int64)
        blocks = -(-self.n_ids // BLOCK)
        at += 13 * docs
        self.block_starts = np.frombuffer(raw, "<u8", blocks + 1, at).astype(np.int64)
        self._body = memoryview(raw)[at + 8 * (blocks + 1) :]
        if int(self.sizes.sum()) != self.n_ids or len(self._body) != self.block_starts[-1]:
            raise ValueError("a shard's lengths differ from its head")

    def block(self, k: int) -> np.ndarray:
        return unpack_block(self._body[self.block_starts[k] : self.block_starts[k + 1]])

    def ids(self, begin: int, end: int) -> np.ndarray:
        if end <= begin:
            return np.empty(0, np.uint32)
        first, last = begin // BLOCK, (end - 1) // BLOCK
        return np.concatenate([self.block(k) for k in range(first, last + 1)])[begin - first * BLOCK : end - first * BLOCK]


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes shards under path: ids in ascending (id_col, text) order, null ids first, each document's then end_id.

    Null and empty texts have end_id alone. Rows that share an id follow one another, by text. An empty table writes
    no shard. Other columns are left.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, -(-size // RANGE_BYTES))
    ordered = rows.repartitionByRange(n, "i", F.xxhash64("t")).sortWithinPartitions("i", "t").withColumn("p", F.spark_partition_id())
    end = np.array([end_id], "<u4").tobytes()

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        number, held, doc_ids, sizes, part = 0, [], [], [], 0

        def close() -> pa.RecordBatch:
            blob = pack_shard(part, number, doc_ids, sizes, np.frombuffer(b"".join(held), "<u4"))
            return pa.RecordBatch.from_arrays([pa.array([blob], pa.binary())], ["shard"])

        total = 0
        for batch in batches:
            part = batch.column("p")[0].as_py() if batch.num_rows else part
            for i, ids in zip(batch.column("i").to_pylist(), encode(batch.column("t").to_pylist()), strict=True):
                held += (ids, end)
                doc_ids.append(i)
                sizes.append(len(ids) // 4 + 1)
                total += sizes[-1]
                if total >= SHARD_IDS:
                    yield close()
                    number, held, doc_ids, sizes, total = number + 1, [], [], [], 0
        if doc_ids:
            yield close()

    write_blobs(ordered.mapInArrow(shards, "shard binary"), "shard", path)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for raw in batch.column("content"):
            s = Shard(raw.as_py().removesuffix(BLOB_END))
            ids = np.concatenate([np.empty(0, np.uint32), *(s.block(k) for k in range(len(s.block_starts) - 1))]).astype("<u4").tobytes()
            ends = np.cumsum(s.sizes)
            crc = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip((ends - s.sizes).tolist(), ends.tolist(), strict=True)]
            n = len(s.doc_ids)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([s.part] * n, pa.int32()), pa.array([s.number] * n, pa.int64()), pa.array(range(n), pa.int64()), pa.array(s.doc_ids, pa.int64()),
                    pa.array(ends - s.sizes, pa.int64()), pa.array(s.sizes, pa.int64()), pa.array(crc, pa.int64()),
                ],
                ["part", "number", "at", "doc_id", "local", "n_tokens", "ids_crc32"],
            )


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """part, number (a shard's place), at (a document's in it), doc_id, local (ids before it there), n_tokens, ids_crc32."""
    return read_blobs(spark, path).select("content").mapInArrow(
        _documents, "part int, number long, at long, doc_id long, local long, n_tokens long, ids_crc32 long"
    )


def with_starts(documents: DataFrame) -> DataFrame:
    """documents with start: the ids of all documents before each. Sums go from shards to ranges, and from runs of ranges on."""
    shards = documents.groupBy("part", "number").agg(F.sum("n_tokens").alias("_ids"))
    ranges = running_before(shards.groupBy("part").agg(F.sum("_ids").alias("_all")), "part", "_all", "_ahead").drop("_all")
    own = F.sum("_ids").over(Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1))
    before = shards.withColumn("_before", F.coalesce(own, F.lit(0))).join(ranges, "part").drop("_ids")
    return documents.join(before, ["part", "number"]).withColumn("start", F.col("_ahead") + F.col("_before") + F.col("local")).drop("_ahead", "_before")


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = new_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    read = checkpointed(read_documents(spark, path))
    remove_path(spark, path)
    return with_starts(read).select("doc_id", "start", "n_tokens", "ids_crc32")

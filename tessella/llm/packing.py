"""Packing token streams into windows by deficit round-robin over source queues."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import n_partitions, running_before, stored, table
from .tokens import encoder

WINDOW = 2048

#: Tokens that a source waits for before it gets a turn, so that pieces aren't crumbs; ends of documents are shorter.
MIN_PIECE = 64

#: Tokens for each part that is packed by itself, but for what is carried in.
PART_TOKENS = 1 << 20

#: Parts that a task packs one after another, if they are more than the session's shuffle partitions.
PARTS_OF_TASK = 16

_PIECE = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def tokenize(docs: DataFrame, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source (null: empty), n_tokens, ids (little-endian, 16 bits each if they all fit, else 32), wide, nth (row of its task).

    Null and empty texts are end_id alone. Other columns of docs are left out, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, before, end = encoder(tokenizer).encode, 0, np.array([end_id], "<u4").tobytes()
        for batch in batches:
            sizes, raw, wide = [], [], []
            for ids in encode(batch.column("t").to_pylist()):
                a = np.frombuffer(ids + end, "<u4")
                wide.append(bool(a.max() >> 16))
                sizes.append(len(a))
                raw.append((a if wide[-1] else a.astype("<u2")).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("i"), batch.column("s"), pa.array(sizes, pa.int64()), pa.array(raw, pa.binary()), pa.array(wide, pa.bool_()), pa.array(range(before, before + len(sizes)), pa.int64())],
                ["doc_id", "source", "n_tokens", "ids", "wide", "nth"],
            )
            before += len(sizes)

    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("s"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    return rows.mapInArrow(run, "doc_id long, source string, n_tokens long, ids binary, wide boolean, nth long")


def capacities(tokens: int, window: int) -> list[int]:
    """Whole windows, then powers of two that hold the rest without padding."""
    rest = tokens % window
    return [window] * (tokens // window) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def deal(queues: dict[str, list[int]], share: dict[str, float], deficit: dict[str, float], window: int, min_piece: int) -> Iterator[tuple[int, int, int, int, int]]:
    """Yields (document, start, length, sequence, offset); documents are numbered through all queues in order.

    queues: each source's document sizes. A source's turn adds its share of a window to its deficit; when that
    covers min_piece or the rest of the document, it is served as far as the deficit goes. A turn that a full window
    breaks off goes on in the next window; what is left of deficits is carried from window to window. A source that
    runs dry leaves the round.
    """
    todo = capacities(sum(map(sum, queues.values())), window)
    numbers, n_docs = {}, 0
    for s, sizes in queues.items():
        numbers[s] = n_docs
        n_docs += len(sizes)
    turn = deque(sorted((s for s in queues if queues[s]), key=lambda s: (-deficit.get(s, 0.0), s)))
    owed = {s: deficit.get(s, 0.0) for s in queues}
    quantum = {s: max(share.get(s, 0.0) * window, 1.0) for s in queues}
    at = dict.fromkeys(queues, 0)
    begun = dict.fromkeys(queues, 0)
    fresh = True
    for sequence, room in enumerate(todo):
        offset = 0
        while offset < room:
            s = turn[0]
            due = owed[s] + quantum[s] if fresh else owed[s]
            fresh = False
            doc, start = at[s], begun[s]
            left = queues[s][doc] - start
            least = min_piece if min_piece < left else left
            if due < least and len(turn) > 1:
                owed[s] = due
                turn.rotate(-1)
                fresh = True
                continue
            n = min(left, room - offset, max(int(due), least))
            yield numbers[s] + doc, start, n, sequence, offset
            offset += n
            owed[s] = due - n
            if n < left:
                begun[s] = start + n
                continue
            at[s], begun[s] = doc + 1, 0
            if doc + 1 == len(queues[s]):
                turn.popleft()
                fresh = True


def pack(tokens: DataFrame, window: int = WINDOW, min_piece: int = MIN_PIECE, part_tokens: int = PART_TOKENS, shares: dict[str, float] | None = None) -> DataFrame:
    """The pieces of tokenize()'s documents: doc_id, start, length, doc_tokens, sequence_id, offset, ids (32 bits each).

    tokens is read several times: store it first. shares: target proportion of tokens by source; the corpus's own by
    default. Documents go to parts by hash of id, length and place, so that each part, whatever a source's size, is a like
    mix, and repeated rows are spread; a part holds about part_tokens, and more only if one document does. A part begins
    with the deficits that the parts before it leave, reckoned from sums of tokens by part and source, so that all
    parts are packed at once; of a deficit, one window is made good, since the sums drift ever further over many parts
    and would fill whole parts' windows with one source after another. All windows are full, but a part's last tokens fill sequences of powers of two: nothing
    is padded. Repeated rows are packed as often as they occur; an empty table gives no piece.
    """
    total = tokens.agg(F.sum("n_tokens")).first()[0] or 0
    n = max(1, -(-total // part_tokens))
    parted = tokens.withColumn("part", F.pmod(F.xxhash64("doc_id", "n_tokens", "nth"), F.lit(n)))
    sums = parted.groupBy("part", "source").agg(F.sum("n_tokens").alias("n"))
    if shares is None:
        wanted = sums.groupBy("source").agg((F.sum("n") / F.lit(max(total, 1))).alias("share"))
    else:
        wanted = tokens.sparkSession.createDataFrame([(s, float(x)) for s, x in shares.items()] or [("", 0.0)], "source string, share double")
    by_part = running_before(sums.groupBy("part").agg(F.sum("n").alias("m")), "part", "m", "all_before").drop("m")
    carried = (
        sums.join(wanted, "source", "left").na.fill(0.0, ["share"]).join(by_part, "part")
        .selectExpr("part", "source", "share", "n", "all_before", "coalesce(sum(n) OVER (PARTITION BY source ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS own_before")
        .selectExpr("part", "source", "share", f"least(greatest(share * all_before - own_before, -{window}D), {window}D) AS deficit")
        .toDF("to_part", "of", "share", "deficit")
    )

    def run(docs: pa.Table, carry: pa.Table) -> pa.Table:
        docs = docs.sort_by([("source", "ascending"), ("doc_id", "ascending"), ("n_tokens", "ascending")])
        queues: dict[str, list[int]] = {}
        for s, size in zip(docs.column("source").to_pylist(), docs.column("n_tokens").to_pylist(), strict=True):
            queues.setdefault(s, []).append(size)
        of = carry.column("of").to_pylist()
        share, deficit = (dict(zip(of, carry.column(c).to_pylist(), strict=True)) for c in ("share", "deficit"))
        first = carry.column("to_part")[0].as_py() << 32 if carry.num_rows else 0
        flat = b"".join([np.frombuffer(x.as_py(), "<u4" if w else "<u2").astype("<u4").tobytes() for x, w in zip(docs.column("ids"), docs.column("wide").to_pylist(), strict=True)])
        sizes = docs.column("n_tokens").to_numpy()
        pieces = np.fromiter(chain.from_iterable(deal(queues, share, deficit, window, min_piece)), np.int64).reshape(-1, 5)
        doc, start, length, sequence, offset = pieces.T
        begin = ((np.cumsum(sizes) - sizes)[doc] + start) * 4
        ids = [flat[a:b] for a, b in zip(begin.tolist(), (begin + 4 * length).tolist(), strict=True)]
        return pa.table(
            [docs.column("doc_id").take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(sizes[doc]), pa.array(first + sequence), pa.array(offset), pa.array(ids, pa.binary())],
            names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
        )

    tasks = n_partitions(tokens, n, PARTS_OF_TASK)
    return parted.drop("nth").repartition(tasks, "part").groupBy("part").cogroup(carried.repartition(tasks, "to_part").groupBy("to_part")).applyInArrow(run, _PIECE)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """pack(tokenize(docs)), with the tokens kept in the shared folder in between."""
    tokens, _ = stored(tokenize(docs, tokenizer, end_id), "packing")
    return pack(tokens)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    pieces = pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")

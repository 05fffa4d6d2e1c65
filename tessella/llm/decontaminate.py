"""Benchmark decontamination: a prefix-filtered join of item windows with document words, verified exactly."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, stored, table

WINDOW = 10

#: Item words that are broadcast at a time, as windows; more items take more blocks, one after another.
BLOCK_WORDS = 200_000

#: Texts with hits that are broadcast to be joined to the documents; more are joined by a shuffle.
BROADCAST_TEXTS = 20_000

#: [^\x00-\x2F\x3A-\x60\x7B-\x7F] after A-Z became a-z; all else parts words.
_WORDS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """Words of UTF-8 text, lower-cased A-Z; none for null."""
    return text.translate(_WORDS).split() if text else []


def item_blocks(items: DataFrame, id_col: str, text_col: str, window: int, block_words: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """(item id, words) up to block_words at a time; longer items go in overlapping stretches. Null ids and texts take no part."""
    block: list[tuple[str, list[bytes]]] = []
    size = 0
    for row in items.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string"), F.col(text_col).cast("binary")).toLocalIterator():
        words = words_of(bytes(row[1])) if row[1] is not None else []
        for a in range(0, max(1, len(words) - window + 1), block_words):
            some = words[a : a + block_words + window - 1]
            if not some:
                continue
            block.append((row[0], some))
            size += len(some)
            if size >= block_words:
                yield block
                block, size = [], 0
    if block:
        yield block


def windows_of(words: list[bytes], window: int) -> list[list[bytes]]:
    return [words[a : a + window] for a in range(max(1, len(words) - window + 1))]


def word_counts(docs: DataFrame, text_col: str, vocabulary: frozenset[bytes]) -> dict[bytes, int]:
    """How often each word of the vocabulary occurs in all documents."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep, counts = known.value.__contains__, Counter()
        for batch in batches:
            for text in batch.column("t"):
                counts.update(filter(keep, words_of(text.as_py())))
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["w", "n"])

    rows = docs.select(F.col(text_col).cast("binary").alias("t")).mapInArrow(run, "w binary, n long")
    return {bytes(w): n for w, n in rows.groupBy("w").agg(F.sum("n")).collect()}


Prefixes = dict[bytes, dict[tuple[int, int], dict[bytes, list[str]]]]


def prefix_index(block: list[tuple[str, list[bytes]]], counts: dict[bytes, int], window: int) -> Prefixes:
    """By each window's rarest word (ties: the smaller word): by (its place, the window's length): by the window's words, items.

    A window is contained only if all its words are, so that in the order of rarity one word is prefix enough.
    Windows with a word that no document has can't occur and are left out.
    """
    index: Prefixes = {}
    for item, words in block:
        for w in windows_of(words, window):
            at = min(range(len(w)), key=lambda k: (counts.get(w[k], 0), w[k]))
            if counts.get(w[at], 0):
                names = index.setdefault(w[at], {}).setdefault((at, len(w)), {}).setdefault(b" ".join(w), [])
                if not names or names[-1] != item:
                    names.append(item)
    return index


def find(words: list[bytes], index: Prefixes) -> tuple[list[tuple[int, int]], set[str]]:
    """Spans of words that lie in an item's window, apart and in order, and the items."""
    spans: list[tuple[int, int]] = []
    items: set[str] = set()
    n = len(words)
    for i in [i for i, w in enumerate(words) if w in index]:
        for (at, length), known in index[words[i]].items():
            begin = i - at
            if begin < 0 or begin + length > n:
                continue
            if names := known.get(b" ".join(words[begin : begin + length])):
                spans.append((begin, begin + length))
                items.update(names)
    return merged(spans), items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


_FOUND = "n_words long, spans array<struct<begin:long,end:long>>, items array<string>"


def find_contamination(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", keep_text: bool = True, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """docs and n_words, spans (of words, from 0, ends excluded) and items (distinct ids as strings, sorted).

    A window is that many consecutive words of an item, or all words of a shorter one; a null text has no words, and
    null item ids take no part. Each row of docs gives a row, repeated or not; no items, or no documents, give no
    spans. Own columns of these three names are replaced.

    A block of items is looked for in one pass over the documents. Where there are several, each pass keeps only what it
    finds, by a hash of the text, and all of it is joined to the documents once, at the end.
    """
    names = [c for c in docs.columns if c not in ("n_words", "spans", "items") and (keep_text or c != text_col)]
    out_schema = T.StructType([docs.schema[c] for c in names] + T._parse_datatype_string(_FOUND).fields)
    own = [f"_{k}" for k in range(len(names))]  # whatever the columns are named
    frame = docs.select(*(F.col(f"`{c}`").alias(o) for c, o in zip(names, own, strict=True)), F.col(text_col).cast("binary").alias("_text"))
    blocks = item_blocks(items, item_id_col, item_text_col, window, block_words)
    index, following = _block_index(docs, text_col, next(blocks, []), window), next(blocks, None)
    if following is None:
        return frame.mapInArrow(lambda batches: _all_rows(batches, own, names, index), out_schema)
    kept, k = [], 0
    while True:
        kept.append(stored(_keyed(frame).select("_key", "_text").mapInArrow(lambda batches, index=index: _hit_rows(batches, index), _HITS).withColumn("k", F.lit(k)), "decontamination")[0])
        index.unpersist()
        if following is None:
            break
        index, following, k = _block_index(docs, text_col, following, window), next(blocks, None), k + 1
    hits = reduce(DataFrame.union, kept).groupBy("key", "k").agg(F.first("spans").alias("spans"), F.first("items").alias("items"))
    hits = checkpointed(hits.groupBy("key").agg(F.flatten(F.collect_list("spans")).alias("_spans"), F.flatten(F.collect_list("items")).alias("_items")).withColumnRenamed("key", "_key"))
    found = _keyed(frame).join(F.broadcast(hits) if hits.count() <= BROADCAST_TEXTS else hits, "_key", "left").drop("_key")
    return found.mapInArrow(lambda batches: _all_rows(batches, own, names, None), out_schema)


_KIND = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
_HITS = "key binary, spans array<struct<begin:long,end:long>>, items array<string>"


def _block_index(docs: DataFrame, text_col: str, block: list[tuple[str, list[bytes]]], window: int) -> Broadcast[Prefixes]:
    vocabulary = frozenset(w for _, words in block for w in words)
    return docs.sparkSession.sparkContext.broadcast(prefix_index(block, word_counts(docs, text_col, vocabulary) if block else {}, window))


def _keyed(frame: DataFrame) -> DataFrame:
    """frame with _key, 128 bits of the text's SHA-256: what is found in a text depends on nothing else."""
    return frame.withColumn("_key", F.substring(F.unhex(F.sha2("_text", 256)), 1, 16))


def _hit_rows(batches: Iterator[pa.RecordBatch], index: Broadcast[Prefixes]) -> Iterator[pa.RecordBatch]:
    """The keys of texts that hold a window of the block, with its spans and items; other texts give no row."""
    for batch in batches:
        keys, spans, items = [], [], []
        for key, text in zip(batch.column("_key"), batch.column("_text"), strict=True):
            s, names = find(words_of(text.as_py()), index.value)
            if s:
                keys.append(key.as_py())
                spans.append([{"begin": a, "end": b} for a, b in s])
                items.append(sorted(names))
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(spans, _KIND), pa.array(items, pa.list_(pa.string()))], ["key", "spans", "items"])


def _all_rows(batches: Iterator[pa.RecordBatch], own: list[str], names: list[str], index: Broadcast[Prefixes] | None) -> Iterator[pa.RecordBatch]:
    """Every row, with what the index finds or, without one, with what _spans and _items have of all blocks."""
    for batch in batches:
        n_words, spans, items = [], [], []
        for k, text in enumerate(batch.column("_text")):
            words = words_of(text.as_py())
            if index is not None:
                s, found = find(words, index.value)
            else:
                s, found = merged([(x["begin"], x["end"]) for x in batch.column("_spans")[k].as_py() or ()]), set(batch.column("_items")[k].as_py() or ())
            n_words.append(len(words))
            spans.append([{"begin": a, "end": b} for a, b in s])
            items.append(sorted(found))
        new = [pa.array(n_words, pa.int64()), pa.array(spans, _KIND), pa.array(items, pa.list_(pa.string()))]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), *new], [*names, "n_words", "spans", "items"])


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_contamination(docs, table(spark, sf_dir, "benchmark"), keep_text=False)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["begin"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated")
    )


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents),
b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[p:p + least(10, len(w)) - 1], ' ') AS s
  FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS u(p) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM win),
grams AS (
  SELECT doc_id, p, n, array_to_string(w[p:p + n - 1], ' ') AS s
  FROM d, sizes, unnest(range(1, len(w) - n + 2)) AS u(p)),
found AS (SELECT g.doc_id, g.p, g.n, win.item_id FROM grams g JOIN win ON g.n = win.n AND g.s = win.s),
hits AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM found, unnest(range(p, p + n)) AS u(q) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items,
       sha256(coalesce(i.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits h ON d.doc_id = h.doc_id LEFT JOIN items i ON d.doc_id = i.doc_id
"""

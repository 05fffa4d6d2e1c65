"""Language ID: nearest of several centroids per language, over normalised TF-IDF character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

#: Buckets that n-grams are hashed into.
DIMS = 8192

#: Labelled rows that the classifier is fitted on, at most, in all; languages share them evenly.
SAMPLE_ROWS = 4_000

#: Centroids for each language, and rounds of clustering.
CENTROIDS = 4
ROUNDS = 12

#: A document is rejected if its cosine is below this share of the least that its language's sample has.
REJECT = 0.25

UNKNOWN = "und"

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(64 - 13)


@cache
def _letters() -> np.ndarray:
    return np.frombuffer(bytes(chr(c).isalpha() if c < 0xD800 or c > 0xDFFF else False for c in range(0x110000)), np.uint8).astype(bool)


def ngram_counts(text: str | None) -> np.ndarray | None:
    """Bucket counts of the runs of two and three letters, white space and all other signs counting as one space; None without a letter."""
    if not text:
        return None
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4")
    letter = _letters()[codes]
    if not letter.any():
        return None
    c = np.where(letter, codes, 32).astype(np.uint64)
    c = np.concatenate([[np.uint64(32)], c, [np.uint64(32)]])
    on = c != 32
    two = c[:-1] | c[1:] << np.uint64(21)
    two = two[on[:-1] | on[1:]]
    three = (c[:-2] | c[1:-1] << np.uint64(21) | c[2:] << np.uint64(42))[on[1:-1]]
    return np.bincount((np.concatenate([two, three]) * _GOLDEN >> _SHIFT).astype(np.int64), minlength=DIMS)


@dataclass
class Model:
    """Centroids (unit rows), the language and least cosine of each, and the inverse document frequencies."""

    languages: list[str]
    centroids: np.ndarray
    floors: np.ndarray
    idf: np.ndarray

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        x = np.log1p(counts).astype(np.float32) * self.idf
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def predict(self, texts: list[str | None], at_a_time: int = 64) -> Iterator[tuple[str, float, bool]]:
        """(language, cosine from 0 to 1, rejected) of each text."""
        for a in range(0, len(texts), at_a_time):
            counts = [ngram_counts(t) for t in texts[a : a + at_a_time]]
            some = [c for c in counts if c is not None]
            best: Iterator[tuple[int, float]] = iter(())
            if some and self.languages:
                cos = self.vectors(np.array(some)) @ self.centroids.T
                nearest = cos.argmax(axis=1)
                best = iter(zip(nearest.tolist(), cos[np.arange(len(some)), nearest].tolist(), strict=True))
            for c in counts:
                if c is None or not self.languages:
                    yield UNKNOWN, 0.0, True
                else:
                    k, x = next(best)
                    yield self.languages[k], min(max(x, 0.0), 1.0), bool(x < self.floors[k])


@dataclass
class Sparse:
    """Rows of a matrix of DIMS columns: of each, the buckets and their values."""

    at: np.ndarray
    value: np.ndarray
    starts: np.ndarray  # of each row, none of which is empty

    @classmethod
    def of(cls, rows: list[tuple[bytes, bytes]], idf: np.ndarray) -> Sparse:
        """Unit TF-IDF rows of buckets and counts."""
        sizes = [len(b) // 2 for b, _ in rows]
        at = np.frombuffer(b"".join(b for b, _ in rows), "<u2")
        starts = np.cumsum([0, *sizes[:-1]])
        value = np.log1p(np.frombuffer(b"".join(n for _, n in rows), "<u4").astype(np.float32)) * idf[at]
        return cls(at, value / np.repeat(np.sqrt(np.add.reduceat(value * value, starts)), sizes), starts)

    def dot(self, centre: np.ndarray) -> np.ndarray:
        return np.add.reduceat(self.value * centre[self.at], self.starts)

    def sums(self, among: np.ndarray) -> np.ndarray:
        """The sum of the rows marked."""
        on = np.repeat(among, np.diff(self.starts, append=len(self.at)))
        return np.bincount(self.at[on], weights=self.value[on], minlength=DIMS).astype(np.float32)


def clusters(x: Sparse, k: int, rounds: int) -> np.ndarray:
    """Spherical k-means of unit rows; starts from the row nearest the mean, then from rows far from all so far."""
    n = len(x.starts)

    def row(i: int) -> np.ndarray:
        return x.sums(np.arange(n) == i)

    first = row(int(x.dot(x.sums(np.ones(n, bool))).argmax()))
    chosen, near = [first], x.dot(first)
    while len(chosen) < min(k, n):
        chosen.append(row(int(near.argmin())))
        near = np.maximum(near, x.dot(chosen[-1]))
    centres = np.stack(chosen)
    for _ in range(rounds):
        own = np.stack([x.dot(c) for c in centres]).argmax(axis=0)
        sums = np.stack([x.sums(own == j) if (own == j).any() else c for j, c in enumerate(centres)])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centres


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample_rows: int = SAMPLE_ROWS, k: int = CENTROIDS, reject: float = REJECT) -> Model:
    """Fits on labelled rows: all, or a sample by hash of the id, so that there are about sample_rows of them and never more.

    Null labels and texts without a letter teach nothing. Without labelled rows the model knows no language and calls
    every text unknown. Of more languages than sample_rows, the most frequent ones are learnt.
    """
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = {r[0]: r[1] for r in labelled.groupBy(F.col(lang_col).alias("l")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "l").limit(sample_rows).collect()}
    each = sample_rows // max(1, len(counts))
    shares = [F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, 0.9 * each / n) if n > each else 1.0)]
    share = F.coalesce(F.create_map(*shares)[F.col(lang_col)], F.lit(0.0)) if shares else F.lit(0.0)
    place = F.pmod(F.xxhash64(F.col(id_col), F.lit("language")), F.lit(1_000_000)) / 1_000_000

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, buckets, numbers = [], [], []
            for lang, text in zip(batch.column("l"), batch.column("t"), strict=True):
                if (c := ngram_counts(text.as_py())) is not None:
                    at = np.flatnonzero(c)
                    langs.append(lang.as_py())
                    buckets.append(at.astype("<u2").tobytes())
                    numbers.append(c[at].astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(buckets, pa.binary()), pa.array(numbers, pa.binary())], ["l", "b", "n"])

    chosen = labelled.where(place < share).select(F.col(lang_col).alias("l"), F.col(text_col).alias("t"))
    found = chosen.mapInArrow(run, "l string, b binary, n binary").limit(sample_rows).toArrow()
    rows = sorted(zip(*(found.column(c).to_pylist() for c in ("l", "b", "n")), strict=True))
    frequency = np.bincount(np.frombuffer(b"".join(r[1] for r in rows), "<u2"), minlength=DIMS)
    idf = np.log((1 + len(rows)) / (1 + frequency)).astype(np.float32) + 1
    model = Model([], np.zeros((0, DIMS), np.float32), np.zeros(0), idf)
    languages, centroids, floors = [], [], []
    for lang, group in groupby(rows, key=itemgetter(0)):
        own = Sparse.of([r[1:] for r in group], idf)
        centres = clusters(own, k, ROUNDS)
        languages += [lang] * len(centres)
        centroids.append(centres)
        floors += [reject * float(np.stack([own.dot(c) for c in centres]).max(axis=0).min())] * len(centres)
    if languages:
        model = Model(languages, np.concatenate(centroids), np.array(floors), idf)
    return model


def identify(docs: DataFrame, model: Model, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """docs with lang_pred, score and rejected: the text alone decides.

    Null texts and those without a letter are `und`, with score 0, and rejected; so are texts further from every
    centroid than the model allows, which keep their nearest language. Own columns of these names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in docs.columns if c not in ("lang_pred", "score", "rejected") and (keep_text or c != text_col)]

    own = [f"_{k}" for k in range(len(names))]  # whatever the columns are named

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score, rejected = zip(*shared.value.predict(batch.column("_t").to_pylist()), strict=True) if batch.num_rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in own), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], [*names, "lang_pred", "score", "rejected"]
            )

    new = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
    return docs.select(*(F.col(f"`{c}`").alias(o) for c, o in zip(names, own, strict=True)), F.col(text_col).alias("_t")).mapInArrow(run, T.StructType([docs.schema[c] for c in names] + new))


def fold(id_col: str, folds: int) -> Column:
    """CRC-32 of the id as text, modulo folds; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(fold("doc_id", 3) != 1))
    out = identify(docs.select("doc_id", "text"), model, keep_text=False)
    return out.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "rejected")

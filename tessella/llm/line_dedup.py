"""Line dedup: lines found in many documents, marked by sparse per-document bitmaps. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACES, checkpointed, lower_ascii, table

WORD = 64  # lines for each word of a bitmap

#: A line that over one in so many documents has is looked up by broadcast, so that its rows stay where they are; but for
#: HOT_LINES of them at most, the most frequent ones. All other lines are joined by their hash, which Spark can split.
HOT_SHARE = 200
HOT_LINES = 20_000


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(SPACES)))


def _row_key(id_col: str, text_col: str) -> list[Column]:
    return [F.col(id_col).alias("_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_version")]


def line_occurrences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 1) -> DataFrame:
    """One row for each line whose key has at least min_chars code points: _id, _version, _at (from 0), _hash, _nth.

    Hashes (128 bits of the key's SHA-256) are range-partitioned together with the document, so that a very frequent line is cut
    into ranges of documents, and sorted by hash, document and position; _nth streams over that order and is 1 at a
    line's first occurrence in a document.
    """
    lines = docs.select(*_row_key(id_col, text_col), F.posexplode(F.transform(_lines(F.col(text_col)), line_key)).alias("_at", "_key"))
    keyed = lines.where(F.char_length("_key") >= min_chars).select("_id", "_version", "_at", F.substring(F.unhex(F.sha2("_key", 256)), 1, 16).alias("_hash"))
    ranged = keyed.repartitionByRange("_hash", "_id")
    return ranged.withColumn("_nth", F.row_number().over(Window.partitionBy("_hash", "_id").orderBy("_version", "_at")))


def drop_bitmaps(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each document that loses lines: _id, _version, _drop (map from word to bits).

    Bit b of a word w stands for line 64 * w + b; words without a bit are left out, so that the bitmap's size follows
    the dropped lines. Lines go if their key is found in at least min_docs distinct ids (a null id counts as one id);
    keep_first leaves each such key's first occurrence by (id, position).
    """
    at = checkpointed(line_occurrences(docs, id_col, text_col, min_chars))  # read several times below
    firsts = at.where("_nth = 1").groupBy("_hash")  # partial counts: a key's rows never meet in one task
    frequent = firsts.agg(F.count(F.lit(1)).alias("_docs"), F.min(F.struct("_id", "_version", "_at")).alias("_first")).where(F.col("_docs") >= min_docs)
    limit = docs.count() / HOT_SHARE
    frequent = checkpointed(frequent)
    bar = frequent.where(F.col("_docs") > limit).orderBy(F.desc("_docs")).limit(HOT_LINES).agg(F.count(F.lit(1)), F.min("_docs")).first()
    limit = bar[1] if bar[0] == HOT_LINES else limit  # of equally frequent ones at the bar, none is broadcast
    hot = F.broadcast(frequent.where(F.col("_docs") > limit).select("_hash", "_first"))
    rest = frequent.where(F.col("_docs") <= limit).select("_hash", "_first")
    gone = at.join(hot, "_hash").unionByName(at.join(hot, "_hash", "left_anti").join(rest, "_hash"))
    if keep_first:
        gone = gone.where(~F.struct("_id", "_version", "_at").eqNullSafe(F.col("_first")))
    bit = F.expr(f"shiftleft(1L, cast(_at % {WORD} as int))")
    words = gone.groupBy("_id", "_version", F.floor(F.col("_at") / WORD).cast("int").alias("word")).agg(F.bit_or(bit).alias("bits"))
    return words.groupBy("_id", "_version").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("word", "bits")))).alias("_drop"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all its columns, and _lines_in, _dropped (long) and _kept (text; null counts as empty)."""
    mine, version = _row_key(id_col, text_col)
    m = bitmaps.select(F.col("_id").alias("_bid"), F.col("_version").alias("_bversion"), "_drop")
    both = docs.withColumns({"_rid": mine, "_rversion": version}).join(
        m, F.col("_rid").eqNullSafe(F.col("_bid")) & (F.col("_rversion") == F.col("_bversion")), "left"
    )
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.split(text, "\n", -1)
    n_words = F.ceil(F.size(lines) / WORD).cast("int")
    words = F.transform(F.sequence(F.lit(0), n_words - 1), lambda w: F.coalesce(F.col("_drop")[w], F.lit(0).cast("long")))
    flags = F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda b: F.call_function("shiftright", w, b).bitwiseAND(F.lit(1)))))
    paired = F.zip_with(lines, flags, lambda x, f: F.struct(x.alias("x"), f.alias("f")))
    kept = F.transform(F.filter(paired, lambda p: p["x"].isNotNull() & (p["f"] == 0)), lambda p: p["x"])
    dropped = F.aggregate(F.map_values("_drop"), F.lit(0), lambda a, x: a + F.bit_count(x))
    return both.withColumns(
        {
            "_lines_in": (F.char_length(text) - F.char_length(F.translate(text, "\n", "")) + 1).cast("long"),
            "_dropped": F.coalesce(dropped, F.lit(0)).cast("long"),
            "_kept": F.when(F.col("_drop").isNull(), text).otherwise(F.array_join(kept, "\n")),
        }
    ).drop("_rid", "_rversion", "_bid", "_bversion", "_drop")


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False, id_col: str = "doc_id", text_col: str = "text", whole_if_blank: bool = False) -> DataFrame:
    """docs without the lines of drop_bitmaps(), and n_lines, n_dropped (long).

    A null or empty text is one empty line, which has no key and stays; a document all of whose lines go keeps an
    empty text, or, by whole_if_blank, one that would be left with white space alone loses no line. Lines are told apart by \\n alone. Rows that share an id count as one document; each is cut by its
    own text. An empty table gives an empty table. Other columns stay as they are, whatever their names; own
    n_lines and n_dropped are replaced.
    """
    others = [c for c in docs.columns if c not in (text_col, "n_lines", "n_dropped")]
    slim = docs.select(F.col(id_col).alias("_i"), F.col(text_col).alias("_t"), F.struct(*others).alias("_row") if others else F.lit(None).alias("_row"))
    out = apply_bitmaps(slim, drop_bitmaps(slim, min_docs, min_chars, keep_first, "_i", "_t"), "_i", "_t")
    if whole_if_blank:
        blank = (F.col("_dropped") > 0) & (F.length(F.btrim("_kept", F.lit(SPACES))) == 0)
        out = out.withColumns({"_kept": F.when(blank, F.col("_t")).otherwise(F.col("_kept")), "_dropped": F.when(blank, F.lit(0).cast("long")).otherwise(F.col("_dropped"))})
    return out.select(*(F.col("_row").getField(c).alias(c) for c in others), F.col("_kept").alias(text_col), F.col("_lines_in").alias("n_lines"), F.col("_dropped").alias("n_dropped"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=10, min_chars=1)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
frequent AS (
  SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
flagged AS (
  SELECT k.doc_id, k.pos, k.line, f.key IS NOT NULL AS gone FROM keyed k LEFT JOIN frequent f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM flagged GROUP BY doc_id
"""

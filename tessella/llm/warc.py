"""WARC archives of one Zstandard frame for each record, with a dictionary in a leading skippable frame."""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLOB_END, checkpointed, new_path, read_blobs, remove_path, table, write_blobs

#: Magic number of the skippable frame that holds the dictionary, and of any Zstandard frame.
DICTIONARY_FRAME = 0x184D2A5D
ZSTD_FRAME = 0xFD2FB528

#: Payload bytes after which an archive is closed.
ARCHIVE_BYTES = 16 << 20

#: The dictionary: its size, and the records and their bytes that it is fitted on, from each archive's start.
DICTIONARY_BYTES = 16 << 10
SAMPLE_RECORDS = 200
SAMPLE_BYTES = 2 << 20

LEVEL = 3
MIN_REVISIT_BYTES = 1000
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class WarcError(ValueError):
    """An archive that breaks the format, with where it does."""


@dataclass
class Record:
    """A record of an archive: its named fields (lower-cased names) and its block."""

    fields: dict[str, str]
    block: bytes

    @property
    def type(self) -> str:
        return self.fields["warc-type"]

    def http(self) -> tuple[dict[str, str], bytes]:
        """Named fields of the HTTP head in the block, and what follows it."""
        head, gap, body = self.block.partition(b"\r\n\r\n")
        lines = head.decode("utf-8").split("\r\n")
        if not gap or not lines[0].startswith("HTTP/"):
            raise WarcError(f"{self.fields['warc-record-id']}: no HTTP head")
        return _fields(lines[1:], self.fields["warc-record-id"]), body


def _fields(lines: list[str], where: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip():
            raise WarcError(f"{where}: a field without a name: {line[:80]!r}")
        out[name.lower()] = value.strip()
    return out


def _safe(value: str) -> str:
    """A field's value on one line: controls are percent-encoded."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """A response with its payload, or a revisit with the HTTP head alone; both say how long the payload is."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        *([("WARC-Target-URI", _safe(url))] if url is not None else []),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        *([("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", REVISIT_PROFILE)] if revisit else []),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    return b"".join([b"WARC/1.1\r\n", *(f"{k}: {v}\r\n".encode() for k, v in fields), b"\r\n", block, b"\r\n\r\n"])


def train_dictionary(records: list[bytes], size: int = DICTIONARY_BYTES) -> zstandard.ZstdCompressionDict | None:
    """Of the first SAMPLE_RECORDS; none if they are too few to learn from. The dictionary bears on size alone."""
    sample, total = [], 0
    for r in records[:SAMPLE_RECORDS]:
        sample.append(r[: SAMPLE_BYTES // 16])
        total += len(sample[-1])
        if total > SAMPLE_BYTES:
            break
    try:
        return zstandard.train_dictionary(size, sample) if len(sample) >= 8 else None
    except zstandard.ZstdError:
        return None


def write_archive(records: list[bytes], level: int = LEVEL) -> bytes:
    """The dictionary, if there is one, then a frame for each record, with its length and a checksum."""
    trained = train_dictionary(records)
    c = zstandard.ZstdCompressor(level=level, dict_data=trained, write_checksum=True, write_content_size=True)
    out = []
    if trained:
        raw = trained.as_bytes()
        out = [struct.pack("<II", DICTIONARY_FRAME, len(raw)), raw]
    return b"".join([*out, *(c.compress(r) for r in records)])


def parse_record(raw: bytes) -> Record:
    """A record that fills its frame, to the byte; else a WarcError."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    try:
        lines = head.decode("utf-8").split("\r\n")
    except UnicodeDecodeError as e:
        raise WarcError(f"a record's head is not UTF-8: {e}") from None
    if not gap or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise WarcError(f"a record starts with {lines[0][:40]!r}")
    fields = _fields(lines[1:], lines[0])
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise WarcError(f"{fields.get('warc-record-id')}: no {name}")
    if not re.fullmatch(r"\d+", fields["content-length"]):
        raise WarcError(f"{fields['warc-record-id']}: content-length {fields['content-length'][:40]!r}")
    n = int(fields["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise WarcError(f"{fields['warc-record-id']}: {len(rest) - 4} bytes where content-length says {n}")
    return Record(fields, rest[:n])


def read_archive(raw: bytes) -> Iterator[Record]:
    """Records in order: one frame is one record. Skippable frames but a leading dictionary are passed over."""
    view, at, d = memoryview(raw), 0, zstandard.ZstdDecompressor()
    while at < len(raw):
        if len(raw) - at < 8:
            raise WarcError(f"{len(raw) - at} stray bytes at {at}")
        magic, size = struct.unpack_from("<II", raw, at)
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            if at + 8 + size > len(raw):
                raise WarcError(f"a skippable frame at {at} is cut off")
            if magic == DICTIONARY_FRAME and at == 0:
                held = bytes(view[8 : 8 + size])
                if held[:4] == ZSTD_FRAME.to_bytes(4, "little"):  # a dictionary may itself be compressed
                    held = zstandard.ZstdDecompressor().decompressobj().decompress(held)
                d = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(held))
            at += 8 + size
            continue
        if magic != ZSTD_FRAME:
            raise WarcError(f"no frame at {at}")
        one = d.decompressobj()
        try:
            record = one.decompress(view[at:])
        except zstandard.ZstdError as e:
            raise WarcError(f"the frame at {at} is damaged: {e}") from None
        if not one.eof:
            raise WarcError(f"the frame at {at} is cut off")
        at = len(raw) - len(one.unused_data)
        yield parse_record(record)


def originals(pages: DataFrame, id_col: str, payload_col: str, min_bytes: int) -> DataFrame:
    """Of the payloads of min_bytes at least that several rows have: _same (SHA-256), _first, the largest id."""
    digests = pages.select(F.col(id_col).alias("_id"), F.octet_length(payload_col).alias("_n"), F.sha2(F.col(payload_col), 256).alias("_same"))
    long = digests.where(F.col("_n") >= min_bytes).groupBy("_same")
    return long.agg(F.max("_id").alias("_first"), F.count(F.lit(1)).alias("_rows")).where("_rows > 1").select("_same", "_first")


def with_types(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """pages with _digest (SHA-1, which records carry), _revisit and _refers_to.

    Payloads are equal if their SHA-256 is. Only rows of repeated payloads are looked up, without their text; a payload
    that very many rows have is counted in parts and joined as Spark splits it.
    """
    rows = pages.select(F.col(id_col).alias("_pid"), F.octet_length(payload_col).alias("_n"), F.sha2(F.col(payload_col), 256).alias("_same"))
    again = (
        rows.where(F.col("_n") >= min_bytes).join(originals(pages, id_col, payload_col, min_bytes), "_same")
        .where(~F.col("_pid").eqNullSafe(F.col("_first"))).select("_pid", F.col("_same").alias("_s"), "_first").distinct()
    )
    mine = pages.withColumn("_digest", F.sha1(F.col(payload_col))).withColumn("_same", F.sha2(F.col(payload_col), 256))
    both = mine.join(again, mine[id_col].eqNullSafe(again["_pid"]) & (F.col("_same") == F.col("_s")), "left")
    return both.withColumn("_revisit", F.col("_s").isNotNull()).withColumn("_refers_to", F.col("_first")).drop("_pid", "_same", "_s", "_first")


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = MIN_REVISIT_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Writes a record for each row into archives of about archive_bytes under path.

    The payload is the text in UTF-8; null counts as empty. Of rows with equal payloads of min_bytes at least, those
    with the largest id are responses and the others revisit them; a null id is below any other. Repeated rows each
    give a record; an empty table writes no archive. Null urls give records without a target. Other columns are left out,
    whatever their names.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))
    typed = with_types(rows, "page_id", "payload", min_bytes)

    def archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for page_id, url, payload, digest, revisit, refers_to in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "_digest", "_revisit", "_refers_to")), strict=True):
                body = payload.as_py()
                held.append(record_bytes(page_id.as_py(), url.as_py(), body, digest.as_py(), refers_to.as_py(), revisit.as_py()))
                size += len(body)
                if size >= archive_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([write_archive(held)], pa.binary())], ["archive"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([write_archive(held)], pa.binary())], ["archive"])

    write_blobs(typed.mapInArrow(archives, "archive binary"), "archive", path)


def _page(record_id: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)?>", record_id or "")
    return int(m[1]) if m and m[1] else None


_READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """A row for each record under path, its lengths and digests checked; a revisit has no payload of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
        for batch in batches:
            for raw in batch.column("content"):
                out = []
                for r in read_archive(raw.as_py()):
                    http, body = r.http()
                    where, digest = r.fields["warc-record-id"], r.fields["warc-payload-digest"].removeprefix("sha1:")
                    if r.type == "response" and (int(http["content-length"]) != len(body) or hashlib.sha1(body).hexdigest() != digest):
                        raise WarcError(f"{where}: the payload differs from its length or digest")
                    if r.type == "revisit" and body:
                        raise WarcError(f"{where}: a revisit with a payload")
                    out.append({
                        "page_id": _page(where), "url": r.fields.get("warc-target-uri"), "payload_bytes": int(http["content-length"]), "payload_digest": digest, "record_type": r.type,
                        "refers_to": _page(r.fields.get("warc-refers-to")), "payload": body if payloads and r.type == "response" else None,
                    })
                yield pa.RecordBatch.from_pylist(out, schema=kinds)

    return read_blobs(spark, path).select("content").mapInArrow(run, _READ)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    read = checkpointed(read_warc(spark, path, payloads=False).drop("payload", "url"))
    remove_path(spark, path)
    return read


OP5_SQL = r"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages),
o AS (SELECT d, max(page_id) AS first FROM p WHERE n >= 1000 GROUP BY d)
SELECT p.page_id, p.n AS payload_bytes, p.d AS payload_digest,
       CASE WHEN o.first IS NULL OR o.first = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN o.first <> p.page_id THEN o.first END AS refers_to
FROM p LEFT JOIN o ON p.d = o.d AND p.n >= 1000
"""

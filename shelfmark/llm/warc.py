"""WARC archives: written by tasks, read back in byte ranges that are found and owned independently.

Writing: one aggregation by payload digest finds the smallest page id of equal payloads, so a hot payload
meets the join as one row against many and no group is gathered.  Every task streams its pages into an
archive of its own, one gzip member per record, under a name no other attempt uses; only archives listed in
the table of finished tasks exist for the reader, so a lost or repeated task leaves no wrong record.

Reading: a task takes byte ranges of an archive.  It searches the range for gzip magic, accepts a candidate
only if it decodes to a WARC header and the whole member passes its CRC, and owns the records that start
inside its range, reading past the end for the last one.  UTF-8 text can't hold the magic (0x8b never
follows 0x1f), so an uncompressed block inside a member shows no false start.

Paths are opened with ``pyarrow.fs`` and lie in the folder all executors share.

Defined cases: a null payload is empty; a null url is left out; control characters in a url are escaped; a
null page id is read back as null, is larger than any id and never the target of a revisit while another
id has the payload; rows that repeat the smallest page id are all responses; an empty table writes no
archive and reads no row; other columns are not archived.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfmark.llm.common import BROADCAST_BYTES, bounded_batches, table
from shelfmark.session import broadcast_if_small, new_table_path, write_through

REVISIT_BYTES = 100
SPLIT_BYTES = 8 * 1024 * 1024
ROLL_BYTES = 512 * 1024 * 1024
READ_BYTES = 256 * 1024
LEVEL = 3
DATE = "2024-01-01T00:00:00Z"
MAGIC = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def with_record_types(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", url_col: str = "url") -> DataFrame:
    """Rows (page_id, url, payload, digest, refers_to); ``refers_to`` is null for a response."""
    records = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).alias("url"),
        F.coalesce(F.col(payload_col).cast("binary"), F.lit("").cast("binary")).alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))
    groups = (
        records.where(F.octet_length("payload") >= REVISIT_BYTES)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .where((F.col("n") > 1) & F.col("first").isNotNull())
        .select("digest", "first")
    )
    groups = broadcast_if_small(write_through(groups, "warc-groups"), BROADCAST_BYTES)
    repeats = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return records.join(groups, "digest", "left").select(
        "page_id", "url", "payload", "digest", F.when(repeats, F.col("first")).alias("refers_to")
    )


def encode_record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One record as a gzip member."""
    own = f"urn:page:{page_id}" if page_id is not None else f"urn:uuid:{uuid.uuid4()}"
    head = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<{own}>"),
        ("WARC-Date", DATE),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("X-Payload-Length", len(payload)),
    ]
    if url is not None:
        head.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f-\x9f]", lambda m: quote(m[0]), url)))
    if refers_to is not None:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
        payload = b""
    head += [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", len(payload))]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(text.encode()) + packer.compress(payload) + packer.compress(b"\r\n\r\n") + packer.flush()


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Write ``records`` below ``folder``; returns the table (path, bytes) of the archives that count."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = arrow_fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        done, out, name, size = [], None, "", 0
        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "payload", "digest", "refers_to")]
            for i in range(batch.num_rows):
                member = encode_record(*(c[i].as_py() for c in columns))
                if out is None or size + len(member) > ROLL_BYTES:
                    if out is not None:
                        out.close()
                        done.append((name, size))
                    name, size = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{root}/{name.rpartition('/')[2]}", compression=None)
                out.write(member)
                size += len(member)
        if out is not None:
            out.close()
            done.append((name, size))
        yield pa.RecordBatch.from_pydict(
            {"path": [x[0] for x in done], "bytes": [x[1] for x in done]}, pa.schema([("path", pa.string()), ("bytes", pa.int64())])
        )

    return write_through(bounded_batches(records).mapInArrow(write, "path string, bytes long"), "warc-archives")


def list_archives(spark: SparkSession, folder: str) -> DataFrame:
    """(path, bytes) of the archives someone else wrote below ``folder``."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select(
        "path", F.col("length").alias("bytes")
    )


class _Window:
    """The bytes of a file from a place on, read as they are asked for and dropped when passed."""

    def __init__(self, file, at: int):
        self.file, self.base, self.data, self.ended = file, at, bytearray(), False
        file.seek(at)

    def reach(self, at: int) -> bool:
        """Have the byte before ``at``; False when the file is shorter."""
        while self.base + len(self.data) < at and not self.ended:
            more = self.file.read(READ_BYTES)
            self.data += more
            self.ended = not more
        return self.base + len(self.data) >= at

    def drop(self, at: int) -> None:
        del self.data[: at - self.base]
        self.base = at


def _member(window: _Window, at: int):
    """The decoded member at ``at`` and the place after it, or None if none starts there."""
    unpack, parts, place, checked = zlib.decompressobj(31), [], at, False
    while not unpack.eof:
        if not window.reach(place + 1):
            return None
        chunk = bytes(window.data[place - window.base : place - window.base + READ_BYTES])
        try:
            parts.append(unpack.decompress(chunk))
        except zlib.error:
            return None
        place += len(chunk)
        if not checked and sum(map(len, parts)) >= 7:
            parts = [b"".join(parts)]
            if not re.match(rb"WARC/\d\.\d", parts[0] + b"0" * (7 - min(7, len(parts[0])))):
                return None
            checked = True
    return b"".join(parts), place - len(unpack.unused_data)


def _parsed(record: bytes):
    """Headers and payload of a decoded record, or None."""
    head, mark, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not mark or not re.fullmatch(r"WARC/\d\.\d", lines[0]):
        return None
    headers = {k.strip().lower(): v.strip() for k, sep, v in (x.partition(":") for x in lines[1:]) if sep}
    length = headers.get("content-length", "")
    if not length.isdigit() or len(rest) < int(length):
        return None
    return headers, rest[: int(length)]


def records_in_range(file, start: int, end: int):
    """(headers, payload) of the records that start in [start, end) of an open archive."""
    window, at = _Window(file, start), start
    while at < end:
        window.drop(at)
        window.reach(min(end, at + READ_BYTES) + len(MAGIC) - 1)
        found = window.data.find(MAGIC)
        if found < 0:
            at = max(at + 1, window.base + len(window.data) - len(MAGIC) + 1)
            if window.ended:
                return
            continue
        at = window.base + found
        if at >= end:
            return
        member = _member(window, at)
        parsed = _parsed(member[0]) if member else None
        if parsed:
            yield parsed
        at = member[1] if parsed else at + 1


def _page(urn: str | None):
    match = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(match[1]) if match else None


RECORD_SCHEMA = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_archives(archives: DataFrame, split_bytes: int = SPLIT_BYTES, payload: bool = False) -> DataFrame:
    """One row per record of the archives (path, bytes); with ``payload``, a binary column more."""
    ranges = archives.where("bytes > 0").select(
        "path", "bytes", F.explode(F.sequence(F.lit(0), F.col("bytes") - 1, F.lit(split_bytes))).alias("start")
    )
    tasks = archives.agg(F.sum(F.ceil(F.col("bytes") / split_bytes)).alias("n")).first()["n"] or 1
    ranges = ranges.repartition(int(min(tasks, 20_000)))
    schema = RECORD_SCHEMA + (", payload binary" if payload else "")
    kinds = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
    arrow = pa.schema(kinds + ([("payload", pa.binary())] if payload else []))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                store, inner = arrow_fs.FileSystem.from_uri(path)
                with store.open_input_file(inner) as file:
                    for headers, body in records_in_range(file, start, start + split_bytes):
                        stated = headers.get("warc-payload-digest", "").removeprefix("sha256:")
                        kind, n, digest = headers.get("warc-type"), len(body), hashlib.sha256(body).hexdigest()
                        if kind == "revisit":
                            n, digest = int(headers.get("x-payload-length", 0)), stated
                        elif stated and stated != digest:
                            raise ValueError(f"{path}: payload of {headers.get('warc-record-id')} is damaged")
                        row = (_page(headers.get("warc-record-id")), headers.get("warc-target-uri"), n, digest, kind, _page(headers.get("warc-refers-to")))
                        rows.append(row + ((body,) if payload else ()))
                        held += 200 + (len(body) if payload else 0)
                        if held > 4_000_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), arrow.types)], schema=arrow)
                            rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), arrow.types)], schema=arrow)

    return ranges.select("path", "start").mapInArrow(read, schema)


def op10_warc(spark, sf_dir):
    """Every page through the archives and back."""
    folder = new_table_path(spark, "warc")
    archives = write_archives(with_record_types(table(spark, sf_dir, "pages")), folder)
    return read_archives(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha256(payload) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes < {REVISIT_BYTES} OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN payload_bytes < {REVISIT_BYTES} OR page_id = first THEN NULL ELSE first END AS refers_to
FROM f
"""

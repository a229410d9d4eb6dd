"""WARC archives: a writer with revisit records and a splittable reader.

Every record is a gzip member of its own. A reading task gets a byte range of an archive, looks for the gzip magic in it,
accepts a candidate only if it inflates to a WARC header, and owns the records that start inside its range; a record may end
beyond it. No index is needed and no task reads an archive from its beginning.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, scratch

MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1\r\n"
#: Bytes read at a time.
CHUNK = 1 << 20
PAGE_URN = "urn:page:"


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def encode_record(kind: str, page_id: int | None, url: str | None, payload: bytes, sha1: str, refers_to: int | None, level: int = 6) -> bytes:
    """One record as a gzip member. A revisit carries no payload, only its digest and length."""
    one_line = re.sub(r"[\r\n]+", " ", url) if url is not None else None
    name = lambda i: f"<{PAGE_URN}{'' if i is None else i}>"
    body = payload if kind == "response" else b""
    lines = [f"WARC-Type: {kind}", f"WARC-Record-ID: {name(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    lines += [f"WARC-Target-URI: {one_line}"] if one_line is not None else []
    lines += [f"WARC-Payload-Digest: sha1:{sha1}", f"X-Payload-Length: {len(payload)}"]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to)}"]
    lines += [f"Content-Length: {len(body)}"]
    data = VERSION + "\r\n".join(lines).encode("utf-8") + b"\r\n\r\n" + body + b"\r\n\r\n"
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def parse_header(data: bytes) -> tuple[dict[str, str], int] | None:
    """Fields by lower-case name and the offset of the body, or None if data doesn't start with a whole WARC header."""
    end = data.find(b"\r\n\r\n")
    if not data.startswith(b"WARC/") or end < 0:
        return None
    fields = {}
    for line in data[:end].split(b"\r\n")[1:]:
        key, colon, value = line.partition(b":")
        if not colon:
            return None
        fields[key.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
    return (fields, end + 4) if fields.get("content-length", "").isdigit() else None


def _file_system(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def read_range(source, size: int, start: int, stop: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, fields, body) of the records of an open archive that start in [start, stop).

    A candidate must inflate to a complete WARC header. After a good member the next one is tried directly behind it, and
    the search goes on byte by byte where that fails, so magic inside compressed data or damaged members are passed over.
    """
    at = start
    window, base = b"", start
    while at < stop:
        if at < base or at + len(MAGIC) > base + len(window):
            source.seek(at)
            window, base = source.read(min(CHUNK, stop - at + len(MAGIC) - 1)), at
        hit = window.find(MAGIC, at - base)
        if hit < 0:
            ahead = base + len(window) - (len(MAGIC) - 1)
            if ahead <= at or base + len(window) >= min(size, stop + len(MAGIC) - 1):
                return
            at = ahead
            continue
        at = base + hit
        if at >= stop:
            return
        found = _member(source, at)
        if found is None:
            at += 1
            continue
        fields, body, length = found
        yield at, fields, body
        at += length


def _member(source, at: int) -> tuple[dict[str, str], bytes, int] | None:
    """Fields, body and compressed length of the record whose gzip member starts at `at`; None if there is none."""
    source.seek(at)
    inflate, data, used, header = zlib.decompressobj(31), [], 0, None
    step = 1 << 14
    try:
        while not inflate.eof:
            raw = source.read(step)
            if not raw:
                return None
            used += len(raw)
            step = CHUNK
            data.append(inflate.decompress(raw))
            if header is None:
                head = b"".join(data)
                data = [head]
                header = parse_header(head)
                # a header may be of any length: it ends somewhere in the member, or the member is no record
                if header is None and (b"\r\n\r\n" in head or not head.startswith(b"WARC/"[: len(head)])):
                    return None
    except zlib.error:
        return None
    whole = b"".join(data)
    header = header or parse_header(whole)
    if header is None:
        return None
    fields, start = header
    length = int(fields["content-length"])
    if len(whole) < start + length:
        return None
    return fields, whole[start : start + length], used - len(inflate.unused_data)


def write(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Archives the pages (page_id, url, html) under folder; returns the manifest (path, bytes, records).

    Of pages with equal payloads of at least min_bytes the smallest page_id is the response and the others refer to it. Null
    html is an empty payload; rows that repeat the smallest page_id are all responses; a null page_id is a revisit of a known
    page with the same payload, else a response. An attempt that is lost leaves a file that the manifest doesn't name.
    """
    # the file system's own sha1 of the same bytes groups copies without moving texts
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("html"), F.lit("")), "utf-8").alias("payload"))
    keyed = keyed.withColumn("sha1", F.sha1("payload"))
    groups = keyed.filter(F.octet_length("payload") >= min_bytes).groupBy(F.col("sha1").alias("_sha1")).agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    firsts = materialize(groups.filter("n > 1 and first is not null").select("_sha1", "first"), "warc-firsts")
    narrow = keyed.select("page_id", F.col("sha1").alias("key")).distinct().join(firsts, F.col("key") == F.col("_sha1")).select("page_id", "key", "first")
    repeats = materialize(narrow.filter(~F.col("page_id").eqNullSafe(F.col("first"))), "warc-repeats").select(F.col("page_id").alias("_id"), F.col("key").alias("_key"), "first")
    marked = keyed.join(repeats, F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("sha1") == F.col("_key")), "left")
    rows = marked.select("page_id", "url", "payload", F.col("first").alias("refers_to"))

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = _file_system(folder)
        store.create_dir(top, recursive=True)
        name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz"
        records = size = 0
        with store.open_output_stream(f"{top}/{name}", compression=None) as out:
            for b in batches:
                for page, url, payload, refers in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist()):
                    data = payload.as_py()
                    raw = encode_record("response" if refers is None else "revisit", page, url, data, digest(data), refers)
                    out.write(raw)
                    records, size = records + 1, size + len(raw)
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([size], pa.int64()), pa.array([records], pa.int64())], names=["path", "bytes", "records"])

    return materialize(rows.mapInArrow(archive, "path string, bytes long, records long"), "warc-manifest")


FIELDS = "path string, offset long, record_type string, record_id string, target_uri string, payload_digest string, refers_to string, declared_bytes long, payload binary"


def read(manifest: DataFrame, split_bytes: int = 16 << 20) -> DataFrame:
    """The records of the archives (path, bytes), a row each, read in ranges of split_bytes; empty archives have no rows."""
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long")))
    splits = manifest.filter("bytes > 0").select("path", "bytes", starts.alias("start"))
    # ranges are dealt out by their own hash: no key repeats
    splits = splits.repartition(max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "path", "start")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in FIELDS.split(", ")]
        types = [pa.string(), pa.int64(), *[pa.string()] * 5, pa.int64(), pa.binary()]

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * len(types), types)], names=names)

        for b in batches:
            for path, size, start in zip(*(b.column(k).to_pylist() for k in range(3))):
                store, place = _file_system(path)
                rows, held = [], 0
                with store.open_input_file(place) as source:
                    for offset, f, body in read_range(source, size, start, min(size, start + split_bytes)):
                        declared = f.get("x-payload-length", "")
                        rows.append((path, offset, f.get("warc-type"), f.get("warc-record-id"), f.get("warc-target-uri"), f.get("warc-payload-digest"), f.get("warc-refers-to"), int(declared) if declared.isdigit() else None, body))
                        held += len(body)
                        if held > 8 << 20:
                            yield out(rows)
                            rows, held = [], 0
                yield out(rows)

    return splits.mapInArrow(scan, FIELDS)


def _page(column: str):
    return F.regexp_extract(F.col(column), PAGE_URN + r"(-?\d+)>", 1)


def digests(records: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of archived pages.

    A response's length and digest are those of the payload that was read; a revisit's are what its header says of the page.
    """

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kind, said, declared, body = (b.column(k) for k in range(2, 6))
            rows = [
                (len(d), digest(d)) if k == "response" else (n, (s or "").removeprefix("sha1:"))
                for k, s, n, d in zip(kind.to_pylist(), said.to_pylist(), declared.to_pylist(), (x.as_py() for x in body))
            ]
            sizes, sums = list(zip(*rows)) or ([], [])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(sums, pa.string()), kind, b.column(1)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    number = lambda c: F.nullif(_page(c), F.lit("")).cast("long").alias(c)
    narrow = records.select(number("record_id"), number("refers_to"), "record_type", "payload_digest", "declared_bytes", "payload")
    return narrow.mapInArrow(measure, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive_and_read(spark: SparkSession, pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes the pages as archives in the shared folder and reads them back; fails unless every record written is read."""
    manifest = write(pages, scratch(spark, "warc"), min_bytes)
    found = materialize(digests(read(manifest)), "warc-records")
    written, seen = manifest.agg(F.coalesce(F.sum("records"), F.lit(0))).first()[0], found.count()
    if written != seen:
        raise ValueError(f"{written} records were written to the archives and {seen} read from them")
    return found

"""WARC archives with a Zstandard dictionary.

An archive is one file in the public .warc.zst layout: a skippable frame (magic 0x184D2A5D, little-endian length) that
holds a dictionary built from the archive's own records, then one Zstandard frame for each record. Archives are rows
(archive, content) of a table that Spark's committer writes to the shared folder, so a retried task leaves no half
file; `export` puts them out as files.

Defined results: a null payload is empty; null urls give an empty target; of rows with equal payloads those with the
smallest page_id are responses and the others revisit it (repeated rows of that page_id are responses each); rows whose
page_id is null never stand as originals, and are responses where no other row has their payload; an empty table
gives no archive; columns other than the three named are not read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorefabric.llm.common import materialise, table, tune

SKIPPABLE = 0x184D2A5D  # fixed value of the .warc.zst layout
DICT_BYTES = 32 << 10
#: Raw bytes after which an archive is closed; a task holds one archive at a time.
ARCHIVE_BYTES = 24 << 20
#: Raw bytes of an archive's first records from which its dictionary is built.
SAMPLE_BYTES = 2 << 20
DATE = "1970-01-01T00:00:00Z"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC/1.1 record; a revisit stores no payload and names the original."""
    named = "" if page_id is None else str(page_id)
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{named}')}>",
        f"WARC-Page-ID: {named}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {' '.join((url or '').split())}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Payload-Length: {len(payload)}",
    ]
    if refers_to is None:
        body = payload
    else:
        body = b""
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{refers_to}')}>", f"WARC-Refers-To-Page: {refers_to}"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    n = int(fields["Content-Length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("a WARC record ends early")
    return fields, rest[:n]


def build_dictionary(records: list[bytes]) -> bytes:
    """From the first SAMPLE_BYTES of records. An archive of fewer than 16 records, from which the trainer can't build one, has
    the first bytes of its first record as a raw-content dictionary; it is read the same way."""
    sample, size = [], 0
    for r in records:
        sample.append(r[: 128 << 10])
        size += len(sample[-1])
        if size >= SAMPLE_BYTES:
            break
    try:
        return zstandard.train_dictionary(DICT_BYTES, sample, d=8, k=256, f=18, accel=4).as_bytes() if len(sample) >= 16 else sample[0][:4096]
    except zstandard.ZstdError:
        return sample[0][:4096]


def _compressor(data: bytes) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(data), write_checksum=True)


def write_archive(records: list[bytes]) -> bytes:
    data = build_dictionary(records)
    c = _compressor(data)
    return b"".join([struct.pack("<II", SKIPPABLE, len(data)), data, *map(c.compress, records)])


def read_archive(content: bytes):
    """The records of an archive, one after another."""
    magic, n = struct.unpack_from("<II", content)
    if magic != SKIPPABLE:
        raise ValueError("no dictionary frame")
    at, d = 8 + n, zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content[8 : 8 + n]))
    view = memoryview(content)
    while at < len(content):
        step = d.decompressobj()
        out, ahead = [], 1 << 16
        start = at
        while not step.eof:
            piece = view[start : start + ahead]
            if not piece:
                raise ValueError("an archive ends early")
            out.append(step.decompress(piece))
            start += len(piece)
        at = start - len(step.unused_data)
        yield parse(b"".join(out))


def archives(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(archive, content): every row of pages is a record of one archive."""
    tune(pages.sparkSession)
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html).cast("binary"), F.lit(b"")).alias("html")).withColumn("sha", F.sha1("html"))
    # Only payloads that repeat are looked up, and without their bytes: counts combine before the shuffle.
    thin = rows.select("page_id", "sha")
    firsts = thin.groupBy("sha").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1 and first_id is not null").select("sha", "first_id")
    revisits = thin.join(firsts, "sha").where("page_id is null or page_id <> first_id").select(F.col("page_id").alias("_id"), F.col("sha").alias("_sha"), F.col("first_id").alias("refers_to")).distinct()
    # payloads are dealt by page, so those that many pages share don't meet in one task
    linked = rows.join(revisits, F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("sha") == F.col("_sha")), "left").select("page_id", "url", "html", "refers_to")

    def write(batches):
        held, size, k = [], 0, 0
        from pyspark import TaskContext

        pid = TaskContext.get().partitionId()
        for b in batches:
            for i, u, h, r in zip(b["page_id"], b["url"], b["html"], b["refers_to"], strict=True):
                h = bytes(h)
                held.append(record(None if pd.isna(i) else int(i), u, h, digest32(h), None if pd.isna(r) else int(r)))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield pd.DataFrame({"archive": [f"part-{pid:06d}-{k:04d}.warc.zst"], "content": [write_archive(held)]})
                    held, size, k = [], 0, k + 1
        if held:
            yield pd.DataFrame({"archive": [f"part-{pid:06d}-{k:04d}.warc.zst"], "content": [write_archive(held)]})

    return linked.mapInPandas(write, "archive string, content binary")


def records(written: DataFrame) -> DataFrame:
    """Read archives: a row for each record, payload included; digests of stored payloads are checked."""

    def read(batches):
        for b in batches:
            for content in b["content"]:
                rows, size = [], 0
                for f, body in read_archive(bytes(content)):
                    page, to = f["WARC-Page-ID"], f.get("WARC-Refers-To-Page")
                    digest = f["WARC-Payload-Digest"].removeprefix("sha1:")
                    if to is None and digest32(body) != digest:
                        raise ValueError(f"payload of page {page} differs from its digest")
                    rows.append((int(page) if page else None, f["WARC-Target-URI"], int(f["WARC-Payload-Length"]), digest, f["WARC-Type"], None if to is None else int(to), body))
                    size += len(body)
                    if size > 8 << 20:
                        yield _records(rows)
                        rows, size = [], 0
                if rows:
                    yield _records(rows)

    return written.mapInPandas(read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def _records(rows) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])
    return out.astype({"page_id": "Int64", "refers_to": "Int64"})


def export(written: DataFrame, folder: str) -> int:
    """Put archives out as files of a folder that the driver can write, one at a time; the number of files."""
    import os

    n = 0
    for name, content in written.select("archive", "content").toLocalIterator():
        with open(os.path.join(folder, name), "wb") as f:
            f.write(content)
        n += 1
    return n


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = materialise(archives(table(spark, sf_dir, "pages")), "warc", codec="uncompressed")
    return records(written).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")

"""Media columns: payloads kept as chunk lists over a store of chunks.

A payload of 8-bit samples is cut where a rolling gear hash of the last 32 bytes has CUT_BITS low zero bits, between LEAST
and MOST bytes. The digest of a chunk names it. Chunks whose digest repeats in the corpus live once in a chunk store,
where Spark joins bring them together; the other chunks live in the media row itself, so most bytes are written once
and never shuffled. A media row holds the ordered chunk list as bytes (magic, sample width, payload length, number of
chunks, each chunk's digest and length) and the chunks, null where the store has them. Reading parses the stored list,
joins the store's chunks back, puts them in order, checks every digest and the payload's own, and computes features of
the samples.

The stored form, to which media_bytes and media_sha256 refer, is what is read back: the stored chunk list followed by the
stored chunks in its order. It depends on the payload alone.

Defined results: a null payload is empty; repeated rows each have a media row; a null doc_id keeps its row; an empty
table gives no rows; columns other than the key and the text are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorefabric.llm.common import materialise, may_repeat, repeated_bits, table, tune

LEAST, MOST, CUT_BITS = 256, 8192, 11
PAD, PAD_TO = 255, 576
MAGIC = b"SFMC"
# the gear table: 256 numbers from a fixed hash of the byte
_GEAR = np.array([xxhash.xxh32_intdigest(bytes([i]), seed=7) for i in range(256)], np.uint32)


def cut_points(payload: bytes) -> list[int]:
    """Ends of the chunks, in order; the last is the payload's length."""
    n = len(payload)
    h = _GEAR[np.frombuffer(payload, np.uint8)]
    for k in (1, 2, 4, 8, 16):  # doubling: after it h holds the gear hash of the last 2k bytes
        h[k:] = h[k:] + (h[:-k] << np.uint32(k)) if n > k else h[k:]
    # the low bits see the newest bytes only, so the high ones are asked
    marks = np.flatnonzero(h >> np.uint32(32 - CUT_BITS) == 0) + 1
    out, start = [], 0
    while n - start > LEAST:
        i = np.searchsorted(marks, start + LEAST)
        end = int(marks[i]) if i < len(marks) else n
        end = min(end, start + MOST, n)
        out.append(end)
        start = end
    if start < n or not out:
        out.append(n)
    return out


def chunks(payload: bytes) -> list[tuple[bytes, bytes]]:
    """(digest, bytes) in order."""
    out, at = [], 0
    for end in cut_points(payload):
        piece = payload[at:end]
        out.append((xxhash.xxh3_128_digest(piece), piece))
        at = end
    return out


def chunk_list(parts: list[tuple[bytes, int]]) -> bytes:
    """The list as bytes."""
    return MAGIC + struct.pack("<BQI", 1, sum(n for _, n in parts), len(parts)) + b"".join(d + struct.pack("<I", n) for d, n in parts)


def parse_list(raw: bytes) -> list[tuple[bytes, int]]:
    """(digest, length) of the chunks of a stored list."""
    if raw[:4] != MAGIC:
        raise ValueError("not a chunk list")
    width, total, n = struct.unpack_from("<BQI", raw, 4)
    parts = [(d, size) for d, size in struct.iter_unpack("<16sI", raw[4 + struct.calcsize("<BQI") :])]
    if width != 1 or len(parts) != n or sum(size for _, size in parts) != total:
        raise ValueError("a chunk list differs from its head")
    return parts


def text_payload(text: str | None) -> bytes:
    """The text's UTF-8 bytes, with bytes 255 to a positive multiple of PAD_TO."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes([PAD]) * (-len(raw) % PAD_TO or (0 if raw else PAD_TO))


def features(payload: bytes) -> str:
    """Mean, root mean square, zero crossings about 128, and a 16-bin histogram of the samples."""
    x = np.frombuffer(payload, np.uint8)
    if not len(x):
        return "mean=0;rms=0;crossings=0;hist="
    hist = np.bincount(x >> 4, minlength=16)
    up = x >= 128
    c = x.astype(np.float64) - 128
    return f"mean={x.mean():.6f};rms={np.sqrt((c * c).mean()):.6f};crossings={int((up[1:] != up[:-1]).sum())};hist={','.join(map(str, hist.tolist()))}"


def _low(digest: bytes) -> int:
    return struct.unpack("<q", digest[:8])[0]


_MEDIA = "doc long, n_bytes long, payload_sha256 string, listed binary, held array<binary>"


def store(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Written (media rows, shared chunks): media (row, doc, n_bytes, payload_sha256, listed, held), chunks (digest, data)."""
    tune(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text"))

    def digests(batches):
        for b in batches:
            yield pd.DataFrame({"h": [_low(d) for x in b["text"] for d, _ in chunks(text_payload(x))]}, dtype="int64")

    bits = repeated_bits(rows.select("text").mapInPandas(digests, "h long"), "h")

    def shared_of(cut, words):
        return may_repeat(words, np.array([_low(d) for d, _ in cut], np.int64).view(np.uint64))

    def media(batches):
        words = np.frombuffer(bits, "<u4")
        for b in batches:
            out = []
            for doc, x in zip(b["doc"], b["text"], strict=True):
                payload = text_payload(x)
                cut = chunks(payload)
                held = [None if s else c for (_, c), s in zip(cut, shared_of(cut, words), strict=True)]
                out.append((doc, len((x or "").encode("utf-8", "surrogatepass")), hashlib.sha256(payload).hexdigest(), chunk_list([(d, len(c)) for d, c in cut]), held))
            yield pd.DataFrame(out, columns=["doc", "n_bytes", "payload_sha256", "listed", "held"]).astype({"doc": "Int64"})

    def shared(batches):
        words = np.frombuffer(bits, "<u4")
        for b in batches:
            held = {}
            for x in b["text"]:
                cut = chunks(text_payload(x))
                held |= {d: c for (d, c), s in zip(cut, shared_of(cut, words), strict=True) if s}
            yield pd.DataFrame({"digest": list(held), "data": list(held.values())}, columns=["digest", "data"])

    written = materialise(rows.mapInPandas(media, _MEDIA).withColumn("row", F.monotonically_increasing_id()), "media")
    pool = materialise(rows.select("text").mapInPandas(shared, "digest binary, data binary").groupBy("digest").agg(F.first("data").alias("data")), "chunks")
    return written, pool


_OUT = "doc long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def load(written: DataFrame, pool: DataFrame, key: str = "doc_id", with_payload: bool = False) -> DataFrame:
    """Read media back: payloads put together from chunks, verified, with their features."""

    columns = ["doc", "n_bytes", "payload_sha256", "listed", "held"]

    def put_together(batches):
        for b in batches:
            out = []
            for doc, n_bytes, sha, listed, held in zip(*(b[c] for c in columns), strict=True):
                listed, pieces = bytes(listed), []
                for (digest, _), data in zip(parse_list(listed), held, strict=True):
                    data = bytes(data) if data is not None else None
                    if data is None or xxhash.xxh3_128_digest(data) != digest:
                        raise ValueError(f"a chunk of media {doc} is missing or differs from its digest")
                    pieces.append(data)
                payload = b"".join(pieces)
                if hashlib.sha256(payload).hexdigest() != sha:
                    raise ValueError(f"media {doc} differs from its digest")
                form = hashlib.sha256(listed)
                form.update(payload)
                out.append((doc, n_bytes, len(payload), sha, zlib.crc32(payload[-32:]), len(listed) + len(payload), form.hexdigest(), features(payload), *((payload,) if with_payload else ())))
            names = [x.split()[0] for x in _OUT.split(", ")] + ["payload"] * with_payload
            yield pd.DataFrame(out, columns=names).astype({"doc": "Int64"})

    schema = _OUT + ", payload binary" * with_payload
    refers = F.exists("held", lambda x: x.isNull())
    whole = written.where(~refers).select(*columns).mapInPandas(put_together, schema)

    # rows that refer to the store say which chunks they lack; only those are joined
    def lacks(batches):
        for b in batches:
            rows = [(row, pos, digest) for row, listed, gone in zip(b["row"], b["listed"], b["gone"], strict=True) for pos, (digest, _) in enumerate(parse_list(bytes(listed))) if gone[pos]]
            yield pd.DataFrame(rows, columns=["row", "pos", "digest"])

    lost = written.where(refers).select("row", "listed", F.transform("held", lambda x: x.isNull()).alias("gone")).mapInPandas(lacks, "row long, pos int, digest binary")
    got = lost.join(pool, "digest", "left").groupBy("row").agg(F.collect_list(F.struct("pos", "data")).alias("got"))
    filled = (
        written.where(refers).join(got, "row")
        .withColumn("found", F.map_from_entries("got"))
        .withColumn("held", F.transform("held", lambda x, i: F.coalesce(x, F.element_at("found", i))))
        .select(*columns).mapInPandas(put_together, schema)
    )
    return whole.union(filled).withColumnRenamed("doc", key)


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    written, pool = store(table(spark, sf_dir, "documents"))
    return load(written, pool)

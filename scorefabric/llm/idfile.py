"""Token-id files: an adaptive context-mixing range coder over blocks that are reset and checked one by one.

A file holds the ids of many documents one after another. Its ids are cut into blocks of BLOCK ids; each block is
coded alone, with its own model state, and carries the crc32 of its ids, so damage stays within a block and any block
can be read by itself. In a block, the last two ids and the last id each predict the next one (the id that followed
that context before, with a confidence), and order 0 predicts the block's most frequent id so far. Two adaptive
estimates of a hit, one by confidence and one by agreement, are mixed, and a third tells how often order 0 is right
where the others are not. The range coder gets the mixed probabilities of "as order 2 says", "as order 1 says", "as
order 0 says" and "none of them", and after the last the id itself by its frequency in the file, which the header holds
and from which every block starts.

The blocks of a file are coded in step, one id of every block at a time, as numpy vectors: the code of a block is what
it would be alone.

Layout, little-endian: magic, version, number of documents, ids and blocks, then sections with 32-bit lengths: zlib of
doc_ids (delta, int64) with a null mask, zlib of ids per document, zlib of (id, frequency) of order 0, zlib of
(crc32, code words) per block, and the blocks' code words (16 bits each).

Defined results: a null text is empty and gives the end id alone; repeated rows each give theirs, in the order of
their texts; null doc_ids come first; an empty table gives no file; other columns than the key and the text are not read.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scorefabric.llm.common import BROADCAST_ROWS, materialise, parts_for, table, tune
from scorefabric.llm.packing import vocabulary
from scorefabric.llm.tokens import CHUNK_BYTES, encoder, with_end

MAGIC = b"SFID"
BLOCK = 1024
#: Ids after which a file is closed, and bytes of text that one task gets: 32 MB are some 12,000 blocks in step.
FILE_IDS, TASK_BYTES = 16 << 20, 32 << 20
_HASH = 8  # log2 of a block's slots for orders 1 and 2
_COUNTS = 6  # log2 of its counters for order 0
_TOTAL0 = 20  # log2 of the order-0 total
_U = np.uint64
_TOP, _BOT = _U(1) << _U(48), _U(1) << _U(44)  # 2^36 is the total of one step


class _Model:
    """The adaptive state of all blocks, one column of numbers each. A slot holds 4 * id + confidence (0 to 3)."""

    def __init__(self, lanes: int):
        self.base = np.arange(lanes, dtype=np.int64) << _HASH
        self.slots2, self.slots1 = (np.zeros(lanes << _HASH, np.int32) for _ in range(2))
        row = np.arange(lanes, dtype=np.int64)
        self.by_sure, self.by_both, self.by_one = row * 4, row * 8, row * 8
        self.p_sure = np.tile(np.array([2000, 16000, 32000, 48000], np.int32), lanes)
        self.p_both = np.full(lanes * 8, 16000, np.int32)
        self.p_one = np.tile(np.array([2000, 12000, 24000, 32000, 2000, 8000, 16000, 24000], np.int32), lanes)
        self.p_zero = np.full(lanes, 3000, np.int32)
        self.counts, self.base0 = np.zeros(lanes << _COUNTS, np.int16), row << _COUNTS
        self.x0, self.most = np.zeros(lanes, np.int32), np.zeros(lanes, np.int16)
        self.c1 = np.zeros(lanes, np.int64)
        self.k1 = np.zeros(lanes, np.int64)

    def predict(self):
        """Sets the predicted ids and the ends of the ranges, of 2^16, of orders 2, 1 and 0."""
        mask = (1 << _HASH) - 1
        k = self.c1 * 40503
        self.i1 = (k >> 3 & mask) + self.base
        self.i2 = ((k ^ self.k1) >> 2 & mask) + self.base
        self.k1 = k * 3
        self.e2, self.e1 = self.slots2.take(self.i2), self.slots1.take(self.i1)
        self.x2, self.x1 = self.e2 >> 2, self.e1 >> 2
        s2, s1 = self.e2 & 3, self.e1 & 3
        other = self.x2 != self.x1
        self.ja = self.by_sure + s2
        self.jb = self.by_both + np.where(other, s1, s1 + 4)
        self.jc = self.by_one + np.where(s2 > 0, s1 + 4, s1)
        self.pa, self.pb, self.pc = self.p_sure.take(self.ja), self.p_both.take(self.jb), self.p_one.take(self.jc)
        # each estimate lies in 0..65535, so the mixture leaves room for all four outcomes
        self.f2 = ((self.pa + self.pb) * 15 >> 5) + 64
        self.f12 = ((63000 - self.f2) * (self.pc * other >> 4) >> 12) + self.f2 + 64
        self.f012 = ((65000 - self.f12) * (self.p_zero >> 4) >> 12) + self.f12 + 64

    def learn(self, x, hit2, miss2, miss1):
        """x: the ids as they are (int32); miss1: neither order 2 nor order 1 is right."""
        full = np.int32(65535)
        to = hit2 * full
        self.p_sure[self.ja] = self.pa + (to - self.pa >> 5)
        self.p_both[self.jb] = self.pb + (to - self.pb >> 5)
        right = self.x1 == x
        self.p_one[self.jc] = self.pc + (right * full - self.pc >> 5) * miss2
        fresh = x * 4 + 1
        for slots, i, e, hit in ((self.slots1, self.i1, self.e1, right), (self.slots2, self.i2, self.e2, hit2)):
            s = e & 3
            slots[i] = np.where(hit, e + (s < 3), np.where(s < 2, fresh, e - 1))
        self.c1 = x.astype(np.int64)
        self.p_zero += ((self.x0 == x) * full - self.p_zero >> 6) * miss1
        i = self.base0 + (x & ((1 << _COUNTS) - 1))
        n = self.counts.take(i) + np.int16(1)
        self.counts[i] = n
        top = n >= self.most
        self.x0, self.most = np.where(top, x, self.x0), np.maximum(n, self.most)


def _settle(low, rng):
    """Lanes whose top 16 bits go out; a range that is too small is cut at the next boundary first."""
    same = (low ^ (low + rng)) < _TOP
    small = rng < _BOT
    small &= ~same
    if small.any():
        rng[small] = (~low[small] + _U(1)) & (_BOT - _U(1))
        same |= small
    return np.flatnonzero(same)


def _shift(low, rng, move):
    """Move settled words out (or in) until every lane has range enough; after the first look only lanes that moved are looked at."""
    k = _settle(low, rng)
    while len(k):
        move(k)
        l, r = low[k] << _U(16), rng[k] << _U(16)
        again = _settle(l, r)
        low[k], rng[k] = l, r
        k = k[again]


def _span(m, miss2, miss1, miss):
    """(start, end), of 2^16, of the outcome that the misses say."""
    start = np.where(miss, m.f012, np.where(miss1, m.f12, m.f2 * miss2))
    end = np.where(miss, np.int32(1 << 16), np.where(miss1, m.f012, np.where(miss2, m.f12, m.f2)))
    return start, end - start


def _grid(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids as (step, block), and the ids of each block; the last of several is filled up with an id that is known."""
    lanes = max(1, -(-len(ids) // BLOCK))
    full = np.full(lanes * BLOCK, ids[0] if len(ids) else 0, np.uint16)
    full[: len(ids)] = ids
    sizes = np.full(lanes, BLOCK)
    sizes[-1] = len(ids) - (lanes - 1) * BLOCK
    return np.ascontiguousarray(full.reshape(lanes, BLOCK).T[: sizes.max()]).astype(np.int32), sizes


def _order0(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, n = np.unique(ids, return_counts=True)
    room = (1 << _TOTAL0) - len(found)
    return found.astype(np.uint16), (1 + n.astype(np.int64) * room // max(1, int(n.sum()))).astype(np.uint32)


def compress(ids: np.ndarray) -> tuple[bytes, bytes, list[bytes]]:
    """(order-0 section, block table section, code words of each block) of ids below 2^16."""
    if len(ids) and int(ids.max()) >> 16:
        raise ValueError("ids must be below 65536")
    known, freq = _order0(ids)
    grid, sizes = _grid(ids)
    steps, lanes = grid.shape
    f0, start0 = np.zeros(1 << 16, np.uint64), np.zeros(1 << 16, np.uint64)
    f0[known] = freq
    start0[known] = np.cumsum(freq) - freq
    low, rng, one = np.zeros(lanes, np.uint64), np.full(lanes, ~_U(0)), _U(1 << _TOTAL0)
    out, at = np.zeros((lanes, steps * 2 + 16), np.uint16), np.zeros(lanes, np.int64)
    m = _Model(lanes)

    def move(k):
        out[k, at[k]] = low[k] >> _U(48)
        at[k] += 1

    for t in range(steps):
        x = grid[t]
        m.predict()
        miss2 = m.x2 != x
        miss1 = miss2 & (m.x1 != x)
        miss = miss1 & (m.x0 != x)
        start, width = (v.astype(np.uint64) for v in _span(m, miss2, miss1, miss))
        # the outcome's range, and within the last one the id's: one step of 2^(16 + _TOTAL0)
        rng >>= _U(16 + _TOTAL0)
        low += rng * ((start << _U(_TOTAL0)) + start0[x] * (width * miss))
        rng *= width * np.where(miss, f0[x], one)
        _shift(low, rng, move)
        m.learn(x, ~miss2, miss2, miss1)
    for _ in range(4):
        out[np.arange(lanes), at] = low >> _U(48)
        at += 1
        low <<= _U(16)
    blocks = [out[i, : at[i]].tobytes() for i in range(lanes)]
    raw = ids.astype("<u4")
    crcs = np.array([zlib.crc32(raw[i * BLOCK : i * BLOCK + BLOCK]) for i in range(lanes)], "<u4")
    zero = zlib.compress(known.astype("<u2").tobytes() + freq.astype("<u4").tobytes(), 6)
    return zero, zlib.compress(crcs.tobytes() + at.astype("<u4").tobytes(), 6), blocks


def expand(n_ids: int, zero: bytes, table_: bytes, words: np.ndarray) -> np.ndarray:
    """The ids again; a block whose checksum differs is an error."""
    z = zlib.decompress(zero)
    d = len(z) // 6
    known, freq = np.frombuffer(z, "<u2", d), np.frombuffer(z, "<u4", d, 2 * d).astype(np.uint64)
    raw = zlib.decompress(table_)
    lanes = len(raw) // 8
    crcs, sizes_w = np.frombuffer(raw, "<u4", lanes), np.frombuffer(raw, "<u4", lanes, 4 * lanes).astype(np.int64)
    sizes = np.full(lanes, BLOCK)
    sizes[-1] = n_ids - (lanes - 1) * BLOCK
    steps = int(sizes.max())
    start_of = np.cumsum(freq) - freq
    slot = np.zeros(1 << _TOTAL0, np.uint16)
    used = np.repeat(np.arange(d, dtype=np.uint16), freq.astype(np.int64))
    slot[: len(used)] = used
    ends = np.cumsum(sizes_w)
    at = ends - sizes_w
    words = np.concatenate([words, np.zeros(8, np.uint16)]).astype(np.uint64)
    last = len(words) - 1
    code, low, rng = np.zeros(lanes, np.uint64), np.zeros(lanes, np.uint64), np.full(lanes, ~_U(0))
    for _ in range(4):
        code = (code << _U(16)) | words[np.minimum(at, last)]
        at += 1
    m, grid = _Model(lanes), np.zeros((steps, lanes), np.uint16)
    one = _U(1 << _TOTAL0)

    def move(k):
        code[k] = (code[k] << _U(16)) | words[np.minimum(at[k], last)]
        at[k] += 1

    known = known.astype(np.int32)
    for t in range(steps):
        m.predict()
        rng >>= _U(16 + _TOTAL0)
        said = (code - low) // rng
        v = (said >> _U(_TOTAL0)).astype(np.int32)
        miss2, miss1, miss = v >= m.f2, v >= m.f12, v >= m.f012
        start, width = (x.astype(np.uint64) for x in _span(m, miss2, miss1, miss))
        start <<= _U(_TOTAL0)
        x = np.where(miss1, m.x0, np.where(miss2, m.x1, m.x2))
        size, i = np.full(lanes, one), np.flatnonzero(miss)
        k = slot[np.minimum((said[i] - start[i]) // width[i], one - _U(1)).astype(np.int64)]
        start[i] += start_of[k] * width[i]
        size[i], x[i] = freq[k], known[k]
        low += rng * start
        rng *= width * size
        _shift(low, rng, move)
        grid[t] = x
        m.learn(x, ~miss2, miss2, miss1)
    ids = np.ascontiguousarray(grid.T).reshape(-1)
    if steps == BLOCK:
        ids = ids[:n_ids]
    else:
        ids = ids[: int(sizes[-1])]
    raw = ids.astype("<u4")
    for i in range(lanes):
        if zlib.crc32(raw[i * BLOCK : i * BLOCK + BLOCK]) != crcs[i]:
            raise ValueError(f"block {i} differs from its checksum")
    return ids.astype(np.uint32)


def write_file(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray) -> bytes:
    null = np.array([x is None for x in doc_ids], np.uint8)
    keys = np.array([x or 0 for x in doc_ids], np.int64)
    zero, blocks_table, blocks = compress(ids)
    sections = [zlib.compress(np.diff(keys, prepend=0).astype("<i8").tobytes() + null.tobytes(), 6), zlib.compress(counts.astype("<u4").tobytes(), 6), zero, blocks_table, b"".join(blocks)]
    head = MAGIC + struct.pack("<HIQI", 1, len(doc_ids), len(ids), len(blocks))
    return head + b"".join(struct.pack("<I", len(s)) + s for s in sections)


def read_file(content: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(doc_ids, ids of each document, all ids)."""
    if content[:4] != MAGIC:
        raise ValueError("not a token-id file")
    _, n, n_ids, _ = struct.unpack_from("<HIQI", content, 4)
    at, sections = 4 + struct.calcsize("<HIQI"), []
    for _ in range(5):
        (size,) = struct.unpack_from("<I", content, at)
        sections.append(content[at + 4 : at + 4 + size])
        at += 4 + size
    raw = zlib.decompress(sections[0])
    keys, null = np.cumsum(np.frombuffer(raw, "<i8", n)), np.frombuffer(raw, np.uint8, n, 8 * n)
    counts = np.frombuffer(zlib.decompress(sections[1]), "<u4", n).astype(np.int64)
    ids = expand(n_ids, sections[2], sections[3], np.frombuffer(sections[4], "<u2"))
    return [None if z else int(k) for k, z in zip(keys, null, strict=True)], counts, ids


def _gathered(batches, text: str):
    """The batches, put together until their texts fill what the encoder takes at once."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += int(b[text].str.len().sum())
        if size >= CHUNK_BYTES:
            yield pd.concat(held)
            held, size = [], 0
    if held:
        yield pd.concat(held)


def files(docs: DataFrame, tokenizer: str, end_id: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(part, number, n_ids, content): files in ascending key order by (part, number)."""
    tune(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias(key), text)

    def write(batches):
        enc, part, number = encoder(tokenizer), TaskContext.get().partitionId(), 0
        keys: list = []
        held: list = []
        sizes: list = []

        def close():
            ids = np.concatenate(held)
            return pd.DataFrame({"part": [part], "number": [number], "n_ids": [len(ids)], "content": [write_file(keys, np.concatenate(sizes), ids)]})

        for b in _gathered(batches, text):
            ids, off = with_end(*enc.encode(b[text].tolist()), end_id)
            keys += [None if pd.isna(x) else int(x) for x in b[key]]
            held.append(ids)
            sizes.append(np.diff(off))
            if sum(map(len, held)) >= FILE_IDS:
                yield close()
                keys, held, sizes, number = [], [], [], number + 1
        if keys:
            yield close()

    order = [F.col(key).asc_nulls_first(), F.col(text).asc_nulls_first()]
    parts = parts_for(rows, text, TASK_BYTES, least=docs.sparkSession.sparkContext.defaultParallelism)
    return rows.repartitionByRange(parts, F.col(key).asc_nulls_first()).sortWithinPartitions(*order).mapInPandas(write, "part int, number int, n_ids long, content binary")


def documents(written: DataFrame, key: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """Per document of written files: key, start, n_tokens, ids_crc32[, ids], from the files' bytes alone."""
    at = written.select("part", "number", (F.sum("n_ids").over(Window.orderBy("part", "number")) - F.col("n_ids")).alias("base"))  # a row a file
    few = written.select("part").limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    # files are read where they lie; only their places are sent around
    placed = written.join(F.broadcast(at) if few else at, ["part", "number"])

    def read(batches):
        for b in batches:
            for base, content in zip(b["base"], b["content"], strict=True):
                keys, counts, ids = read_file(bytes(content))
                raw = memoryview(ids.astype("<u4")).cast("B")
                ends = np.cumsum(counts)
                spans = list(zip((4 * (ends - counts)).tolist(), (4 * ends).tolist(), strict=True))
                out = pd.DataFrame({key: pd.array(keys, "Int64"), "start": base + ends - counts, "n_tokens": counts, "ids_crc32": [zlib.crc32(raw[i:j]) for i, j in spans]})
                if with_ids:
                    out["ids"] = [bytes(raw[i:j]) for i, j in spans]
                yield out

    return placed.select("base", "content").mapInPandas(read, f"{key} long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)


def op5_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = materialise(files(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json")), "ids", codec="uncompressed")
    return documents(written)

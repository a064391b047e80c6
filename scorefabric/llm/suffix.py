"""Suffix-array deduplication of byte strings that occur more than once.

Every byte covered by a string of `length` bytes that also starts anywhere else is removed; strings are judged on the
input and never cross documents.

1. Each window of `length` bytes is named by the least hash of its strings of two fifths of that length. Equal windows have equal names,
   whatever surrounds them, so neighbours with one name form a run, and a name that occurs once in the corpus rules its
   windows out. Names are counted with partial sums; a bit map of fixed size holds those that repeat.
2. The bytes of runs whose name may repeat are cut out. Equal cuts are one content with a count.
3. Contents are dealt by name and concatenated to shards of bounded size. Each shard's suffix array is built by
   induced sorting: suffixes are classified, leftmost-smaller substrings sorted (recursively where their names repeat),
   and the array induced from them in linear time. Common prefixes are computed in text order (permuted), directly
   where the preceding bytes differ and by the decrease by one elsewhere. Windows that share `length` bytes with a
   neighbour in the array, and all windows of a content that occurs twice, are repeated.
4. Repeated windows go back to the texts that have them; texts without any are never moved.

A name whose contents exceed a shard is split by naming its windows anew with another hash, so no task collects it.

Defined results: a null text is empty and loses nothing; repeated rows are copies, so texts of `length` bytes or more
lose all; a null doc_id keeps its row; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorefabric.llm.common import materialise, may_repeat, repeated_bits, table, tune

LENGTH = 400
#: Bytes of a shard, and bytes of one name's contents beyond which it is split; rounds of splits.
SHARD_BYTES, SPLIT_BYTES, SPLITS = 2 << 20, 4 << 20, 3

# ---- suffix arrays by induced sorting ----


def _types(s: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one (S), False where larger (L). The last symbol is the least."""
    up = np.zeros(len(s), np.int8)
    up[:-1] = np.sign(s[1:].astype(np.int64) - s[:-1])
    up[-1] = 1
    at = np.where(up != 0, np.arange(len(s)), len(s))
    return up[np.minimum.accumulate(at[::-1])[::-1]] > 0


def _induce_waves(s: np.ndarray, small: np.ndarray, lms: np.ndarray, sigma: int) -> np.ndarray:
    """The suffix order that a given order of leftmost-smaller suffixes induces, bucket by bucket: what a bucket adds to itself is a further wave."""
    n = len(s)
    ends = np.cumsum(np.bincount(s, minlength=sigma))
    starts = ends - np.bincount(s, minlength=sigma)
    sa = np.full(n, -1, np.int64)
    tails = ends - np.bincount(s[lms], minlength=sigma)
    by = np.argsort(s[lms], kind="stable")
    first = np.cumsum(np.bincount(s[lms], minlength=sigma)) - np.bincount(s[lms], minlength=sigma)
    c = s[lms][by]
    sa[tails[c] + np.arange(len(by)) - first[c]] = lms[by]
    heads = starts.copy()

    def left(found):
        j = found - 1
        j = j[j >= 0]
        j = j[~small[j]]
        if len(j):
            c = s[j]
            order = np.argsort(c, kind="stable")
            j, c = j[order], c[order]
            n_c = np.bincount(c, minlength=sigma)
            sa[heads[c] + np.arange(len(j)) - (np.cumsum(n_c) - n_c)[c]] = j
            heads[:] += n_c

    for b in np.flatnonzero(ends > starts):
        at = starts[b]
        while at < heads[b]:
            to = heads[b]
            left(sa[at:to])
            at = to
        if tails[b] < ends[b]:
            left(sa[tails[b] : ends[b]])
    lasts = ends.copy()

    def right(found):  # found descends
        j = found - 1
        j = j[j >= 0]
        j = j[small[j]]
        if len(j):
            c = s[j]
            order = np.argsort(c, kind="stable")
            j, c = j[order], c[order]
            n_c = np.bincount(c, minlength=sigma)
            sa[lasts[c] - 1 - (np.arange(len(j)) - (np.cumsum(n_c) - n_c)[c])] = j
            lasts[:] -= n_c

    for b in np.flatnonzero(ends > starts)[::-1]:
        at = ends[b]
        while at > lasts[b]:
            to = lasts[b]
            right(sa[to:at][::-1])
            at = to
        if heads[b] > starts[b]:
            right(sa[starts[b] : heads[b]][::-1])
    sa[0] = n - 1
    return sa


def _induce_steps(s: np.ndarray, small: np.ndarray, lms: np.ndarray, sigma: int) -> np.ndarray:
    """The same one by one, for alphabets of many symbols."""
    counts = np.bincount(s, minlength=sigma)
    ends = np.cumsum(counts)
    heads, tails = (ends - counts).tolist(), ends.tolist()
    text, is_small, sa = s.tolist(), small.tolist(), [-1] * len(s)
    for i in lms[::-1].tolist():
        c = text[i]
        tails[c] -= 1
        sa[tails[c]] = i
    for k in range(len(sa)):
        j = sa[k] - 1
        if j >= 0 and not is_small[j]:
            c = text[j]
            sa[heads[c]] = j
            heads[c] += 1
    tails = ends.tolist()
    for k in range(len(sa) - 1, -1, -1):
        j = sa[k] - 1
        if j >= 0 and is_small[j]:
            c = text[j]
            tails[c] -= 1
            sa[tails[c]] = j
    sa[0] = len(sa) - 1
    return np.array(sa, np.int64)


def suffix_array(s: np.ndarray, sigma: int) -> np.ndarray:
    """Of symbols 0..sigma-1 whose last is 0 and occurs only there."""
    n = len(s)
    if n < 3:
        return np.argsort(s, kind="stable").astype(np.int64)[:n] if n < 2 or s[0] != s[-1] else np.arange(n)[::-1].copy()
    small = _types(s)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    induce = _induce_waves if sigma <= 1024 else _induce_steps
    sa = induce(s, small, lms, sigma)
    # name the leftmost-smaller substrings in their order
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    order = sa[is_lms[sa]]
    index = np.zeros(n, np.int64)
    index[lms] = np.arange(len(lms))
    size = np.diff(lms, append=n) + 1
    a, b = order[:-1], order[1:]
    same = size[index[a]] == size[index[b]]
    live = np.flatnonzero(same)
    d = 0
    while len(live):
        in_a = size[index[a[live]]] > d
        live = live[in_a]
        at_a, at_b = np.minimum(a[live] + d, n - 1), np.minimum(b[live] + d, n - 1)
        equal = (s[at_a] == s[at_b]) & (small[at_a] == small[at_b])
        same[live[~equal]] = False
        live = live[equal]
        d += 1
    if len(same):
        same[(a == n - 1) | (b == n - 1)] = False  # the end differs from all
    names = np.concatenate([[0], np.cumsum(~same)])
    if names[-1] + 1 < len(lms):
        reduced = np.zeros(len(lms), np.int64)
        reduced[index[order]] = names
        order = lms[suffix_array(reduced, int(names[-1]) + 1)]
    return induce(s, small, order, sigma)


def permuted_lcp(s: np.ndarray, sa: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """For each position the length of the common prefix with its predecessor in the array.

    Computed directly where the bytes before differ or at the positions `fresh`; elsewhere one less than at the
    position before. A common prefix is not followed beyond the next of `fresh`.
    """
    n = len(s)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    at = np.arange(n)
    direct = (phi < 1) | (at == 0)
    ok = ~direct
    direct[ok] = s[at[ok] - 1] != s[phi[ok] - 1]
    direct[fresh] = True
    limit = np.append(fresh, n)[np.searchsorted(fresh, at, side="right")]
    p = np.flatnonzero(direct & (phi >= 0))
    lcp = np.zeros(n, np.int64)
    step = 16
    padded = np.concatenate([s, np.full(step, -1, s.dtype)])
    tiles = np.lib.stride_tricks.sliding_window_view(padded, step)
    live, l = p, np.zeros(len(p), np.int64)
    while len(live):
        i, j = live + l, phi[live] + l
        inside = (i < n) & (j < n)
        i, j = np.minimum(i, n - 1), np.minimum(j, n - 1)
        equal = tiles[i] == tiles[j]
        k = np.where(equal.all(1), step, equal.argmin(1))
        k = np.where(inside, k, 0)
        l = l + k
        lcp[live] = l
        on = (k == step) & (live + l < limit[live])
        live, l = live[on], l[on]
    last = np.maximum.accumulate(np.where(direct, at, 0))
    return np.maximum(np.where(phi >= 0, lcp[last] - (at - last), 0), 0)


def repeated_starts(contents: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each content, whether the `length` bytes at each start also start elsewhere in the contents."""
    sizes = np.array([len(c) for c in contents], np.int64)
    begins = np.cumsum(sizes + 1) - sizes - 1
    # symbols: 0 the end, 1 a separator, byte + 2
    s = np.ones(int(sizes.sum()) + len(sizes) + 1, np.int16)
    s[-1] = 0
    flat = np.frombuffer(b"\0".join(contents), np.uint8)
    body = np.ones(len(s) - 1, bool)
    body[begins + sizes] = False
    s[:-1][body] = flat[body[: len(flat)]].astype(np.int16) + 2
    sa = suffix_array(s, 258)
    lcp = permuted_lcp(s, sa, begins)
    high = lcp >= length
    mark = high.copy()
    prev = np.full(len(s), -1, np.int64)
    prev[sa[1:]] = sa[:-1]
    mark[prev[np.flatnonzero(high)]] = True
    return [mark[b : b + max(0, n - length + 1)] for b, n in zip(begins.tolist(), sizes.tolist(), strict=True)]


# ---- names of windows ----

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def gram_of(length: int) -> int:
    """Bytes whose least hash names a window: the longer, the fewer windows share a name by chance, but the shorter the runs."""
    return max(1, length * 2 // 5)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << int(n).bit_length()
        for k, b in enumerate((_BASE, _INVERSE)):
            x = np.full(size, b, np.uint64)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    return _powers[0], _powers[1]


def runs(raw: bytes, length: int = LENGTH, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first start, last start, name, again) of the runs of windows with one name; again: the run has its least hash twice, so it may repeat itself."""
    n = len(raw) - length + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool)
    up, down = _power_tables(len(raw) + 1)
    t = np.frombuffer(raw, np.uint8).astype(np.uint64) + np.uint64(1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(t * up[: len(raw)], out=total[1:])
    gram = gram_of(length)
    h = (total[gram:] - total[:-gram]) * down[: len(raw) - gram + 1]
    h = (h ^ (h >> np.uint64(29)) ^ np.uint64((seed * 0xD6E8FEB86659FD93) & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    # sliding minimum over w hashes: the least of a block's tail and of the next block's head
    w = length - gram + 1
    m = -(-len(h) // w) * w
    block = np.full(m, ~np.uint64(0))
    block[: len(h)] = h
    block = block.reshape(-1, w)
    head = np.minimum.accumulate(block, axis=1).reshape(-1)
    tail = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    name = np.minimum(tail[:n], head[w - 1 : w - 1 + n])
    first = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]]))
    last, name = np.append(first[1:], n) - 1, name[first]
    again = np.array([np.count_nonzero(h[a : b + w] == x) > 1 for a, b, x in zip(first.tolist(), last.tolist(), name, strict=True)], bool)
    return first, last, name, again


def _cut(raw: bytes, length: int, seed: int, keep) -> list[tuple]:
    """(name, first start, content) of the runs that keep(names) lets through."""
    a, b, name, _ = runs(raw, length, seed)
    k = np.flatnonzero(keep(name))
    return [(int(x), int(i), raw[i : j + length]) for i, j, x in zip(a[k].tolist(), b[k].tolist(), name[k].view(np.int64).tolist(), strict=True)]


def _utf8(text) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


# ---- tables ----


def _bits_of(docs: DataFrame, text: str, length: int) -> bytes:
    def names(batches):
        for b in batches:
            out = []
            for x in b[text]:
                _, _, name, again = runs(_utf8(x), length)
                out += [name, name[again]]
            yield pd.DataFrame({"name": np.concatenate(out).view(np.int64) if out else []})

    return repeated_bits(docs.select(text).mapInPandas(names, "name long"), "name")


def _cuts(docs: DataFrame, bits: bytes, text: str, length: int) -> tuple[DataFrame, DataFrame]:
    """(cid, name, n, content) of the distinct cuts whose name may repeat, and (text_id, at, cid): where they are.

    Two scans, so that a content's bytes are written once and not at each of its places.
    """

    def cuts(batches, places: bool):
        repeats = np.frombuffer(bits, "<u4")
        for b in batches:
            rows = []
            for x in b[text]:
                raw = _utf8(x)
                found = _cut(raw, length, 0, lambda v: may_repeat(repeats, v)) if len(raw) >= length else []
                if found and places:
                    tid = xxhash.xxh3_128_digest(raw)
                    rows += [(tid, at, xxhash.xxh3_128_digest(content)) for _, at, content in found]
                else:
                    rows += [(xxhash.xxh3_128_digest(content), name, content) for name, _, content in found]
            yield pd.DataFrame(rows, columns=["text_id", "at", "cid"] if places else ["cid", "name", "content"])

    one = docs.select(text)
    held = one.mapInPandas(lambda it: cuts(it, False), "cid binary, name long, content binary")
    contents = held.groupBy("cid").agg(F.first("name").alias("name"), F.count(F.lit(1)).alias("n"), F.first("content").alias("content"))
    places = one.mapInPandas(lambda it: cuts(it, True), "text_id binary, at long, cid binary").distinct()
    return materialise(contents, "contents"), materialise(places, "places")


def _judge(batches, length: int, seed: int):
    """Rows (name, cid, n, content) in order of name: (cid, spans) of the starts that are repeated, as first and last pairs."""

    def spans(mark: np.ndarray) -> list[int]:
        edge = np.flatnonzero(np.diff(np.concatenate([[0], mark.astype(np.int8), [0]])))
        edge[1::2] -= 1
        return edge.tolist()

    def flush(group):
        ids, counts, contents = zip(*group, strict=True)
        marks = repeated_starts(list(contents), length)
        return [(i, [0, len(c) - length] if n > 1 else spans(m)) for i, n, c, m in zip(ids, counts, contents, marks, strict=True)]

    shard, size, own, last = [], 0, [], None

    def close(own):
        """A name's contents join the shard unless their counts say all."""
        if len(own) == 1 and (own[0][1] > 1 or not runs(own[0][2], length, seed)[3].any()):
            return [], [(own[0][0], [0, len(own[0][2]) - length])] if own[0][1] > 1 else []
        return own, []

    for b in batches:
        out = []
        for name, cid, n, content in zip(b["name"], b["cid"], b["n"], b["content"], strict=True):
            if name != last and own:
                more, done = close(own)
                shard += more
                out += done
                size += sum(len(x[2]) for x in more)
                own = []
                if size >= SHARD_BYTES:
                    out += flush(shard)
                    shard, size = [], 0
            last = name
            own.append((cid, n, bytes(content)))
        yield pd.DataFrame([x for x in out if x[1]], columns=["cid", "spans"])
    if own:
        more, out = close(own)
        shard += more
    else:
        out = []
    if shard:
        out += flush(shard)
    yield pd.DataFrame([x for x in out if x[1]], columns=["cid", "spans"])


def repeated_spans(docs: DataFrame, text: str = "text", length: int = LENGTH) -> DataFrame:
    """(text_id, spans): for each text with repeated bytes, their first and end positions in turn, merged and ascending.

    text_id is the 128-bit xxh3 digest of the text's bytes.
    """
    tune(docs.sparkSession)
    bits = _bits_of(docs, text, length)
    level, places = _cuts(docs, bits, text, length)
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    schema = "cid binary, spans array<long>"
    found = None
    for k in range(1, SPLITS + 1):
        heavy = level.groupBy("name").agg(F.sum(F.length("content")).alias("bytes"), F.count(F.lit(1)).alias("m")).where(f"bytes > {SPLIT_BYTES} and m > 1").select("name")
        heavy = materialise(heavy, "heavy") if k < SPLITS else None
        split = heavy is not None and not heavy.isEmpty()
        light = level.join(heavy, "name", "left_anti") if split else level
        judged = light.repartition(parts, "name").sortWithinPartitions("name").select("name", "cid", "n", "content").mapInPandas(lambda it, seed=k - 1: _judge(it, length, seed), schema)
        hits = places.join(judged, "cid").select("text_id", "at", "spans")
        found = hits if found is None else found.union(hits)
        if not split:
            break
        level, places = _named_anew(level.join(heavy, "name"), places, length, k)

    def merge(batches):
        for b in batches:
            rows = []
            for tid, held in zip(b["text_id"], b["held"], strict=True):
                pairs = sorted((x["at"] + s, x["at"] + e + length) for x in held for s, e in zip(x["spans"][::2], x["spans"][1::2], strict=True))
                out: list[int] = []
                for s, e in pairs:
                    if out and s <= out[-1]:
                        out[-1] = max(out[-1], e)
                    else:
                        out += [s, e]
                rows.append((tid, out))
            yield pd.DataFrame(rows, columns=["text_id", "spans"])

    # a text's own cuts, each once: copies give the same rows, which combine before the shuffle
    return found.groupBy("text_id").agg(F.collect_set(F.struct("at", "spans")).alias("held")).mapInPandas(merge, "text_id binary, spans array<long>")


def _named_anew(level: DataFrame, places: DataFrame, length: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Contents of a name that is too frequent for one shard, cut again by another hash; and the places of the new cuts."""

    def cut(batches):
        for b in batches:
            rows = []
            for name, cid, n, content in zip(b["name"], b["cid"], b["n"], b["content"], strict=True):
                for sub, at, c in _cut(bytes(content), length, seed, lambda v: np.ones(len(v), bool)):
                    rows.append((cid, at, int(np.array([sub ^ name * 31 & 0x7FFFFFFFFFFFFFFF]).astype(np.int64)[0]), xxhash.xxh3_128_digest(c), c, n))
            yield pd.DataFrame(rows, columns=["parent", "shift", "name", "cid", "content", "n"])

    new = materialise(level.select("name", "cid", "n", "content").mapInPandas(cut, "parent binary, shift long, name long, cid binary, content binary, n long"), "renamed")
    again = new.groupBy("cid").agg(F.first("name").alias("name"), F.sum("n").alias("n"), F.first("content").alias("content"))
    moved = places.withColumnRenamed("cid", "parent").join(new.select("parent", "shift", "cid"), "parent").select("text_id", (F.col("at") + F.col("shift")).alias("at"), "cid")
    return materialise(again, "contents"), materialise(moved.distinct(), "places")


def kept_texts(docs: DataFrame, text: str = "text", length: int = LENGTH, with_text: bool = True) -> DataFrame:
    """(sha256, n_removed, n_spans, kept_sha256[, kept_text]) of the texts that lose bytes, written to the shared folder.

    sha256 is the text's, as sha2(text, 256) gives it. kept_text leaves out the rest of a character that a cut divides.
    """
    found = materialise(repeated_spans(docs, text, length), "spans")
    low = found.select("text_id").mapInPandas(lambda it: (pd.DataFrame({"h": _low(b["text_id"])}) for b in it), "h long")
    bits = repeated_bits(low, "h", least=1)

    def named(batches):
        words = np.frombuffer(bits, "<u4")
        for b in batches:
            raws = [_utf8(x) for x in b[text]]
            out = pd.DataFrame({"text_id": [xxhash.xxh3_128_digest(x) for x in raws], "raw": raws})
            yield out[may_repeat(words, _low(out["text_id"]).view(np.uint64))]

    # only texts that may have spans are moved, each once
    texts = docs.select(text).where(F.octet_length(text) >= length).mapInPandas(named, "text_id binary, raw binary").groupBy("text_id").agg(F.first("raw").alias("raw"))

    def apply(batches):
        for b in batches:
            out = []
            for raw, spans in zip(b["raw"], b["spans"], strict=True):
                raw, at, kept = bytes(raw), 0, []
                for s, e in zip(spans[::2], spans[1::2], strict=True):
                    kept.append(raw[at:s])
                    at = e
                kept.append(raw[at:])
                left = b"".join(kept)
                out.append((hashlib.sha256(raw).hexdigest(), len(raw) - len(left), len(spans) // 2, hashlib.sha256(left).hexdigest(), *((b"".join(kept).decode("utf-8", "ignore"),) if with_text else ())))
            yield pd.DataFrame(out, columns=["sha256", "n_removed", "n_spans", "kept_sha256"] + ["kept_text"] * with_text)

    return materialise(texts.join(found, "text_id").mapInPandas(apply, "sha256 string, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string" * with_text), "kept")


def cut_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """Every row's (key, n_bytes, n_removed, n_spans, kept_sha256)."""
    cut = kept_texts(docs, text, length, with_text=False)
    raw = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key), F.octet_length(raw).cast("long").alias("n_bytes"), F.sha2(raw, 256).alias("sha256"))
    zero = F.lit(0).cast("long")
    return rows.join(cut, "sha256", "left").select(key, "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("kept_sha256", "sha256").alias("kept_sha256"))


def _low(ids) -> np.ndarray:
    """The low 64 bits of 128-bit digests, as signed numbers."""
    return np.frombuffer(b"".join(bytes(x) for x in ids), ">u8")[1::2].astype(np.uint64).view(np.int64)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_texts(table(spark, sf_dir, "documents"))

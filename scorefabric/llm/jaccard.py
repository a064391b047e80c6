"""N-gram Jaccard join by parity sketches.

A document's set holds its distinct word shingles. Each shingle flips one bit of a parity sketch, so two sketches
differ in no more bits than the sets differ in shingles. Linked sets of s and t shingles differ in at most
(s + t)(1 - J)/(1 + J) of them.

1. Sets are put into bands of sizes, in which the sketch has more parts than that bound; by the pigeonhole, linked sets
   agree in a whole part. A set goes into its own band and into the next, where it meets larger partners. Part by part
   the parity bits (2^32 a part) are kept as the XOR of a 64-bit code for each set bit: equal parts have equal codes. A
   part that no shingle falls into would bring unlike sets together, so a band has spare parts: linked sets agree in
   more parts than are spare, and a set gives keys of its empty parts only if it has more of them than that.
2. Keys travel as packed numbers, a row for each chunk of documents and range of keys; a key that many documents of a
   chunk have travels twice, which says that it repeats. Each task sorts its range and keeps the keys that two sets have.
   Equal sets are one class; buckets with the same members are one bucket.
3. A short sketch of the whole set goes with each member of a bucket. Members are first compared with one of them, in
   STARS rounds. In NEAREST rounds each member is compared within its largest bucket, and each component proposes the
   pair with the closest sketches. What then still has different components is compared within all its buckets, a block
   of members against another at a time, and a pair counts in one of the buckets that it shares,
   or few. Only pairs whose sketches are as close as the bound allows leave a task; their
   sets are fetched and compared exactly. So a large group of near copies sends on a pair or two for each member, and no
   link between different components is lost. Components are contracted by joins.

Defined results: a null or empty text, or one without words, has an empty set and is linked with nothing; a text with
fewer words than a shingle is one shingle; repeated rows are copies; a null doc_id takes part, and a component whose
doc_ids are all null has a null id; columns other than the key and the text are not read; an empty table gives no rows.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorefabric.llm.common import materialise, parts_for, release, semi_join, table, tune
from scorefabric.llm.components import components

#: Rounds in which a bucket's members meet one member, and in which each component proposes one pair; members of a bucket
#: that one task compares with as many others.
STARS, NEAREST, BLOCK = 1, 2, 2048
#: Of a member's buckets so many, the least, travel with it: a pair that shares one of them counts in that one alone.
LEAST_KEYS = 8
#: Keys and documents after which a task sends its packed keys; bytes of texts worked on at once.
CHUNK_KEYS, CHUNK_DOCS, SLICE_BYTES = 1 << 20, 60_000, 4 << 20
_WORDS_KEPT = 400_000
_M = np.uint64(0x9E3779B97F4A7C15)
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_words: dict[bytes, int] = {}


def _word_hashes(words: list[bytes]) -> np.ndarray:
    if len(_words) > _WORDS_KEPT:
        _words.clear()
    try:
        return np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    except KeyError:
        for w in words:
            if w not in _words:
                _words[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles of the text, A-Z in lower case, words between ASCII white space."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = _word_hashes(words)
    m = min(n, len(h))
    out = np.full(len(h) - m + 1, _U(m))
    for k in range(m):
        out = _mix(out * _M + h[k : len(h) - m + 1 + k])
    return np.unique(out)


def digest_of(shingles: np.ndarray) -> tuple[int, int]:
    """The set's 128-bit digest, as two signed numbers."""
    raw = xxhash.xxh3_128_digest(shingles.tobytes())
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)


class Bands:
    """Bands of set sizes for links of 100 * intersection >= percent * union."""

    def __init__(self, percent: int):
        self.percent = percent
        self.ends = [0]  # the largest size of each band
        self._parts: list[tuple[int, int]] = []

    def of(self, size: int) -> int:
        while self.ends[-1] < size:
            # partners of the last band's sets reach (largest size) / J
            self.ends.append(max(self.ends[-1] * 100 // self.percent, self.ends[-1] + 1))
        return int(np.searchsorted(self.ends, size))

    def most(self, s, t):
        """The most shingles in which linked sets of these sizes differ; numbers or arrays of them."""
        return (s + t) * (100 - self.percent) // (100 + self.percent)

    def parts(self, band: int) -> tuple[int, int]:
        """(parts of the band's sketches, spare): linked sets agree in more than `spare` parts, so where one of them has no more
        empty parts than that, they agree in a part that is not empty."""
        while len(self.ends) <= band:
            self.of(self.ends[-1] + 1)
        while len(self._parts) <= band:
            k = len(self._parts)
            need = self.most(self.ends[k], self.ends[k]) + 1
            least = self.ends[max(0, k - 2)] + 1  # the smallest set that meets this band
            spare = math.ceil(2 * need * math.exp(-least / need / 1.15)) + 1
            self._parts.append((need + spare, spare))
        return self._parts[band]

    def bits(self, size: int) -> int:
        """Bits of a whole set's sketch: a power of two, some six times the bound."""
        return max(256, 1 << (6 * self.most(size, size)).bit_length())


@lru_cache(8)
def bands(percent: int) -> Bands:
    return Bands(percent)


def keys_of(sets: list[np.ndarray], percent: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(keys, set) of many sets, each in its band and in the next; sets that are linked share a key. Empty sets have none."""
    by = bands(percent)
    live = np.array([i for i, s in enumerate(sets) if len(s)], np.int64)
    if not len(live):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    sizes = np.array([len(sets[i]) for i in live])
    by.of(int(sizes.max()))
    band = np.searchsorted(by.ends, sizes)
    table_ = np.array([by.parts(k) for k in range(int(band.max()) + 2)], np.int64)
    h = _mix(np.concatenate([sets[i] for i in live]) ^ _U((seed * 0xD6E8FEB86659FD93 + 1) & 0xFFFFFFFFFFFFFFFF))
    top, code_of = h >> _U(32), _mix(((h & _U(0xFFFFFFFF)) + _U(1)) * _M)
    out, owner = [], []
    for up in (0, 1):
        parts, spare = table_[band + up].T
        base = np.cumsum(parts) - parts
        part = ((top * np.repeat(parts, sizes).astype(np.uint64)) >> _U(32)).astype(np.int64) + np.repeat(base, sizes)
        order = np.argsort(part)
        at = part[order]
        first = np.flatnonzero(np.diff(at, prepend=-1))
        total = int(parts.sum())
        code, full = np.zeros(total, np.uint64), np.zeros(total, bool)
        code[at[first]] = np.bitwise_xor.reduceat(code_of[order], first)
        full[at[first]] = True
        doc = np.repeat(np.arange(len(live)), parts)
        start = _mix((band + up).astype(np.uint64) * _U(0x10001) + _U(7))
        within = (np.arange(total) - base[doc]).astype(np.uint64)
        said = _mix(code ^ _mix(within * _M + start[doc]))
        empty = parts - np.add.reduceat(full.astype(np.int64), base)
        sent = full | (empty > spare)[doc]
        out.append(said[sent])
        owner.append(live[doc[sent]])
    return np.concatenate(out), np.concatenate(owner)


def sketches(sets: list[np.ndarray], percent: int) -> list[bytes]:
    """The parity sketch of each whole set; sketches of twice the bits fold to one another by XOR of their halves."""
    by = bands(percent)
    bits = np.array([by.bits(len(s)) for s in sets], np.int64)
    base = np.cumsum(bits) - bits
    sizes = [len(s) for s in sets]
    h = _mix(np.concatenate([*sets, np.zeros(0, np.uint64)]) * _M + _U(11))
    at = (h & np.repeat(bits - 1, sizes).astype(np.uint64)).astype(np.int64) + np.repeat(base, sizes)
    flips = np.bincount(at, minlength=int(bits.sum())) & 1
    raw = np.packbits(flips.astype(np.uint8), bitorder="little").tobytes()
    return [raw[b // 8 : (b + n) // 8] for b, n in zip(base.tolist(), bits.tolist(), strict=True)]


def folded(sketch: bytes, to: int) -> np.ndarray:
    """A sketch as 64-bit words, folded to `to` bytes."""
    x = np.frombuffer(sketch, np.uint64)
    while len(x) * 8 > to:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def near(n_a, sketch_a, n_b, sketch_b, percent: int) -> np.ndarray:
    """For pairs given as columns: whether sizes and sketches allow a link."""
    n_a, n_b = np.asarray(n_a, np.int64), np.asarray(n_b, np.int64)
    ok = 100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)
    most = bands(percent).most(n_a, n_b)
    for i in np.flatnonzero(ok):
        p, q = sketch_a[i], sketch_b[i]
        to = min(len(p), len(q))
        ok[i] = np.bitwise_count(folded(p, to) ^ folded(q, to)).sum() <= most[i]
    return ok


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    s, t = sorted((len(a), len(b)))
    if 100 * s < percent * t:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _set(raw) -> np.ndarray:
    return np.frombuffer(raw, np.uint64)


# ---- one pass over the texts: sets, sketches and the keys that repeat ----

_DOC = np.dtype([("doc", "<i8"), ("null", "u1"), ("n", "<i4"), ("rep", "<i8")])
_SCANNED = "kind int, doc long, n long, rep long, d0 long, d1 long, th long, sketch binary, key long"
_ROW, _REP, _KEY = 0, 1, 2


def _blank(kind: int, size: int, **columns) -> pd.DataFrame:
    """Rows of _SCANNED; columns that are not given are null."""
    out = pd.DataFrame({"kind": np.full(size, kind, np.int32)})
    for name in ("doc", "n", "rep", "d0", "d1", "th", "sketch", "key"):
        none = None if name == "sketch" else pd.arrays.IntegerArray(np.zeros(size, np.int64), np.ones(size, bool))
        out[name] = columns.get(name, none)
    return out


class _Chunk:
    """The documents of a task since its last packed rows. Equal sets of a chunk share its first document's number."""

    def __init__(self, words: int, percent: int, parts: int, base: int):
        self.words, self.percent, self.parts, self.base = words, percent, parts, base
        self.docs: list[tuple] = []
        self.of: dict[tuple[int, int], int] = {}
        self.reps: list[tuple] = []
        self.keys: list[np.ndarray] = []
        self.owners: list[np.ndarray] = []
        self.n_keys = 0

    def add(self, doc_ids, texts, hashes) -> None:
        fresh, numbers = [], []
        for i, x, th in zip(doc_ids, texts, hashes, strict=True):
            s = shingle_set(x, self.words)
            null = pd.isna(i)
            if not len(s):
                self.docs.append((0 if null else i, null, 0, -1))
                continue
            d = digest_of(s)
            k = self.of.get(d)
            if k is None:
                k = self.of[d] = len(self.reps)
                self.reps.append((len(s), *d, int(th)))
                fresh.append(s)
                numbers.append(k)
            self.docs.append((0 if null else i, null, len(s), self.base + k))
        if fresh:
            for k, sk in zip(numbers, sketches(fresh, self.percent), strict=True):
                self.reps[k] = (*self.reps[k], sk)
            keys, owner = keys_of(fresh, self.percent)
            self.keys.append(keys)
            self.owners.append(np.array(numbers, np.int64)[owner])
            self.n_keys += len(keys)

    def full(self) -> bool:
        return self.n_keys >= CHUNK_KEYS or len(self.docs) >= CHUNK_DOCS

    def packed(self) -> list[tuple]:
        """(part, kind, base, payload): keys go to the part that their top bits name; documents and sets to any."""
        out: list[tuple] = []
        if self.docs:
            out.append((_ROW, np.array(self.docs, _DOC).tobytes(), None))
        if self.reps:
            heads = np.array([r[:4] for r in self.reps], np.int64)
            out.append((_REP, heads.tobytes(), [r[4] for r in self.reps]))
        spread = self.base % self.parts
        rows = [((spread + k) % self.parts, kind, self.base, [raw, *(more or [])]) for k, (kind, raw, more) in enumerate(out)]
        if self.keys:
            keys, owner = np.concatenate(self.keys), np.concatenate(self.owners)
            order = np.argsort(keys)
            keys, owner = keys[order], owner[order]
            rank = np.arange(len(keys)) - np.maximum.accumulate(np.where(np.diff(keys, prepend=keys[0] + _U(1)) != 0, np.arange(len(keys)), 0))
            # the third and further sets of a key need not travel: two have said that it repeats
            more = rank >= 2
            if more.any():
                rows.append(((spread + 2) % self.parts, 3, self.base, [keys[more].tobytes(), owner[more].astype("<u2").tobytes()]))
                keys, owner = keys[~more], owner[~more]
            part = ((keys >> _U(32)) * _U(self.parts) >> _U(32)).astype(np.int64)
            ends = np.searchsorted(part, np.arange(self.parts + 1))
            for p, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
                if b > a:
                    rows.append((p, _KEY, self.base, [keys[a:b].tobytes(), owner[a:b].astype("<u2").tobytes()]))
        return rows


def _scan(docs: DataFrame, words: int, percent: int, key: str, text: str) -> DataFrame:
    """_SCANNED rows: documents (doc, n, rep), sets (rep, n, digest, text hash, sketch), and (key, rep) of the keys that two sets have.

    rep numbers the first document of a chunk that has the set; sets of different chunks may be equal yet.
    """
    parts = parts_for(docs, text)

    def pack(batches):
        pid, start = TaskContext.get().partitionId(), 0
        chunk = _Chunk(words, percent, parts, pid << 33)
        for b in batches:
            ids, texts, hashes = b["doc"].tolist(), b["text"].tolist(), b["th"].tolist()
            at = 0
            while at < len(ids):
                stop, size = at, 0
                while stop < len(ids) and (stop == at or size < SLICE_BYTES):
                    size += len(texts[stop] or "")
                    stop += 1
                chunk.add(ids[at:stop], texts[at:stop], hashes[at:stop])
                at = stop
                if chunk.full():
                    yield pd.DataFrame(chunk.packed(), columns=["part", "kind", "base", "held"])
                    start += len(chunk.reps)
                    chunk = _Chunk(words, percent, parts, (pid << 33) + start)
        yield pd.DataFrame(chunk.packed(), columns=["part", "kind", "base", "held"])

    def unpack(batches):
        keys, owners = [], []
        for b in batches:
            for kind, base, held in zip(b["kind"], b["base"], b["held"], strict=True):
                if kind == _ROW:
                    d = np.frombuffer(held[0], _DOC)
                    doc = pd.array(d["doc"], "Int64")
                    doc[d["null"] > 0] = pd.NA
                    rep = pd.array(d["rep"], "Int64")
                    rep[d["rep"] < 0] = pd.NA
                    yield _blank(_ROW, len(d), doc=doc, n=d["n"].astype(np.int64), rep=rep)
                elif kind == _REP:
                    r = np.frombuffer(held[0], np.int64).reshape(-1, 4)
                    yield _blank(_REP, len(r), n=r[:, 0], rep=base + np.arange(len(r)), d0=r[:, 1], d1=r[:, 2], th=r[:, 3], sketch=[bytes(x) for x in held[1:]])
                else:
                    k, o = np.frombuffer(held[0], np.uint64), np.frombuffer(held[1], "<u2").astype(np.int64) + base
                    if kind == _KEY:
                        keys.append(k)
                        owners.append(o)
                    else:
                        yield _blank(_KEY, len(k), rep=o, key=k.view(np.int64))
        if keys:
            k, o = np.concatenate(keys), np.concatenate(owners)
            order = np.argsort(k)
            k = k[order]
            same = k[1:] == k[:-1]
            twice = np.concatenate([same, [False]]) | np.concatenate([[False], same])
            for i in range(0, int(twice.sum()), 100_000):
                at = np.flatnonzero(twice)[i : i + 100_000]
                yield _blank(_KEY, len(at), rep=o[order[at]], key=k[at].view(np.int64))

    rows = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text"), F.xxhash64(text).alias("th"))
    packed = rows.mapInPandas(pack, "part int, kind int, base long, held array<binary>")
    return packed.repartitionById(parts, "part").mapInPandas(unpack, _SCANNED)


def _buckets(entries: DataFrame, moved: DataFrame) -> DataFrame:
    """(key, class) of the keys that two classes share; of buckets with equal members one."""
    named = entries.join(moved, "rep", "left").select("key", F.coalesce("class", "rep").alias("class")).distinct()
    rows = materialise(named, "entries")
    by = rows.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.bit_xor(F.xxhash64("class")).alias("x"), F.bit_xor(F.xxhash64("class", F.lit(1))).alias("y")).where("m > 1")
    out = materialise(rows.join(by.groupBy("m", "x", "y").agg(F.min("key").alias("key")).select("key"), "key"), "buckets")
    release(rows)
    return out


# ---- pairs ----


def _rooted(rows: DataFrame, roots: DataFrame | None) -> DataFrame:
    """rows (key, class, n, sketch) with the root of each class, in the buckets that still have two."""
    if roots is None:
        return rows.withColumn("root", F.col("class"))
    rows = rows.join(roots.select(F.col("node").alias("class"), "root"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    return rows.join(rows.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key"), "key")


def _star_pairs(rows: DataFrame, reps: DataFrame, percent: int, k: int) -> DataFrame:
    """(a, b) of each member and one member b of its bucket, where they may be linked."""
    one = rows.groupBy("key").agg(F.min(F.struct(F.xxhash64("root", F.lit(k)).alias("h"), "class", "root")).alias("one"))
    star = one.select("key", F.col("one.class").alias("b"), F.col("one.root").alias("rb"))
    pairs = rows.select("key", F.col("class").alias("a"), "root").join(star, "key").where("root <> rb").select("a", "b").distinct()

    def close(batches):
        for b in batches:
            yield b.loc[near(b["na"], b["sa"].tolist(), b["nb"], b["sb"].tolist(), percent), ["a", "b"]]

    first = pairs.join(reps.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa")), "a")
    return first.join(reps.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb")), "b").mapInPandas(close, "a long, b long")


def _close_in_group(key: int, group: list[tuple], percent: int, nearest: bool) -> list[tuple[int, int]]:
    """Pairs of different roots that may be linked, of members (class, root, n, sketch, side, keys): of one block, or of two sides.

    nearest: of each root only the pair with the closest sketches. Otherwise a pair that is known to share a bucket less than
    this one, which is key, is left to that.
    """
    two = len({g[4] for g in group}) > 1
    group.sort(key=lambda g: (g[4], g[2]))
    cls, root = np.array([g[0] for g in group]), np.array([g[1] for g in group])
    n, side = np.array([g[2] for g in group], np.int64), np.array([g[4] for g in group])
    to = min(len(g[3]) for g in group)
    s = np.stack([folded(g[3], to) for g in group])
    low = int(np.searchsorted(side, side[0], side="right")) if two else 0  # the second side starts here
    by = bands(percent)
    one, other, far = [], [], []
    for i in range(low if two else len(group)):
        j0 = low if two else i + 1
        # sizes ascend within a side, so partners are a run
        j1 = int(np.searchsorted(n[j0:], n[i] * 100 // percent, side="right")) + j0
        if two:
            j0 += int(np.searchsorted(n[j0:], -(-n[i] * percent // 100)))
        if j1 <= j0:
            continue
        ham = np.bitwise_count(s[j0:j1] ^ s[i]).sum(axis=1, dtype=np.int64)
        hit = np.flatnonzero((ham <= by.most(n[j0:j1], n[i])) & (root[j0:j1] != root[i])) + j0
        one.append(np.full(len(hit), i))
        other.append(hit)
        far.append(ham[hit - j0])
    if not one:
        return []
    one, other, far = np.concatenate(one), np.concatenate(other), np.concatenate(far)
    if nearest:
        order = np.argsort(far, kind="stable")
        one, other = one[order], other[order]
        ends = np.concatenate([root[one], root[other]])
        k = np.concatenate([np.arange(len(one))] * 2)
        order = np.lexsort((k, ends))
        first = np.unique(k[order][np.diff(ends[order], prepend=ends[order][:1] - 1) != 0])
        one, other = one[first], other[first]
    elif len(one):
        keys = [set(g[5]) for g in group]
        own = np.array([min(keys[i] & keys[j], default=key) >= key for i, j in zip(one.tolist(), other.tolist(), strict=True)])
        one, other = one[own], other[own]
    return list(zip(cls[one].tolist(), cls[other].tolist(), strict=True))


def _largest_buckets(rows: DataFrame) -> DataFrame:
    """The rows of each class in the largest of its buckets."""
    size = rows.join(rows.groupBy("key").agg(F.count(F.lit(1)).alias("m")), "key").groupBy("class").agg(F.max(F.struct("m", "key")).alias("one"))
    return rows.join(size.select("class", F.col("one.key").alias("key")), ["class", "key"])


def _bucket_pairs(rows: DataFrame, percent: int, nearest: bool = False) -> DataFrame:
    """(a, b) of members of a bucket that have different roots and may be linked, a block of members with a block at a time."""
    many = rows.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    dealt = rows.join(many, "key").withColumn("own", F.pmod(F.xxhash64("class", F.lit(5)), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "class", "root", "n", "sketch", "keys")
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)

    def each(batches):
        last, group = None, []
        for b in batches:
            out: list[tuple[int, int]] = []
            for key, p, q, own, c, r, n, s, held in zip(*(b[x].tolist() for x in ("key", "p", "q", "own", "class", "root", "n", "sketch", "keys")), strict=True):
                if (key, p, q) != last and group:
                    out += _close_in_group(last[0], group, percent, nearest)
                    group = []
                last = key, p, q
                group.append((c, r, n, s, own, held))
            yield pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)
        if group:
            yield pd.DataFrame(_close_in_group(last[0], group, percent, nearest), columns=["a", "b"], dtype=np.int64)

    return dealt.repartition(parts, "key", "p", "q").sortWithinPartitions("key", "p", "q").mapInPandas(each, "a long, b long")


def _sets(docs: DataFrame, wanted: DataFrame, words: int, text: str) -> DataFrame:
    """(class, shingles) of the wanted classes (class, d0, d1, th): only their texts leave the scan."""

    def each(batches):
        seen = set()
        for b in batches:
            rows = []
            for x in b["text"]:
                s = shingle_set(x, words)
                d = digest_of(s)
                if d not in seen:
                    seen.add(d)
                    rows.append((*d, s.tobytes()))
            yield pd.DataFrame(rows, columns=["d0", "d1", "shingles"])

    texts = semi_join(docs.select(F.col(text).alias("text"), F.xxhash64(text).alias("th")), wanted.select("th"), "th").select("text")
    held = texts.mapInPandas(each, "d0 long, d1 long, shingles binary")
    return held.join(wanted.select("class", "d0", "d1"), ["d0", "d1"]).groupBy("class").agg(F.first("shingles").alias("shingles"))


def _verified(pairs: DataFrame, docs: DataFrame, reps: DataFrame, words: int, percent: int, text: str) -> DataFrame:
    """The pairs (a, b) that are linked, written."""
    pairs = materialise(pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    ids = pairs.select(F.col("a").alias("rep")).union(pairs.select(F.col("b").alias("rep"))).distinct()
    wanted = materialise(reps.join(ids, "rep").select(F.col("rep").alias("class"), "d0", "d1", "th"), "wanted")
    sets = materialise(_sets(docs, wanted, words, text), "sets", codec="uncompressed")

    def each(batches):
        for b in batches:
            ok = [linked(_set(p), _set(q), percent) for p, q in zip(b["sa"], b["sb"], strict=True)]
            yield b.loc[ok, ["a", "b"]]

    one = pairs.join(sets.select(F.col("class").alias("a"), F.col("shingles").alias("sa")), "a")
    links = materialise(one.join(sets.select(F.col("class").alias("b"), F.col("shingles").alias("sb")), "b").mapInPandas(each, "a long, b long"), "links")
    release(pairs, wanted, sets)
    return links


def links_between(buckets: DataFrame, reps: DataFrame, docs: DataFrame, words: int, percent: int, text: str) -> DataFrame | None:
    """(node, root) of the classes that have a link; buckets are (key, class)."""
    keys = buckets.groupBy("class").agg(F.slice(F.array_sort(F.collect_list("key")), 1, LEAST_KEYS).alias("keys"))  # a class has no more than its sketch has parts
    rows = materialise(buckets.join(reps.select(F.col("rep").alias("class"), "n", "sketch"), "class").join(keys, "class"), "members")
    release(buckets)
    found: DataFrame | None = None
    roots: DataFrame | None = None
    rounds = ["star"] * STARS + ["nearest"] * NEAREST + ["all"]
    while rounds:
        kind = rounds.pop(0)
        mixed = materialise(_rooted(rows, roots), "mixed") if roots is not None else _rooted(rows, None)
        if mixed.isEmpty():
            break
        if kind == "star":
            pairs = _star_pairs(mixed, reps, percent, len(rounds))
        else:
            pairs = _bucket_pairs(mixed if kind == "all" else _largest_buckets(mixed), percent, kind == "nearest")
        new = _verified(pairs, docs, reps, words, percent, text)
        release(*[mixed] * (roots is not None))
        if new.isEmpty():
            rounds = [x for x in rounds if x != kind]
            continue
        found = new if found is None else found.union(new)
        release(*[roots] * (roots is not None))
        roots = components(found)
    release(rows)
    return roots


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id) of every row: component_id is the least key that links reach.

    Links hold where 100 * intersection >= percent * union.
    """
    tune(docs.sparkSession)
    scanned = materialise(_scan(docs, words, percent, key, text), "scanned", partition_by=("kind",))
    rows = scanned.where(F.col("kind") == _ROW).select("doc", "n", "rep")
    reps = scanned.where(F.col("kind") == _REP).select("rep", "n", "d0", "d1", "th", "sketch")
    same = reps.groupBy("d0", "d1").agg(F.min("rep").alias("class"), F.count(F.lit(1)).alias("m")).where("m > 1").drop("m")
    moved = materialise(reps.select("rep", "d0", "d1").join(same, ["d0", "d1"]).where("rep <> class").select("rep", "class"), "moved")
    buckets = _buckets(scanned.where(F.col("kind") == _KEY).select("key", "rep"), moved)
    roots = links_between(buckets, reps, docs, words, percent, text)
    # per set, then per component: all combine before their shuffles
    least = rows.where("rep is not null").groupBy("rep").agg(F.min("doc").alias("component"))
    least = least.join(moved, "rep", "left").withColumn("class", F.coalesce("class", "rep"))
    if roots is not None:
        least = least.join(roots.select(F.col("node").alias("class"), "root"), "class", "left").withColumn("class", F.coalesce("root", "class"))
    least = materialise(least.select("rep", "class", "component"), "least")
    named = least.select("rep", "class").join(least.groupBy("class").agg(F.min("component").alias("component")), "class").select("rep", "component")
    return rows.join(named, "rep", "left").select(F.col("doc").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component", "doc").alias("component_id"))


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the near copies of rows that stay: of each component one row of the least key, null keys last.

    Rows are told apart by numbers of their own, so equal or null keys lose no other text. Rows of empty texts all stay.
    """
    rows = materialise(docs.withColumn("_row_number", F.monotonically_increasing_id()), "rows")
    found = materialise(near_duplicates(rows, words, percent, "_row_number", text), "found")
    many = found.groupBy("component_id").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("component_id")
    held = found.join(many, "component_id").join(rows.select("_row_number", F.col(key).alias("_key")), "_row_number")
    stays = held.groupBy("component_id").agg(F.min(F.struct(F.col("_key").isNull().alias("null"), F.col("_key"), F.col("_row_number"))).alias("one")).select("one._row_number")
    drop = held.select("_row_number").join(stays, "_row_number", "left_anti")
    return rows.join(drop, "_row_number", "left_anti").select(*docs.columns)


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=90)

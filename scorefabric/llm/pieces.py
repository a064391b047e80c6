"""SentencePiece encoding and decoding of whole texts by suffix-array matching.

For a BPE model with identity normalisation, a dummy prefix and byte fallback. Spaces become U+2581, and since no
piece goes on beyond a space after another character, texts fall into units (spaces, then other characters). The units
that a batch brings anew are concatenated and indexed by a suffix array, sorted by as many characters as the longest
piece has. Every piece is binary-searched for its range of occurrences; the occurrences are the edges of a lattice.
Edges are sorted by position and relaxed from left to right, all units in step: an edge reaches a position if its piece may
follow the last piece of the encoding that ends where it starts, that is, if the two pieces side by side encode to
themselves, which is looked up once for each two pieces. For BPE exactly one edge into each position does, so the path
is the encoding that merging by score gives. (Relaxing by the sum of scores, as for a unigram model, would give other
ids than the model's own.)

Defined results: a null or empty text has no ids; characters without a piece are bytes; repeated rows each give theirs; a
null doc_id keeps its row; an empty table gives no rows; columns other than the key and the text are not read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorefabric.llm.common import table, tune
from scorefabric.llm.packing import vocabulary

SPACE = "▁"
_UNIT = re.compile("▁*[^▁]+|▁+")
_LINES = re.compile("(\n)")
#: Units that a worker keeps from one call to the next, and characters of texts that it takes at once.
UNITS_KEPT, SLICE_CHARS = 400_000, 4 << 20


class _Pairs:
    """Whether a piece may follow another, by a number for each pair: an open hash table that takes arrays."""

    def __init__(self, judge):
        self.judge = judge
        self._reset(16)

    def _reset(self, bits: int) -> None:
        self.bits, self.count = bits, 0
        self.keys, self.says = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, bool)

    def _place(self, keys: np.ndarray) -> np.ndarray:
        """For each key its place, or the empty one where it belongs."""
        mask = (1 << self.bits) - 1
        at = ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)
        held = self.keys[at]
        on = np.flatnonzero((held != keys) & (held >= 0))
        while len(on):
            at[on] = (at[on] + 1) & mask
            held = self.keys[at[on]]
            on = on[(held != keys[on]) & (held >= 0)]
        return at

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = self._place(keys)
        new = np.unique(keys[self.keys[at] < 0])
        if len(new):
            if self.count + len(new) > 1 << (self.bits - 1):
                old = self.keys >= 0
                keys_, says = self.keys[old], self.says[old]
                if self.bits >= 22:  # two million pairs: start anew
                    keys_, says = keys_[:0], says[:0]
                self._reset(min(22, self.bits + 2) if len(keys_) else max(16, int(4 * len(new)).bit_length()))
                self._put(keys_, says)
            self._put(new, np.array([self.judge(k) for k in new.tolist()], bool))
            at = self._place(keys)
        return self.says[at]

    def _put(self, keys: np.ndarray, says: np.ndarray) -> None:
        left = np.arange(len(keys))
        while len(left):  # keys that meet at one place take turns
            at = self._place(keys[left])
            self.keys[at] = keys[left]
            won = self.keys[at] == keys[left]
            self.says[at[won]] = says[left[won]]
            left = left[~won]
        self.count += len(keys)


class PieceEncoder:
    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.names = [sp.id_to_piece(i) for i in range(n)]
        self.byte = {int(self.names[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.of_byte = {i: b for b, i in self.byte.items()}
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        if any(SPACE in self.names[i].lstrip(SPACE) for i in plain):
            raise ValueError("a piece has a space after another character")
        self.score = {self.names[i]: sp.get_score(i) for i in plain}
        self.id = {self.names[i]: i for i in plain}
        self.width = max(map(len, self.score))
        order = sorted(self.score)
        self.pieces = order
        self.lens = np.array([len(p) for p in order])
        self.codes = np.zeros((len(order), self.width), np.uint32)
        for k, p in enumerate(order):
            self.codes[k, : len(p)] = [ord(c) for c in p]
        one = np.flatnonzero(self.lens == 1)
        self.char_of, self.char_piece = self.codes[one, 0], one  # ascending, as the pieces are
        self.id_of = np.array([self.id[p] for p in order], np.int32)
        said = [bytes([self.of_byte[i]]) if i in self.of_byte else self.names[i].replace(SPACE, " ").encode("utf-8", "surrogatepass") for i in range(n)]
        self.said = np.frombuffer(b"".join(said), np.uint8)
        self.said_end = np.cumsum([len(x) for x in said])
        self.said_len = np.array([len(x) for x in said])
        self.follow = _Pairs(self._may_follow)
        self.known: dict[str, bytes] = {}

    def merged(self, text: str) -> list[str]:
        """The encoding of a short string by merging the best pair, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = self.score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _may_follow(self, pair: int) -> bool:
        """Whether piece b may follow piece a - 1, of a pair a * number of pieces + b; a = 0 is the start of a unit or a character
        without a piece."""
        a, b = divmod(pair, len(self.pieces))
        first, second = self.pieces[a - 1] if a else "", self.pieces[b]
        return self.merged(first + second) == ([first, second] if first else [second])

    def edges(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, piece) of every occurrence of every piece in the characters of text, in order of the end, then of the start."""
        n = len(text)
        padded = np.concatenate([text, np.zeros(self.width, np.uint32)])
        rank, span = np.unique(text, return_inverse=True)[1].astype(np.int64) + 1, 1
        while span < self.width:
            second = np.concatenate([rank[span:], np.zeros(min(span, n), np.int64)])
            rank = np.unique(rank * (n + 2) + second, return_inverse=True)[1].astype(np.int64) + 1
            span *= 2
        order = np.argsort(rank, kind="stable")
        rows = np.lib.stride_tricks.sliding_window_view(padded, self.width)
        cover = np.arange(self.width)[None, :] < self.lens[:, None]

        def bound(upper: bool) -> np.ndarray:
            low, high = np.zeros(len(self.lens), np.int64), np.full(len(self.lens), n)
            while (live := np.flatnonzero(low < high)).size:
                mid = (low[live] + high[live]) // 2
                differs = (rows[order[mid]] != self.codes[live]) & cover[live]
                first = differs.argmax(1)
                at = np.arange(len(live))
                less = rows[order[mid], first] < self.codes[live, first]
                go = np.where(differs[at, first], less, upper)
                low[live] = np.where(go, mid + 1, low[live])
                high[live] = np.where(go, high[live], mid)
            return low

        a, b = bound(False), bound(True)
        k = b - a
        piece = np.repeat(np.arange(len(k)), k)
        start = order[np.repeat(a - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))]
        by = np.lexsort((start, start + self.lens[piece]))
        return start[by], piece[by]

    def _learn(self, units: list[str]) -> None:
        """Find the ids of new units and keep them."""
        joined = "\n".join(units) + "\n"  # no piece of these models has a line feed; it is coded as a byte
        text = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        n, size = len(self.pieces), np.array([len(u) for u in units], np.int64)
        ends = np.cumsum(size + 1) - 1
        begins = ends - size
        # the last piece of the encoding up to each place: -1 at a unit's start and after a character without a piece
        k = np.minimum(np.searchsorted(self.char_of, text), len(self.char_of) - 1)
        last = np.concatenate([[-1], np.where(self.char_of[k] == text, self.char_piece[k], -1)])
        last[begins] = -1
        start, piece = self.edges(text)
        end = start + self.lens[piece]
        offset = end - np.repeat(begins, size + 1)[end - 1]
        order = np.lexsort((-start, offset))  # the longest of the edges into a place comes last
        start, piece, end = start[order], piece[order], end[order]
        steps = np.searchsorted(offset[order], np.arange(int(size.max()) + 2))
        for a, b in zip(steps[1:-1].tolist(), steps[2:].tolist(), strict=True):
            at = slice(a, b)
            ok = self.follow((last[start[at]] + 1) * n + piece[at])
            last[end[at][ok]] = piece[at][ok]
        # back from the units' ends
        said = np.full(len(text) + 1, -2, np.int64)
        at, first = ends.copy(), begins
        while len(at):
            p = last[at]
            said[at] = p
            at = at - np.where(p >= 0, self.lens[p], 1)
            on = at > first
            at, first = at[on], first[on]
        places = np.flatnonzero(said > -2)
        ids, counts = self.id_of[said[places]], np.ones(len(places), np.int64)
        bare = np.flatnonzero(said[places] < 0)  # characters without a piece are their bytes
        if len(bare):
            raw = [chr(c).encode("utf-8", "surrogatepass") for c in text[places[bare] - 1].tolist()]
            counts[bare] = list(map(len, raw))
            wide = np.repeat(ids, counts)
            inside = np.repeat(said[places] < 0, counts)
            wide[inside] = [self.byte[x] for r in raw for x in r]
            ids = wide
        total = np.concatenate([[0], np.cumsum(counts)])
        cuts = (4 * total[np.searchsorted(places, np.concatenate([[0], ends]), side="right")]).tolist()
        held = ids.astype("<i4").tobytes()
        self.known.update(zip(units, [held[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)], strict=True))

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        if len(self.known) > UNITS_KEPT:  # before this call's units are looked up, so all of them are there at its end
            self.known.clear()
        cut = [_UNIT.findall(SPACE + x.replace(" ", SPACE)) if x else [] for x in texts]
        # units with a line feed are cut there: it has no piece, so nothing merges across it
        cut = [[p for u in c for p in (_LINES.split(u) if "\n" in u else (u,)) if p] if x and "\n" in x else c for c, x in zip(cut, texts, strict=True)]
        self.known["\n"] = self.byte[10].to_bytes(4, "little")
        new = set(chain.from_iterable(cut)).difference(self.known)
        if new:
            self._learn(list(new))
        return [np.frombuffer(b"".join(map(self.known.__getitem__, c)), "<i4") for c in cut]

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        """The texts of many lists of ids."""
        flat = np.concatenate([*ids, np.zeros(0, np.int64)]).astype(np.int64)
        lens = self.said_len[flat]
        ends = np.cumsum(lens)
        raw = self.said[np.repeat(self.said_end[flat] - ends, lens) + np.arange(int(ends[-1]) if len(ends) else 0)].tobytes()
        cuts = np.concatenate([[0], ends])[np.cumsum([0, *map(len, ids)])].tolist()
        return [raw[a:b].decode("utf-8", "replace").removeprefix(" ") for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


@lru_cache(2)
def encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


def _slices(batches, text: str):
    """Frames of some SLICE_CHARS characters of texts: small batches are joined, large ones cut."""
    held, size = [], 0
    for b in batches:
        ends = np.cumsum([len(x) if x else 0 for x in b[text]])
        at = 0
        while at < len(b):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_CHARS - size, side="right")))
            held.append(b.iloc[at:stop])
            size += int(ends[stop - 1] - (ends[at - 1] if at else 0))
            at = stop
            if size >= SLICE_CHARS // 2:
                yield pd.concat(held, ignore_index=True)
                held, size = [], 0
    if held:
        yield pd.concat(held, ignore_index=True)


def encode_frames(batches, model: str, key: str, text: str):
    """Frames (key, ids) of frames (key, text)."""
    enc = encoder(model)
    for b in _slices(batches, text):
        yield pd.DataFrame({key: b[key].astype("Int64"), "ids": enc.encode(b[text].tolist())})


def decode_frames(batches, model: str, key: str):
    """Frames (key, ids, text) of frames (key, ids)."""
    enc = encoder(model)
    for b in batches:
        yield pd.DataFrame({key: b[key].astype("Int64"), "ids": b["ids"], "text": enc.decode(b["ids"].tolist())})


def encode(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids) of every row."""
    tune(docs.sparkSession)
    return docs.select(F.col(key).cast("long").alias(key), text).mapInPandas(lambda it: encode_frames(it, model, key, text), f"{key} long, ids array<int>")


def decode(coded: DataFrame, model: str, key: str = "doc_id") -> DataFrame:
    """(key, ids, text) of every row of (key, ids)."""
    return coded.select(key, "ids").mapInPandas(lambda it: decode_frames(it, model, key), f"{key} long, ids array<int>, text string")


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded texts of all documents, as digests; both ways in one pass, so neither travels between processes."""
    model = vocabulary("piece_bpe_32k.model")

    def each(batches):
        for b in decode_frames(encode_frames(batches, model, "doc_id", "text"), model, "doc_id"):
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_ids": [len(x) for x in b["ids"]], "ids_crc32": [zlib.crc32(np.ascontiguousarray(x, "<u4")) for x in b["ids"]], "decoded_sha256": [hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in b["text"]]})

    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(each, "doc_id long, n_ids long, ids_crc32 long, decoded_sha256 string")

"""Token ids of whole texts, equal to those of the tokenizers library.

The pre-tokenizers of the two public BPE files cut a text into words that are encoded one by one, so each distinct
word is encoded once by the library and then looked up. That holds for texts of Latin letters and common punctuation,
where the cutting pattern can be stated exactly with the standard library; any other text, and one that holds the string
of an added token, goes to the library whole. Words of the lower-casing file are cut from the bytes of many texts at once.
"""

from __future__ import annotations

import gc
import json
import os
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Words that a worker keeps; beyond it the store starts anew.
CACHE_WORDS = 1_000_000
#: Bytes of text whose words are cut at once; some ten times as many are held meanwhile.
CHUNK_BYTES = 8 << 20

# Within the safe characters these classes are \p{L}, \p{N} and \s, stated as ranges.
_SAFE = re.compile(r"[\t\n\r\x20-\x7e\xa0-\u012f\u0131-\u024f\u2010-\u2027\u2030-\u205e]*")
_L, _N, _S = r"A-Za-zªµºÀ-ÖØ-öø-\u024f", "0-9²³¹¼½¾", r"\t\n\r \xa0"
_ENDINGS = "'s|'t|'re|'ve|'m|'ll|'d"
# letters first: no other branch can start where they do
_BYTE_LEVEL = re.compile(rf" ?[{_L}]+|{_ENDINGS}| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
_WORD_ENDS = re.compile(rf"[{_L}]+|{_ENDINGS}|[{_N}]|[^{_S}{_L}{_N}]+")


def _byte_letters() -> dict[int, int]:
    """Byte-level models write bytes that don't print as letters from U+0100 on; this maps a byte to its letter."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: 256 + k for k, b in enumerate(rest)}


_LETTERS = _byte_letters()
_SPACE = chr(_LETTERS[32])
_BYTE_LETTERS = np.array([b if b == 10 else _LETTERS.get(b, b) for b in range(256)], "<u2")  # a line end parts words


# kinds of characters, for code points below U+0250 and for the first byte of any other (beyond those all safe ones are punctuation)
_SPACES, _LETTER, _NUMBER, _OTHER = range(4)
_KINDS = np.array([_SPACES if re.match(f"[{_S}]", c) else _LETTER if re.match(f"[{_L}]", c) else _NUMBER if re.match(f"[{_N}]", c) else _OTHER for c in map(chr, range(0x250))], np.uint8)
_BYTE_KINDS = np.concatenate([_KINDS[:128], np.full(128, _OTHER, np.uint8)])


def _cut_words(texts: list[bytes]) -> tuple[np.ndarray, list[str], np.ndarray]:
    """(number of each word, the distinct words by number, offsets of texts with a last end): what _WORD_ENDS finds in safe texts."""
    raw = b"\n".join([*texts, b"\n\n\n"])  # a word ends with its text, and three bytes on can be looked at
    b = np.frombuffer(raw, np.uint8)
    kind = _BYTE_KINDS[b]
    two = np.flatnonzero((b >= 0xC0) & (b < 0xE0))
    kind[two] = kind[two + 1] = _KINDS[(b[two].astype(np.int64) & 31) << 6 | b[two + 1] & 63]
    first = np.ones(len(b), bool)
    np.not_equal(kind[1:], kind[:-1], out=first[1:])
    first |= kind == _NUMBER
    first[two + 1] = False
    first &= kind != _SPACES
    # an ending is its apostrophe, alone among punctuation, and letters; what follows them is a word of its own
    q = np.flatnonzero(b == ord("'"))
    q = q[first[q] & (kind[q + 1] == _LETTER)]
    x, y = b[q + 1], b[q + 2]
    one = (x == ord("s")) | (x == ord("t")) | (x == ord("m")) | (x == ord("d"))
    more = ((x == ord("r")) | (x == ord("v"))) & (y == ord("e")) | (x == ord("l")) & (y == ord("l"))
    first[q[one | more] + 1] = False
    after = np.concatenate([q[one] + 2, q[more] + 3])
    first[after] |= kind[after] == _LETTER
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
    offsets = np.searchsorted(np.flatnonzero(first), begins)
    held = kind != _SPACES
    kept = b[held]
    ends = np.append(np.flatnonzero(first[held]), len(kept)).astype(np.int32)
    words = pa.StringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends), pa.py_buffer(kept)).dictionary_encode()
    return words.indices.to_numpy(), words.dictionary.to_numpy(zero_copy_only=False).tolist(), offsets


class _Words(dict):
    """The ids of a word as little-endian 32-bit numbers; a word that is new is handed to the library's model."""

    def __init__(self, model):
        self.tokenize = model.tokenize

    def __missing__(self, word: str) -> bytes:
        # a word is what the pre-tokenizer would hand to the model: its bytes as letters
        rest = word[1:] if word[0] == " " else word
        if rest.isascii() and rest.isprintable() and " " not in rest:
            said = _SPACE + rest if rest is not word else word
        else:
            said = word.encode().decode("latin-1").translate(_LETTERS)
        self[word] = ids = array("I", [t.id for t in self.tokenize(said)]).tobytes()
        return ids

    def many(self, words: list[str]) -> list[bytes]:
        """The ids of words without white space; the new ones go to the model together."""
        out = list(map(self.get, words))
        new = [i for i, x in enumerate(out) if x is None]
        said = _BYTE_LETTERS[np.frombuffer("\n".join([words[i] for i in new]).encode(), np.uint8)].tobytes().decode("utf-16-le").split("\n")
        on = gc.isenabled()
        gc.disable()  # the model's tokens make no cycles, and each collection would walk all words
        try:
            for i, x in zip(new, said, strict=False):  # without new words there is one empty string
                self[words[i]] = out[i] = array("I", [t.id for t in self.tokenize(x)]).tobytes()
        finally:
            if on:
                gc.enable()
        return out


class WordEncoder:
    """Encodes texts to ids; keeps the ids of words it has met."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        pre, norm = said["pre_tokenizer"] or {}, said["normalizer"] or {}
        self.pattern, self.lower = None, False
        if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not norm:
            self.pattern = _BYTE_LEVEL
        elif pre.get("type") == "Sequence" and [x["type"] for x in norm.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]:
            self.pattern, self.lower = _WORD_ENDS, True
        added = [x for x in said.get("added_tokens") or [] if x["content"]]
        self.added = [x["content"] for x in added]
        if any(x["normalized"] for x in added):
            self.pattern = None  # found in normalised text: the library sees every text whole
        self._reset()

    def _safe(self, text: str) -> str | None:
        """The text to cut, or None where the library has to see it whole. Letters are judged as they are encoded."""
        if not self.pattern or any(x in text for x in self.added):
            return None
        if self.lower:
            text = text.lower()
        return text if _SAFE.fullmatch(text) else None

    def _reset(self) -> None:
        self.words = _Words(self.library.model)

    def _ids(self, texts: list[bytes]) -> list[bytes]:
        """The ids of safe lower-cased texts: each distinct word is looked up once."""
        words, distinct, offsets = _cut_words(texts)
        said = self.words.many(distinct)
        if len(self.words) > CACHE_WORDS:
            self._reset()
        known, size = np.frombuffer(b"".join(said), np.uint32), np.fromiter(map(len, said), np.int64, len(said)) >> 2
        n = size[words]
        ends = np.cumsum(n)
        at = np.repeat((np.cumsum(size) - size)[words] - (ends - n), n)
        at += np.arange(len(at))
        ids = known[at].tobytes()
        cuts = (4 * np.concatenate([[0], ends])[offsets]).tolist()
        return [ids[i:j] for i, j in zip(cuts[:-1], cuts[1:], strict=True)]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets with a last end): the ids of text i are ids[offsets[i]:offsets[i + 1]]."""
        held, waiting, size = [], {}, 0
        for i, x in enumerate(texts):
            safe = self._safe(x) if x else ""
            held.append(b"")
            if safe is None:
                held[i] = array("I", self.library.encode(x, add_special_tokens=False).ids).tobytes()
            elif safe and self.lower:
                waiting[i] = safe.encode()
                size += len(waiting[i])
            elif safe:
                held[i] = b"".join(map(self.words.__getitem__, self.pattern.findall(safe)))
                if len(self.words) > CACHE_WORDS:
                    self._reset()
            if waiting and (size >= CHUNK_BYTES or i == len(texts) - 1):
                for k, ids in zip(waiting, self._ids([*waiting.values()]), strict=True):
                    held[k] = ids
                waiting, size = {}, 0
        ids = np.frombuffer(b"".join(held), np.uint32)
        return ids, np.cumsum([0, *map(len, held)]) // 4


@lru_cache(4)
def encoder(path: str) -> WordEncoder:
    """One for each worker process and file."""
    return WordEncoder(path)


def with_end(ids: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Append an end id to each document."""
    return np.insert(ids, offsets[1:], np.uint32(end)), offsets + np.arange(len(offsets))

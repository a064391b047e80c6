"""Toxicity by subword-bag embeddings.

A word is the bag of its character n-grams and of itself, hashed to a table of embeddings; a segment of SEGMENT words is
the average of its words' averages, and a linear softmax on it gives the probability of label 1. Embeddings and softmax
start at random and are trained jointly in numpy by Adam, in batches of texts. The first passes learn every segment with
its text's label, so that each word that tells the labels apart is found; in the last ones a text answers as a whole, its
segments weighted by their share of the text's softmax, which is mostly the most toxic one. A text is scored by its most
toxic segment. Misspelt or inflected words that training never saw share n-grams, and so vectors, with those it saw; an
n-gram that too few texts hold has no vector, as it would only remember them.

The fit takes TRAIN_ROWS labelled rows of each label at most, the first by a hash of their doc_id; scoring covers all
rows and whole texts. At scoring an n-gram counts as one number, its embedding times the softmax's weights.

Defined results: a null or empty text, or one without words, gets the score of no evidence (the bias alone); repeated
rows each get their score; a null doc_id counts as held out and is never trained on; labels other than 0 and 1, null
ones, and labels without a document are left out; without labels of both kinds every score is the share of label 1
(0.5 without any); an empty table gives no rows. Scores read the text alone.
"""

from __future__ import annotations

import re
import zlib
from array import array

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorefabric.llm.common import table, tune

#: Labelled rows of each label that a fit takes at most.
TRAIN_ROWS = 2500
SEGMENT, LEAST_WORDS = 16, 8
BUCKETS, DIM, GRAMS = 1 << 16, 8, (3, 4, 5)
#: Passes over segments and over whole texts (more of both where texts are few, to make STEPS steps), texts of a batch, and
#: the texts that must hold an n-gram (a tenth of all, where that is less).
SEGMENT_PASSES, TEXT_PASSES, STEPS, BATCH, RATE, LEAST_TEXTS = 4, 3, 280, 64, 0.1, 10
#: Share of every vector that a pass takes away: what a few texts teach again and again does not pile up.
DECAY = 0.02
_CACHE_WORDS = 500_000
#: A run of more than 64 word characters is several words in a row.
_WORD = re.compile(r"\w{1,64}")


def subwords(word: str) -> list[int]:
    """Buckets of the n-grams of <word>, and of the word."""
    w = f"<{word}>"
    out = [zlib.crc32(w.encode("utf-8", "surrogatepass")) % BUCKETS]
    for n in GRAMS:
        out += [zlib.crc32(w[i : i + n].encode("utf-8", "surrogatepass")) % BUCKETS for i in range(len(w) - n + 1)]
    return out


class Model:
    """numbers: what each bucket adds; bias. score() is the softmax's probability of label 1."""

    def __init__(self, numbers: np.ndarray, bias: float):
        self.numbers, self.bias = numbers, bias
        self.known: dict[str, float] = {}

    def _learn(self, words) -> None:
        if len(self.known) > _CACHE_WORDS:
            self.known.clear()
        for w in words:
            s = self.numbers[subwords(w)]
            self.known[w] = float(s.sum() / len(s))

    def score(self, text: str | None) -> float:
        words = _WORD.findall((text or "").lower())
        if not words:
            return float(_sigmoid(self.bias))
        try:
            v = np.fromiter(map(self.known.__getitem__, words), np.float64, len(words))
        except KeyError:
            self._learn(set(words).difference(self.known))
            v = np.fromiter((self.known[w] if w in self.known else self._one(w) for w in words), np.float64, len(words))
        starts = np.arange(0, len(v), SEGMENT)
        n = np.maximum(np.minimum(SEGMENT, len(v) - starts), LEAST_WORDS)
        return float(_sigmoid((np.add.reduceat(v, starts) / n).max() + self.bias))

    def _one(self, w: str) -> float:
        s = self.numbers[subwords(w)]
        return float(s.sum() / len(s))

    def __getstate__(self):
        return self.numbers, self.bias

    def __setstate__(self, said):
        self.__init__(*said)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


class _Corpus:
    """Texts as word numbers, and the n-grams of each word."""

    def __init__(self, texts: list[str | None]):
        index: dict[str, int] = {}
        found = (_WORD.findall((t or "").lower()) for t in texts)
        self.texts = [np.fromiter((index.setdefault(w, len(index)) for w in f), np.int32) for f in found]
        held, sizes = array("i"), array("i")  # plain lists of every word's n-grams would be most of the driver's memory
        for w in index:
            g = subwords(w)
            held.extend(g)
            sizes.append(len(g))
        self.flat, self.size = np.array(held, np.int32), np.array(sizes, np.int64)
        self.begin = np.cumsum(self.size) - self.size

    def grams(self, words: np.ndarray) -> np.ndarray:
        n = self.size[words]
        return self.flat[np.repeat(self.begin[words], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]

    def held_by(self) -> np.ndarray:
        """How many texts hold each bucket."""
        out = np.zeros(BUCKETS, np.int64)
        for t in self.texts:
            if len(t):
                out[np.unique(self.grams(np.unique(t)))] += 1
        return out


class _Adam:
    def __init__(self, value: np.ndarray):
        self.value, self.first, self.second, self.steps = value, np.zeros_like(value), np.zeros_like(value), 0

    def move(self, gradient: np.ndarray) -> None:
        self.steps += 1
        self.first += 0.1 * (gradient - self.first)
        self.second += 0.01 * (gradient * gradient - self.second)
        self.value -= RATE * (self.first / (1 - 0.9**self.steps)) / (np.sqrt(self.second / (1 - 0.99**self.steps)) + 1e-8)


def fit(texts: list[str | None], labels: list[int], seed: int = 7) -> Model:
    """Joint training on whole texts, from random vectors."""
    y = np.array(labels, np.float64)
    if not len(y) or y.min() == y.max():
        p = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.5
        return Model(np.zeros(BUCKETS), float(np.log(p / (1 - p))))
    corpus = _Corpus(texts)
    some = np.flatnonzero([len(t) > 0 for t in corpus.texts])
    if not len(some):
        return fit([], [])
    rng = np.random.default_rng(seed)
    live = (corpus.held_by() >= min(LEAST_TEXTS, max(1, len(y) // 10)))[:, None]
    emb, out, bias = _Adam(rng.normal(0, 0.1, (BUCKETS, DIM)) * live), _Adam(rng.normal(0, 1, DIM)), _Adam(np.array([-1.0]))
    more = -(-STEPS // ((SEGMENT_PASSES + TEXT_PASSES) * -(-len(some) // BATCH)))
    for k in range((SEGMENT_PASSES + TEXT_PASSES) * max(1, more)):
        order = rng.permutation(some)
        for at in range(0, len(order), BATCH):
            emb.value *= 1 - DECAY * min(BATCH, len(order)) / len(order)
            _step(corpus, order[at : at + BATCH], y, emb, out, bias, live, whole=k >= SEGMENT_PASSES * max(1, more))
    return Model(emb.value @ out.value, float(bias.value[0]))


def _step(corpus: _Corpus, batch: np.ndarray, y: np.ndarray, emb: _Adam, out: _Adam, bias: _Adam, live: np.ndarray, whole: bool) -> None:
    """One batch of texts. whole: a text answers by the softmax of its segments, else each segment with the text's label."""
    length = np.array([len(corpus.texts[d]) for d in batch])
    words = np.concatenate([corpus.texts[d] for d in batch])
    parts = -(-length // SEGMENT)
    of = np.repeat(np.arange(len(batch)), parts)
    begin = np.repeat(np.cumsum(length) - length, parts) + SEGMENT * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
    size = np.diff(np.append(begin, len(words)))
    used, place = np.unique(words, return_inverse=True)
    n, own = corpus.size[used], corpus.grams(used)
    vector = np.add.reduceat(emb.value[own], np.cumsum(n) - n, axis=0) / n[:, None]
    denom = np.maximum(size, LEAST_WORDS)
    mean = np.add.reduceat(vector[place], begin, axis=0) / denom[:, None]
    logit, target = mean @ out.value + bias.value[0], y[batch]
    if whole:
        top = np.maximum.reduceat(logit, np.cumsum(parts) - parts)
        share = np.exp(logit - top[of])
        total = np.bincount(of, share, len(batch))
        slope = ((_sigmoid(top + np.log(total)) - target) / total)[of] * share
    else:
        slope = (_sigmoid(logit) - target[of]) / np.sqrt(parts)[of]
    slope /= len(batch)
    by_word = np.bincount(place, np.repeat(slope / denom, size), len(used)) / n
    by_bucket = np.bincount(own, np.repeat(by_word, n), BUCKETS)
    toward = out.value.copy()
    out.move(slope @ mean)
    emb.move(by_bucket[:, None] * toward * live)
    bias.move(np.array([slope.sum()]))


def held_out(key: str = "doc_id"):
    """Whether crc32 of the key as text leaves 1 by 3; null keys count as held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 3 == 1, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Fit on a bounded sample of the labelled rows that are not held out: the sample, 2 * rows keys at most, is broadcast."""
    usable = labels.select(F.col(key).cast("long").alias("_k"), F.col(label).alias("_y")).where(F.col("_k").isNotNull() & F.col("_y").isin(0, 1)).where(~held_out("_k"))
    parts = [usable.where(F.col("_y") == v).orderBy(F.xxhash64("_k"), "_k").limit(rows) for v in (0, 1)]
    sample = parts[0].union(parts[1])
    got = docs.select(F.col(key).cast("long").alias("_k"), F.col(text).alias("_t")).join(F.broadcast(sample), "_k").orderBy("_k", "_y", "_t").limit(2 * rows).select("_t", "_y").collect()
    return fit([r._t for r in got], [r._y for r in got])


def scores(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Each row with its score; keep: the columns of docs that come along (the key by default)."""
    tune(docs.sparkSession)
    columns = keep or [key]
    chosen = docs.select(*columns, *([text] if text not in columns else []))

    def each(batches):
        import pyarrow as pa

        for b in batches:
            got = b.column(text).to_pylist()
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array([model.score(x) for x in got], pa.float64())], names=[*columns, "score"])

    from pyspark.sql import types as T

    schema = T.StructType([*(chosen.schema[c] for c in columns), T.StructField("score", T.DoubleType())])
    return chosen.mapInArrow(each, schema)


THRESHOLD = 0.7


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    return scores(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

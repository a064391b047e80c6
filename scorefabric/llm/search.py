"""Ranked lexical search over document-sharded postings with integer impacts.

Tasks cut their documents into shards. A shard holds its terms in UTF-8 order, and for each term the shard's documents with
it and their impacts, in compressed sparse rows: the part of a score that depends on the document is computed once, when the
index is built. A search takes its queries in blocks. It first sums the document frequencies of a block's terms over all
shards, which reads terms and row bounds alone. Then each shard goes through a query's terms one at a time and adds weight
times impact to a dense vector of its documents; the greatest scores are selected with ties by doc_id. A task merges what
its shards select, and Spark merges the tasks' selections, so no more than `top` rows a query leave a task.

Documents without terms are in no shard. Weights are floor(1000 ln((2 N + 2) / (2 df + 1))) in doubles, all else is exact.

Defined results: a null text has no terms and is never found; a null doc_id comes after all others of its score; repeated
rows are found each; an item without terms, or with none that occurs, has no rows; repeated items have results each; an
empty table of either kind gives an empty result; columns other than those named are not read.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorefabric.llm.common import materialise, table

#: Bytes that separate terms become spaces, A to Z become a to z; digits and all others stay.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

_IN_TERM = np.frombuffer(TERM_BYTES, np.uint8) != 32

#: Documents and postings after which a shard is closed; queries and terms after which a block of queries is.
SHARD_DOCS, SHARD_POSTINGS, BLOCK_ITEMS, BLOCK_TERMS = 1 << 13, 1 << 19, 1 << 10, 1 << 17

TOP = 10


def terms_of(body: bytes) -> list[bytes]:
    return body.translate(TERM_BYTES).split()


# ---- the index ----


def lengths(bodies: pa.BinaryArray) -> np.ndarray:
    """Terms with repeats of each text: places where a term begins, counted over the whole buffer at once."""
    if not len(bodies):
        return np.zeros(0, np.int64)
    offsets = np.frombuffer(bodies.buffers()[1], "<i4")[bodies.offset : bodies.offset + len(bodies) + 1].astype(np.int64)
    data = np.frombuffer(bodies.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if bodies.buffers()[2] else np.zeros(0, np.uint8)
    inside = _IN_TERM[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = offsets - offsets[0]
    edge = edges[edges < len(data)]
    begins[edge] = inside[edge]
    return np.diff(np.r_[0, np.cumsum(begins)][edges])


def totals(docs: DataFrame, text: str = "text") -> tuple[int, int]:
    """N, the documents with a term, and L, all their terms with repeats."""

    def each(batches):
        documents = terms = 0
        for b in batches:
            n = lengths(b.column(0))
            documents, terms = documents + int((n > 0).sum()), terms + int(n.sum())
        yield pa.RecordBatch.from_arrays([pa.array([documents]), pa.array([terms])], ["n", "l"])

    found = docs.where(F.col(text).isNotNull()).select(F.col(text).cast("binary").alias("body")).mapInArrow(each, "n long, l long")
    n, l = found.agg(F.sum("n"), F.sum("l")).first()
    return n or 0, l or 0


_INDEX = "terms array<binary>, bounds array<int>, places binary, impacts binary, ids array<long>"


class _Shard:
    """Postings of some documents as they come in."""

    def __init__(self):
        self.numbers: dict[bytes, int] = {}
        self.terms, self.counts, self.held, self.damp, self.ids = [], [], [], [], []

    def add(self, doc_id: int | None, words: list[bytes], documents: int, all_terms: int) -> None:
        counts = Counter(words)
        numbers = self.numbers
        self.terms += [numbers.setdefault(t, len(numbers)) for t in counts]
        self.counts += counts.values()
        self.held.append(len(counts))
        self.damp.append(10 + 90 * len(words) * documents // all_terms)
        self.ids.append(doc_id)

    def row(self) -> pa.RecordBatch:
        """Postings by term in UTF-8 order, within one by place; places count the shard's documents."""
        names = sorted(self.numbers)
        rank = np.empty(len(names), np.int64)
        rank[[self.numbers[t] for t in names]] = np.arange(len(names))
        terms = rank[self.terms]
        place = np.repeat(np.arange(len(self.held)), self.held)
        tf = np.array(self.counts, np.int64)
        impacts = (1_000_000_000 * tf) // (1000 * tf + 8 * np.array(self.damp, np.int64)[place])
        order = np.argsort(terms, kind="stable")
        bounds = np.r_[0, np.cumsum(np.bincount(terms, minlength=len(names)))]
        row = [names, bounds.tolist(), place[order].astype("<u2").tobytes(), impacts[order].astype("<u4").tobytes(), self.ids]
        kinds = (pa.list_(pa.binary()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip(row, kinds, strict=True)], [x.split()[0] for x in _INDEX.split(", ")])


def index_of(docs: DataFrame, documents: int, all_terms: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each shard: terms, the bounds of each one's postings, their places among ids, and their impacts."""

    def cut(batches):
        shard = _Shard()
        for b in batches:
            for doc_id, body in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if words := terms_of(body.as_py()):
                    shard.add(doc_id, words, documents, all_terms)
                    if len(shard.ids) >= SHARD_DOCS or len(shard.terms) >= SHARD_POSTINGS:
                        yield shard.row()
                        shard = _Shard()
        if shard.ids:
            yield shard.row()

    return docs.where(F.col(text).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(text).cast("binary").alias("body")).mapInArrow(cut, _INDEX)


# ---- searches ----


def _found(terms: pa.ListScalar, wanted: list[bytes]) -> list[tuple[int, int]]:
    """(number among wanted, place among a shard's terms) of the wanted terms that the shard has. Both are sorted."""
    names, out, at = terms.as_py(), [], 0
    for k, t in enumerate(wanted):
        at = bisect_left(names, t, at)
        if at == len(names):
            break
        if names[at] == t:
            out.append((k, at))
    return out


def frequencies(index: DataFrame, wanted: list[bytes]) -> list[int]:
    """Documents that hold each of the wanted terms, which are sorted."""

    def each(batches):
        held = np.zeros(len(wanted), np.int64)
        for b in batches:
            for terms, bounds in zip(b.column(0), b.column(1), strict=True):
                found = np.array(_found(terms, wanted), np.int64).reshape(-1, 2)
                sizes = np.diff(bounds.values.to_numpy())
                held[found[:, 0]] += sizes[found[:, 1]]
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(held[some], pa.int64())], ["term", "df"])

    out = [0] * len(wanted)
    for term, df in index.select("terms", "bounds").mapInArrow(each, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toLocalIterator():
        out[term] = df
    return out


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


_NULL = np.iinfo(np.int64).max  # stands for a null doc_id, and is marked apart


def _best(scores: np.ndarray, ids: np.ndarray, blank: np.ndarray, top: int) -> np.ndarray:
    """Places of the `top` greatest scores above 0; of equal ones those of least id, null last."""
    some = np.flatnonzero(scores > 0)
    if len(some) > top:
        s = scores[some]
        least = s[np.argpartition(s, len(s) - top)[len(s) - top]]
        some = some[s >= least]  # with every tie at the border
    return some[np.lexsort((ids[some], blank[some], -scores[some]))[:top]]


_HITS = "q long, id long, score long"


def _searched(queries: list[tuple[int, list[int]]], wanted: list[bytes], weights: list[int], top: int):
    """Selects within each shard, then within the task. queries: (number, numbers of its terms)."""

    def each(batches):
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))
        kept = {q: none for q, _ in queries}
        for b in batches:
            for row in range(b.num_rows):
                terms, bounds, places, impacts, ids = (b.column(c)[row] for c in range(5))
                at = dict(_found(terms, wanted))
                bounds = bounds.values.to_numpy()
                places, impacts = np.frombuffer(places.as_buffer(), "<u2"), np.frombuffer(impacts.as_buffer(), "<u4")
                blank = ids.values.is_null().to_numpy(zero_copy_only=False)
                ids = ids.values.fill_null(_NULL).to_numpy()
                scores = np.zeros(len(ids), np.int64)
                for q, numbers in queries:
                    scores[:] = 0
                    for k in numbers:
                        if (t := at.get(k)) is not None:
                            span = slice(bounds[t], bounds[t + 1])
                            scores[places[span]] += weights[k] * impacts[span].astype(np.int64)
                    best = _best(scores, ids, blank, top)
                    if len(best):
                        now = tuple(np.r_[a, x[best]] for a, x in zip(kept[q], (scores, ids, blank), strict=True))
                        best = _best(*now, top)
                        kept[q] = tuple(x[best] for x in now)
        for q, (scores, ids, blank) in kept.items():
            if len(scores):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(scores), q)), pa.array(ids, mask=blank), pa.array(scores)], ["q", "id", "score"])

    return each


#: Tasks' selections meet in so many parts first.
PARTS = 64


def _merged(hits: DataFrame, top: int) -> DataFrame:
    order = [F.desc("score"), F.asc_nulls_last("id")]
    part = F.row_number().over(Window.partitionBy("q", "_part").orderBy(*order))
    some = hits.withColumn("_part", F.pmod(F.spark_partition_id(), F.lit(PARTS))).withColumn("rank", part).where(F.col("rank") <= top).drop("_part")
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(*order))).where(F.col("rank") <= top)


def _blocks(items: DataFrame):
    """Rows (item, body) in blocks of so many items or terms; one block is on the driver at a time. Items without terms are left out."""
    block, size = [], 0
    for item, body in items.toLocalIterator():
        if terms := sorted(set(terms_of(bytes(body)))):
            block.append((item, terms))
            size += len(terms)
        if len(block) >= BLOCK_ITEMS or size >= BLOCK_TERMS:
            yield block
            block, size = [], 0
    if block:
        yield block


def search(index: DataFrame, documents: int, items: DataFrame, top: int = TOP, item: str = "item_id", text: str = "text", key: str = "doc_id") -> DataFrame:
    """(item, rank, key, score): the `top` documents of each item with the highest scores above 0. index should be written: each block reads it."""
    spark = items.sparkSession
    schema = T.StructType([items.schema[item], T.StructField("rank", T.IntegerType()), T.StructField(key, T.LongType()), T.StructField("score", T.LongType())])
    out = []
    for block in _blocks(items.where(F.col(text).isNotNull()).select(item, F.col(text).cast("binary").alias("body"))):
        wanted = sorted(set().union(*(terms for _, terms in block)))
        number = {t: k for k, t in enumerate(wanted)}
        weights = [weight(documents, df) for df in frequencies(index, wanted)]
        queries = [(q, [number[t] for t in terms]) for q, (_, terms) in enumerate(block)]
        names = spark.createDataFrame([(q, name) for q, (name, _) in enumerate(block)], T.StructType([T.StructField("q", T.LongType()), items.schema[item]]))
        hits = _merged(index.mapInArrow(_searched(queries, wanted, weights, top), _HITS), top)
        named = hits.join(F.broadcast(names), "q").select(item, "rank", F.col("id").alias(key), "score")
        out.append(materialise(named, "hits"))
    return spark.createDataFrame([], schema) if not out else out[0] if len(out) == 1 else _union(out)


def _union(tables: list[DataFrame]) -> DataFrame:
    """One table of many, in a balanced plan."""
    while len(tables) > 1:
        tables = [a.unionByName(b) for a, b in zip(tables[::2], tables[1::2])] + (tables[-1:] if len(tables) % 2 else [])
    return tables[0]


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    documents, all_terms = totals(docs)
    index = materialise(index_of(docs, documents, all_terms), "postings")
    return search(index, documents, table(spark, sf_dir, "benchmark"))


OP13_SQL = r"""with lower_docs as (select row_number() over () r, doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') x from documents where text is not null),
w as (select r, doc_id, unnest(regexp_extract_all(x, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) term from lower_docs),
tf as (select r, doc_id, term, count(*) tf from w group by all),
d as (select r, sum(tf)::bigint n from tf group by r),
c as (select count(*) big_n, sum(n)::bigint l from d),
m as (select r, 10 + ((90 * n * big_n) // l) m from d, c),
q as (select distinct i, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) term from (select row_number() over () i, * from benchmark)),
df as (select term, count(*) df from tf where term in (select term from q) group by term),
wt as (select term, floor(1000 * ln((2 * big_n + 2) / (2 * df + 1)))::bigint w from df, c),
s as (select q.i, q.item_id, tf.r, tf.doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::bigint score from q join wt using (term) join tf using (term) join m on m.r = tf.r group by all)
select item_id, rank, doc_id, score from (select *, row_number() over (partition by i order by score desc, doc_id, r)::int rank from s where score > 0) where rank <= 10"""

"""Source divergence audit: how far the words of each source of a language are from those of the others, in exact integers.

A term is a run of letters A to Z and characters beyond ASCII, with A to Z lower-cased. Each language keeps the terms that
enough of its documents hold. Tasks count terms by language and source and send on one row for each term; these are dealt
by ranges of (language, term), so that a task holds a sorted array of kept terms, a chunk of its language's dictionary. A
term's id is its place there, found by binary search; counts by source are one bincount over ids, a dense vector for each
source. Ids follow the UTF-8 order of terms and decide ties. Sums over all kept terms are sums over chunks.

p is 1 + floor(10^9 (count + 5) / (N + 5 V)): long division three digits at a time keeps it exact for N beyond 10^10. A
chunk's vectors are compared in blocks of ids, so memory follows the number of sources and not the dictionary.

Defined results: null text, language and source count as ''; a text without terms still makes its (language, source) occur;
repeated rows count each; a language that keeps no term has pairs of value 0 and no terms; a language of one source has no
pairs; an empty table gives an empty result; columns other than the three named are not read.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scorefabric.llm.common import materialise, table

#: Documents that must hold a kept term; what is added to each count; the scale of p; ranks of terms that are reported.
LEAST_DOCS, ADDED, SCALE, TOP = 30, 5, 1_000_000_000, 50

#: Bytes that separate terms become spaces, A to Z become a to z; all others stay.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

#: Counted terms that a task holds before it sends them on; rows of a chunk; numbers of a block of a chunk's vectors.
FLUSH, CHUNK_ROWS, BLOCK = 1 << 18, 1 << 17, 1 << 20

# ---- counts of terms by language and source ----

_COUNTS = "lang string, source string, term binary, n long, docs long"


def _flushed(groups: dict) -> pa.RecordBatch:
    rows = [(lang, source, term, n, held[term]) for (lang, source), (counts, held) in groups.items() for term, n in counts.items()]
    rows += [(lang, source, b"", 0, 0) for lang, source in groups]
    kinds = (pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["lang", "source", "term", "n", "docs"])


def _counted(batches):
    """For each (language, source): a term's occurrences and the documents with it, and the empty term, which marks the group."""
    groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    for b in batches:
        for lang, source, body in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
            counts, held = groups.setdefault((lang, source), (Counter(), Counter()))
            words = body.translate(TERM_BYTES).split()
            counts.update(words)
            held.update(set(words))
        if sum(len(counts) for counts, _ in groups.values()) > FLUSH:
            yield _flushed(groups)
            groups = {}
    if groups:
        yield _flushed(groups)


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): counts in each group; the empty term stands for the group itself."""
    body = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    counted = docs.select(*body).withColumn("text", F.col("text").cast("binary")).mapInArrow(_counted, _COUNTS)
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


# ---- chunks of the dictionaries ----

_CHUNKS = "lang string, chunk int, terms array<binary>, sources array<string>, totals array<long>, counts binary"


def _chunks(least: int):
    def cut(batches):
        rows = pa.Table.from_batches(list(batches)) if (batches := [b for b in batches if b.num_rows]) else None
        if rows is None:
            return
        lang = rows.column("lang").to_pylist()
        starts = [k for k in range(len(lang)) if k == 0 or lang[k] != lang[k - 1]]
        for start, end in zip(starts, [*starts[1:], len(lang)], strict=True):
            yield _chunk(lang[start], rows.slice(start, end - start), least)

    return cut


def _chunk(lang: str, rows: pa.Table, least: int) -> pa.RecordBatch:
    """One language's rows of a range of terms, sorted by term."""
    terms = np.array(rows.column("term").to_pylist(), dtype=object)
    n, held = (rows.column(c).to_numpy() for c in ("n", "docs"))
    first = np.flatnonzero(np.r_[True, terms[1:] != terms[:-1]])
    kept = terms[first[(np.add.reduceat(held, first) >= least) & (terms[first] != b"")]]
    names, source = np.unique(np.array(rows.column("source").to_pylist(), dtype=object), return_inverse=True)
    ids = np.searchsorted(kept, terms) if len(kept) else np.zeros(len(terms), np.int64)
    known = np.flatnonzero(kept[np.minimum(ids, len(kept) - 1)] == terms) if len(kept) else np.zeros(0, np.int64)
    counts = np.stack([np.bincount(ids[at], n[at], len(kept)).astype(np.int64) for at in (known[source[known] == s] for s in range(len(names)))])
    row = [lang, TaskContext.get().partitionId(), list(kept), list(names), counts.sum(axis=1).tolist(), counts.astype("<i8").tobytes()]
    kinds = (pa.string(), pa.int32(), pa.list_(pa.binary()), pa.list_(pa.string()), pa.list_(pa.int64()), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip(row, kinds, strict=True)], [x.split()[0] for x in _CHUNKS.split(", ")])


def chunks(counts: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """A row for each language and range of terms: its kept terms in order and, for each source that occurs there, the vector of their counts.

    counts should be written: it is read to find the ranges and again to be dealt.
    """
    parts = max(1, math.ceil(counts.count() / CHUNK_ROWS))
    return counts.repartitionByRange(parts, "lang", "term").sortWithinPartitions("lang", "term").mapInArrow(_chunks(least), _CHUNKS)


# ---- comparison ----

_PARTS = "lang string, source string, item string, value long, id long, pair boolean"


def shares(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (counts + ADDED) / total), where no count + ADDED exceeds its total, by long division to the base 1,000."""
    left, out = counts + ADDED, np.zeros_like(counts)
    out, left = left // total, left % total
    for _ in range(3):
        left = left * 1000
        out = out * 1000 + left // total
        left = left % total
    return out + 1


def _compared(top: int):
    def parts(batches):
        for b in batches:
            for row in b.to_pylist():
                yield from _compare(row, top)

    return parts


def _compare(row: dict, top: int):
    """The chunk's share of each pair's value, and each source's first terms in it."""
    lang, terms = row["lang"], row["terms"]
    names = sorted((g["source"], g["total"]) for g in row["groups"])
    place = {name: k for k, (name, _) in enumerate(names)}
    size = len(terms)
    here = np.frombuffer(row["counts"], "<i8").reshape(len(row["sources"]), size)
    at = [place[s] for s in row["sources"]]
    totals = np.array([n for _, n in names], np.int64)
    over = totals + ADDED * row["kept"]
    whole = int(totals.sum()) + ADDED * row["kept"]
    pair = np.zeros((len(names), len(names)), np.int64)
    first: list[list] = [[] for _ in names]
    step = max(1, BLOCK // len(names))
    for start in range(0, size, step):
        counts = np.zeros((len(names), min(step, size - start)), np.int64)
        counts[at] = here[:, start : start + step]
        p = shares(counts, over[:, None])
        q = shares(counts.sum(axis=0), np.int64(whole))
        for k in range(len(names) - 1):
            pair[k, k + 1 :] += np.abs(p[k + 1 :] - p[k]).sum(axis=1)
        for k in range(len(names)):
            more = np.flatnonzero((counts[k] > 0) & (p[k] > q))
            f = p[k][more] - q[more]
            best = more[_first(f, top)]
            first[k] += [(int(p[k][i] - q[i]), start + int(i)) for i in best]
    pair += pair.T
    out = [(lang, a, b, int(pair[k, j]), 0, True) for k, (a, _) in enumerate(names) for j, (b, _) in enumerate(names) if j != k]
    for k, (name, _) in enumerate(names):
        for f, i in sorted(first[k], key=lambda x: (-x[0], x[1]))[:top]:
            out.append((lang, name, terms[i].decode("utf-8", "replace"), f, row["chunk"] << 32 | i, False))
    kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_())
    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], [x.split()[0] for x in _PARTS.split(", ")])


def _first(values: np.ndarray, top: int) -> np.ndarray:
    """Places of the `top` greatest values, of equal ones the first."""
    if len(values) <= top:
        return np.arange(len(values))
    least = np.partition(values, len(values) - top)[len(values) - top]
    above = np.flatnonzero(values > least)
    return np.r_[above, np.flatnonzero(values == least)[: top - len(above)]]


#: A language's totals are joined to its chunks in so many parts.
SALTS = 64


def divergence(docs: DataFrame, least: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): `pair` ranks the other sources of the language, `term` the source's own terms."""
    counts = materialise(term_counts(docs), "terms")
    cut = materialise(chunks(counts, least), "chunks")
    totals = cut.select("lang", F.explode(F.arrays_zip("sources", "totals")).alias("g")).groupBy("lang", F.col("g.sources").alias("source")).agg(F.sum("g.totals").alias("total"))
    kept = cut.groupBy("lang").agg(F.sum(F.size("terms")).cast("long").alias("kept"))
    # a row for each source of a language; the result has one for each two of them
    groups = totals.groupBy("lang").agg(F.collect_list(F.struct("source", "total")).alias("groups")).join(kept, "lang")
    dealt = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    parts = materialise(cut.withColumn("_salt", F.col("chunk") % SALTS).join(dealt, ["lang", "_salt"]).drop("_salt").mapInArrow(_compared(top), _PARTS), "parts")
    pairs = parts.where("pair").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    by = Window.partitionBy("lang", "source")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(by.orderBy(F.desc("value"), "item")).alias("rank"))
    terms = parts.where("not pair").withColumn("rank", F.row_number().over(by.orderBy(F.desc("value"), "id"))).where(F.col("rank") <= top)
    return pairs.unionByName(terms.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


OP12_SQL = r"""with d as (select coalesce(text, '') x, coalesce(lang, '') lang, coalesce(source, '') source, row_number() over () r from documents),
w as (select r, lang, source, unnest(regexp_extract_all(x, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) t from d),
t as (select r, lang, source, translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') term from w),
kept as (select lang, term from t group by lang, term having count(distinct r) >= 30),
groups as (select distinct lang, source from d),
seen as (select lang, source, term, count(*) n from t semi join kept using (lang, term) group by all),
cells as (select g.lang, g.source, k.term, coalesce(s.n, 0) n from groups g join kept k on g.lang = k.lang left join seen s on s.lang = g.lang and s.source = g.source and s.term = k.term),
p as (select lang, source, term, n, (1 + (1000000000::hugeint * (n + 5)) // (sum(n) over (partition by lang, source) + 5 * count(*) over (partition by lang, source)))::bigint p from cells),
q as (select lang, term, (1 + (1000000000::hugeint * (sum(n) + 5)) // (sum(sum(n)) over (partition by lang) + 5 * count(*) over (partition by lang)))::bigint q from cells group by lang, term),
pair as (select a.lang, a.source, b.source item, sum(abs(a.p - b.p))::bigint v from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pairs as (select a.lang, a.source, b.source item, coalesce(v, 0) v from groups a join groups b on a.lang = b.lang and a.source <> b.source left join pair on pair.lang = a.lang and pair.source = a.source and pair.item = b.source),
terms as (select lang, source, term item, p - q v from p join q using (lang, term) where n > 0 and p > q),
r as (select 'pair' part, *, row_number() over (partition by lang, source order by v desc, item) k from pairs union all by name select 'term' part, *, row_number() over (partition by lang, source order by v desc, item) k from terms)
select lang, source, part, item, v "value", k::int rank from r where part = 'pair' or k <= 50"""

"""Exact dedup of a batch against history, by a minimal perfect hash over the history's distinct digests.

The digests of history, one row for each different one, are dealt over shards by their bits. A shard's task places its
digests in levels of bits: a digest that has a place of a level to itself stays there, the others try the next level, and
the number of set bits before a place is the digest's slot. A slot holds the full digest, the number of its rows and the
locator of its winner: doc_id, and the row of the written table of digests. A lookup finds the slot that a digest would
have and compares all of its bytes, so digests that history lacks are told apart; these nonmembers group by themselves.

What lookups and groups propose is then held to the texts: all texts of a repeated digest meet, one of each kind from a
task, and are compared byte for byte. Texts that share a digest and differ get digests of their own, and the lookups
run again; with SHA-256 no such texts are known.

Defined results: a null text counts as empty; a null doc_id counts as the least, and a group that has no other has a null
keep_id; of repeated rows that share the largest doc_id one stays; without history all rows group by themselves; an empty
table gives an empty result; columns other than the two named are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scorefabric.llm.common import materialise, release, semi_join, table

#: Digests of a shard, about: 64 bytes each in a slot.
SHARD = 1 << 16

#: Bits of a level for each digest that still has no place.
SPARE = 2

# ---- minimal perfect hash ----


def _words(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), "<u8").reshape(-1, 4)


def _mixed(words: np.ndarray, level: int) -> np.ndarray:
    """64 bits of each digest, others at each level; all of its bytes count."""
    h = np.full(len(words), (level + 1) * 0x9E3779B97F4A7C15 % (1 << 64), np.uint64)
    for k in range(4):
        h = (h ^ words[:, k]) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return h


def perfect(words: np.ndarray) -> tuple[list[int], np.ndarray]:
    """The bits of each level, counted and as flags, such that every digest (all are different) has a set bit of its own."""
    sizes, flags = [], []
    while len(words):
        size = SPARE * len(words) + 1
        at = (_mixed(words, len(sizes)) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(at, minlength=size) == 1
        sizes.append(size)
        flags.append(alone)
        words = words[~alone[at]]
    return sizes, np.concatenate(flags) if flags else np.zeros(0, bool)


def slots(words: np.ndarray, sizes: list[int], flags: np.ndarray) -> np.ndarray:
    """The slot of every digest; for one that the hash was not built for any slot, or -1."""
    before = np.cumsum(flags) - 1
    out, left, start = np.full(len(words), -1, np.int64), np.arange(len(words)), 0
    for level, size in enumerate(sizes):
        at = start + (_mixed(words[left], level) % np.uint64(size)).astype(np.int64)
        out[left[flags[at]]] = before[at[flags[at]]]
        left = left[~flags[at]]
        start += size
    return out


# ---- the index: a row for each shard ----

_INDEX = "_shard int, sizes array<long>, flags binary, digests binary, ids array<long>, rows array<long>, counts array<long>"


def _built(group: pa.Table) -> pa.Table:
    digests = group.column("digest").to_pylist()
    words = _words(digests)
    sizes, flags = perfect(words)
    order = np.argsort(slots(words, sizes, flags), kind="stable")  # a row for each slot, in order
    cells = group.take(pa.array(order))
    return pa.table({
        "_shard": group.column("_shard").slice(0, 1).combine_chunks(),
        "sizes": pa.array([sizes], pa.list_(pa.int64())),
        "flags": pa.array([np.packbits(flags).tobytes()], pa.binary()),
        "digests": pa.array([words[order].tobytes()], pa.binary()),
        "ids": pa.array([cells.column("id").to_pylist()], pa.list_(pa.int64())),
        "rows": pa.array([cells.column("row").to_pylist()], pa.list_(pa.int64())),
        "counts": pa.array([cells.column("n").to_pylist()], pa.list_(pa.int64())),
    })


def classes_of(rows: DataFrame) -> DataFrame:
    """(digest, id, row, n) for each digest of rows (row, id, digest): its winner and its number of rows; copies combine before the shuffle."""
    winner = F.coalesce(F.max_by("row", "id"), F.max("row"))
    return rows.groupBy("digest").agg(F.max("id").alias("id"), winner.alias("row"), F.count("*").alias("n"))


def _sharded(classes: DataFrame, shards: int) -> DataFrame:
    return classes.withColumn("_shard", F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int"))


def index_of(classes: DataFrame, shards: int) -> DataFrame:
    """The index over classes (digest, id, row, n) with different digests."""
    return _sharded(classes, shards).groupBy("_shard").applyInArrow(_built, _INDEX)


# ---- lookups ----

_CLASSES = "digest binary, id long, row long, n long, member boolean"


def _looked_up(index: pa.Table, asked: pa.Table) -> pa.Table:
    """The classes of a shard: every slot with what was added to it, then the nonmembers."""
    ask = {c: asked.column(c).to_pylist() for c in ("digest", "id", "row", "n")} if asked.num_rows else {c: [] for c in ("digest", "id", "row", "n")}
    held = {c: [] for c in ask}
    found = np.full(len(ask["digest"]), -1, np.int64)
    if index.num_rows:
        sizes = index.column("sizes")[0].as_py()
        flags = np.unpackbits(np.frombuffer(index.column("flags")[0].as_py(), np.uint8), count=sum(sizes)).astype(bool)
        words, wanted = np.frombuffer(index.column("digests")[0].as_py(), "<u8").reshape(-1, 4), _words(ask["digest"])
        at = slots(wanted, sizes, flags)
        found = np.where((at >= 0) & (words[at] == wanted).all(axis=1), at, -1)
        held = {"digest": [w.tobytes() for w in words], "id": index.column("ids")[0].as_py(), "row": index.column("rows")[0].as_py(), "n": index.column("counts")[0].as_py()}
        for k in np.flatnonzero(found >= 0):
            slot = found[k]
            held["n"][slot] += ask["n"][k]
            if _order(ask["id"][k], ask["row"][k]) > _order(held["id"][slot], held["row"][slot]):
                held["id"][slot], held["row"][slot] = ask["id"][k], ask["row"][k]
    new = np.flatnonzero(found < 0)
    out = {c: held[c] + [ask[c][k] for k in new] for c in ask}
    kinds = {"digest": pa.binary(), "id": pa.int64(), "row": pa.int64(), "n": pa.int64()}
    member = pa.array([True] * len(held["n"]) + [False] * len(new), pa.bool_())
    return pa.table({c: pa.array(out[c], kinds[c]) for c in out} | {"member": member})


def _order(key: int | None, row: int) -> tuple:
    """By which winners are told: a null key is the least; of equal keys the later row."""
    return (key is not None, key or 0, row)


def looked_up(index: DataFrame, classes: DataFrame, shards: int) -> DataFrame:
    """All classes after a batch: those of the index, its repeats added, and those of the batch alone (member false)."""
    return index.groupBy("_shard").cogroup(_sharded(classes, shards).groupBy("_shard")).applyInArrow(_looked_up, _CLASSES)


# ---- byte comparison ----

#: Tasks' representatives of a text meet in so many parts first.
PARTS = 64


def twins(bodies: DataFrame, repeated: DataFrame) -> DataFrame | None:
    """(digest, body, rank) of texts whose digest another text has, ranks from 1 (the least text keeps its digest); None if there are none.

    bodies: (digest, body). Equal texts become one row in each task; these meet in parts, and then by digest.
    """
    mine = semi_join(bodies.withColumn("_h", F.xxhash64("digest")), repeated.select(F.xxhash64("digest").alias("_h")), "_h")
    each = mine.withColumn("_part", F.pmod(F.spark_partition_id(), F.lit(PARTS))).select("digest", "body", "_part").distinct().select("digest", "body").distinct()
    many = materialise(each.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest"), "twins")
    if many.isEmpty():
        release(many)
        return None
    rank = F.row_number().over(Window.partitionBy("digest").orderBy("body")) - 1
    return materialise(each.join(many, "digest").withColumn("rank", rank).where("rank > 0"), "twins")


# ---- the operator ----


def sha(body: Column) -> Column:
    return F.unhex(F.sha2(body, 256))


#: A class with a part of 1 / 2^HOT of all rows, and LEAST_HOT rows, has its rows joined by broadcast: some 33,600 classes at most.
HOT, LEAST_HOT = 15, 1000


def deduplicated(docs: DataFrame, old: Column, key: str = "doc_id", text: str = "text", digest=sha) -> DataFrame:
    """(key, keep_id, group_size, kept, digest, member) of every row of docs: history, where `old` is true, and a batch.

    keep_id is the largest key among the rows of equal text; kept marks one row of each text. member says whether history
    has the text.
    """
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    base = docs.select(F.col(key).cast("long").alias("id"), body.alias("body"), F.coalesce(old, F.lit(False)).alias("old")).withColumn("digest", digest(F.col("body")))
    rows = materialise(base.select(F.monotonically_increasing_id().alias("row"), "id", "old", "digest", F.lit(None).cast("binary").alias("sha")), "digests")
    classes = _proposed(rows)
    apart = twins(base.select("digest", "body"), classes.where("n > 1"))
    if apart is not None:
        ranked = base.join(apart, ["digest", "body"], "left").withColumn("sha", F.col("digest"))
        own = F.when(F.col("rank").isNull(), F.col("digest")).otherwise(digest(F.concat(F.col("digest"), F.lit("-").cast("binary"), F.col("rank").cast("string").cast("binary"), F.sha2("body", 512).cast("binary"))))
        rows = materialise(ranked.select(F.monotonically_increasing_id().alias("row"), "id", "old", own.alias("digest"), "sha"), "digests")
        classes = _proposed(rows)
    return _joined(rows, classes).select(F.col("id").alias(key), "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.coalesce("sha", "digest").alias("digest"), "member")


def _proposed(rows: DataFrame) -> DataFrame:
    """The classes of all rows: those of history are indexed, those of the batch looked up."""
    history = materialise(classes_of(rows.where("old")), "history")
    batch = materialise(classes_of(rows.where("not old")), "batch")
    shards = -(-max(history.count(), batch.count(), 1) // SHARD)
    index = materialise(index_of(history, shards), "index")
    classes = materialise(looked_up(index, batch, shards), "classes")
    release(history, batch)
    return classes


def _joined(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Every row with its class. Rows of hot classes meet theirs by broadcast, and other classes have few rows each."""
    most = max(LEAST_HOT, rows.count() >> HOT)
    found = classes.select("digest", F.col("id").alias("keep_id"), F.col("row").alias("keep_row"), F.col("n").alias("group_size"), "member")
    hot = F.broadcast(found.where(F.col("group_size") >= most))
    rest = rows.join(hot.select("digest"), "digest", "left_anti").join(found.where(F.col("group_size") < most), "digest")
    return rows.join(hot, "digest").unionByName(rest)


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History is the half of documents with the larger doc_ids, so that what a slot names as winner is the row that stays."""
    docs = table(spark, sf_dir, "documents")
    middle = docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), 0.5)).first()[0]
    found = deduplicated(docs, F.col("doc_id") >= F.lit(middle).cast("long"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP11_SQL = """select doc_id, max(doc_id) over g keep_id, count(*) over g group_size, doc_id = max(doc_id) over g kept, sha256(coalesce(text, '')) text_sha256
from documents window g as (partition by coalesce(text, ''))"""

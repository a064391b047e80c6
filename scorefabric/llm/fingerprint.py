"""Document fingerprints: an exact digest of the canonical text.

The canonical text is NFKC, case-folded, NFKC again, with every run of white space one space and none at the ends. Its
128-bit xxh3 hash in hex is the fingerprint. Texts whose hashes are equal are compared byte for byte, and edited texts,
which no table holds, by the SHA-256 of their bytes, with each other and with the texts. Where a bucket holds different
canonical texts, each but the first by that digest gets its rank there as a suffix, so equal fingerprints mean equal
canonical texts.

Defined results: a null text counts as empty; repeated rows each give their row; a null doc_id sorts below all others;
an empty table gives an empty result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import unicodedata

import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorefabric.llm.common import materialise, may_repeat, parts_for, repeated_bits, table, tune


def canonical(text: str | None) -> bytes:
    """The bytes on which fingerprints are defined."""
    text = text or ""
    if text.isascii():
        return " ".join(text.lower().split()).encode()
    text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(text.split()).encode("utf-8", "surrogatepass")


def digest(canon: bytes) -> str:
    return xxhash.xxh3_128_hexdigest(canon)


def edited(text: str, following: str) -> str:
    """text with its last floor(n/2) code points replaced by the first as many of the following text."""
    k = len(text) // 2
    return text[: len(text) - k] + following[:k]


# ---- exactness: byte comparison inside equal buckets ----


def collisions(docs: DataFrame, text: str = "text") -> DataFrame:
    """(fingerprint0, canon_sha) of canonical texts that share a hash with a different one.

    A first pass counts 64 bits of each hash; only texts whose bits may repeat go on and are compared by their bytes
    within equal hashes. Equal texts combine before the shuffle, so a bucket with a third of all rows costs a row per task.
    """
    low = docs.select(text).mapInPandas(lambda it: (pd.DataFrame({"h": [_low(digest(canonical(x))) for x in b[text]]}) for b in it), "h long")
    bits = repeated_bits(low, "h")

    def repeats(batches):
        import numpy as np

        words = np.frombuffer(bits, "<u4")
        for b in batches:
            rows = []
            for x in b[text]:
                c = canonical(x)
                d = digest(c)
                if may_repeat(words, np.array([_low(d)]).view(np.uint64))[0]:
                    rows.append((d, c))
            yield pd.DataFrame(rows, columns=["fingerprint0", "canon"])

    same = docs.select(text).mapInPandas(repeats, "fingerprint0 string, canon binary")
    # Equal bytes become one row in each task, so what meets under one hash is a row for each different text.
    each = materialise(same.distinct(), "same")
    two = each.groupBy("fingerprint0").agg(F.min("canon").alias("low"), F.max("canon").alias("high")).where("low <> high").select("fingerprint0")
    return each.join(two, "fingerprint0").select("fingerprint0", F.unhex(F.sha2("canon", 256)).alias("canon_sha"))


def collisions_by_digest(pairs: DataFrame) -> DataFrame:
    """The distinct rows of pairs (fingerprint0, canon_sha; written or cheap to read twice) whose hash stands for two digests."""
    two = pairs.groupBy("fingerprint0").agg(F.min("canon_sha").alias("low"), F.max("canon_sha").alias("high")).where("low <> high").select("fingerprint0")
    return pairs.join(two, "fingerprint0", "left_semi").distinct()


def _low(hexed: str) -> int:
    """The low 64 bits as a signed long."""
    v = int(hexed[16:], 16)
    return v - (1 << 64) if v >> 63 else v


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint) of every row."""
    tune(docs.sparkSession)

    def each(batches):
        for b in batches:
            canon = [canonical(x) for x in b[text]]
            yield pd.DataFrame({key: b[key], "fingerprint0": [digest(c) for c in canon], "canon_sha": [hashlib.sha256(c).digest() for c in canon]})

    base = docs.select(key, text).mapInPandas(each, T.StructType([docs.schema[key], T.StructField("fingerprint0", T.StringType()), T.StructField("canon_sha", T.BinaryType())]))
    return ranked(base, collisions(docs, text)).select(key, "fingerprint")


def ranked(base: DataFrame, found: DataFrame, hash_col: str = "fingerprint0", sha_col: str = "canon_sha", out: str = "fingerprint") -> DataFrame:
    """Add the rank suffix; found is empty unless 128-bit hashes collide, which adaptive execution sees before it joins."""
    rank = F.row_number().over(Window.partitionBy("fingerprint0").orderBy("canon_sha")) - 1
    marks = found.select("fingerprint0", "canon_sha").distinct().withColumn("rank", rank).where("rank > 0").select(F.col("fingerprint0").alias("_h"), F.col("canon_sha").alias("_s"), "rank")
    return base.join(marks, (base[hash_col] == F.col("_h")) & (base[sha_col] == F.col("_s")), "left").withColumn(out, F.concat(F.col(hash_col), F.when(F.col("rank") > 0, F.concat(F.lit("-"), F.col("rank").cast("string"))).otherwise(F.lit("")))).drop("_h", "_s", "rank")


# ---- the comparison of each text with its edited form and with the next text ----

_ROW = "kind int, pid int, doc_id long, n_chars long, edited_sha256 string, fingerprint0 string, canon_sha binary, e_fingerprint0 string, e_canon_sha binary, near_edited double, near_next double, text string"


def _compare(doc_id, text: str, following: str) -> tuple:
    e = edited(text, following)
    c, ec, nc = canonical(text), canonical(e), canonical(following)
    return (doc_id, len(text), hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest(), digest(c), hashlib.sha256(c).digest(), digest(ec), hashlib.sha256(ec).digest(), float(c == ec), float(c == nc))


def _frame(rows: list[tuple]) -> pd.DataFrame:
    names = [x.split()[0] for x in _ROW.split(", ")]
    out = pd.DataFrame(rows, columns=names)
    for name in ("doc_id", "n_chars"):
        out[name] = out[name].astype("Int64")
    return out


def _walk(batches):
    """Rows in descending doc_id: compares each with the one after it; the ends of a partition go out with their texts (kind 1: head, 2: tail)."""
    pid, last, head = TaskContext.get().partitionId(), None, True
    blank = (None,) * 8
    for b in batches:
        rows = []
        for doc_id, text in zip(b["doc_id"], b["text"], strict=True):
            doc_id = None if pd.isna(doc_id) else int(doc_id)
            if last is not None:
                rows.append((0, pid, *_compare(*last, text), None))
            if head:
                rows.append((1, pid, doc_id, *blank, text))
                head = False
            last = (doc_id, text)
        if rows:
            yield _frame(rows)
    if last is not None:
        yield _frame([(2, pid, last[0], *blank, last[1])])


def successive(docs: DataFrame) -> DataFrame:
    """Per row: n_chars, the hashes of its text and of its edited text, and the likeness to the edited and to the next text.

    One range shuffle of (doc_id, text); the next text is then the next row. The first and the last row of each
    partition are matched afterwards, two rows a partition.
    """
    spark = tune(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("text").asc()]
    walked = materialise(rows.repartitionByRange(parts_for(rows), F.col("doc_id").desc_nulls_last()).sortWithinPartitions(*order).mapInPandas(_walk, _ROW), "fingerprints")
    pids = sorted(r.pid for r in walked.where("kind = 2").select("pid").collect())  # a row a partition
    after = spark.createDataFrame([(a, b) for a, b in zip(pids, pids[1:] + pids[:1], strict=True)], "pid int, next_pid int")
    ends = (
        walked.where("kind = 2").select("pid", "doc_id", "text").join(after, "pid")
        .join(walked.where("kind = 1").select(F.col("pid").alias("next_pid"), F.col("text").alias("following")), "next_pid")
        .select("doc_id", "text", "following")
        .mapInPandas(lambda it: (_frame([(0, 0, *_compare(None if pd.isna(i) else int(i), t, f), None) for i, t, f in zip(b["doc_id"], b["text"], b["following"], strict=True)]) for b in it), _ROW)
    )
    return walked.where("kind = 0").unionByName(ends).drop("kind", "pid", "text")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    base = successive(docs)
    pairs = base.select("fingerprint0", "canon_sha").union(base.select("e_fingerprint0", "e_canon_sha"))
    # a row only where 128-bit hashes of different texts, edited ones among them, are equal
    found = materialise(collisions(docs).union(collisions_by_digest(pairs)), "collisions")
    out = ranked(base, found)
    out = ranked(out.withColumnRenamed("fingerprint", "_f"), found, "e_fingerprint0", "e_canon_sha", "edited_fingerprint").withColumnRenamed("_f", "fingerprint")
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")

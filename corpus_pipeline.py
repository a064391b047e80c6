"""A corpus pipeline of documents: toxic documents go, near copies keep one, repeated passages are cut, the rest is packed.

Each stage takes (spark, docs, sf_dir), works on all rows of docs and returns a DataFrame; it is written as Parquet and
read again before the next one. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorefabric.llm.common import materialise, table
from scorefabric.llm.jaccard import keep_one
from scorefabric.llm.packing import pieces, place, vocabulary
from scorefabric.llm.suffix import kept_texts
from scorefabric.llm.toxicity import THRESHOLD, scores, train

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below the threshold; labels of held-out documents are not learnt from.

    Every row is judged by its text alone: null and empty texts have a score too, repeated rows go or stay together,
    rows with a null doc_id are scored and never learnt from. An empty table gives no rows. Columns beyond those of
    documents are left out.
    """
    model = train(docs, table(spark, sf_dir, "labels"))
    return scores(docs, model, keep=COLUMNS).where(F.col("score") < THRESHOLD).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near copies (five-word shingles, similarity 0.8 or more): that of least doc_id, null last.

    Rows are told apart by themselves and not by doc_id, so rows that share a doc_id, or have none, lose no other text; of
    repeated rows one stays. Null and empty texts are no copies of each other and all stay. An empty table gives no rows.
    """
    return keep_one(docs.select(*COLUMNS), words=5, percent=80)


#: Bytes of a string that counts as a repeated passage: 51 words of prose have more (237 the shortest seen in four
#: languages). Passages of over 50 words of two or three letters can be shorter, and then stay.
PASSAGE = 200


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the bytes of passages that occur elsewhere too; n_chars follows the text.

    Every row stays. Null and short texts are as they were; rows whose texts are equal lose all that is long enough, since
    each repeats the other; a character that a cut divides goes whole. An empty table gives no rows.
    """
    cut = kept_texts(docs, length=PASSAGE).select(F.col("sha256").alias("_sha"), "kept_text")
    out = docs.withColumn("_sha", F.sha2("text", 256)).join(cut, "_sha", "left")
    changed = F.col("kept_text").isNotNull()
    return out.select("doc_id", F.coalesce("kept_text", "text").alias("text"), "lang", "source", F.when(changed, F.length("kept_text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences.

    Null and empty texts are an end id alone; repeated rows and rows with a null doc_id are packed each; an empty table
    gives no pieces.
    """
    return place(materialise(pieces(docs, vocabulary("byte_bpe_50k.json")), "pieces"))


STAGES = [("toxicity", toxicity), ("near_copies", near_copies), ("repeated_passages", repeated_passages), ("packing", packing)]

#: None: no SQL gives a trained score or the library's token ids; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""What the operators of this subpackage share: tables in the shared folder, bounded bit sketches, column names."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that one Arrow batch carries to Python: texts of up to 20,000 words stay within tens of MB.
BATCH_ROWS = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; a temporary one only where it is unset and the master is local."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        at = _own.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="scorefabric-"))
    return at


_own: dict[str, str] = {}


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver's JVM ends."""
    at = f"{shared_dir(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"
    path, files = _files(spark, at)
    files.deleteOnExit(path)
    return at


def _files(spark: SparkSession, at: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


#: Spark's own option that removes a write's shuffle files once it has ended.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, name: str, codec: str = "zstd", partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut and lost executors cost one stage at most."""
    spark = df.sparkSession
    at = fresh_path(spark, name)
    writer = df.write.option("compression", codec)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    was = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        writer.parquet(at)
    finally:
        spark.conf.unset(_CLEAN) if was is None else spark.conf.set(_CLEAN, was)
    out = spark.read.schema(df.schema).parquet(at)
    out._written = at
    return out


def release(*tables: DataFrame) -> None:
    """Remove written tables that nothing reads any more; other DataFrames are left alone."""
    for df in tables:
        at = getattr(df, "_written", None)
        if at:
            path, files = _files(df.sparkSession, at)
            files.delete(path, True)


#: Rows of a semi-join's list up to which it is broadcast: 16 bytes each.
BROADCAST_ROWS = 1 << 20


def semi_join(rows: DataFrame, wanted: DataFrame, column: str) -> DataFrame:
    """The rows whose column is in wanted (written or otherwise cheap to read twice); broadcast only where wanted is counted small."""
    wanted = wanted.select(column).distinct()
    small = wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(wanted) if small else wanted, column, "left_semi")


def tune(spark: SparkSession) -> SparkSession:
    """Bound the rows of an Arrow batch."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(text: str = "text") -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


#: Bytes of text that a byte of a compressed file holds, about.
UNPACKED = 4


def parts_for(df: DataFrame, column: str = "text", target: int = 16 << 20, least: int | None = None) -> int:
    """Partitions such that each holds about `target` bytes of the column; at least `least`, or as many as the session's shuffles have.

    The bytes are those of the files that df reads, as the optimizer knows them, and counted where it doesn't.
    """
    known = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) * UNPACKED if df.inputFiles() else 0
    total = known if 0 < known < 1 << 60 else df.agg(F.sum(F.octet_length(column))).first()[0] or 0
    return max(math.ceil(total / target), least or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)


#: The bit map of digests that may repeat has some 16 bits for each, 2^16 to 2^27 (16 MB) in all. Beyond some ten million
#: repeats it lets more and more others through; they cost time, and results stay the same.
LEAST_BITS, MOST_BITS, BITS_EACH = 16, 27, 16


def repeated_bits(digests: DataFrame, column: str, least: int = 2) -> bytes:
    """A bit map with the digests that occur `least` times or more (false positives are possible, misses are not).

    The digest column holds longs. Counting is distributed with partial sums; the digests that repeat are written, and the
    map is as large as their number asks for, up to a bound: 2^MOST_BITS / 32 rows reach the driver at most.
    """
    import numpy as np

    found = materialise(digests.groupBy(column).count().where(F.col("count") >= least).select(column), "repeated")
    size = min(MOST_BITS, max(LEAST_BITS, (BITS_EACH * found.count()).bit_length()))
    bit = F.col(column).bitwiseAND(F.lit((1 << size) - 1))
    words = found.groupBy(F.shiftright(bit, 5).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(F.lit(31)).cast("int"))).alias("bits"))
    out = np.zeros(1 << (size - 5), dtype="<u4")
    for word, bits in words.toLocalIterator():
        out[word] = bits
    release(found)
    return out.tobytes()


def may_repeat(bits, values):
    """For uint64 digests: whether the bit map, as 32-bit words, has them."""
    import numpy as np

    low = values & np.uint64(32 * len(bits) - 1)
    return (bits[(low >> np.uint64(5)).astype(np.int64)] >> (low & np.uint64(31)).astype(np.uint32)) & np.uint32(1) != 0

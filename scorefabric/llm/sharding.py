"""Sharding by a minimax contiguous partition, in DataFrame functions alone.

Equal texts are one atomic group. Groups stand in the order of their text's SHA-256 digest, and shards are runs of that
order. The capacity is the smallest for which greedy filling needs no more than the given number of shards; binary
search finds it, and the cuts are then made within it, each as near its even share as the capacity allows, so that a
group larger than the even share does not leave the last shards empty.

The greedy check needs, for a capacity, the last group end within reach of each cut. Group ends are summed up in cells of
the byte line (least and greatest end, count) whose width is a power of two; a cell with two ends at most is exact, and
the search refines together all cells that its checks land in, so the driver holds some CELLS rows at a time whatever
the number of groups, and asks for them a few times. Running sums come from ranges of digests, as many as the groups
need, whose totals are added up. A row's shard follows from its digest and the cut digests without a join; its slot from
its rank in one of SALTS parts of the shard.

Defined results: a null text has size 16 and forms a group of its own; repeated rows are members of their group; a null
doc_id takes a slot as any other; fewer groups than shards leave shards empty; an empty table gives no rows; columns
other than the key and the text are not read.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scorefabric.llm.common import materialise, table

SHARDS, OVERHEAD = 40, 16
CELLS, SALTS = 1 << 15, 1024
#: Groups that one range of digests holds, about.
RANGE_GROUPS = 1 << 17


def sized(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, size, text_crc32, digest): the digest of a null text differs from that of the empty text."""
    raw = F.coalesce(F.encode(text, "UTF-8"), F.lit(b""))
    digest = F.when(F.col(text).isNull(), F.lit("null")).otherwise(F.sha2(raw, 256))
    return docs.select(F.col(key), (F.length(raw) + OVERHEAD).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), digest.alias("digest"))


def group_ends(rows: DataFrame) -> DataFrame:
    """(digest, size, end): groups in digest order with the running sum of sizes; ranges are digest prefixes of even weight."""
    groups = materialise(rows.groupBy("digest").agg(F.sum("size").alias("size")), "groups")
    bits = max(6, (groups.count() // RANGE_GROUPS).bit_length())
    # a range is the first bits of the digest; the group of null texts, whose digest is no number, comes last
    head = F.coalesce(F.conv(F.substring("digest", 1, 8), 16, 10).cast("long"), F.lit((1 << 32) - 1))
    held = groups.withColumn("range", F.shiftright(head, 32 - bits))
    # a row for each range
    before = held.groupBy("range").agg(F.sum("size").alias("total")).withColumn("before", F.sum("total").over(Window.orderBy("range")) - F.col("total")).drop("total")
    inside = F.sum("size").over(Window.partitionBy("range").orderBy("digest").rowsBetween(Window.unboundedPreceding, 0))
    return held.withColumn("inside", inside).join(before, "range").select("digest", "size", (F.col("before") + F.col("inside")).alias("end"))


class Ends:
    """The group ends on the byte line, in cells (least, greatest, count, shift) of 2^shift bytes; refined where asked."""

    def __init__(self, ends: DataFrame):
        self.ends = ends
        got = ends.agg(F.max("end"), F.max("size")).first()
        self.total, self.largest = got[0] or 0, got[1] or 0
        self.cells: list[tuple[int, int, int, int]] = []
        self.missing: set[int] = set()
        if self.total:
            shift = max(0, self.total.bit_length() - CELLS.bit_length() + 1)
            self._hold(self._summed({self.total.bit_length(): [0]}, shift))

    def _summed(self, windows: dict[int, list[int]], shift: int | None = None) -> list[tuple[int, int, int, int]]:
        """Cells of the ends in the windows {shift: numbers}, each cut evenly into 2^k of them."""
        k = max(1, (CELLS // sum(map(len, windows.values()))).bit_length() - 1)
        cell = to = F.lit(None).cast("long")
        for wide, numbers in sorted(windows.items()):  # a few widths at most
            finer = max(0, wide - k) if shift is None else shift
            inside = F.shiftright("end", wide).isin(numbers)
            cell, to = F.when(inside, F.shiftright("end", finer)).otherwise(cell), F.when(inside, F.lit(finer)).otherwise(to)
        rows = self.ends.select("end", cell.alias("cell"), to.alias("to")).where("cell is not null").groupBy("to", "cell")
        return [(r.low, r.high, r.n, r.to) for r in rows.agg(F.min("end").alias("low"), F.max("end").alias("high"), F.count(F.lit(1)).alias("n")).collect()]

    def _hold(self, cells: list[tuple[int, int, int, int]]) -> None:
        self.cells = sorted(cells)
        self.lows = [c[0] for c in self.cells]

    def settled(self, search):
        """The result of a search, repeated with finer cells until it lands in exact ones alone."""
        while True:
            self.missing = set()
            out = search()
            if not self.missing:
                return out
            windows: dict[int, list[int]] = {}
            for i in sorted(self.missing)[: CELLS // 2]:
                low, _, _, shift = self.cells[i]
                windows.setdefault(shift, []).append(low >> shift)
            fresh = self._summed(windows)
            gone = {(k, n) for k, numbers in windows.items() for n in numbers}
            self._hold([c for c in self.cells if (c[3], c[0] >> c[3]) not in gone] + fresh)

    def floor(self, x: int) -> tuple[int, int]:
        """(surely reached, perhaps reached): bounds of the greatest end <= x; notes a cell that is not exact."""
        i = bisect_right(self.lows, x) - 1
        if i < 0:
            return 0, 0
        low, high, n, _ = self.cells[i]
        if x >= high:
            return high, high
        if n <= 2:  # least and greatest are all there is
            return low, low
        self.missing.add(i)
        return low, x

    def ceil(self, x: int) -> int:
        """The least end >= x, or a bound of it where a cell is not exact; x is at most the total."""
        i = bisect_right(self.lows, x) - 1
        if i < 0 or x > self.cells[i][1]:
            return self.cells[i + 1][0]
        low, high, n, _ = self.cells[i]
        if x == low or x == high:
            return x
        if n > 2:
            self.missing.add(i)
        return high

    def _fill(self, capacity: int, shards: int, sure: bool) -> bool:
        """Whether greedy filling reaches the end, by sure or by hopeful steps."""
        at = 0
        for _ in range(shards):
            to = self.floor(at + capacity)[0 if sure else 1]
            if to <= at:
                return False
            at = to
            if at >= self.total:
                return True
        return False

    def capacity(self, shards: int) -> int:
        """The smallest feasible capacity, exactly."""
        if not self.total:
            return 0
        least = max(self.largest, -(-self.total // shards)) - 1  # infeasible
        most = min(self.total, least + 1 + self.largest)  # feasible: greedy filling leaves less than one group of room

        def halve(low: int, high: int, sure: bool) -> int:
            while high - low > 1:
                mid = (low + high) // 2
                low, high = (low, mid) if self._fill(mid, shards, sure) else (mid, high)
            return high

        def search() -> int:
            hopeful = halve(least, most, False)  # nothing below it is feasible
            sure = halve(hopeful - 1, most, True)
            self.missing.clear()
            if sure > hopeful:
                for c in {hopeful, (hopeful + sure) // 2, sure - 1}:
                    self._fill(c, shards, True)
                    self._fill(c, shards, False)
            return sure

        return self.settled(search)

    def cuts(self, shards: int) -> list[int]:
        """Ends of the shards: each near its even share, none above the capacity, the rest always packable."""
        if not self.total:
            return [0] * shards
        c = self.capacity(shards)

        def search() -> list[int]:
            # from the right: the least position from which k shards of the capacity reach the end
            need = [self.total]
            for _ in range(shards - 1):
                back = need[-1] - c
                need.append(0 if back <= 0 else self.ceil(back))
            out, at = [], 0
            for k in range(1, shards):
                even = self.total * k // shards
                x, y = self.floor(even)[0], self.ceil(even)
                want = max(y if y - even < even - x else x, need[shards - k], at)
                if want - at > c:
                    want = self.floor(at + c)[0]
                out.append(want)
                at = want
            return [*out, self.total]

        return self.settled(search)


def shard(docs: DataFrame, shards: int = SHARDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, size, text_crc32, shard, slot) of every row."""
    rows = materialise(sized(docs, key, text), "rows")
    ends = materialise(group_ends(rows), "ends")
    cuts = Ends(ends).cuts(shards)
    # the digest of each cut's last group: a shard holds the digests above the cut before it and up to its own
    named = {r["end"]: r["digest"] for r in ends.where(F.col("end").isin(sorted(set(cuts)))).collect()}  # a row a shard at most
    bounds = [named.get(c, "") for c in cuts[:-1]]
    own = F.lit(0)
    for b in bounds:
        own = own + (F.col("digest") > b).cast("int")
    placed = rows.withColumn("shard", own).withColumn("_salt", F.pmod(F.xxhash64(key, "digest"), F.lit(SALTS)))
    before = placed.groupBy("shard", "_salt").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.sum("_n").over(Window.partitionBy("shard").orderBy("_salt")) - F.col("_n")).drop("_n")
    rank = F.row_number().over(Window.partitionBy("shard", "_salt").orderBy(key, "digest")) - 1
    return placed.withColumn("_rank", rank).join(before, ["shard", "_salt"]).select(key, "size", "text_crc32", "shard", (F.col("_before") + F.col("_rank")).cast("long").alias("slot"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

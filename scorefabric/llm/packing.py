"""Best-fit packing by bin completion.

Documents are cut into pieces of at most `capacity` tokens, and pieces packed into as few sequences as the search
finds. Pieces of one length are interchangeable, so the search works on the counts of lengths: at most `capacity`
numbers reach the driver, whatever the size of the input, and each pattern it chooses holds for many sequences at
once. Around the largest length that is left, bin completion enumerates fillings that no other filling dominates;
waste bounds prune; a best-fit-decreasing packing is the first incumbent, and the search ends at the lower bound
or when its budget of nodes is spent, with the best packing found. Pieces then take places by their rank
within their length, which salted counts give without bringing a length together in one task.

Defined results: a null text is empty and so one end id; repeated rows are packed each; a null doc_id is kept; an empty
table gives no piece; columns other than the key and the text are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scorefabric.llm.common import materialise, table, tune
from scorefabric.llm.tokens import encoder, with_end

CAPACITY = 2048
#: Bins that the search completes in all, and fillings that one bin tries.
NODES, BRANCH = 20_000, 6
_STEPS = 400  # partial fillings looked at for one bin


# ---- the search ----


def dominates(a: tuple[int, ...], b: tuple[int, ...]) -> bool:
    """Whether filling a is at least as good as b: the items of b fit, in subsets, into the items of a."""
    if not b:
        return True
    rest = sorted(a, reverse=True)

    def place(k: int) -> bool:
        if k == len(b):
            return True
        tried = set()
        for i, room in enumerate(rest):
            if room >= b[k] and room not in tried:
                tried.add(room)
                rest[i] -= b[k]
                if place(k + 1):
                    return True
                rest[i] += b[k]
        return False

    return sum(a) >= sum(b) and place(0)


def fillings(room: int, lengths: list[int], count: dict[int, int], most_waste: int) -> list[tuple[int, ...]]:
    """Undominated fillings of room, least waste first. lengths ascend; count has how many are left of each."""
    found: list[tuple[int, ...]] = []
    steps = 0
    best = room + 1

    def walk(left: int, at: int, chosen: list[int]) -> None:
        nonlocal steps, best
        steps += 1
        if steps > _STEPS or best == 0 and len(found) >= BRANCH:
            return
        i = bisect_right(lengths, min(left, at)) - 1
        fits = False
        for j in range(i, max(-1, i - 12), -1):
            x = lengths[j]
            if chosen.count(x) < count[x]:
                fits = True
                chosen.append(x)
                walk(left - x, x, chosen)
                chosen.pop()
                if left == x:  # an exact item dominates every other choice here
                    break
        if not fits and left <= max(most_waste, best):
            best = min(best, left)
            found.append(tuple(chosen))

    if lengths:
        walk(room, room, [])
    found.sort(key=lambda f: (-sum(f), len(f)))
    out: list[tuple[int, ...]] = []
    for f in dict.fromkeys(found):
        if len(f) <= 6 and any(len(o) <= 6 and dominates(o, f) for o in out):
            continue
        out.append(f)
        if len(out) == BRANCH:
            break
    return out or [()]


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of a best-fit-decreasing packing, by counts: open sequences of equal contents and room are one entry."""
    open_at: dict[int, Counter] = {}
    for x in sorted(counts, reverse=True):
        n = counts[x]
        while n:
            room = min((r for r in open_at if r >= x), default=None)
            if room is None:
                each = min(capacity // x, n)
                whole, n_left = divmod(n, each)
                open_at.setdefault(capacity - each * x, Counter())[(x,) * each] += whole
                n = n_left
                continue
            pattern, m = next(iter(open_at[room].items()))
            each = min(room // x, n)
            k = min(m, n // each)
            open_at[room][pattern] -= k
            if not open_at[room][pattern]:
                del open_at[room][pattern]
                if not open_at[room]:
                    del open_at[room]
            open_at.setdefault(room - each * x, Counter())[(*pattern, *(x,) * each)] += k
            n -= k * each
    return [(p, m) for by in open_at.values() for p, m in by.items()]


def plan(counts: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths, number of sequences) that hold every piece once, in as few sequences as the search finds."""
    counts = {int(k): int(v) for k, v in counts.items() if v}
    if not counts:
        return []
    if min(counts) < 1 or max(counts) > capacity:
        raise ValueError("lengths must be from 1 to the capacity")
    total = sum(k * v for k, v in counts.items())
    # No two items over half the capacity share a sequence: with the volume, a lower bound.
    bound = max(-(-total // capacity), sum(v for k, v in counts.items() if 2 * k > capacity))
    best = best_fit_decreasing(counts, capacity)
    best_n = sum(m for _, m in best)
    left_nodes = nodes

    # Depth first, fillings of least waste first: a stack of (rest, patterns so far, sequences so far, waste so far).
    stack = [(counts, None, 0, 0)]
    while stack and best_n > bound and left_nodes:
        rest, chain_, used, waste = stack.pop()
        while left_nodes:
            left_nodes -= 1
            if not rest:
                if used < best_n:
                    best, best_n = [], used
                    while chain_:
                        (p, m), chain_ = chain_
                        best.append((p, m))
                break
            allowed = (best_n - 1) * capacity - total - waste  # more waste than this can't beat the incumbent
            if allowed < 0:
                break
            x = max(rest)
            less = dict(rest)
            less[x] -= 1
            lengths = sorted(k for k, v in less.items() if v)
            options = fillings(capacity - x, lengths, less, allowed)
            nexts = []
            for f in options:
                p = (x, *f)
                need = Counter(p)
                m = min(rest[k] // v for k, v in need.items())
                lost = (capacity - sum(p)) * m
                after = {k: v - need.get(k, 0) * m for k, v in rest.items()}
                after = {k: v for k, v in after.items() if v}
                if lost <= allowed or not after:
                    nexts.append((after, ((p, m), chain_), used + m, waste + lost))
            if not nexts:
                break
            for y in reversed(nexts[1:]):
                stack.append(y)
            if len(stack) > 4 * nodes:
                del stack[: len(stack) - 4 * nodes]
            rest, chain_, used, waste = nexts[0]
    return [(tuple(sorted(p, reverse=True)), m) for p, m in best]


# ---- pieces and their places ----


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """(key, piece, start, length, ids_crc32[, ids]): documents cut so that only the first piece may be short."""
    tune(docs.sparkSession)

    def cut(batches):
        enc = encoder(tokenizer)
        for b in batches:
            ids, off = with_end(*enc.encode(b[text].tolist()), end_id)
            ids = ids.astype("<u4")
            n = np.diff(off)
            k = -(-n // capacity)
            doc = np.repeat(np.arange(len(n)), k)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(k) - k, k)
            first = n - (k - 1) * capacity
            start = np.where(piece == 0, 0, first[doc] + (piece - 1) * capacity)
            length = np.where(piece == 0, first[doc], capacity)
            at = off[doc] + start
            raw = memoryview(ids).cast("B")
            out = pd.DataFrame({key: b[key].to_numpy()[doc], "piece": piece.astype("int32"), "start": start, "length": length, "ids_crc32": [zlib.crc32(raw[4 * i : 4 * (i + m)]) for i, m in zip(at.tolist(), length.tolist(), strict=True)]})
            if with_ids:
                out["ids"] = [bytes(raw[4 * i : 4 * (i + m)]) for i, m in zip(at.tolist(), length.tolist(), strict=True)]
            yield out.astype({key: "Int64"})

    return docs.select(F.col(key).cast("long").alias(key), text).mapInPandas(cut, f"{key} long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def place(cut: DataFrame, capacity: int = CAPACITY, key: str = "doc_id", nodes: int = NODES) -> DataFrame:
    """cut (with a column length; written or otherwise cheap to read twice) with sequence_id and offset."""
    spark = cut.sparkSession
    counts = {r.length: r.n for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    slots, sequence, rank = [], 0, Counter()
    for p, m in plan(counts, capacity, nodes):
        at = 0
        for x in p:
            slots.append((x, rank[x], sequence, at))
            rank[x] += m
            at += x
        sequence += m
    slots.sort()
    lens, firsts, bases, offsets = (np.array(c, np.int64) for c in zip(*slots, strict=True)) if slots else (np.zeros(0, np.int64),) * 4
    keys = lens * (1 << 50) + firsts  # a few numbers for each length; ranks stay below 2^50

    salts = max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = [x for x in (key, "piece", "start", "ids_crc32") if x in cut.columns]
    salted = cut.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    # at most capacity * salts rows, each length's in one window
    before = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_salt")) - F.col("_n")).drop("_n")
    ranked = salted.withColumn("_r", F.row_number().over(Window.partitionBy("length", "_salt").orderBy(*order)) - 1).join(before, ["length", "_salt"]).withColumn("_rank", F.col("_before") + F.col("_r"))

    def assign(batches):
        for b in batches:
            x, r = b["length"].to_numpy(), b["_rank"].to_numpy()
            i = np.searchsorted(keys, x * (1 << 50) + r, side="right") - 1
            b = b.drop(columns=["_rank"])
            b["sequence_id"], b["offset"] = bases[i] + r - firsts[i], offsets[i]
            yield b.astype({key: "Int64"})

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema.fields)
    return ranked.select(*cut.columns, "_rank").mapInPandas(assign, f"{fields}, sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the packed token ids themselves; packed needs the column ids. A sequence is at most `capacity` ids."""
    held = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.aggregate(held, F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = materialise(pieces(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json")), "pieces")
    return place(cut)

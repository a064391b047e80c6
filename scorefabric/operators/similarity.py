"""Vector and text similarity: blocked cosine join, nearest neighbours, TF-IDF anchors, groups by components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scorefabric.functions.expressions import tokens
from scorefabric.operators.quantiles import quantiles
from scorefabric.operators.written import checkpointed, fresh_folder, kept

#: Vectors of a block, about: a task multiplies two blocks and emits only what passes. Pivots at most.
BLOCK, PIVOTS = 1024, 2048

#: Blocks up to which all pairs of blocks are met without looking for bounds; results are the same.
FEW = 4

#: Blocks of a group at most, and groups into which a table of enough blocks is dealt at least. A task takes two groups, so a
#: vector is shuffled once for each group, not for each block.
GROUP, GROUPS = 64, 8

#: Blocks' worth of rows in a strip, and strips in a partition at most, of which a task holds one.
STRIP, STRIPS = 4, 16

#: Rows that a task sends on at once, about, and links that it holds before it follows them.
ROWS, LINKS = 1 << 18, 1 << 20

#: Angles are taken to be less exact than this.
SLACK = 1e-6


def _pivots(df: DataFrame, key: str, vector: str, block: int) -> tuple[np.ndarray, int]:
    """(unit vectors of some rows, as many as there are blocks and PIVOTS at most; the number of rows)."""
    n = df.count()
    most = min(PIVOTS, max(1, math.ceil(n / block)))
    v = df.where(F.col(vector).isNotNull()).orderBy(F.xxhash64(F.lit(7), key), key).limit(most).select(F.transform(vector, lambda x: x.cast("double")).alias("v")).collect()
    return (_unit(np.array([r["v"] for r in v])) if v else np.zeros((0, 0))), n


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1, 1))


def _placed(df: DataFrame, key: str, vector: str, pivots: np.ndarray) -> DataFrame:
    """(id, v, pivot, angle): vectors with their nearest pivot. Zero vectors are no one's neighbours and go to pivot -1; null ones go."""

    def place(batches):
        for b in batches:
            if len(b):
                x = _vectors(b)
                s = x @ pivots.T
                near = s.argmax(1)
                zero = np.abs(x).sum(1) == 0
                yield pd.DataFrame({"id": b["id"], "v": b["v"], "pivot": np.where(zero, -1, near), "angle": np.where(zero, 0.0, _angle(s[np.arange(len(x)), near]))})

    kind = df.schema[key].dataType.simpleString()
    narrow = df.schema[vector].dataType.simpleString() == "array<float>"  # these stay as small as they are
    v = F.col(vector) if narrow else F.transform(vector, lambda x: x.cast("double"))
    rows = df.where(F.col(vector).isNotNull()).select(F.col(key).alias("id"), v.alias("v"))
    return rows.mapInPandas(place, f"id {kind}, v array<{'float' if narrow else 'double'}>, pivot int, angle double")


def _vectors(pdf: pd.DataFrame) -> np.ndarray:
    """The unit vectors of some rows."""
    return _unit(np.stack(pdf["v"].to_numpy()).astype(float))


def _hashed(df: DataFrame, key: str, vector: str, blocks: int) -> DataFrame:
    """(id, v, blk): unit vectors in blocks by a hash of their key."""
    rows = df.where(F.col(vector).isNotNull()).select(F.col(key).alias("id"), F.transform(vector, lambda x: x.cast("double")).alias("x"))
    size = rows.withColumn("l", F.greatest(F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, e: a + e * e)), F.lit(1e-12)))
    return size.select("id", F.transform("x", lambda e: e / F.col("l")).alias("v"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("blk"))


def _all_pairs(spark, rows: int, columns: int, once: bool) -> DataFrame:
    """(i, j) of a few blocks; once: i <= j."""
    return spark.createDataFrame([(i, j) for i in range(rows) for j in range(i if once else 0, columns)], "i int, j int")


def _rings(placed: DataFrame, block: int, cells: int = 256) -> tuple[DataFrame, pd.DataFrame]:
    """placed with the block of each row, and the blocks (blk, pivot, low, high, n rows about). A block is a range of angles about a
    pivot; equal angles beyond a block's size, of copies say, are dealt over more blocks of that range.

    The driver holds `cells` counts a pivot at most, and a row for each block.
    """
    cell = F.floor(F.col("angle") * (cells / np.pi)).cast("int")
    some = placed.withColumn("cell", cell)
    counts = some.groupBy("pivot", "cell").agg(F.count(F.lit(1)).alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high")).toPandas().sort_values(["pivot", "cell"])
    blocks, cuts, at = [], [], 0
    for pivot, mine in counts.groupby("pivot"):
        held, low, high = 0, 0.0, 0.0
        for c, n, a, z in zip(mine["cell"], mine["n"], mine["low"], mine["high"], strict=True):
            if n > block:  # one cell, over several blocks
                if held:
                    blocks.append((at, pivot, low, high, held))
                    at, held = at + 1, 0
                parts = math.ceil(n / block)
                cuts.append((pivot, c, at, parts))
                blocks += [(at + k, pivot, a, z, math.ceil(n / parts)) for k in range(parts)]
                at += parts
                continue
            if held and held + n > block:
                blocks.append((at, pivot, low, high, held))
                at, held = at + 1, 0
            low = a if not held else low
            held, high = held + n, z
            cuts.append((pivot, c, at, 1))
        if held:
            blocks.append((at, pivot, low, high, held))
            at += 1
    table = placed.sparkSession.createDataFrame([tuple(map(int, c)) for c in cuts], "pivot int, cell int, first int, parts int")
    dealt = some.join(F.broadcast(table), ["pivot", "cell"]).select("id", "v", (F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts"))).cast("int").alias("blk"))
    return dealt, pd.DataFrame(blocks, columns=["blk", "pivot", "low", "high", "n"])


def _least_angles(a: pd.DataFrame, b: pd.DataFrame, pivots: np.ndarray) -> np.ndarray:
    """(blocks of a, blocks of b): no two vectors of the two blocks are closer. Angles obey the triangle inequality:
    through one pivot by the difference of the angles to it, between pivots by what is left of their own angle."""
    p, q = a["pivot"].to_numpy(), b["pivot"].to_numpy()
    low = lambda t: t["low"].to_numpy()
    high = lambda t: t["high"].to_numpy()
    d = _angle(pivots[p] @ pivots[q].T) if len(pivots) else np.zeros((len(p), len(q)))
    d[p[:, None] == q[None, :]] = 0.0
    far = d - high(a)[:, None] - high(b)[None, :]
    # a vector far from its pivot is far from what lies near that pivot, and the other way round
    far = np.maximum(far, low(a)[:, None] - d - high(b)[None, :])
    far = np.maximum(far, low(b)[None, :] - d - high(a)[:, None])
    return np.maximum(far, 0.0) - SLACK


def _pairs_of_blocks(spark, a: pd.DataFrame, b: pd.DataFrame, pivots: np.ndarray, chosen, of: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """(i, j) of the blocks of a and b for which chosen(least angles, blocks of a) holds; tasks take some blocks of a each.
    With the groups of both sides' blocks, the pairs of groups that hold such a pair."""
    of_a, of_b = of or (np.arange(len(a)), np.arange(len(b)))
    step = max(1, (1 << 22) // max(1, len(b)))

    def some(batches):
        for t in batches:
            for k in range(0, len(t), step):
                mine = t.iloc[k : k + step]
                i, j = np.nonzero(chosen(_least_angles(mine, b, pivots), mine["blk"].to_numpy()))
                yield pd.DataFrame({"i": of_a[mine["blk"].to_numpy()[i]], "j": of_b[b["blk"].to_numpy()[j]]}).drop_duplicates()

    rows = [(int(r.blk), int(r.pivot), float(r.low), float(r.high)) for r in a.itertuples()]
    return checkpointed(spark.createDataFrame(rows, "blk int, pivot int, low double, high double").mapInPandas(some, "i int, j int").distinct())


def _of_groups(rows: DataFrame, pairs: DataFrame, of: np.ndarray):
    """The rows grouped by the pairs (i, j), i <= j, of groups; `of` has the group of each block. A pair (i, i) takes a row once."""
    table = rows.sparkSession.createDataFrame([(i, int(g)) for i, g in enumerate(of)], "blk int, _g int")
    placed = rows.join(F.broadcast(table), "blk")
    meet = lambda side: placed.join(F.broadcast(pairs.withColumn("_g", F.col(side))), "_g")
    one, two = meet("i"), meet("j").where("i <> j")
    return one.select(F.lit(0).alias("side"), "id", "v", "blk", "i", "j").unionByName(two.select(F.lit(1).alias("side"), "id", "v", "blk", "i", "j")).groupBy("i", "j")


def _meetings(pdf: pd.DataFrame, chosen) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places of rows, places of rows, similarities) of each pair of blocks i <= j in a pair of groups that
    chosen(block, blocks) keeps; a group may meet itself."""
    x, blk, side = _vectors(pdf), pdf["blk"].to_numpy(), pdf["side"].to_numpy()
    places = lambda k: {int(i): np.flatnonzero((side == k) & (blk == i)) for i in np.unique(blk[side == k])}
    left, right = places(0), places(1)
    right = right or left
    for i, r in left.items():
        js = np.array([j for j in right if j >= i], int)
        for j in js[chosen(i, js)] if len(js) else ():
            yield r, right[int(j)], x[r] @ x[right[int(j)]].T


def _each(blocks: int) -> int:
    """Blocks of a group."""
    return max(1, min(GROUP, math.ceil(blocks / GROUPS)))


def _strips(blocks: pd.DataFrame, rows: int) -> np.ndarray:
    """The strip of each block: blocks in a row of about so many rows together."""
    return np.unique((blocks["n"].cumsum() - 1) // rows, return_inverse=True)[1]


def _packed(rows: DataFrame, strips: np.ndarray, parts: int) -> DataFrame:
    """(strip, ids, blks, v): a row a strip, its rows' columns as bytes, ascending by id; in at most so many partitions."""
    own = rows.sparkSession.createDataFrame([(int(g), int(g)) for g in np.unique(strips)], "i int, j int")

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        v = np.stack(pdf["v"].to_numpy())
        return pd.DataFrame({"strip": pdf["i"].iloc[:1].to_numpy(), "ids": [pdf["id"].to_numpy(np.int64).tobytes()], "blks": [pdf["blk"].to_numpy(np.int32).tobytes()], "v": [v.tobytes()]})

    return checkpointed(_of_groups(rows, own, strips).applyInPandas(pack, "strip int, ids binary, blks binary, v binary").coalesce(parts))


def _blocks(df: DataFrame, key: str, vector: str, threshold: float, block: int):
    """(rows with their block, the blocks, pivots, whether pairs of blocks of some least angles can hold a cosine above the threshold)."""
    pivots, _ = _pivots(df, key, vector, block)
    dealt, blocks = _rings(checkpointed(_placed(df, key, vector, pivots)).where("pivot >= 0"), block)
    far, all_ = float(_angle(np.array(threshold))), blocks["blk"].to_numpy()
    return dealt, blocks, pivots, lambda least, own: (least <= far) & (own[:, None] <= all_[None, :])


def block_pairs(df: DataFrame, key: str, vector: str, threshold: float, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(rows with their block, the pairs of blocks i <= j that can hold two vectors of a cosine above the threshold)."""
    dealt, blocks, pivots, chosen = _blocks(df, key, vector, threshold, block)
    return dealt, _pairs_of_blocks(df.sparkSession, blocks, blocks, pivots, chosen)


def _above(df: DataFrame, key: str, vector: str, threshold: float, block: int, found, schema: str) -> DataFrame:
    """found(ids of rows, pairs of places above the threshold, one block pair after the other) for each pair of groups."""
    dealt, blocks, pivots, chosen = _blocks(df, key, vector, threshold, block)
    far, each = float(_angle(np.array(threshold))), _each(len(blocks))
    groups = np.arange(len(blocks)) // each
    pairs = _pairs_of_blocks(df.sparkSession, blocks, blocks, pivots, chosen, (groups, groups))

    def close(i: int, js: np.ndarray) -> np.ndarray:
        return _least_angles(blocks.iloc[i : i + 1], blocks.iloc[js], pivots)[0] <= far

    def multiply(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(frames), ignore_index=True)

        def passing():
            for r, c, s in _meetings(pdf, close):
                p, q = np.nonzero(s > threshold)
                keep = p < q if r is c else slice(None)
                yield r[p[keep]], c[q[keep]], s[p, q][keep]

        yield from found(pdf["id"].to_numpy(), passing())

    return _of_groups(dealt, pairs, groups).applyInPandas(multiply, schema)


def cosine_pairs(df: DataFrame, key: str, vector: str, threshold: float, block: int = BLOCK) -> DataFrame:
    """(a, b, sim) of all pairs a < b whose cosine exceeds the threshold (strict, and above 0 where a vector is zero).

    Exact. Vectors are dealt over ranges of the angle to their nearest pivot; pairs of ranges that the triangle
    inequality keeps apart are never multiplied. A task takes two groups of ranges and sends on pairs as it finds them.
    """
    if threshold < 0:
        raise ValueError("a threshold is 0 at least")
    blocks = max(1, math.ceil(df.count() / block))
    if blocks > FEW:

        def told(ids, passing):
            held, n = [], 0
            for p, q, s in passing:
                held.append(pd.DataFrame({"a": np.minimum(ids[p], ids[q]), "b": np.maximum(ids[p], ids[q]), "sim": s}))
                n += len(p)
                if n > ROWS:
                    yield pd.concat(held)
                    held, n = [], 0
            if n:
                yield pd.concat(held)

        return _above(df, key, vector, threshold, block, told, "a long, b long, sim double")
    dealt, pairs = _hashed(df, key, vector, blocks), _all_pairs(df.sparkSession, blocks, blocks, True)

    def multiply(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
        x, y = pdf[pdf["blk"] == i], pdf[pdf["blk"] == j]
        if not len(x) or not len(y):
            return pd.DataFrame({"a": [], "b": [], "sim": []})
        s = np.stack(x["v"].to_numpy()) @ np.stack(y["v"].to_numpy()).T
        r, c = np.nonzero(s > threshold)
        a, b = x["id"].to_numpy()[r], y["id"].to_numpy()[c]
        keep = a < b if i == j else np.ones(len(a), bool)
        return pd.DataFrame({"a": np.minimum(a, b)[keep], "b": np.maximum(a, b)[keep], "sim": s[r, c][keep]})

    both = pairs.withColumn("blk", F.col("i")).union(pairs.where("i <> j").withColumn("blk", F.col("j")))
    return dealt.join(both, "blk").groupBy("i", "j").applyInPandas(multiply, "a long, b long, sim double")


def _joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """label, in place: the least place that each place reaches, by what it was and the links between a and b."""
    while len(a):
        p, q = label[a], label[b]
        apart = p != q
        a, b = a[apart], b[apart]
        np.minimum.at(label, np.maximum(p, q)[apart], np.minimum(p, q)[apart])
        while (label[label] != label).any():
            label[:] = label[label]


def cosine_links(df: DataFrame, key: str, vector: str, threshold: float, block: int = BLOCK) -> DataFrame:
    """(a, b) with the components of all pairs above the threshold: a task sends on, for each of its rows, the least one it
    reaches there, so a link for a row and a pair of groups at most."""
    if threshold < 0:
        raise ValueError("a threshold is 0 at least")
    if math.ceil(df.count() / block) <= FEW:
        return cosine_pairs(df, key, vector, threshold, block).select("a", "b")

    def told(ids, passing):
        order = np.argsort(ids, kind="stable")
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))  # places in the order of ids, so that the least place is the least id
        label, held, n = np.arange(len(ids)), [], 0
        for p, q, _ in passing:
            held.append((place[p], place[q]))
            n += len(p)
            if n > LINKS:
                _joined(label, *map(np.concatenate, zip(*held, strict=True)))
                held, n = [], 0
        if held:
            _joined(label, *map(np.concatenate, zip(*held, strict=True)))
        some = np.flatnonzero(label != np.arange(len(ids)))
        yield pd.DataFrame({"a": ids[order][label[some]], "b": ids[order][some]})

    return _above(df, key, vector, threshold, block, told, "a long, b long")


def nearest(queries: DataFrame, base: DataFrame, key: str, vector: str, k: int = 1, block: int = BLOCK) -> DataFrame:
    """(id, neighbour, sim): the k nearest of base by cosine for each query, itself left out; ties to the least key.

    Exact. Queries first meet the blocks of base that lie nearest to theirs; the k-th similarity found there bounds how far
    a better one can be, and only blocks within that bound of a block of queries are met after that. Both sides are written
    in strips of blocks, a row a strip; pairs of strips meet where they lie, so that no vector is copied for a meeting.
    """
    w = Window.partitionBy("id").orderBy(F.col("sim").desc(), "neighbour")
    top = lambda d: d.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf[pdf["side"] == "q"], pdf[pdf["side"] == "b"].sort_values("id")
        if not len(x) or not len(y):
            return pd.DataFrame({"id": [], "neighbour": [], "sim": [], "own": []})
        s = _vectors(x) @ _vectors(y).T
        s[x["id"].to_numpy()[:, None] == y["id"].to_numpy()[None, :]] = -np.inf
        some = _first(s, k)
        r = np.repeat(np.arange(len(x)), some.shape[1])
        out = pd.DataFrame({"id": x["id"].to_numpy()[r], "neighbour": y["id"].to_numpy()[some.ravel()], "sim": s[r, some.ravel()], "own": x["blk"].to_numpy()[r]})
        return out[np.isfinite(out["sim"])]

    def met(q: DataFrame, b: DataFrame, pairs: DataFrame) -> DataFrame:
        """The k best of each query in each of the given (block of queries, block of base)."""
        one = q.join(pairs.withColumn("blk", F.col("i")), "blk").select(F.lit("q").alias("side"), "id", "v", "blk", "i", "j")
        two = b.join(pairs.withColumn("blk", F.col("j")), "blk").select(F.lit("b").alias("side"), "id", "v", "blk", "i", "j")
        return one.unionByName(two).groupBy("i", "j").applyInPandas(best, "id long, neighbour long, sim double, own int")

    nq, nb = (max(1, math.ceil(d.count() / block)) for d in (queries, base))
    if max(nq, nb) <= FEW:
        return top(met(_hashed(queries, key, vector, nq), _hashed(base, key, vector, nb), _all_pairs(queries.sparkSession, nq, nb, False))).select("id", "neighbour", "sim")
    pivots, _ = _pivots(base, key, vector, block)
    if not len(pivots):
        return queries.sparkSession.createDataFrame([], f"id {queries.schema[key].dataType.simpleString()}, neighbour long, sim double")
    q, qb = _rings(checkpointed(_placed(queries, key, vector, pivots)), block)
    b, bb = _rings(checkpointed(_placed(base, key, vector, pivots)), block)
    spark = queries.sparkSession
    if not len(qb) or not len(bb):
        return spark.createDataFrame([], "id long, neighbour long, sim double")
    zero_q, zero_b = qb["pivot"].to_numpy() < 0, bb["pivot"].to_numpy() < 0
    qb["pivot"], bb["pivot"] = qb["pivot"].clip(lower=0), bb["pivot"].clip(lower=0)

    def least_of(least: np.ndarray, own: np.ndarray) -> np.ndarray:
        """With zero vectors: they are at a right angle to all, and as queries may meet any block."""
        least = np.where(zero_b[None, :], np.pi / 2 - SLACK, least)
        return np.where(zero_q[own][:, None], -1.0, least)

    def nearest_two(least: np.ndarray, own: np.ndarray) -> np.ndarray:
        out = np.zeros(least.shape, bool)
        np.put_along_axis(out, np.argsort(least_of(least, own), axis=1, kind="stable")[:, :2], True, axis=1)
        return out

    of_q, of_b = _strips(qb, STRIP * block), _strips(bb, STRIP * block)
    b_parts = math.ceil((of_b.max() + 1) / STRIPS)
    q_parts = min(int(of_q.max()) + 1, max(math.ceil((of_q.max() + 1) / STRIPS), math.ceil(4 * spark.sparkContext.defaultParallelism / b_parts)))
    packed_q, packed_b = _packed(q, of_q, q_parts), _packed(b, of_b, b_parts)
    kind = np.float32 if dict(q.dtypes)["v"] == "array<float>" else np.float64
    kind_b = np.float32 if dict(b.dtypes)["v"] == "array<float>" else np.float64

    def meet(chosen) -> DataFrame:
        """The k best of each query in the blocks of base that chosen(least angles, blocks of queries) keeps for its block,
        in each partition of base."""

        def best(batches):
            last, held = None, None

            def told():
                ids, own, sim, near = held
                r, c = np.nonzero(np.isfinite(sim))
                return pd.DataFrame({"id": ids[r], "neighbour": near[r, c], "sim": sim[r, c], "own": own[r]})

            for pairs in batches:
                for strip, ids, blks, v, ids_b, blks_b, v_b in zip(*(pairs[c] for c in ("strip", "ids", "blks", "v", "ids_b", "blks_b", "v_b")), strict=True):
                    if strip != last:
                        if held is not None:
                            yield told()
                        last, ids = strip, np.frombuffer(ids, np.int64)
                        x = _unit(np.frombuffer(v, kind).reshape(len(ids), -1).astype(float))
                        own = np.frombuffer(blks, np.int32)
                        held = ids, own, np.full((len(ids), k), -np.inf), np.zeros((len(ids), k), np.int64)
                        mine = np.unique(own)
                    ids, own, sim, near = held
                    ids_b, blks_b = np.frombuffer(ids_b, np.int64), np.frombuffer(blks_b, np.int32)
                    y = _unit(np.frombuffer(v_b, kind_b).reshape(len(ids_b), -1).astype(float))
                    wanted = chosen(_least_angles(qb.iloc[mine], bb, pivots), mine)
                    for i, some in zip(mine, wanted, strict=True):
                        c = np.flatnonzero(some[blks_b])
                        if not len(c):
                            continue
                        p = np.flatnonzero(own == i)
                        s = x[p] @ (y if len(c) == len(y) else y[c]).T
                        at = np.searchsorted(ids_b[c], ids[p]).clip(max=len(c) - 1)
                        same = ids_b[c][at] == ids[p]
                        s[np.flatnonzero(same), at[same]] = -np.inf
                        few = _first(s, k)
                        sims = np.hstack([sim[p], np.take_along_axis(s, few, 1)])
                        nears = np.hstack([near[p], ids_b[c][few]])
                        order = np.lexsort((nears, -sims), axis=1)[:, :k]
                        sim[p], near[p] = np.take_along_axis(sims, order, 1), np.take_along_axis(nears, order, 1)
            if held is not None:
                yield told()

        pairs = _pairs_of_blocks(spark, qb, bb, pivots, chosen, (of_q, of_b)).groupBy("i").agg(F.collect_list("j").alias("to"))  # the strips of base that a strip meets
        left = packed_q.join(F.broadcast(pairs), packed_q.strip == pairs.i).drop("i")
        right = packed_b.select(F.col("strip").alias("strip_b"), F.col("ids").alias("ids_b"), F.col("blks").alias("blks_b"), F.col("v").alias("v_b"))
        both = left.join(right.hint("shuffle_replicate_nl"), F.array_contains("to", F.col("strip_b"))).drop("to", "strip_b")
        return both.mapInPandas(best, "id long, neighbour long, sim double, own int")

    found = checkpointed(top(meet(nearest_two)))
    # the queries of a block have k neighbours at least as similar as its floor; a block with fewer has none
    held = found.groupBy("id", "own").agg(F.count(F.lit(1)).alias("n"), F.min("sim").alias("s")).groupBy("own").agg(F.count_if(F.col("n") == k).alias("full"), F.min("s").alias("s"))
    sizes = q.groupBy("blk").agg(F.count(F.lit(1)).alias("all"))
    reach = np.full(len(qb), np.inf)
    for r in sizes.join(held, sizes.blk == held.own).collect():  # a row a block
        if r["full"] == r["all"]:
            reach[r["blk"]] = _angle(np.array(r["s"]))
    near = lambda least, own: (least_of(least, own) <= reach[own][:, None]) & ~nearest_two(least, own)
    return top(found.unionByName(meet(near))).select("id", "neighbour", "sim")


def _first(s: np.ndarray, k: int) -> np.ndarray:
    """Places of the k greatest of each row, equal ones in their order."""
    return s.argmax(1)[:, None] if k == 1 else np.argsort(-s, axis=1, kind="stable")[:, :k]


def nn_threshold(queries: DataFrame, base: DataFrame, key: str, vector: str, percentile: float = 0.995) -> float:
    """The percentile of the queries' greatest similarities: one number, None if there are none."""
    found = quantiles(nearest(queries, base, key, vector), "sim", [percentile]).first()
    return found["q"][0] if found else None


def speaker_vectors(df: DataFrame, key: str, mean: str, sd: str, layers: tuple[int, int] = (3, 6), least: float = 1e-8) -> DataFrame:
    """(key, vector): means and deviations of some layers side by side, z-scored place by place over all rows, of unit length.

    mean and sd are arrays of layers. The scale is one row with an entry a place. A row without spread anywhere is zeros.
    """
    first, last = layers
    part = lambda c: F.flatten(F.slice(c, first + 1, last - first + 1))
    rows = df.select(key, F.transform(F.concat(part(mean), part(sd)), lambda x: x.cast("double")).alias("_v"))
    each = rows.select(F.posexplode("_v").alias("_i", "_x")).groupBy("_i").agg(F.avg("_x").alias("_m"), F.stddev_pop("_x").alias("_s"))
    scale = each.agg(F.array_sort(F.collect_list(F.struct("_i", "_m", "_s"))).alias("_scale"))  # an entry a place
    z = rows.join(F.broadcast(scale)).select(key, F.zip_with("_v", "_scale", lambda x, s: (x - s["_m"]) / (s["_s"] + least)).alias("_z"))
    size = z.withColumn("_l", F.sqrt(F.aggregate("_z", F.lit(0.0), lambda a, x: a + x * x)))
    return size.select(key, F.transform("_z", lambda x: x / F.greatest(F.col("_l"), F.lit(1e-12))).alias("vector"))


def components(edges: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """(key, component): the least key each node reaches; isolated nodes are their own.

    Least labels spread over edges and jump over labels; every round is written as files, so that plan statistics don't
    grow with each round, and the driver's memory with them.
    """
    at, rounds = fresh_folder(nodes.sparkSession, "components"), 0
    both = kept(edges.select(F.col("a").alias("x"), F.col("b").alias("y")).union(edges.select("b", "a")).distinct(), f"{at}/both")
    label = kept(nodes.select(F.col(key).alias("x"), F.col(key).alias("c")), f"{at}/nodes")
    while True:
        near = both.join(label.select(F.col("x").alias("y"), F.col("c").alias("cy")), "y").groupBy("x").agg(F.min("cy").alias("m"))
        step = label.join(near, "x", "left").select("x", F.least("c", F.coalesce("m", "c")).alias("n"), F.col("c").alias("old"))
        jump = step.select(F.col("x").alias("n"), F.col("n").alias("up"))
        new = kept(step.join(jump, "n", "left").select("x", F.least("n", F.coalesce("up", "n")).alias("c"), "old"), f"{at}/labels-{rounds % 2}")
        done, rounds = new.where(F.col("c") != F.col("old")).isEmpty(), rounds + 1
        label = new.select("x", "c")
        if done:
            return label.select(F.col("x").alias(key), F.col("c").alias("component"))


#: Clusters whose distances are a matrix in one task; more are first merged in rounds over blocks.
MOST_LINKED = 4096


def average_linkage(x: np.ndarray, thresholds: list[float], sizes: np.ndarray | None = None) -> list[np.ndarray]:
    """Cluster labels of rows by average linkage of cosine distances, cut at 1 - threshold for each threshold. With sizes,
    rows are means of so many unit vectors."""
    n = len(x)
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12) if sizes is None else x
    d = 1 - u @ u.T
    np.fill_diagonal(d, np.inf)
    size, alive, merges, chain = np.ones(n) if sizes is None else sizes.astype(float), np.ones(n, bool), [], []
    while alive.sum() > 1:
        if not chain:
            chain.append(int(np.flatnonzero(alive)[0]))
        a = chain[-1]
        row = np.where(alive, d[a], np.inf)
        b = int(np.argmin(row))
        if len(chain) > 1 and row[chain[-2]] <= row[b]:
            b = chain[-2]
            chain = chain[:-2]
            merges.append((float(d[a, b]), a, b))
            d[a] = d[:, a] = (size[a] * d[a] + size[b] * d[b]) / (size[a] + size[b])
            d[a, a] = np.inf
            size[a] += size[b]
            alive[b] = False
        else:
            chain.append(b)
    out = []
    for t in thresholds:
        up = list(range(n))

        def find(i: int, up=up) -> int:
            while up[i] != i:
                i = up[i]
            return i

        for h, a, b in merges:
            if h < 1 - t:
                lo, hi = sorted((find(a), find(b)))
                up[hi] = lo
        out.append(np.array([find(i) for i in range(n)]))
    return out


#: Rows of a group of clusters at most: a task of a round takes two groups.
CLUSTERS = 32768


def _better(s: np.ndarray, u: np.ndarray, v: np.ndarray, ids: np.ndarray, top: np.ndarray, other: np.ndarray, least: float, margin: float) -> None:
    """top and other, in place, by the rows of v (their ids ascend): s are single precision products of u and v that err by
    less than half the margin, so whatever can be a row's greatest is multiplied again."""
    row, column = np.nonzero(s >= (np.maximum(np.maximum(s.max(1), top), least) - margin)[:, None])
    # products that differ by the order of their sums alone are equal, so that two clusters see one similarity
    sim = [np.round(np.einsum("ij,ij->i", u[row[k : k + 65536]], v[column[k : k + 65536]]), 12) for k in range(0, len(row), 65536)]
    if sim:
        sim = np.concatenate(sim)
        order = np.lexsort((column, -sim, row))
        order = order[np.unique(row[order], return_index=True)[1]]
        order = order[sim[order] > top[row[order]]]
        top[row[order]], other[row[order]] = sim[order], ids[column[order]]


def _closest(asking: DataFrame, clusters: DataFrame, sizes: tuple[int, int], least: float, block: int) -> DataFrame:
    """(c, other, sim) of the most similar one of clusters, above least, for each of those asking; ties to the least other.
    Where all ask, a pair of groups is multiplied once for both."""
    deal = lambda n: max(1, math.ceil(n / min(CLUSTERS, 32 * block)), min(GROUPS - 2, math.ceil(n / block)))
    left, right, all_ask = deal(sizes[0]), deal(sizes[1]), sizes[0] == sizes[1]
    others = lambda own, n, first: F.explode(F.sequence(own if all_ask and first else F.lit(0), F.lit(n - 1) if first or not all_ask else own))
    side = lambda d, k, own, n, i, j: d.select(F.lit(k).alias("side"), F.col("c").alias("id"), "m", F.pmod(F.xxhash64("c"), F.lit(own)).cast("int").alias(i)).select("side", "id", "m", i, others(F.col(i), n, k == 0).alias(j))

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        x, y = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        if not len(x) or not len(y):
            return pd.DataFrame({"c": [], "other": [], "sim": []})
        back = all_ask and pdf["i"].iloc[0] != pdf["j"].iloc[0]
        a, b, u, v = x["id"].to_numpy(), y["id"].to_numpy(), np.stack(x["m"].to_numpy()), np.stack(y["m"].to_numpy())
        u4, v4, margin = u.astype(np.float32), v.astype(np.float32), 3e-7 * (u.shape[1] + 8)  # means of unit vectors are no longer than 1
        tops, nears = [np.full(n, -np.inf) for n in (len(a), len(b))], [np.zeros(n, np.int64) for n in (len(a), len(b))]
        for r in range(0, len(a), 1024):
            mine = slice(r, r + 1024)
            for k in range(0, len(b), 4096):
                s, some = u4[mine] @ v4[k : k + 4096].T, slice(k, k + 4096)
                at = np.searchsorted(b[some], a[mine]).clip(max=len(b[some]) - 1)
                same = b[some][at] == a[mine]
                s[np.flatnonzero(same), at[same]] = -np.inf
                _better(s, u[mine], v[some], b[some], tops[0][mine], nears[0][mine], least, margin)
                if back:
                    _better(s.T, v[some], u[mine], a[mine], tops[1][some], nears[1][some], least, margin)
        found = pd.DataFrame({"c": np.concatenate([a, b]), "other": np.concatenate(nears), "sim": np.concatenate(tops)})
        return found[found["sim"] > least]

    both = side(asking, 0, left, right, "i", "j").unionByName(side(clusters, 1, right, left, "j", "i"))
    part = both.groupBy("i", "j").applyInPandas(best, "c long, other long, sim double")
    return part.groupBy("c").agg(F.max(F.struct("sim", (-F.col("other")).alias("x"))).alias("t")).select("c", (-F.col("t.x")).alias("other"), "t.sim")


def linked_groups(df: DataFrame, key: str, vector: str, thresholds: list[float], most: int = MOST_LINKED, block: int = BLOCK) -> DataFrame:
    """(key, group per threshold): exact average linkage of all rows; a group is its least key.

    The mean similarity of two clusters is the product of their mean unit vectors, and merging others never raises a
    cluster's greatest one; so every round merges all mutually closest pairs, until none exceeds the least threshold or
    `most` clusters at most are left, which one task links. For the same reason a cluster keeps its closest one until that
    one merges: after the first round, which is a product of all pairs, only the others are compared with all. Equal
    vectors are one cluster from the start.
    """
    names, least = [f"group_{int(round(100 * t))}" for t in thresholds], min(thresholds)
    if not 0 <= least <= max(thresholds) < 1:
        raise ValueError("thresholds are in [0, 1)")
    v = F.transform(vector, lambda x: x.cast("double"))
    own = df.select(F.col(key).cast("long").alias("k"), v.alias("v")).withColumn("s", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))
    own = checkpointed(own.withColumn("z", F.when(F.col("s") == 0, F.col("k")).otherwise(F.lit(-1).cast("long"))))
    equal = own.groupBy("v", "z").agg(F.min("k").alias("c"), F.count(F.lit(1)).alias("n"), F.first("s").alias("s"))
    clusters = (equal.select("c", "n", F.transform("v", lambda x: x / F.greatest(F.col("s"), F.lit(1e-12))).alias("m"), F.lit(None).cast("long").alias("other"), F.lit(None).cast("double").alias("sim")))
    members = (own.join(equal.select("v", "z", "c"), ["v", "z"]).select("k", "c", *[F.col("c").alias(m) for m in names]))
    rounds, at = 0, fresh_folder(df.sparkSession, "linkage")
    members = kept(members, f"{at}/members")
    clusters = kept(clusters, f"{at}/merged")
    while (sizes := clusters.agg(F.count_if(F.col("other").isNull()), F.count(F.lit(1))).first())[1] > most:
        asking = clusters.where("other is null").select("c", "n", "m")
        found = asking.join(_closest(asking, clusters, tuple(sizes), least, block), "c")  # the others merge no more
        clusters = kept(clusters.where("other is not null").unionByName(found.select(*clusters.columns)), f"{at}/found")
        x, y = clusters.select("c", "other", "sim").alias("x"), clusters.select("c", "other").alias("y")
        pairs = x.join(y, F.col("x.other") == F.col("y.c")).where("y.other = x.c and x.c < y.c").select(F.col("x.c").alias("a"), F.col("y.c").alias("b"), F.col("x.sim").alias("sim"))
        into = kept(pairs.select(F.explode(F.array("a", "b")).alias("c"), F.col("a").alias("new"), F.col("sim").alias("at")), f"{at}/into-{rounds}")
        if into.isEmpty():
            # similarities that rounding sets apart may point in a circle; of those the greatest pair merges
            first = clusters.orderBy(F.desc("sim"), F.least("c", "other"), F.greatest("c", "other")).limit(1)
            into = kept(first.select(F.explode(F.array("c", "other")).alias("c"), F.least("c", "other").alias("new"), F.col("sim").alias("at")), f"{at}/first-{rounds}")
            if into.isEmpty():
                break
        gone = into.select(F.col("c").alias("other"), F.lit(True).alias("moved"))
        joined = clusters.join(into, "c", "left").join(gone, "other", "left").groupBy(F.coalesce("new", "c").alias("c2")).agg(F.sort_array(F.collect_list(F.struct("c", "n", "m"))).alias("l"), F.max(F.when(F.col("moved").isNull() & F.col("new").isNull(), F.struct("other", "sim"))).alias("o"))
        total = F.aggregate(F.transform("l", lambda e: e["n"]), F.lit(0).cast("long"), lambda a, e: a + e)
        mean = F.when(F.size("l") == 1, F.col("l")[0]["m"]).otherwise(F.zip_with(F.col("l")[0]["m"], F.get("l", F.lit(1))["m"], lambda p, q: (p * F.col("l")[0]["n"] + q * F.get("l", F.lit(1))["n"]) / (F.col("l")[0]["n"] + F.get("l", F.lit(1))["n"])))
        clusters = kept(joined.select(F.col("c2").alias("c"), total.alias("n"), mean.alias("m"), "o.other", "o.sim"), f"{at}/merged")
        members = members.join(into, "c", "left").select("k", F.coalesce("new", "c").alias("c"), *[F.when(F.col("at") > t, F.col("new")).otherwise(F.col(m)).alias(m) for m, t in zip(names, thresholds, strict=True)])
        rounds += 1
        members = kept(members, f"{at}/members-{rounds // 6 % 2}") if rounds % 6 == 0 else members

    def rest(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("c")
        ids = pdf["c"].to_numpy()
        labels = average_linkage(np.stack(pdf["m"].to_numpy()), thresholds, pdf["n"].to_numpy())
        return pd.DataFrame({"c": ids, **{f"to_{m}": ids[at] for m, at in zip(names, labels, strict=True)}})

    last = clusters.withColumn("_one", F.lit(0)).groupBy("_one").applyInPandas(rest, "c long, " + ", ".join(f"to_{m} long" for m in names))
    kind = df.schema[key].dataType
    return members.join(last, "c", "left").select(F.col("k").cast(kind).alias(key), *[F.when(F.col(f"to_{m}") != F.col("c"), F.col(f"to_{m}")).otherwise(F.col(m)).alias(m) for m in names])


def tfidf(docs: DataFrame, key: str, text: str, min_df: int = 2) -> DataFrame:
    """(key, term, w): 1- and 2-grams of words of two letters or more, sublinear tf, idf ln((1 + n) / (1 + df)) + 1, unit length."""
    words = F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?U)(\b\w\w+\b)"), 1), lambda w: F.length(w) > 1)
    bigrams = F.when(F.size("_w") > 1, F.zip_with(F.slice("_w", 1, F.size("_w") - 1), F.slice("_w", 2, F.size("_w") - 1), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))
    terms = docs.select(key, words.alias("_w")).select(key, F.explode(F.concat("_w", bigrams)).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))
    n = docs.agg(F.count(F.lit(1)).alias("_n"))
    df = terms.groupBy("term").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= min_df)
    raw = terms.join(df, "term").join(F.broadcast(n)).select(key, "term", ((1 + F.log("tf")) * (F.log((1 + F.col("_n")) / (1 + F.col("df"))) + 1)).alias("r"))
    size = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("r") * F.col("r"))).alias("_s"))
    return raw.join(size, key).select(key, "term", (F.col("r") / F.col("_s")).alias("w"))


#: Texts of the pool up to which a term counts as rare: its pairs are made first.
RARE = 64


def text_neighbours(weights: DataFrame, pool: DataFrame, key: str, k: int = 4, digits: int | None = None, rare: int = RARE) -> DataFrame:
    """(key, anchor, sim): the k most similar texts of the pool, itself and its own fold left out; equal ones by anchor.
    pool: key, fold (-1: no fold). With digits, similarities are rounded before they are ranked.

    Exact. Similarities over rare terms alone are made first; the k-th of them is a floor of a text's k-th similarity. Of a
    text's terms, from rare to frequent, a tail whose greatest possible sum stays below the floor makes no candidates, so a
    frequent term pairs only the texts that have nothing better. What a candidate can still reach is compared with the
    floor, and the rest is summed over the tail.
    """
    spare = 1e-9 + (10.0**-digits if digits is not None else 0.0)
    w = checkpointed(weights.join(pool, key).select(F.col(key).alias("id"), "fold", "term", "w"))
    lists = w.where("fold >= 0").select(F.col("id").alias("anchor"), F.col("fold").alias("fa"), "term", F.col("w").alias("wa"))
    terms = lists.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.max("wa").alias("most"))
    asked = w.join(terms, "term").select(F.col("id").alias("q"), F.col("fold").alias("fq"), "term", F.col("w").alias("wq"), "df", "most")
    other = "q <> anchor and (fq = -1 or fq <> fa)"
    some = asked.where(F.col("df") <= rare).join(lists, "term").where(other).groupBy("q", "anchor").agg(F.sum(F.col("wq") * F.col("wa")).alias("s"))
    best = Window.partitionBy("q").orderBy(F.desc("s"))
    floors = some.withColumn("_r", F.row_number().over(best)).where(F.col("_r") == k).select("q", (F.col("s") - spare).alias("floor"))
    # the tail: bounded by the pool's greatest weights, and by Cauchy and Schwarz, as texts have unit length
    tail = Window.partitionBy("q").orderBy(F.desc("df"), "term").rowsBetween(Window.unboundedPreceding, 0)
    reach = F.least(F.sum(F.col("wq") * F.col("most")).over(tail), F.sqrt(F.sum(F.col("wq") * F.col("wq")).over(tail)))
    split = checkpointed(asked.withColumn("reach", reach).join(floors, "q", "left").withColumn("floor", F.coalesce("floor", F.lit(0.0))))
    head, rest = split.where("reach >= floor"), split.where("reach < floor")
    left = rest.groupBy("q").agg(F.max("reach").alias("left"))
    found = head.join(lists, "term").where(other).groupBy("q", "anchor", "floor").agg(F.sum(F.col("wq") * F.col("wa")).alias("s"))
    alive = checkpointed(found.join(left, "q", "left").where(F.col("s") + F.coalesce("left", F.lit(0.0)) >= F.col("floor")).select("q", "anchor", "s"))
    added = alive.join(rest.select("q", "term", "wq"), "q").join(lists.select("anchor", "term", "wa"), ["anchor", "term"]).groupBy("q", "anchor").agg(F.sum(F.col("wq") * F.col("wa")).alias("more"))
    s = alive.join(added, ["q", "anchor"], "left").select("q", "anchor", (F.col("s") + F.coalesce("more", F.lit(0.0))).alias("sim"))
    s = s.withColumn("sim", F.round("sim", digits)) if digits is not None else s
    order = Window.partitionBy("q").orderBy(F.desc("sim"), "anchor")
    return s.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).select(F.col("q").alias(key), "anchor", "sim")


#: Grade bands from which one anchor each is drawn.
BANDS = [(2.0, 2.5), (3.0, 3.5), (4.0, 4.5), (5.0, 5.0)]


def band_anchors(queries: DataFrame, pool: DataFrame, key: str, label: str, seed: int = 42, bands=tuple(BANDS)) -> DataFrame:
    """(key, band, anchor): one row of the whole band, each with equal chance by a hash of (seed, query, band), the query's
    own fold left out. queries: key, fold (-1: none); pool: key, label, fold, of which rows with fold -1 are no candidates.

    A band's rows are numbered fold by fold in hash order from salted counts; a pick is a number, so no pairs are made.
    """
    band = F.lit(None).cast("int")
    for k, (low, high) in enumerate(bands):
        band = F.when(F.col(label).between(low, high), k).otherwise(band)
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("anchor").cast("string")))
    p = pool.where("fold >= 0").select(F.col(key).alias("anchor"), "fold", band.alias("band")).where("band is not null").withColumn("_h", h).withColumn("_s", F.substring("_h", 1, 2))
    salted = p.groupBy("band", "fold", "_s").count().withColumn("_b", F.sum("count").over(Window.partitionBy("band").orderBy("fold", "_s")) - F.col("count"))
    numbered = p.withColumn("_r", F.row_number().over(Window.partitionBy("band", "fold", "_s").orderBy("_h", "anchor")) - 1).join(salted.drop("count"), ["band", "fold", "_s"]).select("band", (F.col("_b") + F.col("_r")).alias("_at"), "anchor")
    sizes = salted.groupBy("band", "fold").agg(F.min("_b").alias("_first"), F.sum("count").alias("_own"))  # bands times folds rows
    totals = sizes.groupBy("band").agg(F.sum("_own").alias("_n"))
    q = queries.select(F.col(key), "fold").join(F.broadcast(totals)).join(F.broadcast(sizes), ["band", "fold"], "left")
    others = F.col("_n") - F.coalesce("_own", F.lit(0))
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"), F.col("band").cast("string"))), 1, 15), 16, 10).cast("long") % others
    at = F.when(F.col("_first").isNull() | (F.col("_u") < F.col("_first")), F.col("_u")).otherwise(F.col("_u") + F.col("_own"))
    return q.where(others > 0).withColumn("_u", u).select(key, "band", at.alias("_at")).join(numbered, ["band", "_at"]).select(key, "band", "anchor")


def few_shot_prompt(examples, text, rubric: str, scale: str = "1.0-5.0"):
    """A prompt from an array of (text, grade) structs, in order, and the text to grade."""
    shots = F.array_join(F.transform(examples, lambda e: F.concat(F.lit("Text: "), e["text"], F.lit("\nGrade: "), e["grade"].cast("string"))), "\n\n")
    return F.concat(F.lit(f"{rubric}\nScale {scale}.\n\n"), shots, F.lit("\n\nText: "), text, F.lit("\nGrade:"))


__all__ = ["band_anchors", "block_pairs", "components", "cosine_links", "cosine_pairs", "few_shot_prompt", "linked_groups", "nearest", "nn_threshold", "speaker_vectors", "text_neighbours", "tfidf", "tokens"]

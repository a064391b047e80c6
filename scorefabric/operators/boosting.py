"""Gradient-boosted regression trees grown leaf by leaf, from histograms of gradients.

Features are cut into at most 255 bins, null and NaN in the lowest. A tree splits the leaf of greatest gain until it has
its number of leaves; a side of a split has `least` rows or more. Gradients are whole multiples of 2^-20, so a histogram
is a sum of integers and comes out the same in any order: trees grown by Spark aggregates and trees grown in one task are
equal. Rows of a tree are drawn by a hash of (seed, tree, row), columns by (seed, tree).

`grown` holds the binned rows of one fit in memory. `fitted` grows the trees of many fits (seeds, folds, repeats) in step
over a written table of any number of rows: an aggregate serves all fits at once and is asked, besides the leaves that are
due, for those that splits known so far would make, so a tree takes about as many aggregates as it is deep.
Where the bins of a table fit a task, as those of a million rows of 32 columns do, it may grow each fit in a task of its own.
"""

from __future__ import annotations

import json
from collections.abc import Generator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorefabric.operators.written import checkpointed

UNIT = 1 << 20
MOST_BINS = 255


@dataclass(frozen=True)
class Boosting:
    """Parameters of a fit; the defaults are those of the scoring run."""

    trees: int = 500
    rate: float = 0.02
    leaves: int = 7
    least: int = 25
    rows: float = 0.8
    columns: float = 0.5
    penalty: float = 5.0
    bins: int = MOST_BINS
    seed: int = 0


@dataclass
class Fitted:
    """start plus, for each tree, the value of the leaf that a row reaches. A tree is a nested dict: inner nodes have
    feature, threshold, cover, left and right (left is <= threshold), leaves value and cover."""

    start: float
    trees: list[dict]

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        for tree in self.trees:
            todo = [(tree, np.arange(len(x)))]
            while todo:
                node, at = todo.pop()
                if "value" in node:
                    out[at] += node["value"]
                elif len(at):
                    right = x[at, node["feature"]] > node["threshold"]  # NaN is left
                    todo += [(node["left"], at[~right]), (node["right"], at[right])]
        return out


# ---- bins ----


def cuts(x: np.ndarray, bins: int = MOST_BINS) -> list[np.ndarray]:
    """Thresholds of each column, ascending: between its values where it has few, else between its quantiles."""
    out = []
    for column in x.T:
        column = column[~np.isnan(column)]
        values = np.unique(column)
        if len(values) > bins:
            values = np.unique(np.quantile(column, np.linspace(0, 1, bins), method="inverted_cdf"))
        out.append((values[1:] + values[:-1]) / 2)
    return out


def cuts_of(df: DataFrame, vector: str, bins: int = MOST_BINS) -> list[np.ndarray]:
    """cuts of a table of any size: the values of a place of the vector that has few, else approximate quantiles; the
    driver holds `bins` numbers for each place."""
    long = df.select(F.posexplode(F.transform(vector, lambda e: e.cast("double"))).alias("i", "x")).where("x is not null and not isnan(x)")
    values = long.distinct()
    few = values.groupBy("i").count().where(F.col("count") <= bins).select("i")
    q = F.percentile_approx("x", F.array(*[F.lit(float(p)) for p in np.linspace(0, 1, bins)]), F.lit(20 * bins))
    known = values.join(F.broadcast(few), "i").groupBy("i").agg(F.collect_list("x").alias("q"))  # a row a place, of `bins` values at most
    many = long.join(F.broadcast(few), "i", "left_anti").groupBy("i").agg(q.alias("q"))
    width = df.select(F.max(F.size(vector))).first()[0] or 0
    out = [np.zeros(0)] * width
    for i, found in known.union(many).collect():
        found = np.unique(found)
        out[i] = (found[1:] + found[:-1]) / 2
    return out


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Bin numbers, from 0; a value at a threshold is in the bin below it. NaN is in bin 0."""
    out = np.zeros(x.shape, np.uint8)
    for j, e in enumerate(edges):
        out[:, j] = np.where(np.isnan(x[:, j]), 0, np.searchsorted(e, x[:, j], side="left"))
    return out


# ---- draws ----


def drawn_rows(hashes: np.ndarray, p: Boosting, tree: int) -> np.ndarray:
    """Whether a tree learns from each row: a share p.rows, by a hash of (row, seed, tree)."""
    if p.rows >= 1:
        return np.ones(len(hashes), bool)
    h = hashes.astype(np.int64).view(np.uint64) + np.uint64((p.seed * 1_000_003 + tree + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    for m in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(m)
    return (h >> np.uint64(11)).astype(float) < p.rows * 2.0**53


def drawn_columns(width: int, p: Boosting, tree: int) -> np.ndarray:
    some = min(width, max(1, int(np.ceil(p.columns * width))))
    return np.sort(np.random.default_rng([p.seed, tree]).choice(width, some, replace=False))


# ---- one tree ----


class _Tree:
    """Nodes of a tree in growth. A node that has a best split has its two sides as nodes from then on, whether it is split or not."""

    def __init__(self):
        self.split: list[tuple[int, int] | None] = [None]  # (feature, highest bin of the left side)
        self.sides: list[tuple[int, int] | None] = [None]
        self.sums: list[tuple[float, float]] = [(0.0, 0.0)]  # gradients in units, rows
        self.gain: list[float] = [0.0]
        self.histogram: dict[int, np.ndarray] = {}  # (2, columns, bins): gradients, rows
        self.inner: set[int] = set()

    def add(self, sums: tuple[float, float]) -> int:
        for part, value in ((self.split, None), (self.sides, None), (self.sums, sums), (self.gain, 0.0)):
            part.append(value)
        return len(self.split) - 1

    def bare(self) -> _Tree:
        """The splits alone, as tasks need them."""
        out = _Tree()
        out.split, out.sides = self.split, self.sides
        return out

    def places(self, bins: np.ndarray) -> np.ndarray:
        """The deepest node that each row reaches."""
        at = np.zeros(len(bins), np.int64)
        for node, split in enumerate(self.split):  # sides come after their node
            if split:
                mine = np.flatnonzero(at == node)
                at[mine] = np.where(bins[mine, split[0]] > split[1], self.sides[node][1], self.sides[node][0])
        return at

    def above(self) -> np.ndarray:
        """The parent of each node, -1 for the root."""
        out = np.full(len(self.split), -1)
        for node, sides in enumerate(self.sides):
            if sides:
                out[list(sides)] = node
        return out


def _best(h: np.ndarray, columns: np.ndarray, p: Boosting) -> tuple[float, tuple[int, int] | None, tuple, tuple]:
    """(gain, (feature, bin), sums of the left side, of the right); equal gains: the first feature, then the lowest bin."""
    g, n = h[0].cumsum(1), h[1].cumsum(1)
    all_g, all_n = g[0, -1], n[0, -1]
    right_g, right_n = all_g - g, all_n - n
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = (g / UNIT) ** 2 / (n + p.penalty) + (right_g / UNIT) ** 2 / (right_n + p.penalty) - (all_g / UNIT) ** 2 / (all_n + p.penalty)
    gain[(n < max(p.least, 1)) | (right_n < max(p.least, 1))] = -np.inf
    k = int(np.argmax(gain))
    if not gain.flat[k] > 1e-12:
        return 0.0, None, (), ()
    j, b = divmod(k, gain.shape[1])
    return float(gain[j, b]), (int(columns[j]), b), (g[j, b], n[j, b]), (right_g[j, b], right_n[j, b])


def _growth(tree: _Tree, columns: np.ndarray, p: Boosting, ahead: bool) -> Generator[list[int], dict[int, np.ndarray], None]:
    """Asks for histograms of nodes (the right side's is the difference) until the tree has its leaves."""

    def learn(got: dict[int, np.ndarray]):
        parent = tree.above()
        for node, h in sorted(got.items()):
            tree.histogram[node] = h
            if (up := parent[node]) >= 0:
                tree.histogram[tree.sides[up][1]] = tree.histogram[up] - h
        for node in sorted(tree.histogram):
            h = tree.histogram[node]
            if node == 0 and tree.sums[0] == (0.0, 0.0):
                tree.sums[0] = (h[0, 0].sum(), h[1, 0].sum())
            if tree.split[node] is None and node not in known:
                known.add(node)
                gain, split, left, right = _best(h, columns, p)
                if split:
                    tree.gain[node], tree.split[node] = gain, split
                    tree.sides[node] = (tree.add(left), tree.add(right))

    known: set[int] = set()
    learn((yield [0]))
    leaves = [0]
    while len(leaves) < p.leaves:
        if due := [tree.sides[up][0] for up in tree.inner if any(s in leaves and s not in known for s in tree.sides[up])]:
            if ahead:
                due += [tree.sides[x][0] for x in leaves if x in known and tree.split[x] and tree.sides[x][0] not in known]
            learn((yield sorted(set(due))))
        best = max((x for x in leaves if tree.split[x]), key=lambda x: (tree.gain[x], -x), default=None)
        if best is None:
            return
        leaves.remove(best)
        leaves += tree.sides[best]
        tree.inner.add(best)


def _value(sums: tuple[float, float], p: Boosting) -> float:
    return -p.rate * (sums[0] / UNIT) / (sums[1] + p.penalty) if sums[1] + p.penalty else 0.0


def _nested(tree: _Tree, edges: list[np.ndarray], p: Boosting, node: int = 0) -> dict:
    if node not in tree.inner:
        return {"value": _value(tree.sums[node], p), "cover": float(tree.sums[node][1])}
    (f, b), (left, right) = tree.split[node], tree.sides[node]
    return {"feature": f, "threshold": float(edges[f][b]), "cover": float(tree.sums[node][1]), "left": _nested(tree, edges, p, left), "right": _nested(tree, edges, p, right)}


def _values(tree: _Tree, p: Boosting) -> np.ndarray:
    """For each node the value of the leaf that it belongs to."""
    parent, out = tree.above(), np.zeros(len(tree.split))
    for node in range(len(out)):
        up = parent[node]
        out[node] = _value(tree.sums[node], p) if up < 0 or up in tree.inner else out[up]
    return out


def _units(pred: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.rint((pred - y) * UNIT)


def _histogram(bins: np.ndarray, g: np.ndarray, columns: np.ndarray, width: int) -> np.ndarray:
    """(2, columns, width); doubles hold the integers exactly."""
    flat = (bins[:, columns] + np.arange(len(columns)) * width).ravel()
    out = [np.bincount(flat, w, len(columns) * width) for w in (np.repeat(g, len(columns)), None)]
    return np.stack(out).reshape(2, len(columns), width).astype(float)


# ---- a fit in one task ----


def grown(x: np.ndarray, y: np.ndarray, hashes: np.ndarray, p: Boosting, edges: list[np.ndarray] | None = None) -> Fitted:
    """A fit of rows held in memory."""
    edges = cuts(x, p.bins) if edges is None else edges
    return _grown(np.ascontiguousarray(binned(x, edges).T), y, hashes, p, edges)


def _grown(bins: np.ndarray, y: np.ndarray, hashes: np.ndarray, p: Boosting, edges: list[np.ndarray]) -> Fitted:
    """bins has a row a column. Rows are parted as nodes are split, and of two sides the smaller is counted."""
    start, width = start_of(y.sum(), len(y)), max((len(e) for e in edges), default=0) + 1
    pred, out = np.full(len(y), start), []
    for k in range(p.trees if len(y) else 0):
        columns = drawn_columns(len(bins), p, k)
        tree, g = _Tree(), _units(pred, y)
        everyone, drawn = {0: np.arange(len(y))}, {0: np.flatnonzero(drawn_rows(hashes, p, k))}
        asks = _growth(tree, columns, p, ahead=False)
        ask = next(asks)
        try:
            while True:
                parent, got = tree.above(), {}
                for node in ask:  # the root, or the left side of a node
                    up = parent[node]
                    other = tree.sides[up][1] if up >= 0 else node
                    if tree.sums[other][1] < tree.sums[node][1]:
                        got[node] = tree.histogram[up] - _counted(bins, g, _members(tree, bins, drawn, other), columns, width)
                    else:
                        got[node] = _counted(bins, g, _members(tree, bins, drawn, node), columns, width)
                ask = asks.send(got)
        except StopIteration:
            pass
        if not tree.inner and not tree.sums[0][1]:
            break
        for leaf in {s for node in tree.inner for s in tree.sides[node]} - tree.inner or {0}:
            pred[_members(tree, bins, everyone, leaf)] += _value(tree.sums[leaf], p)
        out.append(_nested(tree, edges, p))
    return Fitted(start, out)


def _members(tree: _Tree, bins: np.ndarray, held: dict[int, np.ndarray], node: int) -> np.ndarray:
    """The rows of a node; held has those of the nodes parted so far that are not parted themselves."""
    if node not in held:
        up = int(tree.above()[node])
        (f, b), mine = tree.split[up], _members(tree, bins, held, up)
        right = bins[f][mine] > b
        del held[up]
        held[tree.sides[up][0]], held[tree.sides[up][1]] = mine[~right], mine[right]
    return held[node]


#: Rows that a histogram takes at once, so that they stay in a processor's cache.
AT_ONCE = 1 << 15

#: Rows below which all columns are counted together.
FEW = 1 << 11


def _counted(bins: np.ndarray, g: np.ndarray, rows: np.ndarray, columns: np.ndarray, width: int) -> np.ndarray:
    """_histogram of some rows of bins that have a row a column."""
    if len(rows) < FEW:
        return _histogram(bins[:, rows].T, g[rows], columns, width)
    out = np.zeros((2, len(columns), width))
    for k in range(0, len(rows), AT_ONCE):
        some = rows[k : k + AT_ONCE]
        mine = g[some]
        for c, j in enumerate(columns):
            b = bins[j][some].astype(np.intp)
            out[0, c] += np.bincount(b, mine, width)
            out[1, c] += np.bincount(b, minlength=width)
    return out


def start_of(total: float, n: int) -> float:
    """The mean label in units, so that it does not depend on the order of a sum."""
    return round(total / n * UNIT) / UNIT if n else 0.0


# ---- fits over a table ----

#: Trees after which the table is written anew with its predictions.
REWRITE = 20

#: Bins (rows times columns) of a table up to which a fit may be grown in one task, which holds a byte for each and some 200
#: bytes a row.
HELD = 1 << 25


def fitted(df: DataFrame, key: str, vector: str, label: str, fits: list[tuple[Boosting, int, int]], own: str | None = None, edges: list[np.ndarray] | None = None, write=None, held: int = 0) -> list[Fitted]:
    """A fit for each (parameters, repeat, fold): it learns from labelled rows whose fold in that repeat, a place of the array `own`, is another.

    All parameters but the seed must be equal. write(df, name) writes a table and reads it back; by default a checkpoint.
    The driver holds histograms: fits times nodes times columns times bins numbers. A table of up to `held` bins is instead
    read by a task for each fit, which grows the same trees.
    """
    write = write or (lambda table, _: checkpointed(table))
    labelled = df.where(F.col(label).isNotNull() & ~F.isnan(F.col(label).cast("double")))
    edges = cuts_of(labelled, vector) if edges is None else edges
    width = max((len(e) for e in edges), default=0) + 1
    p = fits[0][0]

    def cut(batches):
        for b in batches:
            x = np.array([[np.nan if e is None else e for e in v] for v in b["x"]], float).reshape(len(b), len(edges))
            yield pd.DataFrame({"h": b["h"], "y": b["y"], "own": b["own"], "bins": [r.tobytes() for r in binned(x, edges)]})

    folds = F.col(own) if own else F.array().cast("array<int>")
    rows = labelled.select(F.xxhash64(key).alias("h"), F.col(label).cast("double").alias("y"), folds.cast("array<int>").alias("own"), F.transform(vector, lambda e: e.cast("double")).alias("x"))
    table = write(rows.mapInPandas(cut, "h long, y double, own array<int>, bins binary"), "bins")
    if table.count() * len(edges) <= held:
        return _in_tasks(table, fits, edges, write)
    starts = [start_of(*_mean(table, r, f)) for _, r, f in fits]
    table = write(table.withColumn("pred", F.array(*[F.lit(s) for s in starts])), "bins")
    out = [Fitted(s, []) for s in starts]
    recent: list[list[tuple[_Tree, np.ndarray]]] = []
    for k in range(p.trees):
        columns = [drawn_columns(len(edges), q, k) for q, *_ in fits]
        trees = [_Tree() for _ in fits]
        asks = [_growth(t, c, p, ahead=True) for t, c in zip(trees, columns, strict=True)]
        ask = {i: next(a) for i, a in enumerate(asks)}
        while ask:
            got = _summed(table, fits, trees, recent, columns, ask, k, width)
            now, ask = ask, {}
            for i in now:
                try:
                    ask[i] = asks[i].send(got[i])
                except StopIteration:
                    pass
        recent.append([(t.bare(), _values(t, p)) for t in trees])
        for o, t in zip(out, trees, strict=True):
            o.trees.append(_nested(t, edges, p))
        if len(recent) == REWRITE and k + 1 < p.trees:
            table, recent = write(table.mapInPandas(_predicting(recent), table.schema), "bins"), []
    return out


def _in_tasks(table: DataFrame, fits: list[tuple[Boosting, int, int]], edges: list[np.ndarray], write) -> list[Fitted]:
    """A task for each fit. It reads the binned rows where they are written: no copy of them is made for a fit."""
    repeats = max((r for _, r, _ in fits), default=0) + 1
    names = ("h", "y", "own", "bins")

    def pack(batches):
        for b in batches:
            if len(b):
                own = np.full((len(b), repeats), -1, np.int32)  # no fold
                for i, o in enumerate(b["own"]):
                    for r, f in enumerate(o[:repeats]):
                        own[i, r] = -1 if f is None or f != f else f
                parts = (b["h"].to_numpy(np.int64), b["y"].to_numpy(np.float64), own)
                yield pd.DataFrame([[a.tobytes() for a in parts] + [b"".join(b["bins"])]], columns=names)

    def grow(batches):
        strips: dict[int, list] = {}
        for b in batches:
            for i, h, y, own, bins in b[["id", *names]].itertuples(index=False):
                h = np.frombuffer(h, np.int64)
                p, repeat, fold = fits[i]
                use = np.flatnonzero((np.frombuffer(own, np.int32).reshape(len(h), -1)[:, repeat] != fold) | (fold < 0))
                strips.setdefault(i, []).append((h[use], np.frombuffer(y)[use], np.frombuffer(bins, np.uint8).reshape(len(h), -1)[use].T))
        for i in list(strips):
            parts = strips.pop(i)
            h, y, bins = (np.concatenate([x[k] for x in parts], axis=-1) for k in range(3))
            del parts  # the rows are held once
            fit = _grown(bins, y, h, fits[i][0], edges)
            yield pd.DataFrame({"fit": [i], "start": [fit.start], "trees": [json.dumps(fit.trees)]})

    packed = write(table.mapInPandas(pack, "h binary, y binary, own binary, bins binary").coalesce(1), "strips")
    of = table.sparkSession.range(0, len(fits), 1, len(fits))  # a partition a fit
    got = of.join(packed.hint("shuffle_replicate_nl")).mapInPandas(grow, "fit int, start double, trees string").collect()
    out = [Fitted(0.0, []) for _ in fits]
    for r in got:
        out[r["fit"]] = Fitted(r["start"], json.loads(r["trees"]))
    return out


def _mean(table: DataFrame, repeat: int, fold: int) -> tuple[float, int]:
    mine = table if fold < 0 else table.where(F.coalesce(F.get("own", F.lit(repeat)) != fold, F.lit(True)))
    return tuple(mine.agg(F.coalesce(F.sum("y"), F.lit(0.0)), F.count("y")).first())


def _matrix(b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    bins = np.frombuffer(b"".join(b["bins"]), np.uint8).reshape(len(b), -1)
    return bins, np.stack(b["pred"].to_numpy()).astype(float)


def _add(pred: np.ndarray, bins: np.ndarray, recent: list) -> np.ndarray:
    for trees in recent:
        for i, (tree, values) in enumerate(trees):
            pred[:, i] += values[tree.places(bins)]
    return pred


def _predicting(recent: list):
    def add(batches):
        for b in batches:
            if len(b):
                bins, pred = _matrix(b)
                b["pred"] = list(_add(pred, bins, recent))
            yield b

    return add


def _summed(table: DataFrame, fits: list, trees: list[_Tree], recent: list, columns: list[np.ndarray], ask: dict[int, list[int]], k: int, width: int) -> dict[int, dict[int, np.ndarray]]:
    """The histograms asked for, of all fits, in one aggregate."""

    bare = [t.bare() for t in trees]

    def each(batches):
        held: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            if not len(b):
                continue
            bins, pred = _matrix(b)
            pred, y, h = _add(pred, bins, recent), b["y"].to_numpy(float), b["h"].to_numpy()
            for i, nodes in ask.items():
                p, repeat, fold = fits[i]
                use = drawn_rows(h, p, k)
                if fold >= 0:
                    use &= np.array([repeat >= len(o) or o[repeat] != fold for o in b["own"]])
                use = np.flatnonzero(use)
                at, g = bare[i].places(bins[use]), _units(pred[use, i], y[use])
                for node in nodes:
                    mine = at == node
                    held[i, node] = held.get((i, node), 0) + _histogram(bins[use[mine]], g[mine], columns[i], width)
        for (i, node), v in held.items():
            v = v.reshape(2, -1)
            cell = np.flatnonzero(v[1])
            yield pd.DataFrame({"fit": i, "node": node, "cell": cell, "g": v[0, cell].astype(np.int64), "n": v[1, cell].astype(np.int64)})

    sums = table.mapInPandas(each, "fit int, node int, cell int, g long, n long").groupBy("fit", "node", "cell").agg(F.sum("g").alias("g"), F.sum("n").alias("n")).toPandas()
    out = {i: {node: np.zeros((2, len(columns[i]) * width)) for node in nodes} for i, nodes in ask.items()}
    for (i, node), s in sums.groupby(["fit", "node"]):
        out[i][node][:, s["cell"]] = s[["g", "n"]].to_numpy(float).T
    return {i: {node: h.reshape(2, -1, width) for node, h in v.items()} for i, v in out.items()}


def predicted(df: DataFrame, vector: str, models: list[Fitted], out: str = "pred") -> DataFrame:
    """df with the mean prediction of the models; map only."""

    def each(batches):
        for b in batches:
            if len(b):
                x = np.array([[np.nan if e is None else e for e in v] for v in b["_x"]], float)
                yield b.drop(columns="_x").assign(**{out: np.mean([m.predict(x) for m in models], 0)})

    schema = T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType())])
    return df.withColumn("_x", F.transform(vector, lambda e: e.cast("double"))).mapInPandas(each, schema)

"""Regressors and the ensemble.

Ridge fits of a view run once for each (view, repeat, fold) group in numpy: a view is at most a few thousand rows wide as
a kernel; beyond MOST_ROWS rows the primal normal equations of every fold are summed by Spark instead. The stack's Gram matrix has
the size of the number of models squared and is one aggregate, whatever the number of rows.
"""

from __future__ import annotations

import itertools
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorefabric.operators.folds import group_folds

ALPHAS = np.logspace(-1, 6, 36) / 1000
SEARCH = np.logspace(-2, 3, 30)
MOST_ROWS = 5000

# ---- kernel ridge ----


def standardised(x: np.ndarray) -> np.ndarray:
    sd = x.std(0)
    return (x - x.mean(0)) / np.where(sd > 1e-8, sd, 1.0)


def gram(x: np.ndarray) -> np.ndarray:
    return x @ x.T / x.shape[1]


def _centre(k: np.ndarray, means: np.ndarray) -> np.ndarray:
    """Inner products about the training rows' mean: `means` are those of the training kernel's columns."""
    out = k - means
    out -= out.mean(1, keepdims=True)
    return out


def _spectrum(k: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(variances, directions, the centred target in them) of a training kernel."""
    variance, axes = np.linalg.eigh(_centre(k, k.mean(0)))
    return variance.clip(min=0), axes, (y - y.mean()) @ axes


def ridge_predict(k: np.ndarray, k_new: np.ndarray, y: np.ndarray, alphas: np.ndarray = ALPHAS) -> np.ndarray:
    """Predictions for new rows at every alpha, (alphas, rows): one product, as alphas differ in weights of directions only."""
    variance, axes, target = _spectrum(k, y)
    weights = target / np.add.outer(alphas, variance)
    return weights @ (_centre(k_new, k.mean(0)) @ axes).T + y.mean()


def ridge_loo(k: np.ndarray, y: np.ndarray, alphas: np.ndarray = ALPHAS) -> int:
    """The alpha (its place) of least leave-one-out error, all at once; a row left out keeps its part in the centring."""
    variance, axes, target = _spectrum(k, y)
    share = variance / np.add.outer(alphas, variance)
    rest = (y - y.mean()) - (share * target) @ axes.T
    free = 1 - share @ np.square(axes).T
    return int(np.square(rest / free.clip(min=1e-6)).sum(1).argmin())


def ridge_grouped(k: np.ndarray, y: np.ndarray, groups: np.ndarray, alphas: np.ndarray = ALPHAS, inner: int = 4) -> int:
    """The alpha of least squared error over inner folds that keep groups together."""
    names, sizes = np.unique(groups, return_counts=True)
    fold_of = group_folds(dict(zip(names.tolist(), sizes.tolist(), strict=True)), min(inner, len(names)))
    fold = np.array([fold_of[g] for g in groups.tolist()])
    err = np.zeros(len(alphas))
    for f in np.unique(fold):
        t, v = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
        if len(t):
            err += ((ridge_predict(k[np.ix_(t, t)], k[np.ix_(v, t)], y[t], alphas) - y[v]) ** 2).sum(1)
    return int(np.argmin(err))


def ridge_oof(view: DataFrame, folds: DataFrame, key: str, vector: str, label: str, group: str, mode: str = "grouped") -> DataFrame:
    """(view, key, repeat, fold, pred, alpha): every labelled row predicted once a repeat, unlabelled rows by every fold.

    view: (view, key, vector, label, group), label null for test rows; folds: (group, repeat, fold). One task for each
    (view, repeat, fold); z-scores are fitted on labelled and unlabelled rows together.
    """
    n = view.groupBy("view").count().agg(F.max("count")).first()[0] or 0
    if n > MOST_ROWS:
        if mode != "grouped":
            raise ValueError(f"a view has {n} rows: leave-one-out errors take {MOST_ROWS} at most")
        return _primal_oof(view, folds, key, vector, label, group)
    jobs = folds.select("repeat", "fold").distinct()
    by_group = folds.select(F.col(group), "repeat", F.col("fold").alias("_own"))
    rows = view.select("view", key, vector, label, group)
    placed = rows.join(by_group, group, "left").withColumnRenamed("repeat", "_r")
    fan = placed.join(F.broadcast(jobs)).where(F.col("_r").isNull() | (F.col("_r") == F.col("repeat"))).drop("_r")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key).reset_index(drop=True)
        x = standardised(np.stack(pdf[vector].to_numpy()).astype(float))
        y, own, fold = pdf[label].to_numpy(float), pdf["_own"].to_numpy(), int(pdf["fold"].iloc[0])
        labelled = ~np.isnan(y)
        t = np.flatnonzero(labelled & (own != fold))
        v = np.flatnonzero((labelled & (own == fold)) | ~labelled)
        if not len(t) or not len(v):
            return pd.DataFrame({"view": [], key: [], "repeat": [], "fold": [], "pred": [], "alpha": []})
        k = gram(x)
        kt = k[np.ix_(t, t)]
        a = ridge_loo(kt, y[t]) if mode == "loo" else ridge_grouped(kt, y[t], pdf[group].to_numpy()[t])
        p = ridge_predict(kt, k[np.ix_(v, t)], y[t], ALPHAS[a : a + 1])[0]
        return pd.DataFrame({"view": pdf["view"].iloc[0], key: pdf[key].to_numpy()[v], "repeat": int(pdf["repeat"].iloc[0]), "fold": fold, "pred": p, "alpha": ALPHAS[a]})

    kind = view.schema[key].dataType.simpleString()
    return fan.groupBy("view", "repeat", "fold").applyInPandas(fit, f"view string, {key} {kind}, repeat int, fold int, pred double, alpha double")


def _primal_oof(view: DataFrame, folds: DataFrame, key: str, vector: str, label: str, group: str, inner: int = 4, jobs: DataFrame | None = None, everyone: bool = False) -> DataFrame:
    """ridge_oof for any number of rows: moments of (1, z, y) are summed for each (view, repeat, fold, inner fold), and
    inner errors are quadratic forms of them. A task holds the table of group sizes of a view and repeat. With everyone,
    rows that were learnt from are predicted too."""
    spark, kind = view.sparkSession, view.schema[key].dataType.simpleString()
    gkind = view.schema[group].dataType.simpleString()
    jobs = folds.select("repeat", "fold").distinct() if jobs is None else jobs
    x = F.transform(vector, lambda e: e.cast("double"))
    rows = view.select("view", key, x.alias("x"), F.col(label).cast("double").alias("y"), group)
    rows = rows.withColumn("y", F.when(~F.isnan("y"), F.col("y")))
    placed = rows.join(folds.select(F.col(group), F.col("repeat").alias("_r"), F.col("fold").alias("_own")), group, "left")
    at = placed.join(F.broadcast(jobs.select("repeat").distinct())).where(F.col("_r").isNull() | (F.col("_r") == F.col("repeat"))).drop("_r")
    long = at.select("view", "repeat", F.posexplode("x").alias("i", "e")).groupBy("view", "repeat", "i").agg(F.avg("e").alias("mean"), F.stddev_pop("e").alias("sd"))
    scale = {}
    for r in long.orderBy("view", "repeat", "i").collect():  # views times repeats times dimensions rows
        m, sd = scale.setdefault((r["view"], r["repeat"]), ([], []))
        m.append(r["mean"]), sd.append(r["sd"] if r["sd"] > 1e-8 else 1.0)
    scale = {k: tuple(map(np.array, v)) for k, v in scale.items()}
    train = at.where("y is not null").join(F.broadcast(jobs), "repeat").where(F.col("_own").isNull() | (F.col("_own") != F.col("fold")))

    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        of = group_folds(dict(zip(pdf[group].tolist(), pdf["n"].tolist(), strict=True)), min(inner, len(pdf)))
        return pd.DataFrame({"view": pdf["view"], "repeat": pdf["repeat"], "fold": pdf["fold"], group: pdf[group], "inner": [of[g] for g in pdf[group].tolist()]})

    sizes = train.groupBy("view", "repeat", "fold", group).agg(F.count(F.lit(1)).alias("n"))
    dealt = sizes.groupBy("view", "repeat", "fold").applyInPandas(deal, f"view string, repeat int, fold int, {group} {gkind}, inner int")

    def sums(batches):
        held: dict = {}
        for pdf in batches:
            for k, g in pdf.groupby(["view", "repeat", "fold", "inner"]):
                m, sd = scale[k[:2]]
                z = (np.stack(g["x"].to_numpy()) - m) / sd / np.sqrt(len(m))
                a = np.column_stack([np.ones(len(z)), z, g["y"].to_numpy(float)])
                held[k] = held.get(k, 0) + a.T @ a
        yield pd.DataFrame([(*k, v.ravel()) for k, v in held.items()], columns=["view", "repeat", "fold", "inner", "s"])

    parts = train.join(dealt, ["view", "repeat", "fold", group]).select("view", "repeat", "fold", "inner", "x", "y").mapInPandas(sums, "view string, repeat int, fold int, inner int, s array<double>")

    def fitted(s: np.ndarray):
        n, mean = s[0, 0], s[0, 1:] / s[0, 0]
        c = s[1:, 1:] - n * np.outer(mean, mean)
        lam, u = np.linalg.eigh(c[:-1, :-1])
        q = u.T @ c[:-1, -1]
        w = np.stack([u @ (q / (np.maximum(lam, 0) + a)) for a in ALPHAS])
        return w, mean[-1] - w @ mean[:-1]

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        wide_ = int(np.sqrt(len(pdf["s"].iloc[0])))
        cell: dict = {}
        for i, v in zip(pdf["inner"], pdf["s"], strict=True):
            cell[i] = cell.get(i, 0) + np.asarray(v).reshape(wide_, wide_)
        every, err = sum(cell.values()), np.zeros(len(ALPHAS))
        for v in cell.values():
            if every[0, 0] - v[0, 0] > 0.5:
                w, b = fitted(every - v)
                e = np.column_stack([b, w, -np.ones(len(b))])  # the error is this row by (1, z, y)
                err += np.einsum("ai,ij,aj->a", e, v, e)
        a = int(np.argmin(err))
        w, b = fitted(every)
        m, sd = scale[pdf["view"].iloc[0], pdf["repeat"].iloc[0]]
        w = w[a] / sd / np.sqrt(len(m))
        return pd.DataFrame({"view": [pdf["view"].iloc[0]], "repeat": [int(pdf["repeat"].iloc[0])], "fold": [int(pdf["fold"].iloc[0])], "w": [w], "b": [float(b[a] - w @ m)], "alpha": [ALPHAS[a]]})

    fits = parts.groupBy("view", "repeat", "fold").applyInPandas(solve, "view string, repeat int, fold int, w array<double>, b double, alpha double")
    fits = spark.createDataFrame(fits.collect(), fits.schema)  # one row a fit
    new = at.join(F.broadcast(fits), ["view", "repeat"]).where(F.lit(everyone) | F.col("y").isNull() | (F.col("_own") == F.col("fold")))
    pred = F.aggregate(F.zip_with("x", "w", lambda p, q: p * q), F.col("b"), lambda s, e: s + e)
    return new.select("view", F.col(key).cast(kind).alias(key), "repeat", "fold", pred.alias("pred"), "alpha")


def primal_ridge(df: DataFrame, features: list[str], label: str, alpha: float) -> tuple[np.ndarray, float]:
    """Weights and intercept from centred normal equations summed by Spark: features squared numbers reach the driver."""
    c, v, m = covariances(df, features, label)
    w = np.linalg.solve(c + alpha * np.eye(len(features)) / max(1, m["n"]), v)
    return w, m["y"] - float(w @ np.array([m[f] for f in features]))


def svr_fit(k: np.ndarray, y: np.ndarray, c: float = 3.0, eps: float = 0.1, tol: float = 1e-3, most: int = 1_000_000) -> tuple[np.ndarray, float, float]:
    """(weights, bias, KKT residual) of epsilon-insensitive regression on a kernel, by sequential minimal optimisation.

    The dual has a weight for each row, between -c and c, and they add up to 0. The residual is the violation that is left,
    `tol` at most unless the steps run out.
    """
    n = len(y)
    if not n:
        return np.zeros(0), 0.0, 0.0
    w, f = svr_steps(k, y, np.zeros(n), np.zeros(n), c, eps, tol, most)
    up, down = svr_slopes(w, f - y, c, eps)
    return w, -(up.min() + down.max()) / 2, max(0.0, float(down.max() - up.min()))


def svr_slopes(w: np.ndarray, slack: np.ndarray, c: float, eps: float) -> tuple[np.ndarray, np.ndarray]:
    """The slope of the objective when a weight goes up, and when it goes down: they differ by 2 eps at weight 0."""
    return np.where(w < c, slack + np.where(w >= 0, eps, -eps), np.inf), np.where(w > -c, slack - np.where(w > 0, -eps, eps), -np.inf)


def svr_steps(k: np.ndarray, y: np.ndarray, w: np.ndarray, f: np.ndarray, c: float, eps: float, tol: float, most: int = 1_000_000) -> tuple[np.ndarray, np.ndarray]:
    """(weights, outputs without bias) after steps on the rows of the kernel, from given weights and outputs; what other
    rows add to the outputs stays as it is.

    Two weights move at a time, one up and one down: the one whose gradient is furthest below what optimality asks for,
    and the partner that lowers the objective most.
    """
    w, slack, diagonal = w.copy(), f - y, np.diag(k).copy()
    if not len(w):
        return w, f.copy()
    rise, fall = svr_slopes(w, np.zeros(len(w)), c, eps)
    up, down, curve = np.empty(len(w)), np.empty(len(w)), np.empty(len(w))
    for _ in range(most):
        np.add(slack, rise, out=up)
        np.add(slack, fall, out=down)
        i = int(up.argmin())
        low = up[i]
        if down.max() - low <= tol:
            break
        lead = np.subtract(down, low, out=down)
        np.multiply(k[i], -2, out=curve)
        curve += diagonal
        curve += diagonal[i]
        np.maximum(curve, 1e-12, out=curve)
        gain = np.maximum(lead, 0, out=up)
        gain *= gain
        gain /= curve
        j = int(gain.argmax())
        step = lead[j] / curve[j]
        # a step ends where a weight meets 0, where its slope changes, or its bound
        step = min(step, -w[i] if w[i] < 0 else c - w[i], w[j] if w[j] > 0 else w[j] + c)
        w[i] += step
        w[j] -= step
        for at in (i, j):
            if abs(w[at]) < 1e-15 * c:
                w[at] = 0.0
            rise[at] = (eps if w[at] >= 0 else -eps) if w[at] < c else np.inf
            fall[at] = (eps if w[at] > 0 else -eps) if w[at] > -c else -np.inf
        change = np.subtract(k[i], k[j], out=up)
        change *= step
        slack += change
    return w, slack + y


#: Rows and columns of a kernel that are made at a time: they stay in a processor's cache.
TILE = 1024, 512

#: Rows of a working set inside a task at most, and by how much a set lowers its violation before the next one is chosen:
#: sets that are left early move each row less often.
SET, LEFT = 2048, 1.25

#: Tolerances from here on allow kernels in single precision; outputs are summed in double precision.
SINGLE = 1e-4


def _exponents(z: np.ndarray, gamma: float, kind) -> tuple[np.ndarray, np.ndarray]:
    """(left, right): the product of a row of one with a row of the other is the exponent of their RBF kernel."""
    s = z * np.sqrt(2 * gamma)
    half, one = -(s * s).sum(1) / 2, np.ones(len(s))
    return np.column_stack([s, half, one]).astype(kind), np.column_stack([s, one, half]).astype(kind)


def _added(out: np.ndarray, left: np.ndarray, right: np.ndarray, w: np.ndarray) -> None:
    """out, in place: plus the kernel of left and right times w, a tile at a time."""
    hold, w = np.empty(TILE, left.dtype), w.astype(left.dtype)
    for k in range(0, len(right), TILE[1]):
        some, mine = np.ascontiguousarray(right[k : k + TILE[1]].T), w[k : k + TILE[1]]
        for r in range(0, len(left), TILE[0]):
            rows = left[r : r + TILE[0]]
            tile = np.matmul(rows, some, out=hold.ravel()[: len(rows) * len(mine)].reshape(len(rows), len(mine)))
            out[r : r + TILE[0]] += np.exp(tile, out=tile) @ mine


def svr_held(z: np.ndarray, z_new: np.ndarray, y: np.ndarray, gamma: float, c: float, eps: float, tol: float, most: int = SET) -> tuple[np.ndarray, float]:
    """(outputs with bias for z_new, KKT residual) of the fit of svr_fit on an RBF kernel that is never held whole: the rows
    that violate optimality most are solved alone, `most` of them about, and their changes are added to all outputs.

    Memory grows with the rows, time with their square: a kernel's worth of entries for each time that all rows move once.
    """
    n, kind = len(y), np.float32 if tol >= SINGLE else np.float64
    left, right = _exponents(z, gamma, kind)
    w, f = np.zeros(n), np.zeros(n)
    while True:
        up, down = svr_slopes(w, f - y, c, eps)
        gap = float(down.max() - up.min())
        if gap <= tol:
            break
        half = max(1, most // 2)
        some = np.union1d(np.argpartition(up, half)[:half], np.argpartition(-down, half)[:half]) if n > most else np.arange(n)
        new, _ = svr_steps(np.exp(left[some] @ right[some].T).astype(float), y[some], w[some], f[some], c, eps, max(tol / 2, gap / LEFT))
        moved = np.flatnonzero(new != w[some])
        _added(f, left, right[some[moved]], (new - w[some])[moved])
        w[some] = new
    out, used = np.full(len(z_new), -(up.min() + down.max()) / 2), np.flatnonzero(w)
    _added(out, _exponents(z_new, gamma, kind)[0], right[used], w[used])
    return out, max(0.0, gap)


def svr(k: np.ndarray, k_new: np.ndarray, y: np.ndarray, c: float = 3.0, eps: float = 0.1) -> np.ndarray:
    w, bias, _ = svr_fit(k, y, c, eps)
    return k_new @ w + bias


def components_of(n: int, mean: np.ndarray, cov: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(mean, scale, axes, variances) of the first principal components of standardised columns, from their covariance.

    An axis points where its largest entry is positive.
    """
    sd = np.sqrt(np.diag(cov))
    scale = np.where(sd > 1e-8, sd, 1.0)
    variance, axes = np.linalg.eigh(cov / np.outer(scale, scale))
    keep = np.argsort(-variance, kind="stable")[: max(1, min(most, n - 1, len(mean)))]
    axes = axes[:, keep]
    signs = np.sign(axes[np.abs(axes).argmax(0), np.arange(len(keep))])
    return mean, scale, axes * signs, variance[keep].clip(min=0)


def principal(df: DataFrame, vector: str, most: int = 128) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """components_of the rows of a table of any size: tasks send on sums about the first row's values; the driver holds one matrix.

    Rows with a null vector are left out; no rows: no components.
    """
    rows = df.where(F.col(vector).isNotNull()).select(F.transform(vector, lambda e: e.cast("double")).alias("x"))
    first = rows.first()
    if first is None:
        return np.zeros(0), np.zeros(0), np.zeros((0, 0)), np.zeros(0)
    shift = np.array(first["x"])

    def sums(batches):
        s = np.zeros((len(shift) + 1,) * 2)
        for pdf in batches:
            if len(pdf):
                a = np.column_stack([np.ones(len(pdf)), np.stack(pdf["x"].to_numpy()) - shift])
                s += a.T @ a
        yield pd.DataFrame({"i": np.arange(len(s)), "s": list(s)})

    long = rows.mapInPandas(sums, "i int, s array<double>").select("i", F.posexplode("s").alias("j", "v"))
    total = np.zeros((len(shift) + 1,) * 2)
    for i, j, v in long.groupBy("i", "j").agg(F.sum("v").alias("v")).toLocalIterator():
        total[i, j] = v
    n, m = total[0, 0], total[0, 1:] / total[0, 0]
    return components_of(int(n), m + shift, total[1:, 1:] / n - np.outer(m, m), most)


def pca_svr(x: np.ndarray, train: np.ndarray, new: np.ndarray, y: np.ndarray, n: int = 128, c: float = 3.0, eps: float = 0.1) -> np.ndarray:
    """Predictions for `new`: z-scores and principal components of the training rows, RBF kernel, epsilon-insensitive fit."""
    return pca_svr_fit(x[train], y, x[new], n, c, eps)[0]


def pca_svr_fit(x: np.ndarray, y: np.ndarray, new: np.ndarray, n: int = 128, c: float = 3.0, eps: float = 0.1, tol: float = 1e-3, working: int = 0) -> tuple[np.ndarray, float]:
    """(predictions for `new`, KKT residual); the kernel's scale is one over columns times variance. With a working set the
    kernel is never held whole."""
    mean, scale, axes, _ = components_of(len(x), x.mean(0), np.cov(x.T, bias=True).reshape(x.shape[1], x.shape[1]), n)
    z, z_new = ((a - mean) / scale @ axes for a in (x, new))
    gamma = 1 / (z.shape[1] * max(z.var(), 1e-12))
    if working:
        return svr_held(z, z_new, y, gamma, c, eps, tol, min(working, SET))
    w, bias, gap = svr_fit(rbf(z, z, gamma), y, c, eps, tol)
    return rbf(z_new, z, gamma) @ w + bias, gap


def rbf(a: np.ndarray, b: np.ndarray, gamma: float) -> np.ndarray:
    out = a @ b.T
    out *= -2
    out += (a * a).sum(1)[:, None]
    out += (b * b).sum(1)[None, :]
    np.maximum(out, 0, out=out)
    out *= -gamma
    return np.exp(out, out=out)


def boosted_trees(features: str = "features", label: str = "label", trees: int = 500, rate: float = 0.02, seed: int = 42):
    """Gradient-boosted trees of depth 3 (some 7 leaves), rows and columns subsampled."""
    from pyspark.ml.regression import GBTRegressor

    return GBTRegressor(featuresCol=features, labelCol=label, maxIter=trees, stepSize=rate, maxDepth=3, subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=seed)


# ---- out-of-fold tables ----


def oof_mean(preds: DataFrame, key: list[str], models: str = "model") -> DataFrame:
    """Mean over repeats and folds with the count that contracts check."""
    return preds.groupBy(models, *key).agg(F.avg("pred").alias("pred"), F.count(F.lit(1)).alias("n"))


def wide(oof: DataFrame, key: list[str], names: list[str], models: str = "model") -> DataFrame:
    return oof.groupBy(*key).pivot(models, names).agg(F.first("pred"))


# ---- non-negative stack ----


def covariances(df: DataFrame, models: list[str], label: str):
    """(C, v, means): population covariances of the models and with the label, in one aggregate."""
    pairs = list(itertools.combinations_with_replacement(range(len(models)), 2))
    row = df.agg(
        *[F.covar_pop(models[i], models[j]).alias(f"c{i}_{j}") for i, j in pairs], *[F.covar_pop(m, label).alias(f"v{i}") for i, m in enumerate(models)], *[F.avg(m).alias(f"m{i}") for i, m in enumerate(models)], F.avg(label).alias("y"), F.count(F.lit(1)).alias("n")
    ).first()
    c = np.zeros((len(models),) * 2)
    for i, j in pairs:
        c[i, j] = c[j, i] = row[f"c{i}_{j}"] or 0.0
    return c, np.array([row[f"v{i}"] or 0.0 for i in range(len(models))]), {"y": row["y"] or 0.0, "n": row["n"], **{m: row[f"m{i}"] or 0.0 for i, m in enumerate(models)}}


def nnls(c: np.ndarray, v: np.ndarray, tol: float = 1e-12) -> np.ndarray:
    """min w'Cw / 2 - v'w with w >= 0, by active sets; C may be singular."""
    w, free = np.zeros(len(v)), np.zeros(len(v), bool)
    for _ in range(30 * len(v) + 30):
        g = v - c @ w
        g[free] = -np.inf
        if free.all() or g.max() <= tol * max(1.0, np.abs(v).max()):
            break
        free[int(np.argmax(g))] = True
        while True:
            s = np.zeros(len(v))
            s[free] = np.linalg.lstsq(c[np.ix_(free, free)], v[free], rcond=None)[0]
            if not (s[free] <= 0).any():
                break
            k = free & (s <= 0)
            step = min(1.0, float(np.min(w[k] / np.maximum(w[k] - s[k], 1e-300))))
            w = w + step * (s - w)
            free &= w > 1e-14
            w[~free] = 0
            if not free.any():
                s = w
                break
        w = np.where(free, s, 0.0)
    return w


def fit_stack(df: DataFrame, models: list[str], label: str) -> tuple[dict[str, float], float]:
    """Weights and the free intercept that centring gives."""
    c, v, m = covariances(df, models, label)
    w = nnls(c, v)
    return dict(zip(models, w.tolist(), strict=True)), m["y"] - float(sum(a * m[k] for k, a in zip(models, w, strict=True)))


def apply_stack(weights: dict[str, float], intercept: float):
    out = F.lit(float(intercept))
    for k, w in weights.items():
        out = out + F.col(k) * float(w)
    return out


def _moments(df: DataFrame, by: list[str], models: list[str], label: str) -> dict[tuple, tuple[int, np.ndarray, np.ndarray]]:
    """{cell: (rows, means, population covariances)} of models and label, the label last, in one aggregate."""
    cols = [*models, label]
    pairs = list(itertools.combinations_with_replacement(range(len(cols)), 2))
    rows = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.array(*[F.avg(c) for c in cols]).alias("_m"), F.array(*[F.covar_pop(cols[i], cols[j]) for i, j in pairs]).alias("_c")).collect()  # one row a cell
    out = {}
    for r in rows:
        c = np.zeros((len(cols),) * 2)
        for (i, j), x in zip(pairs, r["_c"], strict=True):
            c[i, j] = c[j, i] = x or 0.0
        out[tuple(r[k] for k in by)] = r["_n"], np.array([x or 0.0 for x in r["_m"]]), c
    return out


def _merged(cells: list[tuple[int, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(means, covariances) of cells taken together, about the common mean."""
    n = sum(k for k, _, _ in cells)
    mean = sum(k * m for k, m, _ in cells) / n
    return mean, sum(k * (c + np.outer(m - mean, m - mean)) for k, m, c in cells) / n


def nested_stack(df: DataFrame, folds: DataFrame, models: list[str], label: str, group: str, key: str, bounds=(1.0, 5.0)) -> DataFrame:
    """(key, label, stack_oof): per fold the stack is fitted without it; means over repeats, then clipped.

    Every (repeat, fold) cell's moments come from one aggregate; a fit merges those of a repeat's other folds. A fold that
    is its repeat's only one has no fit: its rows get null.
    """
    from scorefabric.functions.expressions import clip

    placed = df.join(folds, group)
    cells = _moments(placed, ["repeat", "fold"], models, label)
    fits = []
    for r, f in sorted(cells):
        if others := [v for (r2, f2), v in cells.items() if r2 == r and f2 != f]:
            mean, c = _merged(others)
            w = nnls(c[:-1, :-1], c[:-1, -1])
            fits.append((r, f, w.tolist(), float(mean[-1] - w @ mean[:-1])))
    table = df.sparkSession.createDataFrame(fits, "repeat int, fold int, _w array<double>, _b double")  # repeats times folds rows
    pred = sum((F.col(m) * F.col("_w")[i] for i, m in enumerate(models)), F.col("_b"))
    out = placed.join(F.broadcast(table), ["repeat", "fold"], "left").groupBy(key).agg(F.first(label).alias(label), F.avg(pred).alias("_m"))
    return out.select(key, label, clip(F.col("_m"), *bounds).alias("stack_oof"))


def calibrated_stack(df: DataFrame, folds: DataFrame, models: list[str], label: str, group: str, key: str, cohort: str, least: int = 20, bounds=(1.0, 5.0)) -> DataFrame:
    """(key, label, stack_oof): nested_stack whose fits are made linear in the label within each cohort, second level included.

    A fold's lines come from the moments of its repeat's other folds, cohort by cohort, so no row sees its own
    calibration; a cohort with `least` rows or fewer there, or without spread, keeps the plain prediction. Null is a cohort.
    """
    from scorefabric.functions.expressions import clip

    placed = df.join(folds, group)
    cells = _moments(placed, ["repeat", "fold", cohort], models, label)
    cohorts, fits = list(dict.fromkeys(k[2] for k in cells)), []
    for r, f in sorted({k[:2] for k in cells}):
        others = {k: v for k, v in cells.items() if k[0] == r and k[1] != f}
        if not others:
            continue
        mean, c = _merged(list(others.values()))
        w = nnls(c[:-1, :-1], c[:-1, -1])
        bias = float(mean[-1] - w @ mean[:-1])
        for h in cohorts:
            slope, shift, own = 1.0, 0.0, [v for k, v in others.items() if k[2] == h]
            if sum(n for n, _, _ in own) > least:
                at, spread = _merged(own)
                if (variance := float(w @ spread[:-1, :-1] @ w)) > 1e-12:
                    slope = float(w @ spread[:-1, -1]) / variance
                    shift = float(at[-1] - slope * (w @ at[:-1] + bias))
            fits.append((r, f, h, (slope * w).tolist(), slope * bias + shift))
    kind = df.schema[cohort].dataType.simpleString()
    table = df.sparkSession.createDataFrame(fits, f"_r int, _f int, _h {kind}, _w array<double>, _b double")  # repeats times folds times cohorts rows
    on = (F.col("repeat") == F.col("_r")) & (F.col("fold") == F.col("_f")) & F.col(cohort).eqNullSafe(F.col("_h"))
    pred = sum((F.col(m) * F.col("_w")[i] for i, m in enumerate(models)), F.col("_b"))
    out = placed.join(F.broadcast(table), on, "left").groupBy(key).agg(F.first(label).alias(label), F.avg(pred).alias("_m"))
    return out.select(key, label, clip(F.col("_m"), *bounds).alias("stack_oof"))


def component_spread(df: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(model, weight, spread): population sd of each weighted component, in one aggregate."""
    s = df.agg(*[F.stddev_pop(F.col(m) * float(w)).alias(m) for m, w in weights.items()])
    return s.select(F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.lit(float(w)).alias("weight"), F.col(m).alias("spread")) for m, w in weights.items()])).alias("r")).select("r.*")


def ridge_search(df: DataFrame, features: list[str], label: str, alphas: np.ndarray = SEARCH) -> DataFrame:
    """(alpha, loo_mse): exact leave-one-out errors of a ridge on standardised features, at every alpha.

    One aggregate gives the moments, one pass the errors; rows with a null or NaN are left out. No rows: no result rows.
    """
    clean = df.select(*[F.col(c).cast("double").alias(c) for c in [*features, label]])
    for c in clean.columns:
        clean = clean.where(F.col(c).isNotNull() & ~F.isnan(c))
    (n, mean, c), *_ = [*_moments(clean, [], features, label).values()]
    sd = np.sqrt(np.diag(c)[:-1])
    sd = np.where(sd > 1e-8, sd, 1.0)
    lam, u = np.linalg.eigh(n * c[:-1, :-1] / np.outer(sd, sd))
    target = u.T @ (n * c[:-1, -1] / sd)
    inverse = 1 / np.add.outer(alphas, lam.clip(min=0))

    def errors(batches):
        total = np.zeros(len(alphas))
        for pdf in batches:
            z = ((pdf[features].to_numpy() - mean[:-1]) / sd) @ u
            rest = pdf[label].to_numpy()[:, None] - mean[-1] - z @ (inverse * target).T
            total += np.square(rest / (1 - 1 / n - np.square(z) @ inverse.T).clip(min=1e-6)).sum(0)
        yield pd.DataFrame({"alpha": alphas, "_e": total})

    return clean.mapInPandas(errors, "alpha double, _e double").groupBy("alpha").agg((F.sum("_e") / float(max(n, 1))).alias("loo_mse")).where(F.lit(n > 0))


def compared(old: DataFrame, new: DataFrame, key: list[str], label: str, group: str, pred: str = "pred", n: int = 2000, seed: int = 0) -> DataFrame:
    """Two runs on the same rows: metrics of each, and paired draws of groups for their differences, as one row."""
    from scorefabric.operators import contracts, stats

    j = contracts.join_one_to_one(old.select(*key, label, group, F.col(pred).alias("_old")), new.select(*key, F.col(pred).alias("_new")), key)
    sides = [j.agg(*[c.alias(f"{side}_{name}") for name, c in zip(("n", "rmse", "mae", "bias", "r", "composite"), stats.metrics(label, f"_{side}"), strict=True)]) for side in ("old", "new")]
    draws = stats.paired(stats.bootstrap(j, group, label, ["_old", "_new"], n, seed), "_old", "_new")
    return sides[0].join(sides[1]).join(draws)  # one row each


def seed_averaged(makers: list, train: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, pred): mean prediction of estimators (of one kind under several seeds, say), each fitted on `train`."""
    parts = [m.fit(train).transform(new).select(key, F.col("prediction").alias("pred")) for m in makers]
    return reduce(DataFrame.unionByName, parts).groupBy(key).agg(F.avg("pred").alias("pred"))


def ablation(df: DataFrame, folds: list[DataFrame], models: list[str], drop: list[str], label: str, group: str, key: str) -> DataFrame:
    """(key, label, group, full, without): the stack with and without the columns whose names hold a part of `drop`, each the
    mean over the given fold tables (one a seed)."""
    reduced = [m for m in models if not any(part in m for part in drop)]
    if len(reduced) == len(models) or not reduced:
        raise ValueError(f"{drop} matches no column, or all")
    sides = []
    for names, out in ((models, "full"), (reduced, "without")):
        parts = [nested_stack(df, f, names, label, group, key).select(key, "stack_oof") for f in folds]
        sides.append(reduce(DataFrame.unionByName, parts).groupBy(key).agg(F.avg("stack_oof").alias(out)))
    return df.select(key, label, group).join(sides[0], key).join(sides[1], key)


def ablation_report(predictions: DataFrame, label: str, group: str, n: int = 2000, seed: int = 0, draws=None) -> DataFrame:
    """One row: metrics of `full` and of `without`, their differences over paired draws of groups, and the shares of draws
    in which `full` is better. draws: bootstrap of another kind than the one of a fixed number of groups."""
    from scorefabric.operators import resampling, stats

    sides = [predictions.agg(*[c.alias(f"{side}_{name}") for name, c in zip(("n", "rmse", "mae", "bias", "r", "composite"), stats.metrics(label, side), strict=True)]) for side in ("full", "without")]
    drawn = (draws or resampling.bootstrap)(predictions, group, label, ["without", "full"], n, seed)
    return sides[0].join(sides[1]).join(stats.paired(drawn, "without", "full"))  # one row each


def probe(view: DataFrame, folds: DataFrame, key: str, vector: str, label: str, group: str) -> DataFrame:
    """Ridge for each view (a layer, say): (view, rmse, pearson, composite, alpha_med)."""
    from scorefabric.operators.stats import metrics

    p = ridge_oof(view, folds, key, vector, label, group).where("pred is not null")
    j = p.join(view.select("view", key, label), ["view", key]).where(F.col(label).isNotNull())
    return j.groupBy("view").agg(*metrics(label, "pred"), F.percentile("alpha", F.lit(0.5)).alias("alpha_med"))

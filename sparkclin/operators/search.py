"""The logistic models of a search fitted together.

A pass over the rows sums loss, gradient and Hessian of every model (a point of the grid with one fold held out), so the
passes of a search are the Newton steps of its slowest model and don't grow with points or folds. Objective, penalty and
standardisation are those of ``ml.LogisticRegression``; the driver holds a few numbers a model.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkclin.functions.exprs import q

CHUNK = 256           # rows whose margins under all models are in memory at once
FILE_ROWS = 1 << 18   # rows of a stored file, the least that a task reads
PASSES = 100          # as many as LogisticRegression's maxIter
TOL = 1e-12           # a step that promises less of the loss than this ends a model
SWEEPS = 2000         # most coordinate descent rounds of a step with an l1 penalty
POINT = {"regParam": 0.0, "elasticNetParam": 0.0, "weightCol": "weight"}


def _narrow(rows: DataFrame, cols: list[str], target: str, weights: list[str]) -> DataFrame:
    d = lambda c, a: F.col(q(c)).cast("double").alias(a)
    return rows.select(*[d(c, f"x{i}") for i, c in enumerate(cols)], d(target, "y"),
                       *[d(w, f"w{i}") for i, w in enumerate(weights)], "fold")


def _moments(rows: DataFrame, p: int, nw: int, k: int):
    """Centre and scale of the features, positive rows a fold, and per training set and weight: weight of either class,
    deviation of every scaled feature."""
    bad = F.lit(False)
    for c in [*[f"x{i}" for i in range(p)], "y", *[f"w{i}" for i in range(nw)]]:
        v = F.col(c)
        bad = bad | v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    for i in range(nw):
        bad = bad | (F.col(f"w{i}") < 0)
    one = rows.agg(*[F.avg(f"x{i}").alias(f"m{i}") for i in range(p)], *[F.stddev_pop(f"x{i}").alias(f"s{i}") for i in range(p)],
                   F.count_if(bad).alias("bad"), F.count_if(~F.col("y").isin(0.0, 1.0)).alias("other")).first()
    if one["bad"] or one["other"]:
        raise ValueError("features, labels and weights must be finite numbers, labels 0 or 1, weights not negative")
    centre = np.array([one[f"m{i}"] or 0.0 for i in range(p)])
    scale = np.array([one[f"s{i}"] or np.inf for i in range(p)])  # a constant column is 0 in every row
    z = [(F.col(f"x{i}") - float(centre[i])) / float(scale[i]) for i in range(p)]
    aggs = [F.count(F.lit(1))]
    for v in range(nw):
        w = F.col(f"w{v}")
        aggs += [F.sum(w), F.sum(w * w), *[F.sum(w * c) for c in z], *[F.sum(w * c * c) for c in z]]
    n = np.zeros((k, 2))
    sums = np.zeros((k, 2, nw, 2 + 2 * p))
    for r in rows.groupBy("fold", "y").agg(*aggs).collect():
        n[r[0], int(r[1])] = r[2]
        sums[r[0], int(r[1])] = np.array(r[3:], float).reshape(nw, 2 + 2 * p)
    for f in range(k):
        if not n[f].sum():
            raise ValueError(f"The validation data at fold {f} is empty.")
    train = sums.sum(axis=0) - sums                                  # fold, class, weight, sums
    both = train.sum(axis=1)
    w, w2, wz, wzz = both[..., :1], both[..., 1:2], both[..., 2:2 + p], both[..., 2 + p:]
    with np.errstate(divide="ignore", invalid="ignore"):
        var = np.nan_to_num((wzz - wz * wz / w) / (w - w2 / w), nan=0.0, posinf=0.0, neginf=0.0)
    return centre, scale, n[:, 1], train[..., 0], np.sqrt(np.where(var > TOL, var, 0.0))


def _reader(p: int, centre, scale):
    """Scaled features after a column of ones, classes and folds of a batch (a closure, so workers need not import this)."""
    def read(b):
        a = np.ones((b.num_rows, p + 1))
        for i in range(p):
            a[:, i + 1] = (b.column(f"x{i}").to_numpy(zero_copy_only=False) - centre[i]) / scale[i]
        return a, b.column("y").to_numpy(zero_copy_only=False), b.column("fold").to_numpy(zero_copy_only=False)
    return read


def _sums(rows: DataFrame, centre, scale, nw: int, theta, held, weight):
    """Loss, gradient and upper Hessian of each model (row of ``theta``) summed over the rows outside its held-out fold."""
    m, p1 = theta.shape
    hi, hj = np.triu_indices(p1)
    names = [f"s{i}" for i in range(1 + p1 + len(hi))]
    chunk, read = CHUNK, _reader(p1 - 1, centre, scale)

    def run(batches):
        import pyarrow as pa
        total = np.zeros((m, len(names)))
        for b in batches:
            a_all, y, fold = read(b)
            for f in np.unique(fold):
                at = fold == f
                a_f, sign = a_all[at], np.where(y[at] == 1, 1.0, -1.0)[:, None]
                for v in range(nw):
                    ids = np.flatnonzero((held != f) & (weight == v))
                    if not len(ids):
                        continue
                    th, w_f = theta[ids].T, b.column(f"w{v}").to_numpy(zero_copy_only=False)[at]
                    acc = np.zeros((len(names), len(ids)))
                    for i in range(0, len(a_f), chunk):
                        a, w = a_f[i:i + chunk], w_f[i:i + chunk]
                        s = a * sign[i:i + chunk]
                        u = s @ th                       # margin towards the row's own class
                        t = np.exp(-np.abs(u))
                        r = 1.0 / (1.0 + t)
                        tr = t * r
                        acc[0] += w @ (np.maximum(-u, 0.0) - np.log(r))
                        acc[1:1 + p1] -= (s * w[:, None]).T @ np.where(u > 0, tr, r)
                        acc[1 + p1:] += (a[:, hi] * a[:, hj] * w[:, None]).T @ (tr * r)
                    total[ids] += acc.T
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(m, dtype=np.int32)), *[pa.array(total[:, i]) for i in range(len(names))]],
                                         names=["m", *names])

    out = np.zeros((m, len(names)))
    schema = ", ".join(["m int", *[f"{c} double" for c in names]])
    for row in rows.mapInArrow(run, schema).groupBy("m").agg(*[F.sum(c) for c in names]).collect():
        out[row[0]] = row[1:]
    hess = np.zeros((m, p1, p1))
    hess[:, hi, hj] = hess[:, hj, hi] = out[:, 1 + p1:]
    return out[:, 0], out[:, 1:1 + p1], hess


def _step(theta, g, h, l1):
    """Minimiser of each model's quadratic plus l1 penalty, as a step from ``theta``."""
    h = h + np.eye(h.shape[1]) * (1e-10 * np.einsum("mii->mi", h).max(axis=1) + 1e-14)[:, None, None]
    d = -np.linalg.solve(h, g[:, :, None])[:, :, 0]
    lasso = np.flatnonzero(l1.any(axis=1))
    if len(lasso):
        t, gi, hh, pen, di = theta[lasso], g[lasso], h[lasso], l1[lasso], d[lasso]
        for _ in range(SWEEPS):
            before = di.copy()
            for j in range(t.shape[1]):
                c, at = hh[:, j, j], t[:, j] + di[:, j]
                u = at - (gi[:, j] + (hh[:, j] * di).sum(axis=1)) / c
                di[:, j] += np.sign(u) * np.maximum(np.abs(u) - pen[:, j] / c, 0.0) - at
            if np.abs(di - before).max() <= 1e-12 * (1 + np.abs(t).max()):
                break
        d[lasso] = di
    return d


def fit_together(rows: DataFrame, cols: list[str], target: str, points: list[dict], k: int):
    """Intercept and coefficients on scaled features of every (point, fold), point by point; centre, scale, positives a fold."""
    if unknown := {n for p in points for n in p} - set(POINT):
        raise ValueError(f"points fitted together have no {sorted(unknown)}")
    points = [{**POINT, **p} for p in points]
    weights = sorted({p["weightCol"] for p in points})
    rows = _narrow(rows, cols, target, weights)
    centre, scale, positives, class_w, dev = _moments(rows, len(cols), len(weights), k)
    held = np.tile(np.arange(k), len(points))
    weight = np.repeat([weights.index(p["weightCol"]) for p in points], k)
    reg, alpha = (np.repeat([float(p[n]) for p in points], k)[:, None] for n in ("regParam", "elasticNetParam"))
    w0, w1 = class_w[held, 0, weight], class_w[held, 1, weight]
    s = np.column_stack([np.zeros(len(held)), dev[held, weight]])      # the intercept is free
    l1, l2, fixed = reg * alpha * s, reg * (1 - alpha) * s * s, s == 0
    fixed[:, 0] = False                                                # a feature that is constant in its rows gets 0
    theta = np.zeros(s.shape)
    with np.errstate(divide="ignore", invalid="ignore"):
        theta[:, 0] = np.clip(np.nan_to_num(np.log(w1 / w0)), -1e3, 1e3)   # one class only: that class is predicted
    open_ = np.flatnonzero((w0 > 0) & (w1 > 0))
    loss, promise, part = np.full(len(held), np.inf), np.zeros(len(held)), np.ones(len(held))
    step, tried = np.zeros(s.shape), theta.copy()
    for _ in range(PASSES):
        if not len(open_):
            break
        total = (w0 + w1)[open_]
        f, g, h = _sums(rows, centre, scale, len(weights), tried[open_], held[open_], weight[open_])
        t = tried[open_]
        f = f / total + (l2[open_] * t * t / 2 + l1[open_] * np.abs(t)).sum(axis=1)
        old = loss[open_]
        ok = ~np.isfinite(old) | (f <= old + 1e-4 * part[open_] * promise[open_] + TOL * np.abs(old))
        i = open_[ok]
        theta[i], loss[i], part[i] = t[ok], f[ok], 1.0
        g = np.where(fixed[i], 0.0, g[ok] / total[ok, None] + l2[i] * theta[i])
        h = np.where(fixed[i][:, :, None] | fixed[i][:, None, :], 0.0, h[ok] / total[ok, None, None])
        h = h + np.eye(s.shape[1]) * (l2[i] + fixed[i])[:, :, None]
        step[i] = _step(theta[i], g, h, l1[i])
        promise[i] = (g * step[i] + l1[i] * (np.abs(theta[i] + step[i]) - np.abs(theta[i]))).sum(axis=1)
        part[open_[~ok]] /= 2
        open_ = open_[(part[open_] > 1e-10) & (-promise[open_] > TOL * np.maximum(1.0, np.abs(loss[open_])))]
        tried[open_] = theta[open_] + part[open_, None] * step[open_]
    return theta.reshape(len(points), k, -1), centre, scale, positives


def recalls_together(rows: DataFrame, cols: list[str], target: str, points: list[dict], k: int):
    """Recall of class 1 of every point (row) on each held-out fold (column); 0 where a fold has no row of class 1."""
    theta, centre, scale, positives = fit_together(rows, cols, target, points, k)
    n, read = len(points), _reader(len(cols), centre, scale)

    def run(batches):
        import pyarrow as pa
        hits = np.zeros((k, n), dtype=np.int64)
        for b in batches:
            a, _, fold = read(b)
            for f in np.unique(fold):
                hits[f] += (a[fold == f] @ theta[:, f].T > 0).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(k, dtype=np.int32), n)),
                                          pa.array(np.tile(np.arange(n, dtype=np.int32), k)), pa.array(hits.ravel())],
                                         names=["fold", "point", "hits"])

    out = np.zeros((n, k))
    found = _narrow(rows, cols, target, []).where("y = 1").mapInArrow(run, "fold int, point int, hits bigint")
    for r in found.groupBy("fold", "point").agg(F.sum("hits")).collect():
        out[r[1], r[0]] = r[2] / positives[r[0]] if positives[r[0]] else 0.0
    return out

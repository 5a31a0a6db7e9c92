"""Calibration on out-of-fold scores.

Every row is scored by the one of k models that has not seen it (fitted on the other folds), so the calibrator isn't
fitted on scores that a model has learned by heart. Isotonic regression pools adjacent violators block by block:
pooling is associative, so sorted ranges are pooled apart, and neighbouring ranges are merged in a tree. What moves between
levels is blocks (of binary targets at most about n^(2/3)), never rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, inheritable_thread_target
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkclin.functions.exprs import q
from sparkclin.operators.model import assemble, stratified_folds
from sparkclin.session import stored

MERGE = 8            # neighbouring ranges that one task merges
MOST_BLOCKS = 1 << 20  # blocks that may be sent to every task (16 MB of boundaries)


def out_of_fold_scores(df: DataFrame, feature_cols: list[str], target: str, key: str, train: Callable[[DataFrame], object],
                       k: int = 5, score: str = "score", parallelism: int = 1) -> tuple[DataFrame, list]:
    """(``df`` plus ``fold`` and ``score``, the k fitted models); ``train`` maps a frame to a fitted model.

    ``score`` is the probability of class 1 by the model fitted on the other folds. Linear models score all folds in one
    projection, with the coefficients looked up by fold; others by one pass over each fold. ``parallelism``
    models are fitted at a time: a fit's many short jobs leave cores idle between them.
    """
    from pyspark.ml.functions import vector_to_array
    d = stored(stratified_folds(df, target, key, k), "folds")
    fit = inheritable_thread_target(lambda f: train(d.where(F.col("fold") != f)))
    with ThreadPoolExecutor(parallelism) as pool:
        models = [*pool.map(fit, range(k))]
    if all(hasattr(m, "coefficients") and hasattr(m, "intercept") for m in models):
        weights = F.array(*[F.array(*[F.lit(float(x)) for x in m.coefficients.toArray()]) for m in models])
        start = F.array(*[F.lit(float(m.intercept)) for m in models])
        logit = F.get(start, F.col("fold"))
        for i, c in enumerate(feature_cols):
            logit = logit + F.get(F.get(weights, F.col("fold")), F.lit(i)) * F.col(q(c)).cast("double")
        return d.withColumn(score, 1.0 / (1.0 + F.exp(-logit))), models
    parts = [m.transform(assemble(d.where(F.col("fold") == f), feature_cols)).select(
        *[F.col(q(c)) for c in d.columns], vector_to_array("probability")[1].alias(score)) for f, m in enumerate(models)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out, models


def fit_sigmoids(scores: DataFrame, score: str = "score", target: str = "target", by_fold: bool = False) -> DataFrame:
    """Rows fold, slope, intercept of σ(slope · score + intercept), the maximum-likelihood sigmoid.

    One sigmoid over all out-of-fold scores (fold null), or one a fold for an ensemble. Newton's method needs five sums a
    round, so each round is one aggregate over the scores for all folds at once.
    """
    x, y = F.col(score).cast("double"), F.col(target).cast("double")
    fold = F.col("fold") if by_fold else F.lit(-1)
    d = scores.where(x.isNotNull() & y.isNotNull()).select(fold.alias("f"), x.alias("x"), y.alias("y"))
    d = stored(d, "scores")  # read once a round
    state = {r.f: (0.0, 0.0) for r in d.select("f").distinct().collect()}  # one row a fold
    for _ in range(50):
        a = F.create_map(*[F.lit(v) for f, (s, _) in state.items() for v in (f, s)])[F.col("f")]
        b = F.create_map(*[F.lit(v) for f, (_, i) in state.items() for v in (f, i)])[F.col("f")]
        p = 1.0 / (1.0 + F.exp(-(a * F.col("x") + b)))
        w = p * (1 - p)
        sums = d.select("f", "x", (F.col("y") - p).alias("r"), w.alias("w")).groupBy("f").agg(
            F.sum(F.col("r") * F.col("x")).alias("gx"), F.sum("r").alias("g"), F.sum(F.col("w") * F.col("x") * F.col("x")).alias("hxx"),
            F.sum(F.col("w") * F.col("x")).alias("hx"), F.sum("w").alias("h")).collect()
        moved = 0.0
        for r in sums:
            det = r.hxx * r.h - r.hx * r.hx
            if det <= 1e-300:
                continue
            step = ((r.h * r.gx - r.hx * r.g) / det, (r.hxx * r.g - r.hx * r.gx) / det)
            state[r.f] = (state[r.f][0] + step[0], state[r.f][1] + step[1])
            moved = max(moved, abs(step[0]), abs(step[1]))
        if moved < 1e-10:
            break
    rows = [(None if f == -1 and not by_fold else f, s, i) for f, (s, i) in sorted(state.items())]
    return scores.sparkSession.createDataFrame(rows, "fold int, slope double, intercept double")


def apply_sigmoid(score: Column, slope: float, intercept: float) -> Column:
    return 1.0 / (1.0 + F.exp(-(F.lit(float(slope)) * score + F.lit(float(intercept)))))


# ------------------------------------------------------------------ isotonic regression
def pool(low: np.ndarray, high: np.ndarray, total: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, ...]:
    """Adjacent blocks with falling means pooled until the means rise."""
    lo, hi, s, w = [], [], [], []
    for a, b, x, n in zip(low.tolist(), high.tolist(), total.tolist(), weight.tolist()):
        while s and s[-1] * n >= x * w[-1]:  # mean before >= mean here
            a, x, n = lo.pop(), x + s.pop(), n + w.pop()
            hi.pop()
        lo.append(a)
        hi.append(b)
        s.append(x)
        w.append(n)
    return tuple(np.array(v, float) for v in (lo, hi, s, w))


_BLOCKS = ["lo", "hi", "total", "weight"]


def _pooled(part: int, arrays: tuple[np.ndarray, ...]) -> pa.Table:
    return pa.table({"part": pa.array([part] * len(arrays[0]), pa.int64()), **{c: v for c, v in zip(_BLOCKS, arrays)}})


def isotonic_blocks(scores: DataFrame, score: str = "score", target: str = "target", weight: str | None = None,
                    parts: int | None = None) -> DataFrame:
    """Rows lo, hi, value, weight: the steps of the isotonic least-squares fit of target on score, clipped to [0, 1].

    Rows without a score or target are left out. Equal scores are one point.
    """
    x, y = F.col(score).cast("double"), F.col(target).cast("double")
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    points = (scores.where(x.isNotNull() & y.isNotNull()).select(x.alias("lo"), (y * w).alias("t"), w.alias("w"))
              .groupBy("lo").agg(F.sum("t").alias("total"), F.sum("w").alias("weight")))
    n = parts or int(scores.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = "part long, " + ", ".join(f"{c} double" for c in _BLOCKS)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:  # blocks so far, then the batch: pooling is associative
            new = [b.column(c).to_numpy() for c in ("lo", "lo", "total", "weight")]
            held = pool(*(np.concatenate(v) for v in zip(held, new))) if held else pool(*new)
        if held:
            yield from _pooled(TaskContext.get().partitionId(), held).to_batches()

    ranged = points.repartitionByRange(n, "lo").sortWithinPartitions("lo").select("lo", "total", "weight")
    blocks = stored(ranged.mapInArrow(first, schema), "blocks")

    def merge(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by("lo")
        return _pooled(key[0].as_py(), pool(*(table.column(c).to_numpy() for c in _BLOCKS)))

    while blocks.select("part").distinct().count() > 1:
        group = F.floor(F.col("part") / MERGE).cast("long").alias("up")
        blocks = stored(blocks.select(group, *_BLOCKS).groupBy("up").applyInArrow(merge, schema), "blocks")
    value = F.least(F.greatest(F.col("total") / F.col("weight"), F.lit(0.0)), F.lit(1.0))
    return blocks.select("lo", "hi", value.alias("value"), "weight")


def apply_isotonic(df: DataFrame, blocks: DataFrame, score: str = "score", out: str = "calibrated") -> DataFrame:
    """``df`` plus the fitted value: linear between blocks, the first / last value outside; null for a null score.

    The blocks go with each task if there are at most ``MOST_BLOCKS`` (checked); a fit with more is an error.
    """
    n = blocks.count()
    if n > MOST_BLOCKS:
        raise ValueError(f"{n} blocks are more than {MOST_BLOCKS}: fit on rounded scores")
    rows = sorted(map(tuple, blocks.select("lo", "hi", "value").collect()))
    at = np.array([v for lo, hi, _ in rows for v in (lo, hi)])
    value = np.array([v for _, _, v in rows for _ in range(2)])
    known = df.sparkSession.sparkContext.broadcast((at, value))

    @F.pandas_udf("double")
    def fitted(s):
        import pandas as pd
        x = s.to_numpy(dtype=float, na_value=np.nan)
        y = np.interp(x, *known.value) if len(known.value[0]) else np.full(len(x), np.nan)
        return pd.Series(y).where(~np.isnan(x), None)

    return df.withColumn(out, fitted(F.col(q(score)).cast("double")))

"""Sampled Shapley values for any model that predicts from an array of features.

Along a permutation, features switch one by one from a background row's values to the explained row's; the change in the
prediction is the feature's share. Each row's coalition states are made as arrays in the task that holds the row and
predicted at once, so rows meet no grid, and nothing is joined or shuffled. The background is a bounded parameter.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkclin.functions.exprs import q

BACKGROUND_ROWS = 50
STATES = 1 << 20  # states predicted at once


def linear_predictor(coefficients: list[float], intercept: float = 0.0, margin: bool = False) -> Callable[[np.ndarray], np.ndarray]:
    """σ(w·x + b), or w·x + b itself."""
    w = np.array(coefficients, float)

    def predict(x: np.ndarray) -> np.ndarray:
        z = x @ w + intercept
        return z if margin else 1.0 / (1.0 + np.exp(-z))
    return predict


def _tree(node) -> list[tuple]:
    """A fitted tree as rows (feature, threshold, left, right, value); -1 marks a leaf."""
    rows: list[tuple] = []

    def add(n) -> int:
        at = len(rows)
        rows.append(())
        if n.subtreeDepth() == 0:
            stats = n.impurityStats().stats()
            total = sum(stats)
            rows[at] = (-1, 0.0, -1, -1, stats[1] / total if len(stats) == 2 and total else n.prediction(), n.prediction())
        else:
            split = n.split()
            left, right = add(n.leftChild()), add(n.rightChild())
            rows[at] = (split.featureIndex(), split.threshold(), left, right, 0.0, 0.0)
        return at

    add(node)
    return rows


def model_predictor(model) -> Callable[[np.ndarray], np.ndarray]:
    """Probability of class 1 of a fitted logistic, random-forest or boosted-tree classifier of Spark ML, as a function of a
    (rows x features) array. Trees over continuous features only."""
    if hasattr(model, "coefficients"):
        return linear_predictor(model.coefficients.toArray().tolist(), float(model.intercept))
    boosted = type(model).__name__.startswith("GBT")
    trees = [np.array(_tree(t._java_obj.rootNode() if hasattr(t, "_java_obj") else t.rootNode())) for t in model.trees]
    weights = np.array(model.treeWeights)

    def leaves(tree: np.ndarray, x: np.ndarray) -> np.ndarray:
        at, row = np.zeros(len(x), int), np.arange(len(x))
        while True:
            feature = tree[at, 0].astype(int)
            inner = feature >= 0
            if not inner.any():
                return at
            left = x[row, np.maximum(feature, 0)] <= tree[at, 1]
            at = np.where(inner, np.where(left, tree[at, 2], tree[at, 3]).astype(int), at)

    def predict(x: np.ndarray) -> np.ndarray:
        if boosted:
            margin = sum(w * t[leaves(t, x), 5] for t, w in zip(trees, weights))
            return 1.0 / (1.0 + np.exp(-2.0 * margin))
        return sum(t[leaves(t, x), 4] for t in trees) / len(trees)
    return predict


def explain_sampled(predict: Callable[[np.ndarray], np.ndarray], df: DataFrame, background: DataFrame, feature_cols: list[str],
                    key: str, n_perm: int = 8, seed: int = 42) -> DataFrame:
    """Rows (key, feature, contribution): the mean change of the prediction when the feature joins the ones before it, over
    ``n_perm`` seeded permutations (each with its reverse) and all background rows (a bounded sample; 50 to 100).

    For each row the contributions add up to its prediction less the background's mean prediction; for a linear
    margin they are exact. A row or background row with a null feature gives null contributions / takes no part.
    """
    d = len(feature_cols)
    known = [[float(v) for v in r] for r in background.select(*[F.col(q(c)).cast("double") for c in feature_cols]).dropna().collect()]
    if not known:
        raise ValueError("the background holds no row")
    base = np.array(known)
    rng = random.Random(seed)
    perms = [p for _ in range(n_perm) for one in [rng.sample(range(d), d)] for p in (one, one[::-1])]

    def values(x: np.ndarray) -> np.ndarray:
        out = np.zeros_like(x)
        for p in perms:
            states = np.broadcast_to(base, (len(x), *base.shape)).copy()  # rows x background x features
            before = predict(states.reshape(-1, d)).reshape(len(x), -1).mean(axis=1)
            for f in p:
                states[:, :, f] = x[:, None, f]
                after = predict(states.reshape(-1, d)).reshape(len(x), -1).mean(axis=1)
                out[:, f] += after - before
                before = after
        return out / len(perms)

    size = max(1, STATES // (len(base) * d))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.stack([b.column(i + 1).to_numpy(zero_copy_only=False) for i in range(d)], axis=1).astype(float)
            shares = np.concatenate([values(x[i:i + size]) for i in range(0, len(x), size)]) if len(x) else x
            row, feature = np.repeat(np.arange(len(x)), d), np.tile(np.arange(d), len(x))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(row)), pa.array(feature_cols, pa.string()).take(pa.array(feature)),
                 pa.array(shares.reshape(-1), from_pandas=True)], names=[key, "feature", "contribution"])

    rows = df.select(F.col(q(key)), *[F.col(q(c)).cast("double").alias(f"f{i}") for i, c in enumerate(feature_cols)])
    kind = dict(rows.dtypes)[key]
    return rows.mapInArrow(run, f"{q(key)} {kind}, feature string, contribution double")

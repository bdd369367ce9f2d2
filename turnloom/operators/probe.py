"""Linear probes: the epoch-limited recipe on bounded groups, and the scalable estimator."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.operators.metrics import LinearHead

# Penalties, epochs, step and check interval of the recipe.
WEIGHT_DECAYS = (1e-4, 1e-3, 1e-2)
EPOCHS, STEP, CHECK_EVERY = 300, 0.05, 10
#: The recipe is full-batch on one worker; a training set of more bytes than this, as float64, is refused (use fit_scalable).
MAX_BYTES = 2 << 30


def balanced_accuracy(y: np.ndarray, guess: np.ndarray) -> float:
    return float(np.mean([(guess[y == c] == c).mean() for c in np.unique(y)]))


def fit_adam(x: np.ndarray, y: np.ndarray, xv: np.ndarray, yv: np.ndarray, classes: int, weights: np.ndarray, decay: float):
    """(best validation balanced accuracy, W, b) of class-weighted softmax regression, Adam from zero."""
    w, b = np.zeros((x.shape[1], classes)), np.zeros(classes)
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)]
    row_w = weights[y] / weights[y].sum()
    onehot = np.eye(classes)[y]
    best = (-1.0, w, b)
    for epoch in range(1, EPOCHS + 1):
        z = x @ w + b
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = (p - onehot) * row_w[:, None]
        for param, grad, i in ((w, x.T @ g + 2 * decay * w, 0), (b, g.sum(0), 2)):
            state[i] = 0.9 * state[i] + 0.1 * grad
            state[i + 1] = 0.999 * state[i + 1] + 0.001 * grad**2
            param -= STEP * (state[i] / (1 - 0.9**epoch)) / (np.sqrt(state[i + 1] / (1 - 0.999**epoch)) + 1e-8)
        if epoch % CHECK_EVERY == 0:
            score = balanced_accuracy(yv, (xv @ w + b).argmax(1))
            if score > best[0]:
                best = (score, w.copy(), b.copy())
    return best


def _fit_group(classes: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        decay = float(pdf["decay"].iloc[0])
        x, y, train = np.stack(pdf["v"]).astype(np.float64), pdf["label"].to_numpy(int), (pdf["split"] == "train").to_numpy()
        if x.nbytes > MAX_BYTES:
            raise ValueError(f"a training set of more than {MAX_BYTES} bytes: use fit_scalable")
        mean, std = x[train].mean(0), x[train].std(0) + 1e-6
        z = (x - mean) / std
        n = np.maximum(np.bincount(y[train], minlength=classes), 1)
        weights = n.sum() / (classes * n)
        score, w, b = fit_adam(z[train], y[train], z[~train], y[~train], classes, weights / weights.mean(), decay)
        return pd.DataFrame([{"feature": pdf["feature"].iloc[0], "decay": decay, "score": score, "weights": w.T.tolist(), "bias": b.tolist(), "mean": mean.tolist(), "std": std.tolist()}])

    return run


FITTED = "feature string, decay double, score double, weights array<array<double>>, bias array<double>, mean array<double>, std array<double>"


def fit_grid(rows: DataFrame, classes: int) -> DataFrame:
    """One fitted head per (feature, decay): the grid runs in parallel, one group each.

    ``rows`` is (feature, split in train/val, label, v). A group is one bounded training set (MAX_BYTES).
    """
    decays = F.explode(F.array(*[F.lit(d) for d in WEIGHT_DECAYS]))
    return rows.withColumn("decay", decays).groupBy("feature", "decay").applyInPandas(_fit_group(classes), FITTED)


def select_head(fitted: DataFrame) -> tuple[dict, LinearHead]:
    """Best validation score; of equal ones the first feature name, then the smallest decay."""
    r = fitted.orderBy(F.col("score").desc(), "feature", "decay").limit(1).collect()[0]
    return {"feature": r["feature"], "decay": r["decay"], "score": r["score"]}, LinearHead(r["weights"], r["bias"], r["mean"], r["std"])


def fit_scalable(rows: DataFrame, classes: int, decay: float = 1e-3, max_iter: int = 100):
    """The convex optimum of the same objective with Spark ML (distributed, any number of rows): another estimator."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    train = rows.where("split = 'train'")
    counts = {r["label"]: r["n"] for r in train.groupBy("label").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    weight = F.lit(1.0)
    for c, n in counts.items():
        weight = F.when(F.col("label") == c, F.lit(total / (classes * n))).otherwise(weight)
    data = train.select(array_to_vector(F.col("v").cast("array<double>")).alias("features"), F.col("label").cast("double").alias("label"), weight.alias("w"))
    return LogisticRegression(family="multinomial", weightCol="w", regParam=2 * decay, maxIter=max_iter, standardization=True).fit(data)

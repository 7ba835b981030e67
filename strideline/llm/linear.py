"""Lasso logistic regression on a bounded sample, and how the sample is drawn."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column | str, parts: int) -> Column:
    """crc32 of the id's text, modulo parts; null for a null id."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary") if isinstance(doc_id, str) else doc_id.cast("string").cast("binary")), F.lit(parts))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, most: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text, y of at most `most` labelled documents, drawn by a hash of the id; usable is a condition on labels.

    Labels that disagree for one id are averaged and rounded; of several texts with one id the least is taken. The ids
    are few (most is the bound), so they are broadcast; the texts stay spread over the tasks.
    """
    rows = labels.where(usable & F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("_id")).agg((F.avg(label) >= 0.5).cast("int").alias("y"))
    picked = rows.orderBy(F.xxhash64(F.col("_id")), "_id").limit(most)
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(picked), F.col("doc_id") == F.col("_id")).groupBy("doc_id", "y").agg(F.min("text").alias("text"))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def lasso_logistic(rows: np.ndarray, cols: np.ndarray, n: int, d: int, y: np.ndarray, *, l1: float, swaps: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None = None, swap_weight: float = 0.0, steps: int = 400) -> tuple[float, np.ndarray]:
    """Intercept and weights for binary features (rows and cols of the ones) by accelerated proximal gradient steps.

    The loss is the mean logistic loss, l1 times the absolute sum of the weights times their features' deviations (for
    swapped features with the swaps' curvature), and swap_weight times the mean squared score change of the swaps (row,
    column, sign, and each row's count): what each counterfactual removes and adds.
    """
    if not n or y.min() == y.max():
        rate = (y.sum() + 1) / (n + 2) if n else 0.5
        return float(np.log(rate / (1 - rate))), np.zeros(d)
    share = np.bincount(cols, minlength=d) / n
    bend = np.maximum(share * (1 - share), 1 / n)
    m = swaps[3].sum() if swaps and swap_weight else 0
    if m:
        s_rows, s_cols, s_sign, times = swaps
        bend = bend + 8 * swap_weight * np.bincount(s_cols, times[s_rows], d) / m
    scale = 1 / np.sqrt(bend)
    dot = lambda w: np.bincount(rows, (scale * w)[cols], n)
    back = lambda r: scale * np.bincount(cols, r[rows], d)
    change = lambda w: np.bincount(s_rows, s_sign * (scale * w)[s_cols], len(times))
    change_back = lambda r: scale * np.bincount(s_cols, (s_sign * (times * r)[s_rows]), d)
    v, top = np.full(d, 1.0), 1.0
    for _ in range(20):  # the largest curvature, by power iteration
        u = back(dot(v)) / (4 * n) + (2 * swap_weight / m * change_back(change(v)) if m else 0)
        top = max(np.linalg.norm(u), 1e-12)
        v = u / top
    rate, w, b = 1 / (1.1 * top + 0.25), np.zeros(d), float(np.log(y.mean() / (1 - y.mean())))
    near_w, near_b, t = w, b, 1.0
    for _ in range(steps):
        error = sigmoid(near_b + dot(near_w)) - y
        slope = back(error) / n + (2 * swap_weight / m * change_back(change(near_w)) if m else 0)
        step = near_w - rate * slope
        new_w, new_b = np.sign(step) * np.maximum(0, np.abs(step) - rate * l1), near_b - error.mean()
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        near_w, near_b = new_w + (t - 1) / t_new * (new_w - w), new_b + (t - 1) / t_new * (new_b - b)
        w, b, t = new_w, new_b, t_new
    return float(b), scale * w

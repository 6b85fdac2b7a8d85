"""Shared by the scoring operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

FOLDS = 5


def fold(key: Column) -> Column:
    """crc32 of the key as text, modulo 5; fold 0 is held out from all learning.  A null key counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit(""))), F.lit(FOLDS)).cast("int")


def sample_below(df: DataFrame, most: int, *by: str) -> DataFrame:
    """A sample by hash of about ``most`` rows at the most: all of a smaller table."""
    n = df.count()
    if n <= most:
        return df
    return df.filter(F.shiftrightunsigned(F.xxhash64(*by), 1) < F.lit(int(0.95 * most / n * 2**63)))


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30.0, 30.0)))


def fit_line(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Intercept and slope of a logistic line through counted points, by Newton steps."""
    a = np.stack([np.ones_like(x), x], axis=1)
    w = np.zeros(2)
    total = max(n.sum(), 1.0)
    for _ in range(100):
        p = sigmoid(a @ w)
        grad = a.T @ (n * (p - y)) / total + ridge * w
        hess = (a.T * (n * p * (1 - p))) @ a / total + ridge * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w -= np.clip(step, -2.0, 2.0)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])

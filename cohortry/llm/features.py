"""Hashed n-gram features inside tasks, and bounded samples of labelled rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MULTIPLIER = np.uint32(2654435761)


def byte_grams(buf: np.ndarray, n: int, bits: int) -> np.ndarray:
    """A hash of ``bits`` bits for each run of n <= 4 bytes."""
    m = len(buf) - n + 1
    if m <= 0:
        return np.zeros(0, np.int64)
    code = buf[:m].astype(np.uint32)
    for i in range(1, n):
        code |= buf[i:m + i].astype(np.uint32) << np.uint32(8 * i)
    return ((code + np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * MULTIPLIER >> np.uint32(32 - bits)
            ).astype(np.int64)


class Distinct:
    """The distinct values of an array of small integers, in one pass without sorting."""

    def __init__(self, bits: int):
        self.first = np.zeros(1 << bits, np.int64)

    def __call__(self, ids: np.ndarray) -> np.ndarray:
        at = np.arange(len(ids))
        self.first[ids] = at
        return ids[self.first[ids] == at]


def sampled_labels(labels: DataFrame, label: str, per_class: int, seed: int) -> DataFrame:
    """(doc_id, y): about ``per_class`` ids of each class, chosen by a hash of the id, and
    all ids of a smaller class. Null labels are left out; of an id that has several labels
    the largest counts. The result's size does not grow with the table."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy(
        F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("y"))
    sizes = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    place = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.lit(1 << 30))
    keep = F.lit(False)
    for y, n in sizes.items():
        keep = keep | ((F.col("y") == y) & (place < min(1.0, per_class / n) * (1 << 30)))
    return known.where(keep)


def ragged(rows) -> tuple[np.ndarray, np.ndarray]:
    """(starts, values) of a list of arrays; starts has one more entry than there are rows."""
    starts = np.r_[0, np.cumsum([len(r) for r in rows])].astype(np.int64)
    return starts, (np.concatenate(rows) if len(rows) else np.zeros(0)).astype(np.int32)


def row_sums(starts: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of the rows of a ragged array; an empty row sums to zero."""
    total = np.empty(len(values) + 1)
    total[0] = 0.0
    np.cumsum(values, out=total[1:])
    return total[starts[1:]] - total[starts[:-1]]


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def platt(margin: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 60):
    """(a, b) so that sigmoid(a * margin + b) is the weighted share of ones; targets are
    drawn in a little, as usual, so that a perfect margin still has a finite slope."""
    n1, n0 = max(1.0, y.sum()), max(1.0, (1 - y).sum())
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.c_[margin, np.ones_like(margin)]
    beta = np.zeros(2)
    for _ in range(steps):
        p = sigmoid(x @ beta)
        grad = x.T @ (weight * (t - p)) - 1e-6 * beta
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        beta = beta + np.clip(np.linalg.solve(hess, grad), -2, 2)
    return float(beta[0]), float(beta[1])

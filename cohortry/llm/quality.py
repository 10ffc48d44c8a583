"""A quality classifier: Naive Bayes support vectors.

Indicators of byte n-grams are scaled by their log-count ratio between the classes, and a linear
hinge loss on the scaled indicators is minimised by dual coordinate descent. Margins become
scores by a logistic curve fitted on labelled rows that the descent did not see.

The model is fitted on a bounded sample of labelled rows (``PER_CLASS`` of each class); it has
one weight per hashed n-gram, so its size is fixed. Every document is scored from its whole text
in one map over the table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.llm.common import fold, table, texts
from cohortry.llm.features import (Distinct, byte_grams, platt, ragged, row_sums, sampled_labels,
                                   sigmoid)

BITS, GRAMS = 18, (1, 2, 3, 4)
# Indicators of repetition follow those of the byte n-grams.
RUNS, SHARES = 4, 8
DIMS = (1 << BITS) + RUNS + SHARES
PER_CLASS, FOLDS, ACCEPT = 1000, 5, 0.3
ALPHA, COST, EPOCHS = 1.0, 0.1, 12


def repetition(raw: bytes) -> list[int]:
    """n-grams of the marks "same word as before": runs of up to 4, and their share in eighths."""
    words = raw.split()
    again = np.fromiter(map(bytes.__eq__, words, words[1:]), bool, max(0, len(words) - 1))
    out, run = [], again
    for n in range(RUNS):
        if run.any():
            out.append((1 << BITS) + n)
        run = run[:-1] & again[n + 1:]
    if len(again):
        out.append((1 << BITS) + RUNS + min(SHARES - 1, int(SHARES * again.mean())))
    return out


def grams(text: str, distinct: Distinct) -> np.ndarray:
    raw = text.encode()
    buf = np.frombuffer(raw, np.uint8)
    found = distinct(np.concatenate([byte_grams(buf, n, BITS) for n in GRAMS]))
    return np.r_[found, np.array(repetition(raw), np.int64)]


def _gram_batches(batches):
    distinct = Distinct(BITS)
    for b in batches:
        rows = [grams(t.as_py(), distinct).astype(np.int32) for t in b.column("text")]
        yield pa.RecordBatch.from_arrays(
            [b.column("y"), pa.array(rows, pa.list_(pa.int32())), b.column("place")],
            names=["y", "ids", "place"])


def log_count_ratio(starts, ids, y, dims: int) -> np.ndarray:
    positive = np.repeat(y > 0, np.diff(starts))
    p = ALPHA + np.bincount(ids[positive], minlength=dims)
    q = ALPHA + np.bincount(ids[~positive], minlength=dims)
    return np.log((p / p.sum()) / (q / q.sum()))


def dual_descent(starts, ids, ratio, sign, cost: float = COST, epochs: int = EPOCHS):
    """Weights of min |w|^2/2 + cost * sum hinge(sign * w x), x the ratios of a row's n-grams;
    the last weight is the bias."""
    w, bias = np.zeros(len(ratio)), 0.0
    alpha = np.zeros(len(sign))
    size = row_sums(starts, np.square(ratio, dtype=np.float32)[ids]) + 1.0
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(sign)):
            at = ids[starts[i]:starts[i + 1]]
            x = ratio[at]
            g = sign[i] * (w[at] @ x + bias) - 1.0
            new = min(max(alpha[i] - g / size[i], 0.0), cost)
            step = (new - alpha[i]) * sign[i]
            if step:
                w[at] += step * x
                bias += step
                alpha[i] = new
    return w, bias


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality",
        per_class: int = PER_CLASS) -> tuple[np.ndarray, float]:
    """(weights, bias) of the log-odds that a text is of class 1.

    ``labels`` is what may be learned from. With rows of one class only, or none, all
    weights are zero and the score is that class's share (0.5 without rows).
    """
    chosen = sampled_labels(labels, label, per_class, seed=3)
    rows = texts(docs).join(F.broadcast(chosen), "doc_id").withColumn(
        "place", F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30))).select("text", "y", "place")
    got = rows.mapInArrow(_gram_batches, "y int, ids array<int>, place long").toPandas()
    got = got.sort_values(["place", "y"], kind="stable")
    y = (got["y"].to_numpy() > 0).astype(float)
    zero = np.zeros(DIMS)
    if len(set(y)) < 2:
        return zero, float(np.log((y.sum() + 1) / ((1 - y).sum() + 1)))
    held = np.arange(len(y)) % 4 == 3
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        held = np.ones(len(y), bool)
        seen = held
    else:
        seen = ~held
    lists = list(got.pop("ids"))
    starts, ids = ragged([r for r, s in zip(lists, seen) if s])
    ratio = log_count_ratio(starts, ids, y[seen], DIMS)
    w, bias = dual_descent(starts, ids, ratio, 2 * y[seen] - 1)
    weights = w * ratio
    starts, ids = ragged([r for r, s in zip(lists, held) if s])
    a, b = platt(row_sums(starts, weights[ids]) + bias, y[held], np.ones(int(held.sum())))
    return weights * a, bias * a + b


def score(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """(doc_id, score) of every row, from its whole text; null text is empty text."""
    weights, bias = model
    sent = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    def batches(source):
        w, distinct = sent.value.astype(np.float64), Distinct(BITS)
        for b in source:
            s = [float(sigmoid(w[grams(t.as_py(), distinct)].sum() + bias))
                 for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s, pa.float64())],
                                             names=["doc_id", "score"])

    return texts(docs).mapInArrow(batches, "doc_id long, score double")


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``, repeated rows too.

    Labels are learned from ids outside the held-out fold. A null doc_id is hashed as empty
    text. An empty text has the score of the bias. Empty tables give no rows.
    """
    model = fit(docs, labels.where(fold(F.col("doc_id"), FOLDS) != 0))
    return score(docs, model).select(
        "doc_id", (fold(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "score",
        F.when(F.col("score") >= ACCEPT, 1).otherwise(0).alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without what the classifier rejects. Each row is decided by its own text, so
    rows that share an id, or have none, stay or go one by one."""
    weights, bias = fit(docs, labels.where(fold(F.col("doc_id"), FOLDS) != 0))
    sent = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))
    text_at = docs.columns.index("text")

    def batches(source):
        w, distinct = sent.value.astype(np.float64), Distinct(BITS)
        for b in source:
            good = [float(sigmoid(w[grams(t.as_py() or "", distinct)].sum() + bias)) >= ACCEPT
                    for t in b.column(text_at)]
            yield b.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(batches, docs.schema)


def op3_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

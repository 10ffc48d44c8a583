"""Toxicity grades by cumulative-link ordinal regression.

P(grade <= k) = sigmoid(theta_k - w x): one weight vector for all ordered thresholds, x the 0/1
features of a text (its words and the beginnings of its words, hashed). The result is the
expected grade and the probability of any grade above 0.

Where labels only say yes or no, the grades of the toxic rows are cut from how many of the words
that tell the classes apart they hold. The model is fitted on a bounded sample of labelled rows
and has one weight per hashed feature; every document is graded from its whole text in one map.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortry.llm.common import fold, table, texts
from cohortry.llm.features import ragged, row_sums, sampled_labels, sigmoid

BITS, PREFIXES = 21, (5, 6, 7, 8)
PER_CLASS, FOLDS, FLAG, GRADES = 2500, 5, 0.3, 3
MIN_ROWS, MIN_Z, RIDGE, STEPS, RATE = 4, 4.0, 1e-4, 200, 0.15
_WORD = re.compile(r"[^\W_]+")


def word_ids(text: str) -> tuple[list[int], list[int]]:
    """Hashes of the distinct words, and of their distinct beginnings."""
    mask = (1 << BITS) - 1
    words = {w.encode() for w in _WORD.findall(text.lower())}
    starts = {w[:n] + b"\x00" for w in words for n in PREFIXES if len(w) > n}
    h = xxhash.xxh32_intdigest
    return [h(w) & mask for w in words], [h(w) & mask for w in starts]


def _feature_batches(batches):
    for b in batches:
        both = [word_ids(t.as_py()) for t in b.column("text")]
        yield pa.RecordBatch.from_arrays(
            [b.column("y"), b.column("place"),
             pa.array([sorted(set(w)) for w, _ in both], pa.list_(pa.int32())),
             pa.array([sorted(set(w + s)) for w, s in both], pa.list_(pa.int32()))],
            names=["y", "place", "words", "ids"])


def graded(words: list, y: np.ndarray, grades: int = GRADES) -> np.ndarray:
    """Grades 1 .. ``grades`` for the rows of class 1, by how many telling words they hold."""
    starts, ids = ragged(words)
    positive = np.repeat(y > 0, np.diff(starts))
    p = np.bincount(ids[positive], minlength=1 << BITS)
    q = np.bincount(ids[~positive], minlength=1 << BITS)
    odds = np.log((p + 0.5) / (y.sum() + 1)) - np.log((q + 0.5) / ((1 - y).sum() + 1))
    held = row_sums(starts, ((odds > 2) & (p >= 2 * MIN_ROWS))[ids].astype(float))
    cuts = np.quantile(held[y == 1], np.arange(1, grades) / grades)
    return np.where(y == 1, 1 + np.searchsorted(cuts, held, side="left"), 0)


def telling_features(starts, ids, positive):
    """(starts, numbers, features): the features that tell the classes apart, numbered.

    A feature counts if the rows of the two classes that hold it differ by ``MIN_Z`` standard
    errors, and if ``MIN_ROWS`` rows hold it. Most words of a corpus occur in a few rows; without
    this the weights would learn by heart which row is which.
    """
    of = np.repeat(positive, np.diff(starts))
    p = np.bincount(ids[of], minlength=1 << BITS).astype(float)
    q = np.bincount(ids[~of], minlength=1 << BITS).astype(float)
    both, share = p + q, positive.mean()
    z = np.abs(p - both * share) / np.sqrt(np.maximum(both, 1) * share * (1 - share))
    features = np.flatnonzero((both >= MIN_ROWS) & (z >= MIN_Z))
    number = np.full(1 << BITS, -1, np.int32)
    number[features] = np.arange(len(features))
    found = number[ids]
    kept = found >= 0
    per_row = row_sums(starts, kept).astype(np.int64)
    return np.r_[0, np.cumsum(per_row)], found[kept], features


def fit_ordinal(starts, ids, grade, levels: int, dims: int):
    """(weights, thresholds) by accelerated gradient steps on the likelihood with a ridge;
    the thresholds stay in order because their gaps are exponentials."""
    n, per_row = len(grade), np.diff(starts)
    w, m, v = np.zeros(dims), np.zeros(dims), np.zeros(dims)
    share = np.array([(grade > k).mean() for k in range(levels)]).clip(1e-4, 1 - 1e-4)
    first = np.sort(-np.log(share / (1 - share))) + 1e-3 * np.arange(levels)
    t = np.r_[first[0], np.log(np.diff(first))]
    tm, tv = np.zeros(levels), np.zeros(levels)
    for step in range(1, STEPS + 1):
        theta = np.r_[t[0], t[0] + np.cumsum(np.exp(t[1:]))]
        edge = np.r_[-np.inf, theta, np.inf]
        x = row_sums(starts, w[ids])
        up, low = sigmoid(edge[grade + 1] - x), sigmoid(edge[grade] - x)
        up, low = np.where(grade == levels, 1.0, up), np.where(grade == 0, 0.0, low)
        p = np.maximum(up - low, 1e-12)
        du, dl = up * (1 - up) / p, low * (1 - low) / p
        gx = (du - dl) / n  # of the negative log-likelihood with respect to x
        gw = np.bincount(ids, weights=np.repeat(gx, per_row), minlength=dims) + RIDGE * w
        gt = np.array([-(du[grade == k].sum() - dl[grade == k + 1].sum()) / n
                       for k in range(levels)])
        g = np.r_[gt.sum(), [np.exp(t[k]) * gt[k:].sum() for k in range(1, levels)]]
        for val, grad, a, b in ((w, gw, m, v), (t, g, tm, tv)):
            a += 0.1 * (grad - a)
            b += 0.001 * (grad * grad - b)
            val -= RATE * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    return w, np.r_[t[0], t[0] + np.cumsum(np.exp(t[1:]))]


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS):
    """(weights, thresholds) from the labelled rows in ``labels``.

    Labels above 1 are taken as grades: pass them for real grades. 0/1 labels are graded first by
    how many telling words a row holds. Without rows of grade 0, or without others, all weights
    are zero and every text gets the share of the rows above 0, smoothed. Of documents that
    repeat an id, no more than twice ``per_class`` rows of a label are used.
    """
    chosen = sampled_labels(labels, label, per_class, seed=4)
    first = Window.partitionBy("y").orderBy("place", F.xxhash64("text"))
    rows = texts(docs).join(F.broadcast(chosen), "doc_id").withColumn(
        "place", F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(1 << 30))).withColumn(
        "nth", F.row_number().over(first)).where(F.col("nth") <= 2 * per_class).select(
        "text", "y", "place")
    got = rows.mapInArrow(
        _feature_batches, "y int, place long, words array<int>, ids array<int>").toPandas()
    got = got.sort_values(["place", "y"], kind="stable")
    y = got["y"].to_numpy().clip(0)
    if not (y == 0).any() or not (y > 0).any():
        share = ((y > 0).sum() + 1) / (len(y) + 2)
        return np.zeros(1 << BITS), np.array([-np.log(share / (1 - share))])
    n_all, n_pos = labels.where(F.col(label).isNotNull()).agg(
        F.count(F.lit(1)), F.count_if(F.col(label) > 0)).first()
    if y.max() == 1:
        y = graded(list(got.pop("words")), y)
    starts, ids, features = telling_features(*ragged(list(got.pop("ids"))), y > 0)
    small, theta = fit_ordinal(starts, ids, y, int(y.max()), max(1, len(features)))
    weights = np.zeros(1 << BITS)
    weights[features] = small[:len(features)]
    # The sample holds the classes in other shares than the labels do.
    odds = np.log(max(1, n_pos) / max(1, n_all - n_pos)) - np.log((y > 0).sum() / (y == 0).sum())
    return weights, theta - odds


def grade(docs: DataFrame, model) -> DataFrame:
    """(doc_id, severity, toxic, grade, flagged) of every row, from its whole text.

    severity is the expected grade, toxic the probability of a grade above 0, grade the
    likeliest one. Null text is empty text, whose result depends on the thresholds alone.
    """
    weights, theta = model
    sent = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    def batches(source):
        w = sent.value
        for b in source:
            x = np.array([float(w[list(set(a + c))].sum()) if a else 0.0
                          for a, c in (word_ids(t.as_py()) for t in b.column("text"))])
            above = sigmoid(x[:, None] - theta[None, :])
            edges = np.c_[np.ones(len(x)), above, np.zeros(len(x))]
            likeliest = np.argmax(edges[:, :-1] - edges[:, 1:], axis=1)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(above.sum(axis=1)), pa.array(above[:, 0]),
                 pa.array(likeliest.astype(np.int32)),
                 pa.array((above[:, 0] >= FLAG).astype(np.int32))],
                names=["doc_id", "severity", "toxic", "grade", "flagged"])

    return texts(docs).mapInArrow(
        batches, "doc_id long, severity double, toxic double, grade int, flagged int")


def graded_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``grade`` for every row of ``docs``, with held_out: labels are learned from ids outside
    that fold. A null doc_id is hashed as empty text; empty tables give no rows."""
    held = fold(F.col("doc_id"), FOLDS) == 0
    model = fit(docs, labels.where(~held))
    return grade(docs, model).withColumn("held_out", held)


def op4_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graded_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

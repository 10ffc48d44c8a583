"""Threshold-free evaluation: AUROC, average precision, losses and curves.

Everything is read off one table per prediction set: a row per distinct score
with the positives and negatives at or above it.

A missing score (NULL or NaN) ranks below all others, tied with minus infinity.
``audit.finite_scores`` counts such rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.functions.rates import log_loss, squared_error
from cohortry.operators.prefix import RANGE_ROWS, Dealt, running_totals, split_points
from cohortry.session import pinned

CELL = ["cohort", "model", "label"]
CURVE_POINTS = 2000


def known_score(score: Column) -> Column:
    """The score as a double, minus infinity where it is missing."""
    value = score.cast("double")
    return F.when(value.isNull() | F.isnan(value), F.lit(float("-inf"))).otherwise(value)


def score_counts(pred: DataFrame, keys: Sequence[str] = CELL, y: str = "y_true",
                 score: str = "score_raw", weight: Column | None = None) -> DataFrame:
    """(cell, score, p, n): tied scores are merged on the map side."""
    w = F.lit(1) if weight is None else weight
    one = F.col(y).cast("long")
    return pred.groupBy(*keys, F.col(score).alias("score")).agg(
        F.sum(one * w).alias("p"), F.sum((1 - one) * w).alias("n"))


def cumulative(pred: DataFrame, keys: Sequence[str] = CELL, y: str = "y_true",
               score: str = "score_raw", range_rows: int = RANGE_ROWS,
               following: Sequence[str] = (), totals: bool = True,
               points: Sequence[float] | None = None, weight: Column | None = None) -> DataFrame:
    """(cell, score, p, n, tp, fp, pos, neg): counts at or above each score. ``weight`` says how
    many rows a row stands for."""
    pred = pred.withColumn(score, known_score(F.col(score)))
    if points is None:
        points = split_points(pred, score, range_rows)
    # A task merges ties in a table of its scores: files of many rows are dealt again, so that it
    # holds about a range of them, however large the files are.
    ranges = points.parts if isinstance(points, Dealt) else len(points) + 1
    many = ranges > pred.sparkSession.sparkContext.defaultParallelism
    dealt = pred.repartition(ranges) if many else pred
    counts = score_counts(dealt, keys, y, score, weight)
    one, w = F.col(y).cast("long"), F.lit(1) if weight is None else weight
    cum = running_totals(counts, keys, "score", {"p": F.col("p"), "n": F.col("n")},
                         descending=True, points=points, following=following, totals=totals,
                         source=(pred, score, {"p": one * w, "n": (1 - one) * w}))
    return cum.withColumnsRenamed(
        {"cum_p": "tp", "cum_n": "fp", "tot_p": "pos", "tot_n": "neg"})


def discrimination(pred: DataFrame, keys: Sequence[str] = CELL, y: str = "y_true",
                   score: str = "score_raw", range_rows: int = RANGE_ROWS,
                   weight: Column | None = None) -> DataFrame:
    """(cell, n_rows, n_pos, n_neg, prevalence, auroc, auprc).

    The two areas are NULL where a cell has only one class.
    """
    cum = cumulative(pred, keys, y, score, range_rows, totals=False, weight=weight)
    p, n, tp, fp = (F.col(c) for c in ("p", "n", "tp", "fp"))
    # Ties count half in the first sum; the second is the step sum, not the trapezoid.
    sums = cum.groupBy(*keys).agg(
        F.sum(p).alias("n_pos"), F.sum(n).alias("n_neg"), F.sum(n * (tp - p / 2)).alias("rank"),
        F.sum(p * (tp / (tp + fp))).alias("steps"))
    pos, neg = F.col("n_pos"), F.col("n_neg")
    both = (pos > 0) & (neg > 0)
    return sums.select(
        *keys, (pos + neg).alias("n_rows"), "n_pos", "n_neg",
        (pos / (pos + neg)).alias("prevalence"),
        F.when(both, F.col("rank") / (pos.cast("double") * neg)).alias("auroc"),
        F.when(both, F.col("steps") / pos).alias("auprc"))


def outcome_counts(pred: DataFrame, keys: Sequence[str], y: str = "y_true") -> DataFrame:
    one = F.col(y).cast("long")
    return pred.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(one).alias("n_pos"),
        F.sum(1 - one).alias("n_neg"), F.avg(one).alias("prevalence"))


def losses(pred: DataFrame, keys: Sequence[str] = CELL, y: str = "y_true",
           score: str = "score_raw") -> DataFrame:
    """Brier score and log-loss; only meaningful where scores are probabilities."""
    yc, sc = F.col(y), F.col(score)
    return pred.groupBy(*keys).agg(
        F.avg(squared_error(yc, sc)).alias("brier"), F.avg(log_loss(yc, sc)).alias("log_loss"))


def best_f1(cum: DataFrame, keys: Sequence[str] = CELL) -> DataFrame:
    """(cell, f1, threshold): the lowest score among those with the highest F1."""
    f1 = 2 * F.col("tp") / (F.col("tp") + F.col("fp") + F.col("pos"))
    best = cum.groupBy(*keys).agg(F.max(F.struct(f1.alias("f1"), (-F.col("score")).alias("s")))
                                  .alias("best"))
    return best.select(*keys, F.col("best.f1").alias("f1"), (-F.col("best.s")).alias("threshold"))


def _evenly_spaced(idx: Column, m: Column, k: int) -> Column:
    """Whether idx is one of k truncated evenly spaced positions in 0..m-1."""
    step = F.greatest(m - 1, F.lit(1)) / F.lit(float(k - 1))
    near = F.floor(idx / step)
    hits = [(near + d >= 0) & (near + d <= k - 2) & (F.floor((near + d) * step) == idx)
            for d in (0, 1, 2)]
    return (m <= k) | (idx == m - 1) | hits[0] | hits[1] | hits[2]


def roc_curve(pred: DataFrame, keys: Sequence[str] = CELL, y: str = "y_true",
              score: str = "score_raw", k: int = CURVE_POINTS,
              range_rows: int = RANGE_ROWS) -> DataFrame:
    """(cell, idx, fpr, tpr) from (0,0) on, thinned to at most k points.

    A point between two equal steps lies on a straight line and is dropped. The
    index counts the kept points in descending score order.
    """
    points = split_points(pred, score, range_rows)
    cum = cumulative(pred, keys, y, score, following=["p", "n"], points=points)
    first = (F.col("tp") == F.col("p")) & (F.col("fp") == F.col("n"))
    bend = (F.col("next_p") != F.col("p")) | (F.col("next_n") != F.col("n"))
    kept = cum.where(first | F.col("next_p").isNull() | bend).select(
        *keys, "score", F.try_divide("fp", "neg").alias("fpr"),
        F.try_divide("tp", "pos").alias("tpr"), F.lit(1).cast("long").alias("one"))
    if points:
        kept = pinned(kept)  # the range sums and the rows both read it
    ranked = running_totals(kept, keys, "score", {"one": F.col("one")}, descending=True,
                            points=points)
    body = ranked.select(*keys, F.col("cum_one").alias("idx"), (F.col("tot_one") + 1).alias("m"),
                         "fpr", "tpr")
    # The origin rides along with the first point, so no second pass is needed.
    rows = F.when(F.col("idx") == 1, F.array(
        F.struct(F.lit(0).cast("long").alias("idx"), F.lit(0.0).alias("fpr"),
                 F.lit(0.0).alias("tpr")),
        F.struct("idx", "fpr", "tpr"))).otherwise(F.array(F.struct("idx", "fpr", "tpr")))
    full = body.select(*keys, "m", F.inline(rows))
    return full.where(_evenly_spaced(F.col("idx"), F.col("m"), k)).drop("m")


def pr_curve(pred: DataFrame, keys: Sequence[str] = CELL, y: str = "y_true",
             score: str = "score_raw", k: int = CURVE_POINTS,
             range_rows: int = RANGE_ROWS) -> DataFrame:
    """(cell, idx, recall, precision) in ascending score order, ending in (0, 1)."""
    points = split_points(pred, score, range_rows)
    cum = cumulative(pred, keys, y, score, points=points)
    if points:
        cum = pinned(cum)
    ranked = running_totals(cum.withColumn("one", F.lit(1).cast("long")), keys, "score",
                            {"one": F.col("one")}, points=points)
    body = ranked.select(
        *keys, (F.col("cum_one") - 1).alias("idx"), (F.col("tot_one") + 1).alias("m"),
        F.coalesce(F.try_divide("tp", "pos"), F.lit(1.0)).alias("recall"),
        (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"))
    rows = F.when(F.col("idx") == F.col("m") - 2, F.array(
        F.struct("idx", "recall", "precision"),
        F.struct((F.col("idx") + 1).alias("idx"), F.lit(0.0).alias("recall"),
                 F.lit(1.0).alias("precision")))).otherwise(
        F.array(F.struct("idx", "recall", "precision")))
    full = body.select(*keys, "m", F.inline(rows))
    return full.where(_evenly_spaced(F.col("idx"), F.col("m"), k)).drop("m")

"""Rates from confusion counts, and score losses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: scores are clipped this far from 0 and 1 before a log.
CLIP = 1e-7

RATE_METRICS = ["sensitivity", "specificity", "ppv", "npv", "f1", "flagged_pct"]


def over(num: Column, den: Column) -> Column:
    """num / den, where an empty denominator counts as 1 (so the rate is 0)."""
    return num / F.greatest(den, F.lit(1))


def rates(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    return {
        "sensitivity": over(tp, tp + fn),
        "specificity": over(tn, tn + fp),
        "ppv": over(tp, tp + fp),
        "npv": over(tn, tn + fn),
        "f1": over(2 * tp, 2 * tp + fp + fn),
        "flagged_pct": 100.0 * over(tp + fp, tp + fp + fn + tn),
    }


def clipped(score: Column) -> Column:
    return F.greatest(F.least(score, F.lit(1 - CLIP)), F.lit(CLIP))


def squared_error(y: Column, score: Column) -> Column:
    return F.pow(clipped(score) - y, F.lit(2))


def log_loss(y: Column, score: Column) -> Column:
    s = clipped(score)
    return -(y * F.ln(s) + (1 - y) * F.ln(1 - s))

"""Joins on cell keys, any of which may be NULL."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str],
                   how: str = "inner") -> DataFrame:
    """A join on columns that may be NULL; the right side brings its other columns."""
    other = right.withColumnsRenamed({c: f"_r_{c}" for c in on})
    same = [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in on]
    return left.join(other, reduce(Column.__and__, same), how).drop(*[f"_r_{c}" for c in on])


def null_safe_left(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    return null_safe_join(left, right, on, "left")

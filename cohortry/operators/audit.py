"""Checks of written outputs: completeness, counts, schemas, staleness, coverage."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.operators.prefix import RANGE_ROWS, running_totals, split_points
from cohortry.session import settle


def grid_missing(models: Sequence[str], labels: Sequence[str],
                 tables: Mapping[str, DataFrame]) -> DataFrame:
    """(model, label, missing): grid cells without rows in a table (model, label)."""
    first = next(iter(tables.values()))
    grid = settle(first.sparkSession.createDataFrame(
        [(m, y) for m in models for y in labels], "model string, label string"))
    parts = [grid.join(t.select("model", "label").distinct(), ["model", "label"], "left_anti")
             .withColumn("missing", F.lit(name)) for name, t in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def rowcount_check(pred: DataFrame, expected: DataFrame, keys: Sequence[str],
                   on: Sequence[str]) -> DataFrame:
    """(keys, n_rows, expected, ok): every cell against its cohort's row count."""
    counts = pred.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
    return counts.join(settle(expected), list(on), "left").withColumn(
        "ok", F.coalesce(F.col("n_rows") == F.col("expected"), F.lit(False)))


def schema_differences(a: DataFrame, b: DataFrame) -> list[str]:
    """Columns and types that only one of two tables has; no row is read."""
    x, y = ({(f.name, f.dataType.simpleString()) for f in d.schema} for d in (a, b))
    return sorted(f"{n}:{t}" for n, t in x ^ y)


def finite_scores(pred: DataFrame, keys: Sequence[str], score: str = "score_raw") -> DataFrame:
    """(keys, n_rows, n_bad): scores that are missing, NaN or infinite."""
    s = F.col(score)
    bad = s.isNull() | F.isnan(s) | (F.abs(s) == float("inf"))
    return pred.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"),
                                   F.count_if(bad).alias("n_bad"))


def fingerprint(spec: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, config_sha): one hash over the sorted lines of a spec table.

    A spec has one row per column of the data, so its lines fit one value.
    """
    line = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    return spec.groupBy(*keys).agg(
        F.sha2(F.array_join(F.sort_array(F.collect_list(line)), "\n"), 256).alias("config_sha"))


def stale_outputs(outputs: DataFrame, current: DataFrame) -> DataFrame:
    """Outputs stamped with another fingerprint than the current one."""
    sha = current.first()["config_sha"]
    return outputs.where(~F.col("config_sha").eqNullSafe(F.lit(sha)))


def best_iteration_check(meta: DataFrame, boosted: Sequence[str]) -> DataFrame:
    """Boosted cells without a usable best iteration: they cannot be replayed."""
    at = F.col("best_iteration")
    return meta.where(F.col("model").isin(*boosted) & (at.isNull() | (at < 0)))


def interval_gaps(shards: DataFrame, n: int, lo: str = "lo", hi: str = "hi",
                  range_rows: int = RANGE_ROWS) -> DataFrame:
    """(gap_lo, gap_hi): parts of [0, n) that no shard [lo, hi) covers.

    A sweep over the edges: +1 where a shard starts, -1 where one ends, and a gap
    wherever the running sum is 0. Equal edges are merged before the shuffle.
    """
    both = F.array(F.struct(F.col(lo).cast("long").alias("at"), F.lit(1).alias("step")),
                   F.struct(F.col(hi).cast("long").alias("at"), F.lit(-1).alias("step")))
    ends = shards.sparkSession.createDataFrame([(0, 0), (n, 0)], "at long, step int")
    edges = shards.where(F.col(lo) < F.col(hi)).select(F.inline(both)).unionByName(ends)
    at = edges.groupBy("at").agg(F.sum("step").alias("step")).withColumn("_all", F.lit(0))
    points = split_points(edges, "at", range_rows)
    swept = running_totals(at, ["_all"], "at", {"open": F.col("step")}, points=points,
                           following=["at"])
    gap_lo, gap_hi = F.greatest("at", F.lit(0)), F.least("next_at", F.lit(n))
    return swept.where((F.col("cum_open") == 0) & F.col("next_at").isNotNull()).select(
        gap_lo.alias("gap_lo"), gap_hi.alias("gap_hi")).where("gap_lo < gap_hi")

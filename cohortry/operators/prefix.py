"""Running totals over an order, without sorting a whole group in one task.

A window ordered over a large group runs in a single task. Here the order column
is cut into value ranges first: rows are summed inside each (group, range), and
the totals of the earlier ranges are added. A table that fits one range takes the
same way with one range, so there is one answer at every size.

Orders are Spark's: NULL first, NaN after all numbers. Group keys may be NULL.
Numbers, dates and times are cut by literals in the plan, so a retried task puts
every row where it was before. Other types are dealt by Spark's range partitioning
and written, which keeps the dealing.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortry.session import pinned

# Rows that one range holds, about.
RANGE_ROWS = 1_000_000
SAMPLE_PER_RANGE = 2_000
_RANGE = "_range"


class Dealt:
    """Stands for cut points where values are not numbers: how many ranges to deal."""

    def __init__(self, parts: int):
        self.parts = parts


def _numeric(df: DataFrame, value: str) -> bool:
    return isinstance(df.schema[value].dataType, (T.NumericType, T.DateType, T.TimestampType,
                                                  T.TimestampNTZType, T.BooleanType))


def _number(df: DataFrame, value: str) -> Column:
    kind = df.schema[value].dataType
    if isinstance(kind, T.DateType):
        return F.unix_date(value).cast("double")
    if isinstance(kind, T.TimestampNTZType):
        return F.col(value).cast("timestamp").cast("double")
    return F.col(value).cast("double")


def sampled_quantiles(df: DataFrame, value: str, parts: int, n: int) -> list[float]:
    """parts + 1 cut values from a sample of a value column.

    They only decide which task gets which rows, never a result, so a sample with a
    fixed number of rows for each range is enough.
    """
    share = min(1.0, parts * SAMPLE_PER_RANGE / n)
    v = _number(df, value)
    values = df.select(F.when(~F.isnan(v), v).alias("v"))
    if share < 1:
        values = values.sample(share, seed=17)
    probs = [i / parts for i in range(parts + 1)]
    return [c for c in values.approxQuantile("v", probs, 1.0 / (8 * parts)) if math.isfinite(c)]


def split_points(df: DataFrame, value: str, range_rows: int = RANGE_ROWS) -> list[float] | Dealt:
    """Cut points that leave about ``range_rows`` rows between two of them.

    Empty for a table that fits one range. The cuts are taken over all groups
    together: a range then holds at most its share of all rows, so no (group,
    range) is larger, however uneven the groups are. What reaches the driver is
    one number for each range.
    """
    parts = math.ceil(df.count() / range_rows)
    if not _numeric(df, value):
        return Dealt(parts)
    if parts <= 1:
        return []
    return sorted(set(sampled_quantiles(df, value, parts, parts * range_rows)))


def in_ranges(df: DataFrame, value: str, points: Sequence[float] | Dealt,
              out: str = _RANGE) -> DataFrame:
    """Adds the range number of a value; equal values share a range, NULL has the first
    and NaN the last."""
    if isinstance(points, Dealt):
        if points.parts <= 1:
            return df.withColumn(out, F.lit(0))
        dealt = df.repartitionByRange(points.parts, F.col(value).asc_nulls_first())
        return pinned(dealt.withColumn(out, F.spark_partition_id()))
    if not points:
        return df.withColumn(out, F.lit(0))
    tmp = f"{out}_v"
    cut = Bucketizer(splits=[-math.inf, *points, math.inf], inputCol=tmp, outputCol=out,
                     handleInvalid="keep")
    ranged = cut.transform(df.withColumn(tmp, _number(df, value)))
    return ranged.withColumn(out, F.coalesce(F.col(out).cast("int"), F.lit(-1))).drop(tmp)


def running_totals(df: DataFrame, keys: Sequence[str], order: str, measures: dict[str, Column],
                   descending: bool = False, points: Sequence[float] = (),
                   following: Sequence[str] = (), totals: bool = True,
                   source: tuple[DataFrame, str, dict[str, Column]] | None = None) -> DataFrame:
    """Per row: ``cum_<m>`` up to and with it, ``tot_<m>`` of its group.

    ``order`` must be unique within a group (group by it first). Columns named
    in ``following`` are also returned as ``next_<c>``, from the next row. Without
    ``totals`` the rows stream through one window and need no buffer.

    ``source`` (rows, order, measures) may name the table ``df`` was grouped from.
    The sums per range are then taken there, by map-side sums over one more scan,
    instead of grouping all distinct values a second time.
    """
    keys = list(keys)
    asc = F.desc_nulls_last if descending else F.asc_nulls_first
    if not isinstance(points, Dealt) and not points:
        # One range: its sums are the group's, so nothing has to be added.
        part = Window.partitionBy(*keys)
        seq = part.orderBy(asc(order))
        run = seq.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return df.select(
            "*",
            *[F.sum(m).over(run).alias(f"cum_{k}") for k, m in measures.items()],
            *[F.sum(m).over(part).alias(f"tot_{k}") for k, m in measures.items() if totals],
            *[F.lead(c).over(seq).alias(f"next_{c}") for c in following],
        )

    ranged = in_ranges(df, order, points)
    if isinstance(points, Dealt):
        source = None  # only these rows are dealt
    if source is None or following:
        base, base_measures = ranged, measures
    else:
        base, base_measures = in_ranges(source[0], source[1], points), source[2]
    # NULL is the smallest value of a struct as it is of the order.
    edge = F.max if descending else F.min
    heads = [edge(F.struct(F.col(order).alias("_at"), *following)).alias("_head")
             ] if following else []
    sums = base.groupBy(*keys, _RANGE).agg(
        *[F.sum(m).alias(f"_in_{k}") for k, m in base_measures.items()], *heads)

    # One row per group and range from here: a range has about RANGE_ROWS rows.
    group = Window.partitionBy(*keys)
    steps = group.orderBy(asc(_RANGE))
    upto = steps.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = sums.select(
        *keys, _RANGE,
        *[(F.sum(f"_in_{k}").over(upto) - F.col(f"_in_{k}")).alias(f"_off_{k}") for k in measures],
        *[F.sum(f"_in_{k}").over(group).alias(f"tot_{k}") for k in measures],
        *([F.lead("_head").over(steps).alias("_next_head")] if following else []),
    )

    inner = Window.partitionBy(*keys, _RANGE).orderBy(asc(order))
    run = inner.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = ranged.select(
        "*",
        *[F.sum(m).over(run).alias(f"_loc_{k}") for k, m in measures.items()],
        *[F.lead(c).over(inner).alias(f"_lead_{c}") for c in following],
        *([F.lead(F.lit(True)).over(inner).alias("_has_lead")] if following else []),
    )
    offsets = offsets.withColumnsRenamed({c: f"_o_{c}" for c in [*keys, _RANGE]})
    same = [F.col(c).eqNullSafe(F.col(f"_o_{c}")) for c in [*keys, _RANGE]]
    joined = local.join(offsets, reduce(Column.__and__, same))
    return joined.select(
        *df.columns,
        *[(F.col(f"_loc_{k}") + F.col(f"_off_{k}")).alias(f"cum_{k}") for k in measures],
        *[F.col(f"tot_{k}") for k in measures if totals],
        *[F.when(F.col("_has_lead"), F.col(f"_lead_{c}"))
           .otherwise(F.col(f"_next_head.{c}")).alias(f"next_{c}") for c in following],
    )


def value_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(group, value, cnt): ties are merged before anything is shuffled."""
    return (df.where(F.col(value).isNotNull()).groupBy(*keys, value)
            .agg(F.count(F.lit(1)).alias("cnt")))


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float],
                    range_rows: int = RANGE_ROWS) -> DataFrame:
    """Linear-interpolated quantiles of each group: (group, prob, quantile).

    Read off running counts of the distinct values, so no task has to hold a
    group's values, as the built-in exact percentile would.
    """
    counts = value_counts(df, keys, value)
    points = split_points(df, value, range_rows)
    known = df.where(F.col(value).isNotNull())
    cum = running_totals(counts, keys, value, {"cnt": F.col("cnt")}, points=points,
                         source=(known, value, {"cnt": F.lit(1)}))
    return quantiles_of(cum, keys, value, probs, upto="cum_cnt", own="cnt", total="tot_cnt")


def quantiles_of(cum: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float],
                 upto: str, own: str, total: str) -> DataFrame:
    """Quantiles from a table of ascending running counts."""
    last = F.col(upto) - 1
    first = F.col(upto) - F.col(own)

    def at(rank: Column) -> Column:
        return F.max(F.when((first <= rank) & (rank <= last), F.col(value)))

    parts = []
    for i, q in enumerate(probs):
        pos = (F.col(total) - 1) * F.lit(float(q))
        parts += [at(F.floor(pos)).alias(f"lo{i}"), at(F.ceil(pos)).alias(f"hi{i}"),
                  F.max(pos - F.floor(pos)).alias(f"fr{i}")]
    wide = cum.groupBy(*keys).agg(*parts)
    entries = [
        F.struct(F.lit(float(q)).alias("prob"),
                 F.when((F.col(f"fr{i}") == 0) | (F.col(f"lo{i}") == F.col(f"hi{i}")),
                        F.col(f"lo{i}"))
                 .otherwise(F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}")) * F.col(f"fr{i}"))
                 .cast("double").alias("quantile"))
        for i, q in enumerate(probs)]
    return wide.select(*keys, F.inline(F.array(*entries)))

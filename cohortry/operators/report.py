"""Report tables: summaries, ranking panels, availability and drift."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortry.functions.rates import RATE_METRICS
from cohortry.operators.bootstrap import intervals, long_draws
from cohortry.operators.harmonize import recorded_counts
from cohortry.operators.joins import null_safe_join, null_safe_left
from cohortry.operators.ranking import CELL

SHIFT_POINTS = 25.0
# Decimals of a printed cell, and what counts as equal to the best.
DECIMALS, BEST_WITHIN, AXIS_PAD = 3, 5e-7, 0.06
EMPTY_CELL = "—"
SUMMARY_COLUMNS = [
    "cohort", "model", "label", "n_rows", "n_pos", "prevalence", "kind", "rule", "metric",
    "value", "ci_lo", "ci_hi", "boot_std", "n_boot_valid", "threshold", "threshold_source",
    "tp", "fp", "fn", "tn", "n_flagged"]


def tidy_summary(areas: DataFrame, points: DataFrame, rank_draws: DataFrame,
                 rule_draws: DataFrame) -> DataFrame:
    """One row per cell, rule and metric with value, interval and counts."""
    base = [*CELL, "n_rows", "n_pos", "prevalence"]
    ranking = areas.unpivot(base, ["auroc", "auprc"], "metric", "value").withColumns({
        "kind": F.lit("ranking"), "rule": F.lit("ranking"),
        "threshold_source": F.lit("none (rank metric)")})
    counts = ["tp", "fp", "fn", "tn", "n_flagged"]
    per_rule = points.unpivot(
        [*CELL, "rule", "kind", "threshold", "threshold_source", *counts], RATE_METRICS,
        "metric", "value")
    per_rule = null_safe_join(per_rule, areas.select(*base), CELL)
    rows = ranking.unionByName(per_rule, allowMissingColumns=True)
    draws = long_draws(rank_draws, CELL, ["auroc", "auprc"]).withColumn(
        "rule", F.lit("ranking")).unionByName(
        long_draws(rule_draws, [*CELL, "rule"], RATE_METRICS))
    spread = intervals(draws, [*CELL, "rule", "metric"])
    return null_safe_left(rows, spread, [*CELL, "rule", "metric"]).select(*SUMMARY_COLUMNS)


def sorted_summary(summary: DataFrame) -> DataFrame:
    return summary.orderBy("label", "kind", "metric", F.desc("value"))


def wide_ranking(summary: DataFrame, with_cohort: bool = True) -> DataFrame:
    """One row per cell: both areas with their intervals."""
    key = CELL if with_cohort else CELL[1:]
    wide = summary.where(F.col("kind") == "ranking").groupBy(*key, "n_rows", "n_pos").pivot(
        "metric", ["auroc", "auprc"]).agg(
        F.max("value").alias("value"), F.max("ci_lo").alias("ci_lo"), F.max("ci_hi").alias("ci_hi"))
    return wide.withColumnsRenamed({"auroc_value": "auroc", "auprc_value": "auprc"})


def interval_text(value: Column, lo: Column, hi: Column, dash: str = "-") -> Column:
    """``0.812 (0.790-0.833)``."""
    return F.format_string(f"%.{DECIMALS}f (%.{DECIMALS}f{dash}%.{DECIMALS}f)", value, lo, hi)


def ranking_cells(summary: DataFrame, on_print: bool = True, dash: str = "-") -> DataFrame:
    """(cohort, model, label, metric, value, text, best) of the ranking rows.

    Best is the highest printed value of its column, ties all marked; or the
    highest value at full precision with ``on_print=False``.
    """
    col = Window.partitionBy("cohort", "label", "metric")
    r = summary.where((F.col("kind") == "ranking") & F.col("value").isNotNull())
    top = F.max("value").over(col)
    best = (F.round("value", DECIMALS) >= F.round(top, DECIMALS)) if on_print else (
        F.abs(F.col("value") - top) < BEST_WITHIN)
    return r.withColumns({
        "text": interval_text(F.col("value"), F.col("ci_lo"), F.col("ci_hi"), dash), "best": best})


def panel(cells: DataFrame, labels: Sequence[str]) -> DataFrame:
    """One row per cohort, metric and model; one column per outcome; best starred."""
    shown = F.when(F.col("best"), F.concat(F.lit("**"), "text", F.lit("**"))).otherwise(
        F.col("text"))
    wide = cells.withColumn("shown", shown).groupBy("cohort", "metric", "model").pivot(
        "label", list(labels)).agg(F.first("shown"))
    return wide.na.fill(EMPTY_CELL, list(labels))


def event_counts(counts: DataFrame) -> DataFrame:
    """(cohort, label, n_pos, text): events and their share in percent."""
    return counts.select("cohort", "label", "n_pos", F.format_string(
        "%s %d (%.1f%%)", F.col("label"), F.col("n_pos"), F.col("prevalence") * 100).alias("text"))


def merged_arms(arms: Mapping[str, DataFrame | None]) -> DataFrame:
    """Ranking rows of several summaries under one another; an absent one is skipped."""
    frames = [s.where((F.col("kind") == "ranking") & F.col("metric").isin("auroc", "auprc"))
              .withColumn("arm", F.lit(arm)) for arm, s in arms.items() if s is not None]
    if not frames:
        raise ValueError("no summary to merge")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def reference_rows(cells: DataFrame, reference: DataFrame, cohort: str, labels: Sequence[str],
                   name: str) -> DataFrame:
    """The panel of one cohort with a published score below the models.

    The reference is shown for the outcomes it has, is never marked best, and
    other outcomes get a dash.
    """
    body = panel(cells.where(F.col("cohort") == cohort), labels).withColumn("position", F.lit(0))
    ref = reference.where(F.col("cohort") == cohort).withColumns({
        "model": F.lit(name), "best": F.lit(False),
        "text": interval_text(F.col("value"), F.col("ci_lo"), F.col("ci_hi"))})
    foot = panel(ref, labels).withColumn("position", F.lit(1))
    return body.unionByName(foot)


def axis_ranges(summary: DataFrame, reference: DataFrame | None = None,
                metric: str = "auroc") -> DataFrame:
    """(label, lo, hi) over all cohorts and the reference value, padded."""
    r = summary.where((F.col("kind") == "ranking") & (F.col("metric") == metric)).select(
        "label", "ci_lo", "ci_hi")
    if reference is not None:
        r = r.unionByName(reference.where(F.col("metric") == metric).select(
            "label", F.col("value").alias("ci_lo"), F.col("value").alias("ci_hi")))
    span = r.groupBy("label").agg(F.min("ci_lo").alias("lo"), F.max("ci_hi").alias("hi"))
    pad = (F.col("hi") - F.col("lo")) * AXIS_PAD
    return span.select("label", (F.col("lo") - pad).alias("lo"), (F.col("hi") + pad).alias("hi"))


def feature_availability(df: DataFrame, columns: Sequence[str], samples: Mapping[str, Column],
                         train: str, test: str) -> DataFrame:
    """(column, pct_<sample>.., train_minus_test, unusable, large_shift).

    ``samples`` maps a name to a row condition; the table is read once for all.
    """
    tagged = df.withColumn("sample", F.filter(
        F.array(*[F.when(c, F.lit(s)) for s, c in samples.items()]), lambda s: s.isNotNull()))
    counts = recorded_counts(tagged.withColumn("sample", F.explode("sample")), columns, ["sample"])
    pct = F.round(100.0 * F.col("n_recorded") / F.col("n_rows"), 2)
    wide = counts.groupBy("column").pivot("sample", list(samples)).agg(F.max(pct))
    wide = wide.withColumnsRenamed({s: f"pct_{s}" for s in samples})
    shift = F.round(F.col(f"pct_{train}") - F.col(f"pct_{test}"), 2)
    return wide.withColumns({
        "train_minus_test": shift,
        "unusable": (F.col(f"pct_{test}") == 0) & (F.col(f"pct_{train}") > 0),
        "large_shift": F.abs(shift) >= SHIFT_POINTS})


def with_unused_columns(report: DataFrame, spec: DataFrame) -> DataFrame:
    """Adds the columns of the spec that are no model input, with zeros."""
    numeric = [c for c in report.columns if c.startswith("pct_") or c == "train_minus_test"]
    rest = spec.select("column").join(report, "column", "left_anti").withColumns({
        **{c: F.lit(0.0) for c in numeric}, "unusable": F.lit(False),
        "large_shift": F.lit(False), "in_model": F.lit(False)})
    return report.withColumn("in_model", F.lit(True)).unionByName(rest).orderBy(
        F.desc("train_minus_test"), "column")


def throughput(stages: DataFrame, keys: Sequence[str], target_rows: int) -> DataFrame:
    """(keys, n_rows, seconds, rows_per_sec, hours): what a target size would take."""
    sums = stages.groupBy(*keys).agg(F.sum("n_rows").alias("n_rows"),
                                     F.sum("seconds").alias("seconds"))
    rate = F.try_divide("n_rows", "seconds")
    return sums.withColumn("rows_per_sec", rate).withColumn(
        "hours", F.try_divide(F.lit(float(target_rows)), F.col("rows_per_sec")) / 3600)

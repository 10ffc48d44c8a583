"""Rank-based operating points and what each of them flags."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.functions.hashing import SEED, label_seed_col
from cohortry.functions.rates import rates
from cohortry.operators.joins import null_safe_join, null_safe_left
from cohortry.operators.prefix import RANGE_ROWS, quantiles_of
from cohortry.operators.ranking import CELL, best_f1, cumulative, known_score
from cohortry.operators.split import halves
from cohortry.session import pinned, settle

TOP_K = (1, 2, 5, 10)
VAL_RULE = "F1-max @ val"
CROSSFIT_RULE = "F1-max (cross-fitted)"
SOURCES = {
    "topk": "score quantile within this cohort",
    "f1_val": "F1-maximising threshold of the validation split, applied unchanged",
    "f1_crossfit": "cross-fitted within the internal cohort",
}


def slug(rule: Column) -> Column:
    """A name for a rule that can be a column name."""
    return F.btrim(F.regexp_replace(F.lower(rule), "[^0-9a-z]+", "_"), F.lit("_"))


def topk_cuts(pred: DataFrame, ks: Sequence[float] = TOP_K, keys: Sequence[str] = CELL,
              range_rows: int = RANGE_ROWS, cum: DataFrame | None = None) -> DataFrame:
    """(cell, rule, kind, threshold): the score that flags the top k percent.

    The cut is the cell's own interpolated quantile, read off the running counts (``cum``,
    if they have been made).
    """
    cum = cumulative(pred, keys, range_rows=range_rows) if cum is None else cum
    cum = cum.withColumns({
        "own": F.col("p") + F.col("n"),
        "upto": F.col("pos") + F.col("neg") - F.col("tp") - F.col("fp") + F.col("p") + F.col("n"),
        "total": F.col("pos") + F.col("neg")})
    probs = [(100 - k) / 100 for k in ks]
    cuts = quantiles_of(cum, keys, "score", probs, "upto", "own", "total")
    name = F.create_map(*[x for k, q in zip(ks, probs)
                          for x in (F.lit(q), F.lit(f"top{k:g}%"))])
    return cuts.select(*keys, name[F.col("prob")].alias("rule"), F.lit("topk").alias("kind"),
                       F.col("quantile").alias("threshold"))


def val_cuts(val: DataFrame, keys: Sequence[str] = ("model", "label"),
             range_rows: int = RANGE_ROWS) -> DataFrame:
    """(model, label, threshold): the F1-maximising score of the validation rows."""
    return best_f1(cumulative(val, keys, range_rows=range_rows), keys).drop("f1")


def transferred(cells: DataFrame, cuts: DataFrame) -> DataFrame:
    """The validation threshold as a rule of every cell with that model and outcome."""
    return null_safe_join(cells.select(*CELL).distinct(), cuts, ["model", "label"]).select(
        *CELL, F.lit(VAL_RULE).alias("rule"), F.lit("f1_val").alias("kind"), "threshold")


def with_halves(pred: DataFrame, seed: int = SEED) -> DataFrame:
    """Adds half A or B; the models of an outcome share the halves."""
    return halves(pred, CELL, label_seed_col(F.col("label"), seed))


def confusion(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, tp, fp, fn, tn, n_flagged, rates) from (keys, p, n, flag) rows."""
    flag = F.col("flag")
    sums = counts.groupBy(*keys).agg(
        F.sum(F.when(flag, F.col("p")).otherwise(0)).alias("tp"),
        F.sum(F.when(flag, F.col("n")).otherwise(0)).alias("fp"),
        F.sum(F.when(flag, 0).otherwise(F.col("p"))).alias("fn"),
        F.sum(F.when(flag, 0).otherwise(F.col("n"))).alias("tn"))
    return with_rates(sums)


def apply_cuts(pred: DataFrame, rules: DataFrame, keys: Sequence[str] = CELL) -> DataFrame:
    """Confusion of every rule, in one pass over the predictions.

    ``rules`` (keys, rule, kind, threshold) has a few rows per cell. Each task
    joins them to its rows and adds up at once, so what is shuffled is one row
    per cell and rule.
    """
    y = F.col("y_true").cast("long")
    hit = null_safe_join(pred.select(*keys, "score_raw", y.alias("p"), (1 - y).alias("n")),
                         settle(rules), keys)
    return confusion(hit.withColumn("flag", known_score(F.col("score_raw")) >= F.col("threshold")),
                     [*keys, "rule", "kind", "threshold"])


def read_off(cum: DataFrame, rules: DataFrame, names: Sequence[str],
             keys: Sequence[str] = CELL) -> DataFrame:
    """Confusion of the rules in ``names``, read off running counts: no prediction is joined
    to a rule, and a row per distinct score stays one row."""
    keys = list(keys)
    held = F.struct("threshold", "kind")
    wide = settle(rules.groupBy(*keys).pivot("rule", list(names)).agg(F.first(held)))
    at = {n: F.col(f"`{n}`") for n in names}
    tops = [F.max(F.when(F.col("score") >= c["threshold"], F.col(x))).alias(f"{x}{i}")
            for i, c in enumerate(at.values()) for x in ("tp", "fp")]
    sums = null_safe_join(cum, wide, keys).groupBy(
        *keys, *[c.alias(f"r{i}") for i, c in enumerate(at.values())]).agg(
        F.max("pos").alias("pos"), F.max("neg").alias("neg"), *tops)
    zero = F.lit(0).cast("long")
    entries = F.array(*[F.struct(
        F.lit(n).alias("rule"), F.col(f"r{i}").alias("r"),
        F.coalesce(F.col(f"tp{i}"), zero).alias("tp"), F.coalesce(F.col(f"fp{i}"), zero).alias("fp"))
        for i, n in enumerate(names)])
    rows = sums.select(*keys, "pos", "neg", F.inline(entries)).where(F.col("r").isNotNull())
    return with_rates(rows.select(*keys, "rule", F.col("r.kind").alias("kind"),
                                  F.col("r.threshold").alias("threshold"), "tp", "fp",
                                  (F.col("pos") - F.col("tp")).alias("fn"),
                                  (F.col("neg") - F.col("fp")).alias("tn")))


def with_rates(sums: DataFrame) -> DataFrame:
    r = rates(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn"))
    return sums.withColumn("n_flagged", F.col("tp") + F.col("fp")).withColumns(r)


def half_counts(pred: DataFrame, seed: int = SEED, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Running counts of each half of each cell."""
    return cumulative(with_halves(pred, seed), [*CELL, "half"], range_rows=range_rows)


def half_cuts(counts: DataFrame) -> DataFrame:
    """(cell, half, threshold): the cut for a half, learned on the other half. A half whose
    other half is empty has the cut 1."""
    learned = best_f1(counts, [*CELL, "half"])
    other = F.when(F.col("half") == "A", "B").otherwise("A")
    given = counts.select(*CELL, "half").distinct()
    return null_safe_left(given, learned.withColumn("half", other).select(*CELL, "half", "threshold"),
                          [*CELL, "half"]).withColumn("threshold", F.coalesce("threshold", F.lit(1.0)))


def crossfit(pred: DataFrame, seed: int = SEED, range_rows: int = RANGE_ROWS,
             counts: DataFrame | None = None, cuts: DataFrame | None = None) -> DataFrame:
    """Confusion of the cross-fitted rule: no row is flagged by a threshold that was chosen
    with its own outcome. Only for the internal cohort. Read off the running counts of the
    halves (``counts`` and ``cuts``, if they have been made)."""
    counts = pinned(half_counts(pred, seed, range_rows)) if counts is None else counts
    cuts = settle(half_cuts(counts)) if cuts is None else cuts
    zero = F.lit(0).cast("long")
    hit = F.col("score") >= F.col("threshold")
    per_half = null_safe_join(counts, cuts, [*CELL, "half"]).groupBy(*CELL, "half", "threshold").agg(
        F.coalesce(F.max(F.when(hit, F.col("tp"))), zero).alias("tp"),
        F.coalesce(F.max(F.when(hit, F.col("fp"))), zero).alias("fp"),
        F.max("pos").alias("pos"), F.max("neg").alias("neg"))
    cells = per_half.groupBy(*CELL).agg(
        F.sum("tp").alias("tp"), F.sum("fp").alias("fp"),
        F.sum(F.col("pos") - F.col("tp")).alias("fn"), F.sum(F.col("neg") - F.col("fp")).alias("tn"),
        F.max(F.when(F.col("half") == "A", F.col("threshold"))).alias("t_b"),
        F.max(F.when(F.col("half") == "B", F.col("threshold"))).alias("t_a"))
    return with_rates(cells).withColumns({
        "rule": F.lit(CROSSFIT_RULE), "kind": F.lit("f1_crossfit"),
        "threshold": F.lit(None).cast("double")})


@dataclass
class Rules:
    """What all operating points of a set of predictions are read off, each table made once."""
    counts: DataFrame
    rules: DataFrame
    names: list[str]
    halves: DataFrame
    cuts: DataFrame


def learn_rules(pred: DataFrame, val: DataFrame, internal: str, ks: Sequence[float] = TOP_K,
                seed: int = SEED, range_rows: int = RANGE_ROWS) -> Rules:
    counts = pinned(cumulative(pred, range_rows=range_rows))
    rules = topk_cuts(pred, ks, cum=counts).unionByName(
        transferred(counts, val_cuts(val, range_rows=range_rows)))
    halves_ = pinned(half_counts(pred.where(F.col("cohort") == internal), seed, range_rows))
    return Rules(counts, pinned(rules), [f"top{k:g}%" for k in ks] + [VAL_RULE], halves_,
                 settle(half_cuts(halves_)))


def operating_points(pred: DataFrame, val: DataFrame, internal: str, ks: Sequence[float] = TOP_K,
                     seed: int = SEED, range_rows: int = RANGE_ROWS,
                     learned: Rules | None = None) -> DataFrame:
    """Every rule of every cell with its confusion counts and rates."""
    x = learned or learn_rules(pred, val, internal, ks, seed, range_rows)
    fixed = read_off(x.counts, x.rules, x.names)
    crossed = crossfit(pred, seed, range_rows, x.halves, x.cuts)
    source = F.create_map(*[x for k, s in SOURCES.items() for x in (F.lit(k), F.lit(s))])
    return fixed.unionByName(crossed.drop("t_a", "t_b")).withColumn(
        "threshold_source", source[F.col("kind")])


def flagged_rows(pred: DataFrame, rules: DataFrame, names: Sequence[str],
                 crossed: DataFrame | None = None) -> DataFrame:
    """Predictions with a 0/1 column ``f<i>`` per rule in ``names``.

    ``rules`` (cell, rule, threshold); ``crossed`` (cell, half, threshold) needs
    a ``half`` column on the rows. A rule a cell does not have gives NULL.
    """
    per_cell = settle(rules.groupBy(*CELL).agg(F.map_from_entries(
        F.collect_list(F.struct("rule", "threshold"))).alias("cuts")))
    rows = null_safe_join(pred, per_cell, CELL)
    if crossed is not None:
        rows = null_safe_left(rows, settle(crossed.withColumnRenamed("threshold", "_cut")),
                              [*CELL, "half"])

    def cut(rule: str) -> Column:
        if rule == CROSSFIT_RULE and crossed is not None:
            return F.col("_cut")
        return F.try_element_at("cuts", F.lit(rule))

    flags = {f"f{i}": (known_score(F.col("score_raw")) >= cut(r)).cast("int") for i, r in enumerate(names)}
    return rows.withColumns(flags).drop("cuts", "_cut")

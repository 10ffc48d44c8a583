"""Running totals, metrics and draws give one answer however the order is cut."""

import math

import pytest
from pyspark.sql import functions as F

from cohortry.operators import bootstrap, prep, ranking, report, thresholds
from cohortry.operators.prefix import Dealt, running_totals, split_points
from cohortry.operators.split import stratified_split

SIZES = [10, 200, 10**6]


def odd_scores(spark, text_ids=False):
    """Scores with ties, NULL, NaN and infinities; one cell's cohort is NULL."""
    rows = []
    for i in range(600):
        score = [(i * 37 % 101) / 101.0, None, math.nan, math.inf, -math.inf, 0.5][
            0 if i % 7 else 1 + (i // 7) % 5]
        rows.append((f"r{i}" if text_ids else i, ["a", None, "b"][i % 3], "m", "y", score,
                     int((i * 31) % 10 < 3)))
    kind = "string" if text_ids else "long"
    return spark.createDataFrame(rows, f"row_id {kind}, cohort string, model string, label string, "
                                       "score_raw double, y_true int")


def norm(df):
    def cell(v):
        return "nan" if isinstance(v, float) and math.isnan(v) else (
            round(v, 9) if isinstance(v, float) else v)
    return sorted((tuple(cell(v) for v in r) for r in df.collect()), key=repr)


def brute_auroc(rows):
    known = [(-math.inf if s is None or math.isnan(s) else s, y) for s, y in rows]
    pos, neg = [s for s, y in known if y], [s for s, y in known if not y]
    wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    return wins / (len(pos) * len(neg))


def test_discrimination(spark):
    df = odd_scores(spark)
    got = [norm(ranking.discrimination(df, range_rows=r)) for r in SIZES]
    assert got[0] == got[1] == got[2] and len(got[0]) == 3
    rows = {}
    for r in df.collect():
        rows.setdefault(r["cohort"], []).append((r["score_raw"], r["y_true"]))
    for r in ranking.discrimination(df, range_rows=10).collect():
        assert r["n_rows"] == len(rows[r["cohort"]])
        assert r["auroc"] == pytest.approx(brute_auroc(rows[r["cohort"]]))


@pytest.mark.parametrize("what", ["roc", "pr", "f1", "topk"])
def test_curves_and_thresholds(spark, what):
    df = odd_scores(spark)
    make = {"roc": lambda r: ranking.roc_curve(df, range_rows=r),
            "pr": lambda r: ranking.pr_curve(df, range_rows=r),
            "f1": lambda r: ranking.best_f1(ranking.cumulative(df, range_rows=r)),
            "topk": lambda r: thresholds.topk_cuts(df, range_rows=r)}[what]
    got = [norm(make(r)) for r in SIZES]
    assert got[0] == got[1] == got[2] and got[0]


@pytest.mark.parametrize("text_ids", [False, True])
def test_draws(spark, text_ids):
    df = odd_scores(spark, text_ids)
    got = [norm(bootstrap.rank_draws(bootstrap.draw_sums(df, 5, range_rows=r))) for r in SIZES]
    assert got[0] == got[1] == got[2] and len(got[0]) == 15


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("kind", ["double", "string", "date"])
def test_running_totals_of_any_type(spark, kind, descending):
    values = [None, *range(40)] if kind != "double" else [None, math.nan, math.inf, -math.inf, *range(40)]
    rows = [(g, float(v) if v is not None else None, 1 + (7 * k) % 5)
            for g in ("a", None) for k, v in enumerate(values)]
    df = spark.createDataFrame(rows, "g string, v double, w long")
    if kind == "string":
        df = df.withColumn("v", F.when(F.col("v").isNotNull(), F.concat(F.lit("prefix"), F.col("v").cast("string"))))
    if kind == "date":
        df = df.withColumn("v", F.date_add(F.lit("2020-01-01").cast("date"), F.col("v").cast("int")))
    out = []
    for r in (7, 10**6):
        points = split_points(df, "v", r)
        assert isinstance(points, Dealt) == (kind == "string")
        out.append(norm(running_totals(df, ["g"], "v", {"w": F.col("w")}, descending, points, ["w", "v"])))
    assert out[0] == out[1] and len(out[0]) == len(rows)


def test_codes_with_text_row_keys(spark):
    rows = [(f"key{i * 7919 % 1000:04d}", f"v{i % 60}" if i % 9 else None) for i in range(500)]
    df = spark.createDataFrame(rows, "row_id string, c string")
    got = [norm(prep.fit_codes(df, ["c"], range_rows=r)) for r in SIZES]
    assert got[0] == got[1] == got[2]
    first = {}
    for k, v in sorted(rows):
        if v is not None:
            first.setdefault(v, k)
    order = sorted(first, key=first.get)
    assert {r["level"]: r["pos"] for r in prep.fit_codes(df, ["c"], range_rows=20).collect()} == {
        v: i for i, v in enumerate(order)}


def test_rows_without_an_outcome_are_in_no_part(spark):
    df = spark.createDataFrame([(i, None if i % 10 == 0 else int(i % 4 == 0)) for i in range(3000)],
                               "row_id long, y int")
    got = {(r["y"], r["split"]): r["count"]
           for r in stratified_split(df, "y").groupBy("y", "split").count().collect()}
    assert got[(None, None)] == 300
    assert sum(n for (_, s), n in got.items() if s == "val") == 135  # 5 % of 2,700


def null_cells(spark):
    """Predictions and validation rows of two cohorts, one of them NULL."""
    df = odd_scores(spark).withColumn("score_raw", F.col("score_raw").cast("double"))
    named = df.where("cohort IS NOT NULL").select("cohort").first()[0]
    return df, named


def test_rules_hold_for_cells_without_a_name(spark):
    df, named = null_cells(spark)
    filled = df.fillna("zz", ["cohort"])
    for make in (lambda d: thresholds.operating_points(d, d.where(F.col("cohort") == named), named),
                 lambda d: thresholds.apply_cuts(d, thresholds.topk_cuts(d))):
        got, want = make(df), make(filled)
        assert norm(got.fillna("zz", ["cohort"]).select(*sorted(got.columns))) == norm(
            want.select(*sorted(want.columns)))
        assert got.where("cohort IS NULL").count() > 0


def test_intervals_hold_for_cells_without_a_name(spark):
    df, _ = null_cells(spark)
    keys = [*ranking.CELL, "metric"]

    def make(d):
        return bootstrap.intervals(bootstrap.long_draws(
            bootstrap.rank_draws(bootstrap.draw_sums(d, 20)), ranking.CELL, ["auroc", "auprc"]), keys)
    got, want = make(df), make(df.fillna("zz", ["cohort"]))
    assert norm(got.fillna("zz", ["cohort"])) == norm(want)
    assert got.where("cohort IS NULL AND n_boot_valid > 0").count() == 2


def test_differences_and_summary_hold_for_cells_without_a_name(spark):
    df, _ = null_cells(spark)
    two = df.withColumn("model", F.lit("base")).unionByName(df.withColumn("model", F.lit("other"))
                                                            .withColumn("score_raw", -F.col("score_raw")))

    def make(d):
        draws = bootstrap.rank_draws(bootstrap.draw_sums(d, 20))
        points = thresholds.operating_points(d, d, "a")
        return (bootstrap.paired_differences(draws, "base"),
                report.tidy_summary(ranking.discrimination(d), points, draws,
                                    points.select(*ranking.CELL, "rule", F.lit(0).alias("draw"),
                                                  *report.RATE_METRICS)))
    for got, want in zip(make(two), make(two.fillna("zz", ["cohort"]))):
        assert norm(got.fillna("zz", ["cohort"])) == norm(want)
        assert got.where("cohort IS NULL").count() > 0

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortry.functions import hashing
from cohortry.operators import bootstrap, ranking, thresholds
from cohortry.operators.prefix import exact_quantiles, running_totals

CELL = ranking.CELL


def frame(n=4000, seed=0, tied=0.3):
    r = np.random.default_rng(seed)
    s = np.where(r.random(n) < tied, 0.25, np.round(r.random(n), 3))
    return pd.DataFrame({
        "cohort": np.where(np.arange(n) % 5 == 0, "ext", "main"), "model": "m", "label": "y",
        "row_id": np.arange(n), "y_true": (r.random(n) < 0.1 + 0.3 * s).astype(int),
        "score_raw": s})


@pytest.fixture(scope="module")
def pdf():
    return frame()


@pytest.fixture(scope="module")
def pred(spark, pdf):
    return spark.createDataFrame(pdf).repartition(8).cache()


def brute_auroc(y, s):
    p, n = s[y == 1][:, None], s[y == 0][None, :]
    return ((p > n).sum() + 0.5 * (p == n).sum()) / (p.size * n.size)


def brute_ap(y, s):
    total = 0.0
    for t in np.unique(s):
        here = ((s == t) & (y == 1)).sum()
        total += here / y.sum() * ((s >= t) & (y == 1)).sum() / (s >= t).sum()
    return total


@pytest.mark.parametrize("range_rows", [10**9, 300])
def test_areas_equal_brute_force(pred, pdf, range_rows):
    got = {r.cohort: r for r in ranking.discrimination(pred, range_rows=range_rows).collect()}
    for cohort, g in pdf.groupby("cohort"):
        y, s = g.y_true.to_numpy(), g.score_raw.to_numpy()
        assert got[cohort].auroc == pytest.approx(brute_auroc(y, s), abs=1e-12)
        assert got[cohort].auprc == pytest.approx(brute_ap(y, s), abs=1e-12)
        assert (got[cohort].n_rows, got[cohort].n_pos) == (len(y), y.sum())


def test_reversed_scores_mirror(pred):
    a = {r.cohort: r.auroc for r in ranking.discrimination(pred).collect()}
    b = {r.cohort: r.auroc for r in ranking.discrimination(
        pred.withColumn("score_raw", -F.col("score_raw"))).collect()}
    assert all(a[c] + b[c] == pytest.approx(1) for c in a)


def test_one_class_has_no_area(pred):
    row = ranking.discrimination(pred.withColumn("y_true", F.lit(1))).first()
    assert row.auroc is None and row.auprc is None and row.prevalence == 1


@pytest.mark.parametrize("descending", [False, True])
def test_ranges_do_not_change_running_totals(spark, descending):
    r = np.random.default_rng(3)
    rows = pd.DataFrame({"g": r.choice(list("ab"), 3000), "v": np.arange(3000) * 1.0,
                         "w": r.integers(0, 9, 3000)})
    df = spark.createDataFrame(rows)
    out = [running_totals(df, ["g"], "v", {"w": F.col("w")}, descending, points, ["w", "v"])
           .orderBy("v").collect() for points in ((), (0.0, 10.5, 1500.0, 1500.5, 2999.0))]
    assert out[0] == out[1]


@pytest.mark.parametrize("range_rows", [10**9, 100])
def test_quantiles_equal_numpy(pred, pdf, range_rows):
    probs = [0.0, 0.05, 0.5, 0.9, 0.99, 1.0]
    rows = exact_quantiles(pred, ["cohort"], "score_raw", probs, range_rows).collect()
    assert len(rows) == 12
    for r in rows:
        s = pdf.score_raw[pdf.cohort == r.cohort]
        assert r["quantile"] == pytest.approx(np.quantile(s, r.prob), abs=1e-12)


def test_best_f1_takes_lowest_of_equal_scores(spark):
    # Flagging the first alone and flagging the first four both give F1 = 2/3.
    rows = [("c", "m", "y", i, y, s) for i, (y, s) in enumerate(
        [(1, .9), (0, .8), (0, .7), (1, .6), (0, .5)])]
    df = spark.createDataFrame(rows, "cohort string, model string, label string, row_id long,"
                                     " y_true int, score_raw double")
    best = ranking.best_f1(ranking.cumulative(df)).first()
    assert best.f1 == pytest.approx(2 / 3) and best.threshold == 0.6


def test_topk_flags_at_least_k_percent(pred):
    out = thresholds.apply_cuts(pred, thresholds.topk_cuts(pred)).collect()
    assert len(out) == 8
    for r in out:
        assert r.flagged_pct >= float(r.rule[3:-1]) - 0.2
        assert r.tp + r.fp + r.fn + r.tn == (800 if r.cohort == "ext" else 3200)


def test_crossfit_halves_are_even_and_shared_by_models(spark, pred):
    both = pred.unionByName(pred.withColumn("model", F.lit("other")))
    h = thresholds.with_halves(both)
    sizes = {(r.cohort, r.model): r.n for r in h.where("half = 'A'").groupBy("cohort", "model").agg(
        F.count("*").alias("n")).collect()}
    assert set(sizes.values()) == {400, 1600}
    moved = h.groupBy("cohort", "row_id").agg(F.count_distinct("half").alias("k")).where("k > 1")
    assert moved.count() == 0


def thin(x, k):
    return x if len(x) <= k else x[np.unique(np.linspace(0, len(x) - 1, k).astype(int))]


@pytest.mark.parametrize("range_rows", [10**9, 200])
@pytest.mark.parametrize("k", [2000, 37])
def test_curves_equal_brute_force(pred, pdf, range_rows, k):
    roc = ranking.roc_curve(pred, k=k, range_rows=range_rows).toPandas()
    pr = ranking.pr_curve(pred, k=k, range_rows=range_rows).toPandas()
    for cohort, g in pdf.groupby("cohort"):
        y, s = g.y_true.to_numpy(), g.score_raw.to_numpy()
        cuts = np.unique(s)[::-1]
        tp = np.array([((s >= t) & (y == 1)).sum() for t in cuts])
        fp = np.array([((s >= t) & (y == 0)).sum() for t in cuts])
        keep = np.r_[True, np.logical_or(np.diff(fp, 2), np.diff(tp, 2)), True]
        fpr = thin(np.r_[0, fp[keep]] / (y == 0).sum(), k)
        tpr = thin(np.r_[0, tp[keep]] / y.sum(), k)
        got = roc[roc.cohort == cohort].sort_values("idx")
        np.testing.assert_allclose(got.fpr, fpr)
        np.testing.assert_allclose(got.tpr, tpr)
        rec, prec = np.r_[tp[::-1] / y.sum(), 0], np.r_[(tp / (tp + fp))[::-1], 1]
        got = pr[pr.cohort == cohort].sort_values("idx")
        np.testing.assert_allclose(got.recall, thin(rec, k))
        np.testing.assert_allclose(got.precision, thin(prec, k))


def test_weights_in_numpy_and_in_columns_agree(spark):
    ids = [0, 1, 2, 999, 2**31 - 1, 2**31, 2**40 + 7, 2**62]
    df = spark.createDataFrame([(i,) for i in ids], "row_id long")
    l0, l1 = (hashing.row_lane(F.col("row_id"), k) for k in (0, 1))
    cols = [hashing.poisson_weight(hashing.draw_hash(l0, l1, F.lit(d))).alias(f"d{d}")
            for d in (0, 1, 500)]
    rows = df.select(l0.alias("l0"), l1.alias("l1"), *cols).collect()
    got = bootstrap.draw_weights(np.array([r.l0 for r in rows]), np.array([r.l1 for r in rows]),
                                 np.array([0, 1, 500]))
    assert got.astype(int).tolist() == [[r.d0, r.d1, r.d500] for r in rows]


def test_weights_are_poisson_and_independent(spark):
    df = spark.range(200_000).select(
        *[hashing.row_lane(F.col("id"), k).alias(f"l{k}") for k in (0, 1)]).toPandas()
    w = bootstrap.draw_weights(df.l0.to_numpy(), df.l1.to_numpy(), np.arange(40))
    assert abs(w.mean() - 1) < 0.002 and abs(w.var() - 1) < 0.005
    assert abs((w == 0).mean() - np.exp(-1)) < 0.001
    corr = np.corrcoef(w.T)
    assert np.abs(corr - np.eye(40)).max() < 0.012
    assert abs(np.corrcoef(w[:-1].ravel(), w[1:].ravel())[0, 1]) < 0.002


def test_draws_equal_weighted_brute_force_on_both_paths(pred, pdf):
    flagged = pred.withColumn("f0", (F.col("score_raw") >= 0.8).cast("int"))
    paths = [bootstrap.draw_sums(flagged, 6, ["f0"], range_rows=r).toPandas().sort_values(
        ["cohort", "draw"]).reset_index(drop=True) for r in (10**9, 250)]
    assert bootstrap.range_plan(pred, "score_raw", 250)[1], "the tied score should be salted"
    cols = ["pos", "neg", "rank_sum", "prec_sum", "hit_p0", "hit_n0"]
    np.testing.assert_allclose(paths[0][cols], paths[1][cols])

    lanes = pred.select("row_id", *[hashing.row_lane(F.col("row_id"), k).alias(f"l{k}")
                                    for k in (0, 1)]).toPandas()
    g = pdf[pdf.cohort == "ext"].merge(lanes, on="row_id")
    w = bootstrap.draw_weights(g.l0.to_numpy(), g.l1.to_numpy(), np.array([4]))[:, 0].astype(int)
    y, s = np.repeat(g.y_true.to_numpy(), w), np.repeat(g.score_raw.to_numpy(), w)
    row = paths[1][(paths[1].cohort == "ext") & (paths[1].draw == 4)].iloc[0]
    assert row.rank_sum / (row.pos * row.neg) == pytest.approx(brute_auroc(y, s))
    assert row.prec_sum / row.pos == pytest.approx(brute_ap(y, s))
    assert (row.hit_p0, row.hit_n0) == (((s >= .8) & (y == 1)).sum(), ((s >= .8) & (y == 0)).sum())


def test_models_share_draws(pred):
    both = pred.unionByName(pred.withColumn("model", F.lit("copy")))
    draws = bootstrap.rank_draws(bootstrap.draw_sums(both, 5))
    out = bootstrap.paired_differences(draws, "m").collect()
    assert len(out) == 4
    assert all(r.mean_diff == 0 and r.ci_lo == 0 and r.ci_hi == 0 for r in out)


def test_one_class_draws_leave_the_interval(spark):
    rows = [("c", "m", "y", i, int(i == 0), float(i)) for i in range(10)]
    df = spark.createDataFrame(rows, "cohort string, model string, label string, row_id long,"
                                     " y_true int, score_raw double")
    draws = bootstrap.rank_draws(bootstrap.draw_sums(df, 50))
    ci = bootstrap.intervals(bootstrap.long_draws(draws, CELL, ["auroc"]), [*CELL, "metric"])
    used = draws.where("auroc IS NOT NULL").count()
    assert 0 < used < 50 and ci.first().n_boot_valid == used


def test_no_task_counts_the_scores_of_a_large_file(spark):
    rows = spark.range(0, 3000, 1, 1).select(
        F.lit("a").alias("cohort"), (F.col("id") % 3 == 0).cast("int").alias("y_true"),
        (F.col("id") * 7 % 2999 / 2999).alias("score_raw"))
    shown = [ranking.cumulative(rows, ["cohort"], range_rows=n)._jdf.queryExecution().executedPlan()
             .toString() for n in (100, 10**6)]
    assert "RoundRobinPartitioning(" in shown[0] and "RoundRobinPartitioning(" not in shown[1]
    got = [sorted(ranking.cumulative(rows, ["cohort"], range_rows=n).collect()) for n in (100, 10**6)]
    assert got[0] == got[1] and len(got[0]) == 2999

"""Queries over predictions: areas, losses, thresholds, curves, intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortry.functions import hashing
from cohortry.functions.rates import RATE_METRICS
from cohortry.operators import bootstrap, ranking, report, thresholds
from cohortry.plans import fixtures as fx
from cohortry.session import pinned, work_path
from cohortry.sources import sinks
from cohortry.sources.tables import published_scores

CELL = ranking.CELL
N_DRAWS = bootstrap.N_DRAWS
COUNTS = ["tp", "fp", "fn", "tn", "n_flagged"]


def rounded(df, *cols, places=6):
    return df.withColumns({c: F.round(F.col(c), places) for c in cols})


# --- Spark side ---------------------------------------------------------------

def saved(pred):
    """Predictions as evaluation finds them: written once, then read per question."""
    path = work_path(pred.sparkSession, "scores")
    sinks.write_predictions(pred, path)
    return sinks.read_cells(pred.sparkSession, path)


def saved_scores(spark, sf_dir):
    return saved(fx.test_scores(spark, sf_dir)), saved(fx.val_scores(spark, sf_dir))


def auroc_ap(spark, sf_dir):
    out = ranking.discrimination(fx.test_scores(spark, sf_dir))
    return rounded(out, "prevalence", "auroc", "auprc")


def auroc_missing(spark, sf_dir):
    """Scores that divide by the balance: NULL, NaN and infinity occur; a cell without a name."""
    c = fx.cases(spark, sf_dir).where("split = 'test'")
    bad = F.when(F.col("bal") < -900, float("nan")).when(
        F.col("bal") > 9900, float("inf")).otherwise(F.col("bal") / 1e4)
    rows = c.select(F.col("segment").alias("cohort"), F.col("y_a").alias("y_true"),
                    bad.alias("score_raw"))
    return rounded(ranking.discrimination(rows, ["cohort"], range_rows=1000),
                   "prevalence", "auroc", "auprc")


def lineitem_auroc(spark, sf_dir):
    """One large cell: does the price rank returned lines?"""
    rows = fx.table(spark, sf_dir, "lineitem").select(
        F.col("l_linestatus").alias("cohort"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("y_true"),
        F.col("l_extendedprice").alias("score_raw"))
    out = ranking.discrimination(rows, ["cohort"])
    return rounded(out, "prevalence", "auroc", "auprc")


def outcome_counts(spark, sf_dir):
    return rounded(ranking.outcome_counts(fx.test_scores(spark, sf_dir), CELL), "prevalence")


def brier_logloss(spark, sf_dir):
    return rounded(ranking.losses(fx.test_scores(spark, sf_dir)), "brier", "log_loss")


def best_f1(spark, sf_dir):
    cum = ranking.cumulative(fx.test_scores(spark, sf_dir))
    return rounded(ranking.best_f1(cum), "f1", "threshold")


def topk_rules(spark, sf_dir):
    cuts = thresholds.topk_cuts(fx.test_scores(spark, sf_dir))
    return rounded(cuts.withColumn("slug", thresholds.slug(F.col("rule"))), "threshold")


def confusion(spark, sf_dir):
    pred = saved(fx.test_scores(spark, sf_dir))
    out = thresholds.apply_cuts(pred, thresholds.topk_cuts(pred))
    return rounded(out, "threshold", *RATE_METRICS)


def f1_val_transfer(spark, sf_dir):
    pred, val = saved_scores(spark, sf_dir)
    out = thresholds.apply_cuts(pred, thresholds.transferred(pred, thresholds.val_cuts(val)))
    return rounded(out, "threshold", *RATE_METRICS)


def f1_crossfit(spark, sf_dir):
    pred = saved(fx.test_scores(spark, sf_dir).where(F.col("cohort") == fx.INTERNAL))
    out = thresholds.crossfit(pred).drop("threshold")
    return rounded(out, "t_a", "t_b", *RATE_METRICS)


def operating_points(spark, sf_dir):
    out = thresholds.operating_points(*saved_scores(spark, sf_dir), fx.INTERNAL)
    return rounded(out, "threshold", *RATE_METRICS)


def points_null_cell(spark, sf_dir):
    """Operating points with cells whose cohort is NULL: the same points."""
    pred, val = saved_scores(spark, sf_dir)
    unnamed = pred.withColumn("cohort", F.nullif(F.col("cohort"), F.lit("ext")))
    out = thresholds.operating_points(unnamed, val, fx.INTERNAL)
    return rounded(out, "threshold", *RATE_METRICS)


def roc_curve(spark, sf_dir):
    return rounded(ranking.roc_curve(fx.test_scores(spark, sf_dir)), "fpr", "tpr")


def pr_curve(spark, sf_dir):
    return rounded(ranking.pr_curve(fx.test_scores(spark, sf_dir)), "recall", "precision")


def _rank_draws(pred):
    return bootstrap.rank_draws(bootstrap.draw_sums(pred, N_DRAWS))


def bootstrap_draws(spark, sf_dir):
    return rounded(_rank_draws(fx.test_scores(spark, sf_dir)), "auroc", "auprc")


def rank_intervals(spark, sf_dir):
    draws = _rank_draws(fx.test_scores(spark, sf_dir))
    out = bootstrap.intervals(bootstrap.long_draws(draws, CELL, ["auroc", "auprc"]),
                              [*CELL, "metric"])
    return rounded(out, "ci_lo", "ci_hi", "boot_std")


RULES = [f"top{k:g}%" for k in thresholds.TOP_K] + [thresholds.VAL_RULE, thresholds.CROSSFIT_RULE]


def _rule_sums(pred, learned):
    """Sums of all draws with the flags of all six rules, made once."""
    flagged = thresholds.flagged_rows(
        thresholds.with_halves(pred), learned.rules.select(*CELL, "rule", "threshold"), RULES,
        learned.cuts)
    return bootstrap.draw_sums(flagged, N_DRAWS, [f"f{i}" for i in range(len(RULES))])


def rule_intervals(spark, sf_dir):
    pred, val = saved_scores(spark, sf_dir)
    sums = _rule_sums(pred, thresholds.learn_rules(pred, val, fx.INTERNAL))
    draws = bootstrap.rule_draws(sums, RULES)
    long = bootstrap.long_draws(draws, [*CELL, "rule"], RATE_METRICS)
    return rounded(bootstrap.intervals(long, [*CELL, "rule", "metric"]),
                   "ci_lo", "ci_hi", "boot_std")


def paired_diff(spark, sf_dir):
    draws = pinned(_rank_draws(fx.test_scores(spark, sf_dir)))
    return rounded(bootstrap.paired_differences(draws, "m_noise"),
                   "ci_lo", "ci_hi", "boot_std", "mean_diff")


def summary(spark, sf_dir):
    pred, val = saved_scores(spark, sf_dir)
    learned = thresholds.learn_rules(pred, val, fx.INTERNAL)
    sums = pinned(_rule_sums(pred, learned))
    return report.tidy_summary(
        ranking.discrimination(pred),
        thresholds.operating_points(pred, val, fx.INTERNAL, learned=learned),
        bootstrap.rank_draws(sums), bootstrap.rule_draws(sums, RULES))


def rank_summary(spark, sf_dir):
    """The ranking rows of the summary alone: what the report tables read."""
    pred = saved(fx.test_scores(spark, sf_dir))
    areas = ranking.discrimination(pred).unpivot(
        [*CELL, "n_rows", "n_pos", "prevalence"], ["auroc", "auprc"], "metric", "value")
    draws = bootstrap.long_draws(_rank_draws(pred), CELL, ["auroc", "auprc"])
    return areas.withColumn("kind", F.lit("ranking")).join(
        bootstrap.intervals(draws, [*CELL, "metric"]), [*CELL, "metric"])


def summary_tidy(spark, sf_dir):
    out = report.sorted_summary(summary(spark, sf_dir))
    return rounded(out, "prevalence", "value", "ci_lo", "ci_hi", "boot_std", "threshold")


def summary_wide(spark, sf_dir):
    out = report.wide_ranking(rank_summary(spark, sf_dir))
    return rounded(out, "auroc", "auprc", *[f"{m}_ci_{e}" for m in ("auroc", "auprc")
                                            for e in ("lo", "hi")])


def panel(spark, sf_dir):
    return report.panel(report.ranking_cells(rank_summary(spark, sf_dir)), fx.LABELS)


def counts_line(spark, sf_dir):
    counts = ranking.outcome_counts(
        fx.test_scores(spark, sf_dir).where(F.col("model") == fx.MODELS[0]), ["cohort", "label"])
    return report.event_counts(counts)


def _two_arms(spark, sf_dir):
    s = rank_summary(spark, sf_dir)
    tied = F.col("model") == "m_tied"
    return report.merged_arms({"tabular": s.where(~tied), "text": s.where(tied), "none": None})


def merged_arms(spark, sf_dir):
    cells = report.ranking_cells(_two_arms(spark, sf_dir), on_print=False, dash="–")
    return cells.select(*CELL, "metric", "arm", "text", "best")


def _published(spark, sf_dir):
    """A published probability, scored like a model: read wide, one column per outcome."""
    c = fx.cases(spark, sf_dir).where((F.col("split") == "test") & F.col("lab_late").isNotNull())
    return c.select("cohort", "row_id", (F.col("lab_late") / 300.0).alias("prob_a"), "y_a")


def published_score_eval(spark, sf_dir):
    rows = published_scores(_published(spark, sf_dir), {"y_a": "prob_a"}, "published")
    out = ranking.discrimination(rows).join(ranking.losses(rows), CELL)
    return rounded(out, "prevalence", "auroc", "auprc", "brier", "log_loss")


def _reference_summary(spark, sf_dir):
    rows = published_scores(_published(spark, sf_dir), {"y_a": "prob_a"}, "published")
    areas = ranking.discrimination(rows).unpivot(
        CELL, ["auroc", "auprc"], "metric", "value")
    draws = bootstrap.long_draws(_rank_draws(rows), CELL, ["auroc", "auprc"])
    return areas.join(bootstrap.intervals(draws, [*CELL, "metric"]), [*CELL, "metric"])


def reference_row(spark, sf_dir):
    cells = report.ranking_cells(rank_summary(spark, sf_dir))
    return report.reference_rows(cells, _reference_summary(spark, sf_dir), fx.INTERNAL,
                                 fx.LABELS, "published")


def axis_range(spark, sf_dir):
    ref = _reference_summary(spark, sf_dir).where(F.col("cohort") == fx.INTERNAL)
    return rounded(report.axis_ranges(rank_summary(spark, sf_dir), ref), "lo", "hi")


# --- SQL side -----------------------------------------------------------------

KEYS = "cohort, model, label"


def areas_sql(keys=KEYS, cum="cum"):
    return f"""SELECT {keys}, (max(pos) + max(neg))::BIGINT AS n_rows, max(pos) AS n_pos,
  max(neg) AS n_neg, max(pos / (pos + neg)) AS prevalence,
  CASE WHEN max(pos) > 0 AND max(neg) > 0
    THEN sum(n * (tp - p / 2)) / (max(pos)::DOUBLE * max(neg)) END AS auroc,
  CASE WHEN max(pos) > 0 AND max(neg) > 0 THEN sum(p / pos * (tp / (tp + fp))) END AS auprc
FROM {cum} GROUP BY {keys}"""


AREAS_OUT = ("n_rows, n_pos, n_neg, round(prevalence, 6) AS prevalence,"
             " round(auroc, 6) AS auroc, round(auprc, 6) AS auprc")

BEST_SQL = """(SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY {keys}
  ORDER BY 2 * tp / (tp + fp + pos) DESC, score) AS rn FROM {cum}) WHERE rn = 1)"""


def best_sql(keys=KEYS, cum="cum"):
    return BEST_SQL.format(keys=keys, cum=cum)


TOPK_SQL = "\nUNION ALL ".join(
    f"SELECT {KEYS}, 'top{k:g}%' AS rule, 'topk' AS kind,"
    f" quantile_cont(score_raw, {(100 - k) / 100}::DOUBLE) AS threshold FROM pred GROUP BY {KEYS}"
    for k in thresholds.TOP_K)

VALCUT_SQL = f"""{fx.cum_sql("val", "model, label", "vcum")},
valcut AS (SELECT model, label, score AS threshold FROM {best_sql("model, label", "vcum")}),
valrule AS (SELECT c.cohort, model, label, '{thresholds.VAL_RULE}' AS rule, 'f1_val' AS kind,
  threshold FROM (SELECT DISTINCT {KEYS} FROM pred) c JOIN valcut USING (model, label))"""

RATES_SQL = """tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, tn::BIGINT AS tn,
  (tp + fp)::BIGINT AS n_flagged,
  round(tp / greatest(tp + fn, 1), 6) AS sensitivity,
  round(tn / greatest(tn + fp, 1), 6) AS specificity,
  round(tp / greatest(tp + fp, 1), 6) AS ppv, round(tn / greatest(tn + fn, 1), 6) AS npv,
  round(2 * tp / greatest(2 * tp + fp + fn, 1), 6) AS f1,
  round(100.0::DOUBLE * ((tp + fp) / greatest(tp + fp + fn + tn, 1)), 6) AS flagged_pct"""

CONF_SQL = """count(*) FILTER (flag AND y_true = 1) AS tp,
  count(*) FILTER (flag AND y_true = 0) AS fp, count(*) FILTER (NOT flag AND y_true = 1) AS fn,
  count(*) FILTER (NOT flag AND y_true = 0) AS tn"""


def conf_sql(rules):
    return f"""(SELECT {KEYS}, rule, kind, threshold, {CONF_SQL}
  FROM (SELECT p.*, r.rule, r.kind, r.threshold, score_raw >= threshold AS flag
        FROM pred p JOIN {rules} r USING ({KEYS})) GROUP BY ALL)"""


SEED_SQL = "CASE label " + " ".join(
    f"WHEN '{x}' THEN {hashing.label_seed(x)}" for x in fx.LABELS) + " END"

CROSS_SQL = f"""
halved AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY {KEYS}
    ORDER BY md5(({SEED_SQL})::VARCHAR || ':' || row_id))
    <= count(*) OVER (PARTITION BY {KEYS}) // 2 THEN 'A' ELSE 'B' END AS half
  FROM pred WHERE cohort = 'main'),
{fx.cum_sql("halved", KEYS + ", half", "hcum")},
halfcut AS (SELECT {KEYS}, CASE half WHEN 'A' THEN 'B' ELSE 'A' END AS half, score AS cut
  FROM {best_sql(KEYS + ", half", "hcum")}),
crossed AS (SELECT {KEYS}, {CONF_SQL}, max(CASE half WHEN 'B' THEN cut END) AS t_a,
    max(CASE half WHEN 'A' THEN cut END) AS t_b
  FROM (SELECT h.*, cut, score_raw >= cut AS flag FROM halved h
        JOIN halfcut USING ({KEYS}, half)) GROUP BY {KEYS})"""


def _even(m, k=2000):
    """Whether idx is one of the k truncated evenly spaced positions."""
    return (f"({m} <= {k} OR idx = {m} - 1 OR idx IN (SELECT floor(i * (({m} - 1) / {k - 1}.0::DOUBLE))"
            f" FROM generate_series(0, {k - 2}) t(i)))")


ROC_SQL = f"""WITH {fx.PRED_SQL}, {fx.cum_sql()},
steps AS (SELECT *, lead(p) OVER w AS np, lead(n) OVER w AS nn,
  row_number() OVER w AS pos_in FROM cum WINDOW w AS (PARTITION BY {KEYS} ORDER BY score DESC)),
kept AS (SELECT {KEYS}, score, fp / nullif(neg, 0) AS fpr, tp / nullif(pos, 0) AS tpr FROM steps
  WHERE pos_in = 1 OR np IS NULL OR np <> p OR nn <> n),
pts AS (SELECT {KEYS}, row_number() OVER (PARTITION BY {KEYS} ORDER BY score DESC) AS idx, fpr, tpr
  FROM kept UNION ALL SELECT DISTINCT {KEYS}, 0, 0.0::DOUBLE, 0.0::DOUBLE FROM kept),
sized AS (SELECT *, count(*) OVER (PARTITION BY {KEYS}) AS m FROM pts)
SELECT {KEYS}, idx, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr FROM sized
WHERE {_even("m")}"""

PR_SQL = f"""WITH {fx.PRED_SQL}, {fx.cum_sql()},
pts AS (SELECT {KEYS}, row_number() OVER (PARTITION BY {KEYS} ORDER BY score) - 1 AS idx,
  CASE WHEN pos > 0 THEN tp / pos ELSE 1.0 END AS recall, tp / (tp + fp) AS "precision" FROM cum
  UNION ALL SELECT {KEYS}, count(*), 0.0::DOUBLE, 1.0::DOUBLE FROM cum GROUP BY {KEYS}),
sized AS (SELECT *, count(*) OVER (PARTITION BY {KEYS}) AS m FROM pts)
SELECT {KEYS}, idx, round(recall, 6) AS recall, round("precision", 6) AS "precision" FROM sized
WHERE {_even("m")}"""


def _scramble_sql(src, x, out):
    """Stages of the hash as nested selects, so no term is written out twice."""
    p, a, b = hashing.PRIME, hashing.MIX_A, hashing.MIX_B
    one = f"(SELECT *, (xor({x}, {x} >> 15) * {a}) % {p} AS s1 FROM {src})"
    two = f"(SELECT *, (xor(s1, s1 >> 13) * {b}) % {p} AS s2 FROM {one})"
    return f"(SELECT * EXCLUDE ({x}, s1, s2), xor(s2, s2 >> 16) AS {out} FROM {two})"


def weights_sql(src="pred", n_draws=N_DRAWS):
    """Rows of ``src`` x draws with their weight w."""
    p = hashing.PRIME
    cur = src
    for lane, (k1, k2, k3) in enumerate(hashing.LANES):
        cur = (f"(SELECT *, ((row_id & {p}) * {k1} + ((row_id >> 31) & {p}) * {k2} + {k3}) % {p}"
               f" AS x FROM {cur})")
        cur = _scramble_sql(cur, "x", f"lane{lane}")
    cur = (f"(SELECT r.*, draw, (lane0 * ((draw * {hashing.MIX_C} + 1) * {hashing.MIX_C} % {p})"
           f" + lane1) % {p} AS x FROM {cur} r, (SELECT i::BIGINT AS draw"
           f" FROM generate_series(0, {n_draws - 1}) t(i)))")
    cur = _scramble_sql(cur, "x", "h")
    cuts = hashing.poisson_cuts()
    case = " ".join(f"WHEN h < {c} THEN {k}" for k, c in enumerate(cuts))
    return f"(SELECT * EXCLUDE (lane0, lane1, h), CASE {case} ELSE {len(cuts)} END AS w FROM {cur})"


def draws_sql(src="pred", out="draws"):
    k = KEYS + ", draw"
    return f"""
{out}_w AS (SELECT {k}, score_raw AS score, sum(w * y_true)::BIGINT AS p,
  sum(w * (1 - y_true))::BIGINT AS n FROM {weights_sql(src)} GROUP BY ALL),
{out}_c AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS fp,
  sum(p) OVER (PARTITION BY {k}) AS pos, sum(n) OVER (PARTITION BY {k}) AS neg
  FROM {out}_w WINDOW w AS (PARTITION BY {k} ORDER BY score DESC)),
{out} AS (SELECT {KEYS}, draw,
  CASE WHEN max(pos) > 0 AND max(neg) > 0
    THEN sum(n * (tp - p / 2)) / (max(pos)::DOUBLE * max(neg)::DOUBLE) END AS auroc,
  CASE WHEN max(pos) > 0 AND max(neg) > 0
    THEN sum(CASE WHEN p > 0 THEN p * (tp / (tp + fp)) END) / max(pos)::DOUBLE END AS auprc
  FROM {out}_c GROUP BY ALL)"""


def intervals_sql(src, keys):
    return f"""(SELECT {keys},
  CASE WHEN count(value) >= 2 THEN quantile_cont(value, 0.025) END AS ci_lo,
  CASE WHEN count(value) >= 2 THEN quantile_cont(value, 0.975) END AS ci_hi,
  CASE WHEN count(value) >= 2 THEN stddev_samp(value) END AS boot_std,
  count(value)::BIGINT AS n_boot_valid FROM {src} GROUP BY {keys})"""


CI_OUT = "round(ci_lo, 6) AS ci_lo, round(ci_hi, 6) AS ci_hi, round(boot_std, 6) AS boot_std"


def long_sql(src="draws"):
    return f"""(SELECT {KEYS}, draw, 'auroc' AS metric, auroc AS value FROM {src}
  UNION ALL SELECT {KEYS}, draw, 'auprc', auprc FROM {src})"""


RANK_SQL = f"""{fx.PRED_SQL}, {fx.cum_sql()}, areas AS ({areas_sql()}), {draws_sql()},
rank_ci AS (SELECT * FROM {intervals_sql(long_sql(), KEYS + ", metric")}),
rank_summary AS (SELECT {KEYS}, metric, n_rows, n_pos, prevalence,
  CASE metric WHEN 'auroc' THEN auroc ELSE auprc END AS value, ci_lo, ci_hi, boot_std,
  n_boot_valid FROM areas JOIN rank_ci USING ({KEYS}))"""

RULES_SQL = f"""{fx.VAL_SQL}, {VALCUT_SQL}, {CROSS_SQL}, topk AS ({TOPK_SQL}),
fixed AS (SELECT * FROM topk UNION ALL SELECT * FROM valrule)"""

POINTS_SQL = f"""SELECT {KEYS}, rule, kind, round(threshold, 6) AS threshold, {RATES_SQL},
  CASE kind {" ".join(f"WHEN '{k}' THEN '{s}'" for k, s in thresholds.SOURCES.items())} END
  AS threshold_source
FROM (SELECT * FROM {conf_sql("fixed")} UNION ALL
  SELECT {KEYS}, '{thresholds.CROSSFIT_RULE}', 'f1_crossfit', NULL, tp, fp, fn, tn FROM crossed)"""

_RATE_EXPR = {
    "sensitivity": "tp / greatest(tp + fn, 1)", "specificity": "tn / greatest(tn + fp, 1)",
    "ppv": "tp / greatest(tp + fp, 1)", "npv": "tn / greatest(tn + fn, 1)",
    "f1": "2 * tp / greatest(2 * tp + fp + fn, 1)",
    "flagged_pct": "100.0::DOUBLE * ((tp + fp) / greatest(tp + fp + fn + tn, 1))"}

RULE_DRAWS_SQL = f"""
flagrows AS (SELECT p.*, rule, score_raw >= threshold AS flag FROM pred p
    JOIN fixed USING ({KEYS})
  UNION ALL SELECT h.* EXCLUDE (half), '{thresholds.CROSSFIT_RULE}', score_raw >= cut
    FROM halved h JOIN halfcut USING ({KEYS}, half)),
rw AS (SELECT {KEYS}, rule, draw, sum(CASE WHEN flag AND y_true = 1 THEN w ELSE 0 END) AS tp,
  sum(CASE WHEN flag AND y_true = 0 THEN w ELSE 0 END) AS fp,
  sum(CASE WHEN NOT flag AND y_true = 1 THEN w ELSE 0 END) AS fn,
  sum(CASE WHEN NOT flag AND y_true = 0 THEN w ELSE 0 END) AS tn
  FROM {weights_sql("flagrows")} GROUP BY ALL),
rlong AS ({" UNION ALL ".join(
    f"SELECT {KEYS}, rule, '{m}' AS metric, CASE WHEN tp + fn > 0 AND fp + tn > 0 THEN {e} END"
    f" AS value FROM rw" for m, e in _RATE_EXPR.items())}),
rule_ci AS (SELECT * FROM {intervals_sql("rlong", KEYS + ", rule, metric")})"""

SUMMARY_SQL = f"""WITH {RULES_SQL}, {RULE_DRAWS_SQL}, {fx.cum_sql()}, areas AS ({areas_sql()}),
{draws_sql()}, rank_ci AS (SELECT * FROM {intervals_sql(long_sql(), KEYS + ", metric")}),
points AS ({POINTS_SQL})
SELECT {KEYS}, n_rows, n_pos, round(prevalence, 6) AS prevalence, 'ranking' AS kind,
  'ranking' AS rule, metric, round(CASE metric WHEN 'auroc' THEN auroc ELSE auprc END, 6) AS value,
  {CI_OUT}, n_boot_valid, NULL::DOUBLE AS threshold, 'none (rank metric)' AS threshold_source,
  NULL::BIGINT AS tp, NULL::BIGINT AS fp, NULL::BIGINT AS fn, NULL::BIGINT AS tn,
  NULL::BIGINT AS n_flagged
FROM areas JOIN rank_ci USING ({KEYS})
UNION ALL BY NAME
SELECT {KEYS}, n_rows, n_pos, round(prevalence, 6) AS prevalence, kind, rule, metric,
  CASE metric {" ".join(f"WHEN '{m}' THEN {m}" for m in RATE_METRICS)} END AS value,
  {CI_OUT}, n_boot_valid, threshold, threshold_source, tp, fp, fn, tn, n_flagged
FROM points JOIN rule_ci USING ({KEYS}, rule) JOIN areas USING ({KEYS})"""

PUBLISHED_SQL = """
published AS (SELECT cohort, 'published' AS model, 'y_a' AS label, row_id, y_a AS y_true,
  lab_late / 300.0::DOUBLE AS score_raw FROM cases
  WHERE split = 'test' AND lab_late IS NOT NULL)"""

REFERENCE_SQL = f"""{RANK_SQL}, {PUBLISHED_SQL}, {fx.cum_sql("published", KEYS, "pcum")},
pareas AS ({areas_sql(cum="pcum")}), {draws_sql("published", "pdraws")},
pci AS (SELECT * FROM {intervals_sql(long_sql("pdraws"), KEYS + ", metric")}),
reference AS (SELECT {KEYS}, metric, CASE metric WHEN 'auroc' THEN auroc ELSE auprc END AS value,
  ci_lo, ci_hi FROM pareas JOIN pci USING ({KEYS}))"""


def text_sql(dash="-"):
    return f"printf('%.3f (%.3f{dash}%.3f)', value, ci_lo, ci_hi)"


CELLS_SQL = f"""cells AS (SELECT *, {text_sql()} AS txt,
  round(value, 3) >= round(max(value) OVER (PARTITION BY cohort, label, metric), 3) AS best
  FROM rank_summary)"""


def pivot_sql(src, where="TRUE"):
    shown = "CASE WHEN best THEN '**' || txt || '**' ELSE txt END"
    cols = ", ".join(f"coalesce(max(CASE label WHEN '{x}' THEN {shown} END), '—') AS {x}"
                     for x in fx.LABELS)
    return f"SELECT cohort, metric, model, {cols} FROM {src} WHERE {where} GROUP BY ALL"


QUERIES = {f.__name__: f for f in (
    auroc_ap, auroc_missing, lineitem_auroc, outcome_counts, brier_logloss, best_f1, topk_rules, confusion,
    f1_val_transfer, f1_crossfit, operating_points, points_null_cell, roc_curve, pr_curve, bootstrap_draws,
    rank_intervals, rule_intervals, paired_diff, summary_tidy, summary_wide, panel, counts_line,
    merged_arms, published_score_eval, reference_row, axis_range)}

ORACLE = {
    "auroc_ap": f"WITH {fx.PRED_SQL}, {fx.cum_sql()}, areas AS ({areas_sql()})"
                f" SELECT {KEYS}, {AREAS_OUT} FROM areas",
    "lineitem_auroc": f"""WITH pred AS (SELECT l_linestatus AS cohort,
  CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y_true, l_extendedprice AS score_raw
  FROM lineitem), {fx.cum_sql("pred", "cohort")}, areas AS ({areas_sql("cohort")})
SELECT cohort, {AREAS_OUT} FROM areas""",
    "auroc_missing": f"""WITH {fx.CASES_SQL}, pred AS (SELECT segment AS cohort, y_a AS y_true,
  CASE WHEN bal IS NULL OR bal < -900 THEN '-infinity'::DOUBLE WHEN bal > 9900
       THEN 'infinity'::DOUBLE ELSE bal / 10000.0::DOUBLE END AS score_raw
  FROM cases WHERE split = 'test'), {fx.cum_sql("pred", "cohort")}, areas AS ({areas_sql("cohort")})
SELECT cohort, {AREAS_OUT} FROM areas""",
    "outcome_counts": f"""WITH {fx.PRED_SQL} SELECT {KEYS}, count(*) AS n_rows,
  sum(y_true)::BIGINT AS n_pos, sum(1 - y_true)::BIGINT AS n_neg,
  round(avg(y_true), 6) AS prevalence FROM pred GROUP BY ALL""",
    "brier_logloss": f"""WITH {fx.PRED_SQL}, c AS (SELECT *,
  greatest(least(score_raw, 1 - 1e-7::DOUBLE), 1e-7::DOUBLE) AS s FROM pred)
SELECT {KEYS}, round(avg(pow(s - y_true, 2)), 6) AS brier,
  round(-avg(y_true * ln(s) + (1 - y_true) * ln(1 - s)), 6) AS log_loss FROM c GROUP BY ALL""",
    "best_f1": f"""WITH {fx.PRED_SQL}, {fx.cum_sql()}
SELECT {KEYS}, round(2 * tp / (tp + fp + pos), 6) AS f1, round(score, 6) AS threshold
FROM {best_sql()}""",
    "topk_rules": f"""WITH {fx.PRED_SQL}, topk AS ({TOPK_SQL})
SELECT {KEYS}, rule, kind, round(threshold, 6) AS threshold,
  trim(regexp_replace(lower(rule), '[^0-9a-z]+', '_', 'g'), '_') AS slug FROM topk""",
    "confusion": f"""WITH {fx.PRED_SQL}, topk AS ({TOPK_SQL})
SELECT {KEYS}, rule, kind, round(threshold, 6) AS threshold, {RATES_SQL}
FROM {conf_sql("topk")}""",
    "f1_val_transfer": f"""WITH {fx.VAL_SQL}, {VALCUT_SQL}
SELECT {KEYS}, rule, kind, round(threshold, 6) AS threshold, {RATES_SQL}
FROM {conf_sql("valrule")}""",
    "f1_crossfit": f"""WITH {fx.PRED_SQL}, {CROSS_SQL}
SELECT {KEYS}, {RATES_SQL}, round(t_a, 6) AS t_a, round(t_b, 6) AS t_b,
  '{thresholds.CROSSFIT_RULE}' AS rule, 'f1_crossfit' AS kind FROM crossed""",
    "operating_points": f"WITH {RULES_SQL} {POINTS_SQL}",
    "points_null_cell": "SELECT * REPLACE (nullif(cohort, 'ext') AS cohort) FROM"
                        f" (WITH {RULES_SQL} {POINTS_SQL})",
    "roc_curve": ROC_SQL,
    "pr_curve": PR_SQL,
    "bootstrap_draws": f"""WITH {fx.PRED_SQL}, {draws_sql()}
SELECT {KEYS}, draw, round(auroc, 6) AS auroc, round(auprc, 6) AS auprc FROM draws""",
    "rank_intervals": f"""WITH {fx.PRED_SQL}, {draws_sql()}
SELECT {KEYS}, metric, {CI_OUT}, n_boot_valid
FROM {intervals_sql(long_sql(), KEYS + ", metric")}""",
    "rule_intervals": f"""WITH {RULES_SQL}, {RULE_DRAWS_SQL}
SELECT {KEYS}, rule, metric, {CI_OUT}, n_boot_valid FROM rule_ci""",
    "paired_diff": f"""WITH {fx.PRED_SQL}, {draws_sql()}, diff AS (
SELECT a.cohort, a.model, a.label, draw, a.auroc - b.auroc AS auroc, a.auprc - b.auprc AS auprc
FROM draws a JOIN draws b USING (cohort, label, draw)
WHERE a.model <> 'm_noise' AND b.model = 'm_noise'), dl AS (SELECT * FROM {long_sql("diff")})
SELECT {KEYS}, metric, {CI_OUT}, n_boot_valid, round(mean_diff, 6) AS mean_diff
FROM {intervals_sql("dl", KEYS + ", metric")}
JOIN (SELECT {KEYS}, metric, avg(value) AS mean_diff FROM dl GROUP BY ALL)
USING ({KEYS}, metric)""",
    "summary_tidy": SUMMARY_SQL,
    "summary_wide": f"""WITH {RANK_SQL} SELECT {KEYS}, n_rows, n_pos, """ + ", ".join(
        f"round(max(CASE metric WHEN '{m}' THEN {v} END), 6) AS {m}{s}"
        for m in ("auroc", "auprc")
        for v, s in (("value", ""), ("ci_lo", "_ci_lo"), ("ci_hi", "_ci_hi")))
    + " FROM rank_summary GROUP BY ALL",
    "panel": f"WITH {RANK_SQL}, {CELLS_SQL} {pivot_sql('cells')}",
    "counts_line": f"""WITH {fx.PRED_SQL} SELECT cohort, label, sum(y_true)::BIGINT AS n_pos,
  printf('%s %d (%.1f%%)', label, sum(y_true)::BIGINT, avg(y_true) * 100) AS text
FROM pred WHERE model = 'm_signal' GROUP BY cohort, label""",
    "merged_arms": f"""WITH {RANK_SQL}
SELECT {KEYS}, metric, CASE WHEN model = 'm_tied' THEN 'text' ELSE 'tabular' END AS arm,
  {text_sql("–")} AS text,
  abs(value - max(value) OVER (PARTITION BY cohort, label, metric)) < 5e-7 AS best
FROM rank_summary WHERE value IS NOT NULL""",
    "published_score_eval": f"""WITH {fx.CASES_SQL}, {PUBLISHED_SQL},
{fx.cum_sql("published")}, areas AS ({areas_sql()}),
c AS (SELECT *, greatest(least(score_raw, 1 - 1e-7::DOUBLE), 1e-7::DOUBLE) AS s FROM published),
l AS (SELECT {KEYS}, avg(pow(s - y_true, 2)) AS brier,
  -avg(y_true * ln(s) + (1 - y_true) * ln(1 - s)) AS log_loss FROM c GROUP BY ALL)
SELECT {KEYS}, {AREAS_OUT}, round(brier, 6) AS brier, round(log_loss, 6) AS log_loss
FROM areas JOIN l USING ({KEYS})""",
    "reference_row": f"""WITH {REFERENCE_SQL}, {CELLS_SQL},
refcells AS (SELECT *, {text_sql()} AS txt, FALSE AS best FROM reference)
SELECT *, 0 AS position FROM ({pivot_sql("cells", "cohort = 'main'")})
UNION ALL SELECT *, 1 FROM ({pivot_sql("refcells", "cohort = 'main'")})""",
    "axis_range": f"""WITH {REFERENCE_SQL}, r AS (
SELECT label, ci_lo, ci_hi FROM rank_summary WHERE metric = 'auroc' UNION ALL
SELECT label, value, value FROM reference WHERE metric = 'auroc' AND cohort = 'main'),
s AS (SELECT label, min(ci_lo) AS lo, max(ci_hi) AS hi FROM r GROUP BY label)
SELECT label, round(lo - (hi - lo) * 0.06::DOUBLE, 6) AS lo,
  round(hi + (hi - lo) * 0.06::DOUBLE, 6) AS hi FROM s""",
}

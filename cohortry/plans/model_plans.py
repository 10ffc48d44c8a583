"""Queries that fit MLlib models and score held-out rows.

Fits on many columns have no SQL form. The same fitting, saving and scoring code is checked
against SQL where a model has a closed form: Newton steps for a logistic regression on one
column, weighted shares and residual means for trees of one split.
"""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from cohortry.operators import boosting, forest, prep, ranking, thresholds, training
from cohortry.operators import vectors as v
from cohortry.operators.training import Cell
from cohortry.plans import fixtures as fx
from cohortry.plans import harmonize_plans as hp
from cohortry.plans import prep_plans as pp
from cohortry.plans import ranking_plans as rp
from cohortry.session import pinned, work_path
from cohortry.sources import sinks
from cohortry.streaming.apply import case_stream, read_scores, score_stream

COLUMNS = ["bal", "lab_raw", "lab_late", "segment", "casetype", "emergency", "elective",
           "proc_text"]
KEEP = ["cohort", "row_id"]


def _scored(spark, sf_dir, model, label="y_b", **params):
    train, test = pp.train_rows(spark, sf_dir), pp.test_rows(spark, sf_dir)
    cell = training.train_cell(train, model, label, COLUMNS, **params)
    return training.inference_summary(cell.score(test, KEEP))


def lr_fit_score(spark, sf_dir):
    """Fit on the internal development years, score later years of both cohorts."""
    return _scored(spark, sf_dir, "logistic_regression")


def rf_fit_score(spark, sf_dir):
    return _scored(spark, sf_dir, "random_forest", numTrees=20, maxDepth=6)


def gbt_fit_score(spark, sf_dir):
    return _scored(spark, sf_dir, "boosted_trees", maxIter=12, maxDepth=3, min_iterations=0)


def shared_view_scores(spark, sf_dir):
    """Two cells that share one fitted state and its vectors; what the grid still lacks."""
    train, test = pp.train_rows(spark, sf_dir), pp.test_rows(spark, sf_dir)
    first = training.train_cell(train, "logistic_regression", "y_b", COLUMNS)
    second = training.train_cell(train, "logistic_regression", "y_a", COLUMNS,
                                 state=first.state)
    pred = pinned(training.score_cells([first, second], test, KEEP))
    open_cells = training.unfinished(["logistic_regression", "random_forest"], fx.LABELS, pred)
    areas = ranking.discrimination(pred)
    return areas.unionByName(open_cells.withColumn("cohort", F.lit("not trained")),
                             allowMissingColumns=True)


def probe_fit_score(spark, sf_dir):
    """A linear probe on standardised pooled vectors: fitted, with the scaler, on four fifths
    of the rows, scored on the rest."""
    rows = fx.chunk_vectors(spark, sf_dir)
    y = rows.groupBy("row_id").agg(F.max(F.when(F.col("klass") == 0, 1).otherwise(0)).alias("y_true"))
    pooled = pinned(v.pool_chunks(rows))
    held = F.col("row_id") % 5 == 0
    scaler = v.fit_scaler(pooled.where(~held))
    x = v.apply_scaler(pooled, scaler).join(y, "row_id")
    x = pinned(x.withColumn("features", v.array_to_vector("vec")).drop("vec"))
    model = training.probe(training.laid_out(x.where(~held), "row_id"))
    return training.positive_score(model, x.where(held), ["row_id", "y_true"])


def _saved_cell(spark, sf_dir):
    path = work_path(spark, "cell")
    cell = training.train_cell(pp.train_rows(spark, sf_dir), "logistic_regression", "y_a", ["bal"],
                               tol=1e-12)
    cell.save(path)
    return path


def frozen_score(spark, sf_dir):
    """A cell fitted on the development years, saved, loaded in another session and applied to
    the external cohort."""
    path = _saved_cell(spark, sf_dir)
    other = spark.newSession()
    external = pp.test_rows(other, sf_dir).where("cohort = 'ext'")
    out = Cell.load(other, path).score(external, KEEP)
    return out.withColumn("score_raw", F.round("score_raw", 5))


def stream_score(spark, sf_dir):
    """The external cohort arrives in files and is scored by a saved cell; the stream is stopped,
    more files arrive, and it goes on from its checkpoint."""
    cell = Cell.load(spark, _saved_cell(spark, sf_dir))
    folder, sink, at = (work_path(spark, n) for n in ("arriving", "scores", "stream-checkpoint"))
    cases = pp.test_rows(spark, sf_dir).where("cohort = 'ext'")
    source = None
    for part in (0, 1):
        cases.where(F.col("row_id") % 2 == part).repartition(2, "row_id").write.mode("append").parquet(
            folder)
        source = source or case_stream(spark, folder, spark.read.parquet(folder).schema, files_per_batch=1)
        score_stream(source, cell, sink, at).awaitTermination()
    return read_scores(spark, sink).withColumn("score_raw", F.round("score_raw", 5))


def _stump_rows(spark, sf_dir):
    """(row_id, y_true, features) with one 0/1 feature, and the held-out rows."""
    marked = F.when(F.col("lab_raw") > 150, 1.0).otherwise(0.0)
    def rows(df):
        return training.assemble(df.select("row_id", F.col("y_a").alias("y_true"), marked.alias("x")),
                                 ["x"], ["row_id", "y_true"])
    return (training.laid_out(rows(pp.train_rows(spark, sf_dir)), "row_id"),
            rows(pp.test_rows(spark, sf_dir)))


def rf_stump(spark, sf_dir):
    """A forest of one tree with one split, without resampling: its leaves are weighted shares."""
    train, test = _stump_rows(spark, sf_dir)
    model = training.random_forest(train, numTrees=1, maxDepth=1, bootstrap=False,
                                   featureSubsetStrategy="all", minInstancesPerNode=1)
    out = training.positive_score(model, test, ["row_id", "y_true"])
    return out.withColumn("score_raw", F.round("score_raw", 6))


def gbt_stages(spark, sf_dir):
    """Boosted trees of one split: the scores after one, two and three trees."""
    train, test = _stump_rows(spark, sf_dir)
    model, _ = training.boosted_trees(train, train, min_iterations=0, maxIter=3, maxDepth=1,
                                      stepSize=0.5, subsamplingRate=1.0,
                                      featureSubsetStrategy="all")
    out = training.stage_scores(model, test, ["row_id"])
    return out.withColumn("score_raw", F.round("score_raw", 6))


def gbt_early_stop(spark, sf_dir):
    """Boosting as prespecified, but for trees of one split on one 0/1 feature: no stage after
    the first ranks better, so fitting ends after the patience, far from the trees asked for, and
    the model is refused. The margins of all stages that were fitted."""
    train, _ = _stump_rows(spark, sf_dir)
    asked = {**training.GBT_PARAMS, "maxDepth": 1, "subsamplingRate": 1.0,
             "featureSubsetStrategy": "all"}
    model, values = boosting.fit(training.with_class_weight(train, balanced=False), train,
                                 seed=1, patience=training.PATIENCE, **asked)
    refused = training.best_stage(values, training.PATIENCE) < training.MIN_ITERATIONS
    x = vector_to_array("features")[0].cast("int")
    each = train.select(x.alias("x"), "features").dropDuplicates(["x"])
    return training.stage_scores(model, each, ["x"]).select(
        "x", "stage", F.round("score_raw", 5).alias("score_raw"),
        F.lit(asked["maxIter"]).alias("n_asked"), F.lit(refused).alias("refused"))


def native_split(spark, sf_dir):
    """One boosted tree of one split on a category: its left side is the best set of levels, with
    a missing level as one of them."""
    def rows(df, state):
        return training.design(state, df, ["row_id", "y_b"]).withColumnRenamed("y_b", "y_true")
    train, test = pp.train_rows(spark, sf_dir), pp.test_rows(spark, sf_dir)
    state = prep.fit("tree", train, ["segment"])
    x = training.laid_out(rows(train, state), "row_id")
    model, _ = training.boosted_trees(x, x, min_iterations=0, maxIter=1, maxDepth=1,
                                      subsamplingRate=1.0, featureSubsetStrategy="all")
    out = training.stage_scores(model, rows(test, state), ["row_id"])
    return out.select("row_id", F.round("score_raw", 6).alias("score_raw"))


def forest_balance(spark, sf_dir):
    """Rows drawn and class weights of every tree of a forest."""
    rows = pp.train_rows(spark, sf_dir).select("row_id", F.col("y_a").alias("y_true"))
    return forest.tree_weights(rows, 12).withColumn("weight", F.round("weight", 6))


def trained_transfer(spark, sf_dir):
    """A grid run over two cells; a second run finds nothing left. The threshold learned on
    the written validation predictions is applied to the written test predictions."""
    path = work_path(spark, "grid")
    train, test = pp.train_rows(spark, sf_dir), pp.test_rows(spark, sf_dir)
    grid = (train, test, ["logistic_regression"], fx.LABELS, ["bal", "lab_raw"], path)
    first, again = training.run_grid(*grid), training.run_grid(*grid)
    val, pred = (sinks.read_cells(spark, f"{path}/{part}") for part in ("val", "test"))
    out = thresholds.apply_cuts(pred, thresholds.transferred(pred, thresholds.val_cuts(val)))
    return out.withColumns({"n_trained": F.lit(len(first)), "n_again": F.lit(len(again))})


QUERIES = {f.__name__: f for f in (
    lr_fit_score, rf_fit_score, gbt_fit_score, shared_view_scores, probe_fit_score, frozen_score,
    rf_stump, gbt_stages, trained_transfer, stream_score, gbt_early_stop, native_split,
    forest_balance)}

_NEWTON_SQL = f"""
WITH RECURSIVE {pp.CLEAN_SQL},
pool AS (SELECT row_id, y_a, y_b FROM train), {hp._split_sql("y_a", "s")},
fit AS (SELECT t.row_id, t.bal, t.y_a AS y FROM train t JOIN s USING (row_id) WHERE s.split = 'fit'),
med AS (SELECT coalesce(median(bal), 0.0::DOUBLE) AS m FROM fit),
mom AS (SELECT m, avg(coalesce(bal, m)) AS mu, stddev_samp(coalesce(bal, m)) AS sd
  FROM fit, med GROUP BY m),
wts AS (SELECT count(*) / (2.0::DOUBLE * sum(y)) AS w1, count(*) / (2.0::DOUBLE * sum(1 - y)) AS w0,
  count(*)::DOUBLE AS total FROM fit),
x AS (SELECT (coalesce(bal, m) - mu) / sd AS x, y, CASE WHEN y = 1 THEN w1 ELSE w0 END AS w, total
  FROM fit, mom, wts),
nt(i, b0, b1) AS (
  SELECT 0, 0.0::DOUBLE, 0.0::DOUBLE
  UNION ALL
  SELECT i + 1, b0 - (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01),
         b1 - (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01)
  FROM (
    SELECT i, b0, b1, sum(w * (p - y)) / any_value(total) AS g0,
      sum(w * (p - y) * x) / any_value(total) + b1 / any_value(total) AS g1,
      sum(w * p * (1 - p)) / any_value(total) AS h00, sum(w * p * (1 - p) * x) / any_value(total) AS h01,
      sum(w * p * (1 - p) * x * x) / any_value(total) + 1 / any_value(total) AS h11
    FROM (SELECT nt.i, nt.b0, nt.b1, x.*, 1 / (1 + exp(-(nt.b0 + nt.b1 * x.x))) AS p FROM nt, x)
    GROUP BY i, b0, b1)
  WHERE i < 12)
SELECT t.cohort, t.row_id, 'logistic_regression' AS model, 'y_a' AS label, t.y_a AS y_true,
  round(1 / (1 + exp(-(b0 + b1 * (coalesce(t.bal, m) - mu) / sd))), 5) AS score_raw
FROM test t, mom, (SELECT b0, b1 FROM nt ORDER BY i DESC LIMIT 1) WHERE t.cohort = 'ext'"""

_STUMP_SQL = f"""{pp.CLEAN_SQL},
tr AS (SELECT CASE WHEN lab_raw > 150 THEN 1 ELSE 0 END AS x, y_a AS y FROM train),
te AS (SELECT row_id, y_a AS y_true, CASE WHEN lab_raw > 150 THEN 1 ELSE 0 END AS x FROM test)"""

_GBT_SQL = f"""WITH {_STUMP_SQL},
g AS (SELECT x, sum(y)::DOUBLE AS p, sum(1 - y)::DOUBLE AS n,
  (SELECT sum(1 - y) / sum(y)::DOUBLE FROM tr) AS w FROM tr GROUP BY x),
f1 AS (SELECT *, (p * w - n) / (p * w + n) AS s1 FROM g),
f2 AS (SELECT *, s1 + 0.5::DOUBLE * (p * w * 4 / (1 + exp(2 * s1)) - n * 4 / (1 + exp(-2 * s1)))
  / (p * w + n) AS s2 FROM f1),
f3 AS (SELECT *, s2 + 0.5::DOUBLE * (p * w * 4 / (1 + exp(2 * s2)) - n * 4 / (1 + exp(-2 * s2)))
  / (p * w + n) AS s3 FROM f2)
SELECT row_id, k.stage, round(CASE k.stage WHEN 0 THEN s1 WHEN 1 THEN s2 ELSE s3 END, 6) AS score_raw
FROM te JOIN f3 USING (x), (VALUES (0), (1), (2)) k(stage)"""

_STOP_SQL = f"""WITH RECURSIVE {_STUMP_SQL},
g AS (SELECT x, sum(y)::DOUBLE AS p, sum(1 - y)::DOUBLE AS n,
  (SELECT sum(1 - y) / sum(y)::DOUBLE FROM tr) AS w FROM tr GROUP BY x),
f(stage, x, s) AS (
  SELECT 0, x, (p * w - n) / (p * w + n) FROM g
  UNION ALL
  SELECT stage + 1, x, s + 0.05::DOUBLE * (p * w * 4 / (1 + exp(2 * s))
    - n * 4 / (1 + exp(-2 * s))) / (p * w + n)
  FROM f JOIN g USING (x) WHERE stage < 59)
SELECT x, stage, round(s, 5) AS score_raw, 800 AS n_asked, true AS refused FROM f"""

# All sets of levels are tried: those of a number's binary digits.
_NATIVE_SQL = f"""WITH {pp.CLEAN_SQL},
lev AS (SELECT coalesce(segment, '(none)') AS level, sum(y_b)::DOUBLE AS p, sum(1 - y_b)::DOUBLE AS n,
  (SELECT sum(1 - y_b) / sum(y_b)::DOUBLE FROM train) AS w,
  row_number() OVER (ORDER BY coalesce(segment, '(none)')) - 1 AS i FROM train GROUP BY 1),
sides AS (SELECT m, level, (m >> i) & 1 AS side, p * w + n AS total, p * w - n AS signed
  FROM lev, (SELECT unnest(generate_series(1, (SELECT (1 << count(*)) - 2 FROM lev))) AS m)),
halves AS (SELECT m, side, sum(total) AS total, sum(signed) AS signed FROM sides GROUP BY m, side),
best AS (SELECT m FROM halves GROUP BY m ORDER BY round(sum(signed * signed / total), 9) DESC, m LIMIT 1),
leaf AS (SELECT level, signed / total AS s FROM (SELECT level, m, side FROM sides) JOIN halves
  USING (m, side) JOIN best USING (m))
SELECT row_id, round(s, 6) AS score_raw FROM test JOIN leaf ON leaf.level = coalesce(segment, '(none)')"""

_BALANCE_SQL = f"""WITH {pp.CLEAN_SQL}, src AS (SELECT row_id, y_a AS y_true FROM train),
sums AS (SELECT draw::INTEGER AS tree, y_true, sum(w)::BIGINT AS drawn
  FROM {rp.weights_sql("src", 12)} GROUP BY ALL)
SELECT tree, y_true, drawn, round(sum(drawn) OVER (PARTITION BY tree) / (2.0::DOUBLE * drawn), 6)
  AS weight FROM sums"""

ORACLE: dict[str, str] = {
    "frozen_score": _NEWTON_SQL,
    "stream_score": _NEWTON_SQL,
    "gbt_early_stop": _STOP_SQL,
    "native_split": _NATIVE_SQL,
    "forest_balance": _BALANCE_SQL,
    "rf_stump": f"""WITH {_STUMP_SQL},
w AS (SELECT count(*) / (2.0::DOUBLE * sum(y)) AS w1, count(*) / (2.0::DOUBLE * sum(1 - y)) AS w0 FROM tr),
leaf AS (SELECT x, sum(y) * any_value(w1) / (sum(y) * any_value(w1) + sum(1 - y) * any_value(w0)) AS p
  FROM tr, w GROUP BY x)
SELECT row_id, y_true, round(p, 6) AS score_raw FROM te JOIN leaf USING (x)""",
    "gbt_stages": _GBT_SQL,
}

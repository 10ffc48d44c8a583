"""Queries that write tables and read them back, audit them, and score a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortry.operators import audit, harmonize, prep, ranking, report, split, thresholds
from cohortry.operators import vectors as v
from cohortry.plans import fixtures as fx
from cohortry.plans import harmonize_plans as hp
from cohortry.plans import prep_plans as pp
from cohortry.plans import ranking_plans as rp
from cohortry.plans import text_plans as tp
from cohortry.session import pinned, work_path
from cohortry.sources import sinks, tables
from cohortry.streaming.apply import apply_stream, case_stream

CELL = ranking.CELL


# --- readers -----------------------------------------------------------------------

def _case_table(spark, sf_dir):
    path = work_path(spark, "cases")
    sinks.write_cells(fx.cases(spark, sf_dir).where(F.col("split").isNotNull()), path,
                      ["cohort", "split"])
    return path


def scan_contract(spark, sf_dir):
    """Contract columns in contract order, one cohort and split read."""
    return tables.load_features(spark, _case_table(spark, sf_dir), "main", "test",
                                ["segment", "bal", "lab_late"])


def scan_outcome(spark, sf_dir):
    return tables.load_outcome(spark, _case_table(spark, sf_dir), "ext", "test", "y_a")


def scan_meta(spark, sf_dir):
    meta = tables.load_meta(spark, _case_table(spark, sf_dir), "main", "train")
    return meta.select("row_id", "op_year", "proc_text")


def contract_file(spark, sf_dir):
    """The feature list written as a contract file and read again, with its values."""
    path = work_path(spark, "contract")
    spec = hp.prune_empty(spark, sf_dir).where("in_model").select(F.col("column").alias("name"))
    sinks.write_summary(spec, path, ["name"])
    names = tables.feature_contract(spark, path)
    return harmonize.recorded_counts(fx.cases(spark, sf_dir), names)


def spec_csv(spark, sf_dir):
    """The availability spec as a CSV with quoted year lists, read with its types."""
    path = work_path(spark, "spec")
    spec = hp.availability_by_year(spark, sf_dir).select(
        F.col("column").alias("name"), "availability", "years_present", "n_years")
    sinks.write_summary(spec, path, ["name"])
    out = tables.read_spec(spark, path)
    return out.select("name", "availability", "n_years",
                      F.size("years_present").alias("n_listed"),
                      F.try_element_at("years_present", F.lit(1)).alias("first_year"))


def schema_rows(spark, sf_dir):
    c = fx.cases(spark, sf_dir)
    n = tables.checked_count(c)
    return tables.schema_table(c).select("position", "column", "type", F.lit(n).alias("n_rows"))


def row_positions(spark, sf_dir):
    """Row numbers of a single-file table against its key."""
    t = tables.with_row_position(spark, f"{sf_dir}/orders.parquet")
    return t.select("row_id", "o_orderkey")


def row_positions_folder(spark, sf_dir):
    """Row numbers over a folder of five files."""
    path = work_path(spark, "orders")
    fx.table(spark, sf_dir, "orders").select("o_orderkey").repartitionByRange(
        5, "o_orderkey").sortWithinPartitions("o_orderkey").write.parquet(path)
    return tables.with_row_position(spark, path).select("row_id", "o_orderkey")


# --- sinks -------------------------------------------------------------------------

def prediction_sink(spark, sf_dir):
    path = work_path(spark, "pred")
    sinks.write_predictions(fx.test_scores(spark, sf_dir), path)
    return sinks.read_cells(spark, path).select(
        *CELL, "row_id", "y_true", F.round("score_raw", 6).alias("score_raw"))


def split_sink(spark, sf_dir):
    """Splits of both outcomes saved, read back and checked against the rows."""
    path = work_path(spark, "split")
    pool = hp._pool(spark, sf_dir)
    for y in fx.LABELS:
        s = split.stratified_split(pool.select("row_id", y), y)
        sinks.write_split(s.withColumn("label", F.lit(y)), path)
    return sinks.read_split(spark, path, "y_a", pool)


def state_sink(spark, sf_dir):
    """A saved state applied to the external cohort."""
    path = work_path(spark, "state")
    prep.fit("embed", pp.train_rows(spark, sf_dir), [*pp.NUMERIC, *pp.LOW]).save(path)
    ext = pp.test_rows(spark, sf_dir).where(F.col("cohort") == "ext")
    return pp._r(prep.PrepState.load(spark, path).transform(ext), pp.NUMERIC)


def summary_sink(spark, sf_dir):
    path = work_path(spark, "summary")
    areas = rp.auroc_ap(spark, sf_dir)
    sinks.write_summary(areas.where("label = 'y_a'"), path, ["model"])
    sinks.write_summary(areas.where("label = 'y_b'"), path, ["model"], append=True)
    return spark.read.schema(areas.schema).csv(path, header=True)


def draws_sink(spark, sf_dir):
    path = work_path(spark, "draws")
    sinks.write_cells(rp.bootstrap_draws(spark, sf_dir), path)
    return sinks.read_cells(spark, path).select(*CELL, "draw", "auroc", "auprc")


def curve_sink(spark, sf_dir):
    path = work_path(spark, "curves")
    sinks.write_cells(rp.roc_curve(spark, sf_dir), path)
    return sinks.read_cells(spark, path).select(*CELL, "idx", "fpr", "tpr")


def cell_meta_sink(spark, sf_dir):
    path = work_path(spark, "meta")
    counts = ranking.outcome_counts(fx.test_scores(spark, sf_dir), CELL)
    sinks.append_meta(counts.where("cohort = 'main'"), path, CELL)
    sinks.append_meta(counts.where("cohort = 'ext'"), path, CELL)
    out = sinks.read_meta(spark, path, "cohort string, model string, label string",
                          "n_rows long, n_pos long, n_neg long, prevalence double")
    return out.withColumn("prevalence", F.round("prevalence", 6))


def vector_sink(spark, sf_dir):
    path = work_path(spark, "vectors")
    pooled = pinned(v.pool_chunks(fx.chunk_vectors(spark, sf_dir)))
    sinks.write_vectors(pooled.withColumns({
        "encoder": F.lit("e"), "cohort": F.lit("main"), "split": F.lit("train")}), path)
    back = sinks.read_vectors(spark, path, pooled.count(), 64, encoder="e", split="train")
    return back.select("row_id", F.posexplode("vec").alias("dim", "x")).withColumn(
        "x", F.round(F.col("x").cast("double"), 5))


def crosswalk_csv(spark, sf_dir):
    """The crosswalk percentages as a CSV with lists of columns in quotes, read back."""
    path = work_path(spark, "crosswalk")
    pct = hp.crosswalk_pct(spark, sf_dir).groupBy("difference").pivot(
        "sample", ["main_train", "main_test"]).agg(F.first("pct_observed"))
    names = F.create_map(*[F.lit(x) for g, cols in hp.GROUPS.items() for x in (g, ", ".join(cols))])
    sinks.write_summary(pct.select(
        F.col("difference").alias("difference_class"), names[F.col("difference")].alias("variables"),
        F.col("main_train").alias("pct_observed_main_train"),
        F.col("main_test").alias("pct_observed_main_test"), F.lit("as recorded").alias("handling")),
        path, ["difference_class"])
    return tables.read_crosswalk(spark, path)


def scaler_sink(spark, sf_dir):
    """Two scalers in one table; the second does not touch the first."""
    path = work_path(spark, "scaler")
    scaler = pinned(tp.fit_scaler(spark, sf_dir))
    sinks.write_scaler(scaler, path, "e", "y_a")
    sinks.write_scaler(scaler.withColumn("mean", F.lit(0.0)), path, "e", "y_b")
    return sinks.read_scaler(spark, path, "e", "y_a")


def run_discovery(spark, sf_dir):
    path = work_path(spark, "found")
    pred = fx.test_scores(spark, sf_dir)
    sinks.write_predictions(pred.where("cohort = 'main' OR label = 'y_a'"), path)
    return sinks.discover(spark, path)


# --- audits ------------------------------------------------------------------------

def _positives(spark, sf_dir):
    return ranking.outcome_counts(fx.test_scores(spark, sf_dir), CELL)


def grid_missing(spark, sf_dir):
    n = pinned(_positives(spark, sf_dir))
    return audit.grid_missing([*fx.MODELS, "m_absent"], fx.LABELS, {
        "predictions": n.where("cohort = 'main'"),
        "external": n.where("cohort = 'ext' AND n_pos >= 20")})


def rowcount_check(spark, sf_dir):
    """Predictions against the rows of their cohort that have a balance: some differ."""
    c = fx.cases(spark, sf_dir).where("split = 'test'")
    expected = c.groupBy("cohort").agg(
        F.when(F.col("cohort") == "ext", F.count("bal")).otherwise(F.count(F.lit(1)))
        .alias("expected"))
    return audit.rowcount_check(fx.test_scores(spark, sf_dir), expected, CELL, ["cohort"])


def schema_check(spark, sf_dir):
    """Prediction columns against the case table's, with the row count of each."""
    pred, c = fx.test_scores(spark, sf_dir), fx.cases(spark, sf_dir)
    odd = audit.schema_differences(pred, c.select("cohort", "row_id", "op_year"))
    return pred.agg(F.count(F.lit(1)).alias("n_pred")).withColumn(
        "differences", F.lit(",".join(odd)))


def finite_scores(spark, sf_dir):
    """Scores of a model that divides by the balance: zero, missing and not-a-number occur."""
    c = fx.cases(spark, sf_dir).where("split = 'test'")
    bad = F.when(F.col("bal") < -900, float("nan")).when(
        F.col("bal") > 9900, float("inf")).otherwise(F.col("bal") / 1e4)
    return audit.finite_scores(c.withColumn("score_raw", bad), ["cohort"])


def stale_outputs(spark, sf_dir):
    """Cohort parts whose availability differs from that of all test rows."""
    c = fx.cases(spark, sf_dir).where(F.col("split").isNotNull()).withColumn(
        "part", F.concat_ws("_", "cohort", "split"))
    seen = F.col("n_recorded") > 0
    parts = harmonize.recorded_counts(c, fx.CASE_COLUMNS, ["part"]).withColumn("seen", seen)
    test = harmonize.recorded_counts(c.where("split = 'test'"), fx.CASE_COLUMNS).withColumn(
        "seen", seen)
    path = work_path(spark, "stamped")
    stamps = audit.fingerprint(parts, ["column", "seen"], ["part"])
    sinks.write_stamped(c.select("part", "row_id"), path, ["part"], stamps)
    return audit.stale_outputs(sinks.read_stamps(spark, path, ["part"]),
                               audit.fingerprint(test, ["column", "seen"]))


def best_iter_check(spark, sf_dir):
    meta = _positives(spark, sf_dir).select(
        *CELL, F.when(F.col("n_pos") % 3 != 0, F.col("n_pos") % 100 - 30).alias("best_iteration"))
    return audit.best_iteration_check(meta, ["m_signal", "m_tied"])


def interval_gaps(spark, sf_dir):
    """Ranges of amounts around all orders' prices, and what they leave uncovered."""
    at = F.floor("o_totalprice")
    shards = fx.table(spark, sf_dir, "orders").select(at.alias("lo"), (at + 10).alias("hi"))
    n = fx.table(spark, sf_dir, "orders").agg(F.max(at)).first()[0] + 1
    return audit.interval_gaps(shards, n)


def throughput(spark, sf_dir):
    stages = fx.table(spark, sf_dir, "lineitem").groupBy(
        F.col("l_returnflag").alias("stage"), "l_suppkey").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("l_quantity").alias("seconds"))
    out = report.throughput(stages, ["stage"], 4_995_670)
    return out.withColumns({c: F.round(c, 6) for c in ("seconds", "rows_per_sec", "hours")})


# --- stream ------------------------------------------------------------------------

def stream_apply(spark, sf_dir):
    """Events through a frozen state, as a stream of files."""
    batch = fx.table(spark, sf_dir, "events").withColumnRenamed("event_id", "row_id")
    state = prep.fit("embed", batch, ["value", "event_type"])
    source = case_stream(spark, sf_dir, fx.table(spark, sf_dir, "events").schema,
                         "events.parquet").withColumnRenamed("event_id", "row_id")
    sink = work_path(spark, "stream")
    apply_stream(source, state, sink, work_path(spark, "stream-checkpoint")).awaitTermination()
    out = spark.read.parquet(sink)
    return out.withColumn("value", F.round("value", 6))


# --- SQL side ------------------------------------------------------------------------

C, P = fx.CASES_SQL, fx.PRED_SQL
_TYPES = {"row_id": "bigint", "op_year": "int", "cohort": "string", "split": "string",
          "bal": "double", "lab_raw": "double", "lab_late": "double", "segment": "string",
          "casetype": "string", "emergency": "string", "elective": "string",
          "proc_text": "string", "late_only": "double", "y_a": "int", "y_b": "int"}


def _seen_sql(part, where):
    return " UNION ALL ".join(
        f"SELECT {part} AS part, '{c}' || '|' || (count({c}) > 0)::VARCHAR AS line"
        f" FROM cases WHERE {where} GROUP BY {part}" for c in fx.CASE_COLUMNS)


QUERIES = {f.__name__: f for f in (
    scan_contract, scan_outcome, scan_meta, contract_file, spec_csv, crosswalk_csv, schema_rows, row_positions,
    row_positions_folder,
    prediction_sink, split_sink, state_sink, summary_sink, draws_sink, curve_sink, cell_meta_sink,
    vector_sink, scaler_sink, run_discovery, grid_missing, rowcount_check, schema_check,
    finite_scores, stale_outputs, best_iter_check, interval_gaps, throughput, stream_apply)}

ORACLE = {
    "scan_contract": f"""WITH {C} SELECT row_id, segment, bal, lab_late FROM cases
WHERE cohort = 'main' AND split = 'test'""",
    "scan_outcome": f"""WITH {C} SELECT row_id, y_a AS y_true FROM cases
WHERE cohort = 'ext' AND split = 'test'""",
    "scan_meta": f"""WITH {C} SELECT row_id, op_year::INTEGER AS op_year, proc_text FROM cases
WHERE cohort = 'main' AND split = 'train'""",
    "contract_file": f"WITH {C} " + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) AS n_rows, count({c}) AS n_recorded FROM cases"
        for c in fx.CASE_COLUMNS if c != "late_only"),
    "spec_csv": f"""WITH a AS ({hp.ORACLE["availability_by_year"]})
SELECT "column" AS name, availability, n_years::INTEGER AS n_years, n_years::INTEGER AS n_listed,
  split_part(years_present, ',', 1)::INTEGER AS first_year FROM a""",
    "crosswalk_csv": f"WITH x AS ({hp.ORACLE['crosswalk_pct']}), " + "m AS (" + " UNION ALL ".join(
        f"SELECT '{g}' AS difference, '{c}' AS member" for g, cols in hp.GROUPS.items()
        for c in cols) + """)
SELECT difference AS difference_class, member, sample, pct_observed, 'as recorded' AS handling
FROM x JOIN m USING (difference) WHERE sample IN ('main_train', 'main_test')""",
    "schema_rows": f"WITH {C} " + " UNION ALL ".join(
        f"SELECT {i} AS position, '{c}' AS \"column\", '{t}' AS type, count(*) AS n_rows"
        f" FROM cases" for i, (c, t) in enumerate(_TYPES.items())),
    "row_positions": "SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS row_id, o_orderkey"
                     " FROM orders",
    "row_positions_folder": "SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS row_id,"
                            " o_orderkey FROM orders",
    "prediction_sink": f"WITH {P} SELECT * REPLACE (round(score_raw, 6) AS score_raw) FROM pred",
    "split_sink": f"""WITH {hp.POOL_SQL}, {hp._split_sql("y_a", "s")}
SELECT row_id, split FROM s""",
    "state_sink": f"WITH {pp.CLEAN_SQL}, {pp.NUM_SQL}, {pp.levels_sql(pp.LOW)} "
                  + pp.codes_sql(pp.LOW, pp.VOCAB, 0, pp.scaled_sql(pp.NUMERIC) + ", ")
                  + " WHERE cohort = 'ext'",
    "summary_sink": rp.ORACLE["auroc_ap"],
    "draws_sink": rp.ORACLE["bootstrap_draws"],
    "curve_sink": rp.ORACLE["roc_curve"],
    "cell_meta_sink": rp.ORACLE["outcome_counts"],
    "vector_sink": f"WITH {tp.VEC} SELECT row_id, dim, round(x::FLOAT::DOUBLE, 5) AS x FROM pooled",
    "scaler_sink": tp.ORACLE["fit_scaler"],
    "run_discovery": f"""WITH {P} SELECT DISTINCT cohort, model, label FROM pred
WHERE cohort = 'main' OR label = 'y_a'""",
    "grid_missing": f"""WITH {P}, n AS (SELECT cohort, model, label, sum(y_true) AS n_pos
  FROM pred GROUP BY ALL),
grid AS (SELECT model, label FROM (SELECT unnest(['m_signal', 'm_noise', 'm_tied', 'm_absent'])
  AS model) a, (SELECT unnest(['y_a', 'y_b']) AS label) b)
SELECT model, label, 'predictions' AS missing FROM grid
WHERE (model, label) NOT IN (SELECT (model, label) FROM n WHERE cohort = 'main')
UNION ALL SELECT model, label, 'external' FROM grid
WHERE (model, label) NOT IN (SELECT (model, label) FROM n WHERE cohort = 'ext' AND n_pos >= 20)""",
    "rowcount_check": f"""WITH {P}, e AS (SELECT cohort,
  CASE WHEN cohort = 'ext' THEN count(bal) ELSE count(*) END AS expected
  FROM cases WHERE split = 'test' GROUP BY cohort),
n AS (SELECT cohort, model, label, count(*) AS n_rows FROM pred GROUP BY ALL)
SELECT n.*, expected, n_rows = expected AS ok FROM n JOIN e USING (cohort)""",
    "schema_check": f"""WITH {P} SELECT count(*) AS n_pred,
  'label:string,model:string,op_year:int,score_raw:double,y_true:int' AS differences FROM pred""",
    "finite_scores": f"""WITH {C} SELECT cohort, count(*) AS n_rows,
  count(*) FILTER (bal IS NULL OR bal < -900 OR bal > 9900) AS n_bad
FROM cases WHERE split = 'test' GROUP BY cohort""",
    "stale_outputs": f"""WITH {C}, l AS ({_seen_sql("cohort || '_' || split", "split IS NOT NULL")}),
t AS ({_seen_sql("'all'", "split = 'test'")}),
s AS (SELECT part, sha256(string_agg(line, chr(10) ORDER BY line)) AS config_sha FROM l
  GROUP BY part)
SELECT * FROM s WHERE config_sha <> (SELECT sha256(string_agg(line, chr(10) ORDER BY line)) FROM t)""",
    "best_iter_check": f"""WITH {P}, n AS (SELECT cohort, model, label, sum(y_true)::BIGINT AS n_pos
  FROM pred GROUP BY ALL),
m AS (SELECT cohort, model, label, CASE WHEN n_pos % 3 <> 0 THEN n_pos % 100 - 30 END
  AS best_iteration FROM n)
SELECT * FROM m WHERE model IN ('m_signal', 'm_tied')
  AND (best_iteration IS NULL OR best_iteration < 0)""",
    "interval_gaps": """WITH s AS (SELECT floor(o_totalprice)::BIGINT AS lo,
  floor(o_totalprice)::BIGINT + 10 AS hi FROM orders), n AS (SELECT max(lo) + 1 AS n FROM s),
o AS (SELECT lo, coalesce(max(hi) OVER (ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING
  AND 1 PRECEDING), 0) AS reach FROM (SELECT * FROM s UNION ALL SELECT n, n FROM n))
SELECT reach AS gap_lo, least(lo, (SELECT n FROM n)) AS gap_hi FROM o
WHERE reach < least(lo, (SELECT n FROM n))""",
    "throughput": """WITH s AS (SELECT l_returnflag AS stage, count(*) AS n_rows,
  sum(l_quantity) AS seconds FROM lineitem GROUP BY ALL)
SELECT stage, n_rows, round(seconds, 6) AS seconds, round(n_rows / seconds, 6) AS rows_per_sec,
  round(4995670.0::DOUBLE / (n_rows / seconds) / 3600, 6) AS hours FROM s""",
    "stream_apply": """WITH m AS (SELECT median(value) AS med FROM events),
s AS (SELECT med, avg(coalesce(value, med)) AS mean, stddev_samp(coalesce(value, med)) AS sd
  FROM events, m GROUP BY med),
l AS (SELECT event_type, row_number() OVER (ORDER BY count(*) DESC, min(event_id)) AS id
  FROM events GROUP BY event_type)
SELECT event_id AS row_id, round((coalesce(value, med) - mean) / sd, 6) AS value,
  l.id::INTEGER AS event_type FROM events JOIN l USING (event_type), s""",
}

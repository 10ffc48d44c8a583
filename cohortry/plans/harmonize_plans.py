"""Harmonisation, availability, drift, split and class-weight queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortry.functions import hashing
from cohortry.functions.missing import sentinel_to_null
from cohortry.operators import harmonize as h
from cohortry.operators import report, split, training
from cohortry.plans import fixtures as fx

YEAR_OLD, YEAR_NEW = 1997, 1998
GROUPS = {"late": ["lab_late", "late_only"], "recoded": ["casetype", "emergency", "elective"],
          "always": ["bal", "segment", "proc_text"]}


def cohort_split(spark, sf_dir):
    return fx.cases(spark, sf_dir).where(F.col("split").isNotNull()).groupBy(
        "cohort", "split").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("op_year").alias("first_year"),
        F.max("op_year").alias("last_year"))


def casetype_backfill(spark, sf_dir):
    c = fx.cases(spark, sf_dir)
    return c.select("row_id", "op_year", h.backfill_casetype(
        F.col("casetype"), F.col("emergency"), F.col("elective")).alias("casetype"))


def flag_derive(spark, sf_dir):
    c = fx.cases(spark, sf_dir)
    return c.select(
        "row_id",
        h.flag_from_casetype(F.col("emergency"), F.col("casetype"), "Emergent").alias("emergency"),
        h.flag_from_casetype(F.col("elective"), F.col("casetype"), "Elective").alias("elective"))


def _lab(spark, sf_dir):
    return fx.cases(spark, sf_dir).withColumn("lab_raw", sentinel_to_null(F.col("lab_raw")))


def sentinel_null(spark, sf_dir):
    return _lab(spark, sf_dir).select("row_id", "lab_raw")


def lab_proxy(spark, sf_dir):
    c = _lab(spark, sf_dir)
    return c.select("row_id", F.round(h.linear_proxy(F.col("lab_late"), F.col("lab_raw")), 6)
                    .alias("lab"))


def lab_proxy_fit(spark, sf_dir):
    out = h.proxy_fit(_lab(spark, sf_dir), "lab_late", "lab_raw", keys=["op_year"])
    return out.withColumns({c: F.round(c, 6) for c in (
        "slope", "intercept", "r2", "abs_err_p50", "abs_err_p90")})


def rename_coalesce(spark, sf_dir):
    c = fx.cases(spark, sf_dir)
    return c.select("row_id", F.round(F.coalesce("late_only", "lab_late"), 6).alias("late_only"),
                    F.round("lab_late", 6).alias("lab_late"))


def rename_check(spark, sf_dir):
    out = h.rename_check(_lab(spark, sf_dir), ("lab_raw", YEAR_OLD), ("lab_late", YEAR_NEW),
                         "op_year")
    return out.withColumns({c: F.round(c, 6) for c in ("old_value", "new_value")})


def union_years(spark, sf_dir):
    """Yearly tables with their own columns, stacked again."""
    c = fx.cases(spark, sf_dir)
    old = c.where(F.col("op_year") < 1998).select("row_id", "op_year", "bal", "emergency")
    mid = c.where(F.col("op_year").between(1998, 1999)).select("row_id", "op_year", "casetype")
    new = c.where(F.col("op_year") > 1999).select("late_only", "casetype", "op_year", "row_id")
    return h.union_years([old, mid, new])


def prune_empty(spark, sf_dir):
    train = fx.cases(spark, sf_dir).where(F.col("split") == "train")
    return h.model_columns(train, fx.CASE_COLUMNS)


def mask_cols(spark, sf_dir):
    masked = h.mask_columns(fx.cases(spark, sf_dir), ["late_only", "segment"])
    return masked.select("row_id", "bal", "late_only", "segment")


def availability_by_year(spark, sf_dir):
    return h.availability_by_year(
        fx.cases(spark, sf_dir), fx.CASE_COLUMNS, "op_year",
        {"casetype": "partially", "emergency": "partially", "elective": "partially",
         "lab_late": "fully"})


def crosswalk_pct(spark, sf_dir):
    c = fx.cases(spark, sf_dir).where(F.col("split").isNotNull()).withColumn(
        "sample", F.concat_ws("_", "cohort", "split"))
    return h.crosswalk_pct(c, GROUPS, "sample").withColumn(
        "pct_observed", F.round("pct_observed", 6))


def named_field_rules(spark, sf_dir):
    """The six derivation rules on the prespecified names. Late rows lack the old flags, early
    ones the case type, and the second name of the last measurement is absent altogether."""
    c = fx.cases(spark, sf_dir).select(
        "row_id", F.col("casetype").alias("CASETYPE"), F.col("emergency").alias("EMERGNCY"),
        F.col("elective").alias("ELECTSURG"), F.col("bal").alias("PRHEMOGLOBIN"),
        sentinel_to_null(F.col("lab_raw")).alias("PRHCT"), F.col("lab_late").alias("HEMO"))
    out = h.apply_rules(c)
    return out.withColumns({x: F.round(x, 6) for x in ("PRHEMOGLOBIN", "PRHCT", "HEMO", "PRHEMO_A1C")})


def column_types(spark, sf_dir):
    """Numeric or categorical, by stored type, with what each column holds."""
    c = fx.cases(spark, sf_dir)
    numeric, categorical = h.split_types(c, fx.CASE_COLUMNS)
    kind = {**dict.fromkeys(numeric, "numeric"), **dict.fromkeys(categorical, "categorical")}
    kinds = F.create_map(*[F.lit(x) for kv in kind.items() for x in kv])
    return h.recorded_counts(c, numeric + categorical).withColumn(
        "kind", kinds[F.col("column")]).drop("n_rows")


def feature_drift(spark, sf_dir):
    c = fx.cases(spark, sf_dir)
    spec = h.model_columns(c.where(F.col("split") == "train"), fx.CASE_COLUMNS)
    keep = [r["column"] for r in spec.where("in_model").collect()]
    main, ext, test = (F.col("cohort") == "main"), (F.col("cohort") == "ext"), (
        F.col("split") == "test")
    samples = {"main_train": main & (F.col("split") == "train"), "main_test": main & test,
               "ext_test": ext & test}
    rep = report.feature_availability(c, keep, samples, "main_train", "main_test")
    return report.with_unused_columns(rep, spec)


def _pool(spark, sf_dir):
    return fx.cases(spark, sf_dir).where(
        (F.col("split") == "train") & (F.col("cohort") == "main")).select("row_id", *fx.LABELS)


def _splits(spark, sf_dir):
    """(label, model, row_id, split): each model of an outcome makes its own split, from rows in
    another order and layout."""
    pool = _pool(spark, sf_dir)
    out = None
    for label in fx.LABELS:
        for i, model in enumerate(fx.MODELS):
            own = pool.select("row_id", label).repartition(i + 2, "row_id")
            s = split.stratified_split(own, label).select(
                F.lit(label).alias("label"), F.lit(model).alias("model"), "row_id", "split")
            out = s if out is None else out.unionByName(s)
    return out


def strat_split(spark, sf_dir):
    pool = _pool(spark, sf_dir)
    return split.stratified_split(pool, "y_b").select("row_id", "y_b", "split")


def split_quotas(spark, sf_dir):
    return split.class_quotas(_pool(spark, sf_dir), "y_b", split.VAL_FRACTION)


def split_audit(spark, sf_dir):
    """The split of the internal pool, checked against all development rows."""
    rows = fx.cases(spark, sf_dir).where(F.col("split") == "train").select("row_id")
    return split.split_audit(rows, strat_split(spark, sf_dir))


def split_agreement(spark, sf_dir):
    return split.split_agreement(_splits(spark, sf_dir), "label", "model")


def split_identity(spark, sf_dir):
    one = _splits(spark, sf_dir).where(F.col("model") == fx.MODELS[0])
    return split.split_fingerprints(one, ["label"])


def label_seeds(spark, sf_dir):
    """The seed of every outcome name found in the data (here: market segments)."""
    return fx.cases(spark, sf_dir).where(F.col("segment").isNotNull()).groupBy("segment").agg(
        F.count(F.lit(1)).alias("n_rows")).withColumn(
        "seed", hashing.label_seed_col(F.col("segment")))


def shard_bounds(spark, sf_dir):
    return split.shard_bounds(fx.cases(spark, sf_dir), 7)


def class_weights(spark, sf_dir):
    pool = _pool(spark, sf_dir)
    long = pool.unpivot(["row_id"], fx.LABELS, "label", "y_true")
    return training.class_weights(long, ["label"]).withColumns(
        {c: F.round(c, 6) for c in ("pos_weight", "balanced_pos", "balanced_neg")})


# --- SQL side ----------------------------------------------------------------------

C = fx.CASES_SQL
LAB_SQL = C + """,
lab AS (SELECT * REPLACE (nullif(lab_raw, -99.0::DOUBLE) AS lab_raw) FROM cases)"""
POOL_SQL = C + """,
pool AS (SELECT row_id, y_a, y_b FROM cases WHERE split = 'train' AND cohort = 'main')"""


def _split_sql(label, name):
    """The same rows by ranking every class in full."""
    return f"""
{name}_q AS (SELECT cls, n, ceil(total * 0.05::DOUBLE) * n / total AS share,
    ceil(total * 0.05::DOUBLE) AS want
  FROM (SELECT {label} AS cls, count(*) AS n, sum(count(*)) OVER ()::DOUBLE AS total
        FROM pool GROUP BY {label})),
{name}_quota AS (SELECT cls, n, (floor(share) + CASE WHEN row_number() OVER
    (ORDER BY share - floor(share) DESC, cls) <= want - sum(floor(share)) OVER ()
    THEN 1 ELSE 0 END)::BIGINT AS quota FROM {name}_q),
{name} AS (SELECT '{label}' AS label, row_id, {label} AS cls,
  CASE WHEN row_number() OVER (PARTITION BY {label}
    ORDER BY md5('{hashing.label_seed(label)}:' || row_id)) <= quota
    THEN 'val' ELSE 'fit' END AS split FROM pool JOIN {name}_quota ON {label} = cls)"""


def _pct(c, where):
    return f"round(100.0 * count({c}) FILTER ({where}) / count(*) FILTER ({where}), 2)::DOUBLE"


_M, _T, _E = ("cohort = 'main' AND split = 'train'", "cohort = 'main' AND split = 'test'",
              "cohort = 'ext' AND split = 'test'")


def _lanes_sql(src):
    from cohortry.plans.ranking_plans import _scramble_sql
    p, cur = hashing.PRIME, src
    for lane, (k1, k2, k3) in enumerate(hashing.LANES):
        cur = (f"(SELECT *, ((row_id & {p}) * {k1} + ((row_id >> 31) & {p}) * {k2} + {k3}) % {p}"
               f" AS x FROM {cur})")
        cur = _scramble_sql(cur, "x", f"lane{lane}")
    return cur


def _crc32(text: str) -> str:
    import zlib
    return str(42 + zlib.crc32(text.encode()) % 10_000)


QUERIES = {f.__name__: f for f in (
    cohort_split, casetype_backfill, flag_derive, sentinel_null, lab_proxy, lab_proxy_fit,
    rename_coalesce, rename_check, union_years, prune_empty, mask_cols, availability_by_year,
    crosswalk_pct, named_field_rules, column_types, feature_drift, strat_split, split_quotas, split_audit,
    split_agreement, split_identity, label_seeds, shard_bounds, class_weights)}

_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]

ORACLE = {
    "cohort_split": f"""WITH {C} SELECT cohort, split, count(*) AS n_rows,
  min(op_year)::INTEGER AS first_year, max(op_year)::INTEGER AS last_year
FROM cases WHERE split IS NOT NULL GROUP BY ALL""",
    "casetype_backfill": f"""WITH {C} SELECT row_id, op_year::INTEGER AS op_year,
  coalesce(casetype, CASE emergency WHEN 'Yes' THEN 'Emergent' WHEN 'No' THEN 'Elective'
    ELSE CASE elective WHEN 'Yes' THEN 'Elective' END END) AS casetype FROM cases""",
    "flag_derive": f"""WITH {C} SELECT row_id,
  coalesce(emergency, CASE WHEN casetype = 'Emergent' THEN 'Yes'
    WHEN casetype IS NOT NULL THEN 'No' END) AS emergency,
  coalesce(elective, CASE WHEN casetype = 'Elective' THEN 'Yes'
    WHEN casetype IS NOT NULL THEN 'No' END) AS elective FROM cases""",
    "sentinel_null": f"WITH {LAB_SQL} SELECT row_id, lab_raw FROM lab",
    "lab_proxy": f"""WITH {LAB_SQL} SELECT row_id,
  round(coalesce(lab_late, lab_raw * 0.344::DOUBLE + -0.56::DOUBLE), 6) AS lab FROM lab""",
    "lab_proxy_fit": f"""WITH {LAB_SQL}, p AS (SELECT *,
  abs(lab_late - (lab_raw * 0.344::DOUBLE + -0.56::DOUBLE)) AS err FROM lab
  WHERE lab_late IS NOT NULL AND lab_raw IS NOT NULL)
SELECT op_year::INTEGER AS op_year, count(*) AS n_pairs,
  round(regr_slope(lab_late, lab_raw), 6) AS slope,
  round(regr_intercept(lab_late, lab_raw), 6) AS intercept,
  round(regr_r2(lab_late, lab_raw), 6) AS r2, round(quantile_cont(err, 0.5), 6) AS abs_err_p50,
  round(quantile_cont(err, 0.9), 6) AS abs_err_p90 FROM p GROUP BY op_year""",
    "rename_coalesce": f"""WITH {C} SELECT row_id,
  round(coalesce(late_only, lab_late), 6) AS late_only, round(lab_late, 6) AS lab_late
FROM cases""",
    "rename_check": f"""WITH {LAB_SQL}, q AS (SELECT unnest([0.05, 0.5, 0.95])::DOUBLE AS prob,
  unnest((SELECT quantile_cont(lab_raw, [0.05, 0.5, 0.95]) FROM lab WHERE op_year = {YEAR_OLD}))
    AS o,
  unnest((SELECT quantile_cont(lab_late, [0.05, 0.5, 0.95]) FROM lab WHERE op_year = {YEAR_NEW}))
    AS n)
SELECT prob, round(o, 6) AS old_value, round(n, 6) AS new_value FROM q""",
    "union_years": f"""WITH {C} SELECT row_id, op_year::INTEGER AS op_year,
  CASE WHEN op_year < 1998 THEN bal END AS bal,
  CASE WHEN op_year < 1998 THEN emergency END AS emergency,
  CASE WHEN op_year >= 1998 THEN casetype END AS casetype,
  CASE WHEN op_year > 1999 THEN late_only END AS late_only FROM cases""",
    "prune_empty": f"WITH {C} " + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count({c}) AS n_recorded, count({c}) > 0 AS in_model"
        f" FROM cases WHERE split = 'train'" for c in fx.CASE_COLUMNS),
    "mask_cols": f"""WITH {C} SELECT row_id, bal, NULL::DOUBLE AS late_only,
  NULL::VARCHAR AS segment FROM cases""",
    "availability_by_year": f"WITH {C}, y AS (" + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", op_year, count({c}) AS k FROM cases GROUP BY op_year"
        for c in fx.CASE_COLUMNS) + """)
SELECT "column", coalesce(string_agg(op_year::VARCHAR, ',' ORDER BY op_year) FILTER (k > 0), '')
    AS years_present, count(*) FILTER (k > 0) AS n_years,
  CASE WHEN min(k) > 0 THEN 'present in all years'
    WHEN "column" IN ('casetype', 'emergency', 'elective') THEN 'partially derivable'
    WHEN "column" = 'lab_late' THEN 'fully derivable' ELSE 'absent in some years' END
    AS availability FROM y GROUP BY "column\"""",
    "crosswalk_pct": f"WITH {C}, long AS (" + " UNION ALL ".join(
        f"SELECT '{g}' AS difference, cohort || '_' || split AS sample,"
        f" 100.0::DOUBLE * count({c}) / count(*) AS pct FROM cases WHERE split IS NOT NULL"
        f" GROUP BY ALL" for g, cols in GROUPS.items() for c in cols) + """)
SELECT difference, sample, round(avg(pct), 6) AS pct_observed FROM long GROUP BY ALL""",
    "column_types": f"WITH {C} " + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count({c}) AS n_recorded,"
        f" '{'numeric' if c in ('bal', 'lab_raw', 'lab_late', 'late_only') else 'categorical'}'"
        f" AS kind FROM cases" for c in fx.CASE_COLUMNS),
    "feature_drift": f"WITH {C}, r AS (" + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", {_pct(c, _M)} AS pct_main_train,"
        f" {_pct(c, _T)} AS pct_main_test, {_pct(c, _E)} AS pct_ext_test FROM cases"
        for c in fx.CASE_COLUMNS if c != "late_only") + """)
SELECT *, round(pct_main_train - pct_main_test, 2) AS train_minus_test,
  pct_main_test = 0 AND pct_main_train > 0 AS unusable,
  abs(round(pct_main_train - pct_main_test, 2)) >= 25 AS large_shift, TRUE AS in_model FROM r
UNION ALL SELECT 'late_only', 0, 0, 0, 0, FALSE, FALSE, FALSE""",
    "named_field_rules": f"""WITH {C}, r AS (SELECT *, nullif(lab_raw, -99.0::DOUBLE) AS hct FROM cases)
SELECT row_id, coalesce(casetype, CASE emergency WHEN 'Yes' THEN 'Emergent' WHEN 'No' THEN 'Elective'
    END, CASE WHEN elective = 'Yes' THEN 'Elective' END) AS "CASETYPE",
  coalesce(emergency, CASE WHEN casetype = 'Emergent' THEN 'Yes' WHEN casetype IS NOT NULL THEN 'No'
    END) AS "EMERGNCY",
  coalesce(elective, CASE WHEN casetype = 'Elective' THEN 'Yes' WHEN casetype IS NOT NULL THEN 'No'
    END) AS "ELECTSURG",
  round(coalesce(bal, hct * {h.PROXY_SLOPE}::DOUBLE + {h.PROXY_INTERCEPT}::DOUBLE), 6) AS "PRHEMOGLOBIN",
  round(hct, 6) AS "PRHCT", round(lab_late, 6) AS "HEMO", round(lab_late, 6) AS "PRHEMO_A1C"
FROM r""",
    "strat_split": f"""WITH {POOL_SQL}, {_split_sql("y_b", "s")}
SELECT row_id, cls AS y_b, split FROM s""",
    "split_quotas": f"""WITH {POOL_SQL}, {_split_sql("y_b", "s")}
SELECT cls AS y_b, n, quota FROM s_quota""",
    "split_audit": f"""WITH {POOL_SQL}, {_split_sql("y_b", "s")},
rows_ AS (SELECT row_id FROM cases WHERE split = 'train')
SELECT 'uncovered' AS "check", (SELECT count(*) FROM rows_ WHERE row_id NOT IN
  (SELECT row_id FROM s)) AS n_bad
UNION ALL SELECT 'unknown', (SELECT count(*) FROM s WHERE row_id NOT IN
  (SELECT row_id FROM rows_))
UNION ALL SELECT 'overlap', (SELECT count(*) FROM (SELECT row_id FROM s GROUP BY row_id
  HAVING count(DISTINCT split) > 1))
UNION ALL SELECT 'val_empty', (SELECT CASE WHEN count(*) > 0 THEN 0 ELSE 1 END FROM s
  WHERE split = 'val')""",
    "split_agreement": f"""WITH {POOL_SQL}
SELECT label, 3::BIGINT AS n_members, count(*) AS n_rows, 0::BIGINT AS n_disagree
FROM (SELECT unnest(['y_a', 'y_b']) AS label, row_id FROM pool) GROUP BY label""",
    "split_identity": f"""WITH {POOL_SQL}, {_split_sql("y_a", "sa")}, {_split_sql("y_b", "sb")},
both_ AS (SELECT label, row_id FROM sa WHERE split = 'val'
  UNION ALL SELECT label, row_id FROM sb WHERE split = 'val'),
fp AS (SELECT label, count(*) AS n_val, bit_xor(lane0) AS fp_a, bit_xor(lane1) AS fp_b
  FROM {_lanes_sql("both_")} GROUP BY label)
SELECT *, count(*) OVER (PARTITION BY n_val, fp_a, fp_b) AS n_same FROM fp""",
    "label_seeds": f"""WITH {C} SELECT segment, count(*) AS n_rows,
  (CASE segment {" ".join(f"WHEN '{s}' THEN {_crc32(s)}" for s in _SEGMENTS)} END)::BIGINT AS seed
FROM cases WHERE segment IS NOT NULL GROUP BY segment""",
    "shard_bounds": f"""WITH {C}, t AS (SELECT count(*) AS n FROM cases)
SELECT i::INTEGER AS shard, floor(i * (n / 7.0::DOUBLE))::BIGINT AS lo,
  (CASE WHEN i = 6 THEN n ELSE floor((i + 1) * (n / 7.0::DOUBLE)) END)::BIGINT AS hi
FROM t, generate_series(0, 6) g(i)""",
    "class_weights": f"WITH {POOL_SQL} " + " UNION ALL ".join(
        f"SELECT '{y}' AS label, count(*) AS n_rows, sum({y})::BIGINT AS n_pos,"
        f" round(sum(1 - {y}) / greatest(sum({y}), 1), 6) AS pos_weight,"
        f" round(count(*) / (2 * sum({y})), 6) AS balanced_pos,"
        f" round(count(*) / (2 * sum(1 - {y})), 6) AS balanced_neg FROM pool" for y in fx.LABELS),
}

"""Queries that fit preprocessing on the development rows and apply it to test rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortry.functions.missing import sentinel_to_null
from cohortry.operators import prep
from cohortry.plans import fixtures as fx
from cohortry.session import work_path

NUMERIC = ["bal", "lab_raw", "lab_late", "late_only"]
LOW = ["segment", "casetype", "emergency", "elective"]
HIGH = "proc_text"
WIDE = [*NUMERIC, *LOW, HIGH]


def clean_cases(spark, sf_dir):
    return fx.cases(spark, sf_dir).withColumn("lab_raw", sentinel_to_null(F.col("lab_raw")))


def train_rows(spark, sf_dir):
    return clean_cases(spark, sf_dir).where(
        (F.col("split") == "train") & (F.col("cohort") == fx.INTERNAL))


def test_rows(spark, sf_dir):
    return clean_cases(spark, sf_dir).where(F.col("split") == "test")


def _r(df, cols, places=6):
    return df.withColumns({c: F.round(F.col(f"`{c}`"), places) for c in cols})


def fit_numeric(spark, sf_dir):
    return _r(prep.fit_numeric(train_rows(spark, sf_dir), NUMERIC), ["median", "mean", "std"])


def impute_matrix(spark, sf_dir):
    state = prep.fit("matrix", train_rows(spark, sf_dir), NUMERIC)
    return _r(state.transform(test_rows(spark, sf_dir)), NUMERIC)


def impute_scale(spark, sf_dir):
    state = prep.fit("linear", train_rows(spark, sf_dir), NUMERIC)
    return _r(state.transform(test_rows(spark, sf_dir)), NUMERIC)


def onehot_levels(spark, sf_dir):
    levels = prep.fit_linear_levels(train_rows(spark, sf_dir), LOW)
    return levels.select("column", "mode", "level", "pos")


def onehot(spark, sf_dir):
    """One row per test row and indicator, as indicator names come from the data."""
    state = prep.fit("linear", train_rows(spark, sf_dir), LOW)
    wide = state.transform(test_rows(spark, sf_dir))
    entries = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(f"`{n}`").alias("value"))
                        for n in state.feature_names()])
    return wide.select("row_id", F.inline(entries))


def freq_encode(spark, sf_dir):
    state = prep.fit("linear", train_rows(spark, sf_dir), [HIGH])
    return _r(state.transform(test_rows(spark, sf_dir)), [f"{HIGH}__freq"])


def ordinal_codes(spark, sf_dir):
    state = prep.fit("matrix", train_rows(spark, sf_dir), [*LOW, HIGH])
    return state.transform(test_rows(spark, sf_dir))


def codes_text_key(spark, sf_dir):
    """Codes by first appearance where rows are keyed by texts."""
    rows = train_rows(spark, sf_dir).select(
        F.concat(F.lit("case-"), F.lpad(F.col("row_id").cast("string"), 12, "0")).alias("key"),
        *[F.col(c) for c in [*LOW, HIGH]])
    return prep.fit_codes(rows, [*LOW, HIGH], "key", range_rows=500).select("column", "level", "pos")


def approx_median(spark, sf_dir):
    """Approximate medians at an accuracy that is exact for these tables: the lower middle value."""
    out = prep.fit_numeric(train_rows(spark, sf_dir), NUMERIC, exact=False, accuracy=10_000_000)
    return _r(out, ["median"]).select("column", "median")


def native_cat(spark, sf_dir):
    state = prep.fit("tree", train_rows(spark, sf_dir), WIDE)
    return _r(state.transform(test_rows(spark, sf_dir)), NUMERIC)


def vocab_ids(spark, sf_dir):
    state = prep.fit("embed", train_rows(spark, sf_dir), [*LOW, HIGH])
    return state.transform(test_rows(spark, sf_dir))


def feature_names(spark, sf_dir):
    """Names and widths of all views, as the states know them."""
    train = train_rows(spark, sf_dir)
    rows = []
    for view in prep.VIEWS:
        state = prep.fit(view, train, WIDE)
        rows += [(view, i, n) for i, n in enumerate(state.feature_names())]
        if view == "embed":
            rows += [("cardinality", i, str(n)) for i, n in enumerate(state.cardinalities())]
    return spark.createDataFrame(rows, "view string, position int, name string")


def state_diff(spark, sf_dir):
    """The state of the development rows against its saved copy and against a
    state fitted on all cohorts."""
    train = train_rows(spark, sf_dir)
    state = prep.fit("linear", train, WIDE)
    path = work_path(spark, "prep-state")
    state.save(path)
    again = prep.PrepState.load(spark, path)
    other = prep.fit("linear", clean_cases(spark, sf_dir).where(F.col("split") == "train"), WIDE)
    return prep.state_differences(state, again).withColumn("against", F.lit("saved")).unionByName(
        prep.state_differences(state, other).withColumn("against", F.lit("all cohorts")))


def refit_transform(spark, sf_dir):
    """Fit and apply in one call."""
    _, out = prep.fit_transform("embed", train_rows(spark, sf_dir), test_rows(spark, sf_dir),
                                [*NUMERIC, *LOW])
    return _r(out, NUMERIC)


# --- SQL side --------------------------------------------------------------------

CLEAN_SQL = fx.CASES_SQL + """,
clean AS (SELECT * REPLACE (nullif(lab_raw, -99.0::DOUBLE) AS lab_raw) FROM cases),
train AS (SELECT * FROM clean WHERE split = 'train' AND cohort = 'main'),
test AS (SELECT * FROM clean WHERE split = 'test')"""

NUM_SQL = "num AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", (SELECT coalesce(median({c}), 0.0::DOUBLE) FROM train) AS med,"
    f" avg(coalesce({c}, (SELECT coalesce(median({c}), 0.0::DOUBLE) FROM train))) AS mean,"
    f" coalesce(nullif(stddev_samp(coalesce({c}, (SELECT coalesce(median({c}), 0.0::DOUBLE)"
    f" FROM train))), 0), 1.0::DOUBLE) AS std FROM train" for c in NUMERIC) + ")"


def _num(c, what):
    return f"(SELECT {what} FROM num WHERE \"column\" = '{c}')"


def scaled_sql(cols):
    return ", ".join(
        f"round((coalesce({c}, {_num(c, 'med')}) - {_num(c, 'mean')}) / {_num(c, 'std')}, 6)"
        f" AS {c}" for c in cols)


def levels_sql(cols, src="train"):
    return "lev AS (" + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", {c} AS level, count(*) AS n, min(row_id) AS first"
        f" FROM {src} WHERE {c} IS NOT NULL GROUP BY {c}" for c in cols) + """),
ranked AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, first) AS by_n,
  row_number() OVER (PARTITION BY "column" ORDER BY first) - 1 AS by_first,
  count(*) OVER (PARTITION BY "column") AS n_levels,
  sum(n) OVER (PARTITION BY "column") AS n_known FROM lev)"""


def codes_sql(cols, value, default, extra=""):
    joins = "\n".join(
        f"LEFT JOIN (SELECT level, {value} AS v FROM ranked WHERE \"column\" = '{c}') j_{c}"
        f" ON t.{c} = j_{c}.level" for c in cols)
    outs = ", ".join(f"coalesce(j_{c}.v, {default})::INTEGER AS {c}" for c in cols)
    return f"SELECT row_id, {extra}{outs} FROM test t {joins}"


VOCAB = "CASE WHEN by_n <= 1000 THEN by_n END"
FREQ_SQL = f"""freq AS (SELECT level, n, n / n_known AS f FROM ranked WHERE "column" = '{HIGH}'
  AND n_levels > 30),
per_row AS (SELECT coalesce(f, 0.0::DOUBLE) AS f FROM train LEFT JOIN freq ON {HIGH} = level),
mom AS (SELECT avg(f) AS mu, coalesce(nullif(stddev_pop(f), 0), 1.0::DOUBLE) AS sd FROM per_row)"""

_NAMES = [f"SELECT '{v}' AS view, {i} AS position, '{c}' AS name"
          for v in ("matrix", "tree", "embed") for i, c in enumerate(WIDE)]
_NAMES += [f"SELECT 'linear', {i}, '{c}'" for i, c in enumerate(NUMERIC)]

NAMES_SQL = f"""WITH {CLEAN_SQL}, {levels_sql([*LOW, HIGH])},
cols AS (SELECT * FROM (VALUES {", ".join(f"('{c}', {i})" for i, c in enumerate([*LOW, HIGH]))})
  t("column", c_at)),
cat AS (SELECT DISTINCT c_at, CASE WHEN n_levels <= 30 THEN by_n ELSE 1 END AS l_at,
  CASE WHEN n_levels <= 30 THEN "column" || '=' || level ELSE "column" || '__freq' END AS name
  FROM ranked JOIN cols USING ("column"))
{" UNION ALL ".join(_NAMES)}
UNION ALL SELECT 'linear', ({len(NUMERIC)} - 1 + row_number() OVER (ORDER BY c_at, l_at))::INTEGER,
  name FROM cat
UNION ALL SELECT 'cardinality', c_at, (least(count(*), 1000) + 1)::VARCHAR
  FROM ranked JOIN cols USING ("column") GROUP BY c_at"""

STATE_SQL = f"""WITH {CLEAN_SQL}, {NUM_SQL}, {levels_sql([*LOW, HIGH])},
all_train AS (SELECT * FROM clean WHERE split = 'train'),
num2 AS ({NUM_SQL[len("num AS ("):-1].replace("FROM train", "FROM all_train")}),
{levels_sql([*LOW, HIGH], "all_train").replace("lev AS", "lev2 AS").replace(
    "ranked AS", "ranked2 AS").replace("FROM lev)", "FROM lev2)")},
s1 AS (SELECT *, CASE WHEN n_levels > 30 THEN n / n_known END AS f FROM ranked),
s2 AS (SELECT *, CASE WHEN n_levels > 30 THEN n / n_known END AS f FROM ranked2),
m1 AS (SELECT "column", sum(f * n) / (SELECT count(*) FROM train) AS mu,
  sqrt(sum(f * f * n) / (SELECT count(*) FROM train)
    - (sum(f * n) / (SELECT count(*) FROM train)) ** 2) AS sd FROM s1
  WHERE f IS NOT NULL GROUP BY ALL),
m2 AS (SELECT "column", sum(f * n) / (SELECT count(*) FROM all_train) AS mu,
  sqrt(sum(f * f * n) / (SELECT count(*) FROM all_train)
    - (sum(f * n) / (SELECT count(*) FROM all_train)) ** 2) AS sd FROM s2
  WHERE f IS NOT NULL GROUP BY ALL),
j AS (SELECT a."column" AS ac, b."column" AS bc,
  CASE WHEN a.f IS NULL THEN a.by_n END AS ap, CASE WHEN b.f IS NULL THEN b.by_n END AS bp,
  a.f AS af, b.f AS bf, x.mu AS amu, y.mu AS bmu, x.sd AS asd, y.sd AS bsd
  FROM s1 a FULL JOIN s2 b ON a."column" = b."column" AND a.level = b.level
  LEFT JOIN m1 x ON x."column" = a."column" LEFT JOIN m2 y ON y."column" = b."column")
SELECT 'saved' AS against, part, 0::BIGINT AS n_diff FROM (VALUES ('contract'), ('levels'),
  ('numeric')) t(part)
UNION ALL SELECT 'all cohorts', 'contract', 0
UNION ALL SELECT 'all cohorts', 'levels', count(*) FROM j WHERE ac IS NULL OR bc IS NULL
  OR ap IS DISTINCT FROM bp OR (af IS NULL) <> (bf IS NULL)
  OR abs(af - bf) > 1e-8 + 1e-5 * abs(bf) OR abs(amu - bmu) > 1e-8 + 1e-5 * abs(bmu)
  OR abs(asd - bsd) > 1e-8 + 1e-5 * abs(bsd)
UNION ALL SELECT 'all cohorts', 'numeric', count(*) FROM num a JOIN num2 b USING ("column")
  WHERE abs(a.med - b.med) > 1e-8 + 1e-5 * abs(b.med)
  OR abs(a.mean - b.mean) > 1e-8 + 1e-5 * abs(b.mean)
  OR abs(a.std - b.std) > 1e-8 + 1e-5 * abs(b.std)"""

QUERIES = {f.__name__: f for f in (
    fit_numeric, impute_matrix, impute_scale, onehot_levels, onehot, freq_encode, ordinal_codes, codes_text_key,
    approx_median,
    native_cat, vocab_ids, feature_names, state_diff, refit_transform)}

ORACLE = {
    "fit_numeric": f"""WITH {CLEAN_SQL}, {NUM_SQL} SELECT "column", round(med, 6) AS median,
  round(mean, 6) AS mean, round(std, 6) AS std FROM num""",
    "impute_matrix": f"WITH {CLEAN_SQL}, {NUM_SQL} SELECT row_id, " + ", ".join(
        f"round(coalesce({c}, {_num(c, 'med')}), 6) AS {c}" for c in NUMERIC) + " FROM test",
    "impute_scale": f"WITH {CLEAN_SQL}, {NUM_SQL} SELECT row_id, {scaled_sql(NUMERIC)} FROM test",
    "onehot_levels": f"""WITH {CLEAN_SQL}, {levels_sql(LOW)}
SELECT "column", 'onehot' AS mode, level, by_n - 1 AS pos FROM ranked""",
    "onehot": f"""WITH {CLEAN_SQL}, {levels_sql(LOW)},
long AS (""" + " UNION ALL ".join(
        f"SELECT row_id, '{c}' AS \"column\", {c} AS value FROM test" for c in LOW) + """)
SELECT row_id, "column" || '=' || level AS feature,
  CASE WHEN value = level THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS value
FROM long JOIN ranked USING ("column")""",
    "freq_encode": f"""WITH {CLEAN_SQL}, {levels_sql([HIGH])}, {FREQ_SQL}
SELECT row_id, round((coalesce(f, 0.0::DOUBLE) - mu) / sd, 6) AS {HIGH}__freq
FROM test LEFT JOIN freq ON {HIGH} = level, mom""",
    "ordinal_codes": f"WITH {CLEAN_SQL}, {levels_sql([*LOW, HIGH])} "
                     + codes_sql([*LOW, HIGH], "by_first", -1),
    "codes_text_key": f"""WITH {CLEAN_SQL}, {levels_sql([*LOW, HIGH])}
SELECT "column", level, by_first AS pos FROM ranked""",
    "approx_median": f"WITH {CLEAN_SQL} " + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", round(coalesce((SELECT quantile_disc({c}, 0.5) FROM train),"
        f" 0.0::DOUBLE), 6) AS median" for c in NUMERIC),
    "native_cat": f"WITH {CLEAN_SQL}, {levels_sql([*LOW, HIGH])} SELECT row_id, "
                  + ", ".join(f"round({c}, 6) AS {c}" for c in NUMERIC) + ", " + ", ".join(
        f"CASE WHEN {c} IN (SELECT level FROM ranked WHERE \"column\" = '{c}') THEN {c} END AS {c}"
        for c in [*LOW, HIGH]) + " FROM test",
    "vocab_ids": f"WITH {CLEAN_SQL}, {levels_sql([*LOW, HIGH])} "
                 + codes_sql([*LOW, HIGH], VOCAB, 0),
    "feature_names": NAMES_SQL,
    "state_diff": STATE_SQL,
    "refit_transform": f"WITH {CLEAN_SQL}, {NUM_SQL}, {levels_sql(LOW)} "
                       + codes_sql(LOW, VOCAB, 0, scaled_sql(NUMERIC) + ", "),
}

"""Queries that turn rows into passages, and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortry.functions.missing import sentinel_to_null
from cohortry.functions.text import value_text, word_count
from cohortry.operators import passages as p
from cohortry.operators import vectors as v
from cohortry.operators.harmonize import recorded_counts
from cohortry.plans import fixtures as fx
from cohortry.session import work_path

LABELS = {
    "bal": "Account balance", "lab_raw": "First measurement, thousands",
    "lab_late": "Second measurement, from 1998", "segment": "Market segment",
    "casetype": "Case type: elective, urgent, or emergent", "emergency": "Emergency case",
    "elective": "Elective case", "proc_text": "Free-text description",
    "late_only": "Measurement of the late years"}
MASK = ["late_only"]
SMALL_BUDGET = 30


def _cases(spark, sf_dir):
    return fx.cases(spark, sf_dir).withColumn("lab_raw", sentinel_to_null(F.col("lab_raw")))


def format_values(spark, sf_dir):
    """Numbers of many magnitudes, from tiny to beyond ten digits."""
    c = _cases(spark, sf_dir)
    cols = {"bal": F.col("bal"), "whole": F.floor(F.col("lab_raw")).cast("double"),
            "third": F.col("lab_raw") / 3, "tiny": F.col("bal") / 1e8,
            "huge": F.col("bal") * 1234567.891, "segment": F.col("segment")}
    wide = c.select("row_id", *[x.alias(n) for n, x in cols.items()])
    return wide.select("row_id", *[value_text(F.col(n), wide.schema[n].dataType).alias(n)
                                   for n in cols])


def render_sentence(spark, sf_dir):
    return p.sentences(_cases(spark, sf_dir), LABELS, MASK)


def field_token_cost(spark, sf_dir):
    return p.field_costs(_train(spark, sf_dir), LABELS, MASK)


def _train(spark, sf_dir):
    return _cases(spark, sf_dir).where(F.col("split") == "train")


def _plan(spark, sf_dir):
    return p.pack(p.field_costs(_train(spark, sf_dir), LABELS, MASK), SMALL_BUDGET)


def pack_chunks(spark, sf_dir):
    return _plan(spark, sf_dir)


def plan_describe(spark, sf_dir):
    return p.describe(_plan(spark, sf_dir))


def plan_check(spark, sf_dir):
    """A saved plan against the setting it was made under, and against another one."""
    path = work_path(spark, "plan")
    p.save_plan(_plan(spark, sf_dir), path, MASK)
    p.check_plan(spark, path, MASK, list(LABELS))
    return p.plan_differences(spark, path, ["bal"], [*LABELS, "added"])


def _chunks(spark, sf_dir):
    groups = p.plan_groups(_plan(spark, sf_dir))
    return p.passages(_cases(spark, sf_dir), LABELS, groups, MASK, ["row_id", "cohort"])


def render_chunks(spark, sf_dir):
    return _chunks(spark, sf_dir)


def truncation_audit(spark, sf_dir):
    return p.truncation_audit(_chunks(spark, sf_dir), ["cohort", "chunk"], max_tokens=28)


def docs_truncation(spark, sf_dir):
    """Whole documents against the window, by language."""
    return p.truncation_audit(fx.table(spark, sf_dir, "documents"), ["lang"])


def fields_present(spark, sf_dir):
    out = p.fields_present(_cases(spark, sf_dir), list(LABELS), ["cohort"])
    return out.withColumn("mean_fields", F.round("mean_fields", 6))


def first_rows(spark, sf_dir):
    return p.first_rows(p.sentences(_cases(spark, sf_dir), LABELS, MASK), 5)


def label_match(spark, sf_dir):
    """Columns recorded at test time against the labelled ones that are not masked."""
    c = _cases(spark, sf_dir).where(F.col("split") == "test")
    seen = recorded_counts(c, fx.CASE_COLUMNS).where("n_recorded > 0").select("column")
    named = recorded_counts(_train(spark, sf_dir), fx.CASE_COLUMNS).where(
        "n_recorded > 0").select("column")
    return p.set_differences(seen, named, "column")


def _long(df, *keys):
    return df.select(*keys, F.posexplode("vec").alias("dim", "x")).withColumn(
        "x", F.round(F.col("x").cast("double"), 6))


def l2_normalize(spark, sf_dir):
    return _long(v.l2_normalise(fx.chunk_vectors(spark, sf_dir)), "row_id", "chunk")


def chunk_pool(spark, sf_dir):
    return _long(v.pool_chunks(fx.chunk_vectors(spark, sf_dir)), "row_id")


def _tokens(spark, sf_dir):
    return fx.chunk_vectors(spark, sf_dir).select(
        "row_id", F.col("chunk").alias("pos"), "vec",
        F.when(F.col("klass") < 5, 1).otherwise(0).alias("mask"))


def token_pool(spark, sf_dir):
    t = _tokens(spark, sf_dir)
    mean = v.masked_mean(t, ["row_id"]).withColumn("pooling", F.lit("mean"))
    cls = v.first_token(t, ["row_id"]).withColumn("pooling", F.lit("first"))
    return _long(mean.unionByName(cls.withColumn("vec", F.col("vec").cast("array<double>"))),
                 "row_id", "pooling")


def fit_scaler(spark, sf_dir):
    out = v.fit_scaler(v.pool_chunks(fx.chunk_vectors(spark, sf_dir)))
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "scale")})


def apply_scaler(spark, sf_dir):
    pooled = v.pool_chunks(fx.chunk_vectors(spark, sf_dir))
    return _long(v.apply_scaler(pooled, v.fit_scaler(pooled)), "row_id")


def vector_audit(spark, sf_dir):
    c = fx.chunk_vectors(spark, sf_dir)
    raw = v.vector_audit(c, 64, ["chunk"]).withColumn("stage", F.lit("raw"))
    unit = v.vector_audit(v.l2_normalise(c), 64, ["chunk"]).withColumn("stage", F.lit("unit"))
    return raw.unionByName(unit).withColumns(
        {x: F.round(x, 6) for x in ("min_norm", "max_norm")})


def cosine_check(spark, sf_dir):
    """Pooled vectors at stored precision (float) against recomputed ones."""
    pooled = v.pool_chunks(fx.chunk_vectors(spark, sf_dir))
    stored = pooled.withColumn("vec", F.transform("vec", lambda x: F.round(x, 2)))
    return v.cosine_check(stored, pooled).withColumns(
        {c: F.round(c, 6) for c in ("worst_cosine", "max_abs_diff")})


# --- SQL side --------------------------------------------------------------------

C = fx.CASES_SQL + """,
clean AS (SELECT * REPLACE (nullif(lab_raw, -99.0::DOUBLE) AS lab_raw) FROM cases)"""


def num_sql(x):
    return (f"CASE WHEN {x} = floor({x}) THEN ({x})::DECIMAL(38,0)::VARCHAR"
            f" ELSE printf('%.10g', {x}) END")


def text_sql(c):
    if c in MASK:
        return "NULL"
    return num_sql(c) if c in ("bal", "lab_raw", "lab_late") else f"nullif(trim({c}), '')"


def field_sql(c):
    return f"'{LABELS[c]} is ' || coalesce({text_sql(c)}, 'undefined')"


def sentence_sql(cols):
    return f"'This patient''s ' || concat_ws(', ', {', '.join(map(field_sql, cols))}) || '.'"


def count_sql(x):
    return f"len(regexp_extract_all({x}, '[A-Za-z0-9]+|[^A-Za-z0-9\\s]'))"


COST_SQL = "cost AS (" + " UNION ALL ".join(
    f"SELECT {i} AS pos, '{c}' AS \"column\","
    f" max({count_sql(field_sql(c) + chr(124) * 2 + chr(39) + ', ' + chr(39))})::INTEGER AS cost"
    f" FROM clean WHERE split = 'train'" for i, c in enumerate(LABELS)) + ")"

PACK_SQL = f"""{COST_SQL},
plan AS (WITH RECURSIVE f AS (
  SELECT pos, "column", cost, 6 + cost AS used, 0 AS chunk FROM cost WHERE pos = 0
  UNION ALL SELECT c.pos, c."column", c.cost,
    CASE WHEN f.used + c.cost > {SMALL_BUDGET} THEN 6 + c.cost ELSE f.used + c.cost END,
    CASE WHEN f.used + c.cost > {SMALL_BUDGET} THEN f.chunk + 1 ELSE f.chunk END
  FROM f JOIN cost c ON c.pos = f.pos + 1)
SELECT pos, "column", cost, chunk FROM f)"""

# Fields in long form with their group; a passage is the ordered concatenation.
CHUNKS_SQL = f"""{PACK_SQL},
fields AS (""" + " UNION ALL ".join(
    f"SELECT row_id, cohort, {i} AS pos, {field_sql(c)} AS t FROM clean"
    for i, c in enumerate(LABELS)) + """),
chunks AS (SELECT row_id, cohort, chunk,
  'This patient''s ' || string_agg(t, ', ' ORDER BY pos) || '.' AS text
  FROM fields JOIN plan USING (pos) GROUP BY row_id, cohort, chunk)"""


def audit_sql(src, keys, limit):
    n = f"({count_sql('text')} + 2)"
    return f"""SELECT {keys}, count(*) AS n_chunks, max({n})::INTEGER AS longest,
  count(*) FILTER ({n} > {limit}) AS n_over, ({limit} - max({n}))::INTEGER AS headroom
FROM {src} GROUP BY ALL"""


VEC = """
raw AS (SELECT vec_id // 3 AS row_id, vec_id % 3 AS chunk, label AS klass,
  unnest(embedding)::DOUBLE AS x, (generate_subscripts(embedding, 1) - 1)::INTEGER AS dim
  FROM embeddings),
unit AS (SELECT row_id, chunk, klass, dim,
  x / sqrt(sum(x * x) OVER (PARTITION BY row_id, chunk)) AS x FROM raw),
mean_ AS (SELECT row_id, dim, avg(x) AS x FROM unit GROUP BY ALL),
pooled AS (SELECT row_id, dim, x / sqrt(sum(x * x) OVER (PARTITION BY row_id)) AS x FROM mean_),
scaler AS (SELECT dim, avg(x) AS mean, CASE WHEN stddev_pop(x) < 1e-8 THEN 1.0::DOUBLE
  ELSE stddev_pop(x) END AS scale FROM pooled GROUP BY dim)"""


def _norms(src, stage):
    return f"""SELECT chunk, count(*) AS n_rows, count(*) FILTER (size <> 64) AS n_wrong_dim,
  count(*) FILTER (norm = 0) AS n_zero, count(*) FILTER (abs(norm - 1) >= 5e-2) AS n_off_norm,
  round(min(norm), 6) AS min_norm, round(max(norm), 6) AS max_norm, '{stage}' AS stage
FROM (SELECT row_id, chunk, count(*) AS size, sqrt(sum(x * x)) AS norm FROM {src} GROUP BY ALL)
GROUP BY chunk"""


QUERIES = {f.__name__: f for f in (
    format_values, render_sentence, field_token_cost, pack_chunks, plan_describe, plan_check, render_chunks,
    truncation_audit, docs_truncation, fields_present, first_rows, label_match, l2_normalize,
    chunk_pool, token_pool, fit_scaler, apply_scaler, vector_audit, cosine_check)}

ORACLE = {
    "format_values": f"""WITH {C}, n AS (SELECT row_id, bal, floor(lab_raw) AS whole,
  lab_raw / 3 AS third, bal / 1e8::DOUBLE AS tiny, bal * 1234567.891::DOUBLE AS huge, segment
  FROM clean)
SELECT row_id, """ + ", ".join(f"{num_sql(c)} AS {c}" for c in (
        "bal", "whole", "third", "tiny", "huge")) + ", nullif(trim(segment), '') AS segment FROM n",
    "render_sentence": f"WITH {C} SELECT row_id, {sentence_sql(LABELS)} AS text FROM clean",
    "field_token_cost": f"WITH {C}, {COST_SQL} SELECT * FROM cost",
    "pack_chunks": f"WITH {C}, {PACK_SQL} SELECT * FROM plan",
    "plan_check": f"""WITH {C}, {PACK_SQL}
SELECT "column", 'masked differently' AS problem FROM plan WHERE "column" IN ('bal', 'late_only')
UNION ALL SELECT 'added', 'not in the plan'""",
    "plan_describe": f"""WITH {C}, {PACK_SQL} SELECT chunk, arg_min("column", pos) AS first_field,
  arg_max("column", pos) AS last_field, count(*) AS n_fields,
  (sum(cost) + 6)::BIGINT AS worst_tokens FROM plan GROUP BY chunk""",
    "render_chunks": f"WITH {C}, {CHUNKS_SQL} SELECT * FROM chunks",
    "truncation_audit": f"WITH {C}, {CHUNKS_SQL} {audit_sql('chunks', 'cohort, chunk', 28)}",
    "docs_truncation": audit_sql("documents", "lang", 512),
    "fields_present": f"WITH {C} SELECT cohort, count(*) AS n_rows, round(avg("
                      + " + ".join(f"({c} IS NOT NULL)::INTEGER" for c in LABELS)
                      + "), 6) AS mean_fields FROM clean GROUP BY cohort",
    "first_rows": f"WITH {C} SELECT row_id, {sentence_sql(LABELS)} AS text FROM clean"
                  " ORDER BY row_id LIMIT 5",
    "label_match": f"WITH {C}, s AS (" + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count({c}) FILTER (split = 'test') AS te,"
        f" count({c}) FILTER (split = 'train') AS tr FROM clean" for c in fx.CASE_COLUMNS) + """)
SELECT "column", CASE WHEN te > 0 THEN 'left' ELSE 'right' END AS side FROM s
WHERE (te > 0) <> (tr > 0)""",
    "l2_normalize": f"WITH {VEC} SELECT row_id, chunk, dim, round(x, 6) AS x FROM unit",
    "chunk_pool": f"WITH {VEC} SELECT row_id, dim, round(x, 6) AS x FROM pooled",
    "token_pool": f"""WITH {VEC}
SELECT row_id, 'first' AS pooling, dim, round(x, 6) AS x FROM raw WHERE chunk = 0
UNION ALL SELECT row_id, 'mean', dim, round(sum(CASE WHEN klass < 5 THEN x ELSE 0 END)
  / greatest(count(*) FILTER (klass < 5), 1e-6::DOUBLE), 6) FROM raw GROUP BY row_id, dim""",
    "fit_scaler": f"""WITH {VEC} SELECT dim, round(mean, 6) AS mean, round(scale, 6) AS scale
FROM scaler""",
    "apply_scaler": f"""WITH {VEC} SELECT row_id, dim, round((x - mean) / scale, 6) AS x
FROM pooled JOIN scaler USING (dim)""",
    "vector_audit": f"WITH {VEC} {_norms('raw', 'raw')} UNION ALL {_norms('unit', 'unit')}",
    "cosine_check": f"""WITH {VEC}, c AS (SELECT row_id,
  sum(x * round(x, 2)) / (sqrt(sum(x * x)) * sqrt(sum(round(x, 2) * round(x, 2)))) AS cosine,
  max(abs(x - round(x, 2))) AS gap FROM pooled GROUP BY row_id)
SELECT count(*) AS n_rows, count(*) FILTER (cosine <= 0.999) AS n_low,
  round(min(cosine), 6) AS worst_cosine, round(max(gap), 6) AS max_abs_diff FROM c""",
}

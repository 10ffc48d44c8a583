"""The evaluation tables the registered queries run on, from the given tables.

Each has a Spark form and a SQL form that produce the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.functions.hashing import PRIME
from cohortry.operators.harmonize import temporal_split

TRAIN_TO, TEST_FROM = 1998, 2000
INTERNAL = "main"
LABELS = ["y_a", "y_b"]
MODELS = ["m_signal", "m_noise", "m_tied"]
CASE_NUMERIC = ["bal", "lab_raw", "lab_late"]
CASE_TEXT = ["segment", "casetype", "emergency", "elective"]
CASE_COLUMNS = ["bal", "lab_raw", "lab_late", "segment", "casetype", "emergency", "elective",
                "proc_text", "late_only"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order, shaped like a case table with eras and missing values."""
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer")
    key, price, prio = F.col("o_orderkey"), F.col("o_totalprice"), F.col("o_orderpriority")
    year = F.year("o_orderdate")
    urgent, high = prio == "1-URGENT", prio == "2-HIGH"

    def unless(cond, value):
        return F.when(~cond, value)

    def yes_if(cond):
        return F.when(cond, "Yes").otherwise("No")

    new_era, old_era = year >= 1998, year < 1998
    return o.join(c, o.o_custkey == c.c_custkey).select(
        key.alias("row_id"),
        year.alias("op_year"),
        F.when(F.col("c_nationkey") == 0, "ext").otherwise(INTERNAL).alias("cohort"),
        temporal_split(year, TRAIN_TO, TEST_FROM).alias("split"),
        unless(key % 7 == 0, F.col("c_acctbal")).alias("bal"),
        F.when(key % 13 == 0, -99.0).otherwise(price / 1000.0).alias("lab_raw"),
        F.when(new_era, price / 2000.0 + 1.0).alias("lab_late"),
        unless(key % 11 == 0, F.col("c_mktsegment")).alias("segment"),
        F.when(new_era, F.when(urgent, "Emergent").when(high, "Urgent").otherwise("Elective"))
        .alias("casetype"),
        F.when(old_era, yes_if(urgent)).alias("emergency"),
        F.when(old_era, yes_if(~(urgent | high))).alias("elective"),
        F.col("c_name").alias("proc_text"),
        F.when(year >= 2000, price).alias("late_only"),
        F.when(F.col("o_orderstatus") == "P", 1).otherwise(0).alias("y_a"),
        F.when(urgent & (F.col("c_acctbal") < 0), 1).otherwise(0).alias("y_b"),
    )


CASES_SQL = """
cases AS (
SELECT o.o_orderkey AS row_id, year(o.o_orderdate) AS op_year,
  CASE WHEN c.c_nationkey = 0 THEN 'ext' ELSE 'main' END AS cohort,
  CASE WHEN year(o.o_orderdate) <= 1998 THEN 'train'
       WHEN year(o.o_orderdate) >= 2000 THEN 'test' END AS split,
  CASE WHEN o.o_orderkey % 7 = 0 THEN NULL ELSE c.c_acctbal END AS bal,
  CASE WHEN o.o_orderkey % 13 = 0 THEN -99.0::DOUBLE
       ELSE o.o_totalprice / 1000.0::DOUBLE END AS lab_raw,
  CASE WHEN year(o.o_orderdate) >= 1998
       THEN o.o_totalprice / 2000.0::DOUBLE + 1.0::DOUBLE END AS lab_late,
  CASE WHEN o.o_orderkey % 11 = 0 THEN NULL ELSE c.c_mktsegment END AS segment,
  CASE WHEN year(o.o_orderdate) >= 1998 THEN
       CASE o.o_orderpriority WHEN '1-URGENT' THEN 'Emergent' WHEN '2-HIGH' THEN 'Urgent'
            ELSE 'Elective' END END AS casetype,
  CASE WHEN year(o.o_orderdate) < 1998 THEN
       CASE WHEN o.o_orderpriority = '1-URGENT' THEN 'Yes' ELSE 'No' END END AS emergency,
  CASE WHEN year(o.o_orderdate) < 1998 THEN
       CASE WHEN o.o_orderpriority IN ('1-URGENT','2-HIGH') THEN 'No' ELSE 'Yes' END END
       AS elective,
  c.c_name AS proc_text,
  CASE WHEN year(o.o_orderdate) >= 2000 THEN o.o_totalprice END AS late_only,
  CASE WHEN o.o_orderstatus = 'P' THEN 1 ELSE 0 END AS y_a,
  CASE WHEN o.o_orderpriority = '1-URGENT' AND c.c_acctbal < 0 THEN 1 ELSE 0 END AS y_b
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey)"""


# Multipliers that spread row keys over [0, 1), one per score.
SPREAD = {"y_a": 742938285, "y_b": 950706376, "n": 1226874159}


def _u(k: str):
    return (F.col("row_id") * SPREAD[k] % PRIME).cast("double") / F.lit(float(PRIME))


def _u_sql(k: str) -> str:
    return f"((row_id * {SPREAD[k]} % {PRIME})::DOUBLE / {PRIME}.0::DOUBLE)"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of three models for two outcomes: (cohort, split, model, label,
    row_id, y_true, score_raw). Split ``val`` holds the development years."""
    c = cases(spark, sf_dir).where(F.col("split").isNotNull())
    y = F.col("y_true")
    noise = _u("n")
    tied = F.floor(F.col("lab_raw") / 10.0).cast("double") / 100.0

    def outcomes(label: str):
        yl = F.col(label).cast("double")
        u = _u(label)
        return [F.struct(F.lit(label).alias("label"), F.lit(m).alias("model"),
                         F.col(label).alias("y_true"), s.alias("score_raw"))
                for m, s in (("m_signal", 0.3 * yl + 0.7 * u), ("m_noise", noise),
                             ("m_tied", tied))]

    rows = F.array(*[s for label in LABELS for s in outcomes(label)])
    return c.select(
        "cohort", F.when(F.col("split") == "train", "val").otherwise("test").alias("split"),
        "row_id", F.inline(rows),
    ).select("cohort", "split", "model", "label", "row_id", y, "score_raw")


def test_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).where(F.col("split") == "test").drop("split")


def val_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).where(
        (F.col("split") == "val") & (F.col("cohort") == INTERNAL)).drop("split")


def _scored_sql() -> str:
    parts = []
    for label in LABELS:
        for model, score in (
            ("m_signal", f"0.3::DOUBLE * {label}::DOUBLE + 0.7::DOUBLE * {_u_sql(label)}"),
            ("m_noise", _u_sql("n")),
            ("m_tied", "floor(lab_raw / 10.0::DOUBLE) / 100.0::DOUBLE"),
        ):
            parts.append(
                f"SELECT cohort, CASE WHEN split = 'train' THEN 'val' ELSE 'test' END AS split,"
                f" '{model}' AS model, '{label}' AS label, row_id, {label} AS y_true,"
                f" {score} AS score_raw FROM cases WHERE split IS NOT NULL")
    return "scored AS (\n" + "\nUNION ALL ".join(parts) + ")"


SCORED_SQL = CASES_SQL + ",\n" + _scored_sql()
PRED_SQL = (SCORED_SQL + ",\npred AS (SELECT cohort, model, label, row_id, y_true, score_raw"
            " FROM scored WHERE split = 'test')")
VAL_SQL = (PRED_SQL + ",\nval AS (SELECT cohort, model, label, row_id, y_true, score_raw"
           " FROM scored WHERE split = 'val' AND cohort = 'main')")



def cum_sql(src: str = "pred", keys: str = "cohort, model, label", out: str = "cum") -> str:
    """Running counts at or above each distinct score, per cell."""
    return f"""
{out}_counts AS (SELECT {keys}, score_raw AS score, sum(y_true)::BIGINT AS p,
  sum(1 - y_true)::BIGINT AS n FROM {src} GROUP BY ALL),
{out} AS (SELECT *, (sum(p) OVER w)::BIGINT AS tp, (sum(n) OVER w)::BIGINT AS fp,
  (sum(p) OVER (PARTITION BY {keys}))::BIGINT AS pos,
  (sum(n) OVER (PARTITION BY {keys}))::BIGINT AS neg
  FROM {out}_counts WINDOW w AS (PARTITION BY {keys} ORDER BY score DESC))"""


def chunk_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, chunk, vec, y_true): three chunk vectors per row."""
    return table(spark, sf_dir, "embeddings").select(
        F.floor(F.col("vec_id") / 3).alias("row_id"), (F.col("vec_id") % 3).alias("chunk"),
        F.col("embedding").alias("vec"), F.col("label").alias("klass"))


VEC_SQL = """
vec AS (SELECT vec_id // 3 AS row_id, vec_id % 3 AS chunk,
  list_transform(embedding, x -> x::DOUBLE) AS vec, label AS klass FROM embeddings)"""

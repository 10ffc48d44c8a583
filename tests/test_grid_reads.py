"""A grid run reads its tables once, however many cells it trains."""

from pyspark.sql import functions as F

from cohortry.operators import training


def test_tables_of_a_grid_are_made_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def seen(x):
        made.add(1)
        return float(x % 17)

    rows = spark.range(400).select(
        F.lit("main").alias("cohort"), F.col("id").alias("row_id"), seen("id").alias("x"),
        *[(F.col("id") % k == 0).cast("int").alias(f"y{k}") for k in (2, 3)])
    trained = training.run_grid(rows, rows.limit(50), ["logistic_regression"], ["y2", "y3"], ["x"],
                                str(tmp_path / "grid"), options={"logistic_regression": {"maxIter": 3}})
    assert trained == [("logistic_regression", "y2"), ("logistic_regression", "y3")]
    assert made.value <= 2 * (400 + 400)

"""What the optimiser makes of the operators."""

import re

import pytest
from pyspark.sql import functions as F

from cohortry.operators import bootstrap, prep, ranking, split
from cohortry.sources import sinks, tables


def plan(df):
    """The physical plan, as explain prints it."""
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def case_path(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("cases") / "t")
    rows = spark.range(1000).select(
        F.when(F.col("id") % 4 == 0, "ext").otherwise("main").alias("cohort"),
        F.when(F.col("id") % 3 == 0, "test").otherwise("train").alias("split"),
        F.col("id").alias("row_id"), (F.col("id") % 7).cast("double").alias("a"),
        F.concat(F.lit("v"), F.col("id") % 50).alias("c"), (F.col("id") % 5 == 0).cast("int")
        .alias("y"), F.rand(3).alias("other"))
    sinks.write_cells(rows, path, ["cohort", "split"])
    return path


def test_scan_reads_only_what_the_contract_names(spark, case_path):
    text = plan(tables.load_features(spark, case_path, "main", "test", ["c", "a"]))
    assert "ReadSchema: struct<row_id:bigint,a:double,c:string>" in text
    filters = re.search(r"PartitionFilters: \[(.*?)\]", text).group(1)
    assert "main" in filters and "test" in filters


def test_vocabulary_is_limited_before_the_shuffle(spark, case_path):
    text = plan(prep.fit_vocab(spark.read.parquet(case_path), ["c"]))
    assert "WindowGroupLimit" in text


def test_tagging_a_split_shuffles_no_rows(spark, case_path):
    rows = spark.read.parquet(case_path).select("row_id", "y")
    text = plan(split.stratified_split(rows, "y"))
    assert "Exchange hashpartitioning" not in text and "BroadcastHashJoin" in text


def test_scores_are_merged_before_the_shuffle(spark, case_path):
    pred = spark.read.parquet(case_path).select(
        "cohort", F.lit("m").alias("model"), F.lit("y").alias("label"), "row_id",
        F.col("y").alias("y_true"), F.col("a").alias("score_raw"))
    text = plan(ranking.discrimination(pred))
    assert "partial_sum" in text and "Python" not in text and "SinglePartition" not in text
    many = plan(ranking.discrimination(pred, range_rows=100))
    assert "SinglePartition" not in many and "CartesianProduct" not in many
    assert "BroadcastNestedLoopJoin" not in many


def test_bootstrap_repeats_no_row_per_draw(spark, case_path):
    pred = spark.read.parquet(case_path).select(
        "cohort", F.lit("m").alias("model"), F.lit("y").alias("label"), "row_id",
        F.col("y").alias("y_true"), F.col("a").alias("score_raw"))
    text = plan(bootstrap.draw_sums(pred, 1000))
    assert "FlatMapGroupsInArrow" in text and "Generate" not in text


def test_bootstrap_tasks_follow_rows_and_not_bytes(spark, case_path):
    pred = spark.read.parquet(case_path).select(
        "cohort", F.lit("m").alias("model"), F.lit("y").alias("label"), "row_id",
        F.col("y").alias("y_true"), F.col("a").alias("score_raw"))
    # Adaptive execution would merge these few bytes, and so all their draws, into one task.
    assert "REPARTITION_BY_NUM" in plan(bootstrap.draw_sums(pred, 1000))


def test_cells_are_written_side_by_side_and_not_sorted(spark, tmp_path, monkeypatch):
    name, seen = sinks.OPEN_CELLS[0], []
    rows = spark.range(400).select(F.nullif(F.col("id") % 40, F.lit(7)).alias("cell"), "id")
    before, hint = spark.conf.get(name), type(rows).hint
    monkeypatch.setattr(type(rows), "hint", lambda df, *a: seen.append(spark.conf.get(name)) or hint(df, *a))
    sinks.write_cells(rows, str(tmp_path / "t"), ["cell"])
    assert int(seen[0]) > 0 and spark.conf.get(name) == before
    got = {r["cell"]: r["n"] for r in sinks.read_cells(spark, str(tmp_path / "t")).groupBy("cell").agg(
        F.count("id").alias("n")).collect()}
    assert got == {(None if c == 7 else c): 10 for c in range(40)}

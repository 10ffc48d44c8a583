"""Trees that stop early, categories, balanced resamples, scoring as cases arrive."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortry.functions import hashing
from cohortry.operators import boosting, forest, prep, training
from cohortry.sources import tables
from cohortry.streaming.apply import case_stream, read_scores, score_stream


def case_rows(spark, n=600):
    return spark.range(n).select(
        F.col("id").alias("row_id"), F.lit("main").alias("cohort"),
        (F.rand(1) * 4).alias("a"),
        F.when(F.col("id") % 11 != 0, F.concat(F.lit("v"), F.col("id") % 7)).alias("c"),
        F.concat(F.lit("n"), F.col("id") % 300).alias("wide"),
        ((F.col("id") % 7).isin(1, 4, 6) | (F.col("id") % 50 == 0)).cast("int").alias("y"))


def test_fitting_ends_after_the_patience(spark):
    marked = case_rows(spark).withColumn("a", (F.col("a") > 2).cast("int"))
    rows = training.assemble(marked, ["a"], ["row_id", "y"]).withColumnRenamed("y", "y_true")
    weighted = training.with_class_weight(rows, balanced=False)
    options = dict(maxIter=40, stepSize=0.1, seed=3, maxDepth=1, featureSubsetStrategy="all", block=3)
    # One 0/1 feature: no later stage ranks better than the first.
    model, values = boosting.fit(weighted, rows, patience=4, **options)
    assert boosting.best_stage(values, 4) == 0 and len(model.trees) == len(values) == 6
    # The stages that were fitted are the first ones of a longer fit.
    longer, _ = boosting.fit(weighted, rows, patience=60, **{**options, "maxIter": 8})
    cut = boosting.first_trees(longer, 6)
    assert len(cut.trees) == 6 < len(longer.trees)
    same = [{r.row_id: round(r.probability[1], 9) for r in m.transform(rows).collect()}
            for m in (model, cut)]
    assert same[0] == same[1]
    with pytest.raises(ValueError, match="early stopping fired"):
        training.boosted_trees(rows, rows, patience=3, min_iterations=5, maxIter=6, maxDepth=1)


def test_stages_do_not_depend_on_blocks(spark):
    rows = training.assemble(case_rows(spark), ["a"], ["row_id", "y"]).withColumnRenamed("y", "y_true")
    model, _ = boosting.fit(training.with_class_weight(rows, balanced=False), rows, patience=9,
                            maxIter=7, stepSize=0.3, seed=3, maxDepth=2)
    got = [{(r.row_id, r.stage): round(r.score_raw, 9)
            for r in boosting.stage_scores(model, rows, ["row_id"], block=b).collect()} for b in (2, 50)]
    assert got[0] == got[1] and len(got[0]) == 7 * 600


def test_levels_are_split_by_sets(spark):
    rows = case_rows(spark)
    state = prep.fit("tree", rows, ["c"])
    x = training.laid_out(training.design(state, rows, ["row_id", "y"]).withColumnRenamed("y", "y_true"),
                          "row_id")
    assert boosting.nominal_sizes(x) == [9]  # seven levels, an unseen one, a missing one
    model, _ = training.boosted_trees(x, x, min_iterations=0, maxIter=1, maxDepth=1,
                                      subsamplingRate=1.0, featureSubsetStrategy="all")
    new = spark.createDataFrame([(1, "v1"), (2, "v4"), (3, "v0"), (4, "never seen"), (5, None), (6, "")],
                                "row_id long, c string")
    score = {r.row_id: r.score_raw for r in training.positive_score(
        model, training.design(state, new, ["row_id"]), ["row_id"]).collect()}
    assert score[1] == score[2] > score[3]
    assert len(score) == 6 and all(np.isfinite(s) for s in score.values())


def test_large_columns_are_ordered_by_outcome(spark):
    rows = case_rows(spark)
    plain = prep.fit("tree", rows, ["c", "wide"])
    state = training.native_levels(plain, rows, "y", limit=100)
    mean = {r["wide"]: r["m"] for r in rows.groupBy("wide").agg(F.avg("y").alias("m")).collect()}
    assert state.sizes()["wide"]["mode"] == "mean" and state.sizes()["c"]["mode"] == "codes"
    names = state.feature_names()
    new = rows.limit(50).unionByName(spark.createDataFrame(
        [(9001, "x", 1.0, "v1", "unseen", 0), (9002, "x", 1.0, "v1", None, 0)], rows.schema))
    wide = {r.row_id: r.wide for r in new.collect()}
    for r in training.design(state, new, ["row_id"]).collect():
        at = r.features.toArray()[names.index("wide")]
        w = wide[r.row_id]
        assert at == (training.NO_LEVEL if w is None else mean.get(w, training.UNSEEN))
    assert training.native_levels(plain, rows, "y", limit=300) is plain


@pytest.mark.parametrize("bootstrap", [True, False])
def test_a_forest_does_not_depend_on_partitions(spark, bootstrap):
    rows = training.assemble(case_rows(spark), ["a"], ["row_id", "y"]).withColumnRenamed("y", "y_true")
    got = []
    for parts in (2, 5):
        model = forest.fit(rows.repartition(parts, "row_id"), numTrees=5, seed=1, maxDepth=3,
                           bootstrap=bootstrap, featureSubsetStrategy="all")
        got.append({r.row_id: round(float(r.probability[1]), 9) for r in model.transform(rows).collect()})
    assert got[0] == got[1] and len(set(got[0].values())) > 3
    weights = forest.tree_weights(rows, 5, bootstrap).collect()
    for t in range(5):
        own = [r for r in weights if r.tree == t]
        total = sum(r.drawn for r in own)
        assert all(abs(r.weight * r.drawn - total / 2) < 1e-6 for r in own)  # each class has half
    assert len({r.drawn for r in weights if r.y_true == 1}) == (5 if bootstrap else 1) or bootstrap


def test_draws_of_all_trees_are_made_once(spark, monkeypatch):
    rows = training.assemble(case_rows(spark), ["a"], ["row_id", "y"]).withColumnRenamed("y", "y_true")
    unnamed = rows.withColumn("row_id", F.when(F.col("row_id") % 5 != 0, F.col("row_id")))
    both = forest.with_lanes(unnamed).select(
        forest.all_draws(7)("_l0", "_l1").alias("got"),
        F.array(*[forest.draws(F.lit(t)) for t in range(7)]).alias("want")).collect()
    assert both and all(list(r.got) == list(r.want) for r in both)

    read = []

    class Spy(forest.RandomForestClassifier):
        def fit(self, here):
            read.append(here._jdf.queryExecution().optimizedPlan().toString())
            return super().fit(here)
    monkeypatch.setattr(forest, "RandomForestClassifier", Spy)
    forest.fit(rows, numTrees=3, seed=1, maxDepth=2)
    assert len(read) == 3 and not any(str(hashing.MIX_A) in plan for plan in read)


def test_a_forest_needs_both_classes(spark):
    rows = training.assemble(case_rows(spark), ["a"], ["row_id", "y"]).withColumn("y_true", F.lit(1))
    with pytest.raises(ValueError, match="both classes"):
        forest.fit(rows, numTrees=2, seed=1)


@pytest.mark.parametrize("model,options", [
    ("random_forest", {"numTrees": 3}), ("boosted_trees", {"maxIter": 3, "min_iterations": 0})])
def test_trees_are_saved_and_loaded(spark, tmp_path, model, options):
    rows = case_rows(spark)
    cell = training.train_cell(rows, model, "y", ["a", "c"], maxDepth=3, **options)
    cell.save(str(tmp_path / "cell"))
    back = training.Cell.load(spark, str(tmp_path / "cell"))
    a, b = ({r.row_id: r.score_raw for r in c.score(rows).collect()} for c in (cell, back))
    assert a == b


def test_a_stream_scores_every_case_once(spark, tmp_path):
    rows = case_rows(spark)
    cell = training.train_cell(rows, "boosted_trees", "y", ["a", "c"], maxIter=3, maxDepth=2,
                               min_iterations=0)
    folder, sink, at = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    rows.where("row_id < 300").repartition(3).write.parquet(folder)
    source = case_stream(spark, folder, spark.read.parquet(folder).schema, files_per_batch=1)
    score_stream(source, cell, sink, at).awaitTermination()
    assert read_scores(spark, sink).count() == 300
    # A batch that is written again replaces what it wrote before.
    rows.where("row_id >= 300").repartition(2).write.mode("append").parquet(folder)
    (tmp_path / "checkpoint" / "commits" / "2").unlink()
    for crc in (tmp_path / "checkpoint" / "commits").glob(".2.crc"):
        crc.unlink()
    score_stream(source, cell, sink, at).awaitTermination()
    got = {r.row_id: round(r.score_raw, 9) for r in read_scores(spark, sink).collect()}
    assert read_scores(spark, sink).count() == len(got) == 600
    assert got == {r.row_id: round(r.score_raw, 9) for r in cell.score(rows).collect()}


def test_positions_run_through_a_folder(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(1000).withColumnRenamed("id", "k").repartitionByRange(5, "k").sortWithinPartitions(
        "k").write.parquet(path)
    got = tables.with_row_position(spark, path)
    assert got.columns == ["k", "row_id"]
    assert all(r.k == r.row_id for r in got.collect()) and got.count() == 1000


def test_rows_alike_are_merged_without_changing_a_fit(spark, monkeypatch):
    rows = case_rows(spark).withColumns({"a": (F.col("a") > 2).cast("int"), "b": F.col("row_id") % 3})
    x = training.assemble(rows, ["a", "b"], ["row_id", "y"], {"b": 40}).withColumnRenamed("y", "y_true")
    weighted = training.with_class_weight(x, balanced=False)
    read, plain = [], boosting.with_margin
    monkeypatch.setattr(boosting, "with_margin",
                        lambda r, t, w: read.append(r.count()) or plain(r, t, w))
    options = dict(patience=9, maxIter=4, stepSize=0.3, seed=3, maxDepth=2, maxBins=64,
                   featureSubsetStrategy="all")
    def scores(model):
        each = x.dropDuplicates(["features"])
        return {str(r.features): round(r.probability[1], 9) for r in model.transform(each).collect()}
    # Rows of 12 kinds: a fit read all 600 for every tree, and in every stage.
    monkeypatch.setattr(boosting, "ALIKE", 1)
    model, values = boosting.fit(weighted, x, **options)
    assert 40 <= max(read) < 600 and len(values) == 4
    monkeypatch.setattr(boosting, "ALIKE", 1 << 40)
    read.clear()
    apart, apart_values = boosting.fit(weighted, x, **options)
    assert set(read) == {600} and scores(model) == scores(apart)
    assert values == pytest.approx(apart_values)
    # Trees that sample or count rows get each of them.
    monkeypatch.setattr(boosting, "ALIKE", 1)
    for more in ({"subsamplingRate": 0.5}, {"minInstancesPerNode": 2}):
        read.clear()
        boosting.fit(weighted, x, **{**options, "maxIter": 2, **more})
        assert set(read) == {600}

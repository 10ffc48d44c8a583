import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortry.functions.text import WORD, number_text, value_text, word_count
from cohortry.operators import audit, harmonize, passages, split, training, vectors
from cohortry.session import settle
from cohortry.sources import fields, sinks, tables


def as_text(x):
    return str(int(x)) if x.is_integer() else "%.10g" % x


def test_numbers_read_as_in_the_template(spark):
    random.seed(5)
    values = [58.0, 58.5, 0.7300000000000001, -0.25, 1e-4, 1.5e-5, 12345678901.5, -1e20 / 3e9, 0.0,
              -0.0, 1e15, 99999999999.5, 0.1 + 0.2, 123456.7890123, 9.99999999999, 2.5e-3, 1e-9]
    values += [random.uniform(-1, 1) * 10 ** random.randint(-8, 12) for _ in range(400)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = [r.t for r in df.select(number_text(F.col("x")).alias("t")).collect()]
    assert got == [as_text(v) for v in values]


def test_empty_text_and_nan_are_missing(spark):
    df = spark.createDataFrame([(" a b\t", float("nan")), ("  ", 1.0), (None, None)],
                               "s string, x double")
    rows = df.select(value_text(F.col("s"), T.StringType()).alias("s"),
                     value_text(F.col("x"), T.DoubleType()).alias("x")).collect()
    assert [tuple(r) for r in rows] == [("a b", None), (None, "1"), (None, None)]


def test_sentence_names_every_field(spark):
    df = spark.createDataFrame([(1, 58.0, None)], "row_id long, a double, b string")
    row = passages.sentences(df, {"a": "Age", "b": "Sex"}).first()
    assert row.text == "This patient's Age is 58, Sex is undefined."
    assert passages.sentences(df, {"a": "Age"}, ["a"]).first().text == (
        "This patient's Age is undefined.")
    with pytest.raises(ValueError):
        passages.sentences(df, {"a": "Age"}, ["zzz"])


def greedy(costs, budget, overhead):
    out, chunk, used, n = [], 0, overhead, 0
    for c in costs:
        if n and used + c > budget:
            chunk, used = chunk + 1, overhead
        out.append(chunk)
        used, n = used + c, n + 1
    return out


@pytest.mark.parametrize("budget", [10, 40, 480])
def test_packing_is_greedy_and_never_empty(spark, budget):
    costs = [int(x) for x in np.random.default_rng(budget).integers(3, 30, 73)]
    df = spark.createDataFrame([(i, f"f{i}", c) for i, c in enumerate(costs)],
                               "pos int, column string, cost int")
    got = [r.chunk for r in passages.pack(df, budget, 6).orderBy("pos").collect()]
    assert got == greedy(costs, budget, 6)


def test_fixed_fields(spark):
    assert len(fields.FIELD_LABELS) == 73 and len(fields.model_fields()) == 69
    assert [len(g) for g in fields.passage_groups()] == [33, 27, 13]
    actions = {r.build_action: r["count"] for r in fields.spec_table(spark).groupBy(
        "build_action").count().collect()}
    assert sorted(actions.values()) == [2, 4, 15, 52]


def test_rules_read_recorded_values_only(spark):
    df = spark.createDataFrame(
        [(None, "Yes", "No", 40.0, 5.9), (None, "No", "No", None, None),
         ("Urgent", None, None, 30.0, None)],
        "CASETYPE string, EMERGNCY string, ELECTSURG string, PRHCT double, HEMO double")
    a, b, c = harmonize.apply_rules(df).collect()
    assert (a.CASETYPE, a.PRHEMO_A1C, a.PRHEMOGLOBIN) == ("Emergent", 5.9, pytest.approx(13.2))
    assert (b.CASETYPE, b.PRHEMOGLOBIN) == ("Elective", None)
    assert (c.CASETYPE, c.EMERGNCY, c.ELECTSURG) == ("Urgent", "No", "No")


def test_union_fills_absent_columns(spark):
    out = harmonize.union_years([spark.range(2).withColumn("a", F.lit(1)), spark.range(1)])
    assert out.where("a IS NULL").count() == 1 and out.count() == 3


@pytest.mark.parametrize("n,frac", [(997, 0.05), (40, 0.05), (1000, 0.333)])
def test_split_sizes_and_disjointness(spark, n, frac):
    df = spark.range(n).select(F.col("id").alias("row_id"), (F.col("id") % 7 == 0).cast("int")
                               .alias("y")).repartition(5)
    s = split.stratified_split(df, "y", fraction=frac)
    val = s.where("split = 'val'")
    assert val.count() == int(np.ceil(n * frac)) and s.count() == n
    share = val.agg(F.avg("y")).first()[0]
    assert abs(share - df.agg(F.avg("y")).first()[0]) < 1 / val.count()
    again = split.stratified_split(df.repartition(3), "y", fraction=frac)
    assert again.exceptAll(s).count() == 0
    assert split.split_audit(df, s).where("n_bad > 0").count() == 0
    assert split.split_audit(df, s.where("split = 'fit'")).where("n_bad > 0").count() == 2


@pytest.mark.parametrize("range_rows", [10**9, 20])
def test_gaps_equal_brute_force(spark, range_rows):
    r = np.random.default_rng(8)
    lo = r.integers(0, 480, 60)
    rows = [(int(a), int(a + k)) for a, k in zip(lo, r.integers(0, 9, 60))]
    covered = np.zeros(500, bool)
    for a, b in rows:
        covered[a:b] = True
    gaps = audit.interval_gaps(spark.createDataFrame(rows, "lo long, hi long"), 500,
                               range_rows=range_rows).collect()
    found = np.zeros(500, bool)
    for g in gaps:
        assert not covered[g.gap_lo:g.gap_hi].any()
        found[g.gap_lo:g.gap_hi] = True
    assert (found == ~covered).all()


def test_pooled_vectors_have_unit_norm_and_scaler_is_exact(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(60, 5))
    x[:, 3] = 0
    df = spark.createDataFrame([(i // 3, i % 3, [float(v) for v in row]) for i, row in enumerate(x)],
                               "row_id long, chunk int, vec array<double>")
    pooled = vectors.pool_chunks(df)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = unit.reshape(20, 3, 5).mean(axis=1)
    want /= np.linalg.norm(want, axis=1, keepdims=True)
    got = np.array([r.vec for r in pooled.orderBy("row_id").collect()])
    np.testing.assert_allclose(got, want, atol=1e-12)
    scaler = vectors.fit_scaler(pooled).orderBy("dim").toPandas()
    std = want.std(axis=0)
    np.testing.assert_allclose(scaler.scale, np.where(std < 1e-8, 1, std))
    z = np.array([r.vec for r in vectors.apply_scaler(pooled, vectors.fit_scaler(pooled)).collect()])
    np.testing.assert_allclose(z.mean(axis=0), 0, atol=1e-9)


def test_best_iteration_waits_for_patience():
    def curve(values):
        return dict(enumerate(values))
    assert training.best_stage(curve([.1, .3, .2, .2, .9]), patience=2) == 1
    assert training.best_stage(curve([.1, .3, .2, .2, .9]), patience=9) == 4
    assert training.best_stage(curve([.3, .3, .3]), patience=9) == 0


def test_boosting_scores_only_the_best_trees(spark):
    df = spark.range(400).select(
        F.col("id").alias("row_id"), (F.rand(1) * 4).alias("a"), F.lit("main").alias("cohort"))
    df = df.withColumn("y", ((F.col("a") > 2.5) | (F.rand(2) < 0.1)).cast("int")).cache()
    cell = training.train_cell(df, "boosted_trees", "y", ["a"], maxIter=6, maxDepth=2,
                               min_iterations=0)
    at = cell.meta["best_iteration"]
    rows = training.design(cell.state, df, ["row_id"])
    stages = training.stage_scores(cell.fitted, rows, ["row_id"]).where(F.col("stage") == at)
    want = {r.row_id: 1 / (1 + np.exp(-2 * r.score_raw)) for r in stages.collect()}
    for r in cell.score(df).collect():
        assert abs(r.score_raw - want[r.row_id]) < 1e-12
    one = training.positive_score(cell.fitted, rows, ["row_id"], 0)
    first = training.stage_scores(cell.fitted, rows, ["row_id"]).where("stage = 0")
    assert {r.row_id: round(r.score_raw, 9) for r in one.collect()} == {
        r.row_id: round(1 / (1 + np.exp(-2 * r.score_raw)), 9) for r in first.collect()}
    assert training.inference_summary(cell.score(df)).first().auroc > 0.9


def test_settled_tables_are_broadcast_by_bytes(spark):
    small, large = settle(spark.range(10)), settle(spark.range(10), max_bytes=50)
    assert small.count() == large.count() == 10
    plans = [d._jdf.queryExecution().analyzed().toString().lower() for d in (small, large)]
    assert "hint" in plans[0] and "hint" not in plans[1]


def test_readers_refuse_wrong_tables(spark, tmp_path):
    df = spark.range(5).withColumnRenamed("id", "row_id")
    assert tables.checked_count(df, 5) == 5
    with pytest.raises(ValueError):
        tables.checked_count(df, 6)
    with pytest.raises(ValueError):
        tables.require_unique(df.union(df))
    tables.require_unique(df)
    s = df.select("row_id", F.lit("y").alias("label"), F.lit("fit").alias("split"))
    sinks.write_split(s, str(tmp_path / "s"))
    with pytest.raises(ValueError, match="val_empty"):
        sinks.read_split(spark, str(tmp_path / "s"), "y", df)
    plan = spark.createDataFrame([(0, "a", 3, 0), (1, "b", 3, 0)], "pos int, column string, cost int, chunk int")
    passages.save_plan(plan, str(tmp_path / "plan"), ["a"])
    passages.check_plan(spark, str(tmp_path / "plan"), ["a"], ["a", "b"])
    for masked, columns in (([], ["a", "b"]), (["a"], ["a"]), (["a"], ["a", "b", "c"])):
        with pytest.raises(ValueError, match="recalibrate"):
            passages.check_plan(spark, str(tmp_path / "plan"), masked, columns)
    with pytest.raises(ValueError, match="no scaler"):
        one = spark.createDataFrame([(0, 0.0, 1.0)], "dim int, mean double, scale double")
        sinks.write_scaler(one, str(tmp_path / "sc"), "e", "y")
        sinks.read_scaler(spark, str(tmp_path / "sc"), "e", "z")
    with pytest.raises(ValueError):
        passages.require_labels(["a"], {"b": "B"})


def test_rewriting_one_cell_leaves_the_others(spark, tmp_path):
    path = str(tmp_path / "p")
    rows = spark.range(4).select(F.lit("c").alias("cohort"), F.lit("m").alias("model"),
                                 F.concat(F.lit("y"), F.col("id") % 2).alias("label"),
                                 F.col("id").alias("row_id"), F.lit(0).alias("y_true"),
                                 F.lit(0.5).alias("score_raw"))
    sinks.write_predictions(rows, path)
    sinks.write_predictions(rows.where("label = 'y0' AND row_id = 0"), path)
    assert sinks.read_cells(spark, path).count() == 3
    assert sinks.discover(spark, path).count() == 2


def test_wide_texts_are_not_broadcast_however_few(spark):
    wide = spark.range(3).select(F.repeat(F.lit("x"), 1000).alias("t"))
    fixed = settle(wide, max_bytes=2000)
    assert "hint" not in fixed._jdf.queryExecution().analyzed().toString().lower()


def test_forest_does_not_depend_on_the_layout(spark):
    df = spark.range(600).select(F.col("id").alias("row_id"), F.lit("main").alias("cohort"),
                                 (F.hash("id") % 97).cast("double").alias("a"),
                                 (F.hash("id", F.lit(1)) % 89).cast("double").alias("b"))
    df = df.withColumn("y", (F.abs(F.hash("row_id", F.lit(2))) % 3 == 0).cast("int"))
    sums = []
    for parts in (2, 5):
        cell = training.train_cell(df.repartition(parts), "random_forest", "y", ["a", "b"],
                                   numTrees=5, maxDepth=3, minInstancesPerNode=5)
        sums.append(cell.score(df).agg(F.sum("score_raw")).first()[0])
    assert sums[0] == pytest.approx(sums[1], abs=1e-9)


def test_saved_cells_and_states_are_published_whole(spark, tmp_path):
    df = spark.range(300).select(F.col("id").alias("row_id"), F.lit("main").alias("cohort"),
                                 (F.col("id") % 17).cast("double").alias("a"),
                                 (F.col("id") % 3 == 0).cast("int").alias("y"))
    path = str(tmp_path / "cell")
    cell = training.train_cell(df, "random_forest", "y", ["a"], numTrees=2, maxDepth=2,
                               minInstancesPerNode=1)
    cell.save(path)
    cell.save(path)  # a second version beside the first
    back = training.Cell.load(spark.newSession(), path)
    assert (back.model, back.label, back.meta) == (cell.model, cell.label, cell.meta)
    assert sorted(map(tuple, back.score(df).collect())) == sorted(map(tuple, cell.score(df).collect()))


def test_grid_run_skips_finished_cells(spark, tmp_path):
    df = spark.range(400).select(F.col("id").alias("row_id"), F.lit("main").alias("cohort"),
                                 (F.col("id") % 17).cast("double").alias("a"),
                                 (F.col("id") % 3 == 0).cast("int").alias("y"),
                                 (F.col("id") % 5 == 0).cast("int").alias("z"))
    path = str(tmp_path / "grid")
    run = (df, df, ["logistic_regression"])
    assert training.run_grid(*run, ["y"], ["a"], path) == [("logistic_regression", "y")]
    assert training.run_grid(*run, ["y", "z"], ["a"], path) == [("logistic_regression", "z")]
    assert sinks.read_cells(spark, f"{path}/val").select("label").distinct().count() == 2
    assert sinks.read_cells(spark, f"{path}/test").count() == 800
    assert spark.read.parquet(f"{path}/split").where("label = 'y'").count() == 400


def test_work_tables_are_removed(spark):
    from cohortry import session
    path = session.work_path(spark, "gone")
    spark.range(3).write.parquet(path)
    before, session._made[:] = list(session._made), [path]
    session.clear_work(spark)
    session._made[:] = [p for p in before if p != path]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)
    with pytest.raises(ValueError):
        session.remove_work(spark, "/elsewhere/data")


def test_words_are_counted_as_the_expression_finds_them(spark):
    rng = random.Random(3)
    signs = "ab Z9 \t\n\x0b\f\r.,-_\x00\x1c\x85\xa0é日𝄞 "
    texts = [None, "", " ", "a", "a", "b-", "12 ab,", None, *[
        "".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(500)]]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string").repartition(3)
    counted = df.withColumns({"n": word_count(F.col("t")), "m": F.regexp_count("t", F.lit(WORD))})
    assert all(r.n == r.m for r in counted.collect()) and counted.schema["n"].dataType == T.IntegerType()
    # Each match as a text of its own took most of the time of an audit.
    audit_plan = passages.truncation_audit(df.withColumnRenamed("t", "text"), ["i"])
    shown = audit_plan._jdf.queryExecution().executedPlan().toString()
    assert "regexp_extract_all" not in shown and "ArrowEvalPython" in shown
    # Texts longer than what is looked at together, and a maximum of several fields.
    long = spark.range(3).select(F.repeat(F.lit("ab, "), 400_000).alias("a"), F.lit("x.y").alias("b"))
    assert [r.n for r in long.select(word_count(F.col("a")).alias("n")).collect()] == [800_000] * 3
    costs = passages.field_costs(long.select("b"), {"b": "Field"}).first()
    assert costs.cost == len(["Field", "is", "x", ".", "y", ","])

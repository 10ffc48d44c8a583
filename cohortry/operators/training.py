"""Model families on MLlib, class weights, and frozen scoring."""

from __future__ import annotations

import json
import math
import time
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.ml import Model
from pyspark.ml.classification import (GBTClassificationModel, LogisticRegression,
                                       LogisticRegressionModel, RandomForestClassificationModel)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.functions.hashing import SEED
from cohortry.functions.missing import normalise_missing
from cohortry.operators import boosting, forest
from cohortry.operators.boosting import best_stage, stage_scores  # noqa: F401
from cohortry.operators.prep import PrepState, fit
from cohortry.operators.ranking import discrimination
from cohortry.operators.split import stratified_split
from cohortry.session import pinned
from cohortry.sources import sinks

# The prespecified hyperparameters.
LR_C, LR_MAX_ITER, LR_TOL = 1.0, 200, 1e-3
RF_PARAMS = {"numTrees": 300, "maxDepth": 20, "minInstancesPerNode": 50,
             "featureSubsetStrategy": "sqrt"}
GBT_PARAMS = {"maxIter": 800, "stepSize": 0.05, "maxDepth": 8, "subsamplingRate": 0.8,
              "featureSubsetStrategy": "0.8"}
PATIENCE, MIN_ITERATIONS = 50, 20
MODEL_KINDS = {m.__name__: m for m in (LogisticRegressionModel, RandomForestClassificationModel,
                                       GBTClassificationModel)}
VIEW_FOR = {"logistic_regression": "linear", "random_forest": "matrix", "boosted_trees": "tree"}
# Rows of a partition of a fit, and partitions at least. The number follows from the rows alone,
# because the layout is part of a seeded model.
FIT_ROWS, FIT_PARTITIONS = 250_000, 8
# A missing number goes to the far left of every split.
MISSING = -1e30
# Levels of a column that trees split by sets; where the others of a larger column stand.
NATIVE_LEVELS = 254
UNSEEN, NO_LEVEL = -1.0, -2.0


def class_weights(rows: DataFrame, keys: Sequence[str] = (), y: str = "y_true") -> DataFrame:
    """(keys, n_rows, n_pos, pos_weight, balanced_pos, balanced_neg)."""
    one = F.col(y).cast("long")
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(one).alias("n_pos"))
    neg = F.col("n_rows") - F.col("n_pos")
    return counts.withColumns({
        "pos_weight": neg / F.greatest(F.col("n_pos"), F.lit(1)),
        "balanced_pos": F.try_divide(F.col("n_rows"), 2 * F.col("n_pos")),
        "balanced_neg": F.try_divide(F.col("n_rows"), 2 * neg)})


def with_class_weight(rows: DataFrame, balanced: bool, y: str = "y_true") -> DataFrame:
    w = class_weights(rows, y=y).first()
    if not 0 < w.n_pos < w.n_rows:
        raise ValueError("training rows need both classes")
    pos, neg = (w.balanced_pos, w.balanced_neg) if balanced else (w.pos_weight, 1.0)
    return rows.withColumn("weight", F.when(F.col(y) == 1, float(pos)).otherwise(float(neg)))


def assemble(df: DataFrame, features: Sequence[str], keep: Sequence[str],
             nominal: Mapping[str, int] | None = None) -> DataFrame:
    """(keep.., features) with one vector per row. ``nominal`` has the number of codes of the
    features that are codes without an order: trees split those by sets of codes."""
    sizes = nominal or {}
    plain = {}
    for i, c in enumerate(features):
        about = {"ml_attr": {"type": "nominal", "num_vals": sizes[c]}} if c in sizes else None
        x = F.col(f"`{c}`").cast("double")
        plain[f"x{i}"] = x.alias(f"x{i}", metadata=about) if about else x.alias(f"x{i}")
    rows = df.select(*keep, *plain.values())
    out = VectorAssembler(inputCols=list(plain), outputCol="features").transform(rows)
    return out.select(*keep, "features")


def native_levels(state: PrepState, rows: DataFrame, label: str,
                  limit: int = NATIVE_LEVELS) -> PrepState:
    """The tree state with the levels of large columns placed by the mean outcome of their fit
    rows. Trees split columns of up to ``limit`` levels by sets of codes, which needs a bin for
    each level; a larger column is split along this order."""
    large = [c for c in state.cat_cols if state.sizes().get(c, {}).get("n", 0) > limit]
    if not large:
        return state
    entries = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("level"))
               for c in large]
    seen = normalise_missing(rows.select(label, *large)).select(
        F.col(label).alias("y"), F.inline(F.array(*entries))).where("level IS NOT NULL")
    means = seen.groupBy("column", "level").agg(F.avg("y").alias("by_mean"))
    levels = state.levels.join(means, ["column", "level"], "left").withColumns({
        "mode": F.when(F.col("column").isin(large), "mean").otherwise(F.col("mode")),
        "freq": F.when(F.col("column").isin(large), F.coalesce("by_mean", F.lit(UNSEEN)))
        .otherwise(F.col("freq"))}).select(*state.levels.columns)
    return PrepState(state.view, state.num_cols, state.cat_cols, state.numeric, pinned(levels))


def design(state: PrepState, df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Features of a fitted state as vectors.

    In the tree view a level is its code, an unseen level and a missing one are two further codes,
    and the vector says which features are codes. Levels of a large column are their mean outcome
    (``native_levels``), with an unseen and a missing one below all means.
    """
    if state.view != "tree":
        return assemble(state.transform(df, keep), state.feature_names(), keep)
    sizes = state.sizes()
    large = [c for c in state.cat_cols if sizes.get(c, {}).get("mode") == "mean"]
    small = [c for c in state.cat_cols if c not in large]
    has = {f"_has{i}": F.col(c).isNotNull() for i, c in enumerate(state.cat_cols)}
    mark = dict(zip(state.cat_cols, has))
    rows = normalise_missing(df.select(*keep, *state.num_cols, *state.cat_cols)).withColumns(has)
    numbers = PrepState("tree", state.num_cols, [], None, state.levels)
    out = numbers.transform(rows, [*keep, *state.cat_cols, *has]).na.fill(MISSING, state.num_cols)
    codes = PrepState("matrix", [], small, None, state.levels)
    out = codes.transform(out, [*keep, *state.num_cols, *large, *has])
    counts = {c: sizes.get(c, {}).get("n", 0) for c in small}
    for c in large:
        out = out.withColumn(c, F.col(c).cast("string")).join(
            state.lookup(c, "freq"), c, "left").withColumn(c, F.col("_value")).drop("_value")
    out = out.withColumns({
        **{c: F.when(~F.col(mark[c]), n + 1).when(F.col(c) < 0, n).otherwise(F.col(c))
           for c, n in counts.items()},
        **{c: F.when(~F.col(mark[c]), NO_LEVEL).otherwise(F.coalesce(F.col(c), F.lit(UNSEEN)))
           for c in large}})
    return assemble(out, state.feature_names(), keep, {c: n + 2 for c, n in counts.items()})


def positive_score(model: Model, df: DataFrame, keep: Sequence[str],
                   best_iteration: int | None = None) -> DataFrame:
    """(keep.., score_raw): the raw model output. It ranks; it is no risk.

    With ``best_iteration`` only the trees up to that one are read.
    """
    if best_iteration is not None:
        model = boosting.first_trees(model, best_iteration + 1)
    return model.transform(df).select(*keep, vector_to_array("probability")[1].alias("score_raw"))


def logistic_regression(rows: DataFrame, c: float = LR_C, **params) -> Model:
    """L2-penalised, class-balanced. MLlib averages the loss, so the penalty is
    1 / (C * sum of weights)."""
    weighted = with_class_weight(rows, balanced=True)
    total = weighted.agg(F.sum("weight")).first()[0]
    est = LogisticRegression(
        featuresCol="features", labelCol="y_true", weightCol="weight", elasticNetParam=0.0,
        regParam=1.0 / (c * total), standardization=False,
        **{"maxIter": LR_MAX_ITER, "tol": LR_TOL, **params})
    return est.fit(weighted)


def random_forest(rows: DataFrame, seed: int = SEED, **params) -> Model:
    """Resampled per tree, with the classes balanced in each resample."""
    return forest.fit(rows, seed=seed, **{**RF_PARAMS, **params})


def boosted_trees(rows: DataFrame, val: DataFrame, seed: int = SEED, patience: int = PATIENCE,
                  min_iterations: int = MIN_ITERATIONS, **params) -> tuple[Model, int]:
    """Boosting stopped on validation average precision: (model, best iteration).

    Not on the weighted loss, which rises from the first tree on. Fitting ends ``patience``
    trees past the best one. The model keeps the trees that were fitted; ``positive_score`` reads
    those up to the best iteration, so there is no second fit and a new site cannot be scored
    with more trees than were evaluated.
    """
    model, values = boosting.fit(with_class_weight(rows, balanced=False), val, seed=seed,
                                 patience=patience, **{**GBT_PARAMS, **params})
    at = best_stage(values, patience)
    if at < min_iterations:
        raise ValueError(f"early stopping fired at iteration {at} of {len(model.trees)}")
    return model, at


def laid_out(df: DataFrame, row_id: str) -> DataFrame:
    """Rows for an iterative fit, in a layout that follows from their keys alone.

    MLlib draws its samples per partition in the order of the rows. Dealt by key into a number
    of partitions that the row count gives, and sorted there, the same rows and seed give the
    same model whatever files or cores they came from. Pinned, so that a lost executor
    recomputes nothing.
    """
    parts = max(FIT_PARTITIONS, math.ceil(df.count() / FIT_ROWS))
    return pinned(df.repartition(parts, row_id).sortWithinPartitions(row_id))


CELL_HEAD = "version string, published long, model string, label string, kind string, meta string"


@dataclass
class Cell:
    """One fitted (model, label): the frozen preprocessing and the frozen model."""
    model: str
    label: str
    state: PrepState
    fitted: Model
    meta: dict

    def score(self, df: DataFrame, keep: Sequence[str] = ("cohort", "row_id")) -> DataFrame:
        """Predictions for any table with the fitted columns. Fits nothing."""
        return self.score_design(design(self.state, df, [*keep, self.label]), keep)

    def score_design(self, vectors: DataFrame, keep: Sequence[str]) -> DataFrame:
        out = positive_score(self.fitted, vectors, [*keep, self.label],
                             self.meta.get("best_iteration"))
        return out.select(
            *keep, F.lit(self.model).alias("model"), F.lit(self.label).alias("label"),
            F.col(self.label).cast("int").alias("y_true"), "score_raw")

    def save(self, path: str) -> None:
        """Writes model, state and metadata as a new version and publishes it last."""
        spark, version = self.state.levels.sparkSession, uuid.uuid4().hex
        self.fitted.write().save(f"{path}/{version}/model")
        self.state.save(f"{path}/{version}/state")
        spark.createDataFrame(
            [(version, time.time_ns(), self.model, self.label, type(self.fitted).__name__,
              json.dumps(self.meta))], CELL_HEAD).coalesce(1).write.mode("append").json(
            f"{path}/head")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "Cell":
        """The version published last, with nothing taken from the session that fitted it."""
        head = spark.read.schema(CELL_HEAD).json(f"{path}/head").orderBy(
            F.desc("published"), "version").first()
        fitted = MODEL_KINDS[head.kind].load(f"{path}/{head.version}/model")
        return Cell(head.model, head.label, PrepState.load(spark, f"{path}/{head.version}/state"),
                    fitted, json.loads(head.meta))


@dataclass
class Trained:
    """A cell with its split, as (row_id, label, split)."""
    cell: Cell
    split: DataFrame
    val_rows: DataFrame


def train(df: DataFrame, model: str, label: str, columns: Sequence[str],
          state: PrepState | None = None, row_id: str = "row_id",
          min_iterations: int = MIN_ITERATIONS, **params) -> Trained:
    """Split, fit the view on the fit rows, fit the model. ``state`` reuses a view."""
    tagged = stratified_split(df, label, row_id)
    fit_rows = tagged.where(F.col("split") == "fit")
    val_rows = tagged.where(F.col("split") == "val")
    state = state or fit(VIEW_FOR[model], fit_rows, columns, row_id)
    if state.view == "tree":
        state = native_levels(state, fit_rows, label)

    def vectors(rows: DataFrame) -> DataFrame:
        return design(state, rows, [row_id, label]).withColumnRenamed(label, "y_true")

    x = laid_out(vectors(fit_rows), row_id)
    sizes = x.agg(F.count(F.lit(1)), F.sum("y_true")).first()
    meta = {"n_fit": int(sizes[0]), "n_fit_pos": int(sizes[1] or 0), "columns": list(columns)}
    if model == "logistic_regression":
        fitted = logistic_regression(x, **params)
        n_iter = int(fitted.summary.totalIterations)
        meta |= {"n_iter": n_iter, "converged": n_iter < fitted.getMaxIter()}
    elif model == "random_forest":
        fitted = random_forest(x, **params)
    elif model == "boosted_trees":
        fitted, at = boosted_trees(x, pinned(vectors(val_rows)), min_iterations=min_iterations,
                                   **params)
        meta |= {"best_iteration": at}
    else:
        raise ValueError(f"unknown model: {model}")
    split = tagged.where(F.col("split").isNotNull()).select(
        row_id, F.lit(label).alias("label"), "split")
    return Trained(Cell(model, label, state, fitted, meta), split, val_rows)


def train_cell(df: DataFrame, model: str, label: str, columns: Sequence[str], **options) -> Cell:
    """The cell of ``train``."""
    return train(df, model, label, columns, **options).cell


def run_grid(df: DataFrame, tests: DataFrame, models: Sequence[str], labels: Sequence[str],
             columns: Sequence[str], path: str, row_id: str = "row_id",
             options: Mapping[str, Mapping] | None = None) -> list[tuple[str, str]]:
    """Trains every (model, label) that ``path`` has no finished cell of; returns those trained.

    For each cell it writes the model with its state, the split, and the predictions for the
    validation rows and for ``tests`` (tables ``val`` and ``test`` of ``path``). The metadata
    row comes last: it is what marks a cell as finished. The loop runs over the grid, a few
    cells; every step of a cell is a job. Both tables are pinned first: each step reads them, and
    would make them, with what their joins broadcast through the driver, anew.
    """
    spark = df.sparkSession
    trained = []
    left = unfinished(models, labels, finished(spark, path)).orderBy("label", "model").collect()
    if left:
        read = list(dict.fromkeys(["cohort", row_id, *labels, *columns]))
        df, tests = (pinned(rows.select(*read)) for rows in (df, tests))
    for model, label in left:
        done = train(df, model, label, columns, row_id=row_id, **(options or {}).get(model, {}))
        done.cell.save(f"{path}/cells/{model}/{label}")
        sinks.write_cells(done.split.withColumn("model", F.lit(model)), f"{path}/split",
                          ["label", "model"])
        for part, rows in (("val", done.val_rows), ("test", tests)):
            sinks.write_predictions(done.cell.score(rows, ["cohort", row_id]), f"{path}/{part}")
        sinks.append_meta(spark.createDataFrame(
            [(model, label, json.dumps(done.cell.meta))], "model string, label string, facts string"),
            f"{path}/meta", ["model", "label"])
        trained.append((model, label))
    return trained


def finished(spark: SparkSession, path: str) -> DataFrame:
    """(model, label) of the cells whose metadata a grid run has written."""
    try:
        return sinks.read_meta(spark, f"{path}/meta", "model string, label string", "facts string"
                               ).select("model", "label").distinct()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "model string, label string")


def score_cells(cells: Sequence[Cell], df: DataFrame,
                keep: Sequence[str] = ("cohort", "row_id")) -> DataFrame:
    """Predictions of several cells; cells that share a state share its vectors, which are
    pinned in the shared folder."""
    labels = sorted({c.label for c in cells})
    made: list[tuple[PrepState, DataFrame]] = []
    out = None
    for c in cells:
        vectors = next((v for s, v in made if s is c.state), None)
        if vectors is None:
            vectors = pinned(design(c.state, df, [*keep, *labels]))
            made.append((c.state, vectors))
        part = c.score_design(vectors, keep)
        out = part if out is None else out.unionByName(part)
    return out


def inference_summary(pred: DataFrame) -> DataFrame:
    """Counts of every scored cell, and the areas where both classes occur."""
    return discrimination(pred)


def unfinished(models: Sequence[str], labels: Sequence[str], done: DataFrame) -> DataFrame:
    """Grid cells with nothing in ``done`` (model, label): what is left to train."""
    spark = done.sparkSession
    grid = spark.createDataFrame([(m, y) for m in models for y in labels],
                                 "model string, label string")
    return grid.join(done.select("model", "label").distinct(), ["model", "label"], "left_anti")


def probe(rows: DataFrame, **params) -> Model:
    """Class-balanced logistic regression on vectors (a linear probe)."""
    return logistic_regression(rows, **params)



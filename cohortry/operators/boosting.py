"""Boosted trees that stop while they are fitted.

Each tree is one MLlib regression tree on the gradients of the rows, so categories, weights and
bins are MLlib's. Trees are fitted in blocks. The margins of the fit rows and of the validation
rows are columns that are pinned after each block, so no plan holds more trees than a block, and
no row is scored twice by a tree. After a block, the average precision of its stages comes from
one table; no further block is fitted once ``patience`` stages have brought no gain.

A tree cannot tell rows with equal features apart. Where there are few kinds of rows, those of a
kind become a few rows that weigh as much before the first tree, so that trees do not read every row.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.ml.classification import GBTClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressionModel, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.operators.ranking import discrimination
from cohortry.session import pinned

BLOCK = 10
HASH_RANGE = 1 << 30
# Rows of a kind, at least, for which merging them is worth a shuffle.
ALIKE = 4
# Rows of a partition of merged rows, and partitions at least: the layout follows from the rows.
MERGED_ROWS, MERGED_PARTITIONS = 250_000, 8


def ensemble(trees: Sequence[DecisionTreeRegressionModel],
             weights: Sequence[float]) -> GBTClassificationModel:
    """A boosted classifier of these trees: MLlib's own model, to score, save and load."""
    spark = SparkSession.active()
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    held = gateway.new_array(jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, len(trees))
    sizes = gateway.new_array(jvm.double, len(trees))
    for i, (t, w) in enumerate(zip(trees, weights)):
        held[i], sizes[i] = t._java_obj, float(w)
    uid = jvm.org.apache.spark.ml.util.Identifiable.randomUID("gbtc")
    return GBTClassificationModel(
        jvm.org.apache.spark.ml.classification.GBTClassificationModel(uid, held, sizes))


def first_trees(model: GBTClassificationModel, n: int) -> GBTClassificationModel:
    """The model as it was after ``n`` trees."""
    if n >= len(model.trees):
        return model
    return ensemble(model.trees[:n], list(model.treeWeights)[:n])


def with_margin(rows: DataFrame, trees: Sequence, weights: Sequence[float]) -> DataFrame:
    """``rows`` with what these trees add to the column ``margin``; all in one pass."""
    if not trees:
        return rows
    scored = ensemble(trees, weights).transform(rows)
    return scored.withColumn("margin", F.col("margin") + vector_to_array("rawPrediction")[1]).select(
        *rows.columns)


def block_margins(trees: Sequence, weights: Sequence[float], rows: DataFrame, keep: Sequence[str],
                  first: int) -> DataFrame:
    """(keep.., stage, score_raw): the margins after each of a block's trees, the block's first
    tree being number ``first``; ``rows`` has the margin before it."""
    scored, upto = rows, []
    total = F.col("margin")
    for i, (t, w) in enumerate(zip(trees, weights)):
        scored = t.setPredictionCol(f"t{i}").transform(scored)
        total = total + F.col(f"t{i}") * F.lit(float(w))
        upto.append(F.struct(F.lit(first + i).alias("stage"), total.alias("score_raw")))
    return scored.select(*keep, F.inline(F.array(*upto)))


def stage_scores(model: GBTClassificationModel, rows: DataFrame, keep: Sequence[str],
                 block: int = 50) -> DataFrame:
    """(keep.., stage, score_raw): the margin after 1 .. n trees, each tree read once."""
    trees, weights = model.trees, list(model.treeWeights)
    rows = rows.select(*keep, "features", F.lit(0.0).alias("margin"))
    out = None
    for lo in range(0, len(trees), block):
        some, own = trees[lo:lo + block], weights[lo:lo + block]
        part = block_margins(some, own, rows, keep, lo)
        out = part if out is None else out.unionByName(part)
        if lo + block < len(trees):
            rows = pinned(with_margin(rows, some, own))
    return out


def best_stage(values: Mapping[int, float], patience: int) -> int:
    """The stage with the highest value, looking no further than ``patience`` stages past
    the best so far."""
    best, best_at = float("-inf"), -1
    for i in sorted(values):
        if values[i] is not None and values[i] > best:
            best, best_at = values[i], i
        elif i - best_at >= patience:
            break
    return best_at


def drawn(row_id: Column, rate: float, seed: int, tree: int) -> Column:
    """Whether a tree's sample has a row: a hash of its key, so layouts do not matter."""
    place = F.pmod(F.xxhash64(row_id, F.lit(seed), F.lit(tree)), F.lit(HASH_RANGE))
    return place < int(rate * HASH_RANGE)


def nominal_sizes(rows: DataFrame) -> list[int]:
    """The number of levels of each nominal feature, from the metadata of ``features``."""
    attrs = rows.schema["features"].metadata.get("ml_attr", {}).get("attrs", {})
    return [a.get("num_vals") or len(a.get("vals", [])) for a in attrs.get("nominal", [])]


def few_kinds(rows: DataFrame, columns: Sequence[str], shares: int = 1) -> bool:
    """Whether these columns, vectors included, repeat often enough to merge rows into ``shares``
    rows of each kind. A count that may err: it decides how rows are read, never a result."""
    got = rows.agg(F.count(F.lit(1)).alias("n"),
                   F.approx_count_distinct(F.xxhash64(*columns)).alias("kinds")).first()
    return got["kinds"] * shares * ALIKE <= got["n"]


def merged_fit_rows(rows: DataFrame, row_id: str, shares: int) -> DataFrame:
    """(row_id, sign, weight, features) with rows of equal sign, weight and features as up to
    ``shares`` rows that weigh as much together. MLlib wants at least as many rows as a feature
    has levels, therefore the shares. The sums do not depend on the order of rows."""
    share = F.pmod(F.xxhash64(row_id), F.lit(shares)).alias("_share")
    out = rows.groupBy("sign", F.col("weight").alias("_each"), "features", share).agg(
        F.min(row_id).alias(row_id), (F.first("weight") * F.count(F.lit(1))).alias("weight")
    ).select(row_id, "sign", "weight", "features")
    out = pinned(out)
    parts = max(MERGED_PARTITIONS, math.ceil(out.count() / MERGED_ROWS))
    return out.repartition(parts, row_id).sortWithinPartitions(row_id, "sign", "weight")


def fit(rows: DataFrame, val: DataFrame, *, maxIter: int, stepSize: float, seed: int, patience: int,
        subsamplingRate: float = 1.0, row_id: str = "row_id", block: int = BLOCK,
        **tree_params) -> tuple[GBTClassificationModel, dict[int, float]]:
    """(model with the trees that were fitted, precision of each stage).

    ``rows`` (row_id, y_true, weight, features), ``val`` (y_true, features). The first tree is
    fitted to the signs of the outcome, later ones to the gradient of the log-loss and with the
    step size. ``patience`` counts stages; up to ``block - 1`` trees past the stop are fitted.
    Fit rows stay apart where trees sample or count them, or where few are alike.
    """
    sign = (2 * F.col("y_true") - 1).cast("double")
    own = rows.select(row_id, sign.alias("sign"), "weight", "features")
    shares = max([1, *nominal_sizes(rows)])
    apart = subsamplingRate < 1 or tree_params.get("minInstancesPerNode", 1) > 1
    if not apart and few_kinds(own, ["sign", "weight", "features"], shares):
        own = merged_fit_rows(own, row_id, shares)
    own = pinned(own.withColumn("margin", F.lit(0.0)))
    seen = val.select("y_true", "features", F.lit(1).cast("long").alias("stands_for"))
    if few_kinds(seen, ["y_true", "features"]):
        seen = seen.groupBy("y_true", "features").agg(F.sum("stands_for").alias("stands_for"))
    seen = pinned(seen.withColumn("margin", F.lit(0.0)))
    bins = max([32, tree_params.pop("maxBins", 32), *nominal_sizes(rows)])
    gradient = 4 * F.col("sign") / (1 + F.exp(2 * F.col("sign") * F.col("margin")))
    trees, weights, values = [], [], {}
    for lo in range(0, maxIter, block):
        fresh: list = []
        steps = [1.0 if i == 0 else stepSize for i in range(lo, min(lo + block, maxIter))]
        for i, _ in enumerate(steps, lo):
            here = with_margin(own, fresh, steps[:len(fresh)]).withColumn(
                "target", F.col("sign") if i == 0 else gradient)
            if subsamplingRate < 1:
                here = here.where(drawn(F.col(row_id), subsamplingRate, seed, i))
            fitted = RandomForestRegressor(
                numTrees=1, bootstrap=False, subsamplingRate=1.0, seed=seed + i, labelCol="target",
                weightCol="weight", maxBins=bins, cacheNodeIds=False, **tree_params).fit(here)
            fresh.append(fitted.trees[0])
        stages = block_margins(fresh, steps, seen, ["y_true", "stands_for"], lo)
        values |= {r["stage"]: r["auprc"] for r in discrimination(
            stages, ["stage"], weight=F.col("stands_for")).collect()}
        trees, weights = trees + fresh, weights + steps
        if len(trees) - 1 - best_stage(values, patience) >= patience or len(trees) >= maxIter:
            break
        own, seen = (pinned(with_margin(x, fresh, steps)) for x in (own, seen))
    return ensemble(trees, weights), values

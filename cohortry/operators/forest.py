"""Random forests whose classes are balanced anew in every tree's resample.

A row's weight in a tree is its Poisson(1) draw, a hash of its key and the tree, times the
balanced weight of its class among the rows drawn for this tree. So neither files, cores nor a
lost executor change a forest. Each tree is one MLlib tree; some are fitted side by side. The draws
of all trees are made once and kept beside the rows, a byte for each tree: a fit reads its rows
several times.
"""

from __future__ import annotations

from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.util import inheritable_thread_target

from cohortry.functions import hashing
from cohortry.operators.bootstrap import draw_weights
from cohortry.session import pinned

SIDE_BY_SIDE = 4
# Rows whose draws numpy holds at once.
ROWS_AT_ONCE = 1024


def with_lanes(rows: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Adds the hashes of the row key that all draws start from; made once, as the draws of a
    tree name them many times."""
    key = F.col(row_id)
    if not isinstance(rows.schema[row_id].dataType, T.IntegralType):
        key = F.xxhash64(key)
    return rows.withColumns({f"_l{i}": hashing.row_lane(key.cast("long"), i) for i in (0, 1)})


def draws(tree: Column, bootstrap: bool = True) -> Column:
    """How often a tree's resample has a row."""
    if not bootstrap:
        return F.lit(1)
    return hashing.poisson_weight(hashing.draw_hash(F.col("_l0"), F.col("_l1"), tree))


def all_draws(n_trees: int):
    """A function of both lanes: how often each tree's resample has a row, as an array by tree.
    Equals ``draws``, also where a lane is NULL."""
    trees, above = np.arange(n_trees), len(hashing.poisson_cuts())

    @F.arrow_udf("array<tinyint>")
    def times(lane0: pa.Array, lane1: pa.Array) -> pa.Array:
        lanes = [x.fill_null(0).to_numpy(zero_copy_only=False) for x in (lane0, lane1)]
        out = np.empty((len(lane0), n_trees), np.int8)
        for a in range(0, len(out), ROWS_AT_ONCE):
            out[a:a + ROWS_AT_ONCE] = draw_weights(*(x[a:a + ROWS_AT_ONCE] for x in lanes), trees)
        for x in (lane0, lane1):
            if x.null_count:
                out[x.is_null().to_numpy(zero_copy_only=False)] = above
        ends = np.arange(len(out) + 1, dtype=np.int32) * np.int32(n_trees)
        return pa.ListArray.from_arrays(ends, out.reshape(-1))
    return times


def tree_weights(rows: DataFrame, n_trees: int, bootstrap: bool = True,
                 row_id: str = "row_id") -> DataFrame:
    """(tree, y_true, drawn, weight): rows drawn of each class, and the class's weight, for all
    trees in one pass; only sums leave a task."""
    trees = F.explode(F.sequence(F.lit(0), F.lit(n_trees - 1))).alias("tree")
    each = with_lanes(rows, row_id).select("_l0", "_l1", "y_true", trees)
    sums = each.groupBy("tree", "y_true").agg(F.sum(draws(F.col("tree"), bootstrap)).alias("drawn"))
    totals = sums.groupBy("tree").agg(F.sum("drawn").alias("total"))
    return sums.join(totals, "tree").select(
        "tree", "y_true", "drawn", F.try_divide(F.col("total"), 2 * F.col("drawn")).alias("weight"))


def ensemble(trees: list, n_features: int) -> RandomForestClassificationModel:
    """A forest of these trees: MLlib's own model, to score, save and load."""
    spark = SparkSession.active()
    jvm = spark._jvm.org.apache.spark.ml.classification
    held = spark.sparkContext._gateway.new_array(jvm.DecisionTreeClassificationModel, len(trees))
    for i, t in enumerate(trees):
        held[i] = t._java_obj
    made = jvm.RandomForestClassificationModel(held, n_features, 2)
    made.set(made.getParam("numTrees"), len(trees))  # what a loaded model is held against
    return RandomForestClassificationModel(made)


def fit(rows: DataFrame, *, numTrees: int, seed: int, bootstrap: bool = True,
        row_id: str = "row_id", side_by_side: int = SIDE_BY_SIDE, **tree_params
        ) -> RandomForestClassificationModel:
    """A forest on ``rows`` (row_id, y_true, features). A tree that drew one class only has this
    class's rows with weight; both classes must occur."""
    own = with_lanes(rows.select(row_id, "y_true", "features"), row_id)
    times = all_draws(numTrees)("_l0", "_l1") if bootstrap else F.lit(None)
    own = pinned(own.select(row_id, "y_true", "features", times.alias("_times")))
    of_tree: dict[int, dict[int, float]] = {}
    for r in tree_weights(own, numTrees, bootstrap, row_id).collect():  # two rows a tree
        of_tree.setdefault(r["tree"], {})[r["y_true"]] = r["weight"] or 0.0
    if any(len(w) < 2 for w in of_tree.values()) or not of_tree:
        raise ValueError("training rows need both classes")

    def one(tree: int):
        w = of_tree[tree]
        times = F.col("_times")[tree] if bootstrap else F.lit(1)
        here = own.select("y_true", "features", "_times").withColumn("weight", times * F.when(F.col("y_true") == 1, float(w[1]))
                              .otherwise(float(w[0]))).where("weight > 0")
        return RandomForestClassifier(
            numTrees=1, bootstrap=False, subsamplingRate=1.0, seed=seed + tree, labelCol="y_true",
            weightCol="weight", **tree_params).fit(here)

    spark = own.sparkSession
    pool = ThreadPool(min(side_by_side, numTrees))
    try:
        fitted = pool.map(inheritable_thread_target(spark)(one), range(numTrees))
    finally:
        pool.close()
    return ensemble([m.trees[0] for m in fitted], fitted[0].numFeatures)

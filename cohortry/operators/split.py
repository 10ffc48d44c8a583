"""Reproducible stratified splits by row hash, and their audits."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortry.functions.hashing import SEED, hash_key, label_seed, row_lane
from cohortry.session import settle

VAL_FRACTION = 0.05
# Rows that share a bin of the hash histogram, about: what one task ranks.
BIN_ROWS = 10_000


def class_quotas(df: DataFrame, strata: str, fraction: float) -> DataFrame:
    """(stratum, n, quota): ceil(n * fraction) rows over all, shared over the strata
    in proportion, the leftover going to the largest remainders.

    Rows without a stratum take no part. ``strata`` is an outcome: a few classes.
    """
    sizes = df.where(F.col(strata).isNotNull()).groupBy(strata).agg(F.count(F.lit(1)).alias("n"))
    everything = Window.partitionBy(F.lit(0))  # one row per class
    total = F.sum("n").over(everything)
    shared = sizes.withColumn("total", F.ceil(total * F.lit(fraction))).withColumn(
        "share", F.col("total") * F.col("n") / total)
    by_rest = everything.orderBy(F.desc(F.col("share") - F.floor("share")), F.col(strata))
    left = F.col("total") - F.sum(F.floor("share")).over(everything)
    return shared.withColumn("rank", F.row_number().over(by_rest)).withColumn(
        "left", left).select(
        strata, "n",
        (F.floor("share") + F.when(F.col("rank") <= F.col("left"), 1).otherwise(0)).alias("quota"))


def hash_cuts(df: DataFrame, strata: Sequence[str], key: Column, quotas: DataFrame) -> DataFrame:
    """(stratum, cut_key): rows with ``key <= cut_key`` are exactly the quota.

    A histogram of the leading hash digits finds the bin with the last wanted
    row; only that bin is ranked. There are as many digits as leave about
    ``BIN_ROWS`` rows in a bin of the largest stratum. No task orders a whole
    stratum, and tagging the rows afterwards needs no shuffle. Equal keys (rows
    that repeat a row key) fall on one side together.
    """
    strata = list(strata)
    keyed = df.select(*strata, key.alias("key"))
    digits = max(1, math.ceil(math.log(max(1, df.count() / BIN_ROWS), 16)))
    keyed = keyed.withColumn("bin", F.substring("key", 1, digits))
    hist = keyed.groupBy(*strata, "bin").agg(F.count(F.lit(1)).alias("cnt"))
    upto = Window.partitionBy(*strata).orderBy("bin").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    reached = hist.withColumn("cum", F.sum("cnt").over(upto)).join(quotas, strata).where(
        (F.col("quota") > 0) & (F.col("cum") >= F.col("quota")))
    last = settle(reached.groupBy(*strata).agg(
        F.min_by(F.struct("bin", (F.col("quota") - F.col("cum") + F.col("cnt")).alias("need")),
                 "bin").alias("last")).select(*strata, "last.*"))
    inside = keyed.join(last, [*strata, "bin"])
    ranked = inside.withColumn(
        "rank", F.row_number().over(Window.partitionBy(*strata).orderBy("key")))
    return settle(ranked.where(F.col("rank") == F.col("need")).select(
        *strata, F.col("key").alias("cut_key")))


def tag_split(df: DataFrame, strata: Sequence[str], key: Column, cuts: DataFrame,
              inside: str, outside: str, out: str = "split") -> DataFrame:
    tagged = df.withColumn("_key", key).join(cuts, list(strata), "left")
    return tagged.withColumn(
        out, F.when(F.col("_key") <= F.col("cut_key"), inside).otherwise(outside)
    ).drop("_key", "cut_key")


def stratified_split(df: DataFrame, label: str, row_id: str = "row_id",
                     fraction: float = VAL_FRACTION, seed: int = SEED) -> DataFrame:
    """Adds ``split`` (fit / val), stratified on one outcome.

    The rows depend on the outcome's name and values and on the row keys only,
    so every model of an outcome gets the same split. Rows without an outcome
    are in neither part: their ``split`` is NULL.
    """
    key = hash_key(label_seed(label, seed), F.col(row_id))
    known = df.where(F.col(label).isNotNull())
    cuts = hash_cuts(known, [label], key, class_quotas(df, label, fraction))
    tagged = tag_split(df, [label], key, cuts, "val", "fit")
    return tagged.withColumn("split", F.when(F.col(label).isNotNull(), F.col("split")))


def halves(df: DataFrame, keys: Sequence[str], seed: Column | int,
           row_id: str = "row_id") -> DataFrame:
    """Adds ``half``: A for a random floor(n/2) rows of each group, else B."""
    quotas = df.groupBy(*keys).agg(F.floor(F.count(F.lit(1)) / 2).alias("quota"))
    seeded = df.withColumn("_seed", seed if isinstance(seed, Column) else F.lit(seed))
    key = hash_key(F.col("_seed"), F.col(row_id))
    cuts = hash_cuts(seeded, keys, key, quotas)
    return tag_split(seeded, keys, key, cuts, "A", "B", "half").drop("_seed")


def split_audit(rows: DataFrame, split: DataFrame, row_id: str = "row_id") -> DataFrame:
    """(check, n_bad) of a saved split against the rows it must cover."""
    per_row = split.groupBy(row_id).agg(
        F.max(F.when(F.col("split") == "fit", 1).otherwise(0)).alias("in_fit"),
        F.max(F.when(F.col("split") == "val", 1).otherwise(0)).alias("in_val"))
    joined = rows.select(row_id, F.lit(1).alias("wanted")).join(per_row, row_id, "full")
    zero = F.lit(0).cast("long")
    sums = joined.agg(
        F.coalesce(F.sum((F.col("in_fit").isNull()).cast("long")), zero).alias("uncovered"),
        F.coalesce(F.sum((F.col("wanted").isNull()).cast("long")), zero).alias("unknown"),
        F.coalesce(F.sum(F.col("in_fit").cast("long") * F.col("in_val")), zero).alias("overlap"),
        F.when(F.coalesce(F.sum("in_val"), zero) > 0, zero)
        .otherwise(zero + 1).alias("val_empty"))
    checks = ["uncovered", "unknown", "overlap", "val_empty"]
    return sums.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("check"), F.col(c).alias("n_bad")) for c in checks])))


def split_agreement(splits: DataFrame, group: str, member: str,
                    row_id: str = "row_id") -> DataFrame:
    """(group, n_members, n_rows, n_disagree): rows that are not in the same split
    for every member (the models of an outcome)."""
    per_row = splits.groupBy(group, row_id).agg(
        F.count_distinct(member).alias("members"), F.min("split").alias("lo"),
        F.max("split").alias("hi"))
    sizes = splits.groupBy(group).agg(F.count_distinct(member).alias("n_members"))
    odd = (F.col("lo") != F.col("hi")) | (F.col("members") != F.col("n_members"))
    return per_row.join(settle(sizes), group).groupBy(group, "n_members").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(odd).alias("n_disagree"))


def split_fingerprints(splits: DataFrame, keys: Sequence[str], row_id: str = "row_id") -> DataFrame:
    """(keys, n_val, fp_a, fp_b, n_same): order-free fingerprints of the val rows.

    Equal sets have equal fingerprints. ``n_same`` counts the splits that carry
    this one; outcomes that should differ must each have 1.
    """
    val = splits.where(F.col("split") == "val")
    prints = val.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_val"),
        F.bit_xor(row_lane(F.col(row_id), 0)).alias("fp_a"),
        F.bit_xor(row_lane(F.col(row_id), 1)).alias("fp_b"))
    same = Window.partitionBy("n_val", "fp_a", "fp_b")
    return prints.withColumn("n_same", F.count(F.lit(1)).over(same))


def shard_bounds(df: DataFrame, shards: int) -> DataFrame:
    """(shard, lo, hi): n rows in contiguous, nearly equal row ranges."""
    step = F.col("n") / F.lit(float(shards))

    def edge(i):
        return F.when(i == shards, F.col("n")).otherwise(F.floor(i * step))

    return df.agg(F.count(F.lit(1)).alias("n")).select(
        "n", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")).select(
        "shard", edge(F.col("shard")).alias("lo"), edge(F.col("shard") + 1).alias("hi"))

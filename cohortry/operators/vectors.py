"""Vectors per row: normalising, pooling, standardising and checking.

Whole vectors move through MLlib's vector type, so a vector is one value in a
row and never one row per component.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
MASK_FLOOR = 1e-6
MIN_SCALE = 1e-8
NORM_TOLERANCE = 5e-2
MIN_COSINE = 0.999


def l2_normalise(df: DataFrame, vec: str = "vec") -> DataFrame:
    """Every vector at length 1; a zero vector stays zero."""
    tmp = df.withColumn("_v", array_to_vector(F.col(vec)))
    out = Normalizer(p=2.0, inputCol="_v", outputCol="_u").transform(tmp)
    return out.withColumn(vec, vector_to_array("_u")).drop("_v", "_u")


def pool_chunks(df: DataFrame, keys: Sequence[str] = ("row_id",), vec: str = "vec") -> DataFrame:
    """(keys, vec): mean of the normalised chunk vectors, normalised again.

    Partial means are formed before the shuffle; a row has a handful of chunks.
    """
    unit = l2_normalise(df, vec)
    mean = unit.groupBy(*keys).agg(Summarizer.mean(array_to_vector(F.col(vec))).alias("_m"))
    return l2_normalise(mean.select(*keys, vector_to_array("_m").alias(vec)), vec)


def first_token(tokens: DataFrame, keys: Sequence[str], pos: str = "pos",
                vec: str = "vec") -> DataFrame:
    return tokens.where(F.col(pos) == 0).select(*keys, vec)


def masked_mean(tokens: DataFrame, keys: Sequence[str], mask: str = "mask",
                vec: str = "vec") -> DataFrame:
    """(keys, vec): mean of the unmasked token vectors; all masked gives zeros."""
    w = F.col(mask).cast("double")
    sums = tokens.groupBy(*keys).agg(
        Summarizer.metrics("mean", "count").summary(
            array_to_vector(F.transform(vec, lambda x: x.cast("double") * w))).alias("s"),
        F.sum(w).alias("_w"))
    total = F.transform(vector_to_array(F.col("s.mean")), lambda x: x * F.col("s.count"))
    floor = F.greatest(F.col("_w"), F.lit(MASK_FLOOR))
    return sums.select(*keys, total.alias(vec), floor.alias("_w")).select(
        *keys, F.transform(vec, lambda x: x / F.col("_w")).alias(vec))


def fit_scaler(df: DataFrame, vec: str = "vec") -> DataFrame:
    """(dim, mean, scale): population spread, 1 where a component is constant."""
    stats = df.agg(Summarizer.metrics("mean", "variance", "count").summary(
        array_to_vector(F.col(vec))).alias("s")).select(
        F.arrays_zip(vector_to_array("s.mean").alias("mean"),
                     vector_to_array("s.variance").alias("var")).alias("z"),
        F.col("s.count").alias("n")).select("n", F.posexplode("z").alias("dim", "z"))
    spread = F.sqrt(F.col("z.var") * (F.col("n") - 1) / F.col("n"))
    return stats.select("dim", F.col("z.mean").alias("mean"),
                        F.when(spread < MIN_SCALE, 1.0).otherwise(spread).alias("scale"))


def apply_scaler(df: DataFrame, scaler: DataFrame, vec: str = "vec") -> DataFrame:
    """(x - mean) / scale with a fitted scaler: one mean and scale per component."""
    rows = scaler.orderBy("dim").collect()
    table = F.array(*[F.struct(F.lit(float(r["mean"])).alias("m"), F.lit(float(r["scale"])).alias("s"))
                      for r in rows])
    return df.withColumn(vec, F.zip_with(
        vec, table, lambda x, t: (x.cast("double") - t["m"]) / t["s"]))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda s, x: s + x)


def vector_audit(df: DataFrame, dim: int, keys: Sequence[str] = (), vec: str = "vec") -> DataFrame:
    """(keys, n_rows, n_wrong_dim, n_zero, n_off_norm, min_norm, max_norm)."""
    normed = df.select(*keys, F.size(vec).alias("size"),
                       F.sqrt(dot(F.col(vec), F.col(vec))).alias("norm"))
    return normed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("size") != dim).alias("n_wrong_dim"),
        F.count_if(F.col("norm") == 0).alias("n_zero"),
        F.count_if(F.abs(F.col("norm") - 1) >= NORM_TOLERANCE).alias("n_off_norm"),
        F.min("norm").alias("min_norm"), F.max("norm").alias("max_norm"))


def cosine_check(stored: DataFrame, recomputed: DataFrame, key: str = "row_id",
                 vec: str = "vec") -> DataFrame:
    """(n_rows, n_low, worst_cosine, max_abs_diff) of the rows both tables have."""
    both = stored.select(key, F.col(vec).alias("a")).join(
        recomputed.select(key, F.col(vec).alias("b")), key)
    a, b = F.col("a"), F.col("b")
    gap = F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))))
    terms = both.select(dot(a, b).alias("ab"), dot(a, a).alias("aa"), dot(b, b).alias("bb"),
                        gap.alias("gap"))
    cosine = F.try_divide(F.col("ab"), F.sqrt(F.col("aa")) * F.sqrt(F.col("bb")))
    return terms.select(cosine.alias("cosine"), "gap").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.coalesce(F.col("cosine") <= MIN_COSINE, F.lit(True))).alias("n_low"),
        F.min("cosine").alias("worst_cosine"), F.max("gap").alias("max_abs_diff"))

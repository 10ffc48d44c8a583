"""Written tables: predictions, splits, draws, curves, summaries, vectors, metadata.

Tables with many cells are partitioned by cell. ``rebalance`` lets adaptive
execution size the files: a cell with a third of all rows is split over many
tasks, and a small one does not leave a file per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.operators.ranking import CELL
from cohortry.operators.split import split_audit


# Cells that a task writes side by side. Without them Spark sorts all rows of a task by cell
# before it writes one; the rows of further cells still are.
OPEN_CELLS = "spark.sql.maxConcurrentOutputFileWriters", "16"


def write_cells(df: DataFrame, path: str, keys: Sequence[str] = CELL) -> None:
    """Replaces the cells that occur in ``df`` and leaves the others alone."""
    conf, (name, cells) = df.sparkSession.conf, OPEN_CELLS
    before = conf.get(name)
    conf.set(name, cells)
    try:
        df.hint("rebalance", *keys).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)
    finally:
        conf.set(name, before)


def write_predictions(pred: DataFrame, path: str) -> None:
    """(row_id, y_true, score_raw) per cell; scores as they are, not rounded."""
    write_cells(pred.select(*CELL, "row_id", F.col("y_true").cast("int").alias("y_true"),
                            F.col("score_raw").cast("double").alias("score_raw")), path)


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def discover(spark: SparkSession, path: str, keys: Sequence[str] = CELL) -> DataFrame:
    """The cells a written table holds, from its folders: no column is read."""
    return spark.read.parquet(path).select(*keys).distinct()


def write_split(split: DataFrame, path: str, row_id: str = "row_id") -> None:
    write_cells(split.select("label", row_id, "split"), path, ["label"])


def read_split(spark: SparkSession, path: str, label: str, rows: DataFrame | None = None,
               row_id: str = "row_id") -> DataFrame:
    """The saved split of an outcome. With ``rows``, a split that does not cover
    them exactly once, or has no validation rows, is an error."""
    split = spark.read.parquet(path).where(F.col("label") == label).select(row_id, "split")
    if rows is not None:
        bad = split_audit(rows, split, row_id).where("n_bad > 0").collect()
        if bad:
            raise ValueError(f"split of {label}: {[(r['check'], r['n_bad']) for r in bad]}")
    return split


def write_summary(summary: DataFrame, path: str, order: Sequence[str | Column],
                  append: bool = False) -> None:
    """One sorted CSV: a report table, a few rows per cell."""
    summary.orderBy(*order).coalesce(1).write.mode("append" if append else "overwrite").csv(
        path, header=True)


def append_meta(meta: DataFrame, path: str, keys: Sequence[str]) -> None:
    """(keys, meta): everything else of a row packed as JSON, added to the log."""
    rest = [c for c in meta.columns if c not in keys]
    meta.select(*keys, F.to_json(F.struct(*rest)).alias("meta")).write.mode("append").json(path)


def read_meta(spark: SparkSession, path: str, keys: str, fields: str) -> DataFrame:
    """The metadata log with its JSON unpacked; both arguments are DDL."""
    log = spark.read.schema(f"{keys}, meta string").json(path)
    return log.withColumn("meta", F.from_json("meta", fields)).select(
        *[c for c in log.columns if c != "meta"], "meta.*")


def write_vectors(df: DataFrame, path: str, keys: Sequence[str] = ("encoder", "cohort", "split"),
                  vec: str = "vec", row_id: str = "row_id") -> None:
    """(row_id, vec) in single precision, per encoder, cohort and split."""
    write_cells(df.select(*keys, row_id, F.col(vec).cast("array<float>").alias("vec")), path,
                list(keys))


def read_vectors(spark: SparkSession, path: str, expected_rows: int | None = None,
                 dim: int | None = None, **part: str) -> DataFrame:
    """One part of a vector table; a wrong height or width is an error."""
    df = spark.read.parquet(path)
    for k, v in part.items():
        df = df.where(F.col(k) == v)
    if expected_rows is not None or dim is not None:
        bad = F.count_if(F.size("vec") != dim) if dim is not None else F.lit(0)
        got = df.agg(F.count(F.lit(1)).alias("n"), bad.alias("bad")).first()
        if (expected_rows is not None and got.n != expected_rows) or got.bad:
            raise ValueError(f"vectors {part}: {got.n} rows, {got.bad} of another width")
    return df


def write_scaler(scaler: DataFrame, path: str, encoder: str, label: str) -> None:
    """(dim, mean, scale) of one encoder and outcome, beside those of the others."""
    write_cells(scaler.withColumns({"encoder": F.lit(encoder), "label": F.lit(label)}), path,
                ["encoder", "label"])


def read_scaler(spark: SparkSession, path: str, encoder: str, label: str) -> DataFrame:
    found = spark.read.parquet(path).where(
        (F.col("encoder") == encoder) & (F.col("label") == label)).drop("encoder", "label")
    if found.isEmpty():
        raise ValueError(f"no scaler of {encoder}, {label} in {path}")
    return found


def write_stamped(df: DataFrame, path: str, keys: Sequence[str], stamps: DataFrame) -> None:
    """Writes cells with the fingerprint they were made under, as a column ``config_sha``.

    ``stamps`` (keys, config_sha) has one row per cell.
    """
    write_cells(df.join(stamps, list(keys)), path, keys)


def read_stamps(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """(keys, config_sha) of the cells a stamped table holds."""
    return spark.read.parquet(path).select(*keys, "config_sha").distinct()

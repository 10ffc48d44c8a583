"""Table readers: features, outcomes, metadata, published scores, spec files."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortry.functions.missing import normalise_missing
from cohortry.session import settle


def _part(spark: SparkSession, path: str, cohort: str, split: str) -> DataFrame:
    """One cohort and split of a table partitioned by both: others are not read."""
    return spark.read.parquet(path).where(
        (F.col("cohort") == cohort) & (F.col("split") == split))


def load_features(spark: SparkSession, path: str, cohort: str, split: str,
                  columns: Sequence[str], row_id: str = "row_id") -> DataFrame:
    """The contract's columns in the contract's order, NaN as NULL, with the key."""
    df = _part(spark, path, cohort, split)
    require_columns(df, columns)
    return normalise_missing(df.select(row_id, *columns))


def load_outcome(spark: SparkSession, path: str, cohort: str, split: str, label: str,
                 row_id: str = "row_id") -> DataFrame:
    return _part(spark, path, cohort, split).select(
        row_id, F.col(label).cast("int").alias("y_true"))


def load_meta(spark: SparkSession, path: str, cohort: str, split: str) -> DataFrame:
    return _part(spark, path, cohort, split)


def require_columns(df: DataFrame, columns: Sequence[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError(f"columns absent from the table: {missing}")


def feature_contract(spark: SparkSession, path: str, column: str = "name") -> list[str]:
    """The ordered feature names of a contract file: one short file, read as such."""
    rows = spark.read.csv(path, header=True).select(column).collect()
    return [r[0] for r in rows]


def read_spec(spark: SparkSession, path: str) -> DataFrame:
    """The harmonisation spec: years as an array, quoted text kept whole."""
    raw = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True)
    years = F.split("years_present", ",").cast("array<int>")
    return raw.withColumn("years_present", years).withColumn(
        "n_years", F.col("n_years").cast("int"))


def read_crosswalk(spark: SparkSession, path: str, members: str = "variables",
                   shares: str = "pct_observed_") -> DataFrame:
    """(difference_class, member, sample, pct_observed, handling) of a crosswalk file.

    A row lists its columns in one quoted text and has a share per sample, in columns that
    begin with ``shares``; what is left is the handling.
    """
    raw = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True)
    samples = [c for c in raw.columns if c.startswith(shares)]
    rest = [c for c in raw.columns if c not in samples and c not in ("difference_class", members)]
    entries = F.array(*[F.struct(F.lit(c.removeprefix(shares)).alias("sample"),
                                 F.col(c).cast("double").alias("pct_observed")) for c in samples])
    return raw.select(
        "difference_class", F.explode(F.split(members, r"\s*,\s*")).alias("member"),
        entries.alias("entries"), F.concat_ws("; ", *rest).alias("handling")).select(
        "difference_class", "member", F.inline("entries"), "handling")


def published_scores(df: DataFrame, columns: Mapping[str, str], model: str,
                     row_id: str = "row_id") -> DataFrame:
    """Published probabilities in the shape of predictions.

    ``columns`` maps an outcome to its probability column. Rows without a
    probability are left out.
    """
    entries = [F.struct(F.lit(label).alias("label"), F.col(label).cast("int").alias("y_true"),
                        F.col(c).cast("double").alias("score_raw"))
               for label, c in columns.items()]
    return df.select("cohort", F.lit(model).alias("model"), row_id, F.inline(F.array(*entries))
                     ).where(F.col("score_raw").isNotNull())


def schema_table(df: DataFrame) -> DataFrame:
    """(position, column, type) without reading any row."""
    rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema)]
    return df.sparkSession.createDataFrame(rows, "position int, column string, type string")


def checked_count(df: DataFrame, expected: int | None = None) -> int:
    """Row count, from file footers where the source allows; a wrong one is an error."""
    n = df.count()
    if expected is not None and n != expected:
        raise ValueError(f"table has {n:,} rows, expected {expected:,}")
    return n


def require_unique(df: DataFrame, row_id: str = "row_id") -> None:
    """Alignment is by key, so a key may occur once only."""
    if df.groupBy(row_id).count().where("count > 1").limit(1).count():
        raise ValueError(f"{row_id} is not unique")


def with_row_position(spark: SparkSession, path: str) -> DataFrame:
    """A table with its row positions as ``row_id``: the place in its file, after the rows of all
    files whose paths sort before. Counting the files' rows reads no column. One row a file is
    added up in one task."""
    rows = spark.read.parquet(path).select(
        "*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("_file").agg(F.count(F.lit(1)).alias("_n")).select(
        "_file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return rows.join(settle(starts), "_file").withColumn(
        "row_id", F.col("_start") + F.col("_row")).drop("_file", "_row", "_start")

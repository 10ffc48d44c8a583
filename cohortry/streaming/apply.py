"""Frozen preprocessing and scoring of new cases as they arrive.

Both are stateless, so the stream needs no watermark and keeps no state.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from cohortry.operators.prep import PrepState
from cohortry.operators.training import Cell


def case_stream(spark: SparkSession, folder: str, schema, pattern: str = "*.parquet",
                files_per_batch: int = 100) -> DataFrame:
    """New files of a folder as a stream."""
    return (spark.readStream.schema(schema).option("pathGlobFilter", pattern)
            .option("maxFilesPerTrigger", files_per_batch).parquet(folder))


def apply_stream(cases: DataFrame, state: PrepState, sink: str, checkpoint: str,
                 keep: Sequence[str] = ("row_id",),
                 score: Callable[[DataFrame], DataFrame] | None = None):
    """Transforms (and scores) a stream into a parquet table, as far as it goes now.

    The fitted tables are joined to every micro-batch as they are to a batch
    table. The checkpoint makes each file count exactly once.
    """
    out = state.transform(cases, keep) if score is None else score(cases)
    return (out.writeStream.format("parquet").option("path", sink)
            .option("checkpointLocation", checkpoint).outputMode("append")
            .trigger(availableNow=True).start())


def score_stream(cases: DataFrame, cell: Cell, sink: str, checkpoint: str,
                 keep: Sequence[str] = ("cohort", "row_id")):
    """Predictions of a saved cell for a stream of cases, as far as it goes now.

    A batch writes its own folder, which a repeated batch replaces: whatever stops the stream, a
    case is scored once. Start it again with the same checkpoint to go on.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        cell.score(batch, keep).write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    return (cases.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def read_scores(spark: SparkSession, sink: str) -> DataFrame:
    """The predictions of all batches."""
    return spark.read.parquet(sink).drop("batch")

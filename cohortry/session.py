"""Session settings, the shared work folder, and size-checked broadcasts."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Bytes that one operator may broadcast, all its sides together.
BROADCAST_BYTES = 32 << 20
_made: list[str] = []


def build_session(app: str = "cohortry", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, skew-join splitting and UTC time."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        **conf,
    }
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local-mode session may fall back to a temporary folder: on a cluster
    such a folder is not visible to the other executors and dies with its node.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir")
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    root = tempfile.mkdtemp(prefix="cohortry-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path for one written table; see ``clear_work``."""
    path = f"{shared_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def clear_work(spark: SparkSession) -> None:
    """Removes the tables this process has written to the shared folder: call it once the
    results that read them are saved. Checkpoints go when Spark's cleaner finds them unused."""
    while _made:
        remove_work(spark, _made.pop())


def pinned(df: DataFrame) -> DataFrame:
    """Checkpoint a table, so that later reads do not depend on executors."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_root(df.sparkSession))
    return df.checkpoint()


def row_bytes(df: DataFrame) -> Column:
    """About how many bytes a row takes: texts by their length, nested values as JSON."""
    def size(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            return F.coalesce(F.octet_length(c), F.lit(0)) + 8
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            return F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0)) + 8
        return F.lit(8)
    return sum((size(f) for f in df.schema.fields), F.lit(16)).cast("long")


def settle(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Pin a summary table and broadcast it only if it was measured to be small.

    The bytes are summed over the checkpoint, so the check costs no second run of
    the plan. A larger table is returned unhinted and joins by shuffle.
    """
    fixed = pinned(df)
    size = fixed.agg(F.coalesce(F.sum(row_bytes(fixed)), F.lit(0))).first()[0]
    return F.broadcast(fixed) if size <= max_bytes else fixed


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors of a cluster on which it is not installed."""
    package = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp()  # the driver's own; Spark copies the file to the executors
    archive = shutil.make_archive(f"{folder}/{package.name}", "zip", package.parent, package.name)
    spark.sparkContext.addPyFile(archive)


def remove_work(spark: SparkSession, path: str) -> None:
    """Removes a table below the shared folder once nothing reads it any more."""
    root = shared_root(spark).rstrip("/")
    if not path.startswith(f"{root}/"):
        raise ValueError(f"{path} is not below {root}")
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)

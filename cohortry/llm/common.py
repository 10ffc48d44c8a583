"""Shared steps of the text operators: reading, written tables, folds, components."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.session import pinned, work_path

# A document without an id is known by this value inside the operators.
NO_ID = -(1 << 63)
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, *extra: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, extra ..): only the columns an operator reads, null text as empty.

    Columns of other names never reach an operator, so they cannot clash with its own.
    """
    return docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"),
                       *[F.col(c) for c in extra])


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """The table, written to the shared folder and read back: later steps do not
    recompute it, and it outlives lost executors."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id is hashed as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def drop_ids(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The documents whose id is not in the one-column table ``ids``; null ids are
    compared as equal. All columns and repeated rows stay as they are.

    The ids are written first: Spark then knows their size before it plans the join, and
    sends few ids to the texts instead of shuffling the texts.
    """
    own = free_name(docs, "_gone")
    gone = written(ids.select(F.coalesce(F.col(ids.columns[0]), F.lit(NO_ID)).alias(own)).distinct(),
                   "gone")
    return docs.join(gone, F.coalesce(F.col(id_col), F.lit(NO_ID)) == F.col(own), "left_anti")


def keep_rows(docs: DataFrame, found: DataFrame, stay: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose (key, sha) is in ``stay``, one of each.

    ``found`` has the key of every row: its doc_id, or NO_ID; ``stay`` has distinct (key, sha),
    sha the SHA-256 of the text. An id on one row decides by itself, so texts are not shuffled;
    ids on several rows, and null ids, are matched by id and digest.
    """
    from pyspark.sql import Window
    k, sha, no = (free_name(docs, c) for c in ("_key", "_sha", "_no"))
    again = written(found.groupBy("key").agg(F.count(F.lit(1)).alias(no)).where(F.col(no) > 1)
                    .select(F.col("key").alias(k)), "repeated")
    gone = found.select("key").join(stay.select("key").distinct(), "key", "left_anti")
    once = drop_ids(docs, gone.union(again))
    if again.isEmpty():
        return once
    repeated = (docs.withColumns({
        k: F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)),
        sha: F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)})
        .join(again, k, "left_semi").join(stay.toDF(k, sha), [k, sha], "left_semi")
        .withColumn(no, F.row_number().over(Window.partitionBy(k, sha).orderBy(sha)))
        .where(F.col(no) == 1))
    return once.unionByName(repeated.select(*docs.columns))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) of every node in an edge table (a, b): root is the smallest node
    reachable. Alternating large and small stars; each round is a few aggregations and
    joins, and the edges are cut from their lineage by a checkpoint.

    The minima are pinned before they are joined, so that both join sides are plain
    shuffles and a node with very many edges is split over tasks.
    """
    a, b = F.col("a"), F.col("b")
    flat = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where(a != b)
    e, seen = pinned(flat.distinct()), None
    for _ in range(max_rounds):
        mark = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
                     .first())
        if mark == seen or mark[0] == 0:
            break
        seen = mark
        both = e.union(e.select("b", "a")).toDF("u", "v")
        low = pinned(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = pinned(both.where(F.col("v") > F.col("u")).join(low, "u")
                       .select(F.col("v").alias("a"), F.col("m").alias("b")).distinct())
        low = pinned(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(low, "a").where(F.col("b") != F.col("m")).select(
            F.col("b").alias("a"), F.col("m").alias("b"))
        e = pinned(small.union(low.toDF("a", "b")).distinct())
    roots = e.select(F.col("b").alias("node")).distinct().withColumn("root", F.col("node"))
    return e.toDF("node", "root").union(roots)


def running_offsets(df: DataFrame, order: Sequence[Column], measures: Sequence[str],
                    name: str) -> DataFrame:
    """``df`` with ``before_<m>``: the sum of a measure over the rows that sort earlier,
    over the whole table. Rows are dealt by range; only one row per range is summed in
    one task. The order must be unique."""
    from pyspark.sql import Window
    dealt = written(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), name)
    per = dealt.groupBy("_part").agg(*[F.sum(m).alias(f"_p_{m}") for m in measures])
    upto = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = per.select("_part", *[F.coalesce(F.sum(f"_p_{m}").over(upto), F.lit(0)).alias(f"_s_{m}")
                                   for m in measures])
    inner = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = dealt.withColumns({f"before_{m}": F.coalesce(F.sum(m).over(inner), F.lit(0))
                               for m in measures})
    return local.join(starts, "_part").select(
        *df.columns, *[(F.col(f"before_{m}") + F.col(f"_s_{m}")).alias(f"before_{m}")
                       for m in measures])

"""Exact deduplication against a persistent digest index.

The index holds one row per distinct text, (digest, keep_id), in a table that is bucketed
and sorted by digest. A batch is first reduced to its distinct digests, map side first, so
a text held by a third of all rows is one row after the shuffle. Digests that the index
lacks are found by a sort-merge anti-join, for which the index is not shuffled, and appended.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortry.llm.common import NO_ID, drop_ids, free_name, table, texts, written
from cohortry.session import work_path


class DigestIndex:
    """A digest index in a folder.

    The folder outlives the session: opening it again declares the same buckets over the
    files that are there. ``buckets`` must be the number the folder was made with.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.name = f"digests_{uuid.uuid4().hex}"
        spark.sql(f"CREATE TABLE {self.name} (digest BINARY, keep_id BIGINT) USING parquet "
                  f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS "
                  f"LOCATION '{path}'")

    def close(self) -> None:
        """Forgets the table; the files of the index stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, groups: DataFrame) -> None:
        """Adds those of (digest, keep_id), unique by digest, that the index lacks."""
        new = groups.join(self.rows().select("digest").hint("merge"), "digest", "left_anti")
        (new.select("digest", "keep_id").write.format("parquet").mode("append")
         .bucketBy(self.buckets, "digest").sortBy("digest").option("path", self.path)
         .saveAsTable(self.name))
        self.spark.catalog.refreshTable(self.name)

    def dedup(self, docs: DataFrame) -> DataFrame:
        """(doc_id, keep_id, group_size, kept, text_sha256), one row per row of ``docs``.

        keep_id is the document the index holds for the text: an earlier batch's, or the
        largest doc_id of this batch. group_size counts the batch's rows with this text.
        Null text is empty text; a null doc_id sorts below all others. Rows repeated with
        one doc_id are one document, so they are kept or dropped together. An empty batch
        gives no rows and leaves the index as it is.
        """
        digests = written(texts(docs).select(
            "doc_id", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest")), "digests")
        groups = written(digests.groupBy("digest").agg(
            F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "groups")
        self.append(groups)
        # The holders are read without their buckets: both sides are then shuffled for this
        # join, and a digest with very many rows is split over tasks.
        held = self.spark.read.schema("digest BINARY, keep_id BIGINT").parquet(self.path)
        holders = written(groups.select("digest", "group_size").join(held, "digest"), "holders")
        return digests.join(holders, "digest").select(
            "doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"),
            F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"))


def dedup(docs: DataFrame, index_path: str | None = None, buckets: int | None = None) -> DataFrame:
    """``DigestIndex.dedup`` with the index at a path, or a new one for this call."""
    spark = docs.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    index = DigestIndex(spark, index_path or work_path(spark, "digest-index"), buckets)
    out = index.dedup(docs)  # reads the files, not the table
    index.close()
    return out


def keep_unique(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, one for each text, with all their columns.

    Texts are not shuffled, but for ids that occur on several rows: those are matched by id
    and digest, and rows repeated with the id and text that stay are reduced to one.
    """
    key = F.coalesce(F.col("doc_id"), F.lit(NO_ID))
    k, sha, no = (free_name(docs, c) for c in ("_key", "_sha", "_no"))
    found = written(dedup(docs).select(key.alias(k), "kept", F.col("text_sha256").alias(sha)),
                    "deduped")
    again = written(found.groupBy(k).agg(F.count(F.lit(1)).alias(no)).where(F.col(no) > 1)
                    .select(k), "repeated")
    once = drop_ids(docs, found.where("NOT kept").select(k).union(again))
    if again.isEmpty():
        return once
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    stay = found.where("kept").select(k, sha).distinct()
    repeated = (docs.withColumns({k: key, sha: digest}).join(again, k, "left_semi")
                .join(stay, [k, sha], "left_semi")
                .withColumn(no, F.row_number().over(Window.partitionBy(k, sha).orderBy(sha)))
                .where(F.col(no) == 1))
    return once.unionByName(repeated.select(*docs.columns))


def op7_digest_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))


OP7_SQL = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256
FROM d JOIN g USING (text_sha256)
"""

"""Line deduplication by content-defined chunks.

A document's lines are cut into chunks where a rolling hash over the hashes of the last lines has
a fixed remainder. Cuts follow content, so text inserted before a passage does not move the cuts
inside it. Chunks of two or more lines that occur before, anywhere in the corpus, are removed:
they are found by a hash of the chunk and compared byte by byte with the first occurrence.

Chunks miss the edges of a shared passage, and short passages whole. ``without_passages`` has no
chunks: it looks up every two adjacent lines, so that shared runs of two or more lines go whole.

DataFrame functions only. Chunks are made inside a row. Only their hashes are shuffled, map-side
sums first; texts are shuffled for chunks that repeat, in a join whose hot keys can be split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.llm.common import NO_ID, table, texts, written

MEAN_LINES, MIN_LINES = 3, 2
BASE, MODULUS = 31, 2147483647


def _kept_apart(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns through a generator of one row: the optimizer cannot push their
    expressions into the functions that read them once per array entry."""
    row = F.struct(*[c.alias(k) for k, c in columns.items()])
    return df.select("*", F.inline(F.array(row)))


def chunked(docs: DataFrame, mean_lines: int = MEAN_LINES) -> DataFrame:
    """(doc_id, thash, lines, ends): the lines of a text and the 1-based last line of each
    chunk. thash is a hash of the text: rows that share an id are told apart by it."""
    lines = F.split(F.col("text"), "\n", -1)
    h = F.transform("lines", lambda x: F.conv(F.substring(F.md5(x.cast("binary")), 1, 7), 16, 10)
                    .cast("long"))
    at = texts(docs).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"),
                            F.xxhash64("text").alias("thash"), "text")
    at = _kept_apart(at, lines=lines).drop("text")
    at = _kept_apart(at, h=h)
    at = _kept_apart(at, before=F.concat(F.array(F.lit(0).cast("long")), "h"))
    cut = F.transform(F.arrays_zip("h", "before"), lambda p: (
        (F.coalesce(p["before"], F.lit(0)) * BASE + p["h"]) % MODULUS % mean_lines) == 0)
    at = _kept_apart(at, cut=cut)
    n = F.size("lines")
    ends = F.filter(F.sequence(F.lit(1), n), lambda i: (i == n) | F.get("cut", i - 1))
    return _kept_apart(at, ends=ends).select("doc_id", "thash", "lines", "ends")


def _chunk_rows(at: DataFrame) -> DataFrame:
    """(doc_id, thash, chunk_no, n_lines, chunk) of the chunks with two or more lines."""
    spans = F.transform(F.sequence(F.lit(1), F.size("ends")), lambda k: F.struct(
        k.alias("chunk_no"),
        F.when(k == 1, 1).otherwise(F.get("ends", k - 2) + 1).alias("first"),
        F.get("ends", k - 1).alias("last")))
    multi = F.filter("spans", lambda s: s["last"] - s["first"] + 1 >= MIN_LINES)
    rows = _kept_apart(at, spans=spans)
    out = F.transform(multi, lambda s: F.struct(
        s["chunk_no"].alias("chunk_no"), (s["last"] - s["first"] + 1).alias("n_lines"),
        F.array_join(F.slice("lines", s["first"], s["last"] - s["first"] + 1), "\n")
        .alias("chunk")))
    return rows.select("doc_id", "thash", F.inline(out))


def repeated_chunks(docs: DataFrame, mean_lines: int = MEAN_LINES) -> DataFrame:
    """(doc_id, thash, chunk_no, n_lines) of the chunks to remove: all but the first by
    (doc_id, thash, chunk_no) of equal ones."""
    rows = _chunk_rows(chunked(docs, mean_lines)).withColumns(
        {"key": F.xxhash64("chunk"), "bytes": F.octet_length("chunk")})
    at = F.struct("doc_id", "thash", "chunk_no")
    keys = written(rows.select("key", "bytes", at.alias("at")).groupBy("key", "bytes").agg(
        F.count(F.lit(1)).alias("n"), F.min("at").alias("first")).where("n > 1"), "chunk-keys")
    # Always by shuffle, as in every corpus too large to send the keys to the texts.
    found = written(rows.join(keys.drop("n").hint("merge"), ["key", "bytes"]).withColumn(
        "is_first", F.col("first") == at), "repeats")
    # Repeated rows of one document hold the first chunk more than once.
    kept = found.where("is_first").groupBy("key", "bytes").agg(F.min("chunk").alias("same"))
    rest = found.where("NOT is_first").join(written(kept, "firsts"), ["key", "bytes"])
    return rest.where(F.col("chunk") == F.col("same")).select(
        "doc_id", "thash", "chunk_no", "n_lines").distinct()


def without_repeats(docs: DataFrame, mean_lines: int = MEAN_LINES) -> DataFrame:
    """(doc_id, text, n_lines, removed_chunks, removed_lines) for every row of ``docs``.

    Null text is empty text: one empty line, never removed. A text that loses all chunks is
    empty. Of rows that repeat with one id and text none is removed against the other. Chunks
    with one key and other bytes than the first stay. An empty table gives no rows.
    """
    gone = written(repeated_chunks(docs, mean_lines).groupBy("doc_id", "thash").agg(
        F.collect_set("chunk_no").alias("gone"), F.sum("n_lines").alias("removed_lines")), "gone")
    rows = _kept_apart(chunked(docs, mean_lines).join(gone.hint("merge"), ["doc_id", "thash"], "left"),
                       out=F.coalesce("gone", F.array().cast("array<int>")))
    stay = F.filter(F.sequence(F.lit(1), F.size("ends")), lambda k: ~F.array_contains("out", k))
    rows = _kept_apart(rows, stay=stay)
    text = F.array_join(F.transform("stay", lambda k: F.array_join(F.slice(
        "lines", F.when(k == 1, 1).otherwise(F.get("ends", k - 2) + 1),
        F.get("ends", k - 1) - F.when(k == 1, 0).otherwise(F.get("ends", k - 2))), "\n")), "\n")
    return rows.select(
        F.nullif(F.col("doc_id"), F.lit(NO_ID)).alias("doc_id"), text.alias("text"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size("out").cast("long").alias("removed_chunks"),
        F.coalesce("removed_lines", F.lit(0)).cast("long").alias("removed_lines"))


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, thash, lines) of every row; null text is one empty line."""
    return texts(docs).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"),
                              F.xxhash64("text").alias("thash"),
                              F.split(F.col("text"), "\n", -1).alias("lines"))


def _line_pairs(docs: DataFrame) -> DataFrame:
    """(digest, doc_id, thash, line_no) of every two adjacent lines; line_no is the first's."""
    at = _kept_apart(_lines(docs), held=F.col("lines")).where(F.size("held") > 1)
    pairs = F.transform(F.sequence(F.lit(1), F.size("held") - 1), lambda i: F.struct(
        F.unhex(F.sha2(F.concat_ws("\n", F.get("held", i - 1), F.get("held", i))
                       .cast("binary"), 256)).alias("digest"), i.alias("line_no")))
    return at.select("doc_id", "thash", F.inline(pairs)).select(
        "digest", "doc_id", "thash", "line_no")


def without_passages(docs: DataFrame) -> DataFrame:
    """(doc_id, text, n_lines, removed_lines) for every row of ``docs``.

    Removed are all lines in a run of two or more adjacent lines that occur before, by
    (doc_id, hash of the text, line), anywhere in the corpus: each two adjacent lines are
    looked up by their SHA-256, so a run is found whole wherever it starts and ends, and what
    two lines at its edge share with other texts. The chunks that ``without_repeats`` removes
    are among them. A single line that repeats between others that do not stays. Of each line
    that goes, an earlier copy stays.

    Null text is empty text: one empty line, never removed. A text that loses all lines is
    empty. Of rows that repeat with one id and text none is removed against the other. An
    empty table gives no rows.
    """
    at = F.struct("doc_id", "thash", "line_no")
    pairs = _line_pairs(docs)
    keys = written(pairs.groupBy("digest").agg(
        F.count(F.lit(1)).alias("n"), F.min(at).alias("first")).where("n > 1"), "pair-keys")
    hits = written(pairs.join(keys.drop("n").hint("merge"), "digest").where(
        F.col("first") != at).select("doc_id", "thash", "line_no"), "pair-hits")
    gone = written(hits.groupBy("doc_id", "thash").agg(
        F.collect_set("line_no").alias("hit")), "gone-lines")
    rows = _lines(docs).join(gone.hint("merge"), ["doc_id", "thash"], "left")
    hit = F.coalesce("hit", F.array().cast("array<int>"))
    both = F.concat(hit, F.transform(hit, lambda i: i + 1))
    rows = _kept_apart(rows, stay=F.array_except(F.sequence(F.lit(1), F.size("lines")), both))
    n = F.size("lines")
    return rows.select(
        F.nullif(F.col("doc_id"), F.lit(NO_ID)).alias("doc_id"),
        F.array_join(F.transform("stay", lambda i: F.get("lines", i - 1)), "\n").alias("text"),
        n.cast("long").alias("n_lines"), (n - F.size("stay")).cast("long").alias("removed_lines"))


def op8_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents"))


def op8_line_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_passages(table(spark, sf_dir, "documents"))


OP8_SQL = """
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
  FROM documents
), h AS (
  SELECT *, CAST('0x' || substr(md5(line), 1, 7) AS BIGINT) AS h FROM l
), b AS (
  SELECT *, CASE WHEN (coalesce(lag(h) OVER (PARTITION BY doc_id ORDER BY i), 0) * 31 + h)
            % 2147483647 % 3 = 0 THEN 1 ELSE 0 END AS cut FROM h
), c AS (
  SELECT *, coalesce(sum(cut) OVER (PARTITION BY doc_id ORDER BY i
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM b
), k AS (
  SELECT doc_id, c, string_agg(line, chr(10) ORDER BY i) AS chunk, count(*) AS n
  FROM c GROUP BY doc_id, c
), f AS (
  SELECT *, n > 1 AND row_number() OVER (PARTITION BY chunk ORDER BY doc_id, c) > 1 AS gone FROM k
)
SELECT doc_id, coalesce(string_agg(chunk, chr(10) ORDER BY c) FILTER (NOT gone), '') AS text,
       CAST(sum(n) AS BIGINT) AS n_lines, count(*) FILTER (gone) AS removed_chunks,
       CAST(coalesce(sum(n) FILTER (gone), 0) AS BIGINT) AS removed_lines
FROM f GROUP BY doc_id
"""

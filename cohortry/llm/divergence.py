"""How far the sources of a language are from each other, exactly, over run-length columns.

Every (lang, source) group is a column of counts over the kept terms of its language. Terms are
reordered so that equal counts stand together: terms with the same counts in all sources are one
row with a multiplicity, and rows are sorted by their counts. Sorted rows are dealt into blocks;
inside a block each column is run-length encoded, and for each pair of groups the boundaries of
their runs are intersected: f is computed once a piece and multiplied by its length. Blocks add
up, so any order gives the same sums; a good one gives long runs.

Texts are reduced to counts per (lang, source, term) inside the tasks, so a source with a third
of the rows sends no more than its distinct terms.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortry.llm.common import table, written

MIN_DOCS, TOP_TERMS, SCALE = 3, 200, 1_000_000_000
# Distinct (group, term) entries a task holds before it hands them on; cells of a block.
HELD_ENTRIES, BLOCK_CELLS = 400_000, 4_000_000
# Letters a-z and all bytes above 127 make up terms, A-Z become small, other bytes separate.
_TO_TERM = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32
                 for c in range(256))


# --- inside tasks -----------------------------------------------------------------

def terms_of(text: str) -> list[bytes]:
    return text.encode().translate(_TO_TERM).split()


def _count_batches(batches):
    """(lang, source, term, n, docs) of some rows: occurrences, and rows that have the term."""
    held: dict[tuple, tuple[Counter, Counter]] = {}

    def flush():
        for (lang, source), (n, docs) in held.items():
            if n:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(n), pa.string()), pa.array([source] * len(n), pa.string()),
                     pa.array([t.decode() for t in n], pa.string()),
                     pa.array(list(n.values()), pa.int64()),
                     pa.array([docs[t] for t in n], pa.int64())],
                    names=["lang", "source", "term", "n", "docs"])
        held.clear()

    entries = 0
    for b in batches:
        for text, lang, source in zip(*(b.column(c) for c in ("text", "lang", "source"))):
            n, docs = held.setdefault((lang.as_py(), source.as_py()), (Counter(), Counter()))
            before = len(n)
            found = terms_of(text.as_py())
            n.update(found)
            docs.update(set(found))
            entries += len(n) - before
            if entries >= HELD_ENTRIES:
                yield from flush()
                entries = 0
    yield from flush()


def scaled_share(count: np.ndarray, total: int) -> np.ndarray:
    """floor(SCALE * count / total) of whole numbers, by long division in base 1000: no step
    leaves 64 bits while total is below 9e15."""
    share, rest = count // total, count % total
    for _ in range(3):
        share, rest = share * 1000 + rest * 1000 // total, rest * 1000 % total
    return share


class Runs:
    """A column of a block: where runs of equal p start, and the p of each run."""

    def __init__(self, column: np.ndarray, total: int):
        self.starts = np.flatnonzero(np.r_[True, column[1:] != column[:-1]])
        self.p = 1 + scaled_share(column[self.starts] + 1, total)

    def at(self, places: np.ndarray) -> np.ndarray:
        return self.p[np.searchsorted(self.starts, places, side="right") - 1]


def _pair_sums(key, rows: pa.Table, groups: pa.Table) -> pa.Table:
    """(lang, source, item, value): f summed over the terms of one block, all ordered pairs."""
    sources = groups.column("source").to_pylist()
    number = {s: i for i, s in enumerate(sources)}
    totals = [int(n) for n in groups.column("total").to_pylist()]
    counts = np.zeros((rows.num_rows, len(sources)), np.int64)
    for r, cells in enumerate(rows.column("cells").to_pylist()):
        for cell in cells:
            counts[r, number[cell["source"]]] = cell["n"]
    order = np.lexsort(counts.T[::-1]) if len(counts) else np.zeros(0, np.int64)
    counts = counts[order]
    # Place of a row among the block's terms, and the end of the last one.
    upto = np.r_[0, np.cumsum(rows.column("terms").to_numpy()[order])]
    value = np.zeros((len(sources), len(sources)), np.int64)
    if len(counts):
        columns = [Runs(counts[:, i], t) for i, t in enumerate(totals)]
        for i, a in enumerate(columns):
            for j in range(i):
                b = columns[j]
                places = np.union1d(a.starts, b.starts)
                length = np.diff(upto[np.r_[places, len(counts)]])
                p, q = a.at(places), b.at(places)
                square = (p - q) * (p - q)
                value[i, j] = (square // q * length).sum()
                value[j, i] = (square // p * length).sum()
    i, j = np.nonzero(~np.eye(len(sources), dtype=bool))
    lang = key[0].as_py()
    return pa.table({"lang": pa.array([lang] * len(i), pa.string()),
                     "source": pa.array([sources[x] for x in i], pa.string()),
                     "item": pa.array([sources[x] for x in j], pa.string()),
                     "value": pa.array(value[i, j])})


# --- the Spark part -----------------------------------------------------------------

def _dec(c: Column) -> Column:
    return c.cast("decimal(20,0)")


def _share(count: Column, total: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / total), in whole decimals."""
    return F.lit(1) + _floor_div(F.lit(SCALE).cast("decimal(10,0)") * _dec(count + 1), _dec(total))


def _floor_div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _ranked(rows: DataFrame) -> DataFrame:
    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.withColumn("rank", F.row_number().over(by))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS,
          block_cells: int = BLOCK_CELLS) -> DataFrame:
    """(lang, source, part, item, value, rank) for every (lang, source) of ``docs``.

    ``pair``: the divergence from each other source of the lang; ``term``: the kept terms a
    source has more of than its lang. Null text, lang and source are empty strings, which are a
    group like others. Rows that repeat count each by itself. A lang without kept terms has pairs
    of value 0; a lang with one source has no pairs. An empty table gives no rows. A term's
    counts over the sources of a lang are one row, and a block holds a column for each of them:
    the number of sources of a lang must suit a task, as its square is the size of the result.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(text.alias("text"), *[
        F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")])
    counted = rows.mapInArrow(_count_batches, "lang string, source string, term string, n long, "
                                              "docs long")
    # Dealt by (lang, term): the sums per source and the lists of sources need no other shuffle.
    summed = counted.repartition("lang", "term").groupBy("lang", "source", "term").agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    kept = written(summed.groupBy("lang", "term").agg(
        F.sum("docs").alias("docs"), F.sum("n").alias("n"),
        F.sort_array(F.collect_list(F.struct("source", "n"))).alias("cells"))
        .where(F.col("docs") >= min_docs).drop("docs"), "terms")

    cells = kept.select("lang", "term", F.col("n").alias("lang_n"), F.inline("cells"))
    size = cells.groupBy("lang", "source").agg(F.sum("n").alias("held"))
    of_lang = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("n").alias("lang_held"))
    groups = written(rows.select("lang", "source").distinct().join(
        size, ["lang", "source"], "left").join(of_lang, "lang", "left").select(
        "lang", "source", F.coalesce("v", F.lit(0)).alias("v"),
        (F.coalesce("held", F.lit(0)) + F.coalesce("v", F.lit(0))).alias("total"),
        (F.coalesce("lang_held", F.lit(0)) + F.coalesce("v", F.lit(0))).alias("lang_total")),
        "groups")
    return (_pair_part(kept, groups, block_cells)
            .unionByName(_term_part(cells, groups, top_terms)))


def _pair_part(kept: DataFrame, groups: DataFrame, block_cells: int) -> DataFrame:
    alike = written(kept.groupBy("lang", "cells").agg(F.count(F.lit(1)).alias("terms")), "alike")
    wide = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("s"))
    need = alike.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).join(wide, "lang").agg(
        F.sum(F.col("n") * F.col("s"))).first()[0] or 0
    dealt = written(alike.repartitionByRange(max(1, math.ceil(need / block_cells)), "lang", "cells")
                    .withColumn("block", F.spark_partition_id()), "blocks")
    # Block -1 has no terms: a lang without kept terms gets its pairs from it.
    blocks = dealt.select("lang", "block").distinct().union(
        groups.select("lang", F.lit(-1).alias("block")).distinct())
    sides = blocks.join(groups, "lang").select(
        F.col("lang").alias("of"), F.col("block").alias("at"), "source", "total")
    sums = dealt.groupBy("lang", "block").cogroup(sides.groupBy("of", "at")).applyInArrow(
        _pair_sums, "lang string, source string, item string, value long")
    total = sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    return _ranked(total).select("lang", "source", F.lit("pair").alias("part"), "item", "value",
                                 "rank")


def _term_part(cells: DataFrame, groups: DataFrame, top_terms: int) -> DataFrame:
    both = cells.join(groups, ["lang", "source"]).withColumns({
        "p": _share(F.col("n"), F.col("total")), "q": _share(F.col("lang_n"), F.col("lang_total"))})
    gap = F.col("p") - F.col("q")
    more = both.where("p > q").select("lang", "source", F.col("term").alias("item"),
                                      _floor_div(gap * gap, F.col("q")).alias("value"))
    return _ranked(more).where(F.col("rank") <= top_terms).select(
        "lang", "source", F.lit("term").alias("part"), "item", "value", "rank")


def op13_run_length_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(text, '') AS text, coalesce(lang, '') AS lang,
         coalesce(source, '') AS source FROM documents),
tokens AS (
  SELECT d, lang, source, unnest(regexp_extract_all(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS n FROM tokens GROUP BY lang, term
         HAVING count(DISTINCT d) >= 3),
own AS (SELECT t.lang, t.source, t.term, count(*) AS n FROM tokens t JOIN kept k
        ON t.lang = k.lang AND t.term = k.term GROUP BY t.lang, t.source, t.term),
of_lang AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
held AS (SELECT lang, source, sum(n) AS total FROM own GROUP BY lang, source),
groups AS (
  SELECT g.lang, g.source, coalesce(h.total, 0) AS total
  FROM (SELECT DISTINCT lang, source FROM docs) g
  LEFT JOIN held h ON g.lang = h.lang AND g.source = h.source),
shares AS (
  SELECT g.lang, g.source, k.term, coalesce(o.n, 0) AS n,
         1 + 1000000000::HUGEINT * (coalesce(o.n, 0) + 1) // (g.total + l.v) AS p
  FROM groups g JOIN kept k ON g.lang = k.lang JOIN of_lang l ON g.lang = l.lang
  LEFT JOIN own o ON o.lang = g.lang AND o.source = g.source AND o.term = k.term),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
  GROUP BY a.lang, a.source, b.source),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
more AS (
  SELECT s.lang, s.source, 'term' AS part, s.term AS item,
         (s.p - k.q) * (s.p - k.q) // k.q AS value
  FROM shares s JOIN (
    SELECT kept.lang, term, 1 + 1000000000::HUGEINT * (n + 1) // (total + v) AS q
    FROM kept JOIN of_lang ON kept.lang = of_lang.lang) k ON s.lang = k.lang AND s.term = k.term
  WHERE s.n > 0 AND s.p > k.q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM more))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM ranked WHERE part = 'pair' OR rank <= 200
"""

"""Token costs of texts under real vocabularies, by distinct words.

A text costs what its words cost, and a word costs the pieces that a greedy longest match takes
from left to right. Every distinct word of a table is costed once per vocabulary and joined back,
so the work grows with the distinct words and not with the texts. All steps are DataFrame
operations: substrings of words meet the pieces in a join, a fold walks over the longest matches.

Texts are read again for each step instead of being kept or shuffled: the costs of the most
frequent words, as many as may be broadcast, meet the words of a text where it is read, and what
leaves the task is a sum per text. Only words rarer than these are shuffled, as word and digest.
So ``texts`` must give the same rows at each read.

A word is cut after ``WORD_CHARS`` characters, so no word is long, however long a text is.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortry.functions.text import JOIN, field_text
from cohortry.operators.harmonize import mask_columns
from cohortry.operators.passages import MAX_TOKENS, SPECIAL_TOKENS, texts_of_columns
from cohortry.session import BROADCAST_BYTES, pinned, row_bytes, settle

WORD_CHARS = 64
# Distinct words that one task costs, about.
TASK_WORDS = 20_000
# How byte-level files write the space before a word, and others a word's end or inside.
SPACE_MARK, END_MARK, INNER_MARK = "Ġ", "</w>", "##"
# White space as both engines see it.
BLANK = r"\x09-\x0D "
SPACED_WORDS = (rf" ?[A-Za-z]{{1,{WORD_CHARS}}}| ?[0-9]{{1,{WORD_CHARS}}}"
                rf"| ?[^A-Za-z0-9{BLANK}]{{1,{WORD_CHARS}}}|[{BLANK}]{{1,{WORD_CHARS}}}")
LOWER_WORDS = rf"[a-z]{{1,{WORD_CHARS}}}|[0-9]|[^a-z0-9{BLANK}]{{1,{WORD_CHARS}}}"


@dataclass
class Vocabulary:
    """Pieces (piece, at_start, at_end): where a piece may stand in a word, NULL for anywhere.

    ``words`` is the pattern of the words. A character that no piece fits costs its bytes, or
    makes the whole word one unknown token (``unknown_word``).
    """
    name: str
    pieces: DataFrame
    words: str
    lower: bool = False
    unknown_word: bool = False

    def words_of(self, text: Column) -> Column:
        return F.regexp_extract_all(F.lower(text) if self.lower else text, F.lit(self.words), 0)


PIECE = T.StructType([T.StructField("piece", T.StringType()),
                      T.StructField("at_start", T.BooleanType()),
                      T.StructField("at_end", T.BooleanType())])


def read_pieces(path: str) -> list[str]:
    """The pieces of a tokenizer file: a vocabulary, a few MB, read where the job is planned."""
    with open(path, encoding="utf-8") as f:
        return list(json.load(f)["model"]["vocab"])


def _vocabulary(spark: SparkSession, name: str, rows: Sequence[tuple], words: str,
                **options) -> Vocabulary:
    # Pieces beyond ASCII are left out: their characters cost bytes, which is never too few.
    rows = sorted({r for r in rows if r[0] and r[0].isascii()}, key=repr)
    return Vocabulary(name, spark.createDataFrame(rows, PIECE), words, **options)


def spaced_vocabulary(spark: SparkSession, name: str, pieces: Sequence[str]) -> Vocabulary:
    """A byte-level vocabulary, whose pieces hold the space before a word."""
    rows = [(p.replace(SPACE_MARK, " "), None, None) for p in pieces]
    return _vocabulary(spark, name, rows, SPACED_WORDS)


def ended_vocabulary(spark: SparkSession, name: str, pieces: Sequence[str]) -> Vocabulary:
    """A lower-case vocabulary that marks the pieces at a word's end; white space is dropped."""
    rows = [(p.removesuffix(END_MARK), None, p.endswith(END_MARK)) for p in pieces]
    return _vocabulary(spark, name, rows, LOWER_WORDS, lower=True)


def inner_vocabulary(spark: SparkSession, name: str, pieces: Sequence[str],
                     words: str = LOWER_WORDS, lower: bool = True) -> Vocabulary:
    """A vocabulary that marks the pieces inside a word; a word that they cannot make is one
    unknown token."""
    rows = [(p.removeprefix(INNER_MARK), not p.startswith(INNER_MARK), None) for p in pieces]
    return _vocabulary(spark, name, rows, words, lower=lower, unknown_word=True)


def word_costs(words: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(word, cost) for each row of distinct ``words`` (word). An empty word costs nothing."""
    longest = vocabulary.pieces.agg(F.max(F.length("piece"))).first()[0] or 0
    size = F.length("word")
    spots = words.select("word", F.explode(F.sequence(F.lit(1), size)).alias("pos")).where(size > 0)
    # One substring of every length up to the longest piece; length 0 stands for no match.
    subs = spots.select("word", "pos", F.explode(F.sequence(
        F.lit(0), F.least(F.lit(longest), size - F.col("pos") + 1))).alias("len"))
    subs = subs.withColumn("sub", F.substr("word", "pos", "len"))
    fits = ((F.col("sub") == F.col("piece"))
            & F.coalesce(F.col("at_start") == (F.col("pos") == 1), F.lit(True))
            & F.coalesce(F.col("at_end") == (F.col("pos") + F.col("len") - 1 == size), F.lit(True)))
    matched = subs.join(settle(vocabulary.pieces), fits, "left").groupBy("word", "pos").agg(
        F.max(F.when(F.col("piece").isNotNull(), F.col("len")).otherwise(0)).alias("len"))
    alone = F.octet_length(F.substr("word", "pos", F.lit(1)))
    steps = matched.groupBy("word").agg(F.sort_array(F.collect_list(F.struct(
        "pos", "len", alone.alias("bytes")))).alias("steps"))
    start = F.struct(F.lit(1).alias("next"), F.lit(0).alias("cost"), F.lit(False).alias("unknown"))

    def step(s: Column, at: Column) -> Column:
        here, miss = at["pos"] == s["next"], at["len"] == 0
        return F.struct(
            F.when(here, at["pos"] + F.greatest(at["len"], F.lit(1))).otherwise(s["next"]).alias("next"),
            (s["cost"] + F.when(here, F.when(miss, at["bytes"]).otherwise(1)).otherwise(0)).alias("cost"),
            (s["unknown"] | (here & miss)).alias("unknown"))

    walked = F.aggregate("steps", start, step)
    cost = F.when(F.lit(vocabulary.unknown_word) & walked["unknown"], 1).otherwise(walked["cost"])
    return steps.select("word", cost.cast("long").alias("cost"))


def _frequent(costs: DataFrame, max_bytes: int) -> tuple[DataFrame, DataFrame | None]:
    """(the words that may be broadcast, the rarer ones) of (word, cost, times)."""
    size = F.floor(F.log2("times")).alias("size")
    held = sorted(costs.groupBy(size).agg(F.sum(row_bytes(costs)).alias("bytes")).collect(),
                  reverse=True)
    kept = [size for i, (size, _) in enumerate(held) if sum(n for _, n in held[:i + 1]) <= max_bytes]
    if len(kept) == len(held):
        return F.broadcast(costs), None
    least = 2 ** min(kept) if kept else 2 ** (held[0][0] + 1)
    return F.broadcast(costs.where(F.col("times") >= least)), costs.where(F.col("times") < least)


def costed_groups(texts: DataFrame, by: Sequence[str], vocabulary: Vocabulary,
                  max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(by, n_rows, cost) of groups of equal texts, NULL included: ``by`` tells texts apart.

    Costs of a group's rows are added up, so they are a multiple of what one of them costs.
    """
    by = list(by)
    words = texts.select(*by, F.posexplode_outer(vocabulary.words_of(F.col("text"))).alias("_at", "word"))
    counted = pinned(words.where("word IS NOT NULL").groupBy("word").agg(F.count(F.lit(1)).alias("times")))
    # A word meets its pieces in one task; a task holds the spots of its words, so their number
    # is bounded, which the few bytes of the words would not do.
    tasks = max(texts.sparkSession.sparkContext.defaultParallelism, -(-counted.count() // TASK_WORDS))
    costs = pinned(word_costs(counted.select("word").repartition(tasks, "word"), vocabulary).join(
        counted, "word"))
    frequent, rare = _frequent(costs, max_bytes)
    first = F.coalesce(F.col("_at") == 0, F.lit(True)).cast("long")
    sums = words.join(frequent, "word", "left").groupBy(*by).agg(
        F.sum(first).alias("n_rows"), F.coalesce(F.sum("cost"), F.lit(0)).alias("cost"))
    if rare is not None:
        left = words.where("word IS NOT NULL").join(frequent, "word", "left_anti")
        rest = left.join(rare, "word").groupBy(*by).agg(
            F.lit(0).cast("long").alias("n_rows"), F.sum("cost").alias("cost"))
        sums = sums.unionByName(rest).groupBy(*by).agg(
            F.sum("n_rows").alias("n_rows"), F.sum("cost").alias("cost"))
    return sums.select(*by, "n_rows", F.expr("cost div n_rows").alias("cost"))


def text_costs(texts: DataFrame, vocabularies: Sequence[Vocabulary]) -> DataFrame:
    """(text_md5, vocabulary, cost) for each distinct ``text`` of a table; NULL costs nothing.

    Texts are told apart by their md5, so no text is carried along with its words.
    """
    held = texts.where("text IS NOT NULL").select(F.md5("text").alias("text_md5"), "text")
    return reduce(DataFrame.unionByName, [costed_groups(held, ["text_md5"], v).select(
        "text_md5", F.lit(v.name).alias("vocabulary"), "cost") for v in vocabularies])


def field_costs(df: DataFrame, labels: Mapping[str, str], vocabularies: Sequence[Vocabulary],
                mask: Sequence[str] = ()) -> DataFrame:
    """(pos, column, cost): the most tokens a field takes in any row under any vocabulary, with
    its joiner. Fields are stacked and made distinct before anything is cut into words. A table
    without rows costs nothing for every field."""
    columns = list(labels)
    df, values = texts_of_columns(mask_columns(df, mask), columns)
    stacked = df.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("pos"), F.concat(field_text(labels[c], values[c]), F.lit(JOIN)).alias("text"))
        for i, c in enumerate(columns)])))
    texts = pinned(stacked.distinct())
    costs = text_costs(texts, vocabularies)
    worst = texts.select("pos", F.md5("text").alias("text_md5")).join(costs, "text_md5").groupBy(
        "pos").agg(F.max("cost").alias("cost"))
    named = df.sparkSession.createDataFrame(list(enumerate(columns)), "pos int, column string")
    return named.join(worst, "pos", "left").select(
        "pos", "column", F.coalesce("cost", F.lit(0)).cast("int").alias("cost"))


def truncation_audit(chunks: DataFrame, keys: Sequence[str], vocabularies: Sequence[Vocabulary],
                     max_tokens: int = MAX_TOKENS, special: int = SPECIAL_TOKENS) -> DataFrame:
    """(keys, vocabulary, n_chunks, longest, n_over, headroom) of passages in ``text``; a NULL
    text holds the special tokens only."""
    rows = chunks.select(*keys, F.md5("text").alias("text_md5"), "text")
    costed = reduce(DataFrame.unionByName, [
        costed_groups(rows, [*keys, "text_md5"], v).withColumn("vocabulary", F.lit(v.name))
        for v in vocabularies]).withColumn("tokens", F.col("cost") + special)
    return costed.groupBy(*keys, "vocabulary").agg(
        F.sum("n_rows").alias("n_chunks"), F.max("tokens").alias("longest"),
        F.sum(F.when(F.col("tokens") > max_tokens, F.col("n_rows")).otherwise(0)).alias("n_over"),
        (F.lit(max_tokens) - F.max("tokens")).alias("headroom"))

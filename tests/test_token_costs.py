"""Token costs against tokenizers and a plain greedy match."""

import re

import pytest
from pyspark.sql import functions as F

from cohortry.operators import token_costs as tc

PIECES = ["a", "b", "c", "##a", "##b", "##c", "ab", "##bc", "abc", "##cab", "ca", "##aa"]
TEXTS = ["", "a", "abcab", "abc cab bca aabb", "cabcabcabc x abc", "é abc", " \n\t", "abc" * 60,
         "abc, abc. 12", None, "ABC abc"]


def costs_of(spark, v, texts=TEXTS):
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    by_md5 = {r["text_md5"]: r["cost"] for r in tc.text_costs(df, [v]).collect()}
    named = df.where("text IS NOT NULL").distinct().select("text", F.md5("text").alias("m")).collect()
    assert len(by_md5) == len(named)
    return {r["text"]: by_md5[r["m"]] for r in named}


def test_inner_marks_equal_the_library(spark):
    from tokenizers import Tokenizer, models
    vocab = {p: i for i, p in enumerate(["[UNK]", *PIECES])}
    tokenizer = Tokenizer(models.WordPiece(vocab, unk_token="[UNK]"))
    got = costs_of(spark, tc.inner_vocabulary(spark, "inner", PIECES))
    for text, cost in got.items():
        words = re.findall(tc.LOWER_WORDS, text.lower())
        assert cost == sum(len(tokenizer.encode(w).ids) for w in words), text


def greedy(word, pieces):
    at = n = 0
    while at < len(word):
        fits = [len(p) for p, end in pieces if word.startswith(p, at)
                and (end is None or end == (at + len(p) == len(word)))]
        n += 1 if fits else len(word[at].encode())
        at += max(fits, default=1)
    return n


@pytest.mark.parametrize("kind", ["spaced", "ended"])
def test_other_marks_equal_a_plain_match(spark, kind):
    if kind == "spaced":
        raw = ["a", "b", "Ġa", "Ġab", "bc", "c", ",", "Ġ", "ĠĠ"]
        v = tc.spaced_vocabulary(spark, kind, raw)
        pieces, pattern = [(p.replace("Ġ", " "), None) for p in raw], tc.SPACED_WORDS
    else:
        raw = ["a", "b", "c", "a</w>", "c</w>", "ab", "abc</w>", "bc", ",</w>"]
        v = tc.ended_vocabulary(spark, kind, raw)
        pieces = [(p.removesuffix("</w>"), p.endswith("</w>")) for p in raw]
        pattern = tc.LOWER_WORDS
    for text, cost in costs_of(spark, v).items():
        words = re.findall(pattern, text if kind == "spaced" else text.lower())
        assert cost == sum(greedy(w, pieces) for w in words), text


def test_hot_texts_long_texts_and_empty_tables(spark):
    v = tc.inner_vocabulary(spark, "inner", PIECES)
    rows = [("x", "abc")] * 500 + [("x", "abc ca " * 20_000), ("y", None), (None, "a")]
    df = spark.createDataFrame(rows, "k string, text string")
    got = {r["k"]: r for r in tc.truncation_audit(df, ["k"], [v], max_tokens=100).collect()}
    assert (got["x"]["n_chunks"], got["x"]["longest"], got["x"]["n_over"]) == (501, 40_002, 1)
    assert (got["y"]["longest"], got["y"]["headroom"]) == (2, 98)
    assert got[None]["longest"] == 3
    assert tc.truncation_audit(df.limit(0), ["k"], [v]).count() == 0
    none = spark.createDataFrame([], "row_id long, a double, b string")
    fields = tc.field_costs(none, {"a": "A", "b": "B"}, [v]).orderBy("pos").collect()
    assert [(r["column"], r["cost"]) for r in fields] == [("a", 0), ("b", 0)]


def test_worst_of_two_vocabularies(spark):
    coarse = tc.inner_vocabulary(spark, "coarse", [*PIECES, "is", "undefined", ","])
    fine = tc.inner_vocabulary(spark, "fine", ["a", "i", "u", ",", *[f"##{c}" for c in "sndefia"]])
    df = spark.createDataFrame([(1, "a"), (2, None)], "row_id long, a string")
    both, one = (tc.field_costs(df, {"a": "a"}, vs).first()["cost"]
                 for vs in ([coarse, fine], [coarse]))
    assert one == 4 and both == 1 + 2 + len("undefined") + 1


def test_rare_words_beyond_the_broadcast_cost_the_same(spark):
    v = tc.inner_vocabulary(spark, "inner", PIECES)
    rows = [(i % 2, t) for i, t in enumerate([*TEXTS, *TEXTS[1:7], "abc", "abc", "abc"])]
    df = spark.createDataFrame(rows, "k int, text string").withColumn("m", F.md5("text"))
    got = [sorted(map(tuple, tc.costed_groups(df, ["k", "m"], v, max_bytes=b).collect()), key=str)
           for b in (1 << 20, 120, 0)]
    assert got[0] == got[1] == got[2] and sum(r[2] for r in got[0]) == len(rows)


def test_texts_are_not_kept_nor_shuffled(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(tc, "pinned", lambda df: kept.append(df.columns) or df.cache())
    v = tc.inner_vocabulary(spark, "inner", PIECES)
    df = spark.createDataFrame([("x", t) for t in TEXTS], "k string, text string")
    assert tc.truncation_audit(df, ["k"], [v]).first()["n_chunks"] == len(TEXTS)
    assert kept and not any({"text", "text_md5"} & set(columns) for columns in kept)


def test_words_of_one_task_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(tc, "TASK_WORDS", 10)
    seen, cost = [], tc.word_costs
    monkeypatch.setattr(tc, "word_costs", lambda words, v: seen.append(
        words.rdd.getNumPartitions()) or cost(words, v))
    df = spark.range(200).select(F.concat(F.lit("a"), F.col("id")).alias("text"))
    # "a" and the ten digits are few; whole words of letters and digits are 200.
    v = tc.inner_vocabulary(spark, "inner", PIECES, words="[a-z0-9]+")
    assert tc.text_costs(df, [v]).count() == 200 and seen == [20]

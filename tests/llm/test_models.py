import math
from collections import Counter

import numpy as np
import pytest
from helpers import SF, crc, documents, odd_rows, rows_of, words
from pyspark.sql import functions as F

from cohortry.llm import langid, quality, suffix_tree, toxicity
from cohortry.llm.common import table
from cohortry.llm.features import Distinct, byte_grams

SF01 = "/root/testdata/sf0.01"


def label_rows(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, score string")


def test_distinct_and_grams():
    d = Distinct(8)
    assert sorted(d(np.array([5, 1, 5, 7, 1]))) == [1, 5, 7]
    assert len(byte_grams(np.frombuffer(b"ab", np.uint8), 3, 8)) == 0
    assert len(set(byte_grams(np.frombuffer(b"abab", np.uint8), 2, 18).tolist())) == 2


def test_dual_descent_reaches_the_optimum():
    rng = np.random.default_rng(0)
    x = (rng.random((40, 6)) < 0.5).astype(float)
    y = np.where(x[:, 0] + 0.2 * rng.random(40) > 0.5, 1.0, -1.0)
    ids = [np.flatnonzero(r) for r in x]
    starts = np.r_[0, np.cumsum([len(i) for i in ids])]
    w, b = quality.dual_descent(starts, np.concatenate(ids), np.ones(6), y, cost=0.5, epochs=400)

    def loss(v):
        return (v @ v) / 2 + 0.5 * np.maximum(0, 1 - y * (x @ v[:-1] + v[-1])).sum()
    best = np.r_[w, b]
    for _ in range(300):
        assert loss(best) <= loss(best + 0.05 * rng.standard_normal(7)) + 1e-6


def test_quality_held_out(spark):
    docs, labels = table(spark, SF01, "documents"), table(spark, SF01, "labels")
    got = quality.scored(docs, labels)
    assert all(r["held_out"] == (crc(r["doc_id"]) % 5 == 0) for r in got.collect())
    held = got.join(labels, "doc_id").where("held_out").select("score", "predicted", "quality").collect()
    pos = [r["score"] for r in held if r["quality"] == 1]
    neg = [r["score"] for r in held if r["quality"] == 0]
    auc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert auc > 0.95
    assert np.mean([r["predicted"] == 1 for r in held if r["quality"] == 1]) > 0.97


def test_quality_odd_rows(spark):
    docs = documents(spark, odd_rows())
    labels = label_rows(spark, [(i, i % 2, 0, "x") for i in range(1, 11)] + [(None, 1, 1, "x"), (4, None, None, "x")])
    got = quality.scored(docs, labels)
    assert got.count() == len(odd_rows())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got.collect())
    none = quality.scored(docs, label_rows(spark, []))
    assert {r["score"] for r in none.collect()} == {0.5}
    assert quality.scored(documents(spark, []), labels).count() == 0
    assert quality.keep_good(docs, labels).columns == docs.columns


def test_ordinal_regression_orders_grades():
    rng = np.random.default_rng(1)
    grade = rng.integers(0, 4, 600)
    ids = [np.r_[rng.integers(10, 60, 8), np.full(g, 1)[:1], [2] if g > 1 else [], [3] if g > 2 else []]
           .astype(np.int64) for g in grade]
    ids = [np.unique(i) for i in ids]
    starts = np.r_[0, np.cumsum([len(i) for i in ids])]
    w, theta = toxicity.fit_ordinal(starts, np.concatenate(ids), grade, 3, 64)
    assert (np.diff(theta) > 0).all() and w[1] > 0 and w[2] > 0 and w[3] > 0
    x = np.array([w[i].sum() for i in ids])
    severity = (1 / (1 + np.exp(theta[None, :] - x[:, None]))).sum(axis=1)
    means = [severity[grade == g].mean() for g in range(4)]
    assert means == sorted(means) and np.corrcoef(severity, grade)[0, 1] > 0.9


def test_toxicity_held_out(spark):
    docs, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    labels = labels.cache()
    got = toxicity.graded_documents(docs.join(labels.select("doc_id"), "doc_id", "left_semi"), labels)
    held = got.join(labels.select("doc_id", F.col("toxic").alias("y")), "doc_id").where("held_out").collect()
    assert np.mean([r["flagged"] for r in held if r["y"] == 1]) > 0.8
    assert np.mean([r["flagged"] for r in held if r["y"] == 0]) < 0.02
    assert all(0 <= r["severity"] <= 3 for r in held)


def test_toxicity_odd_rows(spark):
    docs = documents(spark, odd_rows())
    labels = label_rows(spark, [(i, 1, i % 2, "x") for i in range(1, 11)] + [(None, 1, 1, "x"), (4, 1, None, "x")])
    got = toxicity.graded_documents(docs, labels)
    assert got.count() == len(odd_rows())
    assert all(0 <= r["toxic"] <= 1 for r in got.collect())
    assert toxicity.graded_documents(docs, label_rows(spark, [])).count() == len(odd_rows())
    assert toxicity.graded_documents(documents(spark, []), labels).count() == 0


def test_toxicity_grades_of_one_side(spark):
    docs = documents(spark, [(i, f"some words number {i}") for i in range(1, 31)])
    every = label_rows(spark, [(i, 1, 1 + i % 2, "x") for i in range(1, 31)])
    got = toxicity.graded_documents(docs, every).collect()
    assert len(got) == 30 and all(r["toxic"] > 0.9 and r["grade"] == 1 for r in got)
    none = label_rows(spark, [(i, 1, 0, "x") for i in range(1, 31)])
    assert all(r["toxic"] < 0.1 and r["grade"] == 0 for r in toxicity.graded_documents(docs, none).collect())


def test_toxicity_with_real_grades(spark):
    words = {0: "calm gentle weather report", 1: "rude grumble mutter", 2: "vile hateful venom"}
    rows = [(i, " ".join(f"{w}" for w in words[i % 3].split()) + f" filler{i % 7}") for i in range(1, 301)]
    labels = label_rows(spark, [(i, 1, i % 3, "x") for i in range(1, 301)])
    got = toxicity.graded_documents(documents(spark, rows), labels).collect()
    assert np.mean([r["grade"] == r["doc_id"] % 3 for r in got]) > 0.95
    mean = [np.mean([r["severity"] for r in got if r["doc_id"] % 3 == g]) for g in range(3)]
    assert mean[0] < mean[1] < mean[2]


def test_repeated_ids_do_not_enlarge_the_sample(spark):
    rows = [(1 + i % 4, f"text {i} of few ids") for i in range(200)]
    labels = label_rows(spark, [(i, 1, i % 2, "x") for i in range(1, 5)])
    weights, theta = toxicity.fit(documents(spark, rows), labels, per_class=5)
    assert np.isfinite(weights).all() and np.isfinite(theta).all()


def test_language_of_rows_without_ids(spark):
    rows = [(None, t, lang) for i in range(60) for t, lang in (
        (f"the weather in the north was good number {i}", "en"),
        (f"das Wetter im Norden war schoen Nummer {i}", "de"))]
    got = langid.labelled(documents(spark, rows)).collect()
    assert len(got) == 120 and {r["lang_pred"] for r in got} == {"en", "de"}
    langs, centres, _, _ = langid.fit(documents(spark, rows).select("doc_id", "text", "lang"), per_lang=3, k=2)
    assert len(langs) == 4 and len(centres) == 4


def test_language_held_out(spark):
    docs = table(spark, SF01, "documents")
    got = langid.labelled(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (crc(r["doc_id"]) % 3 == 1) for r in got)
    assert np.mean([r["lang_pred"] == r["lang"] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_odd_rows(spark):
    got = {(r["doc_id"], r["lang_pred"]) for r in langid.labelled(documents(spark, odd_rows())).collect()}
    for i in (3, 4, 5, 8):
        assert (i, "und") in got
    assert all(lang in ("en", "de", "und") for _, lang in got)
    nothing = langid.labelled(documents(spark, [(1, "abc", None, "a")]))
    assert [r["lang_pred"] for r in nothing.collect()] == ["und"]
    assert langid.labelled(documents(spark, [])).count() == 0


def test_spherical_kmeans_finds_directions():
    rng = np.random.default_rng(2)
    x = np.abs(np.r_[rng.normal([5, 0, 0], .3, (30, 3)), rng.normal([0, 5, 0], .3, (30, 3))])
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    c = langid.spherical_kmeans(x, 2)
    assert sorted(np.argmax(c, axis=1).tolist()) == [0, 1]


# --- language model -----------------------------------------------------------------

def plain_scores(rows, depth):
    """A direct version of the whole model, with dictionaries."""
    s = suffix_tree
    train = [[w.encode() for w in words(t)] + [s.END] for i, t, *_ in rows if crc(i) % 7 != 2]
    count = Counter(w for d in train for w in d)
    total, distinct = sum(count.values()), len(count)
    most = max(2.0, total ** 0.6 / 16)
    def shape(w):
        tail = s._TAIL[w[-1]]
        size = sum(len(w) >= n for n in (4, 7, 11))
        return int((tail * 4 + size) * 2 + w.isascii())
    cls = {w: shape(w) for t in rows for w in [x.encode() for x in words(t[1])]}

    def symbol(w):
        if w == s.END:
            return "end"
        return w if count[w] >= most else cls[w]
    mass = Counter()
    for w, c in count.items():
        if w != s.END and c < most:
            mass[cls[w]] += c + 1
    symbols = s.CLASSES + 1 + sum(1 for w, c in count.items() if w != s.END and c >= most)
    grams = [Counter() for _ in range(depth + 1)]
    for d in train:
        y = ["end"] * depth + [symbol(w) for w in d]
        for i in range(depth, len(y)):
            for k in range(depth + 1):
                grams[k][(tuple(y[i - k:i]), y[i])] += 1
    sums = [Counter() for _ in grams]
    following = [{} for _ in grams]
    for k, g in enumerate(grams):
        for (c, x), n in g.items():
            sums[k][c] += n
            following[k].setdefault(c, {})[x] = n
    states = {}
    for k in range(1, depth + 1):
        for c, n in sums[k].items():
            up = c[1:]
            if n < max(2.0, total ** 0.6 / 256) or (k > 2 and up not in states):
                continue
            nxt = following[k][c]
            gain = sum(m * math.log((m / n) / (grams[k - 1][(up, x)] / sums[k - 1][up]))
                       for x, m in nxt.items())
            if gain > 0.5 * len(nxt) * math.log(n + 1.0):
                states[c] = (n, {x: m for x, m in nxt.items() if m >= max(2.0, total ** 0.6 / 1024)})

    def prob(x, ctx):
        p = (grams[0][((), x)] + 1) / (total + symbols)
        for k in range(1, depth + 1):
            c = ctx[depth - k:]
            if c in states:
                n, own = states[c]
                p = (own.get(x, 0) + (n - sum(own.values()) + s.PRIOR) * p) / (n + s.PRIOR)
        return p
    out = {}
    for i, t, *_ in rows:
        toks = [w.encode() for w in words(t)] + [s.END]
        y = ["end"] * depth + [symbol(w) for w in toks]
        score = 0.0
        for j, w in enumerate(toks):
            score += math.log10(prob(y[j + depth], tuple(y[j:j + depth])))
            if isinstance(y[j + depth], int):
                score += math.log10((count[w] + 1) / (1 + mass[y[j + depth]]))
        base = sum(math.log10((count[w] + 1) / (total + distinct + 1)) for w in toks)
        out[(i, t)] = (crc(i) % 7 == 2, len(toks), sum(count[w] > 0 for w in toks), total, base, score)
    return out, Counter(len(c) for c in states)


@pytest.mark.parametrize("source,depth", [("documents", 2), ("documents", 4), ("odd", 3), ("odd", 1)])
def test_suffix_tree_equals_plain_version(spark, source, depth):
    if source == "odd":
        rows = [r for r in odd_rows()]
        docs = documents(spark, rows)
    else:
        docs = table(spark, SF, "documents")
        rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    want, states = plain_scores(rows, depth)
    assert source == "odd" or set(states) == set(range(1, depth + 1))
    got = suffix_tree.scores(docs, chunk_chars=50_000, depth=depth)
    ids = [(r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"],
            round(r["base_score"], 6), round(r["score"], 6)) for r in got.collect()]
    assert sorted(ids, key=repr) == sorted(
        ((i, *want[(i, t)][1:4], want[(i, t)][0], round(want[(i, t)][4], 6), round(want[(i, t)][5], 6))
         for i, t, *_ in rows), key=repr)


def test_suffix_tree_empty_tables(spark):
    assert suffix_tree.scores(documents(spark, [])).count() == 0
    held = next(i for i in range(99) if crc(i) % 7 == 2)
    got = suffix_tree.scores(documents(spark, [(held, "never learned")])).collect()[0]
    assert (got["n_known"], got["train_tokens"]) == (0, 0) and got["base_score"] == 0.0


def test_suffix_tree_probabilities_sum_to_one():
    size = 50
    rng = np.random.default_rng(4)
    base = rng.random(size)
    base /= base.sum()
    ctx = np.array([3, 7])
    pair = np.array([3 * size + 1, 3 * size + 2, 7 * size + 9])
    n = np.array([10.0, 5.0])
    rest = np.array([4.0, 3.0])
    empty = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0))
    tree = suffix_tree.Tree(base, [None, (ctx, n, rest), empty],
                            [None, (pair, np.array([4.0, 2.0, 2.0])), empty[:2]], size)
    total = sum(10 ** tree.log10(np.array([3, x]), np.array([0]))[1] for x in range(size))
    assert abs(total - 1) < 1e-12


def test_scores_beat_the_base_on_held_out_text(spark):
    got = suffix_tree.scores(table(spark, SF01, "documents")).where("held_out")
    base, score = got.agg(F.sum("base_score"), F.sum("score")).first()
    assert score > base

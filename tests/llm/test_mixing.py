import math
from collections import defaultdict

import pytest
from helpers import WORD, documents, odd_rows, rows_of

from cohortry.llm import mixing


def plain_targets(sizes):
    """sizes: source -> words. The contract's targets by direct resharing."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, capped = {}, set()
    left = 1.5 * sum(sizes.values())
    while True:
        w = sum(weight[s] for s in order if s not in capped)
        room = left - sum(2 * sizes[s] for s in capped)
        target = {s: 2.0 * sizes[s] if s in capped else room * weight[s] / w for s in order}
        over = {s for s in order if target[s] > 2 * sizes[s]} - capped
        if not over:
            return target
        capped |= over


def mixed_rows(n=900):
    rows = []
    for i in range(n):
        source = ["a", "b", "é", "Z", None, "hot", "hot", "hot"][i % 8]
        size = 40 if source == "hot" and i % 3 else 1 + (i * 37) % 400
        rows.append((i, "w " * size, "en", source))
    return rows


@pytest.mark.parametrize("numbered", [7, 400])
def test_mix_meets_targets(spark, numbered, monkeypatch):
    monkeypatch.setattr(mixing, "NUMBERED_ROWS", numbered)
    rows = mixed_rows()
    got = mixing.mix(documents(spark, rows)).collect()
    sizes, taken, longest = defaultdict(int), defaultdict(int), defaultdict(int)
    for _, t, _, s in rows:
        sizes[s] += len(WORD.findall(t))
    target = plain_targets(sizes)
    assert len(got) == len(rows)
    for r in got:
        assert r["source_size"] == sizes[r["source"]]
        assert math.isclose(r["target"], target[r["source"]], rel_tol=1e-12)
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
        assert math.floor(r["rate"]) <= r["copies"] <= math.ceil(r["rate"])
        taken[r["source"]] += r["taken"]
        longest[r["source"]] = max(longest[r["source"]], r["size"])
    for s in sizes:
        assert abs(taken[s] - target[s]) <= longest[s]


def test_rates_are_the_balanced_ones(spark):
    """Among all rates with the right sum, these have the least relative entropy: the log of
    a free rate is the same multiple of the size in all of a source."""
    got = mixing.mix(documents(spark, mixed_rows())).collect()
    for source in {r["source"] for r in got}:
        own = [r for r in got if r["source"] == source and r["size"]]
        if own[0]["target"] >= 2 * own[0]["source_size"] - 1e-9:
            assert all(r["rate"] == 2 for r in own)
            continue
        total = sum(r["rate"] * r["size"] for r in own)
        assert abs(total - own[0]["target"]) <= 1 + 1e-5 * total
        slopes = [math.log(r["rate"]) / r["size"] for r in own if 0 < r["rate"] < 2]
        assert max(slopes) - min(slopes) < 1e-9


def test_reruns_agree(spark):
    docs = documents(spark, mixed_rows(200))
    first = rows_of(mixing.mix(docs), "doc_id", "taken", "target")
    assert rows_of(mixing.mix(docs.repartition(5)), "doc_id", "taken", "target") == first


def test_mix_odd_rows_and_empty_table(spark):
    docs = documents(spark, odd_rows())
    got = mixing.mix(docs).collect()
    assert len(got) == len(odd_rows())
    assert all(r["size"] == 0 and r["taken"] == 0 for r in got if r["doc_id"] in (3, 4, 5))
    assert mixing.mix(documents(spark, [])).count() == 0


def test_mix_of_texts_without_words(spark):
    got = mixing.mix(documents(spark, [(1, "", "en", "a"), (2, None, "en", None)])).collect()
    assert [(r["target"], r["taken"]) for r in got] == [(0.0, 0), (0.0, 0)]


def test_repeat_rows_follows_copies(spark):
    docs = documents(spark, mixed_rows(120))
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(docs).collect()}
    got = mixing.repeat_rows(docs)
    assert got.columns == docs.columns
    count = defaultdict(int)
    for r in got.collect():
        count[r["doc_id"]] += 1
    assert {i: c for i, c in copies.items() if c} == dict(count)


@pytest.mark.parametrize("doc_id", [7, None])
def test_rows_of_one_id_are_rounded_one_by_one(spark, doc_id):
    # The largest have ids of their own, so that the second nudge does not undo the first.
    rows = [(i if i * 37 % 50 > 40 else doc_id, "w " * (1 + i * 37 % 50), "en", s)
            for i in range(90) for s in "abc"]
    got = mixing.mix(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    assert all(0 <= r["copies"] <= 2 for r in got)
    assert all(math.floor(r["rate"]) <= r["copies"] <= math.ceil(r["rate"]) for r in got)
    for s in "abc":
        own = [r for r in got if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 50

import random
from collections import Counter

import pytest
from helpers import classes, documents, fingerprint, odd_rows, rows_of, sha

from cohortry.llm import exact_dedup, line_chunks, simhash
from cohortry.llm.common import components


def expected_dedup(rows):
    groups = {}
    for doc_id, text, *_ in rows:
        groups.setdefault(text or "", []).append(doc_id)
    out = []
    for doc_id, text, *_ in rows:
        ids = groups[text or ""]
        keep = max((i for i in ids if i is not None), default=None)
        out.append((doc_id, keep, len(ids), doc_id == keep, sha(text)))
    return sorted(out, key=repr)


COLS7 = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def test_exact_dedup_odd_rows(spark):
    got = exact_dedup.dedup(documents(spark, odd_rows()))
    assert rows_of(got, *COLS7) == expected_dedup(odd_rows())


def test_exact_dedup_empty_table(spark):
    assert exact_dedup.dedup(documents(spark, [])).count() == 0


def test_index_persists_and_grows(spark, tmp_path):
    path = str(tmp_path / "index")
    first = exact_dedup.DigestIndex(spark, path, 4)
    first.dedup(documents(spark, [(1, "a"), (2, "b"), (3, "b")])).collect()
    again = exact_dedup.DigestIndex(spark, path, 4)  # another table over the same files
    got = again.dedup(documents(spark, [(7, "b"), (8, "c"), (9, "c")]))
    assert rows_of(got, "doc_id", "keep_id", "kept") == [(7, 3, False), (8, 9, False), (9, 9, True)]
    assert again.rows().count() == 3


def test_keep_unique_keeps_columns_and_one_row_per_text(spark):
    docs = documents(spark, odd_rows())
    got = exact_dedup.keep_unique(docs)
    assert got.columns == docs.columns
    texts = [r["text"] or "" for r in got.collect()]
    assert sorted(texts) == sorted({t or "" for _, t, *_ in odd_rows()})
    ids = {r["text"] or "": r["doc_id"] for r in got.collect()}
    assert ids["The same words twice"] == 2 and ids[""] == 4


def near_rows(n=120, seed=5):
    rnd = random.Random(seed)
    base = [" ".join(rnd.choice("abcdefghij") + str(rnd.randint(0, 60)) for _ in range(rnd.randint(30, 80)))
            for _ in range(12)]
    rows = []
    for i in range(n):
        w = rnd.choice(base).split()
        for _ in range(rnd.choice([0, 0, 1, 2, 6])):
            w[rnd.randrange(len(w))] = str(rnd.random())
        rows.append((1000 - i, " ".join(w)))
    return rows


def expected_near(rows):
    fps = [fingerprint(t) for _, t, *_ in rows]
    of = classes(fps, lambda a, b: (a ^ b).bit_count() <= 4)
    low = {}
    for (i, *_), c in zip(rows, of):
        low[c] = min(low.get(c, (False, 0)) if c in low else (i is not None, i or 0),
                     (i is not None, i or 0))
    return sorted(((i, f"{f:016x}", low[c][1] if low[c][0] else None)
                   for (i, *_), f, c in zip(rows, fps, of)), key=repr)


COLS5 = ("doc_id", "fingerprint", "component_id")


@pytest.mark.parametrize("block_rows", [2, 5, 4096])
def test_simhash_equals_all_pairs(spark, block_rows):
    got = simhash.near_duplicates(documents(spark, near_rows()), block_rows=block_rows)
    assert rows_of(got, *COLS5) == expected_near(near_rows())


def test_simhash_odd_rows_and_empty_table(spark):
    got = simhash.near_duplicates(documents(spark, odd_rows()))
    assert rows_of(got, *COLS5) == expected_near(odd_rows())
    assert simhash.near_duplicates(documents(spark, [])).count() == 0


def test_triples_meet_every_four_positions():
    import itertools
    t = [set(x) for x in simhash.triples()]
    assert len(t) == 20
    assert all(any(x <= set(four) for x in t) for four in itertools.combinations(range(8), 4))


def test_forest_connects_like_all_pairs():
    import numpy as np
    rnd = random.Random(3)
    fps = [rnd.getrandbits(64) for _ in range(4)]
    fps += [f ^ sum(1 << rnd.randrange(64) for _ in range(3)) for f in fps for _ in range(20)]
    fps = sorted(set(f & (2**64 - 1) for f in fps))
    a, b = simhash._forest(np.array(fps, np.uint64), np.arange(len(fps)))
    of = classes(fps, lambda x, y: (x ^ y).bit_count() <= 4)
    want = {i: c for i, c in enumerate(of) if Counter(of)[c] > 1 and i != c}
    assert dict(zip(a, b)) == want


def test_keep_one_has_the_smallest_of_each_group(spark):
    docs = documents(spark, near_rows())
    got = simhash.keep_one(docs)
    assert got.columns == docs.columns
    assert {r["doc_id"] for r in got.collect()} == {c for _, _, c in expected_near(near_rows())}


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components(
        spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 160))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def expected_chunks(rows):
    import hashlib

    def h(line):
        return int(hashlib.md5(line.encode()).hexdigest()[:7], 16)
    chunks = {}
    for i, t, *_ in rows:
        lines, cur, before, no = (t or "").split("\n"), [], 0, 1
        for at, line in enumerate(lines):
            cur.append(line)
            if (before * 31 + h(line)) % 2147483647 % 3 == 0 or at == len(lines) - 1:
                chunks[(i, no)] = cur
                cur, no = [], no + 1
            before = h(line)
    first = {}
    for key in sorted(chunks):
        first.setdefault(tuple(chunks[key]), key)
    out = []
    for i, t, *_ in rows:
        own = [(no, c) for (d, no), c in sorted(chunks.items()) if d == i]
        gone = [no for no, c in own if len(c) > 1 and first[tuple(c)] != (i, no)]
        out.append((i, "\n".join("\n".join(c) for no, c in own if no not in gone),
                    sum(len(c) for _, c in own), len(gone),
                    sum(len(c) for no, c in own if no in gone)))
    return sorted(out, key=repr)


COLS8 = ("doc_id", "text", "n_lines", "removed_chunks", "removed_lines")


def line_rows():
    rnd = random.Random(11)
    pool = [f"line {i}" for i in range(60)]
    passage = [f"shared {i}" for i in range(14)]
    rows = []
    for i in range(60):
        lines = [rnd.choice(pool) for _ in range(rnd.randint(1, 9))]
        if i % 3 == 0:
            at = rnd.randint(0, len(lines))
            lines[at:at] = passage
        rows.append((i, "\n".join(lines)))
    return [*rows, (60, ""), (61, None), (62, "\n\n\n"), (63, passage[0])]


def test_line_chunks_equal_plain_python(spark):
    got = line_chunks.without_repeats(documents(spark, line_rows()))
    want = expected_chunks(line_rows())
    assert rows_of(got, *COLS8) == want
    assert sum(r[3] for r in want) > 20


def test_line_chunks_odd_rows_and_empty_table(spark):
    got = rows_of(line_chunks.without_repeats(documents(spark, odd_rows())), "doc_id", "text")
    unlike = [(i, t or "") for i, t, *_ in odd_rows()]  # no chunk repeats but in equal rows
    assert got == sorted(unlike, key=repr)
    assert line_chunks.without_repeats(documents(spark, [])).count() == 0


def expected_passages(rows):
    """Lines in a pair of adjacent lines that another place holds before."""
    seen, out = set(), []
    for i, t in sorted(rows):
        lines, gone = (t or "").split("\n"), set()
        for at in range(len(lines) - 1):
            pair = tuple(lines[at:at + 2])
            if pair in seen:
                gone |= {at, at + 1}
            seen.add(pair)
        out.append((i, "\n".join(x for k, x in enumerate(lines) if k not in gone), len(lines),
                    len(gone)))
    return sorted(out, key=repr)


def test_short_shared_passages_go_whole(spark):
    rnd = random.Random(8)
    passages = [[" ".join(f"p{p}l{k}w{w}" for w in range(52 // n + 1)) for k in range(n)]
                for p in range(20) for n in (2, 3, 4, 5, 6)]
    rows = []
    for i, p in enumerate(passages * 2):
        own = [[f"own {i} {side} {k}" for k in range(rnd.randint(0, 3))] for side in "ab"]
        rows.append((i, "\n".join(own[0] + p + own[1])))
    got = {r["doc_id"]: r for r in line_chunks.without_passages(documents(spark, rows)).collect()}
    for i, p in enumerate(passages * 2):
        text = got[i]["text"].split("\n")
        assert sum(x in text for x in p) == (len(p) if i < len(passages) else 0)
        assert sum(x.startswith("own") for x in text) == rows[i][1].count("own")
        assert got[i]["removed_lines"] == (0 if i < len(passages) else len(p))


def test_line_passages_equal_plain_python(spark):
    rows = [*line_rows(), (70, "one\n" * 5), (71, "one\none"), (72, "a\n\nb"), (73, "a\n\nc")]
    got = line_chunks.without_passages(documents(spark, rows))
    cols = ("doc_id", "text", "n_lines", "removed_lines")
    assert rows_of(got, *cols) == expected_passages(rows)
    held = {r["doc_id"]: set(r["text"].split("\n")) for r in got.collect()}
    for (i, t, *_) in rows:
        assert all(any(x in held[j] for j in held) for x in (t or "").split("\n"))


def test_line_passages_odd_rows_and_empty_table(spark):
    got = rows_of(line_chunks.without_passages(documents(spark, odd_rows())), "doc_id", "text")
    assert got == sorted([(i, t or "") for i, t, *_ in odd_rows()], key=repr)
    assert line_chunks.without_passages(documents(spark, [])).count() == 0

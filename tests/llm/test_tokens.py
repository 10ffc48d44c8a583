"""Byte-level BPE against its own library, alignment and divergence against plain Python."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
import tiktoken
from helpers import LOWER, SF, documents, odd_rows, rows_of
from hypothesis import given, settings
from hypothesis import strategies as st

from cohortry.llm import alignment, byte_bpe, divergence, packing
from cohortry.llm.common import table


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=byte_bpe.word_pattern(),
                             mergeable_ranks=byte_bpe.load_ranks(), special_tokens={})


ODD_TEXTS = ["  two  spaces ", "it's we'll 'tis", "  x　", "<|endoftext|>", "tab\t\tend\t",
             "١٢٣ ½ Ⅷ", "é‍👩‍👩‍👧", "a" * 3000 + " " * 3000 + "!" * 300, "\x00\x1c\x1d\x85 b"]


@given(st.lists(st.lists(st.integers(0, 2**40), max_size=8), max_size=8))
@settings(max_examples=60, deadline=None)
def test_packed_lists_come_back(lists):
    ends = np.cumsum([len(x) for x in lists]).astype(np.int64)
    flat = np.array([v for x in lists for v in x], np.int64)
    values, cuts = packing.unpack(packing.pack(flat, ends))
    assert values.tolist() == flat.tolist() and cuts.tolist() == ends.tolist()
    part = packing.pack(flat, ends)[len(lists) // 2:]
    assert packing.unpack(part)[0].tolist() == [v for x in lists[len(lists) // 2:] for v in x]


@pytest.mark.parametrize("chunk_bytes,group_bytes", [(500, 2000), (1 << 24, 1 << 24)])
def test_ids_equal_the_library(spark, library, chunk_bytes, group_bytes):
    rows = odd_rows() + [(100 + i, t) for i, t in enumerate(ODD_TEXTS)]
    docs = documents(spark, rows).repartition(3)
    got = byte_bpe.encode(docs, chunk_bytes=chunk_bytes, group_bytes=group_bytes)
    want = sorted(((i, library.encode_ordinary(t or "")) for i, t, *_ in rows), key=repr)
    assert rows_of(got, "doc_id", "ids") == want
    back = byte_bpe.decode(got)
    assert sorted(((r["doc_id"], bytes(r["bytes"]).decode()) for r in back.collect()), key=repr) == sorted(
        ((i, t or "") for i, t, *_ in rows), key=repr)


def test_small_tables_and_unknown_ids(spark):
    assert byte_bpe.encode(documents(spark, [])).count() == 0
    blank = byte_bpe.encode(documents(spark, [(1, ""), (None, None)]))
    assert rows_of(blank, "doc_id", "ids") == [(1, []), (None, [])]
    ids = spark.createDataFrame([(1, [0, 1]), (2, [0, 99_999]), (3, None), (4, []), (5, [-1])],
                                "doc_id long, ids array<int>")
    ranks = {b"a": 0, b"bc": 1}
    assert {r["doc_id"]: r["bytes"] and bytes(r["bytes"]) for r in byte_bpe.decode(ids, ranks).collect()} == {
        1: b"abc", 2: None, 3: None, 4: b"", 5: None}


def test_a_word_of_many_chunks_is_encoded_alike(spark, library):
    rows = [(i, "the same words in every chunk " * (i % 3 + 1) + f"x{i}") for i in range(200)]
    got = byte_bpe.encode(documents(spark, rows).repartition(7), chunk_bytes=300, group_bytes=4000)
    assert rows_of(got, "doc_id", "ids") == sorted(
        ((i, library.encode_ordinary(t)) for i, t in rows), key=repr)


def test_query_digests(spark, library):
    docs = table(spark, SF, "documents").select("doc_id", "text").collect()
    want = []
    for d in docs:
        ids = library.encode_ordinary(d["text"] or "")
        want.append((d["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256((d["text"] or "").encode()).hexdigest()))
    got = byte_bpe.op11_word_shuffle_bpe(spark, SF)
    assert rows_of(got, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)


# --- two tokenizers side by side --------------------------------------------------------

def plain_alignment(rows, a, b):
    """Token by token: cuts, links and counts of each row."""
    texts = [t or "" for _, t, *_ in rows]
    out, holders = [], Counter()
    for t in texts:
        ids = [x([t])[0] for x in (a, b)] if t else [[], []]
        raw = (" " + t).encode()
        if t and any(b"".join(x.tokens[i] for i in own) != raw for x, own in zip((a, b), ids)):
            ids = [[], []]
        spans = []
        for x, own in zip((a, b), ids):
            at, s = 0, []
            for i in own:
                s.append((at, at + len(x.tokens[i]), i))
                at += len(x.tokens[i])
            spans.append(s)
        links = [(p[2], q[2]) for p in spans[0] for q in spans[1] if p[0] < q[1] and q[0] < p[1]]
        cuts = sorted({p[1] for p in spans[0]} & {q[1] for q in spans[1]})
        groups = ";".join("|".join(",".join(str(p[2]) for p in s if lo < p[1] <= hi) for s in spans)
                          for lo, hi in zip([0, *cuts], cuts))
        out.append((ids, links, len(cuts), groups))
        holders.update(set(links))
    most = {}
    for (x, _), n in holders.items():
        most[x] = max(most.get(x, 0), n)
    return sorted(((r[0], len(ids[0]), len(ids[1]), cuts, len(links),
                    sum(holders[p] == most[p[0]] for p in links), sum(holders[p] for p in links),
                    hashlib.sha256(groups.encode()).hexdigest() if links else "")
                   for r, (ids, links, cuts, groups) in zip(rows, out)), key=repr)


def test_byte_level_ids_are_those_of_the_file():
    """All code points, alone and beside letters, digits and contractions."""
    import public_tokenizers
    from tokenizers import Tokenizer
    own = alignment.ByteLevel()
    file = Tokenizer.from_file(public_tokenizers.path(alignment.BYTE_BPE_FILE))
    file.encode_special_tokens = True
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 50_000):
        values = [f"a{chr(c)}b {chr(c)}1 {chr(c)}{chr(c)}'s" for c in points[at:at + 50_000]]
        assert [e.ids for e in file.encode_batch([" " + v for v in values], add_special_tokens=False)
                ] == own(values)
    real = [t or "" for _, t, *_ in odd_rows()] + ODD_TEXTS
    assert [e.ids for e in file.encode_batch([" " + t for t in real], add_special_tokens=False)] == own(real)


MEASURES = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.mark.parametrize("chunk_chars,hot", [(300, 0), (300, 2), (10**7, 1000)])
def test_alignment_equals_token_by_token(spark, chunk_chars, hot):
    rows = [r for r in odd_rows() if r[0] != 6] + [(100 + i, t) for i, t in enumerate(
        [*ODD_TEXTS[:-2], "a▁b", "▁", "<0x41> <unk> <s>", "x\x00y", "ﬁne ½", "naïve 日本語 words"])]
    rows += [(1000 + i, "one text of very many documents") for i in range(40)]
    got = alignment.measured(documents(spark, rows).repartition(3), chunk_chars=chunk_chars,
                             hot_copies=hot)
    assert rows_of(got, *MEASURES) == plain_alignment(rows, alignment.ByteLevel(), alignment.PieceLevel())
    assert alignment.measured(documents(spark, [])).count() == 0


def test_alignment_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in
            table(spark, SF, "documents").orderBy("n_chars").limit(120).collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain_alignment(rows, alignment.ByteLevel(), alignment.PieceLevel())
    assert rows_of(alignment.measured(docs), *MEASURES) == want
    assert alignment.op12_text_alignment(spark, SF).count() == table(spark, SF, "documents").count()


def test_long_text_aligns(spark):
    rows = [(6, dict((r[0], r[1]) for r in odd_rows())[6] * 3)]
    (r,) = alignment.measured(documents(spark, rows)).collect()
    assert r["n_links"] == r["n_a"] + r["n_b"] - r["n_groups"] and r["n_best"] <= r["n_links"]


# --- sources side by side -----------------------------------------------------------------

def plain_audit(rows, min_docs=3, top=200):
    find = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    docs, n = Counter(), Counter()
    groups = {((r[2] if len(r) > 2 else None) or "", (r[3] if len(r) > 3 else None) or "") for r in rows}
    for r in rows:
        lang, source = ([*r, None, None][2] or ""), ([*r, None, None][3] or "")
        found = find.findall((r[1] or "").translate(LOWER))
        docs.update({(lang, t) for t in found})
        n.update((lang, source, t) for t in found)
    kept = {k for k, c in docs.items() if c >= min_docs}

    def p(count, total, v):
        return 1 + 10**9 * (count + 1) // (total + v)

    out = []
    for lang, source in groups:
        terms = [t for la, t in kept if la == lang]
        v = len(terms)
        total = {s: sum(n[lang, s, t] for t in terms) for la, s in groups if la == lang}
        part = []
        for other in total:
            if other != source:
                f = [(x - y) * (x - y) // y for x, y in (
                    (p(n[lang, source, t], total[source], v), p(n[lang, other, t], total[other], v))
                    for t in terms)]
                part.append((-sum(f), other.encode(), other))
        out += [(lang, source, "pair", o, -m, i + 1) for i, (m, _, o) in enumerate(sorted(part))]
        part = []
        for t in terms:
            x = p(n[lang, source, t], total[source], v)
            y = p(sum(n[lang, s, t] for s in total), sum(total.values()), v)
            if n[lang, source, t] and x > y:
                part.append((-((x - y) * (x - y) // y), t.encode(), t))
        out += [(lang, source, "term", t, -m, i + 1) for i, (m, _, t) in enumerate(sorted(part)[:top])]
    return sorted(out, key=repr)


AUDIT = ("lang", "source", "part", "item", "value", "rank")


@pytest.mark.parametrize("block_cells", [8, 4_000_000])
def test_audit_equals_term_by_term(spark, block_cells):
    rng = np.random.default_rng(4)
    vocabulary = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)] + ["é", "日本", "𝒳", "ﬁ"]
    rows = odd_rows() + [
        (200 + i, " ".join(rng.choice(vocabulary, 30) if i % 3 else ["Same", "hot", "WORDS"] * 9),
         ["en", "de", None][i % 2 if i % 7 else 2], f"s{i % 5 if i % 4 else 0}") for i in range(150)]
    rows += [(900, None, "fr", "a"), (901, "", "fr", "b"), (902, "once", "it", "alone")]
    got = divergence.audit(documents(spark, rows).repartition(4), block_cells=block_cells)
    assert rows_of(got, *AUDIT) == plain_audit(rows)
    few = divergence.audit(documents(spark, rows), top_terms=5)
    assert rows_of(few, *AUDIT) == plain_audit(rows, top=5)
    assert divergence.audit(documents(spark, [])).count() == 0


def test_shares_are_exact_for_large_counts():
    for c, m in ((10**15, 7 * 10**15), (1, 3), (8 * 10**15, 8 * 10**15), (123456789012345, 987654321098765)):
        assert int(divergence.scaled_share(np.array([c]), m)[0]) == 10**9 * c // m

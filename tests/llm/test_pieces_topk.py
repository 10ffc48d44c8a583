import itertools
import math
from collections import Counter

import duckdb
import numpy as np
import pytest
from helpers import SF, documents, odd_rows, rows_of

from cohortry.llm import pieces, topk
from cohortry.llm.common import table


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Pieces.load()


def small(sharpness=0.5):
    strings = [None, None, None] + [None] * 256 + ["▁", "a", "b", "c", "▁a", "ab", "bc", "abc", "▁ab"]
    return pieces.Pieces(strings, {b: 3 + b for b in range(256)}, sharpness)


def test_sampling_follows_the_lattice():
    p = small()
    text = "abc"
    n = 40_000
    o, flat = p.encode_batch([p.symbols(text)] * n, np.arange(n, dtype=np.uint64) * np.uint64(7919))
    got = Counter(tuple(flat[a:b].tolist()) for a, b in zip(o[:-1], o[1:]))
    full = "▁" + text
    lookup = {s.decode().replace(" ", "▁"): i for i, s in enumerate(p.raw) if i >= 259}
    ways = {}
    for cuts in itertools.product([0, 1], repeat=len(full) - 1):
        parts, cur = [], full[0]
        for ch, c in zip(full[1:], cuts):
            if c:
                parts.append(cur)
                cur = ch
            else:
                cur += ch
        parts.append(cur)
        if all(x in lookup for x in parts):
            ids = tuple(lookup[x] for x in parts)
            ways[ids] = math.prod((1 + i) ** -0.5 for i in ids)
    total = sum(ways.values())
    assert set(got) <= set(ways)
    for ids, w in ways.items():
        assert abs(got[ids] / n - w / total) < 0.01


def test_encoding_is_lossless_and_seeded(vocabulary):
    texts = [t or "" for _, t, *_ in odd_rows()] + ["▁▁", " ", "  a  ", "<s> <0x41>", "\n", "a▁b", "é" * 300]
    keys = np.arange(len(texts), dtype=np.uint64)
    sym = [vocabulary.symbols(t) for t in texts]
    o, flat = vocabulary.encode_batch(sym, keys)
    for a, b, t in zip(o[:-1], o[1:], texts):
        assert vocabulary.decode(flat[a:b].tolist()) == t
    # Alone, or found by comparing symbols: the same ids.
    for i in (0, 6, 9, len(texts) - 1):
        for exact in (False, True):
            _, one = vocabulary.encode_batch([sym[i]], keys[i:i + 1], exact)
            assert one.tolist() == flat[o[i]:o[i + 1]].tolist()


def test_ids_decode_like_the_library(vocabulary):
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL_PATH)
    text = "Some words, naïve ones\nand 漢字 too"
    _, flat = vocabulary.encode_batch([vocabulary.symbols(text)], np.array([3], np.uint64))
    assert sp.decode(flat.tolist()) == text


def test_encode_table(spark, vocabulary):
    docs = documents(spark, odd_rows())
    got = pieces.encode(docs, vocabulary)
    assert got.count() == len(odd_rows()) and all(r["lossless"] for r in got.collect())
    assert rows_of(pieces.decode(got, vocabulary), "doc_id", "text") == sorted(
        ((i, t or "") for i, t, *_ in odd_rows()), key=repr)
    assert rows_of(pieces.encode(docs.repartition(3), vocabulary), "doc_id", "ids") == rows_of(
        got, "doc_id", "ids")
    assert pieces.encode(documents(spark, []), vocabulary).count() == 0


def test_other_seeds_give_other_ways(spark, vocabulary):
    docs = documents(spark, [(1, "a sentence that can be cut in very many ways " * 5)])
    a, b = (pieces.encode(docs, vocabulary, seed=s).first()["ids"] for s in (1, 2))
    assert a != b


# --- top k --------------------------------------------------------------------------

def plain_top_k(rows, k, every):
    best = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        w = [math.floor(1024 * x) for x in v]
        best[i] = max(best.get(i, w), w)
    out = []
    for q in best:
        if q % every:
            continue
        s = sorted((-sum(a * b for a, b in zip(best[q], v)), i) for i, v in best.items() if i != q)
        out += [(q, r + 1, i, -m) for r, (m, i) in enumerate(s[:k])]
    return sorted(out)


def vec_rows(n=700):
    rng = np.random.default_rng(9)
    x = rng.standard_normal((n, 12)) * rng.choice([0.2, 1, 3], (n, 1))
    x[::3] = x[0]  # one vector a third of the time
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]
    return rows + [(1000, None), (1100, [1.0, None] + [0.0] * 10), (1200, [math.nan] * 12),
                   (1300, [math.inf] * 12), (None, rows[1][1]), (1400, []), (1500, [0.0] * 12),
                   (1600, rows[5][1]), (1600, rows[5][1]), (1700, [-4.0])]


@pytest.mark.parametrize("block_rows,query_rows", [(16, 2), (2048, 256)])
def test_top_k_equals_brute_force(spark, block_rows, query_rows):
    rows = vec_rows()
    df = spark.createDataFrame([(i, v, 0, "x", 1.0) for i, v in rows],
                               "vec_id long, embedding array<float>, label int, v string, norm double")
    got = topk.top_k(df, every=10, block_rows=block_rows, query_rows=query_rows)
    assert rows_of(got, "query_id", "rank", "vec_id", "score") == sorted(plain_top_k(rows, 10, 10), key=repr)


def test_top_k_small_tables(spark):
    schema = "vec_id long, embedding array<float>"
    assert topk.top_k(spark.createDataFrame([], schema)).count() == 0
    two = spark.createDataFrame([(0, [1.0]), (5, [2.0])], schema)
    assert rows_of(topk.top_k(two), "query_id", "rank", "vec_id", "score") == [(0, 1, 5, 2048 * 1024)]
    assert topk.top_k(spark.createDataFrame([(0, [1.0])], schema)).count() == 0


def test_large_components_are_exact():
    a = np.array([[2.0**40, 1.0]])
    assert topk._products(a, np.array([[3.0, 1.0]]))[0, 0] == 3 * 2**40 + 1


def test_queries_equal_their_sql(spark):
    from cohortry.llm import registry
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, sql in registry.ORACLE.items():
        got = registry.QUERIES[name](spark, SF)
        cols = sorted(got.columns)
        want = sorted(con.execute(f"SELECT {', '.join(cols)} FROM ({sql})").fetchall(), key=repr)
        assert rows_of(got, *cols) == want and want, name
    assert len(registry.QUERIES) == 13
    assert table(spark, SF, "documents").count() > 0

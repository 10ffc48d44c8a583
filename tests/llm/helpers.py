"""Small tables and plain-Python versions of the text operators."""

import hashlib
import re
import zlib

import xxhash
from pyspark.sql import types as T

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SF = "/root/testdata/sf0.001"

# Names that operators use for their own columns, as extra columns of a table.
CLASHES = ["size", "target", "score", "fp", "kept", "digest", "chunk", "word", "y", "place", "key",
           "ids", "rate", "copies", "node", "n", "skey", "held_out", "_k", "_copies"]


def documents(spark, rows):
    """rows of (doc_id, text[, lang[, source]]) with extra columns of clashing names."""
    full = [(*r, *[None] * (4 - len(r)), None if r[1] is None else len(r[1]),
             *[f"x{i}" for i in range(len(CLASHES))]) for r in rows]
    schema = T.StructType(
        [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
         T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
         T.StructField("n_chars", T.LongType())]
        + [T.StructField(c, T.StringType()) for c in CLASHES])
    return spark.createDataFrame(full, schema)


def odd_rows():
    """Nulls in every column, empty and very long texts, ties and repeated rows."""
    long_text = "\n".join(f"line {i} of a very long text" for i in range(4000))
    return [
        (1, "The same words twice", "en", "a"), (2, "The same words twice", "en", "a"),
        (2, "The same words twice", "en", "a"), (3, None, None, None), (4, "", "en", "b"),
        (5, " \t\n ", "de", "b"), (None, "a row without id", "en", "c"), (None, None, None, None),
        (6, long_text, "en", "a"), (7, "ß ▁ \x00 日本語 😀 é", "de", "é"), (8, "12 34 !!", "en", "b"),
        (9, "x" * 5000, "en", "a"), (10, "the same words TWICE", "en", None)]


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def crc(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode())


def sha(text):
    return hashlib.sha256((text or "").encode()).hexdigest()


def fingerprint(text):
    w = words(text)
    if not w:
        return 0
    shingles = [" ".join(w[i:i + 4]) for i in range(max(1, len(w) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(items, linked):
    """index -> smallest index reachable over linked pairs."""
    parent = list(range(len(items)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x
    for i in range(len(items)):
        for j in range(i):
            if linked(items[i], items[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(items))]


def rows_of(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)

"""SimHash near-duplicates through an inverted index of positional bytes.

Two 64-bit fingerprints that differ in at most 4 bits agree in at least 4 of their 8 bytes.
The lists of single bytes would grow with the corpus (1/256 of it each), so a posting's key is
three positions with their bytes: by Turan's construction 20 of the 56 triples already have one
inside every four positions, so each pair to be found meets in a list. There the shared
positional bytes of a pair are tallied, pairs with fewer than 4 fall out, and the bits of the
rest are compared.

Equal fingerprints are one node before the index is made. Lists longer than a block are split
into tiles of two blocks. A tile hands on a forest that connects what it found linked, never its
pairs, and the components of the forests of all lists are those of all links.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.llm.common import NO_ID, components, keep_rows, table, texts, written

SHINGLE_WORDS, MAX_BITS = 4, 4
MIN_SHARED = 8 - MAX_BITS
# Rows of one block of a list: a tile holds at most two blocks.
BLOCK_ROWS = 4096
# Shingles whose bits are counted at once, so that a very long text needs no more memory.
CHUNK = 50_000


# --- fingerprints ---------------------------------------------------------------

def _bit_counts(shingles) -> np.ndarray:
    h = np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in shingles), dtype=">u8")
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1)
    return bits.sum(axis=0, dtype=np.int64)


def fingerprint(text: str, k: int = SHINGLE_WORDS) -> int:
    """The fingerprint of a text as a signed 64-bit integer; no words: 0."""
    words = text.encode().lower().split()  # bytes: A-Z only, and the six white-space bytes
    if not words:
        return 0
    n, counts = max(1, len(words) - k + 1), np.zeros(64, np.int64)
    for lo in range(0, n, CHUNK):
        counts += _bit_counts(b" ".join(words[i:i + k]) for i in range(lo, min(lo + CHUNK, n)))
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big", signed=True)


def _fingerprint_batches(batches):
    for b in batches:
        fps = [fingerprint(t.as_py()) for t in b.column("text")]
        others = [c for c in b.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays(
            [*[b.column(c) for c in others], pa.array(fps, pa.int64())], names=[*others, "fp"])


def fingerprints(docs: DataFrame, digest: bool = False) -> DataFrame:
    """(doc_id, fp) of every row; null text is empty text. With ``digest`` (doc_id, sha, fp),
    sha the SHA-256 of the text."""
    rows = texts(docs)
    if not digest:
        return rows.mapInArrow(_fingerprint_batches, "doc_id long, fp long")
    sha = F.sha2(F.col("text").cast("binary"), 256)
    return rows.select("doc_id", sha.alias("sha"), "text").mapInArrow(
        _fingerprint_batches, "doc_id long, sha string, fp long")


# --- the index ------------------------------------------------------------------

def triples() -> list[tuple[int, int, int]]:
    """20 triples of the 8 byte positions, so that any 4 positions contain one.

    Positions fall into three classes in a circle. Taken are the triples inside a class and
    those with two positions in one class and one in the next.
    """
    of = [p % 3 for p in range(8)]

    def taken(t):
        c = sorted(of[p] for p in t)
        if len(set(c)) == 1:
            return True
        if len(set(c)) == 3:
            return False
        twice = max(set(c), key=c.count)
        return (twice + 1) % 3 == min(set(c), key=c.count)

    return [t for t in itertools.combinations(range(8), 3) if taken(t)]


def _mask(positions) -> int:
    m = sum(0xFF << (8 * p) for p in positions)
    return m - (1 << 64) if m >= 1 << 63 else m


def _shared_bytes(x: Column) -> Column:
    """How many of the 8 bytes of an exclusive-or are zero."""
    zero = [F.when(x.bitwiseAND(F.lit(_mask([p]))) == 0, 1).otherwise(0) for p in range(8)]
    return sum(zero[1:], zero[0])


def _linked(x: np.ndarray) -> np.ndarray:
    """Tally, filter by count, verify: on a matrix of exclusive-ors."""
    near = (x.view(np.uint8).reshape(*x.shape, 8) == 0).sum(axis=-1) >= MIN_SHARED
    near[near] = np.bitwise_count(x[near]) <= MAX_BITS
    return near


def _forest(fp: np.ndarray, ids: np.ndarray) -> tuple[list, list]:
    """Edges that connect what is linked, each node to the smallest of its component."""
    a, b = [], []
    left = np.arange(len(fp))
    while len(left) > 1:
        front, group, left = left[:1], [left[:1]], left[1:]
        while len(front) and len(left):
            hit = np.zeros(len(left), bool)
            step = max(1, 400_000 // len(left))
            for lo in range(0, len(front), step):
                open_ = np.flatnonzero(~hit)
                x = fp[left[open_]][:, None] ^ fp[front[lo:lo + step]][None, :]
                hit[open_] = _linked(np.ascontiguousarray(x)).any(axis=1)
            front, left = left[hit], left[~hit]
            group.append(front)
        nodes = ids[np.concatenate(group)]
        if len(nodes) > 1:
            root = nodes.min()
            others = nodes[nodes != root]
            a += others.tolist()
            b += [int(root)] * len(others)
    return a, b


def _tile(table_: pa.Table) -> pa.Table:
    fp = table_.column("fp").to_numpy().astype(np.int64).view(np.uint64)
    a, b = _forest(fp, table_.column("node").to_numpy())
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def link_forest(nodes: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Edges (a, b) between nodes (node, fp), unique by both, that connect all links."""
    keys = F.array(*[F.struct(F.lit(i).alias("combo"),
                              F.col("fp").bitwiseAND(F.lit(_mask(t))).alias("bytes"))
                     for i, t in enumerate(triples())])
    postings = nodes.select("node", "fp", F.inline(keys))
    # A list of two is settled by its smallest and largest member, without another shuffle.
    one = F.struct("fp", "node")
    lists = written(postings.groupBy("combo", "bytes").agg(
        F.count(F.lit(1)).alias("n"), F.min(one).alias("x"), F.max(one).alias("y"))
        .where("n > 1"), "lists")
    xor = F.col("x.fp").bitwiseXOR(F.col("y.fp"))
    pairs = lists.where("n = 2").where(_shared_bytes(xor) >= MIN_SHARED).where(
        F.bit_count(xor) <= MAX_BITS).select(
        F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()

    blocks = F.ceil(F.col("n") / block_rows).cast("int")
    long_lists = lists.where("n > 2").select("combo", "bytes", blocks.alias("blocks"))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    tiles = postings.join(long_lists, ["combo", "bytes"]).withColumn("own", own).select(
        "*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select(
        "node", "fp", "combo", "bytes", F.least("own", "other").alias("i"),
        F.greatest("own", "other").alias("j"))
    forest = tiles.groupBy("combo", "bytes", "i", "j").applyInArrow(_tile, "a long, b long")
    return pairs.union(forest)


def _classes(fps: DataFrame, low: Column, block_rows: int) -> DataFrame:
    """(fp, low, root) of each fingerprint: the smallest ``low`` of its rows, and a number its
    component has alone. Nodes are fingerprints: an id may stand on rows of several."""
    nodes = written(fps.groupBy("fp").agg(F.min(low).alias("low")), "nodes")
    roots = components(link_forest(nodes.select(F.col("fp").alias("node"), "fp"), block_rows))
    return written(nodes.join(roots, nodes["fp"] == roots["node"], "left").select(
        "fp", "low", F.coalesce("root", "fp").alias("root")), "classes")


def near_duplicates(docs: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per row of ``docs``.

    component_id is the smallest doc_id reachable over links of at most 4 differing bits.
    Null and empty texts have fingerprint zero and are linked like any other. A null doc_id
    sorts below all others and is returned as null. Repeated rows repeat in the result. Rows
    that share an id are linked by their fingerprints only.
    """
    fps = written(fingerprints(docs), "fingerprints")
    classes = _classes(fps, F.coalesce("doc_id", F.lit(NO_ID)), block_rows)
    smallest = written(classes.groupBy("root").agg(F.min("low").alias("component")), "smallest")
    classes = written(classes.join(smallest, "root").select("fp", "component"), "components")
    return fps.join(classes, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.nullif(F.col("component"), F.lit(NO_ID)).alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest doc_id, null
    below all others; of rows that share it the one with the smallest SHA-256 of the text."""
    fps = written(fingerprints(docs, digest=True), "fingerprints")
    key = F.coalesce("doc_id", F.lit(NO_ID)).alias("key")
    classes = _classes(fps, F.struct(key, "sha"), BLOCK_ROWS)
    stay = written(classes.groupBy("root").agg(F.min("low").alias("low")).select(
        "low.key", "low.sha"), "stay")
    return keep_rows(docs, fps.select(key), stay)


def op5_simhash_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))

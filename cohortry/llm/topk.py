"""Exact top-k inner products by norm-sorted blocks.

Vectors are sorted by falling length and cut into blocks. A first look at the longest vectors
gives each query a score that its k-th best is sure to reach; blocks whose length times the
query's cannot reach it are left out (Cauchy-Schwarz). Inside a block the vectors are taken in
falling length. Their components are rotated by the singular vectors of the whole table, so that
the first of them hold most of the product: a partial sum plus the product of the remaining
lengths bounds the rest, and only pairs that may reach the k-th best are multiplied out, in
whole numbers.

Queries are dealt into blocks as well. A task holds one block of queries and one of vectors and
returns at most k rows for each query, so nothing depends on how many queries there are.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortry.llm.common import table, written

K, EVERY, SCALE = 10, 100, 1024
BLOCK_ROWS, QUERY_ROWS, SEED_ROWS, STEP_ROWS = 2048, 256, 1024, 256
SLACK = 1e-9  # relative rounding of the floating-point bounds, many times over


def whole_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding",
                  scale: int = SCALE) -> DataFrame:
    """(vec_id, v, norm): components as floor(scale * x). Vectors that are null, have no id,
    or hold null or non-finite components are left out; of several rows with one id the
    largest vector stays."""
    x = F.col("x")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"),
                          F.col(vec_col).cast("array<double>").alias("x"))
    whole = rows.where(F.col("vec_id").isNotNull() & x.isNotNull() & ~bad).select(
        "vec_id", F.transform(x, lambda c: F.floor(c * scale).cast("long")).alias("v"))
    one = whole.groupBy("vec_id").agg(F.max("v").alias("v"))
    squares = F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))
    return one.withColumn("norm", F.sqrt(squares))


def _matrix(column, dims: int) -> np.ndarray:
    """Rows of a list column as float64, shorter ones filled with zeros."""
    arrays = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    out = np.zeros((len(arrays), dims))
    sizes = np.diff(arrays.offsets.to_numpy())
    flat = arrays.flatten().to_numpy()
    if len(sizes) and (sizes == dims).all():
        return flat.reshape(len(sizes), dims).astype(np.float64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def rotation(vectors: DataFrame, dims: int) -> np.ndarray:
    """The right singular vectors of the table, largest first: dims x dims. Tasks sum their
    outer products; what reaches the driver has dims x dims numbers."""
    def batches(source):
        gram = np.zeros((dims, dims))
        for b in source:
            m = _matrix(b.column("v"), dims)
            gram += m.T @ m
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(dims * dims, dtype=np.int32)), pa.array(gram.ravel())],
            names=["cell", "x"])

    sums = vectors.select("v").mapInArrow(batches, "cell int, x double").groupBy("cell").agg(
        F.sum("x").alias("x")).toPandas()
    gram = np.zeros(dims * dims)
    gram[sums["cell"].to_numpy()] = sums["x"].to_numpy()
    return np.linalg.eigh(gram.reshape(dims, dims))[1][:, ::-1].copy()


def _best(query, score, vec_id, k):
    """The k best of each query, ties to the smaller id, as positions."""
    order = np.lexsort((vec_id, -score, query))
    q = query[order]
    begin = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, int)
    rank = np.arange(len(q)) - np.repeat(begin, np.diff(np.r_[begin, len(q)]))
    return order[rank < k]


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whole-number inner products of all rows of a with all rows of b."""
    reach = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1]
    if reach < 2**52:
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def search_block(queries, floors, q_ids, vectors, v_ids, turn, k: int):
    """(query position, vector position, score) of up to k best per query in one block.

    ``floors``: scores that the k-th best of the whole table reaches, or -inf. Vectors must be
    sorted by falling length.
    """
    head = max(1, queries.shape[1] // 4)
    qr, vr = queries @ turn, vectors @ turn
    q_rest = np.sqrt((qr[:, head:] ** 2).sum(axis=1))
    v_rest = np.sqrt((vr[:, head:] ** 2).sum(axis=1))
    q_len, v_len = (np.sqrt((x * x).sum(axis=1)) for x in (queries, vectors))
    floors = floors.copy()
    found_q = np.zeros(0, np.int64)
    found_v = np.zeros(0, np.int64)
    found_s = np.zeros(0, np.int64)
    for lo in range(0, len(vectors), STEP_ROWS):
        part = slice(lo, lo + STEP_ROWS)
        room = q_len * v_len[lo] * SLACK + 1e-6
        open_ = np.flatnonzero(q_len * v_len[lo] + room >= floors)
        if not len(open_):
            break
        bound = qr[open_, :head] @ vr[part, :head].T + q_rest[open_, None] * v_rest[None, part]
        may = bound + room[open_, None] >= floors[open_, None]
        may &= q_ids[open_, None] != v_ids[None, part]
        qi, vi = np.nonzero(may)
        if not len(qi):
            continue
        if len(qi) > 0.2 * may.size:
            score = _products(queries[open_], vectors[part])[qi, vi]
        else:
            used, at = np.unique(vi, return_inverse=True)
            score = _products(queries[open_], vectors[lo + used])[qi, at]
        qi, vi = open_[qi], lo + vi
        high = score >= floors[qi]
        found_q = np.r_[found_q, qi[high]]
        found_v = np.r_[found_v, vi[high]]
        found_s = np.r_[found_s, score[high]]
        best = _best(found_q, found_s, v_ids[found_v], k)
        found_q, found_v, found_s = found_q[best], found_v[best], found_s[best]
        count = np.bincount(found_q, minlength=len(queries))
        last = np.full(len(queries), np.iinfo(np.int64).max)
        np.minimum.at(last, found_q, found_s)
        full = count >= k
        floors[full] = np.maximum(floors[full], last[full])
    return found_q, found_v, found_s


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY, block_rows: int = BLOCK_ROWS,
          query_rows: int = QUERY_ROWS, **cols) -> DataFrame:
    """(query_id, rank, vec_id, score): for each vec_id divisible by ``every`` the k other
    vectors with the largest inner products, all if there are fewer.

    Ties go to the smaller vec_id. Shorter vectors count as filled with zeros. See
    ``whole_vectors`` for nulls and repeated ids. An empty table gives no rows.
    """
    vecs = written(whole_vectors(vectors, **cols), "vectors")
    n, dims = vecs.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    dims = max(1, dims)
    turn = rotation(vecs, dims)
    order = [F.desc("norm"), F.col("vec_id")]
    row = F.monotonically_increasing_id()
    dealt = written(vecs.repartitionByRange(
        max(1, math.ceil(n / (8 * block_rows))), *order).sortWithinPartitions(*order).withColumn(
        "block", F.shiftright(row, 33) * (1 << 20)
        + F.floor(row.bitwiseAND(F.lit((1 << 33) - 1)) / block_rows)), "sorted")

    # A score that each query's k-th best reaches, from a fixed number of the longest vectors.
    longest = dealt.orderBy(*order).limit(SEED_ROWS).select("vec_id", "v").toArrow()
    seed_v, seed_id = _matrix(longest.column("v"), dims), longest.column("vec_id").to_numpy()

    def floors(source):
        for b in source:
            q, ids = _matrix(b.column("v"), dims), b.column("vec_id").to_numpy()
            s = _products(q, seed_v).astype(np.float64)
            s[ids[:, None] == seed_id[None, :]] = -np.inf
            low = (np.partition(s, -k, axis=1)[:, -k] if len(seed_id) >= k
                   else np.full(len(q), -np.inf))
            yield pa.RecordBatch.from_arrays(
                [b.column("vec_id"), b.column("v"), b.column("norm"), pa.array(low)],
                names=["vec_id", "v", "norm", "floor"])

    asked = dealt.where(F.col("vec_id") % every == 0).select("vec_id", "v", "norm")
    n_blocks = max(1, math.ceil(asked.count() / query_rows))
    queries = written(asked.mapInArrow(
        floors, "vec_id long, v array<bigint>, norm double, floor double").withColumn(
        "q_block", F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)).cast("int")), "queries")

    # Pairs of blocks in which the longest vector may reach the floor of some query.
    need = queries.groupBy("q_block").agg(F.min(F.when(
        F.col("floor") > 0, F.col("floor") / F.col("norm")).otherwise(0.0)).alias("need"))
    blocks = dealt.groupBy("block").agg(F.max("norm").alias("longest"))
    tiles = written(blocks.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))
                                  .alias("q_block")).join(need, "q_block").where(
        F.col("longest") * (1 + SLACK) + 1e-6 >= F.col("need")).select("block", "q_block"), "tiles")

    def tile(key, q, v):
        if not q.num_rows or not v.num_rows:
            empty = pa.array([], pa.int64())
            return pa.table({"query_id": empty, "vec_id": empty, "score": empty})
        v = v.sort_by([("norm", "descending"), ("vec_id", "ascending")])
        q_ids, v_ids = q.column("vec_id").to_numpy(), v.column("vec_id").to_numpy()
        qi, vi, s = search_block(_matrix(q.column("v"), dims), q.column("floor").to_numpy(),
                                 q_ids, _matrix(v.column("v"), dims), v_ids, turn, k)
        return pa.table({"query_id": q_ids[qi], "vec_id": v_ids[vi], "score": s})

    keys = ["block", "q_block"]
    pairs = queries.join(tiles, "q_block").groupBy(*keys).cogroup(
        dealt.join(tiles, "block").groupBy(*keys)).applyInArrow(
        tile, "query_id long, vec_id long, score long")
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


def op6_norm_sorted_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


OP6_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(q.e, v.e) AS BIGINT) AS score
  FROM v AS q JOIN v ON v.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

"""Byte-level BPE: every distinct word of the corpus is encoded once; exact decoding.

Texts are cut into pre-tokens, here called words. A task numbers the distinct words of a chunk of
rows, the frequent ones first, and keeps each text as the list of its word numbers: the positions.
The distinct words of all chunks are shuffled by a hash of the word. The task that gets a word
encodes it once, for all chunks that hold it, and the ids go back to the chunks, where they are
put in the place of the word numbers. A frequent word is one entry a chunk, however often a chunk
has it, so neither a hot word nor a hot source makes a large group.

Chunks and word groups are bounded by bytes; their number grows with the corpus. Rows are made in
one pass and written, so a lost executor cannot number a chunk anew. The written table is bucketed
by chunk: the positions, which are most of it, meet their answers without a shuffle.
"""

from __future__ import annotations

import base64
import math
import uuid
from collections import defaultdict
from collections.abc import Callable
from hashlib import sha256
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.llm.common import table, texts
from cohortry.llm.packing import Chunks, byte_rows, flat_bytes, gathered, pack, unpack
from cohortry.session import work_path

RANKS_FILE = "byte_bpe_multi_50k.tiktoken"
# Bytes of text in a chunk, bytes of text for each group of words, and packed bytes of a chunk that
# are put together at once.
CHUNK_BYTES, GROUP_BYTES, SLICE_BYTES = 32 << 20, 16 << 20, 1 << 19
# Chunks are dealt into so many buckets at most; a bucket is read as a stream of chunks.
MAX_BUCKETS = 10_000


def load_ranks(path: str | None = None) -> dict[bytes, int]:
    """Token bytes and their ranks from a file of ``base64 rank`` lines; ranks are the ids."""
    if path is None:
        import public_tokenizers
        path = public_tokenizers.path(RANKS_FILE)
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def word_pattern() -> str:
    """The pattern whose matches are encoded each by itself."""
    import public_tokenizers
    return public_tokenizers.PATTERN


# --- inside tasks -----------------------------------------------------------------

def _chunk_rows(chunk: int, ids: list, nos: list, numbers: dict, groups: int) -> pa.RecordBatch:
    """A row for each text of a chunk, with its word numbers, and one for each group of words."""
    ends = np.cumsum([len(x) for x in nos])
    flat = np.concatenate(nos)
    times = np.bincount(flat, minlength=len(numbers))
    words = [w.encode() for w in numbers]
    # Frequent words get small numbers; equally frequent ones stand in the order of their bytes,
    # which makes the words of a group similar to their neighbours.
    order = sorted(range(len(words)), key=lambda i: (-times[i], words[i]))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    group = np.fromiter((xxhash.xxh3_64_intdigest(words[i]) % groups for i in order), np.int64,
                        len(order))
    held, no_parts, size_parts, word_parts = [], [], [], []
    for g in np.unique(group).tolist():
        own = np.flatnonzero(group == g)
        mine = [words[order[i]] for i in own.tolist()]
        held.append(g)
        no_parts.append(np.diff(own, prepend=0))
        size_parts.append(np.array([len(w) for w in mine]))
        word_parts.append(b"".join(mine))
    n, m = len(ids), len(held)
    cut = np.cumsum([len(x) for x in no_parts]) if m else np.zeros(0, np.int64)
    joined = [np.concatenate(x) if m else np.zeros(0, np.int64) for x in (no_parts, size_parts)]
    none = pa.nulls(m, pa.binary()), pa.nulls(n, pa.binary())
    return pa.RecordBatch.from_arrays([
        pa.array(np.full(n + m, chunk)),
        pa.array([-1] * n + held, pa.int32()),
        pa.concat_arrays([pa.array(ids, pa.int64()), pa.nulls(m, pa.int64())]),
        pa.concat_arrays([pack(rank[flat], ends), pack(joined[0], cut)]),
        pa.concat_arrays([none[1], pack(joined[1], cut)]),
        pa.concat_arrays([none[1], pa.array(word_parts, pa.binary())]),
    ], names=["chunk", "grp", "doc_id", "nos", "sizes", "words"])


def _chunk_batches(pattern: str, groups: int, chunk_bytes: int):
    def run(batches):
        import regex
        find, chunks = regex.compile(pattern).findall, Chunks()

        def fresh():
            return [], [], defaultdict(count().__next__), 0

        ids, nos, numbers, size = fresh()
        for b in batches:
            for doc_id, t in zip(b.column("doc_id"), b.column("text")):
                t = t.as_py()
                words = find(t)
                ids.append(doc_id.as_py())
                nos.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
                size += len(t) + 64
                if size >= chunk_bytes:
                    yield _chunk_rows(chunks.number(), ids, nos, numbers, groups)
                    ids, nos, numbers, size = fresh()
        if ids:
            yield _chunk_rows(chunks.number(), ids, nos, numbers, groups)
    return run


def _encode_group(ranks, pattern: str):
    """The ids of every word of a group of chunk rows; a word of several chunks is encoded once."""
    def run(rows: pa.Table) -> pa.Table:
        import tiktoken
        encode = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks.value,
                                   special_tokens={}).encode_ordinary
        sizes, ends = unpack(rows.column("sizes"))
        data, _ = flat_bytes(rows.column("words"))
        data, stop = data.tobytes(), np.cumsum(sizes).tolist()
        words = [data[a:z] for a, z in zip([0, *stop[:-1]], stop)]
        known = {w: encode(w.decode()) for w in dict.fromkeys(words)}
        n = np.fromiter((len(known[w]) for w in words), np.int64, len(words))
        flat = np.fromiter((i for w in words for i in known[w]), np.int64, int(n.sum()))
        return pa.table({
            "chunk": rows.column("chunk"), "nos": rows.column("nos"), "sizes": pack(n, ends),
            "ids": pack(flat, np.r_[0, np.cumsum(n)][ends])})
    return run


def _slices(column: pa.ChunkedArray, size: int):
    """The rows of a binary column in runs of about ``size`` bytes."""
    upto = np.cumsum(pc.binary_length(column).to_numpy().astype(np.int64))
    cuts = np.flatnonzero(np.diff(upto // size, prepend=0)) if len(upto) else upto
    lo = 0
    for hi in [*cuts.tolist(), len(upto)]:
        if hi > lo:
            yield column.slice(lo, hi - lo), lo, hi
            lo = hi


def _reassemble(finish):
    """Each word number of a chunk's texts replaced by the ids of the word; ``finish`` makes the
    result of some rows (doc_id, ids), so that no task holds the ids of a whole chunk."""
    def run(key, docs: pa.Table, answers: pa.Table) -> pa.Table:
        gaps, ends = unpack(answers.column("nos"))
        n, _ = unpack(answers.column("sizes"))
        ids = unpack(answers.column("ids"))[0].astype(np.int32)
        # Numbers were kept as steps inside a group.
        upto = np.r_[0, np.cumsum(gaps)]
        nos = upto[1:] - np.repeat(upto[np.r_[0, ends[:-1]]] if len(ends) else upto[:0],
                                   np.diff(ends, prepend=0))
        start, size = np.zeros(len(nos), np.int64), np.zeros(len(nos), np.int64)
        start[nos], size[nos] = np.cumsum(n) - n, n
        parts = []
        for packed, lo, hi in _slices(docs.column("nos"), SLICE_BYTES):
            at, rows = unpack(packed)
            flat = ids[gathered(start[at], size[at])]
            offsets = np.r_[0, np.cumsum(size[at])][np.r_[0, rows]]
            parts.append(finish(docs.column("doc_id").slice(lo, hi - lo), pa.ListArray.from_arrays(
                pa.array(offsets.astype(np.int32)), pa.array(flat))))
        none = pa.chunked_array([], pa.int64()), pa.array([], pa.list_(pa.int32()))
        return pa.concat_tables(parts or [finish(*none)])
    return run


def _ids_as_they_are(doc_id, ids) -> pa.Table:
    return pa.table({"doc_id": doc_id, "ids": ids})


def _joined(entries: pa.Array, ids: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, known): the entries of each row's ids put together, and whether the table
    of entries has all of them."""
    flat = ids.flatten()
    inside = pc.and_(pc.greater_equal(flat, 0), pc.less(flat, len(entries)))
    found = pc.take(entries, pc.if_else(inside, flat, None))
    n = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(n)
    lost = np.r_[0, np.cumsum(pc.is_null(found).to_numpy(zero_copy_only=False))]
    data, at = flat_bytes(pc.fill_null(found, b""))
    return data, at[np.r_[0, ends]], lost[ends] == lost[ends - n]


def decoded(tokens: pa.Array, ids: pa.ListArray) -> pa.Array:
    """The bytes of each row's ids; null where ids are null or not in the table."""
    data, at, known = _joined(tokens, ids)
    return pc.if_else(pc.and_(pc.is_valid(ids), pa.array(known)), byte_rows(data, at), None)


def _digests(by_id):
    """Counts and digests of ids and of the bytes they decode to."""
    def run(doc_id, ids: pa.ListArray) -> pa.Table:
        tokens = pa.array(by_id.value, pa.binary())
        numbers = pa.array([b"%d," % i for i in range(len(tokens))], pa.binary())
        data, at, _ = _joined(numbers, ids)
        data, at = data.tobytes(), at.tolist()
        return pa.table({
            "doc_id": doc_id, "n_tokens": pc.list_value_length(ids).cast(pa.int64()),
            "ids_sha256": pa.array([sha256(data[a:max(a, z - 1)]).hexdigest()
                                    for a, z in zip(at, at[1:])], pa.string()),
            "decoded_sha256": pa.array([sha256(x.as_buffer()).hexdigest()
                                        for x in decoded(tokens, ids)], pa.string())})
    return run


# --- the Spark part -----------------------------------------------------------------

def _bucketed(rows: DataFrame, buckets: int) -> DataFrame:
    """The rows, written to the shared folder in buckets by chunk. A chunk's rows come from one
    task, so there are no more files than chunks. The table is forgotten, its files stay."""
    spark, name = rows.sparkSession, f"words_{uuid.uuid4().hex}"
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (rows.write.format("parquet").option("compression", "zstd")
     .option("path", work_path(spark, "words")).bucketBy(min(MAX_BUCKETS, max(least, buckets)), "chunk")
     .saveAsTable(name))
    made = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return made


def encode(docs: DataFrame, ranks: dict[bytes, int] | None = None, pattern: str | None = None,
           chunk_bytes: int = CHUNK_BYTES, group_bytes: int = GROUP_BYTES,
           finish: Callable = _ids_as_they_are, schema: str = "doc_id long, ids array<int>"
           ) -> DataFrame:
    """(doc_id, ids) of every row of ``docs``, as the ranks' own library encodes ordinary text.

    Null text is empty text and has no ids. Rows that repeat, share an id or have none are encoded
    each by itself. A long text is one row of a chunk; signs of special tokens are plain text. An
    empty table gives no rows. ``finish`` and ``schema`` give another result of the same rows,
    made where the ids are.
    """
    ranks, pattern = ranks or load_ranks(), pattern or word_pattern()
    sent = docs.sparkSession.sparkContext.broadcast(ranks)
    rows = texts(docs)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(1, math.ceil(size / group_bytes))
    made = _bucketed(rows.mapInArrow(
        _chunk_batches(pattern, groups, chunk_bytes), "chunk long, grp int, doc_id long, "
        "nos binary, sizes binary, words binary"), math.ceil(size / chunk_bytes))
    answers = made.where("grp >= 0").groupBy("grp").applyInArrow(
        _encode_group(sent, pattern), "chunk long, nos binary, sizes binary, ids binary")
    positions = made.where("grp < 0").select("chunk", "doc_id", "nos")
    return positions.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(
        _reassemble(finish), schema)


def _by_id(ranks: dict[bytes, int]) -> list:
    out: list = [None] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        out[rank] = token
    return out


def decode(encoded: DataFrame, ranks: dict[bytes, int] | None = None) -> DataFrame:
    """``encoded`` with ``bytes``, what its ids stand for: every id joined to the table of token
    bytes, which is as large as the vocabulary, and the bytes of a row put together.

    Null ids, and ids that the table lacks, give null bytes; no ids give empty bytes.
    """
    sent = encoded.sparkSession.sparkContext.broadcast(_by_id(ranks or load_ranks()))

    def batches(source):
        tokens = pa.array(sent.value, pa.binary())
        for b in source:
            ids = b.column("ids")
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), ids, decoded(tokens, ids)],
                                             names=["doc_id", "ids", "bytes"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"),
                          F.col("ids").cast("array<int>").alias("ids")).mapInArrow(
        batches, "doc_id long, ids array<int>, bytes binary")


def op11_word_shuffle_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = load_ranks()
    by_id = spark.sparkContext.broadcast(_by_id(ranks))
    return encode(table(spark, sf_dir, "documents"), ranks, finish=_digests(by_id),
                  schema="doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

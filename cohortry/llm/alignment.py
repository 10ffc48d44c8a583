"""Two tokenizers side by side: which of their tokens cover the same bytes, and how usual that is.

Texts are shuffled whole, so that equal ones meet: each distinct text is tokenised and aligned
once, and what it adds to the counts of id pairs is weighted with the number of documents that
have it. A task numbers the distinct pairs of a chunk of texts and keeps each text as the list of
its pair numbers. Only the pairs of a chunk, one row each with its documents, are shuffled to be
counted; the counts go back to the chunk. The measures of a text are joined to its doc_ids by the
SHA-256 of the text; texts that very many documents share are joined by broadcast, so they do not
put their documents into one task.
"""

from __future__ import annotations

import hashlib
import json
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.llm.common import table, texts, written
from cohortry.llm.packing import (Chunks, byte_rows, common_first, flat_bytes, gathered, pack,
                                  unpack)
from cohortry.session import settle

BYTE_BPE_FILE, PIECE_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
# Characters of text in a chunk, and characters tokenised at once.
CHUNK_CHARS, GROUP_CHARS = 12_000_000, 1_000_000
# Texts of more documents than this are joined to their documents by broadcast, if they fit.
HOT_COPIES = 1000
SHIFT = 32  # a pair of ids is one number: the first id above, the second below


def _path(name: str, path: str | None) -> str:
    if path is None:
        import public_tokenizers
        path = public_tokenizers.path(name)
    return path


# --- inside tasks -----------------------------------------------------------------

def byte_signs() -> dict[str, int]:
    """The sign that stands for each byte in a byte-level vocabulary: printable Latin-1 signs
    stand for themselves, the other bytes take the code points from 256 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteLevel:
    """Tokens of a byte-level vocabulary file; ``tokens`` has the bytes of each id.

    The file's merges make its tokens in the order of their ids, so merging the pair with the
    lowest id first is the file's own rule, and the faster library for ranks gives its ids.
    """

    def __init__(self, path: str | None = None):
        import public_tokenizers
        import tiktoken
        with open(_path(BYTE_BPE_FILE, path), encoding="utf-8") as f:
            parts = json.load(f)
        signs = byte_signs()
        special = {t["content"] for t in parts["added_tokens"]}
        ranks = {bytes(signs[c] for c in token): i for token, i in parts["model"]["vocab"].items()
                 if token not in special}
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.tokens[i] = token
        self.model = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN,
                                       mergeable_ranks=ranks, special_tokens={})

    def __call__(self, values: list[str]) -> list[list[int]]:
        return [self.model.encode_ordinary(" " + t) for t in values]


class PieceLevel:
    """Tokens of a piece vocabulary, which puts a space before a text itself."""

    def __init__(self, path: str | None = None):
        import sentencepiece
        self.model = p = sentencepiece.SentencePieceProcessor(model_file=_path(PIECE_FILE, path))
        self.tokens = [bytes([int(p.id_to_piece(i)[3:5], 16)]) if p.is_byte(i)
                       else p.id_to_piece(i).replace("▁", " ").encode()
                       for i in range(p.get_piece_size())]

    def __call__(self, values: list[str]) -> list[list[int]]:
        return self.model.encode(values, num_threads=1)


class Side:
    """The tokens of some texts by one tokenizer: ids one after the other, and their lengths."""

    def __init__(self, lists: list[list[int]], tokens: pa.Array):
        self.sizes = np.array([len(x) for x in lists], np.int64)
        self.ids = np.fromiter(chain.from_iterable(lists), np.int64, int(self.sizes.sum()))
        self.data, at = flat_bytes(pc.take(tokens, pa.array(self.ids)))
        self.lengths = np.diff(at)
        self.text_ends = at[np.cumsum(self.sizes)]

    def equal(self, raw: list[bytes]) -> np.ndarray:
        """Which texts have exactly these bytes."""
        data, z = self.data.tobytes(), self.text_ends.tolist()
        return np.array([data[a:b] == r for a, b, r in zip([0, *z[:-1]], z, raw)], bool)

    def drop(self, bad: np.ndarray) -> None:
        keep = ~np.repeat(bad, self.sizes)
        self.ids, self.lengths = self.ids[keep], self.lengths[keep]
        self.sizes = np.where(bad, 0, self.sizes)

    def sums(self, values: np.ndarray) -> np.ndarray:
        upto = np.r_[0, np.cumsum(values)]
        ends = np.cumsum(self.sizes)
        return upto[ends] - upto[ends - self.sizes]


class Aligner:
    """Aligns the tokens of two tokenizers; ``a`` and ``b`` give lists of ids for texts and have
    the bytes of their tokens."""

    def __init__(self, a, b):
        self.a, self.b = a, b
        self.tables = [pa.array(t.tokens, pa.binary()) for t in (a, b)]
        # How a token is written in the groups: inside and at the end of its side of a group.
        self.written = pa.array([f"{i}{sign}" for t, signs in ((a, ",|"), (b, ",;"))
                                 for sign in signs for i in range(len(t.tokens))], pa.string())

    def __call__(self, values: list[str]):
        """(n_a, n_b, n_groups, n_links, digests, pairs): an entry for each text, and the id pair
        of each link. Texts whose bytes either tokenizer changes have no tokens."""
        raw = [(" " + t).encode() for t in values]
        a, b = (Side(t(values), own) for t, own in zip((self.a, self.b), self.tables))
        bad = ~(a.equal(raw) & b.equal(raw)) | np.array([not t for t in values], bool)
        if bad.any():
            a.drop(bad)
            b.drop(bad)
        # Texts stand one after the other, so ends and starts are places in all of them.
        a_end, b_end = np.cumsum(a.lengths), np.cumsum(b.lengths)
        a_start, b_start = a_end - a.lengths, b_end - b.lengths
        low = np.searchsorted(b_end, a_start, side="right")
        high = np.searchsorted(b_start, a_end, side="left")
        width = high - low
        pairs = np.repeat(a.ids, width) << SHIFT | b.ids[gathered(low, width)]
        a_cut, b_cut = np.isin(a_end, b_end), np.isin(b_end, a_end)
        return (a.sizes, b.sizes, a.sums(a_cut), a.sums(width),
                self._digests(a, b, a_cut, b_cut), pairs)

    def _digests(self, a: Side, b: Side, a_cut: np.ndarray, b_cut: np.ndarray) -> list[str]:
        groups = int(a_cut.sum())
        a_group, b_group = np.cumsum(a_cut) - a_cut, np.cumsum(b_cut) - b_cut
        b_upto = np.r_[0, np.cumsum(np.bincount(b_group, minlength=groups))]
        a_upto = np.r_[0, np.cumsum(np.bincount(a_group, minlength=groups))]
        order = np.empty(len(a.ids) + len(b.ids), np.int64)
        n_a, n_b = (len(t.tokens) for t in (self.a, self.b))
        order[np.arange(len(a.ids)) + b_upto[a_group]] = a.ids + n_a * a_cut
        order[np.arange(len(b.ids)) + a_upto[b_group + 1]] = 2 * n_a + b.ids + n_b * b_cut
        data, at = flat_bytes(pc.take(self.written, pa.array(order)))
        data, ends = data.tobytes(), at[np.cumsum(a.sizes + b.sizes)].tolist()
        return [hashlib.sha256(data[s:z - 1]).hexdigest() if z > s else ""
                for s, z in zip([0, *ends[:-1]], ends)]


def _chunk_batches(make, chunk_chars: int):
    """Rows of texts with their links as pair numbers (no is null), and rows of pairs."""
    names = ["chunk", "sha", "copies", "n_a", "n_b", "n_groups", "n_links", "groups_sha256",
             "links", "no", "a", "b", "docs"]
    types = [pa.int64(), pa.binary(), *[pa.int64()] * 5, pa.string(), pa.binary(), *[pa.int64()] * 4]

    def run(batches):
        align, chunks = make(), Chunks()
        values: list[str] = []
        sha: list[bytes] = []
        copies: list[int] = []
        parts: list[tuple] = []
        size = held = 0

        def aligned():
            parts.append(align(values))
            values.clear()

        def flush():
            n_a, n_b, n_groups, n_links = (np.concatenate([p[i] for p in parts]) for i in range(4))
            digests = list(chain.from_iterable(p[4] for p in parts))
            distinct, no = common_first(np.concatenate([p[5] for p in parts]))
            ends = np.cumsum(n_links)
            # A pair's documents: each text that has it, as often as the text occurs.
            row = np.repeat(np.arange(len(sha)), n_links)
            once = np.unique(no * len(sha) + row) if len(sha) else no
            times = np.array(copies, np.int64)
            docs = np.zeros(len(distinct), np.int64)
            np.add.at(docs, once // max(1, len(sha)), times[once % max(1, len(sha))])
            own = chunks.number()
            cols = [[own] * len(sha), sha, times, n_a, n_b, n_groups, n_links, digests, None]
            rows = [pa.array(c, t) for c, t in zip(cols[:-1], types)] + [pack(no, ends)]
            yield pa.RecordBatch.from_arrays(
                rows + [pa.nulls(len(sha), t) for t in types[9:]], names=names)
            yield pa.RecordBatch.from_arrays(
                [pa.array([own] * len(distinct), pa.int64()),
                 *[pa.nulls(len(distinct), t) for t in types[1:9]],
                 pa.array(np.arange(len(distinct))), pa.array(distinct >> SHIFT),
                 pa.array(distinct & ((1 << SHIFT) - 1)), pa.array(docs)], names=names)
            for x in (sha, copies, parts):
                x.clear()

        for batch in batches:
            for t, s, n in zip(batch.column("text"), batch.column("sha"), batch.column("copies")):
                values.append(t.as_py())
                sha.append(s.as_py())
                copies.append(n.as_py())
                held += len(values[-1]) + 16
                size += len(values[-1]) + 16
                if held >= GROUP_CHARS:
                    aligned()
                    held = 0
                if size >= chunk_chars:
                    if values:
                        aligned()
                    yield from flush()
                    size = held = 0
        if values:
            aligned()
        if parts:
            yield from flush()
    return run


def _measures(key, rows: pa.Table, counts: pa.Table) -> pa.Table:
    """Sums over the links of each text, from the counts of the chunk's pairs."""
    number = counts.column("no").to_numpy()
    n, best = np.zeros(len(number), np.int64), np.zeros(len(number), np.int64)
    n[number] = counts.column("n").to_numpy()
    best[number] = counts.column("best").to_numpy().astype(np.int64)
    links, ends = unpack(rows.column("links"))
    cuts = np.r_[0, ends]
    for name, values in (("n_best", best), ("count_sum", n)):
        upto = np.r_[0, np.cumsum(values[links])]
        rows = rows.append_column(name, pa.array(np.diff(upto[cuts])))
    return rows.drop_columns(["chunk", "links"])


# --- the Spark part -----------------------------------------------------------------

def pair_counts(pairs: DataFrame) -> DataFrame:
    """(a, b, n, best) from rows (a, b, docs): the documents of each id pair, and whether no pair
    of the first id has more. The largest counts have a row for each first id, as many as the
    vocabulary has at most."""
    counts = written(pairs.groupBy("a", "b").agg(F.sum("docs").alias("n")), "pair-counts")
    most = counts.groupBy("a").agg(F.max("n").alias("most"))
    return counts.join(F.broadcast(most), "a").select(
        "a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def measured(docs: DataFrame, make=None, chunk_chars: int = CHUNK_CHARS,
             hot_copies: int = HOT_COPIES) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row.

    ``make`` builds the ``Aligner`` inside a task. Groups are cut where tokens of both end; links
    are the pairs of overlapping tokens; a pair's count is how many rows of ``docs`` hold it;
    n_best counts the links whose pair has the highest count of its first id, ties included.
    Null, empty and changed texts have no tokens: zeros and no digest. Rows that repeat, share an
    id or have none count each by itself. An empty table gives no rows.
    """
    make = make or (lambda: Aligner(ByteLevel(), PieceLevel()))
    rows = texts(docs)
    sha = F.unhex(F.sha2(F.col("text").cast("binary"), 256))
    distinct = rows.groupBy("text").agg(F.count(F.lit(1)).alias("copies")).select(
        "text", sha.alias("sha"), "copies")
    made = written(distinct.mapInArrow(
        _chunk_batches(make, chunk_chars), "chunk long, sha binary, copies long, n_a long, "
        "n_b long, n_groups long, n_links long, groups_sha256 string, links binary, no long, "
        "a long, b long, docs long"), "aligned", "zstd")
    pairs = made.where("no IS NOT NULL").select(F.col("chunk").alias("of"), "no", "a", "b", "docs")
    answers = pairs.join(pair_counts(pairs), ["a", "b"]).select("of", "no", "n", "best")
    of_text = made.where("no IS NULL").drop("no", "a", "b", "docs")
    found = written(of_text.groupBy("chunk").cogroup(answers.groupBy("of")).applyInArrow(
        _measures, "sha binary, copies long, n_a long, n_b long, n_groups long, n_links long, "
        "groups_sha256 string, n_best long, count_sum long"), "measures", "zstd")
    ids = written(rows.select("doc_id", sha.alias("sha")), "digests", "zstd")
    hot = settle(found.where(F.col("copies") > hot_copies))
    rest = ids.join(hot.select("sha"), "sha", "left_anti")
    return ids.join(hot, "sha").unionByName(
        rest.join(found.where(F.col("copies") <= hot_copies), "sha")).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op12_text_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measured(table(spark, sf_dir, "documents"))

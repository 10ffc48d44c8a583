"""SentencePiece encoding by sampled segmentation, and lossless decoding.

A text's segmentations form a lattice of pieces. Forward filtering sums the weights of all ways
to reach a position; backward sampling then draws pieces from the end, each with its share of
the way. Random numbers are hashes of the row key, the place in the text and the step, so a
rerun, another partitioning or a lost executor gives the same ids.

No piece of such a vocabulary has a space sign behind another sign, so the lattice falls apart
before each run of spaces, and parts of a text are sampled on their own, exactly. The forward sums of a
part are computed once per batch for all its occurrences, and for parts of equal length together.
Signs that the vocabulary lacks become bytes, and so does a literal space sign: decoding is exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.llm.common import NO_ID, table, texts

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
# Weight of a piece: (rank in the vocabulary) ** -SHARPNESS. 0 would make all ways equal.
SHARPNESS, SEED = 0.5, 42
# Symbols taken together; bounds what a task holds besides its longest text.
BATCH_SYMBOLS = 2_500_000
BLOCK_CELLS = 1_500_000
SPACE, BYTE0 = 0x2581, 0x110000
_U = np.uint64
_B, _K1, _K2 = _U(0x9E3779B97F4A7C15), _U(0xD1342543DE82EF95), _U(0xA0761D6478BD642F)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Pieces:
    """A vocabulary: pieces as arrays of symbols, found by hash and then compared.

    A symbol is a code point, or ``BYTE0`` plus a byte. ``strings`` holds None where an id is a
    control sign; byte pieces are written <0xNN>.
    """

    def __init__(self, strings: list[str | None], byte_ids: dict[int, int],
                 sharpness: float = SHARPNESS):
        self.raw = [b""] * len(strings)
        self.known = np.zeros(BYTE0, bool)
        of: dict[tuple, int] = {}
        for i, s in enumerate(strings):
            if s:
                self.raw[i] = s.replace("▁", " ").encode()
                of[tuple(map(ord, s))] = i
                if len(s) == 1:
                    self.known[ord(s)] = True
        for b, i in byte_ids.items():
            self.raw[i] = bytes([b])
            of[(BYTE0 + b,)] = i
        self.longest = max(map(len, of))
        keys = list(of)
        hashes = np.array([self._hash_tuple(k) for k in keys], np.uint64)
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        assert (self.hashes[1:] != self.hashes[:-1]).all(), "two pieces share a hash"
        self.ids = np.array([of[k] for k in keys], np.int32)[order]
        self.signs = np.full((len(keys), self.longest), -1, np.int64)
        for row, at in enumerate(order):
            self.signs[row, :len(keys[at])] = keys[at]
        self.log_weight = -sharpness * np.log1p(np.maximum(self.ids.astype(float), 1.0))
        # The pieces whose hash begins with the same 20 bits stand together; ``slot`` has the
        # first of them, or -1.
        slots = (self.hashes >> _U(44)).astype(np.int64)
        self.slot = np.full(1 << 20, -1, np.int32)
        self.slot[slots[::-1]] = np.arange(len(slots) - 1, -1, -1)
        self.per_slot = int(np.bincount(slots).max())

    @staticmethod
    def load(path: str = MODEL_PATH, sharpness: float = SHARPNESS) -> Pieces:
        import sentencepiece
        p = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(p.get_piece_size())
        special = [p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i) for i in ids]
        return Pieces([None if s else p.id_to_piece(i) for i, s in zip(ids, special)],
                      {int(p.id_to_piece(i)[3:5], 16): i for i in ids if p.is_byte(i)}, sharpness)

    @staticmethod
    def _hash_tuple(signs) -> int:
        h, m = 0, (1 << 64) - 1
        for s in reversed(signs):
            h = (int(_mix(np.array([s], np.uint64))[0]) + int(_B) * h) & m
        return h

    def symbols(self, text: str) -> np.ndarray:
        """The symbols of a text with a space before it; an empty text has none."""
        if not text:
            return np.zeros(0, np.int32)
        s = np.frombuffer((" " + text).encode("utf-32-le"), np.uint32).astype(np.int32)
        other = ~self.known[s] | (s == SPACE)
        other &= s != 32
        s[s == 32] = SPACE
        if not other.any():
            return s
        if s[other].max() < 128:
            s[other] += BYTE0
            return s
        width = np.ones(len(s), np.int64)
        size = 1 + (s > 0x7F).astype(np.int64) + (s > 0x7FF) + (s > 0xFFFF)
        width[other] = size[other]
        out = np.repeat(s, width)
        raw = "".join(map(chr, s[other])).encode()
        out[np.repeat(other, width)] = BYTE0 + np.frombuffer(raw, np.uint8).astype(np.int32)
        return out

    def decode(self, ids) -> str:
        """The text of a list of ids; exact for what ``encode_batch`` made."""
        raw = b"".join(map(self.raw.__getitem__, ids))
        return (raw[1:] if raw[:1] == b" " else raw).decode(errors="replace")

    # --- the lattice of parts of one length ------------------------------------------

    def _find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows of h that are a piece's hash, numbers of the pieces)."""
        at = self.slot[(h >> _U(44)).astype(np.int64)]
        rows = np.flatnonzero(at >= 0)
        at = at[rows]
        same = self.hashes[at] == h[rows]
        found, numbers = [rows[same]], [at[same]]
        for _ in range(self.per_slot - 1):
            rows, at = rows[~same], at[~same] + 1
            inside = at < len(self.hashes)
            rows, at = rows[inside], at[inside]
            same = self.hashes[at] == h[rows]
            found.append(rows[same])
            numbers.append(at[same])
        return np.concatenate(found), np.concatenate(numbers)

    def _ways(self, parts: np.ndarray, exact: bool):
        """(cdf, ids), each (parts, end, length - 1): the chance that the last piece of a way
        to ``end`` has at most that length, and the piece."""
        n, size = parts.shape
        k_max = min(size, self.longest)
        mixed = np.ascontiguousarray(_mix(parts.astype(np.uint64)).T)
        alpha = np.full((size + 1, n), -np.inf)
        alpha[0] = 0.0
        cdf = np.full((n, size + 1, k_max), 2.0, np.float32)
        ids = np.zeros((n, size + 1, k_max), np.int32)
        for end in range(1, size + 1):
            k_end = min(end, k_max)
            way = np.full((k_end, n), -np.inf)
            h = np.zeros(n, np.uint64)
            for k in range(1, k_end + 1):
                h = mixed[end - k] + _B * h
                rows, at = self._find(h)
                if exact and len(rows):
                    true = (self.signs[at, :k] == parts[rows, end - k:end]).all(axis=1)
                    rows, at = rows[true], at[true]
                way[k - 1, rows] = alpha[end - k, rows] + self.log_weight[at]
                ids[rows, end, k - 1] = self.ids[at]
            top = way.max(axis=0)
            p = np.exp(way - top)
            c = np.cumsum(p, axis=0)
            alpha[end] = top + np.log(c[-1])
            c /= c[-1]
            last = k_end - 1 - np.argmax(p[::-1] > 0, axis=0)
            c[np.arange(k_end)[:, None] >= last] = 2.0
            cdf[:, end, :k_end] = c.T
        return cdf, ids

    def encode_batch(self, symbols: list[np.ndarray], keys: np.ndarray,
                     exact: bool = False) -> tuple:
        """(offsets, ids): sampled ids of texts given as symbols, by row keys (uint64).

        Pieces are found by 64-bit hashes; ``exact`` also compares their symbols.
        """
        sizes = np.array([len(s) for s in symbols], np.int64)
        s = np.concatenate(symbols) if len(symbols) else np.zeros(0, np.int32)
        doc_start = np.r_[0, np.cumsum(sizes)]
        if not len(s):
            return np.zeros(len(symbols) + 1, np.int32), np.zeros(0, np.int32)
        head = (s == SPACE) & np.r_[True, s[:-1] != SPACE]
        head[doc_start[:-1][sizes > 0]] = True
        start = np.flatnonzero(head)
        length = np.diff(np.r_[start, len(s)])
        doc = np.searchsorted(doc_start, start, side="right") - 1
        first = np.searchsorted(start, doc_start[doc])
        place = np.arange(len(start)) - first

        order, bound = self._distinct(s, start, length)
        rep = order[bound[:-1]]
        seed = _mix(keys[doc] + place.astype(np.uint64) * _K1)
        size_of = length[rep]
        occ_all, step_all, id_all = [], [], []
        count = np.zeros(len(start), np.int64)
        by_size = np.argsort(size_of, kind="stable")
        edges = np.r_[np.flatnonzero(np.r_[True, np.diff(size_of[by_size]) > 0]), len(by_size)]
        for lo, hi in zip(edges[:-1], edges[1:]):
            size = int(size_of[by_size[lo]])
            step = max(1, BLOCK_CELLS // ((size + 1) * min(size, self.longest)))
            for b in range(lo, hi, step):
                parts = by_size[b:min(b + step, hi)]
                cdf, ids = self._ways(
                    s[start[rep[parts]][:, None] + np.arange(size)], exact)
                many = bound[parts + 1] - bound[parts]
                local = np.repeat(np.arange(len(parts)), many)
                shift = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                occ = order[np.repeat(bound[parts], many) + shift]
                pos, turn = np.full(len(occ), size), 0
                turn_key = np.zeros(1, np.uint64)
                while len(occ):
                    draw = _mix(seed[occ] + turn_key) >> _U(11)
                    u = draw.astype(np.float64) / float(1 << 53)
                    k = (u[:, None] >= cdf[local, pos]).sum(axis=1)
                    occ_all.append(occ)
                    step_all.append(np.full(len(occ), turn, np.int32))
                    id_all.append(ids[local, pos, k])
                    count[occ] += 1
                    pos = pos - k - 1
                    open_ = pos > 0
                    occ, local, pos, turn = occ[open_], local[open_], pos[open_], turn + 1
                    turn_key = turn_key + _K2
        stop = np.cumsum(count)
        out = np.zeros(int(stop[-1]), np.int32)
        for occ, t, i in zip(occ_all, step_all, id_all):
            out[stop[occ] - 1 - t] = i
        parts_before = np.r_[np.searchsorted(start, doc_start[:-1]), len(start)]
        return np.r_[0, stop][parts_before].astype(np.int32), out

    @staticmethod
    def _distinct(s, start, length):
        """(order, bounds): parts sorted so that equal ones stand together, and where each
        run of equal parts begins. Parts are sorted by a hash and compared with the first of
        their run; should two differ, another hash is taken."""
        inside = (np.arange(len(s)) - np.repeat(start, length)).astype(np.int32)
        salt = np.ones(1, np.uint64)
        while True:
            powers = np.cumprod(np.repeat(_B * (salt + salt - _U(1)), int(length.max())))
            h = np.add.reduceat(_mix(s.astype(np.uint64) + salt) * powers[inside], start)
            order = np.argsort(h, kind="stable")
            new = np.r_[True, np.diff(h[order]) != 0]
            first = np.empty(len(order), np.int64)
            first[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1]
            if (length[first] == length).all() and (
                    s[np.repeat(start[first], length) + inside] == s).all():
                return order, np.r_[np.flatnonzero(new), len(order)]
            salt = salt + _U(1)


def encode(docs: DataFrame, pieces: Pieces | None = None, seed: int = SEED) -> DataFrame:
    """(doc_id, ids, n_pieces, lossless) of every row of ``docs``.

    Null text is empty text and has no ids. Rows that repeat a doc_id and text repeat the ids:
    the row key is the id, -2^63 for a null one. ``lossless`` decodes the ids and compares.
    """
    pieces = pieces or Pieces.load()
    sent = docs.sparkSession.sparkContext.broadcast(pieces)

    def flush(p, ids, values, symbols, keys):
        for exact in (False, True):  # the second time only if hashes of symbols collided
            offsets, flat = p.encode_batch(symbols, np.array(keys, np.uint64), exact)
            listed = flat.tolist()
            same = [p.decode(listed[a:b]) == t
                    for a, b, t in zip(offsets[:-1], offsets[1:], values)]
            if all(same):
                break
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()),
             pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
             pa.array(np.diff(offsets).astype(np.int64)), pa.array(same)],
            names=["doc_id", "ids", "n_pieces", "lossless"])

    def batches(source):
        p = sent.value
        for b in source:
            held, ids, values, symbols, keys = 0, [], [], [], []
            for doc_id, key, t in zip(b.column("doc_id"), b.column("key"), b.column("text")):
                t = t.as_py()
                sym = p.symbols(t)
                ids.append(doc_id.as_py())
                values.append(t)
                symbols.append(sym)
                keys.append(key.as_py() & ((1 << 64) - 1))
                held += len(sym)
                if held >= BATCH_SYMBOLS:
                    yield flush(p, ids, values, symbols, keys)
                    held, ids, values, symbols, keys = 0, [], [], [], []
            if ids:
                yield flush(p, ids, values, symbols, keys)

    rows = texts(docs).withColumn("key", F.xxhash64(F.coalesce("doc_id", F.lit(NO_ID)), F.lit(seed)))
    return rows.mapInArrow(
        batches, "doc_id long, ids array<int>, n_pieces long, lossless boolean")


def decode(encoded: DataFrame, pieces: Pieces | None = None) -> DataFrame:
    """(doc_id, text) from (doc_id, ids). Null ids give null text, no ids the empty text."""
    pieces = pieces or Pieces.load()
    sent = encoded.sparkSession.sparkContext.broadcast(pieces)

    def batches(source):
        p = sent.value
        for b in source:
            out = [None if i is None else p.decode(i) for i in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.string())],
                                             names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(
        batches, "doc_id long, text string")


def op1_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))

"""Lists of small numbers as bytes, and rows gathered into chunks of bounded size.

Operators that look up something for every word of a text number the distinct words of a chunk.
Only these are shuffled to be looked up; the texts become lists of numbers, a byte or two each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def pack(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary array of lists of numbers >= 0; list i ends before ``values[ends[i]]``.

    Seven bits a byte, lowest first; the last byte of a number is below 128.
    """
    v = np.asarray(values, np.int64)
    width = np.ones(len(v), np.int64)
    for bits in range(7, 63, 7):
        if not (more := v >= np.int64(1) << bits).any():
            break
        width += more
    upto = np.r_[0, np.cumsum(width)]
    out = np.empty(upto[-1], np.uint8)
    for k in range(int(width.max(initial=0))):
        on = np.flatnonzero(width > k)
        out[upto[on] + k] = (v[on] >> (7 * k) & 127) | np.where(width[on] > k + 1, 128, 0)
    return byte_rows(out, upto[np.r_[0, np.asarray(ends, np.int64)]])


def unpack(column) -> tuple[np.ndarray, np.ndarray]:
    """(values, ends) of a packed column, as ``pack`` took them."""
    buf, at = flat_bytes(column)
    last = np.flatnonzero(buf < 128)
    first = np.r_[0, last[:-1] + 1] if len(last) else last
    width = last - first + 1
    values = np.zeros(len(last), np.int64)
    for k in range(int(width.max(initial=0))):
        on = np.flatnonzero(width > k)
        values[on] |= (buf[first[on] + k] & 127).astype(np.int64) << (7 * k)
    return values, np.searchsorted(last, at[1:], side="left")


def byte_rows(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary array of ``data`` cut at ``offsets``."""
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [
        None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def flat_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a binary or string column without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):  # several chunks stay apart only if there are none
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.binary())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    at = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[
        column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return data[at[0]:at[-1]], at - at[0]


def gathered(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions of runs, one run after the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def common_first(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct, numbers): the distinct codes, the most frequent first, and the number of each
    code among them. Small numbers pack into one byte."""
    distinct, number, n = np.unique(codes, return_inverse=True, return_counts=True)
    order = np.argsort(-n, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return distinct[order], rank[number.reshape(-1)]


class Chunks:
    """Numbers for the chunks of a task; unique in one written table."""

    def __init__(self):
        from pyspark import TaskContext
        self.next = TaskContext.get().partitionId() << 32

    def number(self) -> int:
        self.next += 1
        return self.next

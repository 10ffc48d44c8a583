"""Values and rows as text."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the sentence template.
PREFIX, JOIN, SUFFIX = "This patient's ", ", ", "."
MISSING = "undefined"

# What counts as white space at the ends of a string value.
WHITESPACE = "".join(chr(c) for c in (
    *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
# A word is a run of ASCII letters and digits; any other sign but ASCII white space is a mark.
WORD = r"[A-Za-z0-9]+|[^A-Za-z0-9\s]"
# What a byte of UTF-8 is: of a word, the first of a mark, or neither.
IN_WORD, MARK = 1, 2
BYTE_KINDS = bytes(IN_WORD if chr(b).isascii() and chr(b).isalnum() else
                   0 if b in b" \t\n\x0b\f\r" or 0x80 <= b < 0xC0 else MARK for b in range(256))
# Bytes of texts that are looked at together.
BYTES_AT_ONCE = 1 << 20


def number_text(x: Column) -> Column:
    """Whole numbers without a point, others with up to ten significant digits.

    Digits are rounded half up on the shortest decimal form of the number. Whole
    numbers are exact up to 2^53.
    """
    x = x.cast("double")
    # Most numbers have few digits, and then their shortest form is the answer.
    short = x.cast("string")
    few = (F.length(short) <= 11) & ~F.contains(short, F.lit("E"))
    digits = F.format_string("%.9e", x)
    power = F.substring_index(digits, "e", -1)
    mantissa = F.regexp_replace(F.substring_index(digits, "e", 1), r"\.?0+$", "")
    plain = F.regexp_replace(digits.cast("decimal(38,18)").cast("string"), r"\.?0+$", "")
    whole = x.cast("decimal(38,0)").cast("string")
    return (F.when(F.abs(x) == float("inf"), F.when(x > 0, "inf").otherwise("-inf"))
            .when(x == F.floor(x), F.when(F.abs(x) < 1e37, whole))
            .when(few, F.rtrim(short, F.lit("0")))
            .when(power.cast("int").between(-4, 9), plain)
            .otherwise(F.concat(mantissa, F.lit("e"), power)))


def value_text(c: Column, kind: T.DataType) -> Column:
    """One cell as text, NULL if missing. Empty text is missing."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        d = c.cast("double")
        return F.when(d.isNotNull() & ~F.isnan(d), number_text(d))
    if isinstance(kind, T.BooleanType):
        return c.cast("int").cast("string")
    if isinstance(kind, T.IntegralType):
        return c.cast("string")
    return F.nullif(F.btrim(c.cast("string"), F.lit(WHITESPACE)), F.lit(""))


def field_text(label: str, value: Column, missing: str = MISSING) -> Column:
    return F.concat(F.lit(f"{label} is "), F.coalesce(value, F.lit(missing)))


def passage(labels: Mapping[str, str], values: Mapping[str, Column],
            columns: Sequence[str]) -> Column:
    """A sentence with every given field, in order, missing ones included."""
    parts = [field_text(labels[c], values[c]) for c in columns]
    return F.concat(F.lit(PREFIX), F.concat_ws(JOIN, *parts), F.lit(SUFFIX))


def word_count(text: Column) -> Column:
    """Words and marks: a stand-in where no tokenizer is given.

    The matches of ``WORD``, counted on the bytes of many texts together: a match for each word
    that begins and each mark. A regular expression would make every match a text of its own.
    """
    kinds, in_word, mark = np.frombuffer(BYTE_KINDS, np.uint8), IN_WORD, MARK
    at_once = BYTES_AT_ONCE

    @F.arrow_udf(T.IntegerType())
    def count(texts: pa.Array) -> pa.Array:
        n = len(texts)
        out = np.zeros(n, np.int32)
        wide = pa.types.is_large_string(texts.type)
        offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[
            texts.offset:texts.offset + n + 1] if n else np.zeros(1, np.int32)
        # Without any byte there may be no buffer, and all counts are zero.
        held = np.frombuffer(texts.buffers()[2], np.uint8) if offsets[-1] > offsets[0] else None
        lo = 0
        while held is not None and lo < n:
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + at_once, side="right")) - 1)
            at = offsets[lo:hi + 1].astype(np.int64) - offsets[lo]
            kind = kinds[held[offsets[lo]:offsets[hi]]]
            word = kind == in_word
            begins = word.copy()
            begins[1:] &= ~word[:-1]
            starts = at[:-1][at[:-1] < at[1:]]
            begins[starts] = word[starts]
            found = np.flatnonzero(begins | (kind == mark))
            out[lo:hi] = np.diff(np.searchsorted(found, at))
            lo = hi
        nulls = texts.is_null().to_numpy(zero_copy_only=False) if texts.null_count else None
        return pa.array(out, mask=nulls)
    return count(text)


def counter_from(tokenize: Callable[[list[str]], list[int]]) -> Callable[[Column], Column]:
    """A token counter column from a tokenizer that counts a list of texts."""
    @F.pandas_udf(T.IntegerType())
    def count(texts: pd.Series) -> pd.Series:
        return pd.Series(tokenize(texts.tolist()))
    return count

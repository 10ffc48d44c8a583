"""Reproducible pseudo-random numbers computed from row keys.

They depend on the key alone, so a retried task, another partitioning or another
engine gives the same numbers.
"""

from __future__ import annotations

import math
import zlib

from pyspark.sql import Column
from pyspark.sql import functions as F

SEED = 42

# A Mersenne prime: products of two values below it stay inside a signed 64-bit
# integer, so the arithmetic below is the same on any SQL engine.
PRIME = 2147483647
MIX_A, MIX_B, MIX_C = 1664525, 1013904223, 69069
LANES = ((1103515245 % (1 << 30), 747796405, 12345), (277803737, 1181783497 % (1 << 30), 97531))


def label_seed(label: str, seed: int = SEED) -> int:
    """The seed of one outcome: shared by its models, different between outcomes."""
    return seed + zlib.crc32(label.encode()) % 10_000


def label_seed_col(label: Column, seed: int = SEED) -> Column:
    return F.crc32(label.cast("binary")) % 10_000 + seed


def hash_key(seed: Column | int | str, row_id: Column) -> Column:
    """32 hex digits that order rows at random under one seed."""
    s = seed if isinstance(seed, Column) else F.lit(str(seed))
    return F.md5(F.concat(s.cast("string"), F.lit(":"), row_id.cast("string")))


def uniform(seed: Column | int | str, row_id: Column) -> Column:
    """A double in [0, 1) from the first 52 bits of ``hash_key``."""
    head = F.substring(hash_key(seed, row_id), 1, 13)
    return F.conv(head, 16, 10).cast("double") / float(16**13)


def _scramble(x: Column) -> Column:
    x = (x.bitwiseXOR(F.shiftright(x, 15)) * MIX_A) % PRIME
    x = (x.bitwiseXOR(F.shiftright(x, 13)) * MIX_B) % PRIME
    return x.bitwiseXOR(F.shiftright(x, 16))


def row_lane(row_id: Column, lane: int) -> Column:
    """One of two independent 31-bit hashes of an integer row key."""
    k1, k2, k3 = LANES[lane]
    low = row_id.bitwiseAND(F.lit(PRIME))
    high = F.shiftright(row_id, 31).bitwiseAND(F.lit(PRIME))
    return _scramble((low * k1 + high * k2 + k3) % PRIME)


def draw_hash(lane0: Column, lane1: Column, draw: Column) -> Column:
    """31 bits for (row, draw).

    Two lanes make the family pairwise independent over rows: two rows share all
    their draws only if both lanes collide.
    """
    m = (draw.cast("long") * MIX_C + 1) * MIX_C % PRIME
    return _scramble((lane0 * m + lane1) % PRIME)


def poisson_cuts(max_weight: int = 11) -> list[int]:
    """Cut points of the Poisson(1) distribution function on a 31-bit integer."""
    cum, cuts = 0.0, []
    for k in range(max_weight + 1):
        cum += math.exp(-1.0) / math.factorial(k)
        cuts.append(min(round(cum * (1 << 31)), 1 << 31))
    return cuts


def poisson_weight(h: Column) -> Column:
    """How often a row is drawn, from its hash."""
    cuts = poisson_cuts()
    w = F.when(h < cuts[0], 0)
    for k, cut in enumerate(cuts[1:], 1):
        w = w.when(h < cut, k)
    return w.otherwise(len(cuts))

"""Keyed permutations of 0..n-1 as column expressions: no sort, no state."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

ROUNDS = 4
#: steps of a walk back into the domain at most
WALK = 64


def keyed_permutation(rank: Column, n: int, key: Column, seed: int = 0) -> Column:
    """The place of ``rank`` (0..n-1) in the permutation that ``key`` and ``seed`` name.

    A rank is a pair (l, r) below (a, b), a * b >= n, both about the root of n. A Feistel round adds a hash of one half to the
    other, modulo that half's size, which can be undone: so each round, and all of them, permute the pairs. A pair that lands
    at n or beyond is permuted again until it comes back (cycle walking), which keeps it a permutation of 0..n-1. Fewer than
    a pairs lie beyond; if there are fewer than ``WALK``, the walk can't be longer than they are many, else its steps all
    miss with a chance below (1 / WALK) ** WALK."""
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    b = max(1, -(-n // a))

    def once(x: Column) -> Column:
        start = F.struct(F.floor(x / b).cast("long").alias("l"), F.pmod(x, F.lit(b)).cast("long").alias("r"))
        end = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, lambda s, i: _round(s, i, key, seed, a, b))
        return end["l"] * b + end["r"]

    first = once(rank.cast("long"))
    beyond = a * b - n
    if not beyond:
        return first
    return F.aggregate(F.sequence(F.lit(1), F.lit(min(beyond, WALK))), first, lambda x, _: F.when(x < n, x).otherwise(once(x)))


def _round(s: Column, i: Column, key: Column, seed: int, a: int, b: int) -> Column:
    """One Feistel round of the pair s: a hash of r is added to l, then one of the new l to r."""
    left = F.pmod(s["l"] + F.pmod(F.xxhash64(F.lit(seed), key, i, s["r"]), F.lit(a)), F.lit(a))
    return F.struct(left.cast("long").alias("l"), F.pmod(s["r"] + F.pmod(F.xxhash64(F.lit(seed + 1), key, i, left), F.lit(b)), F.lit(b)).cast("long").alias("r"))

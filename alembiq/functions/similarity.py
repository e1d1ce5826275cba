"""Similarity of packed bit fingerprints (arrays of 64-bit words) and of vectors, as columns."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)


def popcount(words: Column, n_words: int | None = None) -> Column:
    """Number of bits set. With a known number of words the sum is written out, and stays in generated code."""
    if n_words:
        return reduce(add, [F.bit_count(F.get(words, F.lit(i))) for i in range(n_words)]).cast("long")
    return _sum(F.transform(words, lambda x: F.bit_count(x).cast("long")))


def set_bits(words: Column, n_words: int | None = None) -> Column:
    """Positions of the bits set, from 0, ascending."""
    last = F.lit(64 * n_words - 1) if n_words else (F.size(words) * 64 - 1)
    bit = lambda i: F.call_function("shiftright", F.get(words, (i / 64).cast("int")), i % 64).bitwiseAND(F.lit(1)) == 1
    return F.when(F.size(words) > 0, F.filter(F.sequence(F.lit(0), last), bit)).otherwise(F.array().cast("array<int>"))


def pack_positions(positions: Column, n_words: int) -> Column:
    """Packed words in which the bits at the given positions are set."""
    one = F.lit(1).cast("long")
    word = lambda w: F.aggregate(F.filter(positions, lambda p: (p / 64).cast("int") == w), F.lit(0).cast("long"), lambda s, p: s.bitwiseOR(F.call_function("shiftleft", one, (p % 64).cast("int"))))
    return F.array(*[word(w) for w in range(n_words)])


def common_bits(a: Column, b: Column, n_words: int | None = None) -> Column:
    if n_words:
        return reduce(add, [F.bit_count(F.get(a, F.lit(i)).bitwiseAND(F.get(b, F.lit(i)))) for i in range(n_words)]).cast("long")
    return _sum(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseAND(y)).cast("long")))


def tanimoto(common: Column, na: Column, nb: Column) -> Column:
    """Common over any bits; 0 where no bit is set."""
    return F.when(na + nb - common > 0, common / (na + nb - common)).otherwise(F.lit(0.0))


def dice(common: Column, na: Column, nb: Column) -> Column:
    return F.when(na + nb > 0, 2 * common / (na + nb)).otherwise(F.lit(0.0))


def cosine_bits(common: Column, na: Column, nb: Column) -> Column:
    return F.when((na > 0) & (nb > 0), common / F.sqrt(na * nb)).otherwise(F.lit(0.0))


METRICS: dict[str, Callable[[Column, Column, Column], Column]] = {"tanimoto": tanimoto, "dice": dice, "cosine": cosine_bits}


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 where either has no length."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def pack_signs(v: Column, n: int) -> Column:
    """The signs of a vector of ``n`` values as packed words; positive values are set bits."""
    words = []
    for w in range(0, n, 64):
        bits = [F.when(F.get(v, F.lit(w + i)) > 0, F.shiftleft(F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")) for i in range(min(64, n - w))]
        words.append(reduce(lambda a, b: a.bitwiseOR(b), bits))
    return F.array(*words)


#: What the metrics can reach at most, from the numbers of set bits alone.
BOUNDS: dict[str, Callable[[Column, Column], Column]] = {m: (lambda na, nb, f=f: f(F.least(na, nb), na, nb)) for m, f in METRICS.items()}


def ranked_positions(v: Column, keep: int, group: int) -> Column:
    """A sparse code of a vector: bit (place, rank of its value / ``group``) for its ``keep`` largest values, equal ones in order of place."""
    order = F.slice(F.array_sort(F.transform(v, lambda x, i: F.struct((-x.cast("double")).alias("x"), i.alias("i")))), 1, keep)
    return F.transform(order, lambda s, r: s["i"] * (keep // group) + (r / group).cast("int"))

"""Evenly spread points as expressions of a row's number: the Halton sequence, plain or with scrambled digits."""

from __future__ import annotations

import math

import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Digits go on until they are worth less than this many bits; numbers have at most so many.
BITS = 53


def primes(n: int) -> list[int]:
    found: list[int] = []
    k = 2
    while len(found) < n:
        if all(k % p for p in found):
            found.append(k)
        k += 1
    return found


def permutation(base: int, place: int, seed: int) -> list[int]:
    """The digits of a base in an order drawn by a hash for a place behind the point."""
    return sorted(range(base), key=lambda digit: xxhash.xxh3_64_intdigest(f"{seed}/{base}/{place}/{digit}"))


def radical_inverse(number: Column, base: int, seed: int | None = None) -> Column:
    """The digits of a number (a long from 0) mirrored at the point; with a seed each place has its digits permuted, those of leading zeros as well."""
    terms = []
    for place in range(math.ceil(BITS / math.log2(base))):
        digit = F.floor(number / F.lit(base**place)) % base if place else number % base
        if seed is not None:
            digit = F.element_at(F.array(*map(F.lit, permutation(base, place, seed))), digit.cast("int") + 1)
        terms.append(digit.cast("double") * (1.0 / base ** (place + 1)))
    # the small terms first
    return sum(reversed(terms[:-1]), terms[-1])


def points(number: Column, dims: int, seed: int | None = None) -> list[Column]:
    """Coordinates in [0, 1), one for each of the first primes."""
    return [radical_inverse(number, b, seed) for b in primes(dims)]

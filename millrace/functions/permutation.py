"""Random orders with direct access: a seeded bijection of 0..n-1 as an expression.

``hash_order`` gives every row its place by sorting hashes.  A bijection computes the place of a number, and the number at a
place, from that number alone: no sort, no exchange, no table; a run that resumes at some place begins there.

The bijection is a swap-or-not network, which works on any n as it is: round r pairs x with ``K_r - x (mod n)``, and a bit
hashed from the larger of the two, the same for both, says whether they change places.  Undone in reverse order.  All numbers
are integers below 2^62, so other engines compute the same.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Modulus of the hash; products of two residues stay below 2^62.
PRIME = (1 << 31) - 1
ROUNDS = 48


@dataclass(frozen=True)
class Round:
    shift: int
    low: int
    high: int
    add: int


def rounds(seed, count: int = ROUNDS) -> list[Round]:
    """Constants of every round from the digits of md5s."""
    def number(r: int, part: int, bound: int) -> int:
        return int(hashlib.md5(f"{seed}:{r}:{part}".encode()).hexdigest()[:15], 16) % bound

    return [Round(number(r, 0, 1 << 59), 1 + number(r, 1, PRIME - 1), 1 + number(r, 2, PRIME - 1), number(r, 3, PRIME)) for r in range(count)]


def _walk(x: Column, n: Column, order: list[Round], salt: Column) -> Column:
    constants = F.array(*[
        F.struct(*[F.lit(v).cast("bigint").alias(k) for k, v in (("shift", r.shift), ("low", r.low), ("high", r.high), ("add", r.add))]) for r in order])

    prime = F.lit(PRIME).cast("bigint")

    def bound(value: Column, use: Callable[[Column], Column]) -> Column:
        """A list of one gives the value a name, so that it is computed once however often it is used."""
        return F.transform(F.array(value), use)[0]

    def step(at: Column, r: Column) -> Column:
        # The shift is below 2^59, the salted part below 2^62.
        def swapped(other: Column) -> Column:
            top = F.greatest(at, other)
            low = F.pmod(F.pmod(top, prime) * r["low"], prime)
            high = F.pmod(F.pmod(F.shiftright(top, 31), prime) * r["high"], prime)
            swap = lambda h: F.pmod(F.shiftright(F.pmod(h * h, prime), 11), F.lit(2)) == 1
            return F.when(bound(F.pmod(low + high + r["add"] + salt, prime), swap), other).otherwise(at)

        return bound(F.pmod(F.pmod(r["shift"] + salt * r["low"], n) - at, n), swapped)

    return F.when(n > 0, F.aggregate(constants, x.cast("bigint"), step))


def _bigint(x: Column | int) -> Column:
    return (F.lit(x) if isinstance(x, int) else x).cast("bigint")


def place_of(x: Column, n: Column | int, seed, salt: Column | None = None) -> Column:
    """Place of number ``x`` of 0..n-1 in the order of ``seed``; ``salt`` (0 to 2^31 - 2) tells orders of groups apart."""
    return _walk(x, _bigint(n), rounds(seed), F.lit(0).cast("bigint") if salt is None else salt.cast("bigint"))


def number_at(place: Column, n: Column | int, seed, salt: Column | None = None) -> Column:
    """Number at a place: the inverse of ``place_of``."""
    return _walk(place, _bigint(n), rounds(seed)[::-1], F.lit(0).cast("bigint") if salt is None else salt.cast("bigint"))

"""Random numbers and orders that replay: everything is a hash of (seed, keys).

``rand()`` depends on partitioning, so it is never used.  A number is the first eight hex
digits of an md5; an order is the md5 itself, whose leading digits give evenly filled
buckets that two passes over the data always agree on.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_RANGE = 4294967296  # 16 ** 8


def seeded_md5(seed, *keys: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys]))


def hash_prefix(md5_col: Column) -> Column:
    """First eight hex digits as BIGINT in [0, 2^32)."""
    return F.conv(F.substring(md5_col, 1, 8), 16, 10).cast("bigint")


def seeded_int(seed, *keys: Column) -> Column:
    return hash_prefix(seeded_md5(seed, *keys))


def seeded_number(seed, *keys) -> int:
    """``seeded_int`` of plain values, for code inside tasks."""
    return int(hashlib.md5(":".join(map(str, (seed, *keys))).encode()).hexdigest()[:8], 16)


def seeded_unit(seed, *keys: Column) -> Column:
    """Uniform DOUBLE in [0, 1)."""
    return seeded_int(seed, *keys) / F.lit(float(HASH_RANGE))


def seeded_below(bound: Column, seed, *keys: Column) -> Column:
    """Integer in [0, bound)."""
    return F.pmod(seeded_int(seed, *keys), bound.cast("bigint"))
